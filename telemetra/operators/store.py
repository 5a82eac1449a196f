"""Store-level operators: A1 rows per file, F6 files in a date range, A4 store
statistics, A5 store report, R1 expired files and their removal, W3 recent points.

File listings come from the ``binaryFile`` source without its ``content`` column, so
listing reads no file bodies (Spark keeps the list of files on the driver, as it does for
every scan); per-file row counts come from the ``_metadata`` column of the data scan. Paths
come from ``_metadata`` on both sides, so escaped directory names agree.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from telemetra.constants import RECENT_LOG_SIZE
from telemetra.session import scratch_path, written
from telemetra.sinks import manifest


# Data file name pattern of each store format as Spark writes it.
DATA_FILES = {
    "parquet": "*.parquet",
    "csv": "*.csv*",
    "csv_tags": "*.csv*",
    "jsonl": "*.json*",
}


def _path(uri: Column) -> Column:
    """A file's URI in one form: local paths come with one slash or with three."""
    return F.regexp_replace(uri, "^file:/+", "file:/").alias("path")


def scan_files(spark: SparkSession, base: str, fmt: str = "parquet") -> DataFrame:
    """The store's files as Spark scans them (one row per stored row or line), for the
    ``_metadata`` columns; no column is parsed."""
    if fmt == "parquet" and manifest.is_manifest(spark, base):
        return manifest.read_points(spark, base)
    if fmt == "parquet":
        return spark.read.parquet(base)
    if fmt in ("csv", "csv_tags"):
        return spark.read.option("header", True).csv(base)
    return spark.read.text(base)


def list_files(spark: SparkSession, base: str, fmt: str = "parquet", partitioned: bool = True) -> DataFrame:
    """Data files of a store: ``path`` (as ``_metadata`` writes it), ``length,
    modificationTime`` and the partition columns. Of a store with a manifest, the files that
    its newest version lists."""
    if manifest.is_manifest(spark, base):
        root = manifest.qualified(spark, base)
        listed = manifest.files(spark, base)
        return listed.select(_path(F.concat(F.lit(f"{root}/"), "path")), F.col("modified").alias("modificationTime"), "length", "date")
    reader = spark.read.format("binaryFile").option("pathGlobFilter", DATA_FILES.get(fmt, "*"))
    if not partitioned:
        reader = reader.option("recursiveFileLookup", "true")
    files = reader.load(base)
    return files.select(_path(F.col("_metadata.file_path")), *[c for c in files.columns if c not in ("path", "content")])


def files_in_range(spark: SparkSession, base: str, start: str | dt.date | None = None, end: str | dt.date | None = None, fmt: str = "parquet") -> DataFrame:
    """files whose ``date`` partition lies in ``[start, end]`` (partition pruning:
    directories outside the range are not listed)."""
    files = list_files(spark, base, fmt)
    if start is not None:
        files = files.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        files = files.where(F.col("date") <= F.lit(end).cast("date"))
    return files


def _with_listing(spark: SparkSession, base: str, fmt: str, rows: DataFrame) -> DataFrame:
    """Per-file ``rows`` for every listed file, empty ones included (``rows`` 0).

    ``rows`` holds a ``path`` per row found. Listing and rows are unioned and aggregated by
    path once, combined map-side; neither side is joined or broadcast."""
    files = list_files(spark, base, fmt)
    part = ["date"] if "date" in files.columns else []
    listed = files.select("path", *part, "length", F.lit(0).cast("bigint").alias("rows"), F.lit(1).alias("listed"))
    found = rows.select(
        "path", *[F.lit(None).cast("date").alias(p) for p in part],
        F.lit(None).cast("bigint").alias("length"), F.lit(1).cast("bigint").alias("rows"), F.lit(0).alias("listed"),
    )
    merged = listed.unionByName(found).groupBy("path").agg(
        *[F.max(p).alias(p) for p in part],
        F.max("length").alias("length"),
        F.sum("rows").alias("rows"),
        F.max("listed").alias("listed"),
    )
    return merged.where(F.col("listed") == 1).drop("listed")


def rows_per_file(spark: SparkSession, base: str, fmt: str = "parquet") -> DataFrame:
    """A1: rows in every data file, empty files included (``rows`` 0)."""
    data = scan_files(spark, base, fmt).select(_path(F.col("_metadata.file_path")))
    return _with_listing(spark, base, fmt, data)


def files_scanned(spark: SparkSession, base: str, fmt: str = "parquet") -> DataFrame:
    """The ``/query`` summary: number of files and rows scanned."""
    per_file = rows_per_file(spark, base, fmt)
    return per_file.agg(F.count(F.lit(1)).alias("files_scanned"), F.sum("rows").alias("rows"))


def query_points(
    spark: SparkSession,
    base: str,
    fmt: str = "parquet",
    metric: str | None = None,
    start=None,
    end=None,
    tags: dict[str, str] | None = None,
    recursive: bool = False,
    pattern: str | None = None,
    partitions: tuple[str, ...] = ("date",),
    event_dates: bool = False,
) -> DataFrame:
    """The read path: points of one store (any format) filtered by metric (empty = all),
    inclusive time range and tag values. On Parquet the metric, time and host filters are
    pushed into the scan. ``event_dates`` says that the store's ``date`` is that of the
    event, so the bounds prune directories too; in a store by arrival date a late point
    lies under another date, and only its timestamp may decide. ``recursive`` reads a
    plain directory tree (the collector's ``YYYY/MM/DD`` layout)."""
    from telemetra.operators import filters
    from telemetra.sources.points import read_store

    pts = read_store(spark, base, fmt, partitions, recursive=recursive, pattern=pattern)
    if event_dates and "date" in pts.columns:
        if start is not None:
            pts = pts.where(F.col("date") >= F.to_date(filters._bound(start)))
        if end is not None:
            pts = pts.where(F.col("date") <= F.to_date(filters._bound(end)))
    pts = filters.in_time_range(filters.by_metric(pts, metric), start, end)
    for key, value in (tags or {}).items():
        pts = filters.by_tag(pts, key, value)
    return pts


# ---------------------------------------------------------------- W3 on a store

# Where a stored point stands in the store's own arrival order.
PLACE = ["arrived", "file", "place"]


def _placed(points: DataFrame) -> DataFrame:
    """Stored points with their place: file time, file, row of the file."""
    meta = F.col("_metadata")
    return points.select("*", meta["file_modification_time"].alias("arrived"), meta["file_path"].alias("file"), meta["row_index"].alias("place"))


def _threshold(points: DataFrame, n: int):
    """Time (microseconds) of the ``n``-th newest point, or None if there are fewer. One column
    is read and each task hands on its newest ``n``."""
    newest = points.select("timestamp").orderBy(F.desc("timestamp")).limit(n)
    found = newest.agg(F.count(F.lit(1)).alias("n"), F.unix_micros(F.min("timestamp")).alias("t")).first()
    return found["t"] if found["n"] >= n else None


def _not_before(points: DataFrame, micros: int) -> DataFrame:
    return points.where(F.col("timestamp") >= F.timestamp_micros(F.lit(micros)))


def _units(spark: SparkSession, base: str, event_dates: bool) -> list[tuple] | None:
    """What a store can leave unread, newest first: (newest time it may hold, what to open).
    Files of a manifest, or dates of a store by event date; None: only a scan can tell."""
    if manifest.is_manifest(spark, base):
        listed = manifest.files(spark, base).select("path", F.unix_micros("max_time").alias("t")).collect()  # a scan's file list
        return sorted(((r["t"], r["path"]) for r in listed if r["t"] is not None), reverse=True)
    if event_dates:
        end = F.unix_micros(F.date_add("date", 1).cast("timestamp")) - 1
        days = list_files(spark, base).select("date", end.alias("t")).distinct().collect()  # a row per partition
        return sorted(((r["t"], r["date"]) for r in days if r["date"] is not None), reverse=True)
    return None


def since(spark: SparkSession, base: str, n: int, matching=None, event_dates: bool = False) -> DataFrame:
    """Every stored point that is at least as new as the ``n``-th newest matching one
    (``matching``: a function of points), with its place in the store.

    Files or dates are opened from the newest on, twice as many each time, until the ``n``-th
    newest time found is later than all that is unread may hold; a point that arrived late
    counts by its own time. A plain store by arrival date has no such bound: its timestamps
    are read first, then what is new enough, which the Parquet scan selects by row group."""
    from telemetra.sources.points import read_parquet_points

    base = base.rstrip("/")
    matching = matching or (lambda points: points)
    units = _units(spark, base, event_dates)
    if units is None:
        points = read_parquet_points(spark, base)
        newest = _threshold(matching(points), n)
        return _placed(matching(points if newest is None else _not_before(points, newest)))

    by_manifest = manifest.is_manifest(spark, base)
    count = 1
    while True:
        some = [what for _, what in units[:count]]
        points = manifest.open_files(spark, base, some) if by_manifest else read_parquet_points(spark, base).where(F.col("date").isin(some))
        if count >= len(units):
            break
        newest = _threshold(matching(points), n)
        if newest is not None and newest > units[count][0]:
            points = _not_before(points, newest)
            break
        count *= 2
    if not units:
        return matching(points).select("*", *[F.lit(None).cast(t).alias(c) for c, t in zip(PLACE, ("timestamp", "string", "bigint"))])
    return _placed(matching(points))


def recent_points(spark: SparkSession, base: str, n: int = RECENT_LOG_SIZE, metric: str | None = None, event_dates: bool = False) -> DataFrame:
    """W3 on a store: the ``n`` newest points, of one metric (``name`` and its fields
    ``name.field``) or of all; of equal times the one stored last. No row is shuffled but
    the newest ``n`` of each task."""
    points = since(spark, base, n, lambda p: of_metric(p, metric), event_dates)
    return points.orderBy(F.desc("timestamp"), *[F.desc(c) for c in PLACE]).limit(n).drop(*PLACE)


def of_metric(points: DataFrame, metric: str | None) -> DataFrame:
    """Points of a metric: its own name, or a field of it."""
    if not metric:
        return points
    return points.where((F.col("metric_name") == F.lit(metric)) | F.startswith(F.col("metric_name"), F.lit(f"{metric}.")))


def _wide(points: DataFrame, metric: str) -> DataFrame:
    """Placed points of a metric as wide rows, one per metric that arrived. Points of equal
    time, host and tags are told apart by their place: the k-th ``usage`` belongs to the k-th
    metric of that key, so equal metrics stay as many as they were."""
    key = ["timestamp", "host", "tags_json"]
    field = F.when(F.col("metric_name") == metric, F.lit("value")).otherwise(F.expr(f"substring(metric_name, {len(metric) + 2})"))
    nth = Window.partitionBy(*key, "field").orderBy(*PLACE)
    each = points.withColumn("field", field).withColumn("nth", F.row_number().over(nth))
    rows = each.groupBy(*key, "nth").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("fields"), F.max(F.struct(*PLACE)).alias("place"))
    return rows.select(F.lit(metric).alias("name"), *key, "fields", "nth", "place")


def recent_metrics(spark: SparkSession, base: str, metric: str, n: int = RECENT_LOG_SIZE, event_dates: bool = False) -> DataFrame:
    """W3 on a store, whole metrics: the ``n`` newest metrics called ``metric`` with all their
    fields. Points from the newest on are put together, twice as many each time, until they
    make ``n`` metrics; all points of a time are read together, so no metric is cut."""
    matching = lambda p: of_metric(p, metric)
    width, order = 4 * n, [F.desc("timestamp"), F.desc("place"), F.desc("nth")]
    while True:
        points = written(since(spark, base, width, matching, event_dates), "recent")
        newest = _wide(points, metric).orderBy(*order).limit(n)
        # fewer points than asked for: the store holds no more
        if points.count() < width or newest.count() >= n:
            return newest.drop("nth", "place")
        width *= 2


def query_files(spark: SparkSession, base: str, metric: str | None = None, start=None, end=None) -> DataFrame:
    """The ``/query`` route with its filters applied: rows of ``metric`` in
    ``[start, end]`` per data file (files without a match count 0). The filters reach the
    Parquet scan; the file listing keeps empty files in the answer."""
    from telemetra.operators import filters
    from telemetra.sources.points import read_parquet_points

    pts = read_parquet_points(spark, base).select(
        "metric_name", "timestamp", _path(F.col("_metadata.file_path"))
    )
    pts = filters.in_time_range(filters.by_metric(pts, metric), start, end)
    return _with_listing(spark, base, "parquet", pts.select("path")).select("path", "date", "rows")


def store_stats(spark: SparkSession, base: str, fmt: str = "parquet", rejected: DataFrame | None = None) -> DataFrame:
    """A4: records, files (empty ones too), bytes, MB, write errors and records per second
    (over the time from the first to the last file written, one second at least)."""
    files = list_files(spark, base, fmt).select(
        F.lit(0).cast("bigint").alias("records"), F.lit(1).alias("files"), "length", F.col("modificationTime").alias("mtime"), F.lit(0).alias("errors"))
    absent = [F.lit(None).cast("bigint").alias("length"), F.lit(None).cast("timestamp").alias("mtime")]
    rows = scan_files(spark, base, fmt).select(F.lit(1).cast("bigint").alias("records"), F.lit(0).alias("files"), *absent, F.lit(0).alias("errors"))
    meta = files.unionByName(rows)
    if rejected is not None:
        meta = meta.unionByName(rejected.select(F.lit(0).cast("bigint").alias("records"), F.lit(0).alias("files"), *absent, F.lit(1).alias("errors")))
    totals = meta.agg(
        F.sum("records").alias("total_records"),
        F.sum("files").alias("total_files"),
        F.coalesce(F.sum("length"), F.lit(0)).alias("total_bytes"),
        F.sum("errors").alias("write_errors"),
        F.min("mtime").alias("first_write"),
        F.max("mtime").alias("last_write"),
    )
    span = F.greatest(F.unix_micros("last_write") - F.unix_micros("first_write"), F.lit(1_000_000))
    return totals.select(
        "total_records",
        "total_files",
        "total_bytes",
        F.round(F.col("total_bytes") / 1048576.0, 3).alias("total_mb"),
        "write_errors",
        F.try_divide(F.col("total_records") * 1_000_000, span).alias("records_per_second"),
    )


def store_report(spark: SparkSession, base: str, fmt: str = "parquet") -> DataFrame:
    """A5: file count, total size, newest file and its size."""
    files = list_files(spark, base, fmt)
    return files.agg(
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"),
        F.max_by("path", "modificationTime").alias("newest_file"),
        F.max_by("length", "modificationTime").alias("newest_bytes"),
    )


def expired_files(spark: SparkSession, base: str, days: int, now: dt.datetime | None = None, fmt: str = "parquet") -> DataFrame:
    """Data files modified more than ``days`` days before ``now`` (default: the
    query's current time)."""
    cutoff = (F.lit(now) if now is not None else F.current_timestamp()) - F.make_interval(days=F.lit(days))
    return list_files(spark, base, fmt).where(F.col("modificationTime") < cutoff)


def remove_files(expired: DataFrame, dry_run: bool = True) -> DataFrame:
    """R1 clean-up: delete the listed files now (``dry_run`` lists them only).

    Returns ``path, deleted``, written before the call returns: the deletion runs once, in
    tasks through Arrow's file systems (local, HDFS, S3, GCS), and later reads of the result
    delete nothing. A file that is gone already counts as deleted, so a retried task agrees
    with its first attempt."""
    spark = expired.sparkSession
    if dry_run:
        return expired.select("path", F.lit(False).alias("deleted"))

    def delete(batches):
        # self-contained: executors need pandas and pyarrow, not this package
        import pandas as pd
        from pyarrow import fs

        def arrow_uri(uri: str) -> str:
            if uri.startswith("file:") and not uri.startswith("file://"):
                return "file://" + uri[len("file:"):]
            if uri.startswith("s3a://"):
                return "s3://" + uri[len("s3a://"):]
            return uri

        for pdf in batches:
            for uri in pdf["path"]:
                filesystem, path = fs.FileSystem.from_uri(arrow_uri(uri))
                try:
                    filesystem.delete_file(path)
                except FileNotFoundError:
                    pass
            yield pd.DataFrame({"path": pdf["path"], "deleted": True})

    done = scratch_path(spark, "removed-files")
    expired.select("path").mapInPandas(delete, "path string, deleted boolean").write.parquet(done)
    return spark.read.schema("path string, deleted boolean").parquet(done)
