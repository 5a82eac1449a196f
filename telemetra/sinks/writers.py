"""Point stores: Parquet (K1, K2), CSV (K3, K4), JSON Lines (K5), rotation (K6) and
fan-out (K7). Every store is partitioned by UTC ``date`` (P10).

Layouts:

* ``as_is`` — no shuffle; each task writes its own file per partition value, for input that
  covers few values per task (arrival dates);
* ``rebalance`` — a REBALANCE on the partition columns: AQE merges small partitions and
  splits skewed ones, so a hot date, metric or host is written by several tasks.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import Literal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemetra.constants import CSV_ROWS_PER_FILE, PARQUET_COMPRESSION
from telemetra.functions.points import epoch_seconds
from telemetra.session import scratch_path, written
from telemetra.sinks import cells

Format = Literal["parquet", "csv", "csv_tags", "jsonl"]
Layout = Literal["as_is", "rebalance"]


# For stores with a directory per host or per file that Spark writes (not on a local or mounted
# file system): every task moves its own files when it is done. The default has the driver move them all, one by one, after the last task. A write
# that fails can leave the files of tasks that had finished (and no ``_SUCCESS``).
MOVED_BY_TASKS = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}


def with_date(points: DataFrame, source: str = "timestamp") -> DataFrame:
    """P10: the ``date`` partition column, UTC, from event time (``timestamp``, default),
    arrival time (``received_at``) or the write's own clock (``flush``: the collector's
    rule, one date per flush)."""
    if source == "flush":
        return points.withColumn("date", F.current_date())
    return points.withColumn("date", F.to_date(F.col(source)))


def to_profile(points: DataFrame, fmt: Format, extra: Sequence[str] = ()) -> DataFrame:
    """Project points to a store's fixed columns (plus partition columns ``extra``)."""
    extra = [c for c in extra if c not in ("timestamp", "metric_name", "value", "host")]
    if fmt == "parquet":
        cols = [F.col("timestamp"), "metric_name", "value", "host", "tags_json"]
    elif fmt in ("csv", "csv_tags"):
        cols = [epoch_seconds(F.col("timestamp")).alias("timestamp"), F.col("metric_name").alias("metric"), "value", "host"]
        if fmt == "csv_tags":
            cols.append(F.col("tags_json").alias("tags"))
    elif fmt == "jsonl":
        tags = F.col("tags_raw") if "tags_raw" in points.columns else F.parse_json(F.col("tags_json"))
        cols = [
            epoch_seconds(F.col("timestamp")).alias("timestamp"),
            F.col("metric_name").alias("metric"),
            "value",
            "host",
            F.coalesce(tags, F.parse_json(F.lit("{}"))).alias("tags"),
        ]
    else:
        raise ValueError(f"unknown store format {fmt!r}")
    return points.select(*cols, *extra)


def write_points(
    points: DataFrame,
    path: str,
    fmt: Format = "parquet",
    *,
    partition_by: Sequence[str] = ("date",),
    date_source: str = "timestamp",
    compression: str | None = None,
    max_records_per_file: int | None = None,
    layout: Layout | None = None,
    mode: str = "append",
) -> None:
    """K1–K6: write points to a date-partitioned store.

    ``partition_by=("date", "metric_name", "host")`` is K2. CSV stores rotate every
    100 000 rows unless ``max_records_per_file`` says otherwise (K6). Without a
    ``layout``, a store partitioned by arrival or flush date alone is written as is (a run
    covers few of them); by event date, metric or host it is rebalanced, so that tasks do
    not each write a file for every value they hold.
    """
    if layout is None:
        few = tuple(partition_by) in ((), ("date",)) and date_source != "timestamp"
        layout = "as_is" if few else "rebalance"
    if "date" in partition_by and "date" not in points.columns:
        points = with_date(points, date_source)
    parts = list(partition_by)
    rows = to_profile(points, fmt, extra=parts)
    part_cols = ["metric" if (p == "metric_name" and fmt != "parquet") else p for p in parts]
    if fmt != "parquet" and "metric_name" in parts:
        rows = rows.drop("metric_name")
    if layout == "rebalance" and part_cols:
        rows = rows.hint("rebalance", *part_cols)
    if fmt in ("csv", "csv_tags") and max_records_per_file is None:
        max_records_per_file = CSV_ROWS_PER_FILE
    codec = compression or (PARQUET_COMPRESSION if fmt == "parquet" else "none")
    if "host" in part_cols and cells.writable(rows.sparkSession, path, fmt, codec, mode):
        line = None if fmt == "parquet" else _encoded(rows.drop(*part_cols), fmt)
        cells.write(rows.sortWithinPartitions(*part_cols), path, fmt, part_cols, line, codec, max_records_per_file)
        return
    writer = rows.write.mode(mode)
    if part_cols:
        writer = writer.partitionBy(*part_cols)
    if "host" in part_cols:
        writer = writer.options(**MOVED_BY_TASKS)
    if max_records_per_file:
        writer = writer.option("maxRecordsPerFile", max_records_per_file)
    if fmt == "parquet":
        (writer.option("compression", compression or PARQUET_COMPRESSION)
         .option("parquet.enable.dictionary", "false")
         .parquet(path))
    elif fmt in ("csv", "csv_tags"):
        (writer.option("header", True).option("compression", compression or "none")
         .option("escape", '"')
         .csv(path))
    else:
        writer.option("compression", compression or "none").option("ignoreNullFields", "false").json(path)


def _encoded(rows: DataFrame, fmt: Format) -> Column:
    """A row's line in its file."""
    if fmt == "jsonl":
        return F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    return F.to_csv(F.struct(*rows.columns), {"escape": '"'})


def write_rotated(
    points: DataFrame,
    path: str,
    fmt: Format = "csv",
    *,
    max_bytes: int,
    window_minutes: int | None = None,
    date_source: str = "timestamp",
    compression: str | None = None,
    mode: str = "append",
) -> None:
    """K6 by size and age: a text store whose files hold at most ``max_bytes`` (header
    included, before compression), as ``date=…/file=<number>``; with ``window_minutes``, no
    file holds points that arrived in two windows of that length (``received_at``).

    A line's file is the running sum of the bytes before it, cut at the limit. The sums are
    taken per task and date; one row per task and date gives each task's offset, so a date of
    any size is summed and written by many tasks. The lines are written once and read back,
    since sizes and rows have to agree. A line that is longer than a file may be has a file
    of its own, beyond the limit."""
    if fmt == "parquet":
        raise ValueError("Parquet files have no size before they are encoded; use max_records_per_file")
    if "date" not in points.columns:
        points = with_date(points, date_source)
    if window_minutes:
        points = points.withColumn("age", F.floor(F.unix_seconds("received_at") / (60 * window_minutes)))
    else:
        points = points.withColumn("age", F.lit(0).cast("bigint"))
    rows = to_profile(points, fmt, extra=["date", "age"])
    lines = rows.drop("date", "age")
    header = 0 if fmt == "jsonl" else len(",".join(lines.columns)) + 1
    group = [F.coalesce("age", F.lit(-1)).alias("age"), "date"]
    ours = cells.writable(points.sparkSession, path, fmt, compression or "none", mode)
    kept = ["_line"] if ours else lines.columns  # each line is encoded once, or by Spark's writer again
    numbered = rows.withColumn("_line", _encoded(lines, fmt)).select(
        *kept, *group, (F.octet_length("_line") + 1).cast("bigint").alias("_bytes"),
        F.spark_partition_id().alias("_task"), F.monotonically_increasing_id().alias("_row"))
    placed = written(numbered, "rotated")
    sizes = placed.groupBy("age", "date", "_task").agg(F.sum("_bytes").alias("_size"), F.max("_bytes").alias("_widest"))
    widest = sizes.agg(F.max("_widest")).first()[0] or 0
    # a file's lines end within `step` of each other, so it holds less than that and a line
    step = max(1, max_bytes - header - widest + 1)
    before = Window.partitionBy("age", "date").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("age", "date", "_task", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    running = Window.partitionBy("age", "date", "_task").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumn("_end", F.sum("_bytes").over(running))
    same = summed["age"].eqNullSafe(offsets["age"]) & summed["date"].eqNullSafe(offsets["date"]) & (summed["_task"] == offsets["_task"])
    number = F.floor((F.col("_before") + F.col("_end") - 1) / step)
    name = F.concat_ws("-", F.col("age"), F.col("number")) if window_minutes else F.col("number")
    out = summed.join(offsets, same).select(*[summed[c] for c in kept], summed["age"], summed["date"], number.alias("number"), "_row")
    out = out.withColumn("file", name).repartition("date", "file").sortWithinPartitions("date", "file", "_row").select(*kept, "date", "file")
    if ours:
        cells.write(out, path, fmt, ["date", "file"], F.col("_line"), compression or "none", names=lines.columns)
        return
    writer = out.write.mode(mode).partitionBy("date", "file").options(**MOVED_BY_TASKS).option("compression", compression or "none")
    if fmt == "jsonl":
        writer.option("ignoreNullFields", "false").json(path)
    else:
        writer.option("header", True).option("escape", '"').csv(path)


STAGED = ["timestamp", "metric_name", "value", "host", "tags_json"]


def staged(points: DataFrame, path: str, *keep: str) -> DataFrame:
    """Points written once as Parquet and read back, tags as the VARIANT they are, for sinks
    that need them several times."""
    raw = F.col("tags_raw") if "tags_raw" in points.columns else F.parse_json("tags_json")
    once = points.select(*STAGED, *keep, raw.alias("tags_raw"))
    once.write.mode("overwrite").parquet(path)
    return points.sparkSession.read.schema(once.schema).parquet(path)


def fan_out(points: DataFrame, stores: Iterable[tuple[str, Format]], **options) -> None:
    """K7: the input parsed once and written to several stores.

    The points are staged in the shared folder, so no store needs the payloads again and
    nothing is held on the executors; JSON Lines keeps the tags' types."""
    keep = [c for c in (options.get("date_source", "timestamp"),) if c not in STAGED and c != "flush"]
    once = staged(points, scratch_path(points.sparkSession, "fan-out"), *keep)
    for path, fmt in stores:
        write_points(once, path, fmt, **options)
