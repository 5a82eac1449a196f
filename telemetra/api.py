"""One function per request a collector user makes today, as DataFrames (no server).

| Request | Function |
| --- | --- |
| ``POST /metrics`` (payload files, batch) | :func:`ingest` |
| ``GET /query?metric=&start=&end=`` | :func:`query` (points) and :func:`query_summary` (files, rows) |
| ``GET /metrics?name=&limit=`` | :func:`recent_metrics` |
| ``GET /metrics/{name}/stats?field=`` | :func:`metric_stats` |
| ``GET /storage/stats`` | :func:`storage_stats` |
| ``POST /storage/cleanup`` | :func:`cleanup` |
| ``GET /stream?metrics=&tag.host=`` | :func:`live_stream` |
| series commands (create, add, multi-add) | :func:`series_tables` |
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from telemetra.operators import aggregates, flatten, series, store, views
from telemetra.schemas import FlattenOptions, SeriesOptions
from telemetra.session import configure
from telemetra.sinks.writers import Format, write_points
from telemetra.sources.payloads import read_payloads
from telemetra.streaming import live


def ingest(spark: SparkSession, landing: str, base: str, fmt: Format = "parquet", quarantine: str | None = None,
           options: FlattenOptions = FlattenOptions(), whole_file: bool = False) -> DataFrame:
    """Flatten the payload files under ``landing`` into the store at ``base`` (and the
    rejects into ``quarantine``); returns the ingest counters of the run, which are observed
    while the store is written."""
    configure(spark)
    payloads = read_payloads(spark, landing, whole_file)
    seen = Observation("ingest")
    write_points(flatten.flatten(payloads, options, counters=seen, dated=True), base, fmt, layout="as_is")
    if quarantine:
        flatten.rejected(payloads, options).write.mode("append").parquet(quarantine)
    totals = [(seen.get["total_requests"], seen.get["total_metrics"])]
    return spark.createDataFrame(totals, "total_requests bigint, total_metrics bigint")


def query(spark: SparkSession, base: str, metric: str | None = None, start=None, end=None, fmt: str = "parquet",
          tags: dict[str, str] | None = None) -> DataFrame:
    """Points of ``metric`` (empty = all) in ``[start, end]``, optionally by tag."""
    configure(spark)
    return store.query_points(spark, base, fmt, metric, start, end, tags)


def query_summary(spark: SparkSession, base: str, metric: str | None = None, start=None, end=None) -> dict[str, DataFrame]:
    """The ``/query`` answer: ``data`` = rows per file with the filters applied (empty
    files included); ``summary`` = files scanned and rows matched, as one aggregate."""
    configure(spark)
    per_file = store.query_files(spark, base, metric, start, end)
    summary = per_file.agg(F.count(F.lit(1)).alias("files_scanned"), F.sum("rows").alias("rows"))
    return {"data": per_file, "summary": summary}


def recent_metrics(spark: SparkSession, base: str, name: str | None = None, limit: int = 100, fmt: str = "parquet") -> DataFrame:
    """The newest ``limit`` metrics as wide rows ``name, timestamp, host, tags_json, fields``.

    Of a Parquet store, a named metric is put together again from its stored points, ``name``
    (as field ``value``) and ``name.field``; without a name, or in a text store, each stored
    point stands for itself."""
    configure(spark)
    if fmt == "parquet" and name:
        return store.recent_metrics(spark, base, name, limit)
    if fmt == "parquet":
        wide = store.recent_points(spark, base, limit)
    else:  # text stores have no time ranges to go by
        wide = views.recent(store.of_metric(store.query_points(spark, base, fmt), name), n=limit)
    return wide.select(F.col("metric_name").alias("name"), "timestamp", "host", "tags_json", F.create_map(F.lit("value"), F.col("value")).alias("fields"))


def metric_stats(spark: SparkSession, base: str, name: str, field: str | None = None, fmt: str = "parquet") -> DataFrame:
    """count, min, max, mean, stddev of ``name.field`` (or ``name``)."""
    configure(spark)
    return aggregates.field_stats(store.query_points(spark, base, fmt), name=name, field=field)


def storage_stats(spark: SparkSession, base: str, fmt: str = "parquet", quarantine: str | None = None) -> DataFrame:
    """Records, files, bytes, MB, write errors and records per second of a store."""
    configure(spark)
    rejected = spark.read.parquet(quarantine) if quarantine else None
    return store.store_stats(spark, base, fmt, rejected)


def cleanup(spark: SparkSession, base: str, retention_days: int, fmt: str = "parquet", dry_run: bool = True) -> DataFrame:
    """Files older than the retention, deleted unless ``dry_run``."""
    configure(spark)
    return store.remove_files(store.expired_files(spark, base, retention_days, fmt=fmt), dry_run=dry_run)


def live_stream(spark: SparkSession, landing: str, sink: str, checkpoint: str, metrics: str | None = None,
                tags: dict[str, str] | None = None, options: FlattenOptions = FlattenOptions(),
                trigger: live.Trigger = live.Trigger(every="1 second")) -> StreamingQuery:
    """Metrics of the listed names (comma-separated) with the given tag values, as they arrive."""
    configure(spark)
    return live.filtered(live.payload_stream(spark, landing), sink, checkpoint, metrics, tags, options, trigger)


def series_tables(labelled: DataFrame, options: SeriesOptions = SeriesOptions()) -> dict[str, DataFrame]:
    """The series commands as tables: ``catalog`` (create once), ``batches`` (multi-add per
    timestamp) and ``values`` (one value per series and timestamp under the policy)."""
    return {
        "catalog": series.series_catalog(labelled, options),
        "batches": series.timestamp_batches(labelled, options),
        "batch_sizes": series.batch_sizes(labelled),
        "values": series.deduplicate(labelled, options.duplicate_policy, options),
    }
