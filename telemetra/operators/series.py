"""Series operators over labelled points (or flat points with a label map).

P11/O1 series key, D1 catalog, A6 per-timestamp batches, A7 duplicate policies and R2
retention. Each is one aggregation on its key with partial aggregation before the
shuffle; R2 joins the per-series maximum back instead of sorting every series in a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemetra.constants import DUPLICATE_POLICIES
from telemetra.functions.points import series_key, sorted_json_object
from telemetra.schemas import SeriesOptions
from telemetra.session import scratch_path

# Arrival order: the payload or line, then the place inside it.
ARRIVAL = ("seq", "pos")


def from_points(points: DataFrame) -> DataFrame:
    """Flattened points in the shape of labelled ones: ``metric``, ``labels`` and epoch
    seconds, so that every series operator takes them."""
    return points.select(
        *ARRIVAL, F.unix_seconds("timestamp").alias("timestamp"), F.col("metric_name").alias("metric"), "value",
        F.coalesce("tags", F.create_map().cast("map<string,string>")).alias("labels"),
    )


def _arrival() -> Column:
    return F.struct(*ARRIVAL)


def with_series_key(points: DataFrame, options: SeriesOptions = SeriesOptions(), metric: str = "metric", labels: str = "labels") -> DataFrame:
    """Add ``series_key`` = ``[prefix:]metric[:k=v…]`` with labels sorted."""
    return points.withColumn("series_key", series_key(F.col(metric), F.col(labels), options.prefix))


def series_catalog(points: DataFrame, options: SeriesOptions = SeriesOptions()) -> DataFrame:
    """Each series once, as first seen (lowest ``seq``, ``pos``), with its options."""
    keyed = with_series_key(points, options)
    first = F.struct("seq", "timestamp", "metric", "labels")
    cat = keyed.groupBy("series_key").agg(
        F.min_by(first, _arrival()).alias("first"),
        F.count(F.lit(1)).alias("points"),
    )
    return cat.select(
        "series_key",
        F.col("first.metric").alias("metric"),
        sorted_json_object(F.col("first.labels")).alias("labels_json"),
        F.col("first.seq").alias("first_seq"),
        F.col("first.timestamp").alias("first_timestamp"),
        "points",
        F.lit(options.retention).cast("bigint").alias("retention"),
        F.lit(options.duplicate_policy).alias("duplicate_policy"),
        F.lit(options.compressed).alias("compressed"),
    )


def timestamp_batches(points: DataFrame, options: SeriesOptions = SeriesOptions()) -> DataFrame:
    """The multi-add batch of each timestamp, as rows in sending order.

    A batch is every row of one timestamp; ``arg`` is the row's ``key ts value`` triple, the
    value printed with six decimals. Rows are range-partitioned and sorted by (timestamp,
    arrival), so a crowded timestamp spreads over tasks and none is collected."""
    keyed = with_series_key(points, options)
    triple = F.concat_ws(" ", "series_key", F.col("timestamp").cast("string"), F.format_string("%.6f", "value"))
    order = ["timestamp", *ARRIVAL]
    return keyed.select(*order, "series_key", "value", triple.alias("arg")).repartitionByRange(*order).sortWithinPartitions(*order)


def batch_sizes(points: DataFrame) -> DataFrame:
    """How many points each timestamp's batch holds."""
    return points.groupBy("timestamp").agg(F.count(F.lit(1)).alias("points"))


def deduplicate(points: DataFrame, policy: str = "LAST", options: SeriesOptions = SeriesOptions()) -> DataFrame:
    """One value per (series, timestamp) under LAST, FIRST, MIN, MAX or SUM; LAST and
    FIRST go by arrival, inside a payload by position."""
    keyed = with_series_key(points, options)
    policy = policy.upper()
    if policy not in DUPLICATE_POLICIES:
        raise ValueError(f"unknown duplicate policy {policy!r}; one of {DUPLICATE_POLICIES}")
    agg = {
        "LAST": F.max_by("value", _arrival()),
        "FIRST": F.min_by("value", _arrival()),
        "MIN": F.min("value"),
        "MAX": F.max("value"),
        "SUM": F.sum("value"),
    }[policy]
    return keyed.groupBy("series_key", "timestamp").agg(agg.alias("value"), F.count(F.lit(1)).alias("duplicates"))


def apply_retention(points: DataFrame, retention: int | None = None, options: SeriesOptions = SeriesOptions()) -> DataFrame:
    """R2: keep points no older than ``retention`` seconds before their series' newest
    point.

    The keyed points are written once and read twice, so that their source is parsed once;
    the per-series maximum is a partial aggregate joined back on the key (AQE broadcasts it
    when its measured size allows, else shuffles both sides and splits skewed keys)."""
    retention = options.retention if retention is None else retention
    keyed = with_series_key(points, options)
    if retention is None:
        return keyed
    path = scratch_path(points.sparkSession, "retention")
    keyed.write.parquet(path)
    keyed = points.sparkSession.read.schema(keyed.schema).parquet(path)
    newest = keyed.groupBy("series_key").agg(F.max("timestamp").alias("_newest"))
    return (
        keyed.join(newest, "series_key")
        .where(F.col("timestamp") >= F.col("_newest") - F.lit(retention))
        .drop("_newest")
    )
