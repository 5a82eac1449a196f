"""Registered queries: one per operator family, each over the driver's whole tables.

Every query takes ``(spark, sf_dir)`` and returns a DataFrame whose columns match the
SQL of :mod:`telemetra.plans.oracle`. Times leave as epoch seconds (``ts``) so results do
not depend on a session time zone. Fixture letters (A–E) are those of
:mod:`telemetra.sources.adapters`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemetra.functions.points import date_path, epoch_seconds
from telemetra.operators import aggregates, filters, flatten, series, store, views
from telemetra.schemas import FlattenOptions, SeriesOptions
from telemetra.session import configure, scratch_path
from telemetra.sinks import manifest, values, writers
from telemetra.sources import adapters, labelled
from telemetra.sources import payloads as payload_src
from telemetra.sources import points as points_src
from telemetra.streaming import buffered, live, seen

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str) -> Callable[[Query], Query]:
    def wrap(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return fn(spark, sf_dir)

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return run

    return wrap


# ---------------------------------------------------------------- inputs

def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.read_table(spark, sf_dir, "events")


def points_a(spark: SparkSession, sf_dir: str, options: FlattenOptions = FlattenOptions(), metrics: list[str] | None = None) -> DataFrame:
    return flatten.flatten(adapters.fields_payloads(events(spark, sf_dir)), options, metrics=metrics)


def wide_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten.wide_metrics(adapters.fields_payloads(events(spark, sf_dir)))


def points_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten.flatten(adapters.value_payloads(events(spark, sf_dir)))


def wide_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten.wide_metrics(adapters.value_payloads(events(spark, sf_dir)))


def labelled_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled.labelled_points(adapters.labelled_lines(events(spark, sf_dir)))


SERIES = SeriesOptions(prefix="metrics")


def point_row(points: DataFrame) -> DataFrame:
    """The common output shape of flattened points."""
    return points.select(
        "seq", "pos", epoch_seconds(F.col("timestamp")).alias("ts"), "metric_name", "value", "host", "tags_json"
    )


# ---------------------------------------------------------------- parse, reshape

@register("flatten_fields")
def flatten_fields(spark, sf_dir):
    """P1–P7 on fixture A: one point per numeric field."""
    return point_row(points_a(spark, sf_dir))


@register("flatten_value")
def flatten_value(spark, sf_dir):
    """P4 on fixture B: a top-level value gives one point named after the metric."""
    return point_row(points_b(spark, sf_dir))


@register("unpivot_wide")
def unpivot_wide(spark, sf_dir):
    """P5 on fixture D: four fields per line item fan out to four points."""
    payloads = adapters.wide_payloads(adapters.read_table(spark, sf_dir, "lineitem"))
    return point_row(flatten.flatten(payloads))


@register("envelope_defaults")
def envelope_defaults(spark, sf_dir):
    """P1–P3 on fixture E, strict: defaults for missing keys, no bare payloads."""
    return point_row(flatten.flatten(adapters.dirty_payloads(events(spark, sf_dir))))


@register("bare_payloads")
def bare_payloads(spark, sf_dir):
    """P1 with ``accept_bare``: the bare array of fixture E is taken as well."""
    opts = FlattenOptions(accept_bare=True)
    return point_row(flatten.flatten(adapters.dirty_payloads(events(spark, sf_dir)), opts))


@register("quarantine")
def quarantine(spark, sf_dir):
    """P8 on fixture E: rejected payloads and why."""
    return flatten.rejected(adapters.dirty_payloads(events(spark, sf_dir))).select("seq", "reason")


@register("quarantine_metric_scope")
def quarantine_metric_scope(spark, sf_dir):
    """P8 on fixture E with metric scope: only the wrongly typed metric is set aside."""
    opts = FlattenOptions(scope="metric")
    rej = flatten.rejected(adapters.dirty_payloads(events(spark, sf_dir)), opts)
    return rej.select("seq", F.coalesce("pos", F.lit(-1)).alias("pos"), "reason")


@register("metric_scope_points")
def metric_scope_points(spark, sf_dir):
    """P8, metric scope: clean metrics next to a bad one still give points."""
    opts = FlattenOptions(scope="metric")
    return point_row(flatten.flatten(adapters.dirty_payloads(events(spark, sf_dir)), opts))


@register("prefix_scope_points")
def prefix_scope_points(spark, sf_dir):
    """P8, prefix scope, on fixture H: the metrics before a payload's first bad one."""
    pts = flatten.flatten(adapters.mixed_payloads(events(spark, sf_dir)), FlattenOptions(scope="prefix"))
    return pts.select("seq", "pos", epoch_seconds(F.col("timestamp")).alias("ts"), "metric_name", "value")


@register("prefix_scope_rejects")
def prefix_scope_rejects(spark, sf_dir):
    """P8, prefix scope: the first bad metric and those behind it, on fixtures E and H."""
    opts = FlattenOptions(scope="prefix")
    found = [flatten.rejected(make(events(spark, sf_dir)), opts).select(F.lit(name).alias("fixture"), "seq", F.coalesce("pos", F.lit(-1)).alias("pos"), "reason")
             for name, make in (("E", adapters.dirty_payloads), ("H", adapters.mixed_payloads))]
    return found[0].unionByName(found[1])


@register("tags_json_sorted")
def tags_json_sorted(spark, sf_dir):
    """P6 on fixture A: tags as compact JSON with sorted keys, one row per metric."""
    return wide_a(spark, sf_dir).select("seq", "pos", "host", "tags_json")


@register("tags_number_text")
def tags_number_text(spark, sf_dir):
    """P6 on fixture I: tag values that are no strings, as the collector writes them."""
    wide = flatten.wide_metrics(adapters.numeric_tag_payloads(events(spark, sf_dir)))
    return wide.select("seq", "tags_json")


@register("date_partition")
def date_partition(spark, sf_dir):
    """P10 on fixture A: the UTC date directory of each point."""
    pts = points_a(spark, sf_dir)
    return pts.select("seq", "metric_name", date_path(F.col("timestamp")).alias("date_path"))


# ---------------------------------------------------------------- filters

@register("filter_metric_time")
def filter_metric_time(spark, sf_dir):
    """F1 + F2: one metric in an inclusive time range (metrics that cannot give the name
    are dropped before their fields fan out)."""
    pts = points_a(spark, sf_dir, metrics=["click.value"])
    pts = filters.in_time_range(pts, "2024-01-05 00:00:00", "2024-01-20 00:00:00")
    return point_row(pts)


@register("filter_tag")
def filter_tag(spark, sf_dir):
    """``tag.host`` equals a value (pushed as a column filter)."""
    return point_row(filters.by_tag(points_a(spark, sf_dir), "host", "user-7"))


@register("filter_tag_other")
def filter_tag_other(spark, sf_dir):
    """F3 on a tag other than host, read from the tag map."""
    pts = filters.by_tag(points_a(spark, sf_dir), "region", "eu")
    return point_row(filters.by_metric(pts, "view.k"))


@register("filter_metric_list")
def filter_metric_list(spark, sf_dir):
    """metric name in a comma-separated list."""
    return point_row(filters.by_metric_list(points_a(spark, sf_dir), "click.value,view.k,signup.value"))


@register("filter_metric_list_early")
def filter_metric_list_early(spark, sf_dir):
    """F4 applied before the fan-out (``flatten(..., metrics=...)``): same answer."""
    return point_row(points_a(spark, sf_dir, metrics=["click.value", "view.k", "signup.value"]))


@register("filter_name_wide")
def filter_name_wide(spark, sf_dir):
    """F5 + P12: wide rows (no fan-out) of one metric name."""
    wide = filters.by_name(wide_a(spark, sf_dir), "purchase")
    return wide.select(
        "seq",
        epoch_seconds(F.col("timestamp")).alias("ts"),
        "name",
        "host",
        F.size("fields").alias("n_fields"),
        F.col("fields")["value"].alias("value"),
        F.col("fields")["k"].alias("k"),
    )


# ---------------------------------------------------------------- aggregates and views

@register("field_stats")
def field_stats(spark, sf_dir):
    """A2: count, min, max, mean, sample deviation per metric (rounded to 6 places)."""
    st = aggregates.field_stats(points_a(spark, sf_dir))
    return st.select(
        "metric_name", "count", "min", "max",
        F.round("mean", 6).alias("mean"), F.round("stddev", 6).alias("stddev"),
    )


@register("field_stats_one")
def field_stats_one(spark, sf_dir):
    """A2 for one metric field, as ``/metrics/{name}/stats?field=`` asks."""
    st = aggregates.field_stats(points_a(spark, sf_dir), name="error", field="value")
    return st.select(
        "metric_name", "count", "min", "max",
        F.round("mean", 6).alias("mean"), F.round("stddev", 6).alias("stddev"),
    )


@register("latest_per_series")
def latest_per_series(spark, sf_dir):
    """W1 on fixture B: newest value per (name, tags) card."""
    lat = views.latest_per_series(wide_b(spark, sf_dir))
    return lat.select("name", "tags_json", "main_field", "value", epoch_seconds(F.col("timestamp")).alias("ts"), "seq")


@register("last_50_per_host")
def last_50_per_host(spark, sf_dir):
    """W2 on fixture B: the newest 50 values per host."""
    last = views.last_n_per_host(wide_b(spark, sf_dir), field="value", n=50)
    return last.select("host", epoch_seconds(F.col("timestamp")).alias("ts"), "seq", "y", "rank")


@register("recent_n")
def recent_n(spark, sf_dir):
    """W3 on fixture B: the 100 most recent points."""
    rec = views.recent(points_b(spark, sf_dir), n=100)
    return rec.select("seq", epoch_seconds(F.col("timestamp")).alias("ts"), "metric_name", "value")


@register("recent_n_metric")
def recent_n_metric(spark, sf_dir):
    """W3 restricted to one metric name."""
    rec = views.recent(points_b(spark, sf_dir), n=20, metric="purchase")
    return rec.select("seq", epoch_seconds(F.col("timestamp")).alias("ts"), "metric_name", "value")


def _chart(name: str) -> Query:
    def run(spark, sf_dir):
        wide = flatten.wide_metrics(adapters.system_payloads(events(spark, sf_dir)))
        return views.chart(wide, name).select("host", epoch_seconds(F.col("timestamp")).alias("ts"), "seq", "y", "rank")

    run.__doc__ = f"W2 with the dashboard's {name} preset, on fixture G."
    return run


for _name in ("cpu", "memory"):
    register(f"chart_{_name}")(_chart(_name))


@register("recent_n_fields")
def recent_n_fields(spark, sf_dir):
    """W3 by metric name where the metric has fields (fixture A): metrics, not points."""
    rec = views.recent(wide_a(spark, sf_dir), n=50, metric="signup")
    return rec.select("seq", epoch_seconds(F.col("timestamp")).alias("ts"), "name", F.col("fields")["value"].alias("value"))


@register("quarantine_times")
def quarantine_times(spark, sf_dir):
    """P8 on fixture F: timestamps out of range are rejected with a reason of their own."""
    return flatten.rejected(adapters.timed_payloads(events(spark, sf_dir))).select("seq", "reason")


@register("distinct_hosts")
def distinct_hosts(spark, sf_dir):
    """D2 on fixture B."""
    return views.distinct_hosts(points_b(spark, sf_dir))


# ---------------------------------------------------------------- series

@register("series_keys")
def series_keys(spark, sf_dir):
    """P9 + P11 + O1 on fixture C: prefixed keys with sorted labels."""
    keyed = series.with_series_key(labelled_c(spark, sf_dir), SERIES)
    return keyed.select("seq", "series_key", F.col("timestamp").alias("ts"), "value")


@register("series_catalog")
def series_catalog(spark, sf_dir):
    """D1 on fixture C: each series once, as first seen, with its options."""
    cat = series.series_catalog(labelled_c(spark, sf_dir), SERIES)
    return cat.select(
        "series_key", "metric", "labels_json", "first_seq",
        F.col("first_timestamp").alias("first_ts"), "points", "retention", "duplicate_policy", "compressed",
    )


def _hourly(spark, sf_dir):
    return labelled_c(spark, sf_dir).withColumn("timestamp", F.floor(F.col("timestamp") / 3600) * 3600)


def _daily(spark, sf_dir):
    return labelled_c(spark, sf_dir).withColumn("timestamp", F.floor(F.col("timestamp") / 86400) * 86400)


@register("timestamp_batches")
def timestamp_batches(spark, sf_dir):
    """A6 on fixture C cut to the hour: the rows of each timestamp's multi-add batch."""
    b = series.timestamp_batches(_hourly(spark, sf_dir), SERIES)
    return b.select(F.col("timestamp").alias("ts"), "seq", "series_key", "arg")


@register("timestamp_batch_sizes")
def timestamp_batch_sizes(spark, sf_dir):
    """Points per timestamp's batch."""
    return series.batch_sizes(_hourly(spark, sf_dir)).select(F.col("timestamp").alias("ts"), "points")


def _bulk_dedup(policy: str) -> Query:
    def run(spark, sf_dir):
        pts = flatten.flatten(adapters.bulk_day_payloads(events(spark, sf_dir)))
        d = series.deduplicate(series.from_points(pts), policy, SERIES)
        return d.select("series_key", F.col("timestamp").alias("ts"), F.round("value", 6).alias("value"), "duplicates")

    run.__doc__ = f"A7 {policy} on payloads that hold several points of a series and timestamp."
    return run


for _policy in ("last", "first"):
    register(f"dedup_{_policy}_bulk")(_bulk_dedup(_policy.upper()))


@register("series_from_points")
def series_from_points(spark, sf_dir):
    """D1 on flattened points (fixture B): labels are the tags."""
    cat = series.series_catalog(series.from_points(points_b(spark, sf_dir)), SERIES)
    return cat.select("series_key", "metric", "labels_json", "first_seq", F.col("first_timestamp").alias("first_ts"), "points")


@register("labelled_array")
def labelled_array(spark, sf_dir):
    """S5 on lines that hold arrays of labelled points, landed as files."""
    path = scratch_path(spark, "labelled-arrays")
    adapters.labelled_arrays(events(spark, sf_dir)).select("raw").write.text(path)
    keyed = series.with_series_key(labelled.read_labelled(spark, path, arrays=True), SERIES)
    return keyed.select("series_key", F.col("timestamp").alias("ts"), "value")


def _dedup(policy: str) -> Query:
    def run(spark, sf_dir):
        d = series.deduplicate(_daily(spark, sf_dir), policy, SERIES)
        return d.select("series_key", F.col("timestamp").alias("ts"), F.round("value", 6).alias("value"), "duplicates")

    run.__doc__ = f"A7 on fixture C cut to the day: duplicate policy {policy}."
    return run


for _policy in ("last", "first", "min", "max", "sum"):
    register(f"dedup_{_policy}")(_dedup(_policy.upper()))


@register("series_retention")
def series_retention(spark, sf_dir):
    """R2 on fixture C: keep the last seven days of each series."""
    kept = series.apply_retention(labelled_c(spark, sf_dir), retention=7 * 86400, options=SERIES)
    return kept.select("seq", "series_key", F.col("timestamp").alias("ts"))


def _stored_dedup(policy: str) -> Query:
    def run(spark, sf_dir):
        base = scratch_path(spark, f"values-{policy}")
        pts = _daily(spark, sf_dir)
        for i in range(3):
            for _ in range(1 + (i == 1)):  # the second batch is replayed
                values.upsert(pts.where(F.col("seq") % 3 == i), base, policy, writer="w", batch_id=i, options=SERIES, buckets=4, slice_seconds=7 * 86400)
        d = values.read_values(spark, base)
        return d.select("series_key", F.col("timestamp").alias("ts"), F.round("value", 6).alias("value"), "duplicates")

    run.__doc__ = f"A7 across batches: fixture C cut to the day and into three batches, policy {policy}."
    return run


for _policy in ("last", "first", "min", "max", "sum"):
    register(f"stored_{_policy}")(_stored_dedup(_policy.upper()))


@register("stored_retention")
def stored_retention(spark, sf_dir):
    """R2 on a running store: fixture C streamed in event order, each series kept to its last
    seven days while batches come in."""
    src = _land(adapters.labelled_lines(events(spark, sf_dir)), spark, "r2", files=3)
    base = scratch_path(spark, "values-retention")
    _run(spark, lambda cp: live.upsert(live.line_stream(spark, src, 1), base, cp, "LAST", SERIES, retention=7 * 86400, buckets=2))
    return values.read_values(spark, base).select("series_key", F.col("timestamp").alias("ts"), F.round("value", 6).alias("value"))


@register("ingest_counters")
def ingest_counters(spark, sf_dir):
    """A3 on fixture E: requests and metrics in enveloped payloads."""
    return flatten.ingest_counters(adapters.dirty_payloads(events(spark, sf_dir)))


# ---------------------------------------------------------------- stores (write, read back)

def store_row(points: DataFrame) -> DataFrame:
    return points.select(epoch_seconds(F.col("timestamp")).alias("ts"), "metric_name", "value", "host", "tags_json")


def _roundtrip(spark, sf_dir, fmt, **write_opts) -> DataFrame:
    path = scratch_path(spark, f"store-{fmt}")
    writers.write_points(points_a(spark, sf_dir), path, fmt, **write_opts)
    parts = tuple(write_opts.get("partition_by", ("date",)))
    return points_src.read_store(spark, path, fmt, parts)


@register("parquet_roundtrip")
def parquet_roundtrip(spark, sf_dir):
    """K1 + S3: Parquet store (Snappy, no dictionary, by date), read back."""
    return store_row(_roundtrip(spark, sf_dir, "parquet"))


@register("parquet_partitioned")
def parquet_partitioned(spark, sf_dir):
    """K2: partitioned by date and metric (rebalanced write), read back. Host partitioning
    is the same option; with one host per user it would make a directory per point."""
    back = _roundtrip(spark, sf_dir, "parquet", partition_by=("date", "metric_name"), layout="rebalance")
    return store_row(back)


@register("parquet_by_host")
def parquet_by_host(spark, sf_dir):
    """K2: partitioned by host alone, read back."""
    return store_row(_roundtrip(spark, sf_dir, "parquet", partition_by=("host",)))


@register("csv_partitioned")
def csv_partitioned(spark, sf_dir):
    """K2 in a CSV store: by date and metric, read back."""
    return store_row(_roundtrip(spark, sf_dir, "csv_tags", partition_by=("date", "metric_name")))


@register("jsonl_partitioned")
def jsonl_partitioned(spark, sf_dir):
    """K2 in a JSON Lines store: by metric and host, read back."""
    return store_row(_roundtrip(spark, sf_dir, "jsonl", partition_by=("metric_name", "host")))


@register("csv_rotation")
def csv_rotation(spark, sf_dir):
    """K6: a CSV store of all line items' fields; rows, and files above the row limit."""
    path = scratch_path(spark, "store-rotated")
    pts = flatten.flatten(adapters.wide_payloads(adapters.read_table(spark, sf_dir, "lineitem")))
    writers.write_points(pts, path, "csv", partition_by=())
    files = points_src.read_csv_points(spark, path, partitions=()).groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("n"))
    return files.agg(F.sum("n").alias("rows"), F.sum((F.col("n") > 100_000).cast("bigint")).alias("over_limit"))


def _rotated(spark, sf_dir, fmt: str, limit: int, window: int | None):
    """A store rotated by size: per date and window, its files, rows, bytes and files over the limit."""
    path = scratch_path(spark, "store-by-size")
    pts = flatten.flatten(adapters.fields_payloads(events(spark, sf_dir)), keep=["received_at"])
    writers.write_rotated(pts, path, fmt, max_bytes=limit, window_minutes=window)
    read = points_src.read_csv_points if fmt == "csv" else points_src.read_jsonl_points
    rows = read(spark, path, partitions=("date", "file")).groupBy("date").agg(F.count(F.lit(1)).alias("rows"))
    age = F.substring_index("file", "-", 1).cast("bigint") if window else F.lit(0).cast("bigint")
    files = store.list_files(spark, path, fmt).groupBy("date", age.alias("age")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.sum((F.col("length") > limit).cast("bigint")).alias("over_limit"))
    return files.join(rows, "date").select(F.date_format("date", "yyyy-MM-dd").alias("date"), "age", "files", "bytes", "over_limit", "rows")


@register("rotation_by_size")
def rotation_by_size(spark, sf_dir):
    """K6 by size: a CSV store in files of at most 16 000 bytes."""
    return _rotated(spark, sf_dir, "csv", 16_000, None)


@register("rotation_by_age")
def rotation_by_age(spark, sf_dir):
    """K6 by size and age: JSON Lines, 30 000 bytes or six hours of arrivals a file."""
    return _rotated(spark, sf_dir, "jsonl", 30_000, 360)


@register("query_late_arrivals")
def query_late_arrivals(spark, sf_dir):
    """A store by arrival date, asked by event time: points that arrived days later count."""
    path = scratch_path(spark, "store-late")
    pts = flatten.flatten(adapters.late_payloads(events(spark, sf_dir)), keep=["received_at"])
    writers.write_points(pts, path, "parquet", date_source="received_at")
    return store_row(store.query_points(spark, path, "parquet", "view.value", "2024-01-05 00:00:00", "2024-01-06 00:00:00"))


@register("csv_roundtrip")
def csv_roundtrip(spark, sf_dir):
    """K3 + K6: CSV store with header, rotated every 100 000 rows, read back."""
    back = _roundtrip(spark, sf_dir, "csv")
    return back.select(epoch_seconds(F.col("timestamp")).alias("ts"), "metric_name", "value", "host")


@register("csv_tags_roundtrip")
def csv_tags_roundtrip(spark, sf_dir):
    """K4: CSV store with the tags column, read back."""
    return store_row(_roundtrip(spark, sf_dir, "csv_tags"))


@register("jsonl_gz_roundtrip")
def jsonl_gz_roundtrip(spark, sf_dir):
    """K5 + S4: gzip JSON Lines store, read back."""
    return store_row(_roundtrip(spark, sf_dir, "jsonl", compression="gzip"))


@register("fanout_stores")
def fanout_stores(spark, sf_dir):
    """K7 + U1: one pass to Parquet, CSV-with-tags and JSON Lines; all three read as one."""
    root = scratch_path(spark, "fanout")
    stores = [(f"{root}/parquet", "parquet"), (f"{root}/csv", "csv_tags"), (f"{root}/jsonl", "jsonl")]
    writers.fan_out(points_a(spark, sf_dir), stores)
    both = points_src.union_stores(spark, stores)
    return both.select("store", epoch_seconds(F.col("timestamp")).alias("ts"), "metric_name", "value", "host", "tags_json")


def _daily_store(spark, sf_dir) -> str:
    """Fixture A in a date-partitioned Parquet store, written with the rebalanced layout
    (AQE sizes the files; a crowded date is split over several writers)."""
    path = scratch_path(spark, "store-daily")
    writers.write_points(points_a(spark, sf_dir), path, "parquet", layout="rebalance")
    return path


@register("rows_per_file")
def rows_per_file(spark, sf_dir):
    """A1: rows per data file, summed per date directory (file counts depend on how the
    writers were balanced, rows do not)."""
    per_file = store.rows_per_file(spark, _daily_store(spark, sf_dir))
    return per_file.groupBy(F.date_format("date", "yyyy-MM-dd").alias("date")).agg(F.sum("rows").alias("rows"))


@register("list_files_range")
def list_files_range(spark, sf_dir):
    """dates in [2024-01-10, 2024-01-20] that hold files (partition pruning)."""
    files = store.files_in_range(spark, _daily_store(spark, sf_dir), "2024-01-10", "2024-01-20")
    return files.select(F.date_format("date", "yyyy-MM-dd").alias("date")).distinct()


@register("store_stats")
def store_stats(spark, sf_dir):
    """A4: records, files, bytes, errors (fixture E rejects) and rate of a store."""
    path = scratch_path(spark, "store-stats")
    payloads = adapters.dirty_payloads(events(spark, sf_dir))
    writers.write_points(flatten.flatten(payloads), path, "parquet", layout="rebalance")
    stats = store.store_stats(spark, path, rejected=flatten.rejected(payloads))
    return stats.select("total_records", F.col("write_errors").cast("bigint").alias("write_errors"), (F.col("total_files") > 0).alias("has_files"), (F.col("records_per_second") > 0).alias("has_rate"))


@register("store_report")
def store_report(spark, sf_dir):
    """A5: file count, total size, newest file and its size."""
    path = _daily_store(spark, sf_dir)
    listed = store.list_files(spark, path).agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("size"))
    report = store.store_report(spark, path).crossJoin(listed)  # one row each
    return report.select((F.col("files") == F.col("n")).alias("files_agree"), (F.col("bytes") == F.col("size")).alias("bytes_agree"),
                         F.col("newest_bytes").between(1, F.col("bytes")).alias("newest_in_range"))


@register("expired_files")
def expired_files(spark, sf_dir):
    """R1 (dry run): files older than 7 days as seen 8 days from now — every file —
    summed per date directory."""
    import datetime as dt

    path = _daily_store(spark, sf_dir)
    later = dt.datetime.now(dt.timezone.utc) + dt.timedelta(days=8)
    expired = store.expired_files(spark, path, days=7, now=later)
    dry = store.remove_files(expired, dry_run=True)
    rows = store.rows_per_file(spark, path).join(dry, "path")
    return rows.groupBy(F.date_format("date", "yyyy-MM-dd").alias("date")).agg(
        F.sum("rows").alias("rows"), F.sum(F.col("deleted").cast("bigint")).alias("deleted"))


# ---------------------------------------------------------------- streaming (landed files → stream)

# A landed file's row groups: a reader's task takes whole ones, so a trigger of one file is read
# by as many tasks as the file has of them.
ROW_GROUP_BYTES = 1 << 20


def _land(df: DataFrame, spark: SparkSession, name: str, files: int = 4) -> str:
    """Write fixture payloads as ``files`` Parquet files in ``seq`` ranges to stream from.

    The bounds come from ``seq`` alone: to find them, a range partitioning would build every
    payload's text a first time."""
    path = scratch_path(spark, f"landing-{name}")
    shares = [i / files for i in range(1, files)]
    bounds = df.agg(F.percentile_approx("seq", F.array(*map(F.lit, shares))).alias("at")).first()["at"] if shares else None
    number = F.lit(0)
    for bound in bounds or []:
        number += F.coalesce((F.col("seq") > bound).cast("int"), F.lit(0))
    df.repartitionById(files, number).write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return path


def _run(spark: SparkSession, start) -> None:
    q = start(scratch_path(spark, "checkpoint"))
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


@register("stream_ingest")
def stream_ingest(spark, sf_dir):
    """T1 + T2: landed payloads (fixture A) streamed into a Parquet store, one file per
    trigger of maxFilesPerTrigger=1, flushed with availableNow."""
    src = _land(adapters.fields_payloads(events(spark, sf_dir)), spark, "a")
    sink = scratch_path(spark, "stream-store")
    stream = live.payload_stream(spark, src, "parquet", max_files_per_trigger=1)
    _run(spark, lambda cp: live.ingest(stream, sink, cp))
    return store_row(points_src.read_parquet_points(spark, sink))


@register("stream_first_seen")
def stream_first_seen(spark, sf_dir):
    """First-seen series across micro-batches (fixture C)."""
    src = _land(adapters.labelled_lines(events(spark, sf_dir)), spark, "c")
    sink = scratch_path(spark, "stream-first-seen")
    _run(spark, lambda cp: live.first_seen(live.line_stream(spark, src, 1), sink, cp, SERIES))
    cat = live.read_first_seen(spark, sink, SERIES)
    return cat.select("series_key", "metric", "labels_json", "first_seq", F.col("first_timestamp").alias("first_ts"))


@register("stream_seen_reset")
def stream_seen_reset(spark, sf_dir):
    """T3 with a reset: even events stream, then odd ones together with a reset; how often
    each series was reported, and its first sequences."""
    lines = adapters.labelled_lines(events(spark, sf_dir))
    src, control = scratch_path(spark, "landing-seen"), scratch_path(spark, "landing-resets")
    sink, checkpoint = scratch_path(spark, "stream-seen"), scratch_path(spark, "checkpoint")
    spark.range(0).write.parquet(control)
    for half in range(2):
        lines.where(F.col("seq") % 2 == half).write.mode("append").option("parquet.block.size", ROW_GROUP_BYTES).parquet(src)
        if half:
            spark.range(1).coalesce(1).write.mode("append").parquet(control)
        resets = spark.readStream.schema("id bigint").parquet(control)
        _run(spark, lambda _: seen.first_seen(live.line_stream(spark, src), sink, checkpoint, resets, options=SERIES, shards=4))
    told = seen.read_reports(spark, sink)
    return told.groupBy("series_key", "metric", "labels_json").agg(F.count(F.lit(1)).alias("reports"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_first_seq"))


@register("stream_filtered")
def stream_filtered(spark, sf_dir):
    """T4: live stream of two metrics for one host (fixture A)."""
    src = _land(adapters.fields_payloads(events(spark, sf_dir)), spark, "a")
    sink = scratch_path(spark, "stream-filtered")
    stream = live.payload_stream(spark, src, "parquet", max_files_per_trigger=1)
    _run(spark, lambda cp: live.filtered_points(stream, sink, cp, metrics="click.value,view.k", tags={"region": "eu"}))
    return point_row(live.read_filtered(spark, sink))


@register("stream_filtered_wide")
def stream_filtered_wide(spark, sf_dir):
    """T4 as the clients call it: metrics by name and host, with all their fields."""
    src = _land(adapters.fields_payloads(events(spark, sf_dir)), spark, "a")
    sink = scratch_path(spark, "stream-filtered")
    stream = live.payload_stream(spark, src, "parquet", max_files_per_trigger=1)
    _run(spark, lambda cp: live.filtered(stream, sink, cp, metrics="purchase, view", tags={"host": "user-7"}))
    return live.read_filtered(spark, sink).select("seq", epoch_seconds(F.col("timestamp")).alias("ts"), "name", "host", "tags_json",
                                           F.col("fields")["value"].alias("value"), F.col("fields")["k"].alias("k"))


@register("stream_rejects")
def stream_rejects(spark, sf_dir):
    """T1 over payloads with bad timestamps (fixture F): it goes on, and the rejects are kept."""
    src = _land(adapters.timed_payloads(events(spark, sf_dir)), spark, "f")
    sink, aside = scratch_path(spark, "stream-store"), scratch_path(spark, "stream-rejects")
    stream = live.payload_stream(spark, src, "parquet", max_files_per_trigger=1)
    _run(spark, lambda cp: live.ingest(stream, sink, cp, quarantine=aside))
    kept = points_src.read_parquet_points(spark, sink).select(F.lit("ok").alias("reason"))
    return kept.unionByName(spark.read.parquet(aside).select("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


@register("published_batches")
def published_batches(spark, sf_dir):
    """Batches of two writers published through the manifest, each of them replayed, next
    to a batch that failed before it was published."""
    sink = scratch_path(spark, "published")
    pts = points_a(spark, sf_dir)
    for _ in range(2):
        for i in range(3):
            manifest.write_batch(pts.where(F.col("seq") % 4 == i), sink, "first", i)
        manifest.write_batch(pts.where(F.col("seq") % 4 == 3), sink, "second", 0)
    writers.write_points(pts, f"{sink}/{manifest.batch_folder('lost')}", "parquet")
    return store_row(points_src.read_parquet_points(spark, sink))


@register("recent_store")
def recent_store(spark, sf_dir):
    """W3 on a store by event date: the newest 40 points of a metric, from the newest dates on."""
    rec = store.recent_points(spark, _daily_store(spark, sf_dir), 40, "purchase.value", event_dates=True)
    return rec.select(epoch_seconds(F.col("timestamp")).alias("ts"), "metric_name", "value", "host")


@register("recent_store_late")
def recent_store_late(spark, sf_dir):
    """W3 on a published store by arrival date, where points arrive up to four days late."""
    pts = flatten.flatten(adapters.late_payloads(events(spark, sf_dir)), keep=["received_at"])
    sink = scratch_path(spark, "published-late")
    for i in range(3):
        manifest.write_batch(pts.where(F.col("seq") % 3 == i), sink, "late", i, "received_at")
    rec = store.recent_points(spark, sink, 40)
    return rec.select(epoch_seconds(F.col("timestamp")).alias("ts"), "metric_name", "value", "host")


@register("recent_store_metrics")
def recent_store_metrics(spark, sf_dir):
    """W3 on a store, whole metrics: every metric is stored twice, and equal ones stay two."""
    pts = points_a(spark, sf_dir)
    sink = scratch_path(spark, "published-twice")
    for i in range(2):
        manifest.write_batch(pts, sink, "twice", i)
    rec = store.recent_metrics(spark, sink, "signup", 60)
    return rec.select(epoch_seconds(F.col("timestamp")).alias("ts"), "name", "host", "tags_json", F.col("fields")["value"].alias("value"), F.col("fields")["k"].alias("k"))


@register("stream_line_numbers")
def stream_line_numbers(spark, sf_dir):
    """Lines of landed files, read by splits, with their number in the file."""
    path = scratch_path(spark, "landing-lines")
    lines = adapters.labelled_lines(events(spark, sf_dir)).withColumn("g", F.col("seq") % 4)
    lines.repartition("g").sortWithinPartitions("g", "seq").select("g", "raw").write.partitionBy("g").text(path)
    sink = scratch_path(spark, "numbered")
    stream = live.payload_stream(spark, path, "text", max_files_per_trigger=1)
    _run(spark, lambda cp: live.land_numbered(stream, sink, cp))
    rows = live.read_log(spark, sink)
    return rows.select(F.regexp_extract("source", "g=([0-9]+)", 1).cast("bigint").alias("file"), "line", "raw")


@register("stream_flush")
def stream_flush(spark, sf_dir):
    """A query that holds back what arrives. Even events wait for a request, those of one
    residue go out when the query has stopped, the last ones by their bytes; points per batch."""
    payloads = adapters.fields_payloads(events(spark, sf_dir))
    src, sink, cp, requests = (scratch_path(spark, f"flush-{n}") for n in ("landing", "store", "checkpoint", "requests"))

    def land(part):
        payloads.where(part).repartitionByRange(2, "seq").write.mode("append").parquet(src)

    def run(**how):
        _run(spark, lambda _: buffered.ingest(live.payload_stream(spark, src, "parquet"), sink, cp, trigger=live.FLUSH, requests=requests, **how))

    land("seq % 4 = 0")
    run()
    buffered.request_flush(spark, requests)
    land("seq % 4 = 2")
    run()
    land("seq % 4 = 1")
    run()
    buffered.publish_pending(spark, sink, cp)
    land("seq % 4 = 3")
    run(max_bytes=1)
    batch = F.regexp_extract("path", "^batch=([0-9]+)-", 1).cast("bigint")
    return manifest.files(spark, sink).groupBy(batch.alias("batch")).agg(F.sum("rows").alias("points"))


@register("append_after_stream")
def append_after_stream(spark, sf_dir):
    """T1 and a batch append into one store: readers see both."""
    payloads = adapters.fields_payloads(events(spark, sf_dir))
    src = _land(payloads.where("seq % 2 = 0"), spark, "a")
    sink = scratch_path(spark, "stream-store")
    stream = live.payload_stream(spark, src, "parquet", max_files_per_trigger=1)
    _run(spark, lambda cp: live.ingest(stream, sink, cp))
    manifest.write_batch(flatten.flatten(payloads.where("seq % 2 = 1"), keep=["received_at"]), sink, date_source="received_at")
    return store_row(points_src.read_parquet_points(spark, sink))


@register("stream_latest")
def stream_latest(spark, sf_dir):
    """T5: latest value per (name, tags) kept in streaming state (fixture B)."""
    src = _land(adapters.value_payloads(events(spark, sf_dir)), spark, "b")
    sink = scratch_path(spark, "stream-latest")
    stream = live.payload_stream(spark, src, "parquet", max_files_per_trigger=1)
    _run(spark, lambda cp: live.latest(stream, sink, cp))
    lat = live.read_latest(spark, sink)
    return lat.select("name", "tags_json", "main_field", "value", epoch_seconds(F.col("timestamp")).alias("ts"), "seq")


@register("stream_last_50")
def stream_last_50(spark, sf_dir):
    """Newest 50 values per host, re-ranked every micro-batch (fixture B)."""
    src = _land(adapters.value_payloads(events(spark, sf_dir)), spark, "b")
    sink = scratch_path(spark, "stream-last-50")
    stream = live.payload_stream(spark, src, "parquet", max_files_per_trigger=1)
    _run(spark, lambda cp: live.last_n(stream, sink, cp, field="value", n=50))
    last = live.read_last_n(spark, sink)
    return last.select("host", epoch_seconds(F.col("timestamp")).alias("ts"), "seq", "y", "rank")


@register("stream_counters")
def stream_counters(spark, sf_dir):
    """Running ingest counters over fixture E."""
    src = _land(adapters.dirty_payloads(events(spark, sf_dir)), spark, "e")
    sink = scratch_path(spark, "stream-counters")
    stream = live.payload_stream(spark, src, "parquet", max_files_per_trigger=1)
    _run(spark, lambda cp: live.counters(stream, sink, cp))
    return live.latest_batch(spark, sink)


# ---------------------------------------------------------------- file sources

@register("payload_files")
def payload_files(spark, sf_dir):
    """Fixture A payloads landed as text files, one per line, read back and flattened."""
    path = scratch_path(spark, "payload-text")
    adapters.fields_payloads(events(spark, sf_dir)).select("raw").write.text(path)
    pts = flatten.flatten(payload_src.read_payloads(spark, path))
    return store_row(pts)


@register("labelled_jsonl")
def labelled_jsonl(spark, sf_dir):
    """Fixture C landed as JSON Lines files, read with the labelled reader."""
    path = scratch_path(spark, "labelled-text")
    adapters.labelled_lines(events(spark, sf_dir)).select("raw").write.text(path)
    keyed = series.with_series_key(labelled.read_labelled(spark, path), SERIES)
    return keyed.select("series_key", F.col("timestamp").alias("ts"), "value")


@register("stream_text_ingest")
def stream_text_ingest(spark, sf_dir):
    """S2 + T1: payload text files streamed into the Parquet store."""
    path = scratch_path(spark, "payload-text")
    adapters.fields_payloads(events(spark, sf_dir)).select("seq", "raw").repartitionByRange(4, "seq") \
        .select("raw").write.text(path)
    sink = scratch_path(spark, "stream-store")
    stream = live.payload_stream(spark, path, "text", max_files_per_trigger=1)
    _run(spark, lambda cp: live.ingest(stream, sink, cp))
    return store_row(points_src.read_parquet_points(spark, sink))


@register("query_per_file")
def query_per_file(spark, sf_dir):
    """A1 + F1 + F2 as the ``/query`` route answers them, filters applied: matching rows
    per file, summed per date directory."""
    per_file = store.query_files(spark, _daily_store(spark, sf_dir), "click.value", "2024-01-05", "2024-01-20")
    return per_file.groupBy(F.date_format("date", "yyyy-MM-dd").alias("date")).agg(F.sum("rows").alias("rows"))


@register("query_points")
def query_points(spark, sf_dir):
    """The read path over a stored dataset: one metric, a time range and a tag, with the
    date range pruning directories."""
    path = _daily_store(spark, sf_dir)
    pts = store.query_points(spark, path, "parquet", "view.value", "2024-01-03 12:00:00", "2024-01-09 12:00:00",
                             tags={"region": "eu"}, event_dates=True)
    return store_row(pts)


@register("bulk_ingest")
def bulk_ingest(spark, sf_dir):
    """P1–P5 on payloads of about 1000 metrics each (line items grouped by order range)."""
    payloads = adapters.bulk_wide_payloads(adapters.read_table(spark, sf_dir, "lineitem"))
    return store_row(flatten.flatten(payloads))
