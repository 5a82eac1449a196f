"""Readers of the point stores (S3 Parquet, S4 JSON Lines, CSV) and their union.

Every reader has a fixed schema (no inference) and returns the canonical point shape
``timestamp, metric_name, value, host, tags_json`` plus ``date`` when the store is
date-partitioned, so filters on metric, host and time reach the Parquet scan and filters
on ``date`` prune directories.

``recursive=True`` reads a plain directory tree instead (the collector's own
``base/YYYY/MM/DD/metrics_*`` layout): every data file below ``base``, no partition
columns, and ``pattern`` selects the files (``*.jsonl*``, ``*.csv``, ``*.parquet``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemetra.constants import UNKNOWN
from telemetra.functions.points import in_time_span, sorted_json_object, to_event_time
from telemetra.functions.rows import keep_where
from telemetra.functions.variant import as_double, field, is_number, is_string, json_text_values
from telemetra.schemas import POINT_CSV, POINT_CSV_TAGS, POINT_PARQUET
from telemetra.sinks import cells, manifest

CANONICAL = ["timestamp", "metric_name", "value", "host", "tags_json"]
_DATE = T.StructField("date", T.DateType(), True)
# What is read of a JSON line; NULL for one that is no object.
LINE = "struct<timestamp:variant,metric:variant,value:variant,host:variant,tags:variant>"


# Partition directories are named after the stored column; its canonical name in points.
STORED_NAMES = {"metric_name": "metric"}


def _with_partitions(schema: T.StructType, partitions: tuple[str, ...]) -> T.StructType:
    """``schema`` with the partition columns (stored names) that it lacks."""
    names = {f.name for f in schema.fields}
    more = [_DATE if p == "date" else T.StructField(p, T.StringType(), True) for p in partitions if p not in names]
    return T.StructType([*schema.fields, *more])


def _stored(partitions: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(STORED_NAMES.get(p, p) for p in partitions)


def _reader(spark: SparkSession, recursive: bool, pattern: str | None):
    reader = spark.read
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader


def read_parquet_points(spark: SparkSession, base: str, partitions: tuple[str, ...] = ("date",), recursive: bool = False, pattern: str | None = None) -> DataFrame:
    """S3: Parquet points with the fixed schema (partition columns from directories). Of a
    store with a manifest, the files that its newest version lists."""
    if not recursive and manifest.is_manifest(spark, base):
        return manifest.read_points(spark, base)
    schema = _with_partitions(POINT_PARQUET, () if recursive else partitions)
    return _reader(spark, recursive, pattern).schema(schema).parquet(base)


def read_parquet_nanos(spark: SparkSession, base: str, recursive: bool = True, pattern: str | None = "*.parquet") -> DataFrame:
    """S3 for files whose timestamp is Parquet TIMESTAMP(NANOS), as the collector writes
    them: read as a number (the ``nanosAsLong`` switch is set while the schema is read and
    put back) and converted to microseconds; the stored values are whole seconds, nothing is
    lost."""
    flag = "spark.sql.legacy.parquet.nanosAsLong"
    before = spark.conf.get(flag, None)
    spark.conf.set(flag, "true")
    try:
        raw = _reader(spark, recursive, pattern).parquet(base)
    finally:
        spark.conf.unset(flag) if before is None else spark.conf.set(flag, before)
    return raw.withColumn("timestamp", F.timestamp_micros(F.expr("timestamp div 1000 - IF(timestamp < 0 AND timestamp % 1000 <> 0, 1, 0)")))


def read_csv_points(spark: SparkSession, base: str, with_tags: bool = False, partitions: tuple[str, ...] = ("date",), recursive: bool = False, pattern: str | None = None) -> DataFrame:
    """CSV points (K3/K4 stores) → canonical points."""
    partitions = () if recursive else _stored(partitions)
    schema = _with_partitions(POINT_CSV_TAGS if with_tags else POINT_CSV, partitions)
    df = _reader(spark, recursive, pattern).schema(schema).option("header", True).option("escape", '"').csv(base)
    tags = F.col("tags") if with_tags else F.lit("{}")
    extra = [p for p in partitions if p == "date"]
    return df.select(
        to_event_time(F.col("timestamp")).alias("timestamp"),
        F.col("metric").alias("metric_name"),
        "value",
        "host",
        tags.alias("tags_json"),
        *extra,
    )


def read_jsonl_points(spark: SparkSession, base: str, partitions: tuple[str, ...] = ("date",), recursive: bool = False, pattern: str | None = None) -> DataFrame:
    """JSON Lines points (plain or gzip, by file suffix); lines that are not JSON or
    miss a typed ``metric`` / ``timestamp`` / ``value`` are skipped."""
    partitions = () if recursive else _stored(partitions)
    line = T.StructType([T.StructField("value", T.StringType(), True)])
    schema = _with_partitions(line, partitions)
    found = cells.read_lines(spark, base, partitions) if pattern is None and not {"host", "file"}.isdisjoint(partitions) else None
    if found is not None:
        lines = found.select(*[F.col(f.name).cast(f.dataType) for f in schema])
    else:
        lines = _reader(spark, recursive, pattern).schema(schema).text(base)
    # one walk over a line and one test of it in compiled projections: the generator only keeps or
    # drops it, and the columns above it are made only if they are asked for
    read = lines.select(F.try_variant_get(F.try_parse_json("value"), "$", LINE).alias("d"), *[F.col(p).alias(f"_{p}") for p in partitions])
    d = F.col("d")
    seconds = field(d["timestamp"], "$", "bigint")
    named = F.lit(True) if "metric" in partitions else is_string(d["metric"])
    ok = F.coalesce(is_number(d["timestamp"]) & in_time_span(seconds) & named & is_number(d["value"]), F.lit(False))
    good = keep_where(read.withColumn("_ok", ok), F.col("_ok"), "d", *[f"_{p}" for p in partitions])
    # a partition column stands for the key that partitioning took out of the lines
    return good.select(
        to_event_time(seconds).alias("timestamp"),
        (F.col("_metric") if "metric" in partitions else field(d["metric"], "$", "string")).alias("metric_name"),
        as_double(d["value"]).alias("value"),
        F.coalesce(F.col("_host") if "host" in partitions else field(d["host"], "$", "string"), F.lit(UNKNOWN)).alias("host"),
        sorted_json_object(json_text_values(d["tags"])).alias("tags_json"),
        *[F.col("_date").alias("date") for p in partitions if p == "date"],
    )


def read_store(spark: SparkSession, base: str, fmt: str, partitions: tuple[str, ...] = ("date",), recursive: bool = False, pattern: str | None = None) -> DataFrame:
    """Any store → canonical points."""
    if fmt == "parquet":
        return read_parquet_points(spark, base, partitions, recursive, pattern)
    if fmt == "csv":
        return read_csv_points(spark, base, False, partitions, recursive, pattern)
    if fmt == "csv_tags":
        return read_csv_points(spark, base, True, partitions, recursive, pattern)
    if fmt == "jsonl":
        return read_jsonl_points(spark, base, partitions, recursive, pattern)
    raise ValueError(f"unknown store format {fmt!r}")


def union_stores(spark: SparkSession, stores: list[tuple[str, str]]) -> DataFrame:
    """Several stores (any formats) as one DataFrame with a ``store`` column."""
    frames = [
        read_store(spark, base, fmt).select(*CANONICAL, F.lit(fmt).alias("store"))
        for base, fmt in stores
    ]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
