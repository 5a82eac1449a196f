"""Fixed schemas of the point profiles and the option records of the library."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Literal

from pyspark.sql import types as T

from telemetra.constants import DEFAULT_DUPLICATE_POLICY, DEFAULT_RETENTION_SECONDS

# Raw payloads as they arrive: one JSON document each, with sender and arrival time.
PAYLOAD = T.StructType([
    T.StructField("seq", T.LongType(), False),
    T.StructField("raw", T.StringType(), True),
    T.StructField("source", T.StringType(), True),
    T.StructField("received_at", T.TimestampType(), True),
])

# Point as stored in Parquet (timestamp is whole seconds, kept as TIMESTAMP).
POINT_PARQUET = T.StructType([
    T.StructField("timestamp", T.TimestampType(), True),
    T.StructField("metric_name", T.StringType(), True),
    T.StructField("value", T.DoubleType(), True),
    T.StructField("host", T.StringType(), True),
    T.StructField("tags_json", T.StringType(), True),
])

# Point as stored in JSON Lines: epoch seconds, tags as a JSON object.
POINT_JSONL = T.StructType([
    T.StructField("timestamp", T.LongType(), True),
    T.StructField("metric", T.StringType(), True),
    T.StructField("value", T.DoubleType(), True),
    T.StructField("host", T.StringType(), True),
    T.StructField("tags", T.MapType(T.StringType(), T.StringType()), True),
])

# Point as stored in CSV, with and without the tags column (tags as JSON text).
POINT_CSV = T.StructType([
    T.StructField("timestamp", T.LongType(), True),
    T.StructField("metric", T.StringType(), True),
    T.StructField("value", T.DoubleType(), True),
    T.StructField("host", T.StringType(), True),
])
POINT_CSV_TAGS = T.StructType(POINT_CSV.fields + [T.StructField("tags", T.StringType(), True)])

# Labelled point used by the series operators.
LABELLED = T.StructType([
    T.StructField("seq", T.LongType(), True),
    T.StructField("timestamp", T.LongType(), True),
    T.StructField("metric", T.StringType(), True),
    T.StructField("value", T.DoubleType(), True),
    T.StructField("labels", T.MapType(T.StringType(), T.StringType()), True),
])

DuplicatePolicy = Literal["LAST", "FIRST", "MIN", "MAX", "SUM"]  # constants.DUPLICATE_POLICIES
ErrorScope = Literal["payload", "metric", "prefix"]
TsUnit = Literal["s", "ms"]


@dataclass(frozen=True)
class FlattenOptions:
    """How payloads become points.

    ``scope='payload'`` rejects a whole payload when one metric has a wrongly typed key
    (the Parquet store's rule); ``'metric'`` rejects only that metric; ``'prefix'`` keeps the
    metrics before it (the rule of the CSV and JSON Lines stores). ``accept_bare``
    takes a bare array of metrics or a bare metric object as if it were enveloped.
    """

    scope: ErrorScope = "payload"
    accept_bare: bool = False
    ts_unit: TsUnit = "s"


@dataclass(frozen=True)
class SeriesOptions:
    """Options carried by every series of the catalog."""

    prefix: str | None = None
    retention: int | None = DEFAULT_RETENTION_SECONDS
    duplicate_policy: DuplicatePolicy = DEFAULT_DUPLICATE_POLICY
    compressed: bool = True
