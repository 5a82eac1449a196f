"""Labelled points from JSON Lines (``{timestamp, metric, value, labels}``).

Blank lines, lines that are not JSON, and lines with a wrongly typed key (non-string
``metric``, non-numeric ``timestamp`` or ``value``, a non-string label value) are
skipped. Defaults: ``metric`` → ``unknown``, ``timestamp`` → 0, ``value`` → 0.0, no
labels → empty map; labels that are not an object count as no labels. With ``arrays`` a
line may also hold an array of such points (the batch sender's input); its points keep
their position as ``pos``, and a wrongly typed one is skipped alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemetra.constants import DEFAULT_LABELLED_VALUE, DEFAULT_TIMESTAMP, UNKNOWN
from telemetra.functions.rows import arrival, keep_where
from telemetra.functions.variant import as_double, field, is_number, is_number_or_boolean, is_string

# What is read of a line; NULL for one that is no object.
POINT = "struct<metric:variant,timestamp:variant,value:variant,labels:variant>"


def labelled_points(lines: DataFrame, arrays: bool = False) -> DataFrame:
    """(``seq``, ``raw``) lines → ``seq, pos, timestamp, metric, value, labels``."""
    doc = F.try_parse_json(F.col("raw"))
    # blank and whitespace-only lines do not parse, so the validity test skips them too
    if arrays:
        # a generator is not pushed below the projection: each line is parsed once
        items = lines.select("seq", doc.alias("_doc"))
        several = field(F.col("_doc"), "$", "array<variant>")
        parsed = items.select("seq", F.posexplode(F.coalesce(several, F.array("_doc"))).alias("pos", "d"))
    else:
        parsed = lines.select("seq", F.lit(0).alias("pos"), doc.alias("d"))
    # one walk over a line, then each column once in a projection (the generator's own
    # expressions are interpreted and share nothing)
    read = parsed.select("seq", "pos", F.try_variant_get("d", "$", POINT).alias("p"))
    p = {c: F.col("p")[c] for c in ("metric", "timestamp", "value", "labels")}
    label_map = field(p["labels"], "$", "map<string,variant>")
    typed = read.select(
        "seq", "pos", field(p["timestamp"], "$", "bigint").alias("timestamp"), field(p["metric"], "$", "string").alias("metric"),
        as_double(p["value"]).alias("value"), field(p["labels"], "$", "map<string,string>").alias("labels"), F.col("p").isNotNull().alias("is_point"),
        (p["metric"].isNull() | F.coalesce(is_string(p["metric"]), F.lit(False))).alias("named"),
        p["timestamp"].isNull().alias("untimed"), F.coalesce(is_number_or_boolean(p["timestamp"]), F.lit(False)).alias("timed"),
        (p["value"].isNull() | F.coalesce(is_number(p["value"]), F.lit(False))).alias("valued"),
        F.coalesce(F.forall(F.map_values(label_map), is_string), F.lit(True)).alias("labelled"))
    timed = F.col("untimed") | (F.col("timed") & F.col("timestamp").isNotNull())
    return keep_where(
        typed,
        F.col("is_point") & F.col("named") & timed & F.col("valued") & F.col("labelled"),
        "seq",
        "pos",
        F.coalesce("timestamp", F.lit(DEFAULT_TIMESTAMP)).alias("timestamp"),
        F.coalesce("metric", F.lit(UNKNOWN)).alias("metric"),
        F.coalesce("value", F.lit(DEFAULT_LABELLED_VALUE)).alias("value"),
        F.coalesce("labels", F.create_map().cast("map<string,string>")).alias("labels"),
    )


def read_labelled(spark: SparkSession, path: str, arrays: bool = False) -> DataFrame:
    """Labelled JSON Lines files (recursive) → labelled points; ``seq`` is each line's place
    in arrival order (:func:`telemetra.functions.rows.arrival`)."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(arrival().alias("seq"), F.col("value").alias("raw"))
    return labelled_points(lines, arrays)
