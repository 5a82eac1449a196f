"""Raw JSON payloads → typed points (one per metric field), plus the rejected input.

Everything here is a narrow transformation: parse, a per-payload validity test, two
generators (metrics, then fields). No step shuffles, so flattening runs inside the scan
stage of whatever reads the payloads, in batch and in streaming alike.

Rules kept from the collector:

* only an object whose ``metrics`` key is an array is a payload (``accept_bare`` also
  takes a bare array of metrics, or a bare metric object without a ``metrics`` key);
* missing ``timestamp`` → 0, missing ``name`` → ``unknown``, host = ``tags.host`` or
  ``unknown`` when tags are absent, not an object, or lack a host;
* a metric with ``value`` yields one point and ignores ``fields``; otherwise each numeric
  entry of an object ``fields`` yields a point ``name.field``; other entries are dropped;
* a key that is present with the wrong type (non-string or null ``name``, non-numeric
  ``timestamp``, non-numeric ``value``, non-string ``tags.host``, a metric that is not an
  object), or a timestamp out of range, rejects the payload (``scope='payload'``, the rule of
  the Parquet store), the metric (``scope='metric'``), or the metric and all that follow it in
  the payload (``scope='prefix'``, the rule of the CSV and JSON Lines stores);
* tag values that are not strings become their JSON text; ``tags_json`` is compact
  JSON with keys sorted, ``{}`` without tags.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from telemetra.constants import DEFAULT_TIMESTAMP, UNKNOWN
from telemetra.functions.points import in_time_span, sorted_json_object, to_event_time
from telemetra.functions.variant import (
    as_double,
    field,
    is_number,
    is_number_or_boolean,
    is_object,
    is_string,
    json_text_values,
)
from telemetra.schemas import FlattenOptions

# Reasons recorded for rejected input.
MALFORMED = "malformed"
NO_ENVELOPE = "no_envelope"
BAD_TYPE = "bad_type"
BAD_TIME = "bad_time"
AFTER_BAD = "after_bad"  # behind a rejected metric, in prefix scope
OK = "ok"

# What is read of a metric, taken out in one walk over the parsed payload; NULL for a metric
# that is not an object, fields NULL for keys that are missing.
METRIC = "struct<name:variant,timestamp:variant,value:variant,fields:map<string,variant>,tags:variant>"


def _absent_or(v: Column, test: Column) -> Column:
    return v.isNull() | F.coalesce(test, F.lit(False))


def metric_problem(m: Column, unit: str = "s") -> Column:
    """NULL for a usable metric, else why it is rejected: ``bad_type`` when a present key
    has no usable type, ``bad_time`` when its timestamp lies outside years 1 to 9999 in
    ``unit`` (a finer unit than stated, or a number past 64 bits)."""
    name, ts, value = m["name"], m["timestamp"], m["value"]
    host = field(m["tags"], "$.host")
    typed = (
        m.isNotNull()
        & _absent_or(name, is_string(name))
        & _absent_or(ts, is_number_or_boolean(ts))
        & _absent_or(value, is_number(value))
        & _absent_or(host, is_string(host))
    )
    in_range = _absent_or(ts, in_time_span(field(ts, "$", "bigint"), unit))
    return F.when(~F.coalesce(typed, F.lit(False)), F.lit(BAD_TYPE)).when(~in_range, F.lit(BAD_TIME))


def parse_payloads(payloads: DataFrame, options: FlattenOptions = FlattenOptions()) -> DataFrame:
    """Add ``metrics`` (an array of :data:`METRIC`) and ``status`` to each payload row.

    ``status`` is ``ok``, ``malformed`` (not JSON), ``no_envelope`` (JSON without a metrics
    array) or, in payload scope, the problem of a metric (``bad_type`` before ``bad_time``).
    """
    doc = F.try_parse_json(F.col("raw"))
    parsed = payloads.withColumn("_doc", doc)
    d = F.col("_doc")
    metrics = field(d, "$.metrics", f"array<{METRIC}>")
    if options.accept_bare:
        bare_object = F.when(is_object(d) & field(d, "$.metrics").isNull(), F.array(field(d, "$", METRIC)))
        metrics = F.coalesce(metrics, field(d, "$", f"array<{METRIC}>"), bare_object)
    parsed = parsed.withColumn("metrics", metrics)
    status = (
        F.when(d.isNull(), F.lit(MALFORMED))
        .when(F.col("metrics").isNull(), F.lit(NO_ENVELOPE))
    )
    if options.scope == "payload":
        # of several problems the greater name, that is bad_type
        worst = F.array_max(F.transform("metrics", lambda m: metric_problem(m, options.ts_unit)))
        status = F.coalesce(status, worst)
    return parsed.withColumn("status", F.coalesce(status, F.lit(OK))).drop("_doc")


def _good_prefix(options: FlattenOptions) -> Column:
    """How many metrics stand before the first one with a problem; one look at the array."""
    first = F.array_position(F.transform("metrics", lambda m: metric_problem(m, options.ts_unit).isNotNull()), F.lit(True))
    return F.when(first > 0, first - 1).otherwise(F.size("metrics")).cast("int")


def _metric_rows(parsed: DataFrame, options: FlattenOptions, keep: list[str]) -> DataFrame:
    """One row per accepted metric with its defaults applied."""
    # The status test sits inside the generator input, not in a Filter: Catalyst would push
    # a Filter below the projection and parse every payload twice.
    metrics = F.slice("metrics", F.lit(1), _good_prefix(options)) if options.scope == "prefix" else F.col("metrics")
    accepted = F.when(F.col("status") == OK, metrics)
    rows = parsed.select(*keep, "seq", F.posexplode(accepted).alias("pos", "m"))
    if options.scope == "metric":
        rows = rows.where(metric_problem(F.col("m"), options.ts_unit).isNull())
    m = F.col("m")
    return rows.select(
        *keep,
        "seq",
        "pos",
        to_event_time(F.coalesce(field(m["timestamp"], "$", "bigint"), F.lit(DEFAULT_TIMESTAMP)), options.ts_unit)
        .alias("timestamp"),
        F.coalesce(field(m["name"], "$", "string"), F.lit(UNKNOWN)).alias("name"),
        F.when(is_object(m["tags"]), m["tags"]).alias("tags_raw"),
        m["value"].alias("_value"),
        m["fields"].alias("_fields"),
    ).withColumn("tags", json_text_values(F.col("tags_raw"))).withColumns({
        # a host that is no string is a problem of its metric: the text among the tags is its own
        "host": F.coalesce(F.try_element_at("tags", F.lit("host")), F.lit(UNKNOWN)),
        # once per metric, before the fan-out repeats the row per field
        "tags_json": sorted_json_object(F.col("tags")),
    })


def could_yield(name: Column, targets: list[str]) -> Column:
    """True when a metric called ``name`` can produce a point named one of ``targets``:
    the target is the name itself (value metric) or starts with ``name.`` (a field)."""
    cond = F.lit(False)
    for t in targets:
        cond = cond | (name == F.lit(t)) | F.lit(t).startswith(F.concat(name, F.lit(".")))
    return cond


def flatten(
    payloads: DataFrame,
    options: FlattenOptions = FlattenOptions(),
    keep: list[str] | None = None,
    metrics: list[str] | None = None,
    counters: Observation | None = None,
    dated: bool = False,
) -> DataFrame:
    """Payload rows (``seq``, ``raw``, …) → points.

    Output columns: ``seq, pos, timestamp, metric_name, value, host, tags, tags_json,
    tags_raw`` plus the payload columns named in ``keep`` (e.g. ``received_at``).
    ``tags_raw`` is the original tag object (VARIANT) for stores that keep tag types.

    ``metrics`` keeps only points with those names, and drops metrics that cannot give
    one before their fields are fanned out (Catalyst cannot derive that from the
    ``concat`` that builds the name).

    ``counters`` observes A3's totals while whatever reads the points runs.

    ``dated`` adds the event ``date`` and deals the metrics by it before their fields are
    fanned out, for a store by event date that is then written ``as_is``: a metric's tags
    move once instead of with each of its points.
    """
    keep = list(keep or [])
    parsed = parse_payloads(payloads, options)
    if counters is not None:
        parsed = parsed.observe(counters, *_totals())
    rows = _metric_rows(parsed, options, keep)
    if metrics:
        rows = rows.where(could_yield(F.col("name"), metrics))
    if dated:
        rows = rows.withColumn("date", F.to_date("timestamp")).hint("rebalance", "date")
        keep = [*keep, "date"]
    points = _fan_out(rows, keep)
    if metrics:
        points = points.where(F.col("metric_name").isin(metrics))
    return points


def _fan_out(metrics: DataFrame, keep: list[str]) -> DataFrame:
    has_value = F.col("_value").isNotNull()
    entries = F.when(has_value, F.create_map(F.lit(""), F.col("_value"))).otherwise(F.col("_fields"))
    exploded = metrics.select(
        *keep, "seq", "pos", "timestamp", "name", "host", "tags", "tags_json", "tags_raw",
        has_value.alias("_single"), F.explode(entries).alias("_field", "_v"),
    ).where(is_number(F.col("_v")))
    return exploded.select(
        *keep,
        "seq",
        "pos",
        "timestamp",
        F.when(F.col("_single"), F.col("name"))
        .otherwise(F.concat(F.col("name"), F.lit("."), F.col("_field")))
        .alias("metric_name"),
        as_double(F.col("_v")).alias("value"),
        "host",
        "tags",
        "tags_json",
        "tags_raw",
    )


def wide_metrics(payloads: DataFrame, options: FlattenOptions = FlattenOptions(), keep: list[str] | None = None) -> DataFrame:
    """One row per metric, no fan-out, for live views.

    ``fields`` keeps the numeric entries as ``map<string,double>``; a metric with a
    top-level ``value`` shows it as the single field ``value``.
    """
    keep = list(keep or [])
    metrics = _metric_rows(parse_payloads(payloads, options), options, keep)
    numeric = F.map_filter(F.col("_fields"), lambda _k, v: is_number(v))
    doubles = F.transform_values(numeric, lambda _k, v: as_double(v))
    fields = F.when(
        F.col("_value").isNotNull(),
        F.create_map(F.lit("value"), as_double(F.col("_value"))),
    ).otherwise(F.coalesce(doubles, F.create_map().cast("map<string,double>")))
    return metrics.select(
        *keep, "seq", "pos", "timestamp", "name", "host", "tags", "tags_json", fields.alias("fields"),
    )


def rejected(payloads: DataFrame, options: FlattenOptions = FlattenOptions(), keep: list[str] | None = None) -> DataFrame:
    """The input set aside, one row per rejected payload (``pos`` NULL) or, in metric and
    prefix scope, also one per rejected metric; columns ``seq, pos, reason, raw``. In prefix
    scope the metrics behind the first bad one have the reason ``after_bad``.

    One pass: each payload row yields, through a single generator, either its own
    rejection or the positions of its wrongly typed metrics."""
    keep = list(keep or [])
    parsed = parse_payloads(payloads, options)
    whole = F.array(F.struct(F.lit(None).cast("int").alias("pos"), F.col("status").alias("reason")))
    if options.scope == "payload":
        items = F.when(F.col("status") != OK, whole)
    else:
        marked = F.transform(
            "metrics",
            lambda m, i: F.struct(i.alias("pos"), metric_problem(m, options.ts_unit).alias("reason")),
        )
        set_aside = F.filter(marked, lambda x: x["reason"].isNotNull())
        if options.scope == "prefix":
            bad = F.get(set_aside, F.lit(0))["pos"]  # NULL: no metric is behind it
            late = F.transform("metrics", lambda _, i: F.struct(i.alias("pos"), F.lit(AFTER_BAD).alias("reason")))
            set_aside = F.concat(F.slice(set_aside, 1, 1), F.filter(late, lambda x: x["pos"] > bad))
        items = F.when(F.col("status") != OK, whole).otherwise(set_aside)
    out = parsed.select(*keep, "seq", "raw", F.inline(items))
    return out.select(*keep, "seq", "pos", "reason", "raw")


def ingest_counters(payloads: DataFrame) -> DataFrame:
    """A3: requests received, and metrics counted over payloads that carry an envelope
    (counted before type checks, as the collector does)."""
    return parse_payloads(payloads, FlattenOptions(scope="metric")).agg(*_totals())


def _totals() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total_requests"),
        F.coalesce(F.sum(F.when(F.col("metrics").isNotNull(), F.size("metrics"))), F.lit(0)).cast("bigint").alias("total_metrics"),
    ]
