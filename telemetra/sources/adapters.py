"""Adapters that turn the driver's test tables into collector input, inside Spark.

Each adapter is one projection over a table scan: the JSON text is built with
``to_json`` per row, so the payload DataFrame has as many partitions as the scan and the
operators downstream parse real JSON. ``seq`` is the arrival order (a unique id of the
source row); ``received_at`` is the row's own time so that runs are reproducible.

* A (fields): events → ``{"metrics":[{name, timestamp, fields:{value, k, note}, tags:{region, host}}]}``
* B (value): the same metric with a top-level ``value`` instead of ``fields``
* C (labelled): events → one ``{timestamp, metric, value, labels:{host, region}}`` per line
* D (wide): lineitem → four numeric fields per line item
* E (dirty): A with ``event_id % 10`` choosing a fault (see :func:`dirty_payloads`)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table, read as it is stored."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _event_seconds() -> Column:
    return F.unix_seconds(F.col("ts").cast("timestamp"))


def event_region() -> Column:
    """A tag that varies: the user's region."""
    return F.element_at(F.array(F.lit("eu"), F.lit("us"), F.lit("ap")), (F.col("user_id") % 3 + 1).cast("int"))


def _event_tags() -> Column:
    return F.struct(
        event_region().alias("region"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("host"),
    )


def _event_k() -> Column:
    return F.get_json_object(F.col("props"), "$.k").cast("bigint")


def _fields_metric(with_name: bool = True, with_ts: bool = True, with_tags: bool = True) -> Column:
    parts = []
    if with_name:
        parts.append(F.col("event_type").alias("name"))
    if with_ts:
        parts.append(_event_seconds().alias("timestamp"))
    parts.append(
        F.struct(F.col("value").alias("value"), _event_k().alias("k"), F.lit("x").alias("note")).alias("fields")
    )
    if with_tags:
        parts.append(_event_tags().alias("tags"))
    return F.struct(*parts)


def _value_metric() -> Column:
    return F.struct(
        F.col("event_type").alias("name"),
        _event_seconds().alias("timestamp"),
        F.col("value").alias("value"),
        _event_tags().alias("tags"),
    )


def _envelope(*metrics: Column, keep_nulls: bool = False) -> Column:
    """``{"metrics":[...]}`` text; metrics may have different shapes, so each is
    serialised on its own and the array is joined as text."""
    opts = {"ignoreNullFields": "false"} if keep_nulls else {}
    items = [F.to_json(m, opts) for m in metrics]
    return F.concat(F.lit('{"metrics":['), F.concat_ws(",", *items), F.lit("]}"))


def _payload_frame(events: DataFrame, raw: Column) -> DataFrame:
    return events.select(
        F.col("event_id").alias("seq"),
        raw.alias("raw"),
        F.lit("events").alias("source"),
        F.col("ts").cast("timestamp").alias("received_at"),
    )


def fields_payloads(events: DataFrame) -> DataFrame:
    """Fixture A: one enveloped fields-metric per event."""
    return _payload_frame(events, _envelope(_fields_metric()))


def value_payloads(events: DataFrame) -> DataFrame:
    """Fixture B: one enveloped value-metric per event."""
    return _payload_frame(events, _envelope(_value_metric()))


def labelled_lines(events: DataFrame) -> DataFrame:
    """Fixture C: one labelled point per line (``seq``, ``raw``)."""
    point = F.struct(
        _event_seconds().alias("timestamp"),
        F.col("event_type").alias("metric"),
        F.col("value").alias("value"),
        F.struct(
            F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("host"),
            event_region().alias("region"),
        ).alias("labels"),
    )
    return events.select(F.col("event_id").alias("seq"), F.to_json(point).alias("raw"))


def wide_payloads(lineitem: DataFrame) -> DataFrame:
    """Fixture D: one enveloped metric per line item with four numeric fields."""
    metric = F.struct(
        F.lit("lineitem").alias("name"),
        F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("timestamp"),
        F.struct(
            F.col("l_quantity").alias("quantity"),
            F.col("l_extendedprice").alias("extendedprice"),
            F.col("l_discount").alias("discount"),
            F.col("l_tax").alias("tax"),
        ).alias("fields"),
        F.struct(
            F.concat(F.lit("supp-"), F.col("l_suppkey").cast("string")).alias("host"),
            F.col("l_returnflag").alias("flag"),
        ).alias("tags"),
    )
    return lineitem.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
        _envelope(metric).alias("raw"),
        F.lit("lineitem").alias("source"),
        F.col("l_shipdate").cast("timestamp").alias("received_at"),
    )


def dirty_payloads(events: DataFrame) -> DataFrame:
    """Fixture E: ``event_id % 10`` picks what is wrong with the payload.

    0 not JSON (cut short) · 1 bare array without envelope · 2 no name · 3 no tags ·
    4 a clean metric plus one whose value is a string · 5 boolean and string fields next
    to the numeric value · 6 no timestamp · 7 a clean metric plus one with a null name ·
    8, 9 clean.
    """
    clean = _fields_metric()
    fault = F.col("event_id") % 10
    string_value = F.struct(
        F.col("event_type").alias("name"),
        _event_seconds().alias("timestamp"),
        F.col("value").cast("string").alias("value"),
        _event_tags().alias("tags"),
    )
    mixed_fields = F.struct(
        F.col("event_type").alias("name"),
        _event_seconds().alias("timestamp"),
        F.struct(
            F.col("value").alias("value"),
            F.lit(True).alias("up"),
            _event_k().cast("string").alias("k"),
        ).alias("fields"),
        _event_tags().alias("tags"),
    )
    null_name = F.struct(
        F.lit(None).cast("string").alias("name"),
        _event_seconds().alias("timestamp"),
        F.col("value").alias("value"),
    )
    raw = (
        F.when(fault == 0, F.concat(F.lit('{"metrics":['), F.to_json(clean)))
        .when(fault == 1, F.to_json(F.array(clean)))
        .when(fault == 2, _envelope(_fields_metric(with_name=False)))
        .when(fault == 3, _envelope(_fields_metric(with_tags=False)))
        .when(fault == 4, _envelope(clean, string_value))
        .when(fault == 5, _envelope(mixed_fields))
        .when(fault == 6, _envelope(_fields_metric(with_ts=False)))
        .when(fault == 7, _envelope(clean, null_name, keep_nulls=True))
        .otherwise(_envelope(clean))
    )
    return _payload_frame(events, raw)


# Orders per bulk payload: about 1000 metrics (four line items per order on average), the
# payload size collection agents send.
ORDERS_PER_PAYLOAD = 250


def bulk_wide_payloads(lineitem: DataFrame, orders_per_payload: int = ORDERS_PER_PAYLOAD) -> DataFrame:
    """Fixture D in bulk: the line items of ``orders_per_payload`` consecutive orders share
    one envelope (about 1000 metrics). Each group is bounded (an order has at most seven
    lines), so the ``collect_list`` per payload is bounded too."""
    metric = F.to_json(
        F.struct(
            F.lit("lineitem").alias("name"),
            F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("timestamp"),
            F.struct(
                F.col("l_quantity").alias("quantity"),
                F.col("l_extendedprice").alias("extendedprice"),
                F.col("l_discount").alias("discount"),
                F.col("l_tax").alias("tax"),
            ).alias("fields"),
            F.struct(
                F.concat(F.lit("supp-"), F.col("l_suppkey").cast("string")).alias("host"),
                F.col("l_returnflag").alias("flag"),
            ).alias("tags"),
        )
    )
    keyed = lineitem.select(
        F.floor(F.col("l_orderkey") / orders_per_payload).alias("seq"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line"),
        metric.alias("metric"),
        F.col("l_shipdate").cast("timestamp").alias("shipped"),
    )
    grouped = keyed.groupBy("seq").agg(
        F.sort_array(F.collect_list(F.struct("line", "metric"))).alias("items"),
        F.max("shipped").alias("received_at"),
    )
    return grouped.select(
        "seq",
        F.concat(F.lit('{"metrics":['), F.array_join(F.col("items.metric"), ","), F.lit("]}")).alias("raw"),
        F.lit("lineitem").alias("source"),
        "received_at",
    )


def mixed_payloads(events: DataFrame) -> DataFrame:
    """Fixture H: three metrics per payload, of which number ``event_id % 4`` (1 to 3; 0: none)
    has a value of the wrong type."""
    def metric(i: int) -> Column:
        value = F.when(F.col("event_id") % 4 == i, F.lit('"bad"')).otherwise(F.col("value").cast("string"))
        return F.concat(F.lit(f'{{"name":"m{i}","timestamp":'), _event_seconds().cast("string"), F.lit(',"value":'), value, F.lit("}"))

    return _payload_frame(events, F.concat(F.lit('{"metrics":['), F.concat_ws(",", *[metric(i) for i in (1, 2, 3)]), F.lit("]}")))


def numeric_tag_payloads(events: DataFrame) -> DataFrame:
    """Fixture I: tags that are numbers of every kind, a nested value and a null."""
    k = _event_k().cast("bigint")
    tags = F.concat(
        F.lit('{"whole":'), k, F.lit('.0,"large":'), k + 1, F.lit('e20,"small":'), k + 1, F.lit('e-7,"part":0.'), k, F.lit('0,"int":'), k,
        F.lit(',"wide":'), k + 1, F.lit('000000000000000000,"nested":{"b":['), k, F.lit(',"x"], "a":true},"none":null,"text":"1.0"}'))
    return _payload_frame(events, F.concat(F.lit('{"metrics":[{"name":"m","timestamp":'), _event_seconds(), F.lit(',"value":1,"tags":'), tags, F.lit("}]}")))


def late_payloads(events: DataFrame) -> DataFrame:
    """Fixture A arriving ``event_id % 5`` days after the event."""
    return fields_payloads(events).withColumn("received_at", F.col("received_at") + F.make_interval(days=(F.col("seq") % 5).cast("int")))


def timed_payloads(events: DataFrame) -> DataFrame:
    """Fixture F: the timestamp in other units, ``event_id % 6``: 0 seconds · 1 milliseconds ·
    2 microseconds · 3 nanoseconds · 4 past 64 bits · 5 before year 1."""
    s = _event_seconds().cast("decimal(38,0)")
    unit = F.col("event_id") % 6
    ts = F.when(unit == 1, s * 1000).when(unit == 2, s * 1_000_000).when(unit == 3, s * 1_000_000_000)
    ts = ts.when(unit == 4, s * F.lit(10**15).cast("decimal(20,0)")).when(unit == 5, -s * 1000).otherwise(s)
    metric = F.concat(F.lit('{"name":"'), "event_type", F.lit('","timestamp":'), ts.cast("string"), F.lit(',"value":'), F.col("value").cast("string"), F.lit("}"))
    return _payload_frame(events, F.concat(F.lit('{"metrics":['), metric, F.lit("]}")))


def system_payloads(events: DataFrame) -> DataFrame:
    """Fixture G: metrics ``cpu``, ``memory`` and ``system`` with the fields the charts plot."""
    name = F.when(F.col("event_type") == "click", "cpu").when(F.col("event_type") == "view", "memory").otherwise("system")
    metric = F.struct(
        name.alias("name"), _event_seconds().alias("timestamp"),
        F.struct(F.col("value").alias("usage"), _event_k().alias("used")).alias("fields"), _event_tags().alias("tags"))
    return _payload_frame(events, _envelope(metric))


# Events per bulk payload or labelled array.
EVENTS_PER_PAYLOAD = 100


def _grouped(events: DataFrame, item: Column) -> DataFrame:
    """``seq`` and the JSON texts of ``EVENTS_PER_PAYLOAD`` consecutive events, in order."""
    rows = events.select(F.floor(F.col("event_id") / EVENTS_PER_PAYLOAD).alias("seq"), "event_id", F.to_json(item).alias("item"))
    return rows.groupBy("seq").agg(F.sort_array(F.collect_list(F.struct("event_id", "item"))).alias("items"))


def bulk_day_payloads(events: DataFrame) -> DataFrame:
    """Fixture B in bulk, timestamps cut to the day: several points of one series and
    timestamp share a payload."""
    metric = F.struct(
        F.col("event_type").alias("name"), (F.floor(_event_seconds() / 86400) * 86400).alias("timestamp"), F.col("value").alias("value"),
        F.struct(event_region().alias("region")).alias("tags"))
    return _grouped(events, metric).select("seq", F.concat(F.lit('{"metrics":['), F.array_join("items.item", ","), F.lit("]}")).alias("raw"))


def labelled_arrays(events: DataFrame) -> DataFrame:
    """Fixture C as arrays of labelled points, one per line."""
    point = F.struct(
        _event_seconds().alias("timestamp"), F.col("event_type").alias("metric"), F.col("value").alias("value"),
        F.struct(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("host"), event_region().alias("region")).alias("labels"))
    return _grouped(events, point).select("seq", F.concat(F.lit("["), F.array_join("items.item", ","), F.lit("]")).alias("raw"))
