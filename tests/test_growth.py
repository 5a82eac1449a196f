"""Steps whose time has to follow the input: what a plan and a landed file look like."""

import glob

import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemetra.functions.variant import as_double, number_text
from telemetra.operators import flatten
from telemetra.plans import catalog
from telemetra.session import scratch_path
from telemetra.sinks import writers
from telemetra.sources import labelled
from telemetra.streaming import seen


def test_number_text_is_a_small_expression(spark):
    df = spark.range(1).select(F.parse_json(F.lit("1.5")).alias("v")).select(number_text(F.col("v")))
    assert len(df._jdf.queryExecution().analyzed().toString()) < 20_000


def test_metrics_are_taken_out_typed(spark, payloads):
    parsed = flatten.parse_payloads(payloads('{"metrics":[{"name":"a"},3,null]}'))
    kind = parsed.schema["metrics"].dataType.elementType
    assert isinstance(kind, T.StructType) and parsed.first()["status"] == flatten.BAD_TYPE


def test_doubles_are_those_of_the_cast(spark):
    texts = ["1", "-0.0", "0.1", "29.27", "1e20", "1e-7", "9007199254740993", "123456789012345678901234567890", "1.7976931348623157e308", "4.9e-324"]
    v = spark.createDataFrame([(t,) for t in texts], "t string").select(F.parse_json("t").alias("v"))
    got = v.select(as_double(F.col("v")).alias("a"), F.variant_get("v", "$", "double").alias("b")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got]


def test_a_landed_file_is_read_by_many_tasks(spark):
    rows = spark.range(60_000).select(F.col("id").alias("seq"), F.sha2(F.col("id").cast("string"), 256).alias("raw"))
    path = catalog._land(rows, spark, "groups", files=1)
    (file,) = glob.glob(f"{path.removeprefix('file:')}/*.parquet")
    assert pq.ParquetFile(file).num_row_groups > 1


def test_a_payload_is_built_once_to_land_it(spark):
    built = spark.sparkContext.accumulator(0)

    def text(n):
        built.add(1)
        return f"payload {n}"

    rows = spark.range(0, 4000, 1, 3).select(F.when(F.col("id") > 0, F.col("id")).alias("seq"), F.udf(text)("id").alias("raw"))
    path = catalog._land(rows, spark, "once")
    assert built.value == 4000
    parts = [pq.read_table(f, columns=["seq"]).column("seq") for f in glob.glob(f"{path.removeprefix('file:')}/*.parquet")]
    sizes, spans = [len(c) for c in parts], sorted((min(x), max(x)) for c in parts if (x := c.drop_null().to_pylist()))
    assert sum(sizes) == 4000 and len(parts) == 4 and max(sizes) < 1200
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    # nothing to land, and one seq for all rows
    assert spark.read.schema(rows.schema).parquet(catalog._land(rows.limit(0), spark, "none")).count() == 0
    assert spark.read.parquet(catalog._land(rows.withColumn("seq", F.lit(7)), spark, "same")).count() == 4000


def test_staged_tags_stay_variants(spark, payloads):
    path = scratch_path(spark, "staged")
    points = flatten.flatten(payloads('{"metrics":[{"name":"a","value":1,"tags":{"n":1.50}}]}', '{"metrics":[{"name":"b","value":2}]}'))
    back = writers.staged(points, path)
    assert isinstance(spark.read.parquet(path).schema["tags_raw"].dataType, T.VariantType)
    assert {r["metric_name"]: r["t"] for r in back.select("metric_name", F.to_json("tags_raw").alias("t")).collect()} == {"a": '{"n":1.5}', "b": None}


class _States:
    """A processor's handle whose states are plain dictionaries that count their messages."""

    def __init__(self):
        self.calls, self.maps, self.values = 0, {}, {}

    def getMapState(self, name, key, value):
        held, outer = self.maps.setdefault(name, {}), self

        class State:
            def getValue(self, key):
                outer.calls += 1
                return held.get(key)

            def containsKey(self, key):
                outer.calls += 1
                return key in held

            def updateValue(self, key, value):
                outer.calls += 1
                held[key] = value

            def clear(self):
                held.clear()

        return State()

    def getValueState(self, name, schema):
        held = self.values

        class State:
            def exists(self):
                return name in held

            def get(self):
                return held[name]

            def update(self, value):
                held[name] = value

        return State()


def _sightings(names, now=0, reset=False):
    rows = [(reset, n, "m", "{}", i, 0, 5, now) for i, n in enumerate(names)]
    return iter([pd.DataFrame(rows, columns=["reset", "series_key", "metric", "labels_json", "seq", "pos", "timestamp", "now"])])


def test_seen_series_are_noted_by_the_cell():
    """One message per series and map would make 30000 of them."""
    states, processor = _States(), seen._processor(10)
    processor.init(states)
    told = lambda *batch: [n for frame in processor.handleInputRows((0,), _sightings(*batch), None) for n in frame["series_key"]]
    names = [f"series-é-{i:05d}" for i in range(10_000)]
    assert told(names) == names and states.calls < 1000
    assert told(names, 12) == []  # the period after: held by the other map, noted anew
    assert told(names + ["zz"], 13) == ["zz"]
    assert told(["a"], 25) == ["a"] and told(names[:3], 25) == []
    assert told(names[:5], 45) == names[:5]  # two periods later: forgotten
    assert told([], 45) == []


def test_cells_split_as_a_map_grows():
    states, processor = _States(), seen._processor(1000, cell=2)
    processor.init(states)
    told = lambda names: [n for frame in processor.handleInputRows((0,), _sightings(names), None) for n in frame["series_key"]]
    names = [f"s{i:03d}" for i in range(200)]
    for i in range(0, 200, 10):
        assert told(names[max(0, i - 20) : i + 10]) == names[i : i + 10]
    held = states.maps["even"]
    assert sorted(n for (own,) in held.values() for n in own) == names and max(len(own) for (own,) in held.values()) < 20
    assert told(names) == []


def test_lines_are_read_in_a_compiled_projection(spark):
    """What a generator computes is interpreted, each mention of a value anew: it only picks
    columns that the projection below it made."""
    lines = spark.createDataFrame([(0, '{"metric":"a","timestamp":1,"value":2.5,"labels":{"h":"x"}}'), (1, '{"metric":1}'), (2, "[]")], "seq bigint, raw string")
    points = labelled.labelled_points(lines)
    plan = points._jdf.queryExecution().optimizedPlan().toString()
    (generate,) = [line for line in plan.splitlines() if "Generate inline" in line]
    assert "variant" not in generate
    assert [r.asDict() for r in points.collect()] == [{"seq": 0, "pos": 0, "timestamp": 1, "metric": "a", "value": 2.5, "labels": {"h": "x"}}]
