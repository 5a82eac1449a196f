"""Property tests: tag text and series keys against a plain-Python statement of the rule."""

import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from telemetra.functions.points import series_key, sorted_json_object
from telemetra.operators import flatten

keys = st.text(alphabet=st.characters(min_codepoint=33, max_codepoint=0x2FF, exclude_characters='"\\'), min_size=1, max_size=6)
scalars = st.one_of(
    st.text(alphabet=st.characters(min_codepoint=32, max_codepoint=0x2FF, exclude_characters='"\\'), max_size=6),
    st.integers(-10**6, 10**6),
    st.booleans(),
)
tag_maps = st.dictionaries(keys, scalars, max_size=5)


def expected_tags_json(tags: dict) -> str:
    text = {k: (v if isinstance(v, str) else json.dumps(v)) for k, v in tags.items()}
    ordered = dict(sorted(text.items(), key=lambda kv: kv[0].encode()))
    return json.dumps(ordered, separators=(",", ":"), ensure_ascii=False)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(tag_maps, min_size=1, max_size=8))
def test_tags_json_is_sorted_compact_text(payloads, tag_list):
    raws = [json.dumps({"metrics": [{"name": "m", "value": 1, "tags": t}]}) for t in tag_list]
    got = [r["tags_json"] for r in flatten.flatten(payloads(*raws)).orderBy("seq").collect()]
    assert got == [expected_tags_json(t) for t in tag_list]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(keys, st.text(alphabet="abcxyz:=", max_size=4), max_size=5), st.sampled_from([None, "p", "metrics"]))
def test_series_key_rule(spark, labels, prefix):
    df = spark.createDataFrame([("cpu", labels)], "metric string, labels map<string,string>")
    (row,) = df.select(series_key(F.col("metric"), F.col("labels"), prefix).alias("k")).collect()
    parts = ([prefix] if prefix is not None else []) + ["cpu"]
    parts += [f"{k}={v}" for k, v in sorted(labels.items(), key=lambda kv: (kv[0].encode(), kv[1].encode()))]
    assert row["k"] == ":".join(parts)


def test_sorted_json_object_of_null_map(spark):
    df = spark.createDataFrame([(None,)], "m map<string,string>")
    assert df.select(sorted_json_object(F.col("m")).alias("j")).first()["j"] == "{}"
