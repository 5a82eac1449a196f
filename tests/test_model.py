"""Model check: random payloads against a plain-Python statement of the collector's rules."""

import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from telemetra.operators import flatten
from telemetra.schemas import FlattenOptions

text = st.text(alphabet="abcXYZ019 ._-:/", min_size=0, max_size=5)
keys = st.text(alphabet="abcdefhost_.", min_size=1, max_size=5)
ints = st.integers(-(2**53), 2**53)
floats = st.floats(-1e6, 1e6, allow_nan=False, allow_infinity=False)
numbers = st.one_of(ints, floats)
anything = st.one_of(numbers, text, st.booleans(), st.none(), st.lists(ints, max_size=2))
tag_values = st.one_of(text, st.integers(-1000, 1000), st.booleans(), st.none())


@st.composite
def metrics(draw):
    if draw(st.integers(0, 19)) == 0:
        return draw(st.one_of(ints, text, st.lists(ints, max_size=2)))  # not an object
    m = {}
    if draw(st.booleans()):
        m["name"] = draw(st.one_of(text, text, text, ints, st.none()))
    if draw(st.booleans()):
        m["timestamp"] = draw(st.one_of(st.integers(-10**9, 4 * 10**9), st.floats(-1e9, 4e9, allow_nan=False),
                                        st.booleans(), text, st.none()))
    if draw(st.integers(0, 3)) == 0:
        m["value"] = draw(st.one_of(numbers, numbers, numbers, text, st.booleans(), st.none()))
    if draw(st.booleans()):
        m["fields"] = draw(st.one_of(st.dictionaries(keys, anything, max_size=4), st.lists(ints, max_size=2)))
    if draw(st.booleans()):
        tags = draw(st.dictionaries(keys, tag_values, max_size=3))
        if draw(st.booleans()):
            tags["host"] = draw(st.one_of(text, text, st.integers(0, 9), st.none()))
        m["tags"] = draw(st.one_of(st.just(tags), st.just(tags), st.lists(ints, max_size=2)))
    return m


payload_docs = st.one_of(
    st.builds(lambda ms: {"metrics": ms}, st.lists(metrics(), max_size=4)),
    st.builds(lambda ms: {"metrics": ms}, st.lists(metrics(), max_size=4)),
    st.builds(lambda ms: {"metrics": ms}, st.lists(metrics(), max_size=4)),
    st.just({"metrics": 5}),
    st.lists(metrics(), max_size=2),
)


def is_num(v):
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def valid(m):
    if not isinstance(m, dict):
        return False
    if "name" in m and not isinstance(m["name"], str):
        return False
    if "timestamp" in m and not (is_num(m["timestamp"]) or isinstance(m["timestamp"], bool)):
        return False
    if "value" in m and not is_num(m["value"]):
        return False
    tags = m.get("tags")
    if isinstance(tags, dict) and "host" in tags and not isinstance(tags["host"], str):
        return False
    return True


def tag_text(v):
    return v if isinstance(v, str) else json.dumps(v)


def model_points(seq, m):
    ts = int(m.get("timestamp", 0))
    name = m.get("name", "unknown")
    tags = m.get("tags")
    if isinstance(tags, dict):
        host = tags.get("host", "unknown")
        text_tags = {k: tag_text(v) for k, v in tags.items()}
    else:
        host, text_tags = "unknown", {}
    ordered = dict(sorted(text_tags.items(), key=lambda kv: kv[0].encode()))
    tags_json = json.dumps(ordered, separators=(",", ":"), ensure_ascii=False)
    if "value" in m:
        return [(seq, ts, name, float(m["value"]), host, tags_json)]
    fields = m.get("fields")
    if not isinstance(fields, dict):
        return []
    return [(seq, ts, f"{name}.{k}", float(v), host, tags_json) for k, v in fields.items() if is_num(v)]


def model(docs, scope):
    points, rejects = [], []
    for seq, doc in enumerate(docs):
        if not (isinstance(doc, dict) and isinstance(doc.get("metrics"), list)):
            rejects.append((seq, None, "no_envelope"))
            continue
        ms = doc["metrics"]
        if scope == "payload" and not all(valid(m) for m in ms):
            rejects.append((seq, None, "bad_type"))
            continue
        for pos, m in enumerate(ms):
            if valid(m):
                points += model_points(seq, m)
            else:
                rejects.append((seq, pos, "bad_type"))
    return sorted(points), sorted(rejects, key=repr)


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(st.lists(payload_docs, min_size=1, max_size=6), st.sampled_from(["payload", "metric"]))
def test_flatten_matches_the_rules(payloads, docs, scope):
    df = payloads(*[json.dumps(d) for d in docs])
    opts = FlattenOptions(scope=scope)
    got = sorted(
        tuple(r) for r in flatten.flatten(df, opts)
        .select("seq", F.unix_seconds("timestamp"), "metric_name", "value", "host", "tags_json").collect()
    )
    rej = sorted((tuple(r) for r in flatten.rejected(df, opts).select("seq", "pos", "reason").collect()), key=repr)
    want_points, want_rejects = model(docs, scope)
    assert got == want_points
    assert rej == want_rejects


@st.composite
def labelled(draw):
    if draw(st.integers(0, 9)) == 0:
        return draw(st.sampled_from(["", "   ", "not json", "[1, 2]", "7"]))
    d = {}
    if draw(st.booleans()):
        d["metric"] = draw(st.one_of(text, text, ints, st.none()))
    if draw(st.booleans()):
        d["timestamp"] = draw(st.one_of(st.integers(0, 4 * 10**9), st.booleans(), text))
    if draw(st.booleans()):
        d["value"] = draw(st.one_of(numbers, numbers, text, st.none()))
    if draw(st.booleans()):
        d["labels"] = draw(st.one_of(st.dictionaries(keys, text, max_size=3),
                                     st.dictionaries(keys, st.one_of(text, ints), max_size=2),
                                     st.lists(ints, max_size=2)))
    return json.dumps(d)


def model_labelled(seq, line, prefix):
    try:
        d = json.loads(line)
    except ValueError:
        return []
    if not isinstance(d, dict):
        return []
    metric, ts, value, labels = d.get("metric", "unknown"), d.get("timestamp", 0), d.get("value", 0.0), d.get("labels", {})
    if not isinstance(metric, str) or not (is_num(ts) or isinstance(ts, bool)) or not is_num(value):
        return []
    if isinstance(labels, dict) and not all(isinstance(v, str) for v in labels.values()):
        return []
    pairs = sorted(labels.items(), key=lambda kv: (kv[0].encode(), kv[1].encode())) if isinstance(labels, dict) else []
    key = ":".join(([prefix] if prefix else []) + [metric] + [f"{k}={v}" for k, v in pairs])
    return [(seq, int(ts), metric, float(value), key)]


@settings(max_examples=30, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(st.lists(labelled(), min_size=1, max_size=8), st.sampled_from([None, "metrics"]))
def test_labelled_points_match_the_rules(spark, lines, prefix):
    from telemetra.operators import series
    from telemetra.schemas import SeriesOptions
    from telemetra.sources.labelled import labelled_points

    df = spark.createDataFrame(list(enumerate(lines)), "seq bigint, raw string")
    keyed = series.with_series_key(labelled_points(df), SeriesOptions(prefix=prefix))
    got = sorted(tuple(r) for r in keyed.select("seq", "timestamp", "metric", "value", "series_key").collect())
    want = sorted(p for seq, line in enumerate(lines) for p in model_labelled(seq, line, prefix))
    assert got == want
