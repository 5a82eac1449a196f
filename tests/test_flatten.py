"""Flattening rules on the literal fixtures (FX*) and the edge cases of the collector."""

import json

from pyspark.sql import functions as F

from telemetra.operators import aggregates, flatten
from telemetra.schemas import FlattenOptions

from conftest import rows

FX1 = {"name": "cpu.usage_percent", "timestamp": 1700000000, "value": 45.5,
       "tags": {"host": "server01", "cpu": "cpu0", "region": "eu-west-1"}}
FX2 = {"name": "mem", "timestamp": 1700000000,
       "fields": {"used_percent": 67.8, "total": 16777216000, "used": 11379851264, "free": 5397364736},
       "tags": {"host": "server01", "region": "eu-west-1"}}
FX6 = {"name": "application",
       "fields": {"requests_per_second": 120.5, "response_time_ms": 35.2, "error_rate": 0.01, "active_connections": 42},
       "tags": {"app": "web", "version": "1.2.3", "environment": "prod"}}
FX8 = [
    {"name": "cpu", "tags": {"host": "server1"}, "fields": {"usage": 45.5}},
    {"name": "memory", "tags": {"host": "server1"}, "fields": {"used": 4096, "total": 8192}},
    {"name": "disk", "tags": {"host": "server1", "device": "/dev/sda1"}, "fields": {"usage": 78.2}},
]
FX9 = {"name": "test_metric", "tags": {"host": "test-host"}, "fields": {"value": 42.5}}


def env(*metrics):
    return json.dumps({"metrics": list(metrics)})


def points(df):
    return rows(
        df.select(F.unix_seconds("timestamp").alias("ts"), "metric_name", "value", "host", "tags_json"),
        "ts", "metric_name", "value", "host", "tags_json",
    )


def test_value_and_fields_metrics(payloads):
    got = points(flatten.flatten(payloads(env(FX1, FX2))))
    mem_tags = '{"host":"server01","region":"eu-west-1"}'
    assert got == sorted([
        (1700000000, "cpu.usage_percent", 45.5, "server01", '{"cpu":"cpu0","host":"server01","region":"eu-west-1"}'),
        (1700000000, "mem.free", 5397364736.0, "server01", mem_tags),
        (1700000000, "mem.total", 16777216000.0, "server01", mem_tags),
        (1700000000, "mem.used", 11379851264.0, "server01", mem_tags),
        (1700000000, "mem.used_percent", 67.8, "server01", mem_tags),
    ])


def test_missing_timestamp_and_host(payloads):
    got = points(flatten.flatten(payloads(env(FX6))))
    assert len(got) == 4
    assert {g[0] for g in got} == {0}
    assert {g[3] for g in got} == {"unknown"}
    assert {g[1] for g in got} == {
        "application.requests_per_second", "application.response_time_ms",
        "application.error_rate", "application.active_connections",
    }


def test_bare_payloads_strict_and_accepted(payloads):
    df = payloads(json.dumps(FX8), json.dumps(FX9))
    assert flatten.flatten(df).count() == 0
    got = points(flatten.flatten(df, FlattenOptions(accept_bare=True)))
    assert [g[1] for g in got] == sorted(["cpu.usage", "memory.used", "memory.total", "disk.usage", "test_metric.value"])
    reasons = rows(flatten.rejected(df), "seq", "reason")
    assert reasons == [(0, "no_envelope"), (1, "no_envelope")]


def test_statistics_over_three_values(payloads):
    fx10 = [{"name": "test_metric", "fields": {"value": v}} for v in (10.0, 20.0, 30.0)]
    pts = flatten.flatten(payloads(env(*fx10)))
    (st,) = aggregates.field_stats(pts, name="test_metric", field="value").collect()
    assert (st["metric_name"], st["count"], st["min"], st["max"], st["mean"], st["stddev"]) == (
        "test_metric.value", 3, 10.0, 30.0, 20.0, 10.0,
    )


def test_value_wins_over_fields_and_non_numbers_are_dropped(payloads):
    m = {"name": "x", "timestamp": 5, "value": 1, "fields": {"a": 2}}
    n = {"name": "y", "timestamp": 5, "fields": {"b": True, "s": "7", "z": None, "arr": [1], "o": {"q": 1}, "ok": 3}}
    got = points(flatten.flatten(payloads(env(m, n))))
    assert [(g[1], g[2]) for g in got] == [("x", 1.0), ("y.ok", 3.0)]


def test_fields_not_an_object_give_nothing(payloads):
    m = {"name": "x", "fields": [1, 2]}
    assert flatten.flatten(payloads(env(m))).count() == 0
    assert flatten.rejected(payloads(env(m))).count() == 0


def test_tag_values_that_are_not_strings_become_json_text(payloads):
    m = {"name": "t", "value": 1, "tags": {"z": 3, "b": True, "host": "h", "n": None, "o": {"k": [1, "a"]}}}
    (p,) = flatten.flatten(payloads(env(m))).collect()
    assert p["tags_json"] == '{"b":"true","host":"h","n":"null","o":"{\\"k\\":[1,\\"a\\"]}","z":"3"}'
    assert p["tags"]["z"] == "3" and p["host"] == "h"


def test_no_tags_and_tags_not_object(payloads):
    df = payloads(env({"name": "a", "value": 1}, {"name": "b", "value": 2, "tags": [1]}))
    got = points(flatten.flatten(df))
    assert [(g[3], g[4]) for g in got] == [("unknown", "{}"), ("unknown", "{}")]


def test_wrong_types_reject_the_payload(payloads):
    bad = [
        {"name": 7, "value": 1},
        {"name": None, "value": 1},
        {"name": "a", "timestamp": "12", "value": 1},
        {"name": "a", "value": "1.5"},
        {"name": "a", "value": True},
        {"name": "a", "value": None},
        {"name": "a", "value": 1, "tags": {"host": 5}},
        42,
    ]
    raws = [env({"name": "ok", "value": 1}, b) for b in bad]
    df = payloads(*raws)
    assert flatten.flatten(df).count() == 0
    assert rows(flatten.rejected(df), "reason") == [("bad_type",)] * len(bad)
    # metric scope keeps the good neighbour and sets aside the bad metric only
    metric = FlattenOptions(scope="metric")
    assert flatten.flatten(df, metric).count() == len(bad)
    assert rows(flatten.rejected(df, metric), "pos", "reason") == [(1, "bad_type")] * len(bad)


def test_malformed_and_no_envelope(payloads):
    df = payloads("not json", '{"metrics": 5}', '{"other": []}', "")
    assert rows(flatten.rejected(df), "seq", "reason") == [
        (0, "malformed"), (1, "no_envelope"), (2, "no_envelope"), (3, "malformed"),
    ]


def test_timestamp_forms(payloads):
    ms = [{"name": "a", "timestamp": 12.7, "value": 1}, {"name": "b", "timestamp": True, "value": 1}]
    got = points(flatten.flatten(payloads(env(*ms))))
    assert [(g[0], g[1]) for g in got] == [(1, "b"), (12, "a")]
    milli = flatten.flatten(payloads(env({"name": "c", "timestamp": 1700000000123, "value": 1})), FlattenOptions(ts_unit="ms"))
    (p,) = milli.select(F.unix_millis("timestamp").alias("t")).collect()
    assert p["t"] == 1700000000123


def test_duplicate_keys_keep_the_last(payloads):
    got = points(flatten.flatten(payloads('{"metrics":[{"name":"a","value":1,"value":2}]}')))
    assert [(g[1], g[2]) for g in got] == [("a", 2.0)]


def test_ingest_counters(payloads):
    df = payloads(env(FX1, FX2), "broken", json.dumps(FX8), env({"name": 1}))
    (c,) = flatten.ingest_counters(df).collect()
    assert (c["total_requests"], c["total_metrics"]) == (4, 3)


def test_wide_rows(payloads):
    (w,) = flatten.wide_metrics(payloads(env(FX2))).collect()
    assert w["name"] == "mem" and w["fields"]["used_percent"] == 67.8 and len(w["fields"]) == 4
    (v,) = flatten.wide_metrics(payloads(env(FX1))).collect()
    assert dict(v["fields"]) == {"value": 45.5}


def test_metric_prefilter_with_dotted_names(payloads):
    df = payloads(env(
        {"name": "a.b", "fields": {"c": 1, "d": 2}},
        {"name": "a.b.c", "value": 3},
        {"name": "a", "fields": {"b.c": 4, "x": 5}},
        {"name": "z", "fields": {"c": 6}},
    ))
    got = points(flatten.flatten(df, metrics=["a.b.c"]))
    assert sorted(g[2] for g in got) == [1.0, 3.0, 4.0]
    assert points(flatten.flatten(df, metrics=["a.b.c"])) == points(flatten.flatten(df).where("metric_name = 'a.b.c'"))


def test_fixture_shapes_ms_wide_and_bulk(payloads):
    fx5 = {"name": "system", "timestamp": 1700000000123,
           "fields": {"cpu_usage": 12.5, "memory_used": 8.0, "memory_total": 16.0, "disk_usage": 40.0,
                      "load_1m": 0.5, "load_5m": 0.4, "load_15m": 0.3},
           "tags": {"host": "server-01", "region": "eu", "datacenter": "dc1"}}
    ms = flatten.flatten(payloads(env(fx5)), FlattenOptions(ts_unit="ms"))
    assert ms.count() == 7
    assert {r["t"] for r in ms.select(F.unix_millis("timestamp").alias("t")).collect()} == {1700000000123}
    fx13 = [{"name": "batch_metric", "timestamp": 1700000000 + i,
             "fields": {f"value{j}": float(i * j) for j in range(1, 6)},
             "tags": {"host": f"host-{i % 10}", "datacenter": f"dc{i % 3}", "environment": "test"}} for i in range(100)]
    assert flatten.flatten(payloads(env(*fx13))).count() == 500
    fx15 = [{"name": "perf.test.metric", "timestamp": 1700000000 + i, "value": float(i),
             "tags": {"host": f"perf-host-{i % 10}", "datacenter": f"dc{i % 3}"}} for i in range(1000)]
    bulk = payloads(env(*fx15), env(*fx15[:999], {"name": "perf.test.metric", "value": "bad"}))
    got = flatten.flatten(bulk)
    assert got.count() == 1000 and got.where("seq = 1").count() == 0
    assert flatten.flatten(bulk, FlattenOptions(scope="metric")).count() == 1999
    (st,) = aggregates.field_stats(got).collect()
    assert (st["count"], st["min"], st["max"], st["mean"]) == (1000, 0.0, 999.0, 499.5)


def test_timestamps_out_of_range_are_rejected_with_a_reason(payloads):
    from telemetra.operators.flatten import flatten as flat, rejected as rej
    bad = ["1700000000000000", "1700000000000000000", "1e30", "-99999999999999"]
    pays = payloads(*[f'{{"metrics":[{{"name":"m","timestamp":{t},"value":1}}]}}' for t in ["1700000000", *bad]])
    assert flat(pays).count() == 1
    assert sorted((r["seq"], r["reason"]) for r in rej(pays).collect()) == [(i, "bad_time") for i in range(1, 5)]
    metric = FlattenOptions(scope="metric")
    assert flat(pays, metric).count() == 1 and rej(pays, metric).count() == 4
    assert flat(payloads('{"metrics":[{"name":"m","timestamp":1700000000123,"value":1}]}'), FlattenOptions(ts_unit="ms")).count() == 1


def test_prefix_scope_keeps_what_stands_before_the_first_bad_metric(payloads):
    good, bad, late = '{"name":"g","value":1}', '{"name":"b","value":"x"}', '{"name":"t","timestamp":1e30,"value":1}'
    raws = [[], [good], [bad], [good, bad, good], [bad, good], [good, good, late, bad], [5, good], [good, "null"]]
    pays = payloads(*['{"metrics":[' + ",".join(map(str, r)) + "]}" for r in raws], "broken")
    options = FlattenOptions(scope="prefix")
    kept = sorted((r["seq"], r["pos"]) for r in flatten.flatten(pays, options).collect())
    assert kept == [(1, 0), (3, 0), (5, 0), (5, 1), (7, 0)]
    out = sorted((r["seq"], -1 if r["pos"] is None else r["pos"], r["reason"]) for r in flatten.rejected(pays, options).collect())
    assert out == [(2, 0, "bad_type"), (3, 1, "bad_type"), (3, 2, "after_bad"), (4, 0, "bad_type"), (4, 1, "after_bad"),
                   (5, 2, "bad_time"), (5, 3, "after_bad"), (6, 0, "bad_type"), (6, 1, "after_bad"), (7, 1, "bad_type"), (8, -1, "malformed")]


def test_numbers_in_tags_are_written_as_the_collector_does(payloads):
    numbers = {"1.0": "1.0", "1": "1", "0.10": "0.1", "1e20": "1e+20", "100000000000000000000": "1e+20", "18446744073709551615": "18446744073709551615",
               "1e2": "100.0", "-1.5": "-1.5", "123456789012345678.5": "1.2345678901234568e+17", "1e14": "100000000000000.0", "1e15": "1e+15",
               "0.00001": "1e-05", "0.0001": "0.0001", "0.00012": "0.00012", "12345678.25": "12345678.25", "-2.5e-9": "-2.5e-09", "1e300": "1e+300",
               "-9223372036854775808": "-9223372036854775808", "0.0": "0.0", "true": "true", '"1.0"': "1.0", "[1,2]": "[1,2]"}
    tags = ",".join(f'"t{i}":{n}' for i, n in enumerate(numbers))
    (row,) = flatten.flatten(payloads('{"metrics":[{"value":1,"tags":{' + tags + "}}]}")).collect()
    assert [row["tags"][f"t{i}"] for i in range(len(numbers))] == list(numbers.values())
