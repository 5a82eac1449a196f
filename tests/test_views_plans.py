"""Views (W1–W3, D2) and the shape of the physical plans the operators produce."""

import json

from pyspark.sql import functions as F

from telemetra.operators import filters, flatten, views
from telemetra.sinks import writers
from telemetra.session import scratch_path
from telemetra.sources import adapters, points as points_src

from conftest import SMALL, rows


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def env(*metrics):
    return json.dumps({"metrics": list(metrics)})


def test_latest_card_uses_first_sorted_field(payloads):
    df = payloads(
        env({"name": "cpu", "timestamp": 1, "fields": {"usage": 1.234, "idle": 9.0}, "tags": {"host": "a"}}),
        env({"name": "cpu", "timestamp": 2, "fields": {"usage": 5.678, "idle": 7.126}, "tags": {"host": "a"}}),
        env({"name": "cpu", "timestamp": 2, "fields": {"usage": 0.0}, "tags": {"host": "b"}}),
    )
    got = rows(views.latest_per_series(flatten.wide_metrics(df)), "tags_json", "main_field", "value", "seq")
    assert got == [('{"host":"a"}', "idle", 7.13, 1), ('{"host":"b"}', "usage", 0.0, 2)]


def test_charts_and_recent(payloads):
    raws = [env({"name": "system", "timestamp": t, "fields": {"usage": float(t), "used": 2.0 * t}, "tags": {"host": "h"}}) for t in range(60)]
    raws.append(env({"name": "cpu", "timestamp": 5, "fields": {"usage": 1.0}}))
    wide = flatten.wide_metrics(payloads(*raws))
    cpu = views.chart(wide, "cpu")
    assert cpu.where(F.col("host") == "h").count() == 50
    assert cpu.where(F.col("host") == "unknown").count() == 1
    assert rows(cpu.where("rank = 1 and host = 'h'"), "y") == [(59.0,)]
    mem = views.chart(wide, "memory")
    assert mem.where(F.col("host") == "unknown").count() == 0
    rec = views.recent(flatten.flatten(payloads(*raws)), n=3, metric="system.usage")
    assert [r["value"] for r in rec.collect()] == [59.0, 58.0, 57.0]
    assert rows(views.distinct_hosts(flatten.flatten(payloads(*raws))), "host") == [("h",)]


def test_flatten_has_no_shuffle_and_parses_once(spark):
    pts = flatten.flatten(adapters.wide_payloads(adapters.read_table(spark, SMALL, "lineitem")))
    p = plan(pts)
    # the only exchange is the round-robin spread of the single-row-group test table
    assert "hashpartitioning" not in p and p.count("Exchange") <= 1
    assert p.count("parseJson") == 1


def test_last_n_limits_before_the_shuffle(spark):
    wide = flatten.wide_metrics(adapters.value_payloads(adapters.read_table(spark, SMALL, "events")))
    p = plan(views.last_n_per_host(wide, n=50))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_latest_aggregates_partially(spark):
    wide = flatten.wide_metrics(adapters.value_payloads(adapters.read_table(spark, SMALL, "events")))
    p = plan(views.latest_per_series(wide))
    assert "partial_max_by" in p or "partial_" in p


def test_filters_reach_the_parquet_scan(spark):
    path = scratch_path(spark, "pushdown")
    pts = flatten.flatten(adapters.fields_payloads(adapters.read_table(spark, SMALL, "events")))
    writers.write_points(pts, path, "parquet")
    stored = points_src.read_parquet_points(spark, path)
    q = filters.in_time_range(filters.by_metric(stored, "click.value"), "2024-01-05", "2024-01-20")
    q = filters.by_tag(q, "host", "user-7").where(F.col("date") >= "2024-01-06").select("value")
    p = plan(q)
    assert "PushedFilters: [IsNotNull(metric_name), IsNotNull(timestamp), IsNotNull(host), EqualTo(metric_name,click.value)" in p
    assert "PartitionFilters: [isnotnull(date" in p
    assert "ReadSchema: struct<timestamp:timestamp,metric_name:string,value:double,host:string>" in p


def test_per_file_counts_neither_join_nor_broadcast(spark):
    from telemetra.operators import store

    path = scratch_path(spark, "plan-files")
    pts = flatten.flatten(adapters.fields_payloads(adapters.read_table(spark, SMALL, "events")))
    writers.write_points(pts, path, "parquet")
    for df in (store.rows_per_file(spark, path), store.query_files(spark, path, "click.value")):
        p = plan(df)
        assert "Join" not in p and "Broadcast" not in p


def test_readers_parse_each_line_once(spark):
    from telemetra.sources.labelled import labelled_points
    from telemetra.sources.points import read_jsonl_points

    lines = adapters.labelled_lines(adapters.read_table(spark, SMALL, "events"))
    assert plan(labelled_points(lines)).count("parseJson") == 1
    path = scratch_path(spark, "jsonl-plan")
    pts = flatten.flatten(adapters.fields_payloads(adapters.read_table(spark, SMALL, "events")))
    writers.write_points(pts, path, "jsonl")
    assert plan(read_jsonl_points(spark, path)).count("parseJson") == 1


def test_hosts_by_tag_and_metrics_by_name(spark, payloads):
    pays = payloads(
        '{"metrics":[{"name":"a","timestamp":1,"value":1,"tags":{"host":"unknown"}},{"name":"a","timestamp":2,"value":1}]}',
        '{"metrics":[{"name":"sys","timestamp":3,"fields":{"x":1,"y":2},"tags":{"host":"h"}}]}')
    assert rows(views.distinct_hosts(flatten.flatten(pays)), "host") == [("h",), ("unknown",)]
    assert views.recent(flatten.wide_metrics(pays), 5, "sys").count() == 1
    assert views.recent(flatten.flatten(pays), 5, "sys").count() == 2


def test_dated_points_move_once_per_metric(spark, payloads):
    """Metrics are dealt by date below the fan-out; points and dates stay the same."""
    raws = [f'{{"metrics":[{{"name":"m","timestamp":{86400 * (i % 3)},"tags":{{"host":"h{i}"}},"fields":{{"a":{i},"b":{i},"c":"x"}}}}]}}' for i in range(30)]
    df = payloads(*raws)
    dated = flatten.flatten(df, dated=True)
    cols = ("seq", "pos", "metric_name", "value", "host", "tags_json")
    assert rows(dated, *cols) == rows(flatten.flatten(df), *cols)
    assert rows(dated.selectExpr("date = to_date(timestamp) as same").distinct(), "same") == [(True,)]
    plan = dated._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("explode(") < plan.index("RebalancePartitions")  # above it
    path = scratch_path(spark, "dated")
    writers.write_points(dated, path, "parquet", layout="as_is")
    assert spark.read.parquet(path).groupBy("date").count().count() == 3 and spark.read.parquet(path).count() == 60
