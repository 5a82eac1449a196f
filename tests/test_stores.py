"""Store round trips (K1–K7, S3–S5, U1), per-file counts, listing, statistics, clean-up."""

import datetime as dt
import json
import os

from pyspark.sql import functions as F

from telemetra.operators import flatten, store
from telemetra.session import scratch_path
from telemetra.sinks import writers
from telemetra.sources import payloads as payload_src
from telemetra.sources import points as points_src

from conftest import rows


def sample(payloads):
    metrics = [
        {"name": "cpu", "timestamp": 1700000000 + 86400 * d, "fields": {"usage": 1.5 + d, "idle": 90}, "tags": {"host": f"h{d % 2}", "n": d}}
        for d in range(4)
    ]
    return flatten.flatten(payloads(json.dumps({"metrics": metrics})))


def canon(df):
    return rows(df.select(F.unix_seconds("timestamp").alias("t"), "metric_name", "value", "host", "tags_json"),
                "t", "metric_name", "value", "host", "tags_json")


def test_round_trips(spark, payloads):
    pts = sample(payloads)
    expect = canon(pts)
    for fmt, opts in [("parquet", {}), ("csv_tags", {}), ("jsonl", {"compression": "gzip"}),
                      ("parquet", {"partition_by": ("date", "metric_name", "host"), "layout": "rebalance"})]:
        path = scratch_path(spark, "rt")
        writers.write_points(pts, path, fmt, **opts)
        back = points_src.read_store(spark, path, fmt, tuple(opts.get("partition_by", ("date",))))
        assert canon(back) == expect, fmt
    path = scratch_path(spark, "rt-csv")
    writers.write_points(pts, path, "csv")
    plain = points_src.read_store(spark, path, "csv")
    assert [r[:4] for r in canon(plain)] == [r[:4] for r in expect]


def test_jsonl_keeps_tag_types(spark, payloads):
    path = scratch_path(spark, "jsonl")
    writers.write_points(sample(payloads), path, "jsonl", partition_by=())
    line = json.loads(spark.read.text(path).first()["value"])
    assert isinstance(line["tags"]["n"], int) and isinstance(line["timestamp"], int)


def test_parquet_options_and_csv_rotation(spark, payloads):
    path = scratch_path(spark, "csvrot")
    writers.write_points(sample(payloads).coalesce(1), path, "csv", max_records_per_file=3, partition_by=())
    per_file = store.rows_per_file(spark, path, "csv")
    assert sorted(r["rows"] for r in per_file.collect()) == [2, 3, 3]


def test_fan_out_and_union(spark, payloads):
    root = scratch_path(spark, "fan")
    stores = [(f"{root}/p", "parquet"), (f"{root}/j", "jsonl")]
    writers.fan_out(sample(payloads), stores)
    both = points_src.union_stores(spark, stores)
    assert rows(both.groupBy("store").count(), "store", "count") == [("jsonl", 8), ("parquet", 8)]


def test_rows_per_file_with_an_empty_file_and_listing(spark, payloads):
    path = scratch_path(spark, "files")
    writers.write_points(sample(payloads), path, "parquet", layout="rebalance")
    empty_dir = f"{path}/date=2023-11-01"
    spark.createDataFrame([], "timestamp timestamp, metric_name string, value double, host string, tags_json string") \
        .coalesce(1).write.parquet(empty_dir + "/x")
    local = empty_dir.replace("file:", "")
    for f in os.listdir(local + "/x"):
        if f.endswith(".parquet"):
            os.link(f"{local}/x/{f}", f"{local}/empty.parquet")
    per_date = rows(store.rows_per_file(spark, path).groupBy("date").agg(F.sum("rows").alias("r")), "date", "r")
    assert per_date[0] == (dt.date(2023, 11, 1), 0)
    assert [r[1] for r in per_date[1:]] == [2, 2, 2, 2]
    in_range = store.files_in_range(spark, path, "2023-11-15", "2023-11-16")
    assert rows(in_range, "date") == [(dt.date(2023, 11, 15),), (dt.date(2023, 11, 16),)]
    (rep,) = store.store_report(spark, path).collect()
    assert rep["files"] == 6 and rep["bytes"] > 0
    (st,) = store.store_stats(spark, path).collect()
    assert st["total_records"] == 8 and st["write_errors"] == 0


def test_expired_files_and_removal(spark, payloads):
    path = scratch_path(spark, "expire")
    writers.write_points(sample(payloads), path, "parquet", layout="rebalance")
    assert store.expired_files(spark, path, days=7).count() == 0
    later = dt.datetime.now(dt.timezone.utc) + dt.timedelta(days=8)
    expired = store.expired_files(spark, path, days=7, now=later)
    assert expired.count() == 4
    assert all(not r["deleted"] for r in store.remove_files(expired).collect())
    done = store.remove_files(expired, dry_run=False).collect()
    assert len(done) == 4 and all(r["deleted"] for r in done)
    assert store.list_files(spark, path).count() == 0


def test_payload_files(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "a.txt").write_text('{"metrics":[{"name":"a","value":1}]}\n{"metrics":[{"name":"b","value":2}]}\n')
    pays = payload_src.read_payloads(spark, str(d))
    got = rows(flatten.flatten(pays, keep=["source"]), "metric_name", "value")
    assert got == [("a", 1.0), ("b", 2.0)]
    assert pays.select("seq").distinct().count() == 2


def test_reads_nanosecond_parquet(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    table = pa.table({
        "timestamp": pa.array([1700000000 * 10**9, 1700000060 * 10**9], pa.timestamp("ns")),
        "metric_name": ["cpu.usage", "mem.used"],
        "value": [1.5, 2.0],
        "host": ["a", "b"],
        "tags_json": ['{"host":"a"}', '{"host":"b"}'],
    })
    pq.write_table(table, tmp_path / "metrics_20231114_221320.parquet", use_dictionary=False, compression="snappy")
    df = points_src.read_parquet_nanos(spark, str(tmp_path))
    got = rows(df.select(F.unix_seconds("timestamp").alias("t"), "metric_name"), "t", "metric_name")
    assert got == [(1700000000, "cpu.usage"), (1700000060, "mem.used")]


def test_whole_file_payloads_and_query_summary(spark, tmp_path, payloads):
    d = tmp_path / "whole"
    d.mkdir()
    (d / "p1.json").write_text('{"metrics": [\n {"name": "a", "value": 1},\n {"name": "b", "value": 2}\n]}\n')
    (d / "p2.json").write_text('[{"name": "c", "value": 3}]')
    pays = payload_src.read_payloads(spark, str(d), whole_file=True)
    assert pays.count() == 2
    assert rows(flatten.flatten(pays), "metric_name") == [("a",), ("b",)]
    path = scratch_path(spark, "summary")
    writers.write_points(sample(payloads), path, "parquet")
    (s,) = store.files_scanned(spark, path).collect()
    assert s["rows"] == 8 and s["files_scanned"] >= 4
    per_file = store.query_files(spark, path, "cpu.usage", "2023-11-15", "2023-11-16")
    assert sum(r["rows"] for r in per_file.collect()) == 1
    pts = store.query_points(spark, path, "parquet", "cpu.idle", tags={"n": "2"})
    assert rows(pts.select(F.unix_seconds("timestamp").alias("t")), "t") == [(1700000000 + 2 * 86400,)]


def test_reads_the_collectors_own_layouts(spark, tmp_path):
    """Stores as the collector writes them: base/YYYY/MM/DD/metrics_<time>.<ext>."""
    import gzip

    import pyarrow as pa
    import pyarrow.parquet as pq

    day = tmp_path / "jsonl" / "2023" / "11" / "14"
    day.mkdir(parents=True)
    lines = [
        {"timestamp": 1700000000, "metric": "cpu.usage", "value": 45.5, "host": "server01", "tags": {"host": "server01", "cpu": 0}},
        {"timestamp": 1700000060, "metric": "mem.used", "value": 11379851264.0, "host": "server01", "tags": {}},
    ]
    (day / "metrics_20231114_221320.jsonl").write_text("\n".join(json.dumps(x) for x in lines) + "\nnot json\n")
    with gzip.open(day / "metrics_20231114_221400.jsonl.gz.gz", "wt") as f:
        f.write(json.dumps({"timestamp": 1700000120, "metric": "disk.usage", "value": 78.2, "host": "h2", "tags": {"host": "h2"}}) + "\n")
    got = points_src.read_jsonl_points(spark, str(tmp_path / "jsonl"), recursive=True, pattern="*.jsonl*")
    assert rows(got, "metric_name", "value", "host", "tags_json") == [
        ("cpu.usage", 45.5, "server01", '{"cpu":"0","host":"server01"}'),
        ("disk.usage", 78.2, "h2", '{"host":"h2"}'),
        ("mem.used", 11379851264.0, "server01", "{}"),
    ]

    cday = tmp_path / "csv" / "2023" / "11" / "14"
    cday.mkdir(parents=True)
    (cday / "metrics_20231114_221320.csv").write_text("timestamp,metric,value,host\n1700000000,cpu.usage_idle,97.3,server01\n1700000000,mem.free,5.39736e+09,server01\n")
    csv = points_src.read_csv_points(spark, str(tmp_path / "csv"), recursive=True, pattern="*.csv")
    assert rows(csv, "metric_name", "value") == [("cpu.usage_idle", 97.3), ("mem.free", 5.39736e9)]

    pday = tmp_path / "parquet" / "2023" / "11" / "14"
    pday.mkdir(parents=True)
    pq.write_table(pa.table({
        "timestamp": pa.array([1700000000 * 10**9], pa.timestamp("ns")),
        "metric_name": ["cpu.usage_percent"], "value": [45.5], "host": ["server01"],
        "tags_json": ['{"cpu":"cpu0","host":"server01","region":"eu-west-1"}'],
    }), pday / "metrics_20231114_221320_123.parquet", use_dictionary=False)
    pts = points_src.read_parquet_nanos(spark, str(tmp_path / "parquet"))
    (p,) = pts.select(F.unix_seconds("timestamp").alias("t"), "metric_name").collect()
    assert (p["t"], p["metric_name"]) == (1700000000, "cpu.usage_percent")


def test_fan_out_to_three_stores(spark, payloads):
    root = scratch_path(spark, "fan-store")
    stores = [(f"{root}/p", "parquet"), (f"{root}/c", "csv_tags"), (f"{root}/j", "jsonl")]
    pts = sample(payloads)
    writers.fan_out(pts, stores)
    both = points_src.union_stores(spark, stores)
    expect = canon(pts)
    for fmt in ("parquet", "csv_tags", "jsonl"):
        assert canon(both.where(F.col("store") == fmt)) == expect, fmt


def test_partitioned_csv_and_jsonl_read_back(spark, payloads):
    pts = sample(payloads)
    expect = canon(pts)
    for fmt in ("csv_tags", "jsonl", "parquet"):
        for parts in (("date", "metric_name"), ("date", "host"), ("host",)):
            path = scratch_path(spark, "k2")
            writers.write_points(pts, path, fmt, partition_by=parts)
            assert canon(points_src.read_store(spark, path, fmt, parts)) == expect, (fmt, parts)


def test_rows_per_file_with_escaped_directories(spark):
    path = scratch_path(spark, "escaped")
    point = spark.sql("select timestamp'2024-01-05 00:00:00' timestamp, 'cpu load:5%' metric_name, 1.0D value, 'h' host, '{}' tags_json")
    writers.write_points(point, path, "parquet", partition_by=("date", "metric_name"))
    assert [r["rows"] for r in store.rows_per_file(spark, path).collect()] == [1]
    done = store.remove_files(store.list_files(spark, path), dry_run=False)
    assert [r["deleted"] for r in done.collect()] == [True] and store.list_files(spark, path).count() == 0


def test_late_points_are_found_by_event_time(spark):
    path = scratch_path(spark, "late")
    pts = spark.sql("""select timestamp'2024-01-05 10:00:00' timestamp, 'm' metric_name, double(d) value, 'h' host, '{"a.b":"x","n":1}' tags_json,
                       timestamp'2024-01-05 11:00:00' + make_interval(0, 0, 0, d) received_at from values (0), (4) t(d)""")
    writers.write_points(pts, path, "parquet", date_source="received_at")
    found = store.query_points(spark, path, "parquet", "m", "2024-01-05 00:00:00", "2024-01-05 23:00:00")
    assert rows(found, "value") == [(0.0,), (4.0,)]
    assert store.query_points(spark, path, tags={"a.b": "x"}).count() == 2
    assert store.query_points(spark, path, tags={"n": "1"}).count() == 2


def test_naive_bounds_are_utc(spark):
    from telemetra.operators import filters

    pts = spark.sql("select timestamp'2024-01-05 00:00:00' timestamp")
    assert filters.in_time_range(pts, dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 5)).count() == 1

