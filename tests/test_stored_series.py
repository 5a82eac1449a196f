"""A7 and R2 on a stored table, K6 by size and age, T3 with a reset: against the batch forms."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from telemetra.constants import DUPLICATE_POLICIES
from telemetra.operators import series, store
from telemetra.session import scratch_path
from telemetra.sinks import manifest, values, writers
from telemetra.sources import points as points_src
from telemetra.streaming import live, seen

from conftest import rows

LABELLED = "seq bigint, pos int, timestamp bigint, metric string, value double, labels map<string,string>"


def labelled(spark, items):
    return spark.createDataFrame([(seq, 0, ts, metric, float(v), {"h": "a"}) for seq, ts, metric, v in items], LABELLED)


def sample(n=120, seed=1):
    rng = random.Random(seed)
    return [(i, rng.randrange(0, 400), rng.choice(["hot", "hot", "b", "c"]), rng.randrange(100)) for i in range(n)]


@pytest.mark.parametrize("policy", DUPLICATE_POLICIES)
def test_policies_hold_over_any_cut_into_batches(spark, policy):
    items = sample(60)
    order = items[::-1] if policy in ("FIRST", "LAST") else items  # arrival decides, not the batch
    base = scratch_path(spark, "values")
    for i, at in enumerate((0, 1, 25)):
        cut = order[at : (1, 25, None)[i]]
        for _ in range(2):  # each batch is replayed
            values.upsert(labelled(spark, cut), base, policy, writer="w", batch_id=i, buckets=2, slice_seconds=100)
    got = rows(values.read_values(spark, base), "series_key", "timestamp", "value", "duplicates")
    assert got == rows(series.deduplicate(labelled(spark, items), policy), "series_key", "timestamp", "value", "duplicates")


def test_a_batch_rewrites_only_what_it_touches(spark):
    base = scratch_path(spark, "values-touch")
    values.upsert(labelled(spark, sample()), base, buckets=2, slice_seconds=100)
    before = set(manifest.current(spark, base).segments)
    values.upsert(labelled(spark, [(999, 50, "hot", 1.0)]), base, buckets=2, slice_seconds=100)
    after = set(manifest.current(spark, base).segments)
    assert len(before - after) == 1 and len(after - before) == 1
    assert {x.split("/", 1)[1] for x in before - after} == {x.split("/", 1)[1] for x in after - before}
    assert values.vacuum(spark, base) == []  # the first directory still holds live parts
    with pytest.raises(ValueError, match="unknown duplicate policy"):
        values.upsert(labelled(spark, sample()), base, "AVG")


def test_a_failed_upsert_leaves_the_old_rows(spark, monkeypatch):
    base = scratch_path(spark, "values-kill")
    values.upsert(labelled(spark, [(0, 1, "m", 1)]), base, "SUM", writer="w", batch_id=0)

    def dead(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as patch:
        patch.setattr(manifest, "_swap", dead)
        with pytest.raises(RuntimeError, match="killed"):
            values.upsert(labelled(spark, [(1, 1, "m", 2)]), base, "SUM", writer="w", batch_id=1)
    assert rows(values.read_values(spark, base), "value") == [(1.0,)]
    values.upsert(labelled(spark, [(1, 1, "m", 2)]), base, "SUM", writer="w", batch_id=1)
    assert rows(values.read_values(spark, base), "value") == [(3.0,)]
    assert len(values.vacuum(spark, base)) == 2 and rows(values.read_values(spark, base), "value") == [(3.0,)]


@pytest.mark.parametrize("seed", [1, 2])
def test_retention_of_stored_rows_equals_the_batch_form(spark, seed):
    """Late batches, series that stand still, and slices that expire whole or in part."""
    items = sample(80, seed) + [(500, 5, "idle", 1), (501, 900, "hot", 2), (502, 10, "hot", 3)]
    random.Random(seed).shuffle(items)
    base = scratch_path(spark, "values-keep")
    for i, at in enumerate(range(0, len(items), 30)):
        values.upsert(labelled(spark, items[at : at + 30]), base, "MAX", writer="w", batch_id=i, retention=150, buckets=2, slice_seconds=100)
    one = series.deduplicate(labelled(spark, items), "MAX")
    newest = one.groupBy("series_key").agg(F.max("timestamp").alias("newest"))
    want = one.join(newest, "series_key").where("timestamp >= newest - 150")
    assert rows(values.read_values(spark, base), "series_key", "timestamp", "value") == rows(want, "series_key", "timestamp", "value")


# ---------------------------------------------------------------- K6

def rotated(spark, n, fmt, limit, window=None, wide=0):
    pts = spark.range(n).repartition(3).select(
        F.timestamp_seconds(F.col("id") % 2 * 86400).alias("timestamp"),
        F.concat(F.lit("m,\"é"), F.when(F.col("id") < wide, F.lit("x" * 500)).otherwise(F.col("id").cast("string"))).alias("metric_name"),
        F.col("id").cast("double").alias("value"), F.lit("h").alias("host"), F.lit('{"a":"b"}').alias("tags_json"),
        F.when(F.col("id") % 5 > 0, F.timestamp_seconds(F.col("id"))).alias("received_at"))
    path = scratch_path(spark, f"rotated-{fmt}")
    writers.write_rotated(pts, path, fmt, max_bytes=limit, window_minutes=window)
    return pts, path


@pytest.mark.parametrize("fmt", ["csv", "csv_tags", "jsonl"])
def test_no_file_is_over_the_limit_and_every_row_is_there(spark, fmt):
    pts, path = rotated(spark, 400, fmt, 2000)
    files = store.list_files(spark, path, fmt).collect()
    assert max(f["length"] for f in files) <= 2000
    total = {d: sum(f["length"] for f in files if f["date"] == d) for d in {f["date"] for f in files}}
    assert all(sum(f["date"] == d for f in files) <= 1.3 * t / 2000 + 1 for d, t in total.items())
    back = points_src.read_store(spark, path, fmt)
    assert rows(back, "metric_name", "value") == rows(pts, "metric_name", "value")


def test_files_of_one_window_of_arrivals(spark):
    pts, path = rotated(spark, 300, "csv", 10_000, window=1)
    files = {tuple(f["file"].split("-")[:1]) for f in store.list_files(spark, path, "csv").collect()}
    assert len(files) == 6 and points_src.read_csv_points(spark, path).count() == 300  # five minutes, and rows without a time


def test_a_line_over_the_limit_has_its_own_file(spark):
    pts, path = rotated(spark, 20, "csv", 300, wide=2)
    assert points_src.read_csv_points(spark, path).count() == 20
    assert sum(f["length"] > 300 for f in store.list_files(spark, path, "csv").collect()) == 2
    none = writers.write_rotated(pts.limit(0), scratch_path(spark, "rotated-none"), "csv", max_bytes=100)
    assert none is None
    with pytest.raises(ValueError, match="Parquet"):
        writers.write_rotated(pts, path, "parquet", max_bytes=100)


# ---------------------------------------------------------------- T3

def land(spark, path, *names, ts=5):
    lines = [(i, json.dumps({"metric": n, "timestamp": ts, "value": 1})) for i, n in enumerate(names)]
    spark.createDataFrame(lines, "seq bigint, raw string").coalesce(1).write.mode("append").parquet(path)


def reports(spark, sink):
    return sorted((r["batch"] if "batch" in r else 0, r["series_key"]) for r in seen.read_reports(spark, sink).collect())


def test_a_reset_in_a_running_query_reports_all_series_again(spark):
    src, control, sink = (scratch_path(spark, n) for n in ("seen-src", "seen-reset", "seen-sink"))
    land(spark, src, "a", "b", "a")
    spark.range(0).write.parquet(control)
    resets = spark.readStream.schema("id bigint").parquet(control)
    query = seen.first_seen(live.line_stream(spark, src), sink, scratch_path(spark, "cp"), resets, shards=2, trigger=live.Trigger(every="1 second"))
    try:
        def after(expected):
            end = time.time() + 90
            while time.time() < end:
                assert query.exception() is None
                try:
                    told = [r["series_key"] for r in seen.read_reports(spark, sink).collect()]
                except Exception:  # noqa: BLE001 - nothing is reported yet
                    told = []
                if len(told) >= len(expected):
                    assert sorted(told) == sorted(expected)
                    return
                time.sleep(0.5)
            raise AssertionError(f"no report of {expected}")

        after(["a", "b"])
        land(spark, src, "b", "c")
        after(["a", "b", "c"])
        spark.range(1).coalesce(1).write.mode("append").parquet(control)
        time.sleep(4)
        land(spark, src, "a", "b", "c")
        after(["a", "b", "c"] * 2)
    finally:
        query.stop()


def test_state_holds_the_series_of_two_periods(spark, monkeypatch):
    """Each run has other series; a series that comes back late is told again, and a poisonous
    timestamp harms nothing."""
    src, sink, checkpoint = scratch_path(spark, "seen-src"), scratch_path(spark, "seen-sink"), scratch_path(spark, "cp")
    sizes = []
    for i in range(4):
        land(spark, src, *[f"s{i}-{k}" for k in range(20)], "always", *(["s0-1"] if i == 3 else []))
        land(spark, src, "bad", ts=1700000000000000000)
        query = seen.first_seen(live.line_stream(spark, src), sink, checkpoint, shards=2, remember_seconds=3)
        query.awaitTermination(100)
        assert query.exception() is None
        sizes.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
        time.sleep(4)
    told = [r["series_key"] for r in seen.read_reports(spark, sink).collect()]
    assert told.count("s0-1") == 2 and told.count("s1-1") == 1 and "bad" not in told
    assert max(sizes) <= 2 * 24 + 2 * 2 and len(set(told)) == 81


def test_a_nanosecond_timestamp_does_not_end_the_bounded_query(spark):
    src, sink = scratch_path(spark, "fsb-src"), scratch_path(spark, "fsb")
    land(spark, src, "a", ts=1700000000)
    land(spark, src, "b", ts=1700000000000000000)
    query = live.first_seen_bounded(live.line_stream(spark, src), sink, scratch_path(spark, "cp"), "1 hour")
    query.awaitTermination(60)
    assert query.exception() is None and rows(spark.read.parquet(sink), "series_key") == [("a",)]
