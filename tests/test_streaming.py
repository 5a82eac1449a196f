"""Streaming twins agree with their batch versions."""

from pyspark.sql import functions as F

from telemetra.operators import flatten, views
from telemetra.session import scratch_path
from telemetra.sources import adapters, points as points_src
from telemetra.streaming import live

from conftest import SMALL, rows


def land(spark, df, files=3):
    path = scratch_path(spark, "land")
    df.repartitionByRange(files, "seq").write.parquet(path)
    return path


def run(q):
    q.awaitTermination()
    assert q.exception() is None


def test_ingest_stream_equals_batch(spark):
    pays = adapters.fields_payloads(adapters.read_table(spark, SMALL, "events"))
    src, sink = land(spark, pays), scratch_path(spark, "sink")
    q = live.ingest(live.payload_stream(spark, src, "parquet", 1), sink, scratch_path(spark, "cp"))
    run(q)
    got = points_src.read_parquet_points(spark, sink).select("metric_name", "value", "host")
    want = flatten.flatten(pays).select("metric_name", "value", "host")
    assert rows(got, "metric_name", "value", "host") == rows(want, "metric_name", "value", "host")


def test_latest_and_last_n_streams_equal_batch(spark):
    pays = adapters.value_payloads(adapters.read_table(spark, SMALL, "events"))
    src = land(spark, pays)
    s1, s2 = scratch_path(spark, "lat"), scratch_path(spark, "l50")
    run(live.latest(live.payload_stream(spark, src, "parquet", 1), s1, scratch_path(spark, "cp")))
    run(live.last_n(live.payload_stream(spark, src, "parquet", 1), s2, scratch_path(spark, "cp"), n=5))
    cols = ("name", "tags_json", "value", "seq")
    assert rows(live.read_latest(spark, s1), *cols) == rows(views.latest_per_series(flatten.wide_metrics(pays)), *cols)
    want = views.last_n_per_host(flatten.wide_metrics(pays), n=5)
    assert rows(live.read_last_n(spark, s2, 5), "host", "seq", "rank") == rows(want, "host", "seq", "rank")


def test_counters_and_fan_out_stream(spark):
    pays = adapters.dirty_payloads(adapters.read_table(spark, SMALL, "events"))
    src = land(spark, pays)
    sink = scratch_path(spark, "cnt")
    run(live.counters(live.payload_stream(spark, src, "parquet", 1), sink, scratch_path(spark, "cp")))
    (c,) = live.latest_batch(spark, sink).collect()
    (b,) = flatten.ingest_counters(pays).collect()
    assert (c["total_requests"], c["total_metrics"]) == (b["total_requests"], b["total_metrics"])
    root = scratch_path(spark, "fan")
    run(live.ingest_fan_out(live.payload_stream(spark, src, "parquet", 1), {f"{root}/p": "parquet"}, f"{root}/q", scratch_path(spark, "cp")))
    assert spark.read.parquet(f"{root}/p").count() == flatten.flatten(pays).count()
    assert spark.read.parquet(f"{root}/q").count() == flatten.rejected(pays).count()


def test_first_seen_bounded_reports_every_series(spark):
    from telemetra.operators import series
    from telemetra.sources.labelled import labelled_points

    lines = adapters.labelled_lines(adapters.read_table(spark, SMALL, "events"))
    src, sink = land(spark, lines), scratch_path(spark, "fsb")
    run(live.first_seen_bounded(live.line_stream(spark, src, 1), sink, scratch_path(spark, "cp"), "1 hour"))
    seen = spark.read.parquet(sink).select("series_key").distinct()
    want = series.with_series_key(labelled_points(lines)).select("series_key").distinct()
    assert rows(seen, "series_key") == rows(want, "series_key")


def test_live_events_fixture_latest(spark, tmp_path):
    import json

    from telemetra.schemas import PAYLOAD

    fx14 = [json.dumps({"metrics": [{"name": "test_metric", "timestamp": 1700000000 + i, "value": 100 + 10 * i,
                                      "tags": {"host": "server-01", "test": "streaming"}}]}) for i in range(5)]
    src = scratch_path(spark, "fx14")
    for i, raw in enumerate(fx14):
        spark.createDataFrame([(i, raw, "fx14", None)], PAYLOAD).write.mode("append").parquet(src)
    sink = scratch_path(spark, "fx14-latest")
    run(live.latest(live.payload_stream(spark, src, "parquet", 1), sink, scratch_path(spark, "cp")))
    (card,) = live.read_latest(spark, sink).collect()
    assert (card["name"], card["main_field"], card["value"], card["seq"]) == ("test_metric", "value", 140.0, 4)
    assert card["tags_json"] == '{"host":"server-01","test":"streaming"}'


def land_in_order(spark, df, files=4):
    """Land ``seq`` ranges one file after another, so files arrive in event-time order
    (event ids of the test table increase with time) and no row is late."""
    path = scratch_path(spark, "land-ordered")
    lo, hi = df.agg(F.min("seq"), F.max("seq")).first()
    step = (hi - lo) // files + 1
    for i in range(files):
        part = df.where((F.col("seq") >= lo + i * step) & (F.col("seq") < lo + (i + 1) * step))
        part.coalesce(1).write.mode("append").parquet(path)
    return path


def test_latest_by_window_emits_closed_windows_only(spark):
    pays = adapters.value_payloads(adapters.read_table(spark, SMALL, "events"))
    src, sink = land_in_order(spark, pays), scratch_path(spark, "lbw")
    run(live.latest_by_window(live.payload_stream(spark, src, "parquet", 1), sink, scratch_path(spark, "cp"), "1 day", "1 hour"))
    got = spark.read.parquet(sink)
    wide = flatten.wide_metrics(pays).withColumn("window_start", F.window("timestamp", "1 day").start)
    want = views.latest_per_series(wide.withColumn("name", F.concat_ws("|", "name", F.col("window_start").cast("string"))))
    emitted = got.select(F.concat_ws("|", "name", F.col("window_start").cast("string")).alias("name"), "tags_json", "value", "seq")
    joined = emitted.join(want.select("name", "tags_json", F.col("value").alias("v2"), F.col("seq").alias("s2")), ["name", "tags_json"])
    assert emitted.count() > 0
    assert joined.count() == emitted.count()
    assert joined.where("value != v2 or seq != s2").count() == 0


def test_logs_hold_what_a_batch_changed_and_fold(spark, monkeypatch):
    from telemetra.streaming.live import _batch_dirs

    monkeypatch.setattr(live, "FOLD_EVERY", 3)
    pays = adapters.value_payloads(adapters.read_table(spark, SMALL, "events"))
    src, sink = land_in_order(spark, pays, files=4), scratch_path(spark, "log")
    run(live.last_n(live.payload_stream(spark, src, "parquet", 1), sink, scratch_path(spark, "cp"), n=3))
    _, found = _batch_dirs(spark, sink)
    _, folded = _batch_dirs(spark, sink, "folded")
    assert set(found) == {3} and set(folded) == {2}
    wide = flatten.wide_metrics(pays)
    hosts = {r["host"] for r in spark.read.parquet(f"{sink}/batch=3").select("host").distinct().collect()}
    assert hosts <= {r["host"] for r in wide.select("host").distinct().collect()}
    assert rows(live.read_last_n(spark, sink, 3), "host", "seq", "rank") == rows(views.last_n_per_host(wide, n=3), "host", "seq", "rank")


def test_readers_pass_over_uncommitted_batches(spark):
    sink = scratch_path(spark, "half")
    spark.range(3).write.parquet(f"{sink}/batch=0")
    spark.range(9).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{sink}/batch=1")
    assert live.latest_batch(spark, sink).count() == 3
    assert live.read_log(spark, sink).count() == 3


def test_stream_of_bare_millisecond_metrics_by_name(spark, tmp_path):
    import json

    from telemetra.schemas import FlattenOptions

    land_dir = tmp_path / "in" / "deeper"
    land_dir.mkdir(parents=True)
    lines = [{"name": "system", "timestamp": 1700000000000 + i, "fields": {"cpu": float(i), "mem": 1}, "tags": {"host": "server-01"}} for i in range(3)]
    lines.append({"name": "other", "timestamp": 1700000000000, "fields": {"cpu": 1.0}, "tags": {"host": "server-01"}})
    (land_dir / "a.txt").write_text("\n".join(map(json.dumps, lines)) + "\n")
    sink = scratch_path(spark, "t4")
    stream = live.payload_stream(spark, str(tmp_path / "in"))
    run(live.filtered(stream, sink, scratch_path(spark, "cp"), "test_metric,system", {"host": "server-01"}, FlattenOptions(accept_bare=True, ts_unit="ms")))
    out = live.read_filtered(spark, sink)
    assert sorted((r["seq"]["row"], r["name"], r["fields"]["cpu"]) for r in out.collect()) == [(0, "system", 0.0), (1, "system", 1.0), (2, "system", 2.0)]
