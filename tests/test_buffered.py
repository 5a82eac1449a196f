"""Batches that close by size, by age or on demand; nothing lost or doubled by a restart."""

import time

import pytest
from pyspark.errors import StreamingQueryException

from telemetra.session import scratch_path
from telemetra.sinks import manifest
from telemetra.sources import points as points_src
from telemetra.streaming import buffered, live


def land(spark, src, *values, bad=0):
    """One text file per value."""
    for v in values:
        lines = [(f'{{"metrics":[{{"name":"m","timestamp":{v},"fields":{{"v":{v}}}}}]}}',)] + [("nonsense",)] * bad
        spark.createDataFrame(lines, "raw string").coalesce(1).write.mode("append").text(src)
        time.sleep(0.01)  # file times are the arrival order


def run(query):
    query.awaitTermination()


def stored(spark, sink):
    return sorted(r["value"] for r in points_src.read_parquet_points(spark, sink).collect())


def batches(spark, sink):
    """Values per published batch, in order."""
    rows = points_src.read_parquet_points(spark, sink).select("value", "_metadata.file_path").collect()
    found = {}
    for r in rows:
        found.setdefault(int(r["file_path"].split("batch=")[1].split("-")[0]), []).append(r["value"])
    return [sorted(found[k]) for k in sorted(found)]


@pytest.fixture
def place(spark):
    paths = {n: scratch_path(spark, f"buf-{n}") for n in ("src", "sink", "cp", "asked", "aside")}
    return paths


def start(spark, p, files=1, trigger=live.FLUSH, **how):
    return buffered.ingest(live.payload_stream(spark, p["src"], "text", files), p["sink"], p["cp"], trigger=trigger, quarantine=p["aside"], **how)


def test_size_closes_a_batch_and_the_rest_waits(spark, place):
    land(spark, place["src"], 1, 2, 3, 4, 5)
    size = len('{"metrics":[{"name":"m","timestamp":1,"fields":{"v":1}}]}')
    run(start(spark, place, max_bytes=size + 1))
    assert batches(spark, place["sink"]) == [[1, 2], [3, 4]]
    assert buffered.publish_pending(spark, place["sink"], place["cp"], quarantine=place["aside"])
    assert not buffered.publish_pending(spark, place["sink"], place["cp"], quarantine=place["aside"])
    assert batches(spark, place["sink"]) == [[1, 2], [3, 4], [5]]
    land(spark, place["src"], 6, 7)  # the query goes on behind what was published without it
    run(start(spark, place, max_bytes=size + 1))
    assert batches(spark, place["sink"]) == [[1, 2], [3, 4], [5], [6, 7]]


def test_source_takes_at_most_so_many_bytes(spark, place):
    land(spark, place["src"], 1, 2, 3)
    stream = live.payload_stream(spark, place["src"], "text", max_bytes_per_trigger=60)
    run(buffered.ingest(stream, place["sink"], place["cp"], trigger=live.FLUSH, max_bytes=1))
    assert batches(spark, place["sink"]) == [[1], [2], [3]]


def test_demand_closes_what_has_arrived(spark, place):
    how = {"requests": place["asked"]}
    land(spark, place["src"], 1, 2, bad=1)
    run(start(spark, place, **how))
    assert stored(spark, place["sink"]) == []
    buffered.request_flush(spark, place["asked"])
    run(start(spark, place, **how))
    assert batches(spark, place["sink"]) == [[1, 2]]
    land(spark, place["src"], 3)  # an old request does not close a later batch
    run(start(spark, place, **how))
    assert stored(spark, place["sink"]) == [1, 2]
    buffered.request_flush(spark, place["asked"])
    land(spark, place["src"], 4)
    run(start(spark, place, **how))
    assert batches(spark, place["sink"]) == [[1, 2], [3, 4]]
    assert live.read_log(spark, place["aside"]).count() == 2


def test_a_request_with_nothing_pending_changes_nothing(spark, place):
    land(spark, place["src"], 1)
    buffered.request_flush(spark, place["asked"])
    run(start(spark, place, requests=place["asked"]))
    version = manifest.current(spark, place["sink"]).number
    buffered.request_flush(spark, place["asked"])
    run(start(spark, place, requests=place["asked"]))
    assert manifest.current(spark, place["sink"]).number == version and stored(spark, place["sink"]) == [1]
    land(spark, place["src"], 2)
    run(start(spark, place, requests=place["asked"]))
    assert stored(spark, place["sink"]) == [1]


def test_age_closes_a_batch_though_nothing_more_arrives(spark, place):
    land(spark, place["src"], 1)
    query = start(spark, place, trigger=live.Trigger(every="300 milliseconds"), max_age=2.0, max_bytes=1 << 30)
    try:
        deadline, seen_empty = time.time() + 60, False
        while time.time() < deadline and query.isActive and stored(spark, place["sink"]) != [1]:
            seen_empty = True
            time.sleep(0.2)
        assert query.exception() is None and seen_empty
    finally:
        query.stop()
    assert stored(spark, place["sink"]) == [1]


@pytest.mark.parametrize("step", ["write_points", "_swap", "after"])
def test_a_kill_while_publishing(spark, place, monkeypatch, step):
    """Died before the data, before the swap or after it: once restarted, every payload is in
    the store once, and every reject is reported once."""
    from telemetra.sinks import writers

    land(spark, place["src"], 1, 2, 3, bad=1)
    run(start(spark, place))  # nothing closes: all pending
    target = {"write_points": writers, "_swap": manifest, "after": manifest}[step]
    name = "write_batch" if step == "after" else step
    real = getattr(target, name)

    def die(*args, **kwargs):
        if step == "after":
            real(*args, **kwargs)
        raise RuntimeError("killed")

    land(spark, place["src"], 4)
    with monkeypatch.context() as m:
        m.setattr(target, name, die)
        with pytest.raises(StreamingQueryException):
            run(start(spark, place, max_bytes=1))
    assert stored(spark, place["sink"]) == ([1, 2, 3, 4] if step == "after" else [])
    run(start(spark, place, max_bytes=1))
    assert batches(spark, place["sink"]) == [[1, 2, 3, 4]]
    assert live.read_log(spark, place["aside"]).count() == 3
    assert not buffered.publish_pending(spark, place["sink"], place["cp"])
