"""The request-level functions over a small landing folder."""

import json

from telemetra import api
from telemetra.operators import series
from telemetra.session import scratch_path
from telemetra.sources.labelled import labelled_points

from conftest import rows


def test_requests_end_to_end(spark, tmp_path):
    land = tmp_path / "landing"
    land.mkdir()
    ms = [{"name": "cpu", "timestamp": 1700000000 + i, "fields": {"usage": float(i)}, "tags": {"host": f"h{i % 2}"}} for i in range(10)]
    (land / "a.txt").write_text(json.dumps({"metrics": ms}) + "\nbroken\n" + json.dumps({"metrics": [{"name": 5}]}) + "\n")
    base, quarantine = scratch_path(spark, "api-store"), scratch_path(spark, "api-quarantine")
    (c,) = api.ingest(spark, str(land), base, quarantine=quarantine).collect()
    assert (c["total_requests"], c["total_metrics"]) == (3, 11)
    assert api.query(spark, base, "cpu.usage", 1700000002, 1700000004).count() == 3
    assert api.query(spark, base, "cpu.usage", tags={"host": "h1"}).count() == 5
    out = api.query_summary(spark, base, "cpu.usage", 1700000002, 1700000004)
    assert out["summary"].first()["rows"] == 3
    assert [r["fields"] for r in api.recent_metrics(spark, base, "cpu", 2).collect()] == [{"usage": 9.0}, {"usage": 8.0}]
    (st,) = api.metric_stats(spark, base, "cpu", "usage").collect()
    assert (st["count"], st["max"]) == (10, 9.0)
    (s,) = api.storage_stats(spark, base, quarantine=quarantine).collect()
    assert (s["total_records"], s["write_errors"]) == (10, 2)
    assert all(not r["deleted"] for r in api.cleanup(spark, base, 30).collect())


def test_series_tables(spark):
    lines = spark.createDataFrame(
        [(i, json.dumps({"timestamp": 10 + (i % 2), "metric": "m", "value": float(i), "labels": {"host": "a"}})) for i in range(4)],
        "seq bigint, raw string",
    )
    t = api.series_tables(labelled_points(lines))
    assert rows(t["catalog"], "series_key", "first_seq") == [("m:host=a", 0)]
    assert rows(t["batch_sizes"], "timestamp", "points") == [(10, 2), (11, 2)]
    assert [r["arg"] for r in t["batches"].collect()][:2] == ["m:host=a 10 0.000000", "m:host=a 10 2.000000"]
    assert rows(t["values"], "timestamp", "value") == [(10, 2.0), (11, 3.0)]
    assert series.deduplicate(labelled_points(lines), "SUM").count() == 2


def test_counters_are_observed_while_the_store_is_written(spark, tmp_path):
    land = tmp_path / "landing2"
    land.mkdir()
    (land / "a.txt").write_text(json.dumps({"metrics": [{"name": "m", "value": 1}, {"name": "n", "value": 2}]}) + "\nbroken\n")
    base, quarantine = scratch_path(spark, "api-nc"), scratch_path(spark, "api-nc-q")
    (c,) = api.ingest(spark, str(land), base, quarantine=quarantine).collect()
    assert (c["total_requests"], c["total_metrics"]) == (2, 2)
    assert api.query(spark, base).count() == 2 and spark.read.parquet(quarantine).count() == 1
