"""Series keys, catalog, batches, duplicate policies and retention (FX11, FX12)."""

import json

from telemetra.operators import series
from telemetra.schemas import SeriesOptions
from telemetra.sources.labelled import labelled_points

from conftest import rows

FX11 = [
    {"timestamp": 1704067200, "metric": "cpu_usage", "value": 45.2, "labels": {"host": "server01", "region": "eu-west-1"}},
    {"timestamp": 1704067260, "metric": "memory_usage", "value": 78.5, "labels": {"region": "eu-west-1", "host": "server01"}},
]


def lines(spark, *objs_or_text):
    data = [(i, o if isinstance(o, str) else json.dumps(o)) for i, o in enumerate(objs_or_text)]
    return spark.createDataFrame(data, "seq bigint, raw string")


def test_series_keys_with_prefix(spark):
    pts = labelled_points(lines(spark, *FX11))
    keyed = series.with_series_key(pts, SeriesOptions(prefix="metrics"))
    assert rows(keyed, "series_key") == [
        ("metrics:cpu_usage:host=server01:region=eu-west-1",),
        ("metrics:memory_usage:host=server01:region=eu-west-1",),
    ]


def test_key_without_prefix_or_labels(spark):
    pts = labelled_points(lines(spark, {"metric": "m", "value": 1}, {"metric": "m", "value": 1, "labels": []}))
    assert rows(series.with_series_key(pts), "series_key") == [("m",), ("m",)]


def test_labelled_defaults_and_bad_lines(spark):
    df = lines(spark, "", "   ", "not json", {"value": 2}, {"metric": 5}, {"metric": "a", "labels": {"k": 1}}, {"metric": "b"})
    got = rows(labelled_points(df), "seq", "metric", "timestamp", "value")
    assert got == [(3, "unknown", 0, 2.0), (6, "b", 0, 0.0)]


def test_catalog_and_batches(spark):
    pts = labelled_points(lines(spark, *FX11, FX11[0]))
    cat = series.series_catalog(pts, SeriesOptions(prefix="metrics"))
    got = rows(cat, "series_key", "first_seq", "points", "retention", "duplicate_policy", "compressed")
    assert got == [
        ("metrics:cpu_usage:host=server01:region=eu-west-1", 0, 2, 86400, "LAST", True),
        ("metrics:memory_usage:host=server01:region=eu-west-1", 1, 1, 86400, "LAST", True),
    ]
    b = series.timestamp_batches(labelled_points(lines(spark, *FX11)), SeriesOptions(prefix="metrics"))
    assert rows(b, "timestamp", "seq", "arg") == [
        (1704067200, 0, "metrics:cpu_usage:host=server01:region=eu-west-1 1704067200 45.200000"),
        (1704067260, 1, "metrics:memory_usage:host=server01:region=eu-west-1 1704067260 78.500000"),
    ]


def test_arrays_positions_and_policies(spark):
    same = [{"timestamp": 5, "metric": "m", "value": float(i)} for i in range(5)]
    pts = labelled_points(lines(spark, json.dumps(same), FX11[0]), arrays=True)
    assert pts.count() == 6
    first = {r["timestamp"]: r["value"] for r in series.deduplicate(pts, "FIRST").collect()}
    last = {r["timestamp"]: r["value"] for r in series.deduplicate(pts, "LAST").collect()}
    assert (first[5], last[5]) == (0.0, 4.0)
    assert [r["pos"] for r in series.timestamp_batches(pts).where("timestamp = 5").collect()] == [0, 1, 2, 3, 4]


def test_arrival_order_is_file_time_then_place(spark, tmp_path):
    import os

    from telemetra.sources.labelled import read_labelled

    point = lambda v: json.dumps({"timestamp": 1, "metric": "m", "value": v}) + "\n"
    (tmp_path / "z_first.txt").write_text(point(1.0))
    (tmp_path / "a_later.txt").write_text("\n" * 5000 + point(2.0) + point(3.0))  # larger, so read first
    os.utime(tmp_path / "z_first.txt", (1_700_000_000, 1_700_000_000))
    os.utime(tmp_path / "a_later.txt", (1_700_000_100, 1_700_000_100))
    pts = read_labelled(spark, str(tmp_path))
    assert [r["value"] for r in series.deduplicate(pts, "LAST").collect()] == [3.0]
    assert [r["value"] for r in series.deduplicate(pts, "FIRST").collect()] == [1.0]


def test_duplicate_policies(spark):
    dup = [{"timestamp": 10, "metric": "m", "value": v} for v in (5.0, 1.0, 3.0)]
    pts = labelled_points(lines(spark, *dup))
    expect = {"LAST": 3.0, "FIRST": 5.0, "MIN": 1.0, "MAX": 5.0, "SUM": 9.0}
    for policy, value in expect.items():
        (r,) = series.deduplicate(pts, policy).collect()
        assert (r["timestamp"], r["value"], r["duplicates"]) == (10, value, 3), policy


def test_retention_keeps_recent_window_per_series(spark):
    objs = [{"timestamp": t, "metric": m, "value": 1} for m, t in [("a", 0), ("a", 50), ("a", 100), ("b", 10)]]
    kept = series.apply_retention(labelled_points(lines(spark, *objs)), retention=50)
    assert rows(kept, "metric", "timestamp") == [("a", 50), ("a", 100), ("b", 10)]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
