"""Headline timings at one scale factor; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is run to completion with the ``noop`` sink (every row computed, nothing
collected), twice: ``queries`` holds the warm (second-run best) time, ``cold`` the first
run, which includes JVM warm-up and code generation for that query's plan. ``ingest_parquet`` is the collector's throughput test re-aimed at the test
tables: line-item payloads → points → Parquet store in the default layout (event date,
rebalanced); its rate is reported as points/s. ``ingest_bulk_parquet`` does the same
with about 1000 metrics per payload (payloads prepared and cached before timing).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from telemetra.operators import flatten, store  # noqa: E402
from telemetra.plans.catalog import QUERIES, points_a  # noqa: E402
from telemetra.session import local_session, scratch_path  # noqa: E402
from telemetra.sinks import writers  # noqa: E402
from telemetra.sources import adapters  # noqa: E402
from telemetra.sources import points as points_src  # noqa: E402
from telemetra.operators import filters  # noqa: E402

HEADLINE = [
    "flatten_fields",
    "unpivot_wide",
    "quarantine",
    "field_stats",
    "latest_per_series",
    "last_50_per_host",
    "recent_n",
    "series_catalog",
    "timestamp_batches",
    "dedup_last",
    "series_retention",
    "stream_ingest",
]


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="telemetra-bench")
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    times: dict[str, float] = {}

    drain(QUERIES["flatten_value"](spark, sf_dir))  # warm-up, not timed

    cold: dict[str, float] = {}

    def timed(name, run) -> None:
        runs = []
        for _ in range(2):
            t0 = time.time()
            run()
            runs.append(time.time() - t0)
        cold[name], times[name] = runs[0], min(runs)

    # ingest: payloads → flatten → Parquet store
    # each test table is one row group, i.e. one scan task: land them as one file per core
    landed = scratch_path(spark, "bench-tables")
    for name in ("events", "lineitem"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").repartition(int(cpus) if cpus.isdigit() else 8).write.parquet(f"{landed}/{name}.parquet")
    sf_dir = landed
    lineitem = adapters.read_table(spark, sf_dir, "lineitem")
    paths = []

    def ingest():
        paths.append(scratch_path(spark, "bench-ingest"))
        pts = flatten.flatten(adapters.wide_payloads(lineitem), dated=True)
        writers.write_points(pts, paths[-1], "parquet", layout="as_is")

    timed("ingest_parquet", ingest)
    (n_points,) = spark.read.parquet(paths[-1]).agg(F.count(F.lit(1))).first()

    # the collector's throughput shape: about 1000 metrics per payload
    bulk = adapters.bulk_wide_payloads(lineitem).persist()
    bulk.count()

    def ingest_bulk():
        pts = flatten.flatten(bulk, dated=True)
        writers.write_points(pts, scratch_path(spark, "bench-bulk"), "parquet", layout="as_is")

    timed("ingest_bulk_parquet", ingest_bulk)

    # the collector's own layout, by the date of the write: beside the total
    by_flush: dict[str, float] = {}
    for label, source in (("ingest_parquet", adapters.wide_payloads(lineitem)), ("ingest_bulk_parquet", bulk)):
        runs = []
        for _ in range(2):
            t0 = time.time()
            writers.write_points(flatten.flatten(source), scratch_path(spark, "bench-flush"), "parquet", date_source="flush")
            runs.append(time.time() - t0)
        by_flush[label] = round(min(runs), 3)
    bulk.unpersist()

    for name in HEADLINE:
        timed(name, lambda name=name: drain(QUERIES[name](spark, sf_dir)))

    # read side: filtered query and per-file counts over a stored dataset
    stored = scratch_path(spark, "bench-store")
    writers.write_points(points_a(spark, sf_dir), stored, "parquet")

    def filtered():
        pts = points_src.read_parquet_points(spark, stored)
        drain(filters.in_time_range(filters.by_metric(pts, "click.value"), "2024-01-05", "2024-01-20"))

    timed("query_store_filtered", filtered)
    timed("rows_per_file", lambda: drain(store.rows_per_file(spark, stored)))

    total = sum(times.values())
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(total, 3),
        "unit": "sec",
        "queries": {k: round(v, 3) for k, v in times.items()},
        "cold": {k: round(v, 3) for k, v in cold.items()},
        "cold_total": round(sum(cold.values()), 3),
        "by_flush_date": by_flush,
        "input": "events and lineitem written anew as one file per core before timing",
        "ingest_points": int(n_points),
        "ingest_points_per_sec": round(n_points / times["ingest_parquet"], 1),
        "bulk_ingest_points_per_sec": round(n_points / times["ingest_bulk_parquet"], 1),
        "sf": float(sf.group(1)) if sf else None,
        "cpus": cpus,
    }))


if __name__ == "__main__":
    main()
