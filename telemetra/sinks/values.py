"""A7 and R2 on stored series: one value per (series, timestamp) under the duplicate policy,
kept up batch by batch, with each series' retention applied to what is stored.

The table is cut by series bucket and time slice. A batch reads and rewrites the parts that
it touches, merges their rows with its own by the policy, and becomes visible by one step of
the manifest; a batch that was committed before is passed over. MIN, MAX and SUM merge in any
order; FIRST and LAST keep the arrival of the value they hold, so the result is that of one
batch over all rows, however they were cut.

With a retention, a second table holds each series' newest timestamp. A row older than that
less the retention is not stored, and slices in which the batch's series have such rows are
rewritten without them. A series that has not moved keeps its rows, as in the batch form.

Layout::

    base/values-<id>/slice=<n>/bucket=<n>/   rows, written once; a version names the live parts
    base/newest-<id>/bucket=<n>/             newest timestamp per series
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telemetra.constants import DUPLICATE_POLICIES
from telemetra.operators.series import ARRIVAL, with_series_key
from telemetra.schemas import SeriesOptions
from telemetra.session import written
from telemetra.sinks import manifest
from telemetra.sinks.manifest import Version

BUCKETS, SLICE_SECONDS = 64, 86_400
KEY = ["series_key", "timestamp"]


def _arrival() -> Column:
    return F.struct(*ARRIVAL)


def _merge(rows: DataFrame, policy: str) -> DataFrame:
    """Rows of equal series and timestamp as one, with the arrival of the value they keep and
    their number."""
    kept = F.struct("value", *ARRIVAL)
    one = {"LAST": F.max_by(kept, _arrival()), "FIRST": F.min_by(kept, _arrival())}.get(policy)
    if one is None:
        value = {"MIN": F.min("value"), "MAX": F.max("value"), "SUM": F.sum("value")}[policy]
        one = F.struct(value.alias("value"), F.max(_arrival()).alias("last"))
        found = rows.groupBy("slice", "bucket", *KEY).agg(one.alias("kept"), F.sum("duplicates").alias("duplicates"))
        return found.select(*KEY, "kept.value", *[F.col(f"kept.last.{c}").alias(c) for c in ARRIVAL], "duplicates", "slice", "bucket")
    found = rows.groupBy("slice", "bucket", *KEY).agg(one.alias("kept"), F.sum("duplicates").alias("duplicates"))
    return found.select(*KEY, "kept.value", *[f"kept.{c}" for c in ARRIVAL], "duplicates", "slice", "bucket")


def _parts(version: Version, kind: str) -> dict[tuple[str, ...], str]:
    """Live parts of a table: (slice, bucket) or (bucket,) → directory."""
    return {tuple(s.split("/")[1:]): s for s in version.segments if s.startswith(f"{kind}-")}


def _open(spark: SparkSession, base: str, parts: list[str], like: DataFrame) -> DataFrame:
    """Parts of a table, read with the schema of a batch's rows."""
    if not parts:
        return like.limit(0)
    frames = {}
    for part in parts:
        frames.setdefault(part.split("/")[0], []).append(f"{base}/{part}")
    out = None
    for root, paths in frames.items():
        one = spark.read.schema(like.schema).option("basePath", f"{base}/{root}").parquet(*paths).select(*like.columns)
        out = one if out is None else out.unionByName(one)
    return out


def upsert(points: DataFrame, base: str, policy: str = "LAST", *, writer: str | None = None, batch_id: int | None = None,
           options: SeriesOptions = SeriesOptions(), retention: int | None = None, buckets: int = BUCKETS, slice_seconds: int = SLICE_SECONDS) -> Version:
    """One batch of labelled points (``seq, pos, timestamp, metric, value, labels``) merged into
    the table at ``base``. ``policy``, ``buckets``, ``slice_seconds`` and ``retention`` stay the
    same over a table's life; ``retention`` None keeps everything."""
    policy = policy.upper()
    if policy not in DUPLICATE_POLICIES:
        raise ValueError(f"unknown duplicate policy {policy!r}; one of {DUPLICATE_POLICIES}")
    spark, base = points.sparkSession, base.rstrip("/")
    manifest.create(spark, base)
    if writer is not None and manifest.committed(spark, base, writer, batch_id):
        return manifest.current(spark, base)

    keyed = with_series_key(points, options).select(
        *KEY, "value", *ARRIVAL, F.lit(1).cast("bigint").alias("duplicates"),
        F.floor(F.col("timestamp") / slice_seconds).cast("bigint").alias("slice"),
        F.pmod(F.xxhash64("series_key"), F.lit(buckets)).cast("int").alias("bucket"))
    own = written(_merge(keyed, policy), "upsert")
    heads = own.groupBy("series_key", "bucket").agg(F.max("timestamp").alias("newest"))
    # parts of the table, not rows: at most buckets x slices of the batch reach the driver
    touched = {(f"slice={r['slice']}", f"bucket={r['bucket']}") for r in own.select("slice", "bucket").distinct().collect()}
    moved = {b for _, b in touched}

    def change(now: Version) -> Version | None:
        if writer is not None and now.writers.get(writer, -1) >= batch_id:
            return None
        live, newest = _parts(now, "values"), _parts(now, "newest")
        rewrite, gone, made = set(touched), set(), []
        horizon = None
        if retention is not None:
            before = _open(spark, base, [p for k, p in newest.items() if k[0] in moved], heads)
            horizon = written(before.unionByName(heads).groupBy("series_key", "bucket").agg(F.max("newest").alias("newest")), "newest")
            name = f"newest-{uuid.uuid4().hex[:12]}"
            horizon.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{base}/{name}")
            made += [f"{name}/{b}" for b in moved]
            gone |= {p for k, p in newest.items() if k[0] in moved}
            rewrite |= _expiring(spark, base, live, horizon, own, retention, slice_seconds, moved)
        old = {k: p for k, p in live.items() if k in rewrite}
        rows = _merge(own.unionByName(_open(spark, base, list(old.values()), own)), policy)
        if horizon is not None:
            rows = rows.join(horizon.drop("bucket"), "series_key").where(F.col("timestamp") >= F.col("newest") - retention).select(*own.columns)
        name = f"values-{uuid.uuid4().hex[:12]}"
        rows = written(rows, "merged")
        rows.hint("rebalance", "slice", "bucket").write.partitionBy("slice", "bucket").parquet(f"{base}/{name}")
        made += [f"{name}/slice={r['slice']}/bucket={r['bucket']}" for r in rows.select("slice", "bucket").distinct().collect()]
        gone |= set(old.values())
        kept = [s for s in now.segments if s not in gone]
        writers = now.writers if writer is None else now.writers | {writer: batch_id}
        return Version(0, (*kept, *sorted(made)), writers)

    return manifest.commit(spark, base, change)


def _expiring(spark, base, live, horizon, own, retention, slice_seconds, moved) -> set[tuple[str, ...]]:
    """Parts of the batch's buckets that hold rows below their series' horizon. Only slices that
    begin below the highest horizon of their bucket can."""
    high = {f"bucket={r['bucket']}": r["newest"] for r in horizon.groupBy("bucket").agg(F.max("newest").alias("newest")).collect()}
    old = [p for (s, b), p in live.items() if b in moved and int(s.split("=")[1]) * slice_seconds < high[b] - retention]
    if not old:
        return set()
    rows = _open(spark, base, old, own).join(horizon.drop("bucket"), "series_key")
    found = rows.where(F.col("timestamp") < F.col("newest") - retention).select("slice", "bucket").distinct().collect()
    return {(f"slice={r['slice']}", f"bucket={r['bucket']}") for r in found}


def read_values(spark: SparkSession, base: str) -> DataFrame:
    """``series_key, timestamp, value, duplicates`` of the newest version."""
    base = base.rstrip("/")
    roots: dict[str, list[str]] = {}
    for part in _parts(manifest.current(spark, base), "values").values():
        roots.setdefault(part.split("/")[0], []).append(f"{base}/{part}")
    out = spark.createDataFrame([], "series_key string, timestamp bigint, value double, duplicates bigint")
    for paths in roots.values():
        out = out.unionByName(spark.read.parquet(*paths).select(*out.columns))
    return out


def vacuum(spark: SparkSession, base: str) -> list[str]:
    """Deletes the table's directories of which the newest version names no part, and returns
    them. For a table without readers of older versions and without a batch under way."""
    base = base.rstrip("/")
    live = {s.split("/")[0] for s in manifest.current(spark, base).segments}
    fs, root = manifest._folder(spark, base)
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    gone = [n for n in names if n.startswith(("values-", "newest-")) and n not in live]
    for name in gone:
        fs.delete(manifest._jvm(spark).org.apache.hadoop.fs.Path(f"{base}/{name}"), True)
    return gone
