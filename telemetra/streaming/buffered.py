"""One query whose batches close by size, by age or on demand, whichever comes first.

Every trigger lands what has arrived in ``<checkpoint>-pending/batch=<id>``, so that a lost
executor or driver loses nothing. What is pending becomes one batch of the store once it

* holds ``max_bytes`` of payload text,
* holds a payload that has waited ``max_age`` seconds, or
* a request (:func:`request_flush`) has arrived, which is a stream of its own: its files are
  part of the query's offsets, so a request is neither lost nor heard twice.

Nothing else is remembered: the store's manifest knows the last batch that was published, and
pending are the ones after it. A batch landed once is not landed again by a replay, so the
reason to close it stays. What is pending when the query has stopped goes out with
:func:`publish_pending`, as the collector flushes when it stops.

Without ``max_age`` a batch runs only when something arrives; with it, a clock (one row a
second) makes batches run while nothing does.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from telemetra.operators import flatten
from telemetra.schemas import FlattenOptions
from telemetra.sinks import manifest
from telemetra.streaming import live

PAYLOADS, REQUEST, TICK = "payload", "request", "tick"
TICKING = live.Trigger(every="1 second")


def request_flush(spark: SparkSession, requests: str) -> str:
    """Asks the query that watches ``requests`` to publish what it has taken in; the request's
    file, which appears whole."""
    fs, root = live._files(spark, requests)
    fs.mkdirs(root)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    name = f"flush-{uuid.uuid4().hex}"
    out = fs.create(path(root, f".{name}"), True)
    out.write(b"flush\n")
    out.close()
    fs.rename(path(root, f".{name}"), path(root, name))
    return f"{requests.rstrip('/')}/{name}"


def _arrivals(payloads: DataFrame, requests: str | None, clock: bool) -> DataFrame:
    spark = payloads.sparkSession
    rows = payloads.withColumn("kind", F.lit(PAYLOADS))
    if requests:
        fs, root = live._files(spark, requests)
        fs.mkdirs(root)
        asked = spark.readStream.text(requests).select(F.lit(REQUEST).alias("kind"))
        rows = rows.unionByName(asked, allowMissingColumns=True)
    if clock:
        ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).option("numPartitions", 1).load()
        rows = rows.unionByName(ticks.select(F.lit(TICK).alias("kind")), allowMissingColumns=True)
    return rows


def _pending_dir(checkpoint: str) -> str:
    return f"{checkpoint.rstrip('/')}-pending"


def _pending(spark: SparkSession, sink: str, checkpoint: str, up_to: int | None = None) -> tuple[list[str], int]:
    """The landed batches that are not published yet, and the newest one's id."""
    path = _pending_dir(checkpoint)
    last = manifest.current(spark, sink).writers.get(checkpoint.rstrip("/"), -1)
    fs, found = live._batch_dirs(spark, path)
    ids = sorted(i for i, p in found.items() if i > last and (up_to is None or i <= up_to) and live._complete(spark, fs, p))
    return [f"{path}/batch={i}" for i in ids], max(ids, default=-1)


def _publish(spark: SparkSession, rows: DataFrame, sink: str, checkpoint: str, batch_id: int, options: FlattenOptions, date_source: str, quarantine: str | None) -> None:
    payloads = rows.where(F.col("kind") == PAYLOADS).drop("kind", "bytes", "landed_at")
    if quarantine:
        flatten.rejected(payloads, options).write.mode("overwrite").parquet(f"{quarantine}/batch={batch_id}")
    by_event = date_source == "timestamp"
    points = flatten.flatten(payloads, options, keep=["received_at"], dated=by_event)
    manifest.write_batch(points, sink, checkpoint.rstrip("/"), batch_id, date_source, layout="as_is" if by_event else None)
    live._prune_before(spark, _pending_dir(checkpoint), batch_id + 1)


def ingest(
    payloads: DataFrame,
    sink: str,
    checkpoint: str,
    *,
    max_bytes: int | None = None,
    max_age: float | None = None,
    requests: str | None = None,
    options: FlattenOptions = FlattenOptions(),
    trigger: live.Trigger = TICKING,
    date_source: str = "received_at",
    name: str | None = None,
    quarantine: str | None = None,
) -> StreamingQuery:
    """T1 whose store gets a batch by size, by age or on demand (see the module). The source's
    own bound (``payload_stream(max_bytes_per_trigger=…)``) says by how much a batch may pass
    ``max_bytes``. With an available-now trigger the rest stays pending when the query ends."""
    spark = payloads.sparkSession
    manifest.create(spark, sink)
    writer, landing = checkpoint.rstrip("/"), _pending_dir(checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        if manifest.committed(session, sink, writer, batch_id):
            live._prune_before(session, landing, batch_id + 1)
            return
        arrived = live.numbered(batch.where(F.col("kind") != TICK)).withColumns({
            "bytes": F.octet_length("raw").cast("bigint"), "landed_at": F.current_timestamp()})
        folder = f"{landing}/batch={batch_id}"
        if folder not in _pending(session, sink, checkpoint, batch_id)[0]:
            arrived.write.mode("overwrite").parquet(folder)
        dirs, _ = _pending(session, sink, checkpoint, batch_id)
        rows = session.read.schema(arrived.schema).parquet(*dirs)
        is_payload = F.col("kind") == PAYLOADS
        state = rows.agg(
            F.count_if(is_payload).alias("rows"),
            F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
            F.count_if(F.col("kind") == REQUEST).alias("asked"),
            (F.unix_micros(F.current_timestamp()) - F.unix_micros(F.min(F.when(is_payload, F.col("landed_at"))))).alias("age"),
        ).first()
        if not state["rows"]:
            live._prune_before(session, landing, batch_id + 1)
            return
        full = max_bytes is not None and state["bytes"] >= max_bytes
        old = max_age is not None and state["age"] >= max_age * 1_000_000
        if full or old or state["asked"]:
            _publish(session, rows, sink, checkpoint, batch_id, options, date_source, quarantine)

    stream = _arrivals(payloads, requests, max_age is not None and not trigger.available_now)
    return live._start(stream.writeStream.foreachBatch(write), checkpoint, trigger, name)


def publish_pending(
    spark: SparkSession,
    sink: str,
    checkpoint: str,
    *,
    options: FlattenOptions = FlattenOptions(),
    date_source: str = "received_at",
    quarantine: str | None = None,
) -> bool:
    """Publishes what a stopped query has left pending; False if there is nothing. A query
    that goes on from the checkpoint finds it published."""
    dirs, newest = _pending(spark, sink, checkpoint)
    if not dirs:
        return False
    rows = spark.read.parquet(*dirs)
    if rows.where(F.col("kind") == PAYLOADS).isEmpty():
        return False
    _publish(spark, rows, sink, checkpoint, newest, options, date_source, quarantine)
    return True
