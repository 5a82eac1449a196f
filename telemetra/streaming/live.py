"""Structured Streaming: continuous ingest (T1, T2), first-seen series (T3), filtered live
stream (T4), latest value per series (T5), last N per host (T6) and running counters (T7).

Sinks are idempotent, so that a micro-batch replayed after a lost executor or a restart
writes the same files again instead of twice:

* T1 publishes each micro-batch through the store's manifest, whole or not at all; batch
  appends and deletions go through the same manifest;
* the others write ``<path>/batch=<id>`` with overwrite, and readers take committed ones.

T3, T5 and T6 write what a batch changed (new or newer series, a batch's newest rows per
host) to a log that readers fold with the operator's own aggregate; every ``FOLD_EVERY``
batches the log is folded into one directory. A trigger's cost follows its batch, not all
series ever seen. None of the results depends on how the input was cut into batches.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from telemetra.functions.points import sorted_json_object, to_event_time
from telemetra.functions.rows import line_numbers, split_place
from telemetra.operators import filters, flatten, series, views
from telemetra.schemas import PAYLOAD, FlattenOptions, SeriesOptions
from telemetra.session import written
from telemetra.sinks import manifest, values
from telemetra.sources.labelled import labelled_points

LINES = T.StructType([T.StructField("seq", T.LongType(), False), T.StructField("raw", T.StringType(), True)])


@dataclass(frozen=True)
class Trigger:
    """When micro-batches run. ``every`` (e.g. ``'10 seconds'``, the collector's
    flush interval) or ``available_now`` (flush what has arrived, then stop). Batches that
    close by size, age or demand are in :mod:`telemetra.streaming.buffered`."""

    every: str | None = None
    available_now: bool = False

    def kwargs(self) -> dict:
        if self.available_now:
            return {"availableNow": True}
        return {"processingTime": self.every or "10 seconds"}


FLUSH = Trigger(available_now=True)


# ---------------------------------------------------------------- sources

def payload_stream(spark: SparkSession, path: str, fmt: str = "text", max_files_per_trigger: int | None = None, max_bytes_per_trigger: int | str | None = None) -> DataFrame:
    """Payload files as they land, in sub-directories too. ``text``: one payload per
    line, ``received_at`` the file time and ``seq`` the place of the line's split, which
    :func:`numbered` makes the arrival order of the batch reader; ``parquet``: landed payloads
    with the ``PAYLOAD`` schema (producer-assigned ``seq``). A trigger takes at most so many
    files, or files of so many bytes (but one file at least)."""
    reader = spark.readStream.option("recursiveFileLookup", "true")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if max_bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", max_bytes_per_trigger)
    if fmt == "parquet":
        return reader.schema(PAYLOAD).parquet(path)
    # by splits, as in batch: a file of any size is read by many tasks
    text = reader.text(path)
    return text.select(
        split_place().alias("seq"), F.col("value").alias("raw"), F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_modification_time").alias("received_at"))


def numbered(batch: DataFrame) -> DataFrame:
    """A micro-batch whose ``seq`` is complete. A stream has no row ids, so lines of a text
    stream arrive with the place of their split; within a batch the rows of a split stay
    together and in order, and get their number there, as the batch reader does it."""
    kind = batch.schema["seq"].dataType if "seq" in batch.columns else None
    if not isinstance(kind, T.StructType) or "row" in kind.names:
        return batch
    return batch.withColumn("seq", F.struct("seq.*", F.monotonically_increasing_id().alias("row")))


def land_numbered(lines: DataFrame, sink: str, checkpoint: str, trigger: Trigger = FLUSH, name: str | None = None) -> StreamingQuery:
    """Lines of a text stream landed as Parquet with their number in the file (``line``),
    under ``batch=<id>``; a trigger takes whole files. The numbered splits are written once,
    then their line counts give each split's offset."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = line_numbers(written(numbered(batch), "numbered-lines"))
        rows.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return _start(lines.writeStream.foreachBatch(write), checkpoint, trigger, name)


def line_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Landed labelled lines (``seq, raw``) as a stream."""
    reader = spark.readStream.schema(LINES)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


# ---------------------------------------------------------------- helpers

# Batches after which a change log is folded into one directory.
FOLD_EVERY = 50


def _log_writer(path: str, fold: Callable[[DataFrame], DataFrame]):
    """A change log: each batch's changes in their own directory, folded now and then.

    The folded directory is written before the batches it holds are dropped, and folding
    twice changes nothing, so a replay is safe."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        if (batch_id + 1) % FOLD_EVERY == 0:
            folded = fold(read_log(batch.sparkSession, path))
            folded.write.mode("overwrite").parquet(f"{path}/folded={batch_id}")
            _prune_before(batch.sparkSession, path, batch_id + 1)
            _prune_before(batch.sparkSession, path, batch_id, "folded")

    return write


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All changes of a log: its newest folded directory and the batches after it."""
    fs, folded = _batch_dirs(spark, path, "folded")
    newest = max((i for i, p in folded.items() if _complete(spark, fs, p)), default=-1)
    _, batches = _batch_dirs(spark, path)
    dirs = [f"{path}/batch={i}" for i in sorted(batches) if i > newest and _complete(spark, fs, batches[i])]
    if newest >= 0:
        dirs.insert(0, f"{path}/folded={newest}")
    return spark.read.parquet(*dirs)


def _snapshot_writer(path: str):
    """Complete-mode output: each batch is the whole result; keep it and its predecessor."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        _prune_before(batch.sparkSession, path, batch_id - 1)

    return write


def _start(df_writer, checkpoint: str, trigger: Trigger, name: str | None) -> StreamingQuery:
    w = df_writer.option("checkpointLocation", checkpoint).trigger(**trigger.kwargs())
    if name:
        w = w.queryName(name)
    return w.start()


def _files(spark: SparkSession, path: str):
    """(Hadoop file system, path object); only listings and renames pass through here."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), root


def _complete(spark: SparkSession, fs, directory) -> bool:
    """True once the write of ``directory`` has been committed."""
    return fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(directory, "_SUCCESS"))


def _batch_dirs(spark: SparkSession, path: str, kind: str = "batch"):
    """(file system, {batch id: directory}) of a versioned sink."""
    fs, root = _files(spark, path)
    if not fs.exists(root):
        return fs, {}
    found = {}
    for st in fs.listStatus(root):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith(f"{kind}="):
            found[int(name.split("=", 1)[1])] = st.getPath()
    return fs, found


def latest_batch(spark: SparkSession, path: str) -> DataFrame:
    """The newest committed ``batch=<id>`` directory of a versioned sink."""
    fs, found = _batch_dirs(spark, path)
    return spark.read.parquet(f"{path}/batch={max(i for i, p in found.items() if _complete(spark, fs, p))}")


def _prune_before(spark: SparkSession, path: str, batch_id: int, kind: str = "batch") -> None:
    """Drop versions older than ``batch_id``."""
    fs, found = _batch_dirs(spark, path, kind)
    for bid, p in found.items():
        if bid < batch_id:
            fs.delete(p, True)


# ---------------------------------------------------------------- T1 / T2 / K7

def ingest(
    payloads: DataFrame,
    sink: str,
    checkpoint: str,
    options: FlattenOptions = FlattenOptions(),
    trigger: Trigger = FLUSH,
    date_source: str = "received_at",
    name: str | None = None,
    quarantine: str | None = None,
) -> StreamingQuery:
    """Payloads → points → date-partitioned Parquet store, exactly once.

    The partition date is the arrival date by default, as the collector partitions by
    flush time: each micro-batch lands in about one directory. ``date_source="timestamp"``
    partitions by event time instead. A batch becomes visible whole, through the store's
    manifest (:mod:`telemetra.sinks.manifest`), under the checkpoint's name; rejected input
    goes to ``<quarantine>/batch=<id>`` (its count is the number of rows there)."""
    manifest.create(payloads.sparkSession, sink)
    writer = checkpoint.rstrip("/")

    def write(batch: DataFrame, batch_id: int) -> None:
        if manifest.committed(batch.sparkSession, sink, writer, batch_id):
            return
        batch = numbered(batch)
        if quarantine:
            flatten.rejected(batch, options).write.mode("overwrite").parquet(f"{quarantine}/batch={batch_id}")
        by_event = date_source == "timestamp"
        points = flatten.flatten(batch, options, keep=["received_at"], dated=by_event)
        manifest.write_batch(points, sink, writer, batch_id, date_source, layout="as_is" if by_event else None)

    return _start(payloads.writeStream.foreachBatch(write), checkpoint, trigger, name)


def ingest_fan_out(
    payloads: DataFrame,
    stores: dict[str, str],
    quarantine: str | None,
    checkpoint: str,
    options: FlattenOptions = FlattenOptions(),
    trigger: Trigger = FLUSH,
    name: str | None = None,
) -> StreamingQuery:
    """T1 + K7 + P8: each micro-batch is parsed once and staged beside the checkpoint,
    written from there to every store (``{path: format}``) under ``batch=<id>``, by arrival
    date as in :func:`ingest`; its rejects go to ``quarantine``."""
    from telemetra.sinks.writers import staged, write_points

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = numbered(batch)
        stage = f"{checkpoint.rstrip('/')}-staged"
        pts = staged(flatten.flatten(batch, options, keep=["received_at"]), f"{stage}/batch={batch_id}", "received_at")
        for path, fmt in stores.items():
            write_points(pts, f"{path}/batch={batch_id}", fmt, mode="overwrite", date_source="received_at")
        if quarantine:
            flatten.rejected(batch, options).write.mode("overwrite").parquet(f"{quarantine}/batch={batch_id}")
        _prune_before(batch.sparkSession, stage, batch_id)

    return _start(payloads.writeStream.foreachBatch(write), checkpoint, trigger, name)


# ---------------------------------------------------------------- A7 / R2 on stored series

def upsert(lines: DataFrame, base: str, checkpoint: str, policy: str = "LAST", options: SeriesOptions = SeriesOptions(),
           retention: int | None = None, buckets: int = values.BUCKETS, trigger: Trigger = FLUSH, name: str | None = None) -> StreamingQuery:
    """Labelled lines into the table of one value per (series, timestamp): the policy holds
    over all batches, and ``retention`` is applied to what is stored."""
    writer = checkpoint.rstrip("/")

    def write(batch: DataFrame, batch_id: int) -> None:
        values.upsert(labelled_points(batch), base, policy, writer=writer, batch_id=batch_id, options=options, retention=retention, buckets=buckets)

    return _start(lines.writeStream.foreachBatch(write), checkpoint, trigger, name)


# ---------------------------------------------------------------- T3

def first_seen(lines: DataFrame, sink: str, checkpoint: str, options: SeriesOptions = SeriesOptions(), trigger: Trigger = FLUSH, name: str | None = None) -> StreamingQuery:
    """Every series with its first sighting (lowest ``seq``, ``pos``) across all batches."""
    keyed = series.with_series_key(labelled_points(lines), options)
    first = keyed.groupBy("series_key").agg(
        F.min_by(F.struct("seq", "pos", "timestamp", "metric", "labels"), F.struct("seq", "pos")).alias("first")
    )
    writer = first.writeStream.outputMode("update").foreachBatch(_log_writer(sink, _first_of))
    return _start(writer, checkpoint, trigger, name)


def _first_of(log: DataFrame) -> DataFrame:
    return log.groupBy("series_key").agg(F.min_by("first", F.struct("first.seq", "first.pos")).alias("first"))


def first_seen_bounded(lines: DataFrame, sink: str, checkpoint: str, watermark: str, options: SeriesOptions = SeriesOptions(), trigger: Trigger = FLUSH, name: str | None = None) -> StreamingQuery:
    """T3 with bounded state: a key is forgotten ``watermark`` after it was last seen
    (``dropDuplicatesWithinWatermark``), so a series idle longer than that is reported
    again. Event time is the point's timestamp; points whose timestamp is no time are left
    out. :mod:`telemetra.streaming.seen` forgets by processing time and can be reset."""
    keyed = series.with_series_key(labelled_points(lines), options).withColumn("event_time", to_event_time(F.col("timestamp")))
    keyed = keyed.where(F.col("event_time").isNotNull())
    kept = keyed.withWatermark("event_time", watermark).dropDuplicatesWithinWatermark(["series_key"])
    writer = kept.writeStream.format("parquet").option("path", sink)
    return _start(writer, checkpoint, trigger, name)


def read_first_seen(spark: SparkSession, sink: str, options: SeriesOptions = SeriesOptions()) -> DataFrame:
    """The catalog folded from T3's change log."""
    cat = _first_of(read_log(spark, sink))
    return cat.select(
        "series_key",
        F.col("first.metric").alias("metric"),
        sorted_json_object(F.col("first.labels")).alias("labels_json"),
        F.col("first.seq").alias("first_seq"),
        F.col("first.timestamp").alias("first_timestamp"),
        F.lit(options.retention).cast("bigint").alias("retention"),
        F.lit(options.duplicate_policy).alias("duplicate_policy"),
        F.lit(options.compressed).alias("compressed"),
    )


# ---------------------------------------------------------------- T4

def filtered(payloads: DataFrame, sink: str, checkpoint: str, metrics: str | None = None, tags: dict[str, str] | None = None,
             options: FlattenOptions = FlattenOptions(), trigger: Trigger = FLUSH, name: str | None = None) -> StreamingQuery:
    """T4 as the clients call it: metrics (wide rows, all fields) whose name is in the
    comma-separated list and whose tags have the given values, appended as they arrive."""

    def write(batch: DataFrame, batch_id: int) -> None:
        wide = filters.by_metric_list(flatten.wide_metrics(numbered(batch), options), metrics, column="name")
        for key, value in (tags or {}).items():
            wide = filters.by_tag(wide, key, value)
        rows = wide.select("seq", "pos", "timestamp", "name", "host", "tags_json", "fields")
        rows.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return _start(payloads.writeStream.foreachBatch(write), checkpoint, trigger, name)


def filtered_points(payloads: DataFrame, sink: str, checkpoint: str, metrics: str | None = None, tags: dict[str, str] | None = None,
                    options: FlattenOptions = FlattenOptions(), trigger: Trigger = FLUSH, name: str | None = None) -> StreamingQuery:
    """T4 on points: the listed point names (``name`` or ``name.field``)."""
    names = [n.strip() for n in metrics.split(",") if n.strip()] if metrics else None

    def write(batch: DataFrame, batch_id: int) -> None:
        pts = flatten.flatten(numbered(batch), options, metrics=names)
        for key, value in (tags or {}).items():
            pts = filters.by_tag(pts, key, value)
        rows = pts.select("seq", "pos", "timestamp", "metric_name", "value", "host", "tags_json")
        rows.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return _start(payloads.writeStream.foreachBatch(write), checkpoint, trigger, name)


def read_filtered(spark: SparkSession, sink: str) -> DataFrame:
    """All committed batches of T4's sink."""
    return read_log(spark, sink).drop("batch")


# ---------------------------------------------------------------- T5

def latest(payloads: DataFrame, sink: str, checkpoint: str, options: FlattenOptions = FlattenOptions(), trigger: Trigger = FLUSH, name: str | None = None) -> StreamingQuery:
    """T5: the newest metric per (name, tags) card; a batch's newest cards go to the log,
    which :func:`read_latest` folds."""
    def newest(rows: DataFrame) -> DataFrame:
        last = F.struct("timestamp", "seq", "pos", "main_field", "main_value")
        return rows.groupBy("name", "tags_json").agg(F.max_by(last, F.struct("timestamp", "seq", "pos")).alias("last"))

    log = _log_writer(sink, _last_of)
    cards = lambda batch: views.card_rows(flatten.wide_metrics(numbered(batch), options))
    return _start(payloads.writeStream.foreachBatch(lambda batch, i: log(newest(cards(batch)), i)), checkpoint, trigger, name)


def _last_of(log: DataFrame) -> DataFrame:
    return log.groupBy("name", "tags_json").agg(F.max_by("last", F.struct("last.timestamp", "last.seq", "last.pos")).alias("last"))


def latest_by_window(payloads: DataFrame, sink: str, checkpoint: str, window: str = "1 hour", watermark: str = "10 minutes", options: FlattenOptions = FlattenOptions(), trigger: Trigger = FLUSH, name: str | None = None) -> StreamingQuery:
    """T5 with bounded state: the newest metric per card and event-time ``window``,
    appended once the watermark has passed the window's end, then dropped from state."""
    cards = views.card_rows(flatten.wide_metrics(payloads, options)).withWatermark("timestamp", watermark)
    newest = cards.groupBy(F.window("timestamp", window).alias("window"), "name", "tags_json").agg(
        F.max_by(F.struct("timestamp", "seq", "main_field", "main_value"), F.struct("timestamp", "seq", "pos")).alias("last")
    )
    rows = newest.select(
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        "name",
        "tags_json",
        F.col("last.main_field").alias("main_field"),
        F.round(F.col("last.main_value"), 2).alias("value"),
        F.col("last.timestamp").alias("timestamp"),
        F.col("last.seq").alias("seq"),
    )
    writer = rows.writeStream.outputMode("append").format("parquet").option("path", sink)
    return _start(writer, checkpoint, trigger, name)


def read_latest(spark: SparkSession, sink: str) -> DataFrame:
    """W1 cards from T5's log."""
    cards = _last_of(read_log(spark, sink))
    return cards.select(
        "name",
        "tags_json",
        F.col("last.main_field").alias("main_field"),
        F.round(F.col("last.main_value"), 2).alias("value"),
        F.col("last.timestamp").alias("timestamp"),
        F.col("last.seq").alias("seq"),
    )


# ---------------------------------------------------------------- T6

def last_n(payloads: DataFrame, sink: str, checkpoint: str, field: str = "value", names: list[str] | None = None, n: int = views.MAX_CHART_POINTS,
           options: FlattenOptions = FlattenOptions(), trigger: Trigger = FLUSH, name: str | None = None) -> StreamingQuery:
    """The newest ``n`` values per host; a batch's own newest go to the log, which
    :func:`read_last_n` ranks together."""
    rows = lambda batch: views.chart_rows(flatten.wide_metrics(numbered(batch), options), field, names)
    log = _log_writer(sink, lambda old: views.newest_per_host(old.drop("rank"), n))
    return _start(payloads.writeStream.foreachBatch(lambda batch, i: log(views.newest_per_host(rows(batch), n), i)), checkpoint, trigger, name)


def read_last_n(spark: SparkSession, sink: str, n: int = views.MAX_CHART_POINTS) -> DataFrame:
    """W2 rows from T6's log."""
    return views.newest_per_host(read_log(spark, sink).drop("rank"), n)


# ---------------------------------------------------------------- T7

def counters(payloads: DataFrame, sink: str, checkpoint: str, options: FlattenOptions = FlattenOptions(), trigger: Trigger = FLUSH, name: str | None = None) -> StreamingQuery:
    """Running totals of requests and enveloped metrics (global aggregate)."""
    parsed = flatten.parse_payloads(payloads, replace(options, scope="metric"))
    totals = parsed.agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.coalesce(F.sum(F.when(F.col("metrics").isNotNull(), F.size("metrics"))), F.lit(0))
        .cast("bigint")
        .alias("total_metrics"),
    )
    writer = totals.writeStream.outputMode("complete").foreachBatch(_snapshot_writer(sink))
    return _start(writer, checkpoint, trigger, name)
