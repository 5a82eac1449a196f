"""Stores with a directory per host or per file on a local or mounted file system: written, and
read line by line, by the tasks themselves.

Hadoop's local file system starts a process for every file that it creates (``chmod``) and
keeps a checksum file beside it; Spark's listing gives every directory a task and its scan
opens every file anew. With a directory per value these are the whole cost of a store. Here a
task writes the files of its directories one after another, and lists and reads its share of
them. Names, layout and lines are those of Spark's writers. A file appears under its name when
it is whole; a task that is run again writes the same names. A write that fails can leave the
files of tasks that had finished (and no ``_SUCCESS``).

Other file systems (HDFS, object stores) and other codecs are left to Spark.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telemetra.session import _context, written
from telemetra.sinks import manifest

# Suffix of a file by codec, as Spark names it.
TEXT_CODECS = {"none": "", "uncompressed": "", "gzip": ".gz"}
PARQUET_CODECS = {"none": "", "uncompressed": "", "snappy": ".snappy", "gzip": ".gz", "zstd": ".zstd"}
# Points of a Parquet row group; bytes of a text file that one task reads; files a task may have.
GROUP_ROWS, SPLIT_BYTES, TASK_FILES = 1 << 17, 1 << 26, 4096


def folder(spark: SparkSession, path: str) -> str | None:
    """``path`` as the operating system names it, None if it lies in another file system."""
    if _context(spark) is None:
        return None
    fs, root = manifest._folder(spark, path)
    return fs.makeQualified(root).toUri().getPath() if fs.getUri().getScheme() == "file" else None


def writable(spark: SparkSession, path: str, fmt: str, compression: str, mode: str) -> bool:
    codecs = PARQUET_CODECS if fmt == "parquet" else TEXT_CODECS
    return mode == "append" and compression in codecs and folder(spark, path) is not None


def write(rows: DataFrame, path: str, fmt: str, by: Sequence[str], line: Column | None = None, compression: str = "none", max_records: int | None = None, names: Sequence[str] = ()) -> None:
    """Rows as files under ``by[0]=…/by[1]=…``. They come dealt out and sorted by ``by``;
    ``line`` is a row's line in a text file, of the columns ``names`` if not of the rows' own."""
    spark = rows.sparkSession
    cols = [c for c in rows.columns if c not in by]
    keys = [F.col(c).cast("string").alias(f"_by{i}") for i, c in enumerate(by)]
    data = [F.col(c) for c in cols] if fmt == "parquet" else [F.concat(line, F.lit("\n")).alias("_line")]
    header = ",".join(names or cols) + "\n" if fmt.startswith("csv") else ""
    ending = {"parquet": f"{PARQUET_CODECS.get(compression)}.parquet", "jsonl": f".json{TEXT_CODECS.get(compression)}"}.get(fmt, f".csv{TEXT_CODECS.get(compression)}")
    fs, root = manifest._folder(spark, path)
    fs.mkdirs(root)
    task = _writer(folder(spark, path), list(by), ending, header.encode(), compression, max_records, GROUP_ROWS, spark.version, str(uuid.uuid4()))
    rows.select(*keys, *data).mapInArrow(task, "files bigint").agg(F.sum("files")).first()
    fs.create(manifest._jvm(spark).org.apache.hadoop.fs.Path(root, "_SUCCESS"), True).close()


def _writer(root: str, by: list[str], ending: str, header: bytes, compression: str, max_records: int | None, group_rows: int, version: str, job: str):
    # self-contained: executors need numpy and pyarrow, not this package
    def run(batches):
        import gzip
        import os

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        # what Spark escapes in the name of a partition's directory
        unsafe = str.maketrans({c: f"%{ord(c):02X}" for c in [*map(chr, range(1, 32)), *"\"#%'*/:=?\\\x7f{[]^"]})
        task, parquet = TaskContext.get(), ending.endswith(".parquet")

        class File:
            def __init__(self, key: tuple, number: int, schema: pa.Schema):
                names = [f"{n}={v.translate(unsafe) if v else '__HIVE_DEFAULT_PARTITION__'}" for n, v in zip(by, key)]
                place, name = "/".join([root, *names]), f"part-{task.partitionId():05d}-{job}.c{number:03d}{ending}"
                os.makedirs(place, exist_ok=True)
                self.at, self.draft = f"{place}/{name}", f"{place}/.{name}-{task.taskAttemptId()}"
                self.key, self.rows, self.held = key, 0, []
                if parquet:
                    self.schema = schema.with_metadata({"org.apache.spark.version": version})
                    self.out = pq.ParquetWriter(self.draft, self.schema, compression="none" if compression == "uncompressed" else compression, use_dictionary=False)
                else:
                    self.out = gzip.open(self.draft, "wb", 6) if ending.endswith(".gz") else open(self.draft, "wb")
                    self.out.write(header)

            def flush(self):
                if self.held:
                    self.out.write_table(pa.Table.from_batches(self.held, self.schema))
                self.held = []

            def close(self):
                self.flush()
                self.out.close()
                os.replace(self.draft, self.at)

        file, files, most = None, 0, max_records or 1 << 62
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                ends = np.unique(np.concatenate([pc.run_end_encode(batch.column(i)).run_ends.to_numpy() for i in range(len(by))]))
                starts = np.concatenate([[0], ends[:-1]])
                keys = zip(*[batch.column(i).take(pa.array(starts)).to_pylist() for i in range(len(by))])
                if parquet:
                    data = pa.RecordBatch.from_arrays(batch.columns[len(by):], names=batch.schema.names[len(by):])
                else:
                    text = batch.column(len(by)).cast(pa.large_binary())
                    at = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
                    data = memoryview(text.buffers()[2])
                for key, start, end in zip(keys, starts.tolist(), ends.tolist()):
                    while start < end:
                        if file is None or file.key != key or file.rows >= most:
                            if file is not None:
                                file.close()
                            # numbered through the task: no value and an empty one share a directory
                            file, files = File(key, files, data.schema if parquet else None), files + 1
                        n = min(end - start, most - file.rows)
                        if parquet:
                            file.held.append(data.slice(start, n))
                        else:
                            file.out.write(data[at[start] : at[start + n]])
                        file.rows, start = file.rows + n, start + n
                        if parquet and sum(b.num_rows for b in file.held) >= group_rows:
                            file.flush()
            if file is not None:
                file.close()
                file = None
        finally:
            if file is not None and os.path.exists(file.draft):
                os.unlink(file.draft)
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], names=["files"])

    return run


# ---------------------------------------------------------------- reading

def _tasks(spark: SparkSession) -> int:
    return max(32, 4 * spark.sparkContext.defaultParallelism)


def list_files(spark: SparkSession, base: str, depth: int) -> DataFrame:
    """``path, size`` of the data files below ``depth`` levels of directories, listed once: each
    level by many tasks, and never as a whole on the driver."""
    found = spark.range(0, 1, 1, 1).select(F.lit(folder(spark, base)).alias("path"), F.lit(-1).cast("bigint").alias("size"))
    for level in range(depth + 1):
        found = found.repartition(_tasks(spark)) if level else found
        found = found.mapInArrow(_lister(level == depth), "path string, size bigint")
    return written(found, "listed")


def _lister(to_the_end: bool):
    def run(batches):
        import os

        import pyarrow as pa

        def entries(top):
            with os.scandir(top) as inside:
                for e in inside:
                    # what Spark takes for hidden
                    if e.name.startswith(".") or e.name.startswith("_") and "=" not in e.name or e.name.endswith("._COPYING_"):
                        continue
                    if not e.is_dir():
                        yield e.path, e.stat().st_size
                    elif to_the_end:
                        yield from entries(e.path)
                    else:
                        yield e.path, -1

        def batch(some):
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in some], pa.string()), pa.array([s for _, s in some], pa.int64())], names=["path", "size"])

        some = []
        for given in batches:
            for path, size in zip(given.column(0).to_pylist(), given.column(1).to_pylist()):
                for entry in entries(path) if size < 0 else [(path, size)]:
                    some.append(entry)
                    if len(some) >= 10_000:
                        yield batch(some)
                        some = []
        yield batch(some)

    return run


def read_lines(spark: SparkSession, base: str, partitions: Sequence[str]) -> DataFrame | None:
    """Lines of a text store: ``value`` and the partition columns as strings. None if Spark has
    to read it. The files are those found now; a long one is read by several tasks."""
    root = folder(spark, base)
    fs, place = manifest._folder(spark, base) if root else (None, None)
    if root is None or not fs.exists(place):
        return None
    files = list_files(spark, base, len(partitions))
    name = F.element_at(F.split("path", "/"), -1)
    plain = ~name.rlike(r"\.(bz2|deflate|lz4|snappy|zst|zstd)$")
    totals = files.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.coalesce(F.bool_and(plain), F.lit(True)).alias("plain")).first()
    if not totals["plain"]:
        return None
    # a split begins every SPLIT_BYTES, of a compressed file at its beginning only
    last = F.when(F.endswith(name, F.lit(".gz")), F.lit(0)).otherwise(F.floor(F.greatest(F.col("size") - 1, F.lit(0)) / SPLIT_BYTES))
    splits = files.select("path", F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"))).alias("split"))
    tasks = max(_tasks(spark), totals["n"] // TASK_FILES, totals["size"] // SPLIT_BYTES)
    fields = ", ".join(["line binary", *[f"`{p}` string" for p in partitions]])
    lines = splits.repartition(tasks).mapInArrow(_reader(root, list(partitions), SPLIT_BYTES), fields)
    return lines.select(F.col("line").cast("string").alias("value"), *partitions)


def _reader(root: str, partitions: list[str], split_bytes: int):
    def run(batches):
        import gzip
        import re

        import pyarrow as pa

        def values(path):
            found = dict(part.split("=", 1) for part in path[len(root):].split("/")[:-1] if "=" in part)
            told = [re.sub("%([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), found.get(p, "__HIVE_DEFAULT_PARTITION__")) for p in partitions]
            return [None if v == "__HIVE_DEFAULT_PARTITION__" else v for v in told]

        def pieces(path, split):
            """Whole lines that begin in the split, some MB at a time."""
            packed = path.endswith(".gz")
            with gzip.open(path) if packed else open(path, "rb") as f:
                at, end = split * split_bytes, None if packed else (split + 1) * split_bytes
                if at:
                    f.seek(at - 1)
                    at += len(f.readline()) - 1
                while end is None or at < end:
                    data = f.read(min(1 << 22, end - at) if end else 1 << 22)
                    if not data:
                        return
                    if not data.endswith(b"\n"):
                        data += f.readline()
                    at += len(data)
                    yield data

        def batch(lines, keys):
            columns = [pa.array(lines, pa.binary()), *[pa.array(k, pa.string()) for k in keys]]
            return pa.RecordBatch.from_arrays(columns, names=["line", *partitions])

        lines, keys, held = [], [[] for _ in partitions], 0
        for given in batches:
            for path, split in zip(given.column(0).to_pylist(), given.column(1).to_pylist()):
                told = values(path)
                for data in pieces(path, split):
                    some = re.split(b"\r\n|\r|\n", data) if b"\r" in data else data.split(b"\n")
                    if not some[-1]:
                        some.pop()
                    lines += some
                    for key, value in zip(keys, told):
                        key += [value] * len(some)
                    held += len(data)
                    if held > 1 << 22 or len(lines) >= 10_000:
                        yield batch(lines, keys)
                        lines, keys, held = [], [[] for _ in partitions], 0
        yield batch(lines, keys)

    return run
