"""Stores with a directory per value of a column (K2, K6): whole jobs, files and their layout."""

import glob
import gzip
import os

import pyarrow.parquet as pq
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from telemetra.plans import catalog
from telemetra.session import LISTING_TASKS, scratch_path
from telemetra.sinks import cells, writers
from telemetra.sources import points as points_src

from conftest import rows

KINDS = ("click", "view", "error")


def events(spark, n=60, users=4):
    """A folder with an ``events`` table of rows made here."""
    base = scratch_path(spark, "events")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("id") % 3 + 1).cast("int"))
    spark.range(n).select(
        F.col("id").alias("event_id"), F.expr("timestamp_ntz'2024-01-05 00:00:00' + make_interval(0, 0, 0, 0, id)").alias("ts"),
        (F.col("id") % users).alias("user_id"), kind.alias("event_type"), (F.col("id") / 4).alias("value"),
        F.concat(F.lit('{"k": '), F.col("id"), F.lit("}")).alias("props")).write.parquet(f"{base}/events.parquet")
    return base


def test_jsonl_by_metric_and_host_stores_every_metric(spark):
    stored = catalog.QUERIES["jsonl_partitioned"](spark, events(spark))
    assert rows(stored.groupBy("metric_name").count(), "metric_name", "count") == sorted((f"{k}.{f}", 20) for k in KINDS for f in ("k", "value"))


ODD = ["h", "", None, "a b", "x=1/y:2", "50%", "q\"'*?\\{[]^#", "\t", "%41"]


def odd_points(spark):
    data = [(i, n, float(j), h) for i, h in enumerate(ODD) for n in ("m", "", None) for j in range(3)]
    return spark.createDataFrame(data, "t int, metric_name string, value double, host string").select(
        F.timestamp_seconds("t").alias("timestamp"), "metric_name", "value", "host", F.lit('{"n":1.5}').alias("tags_json"))


def stored(path, ending):
    """Directory → lines of its files, with how many files it has."""
    top, found = path.removeprefix("file:"), {}
    for at, _, names in os.walk(top):
        for name in names:
            if name.endswith(ending):
                read = gzip.open if ending.endswith(".gz") else open
                with read(f"{at}/{name}", "rt") as f:
                    found.setdefault(at.removeprefix(top), []).append(f.read().splitlines())
    return {d: sorted(line for lines in files for line in lines) for d, files in found.items()}


def test_text_stores_by_host_are_those_of_sparks_writer(spark):
    for fmt, codec, ending in (("jsonl", None, ".json"), ("jsonl", "gzip", ".json.gz"), ("csv_tags", None, ".csv")):
        ours, sparks = scratch_path(spark, "ours"), scratch_path(spark, "sparks")
        pts = odd_points(spark).coalesce(1)
        writers.write_points(pts, ours, fmt, partition_by=("metric_name", "host"), compression=codec, layout="as_is")
        writers.write_points(pts, sparks, fmt, partition_by=("metric_name", "host"), compression=codec, layout="as_is", mode="overwrite")
        lines = stored(ours, ending)
        heads = lambda found: {d: set(x) for d, x in found.items()}  # noqa: E731 - a CSV file more has a header more
        assert heads(lines) == heads(stored(sparks, ending)) and len(lines) == 16, fmt
        assert sum(len([x for x in d if not x.startswith("timestamp,")]) for d in lines.values()) == 81
        # no process and no checksum file for each of them
        assert glob.glob(f"{ours.removeprefix('file:')}/**/.part*", recursive=True) == [] and os.path.exists(f"{ours.removeprefix('file:')}/_SUCCESS")
        back = points_src.read_store(spark, ours, fmt, ("metric_name", "host"))
        assert back.count() == 81


def test_a_jsonl_store_by_host_is_listed_and_read_by_tasks(spark, monkeypatch):
    path = scratch_path(spark, "by-host")
    pts = spark.range(500).select(F.timestamp_seconds("id").alias("timestamp"), F.concat(F.lit("é" * 5), F.col("id")).alias("metric_name"), F.col("id").cast("double").alias("value"),
                                  F.concat(F.lit("h"), F.col("id") % 3).alias("host"), F.lit("{}").alias("tags_json"))
    writers.write_points(pts, path, "jsonl", partition_by=("host",))
    writers.write_points(pts, path, "jsonl", partition_by=("host",), compression="gzip")
    sparks = spark.read.schema("value string, host string").text(path)
    for split in (1 << 26, 1000, 97):
        monkeypatch.setattr(cells, "SPLIT_BYTES", split)
        lines = cells.read_lines(spark, path, ("host",))
        assert rows(lines, "host", "value") == rows(sparks, "host", "value"), split
    read = points_src.read_store(spark, path, "jsonl", ("host",))
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "FileScan text" not in plan and read.select("metric_name").distinct().count() == 500
    # a codec that only Spark reads
    pts.limit(1).selectExpr("'{}' value", "host").write.mode("append").partitionBy("host").option("compression", "bzip2").text(path)
    assert cells.read_lines(spark, path, ("host",)) is None
    assert points_src.read_store(spark, path, "jsonl", ("host",)).count() == 1000


def test_pieces_of_a_csv_store_by_host(spark):
    path = scratch_path(spark, "pieces")
    pts = odd_points(spark).where("host = 'h' and metric_name = 'm'").unionAll(odd_points(spark).where("host = '50%' and metric_name = 'm'")).coalesce(1)
    writers.write_points(pts, path, "csv", partition_by=("host",), max_records_per_file=2)
    files = sorted(glob.glob(f"{path.removeprefix('file:')}/*/*.csv"))
    assert [len(open(f).read().splitlines()) - 1 for f in files] == [2, 1, 2, 1]
    assert points_src.read_store(spark, path, "csv", ("host",)).count() == 6


def test_an_empty_store_and_a_missing_one(spark):
    path = scratch_path(spark, "none")
    writers.write_points(odd_points(spark).limit(0), path, "jsonl", partition_by=("host",))
    assert points_src.read_store(spark, path, "jsonl", ("host",)).count() == 0
    with pytest.raises(AnalysisException):
        points_src.read_store(spark, f"{path}-missing", "jsonl", ("host",))


def test_a_listing_takes_a_few_tasks_per_core(spark):
    assert int(spark.conf.get(LISTING_TASKS)) <= max(64, 4 * spark.sparkContext.defaultParallelism)


def test_a_parquet_store_by_host_is_that_of_sparks_writer(spark, monkeypatch):
    monkeypatch.setattr(cells, "GROUP_ROWS", 1)  # a batch of Arrow's default size; 12000 points are two
    days = ["0001-01-01", "1582-10-04", "1899-12-31", "2024-01-05", "9999-12-31"]
    many = spark.range(12_000).select(F.element_at(F.array(*[F.lit(f"{d} 23:59:59").cast("timestamp") for d in days]), (F.col("id") % 5 + 1).cast("int")).alias("timestamp"),
                                    F.lit("m").alias("metric_name"), F.when(F.col("id") % 7 > 0, F.col("id") / 3).alias("value"), F.lit("hot").alias("host"), F.lit(None).cast("string").alias("tags_json"))
    pts = odd_points(spark).unionAll(many)
    for codec, ending in ((None, ".snappy.parquet"), ("gzip", ".gz.parquet"), ("zstd", ".zstd.parquet"), ("none", ".parquet")):
        ours, sparks = scratch_path(spark, "ours"), scratch_path(spark, "sparks")
        writers.write_points(pts, ours, "parquet", partition_by=("host",), compression=codec)
        writers.write_points(pts, sparks, "parquet", partition_by=("host",), compression=codec, mode="overwrite")
        top = ours.removeprefix("file:")
        assert sorted(os.listdir(top)) == sorted(os.listdir(sparks.removeprefix("file:")))
        assert glob.glob(f"{top}/**/.part*", recursive=True) == [] and all(f.endswith(ending) for f in glob.glob(f"{top}/*/*"))
        ours, sparks = (points_src.read_store(spark, p, "parquet", ("host",)) for p in (ours, sparks))
        assert ours.schema == sparks.schema and ours.count() == 12_081
        assert ours.exceptAll(sparks).count() == 0
        assert rows(ours.where("host = 'hot' and value < 2").select("value"), "value") == rows(sparks.where("host = 'hot' and value < 2").select("value"), "value")
    (file,) = glob.glob(f"{top}/host=hot/*")
    kept = pq.ParquetFile(file)
    assert kept.num_row_groups > 1 and "RLE_DICTIONARY" not in kept.metadata.row_group(0).column(1).encodings


def test_a_failed_write_leaves_no_drafts(spark):
    path = scratch_path(spark, "failed")
    bad = odd_points(spark).withColumn("host", F.when(F.col("host") == "x=1/y:2", F.repeat(F.lit("z"), 300)).otherwise(F.col("host")))
    with pytest.raises(Exception, match="File name too long"):
        writers.write_points(bad.coalesce(1), path, "parquet", partition_by=("host",), layout="as_is")
    top = path.removeprefix("file:")
    assert not os.path.exists(f"{top}/_SUCCESS") and glob.glob(f"{top}/**/.part*", recursive=True) == []


def test_a_rotated_store_is_that_of_sparks_writer(spark):
    pts = odd_points(spark).withColumn("received_at", F.col("timestamp") + F.expr("make_interval(0, 0, 0, 0, unix_seconds(timestamp))")).withColumn("metric_name", F.coalesce("metric_name", F.lit("é")))
    for fmt, codec, ending in (("jsonl", None, ".json"), ("jsonl", "gzip", ".json.gz"), ("csv_tags", None, ".csv")):
        ours, sparks = scratch_path(spark, "ours"), scratch_path(spark, "sparks")
        for path, mode in ((ours, "append"), (sparks, "overwrite")):
            writers.write_rotated(pts.coalesce(1), path, fmt, max_bytes=400, window_minutes=180, compression=codec, mode=mode)
        found = stored(ours, ending)
        assert found == stored(sparks, ending) and len(found) > 6, fmt
        top = ours.removeprefix("file:")
        assert glob.glob(f"{top}/**/.part*", recursive=True) == [] and os.path.exists(f"{top}/_SUCCESS")
        if codec is None:
            assert max(os.path.getsize(f) for f in glob.glob(f"{top}/*/*/*")) <= 400


def test_what_is_not_asked_of_a_json_line_is_not_made(spark):
    path = scratch_path(spark, "lines")
    writers.write_rotated(odd_points(spark).withColumn("received_at", F.col("timestamp")), path, "jsonl", max_bytes=1000)
    points = points_src.read_jsonl_points(spark, path, partitions=("date", "file"))
    assert points.count() == 54 and rows(points.groupBy("date").count(), "count") == [(54,)]  # no metric, no point
    plan = points.groupBy("date").count()._jdf.queryExecution().optimizedPlan().toString()
    assert "map_from_entries" not in plan and "inline" in plan
    (generate,) = [line for line in points._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate inline" in line]
    assert "variant_get" not in generate
