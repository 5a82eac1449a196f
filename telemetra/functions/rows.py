"""Row selection that stays above an expensive projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_where(df: DataFrame, cond: Column, *cols: Column | str) -> DataFrame:
    """``df.where(cond).select(*cols)`` evaluated after ``df``'s projection.

    Catalyst pushes a Filter below a Project by inlining the projected expressions, so a
    filter on a column derived from ``try_parse_json`` would parse every row twice. A
    generator over a one-element array is not pushed down: the condition and the output
    are computed once, from the already parsed row.
    """
    structs = F.struct(*[F.col(c) if isinstance(c, str) else c for c in cols])
    return df.select(F.inline(F.when(cond, F.array(structs))))


def _split_place() -> list[Column]:
    meta = F.col("_metadata")
    return [meta["file_modification_time"].alias("arrived"), meta["file_path"].alias("file"), meta["file_block_start"].alias("block")]


def split_place() -> Column:
    """Where the split of a text line stands in arrival order: file time, file, start."""
    return F.struct(*_split_place())


def arrival() -> Column:
    """Where a line of a text file stands in arrival order, in batch and stream alike: file
    time, then file, then place in the file (start of the split, row within it).

    Row ids alone follow Spark's packing of splits (largest first), so they order only the
    lines of one split."""
    return F.struct(*_split_place(), F.monotonically_increasing_id().alias("row"))


def line_numbers(lines: DataFrame, seq: str = "seq", name: str = "line") -> DataFrame:
    """Adds each line's number in its file, from 0, however many splits the file has.

    Rows are numbered within their split from the split's first row id, splits from the counts
    of those before them in the file. One row per split is aggregated and joined back; no
    file and no split is read whole. The lines have to come straight from a scan, or from
    where a scan was written: row ids are read twice and must not change."""
    at = F.col(seq)
    keys = [at["file"].alias("_file"), at["block"].alias("_block")]
    splits = lines.select(*keys, at["row"].alias("_row")).groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_lines"), F.min("_row").alias("_first"))
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("_file", "_block", "_first", F.coalesce(F.sum("_lines").over(before), F.lit(0)).alias("_before"))
    found = lines.join(offsets, (at["file"] == F.col("_file")) & (at["block"] == F.col("_block")))
    return found.withColumn(name, F.col("_before") + at["row"] - F.col("_first")).drop("_file", "_block", "_first", "_before")
