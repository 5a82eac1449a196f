"""Helpers that several of the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemetra.session import scratch_path

# Words of the quality and near-duplicate operators: runs without ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read through Spark (the path may be in any store Spark reads)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the cluster's shared folder and read back: cuts the lineage,
    survives lost executors, and several readers see the same rows."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def plainly_named(df: DataFrame) -> DataFrame:
    """``df`` with columns ``c0, c1, …``, which clash with no helper column of an operator;
    ``toDF(*df.columns)`` gives the names back."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def with_row_id(df: DataFrame, name: str = "_row") -> DataFrame:
    """A number per row that does not depend on any column (ids may be null or repeat)."""
    return df.withColumn(name, F.monotonically_increasing_id())


def map_rows(df: DataFrame, schema: T.StructType, fn: Callable[[list[list]], list[list]]) -> DataFrame:
    """``mapInArrow`` over column lists: ``fn`` gets the batch's columns as Python lists and
    returns the output columns, in the order of ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = fn([c.to_pylist() for c in batch.columns])
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, arrow)], schema=arrow)

    return df.mapInArrow(run, schema)
