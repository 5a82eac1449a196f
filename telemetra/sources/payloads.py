"""Raw payloads from files, one JSON document per line (or per file).

``seq`` is each payload's place in arrival order (file time, file, place in the file),
``source`` the file it came from and ``received_at`` that file's modification time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemetra.functions.rows import arrival
from telemetra.schemas import PAYLOAD


def read_payloads(spark: SparkSession, path: str, whole_file: bool = False) -> DataFrame:
    """Text files under ``path`` (recursive) → ``seq, raw, source, received_at``."""
    text = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=whole_file)
    return text.select(
        arrival().alias("seq"),
        F.col("value").alias("raw"),
        F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_modification_time").alias("received_at"),
    )


def read_landed_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Payloads already landed as Parquet with the ``PAYLOAD`` schema."""
    return spark.read.schema(PAYLOAD).parquet(path)
