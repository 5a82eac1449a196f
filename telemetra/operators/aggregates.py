"""A2 field statistics (A1 and A3 live with the stores and the flattener)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def field_stats(points: DataFrame, name: str | None = None, field: str | None = None) -> DataFrame:
    """A2: count, min, max, mean and sample deviation per metric name.

    ``name`` / ``field`` restrict to ``name.field`` (or ``name`` for value metrics), as
    ``/metrics/{name}/stats?field=`` asks for; both ``None`` gives every metric.
    """
    if name is not None:
        target = f"{name}.{field}" if field else name
        points = points.where(F.col("metric_name") == F.lit(target))
    return points.groupBy("metric_name").agg(
        F.count("value").alias("count"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("stddev"),
    )
