"""Metric, time and tag filters on points and wide rows.

All filters are plain ``where`` clauses on columns, so on a stored dataset Catalyst pushes
them into the Parquet scan (metric name, host, time) or prunes partitions (date).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TimeBound = int | float | str | dt.datetime | None


def _bound(value: TimeBound) -> Column:
    """A time bound as a TIMESTAMP column: epoch seconds, a datetime (UTC unless it says
    otherwise), or a string."""
    if isinstance(value, (int, float)):
        return F.timestamp_seconds(F.lit(value))
    if isinstance(value, dt.datetime):
        return F.lit(value if value.tzinfo else value.replace(tzinfo=dt.timezone.utc))
    return F.to_timestamp(F.lit(value))


def by_metric(points: DataFrame, metric: str | None, column: str = "metric_name") -> DataFrame:
    """exact metric name; ``None`` or ``''`` keeps everything."""
    if not metric:
        return points
    return points.where(F.col(column) == F.lit(metric))


def in_time_range(points: DataFrame, start: TimeBound = None, end: TimeBound = None, column: str = "timestamp") -> DataFrame:
    """``start <= ts <= end``; either bound may be open. Numbers are epoch seconds."""
    cond = F.lit(True)
    if start is not None:
        cond = cond & (F.col(column) >= _bound(start))
    if end is not None:
        cond = cond & (F.col(column) <= _bound(end))
    return points.where(cond)


def by_tag(points: DataFrame, key: str, value: str) -> DataFrame:
    """``tag.<key> = value``. ``host`` is a real column (pushed to the scan); other keys
    are read from the ``tags`` map, or from ``tags_json`` on stored points."""
    if key == "host" and "host" in points.columns:
        return points.where(F.col("host") == F.lit(value))
    if "tags" in points.columns:
        return points.where(F.col("tags").getItem(key) == F.lit(value))
    return points.where(F.from_json("tags_json", "map<string,string>").getItem(key) == F.lit(value))


def by_metric_list(points: DataFrame, names: str | list[str] | None, column: str = "metric_name") -> DataFrame:
    """metric name in a comma-separated list (or a list); empty keeps everything."""
    if not names:
        return points
    if isinstance(names, str):
        names = [n.strip() for n in names.split(",") if n.strip()]
    return points.where(F.col(column).isin(names))


def by_name(wide: DataFrame, name: str | None) -> DataFrame:
    """metric name on wide rows (before fan-out)."""
    return by_metric(wide, name, column="name")
