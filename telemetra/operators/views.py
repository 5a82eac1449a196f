"""Read-side views over points and wide rows: W1 latest, W2 last N per host, W3 recent N,
D2 distinct hosts.

W1 is an aggregate (``max_by``), so it combines map-side; W2 and W3 rank in two levels:
first within (group, ``SALTS`` shares of the tasks), then within the group. Spark limits
each rank before its shuffle too, so at most ``n`` rows per group leave a map task and at
most ``SALTS × n`` reach a group's last task, however skewed the groups are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telemetra.constants import CHART_POINTS as MAX_CHART_POINTS
from telemetra.constants import CHARTS, RECENT_LOG_SIZE


# Shares of the tasks that rank on their own before a group's rows meet.
SALTS = 64


def newest(rows: DataFrame, n: int, group: list[str]) -> DataFrame:
    """The newest ``n`` rows per group, with their ``rank`` (1 = newest)."""
    order = _arrival_order(rows.columns)
    salted = rows.withColumn("_salt", F.spark_partition_id() % SALTS)
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy(*group, "_salt").orderBy(*order))).where(F.col("rank") <= n)
    last = Window.partitionBy(*group, F.lit(0)).orderBy(*order)
    return some.drop("_salt").withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= n)


def _arrival_order(columns: list[str] | None = None) -> list:
    """Newest first: event time, then arrival (``seq``, ``pos``) where the rows carry it."""
    order = ["timestamp", "seq", "pos"]
    if columns is not None:
        order = [c for c in order if c in columns]
    return [F.col(c).desc() for c in order]


def card_rows(wide: DataFrame) -> DataFrame:
    """Wide rows reduced to what a card shows: the main field (first key in sorted order)
    and its value, computed before any aggregate so no map travels through a shuffle."""
    main = F.array_min(F.map_keys(F.col("fields")))
    return wide.select(
        "name", "tags_json", "timestamp", "seq", "pos",
        main.alias("main_field"), F.col("fields")[main].alias("main_value"),
    )


def latest_per_series(wide: DataFrame) -> DataFrame:
    """The newest metric per card (name, tags), its main field and that field's value
    rounded to two decimals."""
    newest = F.max_by(
        F.struct("timestamp", "seq", "main_field", "main_value"),
        F.struct("timestamp", "seq", "pos"),
    )
    latest = card_rows(wide).groupBy("name", "tags_json").agg(newest.alias("last"))
    return latest.select(
        "name",
        "tags_json",
        F.col("last.main_field").alias("main_field"),
        F.round(F.col("last.main_value"), 2).alias("value"),
        F.col("last.timestamp").alias("timestamp"),
        F.col("last.seq").alias("seq"),
    )


def chart_rows(wide: DataFrame, field: str = "value", names: list[str] | None = None) -> DataFrame:
    """Wide rows that carry ``field`` (optionally only the given metric names), as
    ``host, timestamp, seq, pos, y``."""
    rows = wide
    if names:
        rows = rows.where(F.col("name").isin(names))
    return rows.select(
        "host", "timestamp", "seq", "pos", F.col("fields")[field].alias("y")
    ).where(F.col("y").isNotNull())


def newest_per_host(rows: DataFrame, n: int = MAX_CHART_POINTS) -> DataFrame:
    """The newest ``n`` chart rows per host, with their ``rank`` (1 = newest)."""
    return newest(rows, n, ["host"])


def last_n_per_host(wide: DataFrame, field: str = "value", names: list[str] | None = None, n: int = MAX_CHART_POINTS) -> DataFrame:
    """For each host, the newest ``n`` metrics that carry ``field``, as
    ``host, timestamp, seq, y, rank``."""
    ranked = newest_per_host(chart_rows(wide, field, names), n)
    return ranked.select("host", "timestamp", "seq", "y", "rank")


def chart(wide: DataFrame, name: str, n: int = MAX_CHART_POINTS) -> DataFrame:
    """W2 with the dashboard's presets: ``cpu`` or ``memory``."""
    names, field = CHARTS[name]
    return last_n_per_host(wide, field=field, names=names, n=n)


def recent(rows: DataFrame, n: int = RECENT_LOG_SIZE, metric: str | None = None, column: str | None = None) -> DataFrame:
    """The ``n`` most recent rows, optionally of one metric.

    On wide rows (column ``name``) the metric is found by its own name, also when it has
    fields; on points ``metric_name`` is compared, and a metric's fields (``name.field``)
    belong to it."""
    if metric:
        column = column or ("name" if "name" in rows.columns else "metric_name")
        own = F.col(column) == F.lit(metric)
        rows = rows.where(own | F.startswith(F.col(column), F.lit(f"{metric}.")) if column == "metric_name" else own)
    return newest(rows, n, []).drop("rank")


def distinct_hosts(points: DataFrame) -> DataFrame:
    """The hosts that metrics are tagged with. Only the tag counts: a metric without a
    host tag is not listed under the default, one tagged ``unknown`` is; ``''`` is left out."""
    tags = F.col("tags") if "tags" in points.columns else F.from_json("tags_json", "map<string,string>")
    return points.select(tags["host"].alias("host")).where(F.col("host") != "").distinct()
