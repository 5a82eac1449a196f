"""Expressions over flat points: tag text, series keys, time conversions, date paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from telemetra.constants import DATE_PATH_FORMAT


def sorted_json_object(m: Column) -> Column:
    """``map<string,string>`` as compact JSON text with keys in byte order; ``{}`` when
    the map is NULL or empty."""
    ordered = F.map_from_entries(F.sort_array(F.map_entries(m)))
    return F.coalesce(F.to_json(ordered), F.lit("{}"))


def series_key(metric: Column, labels: Column, prefix: str | None = None) -> Column:
    """``prefix:metric:k1=v1:k2=v2`` with labels sorted by (key, value).

    An absent prefix and an empty or NULL label map add no separator.
    """
    pairs = F.transform(
        F.sort_array(F.map_entries(labels)),
        lambda e: F.concat(e["key"], F.lit("="), e["value"]),
    )
    label_part = F.nullif(F.array_join(pairs, ":"), F.lit(""))
    parts = ([F.lit(prefix)] if prefix is not None else []) + [metric, label_part]
    return F.concat_ws(":", *parts)


# Seconds since the epoch of the first and last second of years 1 to 9999, and units per second.
FIRST_SECOND, LAST_SECOND = -62_135_596_800, 253_402_300_799
UNITS = {"s": 1, "ms": 1000}


def in_time_span(epoch: Column, unit: str = "s") -> Column:
    """True for an epoch number that is a time of years 1 to 9999 in ``unit``."""
    return F.coalesce(epoch.between(FIRST_SECOND * UNITS[unit], (LAST_SECOND + 1) * UNITS[unit] - 1), F.lit(False))


def to_event_time(epoch: Column, unit: str = "s") -> Column:
    """Epoch number in seconds or milliseconds → TIMESTAMP; NULL out of range."""
    if unit not in UNITS:
        raise ValueError(f"unknown timestamp unit {unit!r}")
    convert = F.timestamp_seconds if unit == "s" else F.timestamp_millis
    return F.when(in_time_span(epoch, unit), convert(F.when(in_time_span(epoch, unit), epoch)))


def epoch_seconds(ts: Column) -> Column:
    """TIMESTAMP → whole epoch seconds (floor)."""
    return F.unix_seconds(ts)


def date_path(ts: Column) -> Column:
    """``YYYY/MM/DD`` directory text of a timestamp, UTC session assumed."""
    return F.date_format(ts, DATE_PATH_FORMAT)
