"""telemetra: monitoring metrics on Spark.

JSON payloads from collection agents are flattened into typed points, stored as
partitioned Parquet, CSV or JSON Lines, and queried with plain DataFrame code.
"""

from telemetra.schemas import FlattenOptions, SeriesOptions
from telemetra.session import configure, local_session

__all__ = ["FlattenOptions", "SeriesOptions", "configure", "local_session"]
