"""Values that must equal the collector's for the same results."""

# Fixed values (from the collector's behaviour), in one place:
UNKNOWN = "unknown"                      # default metric name and host
DEFAULT_TIMESTAMP = 0                    # missing timestamp
DEFAULT_LABELLED_VALUE = 0.0             # missing value of a labelled point
DEFAULT_RETENTION_SECONDS = 86400        # series retention
DEFAULT_DUPLICATE_POLICY = "LAST"
DUPLICATE_POLICIES = ("LAST", "FIRST", "MIN", "MAX", "SUM")
DATE_PATH_FORMAT = "yyyy/MM/dd"          # UTC date directories
CSV_ROWS_PER_FILE = 100_000              # CSV rotation
PARQUET_COMPRESSION = "snappy"           # Parquet codec, dictionary encoding off
CHART_POINTS = 50                        # points kept per host and chart
RECENT_LOG_SIZE = 100                    # recent metrics kept by the live log
CHARTS = {                               # chart → (metric names, field plotted)
    "cpu": (["cpu", "system"], "usage"),
    "memory": (["memory", "system"], "used"),
}
