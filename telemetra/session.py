"""Session settings the library relies on, and where it may write files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every entry point applies to the session it is given. The store layout and all
# epoch conversions are UTC, and payloads with repeated object keys keep the last value.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


# Streaming state (first-seen series, latest value per series) holds one entry per series.
# RocksDB keeps it off the JVM heap and spills to local disk, checkpointing changes only.
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
HEAP_STATE_STORE = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
ROCKSDB_STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# A listing starts a task for every directory, up to 10 000 of them, and one such job for every
# date of a store; a few tasks per core list as fast.
LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
MOST_LISTING_TASKS = "10000"


def configure(spark: SparkSession) -> SparkSession:
    """Apply :data:`RUNTIME_CONF` to an existing session (runtime-settable keys only).

    The RocksDB state store is chosen only while the session still has Spark's built-in
    heap store, so a provider picked by the user (and its checkpoints) is left alone; so is a
    number of listing tasks that is not Spark's own."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    if spark.conf.get(STATE_STORE, HEAP_STATE_STORE) == HEAP_STATE_STORE:
        spark.conf.set(STATE_STORE, ROCKSDB_STATE_STORE)
        spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    sc = _context(spark)
    if sc and spark.conf.get(LISTING_TASKS, MOST_LISTING_TASKS) == MOST_LISTING_TASKS:
        spark.conf.set(LISTING_TASKS, str(max(64, 4 * sc.defaultParallelism)))
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "telemetra") -> SparkSession:
    """A local session for tests and the bench; clusters build their own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: ``spark.checkpoint.dir`` as the session names it.

    A local session that names none (tests) gets a scratch folder as its checkpoint
    directory; on a cluster the setting has to be there, since a folder of the driver's own
    would not be seen by the executors.
    """
    sc = _context(spark)
    root = spark.conf.get("spark.checkpoint.dir", None) or (sc.getCheckpointDir() if sc else None)
    if not root:
        if sc is None or not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="telemetra-"))
        root = sc.getCheckpointDir()
    return root.rstrip("/")


def _context(spark: SparkSession):
    """The SparkContext of a classic session; ``None`` under Spark Connect."""
    try:
        return spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect sessions have no SparkContext
        return None


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused path under :func:`shared_dir` for one store or stream."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once under :func:`shared_dir` and read back: several readers see the same
    rows, and lost executors do not bring its source back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
