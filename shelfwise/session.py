"""Session settings every job relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Runtime SQL settings. Dimension tables are never hinted: a side is broadcast only when
# its measured size is under the threshold, and skewed sort-merge joins are split by AQE
# even when that costs one more shuffle before the next aggregation.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

# Settings that must be in place when the session starts.
STARTUP_CONF = {
    # call-site capture costs several gateway calls per column expression
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session for tests and the benchmark; on a cluster the submitter makes the session."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("shelfwise")
    fixed = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in {**STARTUP_CONF, **RUNTIME_CONF, **fixed, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def configure(spark: SparkSession) -> SparkSession:
    """Apply the batch settings to an existing session and return it."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


# State is written locally and again to the checkpoint, and its keys begin alike: a closer codec over longer blocks.
STATE_CONF = {
    "spark.sql.streaming.stateStore.rocksdb.compression": "zstd",
    "spark.sql.streaming.stateStore.rocksdb.blockSizeKB": "16",
}


def configure_streaming(spark: SparkSession) -> SparkSession:
    """Batch settings plus the RocksDB state store the stateful operators need."""
    configure(spark)
    for key, value in {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, **STATE_CONF}.items():
        spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """The shared folder the cluster names for checkpoints, or ``fallback`` where it names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if fallback is None:
        raise ValueError("spark.checkpoint.dir is not set and no fallback folder was given")
    return fallback
