"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

_OWN_FOLDERS: dict[str, str] = {}


def local_session(cores: str = "8", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """Session for tests and the local benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("ledgerspark")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


# Wall-clock columns carry no offset, so the session runs in UTC. HotSpot does not
# compile methods above 8000 bytes; the limit makes Spark split such code instead.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
    # A line costs more time than its few stored bytes suggest, so scans are split finely.
    "spark.sql.files.maxPartitionBytes": "16m",
    # Ids are hex digits, which only an entropy coder halves.
    "spark.sql.parquet.compression.codec": "zstd",
    # A task keeps a file open per month instead of sorting its lines by month.
    "spark.sql.maxConcurrentOutputFileWriters": "100",
}
BYTES_PER_PART = 8 << 20  # of source tables; some 400,000 lines
_INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every job of this package relies on."""
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def deal_by_size(spark: SparkSession, size: int) -> None:
    """Let shuffles of ``size`` source bytes start with parts that a task sorts in memory.

    With a number that does not follow the input, a task's part outgrows its memory and is
    spilled over and over. Spark joins parts that prove small; the number is never lowered.
    """
    given = spark.conf.get(_INITIAL, None) or spark.conf.get("spark.sql.shuffle.partitions")
    wanted = -(-size // BYTES_PER_PART)
    if wanted > int(given):
        spark.conf.set(_INITIAL, str(wanted))


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, from ``spark.checkpoint.dir``.

    Only a local master without that setting gets a folder of its own; on a
    cluster a machine-local folder would be lost with its executor.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        return configured.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder all executors share.")
    if sc.applicationId not in _OWN_FOLDERS:
        _OWN_FOLDERS[sc.applicationId] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _OWN_FOLDERS[sc.applicationId]
