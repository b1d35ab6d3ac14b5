"""What the operators of this subpackage share: stored tables, tidy batches, words."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.session import shared_folder

# A word is a run of bytes other than the six ASCII white-space bytes; this is also
# what bytes.split() takes for white space.
WORD = r"[^\x20\x09-\x0D]+"

# Rows of text reach Python in batches of at most so many bytes, whatever their length.
BATCH_BYTES = "4194304"


def prepare(spark: SparkSession) -> SparkSession:
    """Settings the operators rely on: small Arrow batches, shuffle files freed per job."""
    for key, value in {
        "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES,
        "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, tag: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here.

    A lost executor costs a re-read of the files and never a rebuild.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm/{tag}-{uuid4().hex}"
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


def release(*frames: DataFrame, part: str = "") -> None:
    """Delete tables of ``stored``, or one partition folder of theirs, that no later plan reads."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{df._stored_at}/{part}".rstrip("/"))
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def words_in(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column, parts: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == remainder, F.lit(False))


def lean(run):
    """``run`` for mapInArrow, after which the worker gives back the memory it no longer uses.

    Workers live on from task to task, and what their allocators keep counts against the
    executor while the next stage's tasks need it.
    """

    def work(batches):
        import ctypes

        import pyarrow

        yield from run(batches)
        pyarrow.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return work


def worker_state() -> dict:
    """A dictionary that lives as long as the Python worker, across its tasks."""
    import sys
    from types import ModuleType

    name = "_ledgerspark_worker"
    return vars(sys.modules.setdefault(name, ModuleType(name)))
