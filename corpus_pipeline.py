"""From raw documents to coded text: quality, near duplicates, substrings, mixing, pieces.

Each stage takes (spark, docs, sf_dir) and is written and read again before the next, so
a lost executor costs a part of one stage at most. All but the last return the columns of
``documents``; the last adds ``tokens``.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from ledgerspark.llm import mixing, nearcopies, pieces, quality, substrings
from ledgerspark.llm.common import prepare, table
from ledgerspark.session import shared_folder


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each component of near copies (five words, similarity 0.8).

    SimHash links them; its links are checked and completed on the whole sets.
    """
    return nearcopies.keep_one(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the windows that an earlier document has."""
    return substrings.clean(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks."""
    return mixing.emit(docs)


def coded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the ids of their pieces."""
    return pieces.encode(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("near-dedup", one_of_near_copies),
    ("substring dedup", without_repeats),
    ("mixing sources", mixed),
    ("piece coding", coded),
]

# The classifier and the merges are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{shared_folder(spark)}/pipeline/{uuid4().hex}-{k}"
        out = stage(prepare(spark), docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
