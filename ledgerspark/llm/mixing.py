"""Mixing sources to target weights, by DataFrame functions alone.

Tokens are summed per source, a repetition rate follows from the source's target, and
each document is taken floor(rate) times plus one Bernoulli copy whose probability is
the fraction of the rate. The coin is a keyed MD5 of the id, so reruns agree.

Defined results: null and empty texts have size 0 and are taken 0 words; a null source
is a source of its own and comes last; repeated rows count as often as they stand;
rows of a null id share one coin; an empty table gives an empty mix. A source without
words has target 0 and rate 0. Columns other than id, text and source are passed
through ``emit`` untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerspark.llm.common import prepare, stored, words_in

WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3
SEED = "mix-1"


def coin(doc_id: Column, seed: str = SEED) -> Column:
    """Uniform in [0, 1) from the id and the seed, in steps of 2**-32."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(2**32)


def _ranked(sources: DataFrame) -> DataFrame:
    """Add ``rank`` from 0 by code points, null last, without one task for all rows.

    Rows are ranged by name, numbered within their range, and shifted by the number of
    rows in earlier ranges. The ranged rows are stored first: their ranges must not move.
    """
    at = [F.col("source").isNull(), F.col("source")]
    ranged = stored(
        sources.repartitionByRange(*at).withColumn("part", F.spark_partition_id()), "mix-ranged"
    )
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    shifts = counts.select("part", F.coalesce(before, F.lit(0)).alias("shift"))
    own = F.row_number().over(W.partitionBy("part").orderBy(*at))
    return (
        ranged.withColumn("own", own)
        .join(shifts, "part")
        .withColumn("rank", F.col("shift") + F.col("own") - 1)
        .drop("part", "own", "shift")
    )


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """source, source_size, weight, target; ``sizes`` has source and size.

    Sources whose share passes ``most`` times their size stop there, and what is left
    is shared again by weight. Only sums go to the driver; a round that stops no further
    source ends the search, and the level only rises, so it ends.
    """
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    known = stored(
        _ranked(totals)
        .withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")))
        .drop("rank"),
        "mix-sources",
    )
    cap = F.col("source_size") * most
    total = known.agg(F.sum("source_size")).first()[0] or 0
    level, stopped = 0.0, -1
    while True:
        full = cap < F.col("weight") * F.lit(level)
        s = known.agg(
            F.count_if(full).alias("n"),
            F.sum(F.when(full, cap).otherwise(0)).alias("capped"),
            F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if s["n"] == stopped:
            break
        stopped = s["n"]
        if not s["open"]:
            break
        level = (total - s["capped"]) / s["open"]
    share = F.col("weight") * F.lit(float(level))
    return known.withColumn("target", F.least(cap.cast("double"), share))


def plan(sizes: DataFrame, **options) -> DataFrame:
    """``sizes`` (doc_id, source, size, ...) with source_size, target, rate and copies.

    The sources are a stored table: Spark broadcasts it when its files are below the
    threshold and otherwise splits the hot source's side of the join.
    """
    goal = targets(sizes.select("source", "size"), **options)
    goal = goal.withColumnRenamed("source", "goal_source").drop("weight")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor("rate")
    extra = (coin(F.col("doc_id")) < F.col("rate") - whole).cast("long")
    return (
        sizes.join(goal, F.col("source").eqNullSafe(F.col("goal_source")))
        .drop("goal_source")
        .withColumn("rate", rate)
        .withColumn("copies", whole + extra)
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``docs``."""
    prepare(docs.sparkSession)
    sizes = stored(
        docs.select("doc_id", "source", words_in(F.col("text")).alias("size")), "mix-sizes"
    )
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return plan(sizes, **options).select("doc_id", "size", "source_size", "target", taken)


def emit(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, columns unchanged."""
    prepare(docs.sparkSession)
    sized = docs.select(
        F.struct("*").alias("row"), "doc_id", "source", words_in(F.col("text")).alias("size")
    )
    times = F.sequence(F.lit(1), F.col("copies").cast("int"))
    taken = plan(sized, **options).where("copies > 0")
    return taken.select("row", F.explode(times)).select("row.*")
