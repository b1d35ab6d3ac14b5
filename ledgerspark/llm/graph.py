"""Connected components by alternating stars (large-star, small-star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import release, stored


def _lowest(edges: DataFrame) -> DataFrame:
    """node -> least of its neighbours and itself; sums are combined before the shuffle."""
    return edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("low"))


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of ``edges`` (a, b); the root is the least node reachable.

    Every round is a stored table, so lineage stays short and a lost executor costs one
    round at most. Rounds grow with the logarithm of the nodes.
    """
    down = F.col("a") > F.col("b")
    state = stored(
        edges.where("a != b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "stars",
    )
    mark = None
    while True:
        both = state.union(state.select("b", "a"))
        large = both.join(_lowest(both), F.col("a") == F.col("node")).where("b > a")
        large = large.select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = _lowest(large)
        hung = large.join(low, F.col("a") == F.col("node"))
        small = hung.select("b", "low").union(low.select("node", "low")).toDF("a", "b")
        after = stored(small.where(down).distinct(), "stars")
        release(state)
        state = after
        now = tuple(state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    return state.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
