"""Balanced label propagation into shards, by DataFrame functions alone.

Documents of one class (equal texts, or any key that links them) are neighbours. They
start in hash-dealt shards; in every round a class sums its bytes per shard, each member
outside the heaviest shard wants to go there, and a share of those who want is let
through, so that no shard passes its quota: swaps first, then free room. Documents
without neighbours fill the room that is left, large ones first, by exact running sums,
which keeps the shards' bytes equal to within a small document; a class larger than a
shard is cut at the quota and its rest fills up like the others.

The sizes obey the law ``bytes``. Defined results: a null text has no bytes and is in a
class with the empty ones; rows of one id and text go together or not by the same
draw; ties take the lowest shard; an empty table gives no rows. Extra columns are not
read. Running sums go by 4,096 hash buckets of the id, so no window holds a whole shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerspark.llm.common import prepare, release, stored

SHARDS = 8
ROUNDS = 4
SPREAD = 4096  # buckets of a running sum
TIERS = (4.0, 0.25)  # times the mean size: large, middle and small documents


def _running(df: DataFrame, keys: list[str], order: list[str], value: Column) -> DataFrame:
    """Add ``before``: the sum of ``value`` over earlier rows of the same keys.

    A hash bucket is a stretch of the order; bucket totals give each stretch its start.
    """
    df = df.withColumn("value", value).withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(SPREAD)))
    at = [*keys, "bucket"]
    totals = df.groupBy(*at).agg(F.sum("value").alias("in_bucket"))
    earlier = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    earlier = earlier.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(*at, F.coalesce(F.sum("in_bucket").over(earlier), F.lit(0)).alias("start"))
    own = W.partitionBy(*at).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    within = df.withColumn("before_own", F.coalesce(F.sum("value").over(own), F.lit(0)))
    return (
        within.join(starts, at)
        .withColumn("before", F.col("start") + F.col("before_own"))
        .drop("start", "before_own", "bucket", "value")
    )


def _draw(salt: str) -> Column:
    """Uniform in [0, 1) from the row and a salt."""
    return F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit(salt)), F.lit(1 << 30)) / F.lit(1 << 30)


def _loads(df: DataFrame, shards: int) -> list[int]:
    found = {r["shard"]: r["n"] for r in df.groupBy("shard").agg(F.sum("size").alias("n")).collect()}
    return [found.get(k) or 0 for k in range(shards)]


def propagate(linked: DataFrame, shards: int, quota: float, rounds: int = ROUNDS) -> DataFrame:
    """Rounds of moves over ``linked`` (class, size, shard, ...); returns it with new shards.

    What is let through from one shard to another is the smaller of both directions'
    wishes plus the target's free room, shared by wish; the sums are shards squared rows.
    """
    state = linked
    for k in range(rounds):
        masses = state.groupBy("class", "shard").agg(F.sum("size").alias("mass"))
        best = F.max(F.struct("mass", (-F.col("shard")).alias("low"))).alias("best")
        wish = masses.groupBy("class").agg(best).select("class", (-F.col("best.low")).alias("wish"))
        moved = state.join(stored(wish, "shard-wish"), "class")
        asked = {
            (r["shard"], r["wish"]): r["n"]
            for r in moved.where("shard != wish").groupBy("shard", "wish").agg(F.sum("size").alias("n")).collect()
        }
        if not asked:
            break
        loads = _loads(state, shards)
        room = [max(0.0, quota - x) for x in loads]
        towards = [sum(n for (_, b), n in asked.items() if b == t) for t in range(shards)]
        share = {
            (a, b): min(1.0, (min(n, asked.get((b, a), 0)) + room[b] * n / towards[b]) / n)
            for (a, b), n in asked.items()
        }
        cells = [F.lit(float(share.get((a, b), 0.0))) for a in range(shards) for b in range(shards)]
        chance = F.element_at(F.array(*cells), (F.col("shard") * shards + F.col("wish") + 1).cast("int"))
        goes = (F.col("shard") != F.col("wish")) & (_draw(f"round-{k}") < chance)
        after = stored(
            moved.withColumn("shard", F.when(goes, F.col("wish")).otherwise(F.col("shard"))).drop("wish"),
            "shard-round",
        )
        if state is not linked:
            release(state)
        state = after
    return state


def _fill(pool: DataFrame, loads: list[int], full: float, last: bool) -> DataFrame:
    """Deal ``pool`` to the shards' free room by running sums of size."""
    pool = pool.drop("shard")
    total = pool.agg(F.sum("size")).first()[0] or 0
    room = [max(0.0, full - x) for x in loads]
    scale = 1.0 if last and sum(room) >= total else total / (sum(room) or 1.0)
    ends, at = [], 0.0
    for r in room:
        at += r * scale
        ends.append(at)
    middle = F.col("before") + F.col("size") / 2
    shard = sum(((middle >= F.lit(float(e))).cast("int") for e in ends[:-1]), F.lit(0))
    return _running(pool, [], ["doc_id", "text_crc32", "size"], F.col("size")).withColumn("shard", shard).drop("before")


def assign(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, class and shard of every row."""
    prepare(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    nodes = stored(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.sha2(text, 256).alias("class"),
        ),
        "shard-nodes",
    )
    s = nodes.agg(F.sum("size").alias("total"), F.count("*").alias("n")).first()
    total, n = s["total"] or 0, s["n"] or 1
    full = total / shards
    counts = nodes.groupBy("class").agg(F.count("*").alias("members")).where("members > 1")
    known = stored(nodes.join(stored(counts, "shard-classes"), "class", "left"), "shard-known")
    linked = stored(
        known.where("members > 1")
        .drop("members")
        .withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit("start")), F.lit(shards)).cast("int")),
        "shard-linked",
    )
    state = propagate(linked, shards, full, rounds)
    running = _running(state, ["shard"], ["class", "doc_id", "size"], F.col("size"))
    placed = stored(
        running.withColumn("over", F.col("before") + F.col("size") > F.lit(full)).drop("before"),
        "shard-placed",
    )
    done = [placed.where("not over").drop("over")]
    pool = known.where("members is null").drop("members").unionByName(placed.where("over").drop("over", "shard"))
    mean = total / n
    ratio = F.col("size") / F.lit(mean)
    bounds = [float("inf"), *TIERS, 0.0]
    for k, (top, low) in enumerate(zip(bounds, bounds[1:])):
        last = k == len(TIERS)
        loads = [sum(x) for x in zip(*(_loads(d, shards) for d in done))]
        tier = pool.where((ratio <= top) & (ratio > low)) if k else pool.where(ratio > low)
        done.append(stored(_fill(tier, loads, full, last), "shard-tier"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; slots are gapless from 0."""
    placed = assign(docs, shards, rounds)
    order = ["doc_id", "text_crc32", "size"]
    return _running(placed, ["shard"], order, F.lit(1)).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("before").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def cut(placed: DataFrame) -> DataFrame:
    """Members outside their class's heaviest shard, and all linked members: one row."""
    sums = placed.groupBy("class", "shard").agg(F.count("*").alias("n"))
    per = sums.groupBy("class").agg(F.sum("n").alias("members"), F.max("n").alias("together"))
    per = per.where("members > 1")
    return per.agg(
        F.coalesce(F.sum(F.col("members") - F.col("together")), F.lit(0)).alias("apart"),
        F.coalesce(F.sum("members"), F.lit(0)).alias("linked"),
    )
