"""Merkle manifest of a table: nested structs rolled up digit by digit, proofs unrolled again.

A row is a leaf: the hash of its columns. Leaves are numbered per tree (language) in the
order of their ids, by range-sorted files, so a tree of any size is spread over many
tasks. The last binary digits of a number become columns, and rows are dealt to blocks of
2 ** ``DIGITS`` by the digits before them. Grouping the digit columns away one after the
other, in the block's own task and without another shuffle, hashes two nodes into one and
nests their structs in it. Blocks' hashes are the leaves of the next round, until each
tree has one node; trees' roots, ordered by name, are the leaves of the last tree.

Downwards a round's blocks are grouped with the paths that the round above found for them;
one transform walks the nested structs with the path so far and an explode emits a path
per leaf. No task holds more than blocks, and no join is needed: only the numbering joins
with its files' offsets.

Defined results: H is lower-case hex SHA-256. A null is ``-``, any other value its UTF-8
byte count, ``:`` and itself. Null languages are a tree of their own, the first one; null
ids come first; equal ids go by their leaf hash, so repeated rows are leaves side by side;
a single leaf is its tree's root; an empty table gives no rows. A null id is never
tampered with. Columns other than the five named are not read.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import prepare, stored
from ledgerspark.operators.numbering import numbered_in_order
from ledgerspark.session import shared_folder

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
DIGITS = 6  # a block has 64 leaves at most
STEP = "array<struct<side:string,hash:string>>"


def leaf(**changed: Column) -> Column:
    """Hash of a row; ``changed`` gives other values for some columns."""
    parts = []
    for name in COLUMNS:
        value = changed.get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(
        proof,
        start,
        lambda node, step: F.sha2(
            F.when(step["side"] == "left", F.concat(step["hash"], node))
            .when(step["side"] == "right", F.concat(node, step["hash"]))
            .otherwise(node),
            256,
        ),
    )


def _rolled(nodes: DataFrame) -> DataFrame:
    """tree, size, block, hash and the nested ``kids`` of each block of nodes (tree, size, place, hash, item)."""
    digits = [f"digit{k}" for k in range(DIGITS)]
    rows = nodes.select(
        "tree", "size", F.shiftright("place", DIGITS).alias("block"), "hash", "item",
        *[F.shiftright("place", k).bitwiseAND(F.lit(1)).cast("int").alias(d) for k, d in enumerate(digits)],
    )
    rows = rows.repartition("tree", "block")
    inner = ["hash", "item"]
    for k, digit in enumerate(digits):
        kids = F.sort_array(F.collect_list(F.struct(digit, *inner)))
        rows = rows.groupBy("tree", "size", "block", *digits[k + 1 :]).agg(kids.alias("kids"))
        # a tree that has one node left stays as it is
        joined = F.when(F.col("size") > 1 << k, F.sha2(F.array_join("kids.hash", ""), 256))
        rows = rows.withColumn("hash", joined.otherwise(F.col("kids")[0]["hash"]))
        inner = ["hash", "kids"]
    return rows


def _paths(kids: Column, size: Column, path: Column, level: int = DIGITS - 1) -> Column:
    """Array of (item, hash, path) of all leaves below ``kids``."""

    def below(kid: Column, place: Column) -> Column:
        two = F.size(kids) > 1
        side = F.when(two & (place == 0), "right").when(two, "left").otherwise("none")
        step = F.struct(side.alias("side"), F.when(two, F.get(kids, 1 - place)["hash"]).alias("hash"))
        onward = F.when(size > 1 << level, F.concat(F.array(step), path)).otherwise(path)
        if not level:
            return F.array(F.struct(kid["item"].alias("item"), kid["hash"].alias("hash"), onward.alias("path")))
        return _paths(kid["kids"], size, onward, level - 1)

    return F.flatten(F.transform(kids, below))


def _up(nodes: DataFrame) -> list[DataFrame]:
    """Stored rounds of blocks, the last with one block per tree."""
    rounds = []
    while True:
        rounds.append(stored(_rolled(nodes), "merkle-blocks"))
        if (rounds[-1].agg(F.max("size")).first()[0] or 0) <= 1 << DIGITS:
            return rounds
        place = F.col("block")
        size = F.shiftright(F.col("size") + ((1 << DIGITS) - 1), DIGITS)
        nodes = rounds[-1].select("tree", size.alias("size"), place.alias("place"), "hash", place.alias("item"))


def _down(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """tree, item, hash, path and given of every leaf; ``above`` has tree, path and given per tree."""
    above = above.withColumn("item", F.lit(0).cast("long"))
    for blocks in reversed(rounds):
        held = blocks.select("tree", F.col("block").alias("item"), F.struct("kids", "size").alias("held"))
        known = above.select("tree", "item", F.struct("path", "given").alias("known"))
        both = held.unionByName(known, allowMissingColumns=True).groupBy("tree", "item")
        both = both.agg(F.first("held", True).alias("held"), F.first("known", True).alias("known"))
        found = _paths(F.col("held.kids"), F.col("held.size"), F.col("known.path"))
        one = both.select("tree", F.col("known.given").alias("given"), F.explode(found).alias("one"))
        above = one.select("tree", "given", "one.*")
    return above


def _numbered(rows: DataFrame, order: list[str], per: list[str]) -> DataFrame:
    path = f"{shared_folder(rows.sparkSession)}/llm/merkle-{uuid4().hex}"
    return numbered_in_order(rows, path, order, rows.columns, "place", per).withColumn("place", F.col("place") - 1)


def manifest(docs: DataFrame, also: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof (side and hash per level, from the leaf) and the
    columns of ``also`` for every row of ``docs``."""
    prepare(docs.sparkSession)
    named = [c.alias(n) for n, c in (also or {}).items()]
    # names of trees that sort as null first, then bytewise
    tree = F.coalesce(F.concat(F.lit("1"), "lang"), F.lit("0")).alias("tree")
    leaves = stored(docs.select("doc_id", tree, leaf().alias("leaf"), F.struct("doc_id", *named).alias("item")), "leaves")
    numbered = _numbered(leaves, ["tree", "doc_id", "leaf"], ["tree"])
    sizes = stored(leaves.groupBy("tree").agg(F.count("*").alias("size")), "merkle-trees")
    nodes = numbered.join(sizes, "tree").select("tree", "size", "place", F.col("leaf").alias("hash"), "item")
    trees = _up(nodes)
    roots = _numbered(trees[-1].select(F.col("tree").alias("name"), "hash"), ["name"], [])
    size = F.lit(sizes.count())
    whole = _up(roots.select(F.lit("").alias("tree"), size.alias("size"), "place", "hash", F.col("name").alias("item")))
    top = whole[-1].select("tree", F.array().cast(STEP).alias("path"), F.struct(F.col("hash").alias("root")).alias("given"))
    named_roots = _down(whole, top).select(
        F.col("item").alias("tree"), "path", F.struct(F.col("hash").alias("subroot"), F.col("given.root").alias("root")).alias("given")
    )
    return _down(trees, named_roots).select("item.doc_id", F.col("hash").alias("leaf"), "given.*", F.col("path").alias("proof"), *[f"item.{n}" for n in also or {}])


def tampered(doc_id: Column) -> Column:
    """Whether a row's n_chars is tampered with: 7 divides the crc32 of its id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0, F.lit(False))


def verify(docs: DataFrame) -> DataFrame:
    """Roots and proofs of the rows as they are, and what the tampered rows lead to."""
    changed = F.when(tampered(F.col("doc_id")) & F.col("n_chars").isNotNull(), leaf(n_chars=F.col("n_chars") + 1))
    found = manifest(docs, {"changed": changed})
    folded = found.withColumn("folded_root", fold(F.coalesce("changed", "leaf"), F.col("proof")))
    return folded.select(
        "doc_id", "leaf", "subroot", "root",
        F.sha2(F.array_join("proof.hash", ""), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
