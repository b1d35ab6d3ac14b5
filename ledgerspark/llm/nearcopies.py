"""Near copies by SimHash, checked and completed by the exact Jaccard similarity of five-word shingle sets.

Fingerprints of five-word shingles that are equal or differ in at most ``RADIUS`` bits of
``simhash`` are linked by its covering masks; links whose sets are similar enough stay.
Texts of similarity 0.8 may differ in more bits than masks can cover, so what SimHash
leaves apart is looked for by prefixes:

two sets of similarity 4/5 or more share a member among the first n - ceil(4n/5) + 1 of
each, whatever order all sets are put in (prefix filter), so meeting at those shingles
finds every such pair and no radius or number of tables loses one. The order is by hash,
with shingles that are frequent in a sample of documents last; the sample changes how
many meet, never the result. Equal sets are merged first.

A set's sketch is the parity of its members' counts in some cells. Two sketches differ in
at most as many cells as the sets have members apart, so a pair whose sketches differ in
more than similar sets can is no pair. A narrow sketch of ``BITS`` cells goes with the rows
of crowded shingles; pairs then meet a wide one that grows with the set, and only what
passes both is compared by whole sets.

Pairs are looked for in three rounds. First each shingle's members are compared with the
least of them. Where three or more met and are not all linked, those are compared with
the member nearest to the majority of their sketches, the middle of a group of copies.
Last, members that are still in different components are compared with each other inside
their shingle's task by sketch, and only pairs that pass come out. So a group of n copies
costs n pairs and not their square. Shingles of more than ``MOST`` members are dealt in
parts, and for the last round in pairs of parts, so no task holds a crowd.

Defined results: texts without words are copies of one another; a text of fewer words
than a shingle is one shingle; null ids never name a component that has another id; no
rows give no rows. Shingles and sets are told apart by 64-bit hashes. Columns other than
doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerspark.llm.common import lean, prepare, release, stored
from ledgerspark.llm.graph import components
from ledgerspark.llm.simhash import fingerprint, keep_first
from ledgerspark.llm.simhash import links as simhash_links

SHINGLE = 5
OVER, UNDER = 4, 5  # similarity of near copies: 4/5
SEED = 42
SAMPLE = 16  # one document in so many is asked for frequent shingles
OFTEN = 8  # times that a frequent shingle is in the sample, at least
FREQUENT = 1 << 15  # shingles put last, at most
BLOCK = 1 << 15  # pairs looked at in one step
BITS = 2048  # of a narrow sketch; a wide one has four to eight cells for each member
MOST = 2048  # members of a shingle that one task compares with each other


def _hashes(text: bytes) -> np.ndarray:
    """The set as sorted hashes."""
    words = text.lower().split()
    if len(words) <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64).view(np.int64)
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    found = np.fromiter((digest(whole[a:b], SEED) for a, b in spans), np.uint64, len(words) - SHINGLE + 1)
    return np.unique(found.view(np.int64))


def _node(found: np.ndarray) -> int:
    digest = xxhash.xxh64_intdigest(found.tobytes(), SEED)
    return digest - (1 << 64) if digest >> 63 else digest


def _sketch(found: np.ndarray, bits: int) -> bytes:
    return np.packbits(np.bincount(found & (bits - 1), minlength=bits).astype(np.uint8) & 1).tobytes()


def _wide(found: np.ndarray) -> bytes:
    return _sketch(found, max(64, 4 << max(0, len(found) - 1).bit_length()))


def _words(sketches: pa.Array) -> np.ndarray:
    """A row of 64-bit words per narrow sketch."""
    return np.frombuffer(b"".join(sketches.to_pylist()), np.uint64).reshape(len(sketches), BITS // 64)


def _near(n1, words1, n2, words2):
    """Whether sets with these sketches can be similar enough: members apart are s/9 at most."""
    apart = np.bitwise_count(words1 ^ words2).sum(-1, dtype=np.int64)
    return (OVER + UNDER) * apart <= (UNDER - OVER) * (n1 + n2)


def _folded(wide: bytes, size: int) -> np.ndarray:
    """A wide sketch in ``size`` bytes: cells that fall on one another add their parities."""
    return np.bitwise_xor.reduce(np.frombuffer(wide, np.uint64).reshape(-1, size // 8), axis=0)


def _frequent(docs: DataFrame, sample: int, often: int) -> np.ndarray:
    """Frequent shingles of the sample, the most frequent last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                yield pa.record_batch([pa.array(_hashes((t.as_py() or "").encode()))], ["shingle"])

    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(sample)) == 0).select("text")
    counts = some.mapInArrow(lean(run), "shingle long").groupBy("shingle").agg(F.count("*").alias("n"))
    top = counts.where(F.col("n") >= often).orderBy(F.desc("n"), "shingle").limit(FREQUENT).collect()
    return np.array([r["shingle"] for r in reversed(top)], np.int64)


def _prefixes(docs: DataFrame, last: np.ndarray) -> DataFrame:
    """doc_id, node (the set), n (its size), both sketches, prefix (its first shingles) and fp (SimHash)."""
    by_hash = np.argsort(last)
    known = last[by_hash]

    def first(found: np.ndarray) -> np.ndarray:
        n = len(found)
        length = n - (OVER * n + UNDER - 1) // UNDER + 1 if n else 0
        if len(known):
            at = np.minimum(np.searchsorted(known, found), len(known) - 1)
            found = found[np.argsort(np.where(known[at] == found, by_hash[at] + 1, 0), kind="stable")]
        return found[:length]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [_hashes((t.as_py() or "").encode()) for t in batch.column(1)]
            cut = [first(s) for s in sets]
            ends = np.cumsum([0, *map(len, cut)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *cut])))
            nodes, sizes = pa.array(list(map(_node, sets)), pa.int64()), pa.array(list(map(len, sets)), pa.int32())
            sketches = pa.array([_sketch(s, BITS) for s in sets], pa.binary())
            wide = pa.array(list(map(_wide, sets)), pa.binary())
            prints = (fingerprint((t.as_py() or "").encode(), SHINGLE, SEED) for t in batch.column(1))
            fp = pa.array(np.fromiter(prints, np.uint64, batch.num_rows).view(np.int64))
            yield pa.record_batch([batch.column(0), nodes, sizes, sketches, wide, lists, fp], ["doc_id", "node", "n", "sketch", "wide", "prefix", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, node long, n int, sketch binary, wide binary, prefix array<long>, fp long")


def _fingerprinted(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets that SimHash links: of like fingerprints, or of fingerprints within its radius."""
    prints = stored(classes.groupBy("fp").agg(F.min("node").alias("least")), "prints")
    like = classes.select("fp", "node").join(prints, "fp").where("node != least").select("least", "node")
    near = simhash_links(prints.select("fp"))
    near = near.join(prints.toDF("a", "one"), "a").join(prints.toDF("b", "two"), "b").select("one", "two")
    pairs = stored(like.union(near).toDF("a", "b").distinct(), "fingerprinted")
    release(prints)
    return pairs


def _apart(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """The pairs that ``links`` do not connect."""
    roots = components(links)
    for side in ("a", "b"):
        named = roots.toDF(side, f"{side}_root")
        pairs = pairs.join(named, side, "left").withColumn(f"{side}_root", F.coalesce(f"{side}_root", side))
    return pairs.where("a_root != b_root").select("a", "b")


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose key, the first column, they do not have alone, of rows sorted by it."""
    held, follows = None, False  # the last row so far, and whether it is like the one before
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        same = np.diff(batch.column(0).to_numpy()) == 0
        keep = np.concatenate([[follows], same])
        keep[:-1] |= same
        held, follows = batch.slice(batch.num_rows - 1), bool(keep[-1])
        yield batch.slice(0, batch.num_rows - 1).filter(pa.array(keep[:-1]))
    if follows:
        yield held


def _met(classes: DataFrame) -> DataFrame:
    """Rows of shingles that two or more classes begin with: shingle, node, n, place, the least row ``hub``, and ``many``."""
    rows = classes.select("node", "n", F.posexplode("prefix").alias("place", "shingle")).select("shingle", "node", "n", "place")
    dealt = rows.repartition("shingle").sortWithinPartitions("shingle")
    # most shingles have one row: they go before the others are grouped
    met = dealt.mapInArrow(lean(_repeated), "shingle long, node long, n int, place int")
    same = W.partitionBy("shingle")
    row = F.struct("node", "n", "place")
    return met.withColumns({"hub": F.min(row).over(same), "many": F.count("*").over(same)})


def _may(n1, at1, n2, at2):
    """Whether sets that first meet at these places can be similar enough."""
    return (OVER + UNDER) * np.minimum(n1 - at1, n2 - at2) >= OVER * (n1 + n2)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each key, of rows sorted by it (the first column)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), batch.num_rows]
        for i, j in zip(edges, edges[1:]):
            if held and held[0].column(0)[0].as_py() != keys[i]:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            held.append(batch.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _columns(bucket: pa.RecordBatch) -> tuple:
    """node, n, place, root, part and sketch words of a bucket's rows, which have more than one root; else nothing."""
    node, n, place, root, part = (bucket.column(k).to_numpy() for k in range(1, 6))
    if (root == root[0]).all():
        return ()
    return node, n.astype(np.int64), place, root, part, _words(bucket.column(6))


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _middles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each bucket's middle with the members that may be similar and have another root."""
    for bucket in _buckets(batches):
        if not (columns := _columns(bucket)):
            continue
        node, n, place, root, _, words = columns
        bits = np.unpackbits(words.view(np.uint8), axis=1)
        usual = np.packbits(2 * bits.sum(0, dtype=np.int64) > len(node)).view(np.uint64)
        mid = int(np.bitwise_count(words ^ usual).sum(1, dtype=np.int64).argmin())
        fits = (root != root[mid]) & _may(n[mid], place[mid], n, place) & _near(n[mid], words[mid], n, words)
        yield _pairs(np.full(int(fits.sum()), node[mid]), node[fits])


def _others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each bucket that may be similar and have different roots; of two parts, one of each."""
    for bucket in _buckets(batches):
        if not (columns := _columns(bucket)):
            continue
        node, n, place, root, part, words = columns
        # the largest component is compared with the others only
        _, which, number = np.unique(root, return_inverse=True, return_counts=True)
        small = np.flatnonzero(which != number.argmax())
        two = part.min() != part.max()
        step = max(1, BLOCK // len(node))
        for k in range(0, len(small), step):
            i = small[k : k + step]
            fits = (root[i, None] != root) & _may(n[i, None], place[i, None], n, place)
            if two:
                fits &= part[i, None] != part
            x, y = np.nonzero(fits)
            near = _near(n[i[x]], words[i[x]], n[y], words[y])
            yield _pairs(node[i[x[near]]], node[y[near]])


def _unlinked(crowds: DataFrame, links: DataFrame, sketches: DataFrame) -> DataFrame:
    """Rows of crowds whose members are not all in one component, with root and sketch."""
    roots = stored(components(links), "roots")
    rooted = crowds.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).drop("many")
    rooted = stored(rooted, "rooted")
    apart = rooted.groupBy("shingle").agg(F.count("*").alias("many"), F.min("root").alias("least"), F.max("root").alias("most"))
    apart = stored(apart.where("least != most").select("shingle", F.ceil(F.col("many") / MOST).cast("int").alias("parts")), "apart")
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    rows = rooted.join(apart, "shingle").withColumn("part", part).join(sketches, "node")
    rows = stored(rows.select("shingle", "node", "n", "place", "root", "part", "sketch", "parts"), "unlinked")
    release(roots, rooted, apart)
    return rows


def _dealt(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows in buckets of ``key``, named by its hash."""
    named = rows.select(F.xxhash64(*key).alias("key"), "node", "n", "place", "root", "part", "sketch")
    return named.repartition("key").sortWithinPartitions("key")


def _candidates(rows: DataFrame, middles: bool) -> DataFrame:
    if middles:
        return _dealt(rows, ["shingle", "part"]).mapInArrow(lean(_middles), "a long, b long").distinct()
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    paired = rows.withColumn("other", other)
    key = ["shingle", "low", "high"]
    paired = paired.withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")})
    return _dealt(paired, key).mapInArrow(lean(_others), "a long, b long").distinct()


def _passing(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose wide sketches allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = []
            for n1, one, n2, two in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5))):
                size = min(len(one), len(two))
                fits.append(bool(_near(n1, _folded(one, size), n2, _folded(two, size))))
            yield batch.select([0, 1]).filter(pa.array(fits, pa.bool_()))

    sketches = classes.select("node", "n", "wide")
    left, right = sketches.toDF("a", "n1", "s1"), sketches.toDF("b", "n2", "s2")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "n1", "s1", "n2", "s2")
    return both.mapInArrow(lean(run), "a long, b long")


def _similar(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b), stored, whose sets have the similarity."""
    pairs = stored(_passing(pairs, classes), "pairs")
    nodes = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "asked")
    firsts = stored(classes.select("node", "first").join(nodes, "node").select("first").distinct(), "firsts")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [_hashes((t.as_py() or "").encode()) for t in batch.column(0)]
            ends = pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32))
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))
            yield pa.record_batch([pa.array(list(map(_node, sets)), pa.int64()), lists], ["node", "members"])

    rows = docs.join(firsts, docs["doc_id"].eqNullSafe(firsts["first"]), "left_semi").select("text")
    # an id may have other texts as well, and a set more than one text
    sets = rows.mapInArrow(lean(sets_of), "node long, members array<long>").join(nodes, "node", "left_semi")
    sets = stored(sets.dropDuplicates(["node"]), "sets")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stays = []
            for one, two in zip(batch.column(2), batch.column(3)):
                one, two = one.values.to_numpy(), two.values.to_numpy()
                both = len(np.intersect1d(one, two, assume_unique=True))
                stays.append(UNDER * both >= OVER * (len(one) + len(two) - both))
            yield batch.filter(pa.array(stays, pa.bool_())).select(["a", "b"])

    left, right = sets.toDF("a", "one"), sets.toDF("b", "two")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "one", "two")
    links = stored(both.mapInArrow(lean(compared), "a long, b long"), "links")
    release(pairs, nodes, firsts, sets)
    return links


def near_copies(docs: DataFrame, sample: int = SAMPLE, often: int = OFTEN) -> DataFrame:
    """doc_id and component_id of every row of ``docs``."""
    prepare(docs.sparkSession)
    prints = stored(_prefixes(docs, _frequent(docs, sample, often)), "prefixes")
    ids = stored(prints.select("doc_id", "node"), "ids")
    columns = [F.first(c).alias(c) for c in ("n", "sketch", "wide", "prefix")]
    # texts of one set may differ in their fingerprints, which count repeats
    columns.append(F.min("fp").alias("fp"))
    classes = stored(prints.groupBy("node").agg(F.min("doc_id").alias("first"), *columns), "classes")
    release(prints)
    asked = _fingerprinted(classes)
    links = [_similar(asked, docs, classes)]
    release(asked)
    sketches = classes.select("node", "sketch")
    met = stored(_met(classes), "met")
    fits = (OVER + UNDER) * F.least(F.col("n") - F.col("place"), F.col("hub.n") - F.col("hub.place")) >= OVER * (F.col("n") + F.col("hub.n"))
    pairs = met.where((F.col("node") != F.col("hub.node")) & fits).select(F.col("hub.node").alias("a"), F.col("node").alias("b")).distinct()
    links.append(_similar(_apart(pairs, links[0]), docs, classes))
    crowds = met.where("many > 2").select("shingle", "node", "n", "place", "many")
    for middles in (True, False):
        rows = _unlinked(crowds, reduce(DataFrame.union, links), sketches)
        links.append(_similar(_candidates(rows, middles), docs, classes))
        release(rows)
    linked = stored(components(reduce(DataFrame.union, links)), "linked")
    release(met, *links)
    rooted = classes.join(linked, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = stored(rooted.join(least, "root").select("node", "component_id"), "named")
    release(classes, linked)
    return ids.join(named, "node").select("doc_id", "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows whose component has a smaller id; columns unchanged."""
    return keep_first(docs, near_copies(docs, **options))
