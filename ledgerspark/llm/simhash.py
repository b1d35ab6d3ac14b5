"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has a bit set where more than half of the shingle hashes have it. For
radius r every bit position gets a non-zero vector of r + 1 bits, and each of the
2**(r + 1) - 1 non-zero vectors v makes a mask: the positions whose vector has an odd
product with v. Any r positions span less than the whole space, so some v is orthogonal
to all of them: two fingerprints that differ in r bits or fewer agree under that mask
and meet in its table. Equal fingerprints are merged first. Within a bucket members are
linked to their local component's least member, so a bucket of n emits at most n links;
a bucket beyond ``limit`` members is dealt anew by masks over its free bits until it fits.

Defined results: null and empty texts have fingerprint zero and are linked like others;
a text of fewer words than a shingle is hashed whole; repeated rows share a component;
null ids never name a component that has another id; no rows give no rows. Columns
other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import prepare, release, stored
from ledgerspark.llm.graph import components

SHINGLE = 3
SEED = 42
RADIUS = 3
BITS = 64
LIMIT = 4096  # members of a bucket that are compared at once


def fingerprint(text: bytes, width: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of lower-cased words' shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(whole, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist())
    digest, n = xxhash.xxh64_intdigest, len(words) - width + 1
    hashes = np.fromiter((digest(whole[a:b], seed) for a, b in spans), np.uint64, n)
    # how often each byte value stands at each of the eight places, then bits of those
    places = hashes.view(np.uint8).reshape(n, 8) + np.arange(8, dtype=np.int64) * 256
    seen = np.bincount(places.ravel(), minlength=2048).reshape(8, 256)
    counts = (seen @ _BYTE_BITS).ravel()
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprints(docs: DataFrame, width: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (fingerprint((t.as_py() or "").encode(), width, seed) for t in batch.column(1))
            found = np.fromiter(texts, np.uint64, batch.num_rows).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(found)], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def cover(free: int = (1 << BITS) - 1, radius: int = RADIUS) -> list[int]:
    """Masks within ``free`` such that any ``radius`` of its bits miss one of them."""
    places = [i for i in range(BITS) if free >> i & 1]
    vectors = (1 << (radius + 1)) - 1
    masks = []
    for v in range(1, vectors + 1):
        hit = (i for j, i in enumerate(places) if (j % vectors + 1 & v).bit_count() & 1)
        masks.append(sum(1 << i for i in hit))
    return masks


def _local(members: np.ndarray, radius: int) -> np.ndarray:
    """The least member of each member's component within one bucket."""
    members = np.sort(members)
    near = np.bitwise_count((members[:, None] ^ members[None, :]).view(np.uint64)) <= radius
    root = np.full(len(members), -1)
    for i in range(len(members)):
        if root[i] >= 0:
            continue
        todo, root[i] = [i], i
        while todo:
            fresh = np.flatnonzero(near[todo].any(0) & (root < 0))
            root[fresh] = i
            todo = fresh.tolist()
    return np.stack([members, members[root]])


def _bucket_links(radius: int, limit: int):
    """Over rows (mask, key, fp) sorted by bucket: links, and rows of crowded buckets anew."""

    def out(kind: int, a, b, mask) -> pa.RecordBatch:
        n = len(a)
        cols = [np.full(n, kind, np.int32), *(np.asarray(x, np.int64) for x in (a, b, mask))]
        return pa.record_batch([pa.array(c) for c in cols], ["kind", "a", "b", "mask"])

    def again(mask: int, members: np.ndarray) -> pa.RecordBatch:
        used = mask % (1 << BITS)
        masks = np.array([m | used for m in cover(~used % (1 << BITS), radius)], np.uint64).view(np.int64)
        many = np.repeat(members, len(masks))
        return out(1, many, np.zeros(len(many)), np.tile(masks, len(members)))

    def links(members: np.ndarray) -> pa.RecordBatch:
        a, b = _local(members, radius)
        far = a != b
        return out(0, a[far], b[far], np.zeros(far.sum()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, crowded = None, [], False
        for batch in batches:
            if not batch.num_rows:
                continue
            mask, key, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            cuts = np.flatnonzero((np.diff(mask) != 0) | (np.diff(key) != 0)) + 1
            edges = [0, *cuts.tolist(), len(fp)]
            for i, j in zip(edges, edges[1:]):
                if at != (mask[i], key[i]):
                    if held and not crowded and sum(map(len, held)) > 1:
                        yield links(np.concatenate(held))
                    at, held, crowded = (mask[i], key[i]), [], False
                if crowded:
                    yield again(int(at[0]), fp[i:j])
                    continue
                held.append(fp[i:j])
                if sum(map(len, held)) > limit:
                    crowded = True
                    yield again(int(at[0]), np.concatenate(held))
                    held = []
        if held and not crowded and sum(map(len, held)) > 1:
            yield links(np.concatenate(held))

    return run


def links(prints: DataFrame, radius: int = RADIUS, limit: int = LIMIT) -> DataFrame:
    """Links (a, b) that connect distinct ``fp`` exactly as all pairs within the radius do."""
    limit = max(limit, 1 << (radius + 1))
    whole = (1 << BITS) - 1
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in cover(whole, radius)]
    rows = prints.select(F.explode(F.array(*[F.lit(m) for m in signed])).alias("mask"), "fp")
    found, crowded = [], None
    while True:
        dealt = rows.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
        dealt = dealt.repartition("mask", "key").sortWithinPartitions("mask", "key")
        scan = dealt.mapInArrow(_bucket_links(radius, limit), "kind int, a long, b long, mask long")
        step = stored(scan, "cover", "kind")
        if crowded is not None:
            release(crowded)
        found.append(step.where("kind = 0").select("a", "b"))
        crowded = step
        rest = step.where("kind = 1")
        if rest.isEmpty():
            break
        rows = rest.select("mask", F.col("a").alias("fp")).distinct()
        crowded = None
    every = found[0]
    for f in found[1:]:
        every = every.union(f)
    return every


def hexed(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def near_duplicates(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS, limit: int = LIMIT) -> DataFrame:
    """doc_id, fingerprint and component_id of every row of ``docs``."""
    prepare(docs.sparkSession)
    prints = stored(fingerprints(docs, width), "prints")
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    linked = components(links(classes.select("fp"), radius, limit))
    rooted = classes.join(linked, F.col("fp") == F.col("node"), "left")
    rooted = rooted.select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = stored(rooted.join(least, "root").select("fp", "component_id"), "components")
    return prints.join(named, "fp").select("doc_id", hexed(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows whose component has a smaller id; columns unchanged."""
    return keep_first(docs, near_duplicates(docs, **options))


def keep_first(docs: DataFrame, seen: DataFrame) -> DataFrame:
    """``docs`` without the rows whose component in ``seen`` (doc_id, component_id) has a smaller id.

    A component's first id keeps its rows, repeated ones included. Rows without an id are
    kept when some component has no id at all. The ids that go are the smaller table, so
    they are what the texts are joined with.
    """
    first = F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("first")
    gone = seen.groupBy(F.col("doc_id").alias("gone_id")).agg(first).where("not first")
    gone = stored(gone.select("gone_id"), "gone")
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_id"]), "left_anti")
