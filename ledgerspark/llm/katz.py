"""Katz backoff language model over words: learnt, stored and evaluated in partitions.

Tokens are lower-cased words and one end per text; a word's history is the word before it
(a start sign for the first). Counts r <= ``K`` are discounted by Good-Turing, at either
order from its own counts of counts. A seen pair has P(w|v) = d(r) r / c(v); what is left
of a history goes to the words not seen after it, in proportion to P(w): alpha(v) = left(v)
/ (1 - sum of P(w) over words seen after v), so each history sums to one exactly. A single
unknown word takes what the discount leaves of the words. A history whose pairs all have
large counts keeps 1 / (c + 1) back.

Words are known by 64-bit hashes of their bytes, pairs by a 64-bit hash of two of those.
Everything counted is stored by bucket. Words above a count that at most ``HEAD_WORDS``
words reach, and pairs likewise, are sent to every task (a fixed size), which answers most
tokens on the spot and takes the frequent ones, the hot keys, out of the shuffle; all
others are asked of their bucket. A pair's bucket hangs on the rarer thing: on w when w is
rare, so that P(w) is there as well, otherwise on both words.

A score is the sum over tokens of log10 d(r) r for pairs seen, plus log10 of 1/c(v) for
every history, plus, for pairs not seen, log10 alpha(v) c(v) + log10 P(w).

Defined results: null and empty texts are their end token alone; rows without an id are
learnt from; rows that repeat an id are scored each by its text; without training rows
every probability is that of the unknown word, which is one; an empty table gives no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import held_out, prepare, release, stored
from ledgerspark.llm.words import LOWER, hashes, mixed, raw, split, stretches

K = 5
HEAD_WORDS = 1 << 18
HEAD_PAIRS = 1 << 20
SHARE = 6_000_000  # bytes of text for each bucket of the model
FLUSH = 800_000  # pairs that a task gathers before it sends blocks
STEPS = 4  # parts of a doubling in count histograms
END = np.uint64(0x6C62272E07BB0142)
START = np.uint64(0xCBF29CE484222325)
WORDS, PAIRS, SUMS, SHAPE, ASK, OWN = range(6)


def sequence(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """History, word and text of every token."""
    low = LOWER[data]
    starts, stops, text = split(low, ends)
    n = np.bincount(text, minlength=len(ends) - 1)
    last = np.cumsum(n + 1) - 1
    w = np.empty(len(starts) + len(n), np.uint64)
    inner = np.ones(len(w), bool)
    inner[last] = False
    w[inner], w[last] = hashes(low, starts, stops), END
    v = np.append(START, w[:-1])
    v[last - n] = START
    return v, w, np.repeat(np.arange(len(n)), n + 1)


def pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(v * np.uint64(0x9E3779B97F4A7C15) + (w ^ (w >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F))


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys with the sums of their values, and where each first stood."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    firsts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return (keys[firsts], *(np.add.reduceat(x[order], firsts) if len(keys) else x for x in values), order[firsts])


def find(sorted_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key, or -1."""
    if not len(sorted_):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(sorted_, keys), len(sorted_) - 1)
    return np.where(sorted_[at] == keys, at, -1)


def take(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Values at places; 0 where the place is -1."""
    return np.where(at >= 0, values[at], 0) if len(values) else np.zeros(len(at), values.dtype)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed block."""
    head = b"".join(struct.pack("<3sI", a.dtype.str.encode(), len(a)) for a in arrays)
    body = b"".join(a.tobytes() for a in arrays)
    return struct.pack("<BI", len(arrays), len(body)) + head + pa.compress(body, "zstd", asbytes=True)


def unpack(block: bytes) -> list[np.ndarray]:
    n, size = struct.unpack_from("<BI", block)
    kinds = [struct.unpack_from("<3sI", block, 5 + 7 * k) for k in range(n)]
    body, at, out = pa.decompress(block[5 + 7 * n :], size, "zstd", asbytes=True), 0, []
    for kind, count in kinds:
        out.append(np.frombuffer(body, kind.decode(), count, at))
        at += out[-1].nbytes
    return out


class Discount:
    """Good-Turing discounts of one order, from the counts of counts 1 to K + 1."""

    def __init__(self, of_count: list[int]):
        n = [0, *of_count]
        self.d = np.ones(K + 2)
        cut = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
        for r in range(1, K + 1):
            star = (r + 1) * n[r + 1] / n[r] / r if n[r] else 0.0
            self.d[r] = (star - cut) / (1 - cut) if cut < 1 else 0.0
        if not ((self.d[1 : K + 1] > 0) & (self.d[1 : K + 1] < 1)).all():
            # counts of counts too few to trust: take the same off every count instead
            off = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
            self.d[1 : K + 1] = 1 - off / np.arange(1, K + 1)

    def kept(self, r: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        return self.d[np.minimum(r, K + 1)] * r


class Words:
    """Discounted word probabilities, and the frequent words with what is known of them."""

    def __init__(self, of_count: list[int], total: int, distinct: int):
        self.discount, self.total, self.distinct = Discount(of_count), total, distinct
        lost = sum(n * (r - self.discount.d[r] * r) for r, n in enumerate(of_count[:K], 1))
        self.all = total if lost > 0 else total + 1
        self.unknown = (lost if lost > 0 else 1) / self.all
        self.w, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.g = self.a = np.zeros(0)

    def p(self, n: np.ndarray) -> np.ndarray:
        """P(w) of words counted ``n`` times; 0: the unknown word."""
        return np.where(n > 0, self.discount.kept(n) / self.all, self.unknown)

    def base(self, n: np.ndarray) -> np.ndarray:
        return np.log10((n + 0.1) / (self.total + 0.1 * (self.distinct + 1)))

    def bucket(self, v: np.ndarray, w: np.ndarray, common: np.ndarray, buckets: int) -> np.ndarray:
        return (np.where(common, pair(w, v), mixed(w)) % np.uint64(buckets)).astype(np.int64)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of a stretch with its bytes and ends; the text is the last column."""
    for batch in batches:
        data, ends = raw(batch.column(batch.num_columns - 1))
        for a, b in stretches(ends):
            yield batch.slice(a, b - a), data[ends[a] : ends[b]], ends[a : b + 1] - ends[a]


def _batches(names: list[str], *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(columns[0]), 1 << 17):
        yield pa.record_batch([pa.array(c[k : k + (1 << 17)]) for c in columns], names)


def count_words(texts: DataFrame) -> DataFrame:
    """w, n over the whole of ``texts``; tasks add up before the shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, data, ends in _stretches(batches):
            w = sequence(data, ends)[1]
            held.append(summed(w, np.ones(len(w), np.int64))[:2])
            size += len(held[-1][0])
            if size > FLUSH:
                held = [summed(*(np.concatenate(x) for x in zip(*held)))[:2]]
                size = len(held[0][0])
                if size > FLUSH:
                    yield from _batches(["w", "n"], held[0][0].view(np.int64), held[0][1])
                    held, size = [], 0
        if held:
            w, n, _ = summed(*(np.concatenate(x) for x in zip(*held)))
            yield from _batches(["w", "n"], w.view(np.int64), n)

    return texts.select("text").mapInArrow(work, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))


def _level(n: Column) -> Column:
    return F.floor(F.log2(n) * STEPS + 1e-9)


def _least_level(sizes: dict[int, int], most: int) -> int:
    """The lowest level of counts such that no more than ``most`` things lie at or above it."""
    total, level = 0, max(sizes, default=0) + 1
    for k in sorted(sizes, reverse=True):
        total += sizes[k]
        if total > most:
            break
        level = k
    return level


def _send(held: list, buckets: np.ndarray, kind: int, make: Callable) -> Iterator[pa.RecordBatch]:
    """One block per bucket: ``make`` gets the rows of a bucket."""
    order = np.argsort(buckets, kind="stable")
    own = buckets[order]
    cuts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    blocks = [make(*(x[order[i:j]] for x in held)) for i, j in zip(cuts, np.append(cuts[1:], len(own)))]
    yield pa.record_batch(
        [pa.array(own[cuts].astype(np.int32)), pa.array([kind] * len(cuts), pa.int32()), pa.array(blocks, pa.binary())],
        ["bucket", "kind", "block"],
    )


def _blocks_of_words(table: DataFrame, buckets: int, columns: list[str]) -> DataFrame:
    """Rare words as blocks of their buckets."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                w, *rest = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
                at = (mixed(w.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
                yield from _send([w, *rest], at, WORDS, pack)

    return table.select("w", *columns).mapInArrow(work, "bucket int, kind int, block binary")


def _pairs_sent(texts: DataFrame, words: Words, buckets: int) -> DataFrame:
    """Pair counts of training texts as blocks: history, word (or its place among the frequent), count."""

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        v, w, n = (np.concatenate(x) for x in zip(*held))
        _, n, first = summed(pair(v, w), n)
        v, w = v[first], w[first]
        order = np.argsort(v)
        v, w, n = v[order], w[order], n[order]
        place = find(words.w, w)
        at = words.bucket(v, w, place >= 0, buckets)

        def block(v, w, n, place):
            common = place >= 0
            return pack(np.diff(v[common], prepend=np.uint64(0)), place[common].astype("<u4"), n[common].astype("<u4"), v[~common], w[~common], n[~common].astype("<u4"))

        yield from _send([v, w, n, place], at, PAIRS, block)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, data, ends in _stretches(batches):
            v, w, _ = sequence(data, ends)
            _, n, first = summed(pair(v, w), np.ones(len(v), np.int64))
            held.append((v[first], w[first], n))
            size += len(first)
            if size > FLUSH:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    return texts.select("text").mapInArrow(work, "bucket int, kind int, block binary")


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes | None, pa.RecordBatch, int]]:
    for batch in batches:
        kinds, buckets = batch.column(1).to_pylist(), batch.column(0).to_pylist()
        for i, (b, k) in enumerate(zip(buckets, kinds)):
            yield b, k, batch.column(2)[i].as_py(), batch, i


def _tail(blocks: list[list[np.ndarray]], columns: int) -> list[np.ndarray]:
    """Rare words of a bucket, sorted by hash."""
    if not blocks:
        return [np.zeros(0, np.uint64), np.zeros(0, np.int64), *[np.zeros(0)] * (columns - 1)]
    w, *rest = (np.concatenate(x) for x in zip(*blocks))
    w = w.view(np.uint64)
    order = np.argsort(w)
    return [w[order], *(x[order] for x in rest)]


COUNTED = "kind int, bucket int, block binary, v long, r int, types long, low double"


def _pairs_counted(words: Words):
    """Per bucket: a block of pair counts; per history and count r the types and their P(w)."""

    def out(kind: int, v, r, types, low, bucket: int = 0, block: bytes | None = None) -> pa.RecordBatch:
        n = len(v)
        return pa.record_batch(
            [
                pa.array([kind] * n, pa.int32()), pa.array([bucket] * n, pa.int32()), pa.array([block] * n, pa.binary()),
                pa.array(v.astype(np.int64)), pa.array(r.astype(np.int32)), pa.array(types.astype(np.int64)), pa.array(low.astype(float)),
            ],
            [c.split()[0] for c in COUNTED.split(", ")],
        )

    def finish(bucket: int, rare: list, parts: list) -> Iterator[pa.RecordBatch]:
        if not parts:
            return
        tail_w, tail_n = _tail(rare, 1)
        vs, ws, ns, ps = [], [], [], []
        for dv, place, n, v2, w2, n2 in parts:
            v = np.cumsum(dv, dtype=np.uint64)
            at = find(tail_w, w2)
            vs += [v, v2]
            ws += [words.w[place], w2]
            ns += [n, n2]
            ps += [words.p(words.n[place]), words.p(take(tail_n, at))]
        v, w, n, p = (np.concatenate(x) for x in (vs, ws, ns, ps))
        key, n, first = summed(pair(v, w), n.astype(np.int64))
        v, p = v[first], p[first]
        zero = np.zeros(1, np.int64)
        yield out(PAIRS, zero, zero, zero, zero, bucket, pack(np.diff(key, prepend=np.uint64(0)), n.astype("<u4")))
        level = np.floor(np.log2(n) * STEPS + 1e-9).astype(np.int64)
        for code, x in ((0, np.minimum(n, K + 2)), (1, level)):
            seen = np.bincount(x)
            has = np.flatnonzero(seen)
            yield out(SHAPE, np.full(len(has), code), has, seen[has], np.zeros(len(has)))
        r = np.where(n > K, 0, n)
        order = np.lexsort((r, v))
        v, r, p = v[order], r[order], p[order]
        first = np.flatnonzero(np.append(True, (v[1:] != v[:-1]) | (r[1:] != r[:-1])))
        types = np.diff(np.append(first, len(v)))
        low = np.add.reduceat(p, first)
        v, r = v[first].view(np.int64), r[first]
        for k in range(0, len(v), 1 << 17):
            s = slice(k, k + (1 << 17))
            yield out(SUMS, v[s], r[s], types[s], low[s])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rare, parts = None, [], []
        for bucket, kind, block, _, _ in _grouped(batches):
            if bucket != at:
                yield from finish(at, rare, parts)
                at, rare, parts = bucket, [], []
            (rare if kind == WORDS else parts).append(unpack(block))
        yield from finish(at, rare, parts)

    return work


class Shared:
    """What every task gets of a model: arrays of a fixed size."""

    def __init__(self, words: Words, discount: Discount, buckets: int, head_pairs: np.ndarray, head_counts: np.ndarray):
        self.words, self.discount, self.buckets = words, discount, buckets
        self.head_pairs, self.head_counts = head_pairs, head_counts


class Model:
    """A fitted model: the shared part, and the tables of rare words and of all pairs."""

    def __init__(self, shared: Shared, table: DataFrame, pairs: DataFrame):
        self.shared, self.table, self.pairs = shared, table, pairs


def fit(texts: DataFrame) -> Model:
    """Model of the column ``text``, from all of its rows."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // SHARE))
    counts = stored(count_words(texts), "unigrams")
    s = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *[F.count_if(F.col("n") == r).alias(f"n{r}") for r in range(1, K + 2)]).first()
    words = Words([s[f"n{r}"] for r in range(1, K + 2)], s["n"], s["v"])
    levels = {r["level"]: r["count"] for r in counts.groupBy(_level(F.col("n")).alias("level")).count().collect()}
    low = _least_level(levels, HEAD_WORDS)
    common = _level(F.col("n")) >= low
    end = int(END.view(np.int64))
    frequent = counts.where(common | (F.col("w") == end)).select("w", "n").toArrow()  # HEAD_WORDS + 1 rows at most
    w, n = (frequent.column(k).to_numpy() for k in range(2))
    order = np.argsort(w.view(np.uint64))
    words.w, words.n = w.view(np.uint64)[order], n[order]
    rare = counts.where(~common & (F.col("w") != end))
    sent = _blocks_of_words(rare, buckets, ["n"]).union(_pairs_sent(texts, words, buckets))
    dealt = sent.repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind")
    counted = stored(dealt.mapInArrow(_pairs_counted(words), COUNTED), "pairs", "kind")
    shape = counted.where(F.col("kind") == SHAPE).groupBy("v", "r").agg(F.sum("types").alias("n")).collect()
    of = {r["r"]: r["n"] for r in shape if r["v"] == 0}
    discount = Discount([of.get(r, 0) for r in range(1, K + 2)])
    sums = counted.where(F.col("kind") == SUMS).groupBy("v").agg(
        *[F.sum(F.when(F.col("r") == r, F.col("types")).otherwise(0)).alias(f"t{r}") for r in range(1, K + 1)],
        F.sum("low").alias("low"),
    )
    c = F.when(F.col("w") == int(START.view(np.int64)), F.lit(int(n[w == end][0]) if len(n) else 0)).otherwise(F.col("n"))
    lost = sum((F.col(f"t{r}") * float(r - discount.d[r] * r) for r in range(1, K + 1)), F.lit(0.0))
    histories = sums.select(F.col("v").alias("w"), lost.alias("lost"), "low")
    joined = counts.join(histories, "w", "full").withColumn("c", c.cast("double"))
    whole = F.when(F.col("lost") > 0, F.col("c")).otherwise(F.col("c") + 1)
    left = F.when(F.col("lost") > 0, F.col("lost")).otherwise(1.0) / whole
    table = stored(
        joined.select(
            "w",
            F.coalesce("n", F.lit(0)).alias("n"),
            F.when(F.col("low").isNull(), 0.0).otherwise(-F.log10(whole)).alias("g"),
            F.when(F.col("low").isNull(), 0.0).otherwise(F.log10(left) - F.log10(F.greatest(1 - F.col("low"), F.lit(float(words.unknown) * 0.5)))).alias("a"),
        ),
        "words",
    )
    head = table.where((_level(F.greatest("n", F.lit(1))) >= low) & (F.col("n") > 0) | F.col("w").isin(end, int(START.view(np.int64)))).toArrow()
    w, n, g, a = (head.column(k).to_numpy() for k in range(4))
    order = np.argsort(w.view(np.uint64))
    words.w, words.n, words.g, words.a = w.view(np.uint64)[order], n[order], g[order], a[order]
    release(counts)
    release(counted, part=f"kind={SUMS}")
    pairs = counted.where(F.col("kind") == PAIRS).select("bucket", "kind", "block")
    level = _least_level({r["r"]: r["n"] for r in shape if r["v"] == 1}, HEAD_PAIRS)

    def frequent_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0):
                key, n = unpack(block.as_py())
                good = np.floor(np.log2(n) * STEPS + 1e-9) >= level
                yield from _batches(["key", "n"], np.cumsum(key, dtype=np.uint64)[good].view(np.int64), n[good].astype(np.int64))

    top = pairs.select("block").mapInArrow(frequent_pairs, "key long, n long").toArrow()  # HEAD_PAIRS rows at most
    key, n = (top.column(k).to_numpy() for k in range(2))
    order = np.argsort(key.view(np.uint64))
    shared = Shared(words, discount, buckets, key.view(np.uint64)[order], n[order])
    tail = (_level(F.greatest("n", F.lit(1))) < low) & (F.col("n") > 0) & (F.col("w") != end)
    return Model(shared, table.where(tail), pairs)


ASKED = "bucket int, kind int, block binary, row long, doc_id {id}, held_out boolean, n_tokens long, n_known long, base double, score double"
ANSWERED = "row long, doc_id {id}, held_out boolean, n_tokens long, n_known long, base double, score double, v long, block binary"
SUMMED = "row long, n_known long, base double, score double"


def _questions(model: Shared, schema: str):
    """Per text what the frequent words and pairs tell, and blocks of questions on the rest."""
    words, buckets = model.words, model.buckets
    names = [c.split()[0] for c in schema.split(", ")]

    def ask(held: list) -> Iterator[pa.RecordBatch]:
        at, row, v, w, what = (np.concatenate(x) for x in zip(*held))
        origin = row.min(keepdims=True)  # these texts are asked for together, and nowhere else

        def block(row, v, w, what):
            rows, which = np.unique(row, return_inverse=True)
            parts = []
            for k in range(3):  # rare words; pairs of training texts; pairs of held-out texts
                own = what == k
                first = pair(v[own], w[own]) if k == 1 else w[own]
                parts += [which[own].astype("<u4"), first, *([v[own]] if k == 2 else [])]
            return pack(origin, np.diff(rows, prepend=0), *parts)

        for b in _send([row, v, w, what], at, ASK, block):
            n = b.num_rows
            nulls = [pa.nulls(n, t) for t in (pa.int64(), *kinds[4:])]
            yield pa.record_batch([*b.columns, *nulls], names)

    kinds: list = []

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch, data, ends in _stretches(batches):
            if not batch.num_rows:
                continue
            kinds[:] = [None] * 4 + [batch.column(1).type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            v, w, text = sequence(data, ends)
            m = batch.num_rows
            held_rows = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            row = batch.column(0).to_numpy()
            place = find(words.w, w)
            common = place >= 0
            total = lambda x, of: np.bincount(of, x, m).astype(float)
            n = words.n[place[common]]
            base = total(words.base(n), text[common])
            known = total((n > 0).astype(float), text[common])
            before = find(words.w, v)
            own = before >= 0
            score = total(words.g[before[own]], text[own])
            top = find(model.head_pairs, pair(v, w))
            seen = top >= 0
            score += total(np.log10(model.discount.kept(model.head_counts[top[seen]])), text[seen])
            rare, rest = np.flatnonzero(~common), np.flatnonzero(~seen)
            at = np.concatenate([words.bucket(v[rare], w[rare], common[rare], buckets), words.bucket(v[rest], w[rest], common[rest], buckets)])
            both = np.concatenate([rare, rest])
            what = np.concatenate([np.zeros(len(rare), np.int8), 1 + held_rows[text[rest]].astype(np.int8)])
            held.append((at, row[text[both]], v[both], w[both], what))
            size += len(both)
            yield pa.record_batch(
                [
                    pa.array((row % buckets).astype(np.int32)), pa.array([OWN] * m, pa.int32()), pa.nulls(m, pa.binary()), batch.column(0), batch.column(1), batch.column(2),
                    pa.array(np.bincount(text, minlength=m)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score),
                ],
                names,
            )
            if size > FLUSH:
                yield from ask(held)
                held, size = [], 0
        if size:
            yield from ask(held)

    return work


def _answers(model: Shared, schema: str):
    """Per block of questions one of answers, sums per text; and histories of pairs not seen
    that only their own bucket knows."""
    words = model.words
    names = [c.split()[0] for c in schema.split(", ")]

    def out(kind, rows, v=None, block: bytes | None = None) -> pa.RecordBatch:
        n = len(rows)
        blank = [pa.nulls(n, t) for t in (kind, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
        last = [pa.nulls(n, pa.int64()) if v is None else pa.array(v), pa.array([block] * n, pa.binary())]
        return pa.record_batch([pa.array(rows), *blank, *last], names)

    def answer(kind, block: list, rare: list, key: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
        origin, steps, t0, w0, t1, k1, t2, w2, v2 = block
        rows = np.cumsum(steps)
        m = len(rows)
        at = find(rare[0], w0)
        n = take(rare[1], at)
        base = np.bincount(t0, words.base(n), m).astype(float)
        known = np.bincount(t0, (n > 0).astype(float), m)
        score = np.bincount(t0, take(rare[2], at), m).astype(float)
        at = find(key, k1)
        score += np.bincount(t1, np.log10(model.discount.kept(count[at])), m) if len(t1) else 0
        if len(t2):
            at = find(key, pair(v2, w2))
            seen = at >= 0
            if seen.any():
                score += np.bincount(t2[seen], np.log10(model.discount.kept(count[at[seen]])), m)
            t2, w2, v2 = t2[~seen], w2[~seen], v2[~seen]
            place, tail = find(words.w, w2), find(rare[0], w2)
            n = take(words.n, place) + take(rare[1], tail)
            score += np.bincount(t2, np.log10(words.p(n)), m) if len(t2) else 0
            before = find(words.w, v2)
            own = before >= 0
            if own.any():
                score += np.bincount(t2[own], words.a[before[own]] - words.g[before[own]], m)
            if not own.all():
                yield out(kind, rows[t2[~own]], v2[~own].view(np.int64))
        yield out(kind, origin, block=pack(steps, known.astype("<u4"), base, score))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rare, tail, key, count = None, [], None, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for bucket, kind, block, batch, i in _grouped(batches):
            if bucket != at:
                at, rare, tail, key, count = bucket, [], None, np.zeros(0, np.uint64), np.zeros(0, np.int64)
            if kind == WORDS:
                rare.append(unpack(block))
            elif kind == PAIRS:
                key, count = unpack(block)
                key, count = np.cumsum(key, dtype=np.uint64), count.astype(np.int64)
            elif kind == ASK:
                tail = tail or _tail(rare, 2)
                yield from answer(batch.column(4).type, unpack(block), tail, key, count)
            else:
                own = batch.slice(i, 1)
                yield pa.record_batch([*own.columns[3:], pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary())], names)

    return work


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the answers to one origin's questions, over rows (origin, block) sorted by origin."""

    def sums(blocks: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        rows, *values = (np.concatenate(x) for x in zip(*blocks))
        rows, known, base, score, _ = summed(rows, *values)
        yield from _batches([c.split()[0] for c in SUMMED.split(", ")], rows, known, base, score)

    origin, held = None, []
    for batch in batches:
        for at, block in zip(batch.column(0).to_pylist(), batch.column(1)):
            if at != origin and held:
                yield from sums(held)
                held = []
            steps, known, base, score = unpack(block.as_py())
            origin = at
            held.append([np.cumsum(steps), known.astype(np.int64), base, score])
    if held:
        yield from sums(held)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    ``docs`` has a boolean column ``held_out``.
    """
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    asked, answered = ASKED.format(id=id_kind), ANSWERED.format(id=id_kind)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text")
    questions = rows.mapInArrow(_questions(model.shared, asked), asked)
    known = _blocks_of_words(model.table, model.shared.buckets, ["n", "g"]).union(model.pairs)
    extra = [F.lit(None).cast(f.dataType).alias(f.name) for f in questions.schema.fields[3:]]
    every = questions.union(known.select("bucket", "kind", "block", *extra))
    dealt = every.repartition(model.shared.buckets, "bucket").sortWithinPartitions("bucket", "kind")
    answers = stored(dealt.mapInArrow(_answers(model.shared, answered), answered), "answers")
    sums = answers.where("v is null and block is null").drop("v", "block")
    told = answers.where("block is not null").select("row", "block").repartition("row").sortWithinPartitions("row")
    told = told.mapInArrow(_added, SUMMED)
    far = answers.where("v is not null").select("row", "v").join(model.table, F.col("v") == F.col("w"))
    far = far.select("row", (F.col("a") - F.col("g")).alias("score"))
    fields = [f for f in sums.schema.fields if f.name not in ("row", "n_known", "base", "score")]
    told = told.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])
    blank = [F.lit(0).cast(f.dataType).alias(f.name) if f.name in ("n_tokens", "n_known", "base") else F.lit(None).cast(f.dataType).alias(f.name) for f in sums.schema.fields if f.name not in ("row", "score")]
    both = sums.unionByName(told).unionByName(far.select("row", "score", *blank))
    return both.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"),
        F.lit(model.shared.words.total).cast("long").alias("train_tokens"), F.sum("base").alias("base_score"), F.sum("score").alias("score"),
    ).drop("row")


def score_held_out(docs: DataFrame, parts: int = 10, remainder: int = 0) -> DataFrame:
    """Scores of all ``docs``, learnt from those that are not held out."""
    prepare(docs.sparkSession)
    marked = docs.select("doc_id", "text", held_out(F.col("doc_id"), parts, remainder).alias("held_out"))
    return score(marked, fit(marked.where("not held_out")))
