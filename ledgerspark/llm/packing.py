"""Best-two-fit packing of tokenised documents into sequences of one capacity.

A document is its ids by a public vocabulary (read, never trained) and an end id. Longer
ones are cut into pieces of the capacity, of which the first may be shorter. A sequence is
filled greedily, longest piece that fits first; then its shortest piece gives way to the
two unpacked pieces that fill the widened gap best, if they fill it better.

What a sequence takes hangs on the lengths that are left alone, and those are whole
numbers up to the capacity. So the search runs over how many pieces have each length, a
table of ``capacity`` numbers whatever the input, and a filling found once is repeated as
often as its lengths last: the same fillings, in the same order, as one sequence after
the other. A length l ends a run at most capacity / l + 1 times, each time at a smaller
need, so there are fewer than 9,000 runs of at most 44 lengths at a capacity of 1,024: at
most 16 MB go to the tasks, and in practice some 100 KB.

Pieces of one length are alike; each takes a number among them (its task's share begins
after those of earlier tasks, by exact counts), and its number tells its place. No task
sees all pieces of a length.

Defined results: a null text is an empty one, and an empty one is a piece of the end id
alone; repeated rows are packed each for itself; a null id stays null; ties in length go by
task and place; an empty table gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerspark.llm.common import prepare, stored, worker_state
from ledgerspark.llm.words import raw, stretches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
CAPACITY = 1024
END = 2
# fixed value: how byte-level vocabularies split text before merging
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHIFT = 48  # a piece's length stands above its number


def tokenizer(vocabulary: bytes):
    """The worker's vocabulary, built once; special tokens' strings are ordinary text.

    The file is one of ``tokenizers``; its merges run in ``tiktoken``, which takes a third of
    the time and gives the same ids (tested for every code point).
    """
    name = ("packing", hashlib.md5(vocabulary).digest())
    kept = worker_state()
    if name not in kept:
        import tiktoken

        read = json.loads(vocabulary)
        ids, merges, special = read["model"]["vocab"], read["model"]["merges"], {t["content"] for t in read["added_tokens"]}
        made = [ids["".join(m)] for m in merges]
        if any(a >= b for a, b in zip(made, made[1:])):
            raise ValueError("ids of the vocabulary do not follow its merges")
        # a printable character stands for itself, the others for those from 256 on
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        shown = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(sorted({*range(256)} - {*plain}))}
        ranks = {bytes(map(shown.__getitem__, piece)): k for piece, k in ids.items() if piece not in special}
        kept[name] = tiktoken.Encoding(name[0], pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return kept[name]


def cuts(n: int, capacity: int) -> list[int]:
    """Ends of the pieces of ``n`` ids: all but the first have the capacity."""
    first = (n - 1) % capacity + 1
    return list(range(first, n + 1, capacity))


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, end: int = END, ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, with ``ids`` the ids too.

    ``part`` and ``nth`` tell the task that wrote a piece and the piece's number among those
    of its length there.
    """
    prepare(docs.sparkSession)
    with open(vocabulary, "rb") as f:  # a few megabytes, read once and sent with the tasks
        model = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = tokenizer(model), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            texts = batch.column(1).fill_null("")
            for a, b in stretches(raw(texts)[1]):
                row, piece, start, length, crc, flat = [], [], [], [], [], []
                for i, text in enumerate(texts[a:b].to_pylist(), a):
                    line = np.array([*own.encode_ordinary(text), end], "<u4")
                    at = 0
                    for k, stop in enumerate(cuts(len(line), capacity)):
                        row.append(i)
                        piece.append(k)
                        start.append(at)
                        length.append(stop - at)
                        crc.append(zlib.crc32(line[at:stop].tobytes()))
                        at = stop
                    if ids:
                        flat.append(line)
                sizes = np.array(length)
                order = np.argsort(sizes, kind="stable")
                same = sizes[order]
                nth = np.empty(len(sizes), np.int64)
                nth[order] = np.arange(len(sizes)) - np.searchsorted(same, same) + seen[same]
                seen += np.bincount(sizes, minlength=capacity + 1)
                columns = [
                    batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()), pa.array(np.full(len(row), part, np.int32)), pa.array(nth),
                ]
                if ids:
                    ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                    columns.append(pa.ListArray.from_arrays(ends, pa.array(np.concatenate(flat).astype(np.int32))))
                yield pa.record_batch(columns, names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", *(["ids"] if ids else [])]
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long"
    return docs.select("doc_id", "text").mapInArrow(run, schema + (", ids array<int>" if ids else ""))


def _largest(counts: np.ndarray) -> np.ndarray:
    """For every x the greatest length up to x of which there is one; 0 if none."""
    return np.maximum.accumulate(np.where(counts > 0, np.arange(len(counts)), 0))


def _filling(left: np.ndarray, capacity: int) -> tuple[dict[int, int], dict[int, int]]:
    """What the next sequence takes, and what must be there for that choice: length -> number."""
    largest = _largest(left)
    took: dict[int, int] = {}
    gap, length = capacity, int(largest[capacity])
    while length:
        took[length] = min(int(left[length]), gap // length)
        gap -= took[length] * length
        last, length = length, int(largest[min(gap, length - 1)])
    needs = dict(took)
    if not gap:
        return took, needs
    rest = left.copy()
    for length, n in took.items():
        rest[length] -= n
    room = gap + last
    one = np.flatnonzero(rest[: room + 1])
    if not len(one):
        return took, needs
    largest = _largest(rest)
    two = np.minimum(one, room - one)
    two = np.where((two == one) & (rest[one] < 2), two - 1, two)
    two = largest[np.maximum(two, 0)]
    sums = np.where(two > 0, one + two, 0)
    best = len(sums) - 1 - int(sums[::-1].argmax())  # of equal sums the one with the longest piece
    if sums[best] > last:
        took[last] -= 1
        for length in (int(one[best]), int(two[best])):
            took[length] = took.get(length, 0) + 1
            needs[length] = needs.get(length, 0) + 1
    return {length: n for length, n in took.items() if n}, needs


def best_two_fit(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """Fillings in order, as (times, length -> number), that use up ``counts`` by length."""
    left, runs = counts.astype(np.int64).copy(), []
    while left.any():
        took, needs = _filling(left, capacity)
        times = min((int(left[length]) - needs[length]) // n + 1 for length, n in took.items())
        for length, n in took.items():
            left[length] -= times * n
        runs.append((times, took))
    return runs


def places(runs: list[tuple[int, dict[int, int]]], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length << 48 | first number, first sequence, number in a sequence, offset), sorted.

    Pieces of one length from the first number on go to one sequence after another.
    """
    used = np.zeros(capacity + 1, np.int64)
    rows, sequence = [], 0
    for times, took in runs:
        offset = 0
        for length, n in sorted(took.items(), reverse=True):
            rows.append((length << SHIFT | int(used[length]), sequence, n, offset))
            used[length] += times * n
            offset += n * length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4).T.copy()


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, end: int = END, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece; with ``ids`` the ids too."""
    cut = stored(pieces(docs, vocabulary, capacity, end, ids), "pieces")
    shares = stored(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "shares")
    counts = np.zeros(capacity + 1, np.int64)
    for r in shares.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most one row per length
        counts[r["length"]] = r["n"]
    table = places(best_two_fit(counts, capacity), capacity)
    before = F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    firsts = stored(shares.select("part", "length", F.coalesce(before, F.lit(0)).alias("before")), "firsts")
    rows = cut.join(firsts, ["part", "length"])
    rest = ["ids"] if ids else []
    rows = rows.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("number"), *rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, per, offset = table
        for batch in batches:
            if not batch.num_rows:
                continue
            length, number = (batch.column(k).to_numpy() for k in (3, 5))
            at = np.searchsorted(key, length << SHIFT | number, "right") - 1
            nth = number - (key[at] & ((1 << SHIFT) - 1))
            columns = [first[at] + nth // per[at], offset[at] + nth % per[at] * length]
            kept = [batch.column(k) for k in (0, 1, 2, 3, 4, *range(6, batch.num_columns))]
            yield pa.record_batch([*kept, *map(pa.array, columns)], names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", *rest, "sequence_id", "offset"]
    kinds = {f.name: f.dataType.simpleString() for f in cut.schema}
    return rows.mapInArrow(run, ", ".join(f"{c} {kinds.get(c, 'long')}" for c in names))


def sequences(docs: DataFrame, **options) -> DataFrame:
    """The sequences themselves: sequence_id, its ids, and doc_id, piece and offset of what it holds."""
    held = F.struct("offset", "doc_id", "piece", "length", "ids")
    rows = pack(docs, ids=True, **options).groupBy("sequence_id").agg(F.sort_array(F.collect_list(held)).alias("held"))
    return rows.select(
        "sequence_id",
        F.flatten("held.ids").alias("ids"),
        F.transform("held", lambda h: F.struct(h["doc_id"], h["piece"], h["offset"], h["length"])).alias("documents"),
    )
