"""Substring deduplication over word windows, by super-k-mer partitioning.

Every window of ``WINDOW`` words has a minimiser, the least hash among its runs of
``RUN`` words. Consecutive windows of one minimiser travel as one packed string (their
words once, not window by window) to the bucket of that minimiser; equal windows have
equal minimisers and so meet. In its bucket every window is sorted by hash, equal hashes
are compared byte by byte, and each occurrence after the one in the document of least id
marks its words. A bucket beyond ``ROOM`` bytes is passed on and grouped window by window
in Spark, which splits and combines; nothing is dropped.

Defined results: null and empty texts have no words; documents without an id neither mark
nor are marked; rows that repeat an id keep their own words by text, and rows of one id
never mark each other; an empty table gives no rows. Extra columns pass through ``clean``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import lean, prepare, stored
from ledgerspark.llm.words import hashes, joined, mixed, raw, slices, split, stretches

WINDOW = 13
RUN = 2
SHARE = 8_000_000  # bytes of packed words meant for one bucket
ROOM = 48_000_000  # bytes of packed words that a task sorts in memory
FLUSH = 16_000_000  # bytes that a task packs before it sends its blocks
SPREAD = 3  # packed words are about so many times the text


def superkmers(h: np.ndarray, text: np.ndarray, window: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, end word and minimiser of each run of windows with one minimiser."""
    n = len(h) - window + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        least = h[: len(h) - run + 1].copy()
        for k in range(1, run):
            least = least * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - run + 1 + k]
    least, span, want = mixed(least), 1, window - run + 1
    while span < want:
        step = min(span, want - span)
        least, span = np.minimum(least[:-step], least[step:]), span + step
    least = least[:n]
    valid = text[:n] == text[window - 1 :]
    new = valid.copy()
    new[1:] &= ~(valid[:-1] & (least[1:] == least[:-1]) & (text[1:n] == text[: n - 1]))
    first = np.flatnonzero(new)
    last = np.append(new[1:], True) | np.append(~valid[1:], True)
    last = np.flatnonzero(last & valid)
    return first, last + window, least[first]


def _pack(ids: np.ndarray, crcs: np.ndarray, at: np.ndarray, text: bytes) -> bytes:
    """One block: documents, word places and the packed strings, compressed."""
    docs, which = np.unique(np.stack([ids, crcs]), axis=1, return_inverse=True)
    body = b"".join([
        np.diff(docs[0], prepend=0).astype("<i8").tobytes(),
        docs[1].astype("<u4").tobytes(),
        which.ravel().astype("<u4").tobytes(),
        at.astype("<u4").tobytes(),
        text,
    ])
    return struct.pack("<4I", len(body), docs.shape[1], len(at), len(text)) + pa.compress(body, "zstd", asbytes=True)


def _unpack(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, crcs and word places of the packed strings, and their bytes (each ends in a line feed)."""
    size, docs, n, _ = struct.unpack_from("<4I", block)
    body = pa.decompress(block[16:], size, "zstd", asbytes=True)
    ids = np.cumsum(np.frombuffer(body, "<i8", docs))
    crcs = np.frombuffer(body, "<u4", docs, docs * 8).astype(np.int64)
    which = np.frombuffer(body, "<u4", n, docs * 12)
    at = np.frombuffer(body, "<u4", n, docs * 12 + n * 4).astype(np.int64)
    return ids[which], crcs[which], at, np.frombuffer(body, np.uint8, offset=docs * 12 + n * 8)


def _mapper(buckets: int, window: int, run: int):
    def send(held: dict) -> pa.RecordBatch:
        blocks = []
        for parts in held.values():
            ids, crcs, at, texts = zip(*parts)
            blocks.append(_pack(np.concatenate(ids), np.concatenate(crcs), np.concatenate(at), b"".join(texts)))
        return pa.record_batch(
            [pa.array(list(held), pa.int32()), pa.array(blocks, pa.binary())], ["bucket", "block"]
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            data, ends = raw(batch.column(1))
            for a, b in stretches(ends):
                own, cuts = data[ends[a] : ends[b]], ends[a : b + 1] - ends[a]
                crcs = np.array([zlib.crc32(own[i:j]) for i, j in zip(cuts, cuts[1:])], np.int64)
                starts, stops, text = split(own, cuts)
                first, end, least = superkmers(hashes(own, starts, stops), text, window, run)
                if not len(first):
                    continue
                flat, starts, stops = joined(own, starts, stops)
                word0 = np.searchsorted(text, np.arange(b - a))
                bucket = (least % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                low, high = starts[first[order]], stops[end[order] - 1] + 1
                packed = slices(flat, low, high)
                after = np.cumsum(high - low)
                packed[after - 1] = 10
                packed = packed.tobytes()
                which = text[first[order]]
                at = first[order] - word0[which]
                cut = np.flatnonzero(np.diff(bucket[order])) + 1
                for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(order)]):
                    piece = packed[after[i - 1] if i else 0 : after[j - 1]]
                    held.setdefault(int(bucket[order[i]]), []).append((ids[a:b][which[i:j]], crcs[which[i:j]], at[i:j], piece))
                size += len(packed)
                if size > FLUSH:
                    yield send(held)
                    held, size = {}, 0
        if held:
            yield send(held)

    return work


def _windows(block: bytes, window: int):
    """Of each window in a block: hash, id, crc, word place, first byte, end; and the bytes."""
    ids, crcs, at, flat = _unpack(block)
    ends = np.append(0, np.flatnonzero(flat == 10) + 1)
    out = []
    for a, b in stretches(ends):
        own = flat[ends[a] : ends[b]]
        starts, stops, text = split(own, ends[a : b + 1] - ends[a])
        h = hashes(own, starts, stops)
        n = len(h) - window + 1
        total = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(window):
                total = total * np.uint64(0x9E3779B97F4A7C15) + h[k : n + k]
        good = np.flatnonzero(text[:n] == text[window - 1 :])
        place = good - np.searchsorted(text, np.arange(b - a))[text[good]]
        which = a + text[good]
        out.append((mixed(total[good]), ids[which], crcs[which], at[which] + place, starts[good] + ends[a], stops[good + window - 1] + ends[a]))
    return [np.concatenate(x) for x in zip(*out)], flat


def _later(hash_: np.ndarray, ids: np.ndarray, low: np.ndarray, high: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Windows whose words also start in a document of smaller id."""
    order = np.lexsort((ids, hash_))
    firsts = np.flatnonzero(np.append(True, np.diff(hash_[order]) != 0))
    sizes = np.diff(np.append(firsts, len(order)))
    lead = np.repeat(order[firsts], sizes)
    pick = np.flatnonzero(lead != order)
    member, lead = order[pick], lead[pick]
    same = (high - low)[member] == (high - low)[lead]
    for k in range(0, len(member), 1 << 14):
        m, le = member[k : k + (1 << 14)], lead[k : k + (1 << 14)]
        ok = np.flatnonzero(same[k : k + (1 << 14)])
        if not len(ok):
            continue
        m, le = m[ok], le[ok]
        equal = slices(flat, low[m], high[m]) == slices(flat, low[le], high[le])
        n = high[m] - low[m]
        same[k + ok] = np.logical_and.reduceat(equal, np.cumsum(n) - n)
    found = member[same & (ids[member] > ids[lead])]
    if same.all():
        return found
    # different words under one hash: the groups concerned are told apart by their bytes
    odd = np.isin(hash_, np.unique(hash_[member[~same]]))
    least: dict[bytes, int] = {}
    rows = np.flatnonzero(odd).tolist()
    words = [flat[low[r] : high[r]].tobytes() for r in rows]
    for r, w in zip(rows, words):
        least[w] = min(least.get(w, ids[r]), ids[r])
    again = [r for r, w in zip(rows, words) if ids[r] > least[w]]
    return np.concatenate([found[~odd[found]], np.array(again, np.int64)])


def _spans(ids: np.ndarray, crcs: np.ndarray, at: np.ndarray, window: int) -> pa.RecordBatch:
    """Marked windows of a document that touch become one span of words."""
    order = np.lexsort((at, crcs, ids))
    ids, crcs, at = ids[order], crcs[order], at[order]
    new = np.append(True, (np.diff(ids) != 0) | (np.diff(crcs) != 0) | (np.diff(at) > window))[: len(at)]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at))[: len(first)] - 1
    columns = [np.zeros(len(first), np.int32), ids[first], crcs[first], at[first], at[last] + window]
    arrays = [pa.array(c) for c in columns] + [pa.nulls(len(first), pa.binary())]
    return pa.record_batch(arrays, ["kind", "id", "crc", "low", "high", "block"])


def _reducer(window: int, room: int):
    def passed(blocks: list[bytes]) -> pa.RecordBatch:
        n = len(blocks)
        nulls = [pa.nulls(n, pa.int64()) for _ in range(4)]
        return pa.record_batch([pa.array([1] * n, pa.int32()), *nulls, pa.array(blocks, pa.binary())], ["kind", "id", "crc", "low", "high", "block"])

    def marked(blocks: list[bytes]) -> pa.RecordBatch:
        parts, texts, base = [], [], 0
        for block in blocks:
            w, flat = _windows(block, window)
            w[4], w[5] = w[4] + base, w[5] + base
            parts.append(w)
            texts.append(flat)
            base += len(flat)
        hash_, ids, crcs, at, low, high = (np.concatenate(x) for x in zip(*parts))
        hit = _later(hash_, ids, low, high, np.concatenate(texts))
        return _spans(ids[hit], crcs[hit], at[hit], window)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, size, crowded = None, [], 0, False
        for batch in batches:
            for b, block in zip(batch.column(0).to_pylist(), batch.column(1)):
                block = block.as_py()
                if b != bucket:
                    if held:
                        yield marked(held)
                    bucket, held, size, crowded = b, [], 0, False
                size += struct.unpack_from("<4I", block)[3]
                held.append(block)
                crowded = crowded or size > room
                if crowded:
                    yield passed(held)
                    held = []
        if held:
            yield marked(held)

    return work


def _one_by_one(blocks: DataFrame, window: int) -> DataFrame:
    """Spans of crowded buckets: windows as rows, least id per window, joined back."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0):
                (_, ids, crcs, at, low, high), flat = _windows(block.as_py(), window)
                for k in range(0, len(ids), 1 << 15):
                    s = slice(k, k + (1 << 15))
                    words = [flat[a:b].tobytes() for a, b in zip(low[s], high[s])]
                    yield pa.record_batch([pa.array(words, pa.binary()), *(pa.array(x[s]) for x in (ids, crcs, at))], ["words", "id", "crc", "at"])

    rows = stored(blocks.select("block").mapInArrow(lean(work), "words binary, id long, crc long, at long"), "windows")
    least = rows.groupBy("words").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("most > least")
    least = stored(least.select("words", "least"), "least")
    hits = rows.join(least, "words").where("id > least")
    return hits.select("id", "crc", F.col("at").alias("low"), (F.col("at") + window).alias("high"))


def spans(docs: DataFrame, window: int = WINDOW, run: int = RUN, share: int = SHARE, room: int = ROOM) -> DataFrame:
    """id, crc and word span [low, high) of every marked stretch; spans of one text may overlap.

    ``doc_id`` must be an integer column; crc is the text's CRC-32.
    """
    prepare(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-total * SPREAD // share))
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text")
    blocks = texts.mapInArrow(lean(_mapper(buckets, window, run)), "bucket int, block binary")
    dealt = blocks.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    schema = "kind int, id long, crc long, low long, high long, block binary"
    found = stored(dealt.mapInArrow(lean(_reducer(window, room)), schema), "spans", "kind")
    marked = found.where("kind = 0").select("id", "crc", "low", "high")
    crowded = found.where("kind = 1")
    if crowded.isEmpty():
        return marked
    return marked.union(_one_by_one(crowded, window))


def _kept(text: str, marked: list | None) -> tuple[list[bytes], int]:
    words = text.encode().split()
    if not marked:
        return words, len(words)
    gone = np.zeros(len(words), bool)
    for s in marked:
        gone[s["low"] : s["high"]] = True
    return [w for w, g in zip(words, gone.tolist()) if not g], len(words)


def _with_spans(docs: DataFrame, columns: list, **options) -> DataFrame:
    per = spans(docs, **options).groupBy(F.col("id"), F.col("crc")).agg(F.collect_list(F.struct("low", "high")).alias("marked"))
    rows = docs.select(*columns, F.col("doc_id").cast("long").alias("own_id"), F.crc32(F.col("text").cast("binary")).alias("own_crc"))
    joined_ = rows.join(per, (F.col("own_id") == F.col("id")) & (F.col("own_crc") == F.col("crc")), "left")
    return joined_.drop("own_id", "own_crc", "id", "crc")


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, marked in zip(batch.column(1), batch.column(2)):
                kept, n = _kept(text.as_py() or "", marked.as_py())
                rows.append((n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            n, gone, digest = zip(*rows) if rows else ((), (), ())
            yield pa.record_batch(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = _with_spans(docs, [F.col("doc_id"), F.col("text")], **options)
    return rows.mapInArrow(lean(work), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def clean(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with repeated stretches taken out of ``text`` (and ``n_chars`` following).

    A text that loses nothing stays as it is; otherwise kept words are joined by one
    space. Rows that lose every word go.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep = [], []
            for text, marked in zip(batch.column(1), batch.column(2)):
                kept, n = _kept(text.as_py() or "", marked.as_py()) if marked.is_valid else ([], 0)
                texts.append(b" ".join(kept).decode() if marked.is_valid else text.as_py())
                keep.append(not n or bool(kept))
            mask = pa.array(keep, pa.bool_())
            yield pa.record_batch([batch.column(0).filter(mask), pa.array(texts, pa.string()).filter(mask)], ["row", "text"])

    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    rows = _with_spans(docs, [rest, F.col("text")], **options)
    kind = rows.schema["row"].dataType.simpleString()
    out = rows.mapInArrow(lean(work), f"row {kind}, text string").select("row.*", "text")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[f"`{c}`" for c in docs.columns])
