"""SentencePiece merges with seeded dropout, and lossless decoding.

A public merge vocabulary with byte fallback is read, never trained. Each unit (spaces and
the word after them) starts as characters; an agenda holds candidate merges by score, then
place; a candidate that comes up is skipped when a hash keyed by seed, document id, place
of the occurrence and span falls below the dropout. Every occurrence has draws of its own,
so one word is cut in different ways within and across documents, and reruns agree. No
piece of the vocabulary holds a space after another character (checked on loading), so
units are independent and the agenda per unit gives what an agenda over the whole text
would.

A span comes up once at most, so which spans were skipped fixes the cut. A worker keeps
the tokens and merges of units, and of units with one span skipped; an occurrence draws
for the merges, and with the first that it skips it goes on from there, the merges before
being those already made. Ways with more skips are cut anew, as they hardly recur.

Characters outside the vocabulary, and a literal U+2581 (the vocabulary's sign for a
space), become byte pieces; decoding therefore returns every text exactly.

Defined results: a null text has null tokens and decodes to null; an empty one has none;
texts of one id and content are cut alike; an empty table gives no rows; extra columns
pass through. A unit of any length costs n log n; kept units are bounded by ``KEPT``.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import lean, prepare, worker_state

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT = 0.1
SEED = 10
KEPT = 500_000, 150_000  # units, and ways with one skip, that a worker keeps; beyond that it starts anew
SPACE = "▁"
TOGETHER = 48  # longer units have a heap of their own
STRETCH = 1_000_000  # bytes of text cut at once
BLOCK = 1 << 14  # units of one length that go together
UNIT = re.compile(r" *[^ ]+| +")
NONE = np.int32(1 << 30)
_POWERS = np.cumprod(np.full(1 << 12, 0x5851F42D4C957F2D, np.uint64))


def _span(left, middle, end):
    with np.errstate(over="ignore"):
        return (left << np.uint64(40)) + (middle << np.uint64(20)) + end


def _base(seed: np.ndarray, place: np.ndarray) -> np.ndarray:
    """What an occurrence's draws are keyed by: its document's hash and its place there."""
    with np.errstate(over="ignore"):
        x = place * np.uint64(0x9E3779B97F4A7C15) + seed
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)


def _longer(held: np.ndarray, length: int, more: np.ndarray) -> np.ndarray:
    """``held`` with ``more`` written at ``length``; room doubles when it is short."""
    if length + len(more) > len(held):
        held = np.concatenate([held[:length], np.zeros(length + 2 * len(more), held.dtype)])
    held[length : length + len(more)] = more
    return held


class Ways:
    """Cuts of units with given spans skipped, by hash: tokens, and the merges made, in order.

    The first ``done`` merges of a way came before its last skip; only those after it are
    still to be drawn for.
    """

    def __init__(self):
        self.key, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.tokens_at, self.tokens_n, self.merges_at, self.merges_n, self.done = (np.zeros(0, np.int64) for _ in range(5))
        self._tokens, self._lengths = np.zeros(1 << 16, np.int32), [0, 0]
        self._merges, self._made = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int32)

    @property
    def tokens(self) -> np.ndarray:
        return self._tokens[: self._lengths[0]]

    @property
    def merges(self) -> np.ndarray:
        return self._merges[: self._lengths[1]]

    @property
    def made(self) -> np.ndarray:
        """The piece that each merge makes."""
        return self._made[: self._lengths[1]]

    def find(self, key: np.ndarray) -> np.ndarray:
        """Row of each key, or -1."""
        if not len(self.key):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.row[at], -1)

    def add(self, key, tokens, tokens_n, merges, made, merges_n, done) -> None:
        rows = len(self.key) + np.arange(len(key))
        order = np.argsort(key)
        place = np.searchsorted(self.key, key[order])
        self.key, self.row = np.insert(self.key, place, key[order]), np.insert(self.row, place, rows[order])
        self.tokens_at = np.append(self.tokens_at, self._lengths[0] + np.cumsum(tokens_n) - tokens_n)
        self.merges_at = np.append(self.merges_at, self._lengths[1] + np.cumsum(merges_n) - merges_n)
        self.tokens_n, self.merges_n = np.append(self.tokens_n, tokens_n), np.append(self.merges_n, merges_n)
        self.done = np.append(self.done, done)
        self._tokens = _longer(self._tokens, self._lengths[0], tokens)
        self._merges = _longer(self._merges, self._lengths[1], merges)
        self._made = _longer(self._made, self._lengths[1], made)
        self._lengths = [self._lengths[0] + len(tokens), self._lengths[1] + len(merges)]


def _inside(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Places at, at + 1, ... of runs of ``n`` one after another."""
    ends = np.cumsum(n)
    return np.arange(int(ends[-1]) if len(n) else 0) + np.repeat(at - (ends - n), n)


class Pieces:
    """The vocabulary and the cutting of units."""

    def __init__(self, model: bytes, dropout: float, seed: int):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.ids, self.scores, self.bytes = {}, {}, {}
        self.out: list[bytes] = []
        for k in range(sp.vocab_size()):
            piece = sp.id_to_piece(k)
            if sp.is_byte(k):
                value = int(piece[1:-1], 16)
                self.bytes[value] = k
                self.out.append(bytes([value]))
            elif sp.is_control(k) or sp.is_unknown(k):
                self.out.append(b"")
            else:
                self.ids[piece] = k
                self.scores[piece] = sp.get_score(k)
                self.out.append(piece.replace(SPACE, " ").encode())
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece spans two units")
        if len(self.bytes) < 256:
            raise ValueError("the vocabulary has no byte fallback")
        if any(len(p) > 1 and any(c not in self.ids for c in p) for p in self.ids):
            raise ValueError("a character of a piece is no piece itself")
        self.bar, self.seed = int(dropout * (1 << 32)), seed
        # a symbol is a piece's id, or ~ of the code point of a character without a piece
        self.symbol = ~np.arange(0x110000, dtype=np.int32)
        for piece, k in self.ids.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = k
        self.symbol[ord(" ")], self.symbol[ord(SPACE)] = self.ids[SPACE], ~ord(SPACE)
        order = sorted(self.ids, key=lambda q: (-self.scores[q], self.ids[q]))
        self.of_rank = np.array([self.ids[q] for q in order], np.int32)
        rank = {q: k for k, q in enumerate(order)}
        self.width = np.array([len(x) for x in self.out])
        self.first = np.cumsum(self.width) - self.width
        self.spelling = np.frombuffer(b"".join(self.out), np.uint8)
        self.shift = len(self.out).bit_length()
        joins = sorted(
            (self.ids[q[:i]] << self.shift | self.ids[q[i:]], rank[q])
            for q in order
            for i in range(1, len(q))
            if q[:i] in self.ids and q[i:] in self.ids
        )
        self.join, self.join_rank = (np.array(x) for x in zip(*joins))
        # keys of half the width are found faster
        self.join = self.join.astype(np.int32 if 2 * self.shift < 32 else np.int64)
        self.join_rank = self.join_rank.astype(np.int32)
        self.kept = [Ways(), Ways()]

    def look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the piece that neighbours make; ``NONE`` where they make none."""
        key = left.astype(self.join.dtype) << self.shift | right.astype(self.join.dtype)
        at = np.minimum(np.searchsorted(self.join, key), len(self.join) - 1)
        return np.where((self.join[at] == key) & (left > 0) & (right > 0), self.join_rank[at], NONE)

    def _skips(self, base, span):
        """Whether the keyed hash of occurrence and span falls below the dropout."""
        with np.errstate(over="ignore"):
            x = base + span
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (x >> np.uint64(32)) < np.uint64(self.bar)

    def together(self, points, skipped, before) -> tuple[np.ndarray, ...]:
        """Symbols with a mask of the final ones for units of one length (rows of code
        points), and their merges, the pieces made and the number of merges, in order.

        All agendas go in step: each round takes every unit's best candidate. Symbols keep
        their places and know their neighbours, so a merge touches a few cells of a row. A
        unit of which some spans are ``skipped`` (columns; 0 is no span) goes on from the
        merges it made ``before`` (row, number, span, piece) the last skip.
        """
        n, size = points.shape
        wide = size + 1  # the last column stands for nothing
        symbols = np.full((n, wide), -1, np.int32)
        symbols[:, :size] = self.symbol[points]
        alive = np.ones((n, wide), bool)
        alive[:, size] = False
        merges, made, number = np.zeros((n, size), np.uint64), np.zeros((n, size), np.int32), np.zeros(n, np.int64)
        if before is not None:
            row, nth, span, piece = before
            merges[row, nth], made[row, nth] = span, piece
            number += np.bincount(row, minlength=n)
            left, middle = (span >> np.uint64(40)).astype(np.int64), (span >> np.uint64(20)).astype(np.int64) & 0xFFFFF
            symbols[row, left] = piece  # of several at one place the last counts
            alive[row, middle] = False
        columns = np.arange(wide, dtype=np.int64)
        after = np.where(alive, columns, size)
        after = np.minimum.accumulate(after[:, ::-1], axis=1)[:, ::-1]
        nxt = np.full((n, wide), size)
        nxt[:, :size] = after[:, 1:]
        prv = np.full((n, wide), size)
        prv[:, 1:] = np.maximum.accumulate(np.where(alive, columns, -1), axis=1)[:, :size]
        prv[:, 0] = size
        rank = np.full((n, wide), NONE, np.int32)
        pair = np.flatnonzero(alive & (nxt < size))
        line = pair // wide
        flat, nxt, prv, alive, rank1 = symbols.ravel(), nxt.ravel(), prv.ravel(), alive.ravel(), rank.ravel()
        rank1[pair] = self.look(flat[pair], flat[line * wide + nxt[pair]])
        if skipped.shape[1]:
            middle = nxt[pair]
            span = _span((pair % wide).astype(np.uint64), middle.astype(np.uint64), nxt[line * wide + middle].astype(np.uint64))
            rank1[pair[(skipped[line] == span[:, None]).any(1)]] = NONE
        who = np.arange(n)
        while len(who):
            mine = rank[who] if len(who) < n else rank
            at = mine.argmin(1)
            best = mine[np.arange(len(who)), at]
            more = best < NONE
            if not more.all():
                who, at, best = who[more], at[more], best[more]
            base = who * wide
            left = base + at
            middle = nxt[left]
            end = nxt[base + middle]
            piece = self.of_rank[best]
            nth = who * size + number[who]
            merges.ravel()[nth] = _span(at.astype(np.uint64), middle.astype(np.uint64), end.astype(np.uint64))
            made.ravel()[nth] = piece
            number[who] += 1
            flat[left] = piece
            alive[base + middle], rank1[base + middle] = False, NONE
            nxt[left], prv[base + end] = end, at
            other = base + prv[left]
            rank1[left] = self.look(piece, flat[base + end])
            rank1[other] = self.look(flat[other], piece)
            rank1[base + size] = NONE
        return symbols, alive.reshape(n, wide), merges, made, number

    def alone(self, points: np.ndarray, base: np.uint64) -> np.ndarray:
        """Final symbols of one long unit: its agenda is a heap."""
        symbols = self.symbol[points].tolist()
        n = len(symbols)
        ends, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.look(np.array(symbols[:-1]), np.array(symbols[1:]))
        agenda = [(int(first[i]), i, i + 1, i + 2) for i in np.flatnonzero(first < NONE).tolist()]
        heapq.heapify(agenda)
        known: dict[tuple[int, int], int] = {}

        def push(left: int, middle: int, end: int) -> None:
            pair = (symbols[left], symbols[middle])
            if pair not in known:
                known[pair] = int(self.look(np.array(pair[:1]), np.array(pair[1:]))[0])
            if known[pair] < NONE:
                heapq.heappush(agenda, (known[pair], left, middle, end))

        while agenda:
            rank, left, middle, end = heapq.heappop(agenda)
            if symbols[left] is None or ends[left] != middle or ends[middle] != end:
                continue
            if self.bar and self._skips(base, _span(np.uint64(left), np.uint64(middle), np.uint64(end))):
                continue
            symbols[left], symbols[middle], ends[left] = int(self.of_rank[rank]), None, end
            if end < n:
                before[end] = left
                push(left, end, ends[end])
            if left:
                push(before[left], left, end)
        return np.array([x for x in symbols if x is not None], np.int32)

    def cut(self, points, starts, sizes, skipped, before) -> tuple[np.ndarray, ...]:
        """Tokens, their number, merges, pieces made and their number, of units at ``starts`` of ``points``."""
        parts, order = [], []
        for size in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == size)
            for k in range(0, len(rows), BLOCK):
                block = rows[k : k + BLOCK]
                known = before(block) if before else None
                symbols, alive, merges, made, number = self.together(points[starts[block][:, None] + np.arange(size)], skipped[block], known)
                flat, count = self._bytes(symbols[alive], alive.sum(1))
                has = np.arange(size)[None, :] < number[:, None]
                parts.append((flat, count, merges[has], made[has], number))
                order.append(block)
        flat, count, merges, made, number = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(np.concatenate(order))
        tokens = flat[_inside((np.cumsum(count) - count)[order], count[order])]
        own = _inside((np.cumsum(number) - number)[order], number[order])
        return tokens, count[order], merges[own], made[own], number[order]

    def _walk(self, points, starts, sizes, unit, base) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """First token in a pool, number of tokens of each unit by its own draws, and the pool's parts.

        Whole units and those with one skip are kept for later texts; rarer ways are not.
        """
        begin, count = np.zeros(len(unit), np.int64), np.zeros(len(unit), np.int64)
        pools, pooled = [], 0
        todo, key, skipped, deep = np.arange(len(unit)), unit, np.zeros((len(unit), 0), np.uint64), 0
        parent: Ways | None = None
        while len(todo):
            kept = self.kept[deep] if deep < len(self.kept) else Ways()
            at = kept.find(key)
            if (at < 0).any():
                new, first = np.unique(key[at < 0], return_index=True)
                first = np.flatnonzero(at < 0)[first]
                before = None
                if parent is not None:
                    came, upto = way[first], reached[first]  # the way before the skip, and its merges up to it

                    def before(block: np.ndarray) -> tuple[np.ndarray, ...]:
                        n = upto[block]
                        own = _inside(parent.merges_at[came[block]], n)
                        return np.repeat(np.arange(len(block)), n), _inside(np.zeros(len(block), np.int64), n), parent.merges[own], parent.made[own]

                cut = self.cut(points, starts[todo[first]], sizes[todo[first]], skipped[first], before)
                done = reached[first] if parent is not None else np.zeros(len(first), np.int64)
                kept.add(new, *cut, done)
                at = kept.find(key)
            begin[todo], count[todo] = pooled + kept.tokens_at[at], kept.tokens_n[at]
            pools.append(kept.tokens)
            pooled += len(kept.tokens)
            if not self.bar:
                break
            n = kept.merges_n[at] - kept.done[at]
            ends = np.cumsum(n)
            span = kept.merges[_inside(kept.merges_at[at] + kept.done[at], n)]
            hit = np.flatnonzero(self._skips(np.repeat(base[todo], n), span))
            line, first = np.unique(np.searchsorted(ends, hit, "right"), return_index=True)
            hit = hit[first]
            span = span[hit]
            reached = kept.done[at[line]] + hit - (ends - n)[line]
            parent, way = kept, at[line]
            todo, skipped = todo[line], np.column_stack([skipped[line], span])
            with np.errstate(over="ignore"):
                key = (key[line] ^ (key[line] >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9) + span * np.uint64(0x94D049BB133111EB)
            deep += 1
        return begin, count, pools

    def _bytes(self, flat: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte pieces in place of characters that have no piece."""
        strange = np.flatnonzero(flat < 0)
        if not len(strange):
            return flat, count
        coded = [[self.bytes[b] for b in chr(~x).encode()] for x in flat[strange].tolist()]
        wide = np.ones(len(flat), np.int64)
        wide[strange] = [len(c) for c in coded]
        unit = np.repeat(np.arange(len(count)), count)
        out = np.repeat(flat, wide)
        at = np.repeat(flat < 0, wide)
        out[at] = [t for c in coded for t in c]
        return out, np.bincount(unit, wide, len(count)).astype(np.int64)

    def encode(self, texts: list[str], keys: list[str]) -> list[np.ndarray]:
        """Tokens of each text; an occurrence's draws hang on its key and place.

        Units are told apart by a 64-bit hash of their code points. What comes out is
        decoded and compared; should two units ever share a hash, the texts that differ
        are cut again by themselves.
        """
        lengths = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        whole = "".join(f" {t}" for t in texts if t)
        points = np.frombuffer(whole.encode("utf-32-le"), "<u4")
        if not len(points):
            return [np.zeros(0, np.int32) for _ in texts]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        space = points == 32
        opens = space.copy()
        opens[1:] &= ~space[:-1]
        opens[ends[:-1][lengths > 0]] = True
        starts = np.flatnonzero(opens)
        sizes = np.diff(np.append(starts, len(points)))
        with np.errstate(over="ignore"):
            inside = np.arange(len(points)) - np.repeat(starts, sizes)
            unit = np.add.reduceat((points.astype(np.uint64) + np.uint64(1)) * _POWERS[inside % len(_POWERS)], starts)
            unit = (unit ^ (unit >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + sizes.astype(np.uint64)
            text = np.searchsorted(ends, starts, "right") - 1
            seed = np.fromiter((xxhash.xxh64_intdigest(k, self.seed) for k in keys), np.uint64, len(keys))
            base = _base(seed[text], (np.arange(len(starts)) - np.searchsorted(starts, ends[text])).astype(np.uint64))
        self.kept = [k if len(k.key) < most else Ways() for k, most in zip(self.kept, KEPT)]
        short = np.flatnonzero(sizes <= TOGETHER)
        begin, n = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        begin[short], n[short], pools = self._walk(points, starts[short], sizes[short], unit[short], base[short])
        length = sum(map(len, pools))
        for r in np.flatnonzero(sizes > TOGETHER).tolist():
            own = self.alone(points[starts[r] : starts[r] + sizes[r]], base[r])
            pools.append(self._bytes(own, np.array([len(own)]))[0])
            begin[r], n[r] = length, len(pools[-1])
            length += len(pools[-1])
        pool = np.concatenate(pools)
        total = np.cumsum(n)
        flat = pool[np.repeat(begin - (total - n), n) + np.arange(total[-1])]
        bounds = np.concatenate([[0], total])[np.searchsorted(starts, ends)]
        out = [flat[a:b] for a, b in zip(bounds, bounds[1:])]
        if self.spell(flat).tobytes() != whole.encode():
            for i, t in enumerate(texts):
                if t and self.decode(out[i].tolist()) != t:  # two units of one hash: not seen so far
                    out[i] = self._plainly(t, keys[i])
        return out

    def spell(self, tokens: np.ndarray) -> np.ndarray:
        """Bytes of the tokens one after another."""
        return self.spelling[_inside(self.first[tokens], self.width[tokens])]

    def _plainly(self, text: str, key: str) -> np.ndarray:
        done = []
        for place, u in enumerate(UNIT.findall(f" {text}")):
            base = _base(np.array([xxhash.xxh64_intdigest(key, self.seed)], np.uint64), np.array([place], np.uint64))
            flat = self.alone(np.frombuffer(u.encode("utf-32-le"), "<u4"), base[0])
            done.append(self._bytes(flat, np.array([len(flat)]))[0])
        return np.concatenate(done)

    def decode(self, tokens: list[int]) -> str:
        return b"".join(map(self.out.__getitem__, tokens))[1:].decode()


def pieces(model: bytes, dropout: float, seed: int) -> Pieces:
    """The worker's vocabulary, built once."""
    name = ("pieces", hashlib.md5(model).digest(), dropout, seed)
    kept = worker_state()
    if name not in kept:
        kept[name] = Pieces(model, dropout, seed)
    return kept[name]


def _stretches(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``STRETCH`` bytes, at least one row each."""
    start, size = 0, 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        size += n or 0
        if size > STRETCH:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _model(path: str) -> bytes:
    with open(path, "rb") as f:  # half a megabyte, read once and sent with the tasks
        return f.read()


def encode(docs: DataFrame, model_path: str = MODEL, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """``docs`` with a column ``tokens`` (array of int); an earlier one of that name goes."""
    prepare(docs.sparkSession)
    model = _model(model_path)
    docs = docs.drop("tokens")
    text = docs.columns.index("text")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("string").alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model, dropout, seed)
        for batch in batches:
            texts, keys = batch.column(0).field(text), batch.column(1)
            cut = []
            for a, b in _stretches(texts):
                part = [t or "" for t in texts[a:b].to_pylist()]
                cut += own.encode(part, [k or "" for k in keys[a:b].to_pylist()])
            cut = [c if ok else None for c, ok in zip(cut, texts.is_valid().to_pylist())]
            ends = np.cumsum([0, *(0 if c is None else len(c) for c in cut)]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, "<i4"), *(c for c in cut if c is not None)])
            null = pa.array([c is None for c in cut], pa.bool_())
            tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=null)
            yield pa.record_batch([batch.column(0), tokens], ["row", "tokens"])

    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(lean(run), f"row {kind}, tokens array<int>").select("row.*", "tokens")


def decode(coded: DataFrame, model_path: str = MODEL) -> DataFrame:
    """``coded`` with a column ``decoded``, from ``tokens`` alone; an earlier one goes."""
    prepare(coded.sparkSession)
    model = _model(model_path)
    coded = coded.drop("decoded")
    place = coded.columns.index("tokens")
    rows = coded.select(F.struct("*").alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model, 0.0, 0)
        for batch in batches:
            lists = batch.column(0).field(place)
            # each text begins with a space that is not its own
            tokens, sizes = lists.flatten().to_numpy(), lists.value_lengths().fill_null(0).to_numpy()
            data, ends = own.spell(tokens), np.concatenate([[0], np.cumsum(own.width[tokens])])[np.concatenate([[0], np.cumsum(sizes)])]
            texts = [data[a + 1 : b].tobytes().decode() if ok else None for a, b, ok in zip(ends, ends[1:], lists.is_valid().to_pylist())]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], ["row", "decoded"])

    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(lean(run), f"row {kind}, decoded string").select("row.*", "decoded")


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_bytes, n_tokens, digests of tokens and decoded text, and whether it is the text."""
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    both = decode(encode(text, **options))
    return both.select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.size("tokens").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("tokens", " "), 256).alias("tokens_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.col("text")).alias("lossless"),
    )
