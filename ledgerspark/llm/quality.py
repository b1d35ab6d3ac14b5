"""Quality classifier: random Fourier features, ridge by summed normal equations, isotonic.

Statistics of a text (shares of character classes, word lengths, repetition, lines) are
standardised and mapped to cosines of fixed random projections, which approximate a
Gaussian kernel. Tasks sum the normal equations of their rows; the driver solves one
system of ``FEATURES`` + 1 unknowns. Scores of a fold kept aside are counted per bin and
made monotone by pooling adjacent violators, which gives the probability of label 1.

Labels are learnt only from rows whose crc32(doc_id as text) leaves no 1 modulo 3; label,
language, source and id never enter a score. All such rows are used, no sample.

Defined results: null and empty texts have statistics of their own (all zero) and a score
like any text; several labels of one id count as their mean; null labels and labels of
unknown ids are passed over; without any label every score is 0.5; repeated rows score
alike; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import held_out, lean, prepare, stored

FEATURES = 384
RIDGE = 0.3  # times the mean diagonal entry, over a hundred
BINS = 2048
SEED = 4
FOLDS = 5  # one in so many training rows calibrates
CLASSES = [b" \t\r\x0b\x0c", b"\n", bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58)), b"!", b".", b",;:?", b"*", b"#", b"$", b"%", b"&", b"|", b"<>", b"()[]{}\"'", b"-_/\\@=+~^`", bytes(range(128, 256))]
_OF_CLASS = np.array([[b in c for b in range(256)] for c in CLASSES], float).T


def statistics(text: str) -> np.ndarray:
    """Real-valued description of one whole text."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    if not n:
        return np.zeros(N_STATS)
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    shares = seen @ _OF_CLASS / len(raw)
    p = seen[seen > 0] / len(raw)
    counts = Counter(words)
    times = np.fromiter(counts.values(), float, len(counts))
    lengths = np.fromiter(map(len, words), float, n)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    pairs = len(set(zip(words, words[1:]))) / max(1, n - 1)
    more = [
        np.log1p(len(raw)),
        np.log1p(n),
        lengths.mean(),
        lengths.std(),
        lengths.max() ** 0.5,
        (lengths <= 3).mean(),
        sum(map(bytes.isupper, words)) / n,
        sum(map(bytes.isalpha, words)) / n,
        len(counts) / n,
        len(counts) / n**0.7,
        times.max() / n,
        -(times / n * np.log2(times / n)).sum() / np.log2(n + 1),
        pairs,
        sum(map(eq, words, words[1:])) / n,
        np.log1p(len(lines)),
        1 - len(set(lines)) / len(lines),
        np.log1p(n / len(lines)),
        -(p * np.log2(p)).sum(),
        np.sqrt(shares[8:15].sum()),
    ]
    return np.concatenate([np.sqrt(shares), more])


N_STATS = len(CLASSES) + 19


def describe(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every row, as an array of floats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t.as_py() or "") for t in batch.column(1)]
            flat = np.concatenate(rows or [np.zeros(0)]).astype(np.float32)
            ends = np.arange(len(rows) + 1, dtype=np.int32) * N_STATS
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(ends, flat)], ["doc_id", "stats"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, stats array<float>")


def _matrix(batch: pa.RecordBatch, name: str = "stats") -> np.ndarray:
    flat = batch.column(batch.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False)
    return flat.astype(float).reshape(-1, N_STATS)


def summed(rows: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """Sum of ``part`` over all batches: each task adds up its own, then Spark adds the tasks'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(size), False
        for batch in batches:
            if batch.num_rows:
                total, some = total + part(batch), True
        if some:
            yield pa.record_batch([pa.array(np.arange(size)), pa.array(total)], ["place", "value"])

    sums = rows.mapInArrow(lean(run), "place long, value double").groupBy("place").agg(F.sum("value").alias("value"))
    out = np.zeros(size)
    for r in sums.collect():  # ``size`` rows, fixed by the model
        out[r["place"]] = r["value"]
    return out


class Model:
    """Standardisation, projection, ridge weights and the calibrated steps."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        random = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.turn = random.normal(size=(N_STATS, FEATURES)) / np.sqrt(N_STATS)
        self.shift = random.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.at, self.level = np.array([0.0]), np.array([0.5])

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -5, 5)
        cosines = np.cos(x @ self.turn + self.shift) * np.sqrt(2 / FEATURES)
        return np.hstack([cosines, np.ones((len(x), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.at, self.level), 0, 1)


def isotonic(at: np.ndarray, n: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins in order: block centres and their levels."""
    blocks: list[list[float]] = []
    for a, k, y in zip(at, n, ones):
        blocks.append([a * k, k, y])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            top = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], top)]
    b = np.array(blocks)
    return b[:, 0] / b[:, 1], b[:, 2] / b[:, 1]


def fit(rows: DataFrame) -> Model:
    """Model from rows of doc_id, stats and label (0 to 1)."""
    moments = summed(
        rows.select("stats", "label"),
        lambda b: (lambda x: np.concatenate([[len(x)], x.sum(0), (x**2).sum(0)]))(_matrix(b)),
        1 + 2 * N_STATS,
    )
    n = moments[0]
    if not n:
        return Model(np.zeros(N_STATS), np.ones(N_STATS))
    mean = moments[1 : 1 + N_STATS] / n
    scale = np.sqrt(np.maximum(moments[1 + N_STATS :] / n - mean**2, 0))
    model = Model(mean, np.where(scale > 1e-6, scale, 1.0))
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)) == 0
    upper = np.triu_indices(FEATURES + 1)

    def equations(batch: pa.RecordBatch) -> np.ndarray:
        z = model.features(_matrix(batch))
        y = batch.column(1).to_numpy(zero_copy_only=False)
        return np.concatenate([(z.T @ z)[upper], z.T @ y])

    sums = summed(rows.where(~fold).select("stats", "label"), equations, len(upper[0]) + FEATURES + 1)
    left = np.zeros((FEATURES + 1, FEATURES + 1))
    left[upper] = sums[: len(upper[0])]
    left = left + np.triu(left, 1).T
    room = np.full(FEATURES + 1, RIDGE / 100 * np.trace(left) / (FEATURES + 1) + 1e-9)
    room[-1] = 1e-9
    model.weights = np.linalg.solve(left + np.diag(room), sums[len(upper[0]) :])

    def binned(batch: pa.RecordBatch) -> np.ndarray:
        k = np.clip((model.raw(_matrix(batch)) + 0.5) / 2 * BINS, 0, BINS - 1).astype(int)
        y = batch.column(1).to_numpy(zero_copy_only=False)
        return np.concatenate([np.bincount(k, minlength=BINS), np.bincount(k, y, BINS)])

    held = summed(rows.where(fold).select("stats", "label"), binned, 2 * BINS)
    held += summed(rows.where(~fold).select("stats", "label"), binned, 2 * BINS) * 0.05
    has = np.flatnonzero(held[:BINS])
    if len(has):
        model.at, model.level = isotonic((has + 0.5) / BINS * 2 - 0.5, held[:BINS][has], held[BINS:][has])
    return model


def apply(described: DataFrame, model: Model) -> DataFrame:
    """doc_id and score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.score(_matrix(batch)) if batch.num_rows else np.zeros(0)
            yield pa.record_batch([batch.column(0), pa.array(scores)], ["doc_id", "score"])

    kind = described.schema["doc_id"].dataType.simpleString()
    return described.mapInArrow(lean(run), f"doc_id {kind}, score double")


def train(described: DataFrame, labels: DataFrame) -> Model:
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id")
    known = known.agg(F.avg(F.col("quality").cast("double")).alias("label"))
    learnt = described.where(~held_out(F.col("doc_id"), 3, 1)).join(known, "doc_id")
    rows = stored(learnt, "labelled")
    return fit(rows)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    prepare(docs.sparkSession)
    described = stored(describe(docs), "stats")
    return apply(described, train(described, labels)).select(
        "doc_id",
        held_out(F.col("doc_id"), 3, 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` that are predicted 1, columns unchanged."""
    prepare(docs.sparkSession)
    model = train(stored(describe(docs), "stats"), labels)
    row = docs.select(F.struct("*").alias("row"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                stats = np.stack([statistics(t.as_py() or "") for t in batch.column(1)])
                good = pa.array(model.score(stats) >= 0.5)
                yield batch.select([0]).filter(good)

    return row.mapInArrow(lean(run), f"row {row.schema['row'].dataType.simpleString()}").select("row.*")
