"""Quality rules from tokeniser fertility, with bands per language or script.

Two public vocabularies split each text: one with byte fallback, and a byte-level one for
many languages (``multi_`` measures). Characters per token, the share of byte-fallback
tokens and the entropy of the token counts (bits, divided by the most that so many tokens
can have) say how foreign a text is to them. The other public files are of one language
each and byte-level or without fallback, and would measure the same again. Bands come from all
documents: per language (without one: per main script) the quartiles of each measure,
widened by ``REACH`` times their distance on either side and never narrower than
``LEAST``. A text outside a band is rejected; so is one that fails the base rules.

Defined results: null and empty texts have zero counts, null measures, and fail the base
rules; groups of fewer than ``FEW`` texts are judged by the bands of all; ties and
repeated rows are judged alike; an empty table gives no rows. Whole texts are split,
one at a time, so memory follows the longest text. Extra columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import prepare, stored, worker_state
from ledgerspark.llm.packing import PATTERN

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MULTI = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
MEASURES = ("chars_per_token", "byte_share", "entropy", "multi_chars_per_token", "multi_entropy")
LEAST = {"chars_per_token": 0.25, "byte_share": 0.05, "entropy": 0.05, "multi_chars_per_token": 0.25, "multi_entropy": 0.05}
REACH = 3.0
FEW = 20
LEAST_WORDS = 50
MOST_REPEATS = 50  # percent of the words
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
SCRIPTS = (("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("arabic", 0x600, 0x6FF), ("han", 0x4E00, 0x9FFF))
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words that stand in a window of ``width`` words found twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
    key = ids[:n]
    for k in range(1, width):
        if len(index) > 1 << 20:  # the next product could pass 63 bits
            key = np.unique(key, return_inverse=True)[1]
        key = key * len(index) + ids[k : n + k]
    order = np.argsort(key, kind="stable")
    same = np.diff(key[order]) == 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for k in range(width):
        covered[k : n + k] |= twice
    return int(covered.sum())


def counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    raw = text.encode()
    words = raw.split()
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    return (
        len(words),
        len(text) - (len(raw) - len(raw.translate(None, SPACES))),
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def script(text: str) -> str:
    """The script of most letters among ``SCRIPTS``; none: other."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    sums = [int(((points >= low) & (points <= high)).sum()) for _, low, high in SCRIPTS]
    return SCRIPTS[int(np.argmax(sums))][0] if any(sums) else "other"


def entropy(ids: np.ndarray, size: int) -> float:
    """Bits per token, divided by the most that so many tokens of ``size`` kinds can have."""
    p = np.unique(ids, return_counts=True)[1] / len(ids)
    return float(-(p * np.log2(p)).sum() / (np.log2(min(len(ids), size)) or 1.0))


def measure(docs: DataFrame, model: bytes, multi: bytes) -> DataFrame:
    """doc_id, lang, script (where there is no lang), counts and the measures of every row."""
    id_kind = docs.schema["doc_id"].dataType.simpleString()

    def splitters():
        import sentencepiece
        import tiktoken

        kept = worker_state()
        if kept.get("fertility_models") != (model, multi):
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, multi.splitlines())}
            kept["fertility_models"] = model, multi
            kept["fertility"] = (
                sentencepiece.SentencePieceProcessor(model_proto=model),
                tiktoken.Encoding("multi", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}),
            )
        return kept["fertility"]

    def one(text: str, pieces, many, byte: np.ndarray) -> tuple:
        ids = np.array(pieces.encode(text), np.int64)
        if not len(ids):
            return (None,) * len(MEASURES)
        other = np.array(many.encode_ordinary(text), np.int64)
        return (
            len(text) / len(ids), float(byte[ids].mean()), entropy(ids, len(byte)),
            len(text) / len(other), entropy(other, many.n_vocab),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, many = splitters()
        byte = np.array([pieces.is_byte(k) for k in range(pieces.vocab_size())])
        for batch in batches:
            rows = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            texts = [(None if lang is not None else script(t or ""), t or "") for lang, t in rows]  # only asked for without a language
            columns = list(zip(*((s, *counts(t), *one(t, pieces, many, byte)) for s, t in texts))) or [()] * (6 + len(MEASURES))
            kinds = [pa.string(), *[pa.int64()] * 5, *[pa.float64()] * len(MEASURES)]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            yield pa.record_batch([batch.column(0), batch.column(1), *arrays], _NAMES)

    measures = ", ".join(f"{m} double" for m in MEASURES)
    return docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text").mapInArrow(
        run, f"doc_id {id_kind}, lang string, script string, {COUNTS}, {measures}"
    )


_NAMES = ["doc_id", "lang", "script", *(c.split()[0] for c in COUNTS.split(", ")), *MEASURES]


def bands(measured: DataFrame) -> DataFrame:
    """One row per group, and one of all (null group), with the two ends of each measure.

    Quartiles are sketches that tasks combine, so a group of any size is no burden; the
    result has a row per language or script.
    """
    ends = [F.count("*").alias("members")]
    for m in MEASURES:
        q = F.percentile_approx(m, [0.25, 0.75], 10000)
        room = F.greatest((q[1] - q[0]) * REACH, F.lit(LEAST[m]))
        ends += [(q[0] - room).alias(f"{m}_low"), (q[1] + room).alias(f"{m}_high")]
    known = measured.where("chars_per_token is not null")
    per = known.groupBy(group().alias("group")).agg(*ends).where(F.col("members") >= FEW)
    return per.unionByName(known.agg(*ends).withColumn("group", F.lit(None).cast("string")))


def group():
    return F.coalesce(F.concat(F.lit("lang:"), F.col("lang")), F.concat(F.lit("script:"), F.col("script")))


def judge(docs: DataFrame, model_path: str = MODEL, multi_path: str = MULTI) -> DataFrame:
    """doc_id, counts, measures, base_failed and kept of every row of ``docs``."""
    prepare(docs.sparkSession)
    # half a megabyte each, read once and sent with the tasks
    with open(model_path, "rb") as f, open(multi_path, "rb") as g:
        model, multi = f.read(), g.read()
    measured = stored(measure(docs, model, multi), "fertility")
    limits = stored(bands(measured), "bands")
    every = limits.where("`group` is null").drop("group", "members")
    every = every.select(*[F.col(c).alias(f"all_{c}") for c in every.columns]).first()
    own = limits.where("`group` is not null").drop("members").withColumnRenamed("group", "own_group")
    rows = measured.join(own, group() == F.col("own_group"), "left")
    inside = F.lit(True)
    for m in MEASURES:
        low, high = (F.coalesce(F.col(f"{m}_{e}"), F.lit(every[f"all_{m}_{e}"])) for e in ("low", "high"))
        inside &= F.coalesce(F.col(m).between(low, high), F.lit(False))
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATS)
    return rows.withColumn("base_failed", failed).withColumn("in_band", inside).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("in_band")).alias("kept"), *MEASURES,
    )
