"""Small document tables with every odd case, and one with clashing extra columns."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
# names that the operators use themselves
CLASHES = (
    "row", "key", "size", "rate", "copies", "shard", "class", "bucket", "block", "fp", "root", "keep_id", "score",
    "stats", "label", "media", "tokens", "decoded", "marked", "id", "crc", "low", "w", "v", "n", "held_out", "rule",
    "ids", "part", "nth", "length", "number", "sequence_id", "tree", "hash", "item", "leaf", "place", "kids", "proof", "changed",
)
PASSAGE = " ".join(f"shared{k}" for k in range(60))
LONG = " ".join(f"word{k % 997}x{k % 13}" for k in range(40_000))


def odd_rows():
    texts = [
        None, "", "   \n\t ", "one", "One two", "one TWO", PASSAGE, f"ahead {PASSAGE} behind", f"{PASSAGE}\n{PASSAGE}",
        "ünï cödé 漢字 🙂 ▁ sign", "a" * 3000, "the the the the " * 60, "x # * $ % & | < > y", LONG, LONG + " end", "line\nline\n\nline",
        "VAT 19 % 2\u00a0500 \u3000 wide", "<s> </s> <0x41> \x00 nul",
    ]
    rows = [(k, t, None if k % 5 == 0 else "en", None if k % 4 == 0 else f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    rows.append(rows[7])  # a repeated row
    rows.append((7, "another text of a known id " + PASSAGE, "en", "s1", 5))
    rows.append((None, PASSAGE, None, None, None))
    rows.append((None, None, None, None, None))
    rows += [(100 + k, "copy of a text with some few words in it", "de", "s9", 1) for k in range(30)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture(scope="session")
def clashing(odd):
    extra = [F.lit("own").alias(c) for c in CLASHES]
    return odd.select("*", *extra)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
