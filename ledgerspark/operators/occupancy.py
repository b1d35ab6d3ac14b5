"""Which row numbers of each sheet are taken, as one bit per line.

A line's id is the digest of its sheet and row number, so a bit per row number tells
exactly whether an id is known, at a five-hundredth of the size of the ids. Rows of the
index are sorted by sheet and word, so a read for some row numbers skips the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerspark.functions.frames import compact, few
from ledgerspark.functions.predicates import count_where
from ledgerspark.sources.raw import source_row_id

BLOCK_BITS = 10  # 1,024 words, or 65,536 row numbers, stay together
OCCUPIED_SCHEMA = T.StructType(
    [
        T.StructField("source_sheet", T.StringType()),
        T.StructField("word", T.LongType()),
        T.StructField("bits", T.LongType()),
    ]
)


def _word() -> Column:
    return F.shiftright(F.col("source_row_number"), 6)


def _bit() -> Column:
    place = F.col("source_row_number").bitwiseAND(F.lit(63)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def occupied(lines: DataFrame, rows: int | None = None) -> DataFrame:
    """(source_sheet, word, bits) of the lines' row numbers, 64 to a word, in order within each task.

    A task holds whole blocks of neighbouring words, so a file covers few ranges of row
    numbers and no sampling pass is needed to find them. Few lines, ``rows`` at most, are
    one task's work.
    """
    words = lines.select("source_sheet", _word().alias("word"), _bit().alias("bit"))
    dealt = compact(words.withColumn("block", F.shiftright("word", BLOCK_BITS)), rows)
    if not few(rows):
        dealt = dealt.repartition("source_sheet", "block")
    found = dealt.groupBy("source_sheet", "block", "word").agg(F.bit_or("bit").alias("bits"))
    return found.select("source_sheet", "word", "bits").sortWithinPartitions("source_sheet", "word")


def _words(lines: DataFrame) -> DataFrame:
    """(source_sheet, word, bits, n) of the lines, combined before the shuffle."""
    words = lines.select("source_sheet", _word().alias("word"), _bit().alias("bit"))
    return words.groupBy("source_sheet", "word").agg(F.bit_or("bit").alias("bits"), F.count(F.lit(1)).alias("n"))


def all_distinct(lines: DataFrame) -> bool:
    """Whether every line has an id, which is its digest of sheet and row number, and none repeats.

    Two such ids are equal only if sheet and row number are, so a bit per row number tells
    what would otherwise take a shuffle of all ids. False says nothing: the ids themselves
    must then be counted.
    """
    if not {"source_sheet", "source_row_number", "source_row_id"} <= set(lines.columns):
        return False
    own = F.col("source_row_id") == source_row_id(F.col("source_sheet"), F.col("source_row_number"))
    odd = lines.agg(count_where(~F.coalesce(own, F.lit(False)))).first()[0]
    return not odd and not _words(lines).filter(F.bit_count("bits") != F.col("n")).limit(1).count()


def all_or_none(lines: DataFrame, index: DataFrame) -> bool | None:
    """True if every row number of the lines is in the index, False if none is, None if some are."""
    taken = index.groupBy("source_sheet", "word").agg(F.bit_or("bits").alias("taken"))
    met = _words(lines).join(taken, ["source_sheet", "word"], "left").select(
        F.coalesce(F.bit_count(F.col("bits").bitwiseAND(F.col("taken"))), F.lit(0)).alias("known"),
        F.bit_count("bits").alias("asked"),
    )
    known, asked = met.agg(F.coalesce(F.sum("known"), F.lit(0)), F.coalesce(F.sum("asked"), F.lit(0))).first()
    return True if known == asked else None if known else False


def within(index: DataFrame, sheets: dict[str, tuple[int, int]]) -> DataFrame:
    """Rows of an index that can concern the row numbers ``low`` to ``high`` of each sheet.

    One range over all sheets is compared at the scan, where it skips row groups.
    """
    low, high = min(b[0] for b in sheets.values()) >> 6, max(b[1] for b in sheets.values()) >> 6
    return index.filter(F.col("word").between(low, high))


def unoccupied(lines: DataFrame, index: DataFrame) -> DataFrame:
    """Lines whose row number is not in the index; columns unchanged."""
    taken = index.groupBy("source_sheet", "word").agg(F.bit_or("bits").alias("_bits"))
    taken = taken.withColumnRenamed("source_sheet", "_sheet").withColumnRenamed("word", "_word")
    same = (lines["source_sheet"] == taken["_sheet"]) & (_word() == taken["_word"])
    joined = lines.join(taken, same & (taken["_bits"].bitwiseAND(_bit()) != 0), "left_anti")
    return joined.select(*lines.columns)
