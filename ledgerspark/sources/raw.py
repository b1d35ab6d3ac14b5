"""Raw invoice-line sources: one folder or file per sheet, with physical lineage."""

from __future__ import annotations

from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerspark.functions.frames import side_by_side
from ledgerspark.operators.numbering import store_segments, with_position
from ledgerspark.schema import (
    FIRST_ROW_NUMBER,
    LINEAGE_COLUMNS,
    RAW_COLUMNS,
    RAW_TEXT_SCHEMA,
    assert_raw_header,
)
from ledgerspark.session import shared_folder


def source_row_id(sheet: Column, row_number: Column) -> Column:
    """SHA-256 of ``sheet|row`` in lower hex: identity by position, never by content."""
    return F.sha2(F.concat(sheet, F.lit("|"), row_number.cast("string")), 256)


def with_row_ids(lines: DataFrame) -> DataFrame:
    """Stored lines with all their ids: one that was left out is the digest of sheet and row number."""
    own = source_row_id(F.col("source_sheet"), F.col("source_row_number"))
    return lines.withColumn("source_row_id", F.coalesce("source_row_id", own))


def foreign_ids_only(lines: DataFrame) -> DataFrame:
    """Lines to be stored, with only such ids as ``with_row_ids`` cannot derive.

    An id is more than half of what a line takes on disk.
    """
    own = source_row_id(F.col("source_sheet"), F.col("source_row_number"))
    kept = F.when(~F.col("source_row_id").eqNullSafe(own), F.col("source_row_id"))
    return lines.withColumn("source_row_id", kept)


def without_row_ids(lines: DataFrame) -> DataFrame:
    """The same for lines whose ids are known to be digests."""
    return lines.withColumn("source_row_id", F.lit(None).cast("string"))


def with_row_lineage(df: DataFrame, sheet: str, fmt: str = "parquet") -> DataFrame:
    """Prefix a file-backed frame with sheet, physical row number and row id.

    A row's number is its file's or split's offset plus its place inside it; the
    offsets, one per file or split, are stored in the shared folder. Parquet knows a
    row's place in its file. Text does not, so a text sheet is first landed as
    Parquet, each row with its input split and its order in it: split boundaries may
    change from one scan to the next, so they are fixed by writing them down.
    """
    clash = sorted(set(LINEAGE_COLUMNS) & set(df.columns))
    if clash:
        raise ValueError(f"{sheet}: reserved lineage columns in source: {clash}")
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    work = f"{shared_folder(spark)}/ledgerspark/{app}/sheets/{uuid4().hex}"
    file = F.col("_metadata.file_path").alias("_file")
    if fmt == "parquet":
        rows, keys = df.select("*", file, F.col("_metadata.row_index").alias("_index")), ["_file"]
    else:
        keys = ["_file", "_start"]
        df.select(
            "*",
            file,
            F.col("_metadata.file_block_start").alias("_start"),
            F.monotonically_increasing_id().alias("_index"),
        ).write.parquet(f"{work}/rows")
        rows = spark.read.parquet(f"{work}/rows")
    store_segments(rows, f"{work}/segments", keys, [])
    numbered = with_position(rows, spark.read.parquet(f"{work}/segments"), "_position")
    number = F.col("_position") + FIRST_ROW_NUMBER - 1
    return (
        numbered.withColumn("source_sheet", F.lit(sheet))
        .withColumn("source_row_number", number.cast("bigint"))
        .withColumn(
            "source_row_id", source_row_id(F.col("source_sheet"), F.col("source_row_number"))
        )
        .select(*LINEAGE_COLUMNS, *df.columns)
    )


def read_sheet(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None
) -> DataFrame:
    """One sheet with its header checked; text formats default to all-string columns."""
    if fmt == "csv":
        # The header is checked on its own line only; data types are never inferred.
        header = spark.read.option("header", True).csv(path).columns
        assert_raw_header(header, path)
        reader = spark.read.schema(schema or RAW_TEXT_SCHEMA)
        # A record may hold line breaks; one with too few or too many fields fails the read.
        reader = reader.option("multiLine", True).option("mode", "FAILFAST")
        return reader.option("header", True).option("enforceSchema", False).csv(path)
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.format(fmt).load(path)
    assert_raw_header(df.columns, path)
    return df


def read_raw(
    spark: SparkSession,
    sheets: dict[str, str],
    fmt: str = "parquet",
    schema: T.StructType | None = None,
) -> DataFrame:
    """Union of all sheets, each read once, every physical occurrence kept."""
    if not sheets:
        raise ValueError("No source sheets were given.")
    frames = [
        with_row_lineage(read_sheet(spark, path, fmt, schema), name, fmt)
        for name, path in sheets.items()
    ]
    types = {tuple((f.name, f.dataType.simpleString()) for f in d.schema) for d in frames}
    if len(types) != 1:
        raise ValueError(f"Source sheets disagree on column types: {sorted(types)}")
    return reduce(DataFrame.unionByName, frames)


def lineage_violations(raw: DataFrame) -> DataFrame:
    """(check, violations) for sheet names, row numbers, supplied ids and identity.

    Physical identity is unique when no (sheet, row) repeats, so the id itself is
    only recomputed, never shuffled.
    """
    sheet, number = F.col("source_sheet"), F.col("source_row_number")
    bad_number = number.cast("double").isNull() | (number.cast("double") % 1 != 0) | (number < 2)
    mismatch = (
        ~F.col("source_row_id").eqNullSafe(source_row_id(sheet, number.cast("bigint")))
        if "source_row_id" in raw.columns
        else F.lit(False)
    )
    per_identity = raw.groupBy("source_sheet", "source_row_number").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(sheet.isNull() | (F.trim(sheet) == ""), 1)).alias("blank_sheet"),
        F.count(F.when(bad_number, 1)).alias("invalid_row_number"),
        F.count(F.when(mismatch, 1)).alias("row_id_mismatch"),
    )
    totals = per_identity.agg(
        *[
            F.coalesce(F.sum(c), F.lit(0)).alias(c)
            for c in ("blank_sheet", "invalid_row_number", "row_id_mismatch")
        ],
        F.count(F.when(F.col("n") > 1, 1)).alias("duplicate_identity"),
    )
    return totals.unpivot([], totals.columns, "check_name", "violations")


def validate_lineage(raw: DataFrame) -> None:
    """Fail the batch on any lineage violation."""
    failed = {r.check_name: r.violations for r in lineage_violations(raw).collect() if r.violations}
    if failed:
        raise ValueError(f"Source lineage is invalid: {failed}")


def sheet_row_counts(raw: DataFrame) -> DataFrame:
    """Rows per sheet and in total, compared with what the row numbers say.

    Numbers run from the first data row without a hole, so a sheet has as many rows as its
    last number implies; the total is counted by itself.
    """
    per_sheet = raw.groupBy("source_sheet").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min("source_row_number").alias("first"),
        F.max("source_row_number").alias("last"),
    )
    dense = (F.col("first") == FIRST_ROW_NUMBER) & (F.col("last") - F.col("first") + 1 == F.col("row_count"))
    per_sheet = per_sheet.select("source_sheet", "row_count", dense.alias("reconciled"))
    total = raw.agg(F.count(F.lit(1)).alias("combined_row_count"))
    summed = per_sheet.agg(F.coalesce(F.sum("row_count"), F.lit(0)).alias("sheet_row_count"))
    check = side_by_side(total, summed).select(
        F.lit("ALL SHEETS").alias("source_sheet"),
        F.col("combined_row_count").alias("row_count"),
        (F.col("combined_row_count") == F.col("sheet_row_count")).alias("reconciled"),
    )
    return per_sheet.unionByName(check)


def fingerprint(df: DataFrame, columns: list[str] = RAW_COLUMNS) -> DataFrame:
    """Order-free content fingerprint: equal before and after means nothing changed.

    A row's hash is the first 60 bits of the MD5 of its fields, null told from any text.
    The sum is kept beside the xor because equal pairs cancel out in an xor.
    """
    fields = [F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("~")) for c in columns]
    digest = F.md5(F.concat_ws("\x1f", *fields))
    row_hash = F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.bit_xor(row_hash).alias("xor_hash"),
        F.sum(row_hash.cast("decimal(38,0)")).alias("sum_hash"),
    )
