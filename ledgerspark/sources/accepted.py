"""Accepted and rejected sinks, their verification, and month-wise reads."""

from __future__ import annotations

from datetime import date
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerspark.functions.frames import compact, distinct_counts, few, side_by_side
from ledgerspark.functions.predicates import count_where
from ledgerspark.functions.text import utf16_units
from ledgerspark.operators import occupancy
from ledgerspark.schema import (
    ACCEPTED_SCHEMA,
    ACCEPTED_TABLE_SCHEMA,
    NULLABLE_TEXT,
    TEXT_LIMITS,
    assert_signature,
)
from ledgerspark.sources import storage

MAX_ROWS_PER_FILE = 100_000
ROW_ID = r"\A[0-9a-f]{64}\z"
PARTITION_FOLDER = r"/year=[0-9]{4}/month=(?:0[1-9]|1[0-2])/[^/]+$"


def with_partitions(df: DataFrame) -> DataFrame:
    """Zero-padded text ``year`` and ``month`` of the invoice month."""
    return df.withColumn("year", F.date_format("batch_month", "yyyy")).withColumn(
        "month", F.date_format("batch_month", "MM")
    )


def by_month(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Lines dealt to tasks by month; a large month is split and small ones share a task.

    Spark sizes the tasks from the shuffled bytes, so no month is one task's work
    because of its size, and no task writes to every month. Few lines, ``rows`` at most,
    are one task's work.
    """
    if few(rows):
        return compact(df, rows)
    return df.hint("rebalance", F.col("year"), F.col("month"))


def append_by_month(
    df: DataFrame,
    path: str,
    mode: str = "append",
    max_rows: int = MAX_ROWS_PER_FILE,
    rows: int | None = None,
    dealt: bool = False,
) -> None:
    """Write lines under ``year=YYYY/month=MM``; the input is evaluated once.

    Lines that are ``dealt`` lie in tasks of a few months each and are written from there.
    """
    lines = with_partitions(df)
    (
        (lines if dealt else by_month(lines, rows))
        .write.mode(mode)
        .option("maxRecordsPerFile", max_rows)
        .partitionBy("year", "month")
        .parquet(path)
    )


def write_accepted(
    df: DataFrame, path: str, root: str, max_rows: int = MAX_ROWS_PER_FILE, dealt: bool = False
) -> None:
    """Replace the accepted dataset at ``path``, which must lie under ``root``.

    An empty dataset is refused before anything is replaced.
    """
    inside = path.rstrip("/").startswith(root.rstrip("/") + "/")
    if not inside or ".." in path.split("/"):
        raise ValueError(f"Refusing to replace {path}: it is not under {root}.")
    assert_signature(df.schema, ACCEPTED_SCHEMA, "accepted lines")
    if df.isEmpty():
        raise ValueError("An empty accepted dataset is not written.")
    append_by_month(df, path, "overwrite", max_rows, dealt=dealt)


def read_accepted(spark: SparkSession, path: str) -> DataFrame:
    """Accepted lines with text ``year``/``month``; a given schema keeps '01' as text."""
    return spark.read.schema(ACCEPTED_TABLE_SCHEMA).parquet(path)


def in_period(df: DataFrame, period: date) -> DataFrame:
    """Only one month's folders are listed and read: the filter is on the partition columns."""
    return df.filter(
        (F.col("year") == f"{period.year:04d}") & (F.col("month") == f"{period.month:02d}")
    )


def write_rejected(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    (writer.option("header", True).csv if fmt == "csv" else writer.parquet)(path)


def assert_every_signature(spark: SparkSession, path: str) -> None:
    """Fail if any file of an accepted dataset has other columns or types.

    Spark reads all footers in tasks and merges them, so a further column or another type
    shows wherever the file lies. A column that a file lacks is null in all its rows; for
    required columns that is counted per file.
    """
    try:
        merged = spark.read.option("mergeSchema", True).parquet(path)
    except (PySparkException, Py4JJavaError) as error:
        raise ValueError(f"Files under {path} disagree on a column: {error}") from error
    assert_signature(merged.drop("year", "month").schema, ACCEPTED_SCHEMA, path)
    required = [f.name for f in ACCEPTED_SCHEMA.fields if not f.nullable]
    holes = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in required])
    bad = read_accepted(spark, path).filter(holes).select(F.col("_metadata.file_path").alias("file"))
    first = bad.agg(F.min("file")).first()[0]
    if first:
        raise ValueError(f"{first} lacks a required column or value.")


def check_output(spark: SparkSession, path: str, max_rows: int = MAX_ROWS_PER_FILE) -> DataFrame:
    """One-row verification of an accepted dataset written with ``max_rows`` per file.

    The signature is that of every file; ids are counted in two steps so that
    uniqueness needs one shuffle with map-side combining.
    """
    assert_every_signature(spark, path)
    lines = read_accepted(spark, path).select(
        "source_row_id", "batch_month", "year", "month", F.col("_metadata.file_path").alias("file")
    )
    files = lines.groupBy("file", "year", "month").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("batch_month").alias("low"),
        F.max("batch_month").alias("high"),
    )
    label = F.concat_ws("-", "year", "month", F.lit("01")).cast("date")
    by_file = files.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.count(F.lit(1)).alias("file_count"),
        F.countDistinct("year", "month").alias("partition_count"),
        F.min("low").alias("minimum_batch_month"),
        F.max("high").alias("maximum_batch_month"),
        count_where(~F.col("file").rlike(PARTITION_FOLDER)).alias("bad_partition_folders"),
        count_where((F.col("low") != label) | (F.col("high") != label)).alias("misplaced_files"),
        count_where(F.col("n") > max_rows).alias("oversized_files"),
    )
    ids = (
        lines.groupBy("source_row_id")
        .count()
        .agg(
            count_where((F.col("count") > 1) | F.col("source_row_id").isNull()).alias(
                "duplicate_or_missing_ids"
            )
        )
    )
    return side_by_side(by_file, ids)


def text_length_profile(lines: DataFrame) -> DataFrame:
    """Longest UTF-16 length, over-limit and missing-required rows of each text column."""
    wide = lines.agg(
        *[F.coalesce(F.max(utf16_units(F.col(c))), F.lit(0)).alias(f"{c}_len") for c in TEXT_LIMITS],
        *[
            count_where(utf16_units(F.col(c)) > limit).alias(f"{c}_over")
            for c, limit in TEXT_LIMITS.items()
        ],
        *[count_where(F.col(c).isNull()).alias(f"{c}_null") for c in TEXT_LIMITS],
    )
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col(f"{c}_len").alias("maximum_units"),
            F.lit(limit).alias("unit_limit"),
            F.col(f"{c}_over").alias("over_limit_rows"),
            (F.lit(0) if c in NULLABLE_TEXT else F.col(f"{c}_null"))
            .cast("bigint")
            .alias("missing_required_rows"),
        )
        for c, limit in TEXT_LIMITS.items()
    ]
    return wide.select(F.inline(F.array(*rows)))


def staging_preflight(lines: DataFrame) -> DataFrame:
    """Rows, distinct members, time bounds, nulls and text widths of accepted lines."""
    c = F.col
    totals = lines.agg(
        F.count(F.lit(1)).alias("staging_rows"),
        F.min("invoice_datetime").alias("minimum_invoice_datetime"),
        F.max("invoice_datetime").alias("maximum_invoice_datetime"),
        count_where(c("customer_id").isNull()).alias("null_customer_rows"),
        count_where(c("country").isNull()).alias("null_country_rows"),
        *[
            F.max(utf16_units(c(name))).alias(f"maximum_{name}_units")
            for name in ("stock_code", "description", "customer_id", "country")
        ],
    )
    if occupancy.all_distinct(lines):
        ids = lines.agg(F.count(F.lit(1)).alias("distinct_source_row_ids"))
    else:
        ids = lines.groupBy("source_row_id").count().agg(
            count_where(c("source_row_id").isNotNull()).alias("distinct_source_row_ids")
        )
    names = {"customer_id": "known_customer_ids", "stock_code": "stock_codes", "country": "known_country_labels"}
    distinct = distinct_counts(lines, names)
    return side_by_side(totals, ids, distinct)


def periods(lines: DataFrame) -> DataFrame:
    """(period, row_count) from partition folders; only file footers are read."""
    return (
        lines.groupBy("year", "month")
        .agg(F.count(F.lit(1)).alias("row_count"))
        .select(
            F.concat_ws("-", "year", "month", F.lit("01")).cast("date").alias("period"), "row_count"
        )
    )


def period_calendar(found: DataFrame) -> DataFrame:
    """Every month between the first and last period, with gaps marked.

    A calendar has one row per month of history, so its window stays small.
    """
    span = found.agg(F.min("period").alias("low"), F.max("period").alias("high"))
    months = span.filter(F.col("low").isNotNull()).select(
        F.explode(F.sequence("low", "high", F.expr("interval 1 month"))).alias("period")
    )
    joined = months.join(found, "period", "left")
    present = F.col("row_count").isNotNull()
    last_seen = F.max(F.when(present, F.col("period"))).over(
        Window.orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    )
    return joined.select(
        "period",
        F.coalesce("row_count", F.lit(0)).alias("row_count"),
        (~present).alias("is_missing"),
        last_seen.alias("previous_period"),
        F.coalesce(F.add_months(last_seen, 1) == F.col("period"), F.lit(True)).alias(
            "follows_previous"
        ),
    )


def source_periods(
    spark: SparkSession, path: str, approved: tuple[date, date] | None = None
) -> list[date]:
    """Ordered months of a dataset from its folder names; gaps and a wrong range fail."""
    found = sorted(
        date(int(y[5:]), int(m[6:]), 1)
        for y in storage.children(spark, path)
        if y.startswith("year=") and len(y) == 9 and y[5:].isdigit()
        for m in storage.children(spark, f"{path}/{y}")
        if m.startswith("month=") and len(m) == 8 and m[6:].isdigit() and 1 <= int(m[6:]) <= 12
    )
    if not found:
        raise ValueError(f"No year/month partitions under {path}.")
    if approved and (found[0], found[-1]) != approved:
        raise ValueError(f"Periods {found[0]} to {found[-1]} are not the approved {approved}.")
    for earlier, later in zip(found, found[1:]):
        if next_month(earlier) != later:
            raise ValueError(f"Missing source partition between {earlier} and {later}.")
    return found


def next_month(period: date) -> date:
    return date(period.year + period.month // 12, period.month % 12 + 1, 1)


def inspect_periods(lines: DataFrame) -> DataFrame:
    """Per month folder: rows, ids, misplaced rows and time bounds."""
    c = F.col
    label = F.concat_ws("-", "year", "month", F.lit("01")).cast("date")
    outside = (c("batch_month") != c("period")) | (F.trunc("invoice_datetime", "MM") != c("period"))
    bad_id = c("source_row_id").isNull() | ~c("source_row_id").rlike(ROW_ID)
    per_id = (
        lines.withColumn("period", label)
        .groupBy("period", "source_row_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            count_where(F.coalesce(outside, F.lit(True))).alias("outside"),
            count_where(bad_id).alias("bad_id"),
            F.min("invoice_datetime").alias("low"),
            F.max("invoice_datetime").alias("high"),
        )
    )
    return per_id.groupBy("period").agg(
        F.sum("n").alias("row_count"),
        F.count(F.lit(1)).alias("distinct_source_row_ids"),
        count_where(c("n") > 1).alias("duplicated_source_row_ids"),
        F.sum("bad_id").alias("invalid_source_row_ids"),
        F.sum("outside").alias("out_of_period_rows"),
        F.min("low").alias("minimum_invoice_datetime"),
        F.max("high").alias("maximum_invoice_datetime"),
    )


def inspect_period(spark: SparkSession, path: str, period: date) -> dict:
    """Check one month before it is loaded; any problem fails the run."""
    rows = inspect_periods(in_period(read_accepted(spark, path), period)).collect()
    if not rows:
        raise ValueError(f"No accepted lines for {period} under {path}.")
    return assert_inspected(rows[0].asDict())


def assert_inspected(found: dict) -> dict:
    """The inspection of one month, or an error that names its first problem."""
    for problem in ("duplicated_source_row_ids", "invalid_source_row_ids", "out_of_period_rows"):
        if found[problem]:
            raise ValueError(f"Period {found['period']}: {problem} = {found[problem]}.")
    return found
