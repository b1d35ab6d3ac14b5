"""Dense row numbers without a single-task window.

``store_in_order`` range-partitions and sorts rows into files; a row's number is
then its file's offset plus its position in the file. Files are fixed once
written, so the number survives executor loss, and a hot key is spread over
several ranges by the later ordering columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FILE_PARTS = r"part-([0-9]+)-.*?(?:-c([0-9]+))?(?:\.[a-z0-9]+)*$"


def file_order(path: Column) -> Column:
    """Sort key of a Spark output file: writing task, then file within the task."""
    name = F.element_at(F.split(path, "/"), -1)
    number = [
        F.coalesce(F.regexp_extract(name, _FILE_PARTS, i).try_cast("int"), F.lit(0))
        for i in (1, 2)
    ]
    return F.struct(*number, name)


def store_in_order(
    df: DataFrame, path: str, order: list[str], keep: list[str], most: int = 0
) -> None:
    """Write ``keep`` columns globally sorted by ``order``, one key range per task.

    A range of more than ``most`` rows, if given, goes to several files.
    """
    (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(*keep)
        .write.mode("overwrite")
        .option("maxRecordsPerFile", most)
        .parquet(path)
    )


def store_segments(rows: DataFrame, path: str, keys: list[str], per: list[str]) -> None:
    """Offset of each run of rows of a stored table, in physical order.

    A run is what ``keys`` tell apart: a file, an input split, or a group's part of
    one. There is one row per run, so the window below sees file counts, not data;
    storing the result lets Spark judge its size by its files when it is joined.
    """
    runs = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_index").alias("_first")
    )
    physical = [file_order(F.col("_file")), *(["_start"] if "_start" in keys else [])]
    within = Window.partitionBy(*per) if per else Window.partitionBy()
    before = within.orderBy(*physical).rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")
    runs.select(*keys, offset.alias("_offset")).write.mode("overwrite").parquet(path)


def stored_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path).select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.row_index").alias("_index"),
    )


def with_position(rows: DataFrame, segments: DataFrame, name: str) -> DataFrame:
    """1-based position of each row within its group, in physical order."""
    keys = [c for c in segments.columns if c != "_offset"]
    return (
        rows.join(segments, keys)
        .withColumn(name, F.col("_index") + F.col("_offset") + 1)
        .drop("_file", "_start", "_index", "_offset")
    )


def numbered_in_order(
    df: DataFrame,
    path: str,
    order: list[str],
    keep: list[str],
    name: str,
    per: list[str] = (),
    most: int = 0,
) -> DataFrame:
    """Store ``df`` in order under ``path`` and read it back numbered per group."""
    spark, per = df.sparkSession, list(per)
    store_in_order(df, f"{path}/rows", order, keep, most)
    schema = df.select(*keep).schema
    rows = stored_rows(spark, f"{path}/rows", schema)
    store_segments(rows, f"{path}/segments", ["_file", *per], per)
    return numbered_stored(spark, path, schema, name)


def numbered_stored(spark: SparkSession, path: str, schema: T.StructType, name: str) -> DataFrame:
    """The numbered rows that ``numbered_in_order`` has stored under ``path``."""
    segments = spark.read.parquet(f"{path}/segments")
    return with_position(stored_rows(spark, f"{path}/rows", schema), segments, name)


def numbered_few(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Dense numbers from 1 of rows that are few enough for one task (see ``frames.few``)."""
    return df.coalesce(1).withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))


# Hex digits of a SHA-256 id that split a group at least: 256 even parts.
ID_PREFIX_DIGITS = 2
MOST_IN_PREFIX = 1 << 20  # rows that one task numbers


def prefix_digits(rows: int, most: int = MOST_IN_PREFIX, digits: int = ID_PREFIX_DIGITS) -> int:
    """Hex digits, ``digits`` at least, for parts of about ``most`` or fewer of ``rows`` SHA-256 ids.

    Digests spread evenly, so every prefix of one length holds about as many ids.
    """
    while rows > most * 16**digits:
        digits += 1
    return digits


def numbered_by_hash_id(
    df: DataFrame,
    id_column: str,
    groups: list[str],
    name: str,
    start: int,
    digits: int = ID_PREFIX_DIGITS,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Dense numbers after ``start``, ordered by (groups, id), ids being SHA-256 text.

    The leading hex digits order and evenly split any group, however large, so
    numbering inside (groups, prefix) plus the exact count of earlier buckets is
    dense without one task seeing a whole group. Prefixes are summed within their
    group, and only group totals, one row each, are summed over all groups. The ids
    are read twice, once to be counted: ``counted`` is a stored table or a narrow plan
    over one with the same ids, ``df`` itself if not given. The rows come out dealt
    by group and prefix.
    """
    bucket = F.substring(id_column, 1, digits).alias("_bucket")
    keyed = df if "_bucket" in df.columns else df.select("*", bucket)
    keys = [*groups, "_bucket"]
    seen = (df if counted is None else counted).select(*groups, bucket)
    buckets = seen.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    inside = Window.partitionBy(*groups).orderBy("_bucket")
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    totals = buckets.groupBy(*groups).agg(F.sum("_n").alias("_total"))
    earlier = Window.orderBy(*groups).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*groups, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"))
    offsets = (
        buckets.withColumn("_inside", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
        .join(before, groups)
        .select(*keys, (F.col("_before") + F.col("_inside")).alias("_offset"))
    )
    within = Window.partitionBy(*keys).orderBy(id_column)
    return (
        keyed.withColumn("_n", F.row_number().over(within))
        .join(offsets, keys)
        .withColumn(name, F.lit(start) + F.col("_offset") + F.col("_n"))
        .drop("_bucket", "_n", "_offset")
    )
