"""Small DataFrame helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


FEW_ROWS = 1 << 17  # lines of a month that one task handles without a shuffle


def few(rows: int | None) -> bool:
    """Whether ``rows``, None for an unknown number, are few enough for one task."""
    return rows is not None and rows <= FEW_ROWS


def compact(df: DataFrame, rows: int | None) -> DataFrame:
    """``df`` as one partition if it has few rows, so grouping and numbering need no shuffle.

    A small month's jobs are mostly the overhead of their stages; any more rows stay as
    they are and are shuffled.
    """
    return df.coalesce(1) if few(rows) else df


def side_by_side(*rows: DataFrame) -> DataFrame:
    """One-row frames with different columns as one row, without joining them."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def distinct_counts(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """One row with the distinct non-null values of each column (``names``: column -> name).

    A column is read by itself and its values are combined before the shuffle, so what
    moves grows with the values and not with the rows.
    """
    counts = [
        df.groupBy(column).agg(F.lit(1)).agg(F.count(column).alias(name)) for column, name in names.items()
    ]
    return side_by_side(*counts)
