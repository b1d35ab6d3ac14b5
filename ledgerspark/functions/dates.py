"""Invoice timestamps and calendar months as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerspark.functions.text import strip

# Text layouts tried after the ISO form, month before day.
EXTRA_LAYOUTS = (
    "M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy h:mm:ss a", "M/d/yyyy h:mm a", "M/d/yyyy",
    "yyyy/M/d H:mm:ss", "yyyyMMdd", "MMM d, yyyy", "MMMM d, yyyy", "MMM d, yyyy H:mm", "d MMM yyyy",
    "d MMMM yyyy", "d-MMM-yyyy", "d-MMM-yyyy H:mm",
)
LAST_YEAR = 9999


def wall_clock(c: Column, dtype: T.DataType) -> Column:
    """timestamp_ntz as written: an offset in the text is dropped, not applied."""
    if isinstance(dtype, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        return c.cast("timestamp_ntz")
    if not isinstance(dtype, T.StringType):
        return F.lit(None).cast("timestamp_ntz")
    text = strip(c)
    iso = text.try_cast("timestamp_ntz")
    return F.coalesce(
        # six digits alone would be read as one year
        F.when(F.year(iso).between(1, LAST_YEAR), iso),
        *[F.try_to_timestamp(text, F.lit(p)).cast("timestamp_ntz") for p in EXTRA_LAYOUTS],
    )


def whole_second(ts: Column) -> Column:
    return F.date_trunc("second", ts).cast("timestamp_ntz")


def month_start(ts: Column) -> Column:
    return F.trunc(ts.cast("date"), "MM")


def date_key(day: Column) -> Column:
    return F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)
