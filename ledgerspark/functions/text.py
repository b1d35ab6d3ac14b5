"""Text rules of the contract as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Every character Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    """``c`` without outer whitespace; text between visible ASCII characters is left as it is."""
    last = F.right(c, F.lit(1))
    clean = (c >= "!") & (c < "\x7f") & (last >= "!") & (last < "\x7f")
    return F.when(clean, c).otherwise(F.btrim(c, F.lit(WHITESPACE)))


def is_blank(c: Column, dtype: T.DataType) -> Column:
    """Non-null text with nothing but whitespace; never true for typed columns."""
    if not isinstance(dtype, T.StringType):
        return F.lit(False)
    return F.coalesce(strip(c) == "", F.lit(False))


def is_missing(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StringType):
        return c.isNull() | (strip(c) == "")
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def optional_text(c: Column) -> Column:
    return F.nullif(strip(c.cast("string")), F.lit(""))


_LIMB = 10**9
_SHIFT = 29  # a limb times two to this fits a long


def _times(limbs: Column, factor: Column) -> Column:
    """Limbs of nine digits, lowest first, times a factor of at most 2^29."""
    start = F.struct(F.array().cast("array<bigint>").alias("done"), F.lit(0).cast("bigint").alias("carry"))

    def step(acc: Column, limb: Column) -> Column:
        product = limb * factor + acc["carry"]
        low = F.array(product % _LIMB)
        return F.struct(F.concat(acc["done"], low).alias("done"), F.call_function("div", product, F.lit(_LIMB)).alias("carry"))

    return F.aggregate(limbs, start, step, lambda acc: F.concat(acc["done"], F.array(acc["carry"])))


def large_digits(c: Column) -> Column:
    """Every digit of a double of 2^53 or more: its leading part times a power of two."""
    size = F.abs(c)
    power = F.greatest(F.floor(F.log2(size)) - 61, F.lit(0)).cast("int")
    part = F.lpad((size / F.pow(F.lit(2.0), power)).cast("bigint").cast("string"), 27, "0")  # exact: a power of two
    limbs = F.array(*[F.substring(part, k, 9).cast("bigint") for k in (19, 10, 1)])
    times = F.call_function("div", power, F.lit(_SHIFT)).cast("int")
    whole = F.aggregate(
        F.array_repeat(F.lit(1 << _SHIFT).cast("bigint"), times), limbs, lambda acc, factor: _times(acc, factor)
    )
    rest = F.pow(F.lit(2.0), power % _SHIFT).cast("bigint")
    digits = F.transform(F.reverse(_times(whole, rest)), lambda x: F.lpad(x.cast("string"), 9, "0"))
    return F.concat(F.when(c < 0, "-").otherwise(""), F.ltrim(F.array_join(digits, ""), F.lit("0")))


def identifier(c: Column, dtype: T.DataType, upper: bool = False) -> Column:
    """Text identity of an invoice number or stock code.

    A whole *number* loses its ``.0``; *text* keeps its digits as written.
    """
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        c = c.cast("double")
        text = (
            F.when(F.isnan(c), F.lit(None).cast("string"))
            .when(c == float("inf"), F.lit("inf"))
            .when(c == float("-inf"), F.lit("-inf"))
            .when(F.abs(c) >= float(1 << 53), large_digits(c))  # all of these are whole
            .when(c == F.floor(c), c.cast("bigint").cast("string"))
            .otherwise(c.cast("string"))
        )
    elif isinstance(dtype, T.DecimalType):
        text = F.when(c == F.floor(c), c.cast(T.DecimalType(38, 0)).cast("string")).otherwise(
            c.cast("string")
        )
    elif isinstance(dtype, T.BooleanType):
        text = F.initcap(c.cast("string"))
    else:
        text = strip(c.cast("string"))
    text = F.nullif(text, F.lit(""))
    return F.upper(text) if upper else text


def utf16_units(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16LE")) / 2).cast("int")


def ordered_codes(masks: dict[str, Column]) -> Column:
    """``A;B;C`` of the codes whose mask holds, in mapping order; empty when none."""
    return F.concat_ws(";", *[F.when(mask, F.lit(code)) for code, mask in masks.items()])
