"""Lossless numbers from text.

A plain SQL cast rounds (``1.23451`` to ``1.2345``), so text is matched against
the number grammar first. Ordinary texts take a one-pattern fast path; the rest
are split into sign, significant digits and a power of ten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerspark.functions.text import strip
from ledgerspark.schema import INT32_MAX, INT32_MIN, PRICE_TYPE

# Number grammar, and the forms whose direct cast is exact.
NUMBER = r"\A[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"
_PARTS = r"\A([+-]?)([0-9]*)\.?([0-9]*)(?:[eE]([+-]?[0-9]+))?\z"
_PLAIN_PRICE = r"\A[+-]?[0-9]{1,15}(?:\.[0-9]{0,4})?\z"
_PLAIN_INT = r"\A[+-]?[0-9]{1,9}\z"
_PLAIN_ID = r"\A[+-]?[0-9]{1,18}(?:\.0*)?\z"
# Python refuses to print integers beyond this many digits.
_MAX_ID_DIGITS = 4300


def number_text(c: Column, dtype: T.DataType) -> Column:
    """Stripped text of a number column; booleans are not numbers."""
    if isinstance(dtype, T.BooleanType):
        return F.lit(None).cast("string")
    return strip(c.cast("string"))


def _plain_forms() -> dict:
    """kind -> (pattern, direct cast) of ordinary texts."""
    return {
        "price": (_PLAIN_PRICE, lambda t: t.try_cast(PRICE_TYPE)),
        "int32": (_PLAIN_INT, lambda t: t.try_cast("int")),
        "integer_text": (
            _PLAIN_ID,
            lambda t: F.substring_index(t, ".", 1).try_cast("bigint").cast("string"),
        ),
    }


def _general_form(kind: str, sign: Column, digits: Column, power: Column) -> Column:
    """Value of sign x digits x 10^power, or null when the kind cannot hold it exactly."""
    if kind == "price":
        fits = (power >= -4) & (F.length(digits) + power <= 15)
        text = F.concat(sign, digits, F.lit("E"), power.cast("string"))
        return F.when(digits == "", F.lit(0).cast(PRICE_TYPE)).when(
            fits, text.try_cast(PRICE_TYPE)
        )
    widest = _MAX_ID_DIGITS if kind == "integer_text" else 10
    whole = (power >= 0) & (F.length(digits) + power <= widest)
    text = F.when(digits == "", F.lit("0")).when(
        whole, F.concat(sign, digits, F.repeat(F.lit("0"), power.cast("int")))
    )
    if kind == "integer_text":
        return text
    wide = text.try_cast("bigint")
    return F.when(wide.between(INT32_MIN, INT32_MAX), wide.cast("int"))


def _exact(text: Column, kind: str) -> Column:
    """Value of a text that matches the number grammar, by sign, digits and power of ten.

    The steps are lambdas over one element: each is evaluated once, and for the texts that
    reach it only, where plain expressions would be evaluated for every line.
    """

    def read(p: Column) -> Column:
        sign, whole, fraction, exponent = (F.element_at(p, i) for i in (1, 2, 3, 4))
        return F.struct(
            F.when(sign == "-", F.lit("-")).otherwise(F.lit("")).alias("sign"),
            F.ltrim(F.concat(whole, fraction), F.lit("0")).alias("digits"),
            (F.when(exponent == "", F.lit(0)).otherwise(exponent.try_cast("int")).cast("bigint") - F.length(fraction))
            .alias("power"),
        )

    def reduced(n: Column) -> Column:
        digits = F.rtrim(n["digits"], F.lit("0"))
        power = n["power"] + F.length(n["digits"]) - F.length(digits)
        return F.struct(n["sign"].alias("sign"), digits.alias("digits"), power.alias("power"))

    parts = F.array(F.split(F.regexp_replace(text, _PARTS, "$1,$2,$3,$4"), ","))
    numbers = F.transform(F.transform(parts, read), reduced)
    values = F.transform(numbers, lambda n: _general_form(kind, n["sign"], n["digits"], n["power"]))
    return F.element_at(values, 1)


def parse_numbers(df: DataFrame, wanted: dict[str, tuple[str, str]]) -> DataFrame:
    """Add exact numbers: ``{output: (text column, kind)}``.

    Ordinary texts match one pattern and are cast directly; only the others are split into
    parts. All of it is one projection: the lines are wide, and each further one copies them.
    """
    plain = _plain_forms()

    def value(text: Column, kind: str) -> Column:
        pattern, direct = plain[kind]
        return F.when(text.rlike(pattern), direct(text)).when(text.rlike(NUMBER), _exact(text, kind))

    return df.select("*", *[value(F.col(t), kind).alias(out) for out, (t, kind) in wanted.items()])


def loose_double(c: Column, dtype: T.DataType) -> Column:
    """Profiling number: the nearest double, null when the text is no number."""
    if isinstance(dtype, T.StringType):
        text = strip(c)
        infinite = F.lower(text).rlike(r"\A[+-]?inf(?:inity)?\z")
        return F.when(text.rlike(NUMBER) | infinite, text.try_cast("double"))
    if isinstance(dtype, T.BooleanType):
        return c.cast("int").cast("double")
    value = c.cast("double")
    return F.when(~F.isnan(value), value)
