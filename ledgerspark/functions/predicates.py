"""The governed line predicates; every count and KPI uses these two definitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerspark.schema import ACCEPTED_CLASSES

STANDARD_INVOICE = r"\A(?:[0-9]+|C[0-9]+)\z"
CANCELLATION_INVOICE = r"\AC[0-9]+\z"


def _accepted() -> Column:
    return F.col("classification").isin(*ACCEPTED_CLASSES)


def core_sale() -> Column:
    """Accepted, standard, not cancelled, positive quantity and price; null never passes."""
    return F.coalesce(
        _accepted()
        & ~F.col("NONSTANDARD_INVOICE")
        & ~F.col("is_cancelled")
        & (F.col("quantity") > 0)
        & (F.col("unit_price") > 0),
        F.lit(False),
    )


def core_cancellation() -> Column:
    """Accepted ``C<digits>`` line with negative quantity and positive price."""
    return F.coalesce(
        _accepted()
        & F.col("invoice_no").rlike(CANCELLATION_INVOICE)
        & F.col("is_cancelled")
        & (F.col("quantity") < 0)
        & (F.col("unit_price") > 0),
        F.lit(False),
    )


def count_where(condition: Column) -> Column:
    """Exact count of rows meeting a condition; 0, never null, on empty input."""
    return F.count(F.when(condition, F.lit(1)))


# One predicate per representative line category, in report order.
def sample_categories() -> dict[str, Column]:
    return {
        "normal_clean": (F.col("classification") == "ACCEPT")
        & ~F.col("is_cancelled")
        & (F.col("quantity") > 0)
        & (F.col("unit_price") > 0),
        "missing_customer": F.col("MISSING_CUSTOMER"),
        "zero_price": F.col("ZERO_PRICE"),
        "non_c_negative_quantity": ~F.col("is_cancelled")
        & (F.col("quantity") < 0)
        & F.col("QUANTITY_SIGN_MISMATCH"),
        "cancellation": F.col("is_cancelled") & (F.col("quantity") < 0),
        "missing_description": F.col("MISSING_DESCRIPTION"),
    }
