"""Governed sales measures over any filter context.

Distinct counts are taken in steps (context + invoice + customer, then context),
so no measure copies its input once per distinct column and no context, however
large its share of lines, is counted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions.frames import side_by_side
from ledgerspark.functions.predicates import core_cancellation, core_sale, count_where
from ledgerspark.operators.warehouse import best_description
from ledgerspark.schema import ACCEPTED_CLASSES, UNKNOWN_DESCRIPTION

UNKNOWN = "UNKNOWN"
_MONEY = "decimal(38,4)"
_INPUT = (
    "classification", "NONSTANDARD_INVOICE", "is_cancelled", "quantity", "unit_price",
    "invoice_no", "customer_id", "line_amount",
)


def ratio(top: Column, bottom: Column) -> Column:
    """Double quotient; null when there is nothing to divide by."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def invoice_customer_sums(lines: DataFrame, by: list[str], fine: bool = False) -> DataFrame:
    """Additive measures and flags per (context, invoice, customer).

    In a ``fine`` context an invoice has hardly more than a line, so nothing can be combined
    before the shuffle: lines are dealt by context and invoice, once for both steps.
    """
    sale, cancel = core_sale(), core_cancellation()
    marked = lines.select(
        *by, *[c for c in _INPUT if c not in by], sale.alias("_sale"), cancel.alias("_cancel")
    )
    if fine:
        marked = marked.repartition(*by, "invoice_no")
    sale, cancel = F.col("_sale"), F.col("_cancel")
    return marked.groupBy(*by, "invoice_no", "customer_id").agg(
        F.sum(F.when(sale, F.col("line_amount"))).alias("sale_amount"),
        F.sum(F.when(cancel, F.col("line_amount"))).alias("cancel_amount"),
        F.sum(F.when(sale, F.col("quantity"))).alias("units"),
        F.sum(F.when(cancel, -F.col("quantity"))).alias("cancelled_units"),
        F.max(sale).alias("is_order"),
        F.max("is_cancelled").alias("is_cancellation"),
    )


def measures_from_sums(sums: DataFrame, by: list[str]) -> DataFrame:
    """All measures per context from ``invoice_customer_sums`` rows."""
    per_invoice = sums.groupBy(*by, "invoice_no").agg(
        *[F.sum(c).alias(c) for c in ("sale_amount", "cancel_amount", "units", "cancelled_units")],
        F.max("is_order").alias("is_order"),
        F.max("is_cancellation").alias("is_cancellation"),
    )
    order, cancelled = F.col("is_order"), F.col("is_cancellation")
    totals = per_invoice.groupBy(*by).agg(
        F.sum("sale_amount").alias("_sale"),
        F.sum("cancel_amount").alias("_cancel"),
        F.coalesce(F.sum("units"), F.lit(0)).alias("units_sold"),
        F.coalesce(F.sum("cancelled_units"), F.lit(0)).alias("cancelled_units"),
        count_where(order).alias("orders"),
        count_where(cancelled).alias("cancelled_invoices"),
        count_where(order | cancelled).alias("_activity"),
    )
    known = sums.filter(F.col("is_order") & F.col("customer_id").isNotNull())
    per_customer = known.groupBy(*by, "customer_id").agg(F.count(F.lit(1)).alias("_orders"))
    customers = per_customer.groupBy(*by).agg(
        F.count(F.lit(1)).alias("known_customers"),
        count_where(F.col("_orders") >= 2).alias("repeat_customers"),
    )
    # Contexts may be null, and both sides share their lineage: rename, compare null-safe.
    if by:
        customers = customers.withColumnsRenamed({c: f"_{c}" for c in by})
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
        joined = totals.join(customers, same, "left")
    else:
        joined = side_by_side(totals, customers)
    return _named(joined, by, F.col("known_customers"))


def _named(found: DataFrame, by: list[str], known: Column) -> DataFrame:
    """The measures by name and in order from their counts and sums."""
    zero = F.lit(0)
    return found.select(
        *by,
        (F.coalesce("_sale", zero) + F.coalesce("_cancel", zero)).cast(_MONEY).alias("net_sales"),
        "orders",
        F.coalesce("known_customers", zero).alias("known_customers"),
        "units_sold",
        "cancelled_units",
        ratio(F.col("_sale"), F.col("orders")).alias("average_order_value"),
        F.coalesce("repeat_customers", zero).alias("repeat_customers"),
        ratio(F.coalesce("repeat_customers", zero), known).alias("repeat_rate"),
        "cancelled_invoices",
        ratio(F.col("cancelled_invoices"), F.col("_activity")).alias("cancellation_rate"),
    )


def _tagged(sums: DataFrame, by: list[str]) -> DataFrame:
    """Each row of sums twice, keyed by its invoice and by its customer, so one reading serves both."""
    names = ("sale_amount", "cancel_amount", "units", "cancelled_units", "is_order", "is_cancellation")
    none = [F.lit(None).cast(sums.schema[c].dataType).alias(c) for c in names]
    known = F.col("is_order") & F.col("customer_id").isNotNull()
    kinds = F.array(
        F.struct(F.lit(True).alias("_of_invoice"), F.col("invoice_no").alias("_key"), *names, F.lit(False).alias("_order")),
        F.struct(F.lit(False).alias("_of_invoice"), F.col("customer_id").alias("_key"), *none, known.alias("_order")),
    )
    return sums.select(*by, F.inline(kinds))


def measures_in_one_pass(sums: DataFrame, by: list[str]) -> DataFrame:
    """``measures_from_sums`` with the sums read once, for lines that are not stored."""
    per_key = _tagged(sums, by).groupBy(*by, "_of_invoice", "_key").agg(
        *[F.sum(c).alias(c) for c in ("sale_amount", "cancel_amount", "units", "cancelled_units")],
        F.max("is_order").alias("is_order"),
        F.max("is_cancellation").alias("is_cancellation"),
        count_where(F.col("_order")).alias("_orders"),
    )
    order, cancelled, zero = F.col("is_order"), F.col("is_cancellation"), F.lit(0)
    found = per_key.groupBy(*by).agg(
        F.sum("sale_amount").alias("_sale"),
        F.sum("cancel_amount").alias("_cancel"),
        F.coalesce(F.sum("units"), zero).alias("units_sold"),
        F.coalesce(F.sum("cancelled_units"), zero).alias("cancelled_units"),
        count_where(order).alias("orders"),
        count_where(cancelled).alias("cancelled_invoices"),
        count_where(order | cancelled).alias("_activity"),
        count_where(F.col("_orders") >= 1).alias("known_customers"),
        count_where(F.col("_orders") >= 2).alias("repeat_customers"),
    )
    # without a known customer the rate is null, as it is where customers are counted apart
    return _named(found, by, F.nullif(F.col("known_customers"), zero))


def product_measures(lines: DataFrame) -> DataFrame:
    """Measures per stock code with its canonical description, the lines being read once.

    A line counts for its invoice and for its description; both are rows of one aggregate.
    """
    accepted = F.col("classification").isin(*ACCEPTED_CLASSES)
    marked = lines.select(
        "stock_code", "invoice_no", "description", "invoice_datetime", "line_amount", "quantity", "is_cancelled",
        core_sale().alias("_sale"), core_cancellation().alias("_cancel"), accepted.alias("_accepted"),
    )
    sale, cancel, quantity, no = F.col("_sale"), F.col("_cancel"), F.col("quantity"), F.lit(False)
    parts = {
        "sale_amount": F.when(sale, F.col("line_amount")),
        "cancel_amount": F.when(cancel, F.col("line_amount")),
        "units": F.when(sale, quantity),
        "cancelled_units": F.when(cancel, -quantity),
        "is_order": sale,
        "is_cancellation": F.col("is_cancelled"),
    }
    # One of the two rows of a line has what the other lacks.
    times = {"_core": sale & F.col("_accepted"), "_all": F.col("_accepted"), "_time": F.col("invoice_datetime")}
    lacking = [F.when(no, v).alias(c) for c, v in parts.items()]
    kinds = F.array(
        F.struct(
            F.lit(True).alias("_of_invoice"), F.col("invoice_no").alias("_key"),
            *[v.alias(c) for c, v in parts.items()], *[F.when(no, v).alias(c) for c, v in times.items()],
        ),
        F.struct(no.alias("_of_invoice"), F.col("description").alias("_key"), *lacking, *[v.alias(c) for c, v in times.items()]),
    )
    per_key = marked.select("stock_code", F.inline(kinds)).groupBy("stock_code", "_of_invoice", "_key").agg(
        *[F.sum(c).alias(c) for c in ("sale_amount", "cancel_amount", "units", "cancelled_units")],
        F.max("is_order").alias("is_order"),
        F.max("is_cancellation").alias("is_cancellation"),
        *[count_where(F.col(f"_{tier}")).alias(f"{tier}_count") for tier in ("core", "all")],
        *[F.max(F.when(F.col(f"_{tier}"), F.col("_time"))).alias(f"{tier}_latest") for tier in ("core", "all")],
    )
    named = per_key.withColumn("description", F.when(~F.col("_of_invoice"), F.col("_key")))
    zero = F.lit(0)
    found = named.groupBy("stock_code").agg(
        (F.coalesce(F.sum("sale_amount"), zero) + F.coalesce(F.sum("cancel_amount"), zero)).cast(_MONEY).alias("net_sales"),
        count_where(F.col("is_order")).alias("orders"),
        F.coalesce(F.sum("units"), zero).alias("units_sold"),
        F.coalesce(F.sum("cancelled_units"), zero).alias("cancelled_units"),
        count_where(F.col("is_cancellation")).alias("cancelled_invoices"),
        best_description().alias("_best"),
    )
    description = F.coalesce("_best.description", F.lit(UNKNOWN_DESCRIPTION)).alias("description")
    return found.select("stock_code", description, *[c for c in found.columns if c not in ("stock_code", "_best")])


def kpis(lines: DataFrame, by: list[str] = (), fine: bool = False, once: bool = False) -> DataFrame:
    """Every measure within each combination of ``by`` columns (the filter context).

    Lines that are not stored should be read ``once``.
    """
    by = list(by)
    sums = invoice_customer_sums(lines, by, fine)
    return measures_in_one_pass(sums, by) if once else measures_from_sums(sums, by)


def kpi_levels(lines: DataFrame, levels: list[list[str]]) -> DataFrame:
    """Measures at several context levels; absent columns read ``(all)``.

    Distinct counts do not add up, so each level is counted again, but from the
    lines' pre-aggregated sums at the finest level.
    """
    finest = list(dict.fromkeys(c for level in levels for c in level))
    sums = invoice_customer_sums(lines, finest)
    contexts = F.array(
        *[
            F.struct(
                F.lit(i).alias("level"),
                *[
                    (F.col(c).cast("string") if c in level else F.lit("(all)")).alias(f"{c}_context")
                    for c in finest
                ],
            )
            for i, level in enumerate(levels)
        ]
    )
    by = ["level", *[f"{c}_context" for c in finest]]
    spread = sums.select(F.inline(contexts), *[c for c in sums.columns if c not in finest])
    coarser = spread.groupBy(*by, "invoice_no", "customer_id").agg(
        *[F.sum(c).alias(c) for c in ("sale_amount", "cancel_amount", "units", "cancelled_units")],
        F.max("is_order").alias("is_order"),
        F.max("is_cancellation").alias("is_cancellation"),
    )
    return measures_from_sums(coarser, by)


# -- approximate distinct counts, on request -----------------------------------

SKETCH_BITS = 12  # 4,096 registers: a standard error of about 1.6 %


def _counted() -> dict[str, Column]:
    """What each distinct measure counts; null is not counted."""
    sale = core_sale()
    return {
        "orders": F.when(sale, F.col("invoice_no")),
        "known_customers": F.when(sale, F.col("customer_id")),
        "cancelled_invoices": F.when(F.col("is_cancelled"), F.col("invoice_no")),
    }


def distinct_sketches(lines: DataFrame, by: list[str], bits: int = SKETCH_BITS) -> DataFrame:
    """A mergeable sketch of each distinct measure per combination of ``by`` columns.

    Stored once at the finest contexts, sketches answer every coarser one without the lines;
    they are a few kilobytes each, however many values they have seen.
    """
    return lines.groupBy(*by).agg(*[F.hll_sketch_agg(c, bits).alias(name) for name, c in _counted().items()])


def approximate_distinct(sketches: DataFrame, by: list[str] = ()) -> DataFrame:
    """Distinct measures within each combination of ``by``, from the sketches of finer contexts.

    Exact counts are ``kpis``; an estimate is within three standard errors, 3 * 1.04 /
    sqrt(2 ** bits) of the count, in all but a few contexts of a thousand.
    """
    merged = [F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in _counted()]
    return sketches.groupBy(*by).agg(*merged)


# -- single measures ---------------------------------------------------------


def net_sales(lines: DataFrame, by: list[str]) -> DataFrame:
    return lines.groupBy(*by).agg(
        F.coalesce(
            F.sum(F.when(core_sale() | core_cancellation(), F.col("line_amount"))), F.lit(0)
        ).cast(_MONEY).alias("net_sales")
    )


def units_sold(lines: DataFrame, by: list[str]) -> DataFrame:
    return lines.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(core_sale(), F.col("quantity"))), F.lit(0)).alias("units_sold"),
        F.coalesce(F.sum(F.when(core_cancellation(), -F.col("quantity"))), F.lit(0)).alias(
            "cancelled_units"
        ),
    )


def orders(lines: DataFrame, by: list[str]) -> DataFrame:
    return lines.groupBy(*by).agg(
        F.countDistinct(F.when(core_sale(), F.col("invoice_no"))).alias("orders")
    )


def known_customers(lines: DataFrame, by: list[str]) -> DataFrame:
    return lines.groupBy(*by).agg(
        F.countDistinct(F.when(core_sale(), F.col("customer_id"))).alias("known_customers")
    )


def average_order_value(lines: DataFrame, by: list[str]) -> DataFrame:
    sold = lines.groupBy(*by).agg(
        F.sum(F.when(core_sale(), F.col("line_amount"))).cast(_MONEY).alias("sale_amount"),
        F.countDistinct(F.when(core_sale(), F.col("invoice_no"))).alias("orders"),
    )
    return sold.withColumn("average_order_value", ratio(F.col("sale_amount"), F.col("orders")))


def repeat_customers(lines: DataFrame, by: list[str]) -> DataFrame:
    """Known customers, those with two or more orders, and their share, per context."""
    customer = F.when(core_sale(), F.col("customer_id"))
    # a context without a known customer keeps its row of nulls, and so its zeros
    pairs = lines.select(
        *by, customer.alias("_customer"), F.when(customer.isNotNull(), F.col("invoice_no")).alias("_invoice")
    ).distinct()
    per_customer = pairs.groupBy(*by, "_customer").agg(F.count("_invoice").alias("n"))
    counted = per_customer.groupBy(*by).agg(
        F.count("_customer").alias("known_customers"),
        count_where(F.col("_customer").isNotNull() & (F.col("n") >= 2)).alias("repeat_customers"),
    )
    return counted.withColumn(
        "repeat_rate", ratio(F.col("repeat_customers"), F.col("known_customers"))
    )


def cancellation_rate(lines: DataFrame, by: list[str]) -> DataFrame:
    """Share of invoices, ordered or cancelled, that are cancelled; never a row share."""
    active = core_sale() | F.col("is_cancelled")
    per_invoice = (
        lines.select(*by, F.when(active, F.col("invoice_no")).alias("_invoice"), "is_cancelled")
        .groupBy(*by, "_invoice")
        .agg(F.max("is_cancelled").alias("cancelled"))
    )
    counted = per_invoice.groupBy(*by).agg(
        count_where(F.col("_invoice").isNotNull() & F.col("cancelled")).alias("cancelled_invoices"),
        F.count("_invoice").alias("active_invoices"),
    )
    return counted.withColumn(
        "cancellation_rate", ratio(F.col("cancelled_invoices"), F.col("active_invoices"))
    )


def qualifying_invoices(lines: DataFrame) -> DataFrame:
    """Distinct qualifying orders and qualifying cancelled invoices."""
    kind = F.when(F.col("is_cancelled"), "cancelled_invoice").otherwise("order")
    return (
        lines.filter(core_sale() | F.col("is_cancelled"))
        .select("invoice_no", kind.alias("invoice_kind"))
        .distinct()
    )


def top_customers(lines: DataFrame, top: int = 20) -> DataFrame:
    """Known customers by net sales, with their orders and units; UNKNOWN never ranks."""
    known = lines.filter(F.col("customer_id").isNotNull())
    return (
        kpis(known, ["customer_id"], once=True)
        .select("customer_id", "net_sales", "orders", "units_sold", "average_order_value")
        .orderBy(F.col("net_sales").desc(), "customer_id")
        .limit(top)
    )
