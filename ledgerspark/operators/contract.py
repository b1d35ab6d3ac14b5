"""The data contract: normalise, flag, classify and route raw invoice lines.

Everything is one chain of narrow projections, so the whole contract runs in the
scan stage; the steps are separate selects so an expensive value is computed once.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions import dates, numbers, text
from ledgerspark.functions.frames import side_by_side
from ledgerspark.functions.predicates import (
    STANDARD_INVOICE,
    core_cancellation,
    core_sale,
    count_where,
)
from ledgerspark.operators import occupancy
from ledgerspark.schema import (
    ACCEPT,
    ACCEPT_FLAGGED,
    ACCEPTED_SCHEMA,
    AMOUNT_TYPE,
    DERIVED_COLUMNS,
    LINEAGE_COLUMNS,
    NORMALIZED_COLUMNS,
    QUALITY_FLAGS,
    RAW_COLUMNS,
    RAW_KEPT_AS,
    REJECT,
    REJECT_REASONS,
)
from ledgerspark.sources.raw import source_row_id

REJECTED_COLUMNS = (
    *LINEAGE_COLUMNS,
    *RAW_KEPT_AS.values(),
    *NORMALIZED_COLUMNS,
    *DERIVED_COLUMNS,
    "classification",
    "quality_flags",
    *QUALITY_FLAGS,
    "reject_reason",
    "rejected_at",
)
_MISSING = {
    "Quantity": "_quantity_missing",
    "InvoiceDate": "_date_missing",
    "Price": "_price_missing",
    "Customer ID": "_customer_missing",
}


def utc_literal(moment: datetime):
    """One UTC microsecond timestamp for a whole batch; naive input is UTC."""
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=timezone.utc)
    moment = moment.astimezone(timezone.utc)
    return F.lit(moment.strftime("%Y-%m-%d %H:%M:%S.%f+00:00")).cast("timestamp")


def normalize(raw: DataFrame, loaded_at: datetime) -> DataFrame:
    """Lineage, raw fields, normalised and derived columns of every raw line."""
    required = ["source_sheet", "source_row_number", *RAW_COLUMNS]
    absent = [c for c in required if c not in raw.columns]
    if absent:
        raise ValueError(f"Raw lines lack columns: {absent}")
    types = {f.name: f.dataType for f in raw.schema.fields}
    col = {c: F.col(f"`{c}`") for c in RAW_COLUMNS}
    number = {
        c: numbers.number_text(col[c], types[c]) for c in ("Quantity", "Price", "Customer ID")
    }
    texts = raw.select(
        F.col("source_sheet").cast("string").alias("source_sheet"),
        F.col("source_row_number").cast("bigint").alias("source_row_number"),
        *[col[c].alias(kept) for c, kept in RAW_KEPT_AS.items()],
        *[
            text.is_missing(col[c], types[c]).alias(alias)
            for c, alias in _MISSING.items()
        ],
        text.identifier(col["Invoice"], types["Invoice"], upper=True).alias("invoice_no"),
        text.identifier(col["StockCode"], types["StockCode"]).alias("stock_code"),
        text.optional_text(col["Description"]).alias("description"),
        text.optional_text(col["Country"]).alias("country"),
        number["Quantity"].alias("_quantity"),
        number["Price"].alias("_price"),
        number["Customer ID"].alias("_customer"),
        dates.whole_second(dates.wall_clock(col["InvoiceDate"], types["InvoiceDate"])).alias(
            "invoice_datetime"
        ),
    )
    typed = numbers.parse_numbers(
        texts,
        {
            "quantity": ("_quantity", "int32"),
            "unit_price": ("_price", "price"),
            "customer_id": ("_customer", "integer_text"),
        },
    )
    return typed.select(
        *[c for c in typed.columns if c not in ("_quantity", "_price", "_customer")],
        source_row_id(F.col("source_sheet"), F.col("source_row_number")).alias("source_row_id"),
        (F.col("quantity") * F.col("unit_price")).cast(AMOUNT_TYPE).alias("line_amount"),
        F.coalesce(F.startswith("invoice_no", F.lit("C")), F.lit(False)).alias("is_cancelled"),
        dates.month_start(F.col("invoice_datetime")).alias("batch_month"),
        utc_literal(loaded_at).alias("loaded_at"),
    )


def flag_masks() -> dict:
    c = F.col
    cancelled, quantity = c("is_cancelled"), c("quantity")
    masks = (
        c("_customer_missing"),
        ~c("_customer_missing") & c("customer_id").isNull(),
        c("description").isNull(),
        c("unit_price") == 0,
        c("invoice_no").isNotNull()
        & ((cancelled & (quantity >= 0)) | (~cancelled & (quantity <= 0))),
        ~c("invoice_no").rlike(STANDARD_INVOICE),
        c("country").isNull(),
    )
    return {k: F.coalesce(m, F.lit(False)) for k, m in zip(QUALITY_FLAGS, masks, strict=True)}


def reject_masks() -> dict:
    c = F.col
    masks = (
        c("invoice_no").isNull(),
        c("stock_code").isNull(),
        c("_date_missing") | c("invoice_datetime").isNull(),
        c("_quantity_missing"),
        ~c("_quantity_missing") & c("quantity").isNull(),
        c("_price_missing"),
        ~c("_price_missing") & c("unit_price").isNull(),
        F.coalesce(c("unit_price") < 0, F.lit(False)),
    )
    return dict(zip(REJECT_REASONS, masks, strict=True))


def assess(normalized: DataFrame) -> DataFrame:
    """Add the seven flags, their codes, the reject reasons and the classification."""
    flagged = normalized.select(
        "*", *[m.alias(k) for k, m in flag_masks().items()],
        text.ordered_codes(reject_masks()).alias("reject_reason"),
    )
    coded = flagged.withColumn(
        "quality_flags", text.ordered_codes({k: F.col(k) for k in QUALITY_FLAGS})
    )
    return coded.withColumn(
        "classification",
        F.when(F.col("reject_reason") != "", REJECT)
        .when(F.col("quality_flags") != "", ACCEPT_FLAGGED)
        .otherwise(ACCEPT),
    ).drop(*_MISSING.values())


def classify(raw: DataFrame, loaded_at: datetime) -> DataFrame:
    return assess(normalize(raw, loaded_at))


def keep_where(df: DataFrame, condition) -> DataFrame:
    """Filter on a computed column without moving its computation.

    A plain filter is pushed below the projections that define its columns, which
    evaluates the whole contract twice per row. A condition that passes through a
    one-element explode stays above them, and column pruning still applies.
    """
    kept = df.select("*", F.explode(F.array(condition)).alias("_keep")).filter("_keep")
    return kept.drop("_keep")


def accepted_lines(assessed: DataFrame) -> DataFrame:
    """The 24 accepted columns. Routing is two filters over one cheap narrow plan;
    keeping the classified lines in memory would spill at scale for no gain."""
    return keep_where(assessed, F.col("classification") != REJECT).select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in ACCEPTED_SCHEMA.fields]
    )


def rejected_lines(assessed: DataFrame) -> DataFrame:
    """Rejected lines with their raw fields and ordered reasons."""
    return (
        keep_where(assessed, F.col("classification") == REJECT)
        .withColumn("rejected_at", F.col("loaded_at"))
        .select(*REJECTED_COLUMNS)
    )


def transform_summary(assessed: DataFrame) -> DataFrame:
    """(section, metric, value): totals, classes, reasons, accepted flags, core lines."""
    accepted = F.col("classification") != REJECT
    wanted = {
        ("rows", "source_rows"): F.lit(True),
        ("rows", "accepted_rows"): accepted,
        ("rows", "rejected_rows"): ~accepted,
        **{
            ("classification", k): F.col("classification") == k
            for k in (ACCEPT, ACCEPT_FLAGGED, REJECT)
        },
        # The reasons are whole codes between separators.
        **{
            ("reject_reason", k): F.array_contains(F.split("reject_reason", ";"), k)
            for k in REJECT_REASONS
        },
        **{("quality_flag", k): F.col(k) & accepted for k in QUALITY_FLAGS},
        ("core", "core_commercial_lines"): core_sale(),
        ("core", "core_cancellation_lines"): core_cancellation(),
    }
    return long_counts(assessed, wanted)


def long_counts(df: DataFrame, wanted: dict, by: list[str] = ()) -> DataFrame:
    """One pass of conditional counts, returned as (section, metric, value) rows."""
    names = {key: f"c{i}" for i, key in enumerate(wanted)}
    wide = df.groupBy(*by).agg(*[count_where(m).alias(names[k]) for k, m in wanted.items()])
    rows = [
        F.struct(
            F.lit(section).alias("section"), F.lit(metric).alias("metric"), F.col(n).alias("value")
        )
        for (section, metric), n in names.items()
    ]
    return wide.select(*by, F.inline(F.array(*rows)))


def transform_invariants(assessed: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """(check_name, value): what must hold between source, accepted and rejected lines.

    ``assessed`` may be the stored outcome, to be held against its ``source``. Ids are
    shuffled to be counted only if row numbers do not show that they are distinct.
    """
    accepted = F.col("classification").isin(ACCEPT, ACCEPT_FLAGGED)
    rejected = F.col("classification") == REJECT
    distinct = occupancy.all_distinct(assessed)
    measured = [
        count_where(accepted).alias("accepted"),
        count_where(rejected).alias("rejected"),
        count_where(rejected & (F.col("reject_reason") == "")).alias("no_reason"),
        count_where(accepted & (F.col("reject_reason") != "")).alias("accepted_with_reason"),
    ]
    if distinct:  # all ids as one group, of which none is missing or repeated
        none = [F.lit("").alias("source_row_id"), F.lit(1).cast("bigint").alias("n")]
        per_id = assessed.agg(*measured).select(*none, "*")
    else:
        per_id = assessed.groupBy("source_row_id").agg(F.count(F.lit(1)).alias("n"), *measured)

    def total(c: str):
        return F.coalesce(F.sum(c), F.lit(0))

    found = per_id.agg(
        total("no_reason").alias("rejected_without_reason"),
        total("accepted_with_reason").alias("accepted_with_reject_reason"),
        count_where(F.col("source_row_id").isNull()).alias("missing_row_ids"),
        count_where(F.col("n") > 1).alias("duplicated_row_ids"),
        total("accepted").alias("accepted_rows"),
        total("rejected").alias("rejected_rows"),
    )
    counted = (assessed if source is None else source).agg(
        F.count(F.lit(1)).alias("source_rows")
    )
    gap = F.abs(F.col("source_rows") - F.col("accepted_rows") - F.col("rejected_rows"))
    wide = side_by_side(found, counted).withColumn("source_minus_accepted_minus_rejected", gap)
    return wide.unpivot([], wide.columns, "check_name", "value")


def assert_invariants(assessed: DataFrame) -> None:
    found = {r.check_name: r.value for r in transform_invariants(assessed).collect()}
    failed = {k: v for k, v in found.items() if not k.endswith("_rows") and v}
    if failed:
        raise ValueError(f"Transformation does not reconcile: {failed}")
