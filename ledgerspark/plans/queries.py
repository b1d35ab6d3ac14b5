"""Named queries over the stored layers, one per operator of the engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.operators import contract, kpi, profile, reconcile, warehouse
from ledgerspark.plans.layers import Layers
from ledgerspark.plans.warehouse import Warehouse, months_between
from ledgerspark.schema import (
    ACCEPTED_COLUMNS,
    FACT_COLUMNS,
    FACT_COPIED_COLUMNS,
    QUALITY_FLAGS,
)
from ledgerspark.sources import accepted as sink
from ledgerspark.sources import raw as source

Query = Callable[[Layers], DataFrame]
_REGISTRY: dict[str, Query] = {}
MONTH = ["batch_month"]
LINE_COLUMNS = (
    "source_row_id", "invoice_no", "stock_code", "quantity", "unit_price", "line_amount",
    "batch_month",
)


def query(fn: Query) -> Query:
    _REGISTRY[fn.__name__] = fn
    return fn


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(fn: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: fn(Layers(spark, sf_dir))

    return {name: bound(fn) for name, fn in _REGISTRY.items()}


def _clock(df: DataFrame) -> DataFrame:
    """UTC instants shown as plain timestamps."""
    instants = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp"]
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in instants})


# -- sources and sinks -------------------------------------------------------


@query
def raw_transactions(x: Layers) -> DataFrame:
    return x.raw()


@query
def source_lineage(x: Layers) -> DataFrame:
    number = F.col("source_row_number")
    return x.raw().groupBy("source_sheet").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min(number).alias("first_row_number"),
        F.max(number).alias("last_row_number"),
        F.sum(number).alias("row_number_sum"),
    )


@query
def source_row_id(x: Layers) -> DataFrame:
    row_id = source.source_row_id(F.col("source_sheet"), F.col("source_row_number"))
    return x.raw().select("source_sheet", "source_row_number", row_id.alias("source_row_id"))


@query
def lineage_violations(x: Layers) -> DataFrame:
    return source.lineage_violations(x.raw())


@query
def sheet_row_reconciliation(x: Layers) -> DataFrame:
    return source.sheet_row_counts(x.raw())


@query
def accepted_roundtrip(x: Layers) -> DataFrame:
    return x.accepted().groupBy("year", "month").agg(
        F.count(F.lit(1)).alias("row_count"),
        reconcile.money_sum("line_amount").alias("line_amount_sum"),
        F.sum("source_row_number").alias("row_number_sum"),
    )


@query
def accepted_output_check(x: Layers) -> DataFrame:
    # how many files there are is the writer's matter; all else follows from the lines
    return sink.check_output(x.spark, x.published()).drop("file_count")


@query
def rejected_rows(x: Layers) -> DataFrame:
    return _clock(x.rejected().select(*contract.REJECTED_COLUMNS))


@query
def text_length_profile(x: Layers) -> DataFrame:
    return sink.text_length_profile(x.accepted_contents())


@query
def staging_preflight(x: Layers) -> DataFrame:
    return sink.staging_preflight(x.accepted())


@query
def missing_periods(x: Layers) -> DataFrame:
    return sink.period_calendar(sink.periods(x.accepted()))


@query
def period_inspection(x: Layers) -> DataFrame:
    return sink.inspect_periods(x.accepted())


@query
def table_fingerprint(x: Layers) -> DataFrame:
    return source.fingerprint(x.raw_fields())


@query
def transform_summary(x: Layers) -> DataFrame:
    return contract.transform_summary(x.outcome_contents())


@query
def transform_invariants(x: Layers) -> DataFrame:
    return contract.transform_invariants(x.outcome(), x.raw_fields())


# -- contract ----------------------------------------------------------------


@query
def normalized_rows(x: Layers) -> DataFrame:
    return _clock(x.classified().select(*ACCEPTED_COLUMNS[:15]))


@query
def quality_flags(x: Layers) -> DataFrame:
    return x.classified().select("source_row_id", *QUALITY_FLAGS, "quality_flags")


@query
def reject_reasons(x: Layers) -> DataFrame:
    return contract.keep_where(x.classified(), F.col("reject_reason") != "").select(
        "source_row_id", "reject_reason"
    )


@query
def classification_counts(x: Layers) -> DataFrame:
    return reconcile.classification_counts(x.outcome_contents())


@query
def accepted_rows(x: Layers) -> DataFrame:
    return _clock(x.accepted().select(*ACCEPTED_COLUMNS))


@query
def core_commercial_lines(x: Layers) -> DataFrame:
    return x.accepted().filter(reconcile.core_sale()).select(*LINE_COLUMNS)


@query
def core_cancellation_lines(x: Layers) -> DataFrame:
    return x.accepted().filter(reconcile.core_cancellation()).select(*LINE_COLUMNS)


@query
def qualifying_orders(x: Layers) -> DataFrame:
    return kpi.qualifying_invoices(x.accepted_contents())


@query
def load_contract_violations(x: Layers) -> DataFrame:
    # Every classified line is offered, so the rejected ones show what they break.
    return reconcile.load_contract_violations(x.outcome_once())


# -- staging -----------------------------------------------------------------


@query
def flag_totals(x: Layers) -> DataFrame:
    return reconcile.flag_totals(x.accepted_contents())


@query
def time_bounds(x: Layers) -> DataFrame:
    return reconcile.time_bounds(x.accepted_contents())


@query
def staging_validation(x: Layers) -> DataFrame:
    return reconcile.staging_validation(x.accepted())


@query
def duplicate_keys(x: Layers) -> DataFrame:
    staging, fact, dims = x.star()
    return reconcile.duplicate_keys(
        {
            "staging": (staging, ["source_row_id"]),
            "fact_sales": (fact, ["source_row_id"]),
            "dim_date": (dims["dim_date"], ["full_date"]),
            "dim_customer": (dims["dim_customer"], ["customer_id"]),
            "dim_product": (dims["dim_product"], ["stock_code"]),
            "dim_country": (dims["dim_country"], ["country"]),
            # Business values are no identity: this one repeats, and is meant to.
            "staging_business_key": (staging, ["invoice_no", "stock_code"]),
        }
    )


@query
def constraint_violations(x: Layers) -> DataFrame:
    staging, fact, dims = x.star()
    tables = {"staging": staging, "fact_sales": fact, **dims}
    rules = reconcile.standard_rules()
    return reconcile.constraint_violations({t: (tables[t], r) for t, r in rules.items()})


@query
def load_idempotent(x: Layers) -> DataFrame:
    """The accepted lines loaded twice into an empty warehouse."""
    store = Warehouse(x.spark, x.scratch("load_idempotent"))
    lines = x.accepted().select(*ACCEPTED_COLUMNS)
    loads = [(i, *store.load_staging(lines, dealt=True).values()) for i in (1, 2)]
    return x.spark.createDataFrame(
        loads,
        "load_number int, processed long, inserted long, skipped_existing long, staging_rows long",
    )


# -- star schema -------------------------------------------------------------


@query
def description_frequencies(x: Layers) -> DataFrame:
    return warehouse.description_frequencies(x.accepted_contents())


@query
def canonical_description(x: Layers) -> DataFrame:
    return warehouse.canonical_descriptions(x.accepted_contents())


@query
def dim_date(x: Layers) -> DataFrame:
    return x.star()[2]["dim_date"]


@query
def dim_customer(x: Layers) -> DataFrame:
    return x.star()[2]["dim_customer"]


@query
def dim_product(x: Layers) -> DataFrame:
    return x.star()[2]["dim_product"]


@query
def dim_country(x: Layers) -> DataFrame:
    return x.star()[2]["dim_country"]


@query
def dimension_counts(x: Layers) -> DataFrame:
    staging, dims = x.dimensions()
    return warehouse.dimension_counts(dims, staging)


@query
def dim_product_upsert(x: Layers) -> DataFrame:
    """Products of all months but the last, then brought up to date with the last one.

    The description counts of the months before are kept and merged with the last month's;
    lines of earlier months are not read again.
    """
    lines = x.accepted()
    low, high = _period_bounds(lines)
    path = x.scratch("dim_product_upsert")
    kept = warehouse.description_counts(lines.filter(F.col("batch_month") < F.lit(high)))
    kept.write.parquet(f"{path}/counts")
    kept = x.spark.read.schema(kept.schema).parquet(f"{path}/counts")
    added = warehouse.description_counts(months_between(lines, high, high))
    old = warehouse.upsert_products(None, warehouse.canonical_of_counts(kept), f"{path}/old")
    touched = added.select("stock_code").distinct()
    merged = warehouse.merged_counts(kept, added).join(touched, "stock_code", "left_semi")
    new = warehouse.upsert_products(old, warehouse.canonical_of_counts(merged), f"{path}/new")
    before = old.select("product_key", F.col("description").alias("old_description"))
    return new.join(before, "product_key", "left").select(
        "product_key",
        "stock_code",
        "old_description",
        "description",
        F.when(F.col("old_description").isNull(), "inserted")
        .when(F.col("old_description") != F.col("description"), "updated")
        .otherwise("unchanged")
        .alias("change"),
    )


@query
def fact_sales(x: Layers) -> DataFrame:
    return _clock(x.star()[1].select(*FACT_COLUMNS))


# -- reconciliation ----------------------------------------------------------


@query
def layer_identity_diff(x: Layers) -> DataFrame:
    staging, fact, _ = x.star()
    row_id = source.source_row_id(F.col("source_sheet"), F.col("source_row_number"))
    lines = x.raw().select(row_id.alias("source_row_id"))
    return reconcile.identity_diff(lines, staging, "raw", "staging").unionByName(
        reconcile.identity_diff(staging, fact, "staging", "fact_sales")
    )


@query
def layer_row_diff(x: Layers) -> DataFrame:
    staging, fact, _ = x.star()
    shared = list(FACT_COPIED_COLUMNS)
    pairs = {
        "staging_vs_fact_sales": (staging, fact),
        "classified_vs_staging": (x.outcome(), staging),
    }
    frames = [
        reconcile.row_diff_counts(a, b, shared, "classification").select(F.lit(name).alias("comparison"), "*")
        for name, (a, b) in pairs.items()
    ]
    return frames[0].unionByName(frames[1])


@query
def fk_orphans(x: Layers) -> DataFrame:
    _, fact, dims = x.star()
    return reconcile.fk_orphans(fact, dims)


@query
def unknown_member_usage(x: Layers) -> DataFrame:
    return reconcile.unknown_member_usage(*x.star())


@query
def line_amount_reconciliation(x: Layers) -> DataFrame:
    staging, fact, _ = x.star()
    return reconcile.line_amount_reconciliation(staging, fact)


@query
def copied_value_mismatches(x: Layers) -> DataFrame:
    return reconcile.compared_in_all(*x.star())


@query
def core_line_reconciliation(x: Layers) -> DataFrame:
    staging, fact, _ = x.star()
    return reconcile.core_line_reconciliation(staging, fact)


@query
def canonical_product_mismatch(x: Layers) -> DataFrame:
    staging, dims = x.dimensions()
    return reconcile.canonical_product_mismatch(staging, dims["dim_product"])


@query
def multi_description_counts(x: Layers) -> DataFrame:
    return reconcile.multi_description_counts(x.accepted_contents())


@query
def multi_description_report(x: Layers) -> DataFrame:
    staging, _, dims = x.star()
    return reconcile.multi_description_report(staging, dims["dim_product"])


@query
def sample_rows(x: Layers) -> DataFrame:
    return reconcile.sample_rows(*x.star())


@query
def period_reconciliation(x: Layers) -> DataFrame:
    return reconcile.period_reconciliation(*x.star())


# -- incremental -------------------------------------------------------------


def _period_bounds(lines: DataFrame) -> tuple:
    """First and last month, from the partition folders' footers."""
    row = sink.periods(lines).agg(F.min("period"), F.max("period")).first()
    return row[0], row[1]


@query
def period_upsert(x: Layers) -> DataFrame:
    """All months but the last built at once, then the last month upserted: its counters."""
    lines = x.accepted()
    low, high = _period_bounds(lines)
    store = Warehouse(x.spark, x.scratch("period_upsert"))
    wanted = lines.select(*ACCEPTED_COLUMNS)
    store.load_staging(wanted.filter(F.col("batch_month") < F.lit(high)), dealt=True)
    store.bootstrap()
    store.load_staging(months_between(lines, high, high).select(*ACCEPTED_COLUMNS))
    counts = store.upsert_periods(high, high, high)
    del counts["first_period"]
    counts = {"period": counts.pop("last_period"), **counts}
    types = ", ".join(f"{k} {'date' if k == 'period' else 'long'}" for k in counts)
    return x.spark.createDataFrame([tuple(counts.values())], types)


_REPLAYED: dict[str, Warehouse] = {}


def _replayed(x: Layers) -> Warehouse:
    """The history run month after month, each behind its own gate, and the last month again."""
    if x.root not in _REPLAYED:
        lines = x.accepted()
        low, high = _period_bounds(lines)
        store = Warehouse(x.spark, x.scratch("replay"))
        store.replay(lines, low, low, high)
        store.run(lines, high, low, high, force=True)
        _REPLAYED[x.root] = store
    return _REPLAYED[x.root]


@query
def replay_all_periods(x: Layers) -> DataFrame:
    """The history replayed in one run per month and a forced repeat; facts by natural key."""
    store = _replayed(x)
    facts = warehouse.with_natural_keys(store.fact(), store.dims())
    return facts.select(
        "source_row_id", "full_date", "customer_id", "stock_code", "description", "country",
        "quantity", "line_amount",
    )


@query
def replay_progress(x: Layers) -> DataFrame:
    """Progress by the log that the replay itself has written."""
    return reconcile.progress(_replayed(x).run_log())


@query
def period_decisions(x: Layers) -> DataFrame:
    """Every month, and one beyond each end, judged against four progress marks."""
    lines = x.accepted()
    span = sink.periods(lines).agg(F.min("period").alias("low"), F.max("period").alias("high"))
    half = F.floor(F.months_between("high", "low") / 2).cast("int")
    marks = span.select(
        "low",
        "high",
        F.explode(
            F.array(
                F.lit(None).cast("date"), F.col("low"), F.add_months("low", half), F.col("high")
            )
        ).alias("mark"),
    )
    asked = marks.select(
        "*",
        F.explode(
            F.sequence(
                F.add_months("low", -1), F.add_months("high", 1), F.expr("interval 1 month")
            )
        ).alias("period"),
    ).select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("force"))
    return asked.select(
        "mark",
        "period",
        "force",
        reconcile.period_decision(
            F.col("period"), F.col("mark"), F.col("low"), F.col("high"), F.col("force")
        ).alias("decision"),
    )


# -- profile -----------------------------------------------------------------


@query
def dataset_summary(x: Layers) -> DataFrame:
    return profile.dataset_summary(x.raw())


@query
def sheet_summary(x: Layers) -> DataFrame:
    return profile.sheet_summary(x.raw())


@query
def null_summary(x: Layers) -> DataFrame:
    return profile.null_summary(x.raw_fields())


@query
def cardinality(x: Layers) -> DataFrame:
    return profile.cardinality(x.raw_fields())


@query
def cancellation_matrix(x: Layers) -> DataFrame:
    return profile.cancellation_matrix(x.raw())


@query
def numeric_profile(x: Layers) -> DataFrame:
    result = profile.numeric_profile(x.raw(), x.scratch("numeric_profile"))
    # Sums of doubles depend on their order in the last digits.
    return result.withColumns({c: F.round(c, 4) for c in ("mean", "std")})


@query
def country_profile(x: Layers) -> DataFrame:
    return profile.country_profile(x.raw_fields())


@query
def country_variants(x: Layers) -> DataFrame:
    return profile.country_variants(x.raw_fields())


@query
def duplicate_groups(x: Layers) -> DataFrame:
    return profile.duplicate_groups(x.raw())


@query
def stockcode_classes(x: Layers) -> DataFrame:
    return profile.stockcode_classes(x.raw_fields())


@query
def nonstandard_codes(x: Layers) -> DataFrame:
    return profile.nonstandard_codes(x.raw_fields())


@query
def description_consistency(x: Layers) -> DataFrame:
    return profile.description_consistency(x.raw_fields())


@query
def top_values(x: Layers) -> DataFrame:
    return profile.top_values(x.raw_fields())


@query
def extreme_quantity_samples(x: Layers) -> DataFrame:
    return profile.extreme_quantity_samples(x.raw())


@query
def price_anomaly_samples(x: Layers) -> DataFrame:
    return profile.price_anomaly_samples(x.raw())


@query
def rows_by_month(x: Layers) -> DataFrame:
    return profile.rows_by_period(x.raw())


@query
def sheet_overlap(x: Layers) -> DataFrame:
    return profile.sheet_overlap(x.raw())


# -- KPIs --------------------------------------------------------------------


@query
def kpi_net_sales(x: Layers) -> DataFrame:
    return kpi.net_sales(x.accepted_contents(), MONTH)


@query
def kpi_orders(x: Layers) -> DataFrame:
    return kpi.orders(x.accepted_contents(), MONTH)


@query
def kpi_known_customers(x: Layers) -> DataFrame:
    return kpi.known_customers(x.accepted_contents(), MONTH)


@query
def kpi_units_sold(x: Layers) -> DataFrame:
    return kpi.units_sold(x.accepted_contents(), MONTH)


@query
def kpi_aov(x: Layers) -> DataFrame:
    return kpi.average_order_value(x.accepted_contents(), MONTH)


@query
def kpi_repeat_customers(x: Layers) -> DataFrame:
    return kpi.repeat_customers(x.accepted_contents(), MONTH).select(
        "batch_month", "known_customers", "repeat_customers"
    )


@query
def kpi_repeat_rate(x: Layers) -> DataFrame:
    every = kpi.repeat_customers(x.accepted(), []).select(
        F.lit(None).cast("date").alias("batch_month"), "repeat_rate"
    )
    return kpi.repeat_customers(x.accepted(), MONTH).select("batch_month", "repeat_rate").unionByName(every)


@query
def kpi_cancellation_rate(x: Layers) -> DataFrame:
    return kpi.cancellation_rate(x.accepted_contents(), MONTH)


@query
def kpi_by_product(x: Layers) -> DataFrame:
    """Measures per product from the accepted lines, with its canonical description."""
    return kpi.product_measures(x.accepted_contents()).select(
        "stock_code", "description", "net_sales", "orders", "units_sold", "cancelled_units",
        "cancelled_invoices",
    )


@query
def kpi_by_country(x: Layers) -> DataFrame:
    """Measures per country from the accepted lines; a missing one is UNKNOWN."""
    lines = x.accepted_contents().withColumn("country", F.coalesce("country", F.lit(kpi.UNKNOWN)))
    found = kpi.kpis(lines, ["country"], once=True)
    return found.select(*found.columns[1:], "country")


@query
def kpi_by_month_country(x: Layers) -> DataFrame:
    """Month and country with month, country and grand totals."""
    lines = x.accepted().withColumn("country", F.coalesce("country", F.lit(kpi.UNKNOWN)))
    return kpi.kpi_levels(lines, [["batch_month", "country"], ["batch_month"], ["country"], []])


@query
def top_customers(x: Layers) -> DataFrame:
    return kpi.top_customers(x.accepted_contents())
