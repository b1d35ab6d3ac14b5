"""Profile tables of the raw lines, before any cleaning.

Raw rules differ from the contract on purpose: the cancellation prefix is read
unstripped and case-sensitive, and numbers may be any double.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerspark.functions.dates import wall_clock
from ledgerspark.functions.frames import side_by_side
from ledgerspark.functions.numbers import loose_double
from ledgerspark.functions.predicates import count_where
from ledgerspark.functions.text import is_blank, strip
from ledgerspark.operators.numbering import store_in_order
from ledgerspark.schema import RAW_COLUMNS

SAMPLE_SIZE = 20
TOP_VALUES = 10
CODE_EXAMPLES = 30
DESCRIPTION_SAMPLE = 8
QUANTILES = (0.01, 0.05, 0.25, 0.50, 0.75, 0.95, 0.99)
QUANTITY_CLASSES = ("negative", "zero", "positive", "null_blank_or_invalid")
INVOICE_CLASSES = ("c_prefixed", "non_c", "invoice_null", "invoice_blank")


def raw(name: str) -> Column:
    return F.col(f"`{name}`")


def masked(lines: DataFrame) -> DataFrame:
    """Raw columns with the parsed values and classes every profile table uses."""
    types = {f.name: f.dataType for f in lines.schema.fields}

    def blank(name: str) -> Column:
        return is_blank(raw(name), types[name])

    parsed = lines.select(
        "source_sheet",
        "source_row_number",
        *[raw(c) for c in RAW_COLUMNS],
        loose_double(raw("Quantity"), types["Quantity"]).alias("quantity_value"),
        loose_double(raw("Price"), types["Price"]).alias("price_value"),
        loose_double(raw("Customer ID"), types["Customer ID"]).alias("customer_value"),
        wall_clock(raw("InvoiceDate"), types["InvoiceDate"]).alias("invoice_time"),
        raw("Invoice").cast("string").alias("invoice_text"),
        *[
            blank(c).alias(f"{c.replace(' ', '').lower()}_blank")
            for c in RAW_COLUMNS
        ],
    )
    invoice, c = F.col("invoice_text"), F.col

    def sign(value: Column) -> Column:
        return (
            F.when(value < 0, "negative")
            .when(value == 0, "zero")
            .when(value > 0, "positive")
            .otherwise("null_blank_or_invalid")
        )

    return parsed.select(
        "*",
        F.when(invoice.isNull(), "invoice_null")
        .when(c("invoice_blank"), "invoice_blank")
        .when(invoice.startswith("C"), "c_prefixed")
        .otherwise("non_c")
        .alias("invoice_class"),
        sign(c("quantity_value")).alias("quantity_class"),
        sign(c("price_value")).alias("price_class"),
    )


def percentage(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(
        part.cast("double") / whole.cast("double") * 100.0
    )


def isoformat(ts: Column) -> Column:
    """'YYYY-MM-DD HH:MM:SS[.ffffff]', empty when there is no timestamp."""
    whole = F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    text = F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))
    return F.coalesce(text, F.lit(""))


def sheet_summary(lines: DataFrame) -> DataFrame:
    """Rows, columns, types, date bounds and invalid dates of each sheet.

    Sheets are united by name, so a column that a sheet does not have is null in all its
    rows. A sheet's columns are those with a value; they are compared with the first sheet's.
    """
    types = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in lines.schema if f.name in RAW_COLUMNS)
    time = F.col("invoice_time")
    invalid = raw("InvoiceDate").isNotNull() & ~F.col("invoicedate_blank") & time.isNull()
    found = masked(lines).groupBy(F.col("source_sheet").alias("sheet_name")).agg(
        F.count(F.lit(1)).alias("row_count"),
        present_columns().alias("present"),
        F.lit(types).alias("column_types"),
        isoformat(F.min(time)).alias("min_invoice_datetime"),
        isoformat(F.max(time)).alias("max_invoice_datetime"),
        count_where(invalid).alias("invalid_invoice_datetime_count"),
    )
    first = F.first("present").over(Window.orderBy("sheet_name"))  # a row per sheet
    return found.withColumn("schema_matches_reference", F.col("present") == first).select(
        "sheet_name",
        "row_count",
        F.bit_count("present").cast("int").alias("column_count"),
        "column_types",
        "min_invoice_datetime",
        "max_invoice_datetime",
        "invalid_invoice_datetime_count",
        "schema_matches_reference",
    )


def present_columns() -> Column:
    """Aggregate: one bit for each raw column that has any value."""
    bits = [F.when(F.count(raw(c)) > 0, 1 << k).otherwise(0) for k, c in enumerate(RAW_COLUMNS)]
    return reduce(lambda a, b: a + b, bits)


def null_summary(lines: DataFrame) -> DataFrame:
    """Null and blank counts per column, for each sheet and combined.

    Lines are counted once per sheet; the combined rows add up those counts.
    """
    types = {f.name: f.dataType for f in lines.schema.fields}
    per_sheet = lines.groupBy("source_sheet").agg(
        F.count(F.lit(1)).alias("n"),
        *[count_where(raw(c).isNull()).alias(f"null::{c}") for c in RAW_COLUMNS],
        *[count_where(is_blank(raw(c), types[c])).alias(f"blank::{c}") for c in RAW_COLUMNS],
    )
    long = per_sheet.select(
        "source_sheet",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column_name"),
                        F.col("n").alias("row_count"),
                        F.col(f"`null::{c}`").alias("null_count"),
                        F.col(f"`blank::{c}`").alias("blank_count"),
                    )
                    for c in RAW_COLUMNS
                ]
            )
        ),
    )
    totals = long.groupingSets(
        [[F.col("source_sheet"), F.col("column_name")], [F.col("column_name")]],
        F.col("source_sheet"),
        F.col("column_name"),
    ).agg(
        F.grouping("source_sheet").alias("_all"),
        *[F.sum(c).alias(c) for c in ("row_count", "null_count", "blank_count")],
    )
    return totals.select(
        F.when(F.col("_all") == 1, "combined").otherwise("sheet").alias("scope"),
        F.coalesce("source_sheet", F.lit("")).alias("sheet_name"),
        "column_name",
        "row_count",
        "null_count",
        percentage(F.col("null_count"), F.col("row_count")).alias("null_percentage"),
        "blank_count",
        percentage(F.col("blank_count"), F.col("row_count")).alias("blank_percentage"),
    )


def cardinality(lines: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct values of four columns, over all non-null and over non-blank values.

    One small aggregate per column: a line is never copied once per distinct count. On
    request the counts are estimates (two per cent), all from one pass without a shuffle of values.
    """
    types = {f.name: f.dataType for f in lines.schema.fields}
    names = {
        "Invoice": "unique_invoices",
        "StockCode": "unique_stockcodes",
        "Customer ID": "unique_known_customer_ids",
        "Country": "unique_countries",
    }
    frames, estimates = [], {}
    for column, metric in names.items():
        stem = metric if column == "Customer ID" else f"{metric}_non_null"
        if approximate:
            estimates[stem] = raw(column)
            estimates[f"{stem}_non_blank"] = F.when(~is_blank(raw(column), types[column]), raw(column))
            continue
        values = lines.select(raw(column).alias("v")).distinct()
        counts = values.agg(
            count_where(F.col("v").isNotNull()).alias(stem),
            count_where(F.col("v").isNotNull() & ~is_blank(F.col("v"), types[column])).alias(
                f"{stem}_non_blank"
            ),
        )
        frames.append(counts.unpivot([], counts.columns, "metric", "value"))
    if approximate:
        counts = lines.agg(*[F.approx_count_distinct(c, 0.02).alias(name) for name, c in estimates.items()])
        frames.append(counts.unpivot([], counts.columns, "metric", "value"))
    return reduce(DataFrame.unionByName, frames).select(F.lit("combined").alias("scope"), "*")


def cancellation_matrix(lines: DataFrame) -> DataFrame:
    """Invoice class x quantity class: rows, share and distinct invoices; empty cells are 0."""
    per_invoice = masked(lines).groupBy("invoice_class", "quantity_class", "Invoice").agg(
        F.count(F.lit(1)).alias("n")
    )
    found = per_invoice.groupBy("invoice_class", "quantity_class").agg(
        F.sum("n").alias("row_count"),
        count_where(raw("Invoice").isNotNull()).alias("distinct_invoice_count"),
    )
    cells = F.array(
        *[
            F.struct(F.lit(i).alias("invoice_class"), F.lit(q).alias("quantity_class"))
            for i in INVOICE_CLASSES
            for q in QUANTITY_CLASSES
        ]
    )
    grid = lines.sparkSession.range(1).select(F.inline(cells))
    full = grid.join(found, ["invoice_class", "quantity_class"], "left").fillna(
        0, ["row_count", "distinct_invoice_count"]
    )
    total = F.sum("row_count").over(Window.partitionBy())  # sixteen cells
    return full.select(
        "invoice_class",
        "quantity_class",
        "row_count",
        percentage(F.col("row_count"), total).alias("row_percentage"),
        "distinct_invoice_count",
    )


def value_quantiles(lines: DataFrame, workspace: str) -> DataFrame:
    """Exact linear quantiles of (column_name, value) pairs at any scale.

    Values are counted first, then range-sorted by value; ranks come from running
    sums inside each range plus the rows of the ranges before it. No task holds all
    the distinct values of a column, as the built-in exact percentile would.
    """
    spark = lines.sparkSession
    freq = lines.filter(F.col("value").isNotNull()).groupBy("column_name", "value").agg(
        F.count(F.lit(1)).alias("n")
    )
    store_in_order(
        freq,
        workspace,
        ["column_name", "value"],
        ["column_name", "value", "n", F.spark_partition_id().alias("part")],
    )
    stored = spark.read.parquet(workspace)
    parts = stored.groupBy("column_name", "part").agg(F.sum("n").alias("_rows"))
    by_part = Window.partitionBy("column_name").orderBy("part")
    offsets = parts.select(
        "column_name",
        "part",
        (F.sum("_rows").over(by_part) - F.col("_rows")).alias("_before"),
        F.sum("_rows").over(Window.partitionBy("column_name")).alias("_total"),
    )
    inside = Window.partitionBy("column_name", "part").orderBy("value")
    ranked = stored.withColumn("_cum", F.sum("n").over(inside)).join(
        offsets, ["column_name", "part"]
    )
    first = F.col("_before") + F.col("_cum") - F.col("n")
    last = F.col("_before") + F.col("_cum") - 1
    picks = []
    for q in QUANTILES:
        place = F.lit(q) * (F.col("_total") - 1)
        for name, rank in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            picks.append(
                F.max(F.when((first <= rank) & (rank <= last), F.col("value"))).alias(
                    f"{name}_{q}"
                )
            )
    got = ranked.groupBy("column_name").agg(*picks, F.max("_total").alias("_total"))

    def interpolated(q: float) -> Column:
        place = F.lit(q) * (F.col("_total") - 1)
        low, high = F.col(f"`lo_{q}`"), F.col(f"`hi_{q}`")
        return low + (high - low) * (place - F.floor(place))

    return got.select(
        "column_name", *[interpolated(q).alias(f"p{round(q * 100):02d}") for q in QUANTILES]
    )


def numeric_profile(lines: DataFrame, workspace: str) -> DataFrame:
    """Counts, moments, extremes and exact quantiles of Quantity and Price."""
    marked = masked(lines)
    frames = []
    for column, value in (("Quantity", "quantity_value"), ("Price", "price_value")):
        v = F.col(value)
        blank = F.col(f"{column.lower()}_blank")
        frames.append(
            marked.agg(
                F.count(v).alias("count"),
                count_where(raw(column).isNull()).alias("null_count"),
                count_where(blank).alias("blank_count"),
                count_where(raw(column).isNotNull() & ~blank & v.isNull()).alias(
                    "invalid_numeric_count"
                ),
                count_where(v < 0).alias("negative_count"),
                count_where(v == 0).alias("zero_count"),
                count_where(v > 0).alias("positive_count"),
                F.avg(v).alias("mean"),
                F.stddev_samp(v).alias("std"),
                F.min(v).alias("min"),
                F.max(v).alias("max"),
            ).select(F.lit(column).alias("column_name"), "*")
        )
    pairs = marked.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("column_name"), F.col(v).alias("value"))
                    for c, v in (("Quantity", "quantity_value"), ("Price", "price_value"))
                ]
            )
        )
    )
    quantiles = value_quantiles(pairs, workspace)
    return (
        reduce(DataFrame.unionByName, frames)
        .join(quantiles, "column_name", "left")
        .select(
            F.lit("combined").alias("scope"),
            "column_name",
            *[
                c
                for c in frames[0].columns
                if c != "column_name"
            ],
            F.col("p50").alias("median"),
            *[f"p{round(q * 100):02d}" for q in QUANTILES],
        )
    )


def approximate_quantiles(lines: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """One-pass approximate quantiles, for a first look at very large sources."""
    marked = masked(lines)
    qs = F.array(*[F.lit(q) for q in QUANTILES])
    return marked.agg(
        *[
            F.percentile_approx(F.col(v), qs, F.lit(accuracy)).alias(v)
            for v in ("quantity_value", "price_value")
        ]
    )


def country_profile(lines: DataFrame) -> DataFrame:
    """Rows, invoices, known customers and missing-customer rows per raw country label."""
    marked = lines.select(
        raw("Country").cast("string").alias("country_value"),
        raw("Invoice").alias("invoice"),
        raw("Customer ID").alias("customer"),
    )
    # One grouped pass feeds both distinct counts.
    fine = marked.groupBy("country_value", "invoice", "customer").agg(F.count(F.lit(1)).alias("n"))
    label = F.col("country_value")
    summary = fine.groupBy("country_value").agg(
        F.sum("n").alias("row_count"),
        F.countDistinct("invoice").alias("distinct_invoices"),
        F.countDistinct("customer").alias("known_customers"),
        F.coalesce(F.sum(F.when(F.col("customer").isNull(), F.col("n"))), F.lit(0)).alias(
            "missing_customer_rows"
        ),
    )
    total = lines.agg(F.count(F.lit(1))).scalar()
    status = (
        F.when(label.isNull(), "null").when(strip(label) == "", "blank").otherwise("value")
    )
    named = F.col("value_status") == "value"
    return (
        summary.withColumn("value_status", status)
        .select(
            "country_value",
            "value_status",
            "row_count",
            percentage(F.col("row_count"), total).alias("row_percentage"),
            "distinct_invoices",
            "known_customers",
            "missing_customer_rows",
            percentage(F.col("missing_customer_rows"), F.col("row_count")).alias(
                "missing_customer_percentage"
            ),
            (named & (label != strip(label))).alias("has_outer_whitespace"),
            F.when(named, F.lower(strip(label))).otherwise("").alias("comparison_key"),
        )
        .orderBy(F.col("row_count").desc(), F.col("country_value").asc_nulls_last())
    )


def country_variants(lines: DataFrame) -> DataFrame:
    """Comparison keys written in more than one way, with each writing."""
    label = F.col("raw_value")
    written = (
        lines.select(raw("Country").cast("string").alias("raw_value"))
        .groupBy("raw_value")
        .agg(F.count(F.lit(1)).alias("row_count"))
        .filter(label.isNotNull() & (strip(label) != ""))
        .withColumn("comparison_key", F.lower(strip(label)))
    )
    several = (
        written.groupBy("comparison_key")
        .agg(F.count(F.lit(1)).alias("variant_count"))
        .filter("variant_count > 1")
    )
    return written.join(several, "comparison_key").select(
        "comparison_key", "variant_count", "raw_value", "row_count"
    )


def duplicate_counts(lines: DataFrame) -> DataFrame:
    """Groups of lines equal in all eight columns, nulls being equal, with their first place.

    The place (sheet, row) is one wide decimal, the sheet's rank before any row number,
    because a minimum over it is hash-aggregated while one over a struct would sort every
    line first. The ranked sheets are one row per source.
    """
    sheets = lines.groupBy(F.col("source_sheet").alias("_sheet")).agg(F.count(F.lit(1)).alias("_n"))
    rank = F.row_number().over(Window.orderBy("_sheet")).cast("decimal(18,0)")
    ranked = sheets.select("_sheet", rank.alias("_rank"))
    place = (F.col("_rank") * F.lit(Decimal(10**19))).cast("decimal(38,0)") + F.col("source_row_number")
    placed = lines.join(ranked, F.col("source_sheet").eqNullSafe(F.col("_sheet")))
    return (
        placed.select(*[raw(c) for c in RAW_COLUMNS], place.cast("decimal(38,0)").alias("_place"))
        .groupBy(*[raw(c) for c in RAW_COLUMNS])
        .agg(F.count(F.lit(1)).alias("group_size"), F.min("_place").alias("first_place"))
        .filter("group_size > 1")
    )


def duplicate_summary(groups: DataFrame) -> DataFrame:
    stats = groups.agg(
        F.coalesce(F.sum("group_size"), F.lit(0)).alias(
            "rows_participating_in_duplicate_looking_groups"
        ),
        F.count(F.lit(1)).alias("duplicate_looking_group_count"),
        F.coalesce(F.max("group_size"), F.lit(0)).alias("largest_duplicate_looking_group_size"),
    )
    return stats.unpivot([], stats.columns, "metric", "value")


def duplicate_groups(lines: DataFrame, top: int = 10) -> DataFrame:
    """Summary rows and the largest example groups of duplicate-looking lines."""
    groups = duplicate_counts(lines)
    best = groups.orderBy(F.col("group_size").desc(), "first_place").limit(top)
    rank = F.row_number().over(Window.orderBy(F.col("group_size").desc(), "first_place"))
    examples = best.select(
        F.lit("example").alias("record_type"),
        F.lit("representative_duplicate_looking_group").alias("metric"),
        F.lit(None).cast("bigint").alias("value"),
        rank.alias("example_rank"),
        *[raw(c) for c in RAW_COLUMNS],
        "group_size",
    )
    summary = duplicate_summary(groups).select(F.lit("summary").alias("record_type"), "metric", "value")
    return summary.unionByName(examples, allowMissingColumns=True)


def code_class() -> Column:
    """Structural class of a raw stock code."""
    code = raw("StockCode").cast("string")
    text = strip(code)
    return (
        F.when(code.isNull(), "null")
        .when(text == "", "blank")
        .when(text.rlike(r"\A[0-9]+(?:\.0+)?\z"), "numeric_like")
        .when(text.rlike(r"\A[A-Za-z]+\z"), "alphabetic")
        .when(text.rlike(r"\A[A-Za-z0-9]+\z"), "mixed_alphanumeric")
        .otherwise("special_or_other")
    )


def _code_counts(lines: DataFrame) -> DataFrame:
    return (
        lines.groupBy(raw("StockCode"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("category", code_class())
    )


def _top_json(ranked: DataFrame, by: str, value: str, count: str) -> DataFrame:
    """Ranked values per group as one JSON list; at most a handful per group."""
    item = F.struct(
        F.col("value_rank"), F.col(value).alias("value"), F.col(count).alias("row_count")
    )
    listed = F.transform(
        F.array_sort(F.collect_list(item)),
        lambda x: F.struct(x["value"].alias("value"), x["row_count"].alias("row_count")),
    )
    return ranked.groupBy(by).agg(F.to_json(listed).alias("top_examples_json"))


def stockcode_classes(lines: DataFrame) -> DataFrame:
    """Rows, distinct codes and the most frequent codes of each structural class."""
    codes = _code_counts(lines)
    scoped = codes.select(
        F.explode(F.array(F.col("category"), F.lit("all_rows"))).alias("category"), "StockCode", "n"
    )
    counts = scoped.groupBy("category").agg(
        F.sum("n").alias("row_count"),
        count_where(raw("StockCode").isNotNull()).alias("distinct_stockcodes"),
    )
    rank = F.row_number().over(
        Window.partitionBy("category").orderBy(F.col("n").desc(), "StockCode")
    )
    top = (
        scoped.filter(raw("StockCode").isNotNull())
        .withColumn("value_rank", rank)
        .filter(F.col("value_rank") <= TOP_VALUES)
    )
    kinds = ["all_rows", "null", "blank", "numeric_like", "alphabetic", "mixed_alphanumeric", "special_or_other"]
    grid = lines.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(k) for k in kinds])).alias("category")
    )
    return (
        grid.join(counts, "category", "left")
        .join(_top_json(top, "category", "StockCode", "n"), "category", "left")
        .select(
            F.when(F.col("category") == "all_rows", "overall")
            .otherwise("classification")
            .alias("record_type"),
            "category",
            F.coalesce("row_count", F.lit(0)).alias("row_count"),
            F.coalesce("distinct_stockcodes", F.lit(0)).alias("distinct_stockcodes"),
            F.coalesce("top_examples_json", F.lit("[]")).alias("top_examples_json"),
        )
    )


def nonstandard_codes(lines: DataFrame, top: int = CODE_EXAMPLES) -> DataFrame:
    """Most frequent codes that are not five digits and an optional letter."""
    text = strip(raw("StockCode").cast("string"))
    odd = (text != "") & ~text.rlike(r"\A[0-9]{5}[A-Za-z]?\z")
    return (
        lines.filter(odd)
        .groupBy(raw("StockCode").alias("stock_code"))
        .agg(F.count(F.lit(1)).alias("row_count"))
        .orderBy(F.col("row_count").desc(), "stock_code")
        .limit(top)
    )


def code_descriptions(lines: DataFrame) -> DataFrame:
    """Per raw code: rows and distinct non-null descriptions."""
    pairs = (
        lines.filter(raw("StockCode").isNotNull())
        .groupBy(raw("StockCode").alias("stock_code"), raw("Description").alias("description"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return pairs.groupBy("stock_code").agg(
        count_where(F.col("description").isNotNull()).alias("distinct_descriptions"),
        F.sum("n").alias("row_count"),
    )


def description_stats(lines: DataFrame) -> DataFrame:
    n = F.col("distinct_descriptions")
    stats = code_descriptions(lines).agg(
        count_where(n == 1).alias("stockcodes_with_one_description"),
        count_where(n > 1).alias("stockcodes_with_multiple_descriptions"),
        count_where(n == 0).alias("stockcodes_with_zero_descriptions"),
        F.coalesce(F.max(n), F.lit(0)).alias("maximum_descriptions_per_stockcode"),
    )
    return stats.unpivot([], stats.columns, "metric", "value")


def description_consistency(lines: DataFrame, top: int = SAMPLE_SIZE) -> DataFrame:
    """Summary of descriptions per code and the codes with the most of them.

    Ties follow the code; the description samples are read for the chosen codes only.
    """
    best = (
        code_descriptions(lines)
        .filter("distinct_descriptions > 1")
        .orderBy(F.col("distinct_descriptions").desc(), F.col("row_count").desc(), "stock_code")
        .limit(top)
    )
    texts = (
        lines.select(raw("StockCode").alias("stock_code"), raw("Description").alias("description"))
        .filter(F.col("description").isNotNull())
        .join(best.select("stock_code"), "stock_code", "left_semi")
        .groupBy("stock_code", "description")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    rank = F.row_number().over(
        Window.partitionBy("stock_code").orderBy(F.col("n").desc(), "description")
    )
    top_texts = texts.withColumn("value_rank", rank).filter(
        F.col("value_rank") <= DESCRIPTION_SAMPLE
    )
    examples = best.join(
        _top_json(top_texts, "stock_code", "description", "n"), "stock_code", "left"
    ).select(
        F.lit("example").alias("record_type"),
        F.lit("").alias("metric"),
        F.lit(None).cast("bigint").alias("value"),
        "stock_code",
        "distinct_descriptions",
        "row_count",
        F.col("top_examples_json").alias("descriptions_sample_json"),
    )
    summary = description_stats(lines).select(
        F.lit("summary").alias("record_type"), "metric", "value"
    )
    return summary.unionByName(examples, allowMissingColumns=True)


def top_values(lines: DataFrame, columns: list[str] = RAW_COLUMNS, top: int = TOP_VALUES) -> DataFrame:
    """Most frequent non-null values of each column, ties in value order."""
    pairs = lines.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("column_name"), raw(c).cast("string").alias("value"))
                    for c in columns
                ]
            )
        )
    )
    counts = (
        pairs.filter(F.col("value").isNotNull())
        .groupBy("column_name", "value")
        .agg(F.count(F.lit(1)).alias("row_count"))
    )
    rank = F.row_number().over(
        Window.partitionBy("column_name").orderBy(F.col("row_count").desc(), "value")
    )
    return counts.withColumn("value_rank", rank).filter(F.col("value_rank") <= top)


def _samples(marked: DataFrame, kinds: dict[str, tuple[Column, Column]]) -> DataFrame:
    """First rows of each kind by its own order, then by physical place.

    Each kind is an ordered limit, for which a task keeps only its best rows; a
    ranking window would sort all rows of all kinds.
    """
    columns = ["source_sheet", "source_row_number", *RAW_COLUMNS]
    best = [
        marked.filter(rule)
        .select(*[raw(c) for c in columns], order.alias("_order"))
        .orderBy("_order", "source_sheet", "source_row_number")
        .limit(SAMPLE_SIZE)
        .select(F.lit(kind).alias("sample_type"), "*")
        for kind, (rule, order) in kinds.items()
    ]
    place = Window.partitionBy("sample_type").orderBy(
        "_order", "source_sheet", "source_row_number"
    )
    return (
        reduce(DataFrame.unionByName, best)
        .withColumn("sample_rank", F.row_number().over(place))
        .drop("_order")
    )


def extreme_quantity_samples(lines: DataFrame) -> DataFrame:
    v = F.col("quantity_value")
    return _samples(
        masked(lines),
        {"most_negative_quantity": (v < 0, v), "largest_positive_quantity": (v > 0, -v)},
    )


def price_anomaly_samples(lines: DataFrame) -> DataFrame:
    v = F.col("price_value")
    return _samples(
        masked(lines),
        {
            "negative_price": (v < 0, v),
            "zero_price": (v == 0, F.lit(0.0)),
            "largest_positive_price": (v > 0, -v),
        },
    )


def rows_by_period(lines: DataFrame) -> DataFrame:
    """Rows per year and per month of the raw invoice time."""
    time = F.col("invoice_time")
    months = (
        masked(lines)
        .filter(time.isNotNull())
        .groupBy(F.date_format(time, "yyyy-MM").alias("period"))
        .agg(F.count(F.lit(1)).alias("row_count"))
    )
    years = months.groupBy(F.substring("period", 1, 4).alias("period")).agg(
        F.sum("row_count").alias("row_count")
    )
    return years.select(F.lit("year").alias("grain"), "*").unionByName(
        months.select(F.lit("month").alias("grain"), "*")
    )


def sheet_overlap(lines: DataFrame) -> DataFrame:
    """Date bounds, null/blank/invalid dates and the window common to all sheets."""
    time, blank = F.col("invoice_time"), F.col("invoicedate_blank")
    per_sheet = masked(lines).groupBy("source_sheet").agg(
        F.min(time).alias("low"),
        F.max(time).alias("high"),
        count_where(raw("InvoiceDate").isNull()).alias("nulls"),
        count_where(blank).alias("blanks"),
        count_where(raw("InvoiceDate").isNotNull() & ~blank & time.isNull()).alias("invalid"),
    )
    wide = per_sheet.agg(
        F.min("low").alias("minimum"),
        F.max("high").alias("maximum"),
        F.coalesce(F.sum("nulls"), F.lit(0)).alias("null_count"),
        F.coalesce(F.sum("blanks"), F.lit(0)).alias("blank_count"),
        F.coalesce(F.sum("invalid"), F.lit(0)).alias("invalid_count"),
        F.when(count_where(F.col("low").isNull()) == 0, F.max("low")).alias("overlap_start"),
        F.when(count_where(F.col("low").isNull()) == 0, F.min("high")).alias("overlap_end"),
    )
    none = F.col("overlap_start") > F.col("overlap_end")
    return wide.select(
        "minimum",
        "maximum",
        "null_count",
        "blank_count",
        "invalid_count",
        F.when(none, None).otherwise(F.col("overlap_start")).alias("overlap_start"),
        F.when(none, None).otherwise(F.col("overlap_end")).alias("overlap_end"),
    )


def _line_metrics(types: dict[str, T.DataType]) -> dict[tuple[str, str], tuple[str, Column]]:
    """(section, metric) -> (how, condition): counted in rows or in distinct invoices."""
    c = F.col
    is_c, non_c = c("invoice_class") == "c_prefixed", c("invoice_class") == "non_c"
    no_invoice = c("invoice_class") == "invoice_null"
    no_customer, no_text = raw("Customer ID").isNull(), raw("Description").isNull()
    negative, zero = c("price_class") == "negative", c("price_class") == "zero"
    customer_text = raw("Customer ID").cast("string")
    label = raw("Country").cast("string")
    standard = F.col("invoice_text").rlike(r"\A(?:[0-9]+|C[0-9]+)\z")
    fraction = F.abs(c("customer_value") - F.rint(c("customer_value"))) > 1e-9
    rows, invoices = "rows", "invoices"
    return {
        ("dates", "invoice_date_null_count"): (rows, raw("InvoiceDate").isNull()),
        ("dates", "invoice_date_blank_count"): (rows, c("invoicedate_blank")),
        ("dates", "invoice_date_invalid_nonblank_count"): (
            rows,
            raw("InvoiceDate").isNotNull() & ~c("invoicedate_blank") & c("invoice_time").isNull(),
        ),
        ("invoice", "total_rows"): (rows, F.lit(True)),
        ("invoice", "distinct_non_null_invoices"): (invoices, F.lit(True)),
        ("invoice", "c_prefixed_rows"): (rows, is_c),
        ("invoice", "c_prefixed_distinct_invoices"): (invoices, is_c),
        ("invoice", "non_c_nonblank_rows"): (rows, non_c),
        ("invoice", "non_c_nonblank_distinct_invoices"): (invoices, non_c),
        ("invoice", "null_rows"): (rows, no_invoice),
        ("invoice", "blank_rows"): (rows, c("invoice_class") == "invoice_blank"),
        ("invoice_format", "unexpected_nonblank_rows"): (rows, (is_c | non_c) & ~standard),
        ("customer_id", "string_rendering_ends_with_dot_zero_rows"): (
            rows,
            customer_text.endswith(".0"),
        ),
        ("customer_id", "fractional_numeric_rows"): (rows, fraction),
        ("customer_id", "invalid_numeric_rows"): (
            rows,
            customer_text.isNotNull() & ~c("customerid_blank") & c("customer_value").isNull(),
        ),
        ("missing_customer", "rows"): (rows, no_customer),
        ("missing_customer", "distinct_invoices"): (invoices, no_customer),
        ("missing_customer", "c_prefixed_rows"): (rows, no_customer & is_c),
        ("missing_customer", "non_c_rows"): (rows, no_customer & non_c),
        ("missing_customer", "negative_quantity_rows"): (
            rows,
            no_customer & (c("quantity_class") == "negative"),
        ),
        ("missing_customer", "zero_price_rows"): (rows, no_customer & zero),
        ("missing_description", "rows"): (rows, no_text),
        ("missing_description", "missing_customer_overlap_rows"): (rows, no_text & no_customer),
        ("missing_description", "c_prefixed_rows"): (rows, no_text & is_c),
        ("missing_description", "non_c_rows"): (rows, no_text & non_c),
        **{
            ("missing_description_quantity", k): (rows, no_text & (c("quantity_class") == k))
            for k in QUANTITY_CLASSES
        },
        **{
            ("missing_description_price", k): (rows, no_text & (c("price_class") == k))
            for k in QUANTITY_CLASSES
        },
        ("price", "negative_rows"): (rows, negative),
        ("price", "zero_rows"): (rows, zero),
        ("zero_price", "distinct_invoices"): (invoices, zero),
        ("zero_price", "c_prefixed_rows"): (rows, zero & is_c),
        ("zero_price", "non_c_rows"): (rows, zero & non_c),
        ("zero_price", "invoice_null_rows"): (rows, zero & no_invoice),
        ("zero_price", "missing_customer_rows"): (rows, zero & no_customer),
        ("negative_price", "c_prefixed_rows"): (rows, negative & is_c),
        ("negative_price", "non_c_rows"): (rows, negative & non_c),
        **{
            ("negative_price_quantity", k): (rows, negative & (c("quantity_class") == k))
            for k in QUANTITY_CLASSES
        },
        ("country", "null_rows"): (rows, label.isNull()),
        ("country", "blank_rows"): (rows, c("country_blank")),
        ("country", "outer_whitespace_rows"): (
            rows,
            ~c("country_blank") & (label != strip(label)),
        ),
        ("stockcode", "null_rows"): (rows, raw("StockCode").isNull()),
        ("stockcode", "blank_rows"): (rows, c("stockcode_blank")),
        ("description", "null_rows"): (rows, no_text),
        ("description", "blank_rows"): (rows, c("description_blank")),
    }


def dataset_summary(lines: DataFrame) -> DataFrame:
    """(section, metric, value) with text values: the profile's headline numbers.

    Row counts and distinct-invoice counts come from one aggregate per invoice and
    one over invoices: a single shuffle, and no row copy per distinct count.
    """
    types = {f.name: f.dataType for f in lines.schema.fields}
    wanted = _line_metrics(types)
    marked = masked(lines)
    names = {key: f"m{i}" for i, key in enumerate(wanted)}
    per_invoice = marked.groupBy("Invoice").agg(
        *[count_where(rule).alias(names[k]) for k, (_, rule) in wanted.items()]
    )
    known = raw("Invoice").isNotNull()
    wide = per_invoice.agg(
        *[
            (
                F.coalesce(F.sum(n), F.lit(0))
                if wanted[k][0] == "rows"
                else count_where(known & (F.col(n) > 0))
            ).alias(n)
            for k, n in names.items()
        ]
    )

    def item(section: str, metric: str, value: Column) -> Column:
        return F.struct(
            F.lit(section).alias("section"),
            F.lit(metric).alias("metric"),
            value.cast("string").alias("value"),
        )

    total = F.col(names[("invoice", "total_rows")])
    shares = [
        item(s, "percentage", F.round(percentage(F.col(names[(s, "rows")]), total), 6).cast("decimal(12,6)"))
        for s in ("missing_customer", "missing_description")
    ]
    counted = wide.select(
        F.inline(F.array(*[item(*k, F.col(n)) for k, n in names.items()], *shares))
    )
    dates = sheet_overlap(lines).select(
        F.inline(
            F.array(
                *[
                    item("dates", metric, isoformat(F.col(column)))
                    for metric, column in (
                        ("minimum_valid_invoice_datetime", "minimum"),
                        ("maximum_valid_invoice_datetime", "maximum"),
                        ("common_sheet_date_overlap_start", "overlap_start"),
                        ("common_sheet_date_overlap_end", "overlap_end"),
                    )
                ]
            )
        )
    )
    sheets = lines.groupBy("source_sheet").agg(F.count(F.lit(1)).alias("n"), present_columns().alias("present"))
    names_json = F.to_json(F.array_sort(F.collect_list("source_sheet")))
    summed = sheets.agg(
        F.count(F.lit(1)).alias("sheets"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        names_json.alias("names"),
        (F.min("present") == F.max("present")).alias("identical"),
    )
    counted_rows = wide.select(F.col(names[("invoice", "total_rows")]).alias("combined"))
    source = side_by_side(summed, counted_rows).select(
        F.inline(
            F.array(
                item("source", "sheet_count", F.col("sheets")),
                item("source", "sheet_names_json", F.col("names")),
                item("rows", "sum_sheet_row_counts", F.col("rows")),
                item("rows", "combined_row_count", F.col("combined")),
                item("rows", "sheet_combined_row_count_reconciled", F.col("rows") == F.col("combined")),
                item("schema", "schemas_identical", F.col("identical")),
                *[
                    item("schema", f"combined_dtype::{c}", F.lit(types[c].simpleString()))
                    for c in RAW_COLUMNS
                ],
            )
        )
    )
    periods = rows_by_period(lines).select(
        F.when(F.col("grain") == "year", "rows_by_year")
        .otherwise("rows_by_year_month")
        .alias("section"),
        F.col("period").alias("metric"),
        F.col("row_count").cast("string").alias("value"),
    )
    variants = country_variants(lines).select("comparison_key").distinct()
    other = [
        variants.agg(F.count(F.lit(1)).cast("string").alias("value")).select(
            F.lit("country").alias("section"),
            F.lit("comparison_key_variant_group_count").alias("metric"),
            "value",
        ),
        description_stats(lines).select(
            F.lit("description_consistency").alias("section"),
            "metric",
            F.col("value").cast("string").alias("value"),
        ),
        duplicate_summary(duplicate_counts(lines)).select(
            F.lit("duplicates").alias("section"),
            "metric",
            F.col("value").cast("string").alias("value"),
        ),
    ]
    return reduce(DataFrame.unionByName, [source, counted, dates, periods, *other])


PROFILE_TABLES = (
    "dataset_summary",
    "sheet_summary",
    "null_summary",
    "cardinality_summary",
    "cancellation_summary",
    "numeric_summary",
    "country_summary",
    "duplicate_summary",
    "stockcode_summary",
    "description_consistency_summary",
    "extreme_quantity_samples",
    "price_anomaly_samples",
)


def profile_tables(lines: DataFrame, workspace: str) -> dict[str, DataFrame]:
    """The twelve profile tables by name."""
    made = (
        dataset_summary(lines),
        sheet_summary(lines),
        null_summary(lines),
        cardinality(lines),
        cancellation_matrix(lines),
        numeric_profile(lines, f"{workspace}/quantiles"),
        country_profile(lines),
        duplicate_groups(lines),
        stockcode_classes(lines),
        description_consistency(lines),
        extreme_quantity_samples(lines),
        price_anomaly_samples(lines),
    )
    return dict(zip(PROFILE_TABLES, made, strict=True))


def write_profiles(tables: dict[str, DataFrame], path: str) -> None:
    """Write the profile tables as CSV and check each one's header on re-reading."""
    if set(tables) != set(PROFILE_TABLES):
        raise ValueError("The profile must have exactly the twelve contracted tables.")
    for name, table in tables.items():
        # Profile tables are report-sized, so one file each is safe.
        table.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
        spark = table.sparkSession
        again = spark.read.option("header", True).csv(f"{path}/{name}")
        if again.columns != table.columns or again.isEmpty():
            raise ValueError(f"Profile table {name} did not survive writing.")
        if "sample_type" in again.columns:
            largest = again.groupBy("sample_type").count().agg(F.max("count")).first()[0]
            if largest and largest > SAMPLE_SIZE:
                raise ValueError(f"{name} holds a sample of {largest} rows.")
