"""Star schema: four dimensions with stable keys and one fact row per accepted line."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.functions.dates import date_key
from ledgerspark.functions.frames import distinct_counts, few, side_by_side
from ledgerspark.functions.predicates import core_sale, count_where
from ledgerspark.operators.numbering import (
    ID_PREFIX_DIGITS,
    numbered_by_hash_id,
    numbered_few,
    numbered_in_order,
)
from ledgerspark.schema import ACCEPTED_CLASSES, FACT_COLUMNS, UNKNOWN_DESCRIPTION
from ledgerspark.sources.accepted import with_partitions
from ledgerspark.sources.raw import source_row_id

# name -> (surrogate key, natural key)
DIMENSIONS = {
    "dim_date": ("date_key", "full_date"),
    "dim_customer": ("customer_key", "customer_id"),
    "dim_product": ("product_key", "stock_code"),
    "dim_country": ("country_key", "country"),
}
UNKNOWN_KEY = 0
_KEYS = {key for key, _ in DIMENSIONS.values()} | {"sales_key", "source_row_id"}
# What a fact takes from its line besides the id, and what its keys follow from.
LINE_PARTS = list(
    dict.fromkeys(
        [c for c in FACT_COLUMNS if c not in _KEYS]
        + ["source_sheet", "source_row_number", "invoice_datetime", "customer_id", "stock_code", "country"]
    )
)
_SPREAD = 1024


def calendar(bounds: DataFrame) -> DataFrame:
    """One ``dim_date`` row per day of each (first_date, last_date) range."""
    days = bounds.select(
        F.explode(F.sequence("first_date", "last_date", F.expr("interval 1 day"))).alias("full_date")
    )
    d = F.col("full_date")
    return days.select(
        date_key(d).alias("date_key"),
        "full_date",
        F.dayofmonth(d).alias("day"),
        F.month(d).alias("month"),
        F.date_format(d, "MMMM").alias("month_name"),
        F.quarter(d).alias("quarter"),
        F.year(d).alias("year"),
        F.date_format(d, "EEEE").alias("weekday_name"),
        (F.weekday(d) >= 5).alias("is_weekend"),
    )


def date_bounds(lines: DataFrame) -> DataFrame:
    return lines.agg(
        F.min("invoice_datetime").cast("date").alias("first_date"),
        F.max("invoice_datetime").cast("date").alias("last_date"),
    ).filter(F.col("first_date").isNotNull())


def known_members(lines: DataFrame, natural: str) -> DataFrame:
    return lines.filter(F.col(natural).isNotNull()).select(natural).distinct()


def keyed_members(
    members: DataFrame, key: str, path: str, start: int = 0, rows: int | None = None
) -> DataFrame:
    """Members with dense keys after ``start`` in natural-key order, stored under ``path``.

    Few members, ``rows`` at most, are numbered in one task and not stored.
    """
    natural = members.columns[0]
    if few(rows):
        numbered = numbered_few(members, [natural], "_n")
    else:
        numbered = numbered_in_order(members, path, [natural], members.columns, "_n")
    return numbered.select((F.col("_n") + start).cast("int").alias(key), *members.columns)


def unknown_member(members: DataFrame) -> DataFrame:
    """The one key-0 row with no natural key."""
    key, natural = members.columns
    return members.sparkSession.range(1).select(
        F.lit(UNKNOWN_KEY).alias(key), F.lit(None).cast("string").alias(natural)
    )


def description_counts(lines: DataFrame) -> DataFrame:
    """Per (code, description), null ones too: frequency and latest time over core and all accepted lines.

    Core lines are a subset of accepted lines, so both tiers come from one scan and one
    shuffle. Counts of two sets of lines can be merged, see ``merged_counts``.
    """
    core = core_sale()
    accepted = F.col("classification").isin(*ACCEPTED_CLASSES)
    return lines.groupBy("stock_code", "description").agg(
        count_where(core & accepted).alias("core_count"),
        F.max(F.when(core & accepted, F.col("invoice_datetime"))).alias("core_latest"),
        count_where(accepted).alias("all_count"),
        F.max(F.when(accepted, F.col("invoice_datetime"))).alias("all_latest"),
    )


def merged_counts(*counts: DataFrame) -> DataFrame:
    """Description counts of all lines from those of parts of them."""
    return reduce(DataFrame.unionByName, counts).groupBy("stock_code", "description").agg(
        F.sum("core_count").alias("core_count"),
        F.max("core_latest").alias("core_latest"),
        F.sum("all_count").alias("all_count"),
        F.max("all_latest").alias("all_latest"),
    )


def description_frequencies(lines: DataFrame) -> DataFrame:
    """The same counts in long form, tier 0 = core lines, tier 1 = all accepted lines."""
    tiers = F.array(
        *[
            F.struct(
                F.lit(tier).alias("source_tier"),
                F.col(f"{name}_count").alias("occurrence_count"),
                F.col(f"{name}_latest").alias("latest_invoice_datetime"),
            )
            for tier, name in enumerate(("core", "all"))
        ]
    )
    return (
        description_counts(lines.filter(F.col("description").isNotNull()))
        .select("stock_code", "description", F.inline(tiers))
        .filter(F.col("occurrence_count") > 0)
    )


def best_description() -> Column:
    """Aggregate over description counts: the best one by core tier, frequency, latest time, text.

    A minimum over an ordered struct replaces a ranking window: it combines on the
    map side, so a code with very many descriptions is never sorted in one task.
    A description seen on core lines only needs its core candidate, which always
    ranks before its own all-lines candidate. Null where there is no description.
    """
    is_core = F.col("core_count") > 0
    count = F.when(is_core, F.col("core_count")).otherwise(F.col("all_count"))
    latest = F.when(is_core, F.col("core_latest")).otherwise(F.col("all_latest"))
    rank = F.struct(
        F.when(is_core, 0).otherwise(1).alias("tier"),
        (-count).alias("fewer"),
        F.datediff(F.lit("1970-01-01").cast("date"), latest.cast("date")).alias("older_day"),
        (-(F.hour(latest) * 3600 + F.minute(latest) * 60 + F.second(latest))).alias("older_second"),
        F.col("description"),
        count.alias("count"),
        latest.alias("latest"),
    )
    named = F.col("description").isNotNull() & (F.col("all_count") > 0)
    return F.min(F.when(named, rank))


def canonical_of_counts(counts: DataFrame) -> DataFrame:
    """Best description per code; one without any description keeps its row."""
    best = counts.groupBy("stock_code").agg(best_description().alias("best"))
    return best.select(
        "stock_code",
        F.coalesce("best.description", F.lit(UNKNOWN_DESCRIPTION)).alias("description"),
        F.col("best.tier").alias("source_tier"),
        F.col("best.count").alias("occurrence_count"),
        F.col("best.latest").alias("latest_invoice_datetime"),
    )


def canonical_descriptions(lines: DataFrame) -> DataFrame:
    return canonical_of_counts(description_counts(lines))


def upsert_products(current: DataFrame | None, canonical: DataFrame, path: str) -> DataFrame:
    """Type-1 product dimension: new codes get new keys, changed texts are replaced."""
    canonical = canonical.select("stock_code", "description")
    if current is None:
        return keyed_members(canonical, "product_key", path)
    top = current.agg(F.max("product_key")).first()[0] or 0
    fresh = canonical.join(current.select("stock_code"), "stock_code", "left_anti")
    kept = current.join(
        canonical.withColumnRenamed("description", "_new"), "stock_code", "left"
    ).select("product_key", "stock_code", F.coalesce("_new", "description").alias("description"))
    return kept.unionByName(keyed_members(fresh, "product_key", path, top))


def _spread_nulls(natural: str) -> Column:
    """Join key in which missing members are spread instead of meeting in one task."""
    line = F.hash("source_sheet", "source_row_number")
    salt = F.concat(F.lit("\0"), F.pmod(line, F.lit(_SPREAD)).cast("string"))
    return F.coalesce(F.col(natural), salt)


def resolve_keys(lines: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """Left-join the keys of ``dims``; UNKNOWN for missing customers and countries.

    Dimensions are joined as stored tables, so Spark broadcasts those whose files
    are small and shuffles the rest. A missing key stays null for the caller to judge.
    """
    result = lines
    for name, (key, natural) in DIMENSIONS.items():
        if name not in dims:
            continue
        member = dims[name].select(F.col(key), F.col(natural).alias("_member"))
        if name == "dim_date":
            result = result.join(
                member, F.col("invoice_datetime").cast("date") == F.col("_member"), "left"
            ).drop("_member")
            continue
        optional = name != "dim_product"
        on = _spread_nulls(natural) if optional else F.col(natural)
        found = member.filter(F.col("_member").isNotNull()).withColumnRenamed(key, "_key")
        value = F.col("_key")
        if optional:
            value = F.when(F.col(natural).isNull(), UNKNOWN_KEY).otherwise(value)
        result = (
            result.join(found, on == F.col("_member"), "left")
            .withColumn(key, value)
            .drop("_member", "_key")
        )
    return result


def unresolved_keys(lines: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """(dimension, unresolved_rows): must be zero before facts are written."""
    resolved = resolve_keys(lines, dims)
    wide = resolved.agg(
        *[count_where(F.col(key).isNull()).alias(name) for name, (key, _) in DIMENSIONS.items()]
    )
    return wide.unpivot([], wide.columns, "dimension_name", "unresolved_rows")


def fact_rows(
    lines: DataFrame,
    dims: dict[str, DataFrame],
    start: int,
    digits: int = ID_PREFIX_DIGITS,
    rows: int | None = None,
    large: tuple[str, ...] = (),
) -> DataFrame:
    """Fact rows of accepted lines, numbered after ``start`` by (month, row id).

    ``digits`` of the ids split a month; ``prefix_digits`` gives them for its size. Few
    lines, ``rows`` at most, are numbered in one task. Lines are not shuffled to meet
    ``large`` dimensions, only their natural keys are.

    A key that does not resolve stops the job inside the same pass, so no line is
    ever dropped by a join and no second pass is needed to check.
    """
    lines, groups = with_partitions(lines), ["year", "month"]
    if few(rows):
        numbered = numbered_few(lines, [*groups, "source_row_id"], "sales_key")
        resolved = resolve_keys(numbered.withColumn("sales_key", F.lit(start) + F.col("sales_key")), dims)
    else:
        # Ids are the widest column and rarely more than the digest of two others, so most
        # are left out of the shuffles and derived again where the lines are numbered.
        row_id, own = F.col("source_row_id"), source_row_id(F.col("source_sheet"), F.col("source_row_number"))
        narrow = lines.select(
            *[c for c in [*LINE_PARTS, *groups] if c in lines.columns],
            F.substring(row_id, 1, digits).alias("_bucket"),
            F.when(~row_id.eqNullSafe(own), row_id).alias("source_row_id"),
        )
        if large:
            keyed = _keyed_apart(narrow, dims, large, [*groups, "_bucket"])
        else:
            keyed = resolve_keys(narrow, dims).repartition(*groups, "_bucket")
            keyed = keyed.withColumn("source_row_id", F.coalesce(row_id, own))
        resolved = numbered_by_hash_id(
            keyed, "source_row_id", groups, "sales_key", start, digits, lines
        )
    checked = {
        key: F.when(
            F.col(key).isNull(),
            F.raise_error(F.lit(f"An accepted line has no {key}; load dimensions first.")),
        ).otherwise(F.col(key))
        for key, _ in DIMENSIONS.values()
    }
    return resolved.withColumns(checked).select(*FACT_COLUMNS, "year", "month")


def _keyed_apart(
    lines: DataFrame, dims: dict[str, DataFrame], large: tuple[str, ...], place: list[str]
) -> DataFrame:
    """Lines with all keys and their ids, dealt by ``place``, shuffled themselves only once.

    A dimension too large to be sent to every task is met by a line's place and natural
    keys alone; what they resolve to is dealt like the lines and taken over by row id.
    """
    keys = [DIMENSIONS[name][0] for name in large]
    naturals = ["invoice_datetime" if name == "dim_date" else DIMENSIONS[name][1] for name in large]
    others = [F.lit(None).cast("int").alias(key) for key in keys]
    wide = resolve_keys(lines, {n: d for n, d in dims.items() if n not in large})
    wide = wide.select(*[c for c in wide.columns if c in FACT_COLUMNS or c not in naturals], *others, F.lit(True).alias("_line"))
    line = ["source_sheet", "source_row_number", "source_row_id", *place]
    found = resolve_keys(lines.select(*line, *naturals), {n: dims[n] for n in large})
    found = found.select(*line, *keys, F.lit(False).alias("_line"))
    both = wide.unionByName(found, allowMissingColumns=True).repartition(*place)
    own = source_row_id(F.col("source_sheet"), F.col("source_row_number"))
    both = both.withColumn("source_row_id", F.coalesce("source_row_id", own))
    same = Window.partitionBy(*place, "source_row_id")
    repeated = F.when(F.count_if("_line").over(same) != 1, F.raise_error(F.lit("A row id of accepted lines repeats.")))
    taken = {key: F.coalesce(repeated.cast("int"), F.max(key).over(same)) for key in keys}
    return both.withColumns(taken).filter("_line").drop("_line")


def with_natural_keys(fact: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """Fact rows with their dimension members in place of surrogate keys."""
    result = fact
    for name in ("dim_date", "dim_customer", "dim_product", "dim_country"):
        key = DIMENSIONS[name][0]
        columns = {
            "dim_date": ["full_date"],
            "dim_customer": ["customer_id"],
            "dim_product": ["stock_code", "description"],
            "dim_country": ["country"],
        }[name]
        result = result.join(dims[name].select(key, *columns), key, "left")
    return result


def dimension_counts(dims: dict[str, DataFrame], staging: DataFrame) -> DataFrame:
    """Stored rows of each dimension against the count its source lines imply."""
    days = staging.agg(F.min("invoice_datetime").alias("low"), F.max("invoice_datetime").alias("high"))
    members = {"customer_id": "dim_customer", "stock_code": "dim_product", "country": "dim_country"}
    expected = side_by_side(days, distinct_counts(staging, members)).select(
        (F.datediff("high", "low") + 1).cast("bigint").alias("dim_date"),
        (F.col("dim_customer") + 1).alias("dim_customer"),  # and the UNKNOWN rows
        "dim_product",
        (F.col("dim_country") + 1).alias("dim_country"),
    )
    expected = expected.unpivot([], expected.columns, "dimension_name", "expected_rows")
    actual = None
    for name in DIMENSIONS:
        keys = dims[name]
        wrong = F.lit(0).cast("bigint")
        if name == "dim_date":
            wrong = count_where(F.col("date_key") != date_key(F.col("full_date")))
        one = keys.agg(F.count(F.lit(1)).alias("actual_rows"), wrong.alias("incorrect_keys"))
        one = one.select(F.lit(name).alias("dimension_name"), "*")
        actual = one if actual is None else actual.unionByName(one)
    return actual.join(expected, "dimension_name").withColumn(
        "matches", (F.col("actual_rows") == F.col("expected_rows")) & (F.col("incorrect_keys") == 0)
    )
