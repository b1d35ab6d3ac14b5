"""Checks of each layer against the one before it.

Every function returns a DataFrame of measures; nothing is fixed by hand, and
asserting on the measures is left to the caller.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.functions.dates import date_key
from ledgerspark.functions.frames import few, side_by_side
from ledgerspark.functions.predicates import (
    core_cancellation,
    core_sale,
    count_where,
    sample_categories,
)
from ledgerspark.functions.text import utf16_units
from ledgerspark.operators import occupancy
from ledgerspark.operators.contract import long_counts
from ledgerspark.operators.warehouse import DIMENSIONS, canonical_descriptions, resolve_keys
from ledgerspark.schema import (
    ACCEPT,
    ACCEPT_FLAGGED,
    ACCEPTED_CLASSES,
    FACT_COPIED_COLUMNS,
    NULLABLE_TEXT,
    QUALITY_FLAGS,
    TEXT_LIMITS,
    UNKNOWN_DESCRIPTION,
)
from ledgerspark.sources.accepted import ROW_ID


def money_sum(c: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("decimal(38,4)")


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


# -- staging -----------------------------------------------------------------


def flag_totals(lines: DataFrame) -> DataFrame:
    """(quality_flag, row_count) over accepted lines; a line can count under several."""
    wide = lines.agg(*[count_where(F.col(k)).alias(k) for k in QUALITY_FLAGS])
    return wide.unpivot([], list(QUALITY_FLAGS), "quality_flag", "row_count")


def classification_counts(lines: DataFrame) -> DataFrame:
    return lines.groupBy("classification").agg(F.count(F.lit(1)).alias("row_count"))


def time_bounds(lines: DataFrame) -> DataFrame:
    return lines.agg(
        F.min("invoice_datetime").alias("minimum_invoice_datetime"),
        F.max("invoice_datetime").alias("maximum_invoice_datetime"),
        F.min("batch_month").alias("minimum_batch_month"),
        F.max("batch_month").alias("maximum_batch_month"),
    )


def id_counts(lines: DataFrame) -> DataFrame:
    """One row: rows, distinct ids and repeated ids, from one two-step aggregate."""
    per_id = lines.groupBy("source_row_id").agg(F.count(F.lit(1)).alias("n"))
    return per_id.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        count_where(F.col("source_row_id").isNotNull()).alias("distinct_ids"),
        count_where(F.col("n") > 1).alias("repeated_ids"),
    )


def staging_validation(lines: DataFrame) -> DataFrame:
    """(section, metric, value) of identity, class, flag, price and core-line counts."""
    ids = id_counts(lines)
    ids = ids.unpivot([], ids.columns, "metric", "value").select(
        F.lit("identity").alias("section"), "metric", "value"
    )
    wanted = {
        **{("classification", k): F.col("classification") == k for k in ACCEPTED_CLASSES},
        ("classification", "not_accepted"): ~F.col("classification").isin(*ACCEPTED_CLASSES),
        **{("quality_flag", k): F.col(k) for k in QUALITY_FLAGS},
        ("price", "negative_price_rows"): F.col("unit_price") < 0,
        ("core", "core_commercial_line_count"): core_sale(),
        ("core", "core_cancellation_line_count"): core_cancellation(),
    }
    return ids.unionByName(long_counts(lines, wanted))


def duplicate_keys(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """(table_name, key_columns, duplicated_keys, surplus_rows) of each named key.

    Null keys are members of no key, as in a unique constraint over known values.
    """
    frames = []
    for name, (df, keys) in tables.items():
        known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
        groups = df.filter(known).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        frames.append(
            groups.agg(
                count_where(F.col("n") > 1).alias("duplicated_keys"),
                F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus_rows"),
            ).select(
                F.lit(name).alias("table_name"), F.lit(",".join(keys)).alias("key_columns"), "*"
            )
        )
    return _union(frames)


def constraint_violations(checks: dict[str, tuple[DataFrame, dict[str, Column]]]) -> DataFrame:
    """(table_name, rule, violations): row rules that must hold, one scan per table.

    A rule that evaluates to null counts as violated.
    """
    frames = []
    for name, (df, rules) in checks.items():
        wide = df.agg(
            *[count_where(~F.coalesce(ok, F.lit(False))).alias(rule) for rule, ok in rules.items()]
        )
        long = wide.unpivot([], list(rules), "rule", "violations")
        frames.append(long.select(F.lit(name).alias("table_name"), "*"))
    return _union(frames)


def standard_rules() -> dict[str, dict[str, Column]]:
    """Row rules of the accepted table and the star schema."""
    c = F.col

    def unknown_shape(key: str, natural: str) -> Column:
        return ((c(key) == 0) & c(natural).isNull()) | ((c(key) > 0) & c(natural).isNotNull())

    line = {
        "source_row_number_at_least_2": c("source_row_number") >= 2,
        "accepted_classification": c("classification").isin(*ACCEPTED_CLASSES),
        "nonnegative_price": c("unit_price") >= 0,
    }
    return {
        "staging": {
            **line,
            "batch_month_first_day": F.dayofmonth("batch_month") == 1,
            "row_id_is_sha256_hex": c("source_row_id").rlike(ROW_ID),
        },
        "fact_sales": line,
        "dim_date": {"date_key_formula": c("date_key") == date_key(c("full_date"))},
        "dim_customer": {"unknown_member_shape": unknown_shape("customer_key", "customer_id")},
        "dim_country": {"unknown_member_shape": unknown_shape("country_key", "country")},
        "dim_product": {
            "code_and_description_present": c("stock_code").isNotNull()
            & c("description").isNotNull()
        },
    }


def load_violations() -> Column:
    """Codes of the load-contract rules a line breaks, in order; empty when loadable."""
    c = F.col
    # Null-safe: a rule that cannot be evaluated is a broken rule.
    rules = {
        "ROW_ID_NOT_SHA256": c("source_row_id").rlike(ROW_ID),
        "ROW_NUMBER_BELOW_2": c("source_row_number") >= 2,
        "NOT_ACCEPTED": c("classification").isin(*ACCEPTED_CLASSES),
        "PRICE_MISSING_OR_NEGATIVE": c("unit_price") >= 0,
        "AMOUNT_MISSING": c("line_amount").isNotNull(),
        "QUANTITY_MISSING": c("quantity").isNotNull(),
        "DATETIME_FINER_THAN_MILLISECOND": F.pmod(F.unix_micros(c("invoice_datetime").cast("timestamp")), F.lit(1000)) == 0,
        "MONTH_NOT_FIRST_DAY": F.dayofmonth("batch_month") == 1,
        "LOADED_AT_MISSING": c("loaded_at").isNotNull(),
        **{
            f"{name.upper()}_{'TOO_LONG' if name in NULLABLE_TEXT else 'MISSING_OR_TOO_LONG'}": (
                utf16_units(c(name)) <= limit
            )
            | (c(name).isNull() if name in NULLABLE_TEXT else F.lit(False))
            for name, limit in TEXT_LIMITS.items()
        },
        "FLAG_MISSING": reduce(lambda a, b: a & b, [c(k).isNotNull() for k in QUALITY_FLAGS]),
    }
    return F.concat_ws(
        ";", *[F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in rules.items()]
    )


def load_contract_violations(lines: DataFrame) -> DataFrame:
    """(violation, row_count) of lines that may not be loaded."""
    broken = lines.select(F.explode(F.split(load_violations(), ";")).alias("violation"))
    return broken.filter(F.col("violation") != "").groupBy("violation").agg(
        F.count(F.lit(1)).alias("row_count")
    )


# -- staging against fact ----------------------------------------------------


def identity_diff(left: DataFrame, right: DataFrame, left_name: str, right_name: str) -> DataFrame:
    """Ids of each side absent from the other, from one shuffle of ids instead of two joins."""
    sides = left.select("source_row_id", F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select("source_row_id", F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    per_id = sides.groupBy("source_row_id").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    return per_id.agg(
        F.coalesce(F.sum(F.when(F.col("r") == 0, F.col("l"))), F.lit(0)).alias("left_rows_missing_right"),
        F.coalesce(F.sum(F.when(F.col("l") == 0, F.col("r"))), F.lit(0)).alias("right_rows_missing_left"),
    ).select(F.lit(left_name).alias("left_layer"), F.lit(right_name).alias("right_layer"), "*")


NODE_BITS = (8, 16)  # of a row's hash that name its node, level by level


def _row_hashes(rows: DataFrame, columns: list[str]) -> list[Column]:
    """Two 64-bit hashes of a row; a null is told from any value and place."""
    parts = [x for c in columns for x in (F.col(c), F.col(c).isNull())]
    return [F.xxhash64(*parts), F.xxhash64(F.lit("second"), *parts)]


def differing_nodes(left: DataFrame, right: DataFrame, columns: list[str], bits: int) -> list[int]:
    """Nodes of the hash tree at depth ``bits`` whose rows the two sides do not share.

    A node has the rows whose hash begins with its bits. Sides agree in a node when count
    and both hash sums do; only these sums, one row per node and task, are shuffled, and at
    most 2 ** ``bits`` nodes come back.
    """
    return _differing(left, right, columns, F.call_function("shiftrightunsigned", F.col("one"), F.lit(64 - bits)))


def _differing(left: DataFrame, right: DataFrame, columns: list[str], node: Column) -> list:
    """Values of ``node``, which is made of ``columns`` or their hash, whose rows the sides do not share."""
    sums = []
    for rows, sign in ((left, 1), (right, -1)):
        one, two = _row_hashes(rows, columns)
        hashed = rows.select(*columns, one.alias("one"), two.alias("two"))
        sums.append(
            hashed.groupBy(node.alias("node")).agg(
                (F.count(F.lit(1)) * sign).alias("n"),
                *[(F.sum(F.col(h).cast("decimal(20,0)")) * sign).cast("decimal(38,0)").alias(h) for h in ("one", "two")],
            )
        )
    both = _union(sums).groupBy("node").agg(*[F.sum(c).alias(c) for c in ("n", "one", "two")])
    apart = both.filter((F.col("n") != 0) | (F.col("one") != 0) | (F.col("two") != 0))
    return [r.node for r in apart.select("node").collect()]


def differing_rows(
    left: DataFrame, right: DataFrame, columns: list[str], levels: tuple[int, ...] = NODE_BITS, by: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """The rows of both sides that lie in differing nodes; none when the sides agree.

    Each level looks only into the differing nodes of the one above, so rows themselves are
    shuffled by a later comparison only where the sides differ. ``by`` is one of the columns
    that has few values: where rows of one value differ in every node, as rejected lines that
    only one side has, those of the others are not shuffled with them.
    """
    sides = [left.select(*columns), right.select(*columns)]
    if by:
        values = _differing(*sides, columns, F.col(by))
        if not values:
            return sides[0].limit(0), sides[1].limit(0)
        apart = reduce(lambda a, b: a | b, [F.col(by).eqNullSafe(F.lit(v)) for v in values])
        sides = [rows.filter(apart) for rows in sides]
    for bits in levels:
        nodes = differing_nodes(*sides, columns, bits)
        if not nodes:
            return sides[0].limit(0), sides[1].limit(0)
        found = left.sparkSession.createDataFrame([(n,) for n in nodes], "_node long")
        for k, rows in enumerate(sides):
            node = F.call_function("shiftrightunsigned", _row_hashes(rows, columns)[0], F.lit(64 - bits))
            sides[k] = rows.withColumn("_node", node).join(found, "_node", "left_semi").drop("_node")
    return sides[0], sides[1]


def row_diff(left: DataFrame, right: DataFrame, columns: list[str], by: str | None = None) -> DataFrame:
    """Rows on one side only, with multiplicity: both ``EXCEPT ALL`` directions at once."""
    left, right = differing_rows(left, right, columns, by=by)
    sides = left.withColumn("_net", F.lit(1)).unionByName(right.withColumn("_net", F.lit(-1)))
    net = sides.groupBy(*columns).agg(F.sum("_net").alias("_net")).filter(F.col("_net") != 0)
    return net.select(
        F.when(F.col("_net") > 0, "left_only").otherwise("right_only").alias("side"),
        F.abs("_net").alias("copies"),
        *columns,
    )


def row_diff_counts(left: DataFrame, right: DataFrame, columns: list[str], by: str | None = None) -> DataFrame:
    """One row of ``row_diff`` totals per side, zero when the layers agree."""
    total = row_diff(left, right, columns, by).agg(
        *[
            F.coalesce(F.sum(F.when(F.col("side") == side, F.col("copies"))), F.lit(0)).alias(side)
            for side in ("left_only", "right_only")
        ]
    )
    return total.unpivot([], total.columns, "side", "row_count")


def fk_orphans(fact: DataFrame, dims: dict[str, DataFrame], by: list[str] = ()) -> DataFrame:
    """Fact rows whose key has no dimension row, per foreign key.

    Each key column is counted per value before it meets its dimension, so what is
    shuffled grows with the dimension, not with the fact table.
    """
    by = list(by)
    found = []
    for name, (key, _) in DIMENSIONS.items():
        counts = fact.groupBy(*by, key).agg(F.count(F.lit(1)).alias("n"))
        orphans = counts.join(dims[name].select(key), key, "left_anti")
        found.append(orphans.select(*by, F.lit(key).alias("key_name"), "n"))
    return _union(found).groupBy(*by).agg(
        *[
            F.coalesce(F.sum(F.when(F.col("key_name") == key, F.col("n"))), F.lit(0)).alias(
                f"orphan_{key}s"
            )
            for key, _ in DIMENSIONS.values()
        ]
    )


def unknown_member_usage(staging: DataFrame, fact: DataFrame, dims: dict) -> DataFrame:
    """Facts on the UNKNOWN members against missing values in their source lines."""
    frames = []
    for member, natural in (("customer", "customer_id"), ("country", "country")):
        key = f"{member}_key"
        facts = fact.agg(count_where(F.col(key) == 0).alias("unknown_facts"))
        lines = staging.agg(count_where(F.col(natural).isNull()).alias("expected_from_staging"))
        members = dims[f"dim_{member}"].agg(
            count_where((F.col(key) == 0) & F.col(natural).isNull()).alias("unknown_members")
        )
        frames.append(
            side_by_side(facts, lines, members).select(F.lit(member).alias("member"), "*")
        )
    return _union(frames)


def line_amount_reconciliation(staging: DataFrame, fact: DataFrame) -> DataFrame:
    """Signed amount of all accepted lines in both layers: load fidelity, not sales."""
    s = staging.agg(money_sum("line_amount").alias("staging_line_amount_sum"))
    f = fact.agg(money_sum("line_amount").alias("fact_line_amount_sum"))
    return side_by_side(s, f).withColumn(
        "difference",
        (F.col("staging_line_amount_sum") - F.col("fact_line_amount_sum")).cast("decimal(38,4)"),
    )


def compared_lines(
    staging: DataFrame, fact: DataFrame, dims: dict[str, DataFrame], by: list[str] = ()
) -> DataFrame:
    """Line-by-line comparison on row id: copied values and re-resolved keys."""
    expected = resolve_keys(staging, dims)
    s, f = expected.alias("s"), fact.alias("f")

    def differs(column: str) -> Column:
        return ~F.col(f"s.{column}").eqNullSafe(F.col(f"f.{column}"))

    copied = reduce(
        lambda a, b: a | b, [differs(c) for c in FACT_COPIED_COLUMNS if c != "source_row_id"]
    )
    mapped = reduce(
        lambda a, b: a | b,
        [differs(k) | F.col(f"s.{k}").isNull() for k, _ in DIMENSIONS.values()],
    )
    joined = s.join(f, F.col("s.source_row_id") == F.col("f.source_row_id"))
    if by:
        same = reduce(lambda a, b: a & b, [F.col(f"s.{c}") == F.col(f"f.{c}") for c in by])
        joined = joined.filter(same)
    return joined.groupBy(*[F.col(f"s.{c}") for c in by]).agg(
        F.count(F.lit(1)).alias("compared_rows"),
        count_where(copied).alias("copied_value_mismatches"),
        count_where(mapped).alias("dimension_mapping_mismatches"),
    )


def compared_in_all(staging: DataFrame, fact: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """``compared_lines`` of whole layers; lines meet their facts only if sums do not show that both agree."""
    if not layers_agree(staging, fact, dims):
        return compared_lines(staging, fact, dims)
    zero = F.lit(0).cast("bigint")
    return staging.agg(F.count(F.lit(1)).alias("compared_rows")).select(
        "compared_rows", zero.alias("copied_value_mismatches"), zero.alias("dimension_mapping_mismatches")
    )


def core_line_reconciliation(staging: DataFrame, fact: DataFrame) -> DataFrame:
    """(metric, staging_rows, fact_rows) of classes, cancellations and core lines."""
    wanted = {
        ("lines", "cancelled_rows"): F.col("is_cancelled"),
        ("lines", "accept_rows"): F.col("classification") == ACCEPT,
        ("lines", "flagged_rows"): F.col("classification") == ACCEPT_FLAGGED,
        ("lines", "core_commercial_line_count"): core_sale(),
        ("lines", "core_cancellation_line_count"): core_cancellation(),
    }
    s = long_counts(staging, wanted).select("metric", F.col("value").alias("staging_rows"))
    f = long_counts(fact, wanted).select("metric", F.col("value").alias("fact_rows"))
    return s.join(f, "metric")


def canonical_product_mismatch(staging: DataFrame, dim_product: DataFrame) -> DataFrame:
    """Stored descriptions against an independent recomputation, in both directions.

    The loader takes a minimum of merged counts; here both tiers' lines are counted apart
    and ranked by a window over the (code, description) pairs, which are few per code.
    """
    lines = staging.filter(F.col("description").isNotNull() & F.col("classification").isin(*ACCEPTED_CLASSES))
    tiers = lines.filter(core_sale()).withColumn("tier", F.lit(0)).unionByName(lines.withColumn("tier", F.lit(1)))
    counted = tiers.groupBy("stock_code", "description", "tier").agg(
        F.count(F.lit(1)).alias("n"), F.max("invoice_datetime").alias("latest")
    )
    order = Window.partitionBy("stock_code").orderBy("tier", F.desc("n"), F.desc("latest"), "description")
    first = counted.withColumn("place", F.row_number().over(order)).filter("place = 1")
    codes = staging.groupBy("stock_code").agg(F.lit(True).alias("_e"))
    expected = codes.join(first, "stock_code", "left").select(
        "stock_code", F.coalesce("description", F.lit(UNKNOWN_DESCRIPTION)).alias("_expected"), "_e"
    )
    actual = dim_product.select("stock_code", "description", F.lit(True).alias("_a"))
    both = expected.join(actual, "stock_code", "full_outer")
    return both.agg(
        F.count(F.lit(1)).alias("compared_codes"),
        count_where(F.col("_e").isNull()).alias("unexpected_codes"),
        count_where(F.col("_a").isNull()).alias("missing_codes"),
        count_where(
            F.col("_e") & F.col("_a") & ~F.col("_expected").eqNullSafe(F.col("description"))
        ).alias("description_mismatches"),
    )


def multi_description_counts(lines: DataFrame) -> DataFrame:
    """Codes with several, and with no, accepted description."""
    per_code = lines.groupBy("stock_code").agg(F.countDistinct("description").alias("n"))
    return per_code.agg(
        count_where(F.col("n") > 1).alias("multi_description_stock_codes"),
        count_where(F.col("n") == 0).alias("no_description_stock_codes"),
    )


def multi_description_report(lines: DataFrame, dim_product: DataFrame, top: int = 10) -> DataFrame:
    """First codes, in code order, that have several descriptions, with the chosen one."""
    several = (
        lines.groupBy("stock_code")
        .agg(F.countDistinct("description").alias("distinct_descriptions"))
        .filter("distinct_descriptions > 1")
    )
    stored = dim_product.select("stock_code", F.col("description").alias("stored_description"))
    chosen = canonical_descriptions(lines).withColumnsRenamed(
        {"description": "selected_description", "source_tier": "selected_source_tier"}
    )
    return (
        chosen.join(several, "stock_code")
        .join(stored, "stock_code")
        .orderBy("stock_code")
        .limit(top)
    )


def sample_rows(staging: DataFrame, fact: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """One line per category, the smallest row id, compared with its fact row.

    Each category is one minimum, so the categories need one pass and no sort. The picked
    ids, one per category, are looked up first: neither layer is shuffled to meet them.
    """
    categories = sample_categories()
    picks = staging.agg(
        *[F.min(F.when(rule, F.col("source_row_id"))).alias(k) for k, rule in categories.items()]
    )
    ids = {k: v for k, v in picks.first().asDict().items() if v is not None}
    picked = staging.sparkSession.createDataFrame(list(ids.items()), "sample_type string, source_row_id string")
    wanted = F.col("source_row_id").isin(sorted(set(ids.values())))
    lines = resolve_keys(staging.filter(wanted).join(picked, "source_row_id"), dims).alias("s")
    facts = fact.filter(wanted).alias("f")
    joined = lines.join(facts, F.col("s.source_row_id") == F.col("f.source_row_id"), "left")
    compared = [
        "invoice_no", "quantity", "unit_price", "line_amount", "is_cancelled",
        *[k for k, _ in DIMENSIONS.values()],
    ]
    same = reduce(
        lambda a, b: a & b,
        [F.coalesce(F.col(f"s.{c}") == F.col(f"f.{c}"), F.lit(False)) for c in compared],
    )
    return joined.select(
        "s.sample_type",
        "s.source_row_id",
        "s.stock_code",
        "s.description",
        "s.customer_id",
        "s.classification",
        "s.quality_flags",
        *[F.col(f"s.{c}").alias(f"staging_{c}") for c in compared],
        *[F.col(f"f.{c}").alias(f"fact_{c}") for c in compared],
        same.alias("sample_matches"),
    )


# -- periods -----------------------------------------------------------------


_LAYERS = ("staging", "fact")


def _layer_measures(staging: DataFrame, fact: DataFrame) -> DataFrame:
    """Per month: rows, ids, money, price, month and core-line measures of both layers.

    Both layers are reduced per (month, id) in one shuffle, which also shows the ids
    that only one of them has.
    """
    wrong = F.trunc("invoice_datetime", "MM") != F.col("batch_month")

    def narrow(lines: DataFrame, layer: str) -> DataFrame:
        return lines.select(
            "batch_month",
            "source_row_id",
            "line_amount",
            (F.col("unit_price") < 0).alias("negative"),
            wrong.alias("wrong"),
            core_sale().alias("sale"),
            core_cancellation().alias("cancellation"),
            F.lit(layer).alias("layer"),
        )

    both = narrow(staging, "staging").unionByName(narrow(fact, "fact"))
    first, second = [], []
    for layer in _LAYERS:
        mine = F.col("layer") == layer
        first += [
            count_where(mine).alias(f"{layer}_n"),
            F.sum(F.when(mine, F.col("line_amount"))).alias(f"{layer}_amount"),
            *[
                count_where(mine & F.col(c)).alias(f"{layer}_{c}")
                for c in ("negative", "wrong", "sale", "cancellation")
            ],
        ]
        second += [
            F.sum(f"{layer}_n").alias(f"{layer}_rows"),
            count_where(F.col(f"{layer}_n") > 0).alias(f"{layer}_distinct_ids"),
            money_sum(f"{layer}_amount").alias(f"{layer}_line_amount_sum"),
            F.sum(f"{layer}_negative").alias(f"{layer}_negative_price_rows"),
            F.sum(f"{layer}_wrong").alias(f"{layer}_wrong_invoice_month_rows"),
            F.sum(f"{layer}_sale").alias(f"{layer}_core_commercial_lines"),
            F.sum(f"{layer}_cancellation").alias(f"{layer}_core_cancellation_lines"),
        ]
    for layer, other in (_LAYERS, _LAYERS[::-1]):
        only = F.when(F.col(f"{other}_n") == 0, F.col(f"{layer}_n"))
        second.append(F.sum(only).alias(f"{layer}_ids_missing_{other}"))
    per_id = both.groupBy("batch_month", "source_row_id").agg(*first)
    return per_id.groupBy("batch_month").agg(*second)


_LAYER_MEASURES = (
    "rows",
    "distinct_ids",
    "negative_price_rows",
    "wrong_invoice_month_rows",
    "core_commercial_lines",
    "core_cancellation_lines",
)
ZERO_MEASURES = (
    "staging_ids_missing_fact",
    "fact_ids_missing_staging",
    "orphan_date_keys",
    "orphan_customer_keys",
    "orphan_product_keys",
    "orphan_country_keys",
    "staging_negative_price_rows",
    "fact_negative_price_rows",
    "staging_wrong_invoice_month_rows",
    "fact_wrong_invoice_month_rows",
    "copied_value_mismatches",
    "dimension_mapping_mismatches",
)
EQUAL_MEASURES = (
    ("staging_rows", "fact_rows"),
    ("staging_rows", "staging_distinct_ids"),
    ("fact_rows", "fact_distinct_ids"),
    ("staging_line_amount_sum", "fact_line_amount_sum"),
    ("staging_core_commercial_lines", "fact_core_commercial_lines"),
    ("staging_core_cancellation_lines", "fact_core_cancellation_lines"),
)


def layers_agree(staging: DataFrame, fact: DataFrame, dims: dict[str, DataFrame]) -> bool:
    """Whether both layers have the same lines, ids without a repeat, and every key resolves.

    Told by row numbers and by the sums of a hash tree over all copied values and keys, so
    what is shuffled is small. False says nothing: the lines must then be compared.
    """
    if not occupancy.all_distinct(staging):
        return False
    keys = [key for key, _ in DIMENSIONS.values()]
    copied = [h.alias(name) for h, name in zip(_row_hashes(staging, list(FACT_COPIED_COLUMNS)), ("_one", "_two"))]
    naturals = ["invoice_datetime", "customer_id", "stock_code", "country", "source_sheet", "source_row_number"]
    lines = resolve_keys(staging.select(*copied, *naturals), dims)
    found = lines.select("_one", "_two", *[F.coalesce(k, F.lit(-1)).alias(k) for k in keys])
    # A key that does not resolve is a mismatch even where the fact has none either.
    return not differing_nodes(found, fact.select(*copied, *keys), ["_one", "_two", *keys], NODE_BITS[0])


def _agreeing_periods(staging: DataFrame, fact: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """``period_reconciliation`` of layers that agree: nothing is missing or differs."""
    wrong = F.trunc("invoice_datetime", "MM") != F.col("batch_month")
    measured = None
    for layer, lines in zip(_LAYERS, (staging, fact)):
        found = lines.groupBy("batch_month").agg(
            F.count(F.lit(1)).alias(f"{layer}_rows"),
            F.count(F.lit(1)).alias(f"{layer}_distinct_ids"),
            count_where(F.col("unit_price") < 0).alias(f"{layer}_negative_price_rows"),
            count_where(wrong).alias(f"{layer}_wrong_invoice_month_rows"),
            count_where(core_sale()).alias(f"{layer}_core_commercial_lines"),
            count_where(core_cancellation()).alias(f"{layer}_core_cancellation_lines"),
            money_sum("line_amount").alias(f"{layer}_line_amount_sum"),
        )
        measured = found if measured is None else measured.unionByName(found, allowMissingColumns=True)
    months = measured.groupBy("batch_month")
    joined = months.agg(*[F.max(c).alias(c) for c in measured.columns if c != "batch_month"]).join(fk_orphans(fact, dims, ["batch_month"]), "batch_month", "left")
    zero = F.lit(0).cast("bigint")
    agreed = [*ZERO_MEASURES[:2], *ZERO_MEASURES[-2:]]
    counts = [
        *[f"{layer}_{m}" for m in _LAYER_MEASURES for layer in _LAYERS],
        *ZERO_MEASURES[:6],
        *ZERO_MEASURES[-2:],
    ]
    return joined.select(
        F.col("batch_month").alias("period"),
        *[(zero if c in agreed else F.coalesce(F.col(c), zero)).alias(c) for c in counts],
        *[F.col(f"{layer}_line_amount_sum").alias(f"{layer}_line_amount_sum") for layer in _LAYERS],
    )


def period_reconciliation(
    staging: DataFrame, fact: DataFrame, dims: dict[str, DataFrame], rows: int | None = None
) -> DataFrame:
    """22 measures for every month at once; a month missing from a layer shows as zero.

    Lines meet their facts one by one only if sums do not show that the layers agree.
    """
    if not few(rows) and layers_agree(staging, fact, dims):
        return _agreeing_periods(staging, fact, dims)
    orphans = fk_orphans(fact, dims, ["batch_month"])
    compared = compared_lines(staging, fact, dims, ["batch_month"])
    joined = _layer_measures(staging, fact)
    for part in (orphans, compared.drop("compared_rows")):
        joined = joined.join(part, "batch_month", "left")
    counts = [
        *[f"{layer}_{m}" for m in _LAYER_MEASURES for layer in _LAYERS],
        *ZERO_MEASURES[:6],
        *ZERO_MEASURES[-2:],
    ]
    return joined.select(
        F.col("batch_month").alias("period"),
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in counts],
        *[
            F.coalesce(F.col(c), F.lit(0)).cast("decimal(38,4)").alias(c)
            for c in ("staging_line_amount_sum", "fact_line_amount_sum")
        ],
    )


def period_passed() -> Column:
    """True when all zero measures are zero and all paired measures agree."""
    zero = [F.col(c) == 0 for c in ZERO_MEASURES]
    equal = [F.col(a) == F.col(b) for a, b in EQUAL_MEASURES]
    return reduce(lambda a, b: a & b, zero + equal)


def assert_period(measures: dict, input_rows: int) -> None:
    """Raise with the first measure of a period that does not reconcile."""
    if measures["staging_rows"] != input_rows:
        raise ValueError(f"staging_rows = {measures['staging_rows']}, input has {input_rows}.")
    for name in ZERO_MEASURES:
        if measures[name] != 0:
            raise ValueError(f"{name} = {measures[name]}, expected 0.")
    for left, right in EQUAL_MEASURES:
        if measures[left] != measures[right]:
            raise ValueError(f"{left} = {measures[left]} but {right} = {measures[right]}.")


def progress(periods: DataFrame) -> DataFrame:
    """Run log (period, passed, ...) -> per calendar month whether it lies behind the mark.

    The mark is the last month before the first failed or absent one. A month passes
    if any of its runs did; one row per month of history keeps the window small.
    """
    latest = periods.groupBy("period").agg(
        F.max("passed").alias("passed"), F.max("input_rows").alias("input_rows")
    )
    span = latest.agg(F.min("period").alias("low"), F.max("period").alias("high"))
    months = span.filter(F.col("low").isNotNull()).select(
        F.explode(F.sequence("low", "high", F.expr("interval 1 month"))).alias("period")
    )
    joined = months.join(latest, "period", "left").select(
        "period",
        F.coalesce("input_rows", F.lit(0)).alias("input_rows"),
        F.coalesce("passed", F.lit(False)).alias("passed"),
    )
    so_far = Window.orderBy("period").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = joined.withColumn("behind_mark", F.min("passed").over(so_far))
    mark = F.max(F.when(F.col("behind_mark"), F.col("period"))).over(Window.partitionBy())
    return marked.select("period", "input_rows", "passed", "behind_mark", mark.alias("mark"))


def period_decision(
    requested: Column, mark: Column, low: Column, high: Column, force: Column
) -> Column:
    """Sequencing rule of a requested month relative to the progress mark."""
    expected = F.coalesce(F.add_months(mark, 1), low)
    return (
        F.when((requested < low) | (requested > high), "out_of_range")
        .when(force & (mark.isNull() | (requested > mark)), "force_refused")
        .when(force, "force_rerun")
        .when(requested <= mark, "already_processed")
        .when(requested == expected, "next_period")
        .otherwise("gap")
    )
