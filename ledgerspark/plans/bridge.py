"""Raw invoice lines derived from the order tables: the input of every query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Physical order of lines in a sheet; the last two settle lines equal in the rest.
LINE_ORDER = [
    "l_orderkey",
    "l_linenumber",
    "l_partkey",
    "l_suppkey",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
    "l_returnflag",
    "l_linestatus",
    "l_shipdate",
]
TIE_BREAK = ["_file_hash", "_row_index"]
# All of a line that its raw fields are made of: lines equal in these are told apart by nothing
# that is kept, unless a key of the other tables repeats.
LINE_FIELDS = LINE_ORDER[:6]
_KEYS = {"orders": "o_orderkey", "customer": "c_custkey", "nation": "n_nationkey", "part": "p_partkey"}


def line_order(spark: SparkSession, sf_dir: str) -> list[str]:
    """The columns that settle the order of a sheet's lines, as few as the keys allow.

    With unique keys, lines equal in ``LINE_FIELDS`` are equal in all raw fields, and every
    further column would only be shuffled to sort equal lines.
    """
    keys = None
    for name, key in _KEYS.items():
        found = spark.read.parquet(f"{sf_dir}/{name}.parquet").select(F.lit(name).alias("t"), F.col(key).alias("k"))
        keys = found if keys is None else keys.unionByName(found)
    repeated = keys.filter(F.col("k").isNotNull()).groupBy("t", "k").count().filter("count > 1")
    return [*LINE_ORDER, *TIE_BREAK] if repeated.limit(1).count() else list(LINE_FIELDS)


def _sheets():
    """The sheets of a joined line: a replayed line appears in two."""
    year = F.concat(F.lit("YEAR "), F.year("o_orderdate").cast("string"))
    return F.when(F.col("l_orderkey") % 40 == 7, F.array(year, F.lit("REPLAY"))).otherwise(F.array(year))


def unplaced_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheet and raw fields of each line, in no order.

    The fields are made before the sheets are exploded: once for a replayed line, and apart
    from what is computed of them, into which Spark would otherwise copy them.
    """
    made = _joined(spark, sf_dir, LINE_FIELDS).select(_sheets().alias("_sheets"), *raw_fields()[1:])
    fields = [c for c in made.columns if c != "_sheets"]
    return made.select(F.explode("_sheets").alias("source_sheet"), *[F.col(f"`{c}`") for c in fields])


def joined_lines(spark: SparkSession, sf_dir: str, order_by: list[str]) -> DataFrame:
    """Each line with its sheets, its ``order_by`` columns and those its raw fields are made of."""
    # Exploding the sheets avoids a second scan and join.
    return _joined(spark, sf_dir, order_by).select(
        F.explode(_sheets()).alias("source_sheet"), *order_by, "o_custkey", "o_orderdate", "n_name", "p_name"
    )


def _joined(spark: SparkSession, sf_dir: str, order_by: list[str]) -> DataFrame:
    """Lines with their ``order_by`` columns and what they need of the other tables.

    The text fields are left for after the range shuffle (see ``raw_fields``): that
    shuffle reads its input twice, once to sample it. Orders meet customers and nations before the lines do, so the largest table
    is shuffled once per key; join strategies are left to size statistics.
    """

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    c = F.col
    order = (
        table("orders")
        .select("o_orderkey", "o_custkey", "o_orderdate")
        .join(table("customer").select("c_custkey", "c_nationkey"), c("o_custkey") == c("c_custkey"))
        .join(table("nation").select("n_nationkey", "n_name"), c("c_nationkey") == c("n_nationkey"))
        .select("o_orderkey", "o_custkey", "o_orderdate", "n_name")
    )
    made = {
        "_file_hash": F.xxhash64("_metadata.file_path").alias("_file_hash"),
        "_row_index": c("_metadata.row_index").alias("_row_index"),
    }
    line = table("lineitem").select(*[made.get(name, c(name)) for name in order_by])
    # A part adds a short name to a line, an order several columns: the parts are met first.
    joined = line.join(table("part").select("p_partkey", "p_name"), c("l_partkey") == c("p_partkey")).join(
        order, c("l_orderkey") == c("o_orderkey")
    )
    return joined.select(*order_by, "o_custkey", "o_orderdate", "n_name", "p_name")


def raw_fields() -> list:
    """Sheet and the eight raw text fields of a joined line."""
    c = F.col
    none = F.lit(None).cast("string")
    order_text = c("l_orderkey").cast("string")
    customer_text = c("o_custkey").cast("string")
    date_text = c("o_orderdate").cast("string")
    quantity = c("l_quantity").cast("int").cast("string")
    amount = c("l_extendedprice").cast("decimal(19,4)").cast("string")
    cents = (c("l_extendedprice").cast("decimal(19,2)") * 100).cast("bigint").cast("string")
    first, minus = c("l_linenumber") == 1, F.lit("-")
    part, cancel = c("l_partkey"), c("l_orderkey") % 5 == 0
    return [
        c("source_sheet"),
        F.when(c("l_orderkey") % 397 == 5, none)
        .when(c("l_orderkey") % 101 == 0, F.concat(F.lit("A"), order_text))
        .when(cancel, F.concat(F.lit(" c"), order_text, F.lit(" ")))
        .otherwise(order_text)
        .alias("Invoice"),
        F.when((part % 83 == 1) & (c("l_linenumber") == 2), F.lit("  "))
        .otherwise(part.cast("string"))
        .alias("StockCode"),
        F.when(part % 89 == 0, none)
        .when(c("l_suppkey") % 5 == 3, F.concat(F.lit("  "), F.upper("p_name"), F.lit(" ")))
        .otherwise(c("p_name"))
        .alias("Description"),
        F.when((part % 97 == 2) & first, none)
        .when((part % 97 == 3) & first, F.lit("1.5"))
        .when((part % 97 == 4) & first, F.lit("2147483648"))
        .when(cancel & (part % 61 != 0), F.concat(minus, quantity))
        .when(~cancel & (part % 71 == 0), F.concat(minus, quantity))
        .otherwise(quantity)
        .alias("Quantity"),
        F.when((part % 103 == 6) & (c("l_linenumber") == 3), F.lit("bad-date"))
        .when(c("l_suppkey") % 7 == 0, F.concat(date_text, F.lit(".250")))
        .otherwise(date_text)
        .alias("InvoiceDate"),
        F.when((part % 107 == 7) & first, F.lit(""))
        .when((part % 107 == 8) & first, F.lit("1.23451"))
        .when((part % 107 == 9) & first, F.lit("not-a-number"))
        .when((c("l_orderkey") % 101 == 0) & first, F.concat(minus, amount))
        .when(part % 73 == 0, F.lit("0"))
        .when(part % 53 == 0, F.concat(cents, F.lit("E-2")))
        .otherwise(amount)
        .alias("Price"),
        F.when(c("o_custkey") % 10 == 3, none)
        .when(c("o_custkey") % 47 == 1, F.lit("ABC"))
        .when(c("o_custkey") % 11 == 2, F.concat(F.lit("00"), customer_text))
        .otherwise(F.concat(customer_text, F.lit(".0")))
        .alias("Customer ID"),
        F.when(c("l_orderkey") % 211 == 9, F.lit("   "))
        .when(c("l_suppkey") % 9 == 4, F.concat(F.lit(" "), c("n_name"), F.lit(" ")))
        .otherwise(c("n_name"))
        .alias("Country"),
    ]
