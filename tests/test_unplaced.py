"""Measures that need no line's place are read from the source, and agree with the stored layers."""

from uuid import uuid4

import pytest
from pyspark.sql import functions as F

from ledgerspark.operators import contract, kpi, reconcile
from ledgerspark.plans import queries as registry
from ledgerspark.plans.layers import Layers
from ledgerspark.session import shared_folder
from ledgerspark.sources import storage

SF = "/root/testdata/sf0.001"


@pytest.fixture
def layers(spark):
    """Layers of a folder of their own, in which nothing is stored yet."""
    x = Layers(spark, SF)
    x.root = f"{shared_folder(spark)}/tests/unplaced-{uuid4().hex}"
    return x


def rows(df):
    return sorted(map(str, df.collect()))


def stored(x):
    return [n for n in ("raw", "accepted", "rejected", "star") if storage.exists(x.spark, f"{x.root}/{n}")]


def same_as_stored(x, name, plain):
    found = rows(registry._REGISTRY[name](x))
    left = stored(x)
    assert found == rows(plain(x))
    return left


def test_known_customers_store_no_layer(layers):
    assert same_as_stored(layers, "kpi_known_customers", lambda x: kpi.known_customers(x.accepted(), ["batch_month"])) == []


def test_kpi_by_country_reads_the_contract_once_and_stores_nothing(layers):
    plan = registry._REGISTRY["kpi_by_country"](layers)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1

    def plain(x):
        lines = x.accepted().withColumn("country", F.coalesce("country", F.lit(kpi.UNKNOWN)))
        found = kpi.kpis(lines, ["country"])
        return found.select(*found.columns[1:], "country")

    assert same_as_stored(layers, "kpi_by_country", plain) == []


def test_kpi_by_product_reads_the_contract_once_and_stores_nothing(layers):
    plan = registry._REGISTRY["kpi_by_product"](layers)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1

    def plain(x):
        _, fact, dims = x.star()
        return kpi.kpis(fact.withColumn("customer_id", F.lit(None).cast("string")), ["product_key"]).join(
            dims["dim_product"], "product_key"
        ).select(
            "stock_code", "description", "net_sales", "orders", "units_sold", "cancelled_units", "cancelled_invoices"
        )

    assert same_as_stored(layers, "kpi_by_product", plain) == []


def test_measures_in_one_pass_are_those_of_two(spark):
    schema = (
        "c string, classification string, NONSTANDARD_INVOICE boolean, is_cancelled boolean, quantity int, "
        "unit_price decimal(19,4), invoice_no string, customer_id string, line_amount decimal(30,4)"
    )
    data = [
        ("a", "ACCEPT", False, False, 2, 1, "1", "x", 2),
        ("a", "ACCEPT", False, False, 2, 1, "2", "x", 2),
        ("a", "ACCEPT", False, False, 1, 1, "1", None, 1),
        ("a", "ACCEPT", False, True, -1, 1, "C3", "y", -1),
        (None, "ACCEPT", False, False, 0, 0, "4", None, 0),
    ]
    from decimal import Decimal

    lines = spark.createDataFrame([(*r[:5], Decimal(r[5]), *r[6:8], Decimal(r[8])) for r in data], schema)
    for by in (["c"], []):
        for part in (lines, lines.filter("c = 'none'"), lines.filter("c is null")):
            assert rows(kpi.kpis(part, by, once=True)) == rows(kpi.kpis(part, by))


def test_transform_summary_stores_no_layer(layers):
    assert same_as_stored(layers, "transform_summary", lambda x: contract.transform_summary(x.outcome())) == []


def test_load_contract_is_checked_on_placed_lines_without_the_sinks(layers):
    left = same_as_stored(layers, "load_contract_violations", lambda x: reconcile.load_contract_violations(x.outcome()))
    assert left == ["raw"]
