"""Raw profile against pandas on a small fixture."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerspark.operators import profile
from ledgerspark.schema import RAW_COLUMNS


@pytest.fixture(scope="module")
def lines(raw_frame):
    rows = [
        {"Invoice": "1", "Quantity": str(q), "Price": str(p), "Country": c, "Customer ID": k}
        for q, p, c, k in [
            (1, 1.5, "France", "1"),
            (2, 2.25, " france ", None),
            (-3, 0, "France", "2.5"),
            (10, -4, None, "x"),
            (7, 9.75, "  ", "3.0"),
        ]
    ]
    rows += [
        {"Invoice": "C2", "Quantity": "-1", "StockCode": "85123a", "Description": None},
        {"Invoice": " C3", "Quantity": None, "StockCode": "POST"},
        {"Invoice": None, "Quantity": "inf", "StockCode": None, "Price": "nan"},
        {"Invoice": "  ", "Quantity": "1.5.2", "StockCode": " ", "InvoiceDate": "bad"},
        {"Invoice": "9", "StockCode": "D-1", "Description": "other"},
        {"Invoice": "9", "StockCode": "D-1", "Description": "other"},
    ]
    first = raw_frame(*rows, sheet="A")
    return first.unionByName(raw_frame({"InvoiceDate": "2009-12-02 00:00:00"}, sheet="B"))


@pytest.fixture(scope="module")
def pdf(lines):
    return lines.orderBy("source_sheet", "source_row_number").toPandas()


def test_quantiles_match_pandas_with_heavy_ties(spark, folder):
    rng = np.random.default_rng(5)
    values = np.where(rng.random(5000) < 0.4, 7.0, np.round(rng.lognormal(3, 2, 5000), 2))
    df = spark.createDataFrame(
        pd.DataFrame({"column_name": np.where(np.arange(5000) % 5 == 0, "a", "b"), "value": values})
    )
    got = {r.column_name: r for r in profile.value_quantiles(df.repartition(7), folder).collect()}
    for name in ("a", "b"):
        part = values[(np.arange(5000) % 5 == 0) == (name == "a")]
        for q in profile.QUANTILES:
            assert got[name][f"p{round(q * 100):02d}"] == pytest.approx(np.quantile(part, q), rel=1e-12)


def test_numeric_profile(lines, pdf, folder):
    rows = {r.column_name: r for r in profile.numeric_profile(lines, folder).collect()}
    price = pd.to_numeric(pdf["Price"], errors="coerce").dropna()
    r = rows["Price"]
    assert (r["count"], r.null_count, r.invalid_numeric_count) == (len(price), 0, 1)
    assert (r.negative_count, r.zero_count) == (1, 1)
    assert r.mean == pytest.approx(price.mean()) and r.std == pytest.approx(price.std())
    assert r.median == price.median() and r.p95 == pytest.approx(price.quantile(0.95))
    assert rows["Quantity"].invalid_numeric_count == 1 and rows["Quantity"].null_count == 1


def test_raw_prefix_is_case_sensitive_and_unstripped(lines):
    cells = {
        (r.invoice_class, r.quantity_class): r.row_count
        for r in profile.cancellation_matrix(lines).collect()
    }
    assert len(cells) == 16 and sum(cells.values()) == lines.count()
    assert cells["c_prefixed", "negative"] == 1
    assert cells["non_c", "null_blank_or_invalid"] == 1
    assert cells["invoice_null", "positive"] == 1
    assert cells["invoice_blank", "null_blank_or_invalid"] == 1


def test_nulls_cardinality_and_top_values(lines, pdf):
    nulls = {(r.scope, r.sheet_name, r.column_name): r for r in profile.null_summary(lines).collect()}
    assert len(nulls) == 24
    assert nulls["combined", "", "Invoice"].null_count == 1
    assert nulls["sheet", "A", "StockCode"].blank_count == 1
    counts = {r.metric: r.value for r in profile.cardinality(lines).collect()}
    assert counts["unique_invoices_non_null"] == pdf["Invoice"].nunique()
    assert counts["unique_invoices_non_null_non_blank"] == pdf["Invoice"].nunique() - 1
    tops = profile.top_values(lines).filter("column_name = 'Invoice' and value_rank = 1").first()
    assert (tops.value, tops.row_count) == ("1", 5)


def test_countries(lines):
    rows = {r.country_value: r for r in profile.country_profile(lines).collect()}
    assert rows[None].value_status == "null" and rows["  "].value_status == "blank"
    assert rows[" france "].has_outer_whitespace and rows[" france "].missing_customer_rows == 1
    variants = [(r.comparison_key, r.raw_value) for r in profile.country_variants(lines).collect()]
    assert sorted(variants) == [("france", " france "), ("france", "France")]


def test_codes_and_descriptions(lines):
    classes = {r.category: r for r in profile.stockcode_classes(lines).collect()}
    assert {k: r.row_count for k, r in classes.items()} == {
        "all_rows": 12, "null": 1, "blank": 1, "numeric_like": 6, "alphabetic": 1,
        "mixed_alphanumeric": 1, "special_or_other": 2,
    }
    assert json.loads(classes["special_or_other"].top_examples_json) == [
        {"value": "D-1", "row_count": 2}
    ]
    odd = [(r.stock_code, r.row_count) for r in profile.nonstandard_codes(lines).collect()]
    assert odd == [("D-1", 2), ("POST", 1)]
    stats = {r.metric: r.value for r in profile.description_stats(lines).collect()}
    assert stats["stockcodes_with_zero_descriptions"] == 1


def test_duplicates_treat_nulls_as_equal(raw_frame):
    df = raw_frame({"Country": None}, {"Country": None}, {}, {"Country": None})
    rows = profile.duplicate_groups(df).collect()
    found = {r.metric: r.value for r in rows if r.record_type == "summary"}
    assert list(found.values()) == [3, 1, 3]
    (example,) = [r for r in rows if r.record_type == "example"]
    assert (example.group_size, example.Country) == (3, None)


def test_samples_break_ties_by_place(raw_frame):
    df = raw_frame(*[{"Quantity": "5"} for _ in range(30)], {"Quantity": "9"}, {"Quantity": "-1"})
    rows = profile.extreme_quantity_samples(df).orderBy("sample_type", "sample_rank").collect()
    top = [r for r in rows if r.sample_type == "largest_positive_quantity"]
    assert [r.source_row_number for r in top] == [32, *range(2, 21)]
    assert [r.Quantity for r in rows if r.sample_type == "most_negative_quantity"] == ["-1"]


def test_dates(lines):
    row = profile.sheet_overlap(lines).first()
    assert (row.invalid_count, row.overlap_start) == (1, None)
    months = {(r.grain, r.period): r.row_count for r in profile.rows_by_period(lines).collect()}
    assert months == {("year", "2009"): 11, ("month", "2009-12"): 11}


def test_profile_tables_are_written_and_reread(spark, lines, folder):
    tables = profile.profile_tables(lines, folder)
    assert len(tables) == 12
    profile.write_profiles(tables, f"{folder}/csv")
    summary = spark.read.option("header", True).csv(f"{folder}/csv/dataset_summary")
    assert summary.filter("metric = 'total_rows'").first().value == "12"
    with pytest.raises(ValueError, match="twelve"):
        profile.write_profiles({"dataset_summary": tables["dataset_summary"]}, folder)


def test_approximate_quantiles_are_close(lines):
    row = profile.approximate_quantiles(lines).first()
    assert len(row.price_value) == len(profile.QUANTILES)
    assert lines.select(*[F.col(f"`{c}`") for c in RAW_COLUMNS]).columns == list(RAW_COLUMNS)


def test_a_sheet_without_a_column_is_told_from_the_first(raw_frame):
    whole = raw_frame({}, {"Country": None})
    lacking = raw_frame({"Price": None}, sheet="Year 2010-2011")
    found = {r.sheet_name: (r.column_count, r.schema_matches_reference) for r in profile.sheet_summary(whole.union(lacking)).collect()}
    assert found == {"Year 2009-2010": (8, True), "Year 2010-2011": (7, False)}
    rows = {(r.section, r.metric): r.value for r in profile.dataset_summary(whole.union(lacking)).collect()}
    assert rows["schema", "schemas_identical"] == "false"
    assert rows["rows", "combined_row_count"] == "3"
    assert rows["rows", "sheet_combined_row_count_reconciled"] == "true"
    alike = {(r.section, r.metric): r.value for r in profile.dataset_summary(whole).collect()}
    assert alike["schema", "schemas_identical"] == "true"


def test_places_of_duplicates_have_no_bound(raw_frame):
    far = raw_frame({}, {"Quantity": "8"}, numbers=[2**62, 2**62 + 1])
    near = raw_frame({"Quantity": "8"}, {}, sheet="Year 2010-2011")
    examples = [r for r in profile.duplicate_groups(near.union(far)).collect() if r.record_type == "example"]
    # the first sheet's rows decide, however high their numbers
    assert [r.Quantity for r in sorted(examples, key=lambda r: r.example_rank)] == ["4", "8"]


def test_approximate_cardinality_is_near_the_exact_one(lines):
    exact = {r.metric: r.value for r in profile.cardinality(lines).collect()}
    found = {r.metric: r.value for r in profile.cardinality(lines, approximate=True).collect()}
    assert found.keys() == exact.keys()
    assert all(abs(found[k] - n) <= max(1, 0.06 * n) for k, n in exact.items())
