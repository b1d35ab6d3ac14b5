"""Star schema, incremental runs and the checks that guard them."""

from datetime import date, datetime
from decimal import Decimal

import pytest
from conftest import LOADED_AT
from pyspark.sql import functions as F

from ledgerspark.operators import contract, kpi, occupancy, reconcile, warehouse
from ledgerspark.plans.warehouse import Warehouse, marked
from ledgerspark.schema import ACCEPTED_COLUMNS
from ledgerspark.sources import accepted as sink

LINES = [
    {"Invoice": "1", "StockCode": "A", "Description": "old", "InvoiceDate": "2009-12-03 10:00:00"},
    {"Invoice": "1", "StockCode": "B", "Description": None, "InvoiceDate": "2009-12-03 10:00:00"},
    {"Invoice": "2", "StockCode": "A", "Description": "new", "InvoiceDate": "2010-01-05 10:00:00"},
    {"Invoice": "C3", "StockCode": "A", "Description": "new", "Quantity": "-2",
     "InvoiceDate": "2010-01-06 10:00:00", "Customer ID": None},
    {"Invoice": "4", "StockCode": "a", "Description": "lower", "Country": " ",
     "InvoiceDate": "2010-01-06 11:00:00", "Customer ID": "77"},
    {"Invoice": "5", "StockCode": "A", "Description": "new", "InvoiceDate": "2010-02-07 10:00:00"},
    {"Invoice": "6", "StockCode": "Z", "Description": "zero", "Price": "0",
     "InvoiceDate": "2010-02-09 10:00:00", "Country": "Unspecified"},
]
DEC, JAN, FEB = date(2009, 12, 1), date(2010, 1, 1), date(2010, 2, 1)


@pytest.fixture(scope="module")
def source(spark, raw_frame, tmp_path_factory):
    """The accepted dataset of the lines above."""
    from uuid import uuid4

    from ledgerspark.session import shared_folder

    root = f"{shared_folder(spark)}/tests/source-{uuid4().hex}"
    lines = contract.accepted_lines(contract.classify(raw_frame(*LINES), LOADED_AT))
    sink.write_accepted(lines, f"{root}/accepted", root)
    return sink.read_accepted(spark, f"{root}/accepted")


@pytest.fixture(scope="module")
def built(spark, source):
    from uuid import uuid4

    from ledgerspark.session import shared_folder

    store = Warehouse(spark, f"{shared_folder(spark)}/tests/built-{uuid4().hex}")
    store.load_staging(source.select(*ACCEPTED_COLUMNS))
    store.bootstrap()
    return store


def natural(store):
    rows = warehouse.with_natural_keys(store.fact(), store.dims()).select(
        "source_row_id", "full_date", "customer_id", "stock_code", "description", "country"
    )
    return sorted(map(tuple, rows.collect()), key=repr)


def test_dimensions(built):
    dims = {n: d.collect() for n, d in built.dims().items()}
    assert len(dims["dim_date"]) == (date(2010, 2, 9) - date(2009, 12, 3)).days + 1
    day = next(r for r in dims["dim_date"] if r.full_date == date(2010, 1, 2))
    assert (day.date_key, day.month_name, day.weekday_name) == (20100102, "January", "Saturday")
    assert day.is_weekend and day.quarter == 1
    assert {r.customer_id: r.customer_key for r in dims["dim_customer"]} == {
        None: 0, "20417": 1, "77": 2,
    }
    assert {r.country for r in dims["dim_country"]} == {None, "Norway", "Unspecified"}
    products = {r.stock_code: r.description for r in dims["dim_product"]}
    # 'new' and 'old' tie on... frequency decides: two core 'new' lines against one 'old'.
    assert products == {"A": "new", "B": "UNKNOWN DESCRIPTION", "Z": "zero", "a": "lower"}


def test_canonical_description_order(spark):
    schema = (
        "stock_code string, description string, invoice_datetime timestamp_ntz,"
        " classification string, NONSTANDARD_INVOICE boolean, is_cancelled boolean,"
        " quantity int, unit_price decimal(19,4)"
    )

    def line(code, text, day, core=True, second=0):
        when = datetime(2010, 1, day, 0, 0, second)
        return (code, text, when, "ACCEPT", False, not core, 1, Decimal(1))

    rows = [
        line("tier", "many", 1, core=False),
        line("tier", "many", 2, core=False),
        line("tier", "core", 1),
        line("count", "twice", 1),
        line("count", "twice", 1),
        line("count", "late", 9),
        line("late", "early", 1),
        line("late", "later", 1, second=1),
        line("text", "b", 1),
        line("text", "B", 1),
        line("none", None, 1),
    ]
    df = spark.createDataFrame(rows, schema)
    best = {r.stock_code: r for r in warehouse.canonical_descriptions(df).collect()}
    assert {k: r.description for k, r in best.items()} == {
        "tier": "core",
        "count": "twice",
        "late": "later",
        "text": "B",
        "none": "UNKNOWN DESCRIPTION",
    }
    assert (best["tier"].source_tier, best["tier"].occurrence_count) == (0, 1)
    assert best["none"].source_tier is None


def test_facts_resolve_every_line(built, source):
    facts = built.fact()
    assert facts.count() == source.count() == len(LINES)
    assert sorted(r.sales_key for r in facts.collect()) == list(range(1, len(LINES) + 1))
    assert facts.filter("customer_key = 0").count() == 1
    assert facts.filter("country_key = 0").count() == 1
    dims = built.dims()
    assert all(
        r.unresolved_rows == 0 for r in warehouse.unresolved_keys(source, dims).collect()
    )
    dims["dim_product"] = dims["dim_product"].filter("stock_code != 'Z'")
    found = {
        r.dimension_name: r.unresolved_rows
        for r in warehouse.unresolved_keys(source, dims).collect()
    }
    assert found["dim_product"] == 1
    with pytest.raises(Exception, match="no product_key"):
        warehouse.fact_rows(source, dims, 0).collect()


def test_rerun_changes_nothing(built):
    before = natural(built)
    again = built.load_staging(built.staging().select(*ACCEPTED_COLUMNS))
    assert again["inserted"] == 0 and again["skipped_existing"] == len(LINES)
    counts = built.bootstrap()
    assert all(v == 0 for k, v in counts.items() if k.endswith(("inserted", "updated")))
    assert counts["fact_skipped_existing"] == len(LINES)
    assert natural(built) == before


def test_monthly_replay_equals_one_build(spark, folder, source, built):
    store = Warehouse(spark, folder)
    with pytest.raises(ValueError, match="gap"):
        store.run(source, JAN, DEC, FEB)
    with pytest.raises(ValueError, match="force_refused"):
        store.run(source, DEC, DEC, FEB, force=True)
    with pytest.raises(ValueError, match="out_of_range"):
        store.run(source, date(2010, 3, 1), DEC, FEB)
    first = store.run(source, DEC, DEC, FEB)
    assert (first["decision"], first["mark"], first["fact_inserted"]) == ("next_period", DEC, 2)
    assert first["date_inserted"] == 31
    old_key = store.dim("dim_product").filter("stock_code = 'A'").first()
    assert old_key.description == "old"
    second = store.run(source, JAN, DEC, FEB)
    # On a tie of one core line each, the later text wins; the key stays.
    assert (second["product_inserted"], second["product_updated"]) == (1, 1)
    new_key = store.dim("dim_product").filter("stock_code = 'A'").first()
    assert (new_key.product_key, new_key.description) == (old_key.product_key, "new")
    third = store.run(source, FEB, DEC, FEB)
    assert third["mark"] == FEB
    assert store.dim("dim_date").agg(F.max("full_date")).first()[0] == date(2010, 2, 9)
    assert natural(store) == natural(built)
    assert store.run(source, JAN, DEC, FEB) == {"decision": "already_processed", "mark": FEB}
    forced = store.run(source, JAN, DEC, FEB, force=True)
    assert (forced["inserted"], forced["fact_inserted"], forced["mark"]) == (0, 0, FEB)
    assert store.run_log().count() == 3


def test_catching_up_several_months_at_once(spark, folder, source, built):
    store = Warehouse(spark, folder)
    done = store.run(source, DEC, DEC, FEB, high=FEB)
    assert done["mark"] == FEB and store.run_log().count() == 3
    assert natural(store) == natural(built)


def test_a_failed_gate_leaves_the_mark(spark, folder, source, monkeypatch):
    store = Warehouse(spark, folder)
    store.run(source, DEC, DEC, FEB)

    def refuse(*_):
        raise ValueError("quality gate")

    with monkeypatch.context() as patched:
        patched.setattr(reconcile, "assert_period", refuse)
        with pytest.raises(ValueError, match="quality gate"):
            store.run(source, JAN, DEC, FEB)
    assert store.mark() == DEC
    # Readers still see December alone, and finishing the month loads it whole.
    assert {r.month for r in store.staging().select("month").distinct().collect()} == {"12"}
    assert store.fact().count() == 2 and store.run_log().count() == 1
    assert len(store.vacuum()) > 0 and store.fact().count() == 2
    done = store.run(source, JAN, DEC, FEB)
    assert (done["inserted"], done["fact_inserted"], done["mark"]) == (3, 3, JAN)


def test_a_failing_audit_leaves_readers_the_former_snapshot(spark, folder, source, monkeypatch):
    store, reader = Warehouse(spark, folder), Warehouse(spark, folder)
    store.run(source, DEC, DEC, FEB)
    before = reader.snapshot()
    with monkeypatch.context() as patched:
        # a fact table that lost a line does not reconcile
        lost = lambda lines, *a, **k: warehouse.fact_rows(lines.filter("invoice_no <> '4'"), *a, **k)
        patched.setattr("ledgerspark.plans.warehouse.fact_rows", lost)
        with pytest.raises(ValueError, match="fact"):
            store.run(source, JAN, DEC, FEB)
    assert reader.snapshot() == before and reader.mark() == DEC
    store.run(source, JAN, DEC, FEB)
    assert reader.mark() == JAN and reader.fact().count() == 5


def test_of_two_writers_one_is_refused(spark, folder, source):
    store = Warehouse(spark, folder)
    base = store.snapshot()
    store.run(source, DEC, DEC, FEB)
    with pytest.raises(RuntimeError, match="published meanwhile"):
        store.snapshots.publish(base)


def test_a_manifest_cut_short_does_not_count(spark, folder, source):
    from ledgerspark.sources import storage

    store = Warehouse(spark, folder)
    store.run(source, DEC, DEC, FEB)
    seen = store.snapshot()
    storage.create_text(spark, f"{folder}/snapshots/v00000009.json", '{"version": 9, "sta')
    assert store.snapshot() == seen
    assert store.run(source, JAN, DEC, FEB)["mark"] == JAN
    assert store.snapshot().version == 10


def scans(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "FileScan" in line]


def test_a_load_reads_no_staged_line(spark, folder, source):
    """Row numbers taken decide; parts and words that cannot matter are not read."""
    store = Warehouse(spark, folder)
    wanted = source.select(*ACCEPTED_COLUMNS)
    for period in (DEC, JAN):
        store.load_staging(wanted.filter(F.col("batch_month") == F.lit(period)))
    bounds = {r.source_sheet: (r.low, r.high) for r in wanted.groupBy("source_sheet").agg(
        F.min("source_row_number").alias("low"), F.max("source_row_number").alias("high")).collect()}
    new = store.unstaged(store.snapshot(), wanted, bounds)
    assert new.count() == wanted.filter(F.col("batch_month") == F.lit(FEB)).count() == 2
    read = new.inputFiles()
    assert any("/occupied/" in f for f in read) and not any("/staging/" in f for f in read)
    index = [line for line in scans(new) if "word#" in line]
    assert index and all("GreaterThanOrEqual(word," in line for line in index)
    far = {sheet: (low + 10**6, high + 10**6) for sheet, (low, high) in bounds.items()}
    assert not any("/occupied/" in f for f in store.unstaged(store.snapshot(), wanted, far).inputFiles())


def test_ids_that_are_no_row_digest_are_compared_themselves(spark, folder, source):
    store = Warehouse(spark, folder)
    own = source.select(*ACCEPTED_COLUMNS).filter(F.col("batch_month") == F.lit(JAN))
    # the same row numbers under other ids, one id being that of a line staged before
    foreign = own.withColumn("source_row_id", F.sha2(F.concat(F.lit("other"), "source_row_id"), 256))
    assert store.load_staging(foreign)["inserted"] == 3
    assert store.load_staging(own)["inserted"] == 3
    assert store.load_staging(foreign.unionByName(own))["inserted"] == 0
    moved = own.limit(1).withColumn("source_row_number", F.col("source_row_number") + 1000)
    assert store.load_staging(moved)["skipped_existing"] == 1


def test_occupancy_against_sets(spark):
    rows = [("a", n) for n in (2, 3, 63, 64, 65, 127, 128, 10**12)] + [("b", n) for n in range(2, 200, 7)]
    df = spark.createDataFrame(rows, "source_sheet string, source_row_number long")
    index = occupancy.occupied(df)
    asked = spark.createDataFrame([(s, n) for s in "abc" for n in (*range(2, 210), 10**12, 10**12 + 1)], df.schema)
    found = {tuple(r) for r in occupancy.unoccupied(asked, index).collect()}
    assert found == {tuple(r) for r in asked.collect()} - set(rows)


def test_a_month_costs_no_reading_of_history(spark, folder, source):
    """Products of a month are named from maintained counts, and keys follow the snapshot's number."""
    store = Warehouse(spark, folder)
    for period in (DEC, JAN):
        store.run(source, period, DEC, FEB)
    counts = spark.read.parquet(store.snapshot().descriptions)
    assert not any("/staging/" in f for f in warehouse.canonical_of_counts(counts).inputFiles())
    assert {tuple(r) for r in counts.collect()} == {tuple(r) for r in warehouse.description_counts(store.staging()).collect()}
    assert store.snapshot().fact_rows == store.fact().agg(F.max("sales_key")).first()[0] == 5
    months = [set(p.months) for p in store.snapshot().staging]
    assert months == [{"2009-12"}, {"2010-01"}]


@pytest.mark.parametrize("digits", [1, 4])
def test_facts_are_dense_however_deep_the_split(built, digits):
    rows = warehouse.fact_rows(built.staging(), built.dims(), 7, digits).select("batch_month", "source_row_id", "sales_key").collect()
    rows.sort(key=lambda r: r.sales_key)
    assert [r.sales_key for r in rows] == list(range(8, 8 + len(LINES)))
    assert rows == sorted(rows, key=lambda r: (r.batch_month, r.source_row_id))


def test_prefix_digits_follow_the_rows():
    from ledgerspark.operators.numbering import prefix_digits

    assert [prefix_digits(n) for n in (0, 10**8, 10**9, 10**10, 10**12)] == [2, 2, 3, 4, 5]


def test_broken_lines_and_repeated_ids_are_refused(spark, folder, source):
    store = Warehouse(spark, folder)
    lines = source.select(*ACCEPTED_COLUMNS)
    broken = {
        "classification": F.lit("REJECT"),
        "source_row_id": F.upper("source_row_id"),
        "unit_price": F.lit(-1).cast("decimal(19,4)"),
        "source_row_number": F.lit(1).cast("bigint"),
        "invoice_no": F.lit("X" * 33),
        "batch_month": F.lit("2009-12-02").cast("date"),
        "invoice_datetime": F.lit("2009-12-01 00:00:00.000001").cast("timestamp_ntz"),
        "quantity": F.lit(None).cast("int"),
        "loaded_at": F.lit(None).cast("timestamp"),
        "ZERO_PRICE": F.lit(None).cast("boolean"),
    }
    cases = [lines.withColumn(c, v).limit(1) for c, v in broken.items()]
    reasons = [{r.violation for r in reconcile.load_contract_violations(c).collect()} for c in cases]
    assert all(len(r) == 1 for r in reasons), reasons
    with pytest.raises(ValueError, match="1 lines break"):
        store.load_staging(cases[0])
    with pytest.raises(ValueError, match="1 ids repeat"):
        store.load_staging(lines.limit(1).union(lines.limit(1)))
    with pytest.raises(ValueError, match="expected columns"):
        store.load_staging(lines.withColumn("quantity", F.lit(1).cast("bigint")))
    assert store.staging() is None


def test_checks_fire_on_damage(spark, built):
    staging, fact, dims = built.staging(), built.fact(), built.dims()
    ids = sorted(r.source_row_id for r in fact.collect())
    value = fact.withColumn(
        "line_amount",
        F.when(F.col("source_row_id") == ids[0], F.lit(9)).otherwise(F.col("line_amount")).cast("decimal(30,4)"),
    )
    key = fact.withColumn(
        "product_key", F.when(F.col("source_row_id") == ids[1], 999).otherwise(F.col("product_key"))
    )
    lost = fact.filter(F.col("source_row_id") != ids[2])
    twice = fact.union(fact.filter(F.col("source_row_id") == ids[3]))

    clean = reconcile.compared_lines(staging, fact, dims).first()
    assert clean[1:] == (0, 0)
    assert reconcile.compared_lines(staging, value, dims).first().copied_value_mismatches == 1
    assert reconcile.compared_lines(staging, key, dims).first().dimension_mapping_mismatches == 1
    assert reconcile.fk_orphans(key, dims).first().orphan_product_keys == 1
    diff = reconcile.identity_diff(staging, lost, "s", "f").first()
    assert (diff.left_rows_missing_right, diff.right_rows_missing_left) == (1, 0)
    amounts = reconcile.line_amount_reconciliation(staging, value).first()
    assert amounts.difference != 0
    shared = ["source_row_id", "line_amount"]
    sides = {r.side: r.row_count for r in reconcile.row_diff_counts(staging, value, shared).collect()}
    assert sides == {"left_only": 1, "right_only": 1}
    repeated = reconcile.duplicate_keys({"fact_sales": (twice, ["source_row_id"])}).first()
    assert (repeated.duplicated_keys, repeated.surplus_rows) == (1, 1)
    renamed = dims["dim_product"].withColumn("description", F.lit("x"))
    found = reconcile.canonical_product_mismatch(staging, renamed).first()
    assert found.description_mismatches == found.compared_codes == 4
    samples = {r.sample_type: r.sample_matches for r in reconcile.sample_rows(staging, fact, dims).collect()}
    assert all(samples.values()) and {"normal_clean", "cancellation"} <= set(samples)

    for name, damaged in {"value": value, "key": key, "lost": lost, "twice": twice}.items():
        rows = reconcile.period_reconciliation(staging, damaged, dims)
        failed = rows.filter(~reconcile.period_passed()).collect()
        assert len(failed) == 1, name
        with pytest.raises(ValueError):
            reconcile.assert_period(failed[0].asDict(), failed[0].staging_rows)
    good = reconcile.period_reconciliation(staging, fact, dims).collect()
    assert len(good) == 3
    for row in good:
        reconcile.assert_period(row.asDict(), row.staging_rows)
        with pytest.raises(ValueError, match="input has"):
            reconcile.assert_period(row.asDict(), row.staging_rows + 1)


@pytest.mark.parametrize(
    ("log", "mark"),
    [
        ([], None),
        ([(DEC, True), (JAN, True)], JAN),
        ([(DEC, True), (JAN, False), (FEB, True)], DEC),
        ([(DEC, True), (FEB, True)], DEC),
        ([(DEC, False), (DEC, True), (JAN, True), (JAN, True)], JAN),
        ([(DEC, False)], None),
    ],
)
def test_progress_mark(spark, log, mark):
    df = spark.createDataFrame([(p, 1, ok) for p, ok in log], "period date, input_rows long, passed boolean")
    row = reconcile.progress(df).select("mark").first()
    assert (row.mark if row else None) == mark
    passed, logged = {p.isoformat() for p, ok in log if ok}, {p.isoformat() for p, _ in log}
    assert marked(passed, logged) == (mark.isoformat() if mark else None)


def test_constraint_rules_count_violations(spark):
    df = spark.createDataFrame([(0, None), (0, "x"), (2, None), (3, "y")], "customer_key int, customer_id string")
    rules = reconcile.standard_rules()["dim_customer"]
    assert reconcile.constraint_violations({"d": (df, rules)}).first().violations == 2


def test_kpis_by_brute_force(source):
    rows = source.collect()

    def sale(r):
        return not r.NONSTANDARD_INVOICE and not r.is_cancelled and r.quantity > 0 and r.unit_price > 0

    def cancel(r):
        return r.is_cancelled and r.invoice_no[1:].isdigit() and r.quantity < 0 and r.unit_price > 0

    total = kpi.kpis(source).first()
    assert total.net_sales == sum(r.line_amount for r in rows if sale(r) or cancel(r))
    sold = {r.invoice_no for r in rows if sale(r)}
    assert total.orders == len(sold) == 4
    assert total.known_customers == 2 and total.repeat_customers == 1
    assert total.repeat_rate == 0.5
    assert total.cancellation_rate == 1 / 5
    assert (total.units_sold, total.cancelled_units) == (20, 2)
    assert total.average_order_value == float(sum(r.line_amount for r in rows if sale(r))) / 4
    levels = {
        (r.level, r.batch_month_context): r
        for r in kpi.kpi_levels(source, [["batch_month"], []]).collect()
    }
    # A customer who orders once in each of two months repeats only in the total.
    assert levels[1, "(all)"].repeat_customers == 1
    assert sum(r.repeat_customers for k, r in levels.items() if k[0] == 0) == 0
    empty = kpi.kpis(source.filter("is_cancelled")).first()
    assert empty.orders == 0 and empty.average_order_value is None and empty.repeat_rate is None
    assert {r.customer_id for r in kpi.top_customers(source).collect()} == {"20417", "77"}


def test_a_bad_month_is_not_stored_and_loads_once_mended(spark, folder, source):
    store = Warehouse(spark, folder)
    store.run(source, DEC, DEC, FEB)
    early = F.when(F.col("batch_month") == F.lit(JAN), F.col("invoice_datetime") - F.expr("interval 40 days"))
    bad = source.withColumn("invoice_datetime", F.coalesce(early, F.col("invoice_datetime")))
    before = store.staging().count(), store.fact().count()
    with pytest.raises(ValueError, match="out_of_period_rows"):
        store.run(bad, JAN, DEC, FEB)
    assert (store.staging().count(), store.fact().count()) == before and store.mark() == DEC
    assert store.run(source, JAN, DEC, FEB)["mark"] == JAN


def test_the_log_counts_each_months_own_facts(spark, folder, source):
    store = Warehouse(spark, folder)
    dec = source.filter(F.col("batch_month") == F.lit(DEC)).select(*ACCEPTED_COLUMNS)
    store.load_staging(dec)
    store.bootstrap()
    store.run(source, DEC, DEC, FEB, high=FEB)
    logged = {r.period: (r.input_rows, r.inserted_rows) for r in store.run_log().collect()}
    per = {r.batch_month: r["count"] for r in source.groupBy("batch_month").count().collect()}
    assert logged == {DEC: (per[DEC], 0), JAN: (per[JAN], per[JAN]), FEB: (per[FEB], per[FEB])}


def test_facts_are_numbered_without_one_window_over_all_prefixes(built):
    plan = warehouse.fact_rows(built.staging(), built.dims(), 0)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 3  # rows in a bucket, buckets in a month, months
    assert sum("_bucket" in w for w in windows) == 2
    assert all("[year" in w.replace("[_", "") for w in windows if "_bucket" in w)


def test_facts_are_shuffled_once_without_their_ids(built):
    facts = warehouse.fact_rows(built.staging(), built.dims(), 0, 0)
    plan = facts._jdf.queryExecution().optimizedPlan().toString().splitlines()
    dealt = [line for line in plan if "RepartitionByExpression" in line]
    assert len(dealt) == 1 and dealt[0].count("_bucket") == 1


def test_facts_keep_ids_that_are_no_digests(built):
    lines = built.staging()
    odd = F.when(F.col("source_row_number") % 2 == 0, F.sha2(F.reverse("source_row_id"), 256))
    lines = lines.withColumn("source_row_id", F.coalesce(odd, F.col("source_row_id")))
    facts = warehouse.fact_rows(lines, built.dims(), 0, 1)
    months = {r.source_row_id: r.batch_month for r in lines.collect()}
    got = sorted(facts.collect(), key=lambda r: r.sales_key)
    assert [r.source_row_id for r in got] == sorted(months, key=lambda i: (months[i], i))
    assert [r.sales_key for r in got] == list(range(1, len(months) + 1))


@pytest.mark.parametrize("large", [("dim_customer",), ("dim_customer", "dim_product"), tuple(warehouse.DIMENSIONS)])
def test_lines_are_shuffled_once_however_large_the_dimensions(spark, built, large):
    lines, dims = built.staging(), built.dims()
    odd = F.when(F.col("source_row_number") % 2 == 0, F.sha2(F.reverse("source_row_id"), 256))
    lines = lines.withColumn("source_row_id", F.coalesce(odd, F.col("source_row_id")))
    facts = warehouse.fact_rows(lines, dims, 0, 1, large=large)
    assert sorted(map(str, facts.collect())) == sorted(map(str, warehouse.fact_rows(lines, dims, 0, 1).collect()))
    plan = facts._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert len([line for line in plan if "RepartitionByExpression" in line]) == 1
    with pytest.raises(Exception, match="customer_key"):
        none = {**dims, "dim_customer": dims["dim_customer"].filter("customer_key = 0")}
        warehouse.fact_rows(lines, none, 0, 1, large=large).collect()
    with pytest.raises(Exception, match="repeats"):
        warehouse.fact_rows(lines.unionByName(lines), dims, 0, 1, large=large).collect()


def test_lines_and_facts_are_stored_without_derived_ids(spark, folder, source):
    store = Warehouse(spark, folder)
    odd = F.when(F.col("source_row_number") == 2, F.sha2(F.reverse("source_row_id"), 256))
    lines = source.withColumn("source_row_id", F.coalesce(odd, F.col("source_row_id")))
    store.load_staging(lines.drop("year", "month"))
    store.bootstrap()
    ids = sorted(r.source_row_id for r in lines.collect())
    foreign = lines.filter("source_row_number = 2").count()
    for table, found in (("staging", store.staging()), ("fact_sales", store.fact())):
        kept = spark.read.parquet(f"{folder}/{table}").filter("source_row_id is not null")
        assert kept.count() == foreign > 0
        assert sorted(r.source_row_id for r in found.collect()) == ids


def test_rows_of_a_value_that_agrees_are_not_shuffled_with_the_others(built):
    lines = built.staging()
    rejected = lines.withColumn("classification", F.lit("REJECT"))
    columns = ["classification", "source_row_id", "line_amount"]
    left, right = reconcile.differing_rows(lines.unionByName(rejected), lines, columns, by="classification")
    assert {r.classification for r in left.collect()} == {"REJECT"} and right.count() == 0
    found = reconcile.row_diff_counts(lines.unionByName(rejected), lines, columns, "classification")
    assert {r.side: r.row_count for r in found.collect()} == {"left_only": lines.count(), "right_only": 0}


def test_agreeing_layers_are_compared_by_sums(built, monkeypatch):
    staging, fact, dims = built.staging(), built.fact(), built.dims()
    one = reconcile.compared_lines(staging, fact, dims).collect()
    damaged = fact.withColumn("quantity", F.col("quantity") + 1)
    other = reconcile.compared_lines(staging, damaged, dims).collect()
    assert reconcile.compared_in_all(staging, damaged, dims).collect() == other != one
    monkeypatch.setattr(reconcile, "compared_lines", None)
    assert reconcile.compared_in_all(staging, fact, dims).collect() == one


def test_a_month_of_unknown_customers_keeps_its_row(source):
    unknown = source.withColumn("customer_id", F.when(F.col("batch_month") != F.lit(JAN), F.col("customer_id")))
    rows = {r.batch_month: r for r in kpi.repeat_customers(unknown, ["batch_month"]).collect()}
    assert (rows[JAN].known_customers, rows[JAN].repeat_customers, rows[JAN].repeat_rate) == (0, 0, None)
    idle = source.withColumn("unit_price", F.lit(0).cast("decimal(19,4)")).withColumn("is_cancelled", F.lit(False))
    rates = kpi.cancellation_rate(idle, ["batch_month"]).collect()
    assert len(rates) == 3
    assert {(r.cancelled_invoices, r.active_invoices, r.cancellation_rate) for r in rates} == {(0, 0, None)}


def diff_by_counting(left, right):
    from collections import Counter

    a, b = Counter(map(tuple, left.collect())), Counter(map(tuple, right.collect()))
    return Counter({("left_only", *k): n for k, n in (a - b).items()}) + Counter({("right_only", *k): n for k, n in (b - a).items()})


@pytest.mark.parametrize("seed", range(3))
def test_row_diff_against_counting(spark, seed):
    import random

    rnd = random.Random(seed)
    rows = [(rnd.choice(["x", "y", None]), rnd.choice(["x", None, "z"]), rnd.randrange(40)) for _ in range(400)]
    left = spark.createDataFrame(rows, "a string, b string, n int")
    changed = [r for r in rows if rnd.random() > 0.02] + [r for r in rows if rnd.random() < 0.02]
    changed += [(b, a, n) for a, b, n in rows[:3]]
    right = spark.createDataFrame(changed, left.schema)
    found = {(r.side, r.a, r.b, r.n): r.copies for r in reconcile.row_diff(left, right, left.columns).collect()}
    assert found == diff_by_counting(left, right) and found
    assert reconcile.row_diff(left, left.orderBy(F.desc("n")), left.columns).collect() == []


def test_null_places_differ(spark):
    left = spark.createDataFrame([("x", None)], "a string, b string")
    right = spark.createDataFrame([(None, "x")], "a string, b string")
    assert {r.side for r in reconcile.row_diff(left, right, ["a", "b"]).collect()} == {"left_only", "right_only"}


def test_equal_layers_shuffle_no_row(built):
    """Only nodes' sums cross the shuffle; rows are fetched for the nodes that differ."""
    staging, shared = built.staging(), ["source_row_id", "line_amount"]
    diff = reconcile.row_diff(staging, built.fact(), shared)
    assert "Scan parquet" not in diff._jdf.queryExecution().executedPlan().toString()
    near = built.fact().withColumn("line_amount", F.when(F.col("invoice_no") == "5", 0).otherwise(F.col("line_amount")).cast("decimal(30,4)"))
    nodes = reconcile.differing_nodes(staging, near, shared, 16)
    assert 1 <= len(nodes) <= 2
    left, right = reconcile.differing_rows(staging, near, shared)
    assert left.count() == right.count() == 1


def test_sketches_stay_within_their_error(spark, source):
    """Merged over any context they estimate what is counted exactly; the exact path is as it was."""
    row = source.filter("invoice_no = '5'").drop("invoice_no", "customer_id", "country", "batch_month")
    many = spark.range(60_000).select(
        (F.col("id") % 20_000).cast("string").alias("invoice_no"),
        F.when(F.col("id") % 7 > 0, (F.col("id") % 9_001).cast("string")).alias("customer_id"),
        F.element_at(F.array(F.lit("Norway"), F.lit("Chile"), F.lit(None)), (F.col("id") % 3 + 1).cast("int")).alias("country"),
        F.add_months(F.lit(DEC), (F.col("id") % 5).cast("int")).alias("batch_month"),
    )
    rest = row.first().asDict()
    lines = many.select("*", *[F.lit(v).cast(row.schema[c].dataType).alias(c) for c, v in rest.items()])
    sketches = kpi.distinct_sketches(lines, ["batch_month", "country"])
    for by in ([], ["country"], ["batch_month"], ["batch_month", "country"]):
        exact = {tuple(r[c] for c in by): r for r in kpi.kpis(lines, by).collect()}
        for r in kpi.approximate_distinct(sketches, by).collect():
            for name in ("orders", "known_customers", "cancelled_invoices"):
                want = exact[tuple(r[c] for c in by)][name]
                assert abs(r[name] - want) <= 3 * 1.04 / 2 ** (kpi.SKETCH_BITS / 2) * want
    assert "hll" not in kpi.kpis(lines, ["country"])._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def shuffling(monkeypatch):
    """No month is few enough for one task."""
    from ledgerspark.functions import frames

    monkeypatch.setattr(frames, "FEW_ROWS", 0)


def test_a_replay_gates_every_month_and_equals_one_build(spark, folder, source, built):
    store = Warehouse(spark, folder)
    store.replay(source, DEC, DEC, FEB)
    assert natural(store) == natural(built)
    log = store.run_log().orderBy("period").collect()
    assert [(r.period, r.input_rows, r.inserted_rows) for r in log] == [(DEC, 2, 2), (JAN, 3, 3), (FEB, 2, 2)]
    assert store.mark() == FEB and len(store.snapshots._versions()) == 3
    assert sorted(r.sales_key for r in store.fact().collect()) == list(range(1, 8))
    with pytest.raises(ValueError, match="already_processed"):
        store.replay(source, JAN, DEC, FEB)


def test_a_month_that_fails_ends_the_replay_before_it(spark, folder, source, built, monkeypatch):
    store, judge = Warehouse(spark, folder), reconcile.assert_period

    def refuse(measures, n):
        if measures["period"] == JAN:
            raise ValueError("quality gate")
        judge(measures, n)

    with monkeypatch.context() as patched:
        patched.setattr(reconcile, "assert_period", refuse)
        with pytest.raises(ValueError, match="quality gate"):
            store.replay(source, DEC, DEC, FEB)
    assert store.mark() == DEC and store.fact().count() == 2
    assert {r.month for r in store.staging().select("month").distinct().collect()} == {"12"}
    store.replay(source, JAN, DEC, FEB)
    assert store.mark() == FEB and natural(store) == natural(built)


def test_months_of_a_replay_share_what_only_reads(spark, folder, source, built, monkeypatch):
    from ledgerspark.plans import warehouse as plan

    store, calls = Warehouse(spark, folder), []

    def counted(name, f):
        return lambda *a, **k: calls.append(name) or f(*a, **k)

    monkeypatch.setattr(plan, "inspect_periods", counted("inspected", plan.inspect_periods))
    monkeypatch.setattr(reconcile, "period_reconciliation", counted("audited", reconcile.period_reconciliation))
    monkeypatch.setattr(reconcile, "assert_period", counted("judged", reconcile.assert_period))
    store.replay(source, DEC, DEC, FEB)
    assert sorted(calls) == ["audited", "inspected", "judged", "judged", "judged"]
    assert len(store.snapshots._versions()) == 3 and natural(store) == natural(built)


def test_months_of_more_rows_than_one_tasks_are_shuffled_to_the_same_facts(spark, folder, source, built, shuffling):
    store = Warehouse(spark, folder)
    store.replay(source, DEC, DEC, FEB)
    assert natural(store) == natural(built)
    one = {(r.source_row_id, r.sales_key) for r in built.fact().collect()}
    assert {(r.source_row_id, r.sales_key) for r in store.fact().collect()} == one


def test_a_small_month_is_few_jobs(spark, folder, source):
    store, context = Warehouse(spark, folder), spark.sparkContext
    store.run(source, DEC, DEC, FEB)
    context.setJobGroup("a small month", "jobs of one run")
    try:
        store.run(source, JAN, DEC, FEB)
        jobs = context.statusTracker().getJobIdsForGroup("a small month")
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert 10 < len(jobs) <= 70  # 112 when every step shuffled
