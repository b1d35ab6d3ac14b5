"""Raw sources with physical lineage, accepted sink and its checks."""

from datetime import date

import pytest
from conftest import LOADED_AT, SOUND
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerspark.operators import contract
from ledgerspark.operators.numbering import numbered_by_hash_id, numbered_in_order
from ledgerspark.schema import RAW_COLUMNS, RAW_TEXT_SCHEMA
from ledgerspark.sources import accepted as sink
from ledgerspark.sources.raw import (
    fingerprint,
    lineage_violations,
    read_raw,
    sheet_row_counts,
    with_row_lineage,
)


def sheet(spark, first, n, parts=3):
    rows = spark.range(first, first + n, 1, parts)
    return rows.select(
        *[
            (F.col("id").cast("string") if c == "Invoice" else F.lit(SOUND[c])).alias(c)
            for c in RAW_COLUMNS
        ]
    )


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_row_numbers_follow_physical_order_and_restart_per_sheet(spark, folder, fmt):
    paths = {}
    for name, first, n in (("Year A", 0, 1000), ("Year B", 5000, 7)):
        paths[name] = f"{folder}/{name.replace(' ', '_')}"
        sheet(spark, first, n).write.option("header", True).format(fmt).save(paths[name])
    # Small splits put one file's rows into several tasks.
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        raw = read_raw(spark, paths, fmt)
        rows = raw.select("source_sheet", "source_row_number", "Invoice").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 1007
    for r in rows:
        assert int(r.Invoice) == r.source_row_number - 2 + (0 if r.source_sheet == "Year A" else 5000)
    assert {r.check_name: r.violations for r in lineage_violations(raw).collect()} == {
        "blank_sheet": 0,
        "invalid_row_number": 0,
        "row_id_mismatch": 0,
        "duplicate_identity": 0,
    }
    counts = {r.source_sheet: (r.row_count, r.reconciled) for r in sheet_row_counts(raw).collect()}
    assert counts == {"Year A": (1000, True), "Year B": (7, True), "ALL SHEETS": (1007, True)}


def test_lineage_violations_are_found(spark):
    rows = [("S", 2, "x"), (" ", 3, None), ("S", 1, None), ("S", 2, None)]
    df = spark.createDataFrame(rows, "source_sheet string, source_row_number long, source_row_id string")
    found = {r.check_name: r.violations for r in lineage_violations(df).collect()}
    assert found == {
        "blank_sheet": 1,
        "invalid_row_number": 1,
        "row_id_mismatch": 4,
        "duplicate_identity": 1,
    }


def test_headers_must_match_exactly(spark, folder):
    good = sheet(spark, 0, 3)
    good.withColumnRenamed("Price", " Price").write.parquet(f"{folder}/padded")
    with pytest.raises(ValueError, match="outer whitespace"):
        read_raw(spark, {"S": f"{folder}/padded"})
    good.withColumn("source_row_id", F.lit("x")).write.parquet(f"{folder}/reserved")
    with pytest.raises(ValueError, match="reserved"):
        with_row_lineage(spark.read.parquet(f"{folder}/reserved"), "S")
    good.withColumn("Price", F.lit(1.0)).write.parquet(f"{folder}/typed")
    good.write.parquet(f"{folder}/good")
    with pytest.raises(ValueError, match="disagree"):
        read_raw(spark, {"A": f"{folder}/typed", "B": f"{folder}/good"})


def test_fingerprint_ignores_order_but_not_copies(spark):
    df = sheet(spark, 0, 50).select(*RAW_COLUMNS)
    one = fingerprint(df).first()
    assert fingerprint(df.orderBy(F.desc("Invoice"))).first() == one
    pair = df.limit(1).union(df.limit(1))
    assert fingerprint(df.union(pair)).first().sum_hash != one.sum_hash


def test_numbering_is_dense_with_a_hot_key(spark, folder):
    """A third of all rows share one key and the numbers still follow the full order."""
    df = spark.range(0, 3000, 1, 5).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k"),
        (F.col("id") * 7919 % 3001).alias("v"),
        (F.col("id") % 2).cast("string").alias("g"),
    )
    got = numbered_in_order(df, folder, ["g", "k", "v"], ["g", "k", "v"], "n", ["g"]).collect()
    for g in ("0", "1"):
        rows = sorted((r.k, r.v, r.n) for r in got if r.g == g)
        assert [r[2] for r in rows] == list(range(1, len(rows) + 1))


def test_hash_numbering_is_dense_in_group_and_id_order(spark):
    df = spark.range(0, 2000, 1, 5).select(
        F.sha2(F.col("id").cast("string"), 256).alias("rid"),
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("g"),
    )
    got = numbered_by_hash_id(df, "rid", ["g"], "n", 100, 1).collect()
    ordered = sorted((r.g, r.rid, r.n) for r in got)
    assert [r[2] for r in ordered] == list(range(101, 2101))


@pytest.fixture
def accepted(raw_frame):
    raw = raw_frame(
        {"InvoiceDate": "2009-12-01 07:45:00"},
        {"Invoice": "489435", "InvoiceDate": "2010-01-02 08:00:00"},
        {"Invoice": "489436", "InvoiceDate": "2010-01-03 08:00:00"},
    )
    return contract.accepted_lines(contract.classify(raw, LOADED_AT))


def test_accepted_dataset_round_trip(spark, folder, accepted):
    path = f"{folder}/accepted"
    sink.write_accepted(accepted, path, folder)
    back = sink.read_accepted(spark, path)
    assert {(r.year, r.month) for r in back.collect()} == {("2009", "12"), ("2010", "01")}
    types = {f.name: f.dataType.simpleString() for f in back.schema}
    assert (types["unit_price"], types["line_amount"]) == ("decimal(19,4)", "decimal(30,4)")
    assert accepted.exceptAll(back.drop("year", "month")).isEmpty()
    check = sink.check_output(spark, path).first()
    assert (check.row_count, check.partition_count) == (3, 2)
    assert check.minimum_batch_month == date(2009, 12, 1)
    assert check.bad_partition_folders == check.misplaced_files == 0
    assert check.duplicate_or_missing_ids == check.oversized_files == 0


def test_accepted_sink_refuses_unsafe_writes(folder, accepted):
    with pytest.raises(ValueError, match="not under"):
        sink.write_accepted(accepted, f"{folder}/x", f"{folder}/other")
    with pytest.raises(ValueError, match="not under"):
        sink.write_accepted(accepted, folder, folder)
    with pytest.raises(ValueError, match="empty"):
        sink.write_accepted(accepted.limit(0), f"{folder}/x", folder)


def test_one_period_reads_one_folder(spark, folder, accepted):
    path = f"{folder}/accepted"
    sink.write_accepted(accepted, path, folder)
    one = sink.in_period(sink.read_accepted(spark, path), date(2010, 1, 1))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
    assert len(one.select(F.input_file_name()).distinct().collect()) >= 1
    found = sink.inspect_period(spark, path, date(2010, 1, 1))
    assert (found["row_count"], found["out_of_period_rows"]) == (2, 0)
    assert sink.source_periods(spark, path) == [date(2009, 12, 1), date(2010, 1, 1)]
    with pytest.raises(ValueError, match="No accepted lines"):
        sink.inspect_period(spark, path, date(2011, 1, 1))
    with pytest.raises(ValueError, match="not the approved"):
        sink.source_periods(spark, path, (date(2009, 12, 1), date(2011, 12, 1)))


def test_misplaced_and_missing_months_are_reported(spark, folder, accepted):
    wrong = accepted.withColumn("batch_month", F.lit("2010-03-01").cast("date"))
    sink.append_by_month(wrong, f"{folder}/wrong")
    with pytest.raises(ValueError, match="out_of_period_rows"):
        sink.inspect_period(spark, f"{folder}/wrong", date(2010, 3, 1))
    sink.append_by_month(accepted, f"{folder}/wrong")
    with pytest.raises(ValueError, match="Missing source partition"):
        sink.source_periods(spark, f"{folder}/wrong")
    lines = sink.read_accepted(spark, f"{folder}/wrong")
    calendar = {r.period: r for r in sink.period_calendar(sink.periods(lines)).collect()}
    assert [p for p, r in calendar.items() if r.is_missing] == [date(2010, 2, 1)]
    assert calendar[date(2010, 3, 1)].follows_previous is False


def test_rejected_csv(spark, folder, raw_frame):
    raw = raw_frame({"Price": "x"}, {})
    sink.write_rejected(contract.rejected_lines(contract.classify(raw, LOADED_AT)), folder, "csv")
    (row,) = spark.read.option("header", True).csv(folder).collect()
    assert row.reject_reason == "INVALID_PRICE" and row.raw_price == "x"


def test_utf16_widths(spark, accepted):
    wide = accepted.withColumn("description", F.lit("😀" * 300))
    rows = {r.column_name: r for r in sink.text_length_profile(wide).collect()}
    assert rows["description"].maximum_units == 600
    assert rows["description"].over_limit_rows == 3
    assert rows["invoice_no"].missing_required_rows == 0


def test_csv_types_are_never_inferred(spark, folder):
    sheet(spark, 0, 3, 1).write.option("header", True).csv(folder)
    assert read_raw(spark, {"S": folder}, "csv").select(*RAW_COLUMNS).schema == RAW_TEXT_SCHEMA


def _sheet(folder, text):
    """A text sheet of the given lines below the header."""
    spark = SparkSession.getActiveSession()
    header = ",".join(RAW_COLUMNS)
    spark.createDataFrame([(f"{header}\n{text}",)], "value string").coalesce(1).write.text(folder)
    return folder


def test_csv_records_are_whole(spark, folder):
    good = '1,A,"two\nlines, one cell",2,2010-01-02,1.5,7,Norway\n2,B,x,1,2010-01-03,1.5,7,Norway'
    rows = read_raw(spark, {"S": _sheet(f"{folder}/good", good)}, fmt="csv").collect()
    assert [(r.source_row_number, r.Invoice, r.Description) for r in sorted(rows, key=lambda r: r.Invoice)] == [
        (2, "1", "two\nlines, one cell"), (3, "2", "x"),
    ]
    for name, bad in (("long", "1,A,x,2,2010-01-02,1.5,7,Norway,ninth"), ("short", "1,A")):
        with pytest.raises(Exception, match="MALFORMED|malformed"):
            read_raw(spark, {"S": _sheet(f"{folder}/{name}", bad)}, fmt="csv").collect()


def odd_file(spark, folder, change):
    """An accepted dataset of many files, one of which, in its last month, is changed."""
    types = T.StructType([T.StructField("source_sheet", T.StringType()), T.StructField("source_row_number", T.LongType()), *RAW_TEXT_SCHEMA.fields])
    rows = [
        ("S", k, str(k), "X", "thing", "1", f"20{9 + k // 12:02d}-{k % 12 + 1:02d}-05 10:00:00", "2.5", "20417", "Norway")
        for k in range(2, 30)
    ]
    lines = contract.accepted_lines(contract.classify(spark.createDataFrame(rows, types), LOADED_AT))
    sink.write_accepted(lines, f"{folder}/accepted", folder)
    path = f"{folder}/accepted/year=2011/month=06"
    one = spark.read.schema(lines.schema).parquet(path)
    change(one).coalesce(1).write.mode("append").parquet(path.replace("year=2011/month=06", "year=2011/month=07"))
    return f"{folder}/accepted"


@pytest.mark.parametrize(
    "change",
    [
        lambda df: df.withColumn("added", F.lit(1)),
        lambda df: df.withColumn("quantity", F.col("quantity").cast("string")),
        lambda df: df.drop("stock_code"),
    ],
)
def test_one_odd_file_among_many_is_found(spark, folder, change):
    path = odd_file(spark, folder, change)
    with pytest.raises(ValueError):
        sink.check_output(spark, path)


def test_sheet_rows_are_reconciled_with_their_numbers(spark):
    rows = [("A", 2), ("A", 3), ("B", 2), ("B", 4), ("C", 3)]
    raw = spark.createDataFrame(rows, "source_sheet string, source_row_number long")
    found = {r.source_sheet: r.reconciled for r in sheet_row_counts(raw).collect()}
    assert found == {"A": True, "B": False, "C": False, "ALL SHEETS": True}


def test_shuffles_start_with_parts_by_size(spark):
    from ledgerspark.session import BYTES_PER_PART, deal_by_size

    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before = spark.conf.get(key, None)
    try:
        deal_by_size(spark, 3 * BYTES_PER_PART)
        assert spark.conf.get(key, None) == before  # small: the session's number is enough
        deal_by_size(spark, 500 * BYTES_PER_PART + 1)
        deal_by_size(spark, 10 * BYTES_PER_PART)
        assert spark.conf.get(key) == "501"
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def test_accepted_lines_are_written_from_the_tasks_they_lie_in(spark, accepted, folder, monkeypatch):
    def shuffled(*_):
        raise AssertionError("a shuffle by month")

    monkeypatch.setattr(sink, "by_month", shuffled)
    sink.write_accepted(accepted, f"{folder}/dealt", folder, dealt=True)
    wanted = sorted(map(tuple, accepted.select("source_row_id", "batch_month").collect()))
    stored = sink.read_accepted(spark, f"{folder}/dealt")
    assert sorted(map(tuple, stored.select("source_row_id", "batch_month").collect())) == wanted
    checked = sink.check_output(spark, f"{folder}/dealt").first()
    assert checked.misplaced_files == checked.bad_partition_folders == 0


def test_numbers_go_on_over_the_files_of_a_range(spark, folder):
    df = spark.range(0, 900, 1, 3).select((F.col("id") % 450).alias("k"), (F.col("id") % 2).cast("string").alias("g"))
    got = numbered_in_order(df, folder, ["g", "k"], ["g", "k"], "n", ["g"], 50)
    assert len(spark.read.parquet(f"{folder}/rows").inputFiles()) >= 18
    for g in ("0", "1"):
        rows = sorted((r.n, r.k) for r in got.collect() if r.g == g)
        assert [n for n, _ in rows] == list(range(1, 451))
        assert [k for _, k in rows] == sorted(k for _, k in rows)


def test_stripping_keeps_what_btrim_keeps(spark):
    from ledgerspark.functions.text import WHITESPACE, strip

    ends = ["", "a", "~", "!", "\x7f", "é", "漢", "​", *WHITESPACE]
    texts = [a + m + b for a in ends for m in ("", "x y", " ") for b in ends]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    wrong = rows.filter(~strip(F.col("t")).eqNullSafe(F.btrim("t", F.lit(WHITESPACE))))
    assert wrong.collect() == []
