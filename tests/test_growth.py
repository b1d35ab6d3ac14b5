"""What a query shuffles and computes for each line; results stay those of the plain ways."""

from datetime import datetime

from pyspark.sql import functions as F

from ledgerspark.functions import numbers
from ledgerspark.operators import contract, kpi, occupancy
from ledgerspark.plans import bridge
from ledgerspark.sources import accepted as sink

LOADED_AT = datetime(2025, 2, 3, 14, 30)


def tables(spark, folder, order_keys):
    rows = {
        "orders": (order_keys, "o_orderkey long"),
        "customer": ([1, 2], "c_custkey long"),
        "nation": ([1], "n_nationkey long"),
        "part": ([1, 2], "p_partkey long"),
    }
    for name, (keys, schema) in rows.items():
        spark.createDataFrame([(k,) for k in keys], schema).write.parquet(f"{folder}/{name}.parquet")
    return folder


def test_numbers_are_one_projection(spark):
    texts = spark.createDataFrame([("12E-1",), ("0.5",), ("x",), (None,)], "t string")
    parsed = numbers.parse_numbers(texts, {"price": ("t", "price"), "id": ("t", "integer_text")})
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Project [") == 1
    assert [str(r.price) for r in parsed.collect()] == ["1.2000", "0.5000", "None", "None"]


def test_lines_are_ordered_by_what_tells_them_apart(spark, folder):
    assert bridge.line_order(spark, tables(spark, f"{folder}/a", [1, 2, None, None])) == bridge.LINE_FIELDS
    repeated = bridge.line_order(spark, tables(spark, f"{folder}/b", [1, 2, 2]))
    assert repeated == [*bridge.LINE_ORDER, *bridge.TIE_BREAK]


def shuffled_ids(df) -> int:
    """How many exchanges of a plan have row ids in their keys."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("hashpartitioning(" in line and "source_row_id" in line for line in plan.splitlines())


def accepted(spark, raw_frame, n=6):
    rows = raw_frame(*[{"Invoice": str(700001 + k)} for k in range(n)])
    return contract.accepted_lines(contract.classify(rows, LOADED_AT))


def test_distinct_row_numbers_spare_the_ids(spark, raw_frame):
    lines = accepted(spark, raw_frame)
    assert occupancy.all_distinct(lines)
    assert not occupancy.all_distinct(lines.unionByName(lines.limit(1)))
    other = lines.withColumn("source_row_id", F.when(F.col("source_row_number") > 2, F.col("source_row_id")))
    assert not occupancy.all_distinct(other)
    for check in (sink.staging_preflight, contract.transform_invariants):
        offered = lines.withColumn("reject_reason", F.lit(""))
        assert shuffled_ids(check(offered)) == 0
        assert shuffled_ids(check(offered.unionByName(offered.limit(1)))) > 0


def test_repeated_and_missing_ids_are_still_counted(spark, raw_frame):
    lines = accepted(spark, raw_frame).withColumn("reject_reason", F.lit(""))
    odd = lines.unionByName(lines.filter("source_row_number = 2")).withColumn(
        "source_row_id", F.when(F.col("source_row_number") != 3, F.col("source_row_id"))
    )
    found = {r.check_name: r.value for r in contract.transform_invariants(odd).collect()}
    assert (found["duplicated_row_ids"], found["missing_row_ids"], found["accepted_rows"]) == (1, 1, 7)
    assert sink.staging_preflight(odd).first().distinct_source_row_ids == 5


def test_index_tells_all_and_none(spark, raw_frame):
    lines = accepted(spark, raw_frame)
    known = occupancy.occupied(lines.filter("source_row_number <= 4"))
    assert occupancy.all_or_none(lines.filter("source_row_number <= 3"), known) is True
    assert occupancy.all_or_none(lines.filter("source_row_number > 4"), known) is False
    assert occupancy.all_or_none(lines, known) is None


def test_products_are_dealt_once_for_invoices(spark, raw_frame):
    lines = accepted(spark, raw_frame)

    def exchanges(found):
        return found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(")

    plain, fine = (kpi.kpis(lines, ["stock_code"], fine=f) for f in (False, True))
    assert exchanges(fine) < exchanges(plain)
    assert fine.collect() == plain.collect()
