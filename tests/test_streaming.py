"""Draining month folders equals one batch load; draining again adds nothing."""

from conftest import LOADED_AT

from ledgerspark.operators import contract
from ledgerspark.plans.warehouse import Warehouse
from ledgerspark.sources import accepted as sink
from ledgerspark.streaming.months import drain_months


def test_drain_is_idempotent(spark, folder, raw_frame):
    raw = raw_frame(
        {"InvoiceDate": "2009-12-01 07:45:00"},
        {"Invoice": "2", "InvoiceDate": "2010-01-02 08:00:00", "StockCode": "B"},
        {"Invoice": "3", "InvoiceDate": "2010-02-03 08:00:00", "Customer ID": None},
    )
    lines = contract.accepted_lines(contract.classify(raw, LOADED_AT))
    sink.write_accepted(lines, f"{folder}/accepted", folder)
    store = Warehouse(spark, f"{folder}/store")
    for checkpoint in ("first", "first", "second"):
        query = drain_months(spark, f"{folder}/accepted", store, f"{folder}/{checkpoint}", files=2)
        query.awaitTermination()
        assert query.exception() is None
    assert store.staging().count() == store.fact().count() == 3
    facts = store.fact().join(store.dim("dim_product"), "product_key")
    assert sorted(r.stock_code for r in facts.collect()) == ["52017", "52017", "B"]


def test_two_drains_leave_no_hole_in_the_calendar(spark, folder, raw_frame):
    first = raw_frame({"InvoiceDate": "2009-12-10 07:45:00"})
    later = raw_frame({"InvoiceDate": "2010-01-15 08:00:00"}, numbers=[3])
    store = Warehouse(spark, f"{folder}/store")
    for raw in (first, later):
        lines = contract.accepted_lines(contract.classify(raw, LOADED_AT))
        sink.append_by_month(lines, f"{folder}/accepted")
        drain_months(spark, f"{folder}/accepted", store, f"{folder}/checkpoint").awaitTermination()
    days = [r.full_date for r in store.dim("dim_date").orderBy("full_date").collect()]
    assert len(days) == (days[-1] - days[0]).days + 1 == 46  # from the first of December on
