"""Accepted month folders as a stream into the stored warehouse.

The source is a static history, so the stream only drains what is there
(``availableNow``) and ends. Each micro-batch goes through the same idempotent load
and upsert as a batch run, is inspected before anything is written and published once it
reconciles; a replayed batch inserts nothing twice. The run log is left to ``Warehouse.run``, which
knows that a month is complete.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ledgerspark.plans.warehouse import Warehouse
from ledgerspark.schema import ACCEPTED_COLUMNS, ACCEPTED_TABLE_SCHEMA
from ledgerspark.sources.accepted import assert_inspected, inspect_periods


def drain_months(
    spark: SparkSession, accepted_path: str, store: Warehouse, checkpoint: str, files: int = 1000
) -> StreamingQuery:
    """Load every accepted file not yet seen by ``checkpoint``, ``files`` per batch."""

    def load(batch: DataFrame, _: int) -> None:
        found = [r.asDict() for r in inspect_periods(batch).collect()]
        if not found:
            return
        for month in found:
            assert_inspected(month)
        low, high = min(m["period"] for m in found), max(m["period"] for m in found)
        store.load_batch(batch.select(*ACCEPTED_COLUMNS), low, high)

    stream = (
        spark.readStream.schema(ACCEPTED_TABLE_SCHEMA)
        .option("maxFilesPerTrigger", files)
        .parquet(accepted_path)
    )
    return (
        stream.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
