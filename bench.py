"""Timed queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

The layers are built first and timed as ``build_*``, so no query hides that work.
``read_*`` repeats the published CSV/Parquet reading comparison on 100,000 lines.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import functions as F

from ledgerspark.plans import queries as registry
from ledgerspark.plans.layers import Layers
from ledgerspark.schema import ACCEPTED_COLUMNS, ACCEPTED_SCHEMA
from ledgerspark.session import local_session

READ_ROWS = 100_000
READ_COLUMNS = ["source_row_id", "invoice_no", "quantity", "line_amount"]


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def folder_bytes(spark, path: str) -> int:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getContentSummary(jpath).getLength()


def reading(spark, layers: Layers) -> tuple[dict, dict]:
    """Median of three reads of the same lines as CSV and as Parquet."""
    base = layers.scratch("reading")
    lines = layers.accepted().select(*ACCEPTED_COLUMNS).limit(READ_ROWS)
    lines.repartition(8).write.parquet(f"{base}/parquet")
    stored = spark.read.schema(ACCEPTED_SCHEMA).parquet(f"{base}/parquet")
    stored.write.option("header", True).csv(f"{base}/csv")
    csv = spark.read.schema(ACCEPTED_SCHEMA).option("header", True).csv(f"{base}/csv")
    seconds = {}
    for name, df in (("csv", csv), ("parquet", stored)):
        for kind, columns in (("full", list(ACCEPTED_COLUMNS)), ("4_columns", READ_COLUMNS)):
            runs = sorted(timed(lambda: drain(df.select(*columns))) for _ in range(3))
            seconds[f"read_{name}_{kind}"] = runs[1]
    sizes = {k: folder_bytes(spark, f"{base}/{k}") for k in ("csv", "parquet")}
    return seconds, sizes


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, memory=os.environ.get("BENCH_MEMORY", "12g"), partitions=int(cores))
    layers = Layers(spark, sf_dir)
    seconds: dict[str, float] = {"session_warm_up": timed(lambda: spark.range(10).agg(F.sum("id")).collect())}
    seconds["build_raw"] = timed(layers.raw)
    seconds["build_accepted"] = timed(layers.accepted)
    seconds["build_rejected"] = timed(layers.rejected)
    seconds["build_star"] = timed(layers.warehouse)
    failed = []
    for name, run in registry.queries().items():
        try:
            seconds[name] = timed(lambda: drain(run(spark, sf_dir)))
        except Exception as error:  # a broken query must not hide the others
            failed.append(name)
            print(f"{name}: {error}", file=sys.stderr)
    reads, sizes = reading(spark, layers)
    seconds.update(reads)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "accepted_rows": layers.accepted().count(),
                "read_rows": READ_ROWS,
                "bytes": sizes,
                "failed": failed,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
