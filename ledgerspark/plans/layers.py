"""The stored layers of one source: raw, accepted, rejected and the star schema.

Each layer is built once per application from the one before it, in the shared
folder, and then read like any table: column-pruned and filtered at the scan.
"""

from __future__ import annotations

import hashlib
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerspark.operators import contract
from ledgerspark.operators.numbering import numbered_in_order, numbered_stored
from ledgerspark.plans import bridge
from ledgerspark.plans.warehouse import Warehouse
from ledgerspark.schema import ACCEPTED_COLUMNS, FIRST_ROW_NUMBER, RAW_COLUMNS, RAW_TEXT_SCHEMA
from ledgerspark.session import configure, deal_by_size, shared_folder
from ledgerspark.sources import storage
from ledgerspark.sources.accepted import read_accepted, write_accepted, write_rejected
from ledgerspark.sources.raw import with_row_ids, without_row_ids

LOADED_AT = datetime(2026, 1, 1)
_RAW_STORED = T.StructType(
    [
        T.StructField("source_sheet", T.StringType()),
        *RAW_TEXT_SCHEMA.fields,
    ]
)
RAW_FILE_ROWS = 1 << 19
_SOURCE_TABLES = ("lineitem", "orders", "customer", "nation", "part")


class Layers:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = configure(spark)
        self.sf_dir = sf_dir.rstrip("/")
        stamp = "|".join(
            [self.sf_dir]
            + [storage.source_stamp(spark, f"{self.sf_dir}/{t}.parquet") for t in _SOURCE_TABLES]
        )
        deal_by_size(spark, sum(storage.size(spark, f"{self.sf_dir}/{t}.parquet") for t in _SOURCE_TABLES))
        digest = hashlib.sha256(stamp.encode()).hexdigest()[:16]
        self.root = (
            f"{shared_folder(spark)}/ledgerspark/{spark.sparkContext.applicationId}/{digest}"
        )

    def _ready(self, path: str) -> bool:
        return storage.is_complete(self.spark, path)

    def raw(self) -> DataFrame:
        """Raw lines with sheet and physical row number, landed once, in physical order.

        A number is the place of a line in its file after the lines of its sheet in earlier
        files; those offsets are stored with the lines, one row per file and sheet.
        """
        path = f"{self.root}/raw"
        if not self._ready(f"{path}/segments"):
            order = bridge.line_order(self.spark, self.sf_dir)
            numbered_in_order(
                bridge.joined_lines(self.spark, self.sf_dir, order),
                path,
                ["source_sheet", *order],
                bridge.raw_fields(),
                "position",
                ["source_sheet"],
                RAW_FILE_ROWS,
            )
        numbered = numbered_stored(self.spark, path, _RAW_STORED, "position")
        number = (F.col("position") + FIRST_ROW_NUMBER - 1).alias("source_row_number")
        return numbered.select("source_sheet", number, *[F.col(f"`{c}`") for c in RAW_COLUMNS])

    def contents(self) -> DataFrame:
        """Raw lines without row numbers, for measures that read them once.

        What does not depend on a line's place needs neither the order nor the landing: lines
        come from the source tables, or from the raw layer if it is there.
        """
        if self._ready(f"{self.root}/raw/segments"):
            return self.raw_fields()
        return bridge.unplaced_lines(self.spark, self.sf_dir)

    def raw_fields(self) -> DataFrame:
        """Raw lines without row numbers, for measures that need only their content."""
        self.raw()
        return self.spark.read.schema(_RAW_STORED).parquet(f"{self.root}/raw/rows")

    def classified(self) -> DataFrame:
        return contract.classify(self.raw(), LOADED_AT)

    @property
    def accepted_path(self) -> str:
        return f"{self.root}/accepted"

    def accepted(self) -> DataFrame:
        """Accepted lines, stored without their ids, which are all derived from what is stored."""
        if not self._ready(self.accepted_path):
            lines = without_row_ids(contract.accepted_lines(self.classified()))
            # A raw file is part of one sheet, a year as a rule, so its lines have few months.
            write_accepted(lines, self.accepted_path, self.root, dealt=True)
        return with_row_ids(read_accepted(self.spark, self.accepted_path))

    def published(self) -> str:
        """Folder of the accepted dataset as others read it, ids included."""
        path = f"{self.root}/published"
        if not self._ready(path):
            write_accepted(contract.accepted_lines(self.classified()), path, self.root, dealt=True)
        return path

    def assessed(self) -> DataFrame:
        """Every raw line through the contract, without row numbers and ids, for one reading."""
        unplaced = self.contents().withColumn("source_row_number", F.lit(None).cast("bigint"))
        return contract.classify(unplaced, LOADED_AT).drop("source_row_number", "source_row_id")

    def accepted_contents(self) -> DataFrame:
        """Accepted lines without row numbers and ids, for measures that read them once.

        Only the columns that a measure asks for are computed, nothing is stored.
        """
        columns = [c for c in ACCEPTED_COLUMNS if c not in ("source_row_number", "source_row_id")]
        if self._ready(self.accepted_path):
            return self.accepted().select(*columns)
        return contract.keep_where(self.assessed(), F.col("reject_reason") == "").select(*columns)

    def rejected(self) -> DataFrame:
        path = f"{self.root}/rejected"
        if not self._ready(path):
            write_rejected(contract.rejected_lines(self.classified()), path)
        return self.spark.read.parquet(path)

    def outcome(self) -> DataFrame:
        """Accepted and rejected lines as stored, with their reasons: what became of each
        raw line, read from the sinks instead of running the contract again."""
        columns = [*ACCEPTED_COLUMNS, "reject_reason"]
        kept = self.accepted().withColumn("reject_reason", F.lit(""))
        return kept.select(*columns).unionByName(self.rejected().select(*columns))

    def _sinks_stored(self) -> bool:
        return self._ready(self.accepted_path) and self._ready(f"{self.root}/rejected")

    def outcome_once(self) -> DataFrame:
        """The outcome for one reading: through the contract, unless both sinks are there.

        Storing both takes the contract twice and writes every line.
        """
        if self._sinks_stored():
            return self.outcome()
        return self.classified().select(*ACCEPTED_COLUMNS, "reject_reason")

    def outcome_contents(self) -> DataFrame:
        """The outcome for one reading, without row numbers and ids."""
        columns = [c for c in [*ACCEPTED_COLUMNS, "reject_reason"] if c not in ("source_row_number", "source_row_id")]
        return (self.outcome() if self._sinks_stored() else self.assessed()).select(*columns)

    def warehouse(self, facts: bool = True) -> Warehouse:
        """The star schema over the accepted dataset, which serves as its staging table.

        Without ``facts`` its dimensions are enough; they are built once in either case.
        """
        self.accepted()
        store = Warehouse(self.spark, f"{self.root}/star", staging_path=self.accepted_path)
        found = store.snapshots.latest()
        if not found.version:
            store.bootstrap(facts)
        elif facts and not found.facts:
            store.build_facts()
        return store

    def dimensions(self) -> tuple[DataFrame, dict[str, DataFrame]]:
        """(staging lines, dimensions), for what needs no facts."""
        store = self.warehouse(facts=False)
        return store.staging(), store.dims()

    def star(self) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
        """(staging lines, facts, dimensions)."""
        store = self.warehouse()
        return store.staging(), store.fact(), store.dims()

    def scratch(self, name: str) -> str:
        """A fresh folder for a job that writes its own tables."""
        base = f"{self.root}/scratch/{name}"
        return f"{base}/{len(storage.children(self.spark, base)):05d}"
