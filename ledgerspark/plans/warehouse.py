"""A stored warehouse: staging, star schema and run log behind published snapshots.

Plain Parquet has no MERGE, so each run writes folders of its own: the lines it adds, their
facts, the dimensions it changes (small, written whole) and what later runs need to know
about the lines without reading them again: which row numbers they take (one bit each) and
how often each description occurs. A run is reconciled before its snapshot is published;
one that fails leaves readers with the former snapshot, and only folders that nobody reads.
What a month costs therefore depends on the month and the dimensions, not on the history.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, replace
from datetime import date, datetime, timezone
from functools import reduce
from itertools import takewhile
from uuid import uuid4

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ledgerspark.functions.frames import compact, few
from ledgerspark.functions.predicates import count_where
from ledgerspark.operators import occupancy, reconcile
from ledgerspark.operators.numbering import prefix_digits
from ledgerspark.operators.warehouse import (
    DIMENSIONS,
    calendar,
    canonical_of_counts,
    date_bounds,
    description_counts,
    fact_rows,
    keyed_members,
    known_members,
    merged_counts,
    unknown_member,
)
from ledgerspark.plans.snapshots import Part, Snapshot, Snapshots, month_key, overlapping
from ledgerspark.schema import (
    ACCEPTED_SCHEMA,
    ACCEPTED_TABLE_SCHEMA,
    DESCRIPTION_SCHEMA,
    DIM_SCHEMAS,
    FACT_TABLE_SCHEMA,
    RUN_LOG_SCHEMA,
    assert_signature,
)
from ledgerspark.sources import storage
from ledgerspark.sources.accepted import (
    append_by_month,
    assert_inspected,
    inspect_periods,
    next_month,
    periods,
    with_partitions,
)
from ledgerspark.sources.raw import foreign_ids_only, source_row_id, with_row_ids, without_row_ids


LINES_PER_FILE = 1 << 18  # facts of a month that one task numbers and writes
LARGE_DIMENSION = 1 << 19  # members of a dimension that lines are not shuffled to meet
REPLAY_BATCH = 12  # months of a replay whose checks share their readings, at most
REPLAY_ROWS = 1 << 21  # lines of such months, at most, unless one has more

# What a month shows before it is loaded: its inspection, and the rows of ``_checked``.
Inspection = tuple[list[dict], list[Row] | None]


class Warehouse:
    """``staging_path`` names accepted lines that serve as staging without being copied."""

    def __init__(self, spark: SparkSession, root: str, staging_path: str | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self.staging_path = staging_path
        self.snapshots = Snapshots(spark, self.root)

    # -- tables ----------------------------------------------------------------

    def snapshot(self) -> Snapshot:
        """What readers see now."""
        found = self.snapshots.latest()
        if not found.version and self.staging_path and storage.is_complete(self.spark, self.staging_path):
            found = replace(found, staging=(self._part(self.staging_path, ACCEPTED_TABLE_SCHEMA),))
        return found

    def _read(self, paths: list[str], schema: StructType) -> DataFrame | None:
        """Folders ``run=...`` of one table are read as its partitions, others each by itself.

        Lines and facts are stored without those ids that their sheets and row numbers give.
        """
        tables: dict[str, list[str]] = {}
        for path in paths:
            base, _, last = path.rpartition("/")
            tables.setdefault(base if last.startswith("run=") else path, []).append(path)
        frames = []
        for base, folders in tables.items():
            if folders == [base]:
                frames.append(self.spark.read.schema(schema).parquet(base))
                continue
            runs = StructType([*schema.fields, StructField("run", StringType())])
            table = self.spark.read.schema(runs).option("basePath", base).parquet(*folders)
            frames.append(table.select(*schema.names))
        found = reduce(DataFrame.unionByName, frames) if frames else None
        return found if found is None or "source_row_id" not in schema.names else with_row_ids(found)

    def staging(self, at: Snapshot | None = None) -> DataFrame | None:
        return self._read([p.path for p in (at or self.snapshot()).staging], ACCEPTED_TABLE_SCHEMA)

    def fact(self, at: Snapshot | None = None) -> DataFrame | None:
        return self._read([p.path for p in (at or self.snapshot()).facts], FACT_TABLE_SCHEMA)

    def _months(self, parts: tuple[Part, ...], schema: StructType, low: date, high: date) -> DataFrame:
        """Lines of some months; only folders of runs that brought such lines are listed."""
        paths = [p.path for p in overlapping(parts, low, high)]
        found = self._read(paths, schema) if paths else self.spark.createDataFrame([], schema)
        return months_between(found, low, high)

    def run_log(self) -> DataFrame:
        rows = [
            (date.fromisoformat(p), n, inserted, passed, datetime.fromisoformat(at))
            for p, n, inserted, passed, at in self.snapshot().log
        ]
        return self.spark.createDataFrame(rows, RUN_LOG_SCHEMA)

    def dim(self, name: str, at: Snapshot | None = None) -> DataFrame | None:
        found = (at or self.snapshot()).dims.get(name)
        return self.spark.read.schema(DIM_SCHEMAS[name]).parquet(found[0]) if found else None

    def dims(self, at: Snapshot | None = None) -> dict[str, DataFrame]:
        at = at or self.snapshot()
        return {name: self.dim(name, at) for name in DIMENSIONS}

    def _folder(self, table: str = "runs") -> str:
        """A run's own folder, as a partition of ``table``."""
        return f"{self.root}/{table}/run={uuid4().hex}"

    def _part(self, path: str, schema: StructType, most: int | None = None, **known) -> Part:
        """Rows per month of a folder, ``most`` at most, from the file footers."""
        rows = compact(self._read([path], schema), most).groupBy("year", "month").count().collect()
        return Part(path, {f"{r.year}-{r.month}": r["count"] for r in rows}, **known)

    def _written(
        self, lines: DataFrame, path: str, schema: StructType, rows: int, months: list[str], **known
    ) -> Part:
        """``lines``, ``rows`` at most, appended by month to ``path``; few of one month are counted in passing."""
        lines = compact(lines, rows)
        if few(rows) and len(months) == 1:
            # One stage without a shuffle, so what is counted in passing is counted once.
            seen = Observation()
            lines.observe(seen, F.count(F.lit(1)).alias("n")).write.partitionBy("year", "month").parquet(path)
            return Part(path, {months[0]: seen.get["n"]} if seen.get["n"] else {}, **known)
        lines.write.partitionBy("year", "month").parquet(path)
        return self._part(path, schema, rows, **known)

    def vacuum(self) -> list[str]:
        """Delete the folders of runs that the published snapshot does not name; for idle times."""
        used, gone = repr(asdict(self.snapshot())), []
        for table in ("runs", "staging", "occupied", "fact_sales"):
            runs = storage.children(self.spark, f"{self.root}/{table}")
            gone += [f"{self.root}/{table}/{run}" for run in runs if f"/{table}/{run}" not in used]
        for path in gone:
            storage.delete(self.spark, path)
        return gone

    # -- loads -----------------------------------------------------------------

    def load_staging(self, lines: DataFrame, dealt: bool = False) -> dict[str, int]:
        """Append accepted lines whose id is not staged yet; a broken line fails the load.

        Lines that are ``dealt`` lie in tasks of a few months each.
        """
        draft, counts = self._load(self.snapshot(), lines, dealt=dealt)
        self.snapshots.publish(draft)
        return counts

    def _checked(self, lines: DataFrame, rows: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
        """What decides about a load, per sheet and ``by``: lines, broken ones, ids, row numbers."""
        foreign = F.col("source_row_id") != source_row_id(F.col("source_sheet"), F.col("source_row_number"))
        marks = lines.select(
            *by,
            "source_row_id",
            "source_sheet",
            "source_row_number",
            (reconcile.load_violations() != "").alias("broken"),
            foreign.alias("foreign"),
        )
        if not few(rows) and occupancy.all_distinct(lines):
            # A line is its id's only one, so no id needs to be shuffled.
            per_id = marks.select(
                *by,
                F.lit(1).cast("bigint").alias("n"),
                *[F.coalesce(F.col(c), F.lit(False)).cast("bigint").alias(c) for c in ("broken", "foreign")],
                F.col("source_sheet").alias("sheet"),
                F.col("source_row_number").alias("number"),
            )
        else:
            per_id = marks.groupBy(*by, "source_row_id").agg(
                F.count(F.lit(1)).alias("n"),
                count_where(F.col("broken")).alias("broken"),
                count_where(F.col("foreign")).alias("foreign"),
                F.min("source_sheet").alias("sheet"),
                F.min("source_row_number").alias("number"),
            )
        return per_id.groupBy(*by, "sheet").agg(
            F.sum("n").alias("processed"),
            F.sum("broken").alias("broken"),
            F.sum("foreign").alias("foreign"),
            count_where(F.col("n") > 1).alias("repeated"),
            F.min("number").alias("low"),
            F.max("number").alias("high"),
        )

    def _load(
        self,
        draft: Snapshot,
        lines: DataFrame,
        rows: int | None = None,
        dealt: bool = False,
        months: list[str] = (),
        sheets: list[Row] | None = None,
        describe: bool = True,
    ) -> tuple[Snapshot, dict[str, int]]:
        """``draft`` with the lines that are not staged yet.

        ``rows`` is their number, ``months`` are theirs and ``sheets`` what ``_checked`` has
        found of them, if known. Without ``describe`` their descriptions are left to be counted.
        """
        lines = compact(lines.select(*[f.name for f in ACCEPTED_SCHEMA.fields]), rows)
        assert_signature(lines.schema, ACCEPTED_SCHEMA, "lines to load")
        if sheets is None:
            sheets = self._checked(lines, rows).collect()  # one row per sheet
        processed, broken, odd, repeated = (
            sum(r[c] for r in sheets) for c in ("processed", "broken", "foreign", "repeated")
        )
        if broken or repeated:
            raise ValueError(f"Load refused: {broken} lines break the contract, {repeated} ids repeat.")
        before, inserted = draft.staging_rows, 0
        if processed:
            bounds = {r.sheet: (r.low, r.high) for r in sheets}
            draft = self._indexed(draft)
            path = self._folder("staging")
            new = self.unstaged(draft, lines, bounds, odd, rows)
            new = foreign_ids_only(new) if odd else without_row_ids(new)
            if few(processed) and len(months) == 1:
                part = self._written(with_partitions(new), path, ACCEPTED_TABLE_SCHEMA, processed, months)
            else:
                append_by_month(new, path, rows=processed, dealt=dealt and not few(processed))
                part = self._part(path, ACCEPTED_TABLE_SCHEMA, processed)
            inserted = part.rows
            if inserted and describe:
                draft = self._with_staged(draft, part, bounds, odd)
            elif inserted:
                draft = replace(draft, staging=(*draft.staging, self._occupied(part, bounds, odd)))
        counts = {
            "processed": processed,
            "inserted": inserted,
            "skipped_existing": processed - inserted,
            "staging_rows": before + inserted,
        }
        return draft, counts

    def unstaged(
        self,
        at: Snapshot,
        lines: DataFrame,
        bounds: dict[str, tuple[int, int]],
        foreign: int = 0,
        rows: int | None = None,
    ) -> DataFrame:
        """Lines whose id is not staged, by the row numbers taken; staged lines are not read.

        ``bounds`` are the lines' row numbers per sheet: parts that have none of them are
        not opened. An id that is not the digest of its sheet and row number (``foreign``
        counts such lines) is not in the index, so where there are any, on either side,
        the ids themselves are compared as well.
        """

        def meets(part: Part) -> bool:
            return any(
                sheet in part.sheets and part.sheets[sheet][0] <= high and low <= part.sheets[sheet][1]
                for sheet, (low, high) in bounds.items()
            )

        new = lines
        met = [p for p in at.staging if meets(p)]
        index = self._read([p.occupied for p in met], occupancy.OCCUPIED_SCHEMA)
        if index is not None:
            index = occupancy.within(compact(index, sum(p.rows for p in met)), bounds)
            # Lines are shuffled to meet the index only if some of them are staged and some not.
            known = None if few(rows) else occupancy.all_or_none(lines, index)
            if known:
                new = lines.limit(0)
            elif known is None:
                new = occupancy.unoccupied(lines, index)
        others = [p.path for p in at.staging if foreign or p.foreign]
        if others:
            # A foreign line may stand at a row number that another id takes: only ids decide.
            ids = self._read(others, ACCEPTED_TABLE_SCHEMA).select("source_row_id")
            new = (new if not foreign else lines).join(ids, "source_row_id", "left_anti")
        return new.select(*lines.columns)

    def _with_staged(
        self, draft: Snapshot, part: Part, bounds: dict[str, tuple[int, int]], foreign: int
    ) -> Snapshot:
        """``draft`` with a part of staged lines, their row numbers and their descriptions."""
        with ThreadPoolExecutor(2) as pool:
            index = pool.submit(inheritable_thread_target(self.spark)(self._occupied), part, bounds, foreign)
            path = self._described_with(draft.descriptions, part, draft.staging_rows)
            part = index.result()
        return replace(draft, staging=(*draft.staging, part), descriptions=path)

    def _described_with(self, descriptions: str | None, part: Part, before: int) -> str:
        """Folder of the description counts of ``before`` lines and a part of staged ones."""
        counts = description_counts(compact(self._read([part.path], ACCEPTED_TABLE_SCHEMA), part.rows))
        if descriptions:
            counts = merged_counts(self.spark.read.schema(DESCRIPTION_SCHEMA).parquet(descriptions), counts)
            counts = compact(counts, part.rows + before)
        path = f"{self._folder()}/descriptions"
        counts.write.parquet(path)
        return path

    def _occupied(self, part: Part, bounds: dict[str, tuple[int, int]], foreign: int) -> Part:
        """``part`` with its index; ``bounds`` hold its row numbers, ``foreign`` its other ids, at least."""
        path = self._folder("occupied")
        lines = self._read([part.path], ACCEPTED_TABLE_SCHEMA)
        own = F.col("source_row_id") == source_row_id(F.col("source_sheet"), F.col("source_row_number"))
        occupancy.occupied(lines.filter(own), part.rows).write.parquet(path)
        sheets = {sheet: list(span) for sheet, span in bounds.items()}
        return replace(part, occupied=path, sheets=sheets, foreign=foreign)

    def _indexed(self, draft: Snapshot) -> Snapshot:
        """``draft`` with an index for lines that were given as staging and never loaded."""
        if all(p.occupied for p in draft.staging):
            return draft
        return self._described(replace(draft, staging=tuple(map(self._with_index, draft.staging))))

    def _with_index(self, part: Part) -> Part:
        if part.occupied:
            return part
        own = F.col("source_row_id") == source_row_id(F.col("source_sheet"), F.col("source_row_number"))
        found = self._read([part.path], ACCEPTED_TABLE_SCHEMA).groupBy("source_sheet").agg(
            F.min("source_row_number").alias("low"),
            F.max("source_row_number").alias("high"),
            count_where(~own).alias("foreign"),
        ).collect()  # one row per sheet
        bounds = {r.source_sheet: (r.low, r.high) for r in found}
        return self._occupied(part, bounds, sum(r.foreign for r in found))

    def _described(self, draft: Snapshot) -> Snapshot:
        """``draft`` with description counts of all its staged lines."""
        if draft.descriptions or not draft.staging:
            return draft
        path = f"{self._folder()}/descriptions"
        description_counts(self.staging(draft)).write.parquet(path)
        return replace(draft, descriptions=path)

    # -- dimensions and facts ----------------------------------------------------

    def _store_dim(self, name: str, rows: DataFrame, folder: str, most: int | None = None) -> tuple[str, int]:
        """Folder and number of a dimension's rows, which are ``most`` at most."""
        path = f"{folder}/{name}"
        if few(most):
            # One stage without a shuffle, so what is counted in passing is counted once.
            seen = Observation()
            compact(rows, most).observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
            return path, seen.get["n"]
        rows.write.parquet(path)
        return path, self.spark.read.schema(DIM_SCHEMAS[name]).parquet(path).count()

    def _upsert_dates(self, draft: Snapshot, folder: str, bounds: DataFrame, rows: int | None = None):
        """Extend the calendar without a hole: it goes on from the last day it has.

        ``rows`` is the number of scope lines.
        """
        known, before = self.dim("dim_date", draft), 0
        if known is not None:
            before = draft.dims["dim_date"][1]
            known = compact(known, before)
            span = known.agg(F.min("full_date").alias("_first"), F.max("full_date").alias("_last"))
            due = F.least("first_date", F.date_add("_last", 1))
            until = F.greatest("last_date", F.date_sub("_first", 1))
            bounds = bounds.crossJoin(span).select(due.alias("first_date"), until.alias("last_date"))
        days = calendar(bounds.coalesce(1))  # one row
        if known is not None:
            days = known.unionByName(days.join(known.select("full_date"), "full_date", "left_anti"))
        # A calendar has a row per day, so beside few lines it is small as well.
        stored = self._store_dim("dim_date", days, folder, rows and rows + before)
        return {"dim_date": stored}, {"date_inserted": stored[1] - before}

    def _upsert_members(
        self, draft: Snapshot, folder: str, scope: DataFrame, member: str, natural: str, rows: int | None = None
    ):
        """Add an UNKNOWN row at first; known keys stay, new members follow the highest key.

        ``rows`` is the number of scope lines.
        """
        name, key = f"dim_{member}", f"{member}_key"
        known, members = self.dim(name, draft), known_members(scope, natural)
        if known is None:
            keyed = keyed_members(members, key, f"{folder}/_{name}", rows=rows)
            stored = self._store_dim(name, unknown_member(keyed).unionByName(keyed), folder, rows)
            # The UNKNOWN row of a first build is not a member of the lines.
            return {name: stored}, {f"{member}_inserted": stored[1] - 1}
        before = draft.dims[name][1]
        most = rows and rows + before
        fresh = members.join(compact(known, most), natural, "left_anti")
        if not few(most) and fresh.isEmpty():
            return {}, {f"{member}_inserted": 0}
        # Keys are dense from 0 (UNKNOWN), so the number of rows is the next one.
        keyed = keyed_members(fresh, key, f"{folder}/_{name}", before - 1, rows)
        stored = self._store_dim(name, known.unionByName(keyed), folder, most)
        if stored[1] == before:
            return {}, {f"{member}_inserted": 0}
        return {name: stored}, {f"{member}_inserted": stored[1] - before}

    def _upsert_products(self, draft: Snapshot, folder: str, scope: DataFrame | None, rows: int | None = None):
        """Codes of ``scope`` (all without) are named by the maintained counts of all staged lines.

        ``rows`` is the number of scope lines.
        """
        counts, old = self.spark.read.schema(DESCRIPTION_SCHEMA).parquet(draft.descriptions), self.dim("dim_product", draft)
        if scope is not None:
            counts = counts.join(scope.select("stock_code").distinct(), "stock_code", "left_semi")
        canonical = compact(canonical_of_counts(counts), rows).select("stock_code", "description")
        if old is None:
            keyed = keyed_members(canonical, "product_key", f"{folder}/_dim_product", rows=rows)
            stored = self._store_dim("dim_product", keyed, folder, rows)
            return {"dim_product": stored}, {"product_inserted": stored[1], "product_updated": 0}
        start = draft.dims["dim_product"][1]  # keys are dense from 1
        most = rows and rows + start
        old = compact(old, most)
        before = old.select("stock_code", F.col("description").alias("_old"))
        renamed = canonical.join(before, "stock_code", "left").filter(~F.col("description").eqNullSafe(F.col("_old")))
        changes = [count_where(F.col("_old").isNull()).alias("new"), count_where(F.col("_old").isNotNull()).alias("updated")]
        schema, seen = renamed.schema, Observation()
        if few(most):
            renamed = compact(renamed, most).observe(seen, *changes)
        renamed.write.parquet(f"{folder}/_renamed")
        renamed = compact(self.spark.read.schema(schema).parquet(f"{folder}/_renamed"), rows)
        new, updated = (seen.get[c] for c in ("new", "updated")) if few(most) else renamed.agg(*changes).first()
        if not new and not updated:
            return {}, {"product_inserted": 0, "product_updated": 0}
        current = renamed.select("stock_code", F.col("description").alias("_new"))
        products = old.join(current, "stock_code", "left").select(
            "product_key", "stock_code", F.coalesce("_new", "description").alias("description")
        )
        if new:
            fresh = renamed.filter(F.col("_old").isNull()).select("stock_code", "description")
            keyed = keyed_members(fresh, "product_key", f"{folder}/_dim_product", start, rows)
            products = products.unionByName(keyed)
        stored = self._store_dim("dim_product", products, folder, most)
        return {"dim_product": stored}, {"product_inserted": new, "product_updated": updated}

    def _upsert_dimensions(
        self,
        draft: Snapshot,
        scope: DataFrame,
        bounds: DataFrame,
        whole_history: bool,
        rows: int | None = None,
    ) -> tuple[Snapshot, dict[str, int]]:
        """Extend all four dimensions with the members of ``scope`` lines, ``rows`` of them.

        The dimensions do not depend on each other, so their jobs are submitted
        together and share the executors.
        """
        folder = self._folder()
        draft = self._described(draft)
        loads = (
            (self._upsert_dates, draft, folder, bounds, rows),
            (self._upsert_members, draft, folder, scope, "customer", "customer_id", rows),
            (self._upsert_members, draft, folder, scope, "country", "country", rows),
            (self._upsert_products, draft, folder, None if whole_history else scope, rows),
        )
        with ThreadPoolExecutor(len(loads)) as pool:
            jobs = [pool.submit(inheritable_thread_target(self.spark)(f), *a) for f, *a in loads]
            done = [job.result() for job in jobs]
        for stored, _ in done:
            for name, (path, rows) in stored.items():
                draft = draft.with_dim(name, path, rows)
        return draft, {k: v for _, counts in done for k, v in counts.items()}

    def _append_facts(
        self, draft: Snapshot, scope: DataFrame, months: dict[str, int]
    ) -> tuple[Snapshot, dict[str, int]]:
        """Append the scope lines that have no fact yet; ``months`` has the scope's rows.

        Only facts of the scope's months can hold them, so the anti join reads those
        folders; its result is stored, as numbering reads it twice. Keys follow those
        of the snapshot, whose number it knows.
        """
        rows, new = sum(months.values()), scope
        low, high = (date.fromisoformat(f"{m}-01") for m in (min(months), max(months)))
        if overlapping(draft.facts, low, high):
            known = self._months(draft.facts, FACT_TABLE_SCHEMA, low, high).select("source_row_id")
            fresh = scope.join(known, "source_row_id", "left_anti").select(*scope.columns)
            fresh_path = f"{self._folder()}/fresh"
            fresh.write.parquet(fresh_path)
            new = self.spark.read.schema(scope.schema).parquet(fresh_path)
        digits = prefix_digits(max(months.values()), LINES_PER_FILE, 0)
        large = tuple(name for name, (_, members) in draft.dims.items() if members > LARGE_DIMENSION)
        facts = fact_rows(new, self.dims(draft), draft.fact_rows, digits, rows, large)
        facts = foreign_ids_only(facts)
        path = self._folder("fact_sales")
        # Numbering has dealt the lines by month and id, so a month's files are its id ranges.
        part = self._written(facts, path, FACT_TABLE_SCHEMA, rows, list(months))
        if part.rows:
            draft = replace(draft, facts=(*draft.facts, part))
        return draft, {"fact_inserted": part.rows, "fact_skipped_existing": rows - part.rows}

    def bootstrap(self, with_facts: bool = True) -> dict[str, int]:
        """Build or re-run the whole star schema from all staged lines, or its dimensions only."""
        draft = self.snapshot()
        lines = self.staging(draft)
        draft, counts = self._upsert_dimensions(draft, lines, date_bounds(lines), whole_history=True)
        facts = {}
        if with_facts:
            draft, facts = self._append_facts(draft, lines, _rows_per_month(draft.staging))
        self.snapshots.publish(draft)
        return {**counts, **facts}

    def build_facts(self) -> dict[str, int]:
        """Facts of all staged lines, over the dimensions that there are."""
        draft = self.snapshot()
        draft, counts = self._append_facts(draft, self.staging(draft), _rows_per_month(draft.staging))
        self.snapshots.publish(draft)
        return counts

    def upsert_periods(self, low: date, high: date, source_max: date) -> dict:
        """Bring the star schema up to date for the staged months ``low`` to ``high``.

        The calendar runs to the month's end, but stops at the last sale in the
        source's final month. Several months at once give the same members as one
        by one; only the order of new surrogate keys may differ.
        """
        draft, counts = self._upsert(self.snapshot(), low, high, source_max)
        self.snapshots.publish(draft)
        return counts

    def _upsert(self, draft: Snapshot, low: date, high: date, source_max: date) -> tuple[Snapshot, dict]:
        draft, counts = self._upsert_scope(draft, low, high, source_max)
        draft, facts = self._append_scope(draft, low, high)
        return draft, {"first_period": low, "last_period": high, **counts, **facts}

    def _scope(self, draft: Snapshot, low: date, high: date) -> tuple[DataFrame, dict[str, int]]:
        """The staged lines of some months, and their number per month."""
        months = _rows_per_month(draft.staging, low, high)
        if not months:
            raise ValueError(f"No staged lines for {low} to {high}.")
        found = self._months(draft.staging, ACCEPTED_TABLE_SCHEMA, low, high)
        return compact(found, sum(months.values())), months

    def _upsert_scope(self, draft: Snapshot, low: date, high: date, source_max: date) -> tuple[Snapshot, dict]:
        """``draft`` with the dimensions that the months' staged lines need."""
        if low.day != 1 or high.day != 1 or source_max.day != 1:
            raise ValueError("Periods are first-of-month dates.")
        scope, months = self._scope(draft, low, high)
        rows = sum(months.values())
        first = F.lit(low).alias("first_date")
        if high == source_max:
            bounds = scope.agg(first, F.max("invoice_datetime").cast("date").alias("last_date"))
        else:
            bounds = self.spark.range(1).select(first, F.last_day(F.lit(high)).alias("last_date"))
        draft, counts = self._upsert_dimensions(draft, scope, bounds, whole_history=False, rows=rows)
        return draft, {"period_staging_rows": rows, **counts}

    def _append_scope(self, draft: Snapshot, low: date, high: date) -> tuple[Snapshot, dict[str, int]]:
        """``draft`` with the facts of the months' staged lines, over the dimensions it has."""
        return self._append_facts(draft, *self._scope(draft, low, high))

    # -- runs ------------------------------------------------------------------

    def reconciliation(
        self, low: date | None = None, high: date | None = None, at: Snapshot | None = None
    ) -> DataFrame:
        at = at or self.snapshot()
        staging, fact, rows = self.staging(at), self.fact(at), None
        if low is not None:
            rows = max(sum(_rows_per_month(parts, low, high).values()) for parts in (at.staging, at.facts))
            staging = compact(self._months(at.staging, ACCEPTED_TABLE_SCHEMA, low, high), rows)
            fact = compact(self._months(at.facts, FACT_TABLE_SCHEMA, low, high), rows)
        return reconcile.period_reconciliation(staging, fact, self.dims(at), rows)

    def mark(self) -> date | None:
        """Last month of the contiguous passed prefix of the run log."""
        mark = self.snapshot().mark
        return date.fromisoformat(mark) if mark else None

    def decide(self, low: date, source_min: date, source_max: date, force: bool = False) -> str:
        """Sequencing decision for a month, or an error that says what is expected."""
        mark = self.mark()
        decision = (
            self.spark.sql("SELECT 1")
            .select(
                reconcile.period_decision(
                    F.lit(low),
                    F.lit(mark).cast("date"),
                    F.lit(source_min),
                    F.lit(source_max),
                    F.lit(force),
                )
            )
            .first()[0]
        )
        if decision in ("out_of_range", "gap", "force_refused"):
            expected = source_min if mark is None else next_month(mark)
            raise ValueError(f"Period {low}: {decision}; the next period is {expected}.")
        return decision

    def run(
        self,
        accepted: DataFrame,
        low: date,
        source_min: date,
        source_max: date,
        high: date | None = None,
        force: bool = False,
    ) -> dict:
        """Load one month, or catch up on consecutive months, behind the quality gate.

        Lines, star schema and log are published together and only after every month
        reconciles, so a failure anywhere leaves readers the former snapshot and its mark;
        a forced re-run never moves the mark.
        """
        high = high or low
        decision = self.decide(low, source_min, source_max, force)
        if high > source_max:
            raise ValueError(f"Period {high} is after the last source period {source_max}.")
        if decision == "already_processed":
            return {"decision": decision, "mark": self.mark()}
        if force and high > self.mark():
            raise ValueError("A forced run may not pass the mark.")
        draft, inputs, staged = self._inspected_load(self.snapshot(), accepted, low, high)
        before = draft.facts
        draft, built = self._upsert(draft, low, high, source_max)
        self.audit(draft, inputs)
        if not force:
            draft = self._logged(draft, before, inputs)
        self.snapshots.publish(draft)
        return {"decision": decision, **staged, **built, "mark": self.mark()}

    def _inspected_load(
        self,
        draft: Snapshot,
        accepted: DataFrame,
        low: date,
        high: date,
        seen: Inspection | None = None,
        describe: bool = True,
    ) -> tuple[Snapshot, dict[date, int], dict[str, int]]:
        """``draft`` with the lines of some months, their numbers and the load's counts.

        Nothing is written before the months themselves have been looked at, or were ``seen``.
        """
        lines = months_between(accepted, low, high)
        inspected, sheets = seen or ([r.asDict() for r in inspect_periods(lines).collect()], None)
        for found in inspected:
            assert_inspected(found)
        inputs = {found["period"]: found["row_count"] for found in inspected}
        wanted = _months_of(low, high)
        if sorted(inputs) != wanted:
            raise ValueError(f"Source months {sorted(inputs)} are not {wanted}.")
        draft, staged = self._load(
            draft,
            lines,
            sum(inputs.values()),
            months=[month_key(p) for p in wanted],
            sheets=sheets,
            describe=describe,
        )
        return draft, {period: inputs[period] for period in wanted}, staged

    def _inspected(self, accepted: DataFrame, months: list[date], rows: int) -> dict[date, Inspection]:
        """What each of some months, of ``rows`` lines, shows when all are read together; nothing is judged."""
        lines = compact(months_between(accepted, months[0], months[-1]), rows)
        found: dict[date, Inspection] = {p: ([], []) for p in months}
        with ThreadPoolExecutor(2) as pool:
            checks = pool.submit(
                inheritable_thread_target(self.spark)(lambda: self._checked(lines, rows, ("year", "month")).collect())
            )
            for r in inspect_periods(lines).collect():  # one row per month
                found[r.period][0].append(r.asDict())
            for r in checks.result():  # one row per month and sheet
                found[date(int(r.year), int(r.month), 1)][1].append(r)
        return found

    def _batches(self, accepted: DataFrame, months: list[date]) -> list[tuple[list[date], int]]:
        """Consecutive months that are inspected and audited together, with their lines by the footers."""
        found = {r.period: r.row_count for r in periods(months_between(accepted, months[0], months[-1])).collect()}
        batches: list[tuple[list[date], int]] = []
        for period in months:
            n = found.get(period, 0)
            if batches and len(batches[-1][0]) < REPLAY_BATCH and batches[-1][1] + n <= REPLAY_ROWS:
                batches[-1] = ([*batches[-1][0], period], batches[-1][1] + n)
            else:
                batches.append(([period], n))
        return batches

    def replay(self, accepted: DataFrame, low: date, source_min: date, source_max: date) -> None:
        """Run every month from ``low``, the next one, to ``source_max``, each behind its own gate.

        Each month is loaded, gets its dimensions and its facts by itself, and the next ones
        follow while it is under way. What only reads, the inspection before and the audit
        after, is measured for a batch of months at once and judged month by month. A month
        is published after it and all months before it have reconciled, so one that fails
        leaves readers the month before, as single runs do; what was prepared of later months
        are folders that nobody reads.
        """
        decision = self.decide(low, source_min, source_max)
        if decision != "next_period":
            raise ValueError(f"Period {low}: {decision}.")
        published = self.snapshot()
        base = self._indexed(published)
        batches = self._batches(accepted, _months_of(low, source_max))
        months = [(p, b) for b, (batch, _) in enumerate(batches) for p in batch]
        inspections, loads, descriptions, dims, facts = [], [], [], [], []

        def load(k: int) -> tuple[Snapshot, dict[date, int]]:
            before = loads[k - 1].result()[0] if k else base
            period, b = months[k]
            # If the months cannot be read together, each is read by itself and fails by itself.
            seen = None if inspections[b].exception() else inspections[b].result()[period]
            return self._inspected_load(before, accepted, period, period, seen, describe=False)[:2]

        def count(k: int) -> str | None:
            loaded = loads[k].result()[0]
            earlier = loads[k - 1].result()[0] if k else base
            path = descriptions[k - 1].result() if k else base.descriptions
            for part in loaded.staging[len(earlier.staging) :]:
                path = self._described_with(path, part, earlier.staging_rows)
            return path

        def describe(k: int) -> tuple[Snapshot, dict[date, int]]:
            loaded, inputs = loads[k].result()
            before = dims[k - 1].result()[0] if k else base
            draft = replace(before, staging=loaded.staging, descriptions=descriptions[k].result())
            return self._upsert_scope(draft, months[k][0], months[k][0], source_max)[0], inputs

        def build(k: int) -> tuple[Snapshot, tuple[Part, ...], dict[date, int]]:
            before = facts[k - 1].result()[0].facts if k else base.facts
            described, inputs = dims[k].result()
            draft = replace(described, facts=before)
            return self._append_scope(draft, months[k][0], months[k][0])[0], before, inputs

        pools = [ThreadPoolExecutor(1) for _ in range(5)]
        target = inheritable_thread_target(self.spark)

        def prepare(b: int) -> None:
            batch, rows = batches[b]
            inspections.append(pools[0].submit(target(self._inspected), accepted, batch, rows))
            for _ in batch:
                for pool, step, done in zip(pools[1:], (load, count, describe, build), (loads, descriptions, dims, facts)):
                    done.append(pool.submit(target(step), len(done)))

        try:
            for b in range(len(batches)):
                while len(inspections) < min(b + 2, len(batches)):  # the next batch is under way meanwhile
                    prepare(len(inspections))
                first = sum(len(batch) for batch, _ in batches[:b])
                built = facts[first : first + len(batches[b][0])]
                whole = [f.result() for f in takewhile(lambda f: not f.exception(), built)]
                measures = self._audited(whole)
                for draft, before, inputs in whole:
                    self._judge(measures, inputs)
                    draft = replace(draft, version=published.version, log=published.log, mark=published.mark)
                    published = self.snapshots.publish(self._logged(draft, before, inputs))
                for f in built[len(whole) :]:
                    f.result()  # raises
        finally:
            for pool in pools:
                pool.shutdown(cancel_futures=True)

    def _audited(self, built: list[tuple[Snapshot, tuple[Part, ...], dict[date, int]]]) -> dict[date, dict]:
        """Measures of consecutive months in the snapshot of the last one, which has the lines of all."""
        if not built:
            return {}
        low, high = min(built[0][2]), max(built[-1][2])
        return {r.period: r.asDict() for r in self.reconciliation(low, high, built[-1][0]).collect()}

    def audit(self, at: Snapshot, inputs: dict[date, int]) -> None:
        """Reconcile the months of a snapshot with their numbers of input lines, or raise."""
        rows = self.reconciliation(min(inputs), max(inputs), at).collect()
        self._judge({r.period: r.asDict() for r in rows}, inputs)

    def _judge(self, measures: dict[date, dict], inputs: dict[date, int]) -> None:
        for period, n in inputs.items():
            if period not in measures:
                raise ValueError(f"Period {period} has no reconciliation.")
            reconcile.assert_period(measures[period], n)

    def load_batch(self, lines: DataFrame, low: date, high: date) -> None:
        """Load lines of months that may still be arriving; published once they reconcile.

        The calendar ends at the last sale so far and is carried on by the next batch.
        """
        draft, _ = self._load(self.snapshot(), lines)
        draft, _ = self._upsert(draft, low, high, high)
        months = _rows_per_month(draft.staging, low, high)
        self.audit(draft, {date.fromisoformat(f"{m}-01"): n for m, n in months.items()})
        self.snapshots.publish(draft)

    def _logged(self, draft: Snapshot, before: tuple[Part, ...], inputs: dict[date, int]) -> Snapshot:
        """``draft`` with passed months and their input lines in its log, and the mark they lead to.

        ``before`` are the facts of the snapshot that the months were added to.
        """
        inserted = _rows_per_month(draft.facts[len(before) :], min(inputs), max(inputs))
        months = [(p, n, inserted.get(month_key(p), 0)) for p, n in inputs.items()]
        now = datetime.now(timezone.utc).replace(tzinfo=None).isoformat()
        log = (*draft.log, *((p.isoformat(), n, inserted, True, now) for p, n, inserted in months))
        return replace(draft, log=log, mark=marked({p for p, _, _, passed, _ in log if passed}, {p for p, *_ in log}))


def _months_of(low: date, high: date) -> list[date]:
    period, found = low, []
    while period <= high:
        found.append(period)
        period = next_month(period)
    return found


def marked(passed: set[str], logged: set[str]) -> str | None:
    """Last month (ISO date) before the first of the log that did not pass or is absent."""
    mark, period = None, min(logged, default="")
    while period in passed:
        mark, period = period, next_month(date.fromisoformat(period)).isoformat()
    return mark


def _rows_per_month(parts: tuple[Part, ...], low: date | None = None, high: date | None = None) -> dict[str, int]:
    found: dict[str, int] = {}
    for part in parts:
        for month, n in part.months.items():
            if low is None or month_key(low) <= month <= month_key(high):
                found[month] = found.get(month, 0) + n
    return found


def months_between(lines: DataFrame, low: date, high: date) -> DataFrame:
    """Lines of the months ``low`` to ``high``; only those month folders are read.

    A text key ``YYYY-MM`` orders like the date it stands for.
    """
    month = F.concat("year", F.lit("-"), "month")
    return lines.filter(month.between(f"{low:%Y-%m}", f"{high:%Y-%m}"))
