"""Snapshots of a warehouse: which folders readers see, behind one atomic pointer.

A run writes to folders of its own and reconciles them; only then a manifest that names
them is created. Readers take the manifest of the highest number, so they see a run whole
or not at all. A manifest is made by an exclusive create, which one of two concurrent
writers loses; one that was cut short is not valid JSON and does not count.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace
from datetime import date

from pyspark.sql import SparkSession

from ledgerspark.sources import storage


@dataclass(frozen=True)
class Part:
    """One folder of lines: rows per month, and for staged lines what their ids cover."""

    path: str
    months: dict[str, int]
    occupied: str | None = None  # folder of the occupancy of row numbers
    sheets: dict[str, list[int]] = field(default_factory=dict)  # first and last row number of each sheet
    foreign: int = 0  # ids that are not the digest of sheet and row number

    @property
    def rows(self) -> int:
        return sum(self.months.values())


@dataclass(frozen=True)
class Snapshot:
    version: int = 0
    staging: tuple[Part, ...] = ()
    facts: tuple[Part, ...] = ()
    dims: dict[str, tuple[str, int]] = field(default_factory=dict)  # folder and rows
    descriptions: str | None = None  # folder of the counts of all staged lines
    log: tuple[tuple, ...] = ()  # (month, input rows, inserted rows, passed, time)
    mark: str | None = None

    @property
    def staging_rows(self) -> int:
        return sum(p.rows for p in self.staging)

    @property
    def fact_rows(self) -> int:
        """Also the highest sales key: keys are dense from 1."""
        return sum(p.rows for p in self.facts)

    def with_dim(self, name: str, path: str, rows: int) -> Snapshot:
        return replace(self, dims={**self.dims, name: (path, rows)})


def month_key(period: date) -> str:
    return f"{period:%Y-%m}"


def overlapping(parts: tuple[Part, ...], low: date, high: date) -> list[Part]:
    """Parts with rows of the months ``low`` to ``high``."""
    first, last = month_key(low), month_key(high)
    return [p for p in parts if any(first <= m <= last for m in p.months)]


class Snapshots:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.folder = spark, f"{root}/snapshots"

    def _versions(self) -> list[int]:
        names = storage.children(self.spark, self.folder)
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def latest(self) -> Snapshot:
        for version in reversed(self._versions()):
            try:
                found = json.loads(storage.read_text(self.spark, self._path(version)))
            except json.JSONDecodeError:
                continue
            for name in ("staging", "facts"):
                found[name] = tuple(Part(**p) for p in found[name])
            found["dims"] = {k: tuple(v) for k, v in found["dims"].items()}
            found["log"] = tuple(tuple(entry) for entry in found["log"])
            return Snapshot(**found)
        return Snapshot()

    def _path(self, version: int) -> str:
        return f"{self.folder}/v{version:08d}.json"

    def publish(self, draft: Snapshot) -> Snapshot:
        """Make ``draft`` what readers see; fails if another run was published since its base."""
        if self.latest().version != draft.version:
            raise RuntimeError("Another run has been published meanwhile; run again.")
        done = replace(draft, version=max([draft.version, *self._versions()]) + 1)
        storage.create_text(self.spark, self._path(done.version), json.dumps(asdict(done)))
        return done
