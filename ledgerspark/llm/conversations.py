"""Repair of conversations' role order by the cheapest edits, as a secondary-sorted stream.

A conversation is right when its role initials read ``(s?(ua)+)?``. Rows may be kept (0),
given the role user or assistant (3) or deleted (4, a must for blank and repeated ones);
an empty user or assistant row may be put anywhere (3); a truncated row that stays costs
3 more. Four states describe what has come so far: nothing, a system row, a user row, an
assistant row. The letter of an edit fixes the next state, so of the cheapest edits those
with the ASCII-least initials are found by walking on from the front, taking the least
letter that keeps the cost.

Rows go to their conversation's task without their text, sorted from the last turn to the
first, and mapInPandas carries the four costs across Arrow batches. Every row leaves two
bytes behind: the letter to take in each state. A conversation of up to
``BLOCK`` rows is walked at once. A longer one spills its bytes as rows of the stored
table, ``BLOCK`` at a time, and a second stream reads these from the first turn on. The
texts take part only in the last stream, where the edits are applied to them; so the
memory of a task does not depend on a conversation's length, but for its edits' initials
themselves, which are one value. Repeats are found by a grouped minimum that is combined
before the shuffle.

Defined results: a null conversation is one of its own; null roles and texts are one
space; null turns come first; rows of one turn go by role and text; an empty role fits no
place; roles and texts are compared by MD5; an empty table gives no rows. A conversation
whose rows are all dropped has zeros, no edits and the hash of an empty string. Columns
other than the four named are not read.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import prepare, stored

SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3  # costs; CUT: a truncated row that stays
BLOCK = 1 << 16
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None)}
GIVEN = (USER, USER, ASSISTANT, USER)  # the state after a row whose role can be chosen
LETTERS = "DIKR"
FAULTS = ("blank", "duplicate", "truncated")
KEPT_SYSTEM = 1 << 8  # of a step: the system row is kept at the start
ORDER = ("dated", "turn", "role", "digest")  # rows of a conversation


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` with the planted damage: role, text, and how often each row stands there (``times``)."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(key.cast("binary")) % 20
    return rows.select(
        "conv_id", "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("times"),
    )


def _keyed(rows: DataFrame) -> DataFrame:
    """Columns that pandas keeps as they are, and the order of rows: nulls first."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    times = F.col("times") if "times" in rows.columns else F.lit(1)
    return rows.select(
        F.col("conv_id").cast("string").alias("conv"),
        F.col("turn").isNotNull().alias("dated"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        role.alias("role"),
        text.alias("text"),
        F.md5(text.cast("binary")).alias("digest"),
        times.cast("int").alias("times"),
    )


def _judged(rows: DataFrame) -> DataFrame:
    """Rows without text: initial and fault, repeats of other turns included."""
    end = F.rtrim("text", F.lit(SPACE))
    fault = F.when(end == "", "blank").when(~F.right(end, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    plain = stored(rows.select("conv", *ORDER, "times", fault.alias("fault")), "turns")
    when = F.struct("dated", "turn")
    firsts = plain.where("times > 0 AND fault != 'blank'").groupBy("conv", "role", "digest").agg(F.min(when).alias("first"), F.max(when).alias("last"))
    firsts = stored(firsts.where("first != last").select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first"), "repeats")
    same = plain["conv"].eqNullSafe(firsts["c"]) & (plain["role"] == firsts["r"]) & (plain["digest"] == firsts["d"]) & (plain["fault"] != "blank")
    again = F.col("first").isNotNull() & (when > F.col("first"))
    return plain.join(firsts, same, "left").select(
        "conv", *ORDER, "times", F.substring("role", 1, 1).alias("initial"), F.when(again, "duplicate").otherwise(F.col("fault")).alias("fault")
    )


class Costs:
    """Costs of repairing the rows that follow, by state, relative to the least; and the steps back."""

    def __init__(self):
        self.known: dict[tuple, tuple] = {}

    @staticmethod
    def end() -> tuple[int, ...]:
        return 0, 2 * INSERT, INSERT, 0

    @staticmethod
    def _step(after: tuple[int, ...], initial: str, fault: str) -> tuple:
        must, extra = fault in ("blank", "duplicate"), CUT if fault == "truncated" else 0
        options: list[dict[str, int]] = []
        for state in range(4):
            found = {"D": DELETE + after[state]}
            kept = NEXT.get(initial, (None,) * 4)[state]
            if not must and kept is not None:
                found["K"] = KEEP + extra + after[kept]
            if not must:
                found["R"] = REROLE + extra + after[GIVEN[state]]
            options.append(found)
        # at most two insertions help, and none comes back to its own state
        own = [min(o.values()) for o in options]
        best = own[:]
        best[USER] = min(own[USER], INSERT + own[ASSISTANT])
        best[ASSISTANT] = min(own[ASSISTANT], INSERT + own[USER])
        for state in (START, SYSTEM):
            best[state] = min(own[state], INSERT + best[USER])
        step = 0
        for state, found in enumerate(options):
            found["I"] = INSERT + best[GIVEN[state]]
            letter = min(c for c, cost in found.items() if cost == best[state])
            step |= LETTERS.index(letter) << 2 * state
            if state == START and letter == "K" and initial == "s":
                step |= KEPT_SYSTEM
        least = min(best)
        return tuple(b - least for b in best), least, step

    def before(self, after: tuple[int, ...], initial: str, fault: str) -> tuple:
        """Relative costs before a row, what the least of them adds, and the row's step."""
        key = (after, initial, fault)
        if key not in self.known:
            self.known[key] = self._step(*key)
        return self.known[key]


def walk(state: int, steps: array, letters: bytearray) -> int:
    """Follow rows' steps, the last row's first in ``steps``, from ``state``; adds the letters, returns the state."""
    for step in reversed(steps):
        while True:
            letter = LETTERS[step >> 2 * state & 3]
            letters.append(ord(letter))
            if letter == "D":
                break
            state = SYSTEM if letter == "K" and state == START and step & KEPT_SYSTEM else GIVEN[state]
            if letter != "I":
                break
    return state


def _ended(state: int, letters: bytearray) -> str:
    return (letters + b"I" * (Costs.end()[state] // INSERT)).decode()


class _Turns:
    """One conversation as it streams by from its last row to its first."""

    def __init__(self, conv: str | None, costs: Costs, block: int):
        self.conv, self.costs, self.block = conv, costs, block
        self.after, self.total, self.steps, self.spilled = Costs.end(), 0, array("H"), 0
        self.counts = dict.fromkeys(FAULTS, 0)
        self.illegal, self.later, self.held = 0, None, None
        self.turns = self.low = self.high = None

    def add(self, dated: bool, turn: int, role: str, digest: str, initial: str, fault: str) -> list[dict]:
        """The row that comes before the ones so far; returns what is spilled."""
        key = (dated, turn, role, digest)
        out = self._take(key) if self.held else []
        self.held = (key, initial, fault)
        if dated and self.low != turn:
            self.turns, self.low = (self.turns or 0) + 1, turn
            self.high = turn if self.high is None else self.high
        return out

    def _take(self, before: tuple | None) -> list[dict]:
        key, initial, fault = self.held
        if fault != "blank" and key == before:
            fault = "duplicate"
        if fault:
            self.counts[fault] += 1
        self.illegal += self.later is not None and initial + self.later not in ("su", "ua", "au")
        self.later = initial
        self.after, more, step = self.costs.before(self.after, initial, fault)
        self.total += more
        self.steps.append(step)
        return self._spill() if len(self.steps) == self.block else []

    def _row(self, block: int, audit: str | None, steps: bytes | None) -> dict:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        cost = self.total + self.after[START]
        return dict(conv=self.conv, block=block, audit=audit, steps=steps, gaps=gaps, **self.counts, illegal=self.illegal, cost=cost)

    def _spill(self) -> list[dict]:
        self.spilled += 1
        row = self._row(self.spilled, None, self.steps.tobytes())
        self.steps = array("H")
        return [row]

    def end(self) -> list[dict]:
        out = self._take(None) if self.held else []
        if self.spilled:
            return [*out, *self._spill(), self._row(0, None, None)]
        letters = bytearray()
        return [self._row(0, _ended(walk(START, self.steps, letters), letters), None)]


SUMMARY = ("gaps", *FAULTS, "illegal", "cost")
COLUMNS = ["conv", "block", "audit", "steps", *SUMMARY]
KINDS = "conv string, block int, audit string, steps binary, " + ", ".join(f"{c} long" for c in SUMMARY)


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=COLUMNS)


def audits(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv, audit and counts of every conversation of ``rows`` (as of ``_keyed``)."""

    def back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        costs, own = Costs(), None
        for batch in batches:
            out = []
            columns = (batch[c].tolist() for c in ("conv", *ORDER, "times", "initial", "fault"))
            for conv, dated, turn, role, digest, times, initial, fault in zip(*columns):
                if own is None or own.conv != conv:
                    out += own.end() if own else []
                    own = _Turns(conv, costs, block)
                for _ in range(times):
                    out += own.add(dated, turn, role, digest, initial, fault)
            yield _frame(out)
        if own:
            yield _frame(own.end())

    def forth(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, letters = START, bytearray()
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                if row["block"]:
                    state = walk(state, array("H", row["steps"]), letters)
                else:
                    out.append(row | {"audit": _ended(state, letters), "steps": None})
                    state, letters = START, bytearray()
            yield _frame(out)

    down = [F.col("conv"), F.desc("dated"), *[F.desc(c) for c in ORDER[1:]]]
    turns = _judged(rows).repartition("conv").sortWithinPartitions(*down)
    found = stored(turns.mapInPandas(back, KINDS), "repairs")
    long = found.where("audit IS NULL").repartition("conv").sortWithinPartitions("conv", F.desc("block"))
    return found.where("audit IS NOT NULL").union(long.mapInPandas(forth, KINDS)).drop("block", "steps")


class _Repaired:
    """Applies one conversation's letters to its rows, first row first."""

    NAMES = {USER: "user", ASSISTANT: "assistant"}

    def __init__(self, letters: str, put):
        self.letters, self.at, self.state, self.put = letters, 0, START, put

    def row(self, role: str, text: str) -> None:
        while True:
            letter = self.letters[self.at]
            self.at += 1
            if letter == "D":
                return
            if letter == "K":
                self.state = NEXT[role[0]][self.state]
                self.put(role, text)
                return
            self.state = GIVEN[self.state]
            self.put(self.NAMES[self.state], "" if letter == "I" else text)
            if letter == "R":
                return

    def end(self) -> None:
        for _ in self.letters[self.at :]:  # insertions
            self.state = GIVEN[self.state]
            self.put(self.NAMES[self.state], "")


def _applied(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's edits (kind 0), then its rows (kind 1), in their order."""
    texts = rows.where("times > 0").withColumn("kind", F.lit(1))
    both = found.withColumn("kind", F.lit(0)).unionByName(texts, allowMissingColumns=True)
    whole = ["turn", "times", *SUMMARY]
    filled = both.withColumns({c: F.coalesce(c, F.lit(0)) for c in whole} | {"dated": F.coalesce("dated", F.lit(False))})
    return filled.repartition("conv").sortWithinPartitions("conv", "kind", *ORDER)


def _parts(batch: pd.DataFrame) -> Iterator[tuple]:
    return zip(*(batch[c].tolist() for c in ("kind", "conv", "audit", "role", "text", "times")))


def repaired(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, place (from 0), role and text of every row of the repaired conversations."""
    prepare(rows.sparkSession)
    keyed = _keyed(rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, out, name = None, [], None

        def put(role: str, text: str) -> None:
            out.append((name, len(out) + done, role, text))

        done = 0
        for batch in batches:
            for kind, conv, audit, role, text, times in _parts(batch):
                if not kind:
                    if own:
                        own.end()
                    if out:
                        yield pd.DataFrame(out, columns=names)
                        out.clear()
                    own, name, done = _Repaired(audit, put), conv, 0
                else:
                    for _ in range(times):
                        own.row(role, text)
            if out:
                done += len(out)
                yield pd.DataFrame(out, columns=names)
                out.clear()
        if own:
            own.end()
            yield pd.DataFrame(out, columns=names)

    names = ["conv", "place", "role", "text"]
    found = _applied(keyed, audits(keyed, block)).mapInPandas(run, "conv string, place long, role string, text string")
    return found.select(F.col("conv").cast(rows.schema["conv_id"].dataType).alias("conv_id"), "place", "role", "text")


def repair(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, the counts, cost, audit and repaired_sha256 of every conversation of ``rows``."""
    prepare(rows.sparkSession)
    keyed = _keyed(rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, line = None, None

        def put(role: str, text: str) -> None:
            line["n"] += 1
            line["sha"].update(f"{chr(10) if line['n'] > 1 else ''}{role}:{text}".encode())

        def ended() -> dict:
            own.end()
            return line["row"] | {"repaired_sha256": line["sha"].hexdigest()}

        for batch in batches:
            out = []
            summaries = iter(batch.loc[batch["kind"] == 0, names[:-1]].to_dict("records"))
            for kind, _, audit, role, text, times in _parts(batch):
                if not kind:
                    if own:
                        out.append(ended())
                    line = {"n": 0, "sha": hashlib.sha256(), "row": next(summaries)}
                    own = _Repaired(audit, put)
                else:
                    for _ in range(times):
                        own.row(role, text)
            yield pd.DataFrame(out, columns=names)
        if own:
            yield pd.DataFrame([ended()], columns=names)

    names = ["conv", *SUMMARY, "audit", "repaired_sha256"]
    kinds = ", ".join(f"{c} {'long' if c in SUMMARY else 'string'}" for c in names)
    found = _applied(keyed, audits(keyed, block)).mapInPandas(run, kinds)
    return found.select(F.col("conv").cast(rows.schema["conv_id"].dataType).alias("conv_id"), *names[1:])
