"""Repair of conversations against a search over all edits, and on odd rows."""

import heapq
import random
import re
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from ledgerspark.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string"
GAP = re.compile(r"[^\x20\x09-\x0D]")


def damage(rows):
    convs = defaultdict(list)
    for r in rows:
        conv, turn, role, text = (r[c] for c in ("conv_id", "turn", "role", "text"))
        own = convs[conv]
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        own += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return convs


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        shown = GAP.findall(text)
        if not shown:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, marks):
    """Least (cost, initials) by search over rows done and roles so far; the edits' result."""
    n = len(rows)
    heap, done = [(0, "", 0, "", ())], {}
    while heap:
        cost, audit, at, last, made = heapq.heappop(heap)
        if at == n and last in ("", "a"):
            return cost, audit, made
        if done.setdefault((at, last), (cost, audit)) < (cost, audit):
            continue

        def go(more, letter, row, role, name=None):
            if role is None or (last == "" and role in "su") or (last in ("s", "a") and role == "u") or (last == "u" and role == "a"):
                new = made if row is None else (*made, row)
                heapq.heappush(heap, (cost + more, audit + letter, at + (letter != "I"), last if role is None else role, new))

        for name in ("user", "assistant"):
            if cost < 200:
                go(3, "I", f"{name}:", name[0])
        if at < n:
            _, role, text = rows[at]
            extra = 3 if marks[at] == "truncated" else 0
            go(4, "D", None, None)
            if marks[at] not in ("blank", "duplicate"):
                if role[:1] in ("s", "u", "a"):
                    go(extra, "K", f"{role}:{text}", role[0])
                for name in ("user", "assistant"):
                    go(3 + extra, "R", f"{name}:{text}", name[0])


def plain(rows):
    convs = damage(rows)
    out = {}
    for conv, own in convs.items():
        own = sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), sha256(r[2].encode()).digest()))
        marks = faults(own)
        turns = {t for t, _, _ in own if t is not None}
        cost, audit, made = cheapest(own, marks)
        bad = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        counts = [marks.count(f) for f in ("blank", "duplicate", "truncated")]
        out[conv] = (gaps, *counts, bad, cost, audit, sha256("\n".join(made).encode()).hexdigest())
    return out


def found(df, **options):
    rows = C.repair(C.damaged(df), **options).collect()
    out = {r[0]: tuple(r[1:]) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.fixture(scope="module")
def made(spark):
    """Conversations of distinct turns with every kind of fault, some null ids and turns, some dropped whole."""
    rnd = random.Random(7)
    words = ["Yes.", "No?", "well", "", "  \n", "Done! \t", "again.", "x" * 3000 + ".", "ünï?", None]
    rows = []
    for conv in [None, *range(150)]:
        turns = rnd.sample(range(-3, 14), rnd.randint(1, 9))
        turns = [None, *turns] if rnd.random() < 0.2 else turns
        for t in turns:
            rows.append((conv, t, rnd.choice(["system", "user", "assistant", "tool", "", None, "user", "assistant"]), rnd.choice(words)))
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def test_edits_against_search(made):
    assert found(made) == plain(made.collect())


def test_spilled_steps_give_the_same(made):
    assert found(made, block=2) == found(made)


def test_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert found(df) == plain(df.collect())


def test_long_conversation_over_many_batches(spark):
    rows = [(1, k, "user" if k % 3 else "assistant", f"text {k // 2}{'.' if k % 5 else ''}") for k in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        whole, spilled = found(df), found(df, block=64)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert whole == spilled and len(whole[1][6]) >= 2500


def test_repaired_rows_are_right(made):
    damaged = C.damaged(made)
    rows = C.repaired(damaged).collect()
    convs = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["place"]):
        convs[r["conv_id"]].append(r)
    digests = {k: v[-1] for k, v in found(made).items()}
    for conv, own in convs.items():
        assert [r["place"] for r in own] == list(range(len(own)))
        assert re.fullmatch("s?(ua)+", "".join(r["role"][0] for r in own))
        assert sha256("\n".join(f"{r['role']}:{r['text']}" for r in own).encode()).hexdigest() == digests[conv]
    assert all(digests[c] == sha256(b"").hexdigest() for c in set(digests) - set(convs))


def test_odd_tables(spark, made):
    empty = C.repair(C.damaged(spark.createDataFrame([], SCHEMA)))
    assert empty.collect() == [] and empty.columns[-1] == "repaired_sha256"
    assert C.repaired(spark.createDataFrame([], SCHEMA)).collect() == []
    extra = [F.lit("own").alias(c) for c in ("conv", "digest", "fault", "kind", "audit", "dated", "steps", "first")]
    assert found(made.select("*", *extra)) == found(made)
    twice = made.unionByName(made)  # repeated rows are duplicates of themselves
    assert found(twice) == plain(twice.collect())


def test_nothing_but_nulls(spark):
    df = spark.createDataFrame([(None, None, None, None)], SCHEMA)
    assert found(df) == plain(df.collect())
