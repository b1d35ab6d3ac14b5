"""Best-two-fit packing against one sequence after the other, and on odd rows."""

import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerspark.llm import packing


def one_by_one(lengths, capacity):
    """Contents of each sequence, by lists of what is left."""
    left, out = sorted(lengths, reverse=True), []
    while left:
        took, gap = [], capacity
        for x in list(left):
            if x <= gap:
                took.append(x)
                left.remove(x)
                gap -= x
        last, best = took[-1], None
        for i, x in enumerate(left):
            for y in left[i + 1 :]:
                if last < x + y <= gap + last and (best is None or (x + y, x) > (sum(best), best[0])):
                    best = (x, y)
        if best and gap:
            took.remove(last)
            left.append(last)
            for x in best:
                took.append(x)
                left.remove(x)
            left.sort(reverse=True)
        out.append(sorted(took, reverse=True))
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 24), max_size=60), st.integers(24, 40))
def test_runs_are_one_sequence_after_the_other(lengths, capacity):
    counts = np.bincount(np.array(lengths, int), minlength=capacity + 1)
    runs = packing.best_two_fit(counts, capacity)
    found = [sorted(Counter(took).elements(), reverse=True) for times, took in runs for _ in range(times)]
    assert found == one_by_one(lengths, capacity)


def test_a_pair_replaces_the_shortest():
    counts = np.bincount([6, 3, 2, 2, 5, 5], minlength=11)
    assert packing.best_two_fit(counts, 10)[0] == (1, {6: 1, 2: 2})


def check(df, rows, capacity):
    """Every document's pieces, whole, once, and sequences without gaps."""
    tok = Tokenizer.from_file(packing.VOCABULARY)
    tok.encode_special_tokens = True
    expected, held = Counter(), defaultdict(list)
    for r in df.select("doc_id", "text").collect():
        ids = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, packing.END]
        first = len(ids) % capacity or capacity
        bounds = [0, *range(first, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
            expected[r["doc_id"], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return held


def test_documents_are_packed(docs):
    rows = packing.pack(docs).collect()
    held = check(docs, rows, packing.CAPACITY)
    lengths = [r["length"] for r in rows]
    assert len(held) == len(one_by_one(lengths, packing.CAPACITY))
    assert len(held) <= 1.02 * -(-sum(lengths) // packing.CAPACITY) + 1


def test_ids_are_those_of_tokenizers():
    with open(packing.VOCABULARY, "rb") as f:
        own = packing.tokenizer(f.read())
    tok = Tokenizer.from_file(packing.VOCABULARY)
    tok.encode_special_tokens = True
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}b {c} 1{c}'s{c}. {c}{c}\n{c}x  {c}" for c in chars]
    texts += [" " * 70_000, "\n \t" * 9_000, "a" * 70_000, "<|endoftext|> it's we'LL", "ab c" * 20_000]
    for k in range(0, len(texts), 5000):
        part = texts[k : k + 5000]
        assert [own.encode_ordinary(t) for t in part] == [e.ids for e in tok.encode_batch_fast(part, add_special_tokens=False)]


def test_odd_rows(odd, clashing, none):
    for df in (odd, clashing):
        check(df, packing.pack(df, capacity=64).collect(), 64)
    empty = packing.pack(none)
    assert empty.collect() == [] and empty.columns[-2:] == ["sequence_id", "offset"]


def test_shares_of_many_tasks(docs):
    copies = docs.unionByName(docs.where("doc_id % 2 = 0")).repartition(13)
    check(copies, packing.pack(copies, capacity=128).collect(), 128)


def test_sequences_hold_the_ids(docs):
    rows = packing.sequences(docs.where("doc_id < 40")).collect()
    for r in rows:
        assert len(r["ids"]) == sum(d["length"] for d in r["documents"])
    pieces = {(r["doc_id"], r["piece"]): r for r in packing.pack(docs.where("doc_id < 40")).collect()}
    for r in rows:
        for d in r["documents"]:
            ids = np.array(r["ids"][d["offset"] : d["offset"] + d["length"]], "<u4")
            assert zlib.crc32(ids.tobytes()) == pieces[d["doc_id"], d["piece"]]["ids_crc32"]
    assert sum(len(r["documents"]) for r in rows) == len(pieces)


def test_only_lengths_reach_the_driver(docs):
    cut = packing.pieces(docs)
    assert cut.groupBy("length").agg(F.count("*")).count() <= packing.CAPACITY
