"""Operators whose result for a text hangs on all texts: model, windows, fingerprints."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerspark.llm import katz, nearcopies, simhash, substrings
from ledgerspark.llm.words import hashes, raw, split

K = katz.K


def rows_of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def plain_discount(of_count):
    """Good-Turing discounts from counts of counts, or one amount off each count."""
    d = katz.Discount(of_count).d
    return lambda r: d[min(r, K + 1)] * r


def plain_katz(docs):
    """Scores by dictionaries; also checks that histories sum to one."""
    texts = [(i, [*(t or "").encode().lower().split(), None]) for i, t in docs]
    out = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in texts]
    words, pairs = Counter(), Counter()
    for held, (_, w) in zip(out, texts):
        if not held:
            words.update(w)
            pairs.update(zip([0, *w[:-1]], w))
    total, distinct = sum(words.values()), len(words)
    of = lambda c: [sum(1 for x in c.values() if x == r) for r in range(1, K + 2)]
    kept1, kept2 = plain_discount(of(words)), plain_discount(of(pairs))
    lost = sum(r - kept1(r) for r in words.values())
    whole1 = total if lost > 0 else total + 1
    unknown = (lost if lost > 0 else 1) / whole1
    p1 = lambda w: kept1(words[w]) / whole1 if w in words else unknown
    after = defaultdict(list)
    for (v, w), r in pairs.items():
        after[v].append((w, r))
    whole, alpha = {}, {}
    for v, seen in after.items():
        c, gone = sum(r for _, r in seen), sum(r - kept2(r) for _, r in seen)
        whole[v] = c if gone > 1e-12 else c + 1
        alpha[v] = (gone if gone > 1e-12 else 1) / whole[v] / (1 - sum(p1(w) for w, _ in seen))

    def p2(v, w):
        return kept2(pairs[v, w]) / whole[v] if (v, w) in pairs else alpha.get(v, 1.0) * p1(w)

    for v in list(after)[:4]:
        assert sum(p2(v, w) for w in words) + alpha[v] * unknown == pytest.approx(1, abs=1e-9)
    found = []
    for held, (i, w) in zip(out, texts):
        base = sum(math.log10((words[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in w)
        score = sum(math.log10(p2(v, x)) for v, x in zip([0, *w[:-1]], w))
        found.append((i, held, len(w), sum(x in words for x in w), total, round(base, 6), round(score, 6)))
    return found


ROW = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def assert_scores(df, docs):
    got, want = in_order(rows_of(df, *ROW)), in_order(plain_katz(rows_of(docs, "doc_id", "text")))
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-6, abs=1e-5)


def test_katz_is_the_dictionary_model(docs):
    assert_scores(katz.score_held_out(docs), docs)


def test_katz_by_buckets_alone(docs, monkeypatch):
    """With hardly any frequent words or pairs all goes through the buckets."""
    monkeypatch.setattr(katz, "HEAD_WORDS", 20)
    monkeypatch.setattr(katz, "HEAD_PAIRS", 10)
    monkeypatch.setattr(katz, "SHARE", 20_000)
    monkeypatch.setattr(katz, "FLUSH", 2_000)
    assert_scores(katz.score_held_out(docs), docs)


def test_katz_odd_rows(clashing):
    assert_scores(katz.score_held_out(clashing), clashing)


def test_katz_without_rows(none):
    assert katz.score_held_out(none).collect() == []


def test_katz_learns_from_no_row(spark):
    ids = [k for k in range(400) if zlib.crc32(str(k).encode()) % 10 == 0]
    df = spark.createDataFrame([(ids[0], "a b"), (ids[1], None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_tokens"], r["n_known"], r["train_tokens"], r["score"]) for r in katz.score_held_out(df).collect()}
    assert got == {ids[0]: (3, 0, 0, 0.0), ids[1]: (1, 0, 0, 0.0)}


def plain_windows(docs):
    first, found = {}, []
    for i, t in docs:
        w = (t or "").encode().split()
        for k in range(len(w) - 12):
            if i is not None:
                key = tuple(w[k : k + 13])
                first[key] = min(first.get(key, i), i)
    for i, t in docs:
        w = (t or "").encode().split()
        gone = set()
        for k in range(len(w) - 12):
            if i is not None and first[tuple(w[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        kept = [x for k, x in enumerate(w) if k not in gone]
        found.append((i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return found


SPANS = ("doc_id", "n_words", "n_removed", "kept_sha256")


@pytest.mark.parametrize("options", [{}, {"share": 20_000}, {"share": 40_000, "room": 1_500}])
def test_windows_against_a_dictionary(docs, options):
    """Also with many buckets, and with buckets that are grouped window by window."""
    want = in_order(plain_windows(rows_of(docs, "doc_id", "text")))
    assert in_order(rows_of(substrings.report(docs, **options), *SPANS)) == want


def test_windows_odd_rows(clashing, none):
    want = in_order(plain_windows(rows_of(clashing, "doc_id", "text")))
    assert in_order(rows_of(substrings.report(clashing), *SPANS)) == want
    assert substrings.report(none).collect() == []


def test_windows_of_one_hash_are_told_apart(docs, monkeypatch):
    """Were all window hashes equal, the bytes would still decide."""
    monkeypatch.setattr(substrings, "mixed", lambda x: x & 3 if x.dtype.kind == "u" else x)
    want = in_order(plain_windows(rows_of(docs, "doc_id", "text")))
    assert in_order(rows_of(substrings.report(docs), *SPANS)) == want


def test_clean_keeps_columns_and_untouched_texts(clashing):
    out = substrings.clean(clashing)
    assert out.columns == clashing.columns
    texts = {r["doc_id"]: r["text"] for r in out.where("doc_id is not null").collect()}
    assert texts[4] == "One two" and texts[1] == "" and texts[2] == "   \n\t "
    assert texts[0] is None
    assert texts[6].startswith("shared0") and 7 in texts
    assert 8 not in texts  # wholly of an earlier document's windows


def plain_fingerprint(text, width=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    parts = [b" ".join(w[k : k + width]) for k in range(max(1, len(w) - width + 1))]
    hs = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(docs, radius=3):
    prints = [plain_fingerprint(t) for _, t in docs]
    distinct = sorted(set(prints))
    root = {p: p for p in distinct}

    def top(p):
        while root[p] != p:
            p = root[p]
        return p

    for k, a in enumerate(distinct):
        for b in distinct[:k]:
            if (a ^ b).bit_count() <= radius:
                root[max(top(a), top(b))] = min(top(a), top(b))
    least = {}
    for (i, _), p in zip(docs, prints):
        if i is not None:
            least[top(p)] = min(least.get(top(p), i), i)
    return [(i, f"{p:016x}", least.get(top(p))) for (i, _), p in zip(docs, prints)]


PRINTS = ("doc_id", "fingerprint", "component_id")


def near_family(spark):
    """Fingerprints within and beyond the radius come from texts with one word changed."""
    words = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(60):
        w = list(words)
        w[k * 5 % 300] = f"new{k % 7}"
        rows.append((1000 + k, " ".join(w)))
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("limit", [4096, 16])
def test_components_against_all_pairs(spark, docs, limit):
    df = docs.select("doc_id", "text").union(near_family(spark))
    want = in_order(plain_components(rows_of(df, "doc_id", "text")))
    assert in_order(rows_of(simhash.near_duplicates(df, limit=limit), *PRINTS)) == want
    assert len({c for _, _, c in want}) < len({p for _, p, _ in want})  # some differ and link


def test_components_odd_rows(clashing, none):
    want = in_order(plain_components(rows_of(clashing, "doc_id", "text")))
    assert in_order(rows_of(simhash.near_duplicates(clashing), *PRINTS)) == want
    assert simhash.near_duplicates(none).collect() == []


def test_one_row_of_a_group_stays(clashing):
    kept = simhash.keep_one(clashing)
    assert kept.columns == clashing.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert [i for i in ids if i is not None and i >= 100] == [100]
    assert 0 in ids and 1 not in ids and 2 not in ids  # fingerprint zero is one group


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_covering_masks(radius):
    from itertools import combinations

    masks = simhash.cover(radius=radius)
    assert len(masks) == (1 << (radius + 1)) - 1
    for places in combinations(range(0, 64, 3), radius):
        difference = sum(1 << p for p in places)
        assert any(not m & difference for m in masks)


def test_words_in_bytes():
    import numpy as np
    import pyarrow as pa

    texts = ["a  b\tc", "", None, "\n x", "y", " \x0b", "zz\x0c\rq"]
    data, ends = raw(pa.array(["skipped", *texts])[1:])
    starts, stops, text = split(data, ends)
    words = [(int(t), data[a:b].tobytes()) for a, b, t in zip(starts, stops, text)]
    assert words == [(k, w) for k, t in enumerate(texts) for w in (t or "").encode().split()]
    assert len(np.unique(hashes(data, starts, stops))) == len(words)


def shingles(text, width=5):
    words = text.encode().lower().split()
    return [b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))] if words else []


def plain_copies(docs):
    """Component of each row by the Jaccard similarity of all pairs of five-word sets."""
    sets = [frozenset(shingles(t or "")) for _, t in docs]
    distinct = list(dict.fromkeys(sets))
    root = {s: s for s in distinct}

    def top(s):
        while root[s] is not s:
            s = root[s]
        return s

    for k, a in enumerate(distinct):
        for b in distinct[:k]:
            if 4 * max(len(a), len(b)) <= 5 * min(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b):
                root[top(a)] = top(b)
    least = {}
    for (i, _), s in zip(docs, sets):
        if i is not None:
            least[top(s)] = min(least.get(top(s), i), i)
    return [(i, least.get(top(s))) for (i, _), s in zip(docs, sets)]


def chain_family(spark):
    """Texts that differ by ever more words: neighbours are near copies, the ends are not."""
    base, rows = [f"v{k}" for k in range(120)], []
    for k in range(40):
        w = list(base)
        w[: k * 3] = [f"z{j}" for j in range(k * 3)]
        rows.append((2000 + k * 7 % 40, " ".join(w)))
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("options", [{}, {"sample": 1, "often": 2}])
def test_near_copies_against_all_pairs(spark, docs, options):
    df = docs.select("doc_id", "text").union(near_family(spark)).union(chain_family(spark))
    want = in_order(plain_copies(rows_of(df, "doc_id", "text")))
    assert in_order(rows_of(nearcopies.near_copies(df, **options), "doc_id", "component_id")) == want
    assert {c for i, c in want if i >= 2000} == {2000}


def crowd(spark):
    """Copies of one text with ever more changes: some near its middle, some near only to few others."""
    rnd, rows = random.Random(3), []
    base = [f"c{k}" for k in range(150)]
    for k in range(260):
        w = list(base)
        for _ in range(k // 26):
            w[rnd.randrange(150)] = f"x{k if k % 3 else k // 9}"
        rows.append((3000 + k, " ".join(w)))
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("most", [40, 2048])
def test_crowds_of_near_copies(spark, docs, monkeypatch, most):
    monkeypatch.setattr(nearcopies, "MOST", most)
    df = docs.select("doc_id", "text").where("doc_id < 50").union(crowd(spark))
    want = in_order(plain_copies(rows_of(df, "doc_id", "text")))
    assert in_order(rows_of(nearcopies.near_copies(df), "doc_id", "component_id")) == want
    assert len({c for i, c in want if i >= 3000}) > 20


def test_pairs_of_a_crowd_do_not_grow_with_its_square(spark):
    met = nearcopies._met(nearcopies._prefixes(crowd(spark), np.array([], np.int64)).withColumnRenamed("doc_id", "first"))
    rows = met.select("shingle", "node", "n", "place", F.col("node").alias("root"), F.lit(1).alias("parts"), F.lit(0).alias("part"))
    sketches = nearcopies._prefixes(crowd(spark), np.array([], np.int64)).select("node", "sketch")
    members = rows.select("node").distinct().count()
    rows = rows.join(sketches, "node")
    assert nearcopies._candidates(rows, True).count() <= rows.select("shingle").distinct().count() * members
    # far fewer come out than meet
    assert nearcopies._candidates(rows, False).count() < 0.6 * members * (members - 1) / 2


@pytest.mark.parametrize("size", [1, 2, 3, 50])
def test_rows_with_a_key_of_their_own_go(size):
    rnd = random.Random(size)
    keys = sorted(rnd.randrange(60) for _ in range(70))
    rows = pa.record_batch([pa.array(keys), pa.array(range(70))], ["key", "row"])
    found = [r["row"] for b in nearcopies._repeated(rows.slice(k, size) for k in range(0, 70, size)) for r in b.to_pylist()]
    assert found == [k for k, key in enumerate(keys) if keys.count(key) > 1]


def test_sketches_lose_no_pair():
    rnd = random.Random(5)
    for _ in range(300):
        one = rnd.sample(range(10**9), rnd.randint(1, 400))
        two = [*one[rnd.randint(0, len(one) // 9 + 1) :], *rnd.sample(range(10**9), rnd.randint(0, len(one) // 9 + 1))] or [1]
        a, b = (np.unique(np.array(x, np.int64)) for x in (one, two))
        if 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b)):
            w1, w2 = (nearcopies._words(pa.array([nearcopies._sketch(x, nearcopies.BITS)]))[0] for x in (a, b))
            assert nearcopies._near(len(a), w1, len(b), w2)
            w1, w2 = map(nearcopies._wide, (a, b))
            size = min(len(w1), len(w2))
            assert nearcopies._near(len(a), nearcopies._folded(w1, size), len(b), nearcopies._folded(w2, size))


def test_long_words_have_hashes_of_their_own():
    a, b = b"ab" * 2048, b"cd" * 2048
    texts = [x.decode() for x in (a + b, b + a, a + b, a + b + a, a + a + b)]
    data, ends = raw(pa.array(texts))
    starts, stops, _ = split(data, ends)
    found = hashes(data, starts, stops).tolist()
    assert found[0] == found[2] and len(set(found)) == 4


def test_katz_with_long_words_of_swapped_halves(spark):
    a, b = "ab" * 2048, "cd" * 2048
    rows = [(k, f"one {a + b if k % 3 else b + a} two {'q' * 9000 if k % 2 else 'q' * 9001}") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert_scores(katz.score_held_out(df), df)


def test_near_copies_odd_rows(clashing, none):
    want = in_order(plain_copies(rows_of(clashing, "doc_id", "text")))
    assert in_order(rows_of(nearcopies.near_copies(clashing), "doc_id", "component_id")) == want
    assert nearcopies.near_copies(none).collect() == []


def test_the_pipeline_drops_near_copies_of_five_words(spark):
    """A copy with one word in sixty changed differs in more than three bits of op5's fingerprint."""
    import corpus_pipeline

    words = [f"w{k}" for k in range(60)]
    other = [*words[:30], "changed", *words[31:]]
    apart = plain_fingerprint(" ".join(words)) ^ plain_fingerprint(" ".join(other))
    assert apart.bit_count() > 3
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, "quite another text")], "doc_id long, text string")
    kept = corpus_pipeline.one_of_near_copies(spark, df, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


def test_simhash_links_near_copies_without_shared_prefixes(spark, monkeypatch):
    met = nearcopies._met
    monkeypatch.setattr(nearcopies, "_met", lambda classes: met(classes).limit(0))
    words = [f"w{k * k % 7919}x{k}" for k in range(6000)]
    texts = [" ".join(words), " ".join([*words[:-1], "changed"]), " ".join(words[:40]), None]
    docs = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in nearcopies.near_copies(docs).collect()}
    assert found == {1: 1, 2: 1, 3: 3, 4: 4}
