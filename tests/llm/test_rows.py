"""Operators that judge or store each text: media, quality, fertility, pieces."""

import base64
import hashlib
import math
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

from ledgerspark.llm import fertility, media, packing, pieces, quality

MODEL = open(pieces.MODEL, "rb").read()


def by_id(df):
    return {r["doc_id"]: r for r in df.where("doc_id is not null").collect()}


def assert_payloads(found, docs):
    texts = docs.where("doc_id is not null").collect()
    assert len(found) == len(texts)
    want = {}
    for r in texts:
        data = (r["text"] or "").encode()
        whole = data + b"\xff" * (-len(data) % 576 or (0 if data else 576))
        row = (len(data), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-32:]))
        want.setdefault(r["doc_id"], []).append(row)
    got = {}
    for r in found:
        got.setdefault(r["doc_id"], []).append((r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_media_round_trip(docs, clashing, none):
    assert_payloads(media.digest(docs).collect(), docs)
    odd = media.digest(clashing).where("doc_id is not null").collect()
    assert_payloads(odd, clashing)
    assert len({(r["media_sha256"], r["feature"]) for r in odd if r["doc_id"] >= 100}) == 1
    assert media.digest(none).collect() == []


def test_media_walks_files_of_other_shapes():
    """Own sizes per sample, 64-bit offsets and box sizes, no sync table, unknown boxes."""
    data = b"abc" + b"defg" + b"h"
    head = media.box(b"ftyp", b"isom") + media.box(b"free", b"x" * 5)

    def movie(at):
        table = media.box(
            b"stbl",
            media.full(b"stsd", struct.pack(">I", 1), media.box(b"twos", bytes(20))),
            media.full(b"stts", struct.pack(">5I", 2, 2, 10, 1, 5)),
            media.full(b"stsc", struct.pack(">7I", 2, 1, 2, 1, 2, 1, 1)),
            media.full(b"stsz", struct.pack(">2I3I", 0, 3, 3, 4, 1)),
            media.full(b"co64", struct.pack(">I2Q", 2, at, at + 7)),
        )
        times = media.box(b"mdhd", struct.pack(">B3xQQIQ", 1, 0, 0, 90, 25))
        return media.box(b"moov", media.box(b"trak", media.box(b"mdia", times, media.box(b"minf", table))))

    wide = lambda body: struct.pack(">I4sQ", 1, b"mdat", len(body) + 16) + body
    file = head + movie(len(head) + len(movie(0)) + 16) + wide(data)
    (track,) = media.tracks(memoryview(file))
    assert (track["codec"], track["timescale"], track["duration"]) == ("twos", 90, 25)
    assert [n for _, n, _ in track["samples"]] == [3, 4, 1] and all(k for _, _, k in track["samples"])
    assert media.payload(file) == data


def test_media_keyframes_and_damage(spark):
    file = media.container(media.padded(b"z" * 576 * 30))
    rows = [(1, 0, file), (2, 0, file[: len(file) // 3]), (3, 0, b""), (4, 0, None)]
    found = by_id(media.probe(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")))
    keys = [(k["start"], k["bytes"]) for k in found[1]["keyframes"]]
    start = file.index(b"zzzz")
    assert keys == [(start + k * 12 * 576, 576) for k in range(3)]
    assert found[1]["duration"] == 30 and found[1]["timescale"] == 25
    assert found[2]["codec"] is None and found[3]["codec"] is None and found[4]["media_bytes"] is None


def test_quality_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = quality.classify(docs, labels)
    assert scored.count() == docs.count()
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.97 * len(rows)


def test_quality_odd_rows(clashing, none, no_labels, spark):
    assert {(r["score"], r["predicted"]) for r in quality.classify(clashing, no_labels).collect()} == {(0.5, 1)}
    assert quality.classify(none, no_labels).collect() == []
    some = [(3, 1, 0), (3, 0, 0), (6, None, 1), (None, 1, 0), (10, 0, 0), (13, 1, 0), (99, 0, 0)]
    labels = spark.createDataFrame(some, "doc_id long, quality int, toxic int")
    scored = quality.classify(clashing, labels)
    assert scored.count() == clashing.count()
    assert all(0 <= r["score"] <= 1 for r in scored.collect())
    kept = quality.keep_good(clashing, labels)
    assert kept.columns == clashing.columns
    good = scored.where("predicted = 1").count()
    assert kept.count() == good


def test_quality_is_blind_to_other_columns(docs, labels):
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("s"))
    a, b = (by_id(quality.classify(d, labels)) for d in (docs, other))
    assert all(a[k]["score"] == pytest.approx(b[k]["score"], abs=1e-9) for k in a)


def test_isotonic_pools_violators():
    at, level = quality.isotonic(np.arange(5.0), np.array([1, 1, 2, 1, 1.0]), np.array([0, 1, 0, 1, 1.0]))
    assert level.tolist() == pytest.approx([0, 1 / 3, 1, 1][: len(level)]) or (np.diff(level) >= 0).all()
    assert (np.diff(at) > 0).all()


def plain_counts(text):
    text = text or ""
    words = text.encode().split()
    grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    covered = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    return (
        len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), dup, len(covered),
    )


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_fertility_counts(docs, clashing, none):
    for df in (docs.where("length(text) < 6000"), clashing.where("coalesce(length(text), 0) < 6000")):
        texts = [(r["doc_id"], plain_counts(r["text"])) for r in df.collect()]
        rows = fertility.judge(df).collect()
        key = lambda x: (x[0] is not None, x)
        assert sorted(((r["doc_id"], tuple(r[c] for c in COUNTS)) for r in rows), key=key) == sorted(texts, key=key)
        for r in rows:
            assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
            assert not (r["base_failed"] and r["kept"])
    assert fertility.judge(none).collect() == []


def test_fertility_measures_and_bands(spark):
    plain = [(k, " ".join(f"the{j} word number{k + j} is here{j}" for j in range(14 + k % 5)), "en") for k in range(60)]
    odd = [(900, " ".join("漢☃𓀀𓁐"[j % 4] * 3 + str(j) for j in range(90)), "en")]
    df = spark.createDataFrame(plain + odd, "doc_id long, text string, lang string")
    found = by_id(fertility.judge(df))
    sp = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    for k, text, _ in plain[:3] + odd:
        ids = sp.encode(text)
        assert found[k]["chars_per_token"] == pytest.approx(len(text) / len(ids))
        assert found[k]["byte_share"] == pytest.approx(sum(sp.is_byte(i) for i in ids) / len(ids))
    assert not found[900]["kept"] and not found[900]["base_failed"]
    assert sum(found[k]["kept"] for k, _, _ in plain) == 60


def plain_entropy(ids, size):
    p = [n / len(ids) for n in Counter(ids).values()]
    most = math.log2(min(len(ids), size))
    return -sum(x * math.log2(x) for x in p) / (most or 1.0)


def plain_bands(rows, values):
    """Quartiles by rank, widened, for each group of 20 or more and for all."""
    out = {}
    for name in {g for g, _ in rows} | {None}:
        own = [m for g, m in rows if name in (None, g)]
        if name is None or len(own) >= fertility.FEW:
            out[name] = {}
            for k, m in enumerate(values):
                v = sorted(x[k] for x in own)
                low, high = (v[max(0, math.ceil(q * len(v)) - 1)] for q in (0.25, 0.75))
                room = max((high - low) * fertility.REACH, fertility.LEAST[m])
                out[name][m] = (low - room, high + room)
    return out


def test_fertility_against_plain_bands(docs):
    df = docs.where("length(text) < 6000")
    sp = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    with open(fertility.MULTI, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())}
    many = tiktoken.Encoding("own", pat_str=packing.PATTERN, mergeable_ranks=ranks, special_tokens={})
    measured = {}
    for r in df.collect():
        ids, other = sp.encode(r["text"] or ""), many.encode_ordinary(r["text"] or "")
        if ids:
            n = len(r["text"])
            share = sum(sp.is_byte(i) for i in ids) / len(ids)
            measured[r["doc_id"]] = (
                r["lang"], (n / len(ids), share, plain_entropy(ids, sp.vocab_size()), n / len(other), plain_entropy(other, many.n_vocab)),
            )
    bands = plain_bands(list(measured.values()), fertility.MEASURES)
    found = by_id(fertility.judge(df))
    assert set(found) >= set(measured)
    for k, r in found.items():
        if k not in measured:
            assert not r["kept"]
            continue
        lang, values = measured[k]
        assert [r[m] for m in fertility.MEASURES] == pytest.approx(list(values))
        own = bands.get(lang, bands[None])
        fits = all(own[m][0] <= v <= own[m][1] for m, v in zip(fertility.MEASURES, values))
        assert r["kept"] == (fits and not r["base_failed"])
    assert {r["kept"] for r in found.values()} == {True, False}


def test_ridge_against_dense_equations(docs, labels):
    rows = quality.describe(docs).join(labels.where("quality is not null").selectExpr("doc_id", "double(quality) as label"), "doc_id")
    model = quality.fit(rows)
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(quality.FOLDS)) == 0
    stats, y, held = (np.array(c) for c in zip(*rows.select("stats", "label", fold).collect()))
    mean, scale = stats.mean(0), stats.std(0)
    assert model.mean == pytest.approx(mean, abs=1e-5)
    z = model.features(stats)[~held]
    left = z.T @ z
    room = np.full(len(left), quality.RIDGE / 100 * np.trace(left) / len(left) + 1e-9)
    room[-1] = 1e-9
    assert model.weights == pytest.approx(np.linalg.solve(left + np.diag(room), z.T @ y[~held]), abs=1e-5)
    assert (np.diff(model.level) >= 0).all()
    want = np.clip(np.interp(model.features(stats) @ model.weights, model.at, model.level), 0, 1)
    got = quality.apply(rows.select("doc_id", "stats"), model).collect()
    assert sorted(r["score"] for r in got) == pytest.approx(sorted(want), abs=1e-6)


def test_isotonic_is_the_best_monotone_fit():
    rnd = np.random.default_rng(1)
    n, ones = rnd.integers(1, 9, 40).astype(float), np.zeros(40)
    ones = np.floor(rnd.random(40) * (n + 1))
    centres, levels = quality.isotonic(np.arange(40.0), n, ones)
    mean = lambda i, j: ones[i : j + 1].sum() / n[i : j + 1].sum()
    want = [max(min(mean(i, j) for j in range(k, 40)) for i in range(k + 1)) for k in range(40)]
    assert levels == pytest.approx(sorted(set(np.round(want, 12))))
    assert (np.diff(centres) > 0).all()


TEXTS = ["", "a", "  two  spaces ", "ünï 漢字 🙂\n\ttab", "a" * 700, "▁lit ▁▁ eral", "x  ", "<s> </s> <0x41>", "\x00 nul", "The quick brown fox, 1234 jumps!"]


def test_pieces_without_dropout_are_the_vocabularys_own():
    own, sp = pieces.Pieces(MODEL, 0.0, 1), sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    for text, tokens in zip(TEXTS, own.encode(TEXTS, ["k"] * len(TEXTS))):
        if not {"▁", "\0"} & set(text):  # the sign itself and nul, which the library loses
            assert tokens.tolist() == sp.encode(text)
        assert own.decode(tokens.tolist()) == text


def test_pieces_heap_and_steps_agree(monkeypatch):
    a = pieces.Pieces(MODEL, 0.2, 5).encode(TEXTS, ["k"] * len(TEXTS))
    monkeypatch.setattr(pieces, "TOGETHER", 0)
    b = pieces.Pieces(MODEL, 0.2, 5).encode(TEXTS, ["k"] * len(TEXTS))
    assert [x.tolist() for x in a] == [x.tolist() for x in b]


def test_pieces_vary_and_repeat():
    own = pieces.Pieces(MODEL, 0.3, 5)
    text = "internationalisation of unbelievable segmentation " * 20
    a, b, c = (own.encode([text], [k])[0].tolist() for k in ("1", "2", "1"))
    assert a == c and a != b and own.decode(a) == own.decode(b) == text
    monotone = pieces.Pieces(MODEL, 0.0, 5).encode([text], ["1"])[0]
    assert len(monotone) < len(a)
    assert pieces.Pieces(MODEL, 0.3, 6).encode([text], ["1"])[0].tolist() != a


def test_pieces_of_each_occurrence_have_draws_of_their_own():
    """A frequent word is cut as often and in as many ways as free draws cut it."""
    word, n = "unbelievable", 3000
    own = pieces.Pieces(MODEL, 0.1, 5)
    whole = tuple(pieces.Pieces(MODEL, 0.0, 5).encode([word], ["1"])[0].tolist())
    sp = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    free = [tuple(sp.encode(word, enable_sampling=True, alpha=0.1, nbest_size=-1)) for _ in range(n)]
    cuts = [tuple(own.encode([word], [str(k)])[0].tolist()) for k in range(n)]
    assert len(set(cuts)) > 10
    for cut in {whole, *(c for c in free if free.count(c) > 100)}:  # the library's own merge dropout
        assert abs(cuts.count(cut) - free.count(cut)) / n < 0.05
    together = own.encode([" ".join([word] * n)], ["1"])[0].tolist()
    assert own.decode(together) == " ".join([word] * n)
    again = pieces.Pieces(MODEL, 0.1, 5).encode([word] * n, [str(k) for k in range(n)])
    assert [tuple(x.tolist()) for x in again] == cuts  # what was kept before has no part in it


def test_pieces_of_a_shared_hash_are_cut_again(monkeypatch):
    own = pieces.Pieces(MODEL, 0.1, 1)
    monkeypatch.setattr(pieces, "_POWERS", np.zeros(4, np.uint64))  # units of one length collide
    texts = ["some words differ", "more terms differ"]
    assert [own.decode(t.tolist()) for t in own.encode(texts, ["1", "2"])] == texts


def test_pieces_table(docs, clashing, none):
    for df in (docs, clashing):
        rows = pieces.round_trip(df).collect()
        assert len(rows) == df.count() and all(r["lossless"] for r in rows)
        assert all(r["n_tokens"] == 0 for r in rows if not r["n_bytes"])
    coded = pieces.decode(pieces.encode(clashing))
    assert set(coded.columns) == {*clashing.columns}
    assert coded.where("not (text <=> decoded)").count() == 0
    assert pieces.round_trip(none).collect() == []
