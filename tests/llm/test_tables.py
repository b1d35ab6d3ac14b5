"""Operators over whole tables: mixing, sharding, URL templates, the pipeline, the registry."""

import hashlib
import math
import random
import time
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerspark.llm import mixing, queries, sharding, urls


def plain_mix(docs):
    sizes = [(r["doc_id"], r["source"], len((r["text"] or "").encode().split())) for r in docs.collect()]
    total = defaultdict(int)
    for _, s, n in sizes:
        total[s] += n
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, open_ = {}, set(order)
    rest = sum(total.values())
    while open_:
        share = rest / sum(weight[s] for s in open_)
        full = {s for s in open_ if 3 * total[s] < share * weight[s]}
        if not full:
            target |= {s: min(share * weight[s], 3.0 * total[s]) for s in open_}
            break
        target |= {s: 3.0 * total[s] for s in full}
        rest -= sum(3 * total[s] for s in full)
        open_ -= full
    out = []
    for i, s, n in sizes:
        rate = target[s] / total[s] if total[s] else 0.0
        seed = f"mix-1:{'null' if i is None else i}"
        coin = int(hashlib.md5(seed.encode()).hexdigest()[:8], 16) / 2**32
        out.append((i, n, total[s], round(target[s], 6), n * (int(rate) + (coin < rate - int(rate)))))
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


MIX = ("doc_id", "size", "source_size", "target", "taken")


def mix_rows(df):
    return order((*r[:3], round(r[3], 6), r[4]) for r in df.select(*MIX).collect())


def test_mix_against_a_loop(docs, clashing, none):
    for df in (docs, clashing):
        assert mix_rows(mixing.mix(df)) == order(plain_mix(df))
    assert mixing.mix(none).collect() == []


def test_mix_targets_stop_at_three_times(spark):
    rows = [(k, "w " * (100 if k % 3 else 5), f"s{k % 3}") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(df)
    assert mix_rows(found) == order(plain_mix(df))
    assert all(r["taken"] <= 3 * r["size"] for r in found.collect())
    small = [r for r in found.collect() if r["source_size"] == 100]
    assert {r["target"] for r in small} == {300.0} and all(r["taken"] == 15 for r in small)


def test_emit_is_what_mix_takes(clashing):
    taken = Counter()
    for r in mixing.mix(clashing).collect():
        taken[r["doc_id"]] += r["taken"]
    got = Counter()
    emitted = mixing.emit(clashing)
    assert emitted.columns == clashing.columns
    for r in emitted.collect():
        got[r["doc_id"]] += len((r["text"] or "").encode().split())
    assert +got == +taken


def assert_sharded(df, found, most_apart):
    rows = found.collect()
    assert len(rows) == df.count()
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in df.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    sizes, slots = Counter(), defaultdict(list)
    for r in rows:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 8
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    assert max(sizes.values()) - min(sizes[k] for k in range(8)) <= most_apart
    return rows


def test_shards_are_even_and_keep_copies_together(spark, clashing, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = assert_sharded(docs, sharding.shard(docs), 2500)
    shards = defaultdict(Counter)
    for r in rows:
        shards[r["text_crc32"], r["size"]][r["shard"]] += 1
    copies = [c for c in shards.values() if sum(c.values()) > 1]
    apart = sum(sum(c.values()) - max(c.values()) for c in copies)
    assert apart <= 0.1 * sum(sum(c.values()) for c in copies)
    longest = max(len((r["text"] or "").encode()) for r in clashing.collect())
    assert_sharded(clashing, sharding.shard(clashing), 2 * longest)
    assert sharding.shard(none).collect() == []


def test_a_class_larger_than_a_shard_is_cut(spark):
    df = spark.createDataFrame([(k, "same text in most rows" if k % 3 else f"own text {k} of a row") for k in range(900)], "doc_id long, text string")
    assert_sharded(df, sharding.shard(df), 400)


def plain_rule(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        rest = rest[cut:]
        path = rest[: min([rest.index(c) for c in "?#" if c in rest], default=len(rest))]
    fits = []
    for rule, verdict in urls.RULES:
        name, _, tail = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + tail):
            fits.append((len(rule), rule, verdict))
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


URLS = [
    None, "", "no scheme", "http://", "http://net", "http://net/", "http://NET/x", "http://a.net?q#/x", "http://example.net/en/", "http://example.net/en", "http://sub.Example.net/en/1?x",
    "http://knet/x", "x://y://z/a", "http://example.com/de/1", "http://m.example.com/fr/1", "http://a.org/fr/2", "http://ÄÖ.org/ÄÖ/2", "http://h.org/a//b///c", "ftp://h.org/" + "d/" * 40, "http://h.org/\nnew\nlines",
]


def test_rules_and_hosts(spark):
    rows = [(k, u, None) for k, u in enumerate(URLS)] + [(3, URLS[3], None), (None, URLS[8], True)]
    pages = spark.createDataFrame(rows, "page_id long, url string, good boolean").withColumn("host", F.lit("own"))
    found = urls.judge(pages).collect()
    assert len(found) == len(rows)
    for r in found:
        host, path, rule, verdict = plain_rule(URLS[8] if r["page_id"] is None else URLS[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or "allow")  # no bad label, so the method allows
    empty = spark.createDataFrame([], "page_id long, url string, good boolean")
    assert urls.judge(empty).collect() == []


def test_templates_are_judged_by_their_labels(spark):
    rows = [(k, f"http://site.test/{'bad' if k % 4 == 0 else 'good'}/{k}.html", k % 4 != 0 if k % 3 else None) for k in range(400)]
    rows += [(1000 + k, f"http://other.test/{'abc'[k % 3]}/{k}", True) for k in range(90)]
    pages = spark.createDataFrame(rows, "page_id long, url string, good boolean")
    found = {r["page_id"]: r for r in urls.judge(pages).collect()}
    assert {found[k]["template"] for k in range(0, 400, 4)} == {"/bad/*"}
    assert {found[k]["verdict"] for k in range(0, 400, 4)} == {"block"}
    assert {found[k]["verdict"] for k in range(400) if k % 4} == {"allow"}
    assert {found[1000 + k]["template"] for k in range(90)} == {"/a|b|c/*"}  # alike branches merge


def test_small_sections_of_a_large_host_are_judged_alone(spark):
    """One bad section among a hundred of one size, and bad pages below the eighth segment."""
    rows = [(k, f"http://large.test/s{k % 100:02}/{k}", k % 100 != 7) for k in range(3000)]
    deep = "/".join("abcdefghij")
    rows += [(5000 + k, f"http://deep.test/{deep}/{'bad' if k % 4 == 0 else 'good'}/{k}", k % 4 != 0) for k in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, good boolean")
    found = {r["page_id"]: r for r in urls.judge(pages).collect()}
    assert {k for k in range(3000) if found[k]["verdict"] == "block"} == set(range(7, 3000, 100))
    assert {found[k]["template"] for k in range(7, 3000, 100)} == {"/s07/*"}
    assert {k for k in range(400) if found[5000 + k]["verdict"] == "block"} == set(range(0, 400, 4))
    assert found[5000]["template"] == f"/{deep}/bad/*"


def test_sections_between_good_and_bad_do_not_chain(spark):
    """Sections of every purity from 0 to 1: neighbours are alike, the ends are not."""
    rows = [(k * 40 + j, f"http://range.test/s{k:02}/{j}", j < k) for k in range(41) for j in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, good boolean")
    found = {r["page_id"]: r["verdict"] for r in urls.judge(pages).collect()}
    assert found[0] == "block" and found[40 * 40] == "allow"


def plain_smooth(good, labelled, prior):
    return (good + prior * urls.STRENGTH) / (labelled + urls.STRENGTH)


def plain_sides(tokens, prior):
    """-1, 0 or 1 of each token (name -> (good, labelled)) against the others."""
    g, n = (sum(x[k] for x in tokens.values()) for k in (0, 1))
    out = {}
    for name, (a, b) in tokens.items():
        n1, n2 = b + urls.STRENGTH, n - b + urls.STRENGTH
        p1, p2 = plain_smooth(a, b, prior), plain_smooth(g - a, n - b, prior)
        both = (p1 * n1 + p2 * n2) / (n1 + n2)
        z = (p1 - p2) / math.sqrt(max(both * (1 - both), 1e-9) * (1 / n1 + 1 / n2))
        out[name] = 0 if len(tokens) == 1 else (z > urls.Z) - (z < -urls.Z)
    return out


def plain_templates(pages):
    """(host, path) -> (template, purity), level by level from (host, path, good or None)."""
    paths = defaultdict(lambda: [0, 0, 0])
    for host, path, good in pages:
        paths[host, path][0] += 1
        paths[host, path][1] += bool(good)
        paths[host, path][2] += good is not None
    overall = (sum(v[1] for v in paths.values()) + urls.STRENGTH) / (sum(v[2] for v in paths.values()) + urls.STRENGTH)
    hosts = defaultdict(lambda: [0, 0])
    for (host, _), (_, g, n) in paths.items():
        hosts[host][0] += g
        hosts[host][1] += n
    prior = {h: plain_smooth(g, n, overall) for h, (g, n) in hosts.items()}
    named, todo = {}, defaultdict(list)
    for host, path in paths:
        todo[host, ""].append((host, path, [s for s in path.split("/") if s]))
    while todo:
        after = defaultdict(list)
        for (host, template), rows in todo.items():
            longer = [r for r in rows if r[2]]
            named |= {(h, p): template for h, p, rest in rows if not rest}
            if sum(paths[h, p][0] for h, p, _ in longer) < urls.LEAST_PAGES:
                named |= {(h, p): template + "/*" * len(rest) for h, p, rest in longer}
                continue
            pages_of = Counter()
            for h, p, rest in longer:
                pages_of[rest[0]] += paths[h, p][0]
            token = {s: s if n >= urls.LEAST_PAGES else "*" for s, n in pages_of.items()}
            sums = defaultdict(lambda: [0, 0])
            for h, p, rest in longer:
                sums[token[rest[0]]][0] += paths[h, p][1]
                sums[token[rest[0]]][1] += paths[h, p][2]
            side = plain_sides(sums, prior[host])
            branch = defaultdict(list)
            for s in (-1, 0, 1):
                group = {t: sums[t] for t in sums if side[t] == s}
                again = plain_sides(group, prior[host])
                for t in group:
                    branch[s, t if s and again[t] else None].append(t)
            name = {t: "|".join(sorted(ts)) for ts in branch.values() for t in ts}
            for h, p, rest in longer:
                after[host, f"{template}/{name[token[rest[0]]]}"].append((h, p, rest[1:]))
        todo = after
    total = defaultdict(lambda: [0, 0])
    for (host, path), template in named.items():
        total[host, template][0] += paths[host, path][1]
        total[host, template][1] += paths[host, path][2]
    return {(h, p): (t, plain_smooth(*total[h, t], prior[h])) for (h, p), t in named.items()}


@pytest.mark.parametrize("seed", range(4))
def test_templates_against_a_plain_tree(spark, seed):
    rnd = random.Random(seed)
    shape = [["en", "de", "x"], ["a", "b", "long"], ["deep", "1", "2"], ["p", "q"], ["r"], ["s"], ["t", "u"]]
    rows = []
    for _ in range(700):
        host, depth = rnd.choice(["one.test", "one.test", "two.test"]), rnd.choice([0, 1, 2, 3, 4, 5, 6, 7, 7])
        path = "".join(f"/{rnd.choice(shape[k])}" if rnd.random() < 0.9 else f"/{rnd.randrange(40)}" for k in range(depth))
        good = None if rnd.random() < 0.3 else rnd.random() < (0.2 if "/b" in path else 0.9 if "/en" in path else 0.5)
        rows.append((len(rows), f"http://{host}{path}", good))
    found = urls.judge(spark.createDataFrame(rows, "page_id long, url string, good boolean")).collect()
    want = plain_templates([(u.split("/")[2], u[7 + len(u.split("/")[2]) :], g) for _, u, g in rows])
    assert len(found) == len(rows)
    for r in found:
        template, purity = want[r["host"], r["path"]]
        assert (r["template"], r["purity"]) == (template, pytest.approx(purity))
        assert r["verdict"] == ("block" if purity < urls.LEAST_PURITY else "allow")
    assert {r["verdict"] for r in found} == {"block", "allow"}


def test_crawler_traps_end_in_few_rounds(spark):
    """Paths of a thousand segments: eight that share all but the last, and one chain that ends everywhere."""
    trap = "/a/b" * 500
    rows = [(k, f"http://trap.test{trap}/{k}", k > 1) for k in range(8)]
    rows += [(100 + k, f"http://chain.test{'/x/y' * k}", True) for k in range(1, 40)]
    start = time.monotonic()
    found = {r["page_id"]: r["template"] for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, good boolean")).collect()}
    assert time.monotonic() - start < 60
    assert {found[k] for k in range(8)} == {f"{trap}/*"}
    assert found[110] == "/x/y" * 10 and found[139] == "/x/y" * 36 + "/*" * 6


def test_labels_come_from_rules_and_visible_text(spark):
    clean, dirty = "<p>" + "some words of a page " * 5, "<p>so %%% many *** odd ### signs"
    rows = [
        (1, "http://a.net/x", clean, False),  # the rule says so
        (2, "http://example.net/en/1", dirty, True),
        (3, "http://a.com/x", clean, True),
        (4, "http://a.com/x", dirty, False),
        (5, "http://a.com/x", "<script>var a = '%%%%%%%%'</script><!-- ### ### --><style>p{x:%}</style>" + clean, True),
        (6, "http://a.com/x", "<p></p>", None),
        (7, "http://a.com/x", None, None),
        (8, None, "a &amp; b", False),
    ]
    pages = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    assert {r["page_id"]: r["good"] for r in urls.labelled(pages).collect()} == {r[0]: r[3] for r in rows}


def test_some_template_without_a_rule_is_blocked(spark):
    """On the given pages: one whose host's pages a rule blocks, and that is not told apart from them."""
    found = queries.queries()["op9_url_templates"](spark, "/root/testdata/sf0.01").collect()
    free = [r for r in found if r["rule"] is None]
    blocked = [r for r in free if r["verdict"] == "block"]
    assert blocked and len(blocked) < len(free) / 4
    ruled = {(r["host"], r["template"]) for r in found if r["rule"] and r["verdict"] == "block"}
    assert all((r["host"], r["template"]) in ruled or r["purity"] < 0.5 for r in blocked)


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf).cache()
        assert docs.columns[: len(columns)] == columns
        assert (docs.columns == columns) == (k < 4)
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] >= sizes[2] >= sizes[3] and sizes[4] == sizes[5] > 0
    assert docs.where("text <> '' and size(tokens) = 0").count() == 0


@pytest.mark.parametrize("k", range(5))
def test_pipeline_stages_on_odd_rows(spark, clashing, none, k):
    _, stage = corpus_pipeline.STAGES[k]
    sf = "/root/testdata/sf0.001"
    assert stage(spark, none, sf).count() == 0
    out = stage(spark, clashing, sf)
    assert set(clashing.columns) <= set(out.columns)
    assert out.count() > 0


def test_run_is_the_stages_one_after_another(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


def test_one_query_for_each_operator():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 11)]
