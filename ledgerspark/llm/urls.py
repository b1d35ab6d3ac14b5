"""URL filters: rules first, then a path-template tree per host judged by labelled purity.

The tree grows from distinct paths. A run of levels at which all paths of a node go on with
the same segment is taken at once, so rounds follow the branching and not the length of
paths. Below a branching node a segment stays as it is when it holds at least ``LEAST_PAGES`` pages, whatever its share; the rarer ones become one
wildcard. A child is apart when a two-proportion test tells its smoothed purity from that
of the rest of its node by more than ``Z`` deviations; children that are not apart are one
branch. Those apart upwards, and those apart downwards, are tested once more among
themselves: the alike are one branch, the others have branches of their own. A template's
purity is its share of good labels, smoothed towards its host's, which is smoothed
towards all hosts'; a template below ``LEAST_PURITY`` is blocked. A node grows as long as
its paths have segments; one of fewer than ``LEAST_PAGES`` pages has wildcards only.
A branch of more than ``LISTED`` children is named by the first and the number of others.

Defined results: a null url and one without ``://`` have an empty host and path, and form
a host of their own; repeated pages count as often as they stand; without labels
everything is allowed that no rule blocks; an empty table gives no rows. Extra columns
are not read.

A page's label is what the rule that fits it says; without one, a page whose visible words
drown in symbols is bad and any other with words is good (``labelled``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerspark.llm.common import WORD, prepare, release, stored

# host and path, verdict; the longest that fits wins
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
LEAST_PAGES = 4
Z = 1.64
STRENGTH = 4.0  # labels that the smoothing counts for
LEAST_PURITY = 0.5
LISTED = 50
WILDCARD = "*"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
SYMBOL_WORDS = 10  # words that a clean page has for each symbol, at least
_UNSEEN = r"(?s)<(script|style)\b.*?</\1>|<!--.*?-->|<[^<>]*>"
_SYMBOLS = r"[#*$%|]|&(?!#?\w+;)|&(amp|lt|gt);"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, or null."""
    found = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        name, slash, rest = rule.partition("/")
        fits = (host == name) | host.endswith(f".{name}")
        found = F.when(fits & path.startswith(slash + rest), F.lit(rule)).otherwise(found)
    return found


def _smooth(good: Column, labelled: Column, prior: Column) -> Column:
    return (good + prior * STRENGTH) / (labelled + STRENGTH)


def _apart(tokens: DataFrame, at: list[str], name: str) -> DataFrame:
    """``tokens`` with -1, 0 or 1 as ``name``: worse than, like or better than the rest of ``at``."""
    whole = tokens.groupBy(*at).agg(F.sum("good").alias("all_good"), F.sum("labelled").alias("all_labelled"), F.count("*").alias("k"))
    n1, n2 = F.col("labelled") + STRENGTH, F.col("all_labelled") - F.col("labelled") + STRENGTH
    p1 = _smooth(F.col("good"), F.col("labelled"), F.col("prior"))
    p2 = _smooth(F.col("all_good") - F.col("good"), F.col("all_labelled") - F.col("labelled"), F.col("prior"))
    both = (p1 * n1 + p2 * n2) / (n1 + n2)
    z = (p1 - p2) / F.sqrt(F.greatest(both * (1 - both), F.lit(1e-9)) * (1 / n1 + 1 / n2))
    side = F.when(F.col("k") == 1, 0).when(z > Z, 1).when(z < -Z, -1).otherwise(0)
    return tokens.join(whole, at).withColumn(name, side).drop("all_good", "all_labelled", "k")


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Join on ``keys``, null with null."""
    right = right.select(*[F.col(c).alias(f"r_{c}") if c in keys else F.col(c) for c in right.columns])
    fits = [left[c].eqNullSafe(right[f"r_{c}"]) for c in keys]
    return left.join(right, fits).drop(*[f"r_{c}" for c in keys])


def _absorbed(nodes: DataFrame) -> DataFrame:
    """``nodes`` with the levels taken at which a node's paths do not part, added to the template.

    The paths of a node are compared with its longest; levels count as long as
    ``LEAST_PAGES`` pages go on.
    """
    at = ["host", "template"]
    size = F.size("rest")
    longest = nodes.groupBy(*at).agg(F.max_by("rest", F.struct(size, "rest")).alias("longest"))
    far = nodes.withColumn("place", F.row_number().over(W.partitionBy(*at).orderBy(F.desc(size)))).where(F.col("place") <= LEAST_PAGES)
    sizes = F.flatten(F.collect_list(F.array_repeat(size, F.least("n", F.lit(LEAST_PAGES)).cast("int"))))
    last = far.groupBy(*at).agg(F.coalesce(F.get(F.sort_array(sizes, asc=False), F.lit(LEAST_PAGES - 1)), F.lit(0)).alias("last"))
    spans = stored(longest.join(last, at), "spans")
    differs = F.array_position(F.zip_with("rest", F.slice("longest", 1, size), lambda a, b: a != b), F.lit(True)) - 1
    parting = nodes.join(spans, at).groupBy(*at).agg(F.min(F.when(differs >= 0, differs)).alias("parting"))
    runs = spans.join(parting, at)
    run = F.least(F.coalesce("parting", F.size("longest")), "last").cast("int")
    runs = stored(runs.select(*at, run.alias("run")).where("run > 0"), "runs")
    taken = F.least(F.coalesce("run", F.lit(0)), size)
    path = F.transform(F.slice("rest", 1, taken), lambda s: F.concat(F.lit("/"), s))
    out = nodes.join(runs, at, "left").withColumns({
        "template": F.concat("template", F.array_join(path, "")), "rest": F.slice("rest", taken + 1, F.greatest(size, F.lit(1)))
    })
    return stored(out.drop("run"), "absorbed")


def _grown(nodes: DataFrame) -> DataFrame:
    """One level of the tree: ``nodes`` (host, path, template, rest, n, good, labelled, prior)
    with the token of this level added to the template."""
    here = nodes.withColumn("segment", F.col("rest")[0])
    at = ["host", "template"]
    sums = [F.sum(c).alias(c) for c in ("n", "good", "labelled")]
    children = stored(here.groupBy(*at, "segment").agg(*sums, F.first("prior").alias("prior")), "children")
    named = children.withColumn("token", F.when(F.col("n") >= LEAST_PAGES, F.col("segment")).otherwise(WILDCARD))
    tokens = stored(named.groupBy(*at, "token").agg(*sums, F.first("prior").alias("prior")), "tokens")
    once = stored(_apart(tokens, at, "side"), "once")
    twice = _apart(once, [*at, "side"], "again")
    own = (F.col("side") != 0) & (F.col("again") != 0)
    branched = stored(twice.select(*at, "token", "side", F.when(own, F.col("token")).alias("alone")), "branches")
    within = [*at, "side", "alone"]
    size = branched.groupBy(*within).agg(F.count("*").alias("size"), F.min("token").alias("least"))
    few = _same(branched, size.where(F.col("size") <= LISTED), within).groupBy(*within, "size", "least")
    few = few.agg(F.array_join(F.array_sort(F.collect_set("token")), "|").alias("name"))
    many = F.concat("least", F.lit("|+"), F.col("size") - 1, F.lit("|"), F.col("side"))
    names = stored(few.unionByName(size.where(F.col("size") > LISTED).withColumn("name", many)), "names")
    merged = stored(_same(branched, names, within).select(*at, "token", "name"), "merged")
    # one row per child that stays, and the wildcard's name for all the others
    wild = merged.where(F.col("token") == WILDCARD).select(*at, F.col("name").alias("other"))
    fixed = merged.where(F.col("token") != WILDCARD).select(*at, F.col("token").alias("segment"), "name")
    fixed, wild = stored(fixed, "fixed"), stored(wild, "wild")
    name = F.coalesce("name", "other")
    grown = here.join(fixed, [*at, "segment"], "left").join(wild, at, "left")
    grown = grown.withColumns({"template": F.concat("template", F.lit("/"), name), "rest": F.slice("rest", 2, F.size("rest"))})
    grown = stored(grown.drop("segment", "name", "other"), "level")
    release(children, tokens, once, branched, names, merged, fixed, wild)
    return grown


def templates(urls: DataFrame) -> DataFrame:
    """host, path, template, purity of ``urls`` (host, path, n, good, labelled), one row per path."""
    total = urls.agg(F.sum("good").alias("g"), F.sum("labelled").alias("l")).first()
    overall = F.lit(((total["g"] or 0) + STRENGTH) / ((total["l"] or 0) + STRENGTH))
    sums = urls.groupBy("host").agg(F.sum("good").alias("g"), F.sum("labelled").alias("l"))
    priors = stored(sums.select("host", _smooth(F.col("g"), F.col("l"), overall).alias("prior")), "hosts")
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    nodes = stored(urls.join(priors, "host").withColumn("rest", parts).withColumn("template", F.lit("")), "urls")
    done = []
    ended = F.size("rest") == 0

    def small_apart(nodes: DataFrame) -> DataFrame:
        """Nodes that go on; the ended ones and those of few pages are done."""
        done.append(nodes.where(ended))
        pages = nodes.where(~ended).groupBy("host", "template").agg(F.sum("n").alias("pages"))
        longer = stored(nodes.where(~ended).join(pages, ["host", "template"]), "longer")
        # all children of a small node are rare, down to the ends of its paths
        rest = F.concat("template", F.repeat(F.lit(f"/{WILDCARD}"), F.size("rest")))
        done.append(longer.where(F.col("pages") < LEAST_PAGES).withColumn("template", rest).drop("pages"))
        return longer.where(F.col("pages") >= LEAST_PAGES).drop("pages")

    while True:
        nodes = small_apart(nodes)
        if nodes.isEmpty():
            break
        nodes = small_apart(_absorbed(nodes))
        if nodes.isEmpty():
            break
        nodes = _grown(nodes)
    leaves = done[0]
    for d in done[1:]:
        leaves = leaves.unionByName(d)
    per = leaves.groupBy("host", "template").agg(
        F.sum("good").alias("g"), F.sum("labelled").alias("l"), F.first("prior").alias("p")
    )
    judged = stored(per.select("host", "template", _smooth(F.col("g"), F.col("l"), F.col("p")).alias("purity")), "purity")
    return leaves.select("host", "path", "template").join(judged, ["host", "template"])


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of ``pages`` (page_id, url, good).

    ``good`` is a boolean label, or null.
    """
    prepare(pages.sparkSession)
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "good")
    urls = parts.groupBy("host", "path").agg(
        F.count("*").alias("n"), F.count_if("good").alias("good"), F.count("good").alias("labelled")
    )
    known = stored(templates(stored(urls, "paths")), "templates")
    verdict = F.when(F.col("rule").isNull(), F.when(F.col("purity") < LEAST_PURITY, "block").otherwise("allow"))
    for rule, what in rules:
        verdict = verdict.when(F.col("rule") == rule, what)
    return (
        parts.drop("good")
        .join(known, ["host", "path"])
        .withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
        .select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
    )


def labelled(pages: DataFrame, rules=RULES) -> DataFrame:
    """``pages`` (page_id, url, html) with ``good``: what the page's rule says, or its visible text.

    Without a rule a page is bad if it has more than one symbol per ``SYMBOL_WORDS`` words;
    one without words, or without html, has no label.
    """
    rule = rule_of(host_of(F.col("url")), path_of(F.col("url")), rules)
    said = F.lit(None).cast("boolean")
    for name, verdict in rules:
        said = F.when(rule == name, verdict == "allow").otherwise(said)
    text = F.regexp_replace("html", _UNSEEN, " ")
    words, symbols = F.regexp_count(text, F.lit(WORD)), F.regexp_count(text, F.lit(_SYMBOLS))
    clean = F.when(words > 0, symbols * SYMBOL_WORDS <= words)
    return pages.select("page_id", "url", F.coalesce(said, clean).alias("good"))
