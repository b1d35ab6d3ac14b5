"""Merkle manifest against a plain tree, its SQL twin, and odd rows."""

import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerspark.llm import merkle, oracle

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, **changed):
    values = [changed.get(c, row[c]) for c in FIELDS]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(hashes):
    """Root and, for each leaf, its levels' (left sibling, right sibling)."""
    paths = [[] for _ in hashes]
    owners = [[k] for k in range(len(hashes))]
    while len(hashes) > 1:
        runs = [range(k, min(k + 2, len(hashes))) for k in range(0, len(hashes), 2)]
        for run in runs:
            for k in run:
                for own in owners[k]:
                    paths[own].append(([hashes[j] for j in run if j < k], [hashes[j] for j in run if j > k]))
        owners = [[own for k in run for own in owners[k]] for run in runs]
        hashes = [h(*(hashes[k] for k in run)) for run in runs]
    return hashes[0], paths


def plain(rows):
    trees = defaultdict(list)
    for r in rows:
        trees[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r), r))
    names = sorted(trees, key=lambda n: (n is not None, (n or "").encode()))
    built = {}
    for n in names:
        trees[n].sort(key=lambda x: x[:3])
        built[n] = tree([x[2] for x in trees[n]])
    root, tops = tree([built[n][0] for n in names]) if names else ("", [])
    out = []
    for n, top in zip(names, tops):
        for (_, _, own, r), low in zip(trees[n], built[n][1]):
            path = low + top
            bad = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n_chars"] is not None
            node = leaf(r, n_chars=r["n_chars"] + 1) if bad else own
            for left, right in path:
                node = h(*left, node, *right)
            proof = h(*(s for left, right in path for s in (*left, *right)))
            out.append((r["doc_id"], own, built[n][0], root, proof, node, node == root))
    return Counter(out)


def found(df):
    return Counter(tuple(r) for r in merkle.verify(df).collect())


def test_manifest_against_a_plain_tree(docs):
    assert found(docs) == plain(docs.collect())


def test_odd_rows(odd, clashing, none):
    assert found(odd) == found(clashing) == plain(odd.collect())
    empty = merkle.verify(none)
    assert empty.collect() == [] and empty.columns[0] == "doc_id"


@pytest.mark.parametrize("n", [1, 2, 3, 64, 65, 129])
def test_sizes_about_a_block(spark, n):
    rows = [(k, f"t{k}", "en", None, k) for k in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert found(df) == plain(df.collect())


def test_many_rounds_and_many_trees(spark):
    rows = spark.range(5000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), F.lit("s").alias("source"), F.col("id").alias("n_chars"),
        F.when(F.col("id") < 4200, "hot").otherwise(F.concat(F.lit("l"), (F.col("id") % 300).cast("string"))).alias("lang"),
    )
    assert found(rows) == plain(rows.collect())


def test_proofs_lead_to_the_root(docs):
    own = merkle.manifest(docs)
    assert own.where(merkle.fold(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0


def test_no_join_but_for_numbering(docs):
    plan = merkle.verify(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "CartesianProduct" not in plan


def test_sql_twin(docs, odd):
    for df in (docs, odd):
        documents = df.toPandas()
        documents["doc_id"], documents["n_chars"] = (documents[c].astype("Int64") for c in ("doc_id", "n_chars"))
        sql = oracle.oracle_sql()["op12_merkle_manifest"].replace("FROM documents", "FROM given")
        with duckdb.connect() as con:
            con.register("given", documents)
            rows = con.sql(sql).fetchall()
        assert Counter(rows) == found(df)
