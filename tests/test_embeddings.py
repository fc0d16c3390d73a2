"""Hashed vectors and the inverted file against all pairs."""

import random

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import embeddings as E


def names(n=1500):
    rng = random.Random(4)
    verbs, nouns = ["get", "set", "load", "parse", "write", "find", "build", "merge"], ["User", "Graph", "File", "Token", "Node", "Edge", "Index", "Path", "Query", "Cache"]
    return [(i, rng.choice(verbs) + "".join(rng.sample(nouns, rng.randint(1, 3))) + rng.choice(["", "_test", "Error", "2"]) + " " + rng.choice(verbs)) for i in range(n)]


def test_vectors(spark):
    d = spark.createDataFrame([(1, "Reading files async"), (2, None), (3, ""), (4, "reading FILES async"), (5, "x")], "id long, text string")
    v = {r.id: np.array(r.vector) for r in E.embed(d, "id", F.col("text")).collect()}
    assert all(len(x) == E.SIZE for x in v.values()) and not v[2].any() and not v[3].any()
    assert abs(np.linalg.norm(v[1]) - 1) < 1e-9 and v[1] @ v[4] > 0.8 > v[1] @ v[5]
    got = {r.feature for r in E.features(d.filter("id = 1"), "id", F.col("text")).collect()}
    assert {"tok:reading", "stem:read", "stem:fil", "char:rea", "bi:reading:files", "skip:reading:async", "acr:rfa", "group:async"} <= got


def test_neighbours_against_all_pairs(spark):
    rows = names() + [(None, "getUser"), (9000, None)]
    vectors = E.embed(spark.createDataFrame(rows, "id long, text string"), "id", F.col("text")).cache()
    index = E.build_index(vectors, lists=32, part_rows=20)
    got = {}
    for r in E.nearest(index, vectors.filter("id % 50 = 0"), k=10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.score))
    table = {r.id: np.array(r.vector) for r in vectors.filter("id IS NOT NULL").collect()}
    ids = np.array(sorted(i for i, v in table.items() if v.any()))
    matrix = np.stack([table[i] for i in ids])
    hits = wanted = 0
    for q in ids[ids % 50 == 0]:
        scores = matrix @ table[q]
        scores[ids == q] = -9
        tenth = np.sort(scores)[-10]
        found = got[q]
        assert all(abs(s - matrix[ids == i][0] @ table[q]) < 1e-8 for i, s in found) and [s for _, s in found] == sorted((s for _, s in found), reverse=True)
        hits += sum(s >= tenth - 1e-9 for _, s in found)
        wanted += 10
    assert hits / wanted >= 0.9
    assert index.lists.count() == len(ids)


def test_no_vectors(spark):
    none = E.embed(spark.createDataFrame([(1, None)], "id long, text string"), "id", F.col("text"))
    assert E.nearest(E.build_index(none), none).count() == 0


def test_a_search_meets_blocks_and_few_copies(spark, monkeypatch):
    rows = [(i, f"name {'abc'[i % 3]} thing") for i in range(900)]  # three texts, 300 copies each
    vectors = E.embed(spark.createDataFrame(rows, "id long, text string"), "id", F.col("text"))
    index = E.build_index(vectors, lists=4, part_rows=64)
    found = E.nearest(index, vectors.filter("id % 50 = 0"), k=3, again=2)
    assert "list#" in found._jdf.queryExecution().toString() and "CoGroup" in found._jdf.queryExecution().toString()  # no row for a query and a vector
    assert index.lists.filter("place <= 7").count() == 21 and index.lists.count() == 900
    for r in found.collect():
        same = [i for i in range(r.query_id % 3, 900, 3) if i != r.query_id]
        assert abs(r.score - 1) < 1e-9 and r.id == same[r["rank"] - 1]
