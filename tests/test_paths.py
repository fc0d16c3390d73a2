"""Cheapest paths against all paths written out."""

import random

from pyspark.sql import functions as F

from tessera import schemas
from tessera.operators import traversal
from tessera.sources.adapters import Graph


def graph(spark, n, m, seed):
    rng = random.Random(seed)
    kinds = ["calls", "defines", "imports", "member_of", "mentions"]
    edges = [(i, rng.randrange(n), rng.randrange(n), rng.choice(kinds), "extracted", rng.choice([1.0, 0.5, 0.0])) for i in range(m)]
    nodes = [(i, "function", f"n{i}", f"app::n{i}", "a.py", 1, 5, 4, False, None, None, None) for i in range(n)]
    return Graph(spark.createDataFrame(nodes, schemas.NODES), spark.createDataFrame(edges, schemas.EDGES)), edges


def all_paths(edges, start, hops):
    step = {}
    for _, a, b, kind, _, conf in edges:
        c = schemas.PATH_COST.get(kind, schemas.DEFAULTS["path"]) / max(conf, 0.05)
        step[a, b] = min(c, step.get((a, b), c))
    near = {}
    for (a, b), c in step.items():
        near.setdefault(a, []).append((b, c))
    out, stack = [], [((start,), 0.0)]
    while stack:
        path, cost = stack.pop()
        if len(path) > 1:
            out.append((round(cost, 6), len(path), path))
        if len(path) <= hops:
            stack += [((*path, b), cost + c) for b, c in near.get(path[-1], ()) if b not in path]
    return sorted(out)


def test_cheapest_paths_are_all_found(spark):
    g, edges = graph(spark, 40, 170, 3)
    starts = g.nodes.filter("id IN (0, 7, 21)").select("id")
    for target, hops, limit in ((None, 4, 10), (11, 5, 15), (11, 3, 400)):
        report = []
        got = traversal.top_paths(g, starts, target=target, max_hops=hops, limit=limit, report=report).collect()
        every = 0
        for s in (0, 7, 21):
            want = all_paths(edges, s, hops)
            every += len(want)
            want = [p for p in want if target is None or p[2][-1] == target][:limit]
            rows = sorted((r["rank"], round(r.cost, 6), tuple(r.path)) for r in got if r.start == s)
            assert [c for _, c, _ in rows] == [c for c, _, _ in want]
            assert {p for *_, p in rows if rows and rows[-1][1] > 0} <= {p for _, _, p in all_paths(edges, s, hops)}
            cheap = [p for c, _, p in want if c < want[-1][0]]
            assert set(cheap) <= {p for *_, p in rows}
        if limit < 100:
            assert sum(report) * (10 if target is None else 5) <= every, (report, every)


def test_diverse_paths_read_on(spark):
    g, edges = graph(spark, 30, 120, 6)
    got = {}
    for r in traversal.top_diverse_paths(g, g.nodes.filter("id = 4").select("id"), max_hops=4, limit=12, overlap=0.3).orderBy("rank").collect():
        got.setdefault(r.start, []).append(tuple(r.path))
    kept = []
    ranked = traversal.top_paths(g, g.nodes.filter("id = 4").select("id"), max_hops=4, limit=100_000).orderBy("rank").collect()
    for r in ranked:
        near = any(len(set(r.path) & set(k)) / len(set(r.path) | set(k)) > 0.3 for k in kept)
        if len(kept) < 3 or not near:
            kept.append(tuple(r.path))
        if len(kept) == 12:
            break
    assert got[4] == kept
