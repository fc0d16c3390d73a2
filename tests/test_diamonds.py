"""Diamonds against brute force, and what travels to count them."""

import random
from collections import Counter

from tessera.operators import structure


def test_counts_in_pieces_move_no_row_a_path(spark, monkeypatch):
    rng = random.Random(3)
    edges = {(rng.randrange(30), rng.randrange(30)) for _ in range(220)} | {(100 + i, 5) for i in range(6)} | {(5, 200 + i) for i in range(40)} | {(100, 6), (6, 201)}
    table = spark.createDataFrame(sorted(edges) + sorted(edges)[:20], "src long, dst long")
    k = Counter((a, d) for a, m in edges for m2, d in edges if m == m2 and a != m and m != d and a != d)
    want = {(a, d, n * (n - 1) // 2) for (a, d), n in k.items() if n > 1}
    for piece, paths in ((4096, 2_000_000), (3, 50)):
        monkeypatch.setattr(structure, "_PIECE", piece, raising=False)
        monkeypatch.setattr(structure, "_PATHS", paths, raising=False)
        found = structure.diamond_counts(table)
        assert {tuple(r) for r in found.collect()} == want
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert not [line for line in plan.split("\n") if "Exchange hashpartitioning(a#" in line and ", d#" in line]
    pairs = sorted((a, d, b, c) for a, b in edges for a2, c in edges if a == a2 and b < c and a not in (b, c) for b2, d in edges if b2 == b and d not in (a, b, c) and (c, d) in edges)
    assert [(r.a, r.d, r.b, r.c) for r in structure.diamonds(table, limit=40).collect()] == pairs[:40]
