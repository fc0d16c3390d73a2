"""Chains of a history against walking it."""

import random

from tessera.operators import changes


def histories():
    rng = random.Random(8)
    parents = [(f"c{i}", f"c{rng.randint(max(0, i - 6), i - 1)}") for i in range(1, 120) for _ in range(rng.choice([1, 1, 1, 2, 3]))]
    parents += [("lone", None), ("r2", "r1"), ("r3", "r2"), ("x", "c50"), ("x", "r3")]
    return parents + parents[::9]


def walk(parents, commit):
    near = {}
    for c, p in parents:
        near.setdefault(c, set()).add(p)
    seen, stack = set(), [commit]
    while stack:
        for p in near.get(stack.pop(), ()):
            if p is not None and p not in seen:
                seen.add(p)
                stack.append(p)
    return seen


def test_ancestors_match_a_walk(spark):
    parents = histories()
    h = changes.history(spark.createDataFrame(parents, "commit string, parent string"))
    commits = sorted({c for e in parents for c in e if c})
    pairs = [(a, b) for a in commits[::5] + ["x", "lone", "nowhere"] for b in [*commits, "nowhere"]]
    got = {tuple(r) for r in changes.ancestors_among(h, spark.createDataFrame(pairs, "commit string, ancestor string")).collect()}
    assert got == {(a, b) for a, b in pairs if b in walk(parents, a)}


def test_a_label_is_a_row_a_chain(spark):
    line = [(f"{i:05d}", f"{i - 1:05d}") for i in range(1, 3000)] + [(f"b{i}", f"{i * 100:05d}") for i in range(20)] + [(f"{i * 100 + 50:05d}", f"b{i}") for i in range(20)]
    h = changes.history(spark.createDataFrame(line, "commit string, parent string"))
    assert h.chains.count() == 3020 and h.links.count() <= 41
    label = changes.reached(h, spark.createDataFrame([("02999",)], "commit string"))
    assert label.count() == h.chains.select("chain").distinct().count() <= 41


def test_active_rows(spark):
    parents = histories()
    h = changes.history(spark.createDataFrame(parents, "commit string, parent string"))
    rng = random.Random(1)
    pick = lambda: rng.choice([None, "nowhere", *(f"c{i}" for i in range(0, 120, 3))])
    rows = [(i, pick(), pick()) for i in range(400)]
    frame = spark.createDataFrame(rows, "id long, valid_from string, valid_to string")
    for commit in ("c60", "x", "nowhere"):
        old = walk(parents, commit)
        want = {i for i, f, t in rows if (f is None or f == commit or f in old) and not (t is not None and t != commit and t in old)}
        assert {r.id for r in changes.active_at(frame, h, commit).collect()} == want
