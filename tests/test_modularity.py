"""Communities by tables against moves one node at a time."""

import random
from collections import defaultdict

from tessera import schemas
from tessera.operators import communities
from tessera.sources.adapters import Graph


def graph(spark, edges, n):
    nodes = [(i, "function", f"n{i}", f"app::n{i}", "a.py", 1, 5, 4, False, None, None, None) for i in range(n)]
    return Graph(spark.createDataFrame(nodes, schemas.NODES), spark.createDataFrame([(i, a, b, "calls", "extracted", 1.0) for i, (a, b) in enumerate(edges)], schemas.EDGES))


def planted(seed, groups=8, size=12):
    rng = random.Random(seed)
    n = groups * size
    edges = [(g * size + rng.randrange(size), g * size + rng.randrange(size)) for g in range(groups) for _ in range(size * 3)]
    edges += [(rng.randrange(n), rng.randrange(n)) for _ in range(n)]
    edges += [(n + i, n) for i in range(1, 30)] + [(n + 40 + i, n + 41 + i) for i in range(20)]  # a star, a path
    return [e for e in edges if e[0] != e[1]], n + 70


def quality(edges, label):
    w, deg, tot, inner = defaultdict(float), defaultdict(float), defaultdict(float), 0.0
    for a, b in edges:
        deg[a] += 1
        deg[b] += 1
        inner += 2 * (label[a] == label[b])
    for v, d in deg.items():
        tot[label[v]] += d
    m2 = 2 * len(edges)
    return inner / m2 - sum(t * t for t in tot.values()) / m2**2


def one_by_one(edges):
    """Greedy moves in node order, then contraction."""
    near, whole = defaultdict(lambda: defaultdict(float)), {v: v for e in edges for v in e}
    for a, b in edges:
        near[a][b] += 1
        near[b][a] += 1
    deg = {v: sum(x.values()) for v, x in near.items()}
    m2 = sum(deg.values())
    while True:
        label, tot = {v: v for v in deg}, dict(deg)
        moved = True
        while moved:
            moved = False
            for v in sorted(near):
                tie = defaultdict(float)
                for u, w in near[v].items():
                    if u != v:
                        tie[label[u]] += w
                tot[label[v]] -= deg[v]
                gain = lambda c: tie.get(c, 0.0) - deg[v] * tot[c] / m2  # noqa: B023, E731
                best = max(sorted(tie), key=gain, default=label[v])
                if gain(best) > gain(label[v]) + 1e-12:
                    label[v], moved = best, True
                tot[label[v]] += deg[v]
        whole = {v: label[c] for v, c in whole.items()}
        if len(set(label.values())) == len(label):
            return whole
        new = defaultdict(lambda: defaultdict(float))
        for v, x in near.items():
            for u, w in x.items():
                new[label[v]][label[u]] += w
        near, old = new, deg
        deg = defaultdict(float)
        for v, d in old.items():
            deg[label[v]] += d


def pieces(edges, label):
    near = defaultdict(set)
    for a, b in edges:
        if label[a] == label[b]:
            near[a].add(b)
            near[b].add(a)
    n, seen = 0, set()
    for v in label:
        if v not in seen:
            n += 1
            stack = [v]
            while stack:
                x = stack.pop()
                if x not in seen:
                    seen.add(x)
                    stack += near[x]
    return n


def test_modularity_is_near_the_sequential_way(spark):
    edges, n = planted(5)
    g = graph(spark, edges, n)
    want = quality(edges, one_by_one(edges))
    for found in (communities.louvain(g), communities.leiden(g)):
        label = {r.id: r.community for r in found.collect()}
        assert len(label) == n and all(label[c] == c for c in label.values())
        assert quality(edges, label) >= 0.98 * want
    assert pieces(edges, label) == len(set(label.values()))  # every community of the second is connected


def test_label_propagation_comes_to_rest(spark):
    edges, n = planted(9, groups=4, size=8)
    label = {r.id: r.community for r in communities.label_propagation(graph(spark, edges, n)).collect()}
    weight = defaultdict(lambda: defaultdict(float))
    for a, b in edges:
        weight[a][label[b]] += 1
        weight[b][label[a]] += 1
    assert len(label) == n
    for v, votes in weight.items():
        assert label[v] == max(votes, key=lambda c: (votes[c], -c))


def test_no_edges(spark):
    g = graph(spark, [(0, 1)], 3)
    alone = Graph(g.nodes, g.edges.limit(0))
    for detect in (communities.louvain, communities.leiden, communities.label_propagation):
        assert {(r.id, r.community) for r in detect(alone).collect()} == {(0, 0), (1, 1), (2, 2)}


def test_edges_lie_still_while_nodes_move(spark, monkeypatch):
    """Of a round's moves only what edges tell is exchanged, neither ties nor states."""
    from tessera.operators import modularity

    plans, write = [], modularity.bucketed
    monkeypatch.setattr(modularity, "bucketed", lambda df, key, tag, **k: (plans.append((tag, df._jdf.queryExecution().executedPlan().toString())), write(df, key, tag, **k))[1])
    edges, n = planted(5, groups=2, size=5)
    communities.louvain(graph(spark, edges, n))
    moved = [p for tag, p in plans if tag == "moved"]
    assert moved and all(p.count("Exchange") == 1 for p in moved)
    assert not any("SortMergeJoin" in p for p in moved)
