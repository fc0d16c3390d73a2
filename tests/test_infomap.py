"""The map equation on tables against moves one node at a time."""

import numpy as np

from tessera.operators import communities
from test_modularity import graph, planted


def _symmetric(src: np.ndarray, dst: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours and weights of each node, without self-loops, and each node's degree with them."""
    a, b, x = np.concatenate([src, dst]), np.concatenate([dst, src]), np.concatenate([w, w])
    degree = np.bincount(a, x, n)
    keep = a != b
    a, b, x = a[keep], b[keep], x[keep]
    order = np.argsort(a, kind="stable")
    return np.searchsorted(a[order], np.arange(n + 1)), b[order], x[order], degree


def _contract(src: np.ndarray, dst: np.ndarray, w: np.ndarray, dense: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key, inverse = np.unique(dense[src] * k + dense[dst], return_inverse=True)
    return key // k, key % k, np.bincount(inverse, w)


def one_by_one(src: np.ndarray, dst: np.ndarray, w: np.ndarray, n: int, passes: int = 20, levels: int = 10) -> np.ndarray:
    """Greedy search of the map equation: nodes in order join the neighbour module that shortens the code most, then contract."""
    begin, near, x, degree = _symmetric(src, dst, w, n)
    total = float(degree.sum())
    if total <= 0:
        return np.arange(n)
    term = lambda v: v * np.log2(v) if v > 0 else 0.0
    whole = np.arange(n)
    for _ in range(levels):
        begin, near, x, degree = _symmetric(src, dst, w, n)
        flow, out = degree / total, np.array([x[begin[v] : begin[v + 1]].sum() for v in range(n)]) / total
        label, m_flow, m_exit = np.arange(n), flow.copy(), out.copy()
        q = float(out.sum())
        for _ in range(passes):
            moved = 0
            for v in range(n):
                lo, hi = begin[v], begin[v + 1]
                if lo == hi:
                    continue
                names, inverse = np.unique(label[near[lo:hi]], return_inverse=True)
                tie = dict(zip(names.tolist(), (np.bincount(inverse, x[lo:hi]) / total).tolist()))
                old = int(label[v])
                e_old, f_old = m_exit[old] - out[v] + 2 * tie.get(old, 0.0), m_flow[old] - flow[v]
                best, pick = -1e-10, old
                for c in names.tolist():
                    if c == old:
                        continue
                    e_new, f_new = m_exit[c] + out[v] - 2 * tie[c], m_flow[c] + flow[v]
                    q_new = q - m_exit[old] - m_exit[c] + e_old + e_new
                    delta = term(q_new) - term(q)
                    delta -= 2 * (term(e_old) + term(e_new) - term(m_exit[old]) - term(m_exit[c]))
                    delta += term(e_old + f_old) + term(e_new + f_new) - term(m_exit[old] + m_flow[old]) - term(m_exit[c] + m_flow[c])
                    if delta < best:
                        best, pick, state = delta, c, (e_new, f_new, q_new)
                if pick != old:
                    m_exit[old], m_flow[old] = e_old, f_old
                    m_exit[pick], m_flow[pick], q = state
                    label[v] = pick
                    moved += 1
            if not moved:
                break
        kept, dense = np.unique(label, return_inverse=True)
        whole = dense[whole]
        if len(kept) == n:
            break
        src, dst, w = _contract(src, dst, w, dense, len(kept))
        n = len(kept)
    return whole


def bits(g, spark, label):
    return communities.map_equation(g, spark.createDataFrame(list(label.items()), "id long, community long")).first()["bits"]


def test_the_code_is_nearly_as_short_as_the_sequential_one(spark):
    for seed in (5, 8):
        edges, n = planted(seed)
        g = graph(spark, edges, n)
        src, dst = np.array(edges).T
        want = dict(enumerate(one_by_one(src, dst, np.full(len(src), 0.55), n).tolist()))
        found = {r.id: r.community for r in communities.infomap(g).collect()}
        assert len(found) == n and all(found[c] == c for c in found.values())
        assert bits(g, spark, found) <= 1.03 * bits(g, spark, want)


def test_a_component_is_never_one_group(spark, monkeypatch):
    edges, n = planted(3, groups=2, size=6)
    from tessera.operators import modularity

    plans, write = [], modularity.materialise
    monkeypatch.setattr(modularity, "materialise", lambda df, tag: (plans.append(df._jdf.queryExecution().toString()), write(df, tag))[1])
    found = communities.infomap(graph(spark, edges, n))
    assert plans and not any("FlatMapGroups" in p for p in [*plans, found._jdf.queryExecution().toString()])
