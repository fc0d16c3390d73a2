"""After the first round of label propagation only nodes around the last moves vote again."""

from tessera.operators import communities
from test_modularity import graph


def test_only_neighbours_of_moves_vote_again(spark, monkeypatch):
    asked, write = [], communities.materialise

    def seen(df, tag):
        out = write(df, tag)
        if tag == "lp-asked":
            asked.append(out.count())
        return out

    monkeypatch.setattr(communities, "materialise", seen)
    edges = [(3 * i + a, 3 * i + b) for i in range(6) for a, b in ((0, 1), (1, 2), (2, 0))] + [(20 + i, 21 + i) for i in range(8)]
    label = {r.id: r.community for r in communities.label_propagation(graph(spark, edges, 29)).collect()}
    assert all(label[3 * i] == label[3 * i + 1] == label[3 * i + 2] for i in range(6))
    assert asked and asked[-1] < 27, asked
