"""The dispatcher: lookup, paging, detail."""

import pytest

from tessera import schemas
from tessera.plans import operations
from tessera.sources.adapters import Graph


@pytest.fixture(scope="module")
def graph(spark):
    nodes = [(i, "function", f"f{i}", f"m::f{i}", "a.py", 1, 9, 8, False, None, None, None) for i in range(1, 9)]
    edges = [(i, i, i + 1, "calls", "extracted", 1.0) for i in range(1, 8)]
    return Graph(spark.createDataFrame(nodes, schemas.NODES), spark.createDataFrame(edges, schemas.EDGES))


def test_pages_fit_together(graph):
    first = [r.id for r in operations.run(graph, "hub_nodes", detail="minimal").collect()]
    rest = [r.id for r in operations.run(graph, "hub_nodes", detail="minimal", offset=5).collect()]
    assert len(first) == 5 and sorted(first + rest) == list(range(1, 9))


def test_targets_by_name_and_id(graph):
    for target in ("m::f3", "f3", 3):
        assert [r.id for r in operations.run(graph, "callers", target=target).collect()] == [2]
    with pytest.raises(LookupError):
        operations.run(graph, "callers", target="nobody")
    with pytest.raises(KeyError):
        operations.run(graph, "nothing")
