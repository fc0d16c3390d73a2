"""Compiler evidence on a small graph."""

import pytest

from tessera import schemas
from tessera.sources import evidence
from tessera.sources.adapters import Graph


def graph(spark):
    nodes = [(i, "function", n, n, "a.py", 1, 5, 4, False, None, None, None) for i, n in enumerate("abc")]
    edges = [(1, 0, 1, "calls", "ambiguous", 0.0), (2, 0, 1, "calls", "inferred", 0.0), (3, 1, 2, "imports", "inferred", 0.0)]
    return Graph(spark.createDataFrame(nodes, schemas.NODES), spark.createDataFrame(edges, schemas.EDGES))


def files(spark, *texts):
    return spark.createDataFrame([(f"{i}.json", t) for i, t in enumerate(texts)], "path string, content string")


def test_edges_are_added_and_made_certain(spark):
    text = """{"version": 1, "provider": " cc ", "edges": [{"source": "a", "target": "b", "kind": "calls", "detail": "x"}, {"source": "b", "target": "c", "kind": "calls"},
        {"source": "b", "target": "c", "kind": "calls", "detail": "later"}, {"source": "a", "target": "nowhere", "kind": "calls"}]}"""
    out, report = evidence.apply_evidence(graph(spark), evidence.read_evidence(files(spark, text, '{"version": 1, "provider": "p"}')))
    assert tuple(report.first()) == (1, 2, 1)
    rows = {(r.src, r.dst, r.kind, r.conf_class, r.confidence, r.provenance, r.provider, r.detail) for r in out.edges.collect()}
    assert rows == {
        (0, 1, "calls", "extracted", 1.0, "compiler", "cc", "x"),
        (0, 1, "calls", "inferred", 0.0, None, None, None),
        (1, 2, "imports", "inferred", 0.0, None, None, None),
        (1, 2, "calls", "extracted", 1.0, "compiler", "cc", "later"),
    }


@pytest.mark.parametrize("text", ["[]", "no", '{"version": 2, "provider": "p"}', '{"version": 1, "provider": " "}', '{"version": 1, "provider": "p", "edges": [{"source": "a", "target": "b", "kind": "eats"}]}', None])
def test_other_files_are_errors(spark, text):
    with pytest.raises(ValueError, match=r"1\.json"):
        evidence.read_evidence(files(spark, '{"version": 1, "provider": "p"}', text))


def test_no_evidence(spark):
    out, report = evidence.apply_evidence(graph(spark), evidence.read_evidence(files(spark).limit(0)))
    assert tuple(report.first()) == (0, 0, 0) and out.edges.count() == 3
