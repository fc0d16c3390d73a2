"""Calls over a language boundary: every boundary counts, and a call meets one row a name, not every symbol of it."""

from tessera.operators import typing
from tessera.sources.adapters import Graph


def found(spark, boundaries, registry):
    nodes = [(1, "order::1", "f/a.py"), (2, "order::2", "f/b.rs"), (3, "order::3", "f/c.txt"), (9, "call::go", None)]
    g = Graph(spark.createDataFrame(nodes, "id long, qualified_name string, source_uri string"), spark.createDataFrame([(i, i, 9, "calls") for i in (1, 2, 3)], "id long, src long, dst long, kind string"))
    return typing.resolve_cross_language(g, spark.createDataFrame(boundaries, "caller string, callee string"), spark.createDataFrame(registry, "dialect string, name string, target long"))


def test_the_smallest_symbol_of_the_other_side(spark):
    registry = [("rust", "go", 7), ("rust", "go", 5), ("python", "go", 4), ("cpp", "go", 3), ("typescript", "go", 1), ("rust", "stop", 2)]
    got = found(spark, [("rust", "python"), ("typescript", "rust"), ("cpp", "python")], registry)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 3, 0.5), (2, 4, 0.5)]


def test_symbols_are_folded_before_a_call_meets_them(spark):
    got = found(spark, [("rust", "python")], [("rust", "go", k) for k in range(5, 50)])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("min(target") == 3
    assert [tuple(r) for r in got.collect()] == [(1, 5, 0.5)]


def test_no_boundary_is_left_out_where_there_are_many(spark):
    many = [(f"l{i:02}", f"m{i:02}") for i in range(40)] + [("python", f"m{i:02}") for i in range(40)]
    got = found(spark, many, [(f"m{i:02}", "go", 100 - i) for i in range(40)])
    assert [tuple(r) for r in got.collect()] == [(1, 61, 0.5)]
