"""Named operations on a graph: a dispatcher with paging and detail levels."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import biconnected, centrality, changes, communities, flows, primitives, search, structure, traversal
from tessera.sources.adapters import Graph

#: Rows a page by detail level; no page exceeds HARD_LIMIT.
PAGE = {"minimal": 5, "standard": 50, "full": 200}
HARD_LIMIT = 500


def _at(g: Graph, target: str | int) -> DataFrame:
    """The node with this id, qualified name, or unique name."""
    if isinstance(target, int):
        return g.nodes.filter(F.col("id") == target).select("id")
    exact = g.nodes.filter(F.col("qualified_name") == target).select("id", F.lit(0).alias("how"))
    named = g.nodes.filter(F.col("name") == target).select("id", F.lit(1).alias("how"))
    found = exact.unionByName(named).orderBy("how", "id").limit(2).collect()
    if not found or (found[0]["how"] == 1 and len(found) > 1):
        raise LookupError(f"{target!r} names no node, or several")
    return g.nodes.sparkSession.createDataFrame([(found[0]["id"],)], "id long")


def _id(g: Graph, target: str | int) -> int:
    return target if isinstance(target, int) else _at(g, target).first()["id"]


_files = communities.by_source

OPERATIONS: dict[str, Callable[..., DataFrame]] = {
    "status": lambda g: primitives.status(g),
    "node_kinds": lambda g: primitives.kind_counts(g.nodes),
    "edge_kinds": lambda g: primitives.kind_counts(g.edges),
    "search": lambda g, query: search.tiered(g.nodes, "id", F.col("name"), query),
    "token_overlap": lambda g, query: search.token_overlap(g.nodes, "id", F.col("qualified_name"), query),
    "callers": lambda g, target: traversal.call_neighbours(g, _id(g, target), incoming=True),
    "callees": lambda g, target: traversal.call_neighbours(g, _id(g, target), incoming=False),
    "callers_deep": lambda g, target, max_hops=6: traversal.callers(g, _at(g, target), max_hops),
    "callees_deep": lambda g, target, max_hops=6: traversal.callees(g, _at(g, target), max_hops),
    "max_depth": lambda g, target, max_hops=20: traversal.max_depth(g, _at(g, target), max_hops),
    "impact": lambda g, target, max_hops=3: traversal.impact_bfs(g, _at(g, target), max_hops=max_hops),
    "impact_ranked": lambda g, target, max_hops=4: traversal.impact_ranked(g, _at(g, target), max_hops=max_hops),
    "affected_files": lambda g, source: traversal.affected_files(g, source),
    "paths": lambda g, target, to=None, max_hops=3: traversal.top_diverse_paths(g, _at(g, target), target=None if to is None else _id(g, to), max_hops=max_hops),
    "minimal_context": lambda g, target, max_hops=1: traversal.minimal_context(g, _at(g, target), max_hops=max_hops),
    "traverse": lambda g, target, max_hops=3, token_budget=1200: traversal.traverse_budget(g, _at(g, target), max_hops=max_hops, token_budget=token_budget),
    "find_related": lambda g, target: traversal.related(g, _id(g, target)),
    "counterfactual": lambda g, target, removed, max_hops=5: traversal.counterfactual(g, _id(g, target), _id(g, removed), max_hops=max_hops),
    "rename_preview": lambda g, target: traversal.rename_sites(g, _id(g, target)),
    "hub_nodes": lambda g: structure.hub_nodes(g, HARD_LIMIT),
    "god_nodes": lambda g, min_degree=20: structure.god_nodes_degree(g, min_degree),
    "pagerank": lambda g: centrality.god_nodes(g, HARD_LIMIT),
    "fan_in": lambda g, threshold=3: structure.fan(g, incoming=True, threshold=threshold),
    "fan_out": lambda g, threshold=3: structure.fan(g, incoming=False, threshold=threshold),
    "diamonds": lambda g: structure.diamond_counts(g.edges),
    "feedback": lambda g: structure.feedback(g.edges),
    "cycles": lambda g: centrality.cyclic_components(g.edges),
    "core_numbers": lambda g: centrality.core_numbers(g),
    "articulation_points": lambda g: biconnected.articulation_points(g.edges),
    "betweenness": lambda g: centrality.betweenness(g),
    "components": lambda g: centrality.connected_components(g),
    "large_functions": lambda g, min_lines=80: structure.large_functions(g, min_lines),
    "dead_code": lambda g: structure.dead_code(g),
    "gaps": lambda g: structure.gaps(g),
    "knowledge_gaps": lambda g: structure.untested_hotspots(g),
    "surprises": lambda g: structure.surprise_edges(g, _files(g)),
    "coverage": lambda g: structure.coverage(g),
    "diagnostics": lambda g: structure.diagnostics(g),
    "call_resolution": lambda g: primitives.call_resolution_stats(g),
    "communities": lambda g: communities.louvain(g),
    "communities_leiden": lambda g: communities.leiden(g),
    "community_summaries": lambda g: communities.summaries(g, _files(g)),
    "community_quality": lambda g: communities.partition_quality(g, _files(g)),
    "community_split": lambda g, max_size=10: communities.split_half(_files(g), max_size=max_size),
    "architecture": lambda g: communities.coupling(g, _files(g)),
    "architecture_warnings": lambda g: communities.warnings(g, _files(g)),
    "flows": lambda g: flows.materialise_flows(g)[0],
    "risk": lambda g: changes.risk_scores(g),
    "test_coverage": lambda g: changes.test_coverage(g),
    "detect_changes": lambda g, diff: changes.hunk_risk(g, changes.parse_diff(g.nodes.sparkSession.createDataFrame([(diff,)], "diff string"))),
}


def run(g: Graph, operation: str, *, detail: str = "standard", offset: int = 0, limit: int | None = None, **params: Any) -> DataFrame:
    """One page of an operation's rows, ordered by all its plain columns so that pages fit together."""
    if operation not in OPERATIONS:
        raise KeyError(f"unknown operation {operation!r}; known: {', '.join(sorted(OPERATIONS))}")
    rows = OPERATIONS[operation](g, **params)
    first = [F.desc(c) for c in ("score", "rank", "criticality", "degree") if c in rows.columns][:1]
    order = first + [F.col(c) for c, kind in rows.dtypes if not kind.startswith(("map", "variant"))]
    return rows.orderBy(*order).offset(offset).limit(min(limit or PAGE[detail], HARD_LIMIT))
