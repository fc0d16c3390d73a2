"""Execution flows: entry points, traced members, criticality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.traversal import bfs
from tessera.sources.adapters import Graph


# Starts of names, route verbs, and parts of decorators that mark what a framework calls.
ENTRY_PREFIXES = ["route_", "api_", "handle_", "on_", "serve_", "middleware_"]
ROUTE_VERBS = ["get", "post", "put", "delete", "patch"]
ENTRY_DECORATORS = ["@route", "@api", "@endpoint", "@handler", "@command", "@task", "@job", "@cron", "@app.route", "@blueprint", "@celery", "@shared_task", "@pytest", "@fixture", "@click", "@app.websocket", "@middleware", "@resolver"]


def is_framework_entry(name: Column, qualified_name: Column, decorators: Column | None = None) -> Column:
    """Whether a framework calls a symbol: by the start of its name, as a verb of a router, or by a decorator."""
    out = name.rlike("^(" + "|".join(ENTRY_PREFIXES) + ")") | (name.isin(ROUTE_VERBS) & F.contains(qualified_name, F.lit("route")))
    if decorators is not None:
        out = out | F.exists(decorators, lambda d: d.rlike("|".join(x.replace(".", r"\.") for x in ENTRY_DECORATORS)))
    return out


def entry_points(g: Graph) -> DataFrame:
    """Callables that are tests, have an entry name, or that nothing calls."""
    called = g.edges.filter("kind = 'calls'").select(F.col("dst").alias("id")).distinct().withColumn("called", F.lit(True))
    n = g.nodes.filter(F.col("kind").isin("function", "method") & ~F.col("qualified_name").startswith("call::")).join(called, "id", "left")
    named = F.lower("name").rlike(r"^(main|run|start|serve|handler|cli)$")
    return n.filter(F.col("is_test") | named | F.col("called").isNull()).select("id", "name", "is_test")


def trace(g: Graph, entries: DataFrame, *, max_depth: int = 6, cap: int = 200) -> DataFrame:
    """entry, id, depth: members over non-ambiguous calls, the ``cap`` nearest (then most called) kept."""
    solid = Graph(g.nodes, g.edges.filter("kind = 'calls' AND conf_class <> 'ambiguous'"))
    real = solid.edges.join(g.nodes.filter(F.col("qualified_name").startswith("call::")).select(F.col("id").alias("dst")), "dst", "left_anti")
    seen = bfs(Graph(g.nodes, real.select(g.edges.columns)), entries.select("id"), max_hops=max_depth)
    fan_in = real.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("fan_in"))
    close = 1.0 / (1 + F.col("depth")) + F.least(F.coalesce("fan_in", F.lit(0)) / 10.0, F.lit(0.5))
    rank = F.row_number().over(Window.partitionBy("start").orderBy(F.desc(close), "id"))
    return seen.join(fan_in, "id", "left").withColumn("rank", rank).filter(F.col("rank") <= cap).select(F.col("start").alias("entry"), "id", "depth", F.coalesce("fan_in", F.lit(0)).alias("fan_in"))


def criticality(g: Graph, members: DataFrame, *, min_size: int = 3) -> DataFrame:
    """entry, node_count, depth, criticality = size up to .6 + average fan-in up to .25 + name bonus - .2 for tests, in 0..1."""
    s = members.groupBy("entry").agg(F.count(F.lit(1)).alias("node_count"), F.max("depth").alias("depth"), F.avg("fan_in").alias("fan"))
    e = s.filter(F.col("node_count") >= min_size).join(g.nodes.select(F.col("id").alias("entry"), "name", "is_test"), "entry")
    bonus = F.when(F.lower("name").rlike("main|handle|process|run"), 0.15).otherwise(0.0)
    c = F.least(0.1 * F.col("node_count"), F.lit(0.6)) + F.least(F.col("fan") / 8, F.lit(0.25)) + bonus - F.when(F.col("is_test"), 0.2).otherwise(0.0)
    return e.select("entry", "node_count", "depth", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)), 6).alias("criticality"))


def materialise_flows(g: Graph, *, min_size: int = 3, max_depth: int = 6) -> tuple[DataFrame, DataFrame]:
    """Flow rows and (entry, id) membership; applying it twice gives the same flows."""
    members = trace(g, entry_points(g), max_depth=max_depth)
    flows = criticality(g, members, min_size=min_size)
    return flows, members.join(flows.select("entry"), "entry", "left_semi")


def participation(flows: DataFrame, members: DataFrame) -> DataFrame:
    """id, criticality: the sum over the flows that a node is a member of."""
    return members.join(flows.select("entry", "criticality"), "entry").groupBy("id").agg(F.round(F.sum("criticality"), 6).alias("criticality"))


def flows_through(flows: DataFrame, members: DataFrame, ids: DataFrame) -> DataFrame:
    hit = members.join(ids.select("id"), "id", "left_semi").select("entry").distinct()
    return flows.join(hit, "entry", "left_semi").orderBy(F.desc("criticality"), "entry")
