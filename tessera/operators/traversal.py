"""Traversal, paths and impact. Frontiers are tables; each round joins the frontier with the edges once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera import schemas
from tessera.runtime import discard, materialise
from tessera.sources.adapters import Graph


def _pairs(g: Graph, kinds: list[str] | None, direction: str, min_confidence: float | None) -> DataFrame:
    e = g.edges if kinds is None else g.edges.filter(F.col("kind").isin(kinds))
    if min_confidence is not None:
        e = e.filter(F.col("confidence") >= min_confidence)
    out = e.select(F.col("src").alias("here"), F.col("dst").alias("there"))
    into = e.select(F.col("dst").alias("here"), F.col("src").alias("there"))
    return {"out": out, "in": into, "both": out.unionByName(into)}[direction].distinct()


def bfs(g: Graph, starts: DataFrame, *, kinds: list[str] | None = None, direction: str = "out", max_hops: int = 6, min_confidence: float | None = None) -> DataFrame:
    """start, id, depth: nodes first reached from each start, by breadth. ``starts`` has a column id."""
    pairs = materialise(_pairs(g, kinds, direction, min_confidence), "bfs-edges")
    seen = materialise(starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("depth")).distinct(), "bfs-0")
    levels, frontier = [seen], seen
    for hop in range(1, max_hops + 1):
        step = frontier.join(pairs, frontier["id"] == pairs["here"]).select("start", F.col("there").alias("id")).distinct()
        for level in levels:
            step = step.join(level.select("start", "id"), ["start", "id"], "left_anti")
        frontier = materialise(step.withColumn("depth", F.lit(hop)), f"bfs-{hop}")
        if frontier.isEmpty():
            break
        levels.append(frontier)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def callees(g: Graph, starts: DataFrame, max_hops: int = 6) -> DataFrame:
    return bfs(g, starts, kinds=["calls"], max_hops=max_hops).filter("depth > 0")


def callers(g: Graph, starts: DataFrame, max_hops: int = 6, min_confidence: float = 0.5) -> DataFrame:
    return bfs(g, starts, kinds=["calls"], direction="in", max_hops=max_hops, min_confidence=min_confidence).filter("depth > 0")


def max_depth(g: Graph, starts: DataFrame, max_hops: int = 20) -> DataFrame:
    return bfs(g, starts, kinds=["calls"], max_hops=max_hops).groupBy("start").agg(F.max("depth").alias("max_depth"))


def impact_bfs(g: Graph, starts: DataFrame, *, direction: str = "out", max_hops: int = 3) -> DataFrame:
    """Reached nodes scored 1 / (depth + 1), every edge kind."""
    return bfs(g, starts, direction=direction, max_hops=max_hops).filter("depth > 0").withColumn("score", F.round(1 / (F.col("depth") + 1), 6))


def simple_paths(g: Graph, starts: DataFrame, *, max_hops: int = 3, target: int | None = None, kinds: list[str] | None = None, min_confidence: float | None = None) -> DataFrame:
    """start, target, path (ids), hops: all paths without a repeated node, up to the bound."""
    pairs = _pairs(g, kinds, "out", min_confidence)
    frontier = starts.select(F.col("id").alias("start"), F.array("id").alias("path"), F.col("id").alias("last"))
    found = []
    for hop in range(1, max_hops + 1):
        frontier = frontier.join(pairs, F.col("last") == F.col("here")).filter(~F.array_contains("path", F.col("there")))
        frontier = frontier.select("start", F.concat("path", F.array("there")).alias("path"), F.col("there").alias("last"))
        if hop < max_hops:
            frontier = materialise(frontier, f"paths-{hop}")
        found.append(frontier.select("start", F.col("last").alias("target"), "path", F.lit(hop).alias("hops")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out if target is None else out.filter(F.col("target") == target)


def _ahead(steps: DataFrame, target: int | None, max_hops: int) -> DataFrame:
    """last, left, bound: what a path that ends at a node still costs at least if it goes on, with so many hops left.

    Without a target that is the node's cheapest step; with one, the cheapest way there in that many hops, searched backwards from it.
    """
    if target is None:
        first = steps.groupBy(F.col("here").alias("last")).agg(F.min("step").alias("bound"))
        return first.select("last", F.explode(F.sequence(F.lit(1), F.lit(max_hops))).alias("left"), "bound")
    near = steps.filter(F.col("there") == target).select(F.col("here").alias("last"), F.col("step").alias("bound"))
    out = near.withColumn("left", F.lit(1))
    for left in range(2, max_hops + 1):
        further = steps.join(near.withColumnRenamed("last", "there"), "there").select(F.col("here").alias("last"), (F.col("step") + F.col("bound")).alias("bound"))
        near = materialise(near.unionByName(further).groupBy("last").agg(F.min("bound").alias("bound")), "ahead")
        out = out.unionByName(near.withColumn("left", F.lit(left)))
    return out.select("last", "left", "bound")


def _ranked(paths: DataFrame, limit: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("start").orderBy("cost", F.size("path"), "path"))
    return paths.withColumn("rank", rank).filter(F.col("rank") <= limit)


def top_paths(g: Graph, starts: DataFrame, *, target: int | None = None, max_hops: int = 3, limit: int = 10, report: list[int] | None = None) -> DataFrame:
    """Cheapest simple paths by kind cost over max(confidence, .05), the cheapest parallel edge of each step; ties by length, then path.

    Best first: a beam of the most promising paths finds some good ones, whose ``limit``-th cost is what every other path must stay below.
    Then all paths are written out hop by hop, but only while their cost and the least that is still ahead of them does not
    exceed the ``limit``-th cost known for their start, which falls as paths are found. No path among the cheapest is lost. ``report`` takes the number of rows of each hop.
    """
    cost = schemas.weight(F.col("kind"), schemas.PATH_COST, schemas.DEFAULTS["path"]) / F.greatest("confidence", F.lit(0.05))
    steps = materialise(g.edges.filter("src <> dst").select(F.col("src").alias("here"), F.col("dst").alias("there"), cost.alias("step")).groupBy("here", "there").agg(F.min("step").alias("step")), "path-steps")
    ahead = materialise(_ahead(steps, target, max_hops), "path-ahead")
    begin = materialise(starts.select(F.col("id").alias("start"), F.array("id").alias("path"), F.col("id").alias("last"), F.lit(0.0).alias("cost")).distinct(), "path-begin")
    there = F.lit(True) if target is None else F.col("last") == target

    def promising(paths: DataFrame, hop: int) -> DataFrame:
        open_ = paths if target is None else paths.filter(F.col("last") != target)
        return open_.join(ahead.filter(F.col("left") == max_hops - hop).drop("left"), "last").withColumn("least", F.col("cost") + F.col("bound"))

    def longer(paths: DataFrame) -> DataFrame:
        out = paths.join(steps, F.col("last") == F.col("here")).filter(~F.array_contains("path", F.col("there")))
        return out.select("start", F.concat("path", F.array("there")).alias("path"), F.col("there").alias("last"), (F.col("cost") + F.col("step")).alias("cost"))

    def bar(paths: DataFrame) -> DataFrame:
        return _ranked(paths, limit).filter(F.col("rank") == limit).select("start", F.col("cost").alias("most"))

    found, beam = None, begin
    for hop in range(max_hops):
        row = F.row_number().over(Window.partitionBy("start").orderBy("least", "path"))
        beam = materialise(longer(promising(beam, hop).withColumn("row", row).filter(F.col("row") <= 4 * limit)), "path-beam")
        done = beam.filter(there)
        found = done if found is None else found.unionByName(done)
    most = materialise(bar(found), "path-bar")
    frontier, found = begin, None
    for hop in range(max_hops):
        kept = promising(frontier, hop).join(most, "start", "left").filter(F.col("most").isNull() | (F.col("least") <= F.col("most") + 1e-9))
        frontier = materialise(longer(kept), "path-frontier")
        if report is not None:
            report.append(frontier.count())
        done = frontier.filter(there)
        found = done if found is None else found.unionByName(done)
        if hop < max_hops - 1:
            most = materialise(most.unionByName(bar(found)).groupBy("start").agg(F.min("most").alias("most")), "path-bar")
    return _ranked(found, limit).select("start", "rank", "path", F.round("cost", 6).alias("cost"))


def diverse_paths(paths: DataFrame, *, limit: int = 10, overlap: float = 0.7, free: int = 3) -> DataFrame:
    """In rank order, after ``free`` paths drop those whose node set overlaps a kept one by Jaccard above ``overlap``."""
    ordered = paths.groupBy("start").agg(F.sort_array(F.collect_list(F.struct("rank", "path", "cost"))).alias("all"))
    empty = F.filter(F.col("all"), lambda x: F.lit(False))

    def keep(kept, x):
        near = F.exists(kept, lambda k: F.size(F.array_intersect(k["path"], x["path"])) / F.size(F.array_union(k["path"], x["path"])) > overlap)
        return F.when((F.size(kept) >= limit) | ((F.size(kept) >= free) & near), kept).otherwise(F.concat(kept, F.array(x)))

    return ordered.select("start", F.explode(F.aggregate("all", empty, keep)).alias("x")).select("start", "x.rank", "x.path", "x.cost")


def top_diverse_paths(g: Graph, starts: DataFrame, *, target: int | None = None, max_hops: int = 3, limit: int = 10, overlap: float = 0.7, free: int = 3) -> DataFrame:
    """The first ``limit`` paths by rank that don't overlap an earlier one; more ranks are read until every start has them or has no more paths."""
    ranks = 5 * limit
    while True:
        paths = materialise(top_paths(g, starts, target=target, max_hops=max_hops, limit=ranks), "diverse-ranks")
        kept = materialise(diverse_paths(paths, limit=limit, overlap=overlap, free=free), "diverse")
        few = kept.groupBy("start").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < limit)
        more = paths.groupBy("start").agg(F.max("rank").alias("r")).filter(F.col("r") == ranks)
        if few.join(more, "start", "left_semi").isEmpty():
            return kept
        discard(paths)
        discard(kept)
        ranks *= 4


def impact_ranked(g: Graph, starts: DataFrame, *, max_hops: int = 4) -> DataFrame:
    """Least cost over reverse edges and penalised forward structural ones within the hop bound; score = boost / (1 + cost)."""
    conf = F.greatest("confidence", F.lit(0.05))
    back = g.edges.select(F.col("dst").alias("here"), F.col("src").alias("there"), (schemas.weight(F.col("kind"), schemas.REVERSE_IMPACT, schemas.DEFAULTS["impact"]) / conf).alias("step"))
    ahead = g.edges.filter(F.col("kind").isin(*schemas.FORWARD_IMPACT)).select(F.col("src").alias("here"), F.col("dst").alias("there"), (schemas.weight(F.col("kind"), schemas.FORWARD_IMPACT, 9.0) / conf).alias("step"))
    steps = materialise(back.unionByName(ahead).groupBy("here", "there").agg(F.min("step").alias("step")), "impact-steps")
    best = starts.select(F.col("id").alias("start"), "id", F.lit(0.0).alias("cost"), F.lit(0).alias("hops"))
    frontier = best
    for hop in range(1, max_hops + 1):
        reach = frontier.join(steps, F.col("id") == F.col("here")).select("start", F.col("there").alias("id"), (F.col("cost") + F.col("step")).alias("cost"), F.lit(hop).alias("hops"))
        merged = best.unionByName(reach).groupBy("start", "id").agg(F.min(F.struct("cost", "hops")).alias("x")).select("start", "id", "x.cost", "x.hops")
        best = materialise(merged, f"impact-{hop}")
        frontier = best.filter(F.col("hops") == hop)
        if frontier.isEmpty():
            break
    boost = schemas.weight(F.col("kind"), schemas.NODE_BOOST, schemas.DEFAULTS["boost"])
    return best.filter("hops > 0").join(g.nodes.select("id", "kind", "qualified_name", "source_uri"), "id").select("start", "id", "qualified_name", "source_uri", "hops", F.round("cost", 6).alias("cost"), F.round(boost / (1 + F.col("cost")), 4).alias("score"))


def affected_files(g: Graph, seed_uri: str, *, max_hops: int = 3, limit: int = 10) -> DataFrame:
    """Files by the best impact score that any symbol of the seed file gives them."""
    starts = g.nodes.filter(F.col("source_uri") == seed_uri).select("id")
    hit = impact_ranked(g, starts, max_hops=max_hops).filter(F.col("source_uri").isNotNull() & (F.col("source_uri") != seed_uri))
    return hit.groupBy("source_uri").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "source_uri").limit(limit)


def minimal_context(g: Graph, starts: DataFrame, *, max_hops: int = 1, limit: int = 50) -> DataFrame:
    return bfs(g, starts, direction="both", max_hops=max_hops).orderBy("depth", "id").limit(limit)


def call_neighbours(g: Graph, node: int, *, incoming: bool) -> DataFrame:
    """One hop over calls with confidence of .5 or more, by name."""
    here, there = ("dst", "src") if incoming else ("src", "dst")
    e = g.edges.filter((F.col("kind") == "calls") & (F.col("confidence") >= 0.5) & (F.col(here) == node)).select(F.col(there).alias("id")).distinct()
    return e.join(g.nodes.select("id", "qualified_name"), "id")


def related(g: Graph, node: int) -> DataFrame:
    out = g.edges.filter(F.col("src") == node).select(F.col("dst").alias("id"))
    into = g.edges.filter(F.col("dst") == node).select(F.col("src").alias("id"))
    return out.unionByName(into).distinct().join(g.nodes.select("id", "qualified_name", "kind"), "id")


def traverse_budget(g: Graph, starts: DataFrame, *, max_hops: int = 3, token_budget: int = 1200) -> DataFrame:
    """Nodes in breadth order while the running token count (characters / 4) stays within the budget."""
    seen = bfs(g, starts, direction="both", max_hops=max_hops).join(g.nodes.select("id", "qualified_name"), "id")
    tokens = F.greatest(F.lit(1), F.expr("length(qualified_name) div 4"))
    running = F.sum("tokens").over(Window.partitionBy("start").orderBy("depth", "id").rowsBetween(Window.unboundedPreceding, 0))
    return seen.withColumn("tokens", tokens).withColumn("running", running).filter(F.col("running") <= token_budget)


def counterfactual(g: Graph, start: int, removed: int, *, max_hops: int = 5) -> DataFrame:
    """Nodes that ``start`` reaches, but not once ``removed`` has lost its edges."""
    spark = g.nodes.sparkSession
    at = spark.createDataFrame([(start,)], "id long")
    before = bfs(g, at, max_hops=max_hops)
    cut = Graph(g.nodes, g.edges.filter((F.col("src") != removed) & (F.col("dst") != removed)))
    after = bfs(cut, at, max_hops=max_hops)
    return before.join(after.select("id"), "id", "left_anti").select("id", "depth")


def rename_sites(g: Graph, node: int) -> DataFrame:
    """The definition and every calling or importing node, once per place."""
    own = g.nodes.filter(F.col("id") == node).select("id", F.lit("definition").alias("site"), F.lit("HIGH").alias("confidence"))
    use = g.edges.filter((F.col("dst") == node) & F.col("kind").isin("calls", "imports")).select(F.col("src").alias("id"), F.col("kind").alias("site"), F.when(F.col("conf_class") == "extracted", "HIGH").otherwise("MEDIUM").alias("confidence"))
    return own.unionByName(use.groupBy("id", "site").agg(F.min("confidence").alias("confidence")))


def rename_counts(sites: DataFrame) -> DataFrame:
    """confidence, sites, nodes: how many places a rename would touch, by how sure they are, and in how many nodes."""
    return sites.groupBy("confidence").agg(F.count(F.lit(1)).alias("sites"), F.countDistinct("id").alias("nodes"))
