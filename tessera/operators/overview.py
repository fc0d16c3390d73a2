"""Reports over a graph: summaries, bridges, change impact, savings, cycles, freshness."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import biconnected, centrality
from tessera.operators.structure import degrees
from tessera.runtime import discard, materialise
from tessera.sources.adapters import Graph


def graph_summary(g: Graph, top: int = 5) -> DataFrame:
    """what (kind, source), key, n: nodes per kind, and the ``top`` sources with most nodes."""
    kinds = g.nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(F.lit("kind").alias("what"), F.col("kind").alias("key"), "n")
    sources = g.nodes.filter("source_uri IS NOT NULL").groupBy("source_uri").agg(F.count(F.lit(1)).alias("n"))
    return kinds.unionByName(sources.orderBy(F.desc("n"), "source_uri").limit(top).select(F.lit("source").alias("what"), F.col("source_uri").alias("key"), "n"))


def communities_touched(g: Graph, communities: DataFrame) -> DataFrame:
    """id, touched: how many communities a node's neighbours are in."""
    c = communities.select("id", "community")
    ends = g.edges.select(F.col("src").alias("id"), F.col("dst").alias("other")).unionByName(g.edges.select(F.col("dst").alias("id"), F.col("src").alias("other"))).distinct()
    return ends.join(c.withColumnRenamed("id", "other"), "other").select("id", "community").distinct().groupBy("id").agg(F.count(F.lit(1)).alias("touched"))


def bridge_nodes(g: Graph, communities: DataFrame) -> DataFrame:
    """id, touched: nodes whose neighbours lie in more than one community."""
    return communities_touched(g, communities).filter("touched > 1")


def bridge_scores(g: Graph, communities: DataFrame, *, limit: int = 20, max_sources: int = 64) -> DataFrame:
    """3 for each community touched, plus degree, plus the root of betweenness, plus 12 for a cut vertex."""
    between = centrality.betweenness(g, max_sources=max_sources).select("id", F.col("score").alias("betweenness"))
    cut = biconnected.articulation_points(g.edges).withColumn("articulation", F.lit(True))
    d = g.nodes.select("id").join(communities_touched(g, communities), "id", "left").join(degrees(g.edges).select("id", "degree"), "id", "left").join(between, "id", "left").join(cut, "id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    d = d.select("id", zero("touched").alias("touched"), zero("degree").alias("degree"), zero("betweenness").cast("double").alias("betweenness"), F.coalesce("articulation", F.lit(False)).alias("articulation"))
    score = 3.0 * F.col("touched") + F.col("degree") + F.sqrt("betweenness") + F.when(F.col("articulation"), 12.0).otherwise(0.0)
    return d.withColumn("score", F.round(score, 4)).filter("score > 0").orderBy(F.desc("score"), "id").limit(limit)


def simple_cycles(edges: DataFrame, *, max_length: int = 4, limit: int = 100) -> DataFrame:
    """path: cycles of up to ``max_length`` nodes, each once, from its smallest node; the first ``limit`` by length and path."""
    p = edges.select("src", "dst").distinct()
    found = p.filter("src = dst").select(F.array("src").alias("path"))
    walk = p.filter("src < dst").select(F.array("src", "dst").alias("path"))
    step = p.select(F.col("src").alias("here"), F.col("dst").alias("there"))
    for n in range(2, max_length + 1):
        out = walk.join(step, F.element_at("path", -1) == F.col("here"))
        found = found.unionByName(out.filter("there = path[0]").select("path"))
        if n < max_length:
            walk = out.filter("there > path[0] AND NOT array_contains(path, there)").select(F.concat("path", F.array("there")).alias("path"))
    return found.orderBy(F.size("path"), "path").limit(limit)


def reach(g: Graph, starts: DataFrame, max_hops: int, *, incoming: bool) -> DataFrame:
    """id, depth: least number of edges from any start."""
    here, there = ("dst", "src") if incoming else ("src", "dst")
    pairs = g.edges.select(F.col(here).alias("here"), F.col(there).alias("there")).distinct()
    seen = materialise(starts.select("id", F.lit(0).alias("depth")).distinct(), "reach")
    front = seen
    for hop in range(1, max_hops + 1):
        front = materialise(front.join(pairs, F.col("id") == F.col("here")).select(F.col("there").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("depth", F.lit(hop)), "reach")
        seen = seen.unionByName(front)
    return seen


def counterfactual_edges(g: Graph, target: int, *, max_depth: int = 5) -> DataFrame:
    """id, depth: what is reached from ``target`` now and would not be without its outgoing edges."""
    start = g.nodes.filter(F.col("id") == target).select("id")
    before = reach(g, start, max_depth, incoming=False)
    after = reach(Graph(g.nodes, g.edges.filter(F.col("src") != target)), start, max_depth, incoming=False)
    return before.join(after.select("id"), "id", "left_anti")


def blast_radius(g: Graph, changed_files: DataFrame, *, max_depth: int = 2) -> DataFrame:
    """One row: changed files and symbols, nodes that reach them within ``max_depth``, symbols without a test."""
    changed = g.nodes.join(changed_files.select("source_uri"), "source_uri", "left_semi").select("id", "kind")
    hit = reach(g, changed.select("id"), max_depth, incoming=True)
    tests = g.edges.filter("kind = 'calls'").join(g.nodes.filter("is_test").select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
    symbols = changed.filter("kind IN ('function', 'method', 'class')")
    parts = [
        changed_files.select("source_uri").distinct().agg(F.count(F.lit(1)).alias("changed_files")),
        symbols.agg(F.count(F.lit(1)).alias("changed_symbols")),
        hit.filter("depth > 0").agg(F.count(F.lit(1)).alias("impacted")),
        symbols.join(tests, "id", "left_anti").agg(F.count(F.lit(1)).alias("untested")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out


def flows_affected(members: DataFrame, changed: DataFrame, *, limit: int | None = 20) -> DataFrame:
    """entry, hits: flows (entry, id) with a changed member, those with most hits first."""
    out = members.join(changed.select("id").distinct(), "id", "left_semi").groupBy("entry").agg(F.count(F.lit(1)).alias("hits")).orderBy(F.desc("hits"), "entry")
    return out if limit is None else out.limit(limit)


def first_fit(files: DataFrame, *, budget: int, order: list[str], tokens: str = "tokens", batch: int = 1_000) -> DataFrame:
    """The rows that a reader with ``budget`` tokens takes in order, passing over what does not fit; the first is always taken.

    Each pass reads the next ``batch`` rows that still fit; the first of them is taken, so passes end with the budget.
    """
    row = F.struct(*order, tokens, *(c for c in files.columns if c not in (*order, tokens)))
    keyed = materialise(files.select(row.alias("row")), "first-fit")
    taken, used, last = [], 0, None
    while used < budget:
        open_ = keyed if last is None else keyed.filter((F.col("row") > last) & (F.col(f"row.{tokens}") <= budget - used))
        found = [r["row"] for r in open_.orderBy("row").limit(batch if last is not None else 1).collect()]
        for r in found:
            if used + r[tokens] <= budget or not taken:
                taken.append(r)
                used += r[tokens]
        if not found:
            break
        # The last row looked at, as a literal of the same type.
        kinds = keyed.schema["row"].dataType
        last = F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(found[-1], kinds)))
    discard(keyed)
    return files.sparkSession.createDataFrame(taken, keyed.schema["row"].dataType).select(files.columns)


def review_context(texts: DataFrame, changed: DataFrame, impacted: DataFrame, *, budget: int = 1600, max_lines: int = 200) -> DataFrame:
    """path, tokens of the snippets a reviewer gets: changed files first, then impacted ones, within the budget."""
    order = changed.select("path").distinct().withColumn("turn", F.lit(0)).unionByName(impacted.select("path").distinct().join(changed.select("path"), "path", "left_anti").withColumn("turn", F.lit(1)))
    snippet = F.array_join(F.slice(F.split("content", "\n"), 1, max_lines), "\n")
    sized = texts.join(order, "path").select("turn", "path", F.greatest(F.expr("1"), F.floor(F.length(snippet) / 4)).cast("long").alias("tokens"))
    return first_fit(sized, budget=budget, order=["turn", "path"]).select("path", "tokens")


def suggested_questions(changed_files: DataFrame, impacted: DataFrame, *, limit: int = 10) -> DataFrame:
    """place, question: one for each changed file, then one for each impacted name, then a general one."""
    a = changed_files.select(F.lit(0).alias("turn"), F.col("source_uri").alias("key"), F.concat(F.lit("What behavior changed in "), "source_uri", F.lit(" and is it covered by tests?")).alias("question"))
    b = impacted.select(F.lit(1).alias("turn"), F.col("qualified_name").alias("key"), F.concat(F.lit("Does the change alter assumptions relied on by "), "qualified_name", F.lit("?")).alias("question"))
    c = changed_files.sparkSession.createDataFrame([(2, "", "Are any unresolved calls or large functions involved in this change?")], "turn int, key string, question string")
    first = a.orderBy("key").limit(limit).unionByName(b.orderBy("key").limit(limit)).unionByName(c).orderBy("turn", "key").limit(limit)
    return first.withColumn("place", F.row_number().over(Window.orderBy("turn", "key"))).select("place", "question")


def token_savings(nodes: DataFrame, raw: DataFrame) -> DataFrame:
    """One row: tokens of the files (source_uri, raw_tokens) against tokens of what the graph says of them."""
    size = lambda c: F.greatest(F.lit(1), F.floor(F.length(c) / 4))
    span = F.when(F.col("line_start").isNotNull() & F.col("line_end").isNotNull(), F.concat("line_start", F.lit("-"), "line_end")).otherwise(F.lit(""))
    said = nodes.filter("source_uri IS NOT NULL").groupBy("source_uri").agg(F.sum(size(F.col("qualified_name")) + size(F.col("kind")) + size(span)).alias("graph"))
    d = said.join(raw, "source_uri", "left").agg(F.count(F.lit(1)).alias("files_measured"), F.coalesce(F.sum("raw_tokens"), F.lit(0)).alias("raw_tokens"), F.sum("graph").alias("graph_tokens"))
    return d.withColumn("savings_percent", F.when(F.col("raw_tokens") > 0, F.round((F.col("raw_tokens") - F.least("graph_tokens", "raw_tokens")) / F.col("raw_tokens") * 100, 1)).otherwise(0.0)).withColumn("multiplier", F.when(F.col("graph_tokens") > 0, F.round(F.col("raw_tokens") / F.col("graph_tokens"), 1)).otherwise(0.0))


def freshness(stored: DataFrame, current: DataFrame) -> DataFrame:
    """state, added, modified, deleted from two (path, hash) tables."""
    d = stored.select("path", F.col("hash").alias("old")).join(current.select("path", F.col("hash").alias("new")), "path", "full")
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    out = d.agg(n(F.col("old").isNull()).alias("added"), n(F.col("old").isNotNull() & F.col("new").isNotNull() & (F.col("old") != F.col("new"))).alias("modified"), n(F.col("new").isNull()).alias("deleted"))
    return out.select(F.when(F.expr("added + modified + deleted = 0"), "fresh").otherwise("dirty").alias("state"), "added", "modified", "deleted")


def architecture_overview(g: Graph, communities: DataFrame) -> DataFrame:
    """One row: nodes, edges, communities, edges across communities and their share."""
    c = communities.select("id", "community")
    e = g.edges.join(c.select(F.col("id").alias("src"), F.col("community").alias("a")), "src").join(c.select(F.col("id").alias("dst"), F.col("community").alias("b")), "dst")
    across = e.agg(F.count(F.lit(1)).alias("labelled"), F.coalesce(F.sum((F.col("a") != F.col("b")).cast("long")), F.lit(0)).alias("across"))
    totals = g.nodes.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(g.edges.agg(F.count(F.lit(1)).alias("edges"))).crossJoin(c.agg(F.countDistinct("community").alias("communities")))
    return totals.crossJoin(across).select("nodes", "edges", "communities", "across", F.round(F.col("across") / F.greatest("labelled", F.lit(1)), 6).alias("coupling"))


def graph_json(g: Graph, communities: DataFrame, *, offset: int = 0, limit: int = 500) -> DataFrame:
    """json: one page of nodes by id, each with its community, for a viewer."""
    page = g.nodes.select("id", "qualified_name", "name", "kind").orderBy("id").offset(offset).limit(limit)
    d = page.join(communities.select("id", "community"), "id", "left")
    return d.select("id", F.to_json(F.struct("id", "qualified_name", "name", "kind", "community")).alias("json"))


def graph_json_edges(g: Graph, *, offset: int = 0, limit: int = 500) -> DataFrame:
    """id, json: the edges between the nodes of the same page, for a viewer."""
    page = g.nodes.select("id").orderBy("id").offset(offset).limit(limit)  # a page, so that it may be broadcast
    ends = F.broadcast(page)
    e = g.edges.join(ends.withColumnRenamed("id", "src"), "src").join(ends.withColumnRenamed("id", "dst"), "dst")
    return e.select("id", F.to_json(F.struct("id", F.col("src").alias("source"), F.col("dst").alias("target"), "kind", "confidence")).alias("json"))


def report_lines(g: Graph, top: int = 25) -> DataFrame:
    """place, line: a Markdown report with kind counts and the most connected nodes."""
    k = lambda df: df.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    line = lambda turn, df: df.select(F.lit(turn).alias("turn"), (-F.col("n")).alias("order"), "kind", F.concat(F.lit("- "), "kind", F.lit(": "), F.col("n").cast("string")).alias("line"))
    head = g.nodes.sparkSession.createDataFrame([(0, 0, "", "# Graph report"), (1, 0, "", "## Nodes"), (3, 0, "", "## Edges"), (5, 0, "", "## Hubs")], "turn int, order long, kind string, line string")
    hubs = degrees(g.edges).join(g.nodes.select("id", "qualified_name"), "id").orderBy(F.desc("degree"), "id").limit(top)
    hubs = hubs.select(F.lit(6).alias("turn"), (-F.col("degree")).alias("order"), F.col("id").cast("string").alias("kind"), F.concat(F.lit("- "), "qualified_name", F.lit(": "), F.col("degree").cast("string")).alias("line"))
    out = head.unionByName(line(2, k(g.nodes))).unionByName(line(4, k(g.edges))).unionByName(hubs)
    return out.withColumn("place", F.row_number().over(Window.orderBy("turn", "order", "kind"))).select("place", "line")
