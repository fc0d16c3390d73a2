"""One-pass structural operators: degrees, motifs, coverage, gaps, dead code, surprise."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.runtime import materialise
from tessera.sources.adapters import Graph


def degrees(edges: DataFrame) -> DataFrame:
    """id, in_degree, out_degree, degree over parallel edges; one shuffle of both ends."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    return ends.groupBy("x.id").agg(F.sum("x.i").alias("in_degree"), F.sum("x.o").alias("out_degree"), F.count(F.lit(1)).alias("degree"))


def hub_nodes(g: Graph, top: int = 20) -> DataFrame:
    """Most connected nodes, parallel edges counted."""
    return degrees(g.edges).join(g.nodes.select("id", "qualified_name", "kind"), "id").orderBy(F.desc("degree"), "id").limit(top)


def hub_nodes_simple(g: Graph, top: int = 20) -> DataFrame:
    """Degree centrality of the simple digraph: distinct neighbours either way over n - 1."""
    n = g.nodes.count()
    pairs = g.edges.select("src", "dst").distinct()
    d = degrees(pairs).select("id", "degree")
    return d.join(g.nodes.select("id", "qualified_name"), "id").select("id", "qualified_name", F.round(F.col("degree") / F.lit(float(max(1, n - 1))), 6).alias("centrality")).orderBy(F.desc("centrality"), "id").limit(top)


def god_nodes_degree(g: Graph, min_degree: int = 20) -> DataFrame:
    return degrees(g.edges).filter(F.col("degree") >= min_degree).join(g.nodes.select("id", "qualified_name", "kind"), "id").select("id", "qualified_name", "kind", "degree")


def fan(g: Graph, *, incoming: bool, threshold: int = 3, kinds: list[str] | None = None) -> DataFrame:
    """Nodes with at least ``threshold`` distinct neighbours on one side."""
    here, there = ("dst", "src") if incoming else ("src", "dst")
    e = g.edges if kinds is None else g.edges.filter(F.col("kind").isin(kinds))
    return e.select(here, there).distinct().groupBy(F.col(here).alias("id")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= threshold)


def feedback(edges: DataFrame) -> DataFrame:
    """Unordered pairs with an edge each way; a self-loop is its own pair."""
    p = edges.select("src", "dst").distinct()
    back = p.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return p.filter("src <= dst").join(back, ["src", "dst"])


def _two_steps(edges: DataFrame) -> DataFrame:
    """a, m, d: paths of two edges of the simple digraph over three different nodes."""
    p = edges.select("src", "dst").distinct()
    return p.select(F.col("src").alias("a"), F.col("dst").alias("m")).join(p.select(F.col("src").alias("m"), F.col("dst").alias("d")), "m").filter("a <> d AND a <> m AND m <> d")


def diamonds(edges: DataFrame, *, limit: int = 50) -> DataFrame:
    """The first ``limit`` of a -> b, a -> c, b -> d, c -> d with b < c and d <> a, by (a, d, b, c).

    Only pairs (a, d) that can be among them are listed, and of each the first ``limit`` + 1 middle nodes.
    """
    first = diamond_counts(edges).select("a", "d").orderBy("a", "d").limit(limit)
    place = F.row_number().over(Window.partitionBy("a", "d").orderBy("m"))
    first = materialise(first, "diamond-first")
    end = lambda c, to: F.broadcast(first.select(F.col(c).alias(to)).distinct())
    p = edges.select("src", "dst")
    near = p.join(end("a", "src"), "src", "left_semi").unionByName(p.join(end("d", "dst"), "dst", "left_semi"))
    two = _two_steps(near).join(F.broadcast(first), ["a", "d"]).withColumn("place", place).filter(F.col("place") <= limit + 1).drop("place")
    pairs = two.withColumnRenamed("m", "b").join(two.withColumnRenamed("m", "c"), ["a", "d"]).filter("b < c")
    return pairs.select("a", "b", "c", "d").orderBy("a", "d", "b", "c").limit(limit)


#: Targets of a middle node that travel in one row, and paths that one task counts.
_PIECE, _PATHS = 4096, 2_000_000


def diamond_counts(edges: DataFrame) -> DataFrame:
    """Diamonds per (a, d) without listing them: k middle nodes make k (k - 1) / 2.

    What travels to ``a`` is an edge with the targets of its middle node, in sorted pieces of ``_PIECE`` or so, not a row a path: the pieces are unfolded and
    counted where all edges of ``a`` are, in as many tasks as keep the paths of one to ``_PATHS``.
    """
    p = materialise(edges.select("src", "dst").distinct(), "diamond-edges")
    piece = F.pmod(F.xxhash64("dst"), F.ceil(F.col("n") / _PIECE))
    sizes = p.groupBy(F.col("src").alias("m")).agg(F.count(F.lit(1)).alias("n"))
    out = p.withColumnRenamed("src", "m").join(sizes, "m").groupBy("m", piece.alias("piece")).agg(F.sort_array(F.collect_list("dst")).alias("ds"))
    paths = p.select(F.col("src").alias("a"), F.col("dst").alias("m")).filter("a <> m").join(out, "m")
    number = p.groupBy(F.col("dst").alias("m")).agg(F.count(F.lit(1)).alias("into")).join(sizes, "m").agg(F.sum(F.col("into") * F.col("n"))).first()[0] or 0
    parts = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), number // _PATHS)
    met = paths.repartition(parts, "a").select("a", "m", F.explode("ds").alias("d")).filter("a <> d AND m <> d")
    return met.groupBy("a", "d").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("a", "d", F.expr("k * (k - 1) div 2").alias("diamonds"))


def large_functions(g: Graph, min_lines: int = 30) -> DataFrame:
    lines = F.col("line_end") - F.coalesce("line_start", F.lit(0))
    return g.nodes.filter(F.col("kind").isin("function", "method")).withColumn("lines", lines).filter(F.col("lines") >= min_lines).select("id", "qualified_name", "lines")


def dead_code(g: Graph, kinds: tuple[str, ...] = ("function", "method", "class")) -> DataFrame:
    """Callables and classes that nothing calls, imports, tests, inherits or refers to; entry points and tests aside."""
    used = g.edges.filter(F.col("kind").isin("calls", "imports", "tested_by", "inherits", "implements", "reads_writes", "data_flow", "mentions", "depends_on")).select(F.col("dst").alias("id")).distinct()
    entry = F.lower("name").rlike(r"^(main|__main__|run|start|serve|handler|lambda_handler|app|cli|setup|teardown)$")
    return g.nodes.filter(F.col("kind").isin(*kinds) & ~F.col("is_test") & ~entry).join(used, "id", "left_anti").select("id", "qualified_name", "kind")


def isolated(g: Graph) -> DataFrame:
    ends = g.edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return g.nodes.join(ends, "id", "left_anti").select("id", "qualified_name", "kind")


def gaps(g: Graph, max_degree: int = 1) -> DataFrame:
    d = g.nodes.join(degrees(g.edges).select("id", "degree"), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return d.filter(F.col("degree") <= max_degree).select("id", "qualified_name", "degree", F.when(F.col("degree") == 0, "isolated").otherwise("weakly_connected").alias("gap"))


def untested_hotspots(g: Graph, min_degree: int = 5) -> DataFrame:
    tested = g.edges.filter("kind = 'tested_by'").select(F.col("src").alias("id")).distinct()
    called = g.edges.join(g.nodes.filter("is_test").select(F.col("id").alias("src")), "src", "left_semi").filter("kind = 'calls'").select(F.col("dst").alias("id")).distinct()
    hot = degrees(g.edges).filter(F.col("degree") >= min_degree).select("id", "degree")
    return g.nodes.filter(F.col("kind").isin("function", "method", "class") & ~F.col("is_test")).join(hot, "id").join(tested, "id", "left_anti").join(called, "id", "left_anti").select("id", "degree")


def coverage(g: Graph) -> DataFrame:
    """Rates by kind: with source, with location, connected, with callers, with callees; all in one pass over degrees."""
    e = g.edges
    calls = e.filter("kind = 'calls'").select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("into")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("into")))).alias("x")).groupBy("x.id").agg(F.max("x.out").alias("calls_out"), F.max("x.into").alias("calls_in"))
    n = g.nodes.join(degrees(e).select("id", "degree"), "id", "left").join(calls, "id", "left")
    rate = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 4)
    return n.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"),
        rate(F.col("source_uri").isNotNull()).alias("source_rate"),
        rate(F.col("line_end").isNotNull()).alias("location_rate"),
        rate(F.col("degree").isNotNull()).alias("connectivity"),
        rate(F.col("calls_in") == 1).alias("caller_rate"),
        rate(F.col("calls_out") == 1).alias("callee_rate"),
    )


def diagnostics(g: Graph) -> DataFrame:
    """Confidence mix by edge kind."""
    return g.edges.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), *(F.sum((F.col("conf_class") == c).cast("long")).alias(c) for c in ("extracted", "inferred", "ambiguous")))


def surprise_pairs(g: Graph, communities: DataFrame) -> DataFrame:
    """Edges per unordered pair of different communities; unassigned nodes are "unknown"."""
    c = communities.select("id", F.col("community").cast("string").alias("c"))
    e = g.edges.join(c.select(F.col("id").alias("src"), F.col("c").alias("a")), "src", "left").join(c.select(F.col("id").alias("dst"), F.col("c").alias("b")), "dst", "left")
    e = e.select(F.coalesce("a", F.lit("unknown")).alias("a"), F.coalesce("b", F.lit("unknown")).alias("b")).filter("a <> b")
    return e.groupBy(F.least("a", "b").alias("left_community"), F.greatest("a", "b").alias("right_community")).agg(F.count(F.lit(1)).alias("n"))


def surprise_edges(g: Graph, communities: DataFrame) -> DataFrame:
    """Cross-community edges scored .25 confidence + .20 kind change + .15 source change + .20 community + .20 periphery to hub."""
    d = degrees(g.edges).select("id", "degree")
    info = g.nodes.select("id", F.col("kind").alias("k"), "source_uri").join(communities.select("id", "community"), "id").join(d, "id")
    e = g.edges.select("id", "src", "dst", "conf_class")
    for end, x in (("src", "a"), ("dst", "b")):
        e = e.join(info.select(F.col("id").alias(end), *(F.col(c).alias(f"{x}_{c}") for c in ("k", "source_uri", "community", "degree"))), end)
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    low, high = F.least("a_degree", "b_degree"), F.greatest("a_degree", "b_degree")
    weak = F.when(F.col("conf_class") == "ambiguous", 1.0).when(F.col("conf_class") == "inferred", 0.5).otherwise(0.0)
    score = 0.25 * weak + 0.20 * one(F.col("a_k") != F.col("b_k")) + 0.15 * one(~F.col("a_source_uri").eqNullSafe(F.col("b_source_uri"))) + 0.20 * one(F.col("a_community") != F.col("b_community")) + 0.20 * one((low <= 2) & (high >= 5))
    return e.filter("a_community <> b_community").select("id", "src", "dst", F.round(score, 4).alias("score"))
