"""Graph primitives: counts, lookups, upsert, merge, removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.adapters import Graph


def kind_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def status(g: Graph) -> DataFrame:
    """Node and edge counts with call resolution, one row."""
    n = g.nodes.agg(F.count(F.lit(1)).alias("nodes"), F.countDistinct("kind").alias("node_kinds"), F.countDistinct("source_uri").alias("sources"))
    e = g.edges.agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("kind").alias("edge_kinds"), F.sum((F.col("conf_class") == "extracted").cast("long")).alias("extracted"))
    return n.withColumn("k", F.lit(1)).join(e.withColumn("k", F.lit(1)), "k").drop("k")


def in_degree_by_kind(g: Graph, kind: str) -> DataFrame:
    return g.edges.filter(F.col("kind") == kind).groupBy("dst").agg(F.count(F.lit(1)).alias("in_degree"))


def neighbours(g: Graph, node: int, *, incoming: bool = False) -> DataFrame:
    here, there = ("dst", "src") if incoming else ("src", "dst")
    e = g.edges.filter(F.col(here) == node).select(F.col(there).alias("id"), F.col("kind").alias("edge_kind"), F.col("id").alias("edge_id"))
    return e.join(g.nodes.select("id", "qualified_name", "kind"), "id")


def find_by_qname(g: Graph, qname: str) -> DataFrame:
    return g.nodes.filter(F.col("qualified_name") == qname)


def remove_nodes(g: Graph, ids: DataFrame) -> Graph:
    """Drop nodes and every incident edge."""
    gone = ids.select("id").distinct()
    e = g.edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return Graph(g.nodes.join(gone, "id", "left_anti"), e.select(g.edges.columns))


def remove_first_parallel(g: Graph, kind: str) -> Graph:
    """Drop the first of the parallel edges of a kind between two nodes."""
    nth = F.row_number().over(Window.partitionBy("src", "dst", "kind").orderBy("id"))
    return Graph(g.nodes, g.edges.withColumn("nth", nth).filter((F.col("kind") != kind) | (F.col("nth") != 1)).drop("nth"))


def merge_nodes(g: Graph, mapping: DataFrame) -> Graph:
    """Move the edges of ``loser`` to ``winner``; drop what turns into a self-loop or repeats (src, dst, kind)."""
    m = mapping.select("loser", "winner")
    e = g.edges
    for end in ("src", "dst"):
        e = e.join(m.withColumnRenamed("loser", end), end, "left").withColumn(end, F.coalesce("winner", end)).withColumn(f"moved_{end}", F.col("winner").isNotNull()).drop("winner")
    moved = F.col("moved_src") | F.col("moved_dst")
    nth = F.row_number().over(Window.partitionBy("src", "dst", "kind").orderBy(moved.cast("int"), "id"))
    e = e.withColumn("moved", moved).withColumn("nth", nth).filter(~F.col("moved") | ((F.col("src") != F.col("dst")) & (F.col("nth") == 1)))
    return Graph(g.nodes.join(m.select(F.col("loser").alias("id")), "id", "left_anti"), e.select(g.edges.columns))


def upsert(old: DataFrame, new: DataFrame, *, fill: list[str]) -> DataFrame:
    """Existing rows win by qualified name; new ones only fill their nulls."""
    both = old.withColumn("turn", F.lit(0)).unionByName(new.withColumn("turn", F.lit(1)))
    rank = F.struct("turn", "id")
    keep = [c for c in old.columns if c != "qualified_name"]
    return both.groupBy("qualified_name").agg(*((F.min_by(c, F.when(F.col(c).isNotNull(), rank)) if c in fill else F.min_by(c, rank)).alias(c) for c in keep)).select(old.columns)


def merge_graphs(a: Graph, b: Graph) -> Graph:
    """Union by qualified name; existing nodes stay as they are, self-loops and repeated edges of ``b`` go."""
    new = b.nodes.join(a.nodes.select("qualified_name"), "qualified_name", "left_anti").select(a.nodes.columns)
    known = b.nodes.select("id", "qualified_name").join(a.nodes.select("qualified_name", F.col("id").alias("to")), "qualified_name").select(F.col("id").alias("from"), "to")
    e = b.edges
    for end in ("src", "dst"):
        e = e.join(known.withColumnRenamed("from", end), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    e = e.filter("src <> dst").dropDuplicates(["src", "dst", "kind"]).join(a.edges.select("src", "dst", "kind").distinct(), ["src", "dst", "kind"], "left_anti")
    return Graph(a.nodes.unionByName(new), a.edges.unionByName(e.select(a.edges.columns)))


def name_of(qname: Column) -> Column:
    return F.element_at(F.split(qname, "::"), -1)


def scope_key(qname: Column, node_id: Column) -> Column:
    return F.coalesce(qname, F.concat(F.lit("func::"), node_id.cast("string")))


def cut_text(text: Column, limit: int = 10_000) -> Column:
    """At most ``limit`` UTF-8 bytes, without a partial last character."""
    raw = F.encode(text, "UTF-8")
    return F.when(F.octet_length(raw) <= limit, text).otherwise(F.regexp_replace(F.decode(F.substring(raw, 1, limit), "UTF-8"), "�+$", ""))


def call_resolution_stats(g: Graph) -> DataFrame:
    """Resolved calls against placeholders, and their rate (1 without calls)."""
    c = g.edges.filter("kind = 'calls'").join(g.nodes.select(F.col("id").alias("dst"), "qualified_name"), "dst", "left")
    bad = F.coalesce(F.col("qualified_name").startswith("call::"), F.lit(False)).cast("long")
    s = c.agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.sum(bad), F.lit(0)).cast("long").alias("unresolved"))
    return s.select((F.col("total") - F.col("unresolved")).alias("resolved"), "unresolved", "total", F.when(F.col("total") == 0, 1.0).otherwise(F.round((F.col("total") - F.col("unresolved")) / F.col("total"), 4)).alias("rate"))
