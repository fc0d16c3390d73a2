"""Changes of a graph by hand: new nodes and edges, renames, removals, revisions, metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.primitives import merge_nodes, name_of
from tessera.sources.adapters import Graph


def create_nodes(rows: DataFrame) -> DataFrame:
    """kind, qualified_name and whatever else ``rows`` has, with ``name``: what follows the last ``::``."""
    return rows.withColumn("name", name_of(F.col("qualified_name")))


def add_edges(g: Graph, rows: DataFrame) -> Graph:
    """Append edges; parallel edges and self-loops stay. Columns that ``rows`` lacks are null."""
    return Graph(g.nodes, g.edges.unionByName(rows, allowMissingColumns=True).select(g.edges.columns))


def construct_edges(rows: DataFrame, conf_class: Column | str) -> DataFrame:
    """Edges of a confidence class with its score: extracted 1, inferred and ambiguous 0; ``score`` keeps an inferred number."""
    c = conf_class if isinstance(conf_class, Column) else F.lit(conf_class)
    return rows.withColumn("conf_class", c).withColumn("confidence", F.when(F.col("conf_class") == "extracted", 1.0).otherwise(0.0))


def remove_edges_by_id(g: Graph, ids: DataFrame) -> Graph:
    return Graph(g.nodes, g.edges.join(ids.select("id"), "id", "left_anti").select(g.edges.columns))


def rename_nodes(g: Graph, renames: DataFrame) -> Graph:
    """Apply (id, new_qname). A node renamed to a name that another node keeps is merged into that node.

    Of several renamed to one free name the smallest id takes it and the others are merged into it.
    """
    r = g.nodes.join(renames.select("id", "new_qname"), "id", "left")
    r = r.withColumn("wanted", F.coalesce("new_qname", "qualified_name")).withColumn("moves", F.col("new_qname").isNotNull() & (F.col("new_qname") != F.col("qualified_name")))
    first = F.first("id").over(Window.partitionBy("wanted").orderBy(F.col("moves").cast("int"), "id"))
    r = r.withColumn("winner", first)
    losers = r.filter("moves AND winner <> id").select(F.col("id").alias("loser"), "winner")
    named = r.withColumn("name", F.when(F.col("moves"), name_of(F.col("wanted"))).otherwise(F.col("name"))).withColumn("qualified_name", F.col("wanted"))
    return merge_nodes(Graph(named.select(g.nodes.columns), g.edges), losers)


def stamp_revision(rows: DataFrame, revision: str) -> DataFrame:
    """Rows without ``valid_from`` get ``revision``."""
    return rows.withColumn("valid_from", F.coalesce("valid_from", F.lit(revision)))


def put_metadata(stored: DataFrame, new: DataFrame) -> DataFrame:
    """key, value: ``new`` wins."""
    return stored.join(new.select("key"), "key", "left_anti").select("key", "value").unionByName(new.select("key", "value"))


def nodes_for_sources(nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """Nodes of the listed files, one a qualified name (smallest id)."""
    nth = F.row_number().over(Window.partitionBy("qualified_name").orderBy("id"))
    return nodes.join(sources.select("source_uri"), "source_uri", "left_semi").withColumn("nth", nth).filter("nth = 1").drop("nth")


def edges_for_sources(g: Graph, sources: DataFrame) -> DataFrame:
    """Edges with an end in the listed files, one for each (src, dst, kind)."""
    ids = g.nodes.join(sources.select("source_uri"), "source_uri", "left_semi").select("id")
    touched = [g.edges.join(ids.withColumnRenamed("id", end), end, "left_semi").select(g.edges.columns) for end in ("src", "dst")]
    nth = F.row_number().over(Window.partitionBy("src", "dst", "kind").orderBy("id"))
    return touched[0].unionByName(touched[1]).withColumn("nth", nth).filter("nth = 1").drop("nth")


def delete_sources(g: Graph, sources: DataFrame) -> Graph:
    """Nodes of the listed files go, and every edge into or out of them."""
    gone = g.nodes.join(sources.select("source_uri"), "source_uri", "left_semi").select("id")
    e = g.edges
    for end in ("src", "dst"):
        e = e.join(gone.withColumnRenamed("id", end), end, "left_anti")
    return Graph(g.nodes.join(gone, "id", "left_anti").select(g.nodes.columns), e.select(g.edges.columns))


def temporal_versions(active: DataFrame, archived: DataFrame, key: list[str]) -> DataFrame:
    """Active and archived rows, one for each key: the active one, else the archived one that ended last."""
    both = active.withColumn("archived", F.lit(0)).unionByName(archived.withColumn("archived", F.lit(1)), allowMissingColumns=True)
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("archived", F.desc_nulls_first("valid_to"), "id"))
    return both.withColumn("nth", nth).filter("nth = 1").drop("nth", "archived")
