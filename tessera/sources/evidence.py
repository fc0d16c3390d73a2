"""Edges that a compiler has proved: they are added to a graph, or make what was guessed certain.

Evidence files are JSON objects with a version, a provider and a list of edges between qualified names. A file that is not like that is an error, told by its path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import schemas
from tessera.runtime import materialise
from tessera.sources.adapters import Graph

VERSION = 1
_FILE = "version int, provider string, edges array<struct<source:string,target:string,kind:string,detail:string>>"


def read_evidence(files: DataFrame) -> DataFrame:
    """place, provider, source, target, kind, detail of the edges in (path, content); ``place`` orders files by path and edges within them."""
    parsed = files.select("path", F.from_json("content", _FILE).alias("f"))
    kinds = F.array(*map(F.lit, schemas.EDGE_KINDS))
    whole = F.forall("f.edges", lambda e: e["source"].isNotNull() & e["target"].isNotNull() & F.coalesce(F.array_contains(kinds, e["kind"]), F.lit(False)))
    fits = (F.col("f.version") == VERSION) & (F.trim("f.provider") != "") & F.coalesce(whole, F.lit(True))
    wrong = [r.path for r in parsed.filter(~F.coalesce(fits, F.lit(False))).select("path").orderBy("path").limit(5).collect()]
    if wrong:
        raise ValueError(f"not compiler evidence of version {VERSION}: {', '.join(wrong)}")
    rows = parsed.select("path", F.trim("f.provider").alias("provider"), F.posexplode("f.edges").alias("nth", "e"))
    return rows.select(F.struct("path", "nth").alias("place"), "provider", "e.source", "e.target", "e.kind", "e.detail")


def apply_evidence(g: Graph, evidence: DataFrame) -> tuple[Graph, DataFrame]:
    """The graph with provenance, provider and detail on its edges, and counts (added, upgraded, unresolved).

    Of parallel edges the first by id becomes extracted; where there is none, one is added under a hash of its ends and kind. Of several rows for one edge the last
    tells provider and detail. Rows whose ends the graph doesn't have are unresolved.
    """
    name = lambda end, to: g.nodes.select(F.col("qualified_name").alias(end), F.col("id").alias(to))
    told = materialise(evidence.join(name("source", "src"), "source", "left").join(name("target", "dst"), "target", "left"), "evidence")
    proved = told.filter("src IS NOT NULL AND dst IS NOT NULL").groupBy("src", "dst", "kind").agg(F.max(F.struct("place", "provider", "detail")).alias("last"), F.count(F.lit(1)).alias("rows"))
    first = g.edges.groupBy("src", "dst", "kind").agg(F.min("id").alias("id"))
    met = materialise(proved.join(first, ["src", "dst", "kind"], "left"), "evidence-met")
    stamp = [F.lit("compiler").alias("provenance"), F.col("last.provider").alias("provider"), F.col("last.detail").alias("detail")]
    up = g.edges.join(met.filter("id IS NOT NULL").select("src", "dst", "kind", "id", *stamp), ["src", "dst", "kind", "id"], "left")
    certain = F.col("provenance").isNotNull()
    up = up.withColumn("conf_class", F.when(certain, "extracted").otherwise(F.col("conf_class"))).withColumn("confidence", F.when(certain, 1.0).otherwise(F.col("confidence")))
    columns = [*g.edges.columns, "provenance", "provider", "detail"]
    new = met.filter("id IS NULL").select(F.xxhash64("src", "dst", "kind").alias("id"), "src", "dst", "kind", F.lit("extracted").alias("conf_class"), F.lit(1.0).alias("confidence"), *stamp)
    edges = up.select(columns).unionByName(new, allowMissingColumns=True).select(columns)
    report = met.agg(F.count_if(F.col("id").isNull()).alias("added"), F.coalesce(F.sum(F.col("rows") - F.col("id").isNull().cast("long")), F.lit(0)).alias("upgraded"))
    lost = told.agg(F.count_if(F.col("src").isNull() | F.col("dst").isNull()).alias("unresolved"))
    return Graph(g.nodes, edges), report.withColumn("k", F.lit(1)).join(lost.withColumn("k", F.lit(1)), "k").drop("k")
