"""Changes, risk and time: hunks, affected symbols, risk factors, diffs, validity, file state."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.lists import list_ranks
from tessera.operators.structure import degrees
from tessera.runtime import materialise
from tessera.sources.adapters import Graph

# Parts of names that mark security-sensitive code.
SECURITY = [
    "auth", "password", "token", "secret", "encrypt", "decrypt",
    "hash", "sign", "verify", "permission", "access", "credential",
    "login", "logout", "session", "csrf", "xss", "sanitize",
    "validate", "injection", "privilege", "sudo", "root", "admin",
    "key", "certificate", "https", "tls", "ssl", "payment",
    "billing", "invoice", "transaction", "debit", "credit",
    "grant",
]


def parse_diff(texts: DataFrame, text_col: str = "diff", *, per_file: bool = False) -> DataFrame:
    """file_path, line_start, line_end of the hunks of unified diffs; ``per_file``: one hunk a file, from the last header."""
    lines = texts.select(F.posexplode(F.split(text_col, "\n")).alias("n", "line"))
    # One diff is one ordered text; different diffs keep apart by their row.
    rows = texts.withColumn("diff_id", F.monotonically_increasing_id()).select("diff_id", F.posexplode(F.split(text_col, "\n")).alias("n", "line"))
    w = Window.partitionBy("diff_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    file = F.last(F.when(F.col("line").startswith("+++ "), F.regexp_replace(F.substring("line", 5, 4096), r"^b/", "")), True).over(w)
    head = F.when(F.col("line").startswith("@@"), F.regexp_extract("line", r"\+([0-9]+)", 1).cast("int"))
    length = F.when(F.col("line").startswith("@@"), F.coalesce(F.nullif(F.regexp_extract("line", r"\+[0-9]+,([0-9]+)", 1), F.lit("")), F.lit("1")).cast("int"))
    h = rows.withColumn("file_path", file).withColumn("line_start", head).withColumn("size", length).filter("line_start IS NOT NULL AND file_path IS NOT NULL AND file_path <> '/dev/null'")
    del lines
    if per_file:
        return h.groupBy("diff_id", "file_path").agg(F.max_by("line_start", "n").alias("line_start"), F.sum("size").alias("size")).select("file_path", "line_start", (F.col("line_start") + F.col("size")).alias("line_end"))
    return h.select("file_path", "line_start", (F.col("line_start") + F.greatest("size", F.lit(1)) - 1).alias("line_end"))


def affected_symbols(nodes: DataFrame, hunks: DataFrame) -> DataFrame:
    """Interval overlap on the same path: an equi-join on the path with a range condition."""
    n = nodes.filter("line_start IS NOT NULL AND line_end IS NOT NULL").select("id", "qualified_name", "kind", F.col("source_uri").alias("file_path"), F.col("line_start").alias("s"), F.col("line_end").alias("e"))
    return hunks.join(n, "file_path").filter("s <= line_end AND e >= line_start").select("file_path", "line_start", "line_end", "id", "qualified_name", "kind")


def hunk_risk(g: Graph, hunks: DataFrame) -> DataFrame:
    """1 a callable, 2 a class, plus .5 for each with callers, up to 10."""
    used = g.edges.select(F.col("dst").alias("id")).distinct().withColumn("used", F.lit(0.5))
    a = affected_symbols(g.nodes, hunks).join(used, "id", "left")
    each = F.when(F.col("kind").isin("function", "method"), 1.0).when(F.col("kind") == "class", 2.0).otherwise(0.0) + F.coalesce("used", F.lit(0.0))
    return a.groupBy("file_path", "line_start", "line_end").agg(F.least(F.sum(each), F.lit(10.0)).alias("risk"))


def risk_scores(g: Graph, flows: DataFrame | None = None) -> DataFrame:
    """Five factors: flows up to .25, cross-file callers up to .15, tests .30 down to .05, security .20, in-edges / 20 up to .10."""
    n = g.nodes.filter(F.col("kind").isin("function", "method", "class") & ~F.col("is_test"))
    info = g.nodes.select("id", "source_uri", "is_test")
    calls = g.edges.filter("kind = 'calls'").join(info.select(F.col("id").alias("src"), F.col("source_uri").alias("from_uri"), "is_test"), "src").join(info.select(F.col("id").alias("dst"), F.col("source_uri").alias("to_uri")), "dst")
    caller = calls.groupBy(F.col("dst").alias("id")).agg(F.sum((~F.col("from_uri").eqNullSafe(F.col("to_uri"))).cast("long")).alias("crossing"), F.countDistinct(F.when(F.col("is_test"), F.col("src"))).alias("tests"))
    used = degrees(g.edges).select("id", "in_degree")
    d = n.join(caller, "id", "left").join(used, "id", "left")
    d = d.join(flows, "id", "left") if flows is not None else d.withColumn("criticality", F.lit(0.0))
    zero = lambda c: F.coalesce(c, F.lit(0))
    flow = F.least(F.coalesce("criticality", F.lit(0.0)), F.lit(0.25))
    crossing = F.least(zero("crossing") * 0.05, F.lit(0.15))
    tests = F.lit(0.30) - 0.25 * F.least(zero("tests") / 5.0, F.lit(1.0))
    security = F.when(F.regexp_replace(F.lower("name"), r"[^\p{L}\p{N}]", " ").rlike("|".join(SECURITY)), 0.20).otherwise(0.0)
    into = F.least(zero("in_degree") / 20.0, F.lit(0.10))
    score = F.round(flow + crossing + tests + security + into, 4)
    level = F.when(score >= 0.85, "critical").when(score >= 0.70, "high").when(score >= 0.40, "medium").otherwise("low")
    return d.select("id", "qualified_name", score.alias("score"), level.alias("level"))


def test_coverage(g: Graph) -> DataFrame:
    """Callables and classes with whether a test calls them or a tested_by edge names one."""
    tests = g.nodes.filter("is_test").select(F.col("id").alias("src"))
    by_call = g.edges.filter("kind = 'calls'").join(tests, "src", "left_semi").select(F.col("dst").alias("id"))
    by_edge = g.edges.filter("kind = 'tested_by'").select(F.col("src").alias("id"))
    tested = by_call.unionByName(by_edge).distinct().withColumn("t", F.lit(True))
    n = g.nodes.filter(F.col("kind").isin("function", "method", "class") & ~F.col("is_test"))
    return n.join(tested, "id", "left").select("id", "kind", F.coalesce("t", F.lit(False)).alias("tested"))


def graph_diff_nodes(base: DataFrame, head: DataFrame, compare: list[str]) -> DataFrame:
    """qualified_name, change: added, removed or modified (null-safe over the compared columns)."""
    b, h = base.select("qualified_name", F.struct(*compare).alias("b")), head.select("qualified_name", F.struct(*compare).alias("h"))
    d = b.join(h, "qualified_name", "full")
    change = F.when(F.col("b").isNull(), "added").when(F.col("h").isNull(), "removed").when(~F.col("b").eqNullSafe(F.col("h")), "modified")
    return d.select("qualified_name", change.alias("change")).filter("change IS NOT NULL")


def graph_diff_edges(base: DataFrame, head: DataFrame) -> DataFrame:
    keys = ["src", "dst", "kind"]
    b, h = base.select(keys).distinct(), head.select(keys).distinct()
    return h.join(b, keys, "left_anti").withColumn("change", F.lit("added")).unionByName(b.join(h, keys, "left_anti").withColumn("change", F.lit("removed")))


class History(NamedTuple):
    """Commits on chains, each of which goes from a commit to one of its parents, and the parents that lie on other chains.

    ``chains`` (commit, chain, place) has one row a commit, ``links`` (chain, place, to_chain, to_place) one a parent elsewhere. What a commit
    can reach on a chain is all up to one place, so an answer for a commit is one row a chain, however long the history is.
    """

    chains: DataFrame
    links: DataFrame


def history(parents: DataFrame) -> History:
    """Chains of a history (commit, parent): the least of a commit's parents goes on its chain, unless a lesser child took it.

    Places on a chain come from pointer doubling, so a straight history of n commits takes log n rounds, not n.
    """
    p = materialise(parents.filter("parent IS NOT NULL AND commit <> parent").select("commit", "parent").distinct(), "parents")
    on = p.groupBy("commit").agg(F.min("parent").alias("parent")).groupBy("parent").agg(F.min("commit").alias("commit"))
    every = parents.select(F.col("commit").alias("item")).unionByName(p.select(F.col("parent").alias("item"))).distinct()
    ranks = list_ranks(every.join(on.select(F.col("commit").alias("item"), F.col("parent").alias("after")), "item", "left"))
    chains = materialise(ranks.select(F.col("item").alias("commit"), F.col("end").alias("chain"), F.col("steps").alias("place")), "chains")
    to = chains.select(F.col("commit").alias("parent"), F.col("chain").alias("to_chain"), F.col("place").alias("to_place"))
    links = p.join(chains, "commit").join(to, "parent").filter("chain <> to_chain").select("chain", "place", "to_chain", "to_place")
    return History(chains, materialise(links, "chain-links"))


def reached(h: History, commits: DataFrame) -> DataFrame:
    """commit, chain, place: the last place on each chain that each of the commits reaches, itself included.

    A round follows the links of the chains whose place rose; there are as many rounds as a way back has changes of chain.
    """
    known = materialise(commits.select("commit").distinct().join(h.chains, "commit"), "reached")
    fresh = known
    while True:
        step = fresh.join(h.links.withColumnRenamed("place", "at"), "chain").filter("at <= place")
        step = step.groupBy("commit", F.col("to_chain").alias("chain")).agg(F.max("to_place").alias("new"))
        step = materialise(step.join(known, ["commit", "chain"], "left").filter("place IS NULL OR new > place").select("commit", "chain", F.col("new").alias("place")), "reached-step")
        if step.isEmpty():
            return known
        known = materialise(known.unionByName(step).groupBy("commit", "chain").agg(F.max("place").alias("place")), "reached")
        fresh = step


def ancestors_among(h: History, pairs: DataFrame) -> DataFrame:
    """The (commit, ancestor) pairs of ``pairs`` in which the second is a strict ancestor of the first."""
    pairs = pairs.select("commit", "ancestor").filter("commit <> ancestor").distinct()
    placed = pairs.join(h.chains.select(F.col("commit").alias("ancestor"), "chain", F.col("place").alias("at")), "ancestor")
    return placed.join(reached(h, pairs), ["commit", "chain"]).filter("at <= place").select("commit", "ancestor")


def active_at(df: DataFrame, h: History, commit: str) -> DataFrame:
    """Rows whose valid_from is the commit or an ancestor and whose valid_to is not a strict ancestor of it.

    A row ends after its valid_to. Commits that the history doesn't have are nobody's ancestors.
    """
    ends = df.select(F.explode(F.array("valid_from", "valid_to")).alias("ancestor")).filter("ancestor IS NOT NULL").distinct()
    known = materialise(ancestors_among(h, ends.withColumn("commit", F.lit(commit))).select(F.col("ancestor").alias("a")), "known")
    started = df.join(known.withColumnRenamed("a", "valid_from").withColumn("from_ok", F.lit(True)), "valid_from", "left")
    both = started.join(known.withColumnRenamed("a", "valid_to").withColumn("to_gone", F.lit(True)), "valid_to", "left")
    begun = F.col("valid_from").isNull() | (F.col("valid_from") == commit) | F.coalesce("from_ok", F.lit(False))
    return both.filter(begun & ~F.coalesce("to_gone", F.lit(False))).select(df.columns)


def temporal_diff(df: DataFrame, h: History, base: str, head: str) -> DataFrame:
    """Rows active at one commit only, as added or removed."""
    b, h2 = active_at(df, h, base), active_at(df, h, head)
    key = [c for c in ("qualified_name", "src", "dst", "kind") if c in df.columns]
    return h2.join(b.select(key), key, "left_anti").select(*key, F.lit("added").alias("change")).unionByName(b.join(h2.select(key), key, "left_anti").select(*key, F.lit("removed").alias("change")))


def file_diff(stored: DataFrame, current: DataFrame) -> DataFrame:
    """path, change from two (path, hash) tables: changed covers new and different files."""
    d = stored.select("path", F.col("hash").alias("old")).join(current.select("path", F.col("hash").alias("new")), "path", "full")
    change = F.when(F.col("new").isNull(), "deleted").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return d.select("path", change.alias("change")).filter("change IS NOT NULL")


def snippet(texts: DataFrame, text_col: str, *, max_lines: int | None = 200) -> DataFrame:
    """Numbered lines of each text, the first ``max_lines`` or all."""
    keep = [c for c in texts.columns if c != text_col]
    lines = F.split(text_col, "\n")
    return texts.select(*keep, F.posexplode(lines if max_lines is None else F.slice(lines, 1, max_lines)).alias("line", "content")).withColumn("line", F.col("line") + 1)
