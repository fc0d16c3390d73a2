"""Motifs: a typed pattern graph compiled to a chain of joins, and framework patterns from a catalogue."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.adapters import Graph


@dataclass(frozen=True)
class NamePattern:
    """exact (case counts), contains (it does not), glob (* stops at a colon) or regex."""

    how: str
    value: str

    def matches(self, name: Column) -> Column:
        if self.how == "exact":
            return name == self.value
        if self.how == "contains":
            return F.contains(F.lower(name), F.lit(self.value.lower()))
        if self.how == "glob":
            import re

            return name.rlike("^" + re.escape(self.value).replace(r"\*", "[^:]*").replace(r"\?", "[^:]") + "$")
        return name.rlike(self.value)


@dataclass
class Motif:
    """Variables with allowed kinds and name patterns, and edges (from, to, kind) between them."""

    variables: dict[str, tuple[list[str] | None, NamePattern | None]] = field(default_factory=dict)
    edges: list[tuple[str, str, str | None]] = field(default_factory=list)

    def node(self, name: str, kinds: list[str] | None = None, pattern: NamePattern | None = None) -> Motif:
        self.variables[name] = (kinds, pattern)
        return self

    def edge(self, src: str, dst: str, kind: str | None = None) -> Motif:
        self.edges.append((src, dst, kind))
        return self

    def match(self, g: Graph, limit: int | None = None) -> DataFrame:
        """One column of ids a variable; different variables are different nodes.

        Each pattern edge is filtered by kind and by the candidates of both ends before it is joined.
        """

        def candidates(v: str) -> DataFrame | None:
            kinds, pattern = self.variables[v]
            if kinds is None and pattern is None:
                return None
            n = g.nodes
            n = n if kinds is None else n.filter(F.col("kind").isin(kinds))
            n = n if pattern is None else n.filter(pattern.matches(F.col("name")))
            return n.select(F.col("id").alias(v))

        out = None
        for src, dst, kind in self.edges:
            e = g.edges if kind is None else g.edges.filter(F.col("kind") == kind)
            e = e.select(F.col("src").alias(src), F.col("dst").alias(dst)).distinct() if src != dst else e.filter("src = dst").select(F.col("src").alias(src)).distinct()
            for v in {src, dst}:
                c = candidates(v)
                e = e if c is None else e.join(c, v, "left_semi")
            if out is None:
                out = e
            else:
                shared = [c for c in e.columns if c in out.columns]
                out = out.join(e, shared)
            bound = [c for c in self.variables if c in out.columns]
            for i, a in enumerate(bound):
                for b in bound[:i]:
                    out = out.filter(F.col(a) != F.col(b))
        out = out.select(*[v for v in self.variables if v in out.columns])
        return out if limit is None else out.orderBy(*out.columns).limit(limit)


def chain(kind: str, length: int) -> Motif:
    m = Motif()
    for i in range(length + 1):
        m.node(f"v{i}")
    for i in range(length):
        m.edge(f"v{i}", f"v{i + 1}", kind)
    return m


def untested_callee() -> Motif:
    return Motif().node("caller", ["method", "function"]).node("callee", ["function"]).node("owner", ["class"]).edge("owner", "caller", "defines").edge("caller", "callee", "calls")


def security_audit(word: str = "sql") -> Motif:
    """A function with ``word`` in its name that calls another."""
    return Motif().node("caller", ["function"], NamePattern("contains", word)).node("callee", ["function"]).edge("caller", "callee", "calls")


def diamond_inheritance() -> Motif:
    """A class with two parents that share a parent; the parents are ordered by the caller if needed."""
    m = Motif()
    for v in ("child", "left", "right", "top"):
        m.node(v, ["class"])
    return m.edge("left", "top", "inherits").edge("right", "top", "inherits").edge("child", "left", "inherits").edge("child", "right", "inherits")


def doc_function_triangle() -> Motif:
    """A document that describes a function and mentions a concept that mentions the function."""
    return Motif().node("document", ["document"]).node("function", ["function"]).node("concept", ["concept"]).edge("document", "concept", "mentions").edge("concept", "function", "mentions").edge("document", "function", "describes")


BUILT_IN = {"security_audit": security_audit, "diamond_inheritance": diamond_inheritance, "doc_function_triangle": doc_function_triangle}


def load_catalogue(spark, text: str) -> DataFrame:
    """A pattern catalogue (pattern, name_regex, kinds, edge_kind, min_nodes) from TOML ``[[pattern]]`` tables."""
    import tomllib

    rows = [(p["id"], p.get("name_regex", ".*"), list(p.get("kinds", [])), p.get("edge_kind", "calls"), int(p.get("min_nodes", 1))) for p in tomllib.loads(text).get("pattern", [])]
    return spark.createDataFrame(rows, "pattern string, name_regex string, kinds array<string>, edge_kind string, min_nodes int")


def framework_patterns(g: Graph, catalogue: DataFrame) -> DataFrame:
    """id, n, edges, confidence of each catalogue row (id, name_regex, kinds, edge_kind, min_nodes) that the graph holds.

    Candidates are nodes of the kinds whose name matches; at least one edge of the kind must run between
    candidates; confidence = .5 + .05 n + .03 edges, up to 1. The catalogue is a small broadcast table.
    """
    c = F.broadcast(catalogue)
    hit = g.nodes.join(c, F.array_contains("kinds", F.col("kind")) & F.rlike(F.lower("name"), F.col("name_regex"))).select(F.col("pattern"), F.col("id").alias("node"), "edge_kind", "min_nodes")
    size = hit.groupBy("pattern", "min_nodes").agg(F.count(F.lit(1)).alias("n"))
    e = g.edges.select("src", "dst", "kind").join(hit.select("pattern", F.col("node").alias("src"), F.col("edge_kind").alias("kind")), ["src", "kind"]).join(hit.select("pattern", F.col("node").alias("dst")), ["pattern", "dst"])
    count = e.groupBy("pattern").agg(F.count(F.lit(1)).alias("edges"))
    return size.filter("n >= min_nodes").join(count, "pattern").select("pattern", "n", "edges", F.round(F.least(0.5 + 0.05 * F.col("n") + 0.03 * F.col("edges"), F.lit(1.0)), 6).alias("confidence"))
