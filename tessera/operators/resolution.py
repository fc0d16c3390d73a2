"""Resolution and rewrite passes over an extracted graph: placeholders become edges to definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.adapters import Graph

# Call names that are left alone unless a caller gives a set of its own: builtins, methods of every object, pattern and number functions,
# usual parameters, string methods.
SUPPRESSED = [
    "abs", "all", "any", "bool", "bytes", "callable", "dict", "dir",
    "enumerate", "float", "getattr", "hasattr", "hash", "id",
    "int", "isinstance", "iter", "list", "max", "min",
    "next", "open", "print", "range", "repr", "reversed", "round",
    "set", "sorted", "str", "sum", "super", "tuple", "type", "vars",
    "zip",
    "__iter__", "__len__", "__getitem__",
    "__setitem__", "__delitem__", "__contains__", "__eq__", "__ne__",
    "__lt__", "__le__", "__gt__", "__ge__", "__hash__", "__bool__",
    "__repr__", "__str__", "__format__", "__enter__", "__exit__",
    "__call__", "__new__", "__init__", "__del__", "__getattr__",
    "__setattr__", "__delattr__", "__dir__", "__reduce__", "__reduce_ex__",
    "__getattribute__", "__sizeof__", "__class__", "__doc__", "__module__",
    "__annotations__", "__dict__", "__weakref__", "__slots__",
    "match", "search", "fullmatch", "findall", "finditer", "sub",
    "subn", "compile", "escape", "quote", "pattern",
    "log2", "log10", "log", "sqrt", "ceil", "floor", "trunc",
    "pow", "modf", "frexp", "ldexp",
    "isnan", "isinf", "isfinite",
    "cls", "self", "kwargs", "key", "default", "factory",
    "splitlines", "translate", "ljust", "rjust", "zfill", "expandtabs",
    "casefold", "maketrans",
]
# Languages whose symbols may call each other, by file suffix.
FAMILIES = {"py": "python", "pyi": "python", "rs": "rust", "ts": "web", "tsx": "web", "js": "web", "jsx": "web", "mjs": "web", "cjs": "web", "java": "jvm", "kt": "jvm", "go": "go", "c": "native", "h": "native", "cc": "native", "cpp": "native", "hpp": "native"}


def equal_places(a: Column, b: Column) -> Column:
    """Positions at which two ``::`` paths hold the same segment."""
    return F.size(F.filter(F.zip_with(F.split(a, "::"), F.split(b, "::"), lambda x, y: x == y), lambda same: same))


def directory(uri: Column) -> Column:
    return F.regexp_replace(uri, r"/?[^/]*$", "")


def placeholder_calls(g: Graph, prefix: str, edge_kinds: list[str]) -> DataFrame:
    """edge_id, src, name, src_qname, src_uri of the edges into placeholders."""
    e = g.edges.filter(F.col("kind").isin(edge_kinds)).select(F.col("id").alias("edge_id"), "src", "dst")
    place = g.nodes.filter(F.col("qualified_name").startswith(prefix)).select(F.col("id").alias("dst"), F.substring("qualified_name", len(prefix) + 1, 4096).alias("name"))
    caller = g.nodes.select(F.col("id").alias("src"), F.col("qualified_name").alias("src_qname"), F.col("source_uri").alias("src_uri"))
    return e.join(place, "dst").join(caller, "src").select("edge_id", "src", "name", "src_qname", "src_uri")


def definitions(nodes: DataFrame, kinds: list[str]) -> DataFrame:
    """target, name, target_qname, target_uri of what a placeholder may stand for."""
    real = nodes.filter(F.col("kind").isin(kinds) & ~F.col("qualified_name").rlike(r"^(call|type|stub|module)::"))
    return real.select(F.col("id").alias("target"), "name", F.col("qualified_name").alias("target_qname"), F.col("source_uri").alias("target_uri"))


def only(defs: DataFrame, keys: list[str], found: str) -> DataFrame:
    """The only definition of each key; keys with several are left out."""
    return defs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("target").alias(found)).filter("n = 1").drop("n")


def suppressed(name: Column, names: list[str] | None = None) -> Column:
    """Whether calls of this name are left alone: an empty name, or one of ``names`` (SUPPRESSED if none are given) in any case."""
    low = F.lower(F.trim(name))
    return (low == "") | low.isin(*(n.lower() for n in (SUPPRESSED if names is None else names)))


CALLABLE = ["function", "method", "class"]


def _places(rows: DataFrame, path: str) -> DataFrame:
    return rows.select("*", F.posexplode(F.split(path, "::")).alias("place", "segment"))


def _nearest(calls: DataFrame, defs: DataFrame) -> DataFrame:
    """name, src_qname, scoped: the definition that shares most path segments with the caller, if there is one such.

    Definitions meet callers by (name, place, segment). A segment that all definitions of a name share tells none of them
    apart, so it makes no pair; what is left are pairs with a segment in common that some other definition has not.
    """
    asked = _places(calls.select("name", "src_qname").distinct(), "src_qname")
    size = defs.groupBy("name").agg(F.count(F.lit(1)).alias("all"))
    at = _places(defs.select("name", "target", "target_qname"), "target_qname")
    common = at.groupBy("name", "place", "segment").agg(F.count(F.lit(1)).alias("n")).join(size, "name").filter("n < all").select("name", "place", "segment")
    telling = at.select("name", "target", "place", "segment").join(common, ["name", "place", "segment"])
    scope = asked.join(telling, ["name", "place", "segment"]).groupBy("name", "src_qname", "target").agg(F.count(F.lit(1)).alias("scope"))
    best = scope.groupBy("name", "src_qname", "scope").agg(F.count(F.lit(1)).alias("n"), F.min("target").alias("scoped"))
    top = best.groupBy("name", "src_qname").agg(F.max(F.struct("scope", "n", "scoped")).alias("b"))
    return top.filter("b.n = 1").select("name", "src_qname", "b.scoped")


def resolve_named(calls: DataFrame, defs: DataFrame, uses: DataFrame, imports: DataFrame | None = None, receivers: DataFrame | None = None) -> DataFrame:
    """edge_id, name, target, tier, conf_class of the placeholder calls that the tiers of :func:`resolve_calls` decide.

    Each tier is a table of the definitions' own: the only one of a (name), (name, file), (name, directory), (name, owner), the two most
    used of a name. Calls meet each table by its key, so no row is made for a call and a definition, but where scope has to tell.
    """
    segments = F.split("target_qname", "::")
    owned = defs.withColumn("owner", F.when(F.size(segments) > 1, F.element_at(segments, F.greatest(F.size(segments) - 1, F.lit(1)))))
    c = calls.select("edge_id", "name", "src_qname", "src_uri")
    c = c.join(only(defs, ["name"], "t1"), "name", "left")
    c = c.join(only(defs.filter("target_uri IS NOT NULL").select("target", "name", F.col("target_uri").alias("src_uri")), ["name", "src_uri"], "t2"), ["name", "src_uri"], "left")
    undecided = c.filter("t1 IS NULL AND t2 IS NULL")
    c = c.join(_nearest(undecided, defs).withColumnRenamed("scoped", "t3"), ["name", "src_qname"], "left")
    if receivers is None:
        c = c.withColumn("t4", F.lit(None).cast("long"))
    else:
        typed = c.select("edge_id", "name").join(receivers.select("edge_id", F.col("type").alias("owner")).distinct(), "edge_id")
        fits = typed.join(owned.select("name", "owner", "target"), ["name", "owner"])
        c = c.join(only(fits, ["edge_id"], "t4"), "edge_id", "left")
    if imports is None:
        c = c.withColumn("t5", F.lit(None).cast("long"))
    else:
        brought = imports.select("src_uri", "name", "target_uri").distinct().join(defs.select("name", "target_uri", "target"), ["name", "target_uri"])
        c = c.join(only(brought, ["src_uri", "name"], "t5"), ["src_uri", "name"], "left")
    near = defs.withColumn("dir", directory(F.col("target_uri"))).filter("dir IS NOT NULL")
    c = c.withColumn("dir", directory(F.col("src_uri"))).join(only(near, ["name", "dir"], "t6"), ["name", "dir"], "left")
    counted = defs.join(uses.select("target", "uses"), "target").filter("uses > 0")
    ranked = counted.withColumn("nth", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("uses"), "target"))).filter("nth <= 2")
    top = ranked.groupBy("name").agg(F.max(F.when(F.col("nth") == 1, F.col("uses"))).alias("most"), F.coalesce(F.max(F.when(F.col("nth") == 2, F.col("uses"))), F.lit(0)).alias("next"), F.max(F.when(F.col("nth") == 1, F.col("target"))).alias("t7"))
    c = c.join(top.filter("most >= 2 AND next * 2 <= most").select("name", "t7"), "name", "left")
    tier = F.coalesce(*(F.when(F.col(f"t{t}").isNotNull(), F.lit(t)) for t in range(1, 8)))
    target = F.coalesce(*(F.col(f"t{t}") for t in range(1, 8)))
    c = c.select("edge_id", "name", target.alias("target"), tier.alias("tier")).filter("tier IS NOT NULL")
    return c.withColumn("conf_class", F.when(F.col("tier") <= 2, "extracted").otherwise("inferred"))


def call_uses(g: Graph) -> DataFrame:
    """target, uses: how many calls point at a node itself."""
    return g.edges.filter("kind = 'calls'").groupBy(F.col("dst").alias("target")).agg(F.count(F.lit(1)).alias("uses"))


def resolve_calls(g: Graph, imports: DataFrame | None = None, receivers: DataFrame | None = None, *, suppress: list[str] | None = None) -> DataFrame:
    """edge_id, target, tier, conf_class: the first tier with exactly one candidate wins.

    Tiers: 1 unique name, 2 same file, 3 most equal scope segments, 4 owner is the receiver's type (``receivers``:
    edge_id, type), 5 imported module (``imports``: src_uri, name, target_uri), 6 same directory, 7 most callers (two at least, and twice the next). Tiers 1 and 2
    are extracted, the rest inferred. ``suppress`` is the whole set of names that are left alone.
    """
    calls = placeholder_calls(g, "call::", ["calls"]).filter(~suppressed(F.col("name"), suppress))
    return resolve_named(calls, definitions(g.nodes, CALLABLE), call_uses(g), imports, receivers).drop("name")


def apply_resolution(g: Graph, resolved: DataFrame, prefix: str = "call::") -> Graph:
    """Point the resolved edges at their targets and drop placeholders that no edge refers to any more."""
    r = resolved.select(F.col("edge_id").alias("id"), "target", F.col("conf_class").alias("new_class"))
    e = g.edges.join(r, "id", "left").withColumn("dst", F.coalesce("target", "dst")).withColumn("conf_class", F.coalesce("new_class", "conf_class"))
    e = e.withColumn("confidence", F.when(F.col("conf_class") == "extracted", 1.0).otherwise(0.0)).select(g.edges.columns)
    ends = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    orphans = g.nodes.filter(F.col("qualified_name").startswith(prefix)).join(ends, "id", "left_anti").select("id")
    return Graph(g.nodes.join(orphans, "id", "left_anti").select(g.nodes.columns), e)


def resolve_types(g: Graph) -> DataFrame:
    """Inheritance edges to ``type::X`` go to the only class, trait or type named X."""
    calls = placeholder_calls(g, "type::", ["inherits", "implements"])
    found = only(definitions(g.nodes, ["class", "trait", "type"]), ["name"], "target")
    return calls.join(found, "name").select("edge_id", "target", F.lit(1).alias("tier"), F.lit("extracted").alias("conf_class"))


def derive_tested_by(g: Graph) -> DataFrame:
    """src, dst of tested_by edges: production symbol to the test that calls it; existing ones stay out."""
    t = g.nodes.select("id", "is_test")
    e = g.edges.filter("kind = 'calls'").join(t.select(F.col("id").alias("src"), F.col("is_test").alias("a")), "src").join(t.select(F.col("id").alias("dst"), F.col("is_test").alias("b")), "dst")
    new = e.filter("a AND NOT b").select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()
    return new.join(g.edges.filter("kind = 'tested_by'").select("src", "dst"), ["src", "dst"], "left_anti")


def dedupe_generic(edges: DataFrame, generic: tuple[str, ...] = ("mentions", "describes")) -> DataFrame:
    """Drop generic edges between nodes that also have a specific one."""
    specific = F.max((~F.col("kind").isin(*generic)).cast("int")).over(Window.partitionBy("src", "dst"))
    return edges.withColumn("specific", specific).filter(~(F.col("kind").isin(*generic) & (F.col("specific") == 1))).drop("specific")


def stub_nodes(g: Graph) -> DataFrame:
    """Ids that edges point to but no node has."""
    return g.edges.select(F.col("dst").alias("id")).distinct().join(g.nodes.select("id"), "id", "left_anti").select("id", F.concat(F.lit("stub::"), F.col("id").cast("string")).alias("qualified_name"))


def family(uri: Column) -> Column:
    pairs = [F.lit(x) for k, v in FAMILIES.items() for x in (k, v)]
    return F.element_at(F.create_map(*pairs), F.lower(F.regexp_extract(uri, r"\.([A-Za-z]+)$", 1)))


def drop_cross_language(g: Graph) -> Graph:
    """Calls, imports and mentions between files of different language families go."""
    n = g.nodes.select("id", family(F.col("source_uri")).alias("f"))
    e = g.edges.join(n.select(F.col("id").alias("src"), F.col("f").alias("a")), "src", "left").join(n.select(F.col("id").alias("dst"), F.col("f").alias("b")), "dst", "left")
    keep = ~F.col("kind").isin("calls", "imports", "mentions") | F.col("a").isNull() | F.col("b").isNull() | (F.col("a") == F.col("b"))
    return Graph(g.nodes, e.filter(keep).select(g.edges.columns))


def resolve_mentions(mentions: DataFrame, nodes: DataFrame) -> DataFrame:
    """src, token, target: a token is a qualified name, else a name, else a name without case; first by id."""
    n = nodes.select("id", "qualified_name", "name")
    q = n.select(F.col("qualified_name").alias("token"), F.col("id").alias("q"))
    by = n.groupBy(F.col("name").alias("token")).agg(F.min("id").alias("n"))
    low = n.groupBy(F.lower("name").alias("low")).agg(F.min("id").alias("l"))
    m = mentions.select("src", "token").distinct().withColumn("low", F.lower("token"))
    d = m.join(q, "token", "left").join(by, "token", "left").join(low, "low", "left")
    return d.select("src", "token", F.coalesce("q", "n", "l").alias("target")).filter("target IS NOT NULL AND target <> src")


def spring_injections(fields: DataFrame, implements: DataFrame) -> DataFrame:
    """src, target: an injected field's type (src, type_name) with exactly one implementer (type_name, impl)."""
    n = F.count(F.lit(1)).over(Window.partitionBy("type_name"))
    one = implements.select("type_name", "impl").distinct().withColumn("n", n).filter("n = 1")
    return fields.join(one, "type_name").select("src", F.col("impl").alias("target")).distinct()
