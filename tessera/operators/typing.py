"""Evidence for call resolution: import paths, receiver types, library stubs, language boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.adapters import Graph

# Suffixes and the dialect that calls are made in, and the order in which dialects are tried.
DIALECT = {"py": "python", "rs": "rust", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "javascript", "tsx": "javascript", "c": "cpp", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "h": "cpp", "hpp": "cpp"}
DIALECT_ORDER = ["python", "rust", "javascript", "cpp"]


def dialect(uri: Column) -> Column:
    pairs = [F.lit(x) for k, v in DIALECT.items() for x in (k, v)]
    return F.element_at(F.create_map(*pairs), F.lower(F.regexp_extract(F.coalesce(uri, F.lit("")), r"\.([A-Za-z]+)$", 1)))


def module_matches(module: Column, caller: Column, candidate: Column) -> Column:
    """Whether an import path names a candidate file: its parts are a run of the candidate's, or below the caller's folder for dots."""
    bare = F.regexp_replace(F.regexp_replace(candidate, r"\.[^./]*$", ""), r"/?__init__$", "")
    dots = F.length(module) - F.length(F.regexp_replace(module, r"^\.+", ""))
    rest = F.regexp_replace(F.regexp_replace(module, r"^\.+", ""), r"\.+", "/")
    folders = F.split(caller, "/")
    base = F.array_join(F.slice(folders, F.lit(1), F.greatest(F.size(folders) - 1 - F.greatest(dots - 1, F.lit(0)), F.lit(0))), "/")
    expected = F.regexp_replace(F.concat_ws("/", F.when(base != "", base), F.when(rest != "", rest)), r"/+$", "")
    below = (bare == expected) | F.startswith(bare, F.concat(expected, F.lit("/"))) | (expected == "")
    absolute = (rest != "") & F.contains(F.concat(F.lit("/"), bare, F.lit("/")), F.concat(F.lit("/"), rest, F.lit("/")))
    return F.when(dots > 0, below).otherwise(absolute)


def import_tokens(g: Graph) -> DataFrame:
    """src_uri, token: lower-cased words of the module paths that a file imports."""
    m = g.nodes.filter(F.startswith("qualified_name", F.lit("module::"))).select(F.col("id").alias("dst"), F.substring("qualified_name", 9, 4096).alias("path"))
    s = g.nodes.filter("source_uri IS NOT NULL").select(F.col("id").alias("src"), F.col("source_uri").alias("src_uri"))
    words = F.regexp_extract_all(F.lower("path"), F.lit(r"([\p{L}\p{N}_]+)"), 1)
    return g.edges.filter("kind = 'imports'").join(m, "dst").join(s, "src").select("src_uri", F.explode(words).alias("token")).distinct()


#: What binds a name to a type in the texts of several languages. A path is identifiers joined by ``.`` or ``::``.
_NAME, _PATH, _GENERIC = r"[A-Za-z_]\w*", r"(?:[A-Za-z_]\w*(?:::|\.))*[A-Za-z_]\w*", r"(?:\s*<[^<>()]*>)?"
#: ``name: Type``, behind references, lifetimes, modifiers and wrappers that pass calls on.
_ANNOTATED = rf"\b({_NAME})\s*:(?!:|=)\s*(?:&\s*|'\w+\s+|(?:mut|dyn|impl|const|readonly)\s+|(?:Box|Rc|Arc|Ref|Optional|Option)\s*[<\[]\s*)*({_PATH})"
#: ``name = path(...)``, ``name := path{...}``, with ``new``, ``await`` or ``&`` in front.
_BOUND = rf"\b({_NAME})\s*:?=(?![=>])\s*(?:(?:new|await|mut)\s+|&\s*)*({_PATH}){_GENERIC}\s*[({{]"
#: ``Type name`` before ``=``, ``;``, ``,`` or ``)``, the type perhaps with arguments, a pointer or a reference.
_DECLARED = rf"\b({_PATH}){_GENERIC}\s*[&*]?\s+[&*]?({_NAME})\s*(?=[=;,)])"


def _of_path(path: Column) -> Column:
    """The last part of a path that begins with a capital, if only small ones (constructors) follow it."""
    found = F.regexp_extract(path, r"(?:^|\.|::)([A-Z]\w*)(?:(?:\.|::)[a-z_]\w*)*$", 1)
    return F.when(found != "", found)


def _bindings(source: Column, pattern: str, name: int, path: int) -> Column:
    """Pairs (name, type) that a pattern finds in a text, in order."""
    every = lambda group: F.regexp_extract_all(source, F.lit(pattern), group)
    return F.filter(F.zip_with(every(name), every(path), lambda n, p: F.struct(n.alias("name"), _of_path(p).alias("type"))), lambda b: b["type"].isNotNull())


def receiver_type(receiver: Column, source: Column, names: dict[str, str] | None = None) -> Column:
    """Type of a call's receiver from what the caller's text says, null without evidence.

    Every binding of the text is read, whatever its name, and the receiver looks for its own: first if it is a constructor call itself, then among
    annotations, bindings to a constructor or literal, declarations with the type in front, and in ``names`` (variable name to type). The first of a kind counts.
    """
    source, bare = F.coalesce(source, F.lit("")), F.trim(receiver)
    itself = F.regexp_extract(bare, rf"^(?:new\s+)?({_PATH}){_GENERIC}\s*[({{]", 1)
    found = [_of_path(itself)]
    for pattern, name, path in ((_ANNOTATED, 1, 2), (_BOUND, 1, 2), (_DECLARED, 2, 1)):
        mine = F.filter(_bindings(source, pattern, name, path), lambda b: b["name"] == bare)
        found.append(F.get(mine, F.lit(0))["type"])
    if names:
        table = F.create_map(*(F.lit(x) for k, v in names.items() for x in (k, v)))
        found.append(F.element_at(table, F.lower(bare)))
    return F.coalesce(*found)


def resolve_by_receiver(candidates: DataFrame, receivers: DataFrame) -> DataFrame:
    """edge_id, target: the only candidate (edge_id, target, target_qname) whose owner is the receiver's type (edge_id, type)."""
    owner = F.element_at(F.split("target_qname", "::"), -2)
    d = candidates.withColumn("n", F.size(F.split("target_qname", "::"))).filter("n > 1").join(receivers, "edge_id").filter(owner == F.col("type"))
    only = F.count(F.lit(1)).over(Window.partitionBy("edge_id"))
    return d.withColumn("k", only).filter("k = 1").select("edge_id", "target")


def unresolved_calls(g: Graph) -> DataFrame:
    """edge_id, src, name, dialect of calls that still point to a placeholder."""
    p = g.nodes.filter(F.startswith("qualified_name", F.lit("call::"))).select(F.col("id").alias("dst"), F.substring("qualified_name", 7, 4096).alias("name"))
    c = g.nodes.select(F.col("id").alias("src"), dialect(F.col("source_uri")).alias("dialect"))
    return g.edges.filter("kind = 'calls'").select(F.col("id").alias("edge_id"), "src", "dst").join(p, "dst").join(c, "src").filter("dialect IS NOT NULL").select("edge_id", "src", "name", "dialect")


def resolve_library_stubs(g: Graph, stubs: DataFrame) -> DataFrame:
    """edge_id, stub: library type (``stub::Type``) that a placeholder call belongs to, from ``stubs`` (dialect, type, method).

    Of several types of the caller's dialect, one called like the method comes first, then the first by name.
    """
    d = unresolved_calls(g).join(stubs.select("dialect", "type", F.col("method").alias("name")).distinct(), ["dialect", "name"])
    nth = F.row_number().over(Window.partitionBy("edge_id").orderBy((F.col("type") != F.col("name")).cast("int"), "type"))
    return d.withColumn("nth", nth).filter("nth = 1").select("edge_id", F.concat(F.lit("stub::"), "type").alias("stub"))


def ffi_boundaries(nodes: DataFrame) -> DataFrame:
    """binding, caller, callee, key: language boundaries that node texts (qualified_name, source_uri, source_text) show, each once."""
    suffix = F.lower(F.regexp_extract("source_uri", r"\.([A-Za-z]+)$", 1))
    text = F.coalesce("source_text", F.lit(""))
    rules = [
        ("pyo3", "rust", "python", (suffix == "rs") & text.rlike(r"#\[py(function|class|methods|module)\]")),
        ("ctypes", "python", "cpp", (suffix == "py") & text.rlike(r"ctypes\.(CDLL|cdll|PyDLL|WinDLL)|\bimport ctypes\b")),
        ("cffi", "python", "cpp", (suffix == "py") & text.rlike(r"\bffi\.(cdef|dlopen)|\bimport cffi\b|from cffi import")),
        ("js_import", "typescript", "javascript", suffix.isin("ts", "tsx") & text.rlike(r"""(from|require\()\s*['"][^'"]+\.js['"]""")),
    ]
    out = None
    for binding, caller, callee, hit in rules:
        found = nodes.filter(hit).select(F.lit(binding).alias("binding"), F.lit(caller).alias("caller"), F.lit(callee).alias("callee"), F.col("qualified_name").alias("key"))
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def resolve_cross_language(g: Graph, boundaries: DataFrame, registry: DataFrame) -> DataFrame:
    """edge_id, target, score .5: calls that another language's symbol (dialect, name, target) answers over a known boundary.

    A boundary works both ways; of several symbols the smallest target counts. It is found per dialect and name before a call meets it, so no row is made for a
    call and a symbol.
    """
    near = {"typescript": "javascript"}
    plain = lambda c: F.coalesce(*(F.when(F.col(c) == k, v) for k, v in near.items()), F.col(c))
    b = boundaries.select(plain("caller").alias("a"), plain("callee").alias("b")).distinct()
    ways = b.unionByName(b.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").filter(F.col("a").isin(DIALECT_ORDER)).distinct()
    least = lambda x, *by: x.groupBy(*by).agg(F.min("target").alias("target"))
    answers = least(least(registry.select(F.col("dialect").alias("b"), "name", "target"), "b", "name").join(F.broadcast(ways), "b"), "a", "name")
    d = unresolved_calls(g).join(answers.withColumnRenamed("a", "dialect"), ["dialect", "name"])
    return least(d, "edge_id").withColumn("score", F.lit(0.5))
