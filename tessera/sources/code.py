"""Source trees: files to node and edge rows. Python by its own parser, other languages by line patterns."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Suffix to dialect, and directories a scan leaves out.
DIALECTS = {"py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "rs": "rust", "java": "java", "go": "go", "c": "cpp", "h": "cpp", "cc": "cpp", "cpp": "cpp", "hpp": "cpp", "md": "markdown"}
IGNORED = ["node_modules", ".git", "__pycache__", ".venv", "venv", "target", "dist", "build", ".mypy_cache", ".pytest_cache", ".tox", "vendor"]
ROWS = "row string, kind string, name string, qualified_name string, src string, dst string, conf_class string, source_uri string, line_start int, line_end int, is_test boolean"

# What opens a definition, an import and a call, by dialect: (kind, pattern with the name in group 1).
PATTERNS = {
    "javascript": [("class", r"^\s*(?:export\s+)?(?:default\s+)?class\s+(\w+)"), ("function", r"^\s*(?:export\s+)?(?:async\s+)?function\s*\*?\s*(\w+)"), ("function", r"^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>")],
    "typescript": [("class", r"^\s*(?:export\s+)?(?:abstract\s+)?class\s+(\w+)"), ("trait", r"^\s*(?:export\s+)?interface\s+(\w+)"), ("type", r"^\s*(?:export\s+)?(?:type|enum)\s+(\w+)"), ("function", r"^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)"), ("function", r"^\s*(?:export\s+)?const\s+(\w+)\s*=\s*(?:async\s*)?\([^)]*\)[^=]*=>")],
    "rust": [("class", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum)\s+(\w+)"), ("trait", r"^\s*(?:pub\s+)?trait\s+(\w+)"), ("impl", r"^\s*impl(?:<[^>]*>)?\s+(?:\w+\s+for\s+)?(\w+)"), ("function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)")],
    "java": [("class", r"^\s*(?:public\s+|final\s+|abstract\s+)*class\s+(\w+)"), ("trait", r"^\s*(?:public\s+)?interface\s+(\w+)"), ("method", r"^\s+(?:public|private|protected)\s+(?:static\s+)?[\w<>\[\]]+\s+(\w+)\s*\(")],
    "go": [("function", r"^func\s+(\w+)\s*\("), ("method", r"^func\s+\([^)]*\)\s+(\w+)\s*\("), ("class", r"^type\s+(\w+)\s+struct"), ("trait", r"^type\s+(\w+)\s+interface")],
    "cpp": [("class", r"^\s*(?:class|struct)\s+(\w+)[^;]*$"), ("function", r"^(?:[\w:<>*&]+\s+)+(\w+)\s*\([^;]*\)\s*\{")],
}
IMPORTS = {"javascript": r"""(?:from|require\()\s*['"]([^'"]+)['"]""", "typescript": r"""from\s*['"]([^'"]+)['"]""", "rust": r"^\s*use\s+([\w:]+)", "java": r"^\s*import\s+(?:static\s+)?([\w.]+)", "go": r"""^\s*(?:import\s+)?(?:\w+\s+)?"([^"]+)"$""", "cpp": r"""^\s*#include\s*[<"]([^>"]+)[>"]"""}
# What opens a list of parents, by dialect: (edge kind, pattern with the child in group 1 and the parents in group 2).
PARENTS = {
    "javascript": [("inherits", r"^\s*(?:export\s+)?(?:default\s+)?class\s+(\w+)\s+extends\s+([\w.]+)")],
    "typescript": [
        ("inherits", r"^\s*(?:export\s+)?(?:abstract\s+)?class\s+(\w+)(?:<[^>]*>)?\s+extends\s+([\w.]+)"),
        ("implements", r"^\s*(?:export\s+)?(?:abstract\s+)?class\s+(\w+)[^{]*?\simplements\s+([^{]+)"),
        ("inherits", r"^\s*(?:export\s+)?interface\s+(\w+)(?:<[^>]*>)?\s+extends\s+([^{]+)"),
    ],
    "rust": [("inherits", r"^\s*(?:pub\s+)?trait\s+(\w+)\s*:\s*([^{]+)")],
    "java": [
        ("inherits", r"^\s*(?:public\s+|final\s+|abstract\s+)*class\s+(\w+)(?:<[^>]*>)?\s+extends\s+([\w.]+)"),
        ("implements", r"^\s*(?:public\s+|final\s+|abstract\s+)*class\s+(\w+)[^{]*?\simplements\s+([^{]+)"),
        ("inherits", r"^\s*(?:public\s+)?interface\s+(\w+)(?:<[^>]*>)?\s+extends\s+([^{]+)"),
    ],
    "go": [],
    "cpp": [("inherits", r"^\s*(?:class|struct)\s+(\w+)\s*(?:final\s*)?:\s*([^{;]+)")],
}
# A trait implemented for a type, the other way round than the patterns above.
RUST_IMPL = re.compile(r"^\s*impl(?:<[^>]*>)?\s+(?:\w+::)*(\w+)(?:<[^>]*>)?\s+for\s+(?:\w+::)*(\w+)")
_CALL = re.compile(r"\b([A-Za-z][\w]*)\s*\(")
_WORDS = {"if", "for", "while", "switch", "return", "catch", "function", "fn", "func", "sizeof", "match", "new", "class", "def", "match", "loop", "else", "await", "match"}


@dataclass(frozen=True)
class Language:
    """A language of the user's own: file suffixes, (kind, pattern) of definitions and a pattern of imports, names in group 1."""

    name: str
    suffixes: tuple[str, ...]
    definitions: tuple[tuple[str, str], ...]
    imports: str | None = None


def is_test_path(path: str) -> bool:
    return bool(re.search(r"(^|/)tests?/|(^|/)test_[^/]*$|_test\.\w+$|\.(test|spec)\.\w+$|(^|/)__tests__/|Test\.java$", path))


def is_test_name(name: str) -> bool:
    return bool(re.match(r"test_|Test[A-Z]", name) or name.endswith("_test"))


class _Python(ast.NodeVisitor):
    def __init__(self, path: str, rows: list[tuple]) -> None:
        self.path, self.rows, self.scope, self.key = path, rows, [], f"file::{path}"
        self.test = is_test_path(path)

    def owner(self) -> str:
        return "::".join([self.path, *self.scope]) if self.scope else self.key

    def define(self, node, kind: str) -> None:
        qname = "::".join([self.path, *self.scope, node.name])
        self.rows.append(("node", kind, node.name, qname, None, None, None, self.path, node.lineno, node.end_lineno, self.test or is_test_name(node.name)))
        self.rows.append(("edge", "defines", None, None, self.owner(), qname, "extracted", self.path, node.lineno, None, None))
        self.scope.append(node.name)
        self.generic_visit(node)
        self.scope.pop()

    def visit_ClassDef(self, node):
        bases = [b.id if isinstance(b, ast.Name) else getattr(b, "attr", None) for b in node.bases]
        kind = "trait" if {"Protocol", "ABC"} & set(bases) else "type" if "TypedDict" in bases else "class"
        qname = "::".join([self.path, *self.scope, node.name])
        for b in filter(None, bases):
            self.rows.append(("node", "class", b, f"type::{b}", None, None, None, None, None, None, False))
            self.rows.append(("edge", "inherits", None, None, qname, f"type::{b}", "extracted", self.path, node.lineno, None, None))
        self.define(node, kind)

    def visit_FunctionDef(self, node):
        inside = bool(self.scope) and self.class_scope
        before, self.class_scope = self.class_scope, False
        self.define(node, "method" if inside else "function")
        self.class_scope = before

    visit_AsyncFunctionDef = visit_FunctionDef
    class_scope = False

    def generic_visit(self, node):
        if isinstance(node, ast.ClassDef):
            before, self.class_scope = self.class_scope, True
            super().generic_visit(node)
            self.class_scope = before
        else:
            super().generic_visit(node)

    def visit_Call(self, node):
        name = node.func.id if isinstance(node.func, ast.Name) else getattr(node.func, "attr", None)
        if name and not name.startswith("_"):
            self.rows.append(("node", "function", name, f"call::{name}", None, None, None, None, None, None, False))
            self.rows.append(("edge", "calls", None, None, self.owner(), f"call::{name}", "ambiguous", self.path, node.lineno, None, None))
        self.generic_visit(node)

    def visit_Import(self, node):
        for a in node.names:
            self.add_import(a.name, node.lineno)

    def visit_ImportFrom(self, node):
        self.add_import("." * node.level + (node.module or ""), node.lineno)

    def add_import(self, module: str, line: int) -> None:
        self.rows.append(("node", "module", module, f"module::{module}", None, None, None, None, None, None, False))
        self.rows.append(("edge", "imports", None, None, self.key, f"module::{module}", "extracted", self.path, line, None, None))

    def flow(self, src: str, dst: str, line: int) -> None:
        for q in (src, dst):
            if q.startswith(("var::", "param::", "return::")):
                self.rows.append(("node", "variable", q.split("::")[-1], q, None, None, None, self.path, line, None, False))
        self.rows.append(("edge", "data_flow", None, None, src, dst, "extracted", self.path, line, None, None))


def _data_flow(tree: ast.AST, visitor: _Python, scope: list[str]) -> None:
    """Parameters and assignments of each function, and what its returns use."""
    for node in ast.iter_child_nodes(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            own = "::".join([visitor.path, *scope, node.name])
            params = {a.arg for a in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]}
            seen = set()

            def add(src: str, dst: str, line: int, seen=seen) -> None:
                if (src, dst) not in seen:
                    seen.add((src, dst))
                    visitor.flow(src, dst, line)

            for x in ast.walk(node):
                if isinstance(x, ast.Assign):
                    used = {n.id for n in ast.walk(x.value) if isinstance(n, ast.Name)} & params
                    for t in x.targets:
                        if isinstance(t, ast.Name):
                            add(own, f"var::{own}::{t.id}", x.lineno)
                            for p in sorted(used):
                                add(f"param::{own}::{p}", f"var::{own}::{t.id}", x.lineno)
                elif isinstance(x, ast.Return) and x.value is not None:
                    add(own, f"return::{own}", x.lineno)
                    for p in sorted({n.id for n in ast.walk(x.value) if isinstance(n, ast.Name)} & params):
                        add(f"param::{own}::{p}", f"return::{own}", x.lineno)
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            _data_flow(node, visitor, [*scope, node.name])


def extract_python(path: str, text: str) -> list[tuple]:
    rows: list[tuple] = [("node", "file", path.rsplit("/", 1)[-1], f"file::{path}", None, None, None, path, 1, text.count("\n") + 1, is_test_path(path))]
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return rows
    visitor = _Python(path, rows)
    visitor.visit(tree)
    _data_flow(tree, visitor, [])
    return rows


def parents(line: str, dialect: str) -> list[tuple[str, str, str]]:
    """(edge kind, child, parent) that a line declares; qualifiers, access words and type arguments go."""
    out = []
    for kind, p in PARENTS.get(dialect, []):
        if m := re.match(p, line):
            for raw in re.split(r"[,+&]", re.sub(r"<[^>]*>", "", m[2])):
                words = re.findall(r"[A-Za-z_]\w*", re.split(r"\swhere\s|\simplements\s", raw)[0])
                if words:
                    out.append((kind, m[1], words[-1]))
    if dialect == "rust" and (m := RUST_IMPL.match(line)):
        out.append(("implements", m[2], m[1]))
    return out


def extract_lines(path: str, text: str, dialect: str, languages: dict[str, Language] | None = None) -> list[tuple]:
    """Definitions, parents, imports and calls by line patterns; a definition runs to the line before the next one."""
    test = is_test_path(path)
    lines = text.split("\n")
    rows: list[tuple] = [("node", "file", path.rsplit("/", 1)[-1], f"file::{path}", None, None, None, path, 1, len(lines), test)]
    custom = (languages or {}).get(dialect)
    patterns = custom.definitions if custom else PATTERNS[dialect]
    found = [(n, kind, m[1]) for n, line in enumerate(lines, 1) for kind, p in patterns if (m := re.match(p, line))]
    ends = [n - 1 for n, *_ in found[1:]] + [len(lines)]
    owner_at, holder = [f"file::{path}"] * (len(lines) + 2), None
    for (n, kind, name), end in zip(found, ends):
        indent = len(lines[n - 1]) - len(lines[n - 1].lstrip())
        if kind in ("class", "trait", "impl"):
            holder = name
        inside = holder and indent and kind in ("function", "method")
        qname = "::".join([path, holder, name] if inside else [path, name])
        rows.append(("node", "method" if inside and kind == "function" else kind, name, qname, None, None, None, path, n, end, test or is_test_name(name)))
        rows.append(("edge", "defines", None, None, f"file::{path}", qname, "extracted", path, n, None, None))
        owner_at[n : end + 1] = [qname] * (end + 1 - n)
    starts = {n for n, *_ in found}
    for n, line in enumerate(lines, 1):
        for kind, child, parent in parents(line, dialect):
            rows.append(("node", "class", parent, f"type::{parent}", None, None, None, None, None, None, False))
            rows.append(("edge", kind, None, None, f"{path}::{child}", f"type::{parent}", "ambiguous", path, n, None, None))
        imports = custom.imports if custom else IMPORTS.get(dialect)
        for m in re.finditer(imports, line) if imports else ():
            rows.append(("node", "module", m[1], f"module::{m[1]}", None, None, None, None, None, None, False))
            rows.append(("edge", "imports", None, None, f"file::{path}", f"module::{m[1]}", "extracted", path, n, None, None))
        for m in _CALL.finditer(line if n not in starts else line.split("{", 1)[-1] if "{" in line else ""):
            if m[1] not in _WORDS and not m[1].startswith("_"):
                rows.append(("node", "function", m[1], f"call::{m[1]}", None, None, None, None, None, None, False))
                rows.append(("edge", "calls", None, None, owner_at[n], f"call::{m[1]}", "ambiguous", path, n, None, None))
    return rows


def extract_markdown(path: str, text: str) -> list[tuple]:
    """The document, its nested sections, and mentions from code spans."""
    key = f"doc::{path}"
    rows: list[tuple] = [("node", "document", path.rsplit("/", 1)[-1], key, None, None, None, path, 1, text.count("\n") + 1, False)]
    trail: list[tuple[int, str]] = [(0, key)]
    fenced = False
    for n, line in enumerate(text.split("\n"), 1):
        fenced ^= line.lstrip().startswith("```")
        if not fenced and (m := re.match(r"(#{1,6})\s+(.+?)\s*#*$", line)):
            while trail[-1][0] >= len(m[1]):
                trail.pop()
            q = f"{trail[-1][1]}::{m[2]}"
            rows.append(("node", "section", m[2], q, None, None, None, path, n, None, False))
            rows.append(("edge", "defines", None, None, trail[-1][1], q, "extracted", path, n, None, None))
            trail.append((len(m[1]), q))
        for m in re.finditer(r"`([A-Za-z_][\w.:]*)`", line):
            rows.append(("edge", "mentions", None, None, trail[-1][1], m[1], "inferred", path, n, None, None))
    return rows


def extract(path: str, text: str, languages: tuple[Language, ...] = ()) -> list[tuple]:
    """Rows of one file; ``languages`` come before the built-in dialects."""
    suffix = path.rsplit(".", 1)[-1].lower() if "." in path else ""
    own = next((x for x in languages if suffix in x.suffixes), None)
    if own:
        return extract_lines(path, text, own.name, {own.name: own})
    dialect = DIALECTS.get(suffix)
    if dialect == "python":
        return extract_python(path, text)
    if dialect == "markdown":
        return extract_markdown(path, text)
    return extract_lines(path, text, dialect) if dialect else []


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """path (from the root), content, hash of every supported file; the whole tree is one scan."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("://")[-1].lstrip("/")
    path = F.regexp_replace(F.col("path"), f"^.*?{re.escape(base)}/", "")
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    skip = r"(^|/)(" + "|".join(re.escape(d) for d in IGNORED) + ")/"
    return files.select(path.alias("path"), F.decode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("hash")).filter(suffix.isin(*DIALECTS) & ~path.rlike(skip))


def extract_rows(files: DataFrame, languages: tuple[Language, ...] = ()) -> DataFrame:
    """Node and edge rows of (path, content), parsed in Arrow batches.

    Files are dealt to tasks by path: parsing costs far more than reading, and a table of a few MB is one task otherwise.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ROWS.split(", ")]
        for b in batches:
            rows = [r for p, t in zip(b["path"], b["content"]) for r in extract(p, t or "", languages)]
            out = pd.DataFrame(rows, columns=names)
            for c in ("line_start", "line_end"):
                out[c] = out[c].astype("Int32")
            out["is_test"] = out["is_test"].astype("boolean")
            yield out

    spark = files.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return files.select("path", "content").repartition(parts, "path").mapInPandas(run, ROWS)


def code_graph(files: DataFrame, languages: tuple[Language, ...] = ()):
    """Nodes and edges of a source tree; ids are hashes of the qualified names, so files need no common order."""
    from tessera.sources.adapters import Graph

    rows = extract_rows(files, languages)
    n = rows.filter("row = 'node'").groupBy("qualified_name").agg(*(F.min(c).alias(c) for c in ("kind", "name", "source_uri", "line_start", "line_end")), F.max("is_test").alias("is_test"))
    nodes = n.select(F.xxhash64("qualified_name").alias("id"), "kind", "name", "qualified_name", "source_uri", "line_start", "line_end", (F.col("line_end") - F.col("line_start") + 1).alias("line_count"), F.coalesce("is_test", F.lit(False)).alias("is_test"))
    e = rows.filter("row = 'edge'")
    edges = e.select(F.xxhash64("src", "dst", "kind", "source_uri", "line_start").alias("id"), F.xxhash64("src").alias("src"), F.xxhash64("dst").alias("dst"), "kind", "conf_class", F.when(F.col("conf_class") == "extracted", 1.0).otherwise(0.0).alias("confidence"))
    return Graph(nodes, edges)
