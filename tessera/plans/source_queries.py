"""Registered queries of sources: generated manifests, diagrams, source files of several languages, call evidence; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import typing
from tessera.plans.pass_queries import placeholder_graph
from tessera.runtime import read_table
from tessera.sources import aliases, code, documents, evidence, manifests
from tessera.sources.adapters import COMMERCE_SQL, Graph, commerce_graph

_Q: dict = {}
_SQL: dict[str, str] = {}


def _add(name, run, sql=None):
    _Q[name] = run
    if sql is not None:
        _SQL[name] = sql


def _made(table: str, path: str, content: str):
    """Files (path, content) made from the rows of a table by SQL expressions."""
    return lambda s, d: read_table(s, d, table).selectExpr(f"{path} AS path", f"{content} AS content")


# --- manifests ---

_package = _made(
    "part",
    "concat('p', p_partkey, '/package.json')",
    """concat('{"name": "pkg-', p_partkey, '", "version": "1.0", "dependencies": {"brand-', p_size, '": "^', p_size, '.1", "left": "*"}, "devDependencies": {"dev-', p_partkey % 7, '": "~2"}, "scripts": {"x": "y"}}')""",
)
_add(
    "package_json",
    lambda s, d: manifests.package_json(_package(s, d)).drop("path"),
    """SELECT 'pkg-' || p_partkey AS package, unnest(['dependencies', 'dependencies', 'devDependencies']) AS section, unnest(['brand-' || p_size, 'left', 'dev-' || (p_partkey % 7)]) AS dependency, unnest(['^' || p_size || '.1', '*', '~2']) AS version FROM part""",
)
_REQ = "concat('lib', p_partkey, CASE p_partkey % 5 WHEN 0 THEN '>=1.2,<3' WHEN 1 THEN '[extra,more] ~= 2.1' WHEN 2 THEN '' WHEN 3 THEN ' ; python_version < \"3\"' ELSE '==1.0; os_name == \"nt\"' END)"
_add(
    "split_requirement",
    lambda s, d: read_table(s, d, "part").selectExpr("p_partkey AS id", f"{_REQ} AS r").select("id", manifests.split_requirement(F.col("r")).alias("x")).select("id", "x.name", "x.version"),
    "SELECT p_partkey AS id, 'lib' || p_partkey AS name, CASE p_partkey % 5 WHEN 0 THEN '>=1.2,<3' WHEN 1 THEN '~= 2.1' WHEN 4 THEN '==1.0' END AS version FROM part",
)
_pyproject = _made("supplier", "concat('s', s_suppkey, '/pyproject.toml')", r"""concat('[project]\nname = "sup', s_suppkey, '"\ndependencies = ["a', s_nationkey, '>=1", "b[x]"]\n[tool.poetry.dependencies]\npython = "^3"\nc = {version = "2.0", optional = true}\nd = "*"\n')""")
_add(
    "pyproject_toml",
    lambda s, d: manifests.toml_manifests(_pyproject(s, d)).drop("path"),
    "SELECT 'sup' || s_suppkey AS package, unnest(['project', 'project', 'poetry', 'poetry']) AS section, unnest(['a' || s_nationkey, 'b', 'c', 'd']) AS dependency, unnest(['>=1', NULL, '2.0', '*']) AS version FROM supplier",
)
_cargo = _made("supplier", "concat('s', s_suppkey, '/Cargo.toml')", r"""concat('[package]\nname = "crate', s_suppkey, '"\n[dependencies]\nserde = "1.', s_nationkey, '"\nlocal = {path = "../x"}\n[dev-dependencies]\ntest = {version = "0.3"}\n')""")
_add(
    "cargo_toml",
    lambda s, d: manifests.toml_manifests(_cargo(s, d)).drop("path"),
    "SELECT 'crate' || s_suppkey AS package, unnest(['dependencies', 'dependencies', 'dev-dependencies']) AS section, unnest(['serde', 'local', 'test']) AS dependency, unnest(['1.' || s_nationkey, NULL, '0.3']) AS version FROM supplier",
)


def _manifest_graph(s: SparkSession, d: str) -> DataFrame:
    g = manifests.manifest_graph(_package(s, d).unionByName(_pyproject(s, d)).unionByName(_cargo(s, d)))
    name = g.nodes.select("id", "qualified_name")
    return g.edges.join(name.withColumnsRenamed({"id": "src", "qualified_name": "from"}), "src").join(name.withColumnsRenamed({"id": "dst", "qualified_name": "to"}), "dst").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("from").alias("sources"), F.countDistinct("to").alias("targets"))


_add(
    "manifest_graph",
    _manifest_graph,
    """WITH p AS (SELECT 'p' || p_partkey AS f, 'pkg-' || p_partkey AS package, unnest(['brand-' || p_size, 'left', 'dev-' || (p_partkey % 7)]) AS dep FROM part),
    s AS (SELECT 's' || s_suppkey AS f, 'sup' || s_suppkey AS package, unnest(['a' || s_nationkey, 'b', 'c', 'd']) AS dep FROM supplier UNION ALL SELECT 'c' || s_suppkey, 'crate' || s_suppkey, unnest(['serde', 'local', 'test']) FROM supplier), a AS (SELECT * FROM p UNION ALL SELECT * FROM s)
    SELECT 'defines' AS kind, count(*) AS n, count(DISTINCT f) AS sources, count(DISTINCT package) AS targets FROM (SELECT DISTINCT f, package FROM a) UNION ALL SELECT 'depends_on', count(*), count(DISTINCT package), count(DISTINCT dep) FROM (SELECT DISTINCT package, dep FROM a)""",
)

# --- documents ---

_svg = _made("part", "concat('d', p_partkey, '.svg')", r"""concat('<svg><text x="1">\n ', p_brand, ' </text><g><text class="a"><tspan>size ', p_size, '</tspan></text></g><text> <b></b> </text></svg>')""")
_add(
    "svg_labels",
    lambda s, d: documents.svg_labels(_svg(s, d)).select("path", F.col("place").cast("long").alias("place"), "label"),
    "SELECT 'd' || p_partkey || '.svg' AS path, unnest([0, 1])::BIGINT AS place, unnest([p_brand, 'size ' || p_size]) AS label FROM part",
)
_add("svg_illustrates", lambda s, d: documents.svg_graph_rows(_svg(s, d)).groupBy("dst").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("score")), "SELECT 'concept::' || l AS dst, count(*) AS n, 0.7::DOUBLE AS score FROM (SELECT unnest([p_brand, 'size ' || p_size]) AS l FROM part) GROUP BY l")
_PATH = "concat('src/', p_brand, '/', p_size, '/f', p_partkey, CASE p_partkey % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.md' WHEN 2 THEN '.svg' ELSE '.log' END)"
_add("concept_kinds", lambda s, d: read_table(s, d, "part").selectExpr("p_partkey AS id", f"{_PATH} AS path").select("id", documents.concept_kind(F.col("path")).alias("kind")), "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 1 THEN 'markdown' WHEN 2 THEN 'svg' END AS kind FROM part")
_add(
    "ignored_paths",
    lambda s, d: read_table(s, d, "part").selectExpr("p_partkey AS id", f"{_PATH} AS path").select("id", documents.ignored(F.col("path"), ["*.log", "Brand#1*", "!src/Brand#11", "7", "src/Brand#2?/1*/*.md"]).alias("ignored")),
    r"""WITH p AS (SELECT p_partkey AS id, p_brand AS b, p_size AS z, p_partkey % 4 AS k FROM part)
    SELECT id, CASE WHEN regexp_matches(b, '^Brand#2.$') AND z::VARCHAR LIKE '1%' AND k = 1 THEN true WHEN z = 7 THEN true WHEN b = 'Brand#11' THEN false WHEN b LIKE 'Brand#1%' THEN true ELSE k = 3 END AS ignored FROM p""",
)


def _commits(s: SparkSession, d: str) -> DataFrame:
    o = read_table(s, d, "orders").selectExpr("o_orderkey AS k", "o_custkey AS c")
    line = lambda place, text: o.selectExpr("'log' AS source", f"k * 10 + {place} AS line", f"{text} AS text")
    log = line(0, "concat('commit ', lower(hex(k)), '|cust', c, '|', k * 60)").unionByName(line(1, "''")).unionByName(line(2, "concat('src/', c, '.py')")).unionByName(line(3, "concat('doc/', k % 5, '.md')"))
    return documents.commit_rows(log)


_add("commit_log", _commits, "SELECT printf('%x', o_orderkey) AS commit, 'cust' || o_custkey AS author, o_orderkey * 60 AS at, unnest(['src/' || o_custkey || '.py', 'doc/' || (o_orderkey % 5) || '.md']) AS path FROM orders")

# --- source files of several languages ---

_JAVA = r"concat('package a;\nimport java.util.List', p_size, ';\npublic class P', p_partkey, '<T> extends P', p_partkey + 1, ' implements Named', p_size % 3, ', java.io.Sized {\n  public int f() {\n    helper', p_size, '();\n  }\n}\n')"
_RUST = r"concat('use std::x', p_size, ';\npub struct P', p_partkey, ';\nimpl Named for P', p_partkey, ' {\n    pub fn f(&self) {\n        helper', p_size, '();\n    }\n}\ntrait Q', p_partkey, ': Base + Send {\n}\n')"
_TS = r"concat('import {x} from \"m', p_size, '\";\nexport class P', p_partkey, ' extends P', p_partkey + 1, ' implements A, B {\n}\nexport function f() {\n  helper', p_size, '();\n}\n')"
_CPP = r"concat('#include <m', p_size, '.h>\nclass P', p_partkey, ' : public P', p_partkey + 1, ', private std::Base {\n};\n')"
_FILES = {"java": _JAVA, "rs": _RUST, "ts": _TS, "cpp": _CPP}


def _sources(s: SparkSession, d: str) -> DataFrame:
    p, out = read_table(s, d, "part"), None
    for suffix, text in _FILES.items():
        made = p.selectExpr(f"concat('gen/p', p_partkey, '.{suffix}') AS path", f"{text} AS content")
        out = made if out is None else out.unionByName(made)
    return out


_add(
    "inheritance_edges",
    lambda s, d: code.extract_rows(_sources(s, d)).filter("kind IN ('inherits', 'implements') AND row = 'edge'").select("kind", "src", "dst"),
    """WITH p AS (SELECT p_partkey AS k, p_size % 3 AS z FROM part), r AS (
        SELECT 'gen/p' || k || '.java::P' || k AS src, unnest(['inherits', 'implements', 'implements']) AS kind, unnest(['P' || (k + 1), 'Named' || z, 'Sized']) AS t FROM p
        UNION ALL SELECT 'gen/p' || k || '.ts::P' || k, unnest(['inherits', 'implements', 'implements']), unnest(['P' || (k + 1), 'A', 'B']) FROM p
        UNION ALL SELECT 'gen/p' || k || '.rs::' || unnest(['P' || k, 'Q' || k, 'Q' || k]), unnest(['implements', 'inherits', 'inherits']), unnest(['Named', 'Base', 'Send']) FROM p
        UNION ALL SELECT 'gen/p' || k || '.cpp::P' || k, 'inherits', unnest(['P' || (k + 1), 'Base']) FROM p)
    SELECT kind, src, 'type::' || t AS dst FROM r""",
)
_add(
    "language_definitions",
    lambda s, d: code.extract_rows(_sources(s, d)).filter("row = 'node' AND source_uri IS NOT NULL AND kind <> 'file'").select("kind", "qualified_name"),
    """WITH p AS (SELECT p_partkey AS k FROM part)
    SELECT 'class' AS kind, 'gen/p' || k || '.' || unnest(['java', 'rs', 'ts', 'cpp']) || '::P' || k AS qualified_name FROM p UNION ALL SELECT 'method', 'gen/p' || k || '.java::P' || k || '::f' FROM p
    UNION ALL SELECT unnest(['impl', 'method', 'trait']), 'gen/p' || k || '.rs::' || unnest(['P' || k, 'P' || k || '::f', 'Q' || k]) FROM p UNION ALL SELECT 'function', 'gen/p' || k || '.ts::f' FROM p""",
)
_add(
    "language_imports_calls",
    lambda s, d: code.extract_rows(_sources(s, d)).filter("row = 'edge' AND kind IN ('imports', 'calls')").groupBy("kind", "dst").agg(F.count(F.lit(1)).alias("n")),
    """WITH p AS (SELECT p_size AS z FROM part), e AS (SELECT 'imports' AS kind, 'module::' || unnest(['java.util.List' || z, 'std::x' || z, 'm' || z, 'm' || z || '.h']) AS dst FROM p UNION ALL SELECT 'calls', unnest(['call::helper' || z, 'call::helper' || z, 'call::helper' || z]) FROM p)
    SELECT kind, dst, count(*) AS n FROM e GROUP BY kind, dst""",
)
_PROC = code.Language("proc", ("prc",), (("function", r"^proc\s+(\w+)"), ("class", r"^unit\s+(\w+)")), r"^need\s+(\w+)")


def _custom(s: SparkSession, d: str) -> DataFrame:
    files = read_table(s, d, "supplier").selectExpr("concat('s', s_suppkey, '.prc') AS path", r"concat('need base\nunit U', s_suppkey, '\nproc f', s_suppkey, '\n  go', s_nationkey, '()\n') AS content")
    return code.extract_rows(files, (_PROC,)).filter("row = 'edge'").select("kind", "src", "dst")


_add(
    "custom_language",
    _custom,
    """WITH s AS (SELECT s_suppkey AS k, s_nationkey AS n FROM supplier) SELECT 'imports' AS kind, 'file::s' || k || '.prc' AS src, 'module::base' AS dst FROM s
    UNION ALL SELECT 'defines', 'file::s' || k || '.prc', 's' || k || '.prc::U' || k FROM s UNION ALL SELECT 'defines', 'file::s' || k || '.prc', 's' || k || '.prc::U' || k || '::f' || k FROM s WHERE false
    UNION ALL SELECT 'defines', 'file::s' || k || '.prc', 's' || k || '.prc::f' || k FROM s UNION ALL SELECT 'calls', 's' || k || '.prc::f' || k, 'call::go' || n FROM s""",
)
_MD = r"concat('# Part ', p_partkey, '\ntext `code_', p_size, '`\n## Size\nmore\n```\n# no heading\n```\n## Brand\n`Brand.x`\n')"
_add(
    "markdown_sections",
    lambda s, d: code.extract_rows(read_table(s, d, "part").selectExpr("concat('p', p_partkey, '.md') AS path", f"{_MD} AS content")).filter("row = 'edge'").select("kind", "src", "dst"),
    """WITH p AS (SELECT 'doc::p' || p_partkey || '.md' AS d, 'doc::p' || p_partkey || '.md::Part ' || p_partkey AS t, p_size AS z FROM part)
    SELECT 'defines' AS kind, d AS src, t AS dst FROM p UNION ALL SELECT 'defines', t, t || unnest(['::Size', '::Brand']) FROM p UNION ALL SELECT 'mentions', t, 'code_' || z FROM p UNION ALL SELECT 'mentions', t || '::Brand', 'Brand.x' FROM p""",
)

# --- evidence for calls ---


def _modules(s: SparkSession, d: str) -> DataFrame:
    p = read_table(s, d, "part").selectExpr("p_partkey AS id", "concat('src/app', p_partkey % 3, '/core/m', p_size, '.py') AS caller", "concat('src/app', p_partkey % 2, '/core/', CASE WHEN p_partkey % 5 = 0 THEN '__init__' ELSE concat('n', p_size % 4) END, '.py') AS candidate", "element_at(array('app0.core.n1', '.n2', '..core.n3', 'core', '.', 'app1.core'), CAST(p_partkey % 6 + 1 AS INT)) AS module")
    return p.select("id", typing.module_matches(F.col("module"), F.col("caller"), F.col("candidate")).alias("matches"))


_add(
    "module_matches",
    _modules,
    """WITH p AS (SELECT p_partkey AS id, 'src/app' || (p_partkey % 3) AS app, 'src/app' || (p_partkey % 2) || '/core' || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE '/n' || (p_size % 4) END AS c, p_partkey % 6 AS k FROM part),
    e AS (SELECT *, CASE k WHEN 1 THEN app || '/core/n2' WHEN 2 THEN app || '/core/n3' WHEN 4 THEN app || '/core' END AS x FROM p)
    SELECT id, CASE k WHEN 0 THEN contains('/' || c || '/', '/app0/core/n1/') WHEN 3 THEN contains('/' || c || '/', '/core/') WHEN 5 THEN contains('/' || c || '/', '/app1/core/') ELSE c = x OR starts_with(c, x || '/') END AS matches FROM e""",
)
_TEXT = r"element_at(array('let mut obj = Order::new(1);', 'def f(obj: Customer): pass', 'obj = Part(3)', 'let obj = Line { a: 1 };', 'fn g(obj: &mut dyn io::Reader) {}', 'nothing here'), CAST(p_partkey % 6 + 1 AS INT))"
_add(
    "receiver_types",
    lambda s, d: read_table(s, d, "part").selectExpr("p_partkey AS id", "CASE WHEN p_partkey % 11 = 0 THEN 'Node.make(2)' ELSE 'obj' END AS receiver", f"{_TEXT} AS text").select("id", typing.receiver_type(F.col("receiver"), F.col("text"), {"obj": "Thing"}).alias("type")),
    "SELECT p_partkey AS id, CASE WHEN p_partkey % 11 = 0 THEN 'Node' ELSE ['Order', 'Customer', 'Part', 'Line', 'Reader', 'Thing'][p_partkey % 6 + 1] END AS type FROM part",
)


def _calls(s: SparkSession, d: str) -> Graph:
    """Placeholder calls of brands, with callers in files of several languages and owned definitions."""
    g = placeholder_graph(s, d)
    suffix = F.element_at(F.array(*(F.lit(x) for x in (".py", ".rs", ".ts", ".txt"))), (F.col("id") % 4 + 1).cast("int"))
    return Graph(g.nodes.withColumn("source_uri", F.when(F.col("kind") == "method", F.concat(F.lit("f/"), F.col("id").cast("string"), suffix)).otherwise(F.col("source_uri"))), g.edges)


def _stubs(s: SparkSession, d: str) -> DataFrame:
    rows = read_table(s, d, "part").filter("p_partkey % 1500 < 40").select((F.col("p_partkey") % 1500).alias("k")).distinct()
    out = None
    for dialect, kind in (("python", "Dict"), ("python", "Array"), ("rust", "Vec"), ("javascript", "Map")):
        x = rows.select(F.lit(dialect).alias("dialect"), F.lit(kind).alias("type"), F.concat(F.lit("n"), F.col("k").cast("string")).alias("method"))
        out = x if out is None else out.unionByName(x)
    return out.unionByName(rows.select(F.lit("python").alias("dialect"), F.concat(F.lit("n"), F.col("k").cast("string")).alias("type"), F.concat(F.lit("n"), F.col("k").cast("string")).alias("method")).filter("type IN ('n1', 'n2')"))


_CALLS = "WITH c AS (SELECT l_orderkey * 100 + l_linenumber AS edge_id, l_partkey % 1500 AS k, (l_orderkey + 1000000000000) % 4 AS f FROM lineitem)"
_add(
    "library_stubs",
    lambda s, d: typing.resolve_library_stubs(_calls(s, d), _stubs(s, d)),
    _CALLS
    + """, t AS (SELECT edge_id, k, unnest(CASE f WHEN 0 THEN CASE WHEN k IN (1, 2) THEN ['Array', 'n' || k] ELSE ['Array'] END WHEN 1 THEN ['Vec'] ELSE ['Map'] END) AS type FROM c WHERE f < 3 AND k IN (SELECT p_partkey % 1500 FROM part WHERE p_partkey % 1500 < 40))
    SELECT edge_id, 'stub::' || type AS stub FROM t QUALIFY row_number() OVER (PARTITION BY edge_id ORDER BY (type <> 'n' || k)::INT, type) = 1""",
)


def _texts(s: SparkSession, d: str) -> DataFrame:
    text = "element_at(array('#[pyfunction] fn f() {}', 'import ctypes', 'from cffi import FFI', 'import x from \"./y.js\"', 'plain'), CAST(p_partkey % 5 + 1 AS INT))"
    return read_table(s, d, "part").selectExpr("concat('part::', p_partkey) AS qualified_name", "concat('f/', p_partkey, element_at(array('.py', '.rs', '.ts'), CAST(p_size % 3 + 1 AS INT))) AS source_uri", f"{text} AS source_text")


_add(
    "ffi_boundaries",
    lambda s, d: typing.ffi_boundaries(_texts(s, d)).select("binding", "caller", "callee", "key"),
    """SELECT CASE p_partkey % 5 WHEN 0 THEN 'pyo3' WHEN 1 THEN 'ctypes' WHEN 2 THEN 'cffi' ELSE 'js_import' END AS binding, CASE WHEN p_partkey % 5 = 0 THEN 'rust' WHEN p_partkey % 5 < 3 THEN 'python' ELSE 'typescript' END AS caller,
    CASE WHEN p_partkey % 5 = 0 THEN 'python' WHEN p_partkey % 5 < 3 THEN 'cpp' ELSE 'javascript' END AS callee, 'part::' || p_partkey AS key FROM part
    WHERE (p_partkey % 5 = 0 AND p_size % 3 = 1) OR (p_partkey % 5 IN (1, 2) AND p_size % 3 = 0) OR (p_partkey % 5 = 3 AND p_size % 3 = 2)""",
)


def _cross(s: SparkSession, d: str) -> DataFrame:
    rows = read_table(s, d, "part").select((F.col("p_partkey") % 1500).alias("k"), F.col("p_partkey").alias("target"))
    registry = rows.select(F.when(F.col("target") % 2 == 0, "rust").otherwise("python").alias("dialect"), F.concat(F.lit("n"), F.col("k").cast("string")).alias("name"), "target")
    return typing.resolve_cross_language(_calls(s, d), s.createDataFrame([("rust", "python")], "caller string, callee string"), registry)


_add(
    "cross_language_calls",
    _cross,
    _CALLS + " SELECT edge_id, min(p_partkey) AS target, 0.5::DOUBLE AS score FROM c JOIN part ON p_partkey % 1500 = k WHERE (f = 0 AND p_partkey % 2 = 0) OR (f = 1 AND p_partkey % 2 = 1) GROUP BY edge_id",
)


# --- path aliases ---


def _aliases(s: SparkSession, d: str) -> DataFrame:
    """Customers import parts by short names; a nation has the configuration of its folder, one file lies above all."""
    part, customer, nation = (read_table(s, d, t) for t in ("part", "customer", "nation"))
    k, c, n = F.col("p_partkey"), F.col("c_custkey"), F.col("n_nationkey")
    text = lambda x: x.cast("string")
    tail = F.when(k % 3 == 0, F.concat(F.lit("/src/lib/p"), text(k), F.lit(".ts"))).when(k % 3 == 1, F.concat(F.lit("/src/lib/p"), text(k), F.lit("/index.js"))).otherwise(F.concat(F.lit("/src/p"), text(k), F.lit(".tsx")))
    files = part.select(F.concat(F.lit("app/m"), text(k % 7), tail).alias("path"))
    parts = part.count()
    module = F.when(c % 5 == 4, F.lit("@types/node")).otherwise(F.concat(F.when(c % 2 == 0, "@lib/p").otherwise("~/p"), text(c % parts)))
    imports = customer.select(module.alias("module"), F.concat(F.lit("app/m"), text(c % 8), F.lit("/src/deep/c"), text(c), F.lit(".ts")).alias("uri"))
    body = F.concat(F.lit('{\n  // "paths" of '), "n_name", F.lit('\n  "extends": "https://base//x", /* all */ "compilerOptions": {"baseUrl": "src", "paths": {"@lib/*": ["../src/lib/*"], "~/*": ["./*"]}}\n}'))
    own = nation.filter(n < 7).select(F.concat(F.lit("app/m"), text(n), F.lit("/tsconfig.json")).alias("path"), body.alias("content"))
    top = nation.filter(n == 0).select(F.lit("tsconfig.app.json").alias("path"), F.lit('{"compilerOptions": {"paths": {"@lib/*": ["app/m0/src/lib/*"]}}}').alias("content"))
    return aliases.alias_targets(imports, own.unionByName(top), files)


_add(
    "path_aliases",
    _aliases,
    """WITH n AS (SELECT count(*) AS n FROM part), c AS (
        SELECT DISTINCT CASE WHEN c_custkey % 2 = 0 THEN '@lib/p' ELSE '~/p' END || c_custkey % n AS module, 'app/m' || c_custkey % 8 || '/src/deep/c' || c_custkey || '.ts' AS uri,
               c_custkey % 2 = 0 AS lib, c_custkey % 8 AS m, c_custkey % n AS k FROM customer, n WHERE c_custkey % 5 <> 4
    ), t AS (
        SELECT module, uri, CASE
            WHEN k NOT IN (SELECT p_partkey FROM part) THEN NULL
            WHEN lib AND m < 7 AND k % 7 = m AND k % 3 = 0 OR lib AND m = 7 AND k % 7 = 0 AND k % 3 = 0 THEN 'app/m' || k % 7 || '/src/lib/p' || k || '.ts'
            WHEN lib AND m < 7 AND k % 7 = m AND k % 3 = 1 OR lib AND m = 7 AND k % 7 = 0 AND k % 3 = 1 THEN 'app/m' || k % 7 || '/src/lib/p' || k || '/index.js'
            WHEN NOT lib AND m < 7 AND k % 7 = m AND k % 3 = 2 THEN 'app/m' || m || '/src/p' || k || '.tsx' END AS target FROM c
    ) SELECT module, uri, target, CASE WHEN target IS NULL THEN 'not_found' ELSE 'resolved' END AS reason FROM t""",
)


# --- compiler evidence ---


def _evidence(s: SparkSession, d: str) -> DataFrame:
    """One evidence file an order: its line items, a supplier that it implements, and a part that nobody has."""
    line, orders = read_table(s, d, "lineitem"), read_table(s, d, "orders")
    n = read_table(s, d, "supplier").count()
    name = lambda table, key: F.concat(F.lit(f"{table}::"), key.cast("string"))
    o = F.col("o_orderkey")
    row = lambda src, dst, kind, detail: F.struct(src.alias("source"), dst.alias("target"), F.lit(kind).alias("kind"), detail.alias("detail"))
    calls = line.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(row(name("order", F.col("l_orderkey")), name("part", F.col("l_partkey")), "calls", F.lit("seen")))).alias("calls"))
    more = F.array(row(name("order", o), name("supplier", o % n), "implements", F.lit(None).cast("string")), row(name("order", o), F.lit("part::none"), "calls", F.lit("lost")))
    body = F.to_json(F.struct(F.lit(1).alias("version"), F.lit("checker ").alias("provider"), F.concat(F.coalesce("calls", F.array().cast("array<struct<source:string,target:string,kind:string,detail:string>>")), more).alias("edges")))
    files = orders.join(calls, "o_orderkey", "left").select(F.concat(F.lit("e/"), o.cast("string"), F.lit(".json")).alias("path"), body.alias("content"))
    g, report = evidence.apply_evidence(commerce_graph(s, d), evidence.read_evidence(files))
    counts = g.edges.groupBy("kind", "conf_class", "provider", "detail").agg(F.count(F.lit(1)).alias("n"))
    told = report.select(F.explode(F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).alias("n")) for c in ("added", "upgraded", "unresolved")))).alias("r")).select("r.kind", F.lit("report").alias("conf_class"), F.lit(None).cast("string").alias("provider"), F.lit(None).cast("string").alias("detail"), "r.n")
    return counts.unionByName(told)


_add(
    "compiler_evidence",
    _evidence,
    f"""WITH {COMMERCE_SQL}, e AS (SELECT *, CASE WHEN kind = 'calls' AND id = min(id) OVER (PARTITION BY src, dst, kind) THEN 'checker' END AS provider FROM edges),
    x AS (SELECT kind, CASE WHEN provider IS NULL THEN conf_class ELSE 'extracted' END AS conf_class, provider, CASE WHEN provider IS NULL THEN NULL ELSE 'seen' END AS detail FROM e
        UNION ALL SELECT 'implements', 'extracted', 'checker', NULL FROM orders)
    SELECT kind, conf_class, provider, detail, count(*) AS n FROM x GROUP BY ALL
    UNION ALL SELECT 'added', 'report', NULL, NULL, count(*) FROM orders UNION ALL SELECT 'unresolved', 'report', NULL, NULL, count(*) FROM orders
    UNION ALL SELECT 'upgraded', 'report', NULL, NULL, count(*) FROM lineitem""",
)


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
