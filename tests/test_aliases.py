"""Path aliases on hand-made trees."""

import pytest

from tessera import schemas
from tessera.sources import aliases
from tessera.sources.adapters import Graph

CONFIGS = [
    ("tsconfig.app.json", '{"compilerOptions": {"paths": {"@top/*": ["top/*"]}}}'),
    ("tsconfig.json", '{"compilerOptions": {"baseUrl": ".", "paths": {"@one": ["src/one"], "@a/*": ["none/*", "src/*"], "@a/b/*": ["src/b/*"], "#*/x": ["src/*/y"], "@no": []}}} // end'),
    ("pkg/tsconfig.node.json", '{ /* a "comment" */ "compilerOptions": { // "paths": {}\n "baseUrl": "./lib/../src", "paths": {"~/*": ["./*"], "@s": ["q//\\"r"]}}}'),
    ("bad/tsconfig.json", '{"compilerOptions": {"paths": {"@one": ["src/one"],}}}'),
    ("pkg/other.json", "{}"),
    ("nul/tsconfig.json", None),
]
FILES = ["src/one.ts", "src/b/c.js", "src/q/y.vue", "pkg/src/u.tsx", "pkg/src/dir/index.mjs", "pkg/src/f.service.ts", "pkg/src/f.ts", "@bare/z.ts", "top/t.ts", "src/deep.spec.js", None]
IMPORTS = [
    ("@one", "src/m.ts", "src/one.ts", "resolved"),
    ("@a/b/c", "src/m.ts", "src/b/c.js", "resolved"),
    ("#q/x", "src/a/b/m.ts", "src/q/y.vue", "resolved"),
    ("@bare/z", "src/m.ts", "@bare/z.ts", "resolved"),
    ("@no", "src/m.ts", None, "not_found"),
    ("@top/t", "src/m.ts", None, "not_found"),  # tsconfig.json comes before tsconfig.app.json
    ("~/u", "pkg/x/m.ts", "pkg/src/u.tsx", "resolved"),
    ("~/dir", "pkg/m.ts", "pkg/src/dir/index.mjs", "resolved"),
    ("~/f.service", "pkg/m.ts", "pkg/src/f.ts", "resolved"),
    ("~/f.service.ts", "pkg/m.ts", "pkg/src/f.service.ts", "resolved"),
    ("@one", "bad/m.ts", None, "not_found"),
    ("@one", "nul/m.ts", None, "not_found"),
]
LEFT = [("@types/node", "src/m.ts"), ("@mui", "src/m.ts"), ("plain", "src/m.ts"), (None, "src/m.ts")]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(CONFIGS, "path string, content string"), spark.createDataFrame([(f,) for f in FILES + FILES[:3]], "path string")


def test_targets(spark, tables):
    asked = [r[:2] for r in IMPORTS] + LEFT + [IMPORTS[0][:2]]
    got = aliases.alias_targets(spark.createDataFrame(asked, "module string, uri string"), *tables).collect()
    assert sorted(map(tuple, got), key=str) == sorted(IMPORTS, key=str)
    none = aliases.alias_targets(spark.createDataFrame(asked, "module string, uri string"), tables[0].limit(0), tables[1])
    assert {r.reason for r in none.collect()} == {"no_config"}
    assert aliases.alias_targets(spark.createDataFrame([], "module string, uri string"), *tables).count() == 0


def test_modules_become_files(spark, tables):
    nodes = [(1, "file", "m", "file::src/m.ts", "src/m.ts"), (2, "module", "@one", "module::@one", None), (3, "module", "@a/b/c", "module::@a/b/c", None), (4, "module", "os", "module::os", None), (5, "file", "c", "file::src/b/c.js", "src/b/c.js"), (6, "file", "late", "file::bad/m.ts", "bad/m.ts")]
    g = Graph(spark.createDataFrame([(*n, 1, 5, 4, False, None, None, None) for n in nodes], schemas.NODES), spark.createDataFrame([(i, a, b, "imports", "extracted", 1.0) for i, (a, b) in enumerate([(1, 2), (6, 2), (1, 3), (1, 4)])], schemas.EDGES))
    out = aliases.resolve_aliases(g, *tables)
    assert {(r.qualified_name, r.name) for r in out.nodes.collect()} == {("file::src/m.ts", "m"), ("file::src/one.ts", "one"), ("module::os", "os"), ("file::src/b/c.js", "c"), ("file::bad/m.ts", "late")}
    assert {(r.src, r.dst) for r in out.edges.collect()} == {(1, 2), (6, 2), (1, 5), (1, 4)}
