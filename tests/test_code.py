"""Extraction, resolution, storage and the change stream on a small source tree."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import cfg
from tessera.operators import resolution
from tessera.sources import code, store
from tessera.streaming import watch

FILES = {
    "pkg/auth.py": "import os\n\nclass Base:\n    pass\n\nclass Service(Base):\n    def run(self, user):\n        name = user\n        return helper(name)\n\ndef helper(x):\n    return x\n\ndef login():\n    return helper(1)\n",
    "pkg/main.py": "from pkg.auth import login\n\ndef main():\n    login()\n    print('x')\n",
    "tests/test_auth.py": "from pkg.auth import login\n\ndef test_login():\n    login()\n",
    "web/app.ts": "import { a } from './b'\nexport class Service {\n  run() {\n    helper()\n  }\n}\nexport function helper(x: number) { return go(x) }\n",
    "native/lib.rs": "use std::io;\npub struct Service;\nimpl Service {\n    pub fn run(&self) { helper() }\n}\nfn helper() {}\n",
    "docs/guide.md": "# Guide\n\nUse `login` here.\n\n## Details\n\nSee `helper`.\n",
}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(list(FILES.items()), "path string, content string").withColumn("hash", F.sha2("content", 256))


@pytest.fixture(scope="module")
def graph(files):
    g = code.code_graph(files)
    return type(g)(g.nodes.cache(), g.edges.cache())


def test_python_rows(graph):
    kinds = {r.qualified_name: r.kind for r in graph.nodes.collect()}
    assert kinds["pkg/auth.py::Service"] == "class" and kinds["pkg/auth.py::Service::run"] == "method"
    assert kinds["pkg/auth.py::login"] == "function" and kinds["module::os"] == "module"
    assert kinds["native/lib.rs::Service"] == "class" and kinds["web/app.ts::helper"] == "function"
    assert kinds["doc::docs/guide.md::Guide::Details"] == "section"
    tests = {r.qualified_name for r in graph.nodes.filter("is_test AND kind = 'function'").collect()}
    assert tests == {"tests/test_auth.py::test_login"}
    flow = graph.edges.filter("kind = 'data_flow'").count()
    assert flow >= 6


def test_calls_and_types_resolve(graph):
    name = {r.id: r.qualified_name for r in graph.nodes.collect()}
    edges = {r.id: r for r in graph.edges.collect()}
    got = {(name[edges[r.edge_id].src], name[r.target]): r.tier for r in resolution.resolve_calls(graph).collect()}
    assert got[("pkg/main.py::main", "pkg/auth.py::login")] == 1
    assert got[("pkg/auth.py::login", "pkg/auth.py::helper")] == 2
    assert not any(t.endswith("print") for _, t in got)
    types = {name[r.target] for r in resolution.resolve_types(graph).collect()}
    assert types == {"pkg/auth.py::Base"}
    solved = resolution.apply_resolution(graph, resolution.resolve_calls(graph).select("edge_id", "target", "conf_class"))
    tested = {(name[r.src], name[r.dst]) for r in resolution.derive_tested_by(solved).collect()}
    assert tested == {("pkg/auth.py::login", "tests/test_auth.py::test_login")}


def test_store_and_stream(spark, files, graph, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/store")
    assert s.save(graph, files) == 1
    s.snapshot("first")
    landing, check = f"{tmp_path}/landing", f"{tmp_path}/check"
    rows = [("pkg/main.py", "def main():\n    pass\n\ndef extra():\n    pass\n", False, 1), ("web/app.ts", None, True, 1), ("pkg/auth.py", FILES["pkg/auth.py"], False, 1)]
    spark.createDataFrame(rows, watch.CHANGES).write.parquet(landing)
    watch.watch(spark, s, landing, check).awaitTermination()
    assert s.version() == 2
    names = {r.qualified_name for r in s.load().nodes.collect()}
    assert "pkg/main.py::extra" in names and not any(n.startswith("web/app.ts::") for n in names)
    before = {r.qualified_name for r in s.load_snapshot("first").nodes.collect()}
    assert "web/app.ts::helper" in before and "pkg/main.py::extra" not in before
    lines = store.graphml_rows(s.load()).filter("part IN (0, 3)").count()
    assert lines == 2 and store.cypher_rows(s.load()).count() > 0


def test_control_flow():
    text = "def f(a):\n    x = a\n    if x:\n        return 1\n    while x:\n        x = x - 1\n    return x\n"
    blocks = cfg.build(text)
    assert [b["kind"] for b in blocks][0] == "entry" and {"branch", "loop", "return", "assign"} <= {b["kind"] for b in blocks}
    assert cfg.reachable(blocks) == {b["id"] for b in blocks}
    chains = cfg.def_use(blocks)
    assert chains["x"]["defined"] == 2 and 3 in chains["x"]["used"]
    assert cfg.critical_path(blocks)[0] == 0
    assert 0 in cfg.post_dominators(blocks)


def test_one_small_table_of_files_is_parsed_by_many_tasks(spark):
    files = spark.range(400).selectExpr("concat('p', id, '.py') AS path", r"concat('def f', id, '(a):\n    return a\n') AS content").coalesce(1)
    rows = code.extract_rows(files).filter("row = 'node' AND kind = 'function'").selectExpr("name", "spark_partition_id() AS part")
    seen = {r["name"]: r["part"] for r in rows.collect()}
    assert set(seen) == {f"f{i}" for i in range(400)}
    assert len(set(seen.values())) > 4
