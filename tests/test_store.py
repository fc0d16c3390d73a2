"""The delta store against full saves: what a change writes, what readers see, resolution that follows changes."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import resolution
from tessera.sources import code, delta, store
from tessera.sources.adapters import Graph
from tessera.streaming import watch


def source(rng, names):
    lines = []
    for n in rng.sample(names, rng.randint(1, 4)):
        lines.append(f"def {n}():\n" + "".join(f"    {rng.choice(names)}()\n" for _ in range(rng.randint(1, 4))))
    if rng.random() < 0.5:
        lines.append(f"class {rng.choice('ABC')}({rng.choice('ABCDE')}):\n    def {rng.choice(names)}(self):\n        return {rng.choice(names)}()\n")
    return "import os\n\n" + "\n".join(lines)


def rebuilt(spark, files):
    g = code.code_graph(spark.createDataFrame(sorted(files.items()), "path string, content string"))
    calls, types = resolution.resolve_calls(g), resolution.resolve_types(g)
    g2 = resolution.apply_resolution(g, calls.select("edge_id", "target", "conf_class"), "call::")
    return resolution.apply_resolution(g2, types.select("edge_id", "target", "conf_class"), "type::")


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def test_a_refreshed_graph_equals_a_rebuilt_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(delta, "PIECES", 4)
    rng = random.Random(2)
    names = [f"n{i}" for i in range(14)]
    files = {f"{d}/f{i}.py": source(rng, names) for d in ("a", "b", "c/d") for i in range(6)}
    frame = lambda f: spark.createDataFrame([(p, t) for p, t in sorted(f.items())], "path string, content string").withColumn("hash", F.sha2("content", 256))
    s = store.Store(spark, str(tmp_path / "store"), resolve=True)
    s.save(code.code_graph(frame(files)), frame(files))
    want = rebuilt(spark, files)
    assert rows(s.load().edges) == rows(want.edges) and rows(s.load().nodes) == rows(want.nodes)
    for turn in range(3):
        changes = []
        for p in rng.sample(sorted(files), 3):
            if turn and rng.random() < 0.4:
                changes.append((p, None, True, turn))
                del files[p]
            else:
                files[p] = source(rng, names)
                changes += [(p, "old", False, turn - 1), (p, files[p], False, turn)]
        files[f"new/{turn}.py"] = source(rng, names)
        changes.append((f"new/{turn}.py", files[f"new/{turn}.py"], False, turn))
        watch.apply_batch(s, spark.createDataFrame(changes, watch.CHANGES))
        want, got = rebuilt(spark, files), s.load()
        assert rows(got.edges) == rows(want.edges), turn
        assert rows(got.nodes) == rows(want.nodes), turn
        assert rows(s.file_state()) == rows(frame(files).select("path", "hash"))
    assert watch.apply_batch(s, spark.createDataFrame(changes, watch.CHANGES)) == s.version() == 4  # the same again changes nothing


@pytest.fixture
def tables(spark, tmp_path):
    t = delta.DeltaTables(spark, str(tmp_path / "t"), {"x": "key"})
    t.commit(t.stage("x", spark.range(1000).select("id", (F.col("id") % 50).cast("string").alias("key"), F.lit(0).alias("v")), 1, base=True))
    return t


def test_a_change_writes_what_it_changes(spark, tables):
    t = tables
    for k in range(2, 6):
        new = spark.range(k * 10, k * 10 + 5).select("id", F.lit("k").alias("key"), F.lit(k).alias("v"))
        t.commit(t.pieces() + t.stage_dead("x", spark.range(k * 10, k * 10 + 8), k) + t.stage("x", new, k))
    assert [p.rows for p in t.pieces()] == [1000] + [8, 5] * 4
    live = {r.id: r.v for r in t.read("x").collect()}
    assert len(live) == 1000 - 4 * 3 and live[20] == 2 and 26 not in live and live[51] == 5
    assert t.read("x", 1).count() == 1000 and t.read("x", 3).count() == 994
    only = t.read("x", buckets=t.buckets(spark.createDataFrame([("k",)], "key string"), "key"))
    assert {r.id for r in only.filter("key = 'k'").collect()} == {k * 10 + i for k in range(2, 6) for i in range(5)}
    plan = only._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(_bucket" in plan or "PartitionFilters: [_bucket" in plan
    before = {r.id: r.v for r in t.read("x").collect()}
    packed = t.compact(t.pieces(), "x", 6)
    assert sorted(p.part for p in packed) == ["base", "dead", "rows"]
    t.commit(packed)
    assert {r.id: r.v for r in t.read("x").collect()} == before
    big = t.stage("x", spark.range(2000, 2600).select("id", F.lit("z").alias("key"), F.lit(9).alias("v")), 7)
    packed = t.compact(t.pieces() + big, "x", 7)
    assert [p.part for p in packed] == ["base"] and packed[0].rows == 1588
    t.commit(packed)
    assert t.read("x").count() == 1588 and t.read("x", 1).count() == 1000


def test_archived_edges_and_nodes(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    nodes = spark.createDataFrame([(i, "function", q, q, "f.py", None, None) for i, q in enumerate("abc")], "id long, kind string, name string, qualified_name string, source_uri string, valid_from string, valid_to string")
    edges = spark.createDataFrame([(1, 0, 1, "calls", "extracted", 1.0), (2, 1, 2, "calls", "extracted", 1.0)], "id long, src long, dst long, kind string, conf_class string, confidence double")
    s.save(Graph(nodes.filter("id < 2"), edges.filter("id = 1")))
    s.archive(nodes, "c7")
    s.archive_edges(edges, nodes, "c7")
    s.archive_edges(edges, nodes, "c9")
    assert [(r.qualified_name, r.valid_to) for r in s.temporal_nodes().orderBy("qualified_name").collect()] == [("a", None), ("b", None), ("c", "c7")]
    assert [(r.src_qname, r.dst_qname, r.valid_from, r.valid_to) for r in s.temporal_edges().orderBy("src_qname").collect()] == [("a", "b", None, None), ("b", "c", "c9", "c9")]
    s.save_embeddings("m", spark.createDataFrame([("a", [1.0, 2.0])], "qualified_name string, vector array<double>"))
    assert [tuple(r) for r in s.load_embeddings("m").select("qualified_name", "vector").collect()] == [("a", [1.0, 2.0])]


def test_a_read_exchanges_what_was_taken_away_and_not_the_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(delta, "SIEVED", 10)
    t = delta.DeltaTables(spark, str(tmp_path / "t"), {"rows": "key"})
    base = spark.range(3000).select("id", F.concat(F.lit("k"), (F.col("id") % 7).cast("string")).alias("key"))
    t.commit(t.stage("rows", base, 1, base=True))
    gone = spark.range(3000).filter("id % 50 = 3").select("id")
    again = base.filter("id % 100 = 3").withColumn("key", F.lit("new"))
    t.commit(t.pieces() + t.stage_dead("rows", gone, 2) + t.stage("rows", again, 2))
    want = sorted([(i, f"k{i % 7}") for i in range(3000) if i % 50 != 3] + [(i, "new") for i in range(3, 3000, 100)])
    assert sorted(map(tuple, t.read("rows").collect())) == want
    monkeypatch.setattr(delta, "SIEVE", 40)  # most bits set: rows pass for the join, none is lost
    assert sorted(map(tuple, t.read("rows").collect())) == want
    monkeypatch.undo()
    monkeypatch.setattr(delta, "SIEVED", 10)
    dead = t._dead(t.pieces())
    caught = t._caught(t._read(t.pieces()[0]), dead, 16 * 60)
    assert 60 <= caught.filter("_caught").count() < 600
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = caught._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
