"""Changes that settle: one update a path after the quiet time, and the same store after a restart."""

import time

from pyspark.sql import functions as F

from tessera.sources import code, store
from tessera.streaming import settle
from tessera.streaming.watch import CHANGES

FIRST = {"a.py": "def a():\n    b()\n", "b.py": "def b():\n    pass\n"}


def land(spark, path, rows):
    spark.createDataFrame(rows, CHANGES).coalesce(1).write.mode("append").parquet(path)


def wait(query, done, seconds=240):
    end = time.time() + seconds
    while not done() and time.time() < end:
        assert query.exception() is None, query.exception()
        time.sleep(0.5)
    assert done()


def test_changes_settle_and_a_restart_goes_on(spark, tmp_path, monkeypatch):
    files = spark.createDataFrame(list(FIRST.items()), "path string, content string").withColumn("hash", F.sha2("content", 256))
    s = store.Store(spark, str(tmp_path / "store"), resolve=True)
    s.save(code.code_graph(files), files)
    landing, check = str(tmp_path / "landing"), str(tmp_path / "check")
    batches, plain = [], settle.apply_batch
    monkeypatch.setattr(settle, "apply_batch", lambda st, b: batches.append(sorted((r.path, r.deleted, r.at) for r in b.collect())) or plain(st, b))
    names = lambda: {r.qualified_name for r in s.load().nodes.collect()}

    land(spark, landing, [("a.py", "def half(", False, 1), ("a.py", "def a2():\n    b()\n", False, 2), (None, "x", False, 1), ("c.py", "def c():\n    b()\n", False, 2)])
    query = settle.watch_settled(spark, s, landing, check, quiet_ms=20_000)
    wait(query, lambda: query.lastProgress is not None and query.lastProgress["batchId"] >= 0)
    land(spark, landing, [("a.py", "def a3():\n    b()\n", False, 3), ("a.py", "def a3():\n    b()\n", False, 3)])  # before it was quiet
    wait(query, lambda: s.version() >= 2 and {"a.py::a3", "c.py::c"} <= names())
    query.stop()
    query.awaitTermination()
    passed = [r for b in batches for r in b]
    assert [r for r in passed if r[0] == "a.py"] == [("a.py", False, 3)] and ("c.py", False, 2) in passed
    assert not {"a.py::a2", "a.py::half"} & names()

    version = s.version()
    land(spark, landing, [("a.py", "def a3():\n    b()\n", False, 4), ("b.py", None, True, 4)])  # a.py is what it was
    query = settle.watch_settled(spark, s, landing, check, quiet_ms=1000)
    wait(query, lambda: s.version() > version)
    query.stop()
    query.awaitTermination()
    assert "b.py::b" not in names() and "a.py::a3" in names()
    assert [r for b in batches for r in b if r[0] == "a.py"] == [("a.py", False, 3)]
