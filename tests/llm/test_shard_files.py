"""Shards written as files: every document once, whatever its id and its columns are called."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import sharding

SCHEMA = "key long, text string, source string, lang string, n_chars long, slot string, Position int, _row string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, f"s{i % 3}", "en", i, f"mine{i}", i, "r") for i, (k, t) in enumerate([(1, "a"), (1, "b"), (1, "b"), (None, "c"), (None, "c"), (None, None), (2, "é漢"), (3, ""), (4, "long " * 5000), (5, "x")] * 4)]
    return spark.createDataFrame(rows, SCHEMA)


def test_every_document_is_written_once(spark, docs, tmp_path):
    path = str(tmp_path / "shards")
    sharding.write_shards(docs, path, n_shards=6, id_col="key", rows_per_file=3, rows_per_bucket=4)
    back = spark.read.parquet(path)
    assert sorted(back.columns) == sorted(["key", "text", "source", "lang", "n_chars", "slot_in", "Position_in", "_row_in", "slot", "shard"])
    whole = lambda df, slot, pos, row: Counter(map(tuple, df.select("key", "text", "source", "n_chars", slot, pos, row).collect()))
    assert whole(back, "slot_in", "Position_in", "_row_in") == whole(docs, "slot", "Position", "_row")
    sizes = Counter()
    for r in back.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("slot")).alias("slots")).collect():
        assert r.slots == list(range(r.n))
        sizes[r.n] += r.n
    assert sum(sizes.values()) == 40 and max(sizes) - min(sizes) <= 1


def test_clashing_id_and_dimensions(spark, docs, tmp_path):
    path = str(tmp_path / "shards")
    sharding.write_shards(docs.withColumn("shard", F.col("key")).drop("key"), path, n_shards=3, id_col="shard", dimensions=("Position", "n_chars"))
    back = spark.read.parquet(path)
    assert back.count() == 40 and set(r.shard for r in back.select("shard").distinct().collect()) == {0, 1, 2}
    assert back.filter("shard_in IS NULL").count() == 12


def test_an_empty_table_writes_nothing(docs, tmp_path):
    sharding.write_shards(docs.limit(0), str(tmp_path / "none"), id_col="key")
    assert not list((tmp_path / "none").glob("shard=*"))
