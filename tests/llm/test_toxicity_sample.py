"""What learning brings to the driver is bounded, whatever the length of a text."""

from pyspark.sql import functions as F

from tessera.llm import toxicity


def test_long_texts_are_sampled_evenly(spark):
    d = spark.createDataFrame([("short",), ("".join(chr(97 + i * 26 // 100_000) for i in range(100_000)),), ("",), (None,)], "text string")
    got = [r.t for r in d.select(toxicity._sampled(F.col("text"), 6400).alias("t")).collect()]
    assert got[0] == "short" and got[2:] == ["", ""]
    parts = got[1].split(" ")
    assert [len(p) for p in parts] == [100] * 64 and parts[0][0] == "a" and parts[-1][-1] == "z" and set("".join(parts)) == {chr(97 + i) for i in range(26)}


def test_learning_from_long_texts(spark):
    rows = [(i, ("plain words here " * 9000) if i % 2 else ("awful nasty slur " * 9000)) for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2 ^ 1) for i in range(24)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, sample_chars=2048)
    got = {r.doc_id: r.predicted for r in toxicity.toxicity_scores(docs, model).collect()}
    assert all(got[i] == (i % 2 ^ 1) for i in range(24))
