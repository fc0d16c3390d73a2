"""Stages of the corpus pipeline on rows with null and repeated ids."""

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import language, quality, simhash
from tessera.llm.queries import ranks_path
from tessera.llm.tokens import encode_batch
from tessera.runtime import materialise, read_table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
A, B, C, D = (" ".join(f"{w}{i * i % 97}" for i in range(60)) for w in ("alpha", "beta", "gamma", "delta"))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None, A), (None, A), (None, A), (5, B), (5, B), (7, C), (3, C), (3, D), (9, None), (None, "")]
    return spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("stage", [corpus_pipeline.drop_exact_copies, corpus_pipeline.drop_near_copies])
@pytest.mark.parametrize("written", [True, False])
def test_one_row_of_each_group_stays(spark, docs, stage, written):
    out = stage(spark, materialise(docs, "test") if written else docs, "")
    assert out.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in out.collect())
    assert got == Counter([(None, A), (5, B), (3, C), (3, D), (9, None)])


def test_a_language_of_long_texts_is_learned(spark):
    rows = [(0, "the cat sat on the mat and saw the dog " * 20, "en"), (1, "zwölf große boxkämpfer jagen viktor quer über den deich " * 1200, "de")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert set(language.train(d).languages) == {"en", "de"}


def poisson(mean: float, u: float) -> int:
    k, term, below = 0, math.exp(-mean), math.exp(-mean)
    while u >= below:
        k += 1
        term *= mean / k
        below += term
    return k


def test_every_stage_against_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = read_table(spark, sf_dir, "documents").withColumn("rate", F.lit("x")).withColumn("n_copies", F.lit("y")).withColumn("score", F.lit("z"))
    columns, out = docs.columns, docs
    kept = [docs.toPandas()]
    for name, stage in corpus_pipeline.STAGES:
        out = materialise(stage(spark, out, sf_dir), name)
        kept.append(out.toPandas())
    start, good, exact, near, mixed, packed = kept
    assert all(list(k.columns) == columns for k in kept[:5])

    model = quality.train(docs, read_table(spark, sf_dir, "labels"), train_on=F.crc32(F.col("doc_id").cast("string")) % 5 != 0, threshold=0.3)
    score = model.score(quality.counts(pa.array(start["text"].tolist(), pa.string())))
    assert sorted(good["doc_id"]) == sorted(start["doc_id"][score >= 0.3])

    groups = {}
    for i, t in zip(good["doc_id"], good["text"]):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    assert sorted(exact["doc_id"]) == sorted(min(g)[1] for g in groups.values())

    prints = simhash.fingerprints(pa.array(exact["text"].tolist(), pa.string())).tolist()
    ids, up = exact["doc_id"].tolist(), {}
    for a in range(len(ids)):
        up[a] = a
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= 4:
                x, y = up[a], up[b]
                up = {k: (y if v == x else v) for k, v in up.items()}
    parts = {}
    for k, v in up.items():
        parts.setdefault(v, []).append(ids[k])
    assert sorted(near["doc_id"]) == sorted(min(p) for p in parts.values())

    size = near.groupby("source", dropna=False).size()
    raw = {s: math.sqrt(n) for s, n in size.items()}
    want = Counter()
    for i, s in zip(near["doc_id"], near["source"]):
        mean = raw[s] / sum(raw.values()) * len(near) / size[s]
        u = int(hashlib.md5(f"3:{i}:0".encode()).hexdigest()[:13], 16) / 2**52
        want[i] = poisson(mean, u)
    assert Counter(mixed["doc_id"]) == +want

    tokens = {i: len(x) + 1 for i, x in zip(mixed["doc_id"], encode_batch(pa.array(mixed["text"].tolist(), pa.string()), ranks_path()))}
    placed = packed.groupby("doc_id")["length"].sum()
    assert {i: placed[i] for i in tokens} == {i: n * want[i] for i, n in tokens.items()}
    assert packed.groupby("sequence_id")["length"].sum().max() <= 2048


def test_stages_take_an_empty_table(spark):
    empty = read_table(spark, "/root/testdata/sf0.001", "documents").filter("false")
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, materialise(empty, name), "/root/testdata/sf0.001").count() == 0
