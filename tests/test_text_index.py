"""The stored text index against plain counting."""

import math
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.sources import text_index as X

SCHEMA = "doc_id long, text string, lang string"
TEXTS = [(1, "The quick brown fox", "a"), (2, "quick quick brown dog", "b"), (3, None, "a"), (4, "", "b"), (5, "a fox, a dog; a fox", "a"), (5, "the fox again", "b"), (None, "brown bread", "a"), (7, "Quickly the brown-fox É漢字", "b")]


def tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(rows, tests):
    """Every hit with its score; a test maps tokens to a number of hits."""
    docs = [(i, tokens(t)) for i, t, *_ in rows]
    mean = sum(len(w) for _, w in docs) / len(docs)
    tf = [[t(w) for t in tests] for _, w in docs]
    df = [sum(f[i] > 0 for f in tf) for i in range(len(tests))]
    out = []
    for (i, w), fs in zip(docs, tf):
        if all(fs):
            out.append((i, sum(math.log(1 + (len(docs) - d + 0.5) / (d + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(w) / mean)) for f, d in zip(fs, df))))
    return sorted(out, key=lambda r: (-round(r[1], 6), r[0] is not None, r[0] or 0))


def is_(t):
    return lambda w: w.count(t)


def begins(t):
    return lambda w: sum(x.startswith(t) for x in w)


def row_of(*said):
    return lambda w: sum(tuple(w[i : i + len(said)]) == said for i in range(len(w)))


QUERIES = [(X.words("fox"), [is_("fox")]), (X.prefixes("quick brow"), [begins("quick"), begins("brow")]), (X.phrase("brown fox"), [row_of("brown", "fox")]), (X.phrase("quick") + X.prefixes("dog"), [is_("quick"), begins("dog")]), (X.words("nothing"), [is_("nothing")])]


def same(found, want):
    found = [(r.id, r.score) for r in found.collect()]
    assert [i for i, _ in found] == [i for i, _ in want]
    assert all(abs(a - b) < 2e-6 for (_, a), (_, b) in zip(found, want))


@pytest.fixture
def index(spark, tmp_path):
    x = X.TextIndex(spark, str(tmp_path / "index"))
    x.add(spark.createDataFrame(TEXTS, SCHEMA))
    return x


@pytest.mark.parametrize(("terms", "tests"), QUERIES)
def test_search_counts_and_pages(index, terms, tests):
    want = brute(TEXTS, tests)
    same(index.search(terms, limit=None), want)
    same(index.search(terms, limit=1), want[:1])
    same(index.search(terms, limit=2, offset=1), want[1:3])
    assert index.count(terms) == len(want)


def test_snippets(index):
    rows = {r.id: r.snippet for r in index.search(X.phrase("fox"), snippets=True).collect()}
    assert rows[1] == "...quick brown [fox]" or rows[1] == "...[fox]" or "[fox]" in rows[1]
    assert rows[5] in ("a [fox] a dog a [fox]", "the [fox] again")


def test_changes_and_merges(spark, tmp_path):
    index, rows = X.TextIndex(spark, str(tmp_path / "index")), []
    frame = lambda r: spark.createDataFrame(r, SCHEMA)
    assert index.search(X.words("fox")).count() == 0 and index.count(X.words("fox")) == 0
    for k in range(3):
        new = [(i + 10 * k if i is not None else None, t, g) for i, t, g in TEXTS]
        index.add(frame(new))
        rows += new
    index.remove(frame([(1, "", ""), (15, "", ""), (99, "", "")]))
    rows = [r for r in rows if r[0] not in (1, 15)]
    news = [(2, "fox fox fox", "c"), (12, "no more", "c"), (500, "brown fox", "c")]
    assert len(index._pieces()) == 4
    old = index.version()
    index.replace(frame(news))  # the fourth segment of its size: all are merged
    rows = [r for r in rows if r[0] not in (2, 12, 500)] + news
    assert sum(bool(p[0]) for p in index._pieces()) < 4
    for terms, tests in QUERIES:
        same(index.search(terms, limit=None), brute(rows, tests))
        same(index.search(terms, limit=2), brute(rows, tests)[:2])
    index.remove(frame([(500, "", "")]))
    index.merge()
    rows = [r for r in rows if r[0] != 500]
    assert [bool(p[0]) for p in index._pieces()] == [True]
    for terms, tests in QUERIES:
        same(index.search(terms, limit=None), brute(rows, tests))
    assert len(index._pieces(old)) == 4  # a reader of the earlier version still finds it


def test_ranges_out_of_reach_are_not_opened(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "SLOT_BITS", 2)
    index = X.TextIndex(spark, str(tmp_path / "index"))
    docs = spark.range(0, 400, 1, 4).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 97 == 5, F.repeat(F.lit("rare "), 5)).otherwise(F.concat(F.lit("rare "), F.repeat(F.lit("filler "), 30))).alias("text"))
    index.add(docs)
    terms = X.words("rare")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    same(index.search(terms, limit=3), brute(rows, [is_("rare")])[:3])
    opened = []
    plain = X.TextIndex._within_reach
    monkeypatch.setattr(X.TextIndex, "_within_reach", lambda *a: opened.append(plain(*a)) or opened[0])
    index.search(terms, limit=3).collect()
    assert opened[0].select("range").distinct().count() < 10
    plan = opened[0]._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(token), EqualTo(token,rare)]" in plan or "EqualTo(token,rare)" in plan


def test_blocks_are_made_in_pieces(monkeypatch):
    monkeypatch.setattr(X, "CHUNK", 10)
    rows = [(r, d, (f"w{d % 3} w{d % 5} end " * (1 + d % 4)).split()) for r in (4, 7) for d in range(20)]
    batch = pa.RecordBatch.from_pylist([{"range": r, "slot": d, "tokens": w} for r, d, w in rows], pa.schema([("range", pa.int64()), ("slot", pa.int32()), ("tokens", pa.list_(pa.string()))]))
    made = list(X._to_blocks(iter([batch, batch.slice(0, 0)])))
    assert len(made) > 2 and all(sum(len(d["positions"]) for d in x["docs"]) <= 10 + 12 for b in made for x in b.to_pylist())
    got = sorted((x["range"], d["slot"], p, x["token"]) for b in made for x in b.to_pylist() for d in x["docs"] for p in d["positions"])
    assert got == sorted((r, d, p, t) for r, d, w in rows for p, t in enumerate(w))
    assert all(sum(len(d["positions"]) for x in b.to_pylist() for d in x["docs"]) <= 10 + 12 and len({x["range"] for x in b.to_pylist()}) == 1 for b in made)


def test_search_over_ranges_in_pieces(spark, monkeypatch, tmp_path):
    rows = [(i, " ".join(["fox"] * (1 + i % 7) + ["dog"] * (i % 3) + [f"w{i % 11}"]), "a") for i in range(300)]
    monkeypatch.setattr(X, "CHUNK", 25)
    index = X.TextIndex(spark, str(tmp_path / "index"))
    batches = list(X._chunks(iter([pa.RecordBatch.from_pylist([{"range": 0, "slot": i, "tokens": t.split()} for i, t, _ in rows])])))
    assert len(batches) > 20
    index.add(spark.createDataFrame(rows, SCHEMA))
    got = [(r.id, r.score) for r in index.search(X.words("fox dog"), limit=40).collect()]
    want = brute(rows, [is_("fox"), is_("dog")])[:40]
    assert [i for i, _ in got] == [i for i, _ in want] and all(abs(a - b) < 1e-5 for (_, a), (_, b) in zip(got, want))
