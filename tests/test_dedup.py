"""Label deduplication against all pairs of labels."""

import random

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import dedup


def labels():
    rng = random.Random(12)
    words = ["graph", "engine", "service", "payment", "invoice", "customer", "handler", "parser", "index", "query"]
    out = [" ".join(rng.sample(words, 3)) for _ in range(60)]
    for label in out[:30]:
        i = rng.randrange(len(label))
        out.append(label[:i] + rng.choice("xyz") + label[i + 1 :])
    return [(i, t) for i, t in enumerate(out + out[:5] + ["", "a", None, "aaaaaaa"])]


def shingles(label):
    return {label[i : i + 3] for i in range(max(1, len(label) - 2))}


def test_pairs_against_all_pairs(spark):
    rows = labels()
    sign = {i: dedup.minhash_signature(t or "") for i, t in rows}
    got = {(r.a, r.b): r.similarity for r in dedup.candidate_pairs(dedup.signatures(spark.createDataFrame(rows, "id long, label string"), "id", "label")).collect()}
    first = {}
    for i, _ in rows:
        first.setdefault(tuple(sign[i]), i)
    want = {(first[tuple(sign[i])], i): 1.0 for i, _ in rows if first[tuple(sign[i])] != i}
    kept = sorted(first.values())
    for a in kept:
        for b in kept:
            same = sum(x == y for x, y in zip(sign[a], sign[b])) / 64
            if a < b and same >= 0.7 and any(sign[a][k * 5 : k * 5 + 5] == sign[b][k * 5 : k * 5 + 5] for k in range(12)):
                want[a, b] = round(same, 6)
    assert got == want


def test_signatures_estimate_jaccard():
    rows = [t or "" for _, t in labels()][:90]
    errors = []
    for i, a in enumerate(rows):
        for b in rows[:i]:
            x, y = shingles(a), shingles(b)
            same = sum(p == q for p, q in zip(dedup.minhash_signature(a), dedup.minhash_signature(b))) / 64
            errors.append(abs(same - len(x & y) / len(x | y)))
    assert sum(errors) / len(errors) < 0.05


def test_components_of_close_labels(spark):
    rows = labels()
    nodes = spark.createDataFrame(rows, "id long, name string")
    norm = {r.id: r.n for r in nodes.filter(T.passes_entropy(T.normalize_label(F.col("name")))).select("id", T.normalize_label(F.col("name")).alias("n")).collect()}
    text = dict(rows)
    sign = {i: dedup.minhash_signature(text[i]) for i in norm}
    root = {i: i for i in norm}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sorted(norm):
        for b in sorted(norm):
            same = sum(x == y for x, y in zip(sign[a], sign[b])) / 64
            shares = any(sign[a][k * 5 : k * 5 + 5] == sign[b][k * 5 : k * 5 + 5] for k in range(12))
            if a < b and shares and same >= 0.7 and dedup.jaro_winkler_value(norm[a], norm[b]) >= 0.92:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.id: r.keep_id for r in dedup.deduplicate(nodes).collect()}
    assert got == {i: find(i) for i in norm}
    assert len(set(got.values())) < len(got)


def test_labels_of_equal_signature_link_among_themselves(spark):
    names = ["abc" * 2, "abc" * 6, "abc" * 7, "quite another label"]  # the first three hold the same runs of three
    assert len({tuple(dedup.minhash_signature(t)) for t in names}) == 2
    got = {r.id: r.keep_id for r in dedup.deduplicate(spark.createDataFrame(list(enumerate(names)), "id long, name string")).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 3}


def test_large_bands_with_and_without_rounds(spark, monkeypatch):
    names = [f"Supplier#{i:09d}" for i in range(0, 3_000, 7)] + [f"Vendor of parts#{i:09d}" for i in range(0, 900, 7)]
    nodes = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    got = {r.id: r.keep_id for r in dedup.deduplicate(nodes).collect()}
    monkeypatch.setattr(dedup, "_AGREE", ())
    monkeypatch.setattr(dedup, "_PART", 50)
    assert got == {r.id: r.keep_id for r in dedup.deduplicate(nodes).collect()}
    sign = [dedup.minhash_signature(t) for t in names]
    root = list(range(len(names)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for b in range(len(names)):
        for a in range(b):
            if names[a][0] == names[b][0] and sum(x == y for x, y in zip(sign[a], sign[b])) >= 45 and any(sign[a][k * 5 : k * 5 + 5] == sign[b][k * 5 : k * 5 + 5] for k in range(12)):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert got == {i: find(i) for i in range(len(names))}
