"""Removal of repeated passages against a dictionary of all strings of 400 bytes."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tessera.llm import suffix_index as S

SCHEMA = "doc_id long, text string, spans int, key string"


def expected(texts):
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + S.LENGTH] for b in raw for i in range(len(b) - S.LENGTH + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - S.LENGTH + 1):
            if count[b[i : i + S.LENGTH]] > 1:
                gone[i : i + S.LENGTH] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((len(b), int(gone.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest()))
    return out


def texts():
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdeéfghij漢") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    fresh = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [fresh(rng.randint(60, 400)) for _ in range(6)]
    edge = [fresh(200).encode()[:n].decode(errors="ignore") for n in (399, 400, 401, 420)]
    out = [None, "", "short", "x" * 399, "y" * 400, "z" * 401, "ab" * 900, "periodic words here, " * 60]
    for _ in range(60):
        body = [fresh(rng.randint(0, 150))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages + edge)
            a = rng.randint(0, len(p) // 3)
            body += [p[a : len(p) - rng.randint(0, len(p) // 3)] if rng.random() < 0.6 else p, fresh(rng.randint(0, 80))]
        out.append(rng.choice(["", " "]).join(body))
    near = fresh(900).split()
    for k in range(45):  # near copies: one word differs
        said = list(near)
        said[rng.randrange(len(said))] = f"w{k}"
        out.append(" ".join(said))
    return out + [out[20]] * 3 + [out[30]] + ["é" * 300 + e + "漢" * 50 for e in edge]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i % 11 else None, t, 1, "k") for i, t in enumerate(texts())]
    return spark.createDataFrame(rows + rows[40:42], SCHEMA)


@pytest.mark.parametrize(("batches", "hot"), [(4, 4096), (3, 4), (1, 4096)])
def test_removal_matches_all_strings(docs, batches, hot):
    rows = docs.collect()
    want = sorted(zip([str(r.doc_id) for r in rows], expected([r.text for r in rows])))
    out = S.remove_repeats(docs, batches=batches, hot=hot)
    assert out.columns == ["doc_id", "text", "spans_in", "key", "kept", "n_bytes", "n_removed", "spans"]
    got = sorted((str(r.doc_id), (r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest())) for r in out.collect())
    assert got == want


def test_long_texts_are_sliced(spark, monkeypatch):
    monkeypatch.setattr(S, "_SLICE", 1000)
    data = np.frombuffer(texts()[70].encode() * 2, np.uint8)
    cut = [(low + place, low + first, low + last) for low, piece, cuts in S._sliced(data, np.array([0, len(data)])) for _, place, first, last, _ in zip(*S.chosen_suffixes(piece, cuts))]
    _, place, first, last, _ = S.chosen_suffixes(data, np.array([0, len(data)]))
    every = lambda rows: {(s, p) for p, a, b in rows for s in range(a, b + 1)}
    assert every(cut) == every(zip(place, first, last)) and len(every(cut)) == len(data) - S.LENGTH + 1


def test_family_merges_equal_levels(spark):
    family = S.IndexFamily()
    for b in range(7):
        family.add(spark.createDataFrame([(g, g * 10 + (b if g == 1 else 0)) for g in range(b % 3 + 1)], "gram long, context long"))
    assert sorted(family.levels) == [0, 1, 2]
    assert {tuple(r) for r in family.long_matches().collect()} == {(0, 0), (2, 20)}
    assert [(r.gram, r.open) for r in family.shared_beginnings().collect()] == [(1, True)]
    assert sorted(map(sorted, (b for b, _ in family.scans))) == [[0, 1, 2, 3, 4, 5], [0, 1, 2, 3, 6], [4, 5, 6]]


def test_many_contexts_agree_with_pairs():
    rng = random.Random(1)
    base = bytes(rng.randrange(97, 101) for _ in range(900))
    contexts = []
    for _ in range(40):
        far, near = rng.randint(100, 336), rng.randint(0, 99)
        b = bytearray(base[400 - far : 800 - near])
        b[rng.randrange(len(b))] = 65
        contexts.append((bytes(b), near, far))
    whole = S.repeated_strings(contexts)
    strings = Counter(x[i : i + 400] for x, near, far in contexts for i in range(far - near + 1))
    assert all(list(h) == [strings[x[i : i + 400]] > 1 for i in range(far - near + 1)] for h, (x, near, far) in zip(whole, contexts))
    few = contexts[:12]
    strings = Counter(x[i : i + 400] for x, near, far in few for i in range(far - near + 1))
    assert all(list(h) == [strings[x[i : i + 400]] > 1 for i in range(far - near + 1)] for h, (x, near, far) in zip(S.repeated_strings(few), few))


def test_empty_table(docs):
    assert S.removed_digests(docs.limit(0)).count() == 0
    short = S.removed_digests(docs.filter("text = 'short'")).collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans) for r in short] == [(5, 0, 0)]
