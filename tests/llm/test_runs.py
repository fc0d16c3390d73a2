"""Periodic runs against a search over all periods."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tessera.llm import runs as R


def brute(said):
    out = {}
    n = len(said)
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and said[j] == said[j + p]:
                j += 1
            if j + p - i >= max(24, 3 * p):
                out.setdefault((i, j + p), p)
            i = j + 1
    return sorted((a, b - a, p) for (a, b), p in out.items())


def collapsed(said, found):
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(said) if i not in gone)


def texts():
    rng = random.Random(3)
    out = ["", " \t\n", "a", "a " * 23, "a " * 24, "a b " * 12, "a b c " * 700, "x " * 5000]
    for _ in range(120):
        said = []
        while len(said) < rng.randint(20, 600):
            unit = [rng.choice("abcdefgh"[: rng.randint(1, 8)]) for _ in range(rng.randint(1, 60))]
            said += unit * rng.choice([1, 1, 2, 3, 4, 9]) + unit[: rng.randint(0, len(unit))] * rng.randint(0, 1)
        out.append(rng.choice([" ", "\n", " \t "]).join(said))
    sentence = "the same sentence comes again and again in this text but not back to back"
    out.append(" ".join(f"{sentence} {i}" for i in range(200)))
    out.append(" ".join(f"{sentence} {i % 2}" for i in range(200)))
    return out


def test_find_runs_matches_all_periods():
    all_texts = texts()
    said = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in all_texts]
    first = np.cumsum([0, *map(len, said)])
    ids = np.unique(np.array([w for ws in said for w in ws]), return_inverse=True)[1]
    assert R.find_runs(ids, first) == [brute(ws) for ws in said]


def test_shifts_in_blocks(monkeypatch):
    said = [("a b c d e f g h i j k l m " * 40 + "x y z " * 30 + "q " * 50).split(), ("u v " * 40).split()]
    first = np.cumsum([0, *map(len, said)])
    ids = np.unique(np.array([w for ws in said for w in ws]), return_inverse=True)[1]
    whole = R.find_runs(ids, first)
    monkeypatch.setattr(R, "_SHIFTS", 7)
    assert R.find_runs(ids, first) == whole == [brute(ws) for ws in said]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "s", 1, 2) for i, t in enumerate(texts())] + [(None, "z " * 30, "s", 1, 2), (3, None, "s", 1, 2), (3, "é 漢字 " * 20, "s", 1, 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, runs int, best int")


def test_query_matches_brute_force(docs):
    found = R.run_digests(docs).collect()
    want = []
    for doc_id, text, *_ in docs.collect():
        said = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
        if h is not None and h % 10 == 0 and said:
            g, n = h // 10, len(said)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            said = [w if i < a else said[a + (i - a) % p] for i, w in enumerate(said)]
        runs = brute(said)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(collapsed(said, runs))))
    key = lambda r: (r[0] is not None, *map(str, r))
    assert sorted(map(tuple, found), key=key) == sorted(want, key=key)


def test_operator_keeps_columns(docs):
    out = R.periodic_runs(docs)
    assert out.columns == ["doc_id", "text", "source", "runs_in", "best_in", "n_words", "runs", "best", "collapsed"]
    row = next(r for r in out.collect() if r.doc_id is None)
    assert (row.n_words, row.collapsed, row.best.period, row.runs_in) == (30, "z", 1, 1)
    assert R.periodic_runs(docs.limit(0)).count() == 0
