"""Conversation repair against a search for the cheapest edits, one conversation at a time."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from tessera.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string, at long, blocks string, audit string"
NEXT = {("e", "s"): "s", ("e", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
NAME = {"u": "user", "a": "assistant"}


def damaged(rows):
    out = []
    for conv, turn, role, text, *_ in rows:
        role, text = (" " if v is None else v for v in (role, text))
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code == 0:
            continue
        row = (turn, "user" if code == 4 else role, "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text)
        out += [row] * (2 if code == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))


def cheapest(rows):
    """gaps, blank, duplicate, truncated, illegal, cost, audit, lines: shortest path over (rows done, state)."""
    seen, kinds = set(), []
    for _, role, text in rows:
        shown = re.findall(r"[^\x20\x09-\x0D]", text)
        kinds.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    heap, done = [(0, "", 0, "e", ())], set()
    while heap:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if i == len(rows) and state in "ea":
            return gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, lines
        if (i, state) in done:
            continue
        done.add((i, state))
        for r in "ua":
            if (state, r) in NEXT:
                heapq.heappush(heap, (cost + 2, audit + "I", i, NEXT[state, r], (*lines, f"{NAME[r]}:")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, lines))
            if kinds[i] in ("", "truncated"):
                more = kinds[i] == "truncated"
                if (state, role[:1]) in NEXT:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, NEXT[state, role[:1]], (*lines, f"{role}:{text}")))
                for r in "ua":
                    if (state, r) in NEXT:
                        heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, NEXT[state, r], (*lines, f"{NAME[r]}:{text}")))
    raise AssertionError("the empty conversation is always legal")


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        *numbers, lines = cheapest(damaged([r for r in rows if r[0] == conv]))
        out[conv] = (*numbers, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def table():
    rng = random.Random(5)
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 14)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""])
            text = rng.choice(["Well.", "Well", "What now?", "No!  \n", "é 漢字. ", None, "", " \t", f"t{turn}.", f"t{turn}"])
            rows.append((conv, rng.choice([turn, turn, turn, None, 3, turn * 5]), role, text, 1, "b", "x"))
    rows += [(None, 1, "user", "Hi.", 1, "b", "x"), (None, 2, "assistant", "Hello.", 1, "b", "x"), (900, 1, "user", "long " * 50_000, 1, "b", "x")]
    rows += [(901, t, ("user", "assistant")[t % 2], f"Turn {t % 700}.", 1, "b", "x") for t in range(900)]  # one hot conversation
    return rows + [r for r in rows[::7]]


@pytest.mark.parametrize("bits", [10, 1, 3])
def test_repair_matches_a_search(spark, monkeypatch, bits):
    monkeypatch.setattr(C, "BLOCK_BITS", bits)
    rows = table()
    found = C.repaired_digests(spark.createDataFrame(rows, SCHEMA)).collect()
    want = expected(rows)
    assert len(found) == len(want)
    for r in found:
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) == want[r.conv_id], r.conv_id


def test_repaired_turns_are_legal(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "user", "Hi."), (1, 3, "user", "Again?"), (1, 4, "assistant", "Yes."), (2, 0, "tool", "x"), (3, 0, "user", ""), (4, 0, "system", "S.")]
    summary, repaired = C.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    audits = {r.conv_id: (r.cost, r.audit) for r in summary.collect()}
    assert audits == {1: (5, "KKDIKK"), 2: (3, "D"), 3: (3, "D"), 4: (3, "D")}
    lines = [(r.conv_id, r.edit, r.role, r.text) for r in repaired.orderBy("conv_id", "part", "place").collect()]
    assert lines == [(1, "K", "system", "Be kind."), (1, "K", "user", "Hi."), (1, "I", "assistant", ""), (1, "K", "user", "Again?"), (1, "K", "assistant", "Yes.")]


def test_empty_tables_and_dropped_conversations(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert C.repaired_digests(none).count() == 0
    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    (row,) = C.repaired_digests(spark.createDataFrame([(lost, 0, "user", "Hi.", 1, "b", "x")], SCHEMA)).collect()
    assert row[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
