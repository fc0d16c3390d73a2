"""Periodic runs of words: where a text repeats itself back to back.

A run is a stretch of consecutive words with smallest period q and at least ``max(24, 3 * q)`` words that no neighbouring
word extends keeping q. Main and Lorentz's divide and conquer finds them: a run of a segment crosses its midpoint or lies in one
half. At each midpoint the Z-values of all shifts (how far the text agrees with itself that many words on, to the right and to the
left of the midpoint) tell the repetitions that cross it. Here the segments of one depth of all texts of a part are
taken at once: words are interned as numbers, and one comparison of numbers of eight words answers for every shift whether its
Z-value reaches eight, or, for periods of eight and more, a whole period (a run's equal stretch has 2 q words and at least 16, so one side of the
midpoint has half of them). Only the shifts that pass are followed word by word to the ends of their run, which is exact; a shift
that a run found earlier explains (a multiple of its period inside it) is not followed, so a text of one repeated word costs
no more than another. Equal intervals keep their smallest period.

Words are interned by a 64-bit hash of their bytes. A part is about a megabyte of texts; a longer text is a part of its own, and its
shifts are compared a million at a time.

Defined cases: null, empty and blank texts have no word, no run and an empty collapsed text; no text is cut; repeated rows each have their row;
other columns are carried through, and those named like a result are returned as ``<name>_in``; an empty table gives an empty table.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from tessera.llm._frames import aside
from tessera.llm._text import parts, span_hashes, words

LEAST_WORDS, LEAST_POWER = 24, 3
_GRAM = 8
_SHIFTS = 1 << 20
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_FOUND = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("best", _RUN), ("collapsed", pa.string())])


def _grams(ids: np.ndarray) -> np.ndarray:
    """A number for the eight words at each place, with eight more before and after that agree with none."""
    far = 1 << 40
    g = np.concatenate([np.arange(far, far + 2 * _GRAM), ids, np.arange(far * 2, far * 2 + 2 * _GRAM)]).astype(np.uint64)
    for k, (a, b) in zip((1, 2, 4), ((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD), (0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D))):
        g = g[:-k] * np.uint64(a) + (g[k:] ^ (g[k:] >> np.uint64(31))) * np.uint64(b)
    return g


def crossing_shifts(grams: np.ndarray, mid: np.ndarray, longest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, period, place) of each shift that may be the period of a run across its segment's midpoint.

    ``place`` is a word from which the text agrees with itself ``period`` words on, for eight words.
    """
    n, zero = len(grams), 2 * _GRAM
    at = lambda i: grams[np.clip(i + zero, 0, n - 1)]
    found = []
    ends = np.cumsum(longest)
    first = 0
    while first < len(mid):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + _SHIFTS, side="right")))
        for low in range(0, int(longest[first:last].max()), _SHIFTS) if last == first + 1 else (0,):
            size = np.clip(longest[first:last] - low, 0, _SHIFTS)
            seg = np.repeat(np.arange(first, last), size)
            p = np.arange(len(seg)) - np.repeat(np.cumsum(size) - size, size) + 1 + low
            m = mid[seg]
            right, left, back = at(m) == at(m + p), at(m - _GRAM) == at(m - _GRAM + p), at(m - _GRAM - p) == at(m - _GRAM)
            hit = np.flatnonzero(right | left | back)
            seg, p, m, right, left, back = (x[hit] for x in (seg, p, m, right, left, back))
            short = p < _GRAM
            right &= short | (at(m + p - _GRAM) == at(m + 2 * p - _GRAM))
            left &= short | (at(m - p) == at(m))
            back &= short | (at(m - 2 * p) == at(m - p))
            place = np.where(right, m, np.where(left, m - _GRAM, m - _GRAM - p))
            keep = right | left | back
            found.append((seg[keep], p[keep], place[keep]))
        first = last
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found))


def _agrees(ids: np.ndarray, place: int, p: int, low: int, high: int) -> tuple[int, int]:
    """The longest stretch around ``place`` whose words agree with those ``p`` on, within [low, high)."""
    end, step = place, 64
    while end + p < high:
        stop = min(end + step, high - p)
        differ = np.flatnonzero(ids[end:stop] != ids[end + p : stop + p])
        if len(differ):
            end += int(differ[0])
            break
        end, step = stop, step * 2
    start, step = place, 64
    while start > low:
        stop = max(start - step, low)
        differ = np.flatnonzero(ids[stop:start] != ids[stop + p : start + p])
        if len(differ):
            start = stop + int(differ[-1]) + 1
            break
        start, step = stop, step * 2
    return start, end


def find_runs(ids: np.ndarray, first: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each text, by start, then period; words of text i are ``ids[first[i]:first[i + 1]]``."""
    n = len(first) - 1
    found: list[dict[tuple[int, int], int]] = [{} for _ in range(n)]
    text = np.flatnonzero(np.diff(first) >= LEAST_WORDS)
    low, high = first[text], first[text + 1]
    grams = _grams(ids)
    while len(text):
        mid = (low + high) // 2
        seg, period, place = crossing_shifts(grams, mid, (high - low) // LEAST_POWER)
        bounds = np.searchsorted(seg, np.arange(len(text) + 1))
        for s in np.unique(seg):
            runs, m = found[text[s]], mid[s]
            p, at = period[bounds[s] : bounds[s + 1]], place[bounds[s] : bounds[s + 1]]
            window = np.where(at >= m - _GRAM, m, m - p)  # p words in which a shift's text has period p
            known = list(runs.items())
            while len(p):
                for (a, b), q in known:
                    left = ~((p % q == 0) & (a <= window) & (window + p <= b))
                    p, at, window = p[left], at[left], window[left]
                if not len(p):
                    break
                a, b = _agrees(ids, int(at[0]), int(p[0]), int(first[text[s]]), int(first[text[s] + 1]))
                b += int(p[0])
                known = []
                if b - a >= max(LEAST_WORDS, LEAST_POWER * int(p[0])):
                    runs[a, b] = min(runs.get((a, b), int(p[0])), int(p[0]))
                    known = [((a, b), int(p[0]))]
                p, at, window = p[1:], at[1:], window[1:]
        low, high, text = np.stack([low, mid], 1).ravel(), np.stack([mid, high], 1).ravel(), np.repeat(text, 2)
        wide = high - low >= LEAST_WORDS
        low, high, text = low[wide], high[wide], text[wide]
    return [sorted((a - int(first[i]), b - a, q) for (a, b), q in runs.items()) for i, runs in enumerate(found)]


def _without(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, kept: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    marks = np.zeros(len(data) + 1, np.int8)
    marks[starts[kept]] += 1
    marks[ends[kept]] -= 1
    out = np.cumsum(marks[:-1], dtype=np.int8).astype(bool)
    chosen = np.flatnonzero(kept)
    owner = np.searchsorted(first, chosen, side="right")
    inner = chosen[:-1][owner[:-1] == owner[1:]] if len(chosen) else chosen
    out[ends[inner]] = True
    data = data.copy()
    data[ends[inner]] = 0x20
    total = np.zeros(len(out) + 1, np.int64)
    np.cumsum(out, out=total[1:])
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(total[offsets].astype(np.int32)), pa.py_buffer(data[out]))


def _best(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def _part(data: np.ndarray, offsets: np.ndarray) -> pa.StructArray:
    starts, ends, first = words(data, offsets)
    ids = np.unique(span_hashes(data, starts, ends), return_inverse=True)[1] if len(starts) else np.zeros(0, np.int64)
    runs = find_runs(ids, first)
    kept = np.ones(len(starts), bool)
    for i, of_text in enumerate(runs):
        for start, length, period in of_text:
            kept[first[i] + start + period : first[i] + start + length] = False
    as_rows = lambda r: dict(zip(("start", "length", "period"), r))
    return pa.StructArray.from_arrays(
        [
            pa.array(np.diff(first), pa.int64()),
            pa.array([[as_rows(r) for r in of_text] for of_text in runs], pa.list_(_RUN)),
            pa.array([as_rows(b) if (b := _best(of_text)) else None for of_text in runs], _RUN),
            _without(data, offsets, starts, ends, first, kept),
        ],
        fields=list(_FOUND),
    )


@F.arrow_udf(from_arrow_type(_FOUND))
def _find(texts: pa.Array) -> pa.Array:
    done = [_part(data, offsets) for _, _, data, offsets in parts(texts)]
    return pa.concat_arrays(done) if done else pa.array([], _FOUND)


def periodic_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, runs (start, length, period of each), best (the run of greatest length over period) and
    collapsed (the text without the words of a run behind its first period)."""
    names = ["n_words", "runs", "best", "collapsed"]
    text = text_col + "_in" if text_col in names else text_col
    found = aside(docs, [*names, "_found"]).withColumn("_found", _find(F.col(text)))
    return found.select(*[c for c in found.columns if c != "_found"], *(F.col(f"_found.{c}").alias(c) for c in names))


def planted(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The text, or, where CRC-32 of the id divides by ten, its words with a periodic rest from a place and with a period taken from that number."""
    h = F.crc32(F.col(id_col).cast("string"))
    g = F.floor(h / 10)
    said = F.filter(F.split(text_col, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(said)
    a = (g % n).cast("int")
    p = (F.floor((n - a) / (3 + g % 8)) + 1).cast("int")
    times = F.ceil((n - a) / p).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(said, a + 1, p), times)), F.lit(1), n - a)
    return F.when((h % 10 == 0) & F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.array_join(F.concat(F.slice(said, F.lit(1), a), tail), " ")).otherwise(F.col(text_col))


def run_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the best run and digests of runs and collapsed text, for texts that went through :func:`planted`."""
    found = periodic_runs(docs.select("doc_id", planted().alias("text")))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.floor(F.lit(1000).cast("long") * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        digest(F.array_join(F.transform("runs", line), "")).alias("runs_sha256"),
        digest(F.col("collapsed")).alias("collapsed_sha256"),
    )
