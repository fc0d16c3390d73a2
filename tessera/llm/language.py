"""Language identification by cross-parsing entropy.

For each language a suffix automaton of bounded labelled text is built. A text is parsed
against it greedily: a phrase is the longest match with a substring of the language's
text, and the next phrase starts where it ends. The number of phrases, times the logarithm of the
length of the language's text (what one phrase costs to name), estimates the cross entropy; the
language with the least wins (ties: the first by name).

Text is reduced to lower-cased letters with one separator for everything between words, so
that symbols, digits and capitals don't count. Automata are completed to tables: a missing
transition leads to where the next phrase stands, with a flag. Parsing is then one table
lookup per character and language, done for thousands of text pieces side by side. A long
text is cut into pieces of ``PIECE`` characters, whose phrases add up; a cut adds one
phrase at most.

Every language with a labelled text is learned. Learning takes, per language, the distinct texts of
smallest hash up to ``sample_rows`` rows and a number of letters: ``sample_chars``, or less where ``table_cells``
(the size of all tables together) is shared by many languages. Of a text longer than an eighth of that, a slice at
a place given by its hash is learned. Letters beyond the ``COMMON`` most frequent share classes by code point, so that tables
stay narrow for any script. Scoring is one map over Arrow batches, without a shuffle.

Defined cases: null text or no letter gives ``und`` with score 0; letters never seen in training
end a phrase each; null and empty language names are not learned; with no learned language
everything is ``und``; extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._text import parts
from tessera.runtime import discard, materialise

PIECE = 2048
#: Letters with a symbol of their own, and classes that all others share.
COMMON, SHARED = 384, 64
_SEPARATOR = 1  # symbol 0 pads
_fold: np.ndarray | None = None


def fold() -> np.ndarray:
    """Lower-case letter of each code point, 0 for what is no letter."""
    global _fold
    if _fold is None:
        table = np.zeros(0x110000, np.int32)
        for c in range(0x110000):
            s = chr(c)
            if unicodedata.category(s)[0] == "L":
                low = s.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _fold = table
    return _fold


def letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded letters with single 0s between words, and where each text's run of them begins (n + 1 offsets)."""
    lead = (data & 0xC0) != 0x80
    cp = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    count = np.zeros(len(data) + 1, np.int64)
    np.cumsum(lead, out=count[1:])
    at = count[offsets]
    c = fold()[cp]
    keep = c != 0
    keep[1:] |= c[:-1] != 0
    first = np.zeros(len(c) + 1, bool)
    first[at] = True
    keep[first[: len(c)]] = (c != 0)[first[: len(c)]]
    kept = np.zeros(len(c) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    return c[keep], kept[at]


def suffix_automaton(text: list[int], n_symbols: int) -> np.ndarray:
    """Transitions of the suffix automaton, n_symbols a state, -1 where there are none. State 0 is the start."""
    nexts: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        cur = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nexts)
                nexts.append(nexts[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    table = np.full((len(nexts), n_symbols), -1, np.int32)
    for s, d in enumerate(nexts):
        for c, t in d.items():
            table[s, c] = t
    return table


@dataclass(frozen=True)
class Parser:
    """languages, symbol of each letter, and the completed automata one after another.

    ``steps[state * n_symbols + symbol]`` is the next state's row, with the sign bit set
    where a phrase ends before the symbol. The padding symbol keeps the state.
    """

    languages: list[str]
    symbols: np.ndarray
    n_symbols: int
    steps: np.ndarray
    starts: np.ndarray
    costs: np.ndarray

    def phrases(self, codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases of each text (rows) against each language."""
        n, k = len(offsets) - 1, len(self.languages)
        out = np.zeros((n, k), np.int64)
        size = np.diff(offsets)
        n_pieces = -(-size // PIECE)
        owner = np.repeat(np.arange(n), n_pieces)
        begin = np.repeat(offsets[:-1], n_pieces) + PIECE * (np.arange(len(owner)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces))
        length = np.minimum(PIECE, np.repeat(offsets[1:], n_pieces) - begin)
        order = np.argsort(-length, kind="stable")
        owner, begin, length = owner[order], begin[order], length[order]
        symbols = self.symbols[np.minimum(codes, len(self.symbols) - 1)].astype(np.int32)
        symbols[codes >= len(self.symbols)] = self.n_symbols - 1
        state = np.tile(self.starts.astype(np.int32), (len(owner), 1))
        total = np.ones((len(owner), k), np.int32)
        active = np.searchsorted(-length, -np.arange(1, (length[0] if len(length) else 0) + 1), side="right")
        mask = np.int32(0x7FFFFFFF)
        for t, m in enumerate(active.tolist()):
            step = self.steps[state[:m] + symbols[begin[:m] + t][:, None]]
            total[:m] += step < 0
            state[:m] = step & mask
        np.add.at(out, owner, total)
        return out

    def predict(self, array: pa.Array) -> tuple[list[str], np.ndarray]:
        names = np.array([*self.languages, "und"], dtype=object)
        best, score = np.full(len(array), len(self.languages)), np.zeros(len(array))
        for row, end, data, offsets in parts(array):
            codes, at = letters(data, offsets)
            if not len(codes) or not self.languages:
                continue
            bits = self.phrases(codes, at) * self.costs
            has = np.diff(at) > 0
            win = bits.argmin(1)
            # One phrase more halves the share; it is capped so that it stays below 1.
            gap = (bits - bits.min(1, keepdims=True)) / self.costs.max() * np.log(2.0)
            share = 1 / np.exp(-np.minimum(gap, 40)).sum(1)
            best[row:end] = np.where(has, win, len(self.languages))
            score[row:end] = np.where(has, share, 0)
        return names[best].tolist(), score


def build(samples: dict[str, list[str]], *, sample_chars: int = 60_000) -> Parser:
    """Automata from each language's texts, in order, up to ``sample_chars`` letters each."""
    runs: dict[str, np.ndarray] = {}
    for name, texts in sorted(samples.items()):
        held: list[np.ndarray] = []
        room = sample_chars
        for text in texts:
            raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
            c, _ = letters(raw, np.array([0, len(raw)]))
            if room > 1 and len(c):
                held += [c[: room - 1], np.zeros(1, np.int32)]
                room -= len(held[-2]) + 1
        if held:
            runs[name] = np.concatenate(held)
    used, often = np.unique(np.concatenate([r for r in runs.values()] or [np.zeros(1, np.int32)]), return_counts=True)
    used, often = used[used > 0], often[used > 0]
    own = used[np.sort(np.argsort(-often, kind="stable")[:COMMON])]
    rest = np.setdiff1d(used, own)
    n_symbols = len(own) + (SHARED if len(rest) else 0) + 3
    symbols = np.full((used[-1] if len(used) else 0) + 2, n_symbols - 1, np.uint16)
    symbols[0] = _SEPARATOR
    symbols[own] = np.arange(2, len(own) + 2)
    symbols[rest] = 2 + len(own) + rest % SHARED
    tables, starts, base = [], [], 0
    for run in runs.values():
        table = suffix_automaton(symbols[run].tolist(), n_symbols)
        # The next phrase begins with the symbol that did not fit. An unknown symbol is a phrase by
        # itself: it leads to one more state, after which every symbol begins a phrase.
        alone = len(table)
        first = np.where(table[0] >= 0, table[0], alone)
        table = np.concatenate([table, np.full((1, n_symbols), -1, np.int32)])
        rows = np.where(table >= 0, (table + base) * n_symbols, ((first + base) * n_symbols)[None, :] | np.int32(-(2**31)))
        rows[0] = (first + base) * n_symbols
        tables.append(rows.astype(np.int32))
        starts.append(base * n_symbols)
        base += len(table)
    steps = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)
    costs = np.array([np.log2(len(r) + 1.0) for r in runs.values()])
    return Parser(list(runs), symbols, n_symbols, steps, np.array(starts, np.int64), costs)


def train(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", train_on: Column | None = None, sample_rows: int = 64, sample_chars: int = 60_000, table_cells: int = 1 << 26) -> Parser:
    d = docs.filter(train_on) if train_on is not None else docs
    d = d.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang IS NOT NULL AND lang <> '' AND text IS NOT NULL").withColumn("h", F.xxhash64("text"))
    distinct = materialise(d.groupBy("lang", "h").agg(F.count(F.lit(1)).alias("n")), "lang-texts")
    sizes = materialise(distinct.groupBy("lang").agg(F.count(F.lit(1)).alias("texts")), "lang-sizes")
    # An automaton has two states a letter at most, and a state a cell for each symbol.
    n_languages = sizes.count()
    chars = min(sample_chars, max(64, table_cells // (2 * (COMMON + SHARED) * max(1, n_languages))))
    # Of hashes that are spread evenly, the lowest share holds four samples; what ranks first of it ranks first of all.
    share = F.least(F.lit(1.0), F.lit(4.0 * sample_rows) / F.col("texts"))
    low = distinct.join(sizes, "lang").filter(F.col("h").cast("double") <= F.lit(-(2.0**63)) + share * F.lit(2.0**64))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    picked = low.withColumn("rank", rank).filter(F.col("rank") <= sample_rows).select("lang", "h")
    piece = max(8, chars // 8)
    length = F.length("text")
    cut = F.when(length <= chars, F.col("text")).otherwise(F.substring("text", (F.pmod(F.col("h"), length - piece) + 1).cast("int"), F.lit(piece)))
    if n_languages * sample_rows <= 1_000_000:  # of more rows the plain join takes care
        picked = F.broadcast(picked)
    rows = d.join(picked, ["lang", "h"]).groupBy("lang", "h").agg(F.min(cut).alias("text")).collect()
    discard(distinct)
    discard(sizes)
    samples: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["h"])):
        samples.setdefault(r["lang"], []).append(r["text"])
    return build(samples, sample_chars=chars)


def identify(docs: DataFrame, model: Parser, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (the winner's share, 0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def parse(text: pa.Array) -> pa.Array:
        names, score = shared.value.predict(text)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score)], ["lang_pred", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), parse(F.col(text_col)).alias("p")).select("doc_id", "p.lang_pred", "p.score")
