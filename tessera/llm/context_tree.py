"""Language-model scores by context-tree weighting over bytes.

Model. A text is its UTF-8 bytes with A-Z lower-cased, then one end symbol (0xFF, which UTF-8
never uses; it also stands for what precedes a text). A symbol is decided in binary steps,
high bit first; each node of the decision has its own context tree, whose levels are the
previous bytes, newest first, down to ``DEPTH``. Every context holds a Krichevsky-Trofimov
estimate; its weighted probability is the even mixture of its own estimate and the product
of its children's, over all depths. After training the mixture weights are fixed, so the
model is a table of log-probabilities by context and byte. They sum to one over the codes of a
decision, so to one at most over bytes and over all texts (codes beyond the bytes seen keep a
little). Bytes that training never saw share one escape code, then are equally likely.

Size. The tree grows with the corpus: every context that occurs ``least`` times (2) is kept, those that occur
less share one leaf below their parent, and no context is merged to save room. It is held in parts, each all contexts of a run
of newest bytes; the driver joins the parts' evidence at the top ``_TOP`` levels. A place's probability follows from its
run of ``DEPTH`` + 1 bytes alone, so each block of texts sends its distinct runs, sorted, with their
counts to the parts, gets one number back for each, in the same order, and sums them over its texts. The blocks are
found twice by reading the table twice; an error is raised if it gave other rows.

Training counts every byte of every training text. :func:`assemble` lays out a tree whose contexts all fit one process.

The unigram baseline needs the corpus count of every word. Words that are common in a
bounded sample are counted per task and looked up; the others are dealt by hash with their
document's row number and counted where they meet; the documents' partial sums travel as one row
per block of documents. The sample only
decides which way a word goes; counts are exact over all training texts. Words are told
apart by a 64-bit hash.

Defined cases: null text counts as empty, which is the end symbol and token alone; without
training texts N and V are 0, every token is unknown and each bit has probability 1/2;
rows that repeat an id are scored each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._text import LOWER, parts, span_hashes, words
from tessera.runtime import discard, materialise

DEPTH = 6
_END = 0xFF
_LANE = 2048
_HALF = np.log(0.5)
#: Counted runs that a task holds before it merges them.
_HELD = 1_500_000
#: Bytes of text whose distinct grams travel together.
_BLOCK_BYTES = 1 << 23
#: The part of the tree that the driver holds; a part of the rest has whole contexts one byte deeper.
_TOP = 2
_BELOW_TOP = np.uint64(8 * (DEPTH - _TOP))
_SLICE = 4096


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes of all texts, each after DEPTH ends, with DEPTH more at the close; where each text's bytes begin."""
    n = len(offsets) - 1
    begin = offsets[:-1] + DEPTH * np.arange(1, n + 1)
    inside = np.ones(len(data) + DEPTH * (n + 1), bool)
    inside[(np.append(begin, len(inside))[:, None] - np.arange(1, DEPTH + 1)).ravel()] = False
    seq = np.full(len(inside), _END, np.uint8)
    seq[inside] = LOWER[data]
    return seq, begin


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The DEPTH bytes before each scored place, newest on top, then its byte, as one number."""
    seq, begin = padded(data, offsets)
    wide = seq.astype(np.uint64)
    out = wide[DEPTH:].copy()
    shifted = np.empty_like(out)
    for d in range(1, DEPTH + 1):
        np.left_shift(wide[DEPTH - d : len(wide) - d], np.uint64(8 * (DEPTH + 1 - d)), out=shifted)
        out |= shifted
    # Of the ends before a text, the first closes the text before and the others are no places.
    scored = np.ones(len(out), bool)
    scored[(np.append(begin[1:], len(seq))[:, None] - DEPTH - np.arange(1, DEPTH)).ravel()] = False
    return out[scored]


def merge_counts(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln gamma for x > 0, by Stirling's series at x + 8."""
    low = x.copy()
    for i in range(1, 8):
        low *= x + i
    low = np.log(low)
    y = x + 8
    inv = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + (1 / 12 - inv * (1 / 360 - inv / 1260)) / y - low


def kt_log(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    out = np.empty(zeros.shape)
    for at in range(0, len(zeros), 4_096):
        z, o = zeros[at : at + 4_096], ones[at : at + 4_096]
        out[at : at + 4_096] = log_gamma(z + 0.5) + log_gamma(o + 0.5) - np.log(np.pi) - log_gamma(z + o + 1)
    return out


def bit_counts(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones at the decision nodes, from counts by symbol (rows, a power of two)."""
    zeros, ones = [], []
    for k in range(n.shape[1].bit_length() - 1):
        x = n.reshape(len(n), 1 << k, 2, -1).sum(-1)
        zeros.append(x[:, :, 0])
        ones.append(x[:, :, 1])
    return np.concatenate(zeros, 1), np.concatenate(ones, 1)


def estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return (ones + 0.5) / (zeros + ones + 1)


@dataclass(frozen=True)
class ContextTree:
    """log10 of the next symbol's probability and the next state, by state and symbol."""

    symbol: np.ndarray
    logs: np.ndarray
    steps: np.ndarray

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """log10 probability of each text. A lane is up to _LANE places, after DEPTH bytes that set its state."""
        seq, begin = padded(data, offsets)
        code = self.symbol[seq].astype(np.int64)
        size = np.diff(offsets) + 1
        lanes = -(-size // _LANE)
        owner = np.repeat(np.arange(len(size)), lanes)
        first = np.repeat(begin, lanes) + _LANE * (np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes))
        length = np.minimum(_LANE, np.repeat(begin + size, lanes) - first)
        order = np.argsort(-length, kind="stable")
        owner, first, length = owner[order], first[order], length[order]
        width = self.logs.shape[1]
        logs, steps = self.logs.ravel(), self.steps.ravel()
        state = np.zeros(len(owner), np.int64)
        for t in range(DEPTH):
            state = steps[state + code[first - DEPTH + t]].astype(np.int64) * width
        total = np.zeros(len(owner))
        active = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right")
        for t, m in enumerate(active.tolist()):
            cell = state[:m] + code[first[:m] + t]
            total[:m] += logs[cell]
            np.multiply(steps[cell], width, out=state[:m], casting="unsafe")
        return np.bincount(owner, total, len(size))


def assemble(contexts: list[np.ndarray], counts: list[np.ndarray], used: np.ndarray) -> ContextTree:
    """Weigh the tree and lay it out. contexts[d]: the kept contexts of depth d, sorted; counts[d]: by symbol.

    Depth 0 is the one empty context. Bottom up, a node's evidence is the even mixture of its
    estimate with the product of its kept children and of one leaf for all others; top down, the
    weights along the path give each node's prediction, that leaf included.
    """
    width = counts[0].shape[1]
    parents = [np.zeros(len(contexts[d]), np.int64) if d < 2 else np.searchsorted(contexts[d - 1], contexts[d] >> np.uint64(8)) for d in range(len(contexts))]
    weights: list[np.ndarray] = [np.zeros(0)] * len(contexts)
    leaves: list[np.ndarray] = [np.zeros(0)] * len(contexts)
    above: np.ndarray | None = None
    for d in range(len(contexts) - 1, -1, -1):
        zeros, ones = bit_counts(counts[d])
        own = kt_log(zeros, ones)
        if d == len(contexts) - 1:
            weights[d], leaves[d], total = np.ones(own.shape, np.float32), np.zeros(own.shape, np.float32), own
        else:
            kept = np.zeros_like(counts[d])
            np.add.at(kept, parents[d + 1], counts[d + 1])
            z, o = bit_counts(np.maximum(counts[d] - kept, 0))
            children = kt_log(z, o)
            np.add.at(children, parents[d + 1], above)
            total = _HALF + np.logaddexp(own, children)
            weights[d], leaves[d] = np.exp(_HALF + own - total).astype(np.float32), estimate(z, o).astype(np.float32)
        above = total
    logs, base = [], 0
    mixed = left = None
    steps: list[np.ndarray] = []
    starts = np.cumsum([0] + [len(c) for c in contexts])
    symbol_of = np.arange(width)
    for d in range(len(contexts)):
        own = estimate(*bit_counts(counts[d])).astype(np.float32)
        if d == 0:
            mixed, left = weights[0] * own, 1 - weights[0]
        else:
            p = parents[d]
            mixed, left = mixed[p] + left[p] * weights[d] * own, left[p] * (1 - weights[d])
        q = np.clip(mixed + left * leaves[d], 1e-12, 1 - 1e-7)
        yes, no = np.log10(q), np.log10(1 - q.astype(float)).astype(np.float32)
        row = np.zeros((len(q), width), np.float32)
        bits = width.bit_length() - 1
        for k in range(bits):
            node = (1 << k) - 1 + (symbol_of >> (bits - k))
            row += np.where((symbol_of >> (bits - 1 - k)) & 1, yes[:, node], no[:, node])
        logs.append(row)
        # The next state has the longest kept context: one byte deeper if that is kept, else what the parent has.
        step = np.zeros((len(q), width), np.int32) if d == 0 else steps[d - 1][parents[d]].copy()
        if d + 1 < len(contexts) and len(contexts[d + 1]):
            for k, byte in enumerate(used.tolist()):
                wanted = (np.uint64(byte) << np.uint64(8 * d)) | contexts[d]
                at = np.minimum(np.searchsorted(contexts[d + 1], wanted), len(contexts[d + 1]) - 1)
                hit = contexts[d + 1][at] == wanted
                step[hit, k] = starts[d + 1] + at[hit]
        steps.append(step)
    table = np.concatenate(logs)
    # Unseen bytes share the symbol after the last used one.
    n_unseen = 256 - len(used)
    if n_unseen:
        table[:, len(used)] -= np.float32(np.log10(n_unseen))
    symbol = np.full(256, len(used), np.int64)
    symbol[used] = np.arange(len(used))
    return ContextTree(symbol, table, np.concatenate(steps))


# --- training -------------------------------------------------------------------------


def sampled(docs: DataFrame, text_col: str, n_texts: int, *, sample_rows: int = 20_000, max_words: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words found in most texts of a bounded sample, sorted; top bytes of contexts, evenly spread over its grams."""
    share = min(1.0, 1.5 * sample_rows / max(1, n_texts))
    picked = docs.filter(F.pmod(F.xxhash64(text_col), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select(text_col).limit(sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = 64
        for b in batches:
            for _, _, data, offsets in parts(b.column(0)):
                starts, ends, first = words(data, offsets)
                h = span_hashes(LOWER[data], starts, ends)
                found = [np.unique(h[a:z]) for a, z in zip(first[:-1], first[1:])]
                k, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(k), np.int32)), pa.array(k.view(np.int64)), pa.array(n)], ["kind", "h", "n"])
                if rest:
                    rest -= 1
                    g = np.unique(grams(data, offsets))
                    top, n = np.unique(g[:: max(1, len(g) // 1024)][:1024] >> _BELOW_TOP, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(top), np.int32)), pa.array(top.view(np.int64)), pa.array(n)], ["kind", "h", "n"])

    rows = picked.mapInArrow(run, "kind int, h long, n long").groupBy("kind", "h").agg(F.sum("n").alias("n")).filter("kind = 1 OR n >= 3")
    rows = rows.orderBy(F.desc("kind"), F.desc("n"), "h").limit(max_words + 65_536).toArrow()
    kind, h, n = (np.asarray(rows.column(c).combine_chunks()).astype(np.int64) for c in ("kind", "h", "n"))
    return np.sort(h[kind == 0][:max_words].view(np.uint64)), np.sort(np.repeat(h[kind == 1], n[kind == 1])).view(np.uint64)


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def pack(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit numbers as differences, byte by byte, compressed."""
    planes = [np.ascontiguousarray(np.diff(c.view(np.uint64), prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T) for c in columns]
    return pa.compress(b"".join(x.tobytes() for x in planes), codec="zstd", asbytes=True)


def unpack(data: bytes, n: int, width: int) -> list[np.ndarray]:
    raw = np.frombuffer(pa.decompress(data, n * width * 8, codec="zstd"), np.uint8).reshape(width, 8, n)
    return [np.cumsum(np.ascontiguousarray(raw[i].T).view(np.uint64).ravel(), dtype=np.uint64) for i in range(width)]


def _runs(block: np.ndarray) -> Iterator[tuple[int, int]]:
    head = np.append(np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])), len(block)) if len(block) else np.zeros(1, np.int64)
    yield from zip(head[:-1].tolist(), head[1:].tolist())


def _blocks(batches: Iterator[pa.RecordBatch], text: int, block_bytes: int) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    """The block of each row: rows of one partition in order, about ``block_bytes`` of text a block. Column 0 is the row number."""
    done = 0
    for b in batches:
        size = np.asarray(pc.fill_null(pc.binary_length(b.column(text)), 0)).astype(np.int64) + 1
        before = done + np.cumsum(size) - size
        done += int(size.sum())
        yield (np.asarray(b.column(0)) >> 33 << 30) + before // block_bytes, b


def byte_counts(learn: DataFrame) -> np.ndarray:
    """How often each byte is a symbol of the training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for b in batches:
            for _, _, data, offsets in parts(b.column(0)):
                total += np.bincount(LOWER[data], minlength=256)
                total[_END] += len(offsets) - 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(total)], ["byte", "n"])

    out = np.zeros(256, np.int64)
    for r in learn.mapInArrow(run, "byte long, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        out[r["byte"]] = r["n"]
    return out


def block_grams(given: DataFrame, common: np.ndarray, cuts: np.ndarray, block_bytes: int = _BLOCK_BYTES) -> DataFrame:
    """part, block, n, data: each block's distinct grams with their counts in training texts, in a piece for each run of contexts.

    Parts below 0 are slices of the counts of common words, which the number of tokens follows.
    """

    def rows(part: np.ndarray, block: int, data: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.full(len(part), block)), pa.array([len(x[0]) for x in data], pa.int64()), pa.array([pack(*x) for x in data], pa.binary())], ["part", "block", "n", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        seen, waiting, current = np.zeros(len(common) + 1, np.int64), 0, None

        def merged() -> tuple[np.ndarray, np.ndarray]:
            return merge_counts(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))

        def pieces() -> pa.RecordBatch:
            k, n = merged()
            edges = np.concatenate([[0], np.searchsorted(k, cuts << _BELOW_TOP), [len(k)]])
            some = np.flatnonzero(np.diff(edges))
            return rows(some, current, [(k[edges[i] : edges[i + 1]], n[edges[i] : edges[i + 1]]) for i in some])

        for block, b in _blocks(batches, 2, block_bytes):
            for a, z in _runs(block):
                if current is not None and block[a] != current:
                    yield pieces()
                    held, waiting = [], 0
                current = int(block[a])
                text, train = b.column(2).slice(a, z - a), b.column(1).slice(a, z - a)
                for mask, learnt in ((train, True), (pc.invert(train), False)):
                    for _, _, data, offsets in parts(text.filter(mask)):
                        k, n = np.unique(grams(data, offsets), return_counts=True)
                        held.append((k, n if learnt else np.zeros_like(n)))
                        waiting += len(k)
                        if waiting > max(_HELD, 2 * len(held[0][0])):
                            held = [merged()]
                            waiting = 0
                        if learnt:
                            starts, ends, _ = words(data, offsets)
                            at, known = _find(common, span_hashes(LOWER[data], starts, ends))
                            seen[:-1] += np.bincount(at[known], minlength=len(common))
                            seen[-1] += len(starts) + len(offsets) - 1
        if current is not None:
            yield pieces()
        at = np.arange(0, len(seen), _SLICE)
        yield rows(-1 - at // _SLICE, -1, [(seen[i : i + _SLICE],) for i in at])

    return given.select("uid", "train", "text").mapInArrow(run, "part long, block long, n long, data binary")


#: ln gamma of x + 1/2 and of x + 1 for small x.
_LG_HALF, _LG_ONE = (log_gamma(np.arange(1 << 16) + c) for c in (0.5, 1.0))


def _lg(table: np.ndarray, x: np.ndarray, add: float) -> np.ndarray:
    out = table[np.minimum(x, len(table) - 1)]
    big = np.flatnonzero(x >= len(table))
    out[big] = log_gamma(x[big] + add)
    return out


def kt_sparse(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return _lg(_LG_HALF, zeros, 0.5) + _lg(_LG_HALF, ones, 0.5) - np.log(np.pi) - _lg(_LG_ONE, zeros + ones, 1.0)


def _up(keys: np.ndarray) -> np.ndarray:
    """The same decision (low byte) one context byte less deep."""
    return (keys >> np.uint64(16) << np.uint64(8)) | (keys & np.uint64(255))


@dataclass
class Branch:
    """Depths ``low`` to ``high`` of the tree, only nodes with counts. A key is a context and, in the low byte, a symbol or the leading bits of one.

    contexts[d]: kept contexts; nodes[d][k]: keys, weights, estimates and leaves of decision k; below[k]: keys at depth
    low - 1 with the zeros, ones and evidence of the kept nodes under them; keys, n: the counts there by symbol.
    """

    contexts: dict[int, np.ndarray]
    nodes: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]
    below: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    keys: np.ndarray
    n: np.ndarray
    counts: dict[int, np.ndarray]


def _sums(keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    found, place = np.unique(keys, return_inverse=True)
    return found, *(np.bincount(place, c, len(found)).astype(c.dtype) for c in columns)


def weigh(keys: np.ndarray, n: np.ndarray, below: list | None, *, high: int, low: int, bits: int, least: int) -> Branch:
    """Bottom up from counts by context of depth ``high`` and symbol, sorted: evidence, weights and leaves as in :func:`assemble`."""
    contexts, nodes, totals = {}, {}, {}
    for d in range(high, low - 1, -1):
        context = keys >> np.uint64(8)
        head = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(keys) else np.zeros(0, np.int64)
        each = np.add.reduceat(n, head) if len(head) else np.zeros(0, np.int64)
        kept = each >= (least if d else 0)
        contexts[d], totals[d] = context[head][kept], each[kept]
        inside = np.repeat(kept, np.diff(np.append(head, len(keys))))
        own_keys, own_n = keys[inside], n[inside]
        nodes[d], up = [], []
        for k in range(bits):
            symbol = own_keys & np.uint64(255)
            node = (own_keys ^ symbol) | (symbol >> np.uint64(bits - k))
            first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.zeros(0, np.int64)
            node = node[first]
            bit = ((symbol >> np.uint64(bits - 1 - k)) & np.uint64(1)).astype(np.int64)
            ones = np.add.reduceat(own_n * bit, first) if len(first) else np.zeros(0, np.int64)
            zeros = (np.add.reduceat(own_n, first) if len(first) else np.zeros(0, np.int64)) - ones
            own = kt_sparse(zeros, ones)
            if d == DEPTH:
                total, weight, leaf = own, np.ones(len(own)), np.zeros(len(own))
            else:
                under, kz, ko, evidence = below[k]
                at = np.searchsorted(node, under)
                z = zeros - np.bincount(at, kz, len(node)).astype(np.int64)
                o = ones - np.bincount(at, ko, len(node)).astype(np.int64)
                children = kt_sparse(z, o) + np.bincount(at, evidence, len(node))
                total = _HALF + np.logaddexp(own, children)
                weight, leaf = np.exp(_HALF + own - total), estimate(z, o)
            nodes[d].append((node, weight, estimate(zeros, ones), leaf))
            up.append((_up(node), zeros, ones, total))
        below = up
        keys, n = _sums(_up(keys), n)
    return Branch(contexts, nodes, below, keys, n, totals)


def descend(branch: Branch, above: list[tuple[np.ndarray, ...]] | None) -> dict[int, list[tuple[np.ndarray, ...]]]:
    """Top down: keys, the mixture so far, the weight left and the leaf of every node."""
    out: dict[int, list[tuple[np.ndarray, ...]]] = {}
    for d in sorted(branch.nodes):
        out[d] = []
        for k, (keys, weight, own, leaf) in enumerate(branch.nodes[d]):
            if d == 0:
                mixed, left = weight * own, 1 - weight
            else:
                parent, mixed, left, _ = above[k]
                at = np.searchsorted(parent, _up(keys))
                mixed, left = mixed[at] + left[at] * weight * own, left[at] * (1 - weight)
            out[d].append((keys, mixed, left, leaf))
        above = out[d]
    return out


def predict(asked: np.ndarray, used: np.ndarray, contexts: dict[int, np.ndarray], tables: dict[int, list[tuple[np.ndarray, ...]]]) -> np.ndarray:
    """log10 of the last byte's probability after the others, of each gram."""
    bits = symbol_bits(used)
    symbol_of = np.full(256, len(used), np.uint64)
    symbol_of[used] = np.arange(len(used))
    symbol = symbol_of[(asked & np.uint64(255)).astype(np.int64)]
    past = [asked >> np.uint64(8 * (DEPTH + 1 - d)) for d in range(DEPTH + 1)]
    deepest = np.zeros(len(asked), np.int64)
    for d in range(1, DEPTH + 1):
        deepest[_find(contexts[d], past[d])[1]] = d
    total = np.zeros(len(asked))
    for k in range(bits):
        leading = symbol >> np.uint64(bits - k)
        q = np.full(len(asked), 0.5)
        rest = np.arange(len(asked))
        for d in range(DEPTH, -1, -1):
            at_depth = deepest[rest] >= d
            own = rest[at_depth]
            if not len(own):
                continue
            keys, mixed, left, leaf = tables[d][k]
            at, hit = _find(keys, (past[d][own] << np.uint64(8)) | leading[own])
            at, found = at[hit], own[hit]
            # Under a kept context that never saw this decision, every estimate is one half.
            q[found] = mixed[at] + left[at] * np.where(deepest[found] == d, leaf[at], 0.5)
            rest = np.concatenate([rest[~at_depth], own[~hit]])
        q = np.clip(q, 1e-12, 1 - 1e-7)
        total += np.log10(np.where((symbol >> np.uint64(bits - 1 - k)) & np.uint64(1), q, 1 - q))
    total[symbol == len(used)] -= np.log10(max(1, 256 - len(used)))
    return total


def symbol_bits(used: np.ndarray) -> int:
    return max(1, int(len(used)).bit_length())


def _branch(grams_: np.ndarray, n: np.ndarray, used: np.ndarray, least: int) -> Branch:
    """The tree below depth _TOP, from a part's distinct grams."""
    symbol_of = np.zeros(256, np.uint64)
    symbol_of[used] = np.arange(len(used))
    learnt = n > 0
    keys = grams_[learnt]
    keys = (keys >> np.uint64(8) << np.uint64(8)) | symbol_of[(keys & np.uint64(255)).astype(np.int64)]
    return weigh(keys, n[learnt], None, high=DEPTH, low=_TOP + 1, bits=symbol_bits(used), least=least)


def fit_parts(pieces: DataFrame, n_parts: int, used: np.ndarray, least: int, tried: list[int]) -> DataFrame:
    """A row a part: its distinct grams with counts, each block's places among them, and what the top of the tree needs."""
    bits = symbol_bits(used)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, int, bytes]]] = {}
        slices: dict[int, np.ndarray] = {}
        for b in batches:
            for part, block, n, data in zip(*(c.to_pylist() for c in b.columns)):
                if part < 0:
                    slices[part] = slices.get(part, 0) + unpack(data, n, 1)[0].view(np.int64)
                else:
                    held.setdefault(part, []).append((block, n, data))
        for part, seen in slices.items():
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((part, len(seen), pack(seen), b"", [], b"", []), _PART_TYPES)], _PART_NAMES)
        for part in sorted(held):
            given = held.pop(part)
            size = np.array([n for _, n, _ in given])
            keys, counts = (np.concatenate(x) for x in zip(*(unpack(data, n, 2) for _, n, data in given)))
            found, place = np.unique(keys, return_inverse=True)
            n = np.bincount(place, counts, len(found)).astype(np.int64)
            place = np.split(place.astype(np.uint64), np.cumsum(size)[:-1])
            blocks = np.concatenate([[block for block, _, _ in given], size]).astype(np.int64)
            branch = _branch(found, n, used, least)
            fits = [sum(int((c >= t).sum()) for c in branch.counts.values()) for t in tried]
            top = [pack(branch.keys, branch.n)]
            sizes = [len(branch.keys)]
            for key, z, o, evidence in (_sums(*x) for x in branch.below):
                top.append(pack(key, z, o, evidence))
                sizes.append(len(key))
            row = (part, len(found), pack(found, n), blocks.tobytes(), [pack(p) for p in place], np.array(sizes + fits).tobytes(), top)
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _PART_TYPES)], _PART_NAMES)

    assert bits <= 8  # UTF-8 in lower case has fewer than 256 byte values
    return pieces.repartition(n_parts, "part").mapInArrow(run, "part long, n long, grams binary, blocks binary, places array<binary>, sizes binary, top array<binary>")


_PART_NAMES = ["part", "n", "grams", "blocks", "places", "sizes", "top"]
_PART_TYPES = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.binary(), pa.list_(pa.binary())]


def fit_top(fitted: DataFrame, used: np.ndarray, least: int, tried: list[int]) -> tuple[dict[int, np.ndarray], dict[int, list[tuple[np.ndarray, ...]]], np.ndarray]:
    """Kept contexts and nodes down to depth _TOP, of which there are 65,536 contexts at most; contexts of the whole tree by least count."""
    bits = symbol_bits(used)
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    counts: list[tuple[np.ndarray, ...]] = [none]
    below: list[list[tuple[np.ndarray, ...]]] = [[(*none, none[1], np.zeros(0))] for _ in range(bits)]
    fits = np.zeros(len(tried), np.int64)

    def joined(rows: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        return _sums(*(np.concatenate(c) for c in zip(*rows)))

    for i, r in enumerate(fitted.filter("part >= 0").select("sizes", "top").toLocalIterator(prefetchPartitions=True)):
        sizes = np.frombuffer(r["sizes"], np.int64)
        key, n = unpack(r["top"][0], int(sizes[0]), 2)
        counts.append((key, n.view(np.int64)))
        for k in range(bits):
            key, z, o, evidence = unpack(r["top"][k + 1], int(sizes[k + 1]), 4)
            below[k].append((key, z.view(np.int64), o.view(np.int64), evidence.view(float)))
        fits += sizes[bits + 1 :]
        if i % 256 == 255:  # parts share contexts of this depth
            counts, below = [joined(counts)], [[joined(x)] for x in below]
    keys, n = joined(counts)
    under = [joined(x) for x in below]
    top = weigh(keys, n, under, high=_TOP, low=0, bits=bits, least=least)
    return top.contexts, descend(top, None), fits + np.array([sum(int((c >= t).sum()) for d, c in top.counts.items() if d) for t in tried], np.int64)


def score_grams(fitted: DataFrame, model: Broadcast) -> DataFrame:
    """block, part, check, data: log10 probabilities of a block's distinct grams, piece by piece, and the sum of the grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, least, contexts, tables = model.value[:4]
        for b in batches:
            for part, size, data, blocks, places in zip(*(b.column(c).to_pylist() for c in _PART_NAMES[:5])):
                asked, n = unpack(data, size, 2)
                branch = _branch(asked, n.view(np.int64), used, least)
                logs = predict(asked, used, contexts | branch.contexts, tables | descend(branch, tables[_TOP])).astype(np.float32)
                block, sizes = np.frombuffer(blocks, np.int64).reshape(2, -1)
                for k, m, place in zip(block.tolist(), sizes.tolist(), places):
                    at = unpack(place, m, 1)[0].astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([part]), pa.array([int(asked[at].sum().view(np.int64))]), pa.array([logs[at].tobytes()], pa.binary())], ["block", "part", "check", "data"])

    return fitted.filter("part >= 0").mapInArrow(run, "block long, part long, check long, data binary")


# --- scoring --------------------------------------------------------------------------

_BLOCK_BITS = 10
_FIELDS = 7
_NAMES = ["key", "uid", "n", "docs"]
_SCHEMA = "key long, uid long, n int, docs binary"
_TEXT_NAMES = ["block", "kind", "uid", "doc_id", "train", "text", "data"]
_TEXT_SCHEMA = "block long, kind int, uid long, doc_id long, train boolean, text string, data binary"


def _block_rows(uid: np.ndarray, known: np.ndarray, part: np.ndarray, docs: tuple[pa.Array, np.ndarray, np.ndarray] | None = None) -> pa.RecordBatch:
    """One row for each run of documents with the same leading bits of their row number; uid must be sorted.

    A row's bytes are a table of 64-bit numbers, a column a document: row number, kind (0 partial sums
    only, 1 with the document's own columns, 2 the same for a null id), id, tokens, known, part, score.
    """
    table = np.zeros((_FIELDS, len(uid)), np.int64)
    table[0], table[4], table[5] = uid, known, np.ascontiguousarray(part, float).view(np.int64)
    if docs is not None:
        ids, n_tokens, score = docs
        table[1], table[2], table[3], table[6] = np.where(ids.is_null(), 2, 1), np.asarray(pc.fill_null(ids, 0)), n_tokens, np.ascontiguousarray(score, float).view(np.int64)
    block = uid >> _BLOCK_BITS
    head = np.append(np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])), len(uid))
    packed = [np.ascontiguousarray(table[:, a:b]).tobytes() for a, b in zip(head[:-1], head[1:])]
    keys = pa.array(block[head[:-1]])
    return pa.RecordBatch.from_arrays([keys, keys, pa.array(np.zeros(len(packed), np.int32)), pa.array(packed, pa.binary())], _NAMES)


def score_texts(docs: DataFrame, train_on: Column, *, id_col: str = "doc_id", text_col: str = "text", least: int = 2, table_bytes: int | None = None, block_bytes: int = _BLOCK_BYTES) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score (log10 of the text's probability).

    ``train_on`` is an expression over ``docs`` that says which rows to learn from; contexts seen ``least`` times are kept.
    ``table_bytes`` asks for a smaller model: the least count is raised until the kept contexts, as rows of 8 bytes a symbol, fit.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    given = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(train_on, F.lit(False)).alias("train"), F.col(text_col).alias("text"))
    learn = given.filter("train").select("text")
    seen = byte_counts(learn)
    ends = int(seen[_END])
    used = np.flatnonzero(seen)
    common, spread = sampled(learn, "text", ends)
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(seen.sum()) // 4_000_000))
    cuts = np.unique(spread[np.arange(1, 2 * n_parts) * len(spread) // (2 * n_parts)]) if len(spread) else spread
    pieces = block_grams(given, common, cuts, block_bytes)
    # The least count that fits is found among a few, each 1.3 times the last.
    tried = sorted({int(least * 1.3**i) for i in range(80)}) if table_bytes is not None else []
    fitted = materialise(fit_parts(pieces, n_parts, used, least, tried), "lm-parts")
    contexts, tables, fits = fit_top(fitted, used, least, tried)
    if table_bytes is not None:
        least = next((t for t, n in zip(tried, fits) if (n << symbol_bits(used)) * 8 <= table_bytes), tried[-1])
        few = materialise(fit_parts(pieces, n_parts, used, least, []), "lm-parts-few")
        contexts, tables, _ = fit_top(few, used, least, [])
        discard(few)
    count = np.zeros(len(common) + 1, np.int64)
    for r in fitted.filter("part < 0").select("part", "n", "grams").collect():
        at = (-1 - r["part"]) * _SLICE
        count[at : at + r["n"]] = unpack(r["grams"], r["n"], 1)[0].view(np.int64)
    count, tokens = count[:-1], int(count[-1])
    model = sc.broadcast((used, least, contexts, tables))
    vocabulary = sc.broadcast((common, count))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, b in _blocks(batches, 3, block_bytes):
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(np.ones(n, np.int32)), *b.columns, pa.nulls(n, pa.binary())], _TEXT_NAMES)

    def scored(texts: list[pa.RecordBatch], logs: list[bytes], check: int) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """Each part of a block's texts with the texts' scores."""
        held, found = [], []
        for b in texts:
            for row, end, data, offsets in parts(b.column("text")):
                k, place = np.unique(grams(data, offsets), return_inverse=True)
                held.append((b, row, end, data, offsets, place.astype(np.int32)))
                found.append(k)
        keys = np.sort(np.concatenate(found))
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]  # np.unique hashes, which takes twenty times as long
        values = np.frombuffer(b"".join(logs), np.float32)
        if len(values) != len(keys) or int(keys.sum().view(np.int64)) != check:
            raise RuntimeError("the table gave other rows when read again; write it down before it is scored")
        for (b, row, end, data, offsets, place), k in zip(held, found):
            each = values[np.searchsorted(keys, k)][place].astype(float)
            yield b, row, end, data, offsets, np.add.reduceat(each, offsets[:-1] + np.arange(end - row))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray, np.ndarray, np.ndarray]]:
        current, texts, logs, check = None, [], [], 0
        for b in batches:
            block, kind = np.asarray(b.column("block")), np.asarray(b.column("kind"))
            for a, z in _runs(2 * block + kind):
                if current is not None and block[a] != current:
                    yield from scored(texts, logs, check)
                    texts, logs, check = [], [], 0
                current = block[a]
                if kind[a]:
                    texts.append(b.slice(a, z - a))
                else:
                    logs += b.column("data").slice(a, z - a).to_pylist()
                    check = (check + sum(b.column("doc_id").slice(a, z - a).to_pylist()) + 2**63) % 2**64 - 2**63
        if current is not None:
            yield from scored(texts, logs, check)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, count = vocabulary.value
        weight = np.log10(count + 1.0)
        for b, row, end, data, offsets, score in blocks(batches):
            uid, ids, train = np.asarray(b.column("uid"))[row:end], b.column("doc_id").slice(row, end - row), np.asarray(b.column("train"))[row:end]
            starts, stops, first = words(data, offsets)
            h = span_hashes(LOWER[data], starts, stops)
            place, known = _find(common, h)
            sums = np.concatenate([[0.0], np.cumsum(np.where(known, weight[place] if len(weight) else 0.0, 0.0))])
            hits = np.concatenate([[0], np.cumsum(known & (count[place] > 0) if len(count) else known)])
            yield _block_rows(uid, hits[first[1:]] - hits[first[:-1]], sums[first[1:]] - sums[first[:-1]], (ids, np.diff(first) + 1, score))
            # Rare words; runs of one word in a text go as one row. Words of training texts have n > 0.
            rare = np.flatnonzero(~known)
            if not len(rare):
                continue
            owner = np.repeat(np.arange(end - row), np.diff(first))[rare]
            r = h[rare]
            head = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (owner[1:] != owner[:-1])]))
            n = np.diff(np.append(head, len(r))).astype(np.int32)
            owner, r = owner[head], r[head]
            for lo in range(0, len(r), 100_000):
                hi = min(lo + 100_000, len(r))
                o = owner[lo:hi]
                yield pa.RecordBatch.from_arrays([pa.array(r[lo:hi].view(np.int64)), pa.array(uid[o]), pa.array(np.where(train[o], n[lo:hi], -n[lo:hi]).astype(np.int32)), pa.nulls(hi - lo, pa.binary())], _NAMES)

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, uids, ns = [], [], []
        for b in batches:
            n = np.asarray(b.column("n"))
            rare = n != 0
            if not rare.all():
                yield b.filter(pa.array(~rare))
            keys.append(np.asarray(b.column("key"))[rare])
            uids.append(np.asarray(b.column("uid"))[rare])
            ns.append(n[rare])
        key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        if not len(key):
            return
        uid, n = np.concatenate(uids), np.concatenate(ns).astype(np.int64)
        order = np.argsort(key, kind="stable")
        key, uid, n = key[order], uid[order], n[order]
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        c = np.add.reduceat(np.maximum(n, 0), head)
        each = np.repeat(c, np.diff(np.append(head, len(key))))
        part, known = np.log10(each + 1.0) * np.abs(n), np.where(each > 0, np.abs(n), 0)
        order = np.argsort(uid, kind="stable")
        uid, part, known = uid[order], part[order], known[order]
        head = np.flatnonzero(np.concatenate([[True], uid[1:] != uid[:-1]]))
        yield _block_rows(uid[head], np.add.reduceat(known, head), np.add.reduceat(part, head))
        # Row number -1 carries the number of distinct rare words of the training texts.
        yield _block_rows(np.array([-1]), np.array([(c > 0).sum()]), np.zeros(1))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.frombuffer(x, np.int64).reshape(_FIELDS, -1) for b in batches for x in b.column("docs").to_pylist()]
        if not held:
            return
        given = np.concatenate(held, axis=1)
        uid, place = np.unique(given[0], return_inverse=True)
        known = np.zeros(len(uid), np.int64)
        np.add.at(known, place, given[4])
        part = np.bincount(place, given[5].view(float), len(uid))
        own = np.zeros((_FIELDS, len(uid)), np.int64)
        own[:, place[given[1] > 0]] = given[:, given[1] > 0]
        yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array(own[2], mask=own[1] != 1), pa.array(own[3]), pa.array(known), pa.array(part), pa.array(own[6].view(float))], ["uid", "doc_id", "n_tokens", "known", "part", "score"])

    texts = given.mapInArrow(dealt, _TEXT_SCHEMA)
    logs = score_grams(fitted, model).select("block", F.lit(0).alias("kind"), F.col("part").alias("uid"), F.col("check").alias("doc_id"), F.lit(False).alias("train"), F.lit(None).cast("string").alias("text"), "data")
    by_block = texts.unionAll(logs).repartition(n_parts, "block").sortWithinPartitions("block", "kind", "uid")
    met = by_block.mapInArrow(scan, _SCHEMA).repartition(n_parts, "key").mapInArrow(resolve, _SCHEMA).select("key", "docs")
    summed = materialise(met.repartition(n_parts, "key").mapInArrow(total, "uid long, doc_id long, n_tokens long, known long, part double, score double"), "lm-scores")
    discard(fitted)
    rare = summed.filter("uid = -1").agg(F.sum("known")).first()[0] or 0
    distinct = int((count > 0).sum()) + rare + (ends > 0)
    base = F.col("part") + F.lit(float(np.log10(ends + 1.0))) - F.col("n_tokens") * F.lit(float(np.log10(tokens + distinct + 1.0)))
    return summed.filter("uid >= 0").select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        "score",
    )
