"""SimHash near-duplicates found by a generalised pigeonhole.

Fingerprint: words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, every run of
four of them joined by single spaces (fewer words: all of them), XXH64 with seed 42 of
each, and bit b set if more than half of the hashes have it. No words: zero.

Two fingerprints within ``radius`` bits must agree, in a cut of the 64 bits into parts
with thresholds t_1 ... t_m that sum to ``radius - m + 1``, on some part i up to t_i bits (a
threshold of -1 leaves its part out). Bits that go together over the corpus share a part, so
that parts are as independent of each other as they can be, and the thresholds are found by
dynamic programming on the pairs each would produce, estimated from the histogram of the
part's values over all fingerprints.

Probing: equal fingerprints count once. For a part with threshold t each fingerprint writes one
key for every choice of t bits of the part, with these bits masked; two that differ there in
t bits or fewer share a key. A key's fingerprints are compared without writing out pairs:
small groups by shifted array comparison, large ones by growing clusters, where a cluster's
members are only compared with those outside of it. Both give a forest of verified links with
the same components as all links. Keys above ``block_rows`` are cut into blocks and every two
blocks meet in some task, so no task holds an unbounded group.

Components come from alternating large-star and small-star rounds over these links; each
round is a written table. Equal texts never make pairs.

Defined cases: null text counts as empty; all texts without words share fingerprint zero and are
linked; a null id sorts after every other; rows that repeat an id are in one component; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._text import LOWER, parts, words
from tessera.runtime import discard, materialise

# The five primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P2, 31) * _P1


def xxh64(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of data[start : start + length] for each span, spans of one length at a time."""
    out = np.empty(len(starts), np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    at8 = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    at4 = np.ndarray(len(data) + 1, "<u4", padded, strides=(1,))
    s = np.uint64(seed)
    order = np.argsort(lengths.astype(np.uint16) if len(lengths) and lengths.max() < 65536 else lengths, kind="stable")
    sizes, begin = np.unique(lengths[order], return_index=True)
    with np.errstate(over="ignore"):
        for n, lo, hi in zip(sizes.tolist(), begin, np.append(begin[1:], len(order))):
            p = starts[order[lo:hi]]
            i = 0
            if n >= 32:
                v = [np.full(len(p), x, np.uint64) for x in (s + _P1 + _P2, s + _P2, s, s - _P1)]
                while i + 32 <= n:
                    v = [_round(v[k], at8[p + i + 8 * k]) for k in range(4)]
                    i += 32
                h = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
                for x in v:
                    h = (h ^ _round(np.zeros(1, np.uint64), x)) * _P1 + _P4
            else:
                h = np.full(len(p), s + _P5, np.uint64)
            h = h + np.uint64(n)
            while i + 8 <= n:
                h = _rotl(h ^ _round(np.zeros(1, np.uint64), at8[p + i]), 27) * _P1 + _P4
                i += 8
            if i + 4 <= n:
                h = _rotl(h ^ (at4[p + i].astype(np.uint64) * _P1), 23) * _P2 + _P3
                i += 4
            while i < n:
                h = _rotl(h ^ (padded[p + i].astype(np.uint64) * _P5), 11) * _P1
                i += 1
            h = (h ^ (h >> np.uint64(33))) * _P2
            h = (h ^ (h >> np.uint64(29))) * _P3
            out[order[lo:hi]] = h ^ (h >> np.uint64(32))
    return out


def fingerprints(array: pa.Array, *, shingle: int = 4, seed: int = 42) -> np.ndarray:
    """64-bit SimHash of each text."""
    out = np.zeros(len(array), np.uint64)
    for row, end, data, offsets in parts(array):
        starts, ends, first = words(data, offsets)
        if not len(starts):
            continue
        # Words one space apart: word k sits at spaced[k].
        size = ends - starts
        spaced = np.cumsum(size + 1) - size - 1
        shift = starts - spaced
        joined = np.full(int(spaced[-1] + size[-1]), 0x20, np.uint8)
        take = np.repeat(spaced, size) + (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
        joined[take] = LOWER[data[take + np.repeat(shift, size)]]
        count = np.diff(first)
        n_shingles = np.where(count >= shingle, count - shingle + 1, np.minimum(count, 1))
        total = int(n_shingles.sum())
        local = np.arange(total) - np.repeat(np.cumsum(n_shingles) - n_shingles, n_shingles)
        head = np.repeat(first[:-1], n_shingles) + local
        tail = np.minimum(head + shingle, np.repeat(first[1:], n_shingles)) - 1
        h = xxh64(joined, spaced[head], spaced[tail] + size[tail] - spaced[head], seed)
        has = np.flatnonzero(n_shingles)
        cuts = (np.cumsum(n_shingles) - n_shingles)[has]
        value = np.zeros(len(has), np.uint64)
        half = n_shingles[has]
        for b in range(64):
            ones = np.add.reduceat((h >> np.uint64(b)) & np.uint64(1), cuts).astype(np.int64)
            value |= (2 * ones > half).astype(np.uint64) << np.uint64(b)
        out[row + has] = value
    return out


def fingerprint_table(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, row_col: str | None = None) -> DataFrame:
    @F.arrow_udf("long")
    def simhash(text: pa.Array) -> pa.Array:
        return pa.array(fingerprints(text, shingle=shingle).view(np.int64))

    return docs.select(*([row_col] if row_col else []), F.col(id_col).cast("long").alias("doc_id"), simhash(F.col(text_col)).alias("fp"))


# --- parts and thresholds -------------------------------------------------------------


def bit_moments(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and for how many of them each two bits are both set (64 by 64, summed by task)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((64, 64)), 0
        for b in batches:
            x = np.asarray(b.column(0)).view(np.uint64)
            bits = ((x[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)
            both += bits.T @ bits
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(4096), -1)), pa.array(np.append(both.ravel().astype(np.int64), n))], ["cell", "n"])

    rows = fps.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    found = {r[0]: r[1] for r in rows}
    return int(found.get(-1, 0)), np.array([found.get(i, 0) for i in range(4096)], float).reshape(64, 64)


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """Cut 64 bits into m parts of near-equal width, each grown from the free bits most correlated with it."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    r = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(r, 0)
    free, out = set(range(64)), []
    for i in range(m):
        width = 64 // m + (i < 64 % m)
        left = sorted(free)
        part = [left[int(np.argmax(r[np.ix_(left, left)].max(1)))]]
        free.remove(part[0])
        while len(part) < width:
            left = sorted(free)
            best = left[int(np.argmax(r[np.ix_(left, part)].sum(1)))]
            part.append(best)
            free.remove(best)
        out.append(sorted(part))
    return out


def allocate(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]] | None:
    """Thresholds, one a part, that sum to ``total`` at the least summed cost, by dynamic programming; None if none do."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for options in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for s, (c, picked) in best.items():
            for t, extra in options.items():
                if s + t not in new or c + extra < new[s + t][0]:
                    new[s + t] = (c + extra, [*picked, t])
        best = new
    return best.get(total)


def plan(fps: DataFrame, radius: int, *, key_cost: float = 200.0) -> tuple[list[list[int]], list[int]]:
    """Parts and thresholds with the least estimated work, over cuts into 2 to radius + 1 parts.

    ``key_cost`` is what one key costs (written, dealt, sorted) in units of one comparison.
    """
    n, both = bit_moments(fps)
    cuts = [group_bits(n, both, m) for m in range(2, radius + 2)]
    masks = [(k, _mask(part)) for k, part in enumerate(part for cut in cuts for part in cut)]
    keys = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for k, m in masks))).alias("x")
    same = fps.select(keys).groupBy("x.k", "x.v").agg(F.count(F.lit(1)).alias("n")).groupBy("k").agg(F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2)).collect()
    pairs, k, best = dict(same), 0, None
    for cut in cuts:
        costs = []
        for part in cut:
            options, near, width = {-1: 0.0}, 0, len(part)
            for t in range(min(radius, width - 1) + 1):
                near += _choose(width, t)
                if _choose(width, t) > 700:
                    break
                options[t] = n * _choose(width, t) * key_cost + pairs.get(k, 0.0) * near
            costs.append(options)
            k += 1
        found = allocate(costs, radius - len(cut) + 1)
        if found and (best is None or found[0] < best[0]):
            best = (found[0], cut, found[1])
    if best is None:
        raise ValueError(f"no cut of 64 bits finds all pairs within {radius} bits by at most 700 keys a part")
    return best[1], best[2]


def _mask(bits) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def _choose(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out


# --- probing and verification ---------------------------------------------------------


def probe_masks(cut: list[list[int]], thresholds: list[int]) -> list[int]:
    """What stays of a fingerprint in each of its keys."""
    out = []
    for part, t in zip(cut, thresholds):
        if t >= 0:
            out += [_mask(set(part) - set(c)) for c in combinations(part, t)]
    return out


def probe_keys(fps: DataFrame, masks: list[int]) -> DataFrame:
    """key, fp: one row for each fingerprint and mask."""
    m = np.array(masks, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.arange(len(m), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for b in batches:
            fp = np.asarray(b.column(0)).astype(np.int64)
            for lo in range(0, len(fp), max(1, 200_000 // len(m))):
                x = fp[lo : lo + max(1, 200_000 // len(m))]
                k = (x[:, None] & m).view(np.uint64) ^ number
                k = (k ^ (k >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
                k ^= k >> np.uint64(29)
                yield pa.RecordBatch.from_arrays([pa.array(k.ravel().view(np.int64)), pa.array(np.repeat(x, len(m)))], ["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key long, fp long")


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links that join two components when taken in order."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    up = list(range(len(nodes)))
    keep = []
    for i, (x, y) in enumerate(zip(flat[: len(a)].tolist(), flat[len(a) :].tolist())):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        while up[y] != y:
            up[y] = up[up[y]]
            y = up[y]
        if x != y:
            up[max(x, y)] = min(x, y)
            keep.append(i)
    return a[keep], b[keep]


def linked(keys: np.ndarray, fps: np.ndarray, radius: int, small: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Verified links among rows sorted by key, as a forest of each call's components."""
    found_a, found_b = [], []
    cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    size = np.diff(cuts)
    rest = np.flatnonzero(np.repeat((size > 1) & (size <= small), size))
    for d in range(1, small):
        rest = rest[rest + d < len(keys)]
        rest = rest[keys[rest + d] == keys[rest]]
        if not len(rest):
            break
        near = rest[np.bitwise_count((fps[rest] ^ fps[rest + d]).view(np.uint64)) <= radius]
        found_a.append(fps[near])
        found_b.append(fps[near + d])
    for lo, n in zip(cuts[:-1][size > small], size[size > small]):
        outside = np.unique(fps[lo : lo + n])
        while len(outside):
            frontier, outside = [outside[0]], outside[1:]
            while frontier and len(outside):
                x = frontier.pop()
                near = np.bitwise_count((outside ^ x).view(np.uint64)) <= radius
                if near.any():
                    got = outside[near]
                    found_a.append(np.full(len(got), x))
                    found_b.append(got)
                    frontier += list(got)
                    outside = outside[~near]
    if not found_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    return _forest(a[a != b], b[a != b])


def links(fps: DataFrame, radius: int, *, block_rows: int = 20_000) -> DataFrame:
    """a, b: links between distinct fingerprints whose components are those of all links."""
    cut, thresholds = plan(fps, radius)
    keys = written = materialise(probe_keys(fps, probe_masks(cut, thresholds)), "simhash-keys")
    heavy = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block_rows)
    heavy = materialise(heavy.withColumn("blocks", F.ceil(F.col("n") / block_rows).cast("long")), "simhash-heavy")
    if not heavy.isEmpty():
        own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
        other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        dealt = keys.join(heavy.select("key", "blocks"), "key", "left").withColumn("own", own).withColumn("other", other)
        keys = dealt.select(F.when(F.col("blocks").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))).alias("key"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, f = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            k, f = np.concatenate([k, np.asarray(b.column(0))]), np.concatenate([f, np.asarray(b.column(1))])
            change = np.flatnonzero(k[1:] != k[:-1])
            if len(change):
                end = change[-1] + 1
                x, y = linked(k[:end], f[:end], radius)
                k, f = k[end:], f[end:]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])
        x, y = linked(k, f, radius)
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    found = materialise(keys.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long").distinct(), "simhash-links")
    discard(written)
    return found


# --- components -----------------------------------------------------------------------


def components(edges: DataFrame, *, max_rounds: int = 200) -> DataFrame:
    """node, root (smallest node of its component) for every node of ``edges`` (a, b).

    Rounds grow with the logarithm of the longest chain; an error is raised should ``max_rounds`` not do.
    """
    now = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "star")
    seen = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = materialise(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "star")
        discard(now)
        now = new
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen or not state[0]:
            break
        seen = state
    else:
        raise RuntimeError(f"components are not complete after {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, *, radius: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, hot_rows: int = 10_000) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest id reachable over links).

    ``row_col`` names a unique column; it comes along in front, and ``first`` tells the one row of each
    component with the smallest id (null last), then the smallest ``row_col``.
    """
    prints = materialise(fingerprint_table(docs, id_col=id_col, text_col=text_col, shingle=shingle, row_col=row_col), "simhash")
    who = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", row_col) if row_col else F.col("doc_id")
    fps = materialise(prints.groupBy("fp").agg(F.min(who).alias("first_id"), F.count(F.lit(1)).alias("n")), "simhash-distinct")
    roots = materialise(components(links(fps, radius)).withColumnRenamed("node", "fp"), "simhash-roots")
    member = roots.join(fps.select("fp", "first_id"), "fp")
    first = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    joined = roots.join(first, "root").select("fp", "component_id")
    copies = fps.filter("n > 1").join(roots, "fp", "left_anti").select("fp", F.col("first_id").alias("component_id"))
    named = materialise(joined.unionByName(copies), "simhash-named")
    # Rows of hot fingerprints (at most one fingerprint for every ``hot_rows`` rows) meet a broadcast, the others are joined by it.
    hot = fps.filter(F.col("n") > hot_rows).select("fp").join(named, "fp").withColumnsRenamed({"fp": "hot_fp", "component_id": "hot_component"})
    n_hot = hot.count()
    if n_hot:
        prints = prints.join(F.broadcast(hot) if n_hot <= 1_000_000 else hot, F.col("fp") == F.col("hot_fp"), "left")
        prints = prints.withColumn("join_fp", F.when(F.col("hot_fp").isNull(), F.col("fp")).otherwise(F.xxhash64("doc_id", "fp")))
    else:
        prints = prints.withColumn("join_fp", F.col("fp")).withColumn("hot_component", F.lit(None).cast(named.schema["component_id"].dataType))
    found = prints.join(named.withColumnRenamed("fp", "join_fp"), "join_fp", "left").withColumn("component_id", F.coalesce("hot_component", "component_id"))
    component = F.coalesce("component_id", who)
    ids = ["doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")]
    if row_col is None:
        return found.select(*ids, component.alias("component_id"))
    return found.select(row_col, *ids, component["doc_id"].alias("component_id"), (F.col(row_col) == component[row_col]).alias("first"))
