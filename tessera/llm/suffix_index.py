"""Removal of long passages that occur more than once, with a logarithmic family of suffix indexes.

A byte goes if a string of ``LENGTH`` bytes covers it that starts anywhere else too, in the same text or another. A full suffix array
of all bytes would be several times the text, so the arrays here are sparse: of each string of ``LENGTH`` bytes the suffix at its
minimiser (its first least hash of ``GRAM`` bytes) is taken, which equal strings choose at the same place. That is one suffix for some 170 bytes,
and no string of that length is without one. The strings that chose a suffix lie around it in one stretch of bytes, its context.

Batches come to the family one by one. A batch gets its own array: its suffixes by their first ``GRAM`` bytes, then by context (as 64-bit numbers of either;
only equality counts), equal ones as one row with their number. The array is merge-scanned against every level that is there: suffixes equal
in both are long matches, which settle all strings of their context at once; suffixes that share the first bytes but not
the context may share some of their strings, and are marked. Levels made of equally many batches are merged, so that n
batches leave log n levels and each row is rewritten log n times.

Marked suffixes are settled on their bytes: one context of each kind is cut from its text and brought to the others with the same first bytes, and
strings are compared at each distance from the suffix. Copies of a context are one row before that, and first bytes shared by more than
``HOT`` different contexts are settled by grouping the 128-bit hashes of their strings instead, which no number of rows can make one task's work.

A text is known by its MD5, so copies of a text are worked out once and find their result by that key; no document id is needed.

Defined cases: a null text is empty; texts below ``LENGTH`` bytes stay as they are; a text that occurs twice goes as a whole, in both places; what is left
may begin or end within a character, so it is binary; null and repeated ids and clashing column names are carried through; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm._frames import aside
from tessera.llm._text import parts, span_hashes
from tessera.runtime import discard, materialise, release_shuffles

LENGTH, GRAM = 400, 64
#: Contexts with the same first bytes that one task compares.
HOT = 4096
_SLICE = 1 << 19
#: Bytes of text that one set of arrays is made for; they take some 100 bytes a byte.
_PART = 1 << 18
#: Keys of more than one row in so many meet a broadcast; there are no more of them than this.
_HEAVY = 1000
_PLACE = np.uint64((1 << 24) - 1)
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def chosen_suffixes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, place, first, last, gram): the suffixes that the strings of ``LENGTH`` bytes within each text choose, the first and last
    string that chose each, and the hash of their first bytes. Places count from the beginning of ``data``, of 16 MB at most."""
    n = len(data)
    if n < LENGTH:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    begin = np.arange(n - GRAM + 1)
    hashes = span_hashes(data, begin, begin + GRAM)
    least = (hashes & ~_PLACE) | begin.astype(np.uint64)
    width, over = 1, LENGTH - GRAM + 1
    while width * 2 <= over:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    count = n - LENGTH + 1
    place = (np.minimum(least[:count], least[over - width : over - width + count]) & _PLACE).astype(np.int64)
    inside = np.zeros(n + 1, np.int64)
    long = np.diff(offsets) >= LENGTH
    np.add.at(inside, offsets[:-1][long], 1)
    np.add.at(inside, offsets[1:][long] - LENGTH + 1, -1)
    string = np.flatnonzero(np.cumsum(inside[:count]))
    if not len(string):
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    place = place[string]
    new = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (string[1:] != string[:-1] + 1)))
    last = string[np.append(new[1:], len(string)) - 1]
    place, first = place[new], string[new]
    return np.searchsorted(offsets, place, side="right") - 1, place, first, last, hashes[place]


def _sliced(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """A part of texts as it is, or slices of one long text that overlap so that each string lies in one of them."""
    if len(data) <= _SLICE + LENGTH:
        yield 0, data, offsets
        return
    for low in range(0, len(data) - LENGTH + 1, _SLICE):
        piece = data[low : low + _SLICE + LENGTH - 1]
        yield low, piece, np.array([0, len(piece)])


def suffixes(texts: DataFrame) -> DataFrame:
    """gram, context, key, place, near, far of each chosen suffix of ``texts`` (key binary, text): the hashes of its first bytes and of its context,
    its byte in the text, and how far before it the nearest and farthest string begins that chose it."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, _, data, offsets in parts(batch.column("text"), _PART):
                for low, piece, cuts in _sliced(data, offsets):
                    text, place, first, last, gram = chosen_suffixes(piece, cuts)
                    view = memoryview(np.ascontiguousarray(piece))
                    context = np.fromiter((xxhash.xxh3_64_intdigest(view[a : b + LENGTH], f) for a, b, f in zip(first.tolist(), last.tolist(), (place - first).tolist())), np.uint64, len(place))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(gram.view(np.int64)),
                            pa.array(context.view(np.int64)),
                            batch.column("key").take(pa.array(row + text)),
                            pa.array(place - cuts[text] + low),
                            pa.array((place - last).astype(np.int16)),
                            pa.array((place - first).astype(np.int16)),
                        ],
                        ["gram", "context", "key", "place", "near", "far"],
                    )

    return texts.select("key", "text").mapInArrow(read, "gram long, context long, key binary, place long, near short, far short")


class IndexFamily:
    """Levels of suffix arrays (gram, context, n), and the scans that together hold every pair of batches."""

    def __init__(self) -> None:
        self.batches = 0
        self.levels: dict[int, tuple[frozenset[int], DataFrame]] = {}
        self.scans: list[tuple[frozenset[int], DataFrame]] = []

    def add(self, batch: DataFrame) -> None:
        """Take in the suffixes (gram, context) of a batch: merge its array with levels of its size, scan the result against the others."""
        mine = frozenset([self.batches])
        self.batches += 1
        array = materialise(batch.groupBy("gram", "context").agg(F.count(F.lit(1)).alias("n")).sortWithinPartitions("gram", "context"), "suffix-array")
        rank, merged, within = 0, array, mine
        while rank in self.levels:
            others, level = self.levels.pop(rank)
            merged, lower = materialise(self._scan(merged, level).sortWithinPartitions("gram", "context"), "suffix-level"), merged
            within |= others
            discard(level)
            discard(lower)
            rank += 1
        scans = [(within | others, self._scan(merged, level)) for others, level in self.levels.values()] or [(within, merged)]
        self.scans = [old for old in self.scans if not any(old[0] <= new for new, _ in scans)] + scans  # the rest is found again
        self.levels[rank] = (within, merged)

    @staticmethod
    def _scan(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.unionByName(b).groupBy("gram", "context").agg(F.sum("n").alias("n"))

    def all_levels(self) -> DataFrame:
        """gram, context, n of every suffix taken in, in one row a level."""
        return _all([level for _, level in self.levels.values()])

    def long_matches(self) -> DataFrame:
        """gram, context of each suffix whose whole context occurs again."""
        return _all([s.filter("n > 1").select("gram", "context") for _, s in self.scans]).distinct()

    def shared_beginnings(self) -> DataFrame:
        """gram, contexts, open: first bytes with several contexts, their least number, and whether one of these has no equal."""
        kinds = [s.groupBy("gram").agg(F.count(F.lit(1)).alias("contexts"), (F.min("n") == 1).alias("open")) for _, s in self.scans]
        return _all([k.filter("contexts > 1") for k in kinds]).groupBy("gram").agg(F.max("contexts").alias("contexts"), F.bool_or("open").alias("open"))


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _contexts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """gram, key, place, near, far, bytes: the context of each wanted suffix, cut from its text."""
    lists = wanted.groupBy("key").agg(F.collect_list(F.struct("gram", "place", "near", "far")).alias("cuts"))
    joined = texts.dropDuplicates(["key"]).join(lists, "key")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column("text")[i].as_buffer()
                cuts = batch.column("cuts")[i].values
                gram, place, near, far = (cuts.field(c) for c in ("gram", "place", "near", "far"))
                spans = zip(place.to_pylist(), near.to_pylist(), far.to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [gram, pa.array([batch.column("key")[i].as_py()] * len(cuts), pa.binary()), place, near, far, pa.array([text[p - f : p - n + LENGTH].to_pybytes() for p, n, f in spans], pa.binary())],
                    ["gram", "key", "place", "near", "far", "bytes"],
                )

    return joined.mapInArrow(cut, "gram long, key binary, place long, near short, far short, bytes binary")


def _common(x: bytes, y: bytes, backwards: bool = False) -> int:
    """Length of the common beginning (or end) of two byte strings."""
    low, high = 0, min(len(x), len(y))
    while low < high:
        mid = (low + high + 1) // 2
        same = x[len(x) - mid :] == y[len(y) - mid :] if backwards else x[:mid] == y[:mid]
        low, high = (mid, high) if same else (low, mid - 1)
    return low


def repeated_strings(contexts: list[tuple[bytes, int, int]]) -> list[np.ndarray]:
    """For each context (bytes, near, far) of suffixes with the same first bytes, which of its strings, from the farthest on, another context has too."""
    hit = [np.zeros(far - near + 1, bool) for _, near, far in contexts]
    if len(contexts) <= 32:
        for i, (x, x_near, x_far) in enumerate(contexts):
            for j in range(i):
                y, y_near, y_far = contexts[j]
                before, behind = _common(x[:x_far], y[:y_far], backwards=True), _common(x[x_far:], y[y_far:])
                near, far = max(x_near, y_near, LENGTH - behind), min(x_far, y_far, before)
                if near <= far:
                    hit[i][x_far - far : x_far - near + 1] = True
                    hit[j][y_far - far : y_far - near + 1] = True
        return hit
    for distance in range(min(n for _, n, _ in contexts), max(f for _, _, f in contexts) + 1):
        seen: dict[bytes, int] = {}
        for i, (x, near, far) in enumerate(contexts):
            if near <= distance <= far:
                j = seen.setdefault(x[far - distance : far - distance + LENGTH], i)
                if j != i:
                    hit[i][far - distance] = hit[j][contexts[j][2] - distance] = True
    return hit


_SPANS = "key binary, start long, end long"


def _span_rows(keys: list, starts: list[int], ends: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["key", "start", "end"])


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of repeated strings, from contexts sorted by their first bytes."""
    held: list[tuple] = []

    def spans() -> pa.RecordBatch:
        keys, starts, ends = [], [], []
        for (_, key, place, _, far, _), hit in zip(held, repeated_strings([(r[5], r[3], r[4]) for r in held])):
            edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
            for a, b in edges.reshape(-1, 2).tolist():
                keys.append(key)
                starts.append(place - far + a)
                ends.append(place - far + b - 1 + LENGTH)
        return _span_rows(keys, starts, ends)

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("gram", "key", "place", "near", "far", "bytes"))):
            if held and held[0][0] != row[0]:
                yield spans()
                held = []
            held.append(row)
    if held:
        yield spans()


def _hot_spans(contexts: DataFrame) -> DataFrame:
    """The same for first bytes with many contexts: strings as rows, grouped by hash."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, place, near, far, context in zip(*(batch.column(c).to_pylist() for c in ("key", "place", "near", "far", "bytes"))):
                sums = [xxhash.xxh3_128_digest(context[i : i + LENGTH]) for i in range(far - near + 1)]
                yield pa.RecordBatch.from_arrays([pa.array(sums, pa.binary()), pa.array([key] * len(sums), pa.binary()), pa.array(range(place - far, place - near + 1), pa.int64())], ["string", "key", "start"])

    rows = contexts.mapInArrow(strings, "string binary, key binary, start long")
    again = rows.groupBy("string").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("string")
    return rows.join(again, "string", "left_semi").select("key", "start", (F.col("start") + LENGTH).alias("end"))


def _told(left: DataFrame, right: DataFrame, keys: list[str], heavy: DataFrame) -> DataFrame:
    """``left`` with the columns of ``right``, which is unique by ``keys``; rows of the ``heavy`` keys stay where they are."""
    more = [c for c in right.columns if c not in keys]
    known = heavy.join(right, keys, "left").select(*keys, F.struct(*more).alias("_told"))
    met = left.join(F.broadcast(known), keys, "left")
    hot = met.filter("_told IS NOT NULL").select(*left.columns, *(F.col(f"_told.{c}").alias(c) for c in more))
    return met.filter("_told IS NULL").select(*left.columns).join(right, keys, "left").unionByName(hot)


def repeated_spans(texts: DataFrame, *, batches: int = 4, hot: int = HOT) -> DataFrame:
    """key, spans: for each text of ``texts`` (key binary, text) with repeated strings the stretches that they cover, which may overlap."""
    found = materialise(suffixes(texts), "suffixes")
    family = IndexFamily()
    for b in range(batches):
        family.add(found.filter(F.pmod(F.xxhash64("key"), F.lit(batches)) == b).select("gram", "context"))
    least = found.count() // _HEAVY
    arrays = family.all_levels()
    heavy_grams = materialise(arrays.groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") > least).select("gram"), "suffix-heavy")
    heavy = materialise(arrays.groupBy("gram", "context").agg(F.sum("n").alias("n")).filter(F.col("n") > least).select("gram", "context"), "suffix-heavy")
    matches = family.long_matches().withColumn("long", F.lit(True))
    shared = materialise(family.shared_beginnings().filter("open").select("gram", (F.col("contexts") > hot).alias("hot")), "suffix-shared")
    kinds = _told(arrays.select("gram", "context").distinct(), shared, ["gram"], heavy_grams).join(matches, ["gram", "context"], "left").filter("long OR hot IS NOT NULL")
    kinds = materialise(kinds, "suffix-kinds")
    marked = materialise(_told(found, kinds, ["gram", "context"], heavy).filter("long OR hot IS NOT NULL"), "suffix-marks")
    for table in (found, *(level for _, level in family.levels.values()), heavy_grams, heavy, shared, kinds):
        discard(table)
    del family, arrays, matches, shared, kinds
    release_shuffles(texts.sparkSession)

    wanted = marked.filter("hot IS NOT NULL").groupBy("gram", "context", "hot").agg(F.min(F.struct("key", "place", "near", "far")).alias("s")).select("gram", "s.*", "hot")
    wanted = materialise(wanted, "suffix-wanted")
    n_hot = wanted.filter("hot").limit(1).count()
    contexts = _contexts(texts, wanted.filter("NOT hot"))
    spans = contexts.repartition("gram").sortWithinPartitions("gram").mapInArrow(_settle, _SPANS)
    if n_hot:
        spans = spans.unionByName(_hot_spans(_contexts(texts, wanted.filter("hot"))))
    whole = marked.filter("long").select("key", (F.col("place") - F.col("far")).alias("start"), (F.col("place") - F.col("near") + LENGTH).alias("end")).distinct()
    spans = materialise(spans.unionByName(whole).groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("found")), "suffix-spans")
    discard(marked)
    discard(wanted)
    release_shuffles(texts.sparkSession)
    return spans


def _cut_out(text: pa.Scalar, found: pa.Scalar) -> tuple[bytes, int, list[dict]]:
    """What is left of a text, how many bytes went, and the merged spans."""
    data = memoryview(text.as_buffer()) if text.is_valid else memoryview(b"")
    merged: list[tuple[int, int]] = []
    if found.is_valid:
        start, end = (found.values.field(c).to_numpy() for c in ("start", "end"))
        order = np.argsort(start, kind="stable")
        start, end = start[order], np.maximum.accumulate(end[order])
        new = np.flatnonzero(np.append(True, start[1:] > end[:-1]))
        merged = list(zip(start[new].tolist(), end[np.append(new[1:], len(end)) - 1].tolist()))
    edges = [0, *(x for span in merged for x in span), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])), sum(b - a for a, b in merged), [{"start": a, "end": b} for a, b in merged]


def remove_repeats(docs: DataFrame, *, text_col: str = "text", batches: int = 4, hot: int = HOT) -> DataFrame:
    """``docs`` with kept (binary), n_bytes, n_removed and the removed ``spans`` of each text, in bytes."""
    names = ["kept", "n_bytes", "n_removed", "spans"]
    source = text_col + "_in" if text_col in names else text_col
    text = F.coalesce(F.col(f"`{source}`"), F.lit(""))
    docs = aside(docs, [*names, "_key", "_found"])
    texts = docs.select(F.unhex(F.md5(text)).alias("key"), text.alias("text")).filter(F.octet_length("text") >= LENGTH)
    spans = repeated_spans(texts, batches=batches, hot=hot).select(F.col("key").alias("_key"), F.col("found").alias("_found"))
    joined = docs.join(spans, F.unhex(F.md5(text)) == F.col("_key"), "left").drop("_key")
    columns = docs.columns

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            said, found = batch.column(source), batch.column("_found")
            for low in range(0, batch.num_rows, 256):  # 256 texts are copied at a time
                piece = batch.slice(low, 256)
                kept, gone, of_text = zip(*map(_cut_out, said.slice(low, 256), found.slice(low, 256)))
                sizes = [len(k) + g for k, g in zip(kept, gone)]
                more = [pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(of_text, _SPAN)]
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in columns), *more], [*columns, *names])

    out = T.StructType([*docs.schema.fields, *T.StructType.fromDDL("kept binary, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>").fields])
    return joined.mapInArrow(cut, out)


def removed_digests(docs: DataFrame) -> DataFrame:
    out = remove_repeats(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
