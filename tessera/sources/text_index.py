"""Stored full-text index: positional postings in sorted segments, searched without reading the texts.

A segment holds two tables. ``docs`` has one row a document (range, slot, id, length, text): 1,024 documents at most share a range,
a slot tells them apart. ``blocks`` has the postings of one token in one range (token, range, n, max_tf, min_len, docs), sorted by token and cut into
files by token, so a search reads the row groups of its own tokens. Blocks of all tokens are cut at the same ranges: the best score that any document of a range can have is a sum over
its blocks' ``max_tf`` and ``min_len``, and once a page of hits is known, ranges that can't reach its last score are not opened.

Nothing is changed in place. New documents make a new segment, removed ones a tombstone (range, slot, length), a replaced
document is both. Segments of like size are merged, without reading a text again, when there are ``FANOUT`` of them; that drops
their tombstones. Each change ends with a new manifest, so a reader sees one state throughout; there is one writer at a time.

A query is a list of :class:`Term`: whole tokens, prefixes and phrases, all of which a document must hold. Scores are BM25 over live documents.
Defined cases: a null text has no token; null and repeated ids are documents of their own, and removing an id removes all of them; a term without tokens finds nothing.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.runtime import discard, materialise, path_exists

SLOT_BITS = 10
#: Segments of one size class that are merged; sizes of a class differ by this factor at most.
FANOUT = 4
#: Tokens of a range that are sorted into blocks at a time; a longer document stands alone.
CHUNK = 1_000_000
#: Ranges that the first look at a page opens, for each hit asked for.
LOOK = 2
K1, B = 1.2, 0.75
_BLOCK = "token string, range long, n int, max_tf int, min_len int, docs array<struct<slot:int,length:int,positions:array<int>>>"
_PIECE = "segment string, docs long, tokens long, grave string"


class Term(NamedTuple):
    """Tokens in a row; the last may be the beginning of a token."""

    tokens: tuple[str, ...]
    prefix: bool = False


def prefixes(raw: str) -> list[Term]:
    """A query of raw words, each a prefix; stop words and single letters are left out."""
    return [Term((t,), prefix=True) for t in T.query_terms(raw)]


def words(raw: str) -> list[Term]:
    return [Term((t,)) for t in T.query_terms(raw)]


def phrase(raw: str) -> list[Term]:
    return [Term(tuple(raw.lower().split()))]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in pieces: one range each, in parts of about ``CHUNK`` tokens, whatever the size of a batch."""
    for batch in batches:
        lengths = batch.column("tokens").value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ranges, before = batch.column("range").to_numpy(), np.cumsum(lengths) - lengths
        begins = np.flatnonzero(np.append(True, ranges[1:] != ranges[:-1])) if len(ranges) else np.zeros(0, int)
        part = (before - np.repeat(before[begins], np.diff(np.append(begins, len(ranges))))) // CHUNK
        cuts = [0, *(np.flatnonzero((np.diff(part) != 0) | (np.diff(ranges) != 0)) + 1).tolist(), len(lengths)]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def _to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of each token in the documents of each range, from rows (range, slot, tokens); a range that lies in two pieces has two blocks of a token."""
    for batch in _chunks(batches):
        tokens, ranges, slots = batch.column("tokens"), batch.column("range").to_numpy(), batch.column("slot").to_numpy().astype(np.int32)
        lengths = tokens.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        said = tokens.flatten().dictionary_encode()
        if not len(said):
            continue
        doc = np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(len(doc)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        code = said.indices.to_numpy()
        order = np.lexsort((np.arange(len(doc)), ranges[doc], code))
        code, doc, place = code[order], doc[order], place[order].astype(np.int32)
        new_doc = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])))
        tf = np.diff(np.append(new_doc, len(doc)))
        of_doc, of_code = doc[new_doc], code[new_doc]
        new_block = np.flatnonzero(np.append(True, (of_code[1:] != of_code[:-1]) | (ranges[of_doc[1:]] != ranges[of_doc[:-1]])))
        length = lengths[of_doc].astype(np.int32)
        positions = pa.ListArray.from_arrays(pa.array(np.append(new_doc, len(doc)).astype(np.int32)), pa.array(place))
        docs = pa.StructArray.from_arrays([pa.array(slots[of_doc]), pa.array(length), positions], ["slot", "length", "positions"])
        yield pa.RecordBatch.from_arrays(
            [
                said.dictionary.take(pa.array(of_code[new_block])),
                pa.array(ranges[of_doc[new_block]]),
                pa.array(np.diff(np.append(new_block, len(of_doc))).astype(np.int32)),
                pa.array(np.maximum.reduceat(tf, new_block).astype(np.int32)),
                pa.array(np.minimum.reduceat(length, new_block)),
                pa.ListArray.from_arrays(pa.array(np.append(new_block, len(of_doc)).astype(np.int32)), docs),
            ],
            ["token", "range", "n", "max_tf", "min_len", "docs"],
        )


class TextIndex:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    # --- state ---

    def version(self) -> int:
        at = f"{self.root}/current"
        return self.spark.read.schema("version long").parquet(at).agg(F.max("version")).first()[0] or 0 if path_exists(self.spark, at) else 0

    def _pieces(self, version: int | None = None) -> list[tuple[str, int, int, str]]:
        """(segment, docs, tokens, grave) of the live segments and of the tombstone tables (no segment, negative counts)."""
        v = self.version() if version is None else version
        return [tuple(r) for r in self.spark.read.schema(_PIECE).parquet(f"{self.root}/manifest/v={v}").collect()] if v else []

    def _commit(self, pieces: list[tuple[str, int, int, str]]) -> int:
        v = self.version() + 1
        self.spark.createDataFrame(pieces, _PIECE).coalesce(1).write.parquet(f"{self.root}/manifest/v={v}")
        self.spark.createDataFrame([(v,)], "version long").coalesce(1).write.mode("append").parquet(f"{self.root}/current")
        return v

    def _table(self, pieces: list, name: str) -> DataFrame:
        paths = [f"{self.root}/{s}/{name}" for s, *_ in pieces if s]
        schema = _BLOCK if name == "blocks" else "range long, slot int, id long, length int, text string"
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _graves(self, pieces: list) -> DataFrame | None:
        paths = [f"{self.root}/{g}" for *_, g in pieces if g]
        return self.spark.read.schema("range long, slot int, length int").parquet(*paths) if paths else None

    # --- changes ---

    def add(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> int:
        return self.change(docs, None, id_col=id_col, text_col=text_col)

    def remove(self, ids: DataFrame, *, id_col: str = "doc_id") -> int:
        return self.change(None, ids, id_col=id_col)

    def replace(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> int:
        return self.change(docs, docs, id_col=id_col, text_col=text_col)

    def change(self, new: DataFrame | None, gone: DataFrame | None, *, id_col: str = "doc_id", text_col: str = "text") -> int:
        """Documents with the ids of ``gone`` go and those of ``new`` come, as one version."""
        pieces = self._pieces()
        if gone is not None and pieces:
            pieces = pieces + self._bury(pieces, gone.select(F.col(id_col).cast("long").alias("id")).distinct())
        if new is not None:
            pieces = pieces + self._write(new.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), self.version() + 1)
        return self._commit(self._merge_like_sizes(pieces))

    def _bury(self, pieces: list, ids: DataFrame) -> list:
        dead = self._table(pieces, "docs").join(ids, "id", "left_semi").select("range", "slot", "length")
        graves = self._graves(pieces)
        if graves is not None:
            dead = dead.join(graves, ["range", "slot"], "left_anti")
        name = f"graves-{uuid.uuid4().hex}"
        dead.write.parquet(f"{self.root}/{name}")
        n, tokens = self.spark.read.schema("range long, slot int, length int").parquet(f"{self.root}/{name}").agg(F.count(F.lit(1)), F.sum(F.col("length").cast("long"))).first()
        return [("", -n, -(tokens or 0), name)] if n else []

    def _write(self, docs: DataFrame, number: int) -> list:
        name = f"segment-{uuid.uuid4().hex}"
        tokens = T.search_tokens(F.coalesce("text", F.lit("")))
        place = F.monotonically_increasing_id()
        placed = docs.withColumn("place", place).select(
            (F.shiftright("place", SLOT_BITS) + F.lit(number << 42)).alias("range"), F.col("place").bitwiseAND((1 << SLOT_BITS) - 1).cast("int").alias("slot"), "id", F.size(tokens).alias("length"), "text"
        )
        placed.write.parquet(f"{self.root}/{name}/docs")
        stored = self._table([(name,)], "docs")
        blocks = materialise(stored.select("range", "slot", tokens.alias("tokens")).mapInArrow(_to_blocks, _BLOCK), "blocks")
        self._write_blocks(blocks, name)
        discard(blocks)
        n, total = stored.agg(F.count(F.lit(1)), F.sum(F.col("length").cast("long"))).first()
        return [(name, n, total or 0, "")]

    def _write_blocks(self, blocks: DataFrame, name: str) -> None:
        blocks.repartitionByRange("token", "range").sortWithinPartitions("token", "range").write.parquet(f"{self.root}/{name}/blocks")

    def _merge_like_sizes(self, pieces: list) -> list:
        while True:
            classes: dict[int, list] = {}
            for p in pieces:
                if p[0]:
                    classes.setdefault(int(math.log(p[1] + 1, FANOUT)), []).append(p)
            full = next((c for c in classes.values() if len(c) >= FANOUT), None)
            if full is None:
                return pieces
            pieces = self._merge(pieces, full)

    def merge(self) -> int:
        """All segments become one and tombstones go."""
        pieces = self._pieces()
        return self._commit(self._merge(pieces, [p for p in pieces if p[0]]))

    def _merge(self, pieces: list, merged: list) -> list:
        """``pieces`` with the segments ``merged`` as one, their dead documents left out; the others keep their tombstones."""
        name, graves = f"segment-{uuid.uuid4().hex}", self._graves(pieces)
        docs, blocks = self._table(merged, "docs"), self._table(merged, "blocks")
        if graves is not None:
            docs = docs.join(graves, ["range", "slot"], "left_anti")
            dead = graves.groupBy("range").agg(F.collect_set("slot").alias("dead"))  # 1,024 slots at most
            live = F.filter("docs", lambda d: ~F.coalesce(F.array_contains("dead", d["slot"]), F.lit(False)))
            blocks = blocks.join(dead, "range", "left").withColumn("docs", live).filter(F.size("docs") > 0)
            tf, length = F.transform("docs", lambda d: F.size(d["positions"])), F.transform("docs", lambda d: d["length"])
            blocks = blocks.select("token", "range", F.size("docs").alias("n"), F.array_max(tf).alias("max_tf"), F.array_min(length).alias("min_len"), "docs")
        docs.select("range", "slot", "id", "length", "text").write.parquet(f"{self.root}/{name}/docs")
        self._write_blocks(blocks, name)
        stored = self._table([(name,)], "docs")
        n, tokens = stored.agg(F.count(F.lit(1)), F.sum(F.col("length").cast("long"))).first()
        rest = [p for p in pieces if p not in merged]
        if graves is None:
            return [*rest, (name, n, tokens or 0, "")]
        others = [p for p in rest if p[0]]
        kept = graves.join(self._table(others, "docs").select("range", "slot"), ["range", "slot"], "left_semi") if others else graves.limit(0)
        grave = f"graves-{uuid.uuid4().hex}"
        kept.write.parquet(f"{self.root}/{grave}")
        m, lost = self.spark.read.schema("range long, slot int, length int").parquet(f"{self.root}/{grave}").agg(F.count(F.lit(1)), F.sum(F.col("length").cast("long"))).first()
        return [*others, (name, n, tokens or 0, ""), *([("", -m, -(lost or 0), grave)] if m else [])]

    # --- reading ---

    def _blocks(self, pieces: list, terms: list[Term]) -> DataFrame:
        """Blocks of every token that some term holds; the filter is one that Parquet's statistics answer."""
        wanted = F.lit(False)
        for term in terms:
            for i, token in enumerate(term.tokens):
                wanted = wanted | _token_is(token, term.prefix and i == len(term.tokens) - 1)
        return self._table(pieces, "blocks").filter(wanted)

    def _hits(self, blocks: DataFrame, terms: list[Term], graves: DataFrame | None) -> DataFrame:
        """range, slot, length, f0, f1 ... and first: how often each live document holds each term, and the least place of a term."""
        rows = blocks.select("token", "range", F.explode("docs").alias("d")).select("token", "range", "d.slot", "d.length", "d.positions")
        aggs, counts = [], []
        for i, term in enumerate(terms):
            for j, token in enumerate(term.tokens):
                held = F.when(_token_is(token, term.prefix and j == len(term.tokens) - 1), F.col("positions"))
                aggs.append(F.array_sort(F.flatten(F.collect_list(held))).alias(f"p{i}_{j}"))
            begins = F.col(f"p{i}_0")
            for j in range(1, len(term.tokens)):
                begins = F.array_intersect(begins, _back(f"p{i}_{j}", j))
            counts.append(begins.alias(f"at{i}"))
        found = rows.groupBy("range", "slot", "length").agg(*aggs).select("range", "slot", "length", *counts)
        found = found.filter(" AND ".join(f"size(at{i}) > 0" for i in range(len(terms))) or "false")
        if graves is not None:
            found = found.join(graves.select("range", "slot"), ["range", "slot"], "left_anti")
        least = F.array_min(F.array(*(F.array_min(f"at{i}") for i in range(len(terms))))) if terms else F.lit(None).cast("int")
        return found.select("range", "slot", "length", *(F.size(f"at{i}").alias(f"f{i}") for i in range(len(terms))), least.alias("first"))

    def _holders(self, pieces: list, terms: list[Term], graves: DataFrame | None) -> list[int]:
        """How many live documents hold each term."""
        out = []
        for term in terms:
            blocks = self._blocks(pieces, [term])
            if len(term.tokens) == 1 and not term.prefix and graves is None:
                out.append(blocks.agg(F.sum("n")).first()[0] or 0)
            elif len(term.tokens) == 1:
                docs = blocks.select("range", F.explode("docs.slot").alias("slot")).distinct()
                out.append((docs if graves is None else docs.join(graves.select("range", "slot"), ["range", "slot"], "left_anti")).count())
            else:
                out.append(self._hits(blocks, [term], graves).count())
        return out

    def count(self, terms: list[Term]) -> int:
        """How many documents hold all terms."""
        pieces = self._pieces()
        return self._hits(self._blocks(pieces, terms), terms, self._graves(pieces)).count() if terms else 0

    def search(self, terms: list[Term], *, limit: int | None = 20, offset: int = 0, snippets: bool = False) -> DataFrame:
        """id, score (and snippet), best first; ties by id. Without ``limit`` every hit."""
        pieces = self._pieces()
        graves = self._graves(pieces)
        total, tokens = sum(p[1] for p in pieces), sum(p[2] for p in pieces)
        mean = tokens / total if total and tokens else 1.0
        weights = [math.log(1 + (total - df + 0.5) / (df + 0.5)) for df in self._holders(pieces, terms, graves)]
        blocks = self._blocks(pieces, terms)

        def score(tf: list[Column], length: Column) -> Column:
            s = F.lit(0.0)
            for w, f in zip(weights, tf):
                s = s + w * f * (K1 + 1) / (f + K1 * (1 - B + B * length / mean))
            return s

        def scored(of: DataFrame) -> DataFrame:
            hits = self._hits(of, terms, graves)
            return hits.withColumn("score", F.round(score([F.col(f"f{i}") for i in range(len(terms))], F.col("length")), 6))

        if limit is not None and terms:
            blocks = self._within_reach(blocks, terms, score, scored, limit + offset)
        hits = scored(blocks)
        names = self._table(pieces, "docs")
        hits = hits.join(names.select("range", "slot", "id", *(["text"] if snippets else [])), ["range", "slot"])
        out = hits.orderBy(F.desc("score"), "id")
        if limit is not None:
            out = out.offset(offset).limit(limit)
        return out.select("id", "score", *([snippet(F.col("text"), F.col("first"), terms).alias("snippet")] if snippets else []))

    def _within_reach(self, blocks: DataFrame, terms: list[Term], score, scored, wanted: int) -> DataFrame:
        """The blocks of ranges whose best possible score reaches that of the last hit wanted."""
        best = []
        for i, term in enumerate(terms):
            # A phrase is no more frequent than its first token; a prefix no more than all its tokens together.
            token = _token_is(term.tokens[0], term.prefix and len(term.tokens) == 1)
            best.append(F.sum(F.when(token, F.col("max_tf"))).alias(f"f{i}"))
        by_range = blocks.groupBy("range").agg(F.min("min_len").alias("length"), *best)
        by_range = by_range.filter(" AND ".join(f"f{i} > 0" for i in range(len(terms))))
        by_range = by_range.select("range", score([F.col(f"f{i}") for i in range(len(terms))], F.col("length")).alias("bound"))
        look = by_range.orderBy(F.desc("bound"), "range").limit(LOOK * wanted).select("range")
        first = scored(blocks.join(F.broadcast(look), "range", "left_semi")).orderBy(F.desc("score")).limit(wanted).select("score").collect()
        if len(first) < wanted:
            return blocks
        least = first[-1]["score"] - 1e-6
        return blocks.join(by_range.filter(F.col("bound") >= least).select("range"), "range", "left_semi")


def _token_is(token: str, prefix: bool) -> Column:
    if not prefix:
        return F.col("token") == token
    return F.col("token").startswith(token)


def _back(places: str, by: int) -> Column:
    return F.transform(places, lambda p: p - by)


def snippet(text: Column, first: Column, terms: list[Term], *, width: int = 8) -> Column:
    """``width`` words around the word number ``first``, two before it, with the words of a term in brackets."""
    said = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+)"), 1)
    start = F.greatest(first - 2, F.lit(0))
    hit = F.lit(False)

    def mark(w: Column) -> Column:
        low, found = F.lower(w), hit
        for term in terms:
            for i, t in enumerate(term.tokens):
                found = found | (low.startswith(t) if term.prefix and i == len(term.tokens) - 1 else low == t)
        return F.when(found, F.concat(F.lit("["), w, F.lit("]"))).otherwise(w)

    shown = F.array_join(F.transform(F.slice(said, start + 1, width), mark), " ")
    return F.concat(F.when(start > 0, "...").otherwise(""), shown, F.when(start + width < F.size(said), "...").otherwise(""))
