"""Text vectors by signed feature hashing, and an inverted file that finds the nearest.

Features of a text (its tokens, their stems, the pieces of identifiers, runs of three characters, neighbours and neighbours but one, the acronym, groups of words that tell
what code is about) become rows in the JVM; an MD5 gives each a dimension and a sign, one aggregation sums them and scales the vector to length 1. Texts are dealt
by id once, so features are summed where they arise; Python only lays the parts of a vector out.

The inverted file has one list for each of a bounded number of centres, learned from a bounded sample; every vector lies, as bytes, in the list of its
nearest centre, long lists in parts; the number of lists grows with the square root of the rows. A search takes the queries of a list and a part of it as two
matrices, keeps the best of each query by the bytes, and scores the best of all its parts again on the vectors themselves, so scores are exact and only which neighbours are met is
approximate.

Defined cases: null and empty texts have the zero vector and take no part in a search; ties go to the smaller id; repeated ids are searched each.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.runtime import materialise

SIZE = 384
#: Weight of each family of features.
WEIGHTS = {"tok": 1.25, "stem": 0.7, "piece": 0.4, "char": 0.25, "bi": 0.8, "skip": 0.5, "acr": 0.6, "group": 1.2}
GROUPS = {
    "access": ["public", "private", "protected", "static", "const"],
    "type": ["string", "int", "float", "bool", "list", "map", "dict", "optional", "void"],
    "async": ["async", "await", "promise", "future"],
    "error": ["error", "exception", "panic", "try", "catch"],
    "io": ["read", "write", "open", "close", "stream", "file", "path", "socket"],
    "store": ["db", "database", "query", "sql", "cache"],
    "web": ["http", "route", "endpoint", "api", "url"],
    "test": ["test", "spec", "mock", "assert", "expect"],
}
SUFFIXES = "(ing|ers|ies|ed|es|er|s)$"


def features(texts: DataFrame, id_col: str, text: Column) -> DataFrame:
    """id, feature, weight: one row for each time that a feature occurs."""
    d = texts.select(F.col(id_col).alias("id"), T.search_tokens(F.coalesce(text, F.lit(""))).alias("w"), F.filter(F.split(T.normalize_identifier(F.coalesce(text, F.lit(""))), " "), lambda p: p != "").alias("p"))

    def family(name: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.concat(F.lit(name + ":"), v).alias("feature"), F.lit(WEIGHTS[name]).alias("weight")))

    def pairs(step: int) -> Column:
        return F.zip_with(F.slice("w", F.lit(1), F.greatest(F.size("w") - step, F.lit(0))), F.slice("w", F.lit(1 + step), F.greatest(F.size("w") - step, F.lit(0))), lambda a, b: F.concat(a, F.lit(":"), b))

    runs = F.flatten(F.transform(F.filter("w", lambda t: F.length(t) >= 3), lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - 2), lambda i: F.substring(t, i, F.lit(3)))))
    initials = F.when(F.size("w") >= 2, F.array(F.array_join(F.transform("w", lambda t: F.substring(t, 1, 1)), ""))).otherwise(F.array().cast("array<string>"))
    groups = F.filter(F.array(*(F.when(F.arrays_overlap("w", F.array(*map(F.lit, words))), F.lit(name)) for name, words in GROUPS.items())), lambda g: g.isNotNull())
    every = F.concat(
        family("tok", F.col("w")),
        family("stem", F.transform(F.filter("w", lambda t: F.length(t) > 4), lambda t: F.regexp_replace(t, SUFFIXES, ""))),
        family("piece", F.col("p")),
        family("char", runs),
        family("bi", pairs(1)),
        family("skip", pairs(2)),
        family("acr", initials),
        family("group", groups),
    )
    return d.select("id", F.explode(every).alias("f")).select("id", "f.feature", "f.weight")


def hashed(texts: DataFrame, id_col: str, text: Column) -> DataFrame:
    """id, dimension, value of the vectors' parts that are not zero."""
    dealt = texts.select(F.col(id_col).alias("id"), text.alias("text")).filter("id IS NOT NULL").repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    f = features(dealt, "id", F.col("text"))
    digest = F.md5("feature")
    place = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % SIZE
    sign = F.when(F.conv(F.substring(digest, 9, 1), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
    sums = f.select("id", place.cast("int").alias("dimension"), (sign * F.col("weight")).alias("v")).groupBy("id", "dimension").agg(F.round(F.sum("v"), 6).alias("v")).filter("v <> 0")
    norm = F.sqrt(F.round(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("id")), 9))  # the same for equal texts
    return sums.select("id", "dimension", (F.col("v") / norm).alias("value"))


def embed(texts: DataFrame, id_col: str, text: Column) -> DataFrame:
    """id, vector of every text."""
    parts = hashed(texts, id_col, text).groupBy("id").agg(F.collect_list("dimension").alias("at"), F.collect_list("value").alias("value"))
    every = texts.select(F.col(id_col).alias("id")).join(parts, "id", "left")

    def laid_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            full = np.zeros((b.num_rows, SIZE))
            rows = np.repeat(np.arange(b.num_rows), b.column("at").value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            full[rows, b.column("at").flatten().to_numpy()] = b.column("value").flatten().to_numpy()
            ends = pa.array(np.arange(0, full.size + 1, SIZE, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(ends, pa.array(full.ravel()))], ["id", "vector"])

    id_type = every.schema["id"].dataType.simpleString()
    return every.select("id", "at", "value").mapInArrow(laid_out, f"id {id_type}, vector array<double>")


class VectorIndex(NamedTuple):
    """``lists`` (list, part, parts, id, code, place: which of the rows with its vector, by id) and ``vectors`` (id, vector) in the shared folder; centres are a bounded array."""

    centres: np.ndarray
    lists: DataFrame
    vectors: DataFrame


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _centres(x: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means, begun with rows at even distances."""
    c = x[np.linspace(0, len(x) - 1, n).astype(int)].copy()
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.maximum(norm, 1e-12), c)
    return c


#: Most lists that an index has of its own accord, so that the centres stay a bounded array.
_MOST_LISTS = 4096
#: Queries that meet a part of a list at once.
_TOGETHER = 512


def build_index(vectors: DataFrame, *, lists: int | None = None, sample: int = 20_000, part_rows: int = 8_192) -> VectorIndex:
    """Index (id, vector). Centres are learned from ``sample`` rows at most (by hash of the id); every row is indexed. ``lists``: by default
    64, or the square root of the rows where that is more, up to 4,096."""
    v = materialise(vectors.filter("id IS NOT NULL AND exists(vector, x -> x <> 0)").select("id", "vector"), "vectors")
    if lists is None:
        lists = min(_MOST_LISTS, max(64, int(v.count() ** 0.5)))
    got = v.orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").toArrow().column("vector").combine_chunks()
    x = _matrix(got) if len(got) else np.zeros((1, SIZE), np.float32)
    centres = _centres(x, min(lists, len(x)))
    shared = v.sparkSession.sparkContext.broadcast(centres)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _matrix(b.column("vector"))
            if len(m):
                code = np.clip(np.rint(m * 127 / np.maximum(np.abs(m).max(axis=1, keepdims=True), 1e-12)), -127, 127).astype(np.int8)
                yield pa.RecordBatch.from_arrays([pa.array(np.argmax(m @ shared.value.T, axis=1).astype(np.int32)), b.column("id"), pa.array([c.tobytes() for c in code], pa.binary()), b.column("same")], ["list", "id", "code", "same"])

    n = int(v.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = v.select("id", "vector", F.xxhash64("vector").alias("same")).repartition(n).mapInArrow(place, "list int, id long, code binary, same long")
    # Equal vectors tie, so a search for k needs no more than the first of them.
    placed = materialise(placed.withColumn("place", F.row_number().over(Window.partitionBy("list", "same", "code").orderBy("id"))).drop("same"), "lists")
    sizes = placed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias("parts"))  # one row a list
    placed = placed.join(F.broadcast(sizes), "list").select("list", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "parts", "id", "code", "place")
    return VectorIndex(centres, materialise(placed, "lists"), v)


def nearest(index: VectorIndex, queries: DataFrame, *, k: int = 10, probes: int = 12, again: int = 8) -> DataFrame:
    """query_id, rank, id, score (inner product): of the ``again * k`` best by bytes in the probed lists, the ``k`` best by the vectors; a row is not its own neighbour."""
    shared, best = index.vectors.sparkSession.sparkContext.broadcast(index.centres), again * k

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _matrix(b.column("vector"))
            if len(m):
                near = np.argsort(-(m @ shared.value.T), axis=1, kind="stable")[:, :probes]
                rows = np.repeat(np.arange(len(m)), near.shape[1])
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(rows)), b.column("vector").cast(pa.list_(pa.float32())).take(pa.array(rows)), pa.array(near.ravel().astype(np.int32))], ["query_id", "query", "list"])

    def rough(asked: pa.Table, held: pa.Table) -> pa.Table:
        q, ids = _matrix(asked.column("query").combine_chunks()).astype(np.float64), held.column("id").to_numpy()
        own = asked.column("query_id").to_numpy()
        found, picked, scores = [], [], []
        if len(q) and len(ids):
            code = np.frombuffer(b"".join(held.column("code").to_pylist()), np.int8).reshape(len(ids), -1).astype(np.float64)
            # Rounded, so that equal vectors tie wherever they lie.
            score = np.round(q @ (code / np.maximum(np.linalg.norm(code, axis=1, keepdims=True), 1e-12)).T, 9)
            for i, row in enumerate(score):
                near = np.flatnonzero(row >= np.partition(row, -best - 1)[-best - 1]) if len(row) > best + 1 else np.arange(len(row))
                near = near[ids[near] != own[i]]
                near = near[np.lexsort((ids[near], -row[near]))][:best]
                found.append(np.full(len(near), own[i]))
                picked.append(ids[near])
                scores.append(row[near])
        join = lambda parts, kind: pa.array(np.concatenate(parts).astype(kind) if parts else np.empty(0, kind))
        return pa.table([join(found, np.int64), join(picked, np.int64), join(scores, np.float64)], names=["query_id", "id", "rough"])

    asked = queries.filter("id IS NOT NULL AND exists(vector, x -> x <> 0)").select("id", "vector").mapInArrow(probe, "query_id long, query array<float>, list int")
    asked = materialise(asked, "asked")
    lists = index.lists.filter(F.col("place") <= best + 1)  # and the query's own row
    held = index.lists.groupBy("list").agg(F.max("parts").alias("parts"))  # one row a list
    turns = asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / _TOGETHER).cast("int").alias("turns"))
    turn = F.pmod(F.xxhash64("query_id"), F.col("turns")).cast("int")
    left = asked.join(F.broadcast(turns.join(held, "list")), "list").select("query_id", "query", "list", turn.alias("turn"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    right = lists.join(F.broadcast(turns), "list").select("id", "code", "list", "part", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"))
    # As many partitions as a shuffle has, since the bytes moved say little of the work.
    n, key = int(index.lists.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["list", "part", "turn"]
    met = left.repartition(n, *key).groupBy(key).cogroup(right.repartition(n, *key).groupBy(key)).applyInArrow(rough, "query_id long, id long, rough double")
    first = met.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rough"), "id"))).filter(F.col("nth") <= best).select("query_id", "id")
    exact = first.join(index.vectors, "id").join(queries.select(F.col("id").alias("query_id"), F.col("vector").alias("query")), "query_id")
    dot = F.aggregate(F.zip_with("vector", "query", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    scored = exact.select("query_id", "id", F.round(dot, 9).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")
