"""Approximate nearest neighbours by collision-counting hashing.

Vectors with norms up to M are divided by M and lifted onto the unit sphere by one more
coordinate, queries are scaled to length 1, and then the largest inner product is the smallest
distance. Each of ``n_projections`` random directions orders a block's vectors in a sorted array
of their own. A query's windows, centred on its own projections, grow together with a radius
(virtual rehashing: one array serves every radius). A window is a range of places in the sorted
array, so a vector's collisions are the windows that hold its place; a vector that reaches the
collision threshold is verified by its exact inner product. The radii a query tries are its
distances to every (n / k)-th vector of the block, nearest first: the nearest of these is about its
k-th neighbour. A query stops when its k-th nearest verified vector is within the radius, since
whatever is nearer than the radius collides often enough with high probability; when no radius is
left the windows hold everything, and then all is verified.

Rows are dealt into blocks of at most 65,536 by hash. A query first searches one block in full; the k-th score
found there bounds the radius in every other block, which it visits with one window size and from
which only what beats the bound comes back. Queries travel in groups of ``query_rows``, so a block's
arrays are sorted once for that many queries. Nothing is broadcast but the directions.

Defined cases: vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part; any other vector does, however small its norm; a query is never
its own neighbour by id, but equal vectors with other ids are; ties go to the smaller id; with
fewer than k others all are returned; of rows that repeat an id the one whose vector is first
in the order of arrays counts; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.runtime import materialise

_FOUND = "query_id long, vec_id long, score double"


@dataclass(frozen=True)
class Scheme:
    """Projections, window half-width per unit of radius, and how many deviations the threshold is below the mean."""

    n_projections: int = 64
    width: float = 1.8
    slack: float = 0.8

    def threshold(self) -> int:
        # A vector at the radius lies in a window with chance p.
        p = erf(self.width / sqrt(2))
        return max(1, int(self.n_projections * p - self.slack * sqrt(self.n_projections * p * (1 - p))))


def lengths(vectors: np.ndarray) -> np.ndarray:
    """Norms without underflow or overflow of squares."""
    scale = np.abs(vectors).max(-1)
    return scale * np.sqrt(((vectors / np.where(scale > 0, scale, 1)[..., None]) ** 2).sum(-1))


class Block:
    """Sorted projections of a block of vectors, and each vector's place in each of them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, norm: float, directions: np.ndarray, scheme: Scheme) -> None:
        self.ids, self.vectors, self.norm, self.directions, self.scheme = ids, vectors, norm, directions, scheme
        unit = vectors / norm
        lift = np.sqrt(np.maximum(0, 1 - (unit * unit).sum(1)))
        self.unit = unit.astype(np.float32)
        p = (unit @ directions[:-1] + lift[:, None] * directions[-1]).astype(np.float32).T.copy()
        n = len(ids)
        self.place = np.empty(p.shape, np.uint16)
        for row, place in zip(p, self.place):
            order = np.argsort(row, kind="stable")
            place[order] = np.arange(n, dtype=np.uint16)
            row[:] = row[order]
        self.keys = p
        self.threshold = scheme.threshold()
        self.counts, self.gap, self.inside = np.empty(n, np.uint8), np.empty(n, np.uint16), np.empty(n, bool)

    def collisions(self, centre: np.ndarray, radius: float) -> np.ndarray:
        """How many of the query's windows hold each vector."""
        half = self.scheme.width * radius
        self.counts[:] = 0
        for keys, place, c in zip(self.keys, self.place, centre.tolist()):
            low, high = keys.searchsorted(np.float32(c - half)), keys.searchsorted(np.float32(c + half), side="right")
            if high - low == len(place):
                self.inside[:] = True
            else:
                np.subtract(place, np.uint16(low), out=self.gap)
                np.less(self.gap, np.uint16(high - low), out=self.inside)
            np.add(self.counts, self.inside.view(np.uint8), out=self.counts)
        return self.counts

    def search(self, query_id: int, query: np.ndarray, k: int, bound: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """Ids and inner products of the k nearest found, best first; with a ``bound``, of those that reach it."""
        n = len(self.ids)
        length = float(lengths(query))
        unit = query / length
        centre = unit @ self.directions[:-1]
        small = unit.astype(np.float32)
        if bound > -np.inf:
            radii = [sqrt(max(0.0, 2 - 2 * bound / self.norm / length)) + 1e-6]
        else:
            sample = self.unit[:: max(1, k)] @ small
            radii = np.sqrt(np.maximum(0, 2 - 2 * np.sort(sample[self.ids[:: max(1, k)] != query_id])[::-1])) + 1e-6
            radii = [*np.unique(radii[:k]).tolist(), 2.0]
        done = self.ids == query_id
        found, scores = np.zeros(0, np.int64), np.zeros(0, np.float32)
        for radius in radii:
            counts = self.collisions(centre, radius)
            hit = np.flatnonzero((counts >= self.threshold if radius < 2 else np.ones(n, bool)) & ~done)
            done[hit] = True
            found, scores = np.concatenate([found, hit]), np.concatenate([scores, self.unit[hit] @ small])
            # The k-th best within the radius: 2 - 2 s <= R^2 on the sphere.
            if len(scores) >= k and 2 - 2 * float(np.partition(scores, len(scores) - k)[len(scores) - k]) <= radius * radius:
                break
        if len(scores) > k:  # single precision first, then all that may be among the best in double precision
            found = found[scores >= np.partition(scores, len(scores) - k)[len(scores) - k] - np.float32(1e-5)]
        exact = (self.vectors[found] * query).sum(1)
        best = np.lexsort((self.ids[found], -exact))[:k]
        best = best[exact[best] >= bound]
        return self.ids[found[best]], exact[best]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v (doubles), norm: rows that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL")
    rows = rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    rows = rows.withColumn("scale", F.array_max(F.transform("v", F.abs))).filter("scale > 0")
    norm = F.col("scale") * F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / F.col("scale")) * (x / F.col("scale"))))
    return rows.select("vec_id", "v", norm.alias("norm"))


def _arrays(table: pa.Table, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, vectors and the row of each; of rows that repeat an id the first vector in array order."""
    ids = table.column("vec_id").to_numpy()
    vectors = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    order = np.argsort(ids, kind="stable")
    if len(ids) > 1 and (ids[order][1:] == ids[order][:-1]).any():
        order = np.lexsort((*vectors.T[::-1], ids))
        order = order[np.concatenate([[True], ids[order][1:] != ids[order][:-1]])]
    return ids[order], vectors[order], order


def _tiles(held: DataFrame, asked: DataFrame, k: int, d: int, norm: float, scheme: Scheme, directions: np.ndarray) -> DataFrame:
    """query_id, vec_id, score: the best k of each block for each query that meets it."""

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if left.num_rows and right.num_rows:
            ids, vectors, _ = _arrays(left, d)
            block = Block(ids, vectors, norm, directions, scheme)
            queries, given, row = _arrays(right, d)
            bounds = right.column("bound").to_numpy()[row]
            for query_id, query, bound in zip(queries.tolist(), given, bounds.tolist()):
                found, scores = block.search(query_id, query, k, bound)
                for column, values in zip(out, (np.full(len(found), query_id), found, scores)):
                    column.append(values)
        return pa.table([pa.array(np.concatenate(c)) for c in out], ["query_id", "vec_id", "score"])

    keys = ["block", "query_block"]
    return held.select("vec_id", "v", *keys).groupBy(keys).cogroup(asked.select("vec_id", "v", "bound", *keys).groupBy(keys)).applyInArrow(search, _FOUND)


def nearest(vectors: DataFrame, is_query: Column, *, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scheme: Scheme | None = None, block_rows: int = 16_384, query_rows: int = 1_024, seed: int = 1) -> DataFrame:
    """query_id, rank, vec_id, score (inner product in double precision); ``is_query`` is over vec_id.

    ``block_rows`` is the mean size of a block, at most 49,152, so that no block exceeds 65,536 places.
    """
    rows = usable(vectors, id_col, vector_col)
    size = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("norm"), F.sum(is_query.cast("long")).alias("q")).orderBy(F.desc("n"), "d").first()
    d, n, norm, n_queries = (size["d"], size["n"], min(size["norm"] * (1 + 1e-12), 1e308), size["q"] or 0) if size else (1, 0, 1.0, 0)
    rows = rows.filter(F.size("v") == d)
    scheme = scheme or Scheme()
    directions = np.random.default_rng(seed).standard_normal((d + 1, scheme.n_projections))
    blocks, groups = max(1, -(-n // min(block_rows, 49_152))), max(1, -(-n_queries // query_rows))
    block, group = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)), F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(groups))
    every = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    held = rows.select("vec_id", "v", block.alias("block"), every(groups).alias("query_block"))
    asked = rows.filter(is_query).select("vec_id", "v", group.alias("query_block"), block.alias("block"), F.lit(float("-inf")).alias("bound"))
    found = _tiles(held, asked, k, d, norm, scheme, directions)
    if blocks > 1:
        found = materialise(found, "ann-home")
        bounds = found.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(float("-inf")).alias("bound"))
        away = asked.drop("bound").join(bounds, F.col("vec_id") == F.col("query_id"), "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
        away = away.select(F.col("vec_id").alias("vec_id"), F.col("v").alias("v"), F.col("query_block").alias("query_block"), F.col("block").alias("home"), "bound", every(blocks).alias("block")).filter("block <> home")
        found = found.unionByName(_tiles(held, away, k, d, norm, scheme, directions))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
