"""Best-fit packing with lower bounds that certify each partition's bin count.

1. Documents are tokenised in Arrow batches; each gives its ids and one end id. One longer
   than the sequence is cut so that all pieces but the first are full.
2. Pieces are dealt to partitions of about ``rows_per_partition`` rows by hash, and packed there
   by best-fit decreasing. Dual-feasible functions give a lower bound on the partition's bins;
   where the bound is met the packing is optimal, and certified.
3. While the bins of all partitions together are above the lower bound of all lengths, each partition hands
   in its emptiest bins, one and two more for each bin above its own bound. The documents in them
   are exchanged between partitions, packed again and kept if that takes no more bins than before.
   This ends when the total is certified, one partition is left, or a whole round gained no bin.

Each row tells the bound of its partition (``partition_bound``), the bins it took (``partition_bins``) and
``certified``: whether the two are equal.

Only lengths move between tasks, never texts or ids. No group grows with the data: the
number of partitions does. The bound of all lengths needs one row a length, ``capacity`` rows at most. Results are deterministic.

Defined cases: null text counts as empty; an empty text is one piece of one id; a text whose
ids fill sequences exactly has no shorter piece; rows that repeat an id are packed each; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.tokens import encode_batch
from tessera.runtime import discard, materialise

_BIN_BITS = 24
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; only the first may be shorter than ``capacity``."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    out = [(0, head)] if head else []
    return out + [(s, capacity) for s in range(head, n, capacity)]


def token_pieces(docs: DataFrame, *, ranks_path: str, capacity: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every document with their place, length and the CRC-32 of their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], np.uint32)
        for b in batches:
            cols: list[list[int]] = [[], [], [], [], []]
            for doc, ids in zip(b.column(0).to_pylist(), encode_batch(b.column(1), ranks_path)):
                ids = np.concatenate([ids, end]).astype("<u4")
                for k, (s, n) in enumerate(cut(len(ids), capacity)):
                    for c, v in zip(cols, (doc, k, s, n, zlib.crc32(ids[s : s + n]))):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(cols)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin of each item and the fill of each bin; a bit mask finds the tightest open bin."""
    where = np.zeros(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, fill = 0, []
    for k in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[k])
        fits = mask >> n
        if fits:
            left = n + (fits & -fits).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                mask &= ~(1 << left)
        else:
            left, b = capacity, len(fill)
            fill.append(0)
        where[k], fill[b] = b, fill[b] + n
        if left - n:
            room[left - n].append(b)
            mask |= 1 << (left - n)
    return where, np.array(fill, np.int64)


def lower_bound(lengths: np.ndarray, capacity: int, functions: int = 20, count: np.ndarray | None = None) -> int:
    """Bins that any packing needs: the best of two families of dual-feasible functions; ``count`` of each length, else 1."""
    if not len(lengths):
        return 0
    size, n = np.unique(lengths, return_counts=True) if count is None else (lengths, count)
    best = -(-int(size @ n) // capacity)
    for k in range(1, functions + 1):
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)
        best = max(best, -(-int(value @ n) // (k * capacity)))
    # Items above capacity - e count whole, those below e not at all.
    e = np.concatenate([[0], size[size <= capacity // 2]])
    count, mass = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(size * n)])
    low, high = np.searchsorted(size, e, "left"), np.searchsorted(size, capacity - e, "right")
    whole = (count[-1] - count[high]) * capacity + mass[high] - mass[np.minimum(low, high)]
    return max(best, int(-(-whole.max() // capacity)))


def _pack(rows: pd.DataFrame, capacity: int, group: int, level: int) -> pd.DataFrame:
    """Pack one partition; ``handed`` marks the bins that it would exchange."""
    rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32", "start"], ascending=[False, True, True, True, True], ignore_index=True)
    lengths = rows["length"].to_numpy()
    where, fill = best_fit_decreasing(lengths, capacity)
    bound = lower_bound(lengths, capacity)
    if level and rows["sequence_id"].nunique() < len(fill):  # the exchange did not help
        _, where = np.unique(rows["sequence_id"].to_numpy(), return_inverse=True)
        fill = np.bincount(where, lengths).astype(np.int64)
        rows["sequence_id"] = rows["sequence_id"].astype("int64")
    else:
        rows["sequence_id"] = (np.int64(level) << 58) | (np.int64(group) << _BIN_BITS) | where
    order = np.argsort(where, kind="stable")
    total = np.cumsum(lengths[order]) - lengths[order]
    first = np.concatenate([[0], np.cumsum(np.bincount(where[order], minlength=len(fill)))[:-1]])
    offset = np.zeros(len(rows), np.int64)
    offset[order] = total - total[first][where[order]]
    rows["offset"] = offset
    handed = np.zeros(len(fill), bool)
    emptiest = np.argsort(fill, kind="stable")[: 2 * (len(fill) - bound) + 1]
    handed[emptiest] = fill[emptiest] < capacity
    rows["handed"] = handed[where]
    rows["partition_bins"], rows["partition_bound"] = len(fill), bound
    return rows


def _packer(capacity: int, level: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _pack(rows.drop(columns="part"), capacity, int(key[0]), level)

    return run


def pack(pieces: DataFrame, *, capacity: int, rows_per_partition: int = 32_768) -> DataFrame:
    """Pieces with sequence_id and offset (gapless from 0 in each sequence), and the certificate of their partition."""
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    out = [*columns, "sequence_id", "offset", "partition_bins", "partition_bound"]
    schema = f"{PIECES}, sequence_id long, offset long, handed boolean, partition_bins long, partition_bound long"
    done: list[DataFrame] = []
    full = pieces.filter(F.col("length") >= capacity)
    short = pieces.filter(F.col("length") < capacity)
    histogram = np.array([(r[0], r[1]) for r in short.groupBy("length").count().orderBy("length").collect()], np.int64).reshape(-1, 2)
    wanted, n = lower_bound(histogram[:, 0], capacity, count=histogram[:, 1]), int(histogram[:, 1].sum())
    pool, level, kept, before = short.withColumn("sequence_id", F.lit(0).cast("long")), 0, 0, None
    dealt = F.xxhash64(*columns)
    while True:
        groups = max(1, -(-n // rows_per_partition))
        packed = materialise(pool.withColumn("part", F.pmod(dealt, F.lit(groups))).groupBy("part").applyInPandas(_packer(capacity, level), schema), f"pack-{level}")
        bins = packed.groupBy("handed").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("offset") == 0, 1).otherwise(0)).alias("bins")).collect()
        n, total = sum(r["n"] for r in bins if r["handed"]), sum(r["bins"] for r in bins)
        gained = before is None or total < before
        last = groups == 1 or not n or not gained or kept + total <= wanted or level == 30
        done.append(packed if last else packed.filter("NOT handed"))
        if last:
            break
        kept, before = kept + sum(r["bins"] for r in bins if not r["handed"]), sum(r["bins"] for r in bins if r["handed"])
        pool, level = packed.filter("handed").select(*columns, "sequence_id"), level + 1
        dealt = F.xxhash64("sequence_id", F.lit(level))
    found = full.select(*columns, (F.lit(-1) - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *(F.lit(1).cast("long").alias(c) for c in out[-2:]))
    for d in done:
        found = found.unionByName(d.select(*out))
    return found.withColumn("certified", F.col("partition_bins") == F.col("partition_bound"))


def pack_documents(docs: DataFrame, *, ranks_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset and the certificate: one row a piece."""
    pieces = materialise(token_pieces(docs, ranks_path=ranks_path, capacity=capacity, end_id=end_id, id_col=id_col, text_col=text_col), "pieces")
    return pack(pieces, capacity=capacity, **options)
