"""Exact deduplication on an extendible-hash index kept in shared files.

Texts are equal when identical after deleting ``[\\x20\\x09-\\x0D]``. Plan:

1. *Keys.* The 64-bit hash keys of all rows are counted; only keys and counts are shuffled.
2. *Directory.* A histogram of key prefixes drives directory doubling: a bucket with more than
   ``capacity`` keys is split on its next hash bit. The directory has at most ``2 ** MAX_DEPTH``
   slots, whatever the table holds: where the table needs more buckets than that allows, buckets
   grow in proportion, and an owner task sorts its buckets on disk.
3. *Index.* Rows are dealt by the directory's bucket, so an owner task holds whole key ranges. It
   compares texts byte by byte: equal texts become one entry with the list of its rows, and texts
   that share a key form a chain. Entries are written to shared files, without the texts.
4. *Hot keys.* A key with more than ``hot_rows`` rows has its rows spread over parts of about that many;
   each part makes its own entry, and these entries, few for each text, meet in their bucket once
   more, where bytes are compared again. So no list is longer than a part, and no task holds a whole hot group.
5. *Decisions.* Each entry gives its rows the decision; nothing is looked up by hash alone.

Everything is DataFrame expressions.

Defined cases: null text counts as empty, and all texts without other characters
form one group; a null ``doc_id`` sorts after every other id; extra columns are
ignored; an empty table gives no rows; rows that repeat both id and text are one
document written twice and carry the same decision, counted in ``group_size``; where
``row_col`` names a unique column, ``first`` tells exactly one row of each group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.runtime import discard, materialise

_WHITE = r"[\x20\x09-\x0D]+"
#: Bits of the largest directory: 262,144 slots, about 4 MB as a broadcast.
MAX_DEPTH = 18
#: Rows of a hot-key table that a broadcast may hold, about 32 MB; a larger one is joined by a shuffle.
_BROADCAST_ROWS = 1_000_000


def _key(text_col: str) -> tuple[Column, Column, Column]:
    """The original text, its normal form and the key of that."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    norm = F.regexp_replace(text, _WHITE, "")
    return text, norm, F.xxhash64(norm)


def _bounded(small: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(small) if rows <= _BROADCAST_ROWS else small


def directory(histogram: list[tuple[int, int]], depth: int, capacity: int) -> list[tuple[int, int, int]]:
    """Extendible-hash directory from entry counts by ``depth``-bit prefix.

    Returns (first prefix, last prefix, bucket) ranges, prefixes at ``depth`` bits.
    A bucket over ``capacity`` splits while it has bits left; what is still overfull
    at full depth stays one bucket with a longer chain.
    """
    count = dict(histogram)
    out: list[tuple[int, int, int]] = []

    def split(prefix: int, local: int, found: list[tuple[int, int]]) -> None:
        width = depth - local
        first = prefix << width
        if local < depth and sum(c for _, c in found) > capacity:
            middle = first + (1 << (width - 1))
            split(prefix * 2, local + 1, [x for x in found if x[0] < middle])
            split(prefix * 2 + 1, local + 1, [x for x in found if x[0] >= middle])
        else:
            out.append((first, first + (1 << width) - 1, len(out)))

    split(0, 0, sorted(count.items()))
    return out


def build_directory(keys: DataFrame, n_keys: int, capacity: int) -> tuple[DataFrame, int]:
    """prefix, bucket: the bucket of each prefix of the directory's depth, and that depth."""
    capacity = max(capacity, n_keys >> (MAX_DEPTH - 3))
    depth = min(MAX_DEPTH, (-(-n_keys // capacity) - 1).bit_length() + 3) if n_keys > capacity else 0
    prefix = prefix_of(F.col("key"), depth)
    histogram = [(r[0], r[1]) for r in keys.groupBy(prefix.alias("p")).count().collect()]  # at most 2 ** MAX_DEPTH rows
    slots = [(p, b) for lo, hi, b in directory(histogram, depth, capacity) for p in range(lo, hi + 1)]
    return materialise(keys.sparkSession.createDataFrame(slots, "prefix long, bucket int").coalesce(1), "dedup-directory"), depth


def prefix_of(key: Column, depth: int) -> Column:
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4_096, hot_rows: int = 10_000, row_col: str | None = None) -> tuple[DataFrame, int]:
    """The index table, and the number of its hot keys.

    Columns: bucket, part, key, chain, sha, n, best, members; ``text`` for the parts of hot keys only.
    ``best`` is the least (-code points, no id, id, row) of the entry.
    """
    carried = [row_col] if row_col else []
    text, norm, key = _key(text_col)
    keys = materialise(docs.select(key.alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")), "dedup-keys")
    hot = keys.filter(F.col("n") > hot_rows).select("key", F.ceil(F.col("n") / hot_rows).alias("parts"))
    n_keys, n_hot = keys.agg(F.count(F.lit(1)), F.count_if(F.col("n") > hot_rows)).first()
    slots, depth = build_directory(keys, n_keys, capacity)
    rows = docs.select(*carried, F.col(id_col).cast("long").alias("doc_id"), F.length(text).alias("cp"), norm.alias("text"), key.alias("key"), F.spark_partition_id().alias("task"))
    rows = rows.withColumn("prefix", prefix_of(F.col("key"), depth)).join(F.broadcast(slots), "prefix")
    owner = ["bucket"]  # what decides the task; a constant part would hide from the planner that tasks hold whole buckets
    if n_hot:
        rows = rows.join(_bounded(hot, n_hot), "key", "left")
        rows = rows.withColumn("part", F.when(F.col("parts").isNull(), F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64("doc_id", "cp", "task"), F.col("parts"))))
        owner = ["bucket", "part"]
    dealt = rows.select(*carried, "doc_id", "cp", "text", "key", *owner, (F.col("parts").isNotNull() if n_hot else F.lit(False)).alias("hot")).repartition(*owner)
    member = F.struct((-F.col("cp")).alias("cp"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), *carried)
    entries = dealt.groupBy(*owner, "key", "text").agg(F.count(F.lit(1)).alias("n"), F.min(member).alias("best"), F.collect_list(member).alias("members"), F.first("hot").alias("hot"))
    chain = F.row_number().over(Window.partitionBy(*owner, "key").orderBy("text")) - 1
    entries = entries.select("bucket", F.col("part") if n_hot else F.lit(0).cast("long").alias("part"), "key", chain.alias("chain"), F.sha2("text", 256).alias("sha"), "n", "best", "members", F.when(F.col("hot"), F.col("text")).alias("text"))
    index = materialise(entries, "dedup-index")
    discard(keys)
    return index, n_hot


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4_096, hot_rows: int = 10_000, row_col: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, one row per input row.

    Of equal texts, the row with the most code points in the original text, then the
    smallest id, stays. ``row_col`` names a unique column that comes along in front, and adds
    ``first``, true for one row of each group.
    """
    index, n_hot = build_index(docs, id_col=id_col, text_col=text_col, capacity=capacity, hot_rows=hot_rows, row_col=row_col)
    best, size = F.col("best"), F.col("n")
    if n_hot:
        # The entries of a hot text's parts meet in their bucket; links say which they were.
        whole = index.filter("text IS NOT NULL").groupBy("bucket", "key", "text").agg(F.sum("n").alias("all_n"), F.min("best").alias("all_best"), F.collect_list(F.struct("part", "chain")).alias("links"))
        whole = materialise(whole.select("key", F.explode("links").alias("l"), "all_n", "all_best").select("key", "l.part", "l.chain", "all_n", "all_best"), "dedup-hot")
        index = index.join(_bounded(whole, whole.count()), ["key", "part", "chain"], "left")
        best, size = F.coalesce("all_best", "best"), F.coalesce("all_n", "n")
    found = index.select(best.alias("best"), size.alias("group_size"), "sha", F.explode("members").alias("m"))
    same = (F.col("m.doc_id").eqNullSafe(F.col("best.doc_id"))) & (F.col("m.cp") == F.col("best.cp"))
    out = [F.col("m.doc_id"), F.col("best.doc_id").alias("keep_id"), F.col("group_size"), same.alias("kept"), F.col("sha").alias("text_sha256")]
    if row_col:
        out = [F.col(f"m.{row_col}"), *out, (F.col("m") == F.col("best")).alias("first")]
    return found.select(*out)
