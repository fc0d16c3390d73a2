"""Label deduplication: MinHash signatures, bands, Jaro-Winkler, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.centrality import components
from tessera.runtime import discard, materialise

# 64-bit FNV-1a.
_FNV_OFFSET, _FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
_M64 = (1 << 64) - 1


def _splitmix(seed: int, n: int) -> np.ndarray:
    out = np.zeros(n, np.uint64)
    for i in range(n):
        seed = (seed + 0x9E3779B97F4A7C15) & _M64
        z = seed
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _M64
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _M64
        out[i] = z ^ (z >> 31)
    return out


def minhash_signature(label: str, *, shingle: int = 3, permutations: int = 64, modulus: int = 65_521, seed: int = 1) -> list[int]:
    """Least salted hash of the label's character shingles for each permutation."""
    grams = [label[i : i + shingle] for i in range(max(1, len(label) - shingle + 1))]
    salts = _splitmix(seed, permutations)
    best = np.full(permutations, modulus, np.uint64)
    prime = np.uint64(_FNV_PRIME)
    for g in grams:
        h = np.full(permutations, _FNV_OFFSET, np.uint64) ^ salts
        for byte in g.encode():
            h = (h ^ np.uint64(byte)) * prime
        best = np.minimum(best, h % np.uint64(modulus))
    return best.astype(int).tolist()


def signatures(labels: DataFrame, id_col: str, label_col: str, *, keep: tuple[str, ...] = (), **options) -> DataFrame:
    """id, signature and the columns ``keep``; labels that repeat share one computation per batch."""

    @F.arrow_udf("array<int>")
    def sign(labels: pa.Array) -> pa.Array:
        known: dict[str, list[int]] = {}
        return pa.array([known.get(x) or known.setdefault(x, minhash_signature(x, **options)) for x in labels.to_pylist()], pa.list_(pa.int32()))

    return labels.select(F.col(id_col).alias("id"), sign(F.coalesce(F.col(label_col), F.lit(""))).alias("signature"), *keep)


def candidate_pairs(signed: DataFrame, *, bands: int = 12, rows: int = 5, threshold: float = 0.7) -> DataFrame:
    """a, b, similarity: pairs that share a band and whose signatures agree on ``threshold`` of their places.

    Equal signatures are taken once, so a group of copies makes one row a band and joins by its smallest id.
    """
    distinct = signed.groupBy("signature").agg(F.min("id").alias("id"))
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.struct(i.alias("band"), F.slice("signature", i * rows + 1, rows).alias("rows")))).alias("x")
    keyed = distinct.select("id", "signature", band).select("id", "signature", F.xxhash64("x.band", "x.rows").alias("key"))
    a, b = keyed.alias("a"), keyed.alias("b")
    same = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda x: x)) / F.size("sa")
    pairs = a.join(b, "key").filter("a.id < b.id").select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("a.signature").alias("sa"), F.col("b.signature").alias("sb")).dropDuplicates(["a", "b"])
    near = pairs.select("a", "b", F.round(same, 6).alias("similarity")).filter(F.col("similarity") >= threshold)
    copies = signed.join(distinct.withColumnRenamed("id", "first"), "signature").filter("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
    return near.unionByName(copies)


def jaro_winkler_value(a: str, b: str, prefix: float = 0.1) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, left = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, t in zip(b, taken) if t]
    m, swaps = len(left), sum(x != y for x, y in zip(left, right)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    same = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        same += 1
    return jaro + same * prefix * (1 - jaro)


def jaro_winkler(a: Column, b: Column) -> Column:
    @F.arrow_udf("double")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else jaro_winkler_value(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())

    return run(a, b)


#: Places of the signature beside a band on which labels agree that :func:`near_components` compares first, round by round.
_AGREE = (24, -24, 12, -12, 6, -6, 0)
#: Labels of a band that one task compares with the same others.
_PART = 5_000


def _keys(signature: Column, bands: int, rows: int, more: int = 0) -> Column:
    """One key a band, over its rows and ``more`` places after it (before it, if negative), around the end."""
    n, twice = F.size(signature), F.concat(signature, signature)
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.slice(twice, (i * rows + min(more, 0) + n) % n + 1, F.lit(rows + abs(more)))))


def near_components(signed: DataFrame, *, bands: int = 12, rows: int = 5, jaccard: float = 0.7, winkler: float = 0.92, boost: float = 0.05) -> DataFrame:
    """id, root: components of the labels (id, signature, norm, community) that share a band, agree on ``jaccard`` of their places and are close by Jaro-Winkler.

    Only which labels hang together is asked, so pairs of one component need no look. Labels of equal signature, norm and community are one class. Rounds
    compare each class with two others that agree with it on a band and more, one comparison a band, and join components; after them every pair of
    classes that share a band and still lie in two components is compared. That is all pairs of the band but those within its largest component;
    a pair is judged where it is met, and no pairs are written but links.
    """
    same = [F.col(f"m.{c}").eqNullSafe(F.col(f"c.{c}")) for c in ("signature", "norm", "community")]
    classes = materialise(signed.groupBy("signature", "norm", "community").agg(F.min("id").alias("id")), "label-classes")
    member = materialise(signed.alias("m").join(classes.alias("c"), same).select("m.id", F.col("c.id").alias("root")), "label-members")
    root = materialise(classes.select("id", F.col("id").alias("root")), "label-roots")

    def linked(pairs: DataFrame) -> DataFrame:
        """Of pairs with both ends' columns (a_id, a_root, a_signature ..., b_id ...) the roots of those that are links."""
        agree = F.size(F.filter(F.zip_with("a_signature", "b_signature", lambda x, y: x == y), lambda x: x)) / F.size("a_signature")
        near = pairs.filter(F.round(agree, 6) >= jaccard)
        score = jaro_winkler(F.col("a_norm"), F.col("b_norm")) + F.when(F.col("a_community") == F.col("b_community"), boost).otherwise(0.0)
        return near.withColumn("score", score).filter(F.col("score") >= winkler).select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct()

    def join_roots(root: DataFrame, pairs: DataFrame) -> tuple[DataFrame, bool]:
        links = materialise(linked(pairs), "label-links")
        if links.isEmpty():
            return root, False
        new = components(links).select(F.col("id").alias("root"), F.col("root").alias("new"))
        out = materialise(root.join(new, "root", "left").select("id", F.coalesce("new", "root").alias("root")), "label-roots")
        discard(links)
        discard(root)
        return out, True

    side = lambda df, end: df.select(*(F.col(c).alias(f"{end}_{c}") for c in df.columns))
    for more in _AGREE:
        now = classes.join(root, "id")
        keyed = now.select("id", "root", F.explode(_keys(F.col("signature"), bands, rows, more)).alias("key"))
        ends = keyed.groupBy("key").agg(F.min(F.struct("root", "id")).alias("low"), F.max(F.struct("root", "id")).alias("high")).filter("low.root < high.root")
        met = keyed.join(ends, "key").select("id", "root", F.explode(F.array("low", "high")).alias("o")).filter("root <> o.root")
        met = met.select(F.least("id", "o.id").alias("a_id"), F.greatest("id", "o.id").alias("b_id")).distinct()
        root, joined = join_roots(root, met.join(side(now, "a"), "a_id").join(side(now, "b"), "b_id"))
        if joined and root.select("root").distinct().limit(2).count() < 2:
            break

    now = materialise(classes.join(root, "id").withColumn("key", F.explode(_keys(F.col("signature"), bands, rows))), "label-bands")
    held = now.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    groups = held.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("most"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
    groups = materialise(groups.select("key", F.col("most.root").alias("most"), F.ceil(F.col("n") / _PART).cast("int").alias("parts")), "label-groups")
    here = now.join(groups, "key")
    few = here.filter("root <> most").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    every = here.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    a, b = side(few, "a"), side(every, "b")
    pairs = a.join(b, (F.col("a_key") == F.col("b_key")) & (F.col("a_part") == F.col("b_part")) & (F.col("a_root") != F.col("b_root")) & ((F.col("b_root") == F.col("b_most")) | (F.col("a_root") < F.col("b_root"))))
    root, _ = join_roots(root, pairs)
    top = root.select(F.col("id").alias("class"), "root")
    return member.select("id", F.col("root").alias("class")).join(top, "class").select("id", "root")


def deduplicate(nodes: DataFrame, *, jaccard: float = 0.7, winkler: float = 0.92, communities: DataFrame | None = None, boost: float = 0.05) -> DataFrame:
    """id, keep_id: labels that pass the entropy gate, share bands and are close by Jaro-Winkler, joined into components."""
    n = nodes.select("id", F.col("name").alias("label"), T.normalize_label(F.col("name")).alias("norm")).filter(T.passes_entropy(F.col("norm")))
    n = n.withColumn("community", F.lit(None).cast("long")) if communities is None else n.join(communities.select("id", "community"), "id", "left")
    signed = materialise(signatures(n, "id", "label", keep=("norm", "community")), "signatures")
    return near_components(signed, jaccard=jaccard, winkler=winkler, boost=boost).select("id", F.col("root").alias("keep_id"))
