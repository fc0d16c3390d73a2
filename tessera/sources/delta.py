"""Versioned tables of rows with an id: a base cut into buckets of a key, and what changed since as small pieces.

A change writes its new rows and the ids that it takes away, nothing else, and ends with a manifest of the pieces that make up the new
version; readers of older versions go on with their own manifest. Reading joins the rows with the ids taken away later than they came; where these are many, a broadcast
sieve of their hashes lets the other rows by, so that a read exchanges as much as was taken away and not the table. Pieces of
a table are merged when there are ``PIECES`` of them, and a table gets a new base when its changes are more than
half of it, so the cost of a change is in proportion to it, spread over changes. There is one writer at a time.

A reader that knows the keys it wants names their buckets: the base's folders of other buckets are not listed, pieces are filtered by a pushed predicate.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.runtime import child_names, path_exists

BUCKETS, PIECES = 64, 8
#: Ids taken away from which a sieve stands before their join, and its bits at most (a million rows of 64): 16 an id up to there, beyond it more rows are left to the join.
SIEVED, SIEVE = 200_000, 1 << 26
_MANIFEST = "table string, path string, part string, rows long, schema string"


class Piece(NamedTuple):
    """``part`` is base, rows (added later) or dead (ids taken away)."""

    table: str
    path: str
    part: str
    rows: int
    schema: str


class DeltaTables:
    def __init__(self, spark: SparkSession, root: str, keys: dict[str, str]) -> None:
        """``keys``: the column of each table that its buckets are cut by; a null key is cut by the id."""
        self.spark, self.root, self.keys = spark, root.rstrip("/"), keys

    # --- versions ---

    def version(self) -> int:
        """The last saved version, 0 if nothing is saved; a folder that can't be read is an error. A version is there once its manifest is whole."""
        at = f"{self.root}/manifest"
        names = child_names(self.spark, at) if path_exists(self.spark, at) else []
        for v in sorted((int(n[2:]) for n in names if n.startswith("v=")), reverse=True):
            if path_exists(self.spark, f"{at}/v={v}/_SUCCESS"):
                return v
        return 0

    def pieces(self, version: int | None = None) -> list[Piece]:
        v = self.version() if version is None else version
        return [Piece(*r) for r in self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifest/v={v}").collect()] if v else []

    def commit(self, pieces: list[Piece]) -> int:
        v = self.version() + 1
        self.spark.createDataFrame(pieces, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/v={v}")
        return v

    # --- writing ---

    def bucket(self, key: Column | str, id_: Column | str | None = None) -> Column:
        key = F.col(key) if isinstance(key, str) else key
        cut = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")
        return cut if id_ is None else F.when(key.isNull(), F.pmod(F.xxhash64(id_), F.lit(BUCKETS)).cast("int")).otherwise(cut)

    def buckets(self, keys: DataFrame, column: str) -> list[int]:
        """The buckets of the keys in a column; no more than there are."""
        return sorted(r[0] for r in keys.filter(F.col(column).isNotNull()).select(self.bucket(column)).distinct().collect())

    def stage(self, table: str, rows: DataFrame, version: int, *, base: bool = False) -> list[Piece]:
        """Write rows as a new base, or as a piece that a later manifest may name."""
        placed = rows.withColumn("_bucket", self.bucket(self.keys[table], "id")) if "_bucket" not in rows.columns else rows
        placed = placed if "_since" in placed.columns else placed.withColumn("_since", F.lit(version).cast("long"))
        schema = ", ".join(f"`{n}` {t}" for n, t in placed.dtypes if n != "_bucket")
        path = f"{table}-{uuid.uuid4().hex}"
        if base:
            # By range, so that a bucket with a hot key is written by several tasks.
            placed.repartitionByRange("_bucket", "id").sortWithinPartitions("_bucket", "id").write.partitionBy("_bucket").parquet(f"{self.root}/{path}")
        else:
            placed.sortWithinPartitions("_bucket", "id").write.parquet(f"{self.root}/{path}")
        piece = Piece(table, path, "base" if base else "rows", 0, schema)
        n = self._read(piece).count()
        return [piece._replace(rows=n)] if n or base else []

    def stage_dead(self, table: str, ids: DataFrame, version: int) -> list[Piece]:
        """Take away rows (id) that came before this version."""
        path, kind = f"{table}-dead-{uuid.uuid4().hex}", dict(ids.dtypes)["id"]
        dead = ids.select("id").distinct().withColumn("_until", F.lit(version).cast("long")) if "_until" not in ids.columns else ids
        dead.write.parquet(f"{self.root}/{path}")
        piece = Piece(table, path, "dead", 0, f"id {kind}, _until long")
        n = self._read(piece).count()
        return [piece._replace(rows=n)] if n else []

    def compact(self, pieces: list[Piece], table: str, version: int) -> list[Piece]:
        """``pieces`` with those of one table rewritten, if they are many or large."""
        mine = [p for p in pieces if p.table == table]
        base, later = sum(p.rows for p in mine if p.part == "base"), [p for p in mine if p.part != "base"]
        if sum(p.rows for p in later) * 2 > base:
            fresh = self.stage(table, self._live(mine).drop("_bucket"), version, base=True)
            return [p for p in pieces if p.table != table] + fresh
        if len(later) < PIECES:
            return pieces
        rows = self._live([p for p in later])
        fresh = self.stage(table, rows, version) if rows is not None else []
        return [p for p in pieces if p not in later] + fresh + self.stage_dead(table, self._dead(later), version)

    # --- reading ---

    def _read(self, piece: Piece) -> DataFrame:
        schema = piece.schema + (", `_bucket` int" if piece.part != "dead" else "")
        return self.spark.read.schema(schema).parquet(f"{self.root}/{piece.path}")

    def _dead(self, pieces: list[Piece]) -> DataFrame | None:
        out = None
        for p in pieces:
            if p.part == "dead":
                out = self._read(p) if out is None else out.unionByName(self._read(p))
        return None if out is None else out.groupBy("id").agg(F.max("_until").alias("_until"))

    def _live(self, pieces: list[Piece], buckets: list[int] | None = None) -> DataFrame | None:
        out = None
        for p in pieces:
            if p.part != "dead":
                rows = self._read(p)
                rows = rows if buckets is None else rows.filter(F.col("_bucket").isin(buckets))
                out = rows if out is None else out.unionByName(rows)
        dead = self._dead(pieces)
        if out is None or dead is None:
            return out
        taken = sum(p.rows for p in pieces if p.part == "dead")
        if taken < SIEVED:
            return self._outlived(out, dead)
        caught = self._caught(out, dead, min(SIEVE, 16 * taken))
        passed = caught.filter("NOT _caught").drop("_caught")
        return passed.unionByName(self._outlived(caught.filter("_caught").drop("_caught"), dead))

    @staticmethod
    def _outlived(rows: DataFrame, dead: DataFrame) -> DataFrame:
        return rows.join(dead, "id", "left").filter("_until IS NULL OR _until <= _since").drop("_until")

    @staticmethod
    def _caught(rows: DataFrame, dead: DataFrame, bits: int) -> DataFrame:
        """``rows`` with ``_caught``: true of all whose id is among the dead, and of the few others whose hash is."""
        place = F.pmod(F.xxhash64("id"), F.lit(bits))
        word, bit = F.shiftright(place, 6).alias("_word"), F.expr("shiftleft(1L, cast(_place % 64 AS int))")
        sieve = dead.select(place.alias("_place"), word).groupBy("_word").agg(F.bit_or(bit).alias("_bits"))
        met = rows.select("*", place.alias("_place"), word).join(F.broadcast(sieve), "_word", "left")
        return met.withColumn("_caught", F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))).drop("_word", "_place", "_bits")

    def read(self, table: str, version: int | None = None, *, buckets: list[int] | None = None, pieces: list[Piece] | None = None) -> DataFrame:
        """Live rows of a table, of all buckets or some."""
        mine = [p for p in (self.pieces(version) if pieces is None else pieces) if p.table == table]
        rows = self._live(mine, buckets)
        if rows is None:
            raise ValueError(f"no table {table} in this version")
        columns = [n for n in rows.columns if n not in ("_bucket", "_since")]
        return rows.select(columns)
