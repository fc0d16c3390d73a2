"""Structure repair of conversations: the cheapest edits that make turns alternate.

A legal conversation has role initials ``(s?(ua)+)?``. Each turn may be kept (cost 0, with its role), given the role
user or assistant (2) or deleted (3; blank turns and repeats must be); an empty user or assistant turn may be inserted
anywhere (2); a truncated turn that stays adds 1. Of the cheapest ways the one whose edits' initials (K, R, D, I) come
first in ASCII order is taken.

Window functions flag the faults of each turn, the turns are collected as sorted structs, and ``aggregate()`` carries four
(cost, audit) structs through them, one for each state that the rows so far can end in: nothing yet, after the system
turn, after a user turn, after an assistant turn. Each step is a ``least`` over the edits that lead to a state; costs
decide, then audits. An insertion never stands before a deletion in a best way (the other order costs the same and
comes first), so a step is: delete, or stay after at most one inserted turn.

The fold is over blocks, not conversations: turns are range-partitioned by (conversation, turn), so a conversation that holds
a third of all rows lies in many partitions, and each aligned run of 1,024 rows is a block of its own. A block that
doesn't begin its conversation is folded from all four states; a second fold with the same four structs takes the blocks of a
conversation, whose cells are about 16 bytes a turn (the audit itself, a byte a turn, is a cell of the result). Texts
take no part: the rows carry an MD5 of role and text, and only turns that stay meet their texts again.

Defined cases: null role or text is one space; a null conversation id is a conversation of its own; null turns come first; turns of equal
number are taken by role, then by MD5 of the text; identical rows are copies, the first stays; an empty role has no initial, so it can't be kept; other columns
are ignored, whatever their names; an empty table gives empty tables; a range of turn numbers beyond 64 bits gives null gaps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.runtime import materialise

#: Rows of a block, as a power of two.
BLOCK_BITS = 10
WHITE = " \t\n\x0b\x0c\r"
STATES = "esua"
_BEST = "struct<cost:bigint,audit:string>"
_PATH = "struct<cost:bigint,audit:string,trail:array<struct<first_at:bigint,exit:string,piece:string>>>"


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of ``conversations`` with faults planted by CRC-32 of ``conv_id:turn``, modulo 20.

    0 drops the row, 1 empties its text, 2 takes its sentence ends out, 3 repeats it, 4 makes it a user's.
    """
    spoken = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(spoken("conv_id"), F.lit(":"), spoken("turn"))) % 20
    rows = conversations.select("conv_id", "turn", spoken("role").alias("role"), spoken("text").alias("text"), code.alias("code")).filter("code <> 0")
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _told(turns: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.unhex(F.md5(text)).alias("digest"))


def _after(state: Column, cost: Column | int, edits: str) -> Column:
    """The best way to ``state`` with ``edits`` behind it; null where the state can't be reached."""
    return F.when(state.isNotNull(), F.struct((state["cost"] + cost).cast("long").alias("cost"), F.concat(state["audit"], F.lit(edits)).alias("audit")))


def _step(acc: Column, turn: Column) -> Column:
    e, s, u, a = (acc[x] for x in STATES)
    stays, worn = ~turn["must_go"], turn["truncated"].cast("long")

    def stay(initial: str, *ways: tuple[Column, int, str]) -> list[Column]:
        kept = turn["initial"] == initial
        edit = lambda w, c, i: F.when(kept, _after(w, worn + c, i + "K")).otherwise(_after(w, worn + c + 2, i + "R"))
        return [F.when(stays, edit(*way)) for way in ways]

    return F.struct(
        _after(e, 3, "D").alias("e"),
        F.least(_after(s, 3, "D"), F.when(stays & (turn["initial"] == "s"), _after(e, worn, "K"))).alias("s"),
        F.least(_after(u, 3, "D"), *stay("u", (e, 0, ""), (s, 0, ""), (a, 0, ""), (u, 2, "I"))).alias("u"),
        F.least(_after(a, 3, "D"), *stay("a", (u, 0, ""), (e, 2, "I"), (s, 2, "I"), (a, 2, "I"))).alias("a"),
    )


def _from_state(start: Column) -> Column:
    fresh = F.struct(F.lit(0).cast("long").alias("cost"), F.lit("").alias("audit"))
    return F.struct(*(F.when(start == x, fresh).otherwise(F.lit(None).cast(_BEST)).alias(x) for x in STATES))


def _over_block(acc: Column, block: Column) -> Column:
    """The four best paths after a block, whose ``ends`` hold the four structs for each state it may begin in."""

    def to(exit_: str) -> Column:
        ways = []
        for i, begin in enumerate(STATES):
            path, through = acc[begin], F.get(block["ends"], F.lit(i))[exit_]
            step = F.array(F.struct(block["first_at"].alias("first_at"), F.lit(exit_).alias("exit"), through["audit"].alias("piece")))
            both = F.struct((path["cost"] + through["cost"]).alias("cost"), F.concat(path["audit"], through["audit"]).alias("audit"), F.concat(path["trail"], step).alias("trail"))
            ways.append(F.when(path.isNotNull() & through.isNotNull(), both))
        return F.least(*ways)

    return F.struct(*(to(x).alias(x) for x in STATES))


def _close(acc: Column) -> Column:
    """The best legal end: as it is, or with the inserted turns that a system or user turn at the end needs."""

    def end(state: Column, tail: str) -> Column:
        step = F.array(F.struct(F.lit(None).cast("long").alias("first_at"), F.lit("a").alias("exit"), F.lit(tail).alias("piece")))
        longer = F.struct((state["cost"] + 2 * len(tail)).alias("cost"), F.concat(state["audit"], F.lit(tail)).alias("audit"), F.concat(state["trail"], step).alias("trail"))
        return F.when(state.isNotNull(), longer)

    return F.least(acc["e"], acc["a"], end(acc["u"], "I"), end(acc["s"], "II"))


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables: one row a conversation (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit), and the
    repaired turns (conv_id, part, place, edit, role, text), which ``part`` and ``place`` order within a conversation."""
    told = _told(turns)
    last = F.right(F.rtrim(F.col("text"), F.lit(WHITE)), F.lit(1))
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("digest").asc()]
    thin = told.select("conv_id", "turn", "role", "digest", (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("truncated"), F.rand(11).alias("spread"))
    # The last key only parts identical rows of one turn, so that no number of copies is one partition.
    ordered = thin.repartitionByRange(*keys, F.col("spread").asc()).sortWithinPartitions(*keys).drop("spread")
    rows = materialise(ordered.withColumn("at", F.monotonically_increasing_id()), "turns")

    first = rows.groupBy("conv_id", "role", "digest").agg(F.min("at").alias("at"))
    begins = first.groupBy("conv_id").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("begins"))
    marked = rows.join(first.select("at", F.lit(True).alias("first")), "at", "left").join(begins, "at", "left")
    block = Window.partitionBy("conv_id", "block").orderBy("at")
    initial = F.substring("role", 1, 1)
    flagged = (
        marked.withColumn("block", F.shiftright("at", BLOCK_BITS))
        .withColumn("initial", initial)
        .withColumn("before", F.lag("initial").over(block))
        .withColumn("turn_before", F.lag("turn").over(block))
        .withColumn("repeat", ~F.col("blank") & F.col("first").isNull())
        .withColumn("truncated", ~F.col("blank") & ~F.col("repeat") & F.col("truncated"))
    )
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    legal = ["su", "ua", "au"]
    new_turn = F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("turn_before"))
    blocks = flagged.groupBy("conv_id", "block").agg(
        F.array_sort(F.collect_list(F.struct("at", "initial", (F.col("blank") | F.col("repeat")).alias("must_go"), "truncated"))).alias("turns"),
        F.min("at").alias("first_at"),
        F.min_by("initial", "at").alias("first_initial"),
        F.max_by("initial", "at").alias("last_initial"),
        F.min("turn").alias("first_turn"),
        F.max("turn").alias("last_turn"),
        count(new_turn).alias("n_turns"),
        count(F.col("blank")).alias("blank"),
        count(F.col("repeat")).alias("duplicate"),
        count(F.col("truncated")).alias("truncated"),
        count(F.col("before").isNotNull() & ~F.concat("before", "initial").isin(legal)).alias("illegal"),
        F.coalesce(F.bool_or("begins"), F.lit(False)).alias("begins"),
    )
    starts = F.when(F.col("begins"), F.array(F.lit("e"))).otherwise(F.array(*map(F.lit, STATES)))
    blocks = blocks.withColumn("ends", F.transform(starts, lambda start: F.aggregate(F.col("turns"), _from_state(start), _step))).drop("turns", "begins")

    held = blocks.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("first_at", "first_initial", "last_initial", "first_turn", "last_turn", "ends"))).alias("blocks"),
        F.min("first_turn").alias("low"),
        F.max("last_turn").alias("high"),
        *(F.sum(c).alias(c) for c in ("n_turns", "blank", "duplicate", "truncated", "illegal")),
    )
    others = F.size("blocks") - 1
    pairs = F.zip_with(F.slice("blocks", 1, others), F.slice("blocks", 2, others), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    broken = F.size(F.filter(pairs, lambda p: ~F.concat(p["x"]["last_initial"], p["y"]["first_initial"]).isin(legal)))
    shared = F.size(F.filter(pairs, lambda p: F.coalesce(p["x"]["last_turn"] == p["y"]["first_turn"], F.lit(False))))
    nothing = F.struct(F.lit(0).cast("long").alias("cost"), F.lit("").alias("audit"), F.lit(None).cast("array<struct<first_at:bigint,exit:string,piece:string>>").alias("trail"))
    begin = F.struct(F.struct(nothing["cost"].alias("cost"), nothing["audit"].alias("audit"), F.array().cast("array<struct<first_at:bigint,exit:string,piece:string>>").alias("trail")).alias("e"), *(F.lit(None).cast(_PATH).alias(x) for x in "sua"))
    span = F.col("high").cast("decimal(21,0)") - F.col("low").cast("decimal(21,0)") + 1 - (F.col("n_turns") - shared)
    found = materialise(
        held.select(
            "conv_id",
            F.when(F.col("high").isNull(), F.lit(0).cast("long")).otherwise(span.try_cast("long")).alias("gaps"),
            "blank",
            "duplicate",
            "truncated",
            (F.col("illegal") + broken).alias("illegal"),
            F.aggregate("blocks", begin, _over_block, _close).alias("best"),
        ),
        "repairs",
    )
    summary = found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "best.cost", "best.audit")

    piece = F.col("t.piece")
    letters = F.posexplode(F.transform(F.sequence(F.lit(1), F.length("piece")), lambda i: F.substring(F.col("piece"), i, F.lit(1))))
    edits = found.select("conv_id", F.posexplode("best.trail").alias("part", "t")).select("conv_id", "part", F.col("t.first_at").alias("first_at"), F.col("t.exit").alias("exit"), piece.alias("piece"))
    edits = edits.select("*", letters.alias("place", "edit")).filter("edit <> 'D'")
    row = F.length(F.replace(F.left("piece", F.col("place") + 1), F.lit("I"), F.lit("")))
    behind = F.length(F.replace(F.substring(F.col("piece"), F.col("place") + 2, F.length("piece")), F.lit("D"), F.lit("")))
    given = F.when((behind % 2 == 0) == (F.col("exit") == "u"), "user").otherwise("assistant")
    edits = edits.select("conv_id", "part", "place", "edit", given.alias("given"), F.when(F.col("edit") != "I", F.col("first_at") + row - 1).alias("at"))
    kept = edits.filter("edit <> 'I'").join(rows.select("at", "role", "digest"), "at")
    texts = told.dropDuplicates(["conv_id", "role", "digest"])
    same = [kept["conv_id"].eqNullSafe(texts["conv_id"]), kept["role"] == texts["role"], kept["digest"] == texts["digest"]]
    final_role = F.when(F.col("edit") == "R", F.col("given")).otherwise(kept["role"])
    stayed = kept.join(texts, same).select(kept["conv_id"], "part", "place", "edit", final_role.alias("role"), texts["text"])
    inserted = edits.filter("edit = 'I'").select("conv_id", "part", "place", "edit", F.col("given").alias("role"), F.lit("").alias("text"))
    return summary, stayed.unionByName(inserted)


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256 of the lines ``role:text`` of each conversation, read in order as a stream of rows."""
    lines = repaired.select("conv_id", "part", "place", F.encode(F.concat("role", F.lit(":"), "text"), "UTF-8").alias("line"))
    in_order = lines.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "part", "place")
    kind = dict(repaired.dtypes)["conv_id"]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, running, kind_of_id = None, None, None
        for batch in batches:
            kind_of_id = batch.column(0).type
            ids, sums = [], []
            for key, line in zip(batch.column(0).to_pylist(), batch.column(3)):
                if running is None or key != current:
                    if running is not None:
                        ids.append(current)
                        sums.append(running.hexdigest())
                    current, running = key, hashlib.sha256(line.as_py())
                else:
                    running.update(b"\n")
                    running.update(line.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind_of_id), pa.array(sums, pa.string())], ["conv_id", "repaired_sha256"])
        if running is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current], kind_of_id), pa.array([running.hexdigest()], pa.string())], ["conv_id", "repaired_sha256"])

    return in_order.mapInArrow(hashed, f"conv_id {kind}, repaired_sha256 string")


def repaired_digests(conversations: DataFrame) -> DataFrame:
    """One row for every conv_id of ``conversations``, after :func:`damage` and :func:`repair`."""
    summary, repaired = repair(damage(conversations))
    every = conversations.select("conv_id").distinct()
    summary, sums = summary.withColumnRenamed("conv_id", "id"), digests(repaired).withColumnRenamed("conv_id", "id2")
    joined = every.join(summary, every["conv_id"].eqNullSafe(summary["id"]), "left").join(sums, every["conv_id"].eqNullSafe(sums["id2"]), "left")
    zero = lambda c: F.coalesce(F.col(c), F.when(F.col("audit").isNull(), F.lit(0).cast("long"))).alias(c)
    return joined.select(
        "conv_id",
        *(zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
