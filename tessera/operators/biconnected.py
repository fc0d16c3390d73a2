"""Blocks, cut vertices and cut edges of the undirected view, as joins, by a breadth-first forest where it is shallow.

Two breadth-first forests, the second without the edges of the first, part as the whole graph does when any vertex is taken away, so all other edges are left
out. An edge of the second closes a cycle with the first: its ends climb to where they meet, one step a pass, and the tree edges that they climb over are
linked. Components of the links are the blocks. A search sends each edge once from either end, and nothing else grows faster than the vertices.

Where the forest has more than ``_LEVELS`` levels, Tarjan and Vishkin's method does it: a spanning forest is grown by Boruvka rounds (each part takes its least edge
out, parts join, pointers are doubled to the new label). Each tree edge becomes two arcs; the arc after u->v is the one that follows v->u around v, so the arcs of a tree
are one circle, cut at its root; pointer doubling numbers them, which gives every vertex a preorder number and the size of its
subtree without any search. The least and greatest number that a subtree reaches by other edges are range queries over the
preorder, answered on blocks of 64 numbers, level by level. Tree edges that lie on a common cycle are then linked as above.
No step holds a component, or a vertex's neighbours, in one group; rounds are bounded by ``_LEVELS``, or logarithmic in the number of vertices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.centrality import both_ways, components
from tessera.operators.lists import list_ranks, numbered
from tessera.runtime import bucketed, discard, materialise

_BITS = 6
#: Levels of a breadth-first forest up to which its passes, one a level, are fewer or lighter than the rounds of the other method.
_LEVELS = 24


def _to_roots(hooks: DataFrame) -> DataFrame:
    """label, root of labels that point at each other's parts (label, to); the lesser of two that point at one another is a root."""
    back = hooks.select(F.col("label").alias("to"), F.col("to").alias("then"))
    now = hooks.join(back, "to", "left").select("label", F.when((F.col("then") == F.col("label")) & (F.col("label") < F.col("to")), F.col("label")).otherwise(F.col("to")).alias("root"))
    now = materialise(now, "hooks")
    while True:
        step = now.join(now.select(F.col("label").alias("root"), F.col("root").alias("next")), "root", "left")
        new = materialise(step.select("label", F.coalesce("next", "root").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "hooks")
        moved = not new.filter("moved").isEmpty()
        discard(now)
        now = new.select("label", "root")
        now._tessera_path = new._tessera_path
        if not moved:
            return now


def spanning_forest(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tree edges (a, b) out of the distinct pairs (a < b), and (id, root) of every vertex that has an edge."""
    left = materialise(pairs.select("a", "b", F.col("a").alias("x"), F.col("b").alias("y")), "forest-left")
    label = materialise(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("root", F.col("id")), "forest-label")
    tree = None
    while not left.isEmpty():
        out = left.select(F.explode(F.array(F.struct(F.col("x").alias("label"), F.col("y").alias("to")), F.struct(F.col("y").alias("label"), F.col("x").alias("to")))).alias("l"), "a", "b")
        least = materialise(out.groupBy("l.label").agg(F.min(F.struct("a", "b", "l.to")).alias("e")).select("label", "e.a", "e.b", "e.to"), "forest-least")
        taken = materialise(least.select("a", "b").distinct(), "forest-taken")
        tree = taken if tree is None else tree.unionByName(taken)
        roots = _to_roots(least.select("label", "to"))
        # A label without an edge out is final.
        new = materialise(label.join(roots.select(F.col("label").alias("root"), F.col("root").alias("new")), "root", "left").select("id", F.coalesce("new", "root").alias("root")), "forest-label")
        ends = left.join(roots.select(F.col("label").alias("x"), F.col("root").alias("rx")), "x").join(roots.select(F.col("label").alias("y"), F.col("root").alias("ry")), "y").filter("rx <> ry")
        ends = ends.groupBy(F.least("rx", "ry").alias("x"), F.greatest("rx", "ry").alias("y")).agg(F.min(F.struct("a", "b")).alias("e"))
        more = materialise(ends.select("e.a", "e.b", "x", "y"), "forest-left")
        for old in (left, label, least, roots):
            discard(old)
        left, label = more, new
    return (pairs.limit(0) if tree is None else tree), label


def extremes(values: DataFrame, asked: DataFrame) -> DataFrame:
    """key, low, high: least ``low`` and greatest ``high`` of the values (place, low, high; places dense from 0) from ``first`` to ``last`` of each query (key, first, last)."""
    side = 1 << _BITS
    block = lambda c: F.shiftright(c, _BITS)
    cells = values.groupBy(block(F.col("place")).alias("block")).agg(F.array_sort(F.collect_list(F.struct("place", "low", "high"))).alias("cells"))
    cells = materialise(cells.select("block", F.transform("cells", lambda c: c["low"]).alias("lows"), F.transform("cells", lambda c: c["high"]).alias("highs")), "extremes")
    asked = asked.withColumn("from", block(F.col("first"))).withColumn("to", block(F.col("last")))
    within = F.col("from") == F.col("to")
    ends = asked.select("key", F.explode(F.when(within, F.array(F.struct(F.col("from").alias("block"), "first", "last"))).otherwise(F.array(
        F.struct(F.col("from").alias("block"), "first", ((F.col("from") + 1) * side - 1).alias("last")), F.struct(F.col("to").alias("block"), (F.col("to") * side).alias("first"), "last")))).alias("e")).select("key", "e.*")
    start, length = (F.col("first") % side + 1).cast("int"), (F.col("last") - F.col("first") + 1).cast("int")
    found = ends.join(cells, "block").select("key", F.array_min(F.slice("lows", start, length)).alias("low"), F.array_max(F.slice("highs", start, length)).alias("high"))
    between = materialise(asked.filter(F.col("to") > F.col("from") + 1).select("key", (F.col("from") + 1).alias("first"), (F.col("to") - 1).alias("last")), "extremes-asked")
    if not between.isEmpty():
        found = found.unionByName(extremes(cells.select(F.col("block").alias("place"), F.array_min("lows").alias("low"), F.array_max("highs").alias("high")), between))
    return found.groupBy("key").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def _by_preorder(pairs: DataFrame) -> DataFrame:
    """:func:`blocks` of the distinct pairs (a < b), however deep they go."""
    tree, label = spanning_forest(pairs)
    both = tree.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(tree.select(F.col("b").alias("u"), F.col("a").alias("v")))
    arcs = materialise(numbered(both, F.col("u"), F.col("v"), name="arc"), "arcs")
    around = materialise(arcs.groupBy("u").agg(F.min("arc").alias("first"), F.max("arc").alias("last")), "around")
    turned = arcs.join(arcs.select(F.col("u").alias("v"), F.col("v").alias("u"), F.col("arc").alias("back")), ["u", "v"])
    turned = turned.join(around.withColumnRenamed("u", "v"), "v").select("arc", "back", "u", "v", F.when(F.col("back") == F.col("last"), F.col("first")).otherwise(F.col("back") + 1).alias("after"))
    starts = label.select(F.col("root").alias("u")).distinct().join(around, "u").select(F.col("first").alias("after"), F.lit(True).alias("start"))
    turned = materialise(turned.join(starts, "after", "left").withColumn("after", F.when(F.col("start").isNull(), F.col("after"))).drop("start"), "turned")
    steps = list_ranks(turned.select(F.col("arc").alias("item"), "after")).select(F.col("item").alias("arc"), "steps")
    down = turned.join(steps, "arc").join(steps.select(F.col("arc").alias("back"), F.col("steps").alias("up")), "back").filter("steps > up")
    down = down.select(F.col("u").alias("parent"), F.col("v").alias("id"), "steps", ((F.col("steps") - F.col("up") + 1) / 2).cast("long").alias("size")).join(label, "id")
    tops = label.groupBy("root").agg(F.count(F.lit(1)).alias("size")).select(F.lit(None).cast("long").alias("parent"), F.col("root").alias("id"), F.lit(2**62).cast("long").alias("steps"), "size", "root")
    tree_rows = numbered(down.select("parent", "id", "steps", "size", "root").unionByName(tops), F.col("root"), F.col("steps").desc(), name="place")
    vertex = materialise(tree_rows.select("id", "parent", "place", "size"), "vertex")

    at = lambda end: vertex.select(F.col("id").alias(end), F.col("place").alias(f"{end}_place"), F.col("size").alias(f"{end}_size"))
    rest = materialise(pairs.join(tree, ["a", "b"], "left_anti").join(at("a"), "a").join(at("b"), "b"), "rest")
    reach = rest.select(F.col("a_place").alias("place"), F.col("b_place").alias("far")).unionByName(rest.select(F.col("b_place").alias("place"), F.col("a_place").alias("far")))
    own = vertex.select("place", F.col("place").alias("far")).unionByName(reach).groupBy("place").agg(F.min("far").alias("low"), F.max("far").alias("high"))
    span = extremes(own, vertex.select(F.col("place").alias("key"), F.col("place").alias("first"), (F.col("place") + F.col("size") - 1).alias("last"))).withColumnRenamed("key", "place")

    first, second = (F.when(F.col("a_place") < F.col("b_place"), F.col(x)).otherwise(F.col(y)) for x, y in (("a", "b"), ("b", "a")))
    apart = F.when(F.col("a_place") < F.col("b_place"), F.col("a_place") + F.col("a_size") <= F.col("b_place")).otherwise(F.col("b_place") + F.col("b_size") <= F.col("a_place"))
    crossing = rest.filter(apart).select(first.alias("a"), second.alias("b"))
    above = vertex.filter("parent IS NOT NULL").select(F.col("id").alias("parent"), F.col("place").alias("p_place"), F.col("size").alias("p_size"))
    leaving = vertex.join(above, "parent").join(span, "place").filter("low < p_place OR high >= p_place + p_size").select(F.col("parent").alias("a"), F.col("id").alias("b"))
    linked = components(crossing.unionByName(leaving))
    out = vertex.filter("parent IS NOT NULL").join(linked.withColumnRenamed("root", "block"), "id", "left")
    return out.select("parent", F.col("id").alias("child"), F.coalesce("block", "id").alias("block"))


def _search(both: DataFrame, roots: DataFrame, avoid: DataFrame | None) -> list[DataFrame] | None:
    """id, parent, other of each level of a breadth-first search from ``roots`` (id), a table a level; nothing if there are more than ``_LEVELS``.

    Edges to the node's ``other`` (its parent in ``avoid``, in buckets of id) or from there are left out.
    """
    none = F.lit(None).cast("long")
    start = roots.select("id", none.alias("parent"))
    start = start.withColumn("other", none) if avoid is None else start.join(avoid, "id")
    levels = [bucketed(start.select("id", "parent", "other"), "id", "level")]
    while True:
        front = levels[-1].select(F.col("id").alias("a"), F.col("parent").alias("up"), "other").hint("shuffle_hash")
        sent = both.join(front, "a").filter("(up IS NULL OR b <> up) AND (other IS NULL OR b <> other)")
        got = sent.groupBy(F.col("b").alias("id"))
        if avoid is None:
            got = got.agg(F.min("a").alias("parent")).withColumn("other", none)
        else:
            # The least neighbour that is not the parent in the other forest.
            got = got.agg(F.min("a").alias("parent"), F.max("a").alias("last")).join(avoid.hint("shuffle_hash"), "id")
            beside = F.when(F.col("other").isNull() | (F.col("parent") != F.col("other")), F.col("parent")).when(F.col("last") != F.col("other"), F.col("last"))
            got = got.withColumn("parent", beside).filter("parent IS NOT NULL")
        for near in levels[-2:]:
            got = got.join(near.select("id").hint("shuffle_hash"), "id", "left_anti")
        level = bucketed(got.select("id", "parent", "other"), "id", "level", in_place=True)
        if level.isEmpty():
            discard(level)
            return levels
        levels.append(level)
        if len(levels) > _LEVELS:
            for old in levels:
                discard(old)
            return None


def _forest(both: DataFrame, avoid: DataFrame | None = None) -> DataFrame | None:
    """id, parent, level of a breadth-first forest, in buckets of id: one search from the node with most edges, one from a node of each component left.

    ``avoid`` (id, other) is the forest whose edges are left out. Nothing if a search is too deep.
    """
    near = both.groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    if avoid is not None:
        below = avoid.groupBy(F.col("other").alias("id")).agg(F.count(F.lit(1)).alias("below"))
        near = near.join(below.hint("shuffle_hash"), "id", "left").select("id", (F.col("n") - F.coalesce("below", F.lit(0))).alias("n"))
    hub = near.orderBy(F.desc("n"), "id").limit(1).select("id")
    out = None
    while True:
        levels = _search(both, hub, avoid)
        if levels is None:
            return None
        rows = None if out is None else out
        for n, level in enumerate(levels):
            at = level.select("id", "parent", F.lit(n).alias("level"))
            rows = at if rows is None else rows.unionByName(at)
        new = bucketed(rows, "id", "forest")
        for old in levels:
            discard(old)
        if out is not None:
            discard(out)
            return new
        out = new
        rest = both.join(out.select(F.col("id").alias("a")).hint("shuffle_hash"), "a", "left_anti")
        if avoid is None:
            rest = rest.filter("a < b")
        else:
            upper, lower = (avoid.select(F.col("id").alias(end), F.col("other").alias(f"{end}_up")) for end in ("a", "b"))
            rest = rest.filter("a < b").join(upper, "a").join(lower, "b").filter("(a_up IS NULL OR a_up <> b) AND (b_up IS NULL OR b_up <> a)").select("a", "b")
        rest = materialise(rest, "forest-rest")
        if rest.isEmpty():
            return out
        hub = components(rest).select(F.col("root").alias("id")).distinct()
        discard(rest)


def _links(vertex: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b: lower ends of tree edges that lie on a common cycle, from the edges (x, y) beside a breadth-first forest (id, parent, level)."""
    at = lambda end: vertex.select(F.col("id").alias(end), F.col("parent").alias(f"{end}p"), F.col("level").alias(f"{end}l")).hint("shuffle_hash")
    row = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), F.col(a).alias("a"), F.col(b).alias("b"))
    further = lambda a, b: F.struct(F.lit("open").alias("kind"), F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    step = F.when(F.col("xl") > F.col("yl"), F.array(row("link", "x", "xp"), further("xp", "y"))).when(F.col("xl") < F.col("yl"), F.array(row("link", "y", "yp"), further("x", "yp")))
    step = step.when(F.col("xp") == F.col("yp"), F.array(row("link", "x", "y"))).otherwise(F.array(row("link", "x", "xp"), row("link", "y", "yp"), further("xp", "yp")))
    out, now = None, pairs
    while True:
        done = materialise(now.join(at("x"), "x").join(at("y"), "y").select(F.explode(step).alias("s")).select("s.*").distinct(), "climbed")
        links = done.filter("kind = 'link'").select("a", "b")
        out = links if out is None else out.unionByName(links)
        now = done.filter("kind = 'open'").select(F.col("a").alias("x"), F.col("b").alias("y"))
        if now.isEmpty():
            return out.distinct()


def blocks(edges: DataFrame) -> DataFrame:
    """parent, child, block of each edge of a spanning forest: edges of one block lie on common cycles, an edge alone in its block on none."""
    both = both_ways(edges)
    vertex = _forest(both)
    if vertex is None:
        return _by_preorder(materialise(both.filter("a < b"), "pairs"))
    up = vertex.select("id", F.col("parent").alias("other"))
    second = _forest(both, up)
    if second is None:
        # Too deep: all edges beside the first forest.
        parents = lambda end: up.select(F.col("id").alias(end), F.col("other").alias(f"{end}_up"))
        beside = both.filter("a < b").join(parents("a"), "a").join(parents("b"), "b").filter("(a_up IS NULL OR a_up <> b) AND (b_up IS NULL OR b_up <> a)").select(F.col("a").alias("x"), F.col("b").alias("y"))
    else:
        beside = second.filter("parent IS NOT NULL").select(F.col("id").alias("x"), F.col("parent").alias("y"))
    linked = components(_links(vertex, beside))
    discard(both)
    out = vertex.filter("parent IS NOT NULL").join(linked.withColumnRenamed("root", "block"), "id", "left")
    return out.select("parent", F.col("id").alias("child"), F.coalesce("block", "id").alias("block"))


def articulation_points(edges: DataFrame) -> DataFrame:
    """Ids whose removal parts their component: those that lie in two blocks or more."""
    ends = blocks(edges).select(F.explode(F.array("parent", "child")).alias("id"), "block").distinct()
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id")


def cut_edges(edges: DataFrame) -> DataFrame:
    """a, b: pairs whose removal parts their component, parallel edges taken as one."""
    single = blocks(edges).groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.min("parent").alias("p"), F.min("child").alias("c")).filter("n = 1")
    return single.select(F.least("p", "c").alias("a"), F.greatest("p", "c").alias("b"))
