"""Community structure: quality of a partition, detection, splitting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera import schemas
from tessera.operators.centrality import components
from tessera.operators.modularity import MAP_EQUATION, detect
from tessera.runtime import discard, materialise
from tessera.sources.adapters import Graph


def by_source(g: Graph) -> DataFrame:
    """id, community: one community per source file, numbered by its first node."""
    first = g.nodes.filter("source_uri IS NOT NULL").groupBy("source_uri").agg(F.min("id").alias("community"))
    return g.nodes.select("id", "source_uri").join(first, "source_uri").select("id", "community")


def _labelled(edges: DataFrame, communities: DataFrame) -> DataFrame:
    c = communities.select("id", "community")
    return edges.join(c.select(F.col("id").alias("src"), F.col("community").alias("a")), "src").join(c.select(F.col("id").alias("dst"), F.col("community").alias("b")), "dst")


def cohesion(g: Graph, communities: DataFrame) -> DataFrame:
    """Distinct inner pairs over n (n - 1) / 2; singletons 1."""
    size = communities.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    inner = _labelled(g.edges.filter("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), communities).filter("a = b").groupBy(F.col("a").alias("community")).agg(F.count(F.lit(1)).alias("pairs"))
    n = F.col("size").cast("double")
    return size.join(inner, "community", "left").select("community", "size", F.when(F.col("size") < 2, 1.0).otherwise(F.round(F.coalesce("pairs", F.lit(0)) / (n * (n - 1) / 2), 6)).alias("cohesion"))


def conductance(g: Graph, communities: DataFrame) -> DataFrame:
    """Edges leaving a community over the smaller of its volume and the rest's."""
    e = _labelled(g.edges, communities)
    total = e.count()
    ends = e.select(F.explode(F.array(F.struct(F.col("a").alias("c"), (F.col("a") != F.col("b")).cast("long").alias("cut")), F.struct(F.col("b").alias("c"), (F.col("a") != F.col("b")).cast("long").alias("cut")))).alias("x"))
    v = ends.groupBy(F.col("x.c").alias("community")).agg(F.count(F.lit(1)).alias("volume"), F.sum("x.cut").alias("cut"))
    smaller = F.least("volume", F.lit(2 * total) - F.col("volume"))
    return v.select("community", "volume", "cut", F.when(smaller > 0, F.round(F.col("cut") / smaller, 6)).otherwise(0.0).alias("conductance"))


def modularity(g: Graph, communities: DataFrame) -> DataFrame:
    """Of the undirected simple graph: sum over communities of inner share minus squared degree share."""
    e = _labelled(g.edges.filter("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), communities)
    ends = e.select(F.explode(F.array(F.struct(F.col("a").alias("c"), (F.col("a") == F.col("b")).cast("long").alias("inner")), F.struct(F.col("b").alias("c"), F.lit(0).cast("long").alias("inner")))).alias("x"))
    v = ends.groupBy("x.c").agg(F.count(F.lit(1)).alias("d"), F.sum("x.inner").alias("inner"))
    m = e.agg(F.count(F.lit(1)).alias("m")).first()["m"]
    return v.agg(F.coalesce(F.round(F.sum(F.col("inner") / F.lit(float(max(m, 1))) - F.pow(F.col("d") / F.lit(2.0 * max(m, 1)), 2)), 6), F.lit(0.0)).alias("modularity"))


def partition_quality(g: Graph, communities: DataFrame, resolution: float = 1.0) -> DataFrame:
    size = communities.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    n = communities.count()
    s = size.agg(F.count(F.lit(1)).alias("communities"), F.min("size").alias("smallest"), F.max("size").alias("largest"), F.sum((F.col("size") == 1).cast("long")).alias("singletons"), F.round(F.sqrt(F.sum(F.pow(F.col("size") / F.lit(float(max(n, 1))), 2)) * resolution), 6).alias("concentration"))
    c = conductance(g, communities).agg(F.round(F.avg("conductance"), 6).alias("mean_conductance"), F.max("conductance").alias("max_conductance"))
    return s.withColumn("k", F.lit(1)).join(c.withColumn("k", F.lit(1)), "k").drop("k")


def coupling(g: Graph, communities: DataFrame) -> DataFrame:
    e = _labelled(g.edges, communities).filter("a <> b")
    return e.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def warnings(g: Graph, communities: DataFrame, *, low: int = 5, high: int = 20, loose: float = 0.1) -> DataFrame:
    tight = coupling(g, communities).filter(F.col("n") >= low).select(F.concat_ws("-", "a", "b").alias("subject"), F.when(F.col("n") >= high, "high_coupling").otherwise("coupling").alias("warning"))
    thin = cohesion(g, communities).filter(F.col("cohesion") < loose).select(F.col("community").cast("string").alias("subject"), F.lit("low_cohesion").alias("warning"))
    return tight.unionByName(thin)


def summaries(g: Graph, communities: DataFrame, top: int = 3) -> DataFrame:
    """Size and most frequent kinds of each community."""
    k = communities.join(g.nodes.select("id", "kind"), "id").groupBy("community", "kind").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("n"), "kind"))
    ranked = k.withColumn("rank", rank)
    return ranked.groupBy("community").agg(F.sum("n").alias("size"), F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("rank") <= top, F.struct("rank", "kind")))), lambda x: x["kind"]), ",").alias("top_kinds"))


def split_half(communities: DataFrame, *, max_size: int) -> DataFrame:
    """Communities above ``max_size`` cut in two by node order, the second half under a fresh number."""
    w = Window.partitionBy("community")
    place = F.row_number().over(w.orderBy("id"))
    size = F.count(F.lit(1)).over(w)
    fresh = communities.agg(F.max("community")).first()[0] or 0
    return communities.withColumn("place", place).withColumn("size", size).select("id", F.when((F.col("size") > max_size) & (F.col("place") > F.expr("size div 2")), F.col("community") + F.lit(fresh + 1)).otherwise(F.col("community")).alias("community"))


def working_graph(edges: DataFrame) -> DataFrame:
    """src, dst, w: community weights summed over parallel edges, self-loops at half weight."""
    w = F.when(F.col("conf_class") == "ambiguous", schemas.DEFAULTS["ambiguous_community"]).otherwise(schemas.weight(F.col("kind"), schemas.COMMUNITY, schemas.DEFAULTS["community"]))
    return edges.select("src", "dst", (w * F.when(F.col("src") == F.col("dst"), 0.5).otherwise(1.0)).alias("w")).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def label_propagation(g: Graph) -> DataFrame:
    """id, community: weighted label propagation, ties to the smaller label, until no node wants another label.

    Of two neighbours of which one wants the label that the other wants to leave only one moves (by hash of the id). Nobody counts on a tie that is about to go then, so a round
    adds to the weight of edges within a community, or keeps it and lowers labels: the rounds come to an end. After the first round only neighbours of
    nodes that moved vote again, and nodes that still want to move.
    """
    w = working_graph(g.edges).filter("src <> dst")
    both = w.unionByName(w.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg(F.round(F.sum("w"), 9).alias("w"))
    both = materialise(both, "lp-edges")
    label = materialise(g.nodes.select("id", F.col("id").alias("community")), "lp")
    turn = lambda c: F.struct(F.xxhash64(c), F.col(c).alias("id"))
    votes, asked = both, None
    while True:
        votes = votes.join(label.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id"), "community").agg(F.sum("w").alias("w"))
        vote = F.struct(F.round("w", 6).alias("w"), (-F.col("community")).alias("c"))
        own = votes.join(label.withColumnRenamed("community", "home"), "id").groupBy("id", "home").agg(F.max(vote).alias("best"), F.max(F.when(F.col("community") == F.col("home"), vote)).alias("stay"))
        want = materialise(own.filter("stay IS NULL OR best > stay").select("id", "home", (-F.col("best.c")).alias("new")), "lp-want")
        if asked is not None:
            discard(asked)
        if want.isEmpty():
            return label
        mine, other = want.select(F.col("id").alias("src"), F.col("home").alias("from"), F.col("new").alias("to")), want.withColumnRenamed("id", "dst")
        rivals = both.join(mine, "src").join(other, "dst").filter("to = home OR new = from").groupBy(F.col("src").alias("id")).agg(F.min(turn("dst")).alias("rival"))
        done = want.join(rivals, "id", "left").select("id", "new", (F.col("rival").isNull() | (turn("id") < F.col("rival"))).alias("goes"))
        done = materialise(done, "lp-done")
        goes = done.filter("goes")
        next_ = materialise(label.join(goes.select("id", "new"), "id", "left").select("id", F.coalesce("new", "community").alias("community")), "lp")
        near = both.join(goes.select(F.col("id").alias("dst")), "dst", "left_semi").select("src")
        asked = materialise(near.unionByName(done.select(F.col("id").alias("src"))).distinct(), "lp-asked")
        votes = both.join(asked, "src", "left_semi")
        discard(want)
        discard(done)
        discard(label)
        label = next_


def louvain(g: Graph, *, resolution: float = 1.0) -> DataFrame:
    """id, community: modularity by rounds of moves and contraction, whatever the size of a component."""
    return _with_lone_nodes(g, detect(working_graph(g.edges), resolution=resolution))


def _with_lone_nodes(g: Graph, found: DataFrame) -> DataFrame:
    return g.nodes.select("id").join(found, "id", "left").select("id", F.coalesce("community", "id").alias("community"))


def enforce_connected(g: Graph, communities: DataFrame) -> DataFrame:
    """Split each community into its connected parts, named by their smallest node."""
    inner = _labelled(g.edges.select("src", "dst"), communities).filter("a = b")
    roots = components(inner.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return communities.select("id").join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("community"))


def leiden(g: Graph, *, resolution: float = 1.0) -> DataFrame:
    """id, community: the same with communities parted into connected pieces before each contraction; all are connected."""
    return enforce_connected(g, _with_lone_nodes(g, detect(working_graph(g.edges), resolution=resolution, connected=True)))


def infomap(g: Graph) -> DataFrame:
    """id, community: search of the map equation by rounds of moves and contraction, whatever the size of a component."""
    return _with_lone_nodes(g, detect(working_graph(g.edges), aim=MAP_EQUATION))


def map_equation(g: Graph, communities: DataFrame) -> DataFrame:
    """Description length of a walk under the partition, undirected weights: index plus module code lengths."""
    w = _labelled(working_graph(g.edges), communities)
    two_m = 2 * (w.agg(F.sum("w")).first()[0] or 0.0)
    ends = w.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("a").alias("c"), F.when(F.col("a") != F.col("b"), F.col("w")).otherwise(0.0).alias("out"), "w"), F.struct(F.col("dst").alias("id"), F.col("b").alias("c"), F.when(F.col("a") != F.col("b"), F.col("w")).otherwise(0.0).alias("out"), "w"))).alias("x"))
    unit = F.lit(two_m if two_m else 1.0)
    plogp = lambda p: F.when(p > 0, p * F.log2(p)).otherwise(0.0)
    node = ends.groupBy("x.id", "x.c").agg((F.sum("x.w") / unit).alias("p"), (F.sum("x.out") / unit).alias("q"))
    module = node.groupBy("c").agg(F.sum("p").alias("p"), F.sum("q").alias("q"), F.sum(plogp(F.col("p"))).alias("inner"))
    s = module.agg(F.sum("q").alias("q"), F.sum(plogp(F.col("q"))).alias("ql"), F.sum(plogp(F.col("p") + F.col("q"))).alias("pq"), F.sum("inner").alias("inner"))
    return s.select(F.round(plogp(F.col("q")) - 2 * F.col("ql") + F.col("pq") - F.col("inner"), 6).alias("bits"))
