"""Searches over graph nodes: by name, by tool score, by task, with kind boosts; context packs."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import search
from tessera.sources.adapters import Graph

# Words of a query that ask for a kind, and how much its kinds gain.
KIND_BOOSTS = [
    (("function", "method", "fn", "func"), {"function": 1.3, "method": 1.2}),
    (("class", "struct", "type"), {"class": 1.3, "type": 1.2}),
    (("module", "package", "lib"), {"module": 1.3}),
]
# Kinds that stand for real symbols.
DEFINITION_KINDS = ["function", "method", "class", "type", "trait", "impl", "module"]


def kind_boosts(query: str) -> dict[str, float]:
    low = query.lower()
    return next((b for words, b in KIND_BOOSTS if any(w in low for w in words)), {})


def kind_boost(query: str, kind: Column) -> Column:
    out = F.lit(1.0)
    for k, boost in kind_boosts(query).items():
        out = F.when(kind == k, boost).otherwise(out)
    return out


def is_symbol_query(query: str) -> bool:
    q = query.strip()
    return bool(q) and " " not in q and (any(c in q for c in ("::", ".", "_")) or any(c.isupper() for c in q))


def is_definition(qualified_name: Column, kind: Column) -> Column:
    return ~F.startswith(qualified_name, F.lit("call::")) & kind.isin(DEFINITION_KINDS)


def source_stem(uri: Column) -> Column:
    """File name without its last suffix."""
    return F.regexp_replace(F.regexp_extract(uri, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def strip_diacritics(text: Column) -> Column:
    """Compatibility decomposition without combining marks."""

    @F.arrow_udf("string")
    def run(a: pa.Array) -> pa.Array:
        return pa.array([None if t is None else t if t.isascii() else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)) for t in a.to_pylist()], pa.string())

    return run(text)


def search_text(nodes: DataFrame) -> DataFrame:
    """id, text: the searchable fields of a node between zero bytes, so that no run of characters spans two of them."""
    joined = lambda c: F.array_join(T.search_tokens(F.coalesce(c, F.lit(""))), " ")
    fields = [F.lower("name"), joined(F.col("name")), F.col("id").cast("string"), F.lower(F.coalesce("source_uri", F.lit(""))), joined(F.col("source_uri")), F.lower("qualified_name"), joined(F.lower("qualified_name"))]
    return nodes.select("id", F.concat_ws("\0", *fields).alias("text"))


def by_name(nodes: DataFrame, name: str, *, exact: bool = False, limit: int = 50) -> DataFrame:
    """id, score: nodes called ``name``, or whose name holds it, by tiered score."""
    low = name.lower()
    hit = F.lower("name") == low if exact else F.contains(F.lower("name"), F.lit(low))
    scored = search.tiered(nodes, "id", F.col("name"), name, limit=limit)
    out = scored.join(nodes.select("id", "name"), "id").filter(hit)
    return out.select("id", (F.lit(1.0) if exact else F.round(0.5 + F.least(F.col("score") / 1000, F.lit(0.5)), 6)).alias("score"))


def tool_search(nodes: DataFrame, query: str, *, limit: int = 50) -> DataFrame:
    """id, score: 1 equal, .9 prefix, .7 inside, .4 letters in order, .3 a word in common."""
    q = query.strip().lower()
    name, qn = F.lower(F.coalesce("name", F.lit(""))), F.lower(F.coalesce("qualified_name", F.lit("")))
    in_order = ".*" + ".*".join(re.escape(c) for c in q) + ".*"
    words = F.array(*(F.lit(w) for w in sorted(set(re.findall(r"\w+", q)))))
    either = lambda f: f(name) | f(qn)
    score = (
        F.when(either(lambda c: c == q), 1.0)
        .when(either(lambda c: F.startswith(c, F.lit(q))), 0.9)
        .when(either(lambda c: F.contains(c, F.lit(q))), 0.7)
        .when(either(lambda c: c.rlike(f"(?s)^{in_order}$")), 0.4)
        .when(either(lambda c: F.arrays_overlap(F.regexp_extract_all(c, F.lit(r"(\w+)"), 1), words)), 0.3)
        .otherwise(0.0)
    )
    return nodes.select("id", score.alias("score")).filter("score > 0").orderBy(F.desc("score"), "id").limit(limit)


def task_aware(nodes: DataFrame, query: str, *, intent: str | None = None, limit: int = 20) -> DataFrame:
    """id, score: tiered score times .35 without a file, .5 for variables, and the gain that the intent gives a kind."""
    intent = intent or T.intent_of(query)
    scored = search.tiered(nodes, "id", F.col("name"), query, limit=limit).join(nodes.select("id", "kind", "source_uri"), "id")
    score = F.col("score") * F.when(F.col("source_uri").isNull(), 0.35).otherwise(1.0) * F.when(F.col("kind") == "variable", 0.5).otherwise(1.0)
    if intent == "impact":
        score = score * F.when(F.col("kind").isin("function", "class"), 1.3).otherwise(1.0)
    elif intent == "architecture":
        score = score * F.when(F.col("kind") == "module", 1.5).otherwise(1.0)
    return scored.select("id", F.round(score, 6).alias("score")).filter("score > 0.3").orderBy(F.desc("score"), "id").limit(limit)


def hybrid(nodes: DataFrame, query: str, *, intent: str | None = None, limit: int = 20) -> DataFrame:
    """place, id, qualified_name, kind, score: task-aware hits with what a caller shows of them."""
    hits = task_aware(nodes, query, intent=intent, limit=limit)
    place = F.row_number().over(Window.orderBy(F.desc("score"), "id"))  # ``limit`` rows
    return hits.join(nodes.select("id", "qualified_name", "kind"), "id").select(place.alias("place"), "id", "qualified_name", "kind", "score")


def fuzzy_score(query: str, target: Column) -> Column:
    """The best of seven signals between a query and a name."""
    q, target = F.lit(query), F.coalesce(target, F.lit(""))
    compact = re.sub(r"[^0-9A-Za-z]", "", query)
    cq, ct = F.lit(compact), F.regexp_replace(target, r"[^\p{L}\p{N}]", "")
    words = F.filter(F.split(target, r"\s+"), lambda w: w != "")
    acronym = F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")
    common = F.array_sort(F.array_intersect(F.array_distinct(F.split(q, r"\s+")), F.array_distinct(words)))
    text = F.array_join(common, " ")
    in_order = ct.rlike("(?s)^.*" + ".*".join(re.escape(c) for c in compact) + ".*$")
    signals = [
        T.ratio(q, target),
        T.ratio(cq, ct),
        T.partial_ratio(cq, ct),
        T.token_sort_ratio(q, target),
        F.when(F.size(common) == 0, 0.0).otherwise(F.greatest(T.ratio(text, q), T.ratio(text, target))),
        T.ratio(cq, acronym),
        F.when(in_order, F.lit(float(len(compact))) / F.greatest(F.length(ct), F.lit(1))).otherwise(0.0),
    ]
    return F.when((q == "") | (target == ""), 0.0).otherwise(F.round(F.greatest(*signals), 6))


def embedding_text(nodes: DataFrame) -> DataFrame:
    """id, text: kind, name, qualified name and file of a node on lines."""
    return nodes.select("id", F.concat_ws("\n", "kind", "name", "qualified_name", "source_uri").alias("text"))


def context_pack(g: Graph, query: str, *, seeds: DataFrame | None = None, budget: int = 2400, max_items: int = 20, n_seeds: int = 5, per_seed: int | None = None) -> DataFrame:
    """id, role, score, tokens: seeds of a search with their neighbours, the most relevant within the budget.

    A candidate is worth 3 if the query is in its name, 2 in its qualified name, 1 in its content; a file that is
    already taken twice gives no more. Neighbours are candidates up to ``max_items`` a seed, by id.
    """
    per_seed = per_seed or max_items
    if seeds is None:
        seeds = hybrid(g.nodes, query, limit=n_seeds)
    top = seeds.orderBy(F.desc("score"), "id").limit(n_seeds).select("id")
    ends = [("dst", "src", "caller"), ("src", "dst", "callee")]
    near = [g.edges.join(F.broadcast(top.withColumnRenamed("id", here)), here).select(F.col(here).alias("seed"), F.col(there).alias("id"), F.lit(role).alias("role")).distinct() for here, there, role in ends]
    nth = F.row_number().over(Window.partitionBy("seed").orderBy("role", "id"))
    around = near[0].unionByName(near[1]).withColumn("nth", nth).filter(F.col("nth") <= per_seed)
    rank = {"seed": 0, "callee": 1, "caller": 2}
    best = top.select("id", F.lit(0).alias("rank")).unionByName(around.select("id", F.when(F.col("role") == "callee", 1).otherwise(2).alias("rank"))).groupBy("id").agg(F.min("rank").alias("rank"))
    low = query.lower()
    holds = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(low)).cast("int")
    content = F.concat(F.lit("# "), "kind", F.lit(": "), "qualified_name")
    d = g.nodes.join(F.broadcast(best), "id").withColumn("content", content)
    d = d.select("id", F.element_at(F.create_map(*(F.lit(x) for k, v in rank.items() for x in (v, k))), F.col("rank")).alias("role"), (3 * holds(F.col("name")) + 2 * holds(F.col("qualified_name")) + holds(F.col("content"))).alias("score"), F.greatest(F.lit(1), F.floor(F.length("content") / 4)).cast("long").alias("tokens"), F.coalesce("source_uri", "qualified_name").alias("file"))
    # At most n_seeds * (2 * per_seed + 1) rows from here on.
    in_file = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("score"), "id"))
    d = d.withColumn("in_file", in_file).filter("in_file <= 2")
    order = Window.orderBy(F.desc("score"), "id")
    d = d.withColumn("running", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("place", F.row_number().over(order))
    return d.filter((F.col("running") <= budget) & (F.col("place") <= max_items)).select("id", "role", "score", "tokens")
