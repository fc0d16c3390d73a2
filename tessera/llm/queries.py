"""Queries of this subpackage, in the form the driver's entry module registers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import collision_ann, context_tree, language, mixing, packing, quality, sharding, simhash, toxicity
from tessera.llm.conversations import repaired_digests
from tessera.llm.exact_dedup import exact_dedup
from tessera.llm.runs import run_digests
from tessera.llm.suffix_index import removed_digests
from tessera.runtime import read_table

Query = Callable[[SparkSession, str], DataFrame]


def remainder(n: int) -> Column:
    """CRC-32 of the id as text, modulo n; a null id is held out of training."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def held_out(n: int, value: int) -> Column:
    return F.coalesce(remainder(n) == value, F.lit(True))


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collision_ann.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op2_language_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = language.train(docs.select("doc_id", "lang", "text"), train_on=~held_out(4, 2))
    return language.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.replicate(read_table(spark, sf_dir, "documents"), temper=0.5, seed=3)
    return mixed.select("doc_id", "source", F.round("rate", 9).alias("rate"), F.col("n_copies").cast("long").alias("n_copies"), F.col("replica").cast("long").alias("replica"), "shuffle_key", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def op4_pack_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), ranks_path=ranks_path(), capacity=2048)


def op5_context_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scores = context_tree.score_texts(docs, ~held_out(7, 2))
    return scores.select("doc_id", held_out(7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_toxicity_bigru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"), train_on=~held_out(5, 0))
    return toxicity.toxicity_scores(docs, model).select("doc_id", held_out(5, 0).alias("held_out"), "score", "predicted")


def op7_shard_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.hilbert_shards(read_table(spark, sf_dir, "documents"), n_shards=24)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


def op9_quality_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, read_table(spark, sf_dir, "labels"), train_on=~held_out(5, 0), threshold=0.3)
    return quality.quality_scores(docs, model).select("doc_id", held_out(5, 0).alias("held_out"), "score", "predicted")


def op10_simhash_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"), radius=4, shingle=4)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_digests(read_table(spark, sf_dir, "conversations"))


def op12_suffix_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_digests(read_table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_collision_counting": op1_collision_counting,
        "op2_language_cross_parsing": op2_language_cross_parsing,
        "op3_mix_sources": op3_mix_sources,
        "op4_pack_best_fit": op4_pack_best_fit,
        "op5_context_tree_lm": op5_context_tree_lm,
        "op6_toxicity_bigru": op6_toxicity_bigru,
        "op7_shard_hilbert": op7_shard_hilbert,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_quality_pairs": op9_quality_pairs,
        "op10_simhash_pigeonhole": op10_simhash_pigeonhole,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_suffix_family": op12_suffix_family,
        "op13_periodic_runs": op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_mix_sources": r"""
            WITH RECURSIVE c AS (
                SELECT source, count(*) AS n FROM documents GROUP BY source
            ), r AS (
                SELECT source, n, pow(n::DOUBLE, 0.5::DOUBLE) / (SELECT sum(pow(n::DOUBLE, 0.5::DOUBLE)) FROM c) * (SELECT sum(n)::DOUBLE FROM c) / n AS rate FROM c
            ), p AS (
                SELECT source, rate, 0 AS k, exp(-rate) AS term, exp(-rate) AS below FROM r
                UNION ALL
                SELECT source, rate, k + 1, term * rate / (k + 1), below + term * rate / (k + 1) FROM p WHERE k + 1 <= ceil(rate + 12 * sqrt(rate) + 24)
            ), d AS (
                SELECT doc_id, source, coalesce(text, '') AS t, ('0x' || substr(md5('3:' || doc_id::VARCHAR || ':0'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents
            ), k AS (
                SELECT d.doc_id, d.source, p.rate, d.t, count(*) FILTER (WHERE p.below <= d.u) AS n_copies
                FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source GROUP BY ALL
            ), e AS (
                SELECT *, unnest(range(n_copies)) AS replica FROM k WHERE n_copies > 0
            )
            SELECT doc_id, source, round(rate, 9) AS rate, n_copies, replica,
                   ('0x' || substr(md5('3s:' || doc_id::VARCHAR || ':' || replica::VARCHAR), 1, 15))::BIGINT AS shuffle_key, md5(t) AS text_md5
            FROM e
        """,
        "op8_exact_dedup": r"""
            WITH d AS (
                SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents
            ), g AS (
                SELECT doc_id, n,
                       first_value(doc_id) OVER (PARTITION BY n ORDER BY length(t) DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
                       count(*) OVER (PARTITION BY n) AS group_size
                FROM d
            )
            SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n) AS text_sha256 FROM g
        """,
        "op11_conversation_repair": r"""
            WITH RECURSIVE t AS (
                SELECT list_transform(range(256), lambda x: list_reduce(range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, x)) AS tab
            ), k AS (
                SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                       coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
            ), c AS (
                SELECT conv_id, turn, role, text, xor(list_reduce(list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i, 1))::BIGINT),
                           lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 20 AS code FROM k, t
            ), d AS (
                SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
                       CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM c WHERE code <> 0
                UNION ALL SELECT conv_id, turn, role, text FROM c WHERE code = 3
            ), n AS (
                SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
                       regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last, substr(role, 1, 1) AS r FROM d
            ), f AS (
                SELECT *, last = '' AS blank, last <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS dup,
                       lag(r) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM n
            ), g AS (
                SELECT *, NOT blank AND NOT dup AND last NOT IN ('.', '!', '?') AS trunc FROM f
            ), stats AS (
                SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
                       count(*) FILTER (dup) AS duplicate, count(*) FILTER (trunc) AS truncated,
                       count(*) FILTER (before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id
            ), w AS (
                -- A way: cost in nine digits, the edits, then the repaired lines, each behind a newline. Its first ten and the edits order ways.
                SELECT conv_id, 0::BIGINT AS i, {c: 0, a: '', t: ''} AS e, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) AS s, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) AS u, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) AS a
                FROM (SELECT DISTINCT conv_id FROM d)
                UNION ALL
                SELECT z.conv_id, z.i,
                       CASE WHEN e IS NOT NULL THEN {c: e.c + 3, a: e.a || 'D', t: e.t} END,
                       list_min(list_filter([CASE WHEN s IS NOT NULL THEN {c: s.c + 3, a: s.a || 'D', t: s.t} END, CASE WHEN ok AND r = 's' AND e IS NOT NULL THEN {c: e.c + x, a: e.a || 'K', t: e.t || own} END], lambda y: y IS NOT NULL)),
                       list_min(list_filter([CASE WHEN u IS NOT NULL THEN {c: u.c + 3, a: u.a || 'D', t: u.t} END,
                           CASE WHEN ok AND e IS NOT NULL THEN {c: e.c + x + uc, a: e.a || ue, t: e.t || ul} END,
                           CASE WHEN ok AND s IS NOT NULL THEN {c: s.c + x + uc, a: s.a || ue, t: s.t || ul} END,
                           CASE WHEN ok AND a IS NOT NULL THEN {c: a.c + x + uc, a: a.a || ue, t: a.t || ul} END,
                           CASE WHEN ok AND u IS NOT NULL THEN {c: u.c + x + uc + 2, a: u.a || 'I' || ue, t: u.t || chr(10) || 'assistant:' || ul} END], lambda y: y IS NOT NULL)),
                       list_min(list_filter([CASE WHEN a IS NOT NULL THEN {c: a.c + 3, a: a.a || 'D', t: a.t} END,
                           CASE WHEN ok AND u IS NOT NULL THEN {c: u.c + x + ac, a: u.a || ae, t: u.t || al} END,
                           CASE WHEN ok AND e IS NOT NULL THEN {c: e.c + x + ac + 2, a: e.a || 'I' || ae, t: e.t || chr(10) || 'user:' || al} END,
                           CASE WHEN ok AND s IS NOT NULL THEN {c: s.c + x + ac + 2, a: s.a || 'I' || ae, t: s.t || chr(10) || 'user:' || al} END,
                           CASE WHEN ok AND a IS NOT NULL THEN {c: a.c + x + ac + 2, a: a.a || 'I' || ae, t: a.t || chr(10) || 'user:' || al} END], lambda y: y IS NOT NULL))
                FROM (
                    SELECT w.*, g.i AS gi, g.r, NOT (blank OR dup) AS ok, CASE WHEN trunc THEN 1 ELSE 0 END AS x, chr(10) || role || ':' || text AS own,
                           CASE WHEN r = 'u' THEN 0 ELSE 2 END AS uc, CASE WHEN r = 'u' THEN 'K' ELSE 'R' END AS ue, CASE WHEN r = 'u' THEN chr(10) || role || ':' || text ELSE chr(10) || 'user:' || text END AS ul,
                           CASE WHEN r = 'a' THEN 0 ELSE 2 END AS ac, CASE WHEN r = 'a' THEN 'K' ELSE 'R' END AS ae, CASE WHEN r = 'a' THEN chr(10) || role || ':' || text ELSE chr(10) || 'assistant:' || text END AS al
                    FROM w JOIN g ON w.conv_id IS NOT DISTINCT FROM g.conv_id AND g.i = w.i + 1
                ) AS y(conv_id, i0, e, s, u, a, i, r, ok, x, own, uc, ue, ul, ac, ae, al), LATERAL (SELECT y.conv_id, y.i) AS z
            ), best AS (
                SELECT w.conv_id, list_min(list_filter([e, a, CASE WHEN u IS NOT NULL THEN {c: u.c + 2, a: u.a || 'I', t: u.t || chr(10) || 'assistant:'} END,
                           CASE WHEN s IS NOT NULL THEN {c: s.c + 4, a: s.a || 'II', t: s.t || chr(10) || 'user:' || chr(10) || 'assistant:'} END], lambda y: y IS NOT NULL)) AS b
                FROM w JOIN (SELECT DISTINCT conv_id, n FROM g) AS l ON w.conv_id IS NOT DISTINCT FROM l.conv_id AND w.i = l.n
            )
            SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
                   coalesce(b.c, 0)::BIGINT AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(substr(b.t, 2), '')) AS repaired_sha256
            FROM (SELECT DISTINCT conv_id FROM conversations) AS o
            LEFT JOIN stats ON o.conv_id IS NOT DISTINCT FROM stats.conv_id LEFT JOIN best ON o.conv_id IS NOT DISTINCT FROM best.conv_id
        """,
    }
