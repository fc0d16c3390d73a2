"""The training-data operators on small tables, against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import collision_ann, context_tree, exact_dedup, language, mixing, packing, quality, sharding, simhash, tokens, toxicity
from tessera.llm.queries import ranks_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, key long, bucket string"
LONG = "lorem ipsum dolor sit amet " * 4000


def rows():
    texts = [None, "", " \n\t ", "alpha beta gamma delta epsilon zeta", "alpha  beta gamma\ndelta epsilon zeta", "alpha beta gamma delta epsilon zeta eta", LONG, LONG, "x", "É è 漢字 \U0001f600 ok", "it's 10 o'clock, we'll see", "one two three"]
    return [(i, t, "en" if i % 2 else "fr", f"s{i % 3}" if i != 4 else None, None if t is None else len(t), 0.5, i, "b") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# --- exact deduplication ---


def test_exact_dedup_matches_brute_force(docs, empty):
    got = by_id(exact_dedup.exact_dedup(docs, capacity=3, hot_rows=1))
    groups = {}
    for i, t, *_ in rows():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    for norm, members in groups.items():
        keep = min(members)[1]
        for _, i in members:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest())
    assert exact_dedup.exact_dedup(empty).count() == 0


@pytest.mark.parametrize("hot_rows", [10_000, 3_000, 7])
def test_exact_dedup_hot_groups_meet_again(spark, hot_rows):
    d = spark.range(25_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    d = d.unionByName(spark.createDataFrame([(0, "sa me"), (1, "1")], d.schema))
    got = exact_dedup.exact_dedup(d, hot_rows=hot_rows)
    sizes = {r.group_size: r["count"] for r in got.groupBy("group_size").count().collect()}
    assert sizes == {12_501: 12_501, 1: 12_499, 2: 2}
    assert {r.keep_id for r in got.filter("group_size > 2").select("keep_id").distinct().collect()} == {0}
    # Only the longer of the two rows with id 0 stays; the row written twice has the same decision twice.
    assert got.filter("kept AND group_size > 2").count() == 1 and got.filter("kept AND group_size = 2").count() == 2


def test_chains_keep_texts_of_one_key_apart(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "_key", lambda c: (F.coalesce(F.col(c), F.lit("")), F.regexp_replace(F.coalesce(F.col(c), F.lit("")), exact_dedup._WHITE, ""), F.shiftleft(F.length(c).cast("long"), 60)))
    d = spark.createDataFrame([(i, t) for i, t in enumerate(["aa", "bb", "aa", "cc", "dddd", "eeee"] * 40)], "doc_id long, text string")
    for hot_rows in (1000, 5):
        index, _ = exact_dedup.build_index(d, capacity=1, hot_rows=hot_rows)
        assert index.agg(F.max("chain")).first()[0] >= 2
        got = {(r.doc_id % 6, r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(d, capacity=1, hot_rows=hot_rows).collect()}
        assert got == {(0, 0, 80), (2, 0, 80), (1, 1, 40), (3, 3, 40), (4, 4, 40), (5, 5, 40)}


def test_doubling_decides_the_owner_of_each_text(spark):
    d = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 400).cast("string")).alias("text"))
    index, _ = exact_dedup.build_index(d, capacity=3)
    per_bucket = [r["count"] for r in index.groupBy("bucket").count().collect()]
    assert len(per_bucket) > 100 and max(per_bucket) <= 3 * 4
    ranges = sorted((r.lo & (2**64 - 1), r.hi & (2**64 - 1)) for r in index.withColumn("u", F.col("key").cast("decimal(20,0)") + F.when(F.col("key") < 0, F.lit(2).cast("decimal(20,0)") ** 64).otherwise(0)).groupBy("bucket").agg(F.min("u").cast("decimal(20,0)").alias("a"), F.max("u").cast("decimal(20,0)").alias("b")).select(F.col("a").alias("lo"), F.col("b").alias("hi")).toPandas().astype({"lo": object, "hi": object}).map(int).itertuples())
    assert all(x[1] < y[0] for x, y in zip(ranges, ranges[1:]))  # key ranges of buckets don't overlap
    assert exact_dedup.exact_dedup(d, capacity=3).filter("group_size = 2").count() == 200


def test_directory_splits_only_overfull_buckets():
    ranges = exact_dedup.directory([(0, 9), (1, 9), (4, 2), (7, 2)], 3, 10)
    assert ranges == [(0, 0, 0), (1, 1, 1), (2, 3, 2), (4, 7, 3)]
    assert exact_dedup.directory([(5, 100)], 3, 10)[-1][1] == 7  # a single hot prefix ends as its own bucket


# --- near duplicates ---


def reference_print(text):
    w = [x.decode() for x in (text or "").encode().lower().split()]
    import xxhash

    sh = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    ids = sorted(prints)
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= 4:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_fingerprints_and_components(docs, empty):
    got = by_id(simhash.near_duplicates(docs))
    prints = {i: reference_print(t) for i, t, *_ in rows()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r.component_id for i, r in got.items()} == brute_components(prints)
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("block_rows", [20_000, 16])
def test_simhash_links_lose_no_component(spark, block_rows):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**62, 40)
    prints = {int(x) for x in base}
    for x in base:  # chains of near prints, one long
        for _ in range(rng.integers(0, 12)):
            x = int(x) ^ sum(1 << int(b) for b in rng.choice(62, rng.integers(1, 5), replace=False))
            prints.add(x)
    prints = sorted(prints)
    fps = spark.createDataFrame([(p,) for p in prints], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(fps, 4, block_rows=block_rows)).collect()}
    want = brute_components(dict(zip(prints, prints)))
    assert {p: roots.get(p, p) for p in prints} == want


def test_large_dense_group_makes_a_forest():
    rng = np.random.default_rng(4)
    fps = np.unique(np.array([(1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 60, (2000, 2))], np.int64))
    a, b = simhash.linked(np.zeros(len(fps), np.int64), fps, 4, small=8)
    assert len(a) == len(fps) - 1


def test_thresholds_are_the_cheapest_that_sum_up():
    cost, t = simhash.allocate([{-1: 0, 0: 5, 1: 50}, {-1: 0, 0: 1, 1: 4}, {-1: 0, 0: 5, 1: 50}], 0)
    assert sum(t) == 0 and t == [-1, 1, 0] or t == [0, 1, -1]
    assert cost == 9


# --- mixing ---


def test_mixing_rates_and_rows(spark, docs, empty):
    d = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "big").otherwise("small").alias("source"), F.lit("t").alias("text"))
    got = {r.source: (r.n, r.rate) for r in mixing.replicate(d, weights={"big": 1.0, "small": 3.0, "none": 9.0}).groupBy("source").agg(F.count("*").alias("n"), F.max("rate").alias("rate")).collect()}
    # "none" has no rows; the other two share the total 1 : 3.
    assert got["small"][1] == pytest.approx(2.25) and got["big"][1] == pytest.approx(0.375)
    assert abs(got["small"][0] - 22_500) < 4 * 150 and abs(got["big"][0] - 7_500) < 4 * 87
    again = mixing.replicate(docs, temper=0.5)
    assert sorted(r.doc_id for r in again.collect()) == sorted(r.doc_id for r in mixing.replicate(docs, temper=0.5).collect())
    assert mixing.replicate(empty).count() == 0
    assert mixing.replicate(docs, weights={"s0": 1.0}).filter("source <> 's0' OR source IS NULL").count() == 0


def test_poisson_inverse_matches_the_distribution(spark):
    means = [0.0, 0.3, 2.5, 40.0]
    for m in means:
        got = {r.u: r.k for r in spark.range(0, 100).select((F.col("id") / 100).alias("u")).select("u", mixing.poisson_inverse(F.col("u"), F.lit(m)).alias("k")).collect()}
        for u, k in got.items():
            below, term, n = math.exp(-m), math.exp(-m), 0
            while u >= below:
                n += 1
                term *= m / n
                below += term
            assert n == k


# --- packing and tokens ---


def test_tokens_equal_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(5)
    alphabet = [*"abst'rvelmd  \n\t ,.!12é日本  'ʼ́٣😀ÀßЖ", "'s", "'re", "'ll", " '", "<|endoftext|>", "\r\n"]
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 40))) for _ in range(3000)] + [t or "" for _, t, *_ in rows()]
    got = [x.tolist() for x in tokens.encode_batch(pa.array(texts), ranks_path())]
    assert got == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def test_a_small_cache_gives_the_same_ids():
    small = tokens.Encoder(ranks_path(), slots=4, pool=64)
    text = pa.array(["alpha beta gamma delta " * 5, "one two three alpha beta"])
    data, offsets = next(tokens.parts(text))[2:]
    starts, ends, _ = tokens.pre_tokens(data, offsets)
    want, _ = tokens.Encoder(ranks_path()).encode(data, starts, ends)
    for _ in range(2):
        assert small.encode(data, starts, ends)[0].tolist() == want.tolist()


def test_packing_is_a_round_trip(docs, empty):
    got = packing.pack_documents(docs, ranks_path=ranks_path(), capacity=64, rows_per_partition=4).collect()
    ids = dict(zip([r[0] for r in rows()], (np.append(x, 0).astype("<u4") for x in tokens.encode_batch(pa.array([r[1] for r in rows()]), ranks_path()))))
    place, sequences = Counter(), {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        assert r.start == place[r.doc_id] and zlib.crc32(ids[r.doc_id][r.start : r.start + r.length]) == r.ids_crc32
        assert r.length == 64 or r.piece == 0
        place[r.doc_id] += r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert place == {i: len(x) for i, x in ids.items()}
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack_documents(empty, ranks_path=ranks_path()).count() == 0


def test_lower_bound_never_exceeds_a_packing():
    rng = np.random.default_rng(6)
    for _ in range(60):
        lengths = rng.integers(1, 101, rng.integers(1, 40))
        _, fill = packing.best_fit_decreasing(lengths, 100)
        bound = packing.lower_bound(lengths, 100)
        assert fill.max() <= 100 and fill.sum() == lengths.sum() and -(-lengths.sum() // 100) <= bound <= len(fill)
    assert packing.lower_bound(np.array([51] * 7), 100) == 7
    assert packing.lower_bound(np.array([34] * 9), 100) == 5


# --- sharding ---


def test_hilbert_neighbours_touch():
    for bits, d in ((3, 2), (2, 3)):
        cells = np.stack(np.meshgrid(*[np.arange(2**bits)] * d, indexing="ij"), -1).reshape(-1, d)
        h = sharding.hilbert_index(cells, bits)
        assert sorted(h) == list(range(len(h)))
        assert (np.abs(np.diff(cells[np.argsort(h)], axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("n_shards", [5, 24])
def test_shards_differ_by_one_row_at_most(docs, empty, n_shards):
    got = sharding.hilbert_shards(docs, n_shards=n_shards, rows_per_bucket=2).collect()
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(n_shards)) <= 1
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    text = {i: (t or "").encode() for i, t, *_ in rows()}
    assert all(r["size"] == len(text[r.doc_id]) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id]) for r in got)
    assert sorted(r.position for r in got) == list(range(len(got)))
    assert sharding.hilbert_shards(empty).count() == 0


# --- quality, toxicity, language ---


def labelled(spark, n=300):
    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(list("abdeghinorst"), rng.integers(2, 8))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        w = list(rng.choice(words, rng.integers(30, 120)))
        toxic, good = i % 5 == 1, i % 7 != 2
        if toxic:
            w[10], w[20] = "grumblefool", "snarkwit"
        if not good:
            w = [x + "$$$" if k % 2 else x.upper() + "!!" for k, x in enumerate(w)]
        docs.append((i, " ".join(w), "en"))
        labels.append((i, int(good), int(toxic)))
    labels += [(None, 1, 1), (3, None, None), (10**9, 1, 0)]
    docs += [(n, None, None), (n + 1, "", None), (n + 2, "123 !!", None)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_ranks_held_out_texts(spark):
    docs, labels = labelled(spark)
    model = quality.train(docs, labels, train_on=F.col("doc_id") % 3 != 0)
    got = by_id(quality.quality_scores(docs.withColumn("w", F.lit(1)), model))
    right = [got[i].predicted == int(i % 7 != 2) for i in range(0, 300, 3)]
    assert np.mean(right) > 0.95 and all(0 <= r.score <= 1 for r in got.values()) and len(got) == 303
    kept = {r.doc_id for r in quality.keep_good(docs, model).collect()}
    assert kept == {i for i, r in got.items() if r.predicted == 1}
    one = quality.train(docs, labels.filter("quality = 1"))
    assert one.constant > 0.9
    none = quality.train(docs, labels.filter("false"))
    assert none.constant == 0.5 and quality.quality_scores(docs.filter("false"), none).count() == 0


def test_toxicity_finds_held_out_texts(spark):
    docs, labels = labelled(spark, 900)
    model = toxicity.train(docs, labels, train_on=F.col("doc_id") % 3 != 0)
    got = by_id(toxicity.toxicity_scores(docs, model))
    right = [got[i].predicted == int(i % 5 == 1) for i in range(0, 900, 3)]
    assert np.mean(right) > 0.9 and all(0 <= r.score <= 1 for r in got.values()) and len(got) == 903
    assert toxicity.train(docs, labels.filter("false")).constant == 0.5


def test_toxicity_gradients():
    net = toxicity.Network.fresh()
    net.w = {k: v.astype(float) for k, v in net.w.items()}
    held = list(toxicity.parts(pa.array([f"some words {'and more ' * k} bad{k} end" for k in range(12)])))
    owner, start, size, _ = net.window_logits(held[0][2], held[0][3])
    *given, text = next(toxicity._batches([(0, o, s, n) for o, s, n in zip(owner, start, size)], held, np.random.default_rng(1), 999))
    y = (text % 2).astype(float)
    _, g = net.gradients(*given, y)
    for k in g:
        at = np.unravel_index(np.argmax(np.abs(g[k])), g[k].shape)
        old = net.w[k][at]
        net.w[k][at] = old + 1e-4
        up = net.gradients(*given, y)[0]
        net.w[k][at] = old - 1e-4
        down = net.gradients(*given, y)[0]
        net.w[k][at] = old
        assert (up - down) / 2e-4 == pytest.approx(g[k][at], rel=0.02, abs=1e-7), k


def test_every_word_is_in_a_window():
    for n in (0, 1, 31, 32, 33, 56, 57, 500):
        owner, start, size = toxicity.windows(np.array([0, n]))
        covered = {w for s, k in zip(start, size) for w in range(s, s + k)}
        assert covered == set(range(n)) and (size <= toxicity.WINDOW).all() and (size > 0).all()


def brute_phrases(text, reference):
    n, at = 0, 0
    while at < len(text):
        k = 1
        while at + k < len(text) and text[at : at + k + 1] in reference:
            k += 1
        n, at = n + 1, at + k
    return n


def test_phrases_equal_brute_force():
    samples = {"a": ["the cat sat on the mat"], "b": ["abracadabra the banana"]}
    model = language.build(samples)
    text = ["the banana sat", "zzz", "cat", ""]
    for row, _, data, offsets in language.parts(pa.array(text)):
        codes, at = language.letters(data, offsets)
        got = model.phrases(codes, at)
        for k, name in enumerate(model.languages):
            ref = " ".join(samples[name]) + " "
            assert [got[i, k] for i in range(3)] == [brute_phrases(t, ref) for t in text[:3]]


def test_language_of_held_out_texts(spark):
    rng = np.random.default_rng(8)
    make = lambda syllables: " ".join("".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(60))
    kinds = {"x": ["ka", "to", "mi"], "y": ["ber", "sch", "ung"]}
    data = [(i, make(kinds["xy"[i % 2]]), "xy"[i % 2]) for i in range(60)] + [(60, None, "x"), (61, "12 !?", "y"), (62, "katomi " * 3000, None)]
    d = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = language.train(d, train_on=F.col("doc_id") % 4 != 2)
    got = by_id(language.identify(d, model))
    assert all(got[i].lang_pred == "xy"[i % 2] for i in range(60)) and got[62].lang_pred == "x"
    assert (got[60].lang_pred, got[61].lang_pred, got[60].score) == ("und", "und", 0.0)
    assert all(0 <= r.score <= 1 for r in got.values())
    nothing = language.train(d.filter("false"))
    assert {r.lang_pred for r in language.identify(d, nothing).collect()} == {"und"}


# --- language model ---


def test_unigram_baseline_and_proper_model(spark, docs, empty):
    train = F.col("doc_id") % 3 != 0
    got = by_id(context_tree.score_texts(docs, train))
    toks = {i: (t or "").encode().lower().split() + [None] for i, t, *_ in rows()}
    c = Counter(w for i, ws in toks.items() if i % 3 for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in toks.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(w in c for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))
        assert r.score < 0
    assert context_tree.score_texts(empty, train).count() == 0
    assert all(r.train_tokens == 0 for r in context_tree.score_texts(docs, F.lit(False)).collect())


def test_context_tree_sums_to_one_and_follows_the_longest_context():
    text = pa.array(["abracadabra " * 30, "banana bandana " * 20])
    data, offsets = next(context_tree.parts(text))[2:]
    k, c = np.unique(context_tree.grams(data, offsets), return_counts=True)
    used = np.unique(k & np.uint64(255)).astype(int)
    width = 1 << len(used).bit_length()
    contexts, tables = [np.zeros(1, np.uint64)], []
    where = {b: i for i, b in enumerate(used)}
    for d in range(context_tree.DEPTH + 1):
        cx = k >> np.uint64(8 * (context_tree.DEPTH + 1 - d)) if d else np.zeros(len(k), np.uint64)
        u, inv = np.unique(cx, return_inverse=True)
        keep = np.bincount(inv, c) >= (1 if d == 0 else 8)
        table = np.zeros((len(u), width))
        np.add.at(table, (inv, [where[int(x)] for x in k & np.uint64(255)]), c)
        if d:
            contexts.append(u[keep])
        tables.append(table[keep])
    tree = context_tree.assemble(contexts, tables, used)
    total = (10 ** tree.logs.astype(float))[:, : len(used)].sum(1) + (256 - len(used)) * 10 ** tree.logs[:, len(used)].astype(float)
    slack = 1 - total  # what unused codes of the last decision hold
    assert (slack > -1e-4).all() and (slack < 0.2).all()
    whole = tree.score(data, offsets)
    assert whole[0] / (len(text[0].as_py()) + 1) > -0.25  # well below a third of a byte's eight bits


# --- nearest neighbours ---


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((600, 16)) * rng.uniform(0.5, 2, (600, 1))
    x[7] = x[8]
    data = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(600, None), (601, [0.0] * 16), (602, [float("nan")] * 16), (603, [None] * 16), (604, [1.0] * 3), (620, [float("inf")] * 16)]
    d = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = collision_ann.nearest(d, F.col("vec_id") % 20 == 0, k=20, block_rows=200, query_rows=16).collect()
    hits = []
    for q in range(0, 600, 20):
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(600), -s))[:20]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21))
        assert all(r.score == pytest.approx(float(x[r.vec_id] @ x[q])) for r in mine)
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        hits.append(len({r.vec_id for r in mine} & set(best.tolist())) / 20)
    assert np.mean(hits) >= 0.9
    assert {r.query_id for r in got} == set(range(0, 600, 20))
    few = collision_ann.nearest(d.filter("vec_id < 5"), F.col("vec_id") % 20 == 0, k=20).collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3, 4]
    assert collision_ann.nearest(d.filter("false"), F.col("vec_id") % 20 == 0).count() == 0
