"""Nulls, clashing names, repeated rows, ties, long and empty texts for every operator, and brute-force versions."""

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

#: Names that some operator uses inside or returns.
CLASH = ["rate", "source_key", "n_source", "n_copies", "replica", "shuffle_key", "__source__", "document", "ident", "score", "predicted", "y", "c", "key", "bucket", "part", "chain", "sha", "n",
         "best", "members", "norm", "cp", "fp", "component_id", "hilbert", "sub", "size", "shard", "slot", "position", "piece", "start", "length", "offset", "sequence_id", "uid", "train", "held_out", "h", "value", "prefix", "v", "task", "hot"]
CLASH = list({c.lower(): c for c in CLASH}.values())
TEXTS = [None, "", " \t", "alpha beta gamma delta epsilon", "alpha beta gamma delta epsilon", "word " * 30_000, "<|endoftext|>", "a<|endoftext|>b"]


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated ids, repeated rows, and a column of every name in CLASH."""
    ids = [0, 1, 2, 3, 3, 5, None, None]
    rows = [(i, t, "en", None if k % 3 else "web", k, *(["x"] * len(CLASH))) for k, (i, t) in enumerate(zip(ids, TEXTS))]
    rows += [rows[4], rows[6]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 0, 0), (3, 1, 0), (5, 0, 1), (3, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")


def test_every_operator_takes_the_odd_table_and_an_empty_one(spark, odd, labels):
    runs = {
        "language": lambda d: language.identify(d, language.train(d)),
        "mixing": lambda d: mixing.replicate(d, total=10),
        "packing": lambda d: packing.pack_documents(d, ranks_path=ranks_path()),
        "lm": lambda d: context_tree.score_texts(d, F.lit(True)),
        "toxicity": lambda d: toxicity.toxicity_scores(d, toxicity.train(d, labels)),
        "shards": lambda d: sharding.hilbert_shards(d, n_shards=3),
        "exact": lambda d: exact_dedup.exact_dedup(d, capacity=2, hot_rows=2),
        "quality": lambda d: quality.quality_scores(d, quality.train(d, labels)),
        "simhash": lambda d: simhash.near_duplicates(d),
    }
    n = odd.count()
    for name, run in runs.items():
        got = run(odd).collect()
        assert len(got) == n or name in ("mixing", "packing"), name
        assert run(odd.filter("false")).count() == 0, name


def test_mixing_keeps_clashing_columns(odd):
    out = mixing.replicate(odd, total=30)
    assert {"rate", "rate_in", "n_copies_in", "source_key", "n_source"} <= set(out.columns)
    row = out.first()
    assert row["rate_in"] == "x" and isinstance(row["rate"], float) and row["source_key"] == "x"
    assert mixing.replicate(odd, total=30, own_columns_only=True).columns == odd.columns
    counts = out.select("doc_id", "text", "n_copies").distinct().groupBy("doc_id").agg(F.countDistinct("n_copies").alias("k")).filter("doc_id IS NOT NULL AND doc_id <> 3")
    assert counts.filter("k > 1").count() == 0


def test_result_columns_and_clashing_ones(odd, labels):
    for out in (quality.quality_scores(odd, quality.train(odd, labels)), toxicity.toxicity_scores(odd, toxicity.train(odd, labels))):
        row = out.first()
        assert row["score_in"] == "x" and 0 <= row["score"] <= 1 and row["predicted"] in (0, 1)


def test_equal_texts_have_equal_scores(odd, labels):
    for out in (quality.quality_scores(odd, quality.train(odd, labels)), toxicity.toxicity_scores(odd, toxicity.train(odd, labels))):
        assert out.groupBy(F.coalesce("text", F.lit(""))).agg(F.countDistinct(F.round("score", 5)).alias("k")).filter("k > 1").count() == 0


# --- packing ---


def test_special_token_is_one_id():
    got = [x.tolist() for x in tokens.encode_batch(pa.array(["A<|endoftext|>A", "<|endoftext|>", "<|endoftext|", "a <|endoftext|> b"]), ranks_path())]
    assert got[0][1] == got[1][0] == tokens.SPECIAL_ID and len(got[1]) == 1 and tokens.SPECIAL_ID not in got[2]


def test_special_string_across_two_texts_is_no_token():
    got = [x.tolist() for x in tokens.encode_batch(pa.array(["x <|endof", "text|> y"]), ranks_path())]
    assert tokens.SPECIAL_ID not in got[0] + got[1]


def best_bins(lengths, capacity):
    """Fewest bins, by search."""
    lengths = sorted(lengths, reverse=True)

    def fits(k, left):
        if k == len(lengths):
            return True
        tried = set()
        for i, room in enumerate(left):
            if room >= lengths[k] and room not in tried:
                tried.add(room)
                left[i] -= lengths[k]
                if fits(k + 1, left):
                    return True
                left[i] += lengths[k]
        return False

    n = -(-sum(lengths) // capacity)
    while not fits(0, [capacity] * n):
        n += 1
    return n


def test_certified_partitions_are_optimal():
    rng = np.random.default_rng(11)
    seen = 0
    for _ in range(150):
        lengths = rng.integers(5, 60, rng.integers(2, 11))
        _, fill = packing.best_fit_decreasing(lengths, 60)
        bound, best = packing.lower_bound(lengths, 60), best_bins(lengths.tolist(), 60)
        assert bound <= best <= len(fill)
        if len(fill) == bound:
            seen += 1
            assert len(fill) == best
    assert seen > 50


def test_exchange_closes_gaps_between_partitions(spark):
    rng = np.random.default_rng(12)
    lengths = rng.integers(3, 64, 3000).tolist()
    pieces = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)], packing.PIECES)
    one = packing.pack(pieces, capacity=64, rows_per_partition=10_000)
    many = packing.pack(pieces, capacity=64, rows_per_partition=100)
    bins = lambda d: d.select("sequence_id").distinct().count()
    bound = packing.lower_bound(np.array(lengths), 64)
    alone = many.groupBy("partition_bins", "partition_bound").count()
    assert bound <= bins(one) <= bins(many) <= 1.05 * bins(one) and alone.count() > 1
    assert many.filter("certified <> (partition_bins = partition_bound)").count() == 0
    fill = many.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0]
    assert fill <= 64 and many.count() == 3000


# --- sharding ---


def test_strings_with_a_long_common_prefix_have_levels_of_their_own(spark):
    d = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("https://commoncrawl-"), (F.col("id") % 4).cast("string")).alias("source"), F.lit("en").alias("lang"), F.lit("t").alias("text"), F.lit(1).alias("n_chars"))
    got = sharding.hilbert_shards(d, n_shards=4).join(d, "doc_id").select("source", "hilbert", "shard").distinct().collect()
    assert len({r.hilbert for r in got}) == 4 and Counter(r.shard for r in got) == {0: 1, 1: 1, 2: 1, 3: 1}


def test_string_bounds_equal_brute_force(spark):
    values = [f"v{int(x):03d}" for x in np.random.default_rng(13).exponential(20, 1000)] + [None] * 50
    d = spark.createDataFrame([(v,) for v in values], "s string")
    got = sharding.string_bounds(d, F.col("s"), 8)
    known = sorted(v for v in values if v is not None)
    want = sorted({known[math.ceil(i * 1000 / 8) - 1] for i in range(1, 8)} - {known[-1]})
    assert got == want


def test_placement_equals_brute_force(spark):
    rng = np.random.default_rng(14)
    rows = [(i, "x" * int(rng.integers(0, 30)), ["en", "fr", None][i % 3], f"s{i % 5}", int(rng.integers(0, 100))) for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in sharding.hilbert_shards(d, n_shards=7, rows_per_bucket=10_000).collect()}
    order = sorted(got, key=lambda i: (got[i].hilbert, i))
    for place, i in enumerate(order):
        shard = place * 7 // 300
        assert (got[i].position, got[i].shard, got[i].slot) == (place, shard, place - -(-shard * 300 // 7))


# --- quality and toxicity against plain versions ---


def plain_counts(text):
    low = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", low)
    out = [sum(not (chr(b).isalpha() and b < 128 or 48 <= b <= 57 or b >= 128 or b in b" \t\n\x0b\x0c\r") for b in low), low.count(10)]
    out += [sum(a == b for a, b in zip(words, words[k:])) for k in (1, 2)]
    upper = sum(65 <= b <= 90 for b in low)
    return [*out, sum(97 <= b <= 122 or b >= 128 for b in low) + upper, upper, sum(48 <= b <= 57 for b in low), len(words), len(low)]


def test_quality_counts_equal_a_plain_count():
    texts = ["Aa bb bb 12 !? É\nx x y x y", "", None, "one\ttwo\r\n3", "q"]
    got = quality.counts(pa.array(texts, pa.string()))
    for t, row in zip(texts, got):
        assert row[: quality.N_COUNTS].tolist() == plain_counts(t)
        n = len((t or "").encode())
        assert row[quality.N_COUNTS :][: quality.BUCKETS].sum() == len((t or "").split()) and row[quality.N_COUNTS + quality.BUCKETS :].sum() == max(0, n - 2)
    again = quality.counts(pa.array(texts[::-1], pa.string()))[::-1]
    assert (again == got).all()  # a text's features don't depend on its neighbours


def test_bradley_terry_weights_are_a_minimum():
    rng = np.random.default_rng(15)
    texts = [" ".join(rng.choice(["aa", "bb", "cc!", "DD"], 20)) + (" !!! ###" if i % 3 == 0 else "") for i in range(120)]
    y = np.array([int(i % 3 != 0) for i in range(120)])
    c = quality.counts(pa.array(texts))
    model = quality.fit(c, y, steps=40)
    z = (quality.features(c, model.prior) - model.mean) / model.scale
    pick = np.random.default_rng(9)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    d = z[good[pick.integers(0, len(good), 40_000)]] - z[bad[pick.integers(0, len(bad), 40_000)]]
    penalty = np.where(np.arange(z.shape[1]) < 15, 1e-3, 0.05)
    loss = lambda w: np.log1p(np.exp(-(d @ w))).mean() + 0.5 * (penalty * w * w).sum()
    at = loss(model.weights)
    for _ in range(10):
        assert loss(model.weights + 1e-2 * rng.standard_normal(z.shape[1])) >= at - 1e-5


def test_window_scores_equal_a_plain_network():
    net = toxicity.Network.fresh(3)
    text = " ".join(f"word{i} bad{i * i % 7}" for i in range(40))
    data, offsets = next(toxicity.parts(pa.array([text])))[2:]
    owner, start, size, logit = net.window_logits(data, offsets)
    word, runs, starts, sizes, _ = toxicity.encode(data, offsets)
    w = net.w
    sig = lambda v: 1 / (1 + np.exp(-v))
    for a, n, got in zip(start, size, logit):
        x = [np.concatenate([w["ew"][word[k]], w["ec"][runs[starts[k] : starts[k] + sizes[k]]].mean(0), w["ec"][runs[starts[k]]]]) for k in range(a, a + n)]
        states = {}
        for k, seq in (("f", range(n)), ("b", range(n - 1, -1, -1))):
            h = np.zeros(toxicity.HIDDEN)
            for t in seq:
                u = x[t] @ w[f"x{k}"] + w[f"i{k}"]
                gate = sig(u[: 2 * toxicity.HIDDEN] + h @ w[f"g{k}"])
                z, r = gate[: toxicity.HIDDEN], gate[toxicity.HIDDEN :]
                h = h + z * (np.tanh(u[2 * toxicity.HIDDEN :] + (r * h) @ w[f"c{k}"]) - h)
                states[k, t] = h
        joint = np.array([np.concatenate([states["f", t], states["b", t]]) for t in range(n)])
        e = np.exp(np.tanh(joint @ w["a"] + w["ab"]) @ w["av"])
        assert got == pytest.approx(float((e / e.sum()) @ joint @ w["o"] + w["ob"][0]), abs=1e-4)


# --- language model against plain context-tree weighting ---


def plain_ctw(train, text, depth, least):
    """log10 probability of ``text``, by dictionaries: contexts rarer than ``least`` share one leaf below their parent."""
    counts = {}
    seqs = [list(t.lower().encode()) + [0xFF] for t in train]
    for s in seqs:
        past = [0xFF] * depth
        for b in s:
            for d in range(depth + 1):
                counts.setdefault(tuple(past[:d]), Counter())[b] += 1
            past = [b, *past[:-1]]
    used = sorted({b for s in seqs for b in s})
    width = 1 << max(1, len(used).bit_length())
    code = {b: i for i, b in enumerate(used)}
    kept = {c for c, n in counts.items() if not c or sum(n.values()) >= least}
    bits = width.bit_length() - 1

    def split(n, node_bits, value):
        """Zeros and ones at the decision node whose leading bits are ``value``."""
        out = [0, 0]
        for b, k in n.items():
            if code[b] >> (bits - node_bits) == value:
                out[code[b] >> (bits - node_bits - 1) & 1] += k
        return out

    kt = lambda z, o: math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.log(math.pi) - math.lgamma(z + o + 1)
    children = {}
    for c in kept:
        if c:
            children.setdefault(c[:-1], []).append(c)
    cache = {}

    def weigh(c, k, v):
        if (c, k, v) not in cache:
            z, o = split(counts[c], k, v)
            own = kt(z, o)
            if len(c) == depth:
                cache[c, k, v] = own, 1.0, None
            else:
                rest, total = Counter(counts[c]), 0.0
                for x in children.get(c, []):
                    rest.subtract(counts[x])
                    total += weigh(x, k, v)[0]
                lz, lo = split(rest, k, v)
                total += kt(lz, lo)
                m = math.log(0.5) + max(own, total) + math.log1p(math.exp(-abs(own - total)))
                cache[c, k, v] = m, math.exp(math.log(0.5) + own - m), (lo + 0.5) / (lz + lo + 1)
        return cache[c, k, v]

    def chance(past, k, v):
        left, q = 1.0, 0.0
        for d in range(depth + 1):
            c = tuple(past[:d])
            if c not in kept:
                return q + left * weigh(tuple(past[: d - 1]), k, v)[2]
            z, o = split(counts[c], k, v)
            _, weight, _ = weigh(c, k, v)
            q, left = q + left * weight * (o + 0.5) / (z + o + 1), left * (1 - weight)
        return q

    total, past = 0.0, [0xFF] * depth
    for b in [*text.lower().encode(), 0xFF]:
        index = code.get(b, len(used))
        for k in range(bits):
            q = chance(past, k, index >> (bits - k))
            total += math.log10(q if index >> (bits - 1 - k) & 1 else 1 - q)
        if b not in code:
            total -= math.log10(256 - len(used))
        past = [b, *past[:-1]]
    return total


def test_scores_equal_plain_context_tree_weighting(spark):
    train = ["abracadabra", "banana bandana", "cabana banana", "abra abra", "a"]
    asked = ["banana", "cadabra", "zebra", ""]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(train)] + [(100 + i, t) for i, t in enumerate(asked)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in context_tree.score_texts(d, F.col("doc_id") < 100).collect()}
    for i, t in enumerate(asked):
        assert got[100 + i] == pytest.approx(plain_ctw(train, t, context_tree.DEPTH, 2), abs=2e-3)


def test_a_smaller_table_keeps_the_commoner_contexts(spark):
    rng = np.random.default_rng(16)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(50)]
    d = spark.createDataFrame([(i, " ".join(rng.choice(words, 60))) for i in range(80)], "doc_id long, text string")
    held = F.col("doc_id") % 4 == 0
    total = lambda size: context_tree.score_texts(d, ~held, table_bytes=size).filter(held).agg(F.sum("score")).first()[0]
    assert total(1 << 22) > total(1 << 13) > total(1 << 8)


def test_no_context_is_merged_for_the_size_of_the_table(spark):
    """128 symbols wide, the 60,000 kept contexts were more than a table of 48 MB held, and all of them were seen twice only."""
    rng = np.random.default_rng(21)
    letters = [chr(x) for x in (*range(33, 65), *range(91, 127), *range(0x100, 0x140))]
    text = "".join(rng.choice(letters, 14_000))
    asked = [text[5_000:5_040], text[-30:] + "abc", text[100:120][::-1]]
    d = spark.createDataFrame([(0, text), (1, text), *((10 + i, t) for i, t in enumerate(asked))], "doc_id long, text string")
    got = {r.doc_id: r.score for r in context_tree.score_texts(d, F.col("doc_id") < 2).collect()}
    seen, n = np.unique(np.concatenate([context_tree.grams(*x[2:]) for x in context_tree.parts(pa.array([text, text]))]), return_counts=True)
    used = np.unique(seen & np.uint64(255)).astype(int)
    width = 1 << len(used).bit_length()
    contexts, tables = [], []
    for depth in range(context_tree.DEPTH + 1):
        found, place = np.unique(seen >> np.uint64(8 * (context_tree.DEPTH + 1 - depth)) if depth else np.zeros(len(seen), np.uint64), return_inverse=True)
        table = np.zeros((len(found), width))
        np.add.at(table, (place, np.searchsorted(used, (seen & np.uint64(255)).astype(int))), n)
        keep = table.sum(1) >= 2
        contexts.append(found[keep])
        tables.append(table[keep])
    assert sum(map(len, contexts)) * width * 8 > 48 << 20
    whole = context_tree.assemble(contexts, tables, used)
    for i, t in enumerate([text, text]):
        assert got[i] == pytest.approx(whole.score(*next(context_tree.parts(pa.array([t])))[2:])[0], rel=1e-4)
    for i, t in enumerate(asked):
        assert got[10 + i] == pytest.approx(whole.score(*next(context_tree.parts(pa.array([t])))[2:])[0], abs=2e-2)


def test_scores_do_not_hang_on_blocks_and_partitions(spark):
    rng = np.random.default_rng(22)
    words = ["".join(rng.choice(list("abcdeABé"), 4)) for _ in range(60)]
    d = spark.createDataFrame([(i, None if i == 7 else " ".join(rng.choice(words, int(rng.integers(0, 50))))) for i in range(200)], "doc_id long, text string")
    run = lambda x, **k: {r.doc_id: (r.score, r.base_score, r.n_known) for r in context_tree.score_texts(x, F.col("doc_id") % 3 > 0, **k).collect()}
    one = run(d.coalesce(1))
    many = run(d.repartition(7), block_bytes=300)
    assert one.keys() == many.keys()
    for i in one:
        assert one[i] == pytest.approx(many[i], rel=1e-5, abs=1e-5)


# --- language ---


def test_many_languages_and_scripts(spark):
    rng = np.random.default_rng(17)
    rows = []
    for k in range(80):
        start = 0x4E00 + 40 * k if k % 2 else 0x61
        letters = [chr(start + int(x)) for x in (rng.permutation(26)[:8] if k % 2 == 0 else range(40))]
        words = ["".join(rng.choice(letters, 5)) for _ in range(12)]
        rows += [(len(rows) + j, " ".join(rng.choice(words, 40)), f"l{k:02d}") for j in range(4)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(d, train_on=F.col("doc_id") % 4 != 2)
    assert len(model.languages) == 80 and model.n_symbols <= language.COMMON + language.SHARED + 3
    got = {r.doc_id: r.lang_pred for r in language.identify(d, model).collect()}
    held = [(i, lang) for i, _, lang in rows if i % 4 == 2]
    assert np.mean([got[i] == lang for i, lang in held]) > 0.9


def test_a_language_with_much_text_has_no_start(spark):
    rng = np.random.default_rng(18)
    make = lambda letters, n: " ".join("".join(rng.choice(list(letters), 4)) for _ in range(n))
    rows = [(i, make("abcdef", 200), "much") for i in range(60)] + [(100 + i, make("abcghi", 12), "few") for i in range(6)] + [(200 + i, make("abcghi", 12), None) for i in range(10)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language.identify(d, language.train(d)).collect()}
    assert [got[200 + i] for i in range(10)].count("few") >= 9


# --- near duplicates ---


@pytest.mark.parametrize("radius", [6, 8])
def test_wider_radii_lose_no_link(spark, radius):
    rng = np.random.default_rng(radius)
    prints = {int(x) for x in rng.integers(0, 2**62, 30)}
    for x in list(prints):
        prints.add(x ^ sum(1 << int(b) for b in rng.choice(62, radius, replace=False)))
        prints.add(x ^ sum(1 << int(b) for b in rng.choice(62, radius + 1, replace=False)))
    fps = spark.createDataFrame([(p,) for p in prints], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(fps, radius)).collect()}
    prints, up = sorted(prints), {p: p for p in prints}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if bin(a ^ b).count("1") <= radius:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    assert {p: roots.get(p, p) for p in prints} == {p: find(p) for p in prints}


def test_hot_fingerprints_take_their_own_way(spark):
    d = spark.range(60).select(F.when(F.col("id") == 7, None).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 2 == 0, "one two three four five").otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    want = sorted(map(str, simhash.near_duplicates(d).collect()))
    assert sorted(map(str, simhash.near_duplicates(d, hot_rows=5).collect())) == want


# --- nearest neighbours ---


def test_tiny_norms_take_part_and_repeated_ids_count_once(spark):
    rows = [(0, [1.0, 0.0]), (1, [1e-200, 0.0]), (2, [0.5, 0.5]), (2, [0.25, 0.5]), (3, [5e-324, 0.0]), (4, [0.0, -0.0]), (5, [-1.0, 0.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id): (r["rank"], r.score) for r in collision_ann.nearest(d, F.col("vec_id") % 20 == 0, k=20).collect()}
    assert got == {(0, 2): (1, 0.25), (0, 1): (2, 1e-200), (0, 3): (3, 5e-324), (0, 5): (4, -1.0)}
    tiny = spark.createDataFrame([(i, [1e-200 * (i + 1), 1e-200]) for i in range(30)], "vec_id long, embedding array<double>")
    assert collision_ann.nearest(tiny, F.col("vec_id") % 20 == 0, k=5).count() == 10


def test_recall_on_embeddings_in_several_blocks(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    for block_rows in (16_384, 300):
        found = collision_ann.nearest(table, F.col("vec_id") % 20 == 0, block_rows=block_rows, query_rows=40).toPandas()
        p = table.toPandas()
        ids, x = p["vec_id"].to_numpy(), np.stack(p["embedding"].to_numpy()).astype(float)
        hits = []
        for q in np.flatnonzero(ids % 20 == 0):
            s = x @ x[q]
            s[q] = -np.inf
            best = ids[np.lexsort((ids, -s))[:20]]
            hits.append(len(set(best.tolist()) & set(found[found["query_id"] == ids[q]]["vec_id"].tolist())) / 20)
        assert np.mean(hits) >= 0.9, block_rows


def test_packing_rows_that_repeat_an_id_are_packed_each(odd):
    got = packing.pack_documents(odd, ranks_path=ranks_path(), capacity=128).collect()
    assert sum(r.length for r in got if r.doc_id == 3) == 3 * (len(next(tokens.encode_batch(pa.array([TEXTS[3]]), ranks_path()))) + 1)
    assert zlib.crc32(np.array([tokens.SPECIAL_ID, 0], "<u4").tobytes()) in {r.ids_crc32 for r in got if r.doc_id is None}
