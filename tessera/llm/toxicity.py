"""Toxicity scores by a bidirectional gated recurrent network with attention pooling.

Input of a step is a word: the embedding of its hash bucket, and the mean embedding of its
runs of five bytes next to that of its first run (so that words with a part in common are close). Two gated recurrent layers
read a window of words, one from each side; attention weighs their joint states into one
vector, and a logistic unit scores it. A text is cut into overlapping windows, all of which
are scored; the text's score is that of its highest window. The network is trained in numpy,
with gradients by hand and Adam, on the window of each labelled text that now scores highest
(a label says that something in the text is toxic, not where) and on random windows of clean
texts. Embeddings start from the log-odds of a word among toxic texts. Scores are then shifted
so that 0.5 is the cut that separates the labelled texts best.

Training takes at most ``sample_rows`` labelled rows of each kind, those of smallest hash.
Scoring is one map over Arrow batches, without a shuffle, over whole texts.

Defined cases: null text counts as empty; a text without words gets the score of a window without
words; null labels are left out, and of contradicting labels the larger counts; with labels of
one kind only, or none, every text gets that label's smoothed share; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._frames import aside
from tessera.llm._text import LOWER, parts, span_hashes, words

WINDOW, STRIDE = 32, 24
GRAM = 5
N_WORDS, N_RUNS = 1 << 13, 1 << 17
D_WORD, D_CHAR, HIDDEN, ATTENTION = 8, 4, 8, 8
_LETTERISH = np.zeros(256, bool)
_LETTERISH[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def encode(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets, character-run buckets, first run and number of runs of each word, and each text's first word.

    A word's hash leaves out leading and trailing symbols. Its runs are those of GRAM bytes in it
    with a blank before it; a shorter word is one run.
    """
    low = LOWER[data]
    starts, ends, first = words(data, offsets)
    solid = np.zeros(len(low) + 1, np.int64)
    np.cumsum(_LETTERISH[low], out=solid[1:])
    at = np.flatnonzero(_LETTERISH[low])
    some = solid[ends] > solid[starts]
    inner_start, inner_end = starts.copy(), ends.copy()
    inner_start[some] = at[solid[starts[some]]]
    inner_end[some] = at[solid[ends[some]] - 1] + 1
    h = span_hashes(low, inner_start, inner_end)
    # The run at byte i is the blank or byte before it and the GRAM - 1 bytes from it on.
    wide = np.concatenate([low, np.zeros(GRAM, np.uint8)]).astype(np.uint64)
    run = np.zeros(len(low), np.uint64)
    run[1:] = wide[: max(0, len(low) - 1)]
    run[inner_start] = 32
    for k in range(GRAM - 1):
        run = run * np.uint64(257) + wide[k : k + len(low)]
    runs = (((run * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) & np.uint64(N_RUNS - 1)).astype(np.int32)
    return (h & np.uint64(N_WORDS - 1)).astype(np.int32), runs, inner_start, np.maximum(inner_end - inner_start - GRAM + 2, 1), first


def char_means(runs: np.ndarray, starts: np.ndarray, size: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Mean embedding of each word's character runs, then that of its first run."""
    out = np.empty((len(starts), 2 * table.shape[1]), np.float32)
    out[:, table.shape[1] :] = table[runs[starts]]
    total = np.zeros(len(runs) + 1)
    for k in range(table.shape[1]):
        np.cumsum(table[runs, k], out=total[1:], dtype=float)
        out[:, k] = (total[starts + size] - total[starts]) / size
    return out


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... , sizes[i] of them, for each i."""
    return np.repeat(starts, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and number of words of every window; none for a text without words."""
    count = np.diff(first)
    n = np.where(count > 0, np.maximum(0, -(-(count - WINDOW) // STRIDE)) + 1, 0)
    owner = np.repeat(np.arange(len(count)), n)
    start = first[owner] + STRIDE * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    return owner, start, np.minimum(WINDOW, first[owner + 1] - start)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """w: word and run embeddings (ew, ec), per direction input, gate and candidate matrices, attention, output."""

    w: dict[str, np.ndarray]
    cut: float = 0.0
    constant: float | None = None
    moments: dict[str, list[np.ndarray]] = field(default_factory=dict)
    steps: int = 0

    @staticmethod
    def fresh(seed: int = 6) -> Network:
        rng = np.random.default_rng(seed)
        d = D_WORD + 2 * D_CHAR
        r = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        w = {"ew": 0.1 * rng.standard_normal((N_WORDS, D_WORD)).astype(np.float32), "ec": 0.3 * rng.standard_normal((N_RUNS, D_CHAR)).astype(np.float32)}
        for k in "fb":
            w |= {f"x{k}": r(d, 3 * HIDDEN), f"i{k}": np.zeros(3 * HIDDEN, np.float32), f"g{k}": r(HIDDEN, 2 * HIDDEN), f"c{k}": r(HIDDEN, HIDDEN)}
        w |= {"a": r(2 * HIDDEN, ATTENTION), "ab": np.zeros(ATTENTION, np.float32), "av": r(ATTENTION, 1)[:, 0], "o": r(2 * HIDDEN, 1)[:, 0], "ob": np.zeros(1, np.float32)}
        return Network(w)

    def run(self, x: dict[str, np.ndarray], start: np.ndarray, size: np.ndarray, keep: bool = False):
        """Logit of each window. x[k]: input of each word to direction k. keep: also what training needs."""
        w, n = self.w, len(start)
        states = np.zeros((WINDOW, n, 2 * HIDDEN), np.float32)
        tape: dict[str, list] = {"f": [], "b": []}
        live = [np.arange(WINDOW)[t] < size for t in range(WINDOW)]
        for k, times in (("f", range(WINDOW)), ("b", range(WINDOW - 1, -1, -1))):
            h = np.zeros((n, HIDDEN), np.float32)
            half = slice(0, HIDDEN) if k == "f" else slice(HIDDEN, 2 * HIDDEN)
            for t in times:
                on = live[t]
                u = x[k][np.minimum(start + t, len(x[k]) - 1)]
                gates = _sigmoid(u[:, : 2 * HIDDEN] + h @ w[f"g{k}"])
                z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
                c = np.tanh(u[:, 2 * HIDDEN :] + (r * h) @ w[f"c{k}"])
                new = np.where(on[:, None], h + z * (c - h), h)
                if keep:
                    tape[k].append((t, h, z, r, c))
                h = new
                states[t, :, half] = h
        e = np.tanh(states @ w["a"] + w["ab"])
        weight = e @ w["av"]
        weight[~np.array(live)] = -1e9
        weight = np.exp(weight - weight.max(0))
        weight /= weight.sum(0)
        pooled = np.einsum("tn,tnd->nd", weight, states)
        logit = pooled @ w["o"] + w["ob"][0]
        return (logit, states, tape, live, e, weight, pooled) if keep else logit

    def inputs(self, word: np.ndarray, chars: np.ndarray) -> dict[str, np.ndarray]:
        x = np.concatenate([self.w["ew"][word], chars], axis=1)
        return {k: x @ self.w[f"x{k}"] + self.w[f"i{k}"] for k in "fb"}

    def gradients(self, word: np.ndarray, runs: np.ndarray, starts: np.ndarray, sizes: np.ndarray, start: np.ndarray, size: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean logistic loss over the windows (of words given one after another), and its gradients."""
        w = self.w
        chars = char_means(runs, starts, sizes, w["ec"])
        x_in = np.concatenate([w["ew"][word], chars], axis=1)
        x = self.inputs(word, chars)
        logit, states, tape, live, e, weight, pooled = self.run(x, start, size, keep=True)
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        loss = float(-np.mean(y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9)))
        d_logit = ((p - y) / len(y)).astype(np.float32)
        g: dict[str, np.ndarray] = {"o": pooled.T @ d_logit, "ob": np.array([d_logit.sum()])}
        d_pooled = d_logit[:, None] * w["o"]
        d_weight = np.einsum("nd,tnd->tn", d_pooled, states)
        d_states = weight[:, :, None] * d_pooled
        d_score = weight * (d_weight - (weight * d_weight).sum(0))
        d_e = d_score[:, :, None] * w["av"] * (1 - e * e)
        g["av"] = np.einsum("tn,tnk->k", d_score, e)
        g["a"], g["ab"] = np.einsum("tnd,tnk->dk", states, d_e), d_e.sum((0, 1))
        d_states += d_e @ w["a"].T
        d_x = np.zeros_like(x_in)
        for k in "fb":
            gate, cand = w[f"g{k}"], w[f"c{k}"]
            g_gate, g_cand, d_u_all = np.zeros_like(gate), np.zeros_like(cand), np.zeros((len(x_in), 3 * HIDDEN), np.float32)
            half = slice(0, HIDDEN) if k == "f" else slice(HIDDEN, 2 * HIDDEN)
            d_h = np.zeros((len(y), HIDDEN), np.float32)
            for t, h, z, r, c in reversed(tape[k]):
                on = live[t][:, None]
                d_h = d_h + d_states[t, :, half]
                d_new = d_h * on
                d_c = d_new * z * (1 - c * c)
                d_rh = d_c @ cand.T
                d_z = d_new * (c - h) * z * (1 - z)
                d_r = d_rh * h * r * (1 - r)
                d_gates = np.concatenate([d_z, d_r], 1)
                g_gate += h.T @ d_gates
                g_cand += (r * h).T @ d_c
                rows = np.flatnonzero(live[t])
                np.add.at(d_u_all, start[rows] + t, np.concatenate([d_gates, d_c], 1)[rows])
                d_h = d_h * ~on + d_new * (1 - z) + d_rh * r + d_gates @ gate.T
            g[f"g{k}"], g[f"c{k}"] = g_gate, g_cand
            g[f"x{k}"], g[f"i{k}"] = x_in.T @ d_u_all, d_u_all.sum(0)
            d_x += d_u_all @ w[f"x{k}"].T
        g["ew"] = np.zeros_like(w["ew"])
        np.add.at(g["ew"], word, d_x[:, :D_WORD])
        g["ec"] = np.zeros_like(w["ec"])
        np.add.at(g["ec"], runs[_spread(starts, sizes)], np.repeat(d_x[:, D_WORD : D_WORD + D_CHAR] / sizes[:, None], sizes, axis=0))
        np.add.at(g["ec"], runs[starts], d_x[:, D_WORD + D_CHAR :])
        return loss, g

    def update(self, g: dict[str, np.ndarray], rate: float) -> None:
        """One step of Adam."""
        self.steps += 1
        for k, d in g.items():
            m = self.moments.setdefault(k, [np.zeros_like(self.w[k]), np.zeros_like(self.w[k])])
            m[0] += 0.1 * (d - m[0])
            m[1] += 0.01 * (d * d - m[1])
            pace = 0.1 * rate if k in ("ew", "ec") else rate  # rare words would be learned by heart
            self.w[k] -= (pace * (m[0] / (1 - 0.9**self.steps)) / (np.sqrt(m[1] / (1 - 0.99**self.steps)) + 1e-7)).astype(np.float32)

    def window_logits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, first word, number of words and logit of every window of every text."""
        word, runs, starts, sizes, first = encode(data, offsets)
        owner, start, size = windows(first)
        logit = np.zeros(len(owner), np.float32)
        if len(owner):
            x = self.inputs(word, char_means(runs, starts, sizes, self.w["ec"]))
            for lo in range(0, len(owner), 2048):
                logit[lo : lo + 2048] = self.run(x, start[lo : lo + 2048], size[lo : lo + 2048])
        return owner, start - first[owner], size, logit

    def score(self, array: pa.Array) -> np.ndarray:
        """Score of each text, 0 to 1."""
        if self.constant is not None:
            return np.full(len(array), self.constant)
        top = np.full(len(array), self.w["ob"][0], float)
        for row, end, data, offsets in parts(array):
            owner, _, _, logit = self.window_logits(data, offsets)
            best = np.full(end - row, -np.inf)
            np.maximum.at(best, owner, logit)
            top[row:end] = np.where(np.isfinite(best), best, top[row:end])
        return 1 / (1 + np.exp(-np.clip(top - self.cut, -30, 30)))


def _log_odds(counts: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Log-odds of each bucket between toxic and clean texts, by the texts that hold it (counts: clean, toxic)."""
    p0, p1 = (counts[0] + 3 * (1 - y.mean())) / (len(y) - y.sum() + 3), (counts[1] + 3 * y.mean()) / (y.sum() + 3)
    return np.clip(np.log(p1 / p0), -4, 4).astype(np.float32)


def _texts_with(buckets: np.ndarray, texts: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
    """Clean and toxic texts that hold each bucket."""
    seen = np.unique(texts * size + buckets)
    toxic = y[seen // size] == 1
    return np.stack([np.bincount(seen[k] % size, minlength=size) for k in (~toxic, toxic)])


def fit(texts: pa.Array, y: np.ndarray, *, epochs: int = 5, batch: int | None = None, rate: float = 0.01, seed: int = 6) -> Network:
    net = Network.fresh(seed)
    if len(np.unique(y)) < 2:
        net.constant = (y.sum() + 0.5) / (len(y) + 1.0)
        return net
    batch = batch or min(256, max(32, len(y) // 16))
    rng = np.random.default_rng(seed)
    apart = rng.random(len(y)) < 0.2  # these only set the cut
    if len(np.unique(y[apart])) < 2 or len(np.unique(y[~apart])) < 2:
        apart[:] = False
    texts_cut, y_cut = (texts.filter(pa.array(apart)), y[apart]) if apart.any() else (texts, y)
    texts, y = texts.filter(pa.array(~apart)), y[~apart]
    held = list(parts(texts))
    by_word, by_run = np.zeros((2, N_WORDS)), np.zeros((2, N_RUNS))
    for row, end, data, offsets in held:
        word, runs, starts, sizes, first = encode(data, offsets)
        owner = row + np.repeat(np.arange(end - row), np.diff(first))
        by_word += _texts_with(word, owner, y, N_WORDS)
        by_run += _texts_with(runs[_spread(starts, sizes)], np.repeat(owner, sizes), y, N_RUNS)
    net.w["ew"][:, 0], net.w["ec"][:, 0] = _log_odds(by_word, y) / 2, _log_odds(by_run, y)
    for epoch in range(epochs):
        picked = []  # part, text in it, first word, number of words
        for k, (row, end, data, offsets) in enumerate(held):
            owner, start, size, logit = net.window_logits(data, offsets)
            if not len(owner):
                continue
            order = np.lexsort((-logit, owner))
            top = order[np.concatenate([[True], owner[order][1:] != owner[order][:-1]])]
            clean = np.flatnonzero(y[row + owner] == 0)
            extra = rng.choice(clean, min(len(clean), len(top)), replace=False) if len(clean) else clean
            picked += [(k, owner[i], start[i], size[i]) for i in np.concatenate([top, extra])]
        for *given, text in _batches(picked, held, rng, batch):
            _, g = net.gradients(*given, y[text].astype(np.float32))
            net.update(g, rate * (0.5 if epoch >= epochs // 2 else 1.0))
    scores = net.score(texts_cut)
    logit = np.log(scores / (1 - scores))
    cuts = np.unique(np.quantile(logit, np.linspace(0.005, 0.995, 397)))
    miss = np.searchsorted(np.sort(logit[y_cut == 1]), cuts) / (y_cut == 1).sum()
    clear = np.searchsorted(np.sort(logit[y_cut == 0]), cuts) / (y_cut == 0).sum()
    gain = clear * 3 - miss  # clean texts are the many, so a false alarm weighs more
    net.cut = float(cuts[np.flatnonzero(gain >= gain.max() - 1e-9)].mean())
    net.moments = {}
    return net


def _batches(picked: list, held: list, rng: np.random.Generator, batch: int) -> Iterator[tuple]:
    """Batches of windows with their own words: word, runs, starts, sizes, start, size, text."""
    cache: dict[int, tuple] = {}
    for chosen in np.array_split(rng.permutation(len(picked)), max(1, len(picked) // batch)):
        word, runs, starts, sizes, start, size, text = [], [], [], [], [], [], []
        n_words = n_runs = 0
        for i in chosen:
            k, owner, first_word, n = picked[i]
            if k not in cache:
                cache[k] = encode(held[k][2], held[k][3])
            w, p, s, z, first = cache[k]
            a = first[owner] + first_word
            lo_byte, hi_byte = s[a], s[a + n - 1] + z[a + n - 1]
            word.append(w[a : a + n])
            runs.append(p[lo_byte:hi_byte])
            starts.append(s[a : a + n] - lo_byte + n_runs)
            sizes.append(z[a : a + n])
            start.append(n_words)
            size.append(n)
            text.append(held[k][0] + owner)
            n_words += n
            n_runs += hi_byte - lo_byte
        yield *(np.concatenate(v) for v in (word, runs, starts, sizes)), np.array(start), np.array(size), np.array(text)


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_on: Column | None = None, sample_rows: int = 2_500, sample_chars: int = 65_536, **options) -> Network:
    """Fit on labelled rows for which ``train_on`` (an expression over the id, here named doc_id) holds.

    Learning takes ``sample_rows`` texts a label and of a text longer than ``sample_chars`` as many characters in 64 slices at even distances, so that what
    comes to the driver is bounded in bytes too. Scores always take whole texts.
    """
    y = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("y")).filter("y IN (0, 1) AND doc_id IS NOT NULL")
    if train_on is not None:
        y = y.filter(train_on)
    y = y.groupBy("doc_id").agg(F.max("y").cast("int").alias("y"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    y = y.filter("y = 1").orderBy(*order).limit(sample_rows).unionByName(y.filter("y = 0").orderBy(*order).limit(sample_rows))
    got = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(y), "doc_id").groupBy("doc_id").agg(F.max("y").alias("y"), F.max("text").alias("text")).select("doc_id", "y", _sampled(F.col("text"), sample_chars).alias("text")).toArrow().sort_by("doc_id")
    return fit(got.column("text").combine_chunks() if got.num_rows else pa.array([], pa.string()), got.column("y").to_numpy().astype(int), **options)


def _sampled(text: Column, chars: int) -> Column:
    width = chars // 64
    slices = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.substring(text, (F.floor(i * (F.length(text) - width) / 63) + 1).cast("int"), F.lit(width)))
    return F.when(F.length(text) <= chars, text).otherwise(F.array_join(slices, " "))


def score_column(model: Network, text: Column | str, spark) -> Column:
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def toxicity(text: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(text))

    return toxicity(text)


def _text_name(docs: DataFrame, text_col: str, added: list[str]) -> tuple[str, DataFrame]:
    moved = aside(docs, added)
    return moved.columns[docs.columns.index(text_col)], moved


def toxicity_scores(docs: DataFrame, model: Network, *, text_col: str = "text", score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """``docs`` with a score in [0, 1] and predicted 0 / 1 at 0.5; columns of these names become ``<name>_in``."""
    text_col, docs = _text_name(docs, text_col, [score_col, predicted_col])
    return docs.withColumn(score_col, score_column(model, text_col, docs.sparkSession)).withColumn(predicted_col, (F.col(score_col) >= 0.5).cast("int"))
