"""Quality classifier: Bradley-Terry pairwise ranking.

A document's score is linear in features of its whole text: shape (symbols, capitals,
digits, repeated words, word and line lengths), and the square roots of the shares of its words and of its
runs of three bytes, each hashed into ``BUCKETS`` classes. Shares are pulled to those of good texts by
pseudo-counts, so that a short text is judged by what it has. Weights come from preference pairs,
one text labelled 1 against one labelled 0, by logistic loss on the difference of their
features, so only the order of the two matters. The cut is a quantile of the labelled
texts' scores, the one with the best balanced accuracy; scores are then mapped through a
logistic curve that puts the cut at ``threshold``.

Fitting takes at most ``sample_rows`` labelled rows, those of smallest hash; everything
else covers all rows. Scoring is one map over Arrow batches, without a shuffle.

Defined cases: null text counts as empty; an empty text has all features 0 and a score
like any other; labels that are null are left out, and of contradicting labels the larger
counts; with labels of one kind only, every score is that label's share moved into (0, 1);
no labels at all give 0.5 everywhere; of rows that repeat a labelled id the largest text is learned;
equal texts have equal scores; an empty table gives no rows; extra columns pass through, and one named like
a result column becomes ``<name>_in``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._frames import aside
from tessera.llm._text import LOWER, WHITE, parts, per_text, span_hashes, words

N_COUNTS = 9
#: Classes of words, and as many of byte runs.
BUCKETS = 256
#: Pseudo-words and pseudo-bytes that pull a short text's ratios to those of good texts.
_PSEUDO_WORDS, _PSEUDO_BYTES = 12.0, 60.0


def counts(array: pa.Array) -> np.ndarray:
    """Symbols, lines, repeats of the last and the last but one word, letters, capitals, digits, words and bytes of each text.

    Then how many of its words, and of its runs of three lower-cased bytes, fall into each class.
    """
    out = np.zeros((len(array), N_COUNTS + 2 * BUCKETS), np.float32)
    for row, end, data, offsets in parts(array):
        starts, ends, first = words(data, offsets)
        size = np.diff(offsets)
        upper = per_text((data >= 65) & (data <= 90), offsets)
        digit = per_text((data >= 48) & (data <= 57), offsets)
        letter = per_text(((data >= 97) & (data <= 122)) | (data >= 128), offsets) + upper
        other = size - letter - digit - per_text(WHITE[data], offsets)
        h = span_hashes(data, starts, ends)
        same1, same2 = np.zeros(len(h), bool), np.zeros(len(h), bool)
        same1[1:], same2[2:] = h[1:] == h[:-1], h[2:] == h[:-2]
        out[row:end, :N_COUNTS] = np.stack([other, per_text(data == 10, offsets), per_text(same1, first), per_text(same2, first), letter, upper, digit, np.diff(first), size], axis=1)
        low = LOWER[data]
        n, owner = end - row, np.repeat(np.arange(end - row), np.diff(first))
        word = (span_hashes(low, starts, ends) >> np.uint64(40)).astype(np.int64) % BUCKETS
        wide = low.astype(np.uint32)
        run = ((wide[:-2] | (wide[1:-1] << np.uint32(8)) | (wide[2:] << np.uint32(16))) * np.uint32(2654435761)) >> np.uint32(16)
        text = np.repeat(np.arange(n), size)
        within = text[2:] == text[:-2] if len(text) > 2 else np.zeros(0, bool)
        out[row:end, N_COUNTS : N_COUNTS + BUCKETS] = np.bincount(owner * BUCKETS + word, minlength=n * BUCKETS).reshape(n, BUCKETS)
        out[row:end, N_COUNTS + BUCKETS :] = np.bincount((text[2:] * BUCKETS + run % BUCKETS)[within], minlength=n * BUCKETS).reshape(n, BUCKETS)
    return out


def ratios(c: np.ndarray, prior: np.ndarray | None = None) -> np.ndarray:
    """The first five counts a word, the next two a byte, shrunk to ``prior`` by pseudo-counts."""
    by = np.concatenate([np.repeat(c[:, 7:8], 5, axis=1), np.repeat(c[:, 8:9], 2, axis=1)], axis=1)
    if prior is None:
        return c[:, :7] / np.maximum(by, 1)
    pseudo = np.repeat([_PSEUDO_WORDS, _PSEUDO_BYTES], [5, 2])
    return (c[:, :7] + pseudo * prior) / (by + pseudo)


def shares(c: np.ndarray, prior: np.ndarray | None = None) -> np.ndarray:
    """Shares of the word classes and of the byte-run classes, shrunk to ``prior``."""
    out = c[:, N_COUNTS:].copy()
    for k, pseudo in enumerate((_PSEUDO_WORDS, _PSEUDO_BYTES)):
        at = slice(k * BUCKETS, (k + 1) * BUCKETS)
        total = out[:, at].sum(1, keepdims=True)
        out[:, at] = out[:, at] / np.maximum(total, 1) if prior is None else (out[:, at] + pseudo * prior[at]) / (total + pseudo)
    return out


def features(c: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Ratios up to 1 (letters in units of 8), their square roots, how far word length is from the prior's, roots of shares."""
    x = ratios(c, prior[:7])
    far = np.abs(x[:, 4:5] - prior[4]) / 5
    x = np.minimum(x / np.array([1, 1, 1, 1, 8, 1, 1]), 1)
    return np.concatenate([x, np.sqrt(x), np.minimum(far, 1), np.sqrt(shares(c, prior[7:]))], axis=1)


@dataclass(frozen=True)
class Ranker:
    """Weights over standardised features; the cut maps to ``threshold`` on a logistic curve."""

    prior: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    threshold: float
    constant: float | None = None

    def score(self, c: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(c), self.constant)
        # Row by row, so that a text's score doesn't depend on its place in a batch.
        z = ((features(c, self.prior) - self.mean) / self.scale * self.weights).sum(1) - self.cut
        return 1 / (1 + np.exp(-np.clip(z + np.log(self.threshold / (1 - self.threshold)), -30, 30)))


def fit(c: np.ndarray, y: np.ndarray, *, threshold: float = 0.3, n_pairs: int = 40_000, l2: float = 1e-3, l2_classes: float = 0.05, steps: int = 12, seed: int = 9) -> Ranker:
    """Bradley-Terry weights by Newton's method on the pairwise logistic loss; ``l2_classes`` holds for the hashed classes."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        none = np.zeros(0)
        return Ranker(none, none, none, none, 0.0, threshold, (len(good) + 0.5) / (len(y) + 1))
    prior = np.concatenate([np.median(ratios(c[good]), axis=0), shares(c[good]).mean(0)])
    x = features(c, prior)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = ((x - mean) / scale).astype(np.float32)
    rng = np.random.default_rng(seed)
    left, right = good[rng.integers(0, len(good), n_pairs)], bad[rng.integers(0, len(bad), n_pairs)]
    penalty = np.where(np.arange(x.shape[1]) < 15, l2, l2_classes)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        gradient, hessian = penalty * w, np.diag(penalty)
        for at in range(0, n_pairs, 4_000):
            d = z[left[at : at + 4_000]] - z[right[at : at + 4_000]]
            p = 1 / (1 + np.exp(np.clip(d @ w.astype(np.float32), -30, 30)))
            gradient -= (p @ d) / n_pairs
            hessian += (d * (p * (1 - p))[:, None]).T @ d / n_pairs
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    ranks = z @ w
    cuts = np.unique(np.quantile(ranks, np.linspace(0.005, 0.995, 199)))
    below_bad = np.searchsorted(np.sort(ranks[bad]), cuts, side="left") / len(bad)
    below_good = np.searchsorted(np.sort(ranks[good]), cuts, side="left") / len(good)
    return Ranker(prior, mean, scale, w, float(cuts[np.argmax(below_bad - below_good)]), threshold)


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_on: Column | None = None, sample_rows: int = 20_000, **options) -> Ranker:
    """Fit on the labelled rows for which ``train_on`` (an expression over the id, here named doc_id) holds."""
    y = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("y")).filter("y IN (0, 1) AND doc_id IS NOT NULL")
    if train_on is not None:
        y = y.filter(train_on)
    y = y.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    picked = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(y), "doc_id").groupBy("doc_id").agg(F.max("y").cast("int").alias("y"), F.max("text").alias("text"))

    def extract(batches):
        for b in batches:
            c = counts(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array([row.tobytes() for row in c], pa.binary())], ["doc_id", "y", "c"])

    got = picked.select("doc_id", "y", "text").mapInArrow(extract, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, y int, c binary").toArrow().sort_by("doc_id")
    c = np.frombuffer(b"".join(got.column("c").to_pylist()), np.float32).reshape(-1, N_COUNTS + 2 * BUCKETS)
    return fit(c, got.column("y").to_numpy().astype(int), **options)


def score_column(model: Ranker, text: Column | str) -> Column:
    """Score of each text, from 0 to 1, as a column expression."""

    @F.arrow_udf("double")
    def quality(text: pa.Array) -> pa.Array:
        return pa.array(model.score(counts(text)))

    return quality(text)


def quality_scores(docs: DataFrame, model: Ranker, *, text_col: str = "text", score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """``docs`` with a score in [0, 1] and predicted 0 / 1 by the model's threshold."""
    moved = aside(docs, [score_col, predicted_col])
    text_col, docs = moved.columns[docs.columns.index(text_col)], moved
    return docs.withColumn(score_col, score_column(model, text_col)).withColumn(predicted_col, (F.col(score_col) >= model.threshold).cast("int"))


def keep_good(docs: DataFrame, model: Ranker, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model accepts, columns unchanged."""
    name = "__tessera_quality__"
    return docs.withColumn(name, score_column(model, text_col)).filter(F.col(name) >= model.threshold).drop(name)
