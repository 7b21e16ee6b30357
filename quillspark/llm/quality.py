r"""Quality classifier by positive-unlabelled learning.

Trusted positives (label 1) and unlabelled web text of the learning folds, with an estimated class prior, give the non-negative
unbiased risk of a small neural network: pi R+(P) + max(0, R-(U) - pi R-(P)). Where the second term turns negative, a
step goes the other way, so it isn't driven below zero. The loss is logistic, which is proper: the sigmoid of the output is the
score. Rows of label 0 are never used.

The prior is estimated from positives and unlabelled texts alone. A network tells half of the positives from half of the unlabelled; among texts
of the other halves that score at least c, the unlabelled hold at least the prior's part of the share that the positives hold, so the
ratio of the two shares bounds the prior from above. c is the score where ratio and confidence term are least; either half takes its turn.

Features are of the whole text alone: rates of classes of bytes, shapes and repetition of words and lines. Fitting
takes at most `most` positives and `unlabelled` other texts (those of the smallest hashes of the id); scoring reads all.

Cases: null and empty texts have a feature of their own and get a score; repeated rows get equal scores; a doc_id with several labels has the
greatest of them; without positives or without unlabelled texts every score is 0.5; other columns stay, but for the one that is added.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, fold, fresh, map_arrow, sample_ids

MOST, UNLABELLED = 6_000, 12_000

_CLASS = np.zeros(256, dtype=np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 full stop and comma, 6 other ASCII signs, 7 above ASCII, 8 newline
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 7
for _c in b" \t\r\x0b\x0c":
    _CLASS[_c] = 4
for _c in b".,":
    _CLASS[_c] = 5
for _c in b"!\"#$%&'()*+-/:;<=>?@[\\]^_`{|}~":
    _CLASS[_c] = 6
_CLASS[10] = 8
NAMES = ["lower", "upper", "digit", "space", "stops", "signs", "high", "newlines", "entropy", "short_words", "top_sign", "log_words", "word_bytes", "distinct", "top_word", "stops_per_word", "next_same", "caps_words", "line_distinct", "short_lines", "empty"]


def features(text: bytes) -> list[float]:
    n = len(text)
    if not text.strip():
        return [0.0] * (len(NAMES) - 1) + [1.0]
    hist = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    by = np.bincount(_CLASS, weights=hist, minlength=9) / n
    signs = np.where(_CLASS == 6, hist, 0)
    words = text.split()
    m = len(words)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    caps = sum(map(bytes.isupper, words))
    lines = text.split(b"\n")
    share = hist[hist > 0] / n
    return [
        *by[1:9].tolist(), -float(share @ np.log2(share)), sum(len(w) < 4 for w in words) / m, signs.max() / n, float(np.log1p(m)), min(n / m, 40.0), len(counts) / m * (1 + 0.15 * float(np.log1p(m))), max(counts.values()) / m,
        (hist[46] + hist[44]) / m, same / m, caps / m, len(set(lines)) / len(lines), sum(len(x) < 20 for x in lines) / len(lines), 0.0,
    ]


def feature_rows(texts: list[bytes | None]) -> np.ndarray:
    return np.array([features(t or b"") for t in texts], dtype=np.float64).reshape(-1, len(NAMES))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    prior: float

    def output(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w1, b1, w2, b2 = self.weights
        hidden = np.tanh(x @ w1 + b1)
        return hidden, hidden @ w2 + b2[0]

    def score(self, raw: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.full(len(raw), self.prior)
        return sigmoid(self.output(np.clip((raw - self.mean) / self.scale, -6, 6))[1])


def pu_risk(g: np.ndarray, positive: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The risk pi R+(P) + max(0, R-(U) - pi R-(P)) of outputs g, and the derivative by which a step goes."""
    n_p, n_u = int(positive.sum()), int((~positive).sum())
    plus, minus, s = np.logaddexp(0, -g), np.logaddexp(0, g), sigmoid(g)
    rest = minus[~positive].mean() - prior * minus[positive].mean()
    d_rest = np.where(positive, -prior * s / n_p, s / n_u)
    d = np.where(positive, prior * (s - 1) / n_p, 0) + d_rest if rest >= 0 else -d_rest
    return prior * plus[positive].mean() + max(0.0, rest), d


def two_class_risk(g: np.ndarray, positive: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """Positives against unlabelled, both sides of equal weight."""
    weight = np.where(positive, 0.5 / positive.sum(), 0.5 / (~positive).sum())
    sign = np.where(positive, -1.0, 1.0)
    return float(weight @ np.logaddexp(0, sign * g)), weight * sign * sigmoid(sign * g)


def fit_network(pos: np.ndarray, unl: np.ndarray, prior: float, risk, hidden: int = 12, steps: int = 300, rate: float = 0.02, decay: float = 1e-4, seed: int = 3) -> Network:
    both = np.concatenate([pos, unl])
    net = Network(both.mean(axis=0), both.std(axis=0) + 1e-6, [], prior)
    x, positive = np.clip((both - net.mean) / net.scale, -6, 6), np.arange(len(both)) < len(pos)
    rng = np.random.default_rng(seed)
    net.weights = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m, v = [np.zeros_like(w) for w in net.weights], [np.zeros_like(w) for w in net.weights]
    for t in range(1, steps + 1):
        h, g = net.output(x)
        d = risk(g, positive, prior)[1]
        back = np.outer(d, net.weights[2]) * (1 - h * h)
        grads = [x.T @ back, back.sum(axis=0), h.T @ d, np.array([d.sum()])]
        for i, grad in enumerate(grads):
            grad = grad + decay * net.weights[i]
            m[i], v[i] = 0.9 * m[i] + 0.1 * grad, 0.999 * v[i] + 0.001 * grad * grad
            net.weights[i] = net.weights[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return net


def fit_nnpu(pos: np.ndarray, unl: np.ndarray, prior: float, **options) -> Network:
    if not len(pos) or not len(unl) or not 0 < prior < 1:
        return Network(np.zeros(0), np.zeros(0), [], float(prior))
    return fit_network(pos, unl, prior, pu_risk, **options)


def best_bin(p: np.ndarray, u: np.ndarray, delta: float = 0.1, gamma: float = 0.01) -> float:
    """The ratio of the shares of unlabelled and of positives that score at least c, at the c where it and its confidence term are least."""
    cuts = np.unique(p)
    q_p = 1 - np.searchsorted(np.sort(p), cuts) / len(p)
    q_u = 1 - np.searchsorted(np.sort(u), cuts) / len(u)
    slack = (1 + gamma) * (np.sqrt(np.log(4 / delta) / (2 * len(u))) + np.sqrt(np.log(4 / delta) / (2 * len(p))))
    at = int(np.argmin((q_u + slack) / q_p))
    return float(q_u[at] / q_p[at])


def estimate_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """The share of positives among the unlabelled, from 0.01 to 0.99."""
    if len(pos) < 4 or len(unl) < 4:
        return 0.5
    found = []
    for own, other in ((0, 1), (1, 0)):
        net = fit_network(pos[own::2], unl[own::2], 0.5, two_class_risk)
        found.append(best_bin(net.score(pos[other::2]), net.score(unl[other::2])))
    return float(np.clip(np.mean(found), 0.01, 0.99))


def sampled_features(docs: DataFrame, ids: DataFrame, text: str = "text") -> np.ndarray:
    """Features of the documents of a bounded set of ids."""
    own = docs.join(F.broadcast(ids.select("doc_id").distinct()), "doc_id", "left_semi").select(text)

    def run(batch: pa.RecordBatch) -> dict:
        return {"f": list(feature_rows(batch.column(0).cast(pa.binary()).to_pylist()).astype("<f8").tolist())}

    rows = map_arrow(own, run, "f array<double>").collect()
    return np.array([r["f"] for r in rows], dtype=np.float64).reshape(-1, len(NAMES))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held: int = 0, most: int = MOST, unlabelled: int = UNLABELLED, prior: float | None = None) -> Network:
    """labels: (doc_id, label). Neither labels nor texts of the held-out fold are read. The prior is estimated unless it is given."""
    docs = docs.select("doc_id", "text")
    open_ = F.col("doc_id").isNotNull() & (fold("doc_id", folds) != held)
    known = labels.select("doc_id", col(label).alias("y")).filter(open_).groupBy("doc_id").agg(F.max("y").alias("y"))
    pos = sampled_features(docs, sample_ids(known.filter("y = 1").select("doc_id"), "doc_id", most))
    unl = sampled_features(docs, sample_ids(docs.select("doc_id").filter(open_), "doc_id", unlabelled))
    if not len(pos) or not len(unl):
        return Network(np.zeros(0), np.zeros(0), [], 0.5)
    return fit_nnpu(pos, unl, estimate_prior(pos, unl) if prior is None else prior)


def score(docs: DataFrame, net: Network, text: str = "text", column: str = "score") -> DataFrame:
    """docs with the probability of label 1."""
    docs = docs.drop(column)
    at = docs.columns.index(text)

    def run(batch: pa.RecordBatch) -> dict:
        own = feature_rows(batch.column(at).cast(pa.binary()).to_pylist())
        return dict(enumerate([*batch.columns, pa.array(net.score(own))]))

    return map_arrow(docs, run, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


def digests(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    docs = docs.select("doc_id", "text")
    out = score(docs, train(docs, labels)).withColumn("held_out", fold("doc_id", 5) == 0)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """docs without those that the classifier rejects."""
    (own,) = fresh(docs, "quality_score")
    return score(docs, train(docs, labels), column=own).filter(col(own) >= threshold).drop(own)
