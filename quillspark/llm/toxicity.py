r"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a whole text: densities of a lexicon (a fixed list of insults, and words and word beginnings that labelled texts
of the learning folds show to be toxic), how near its hits stand to the second person, capitals, punctuation and
obfuscation (letters written as digits or signs, or set apart). The learning folds are divided: the lexicon comes from two
of them, the trees from the third and the calibration from the fourth, so none is fitted to what another has seen.

Fitting takes at most `most` labelled texts (those of the smallest hashes of the id); scoring reads all texts.

Cases: null and empty texts get the score of a text without hits; repeated rows get equal scores; without labels of both kinds the
score is the share of label 1 (0 without labels); a doc_id with several labels is toxic if one says so; other columns stay, but for the one that is added.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, fold, map_arrow, sample_ids, short_batches

MOST = 20_000
LEXICON_MOST = 4_000
PREFIXES = range(3, 9)

# Insults and words of the second person.
INSULTS = frozenset("idiot idiots stupid moron moronic loser losers scum trash worthless pathetic disgusting clown dumb fool imbecile garbage scumbag jerk vermin filth filthy hate dummkopf abschaum versager connard imbécile ordure crétin estúpido basura escoria imbécil".split())
SECOND = frozenset("you your yours yourself du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos usted ustedes tú ti tus vosotros".split())

WORD = re.compile(r"[^\W\d_]+")
ODD = re.compile(r"(?<![^\W_])(?=[\w@$!*.\-]*[\d@$!*.\-])(?=[\w@$!*.\-]*[^\W\d_])[^\W_](?:[\w@$!*]|[.\-](?=\w[.\-]|\w(?!\w)))+")
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "*": None, ".": None, "-": None, "_": None})
NAMES = ["seed_density", "lexicon_density", "lexicon_hits", "lexicon_kinds", "weight_top", "weight_density", "weight_sum", "strong_kinds", "weight_excess", "near_second", "second_density", "capitals", "caps_words", "exclaims", "signs", "odd_rate", "odd_hits", "log_words"]


def beginnings(word: str) -> list[str]:
    """The word, and its beginnings with a mark."""
    return [word, *("^" + word[:k] for k in PREFIXES if len(word) > k)]


class Matcher:
    """The weight of a word in the lexicon: that of its strongest entry; a memo keeps the words seen."""

    def __init__(self, weights: dict[str, float]):
        self.weights, self.memo = weights, {}

    def __call__(self, word: str) -> float:
        w = self.memo.get(word)
        if w is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            w = self.memo[word] = max((self.weights.get(x, 0.0) for x in beginnings(word)), default=0.0)
        return w


def features(text: str, weight: Matcher) -> list[float]:
    low = text.lower()
    words = WORD.findall(low)
    m = max(1, len(words))
    kinds = set(words)
    bad = {w: x for w in kinds if (x := weight(w)) > 0}
    seeds, n_hits, near, total = 0, 0, 0, 0.0
    second = 0
    if bad or kinds & SECOND:
        at_bad = [i for i, w in enumerate(words) if w in bad]
        at_second = np.array([i for i, w in enumerate(words) if w in SECOND], dtype=np.int64)
        second, n_hits = len(at_second), len(at_bad)
        seeds = sum(words[i] in INSULTS for i in at_bad)
        total = sum(bad[words[i]] for i in at_bad)
        if n_hits and second:
            k = np.searchsorted(at_second, at_bad)
            left = np.abs(at_second[np.clip(k - 1, 0, second - 1)] - at_bad)
            right = np.abs(at_second[np.clip(k, 0, second - 1)] - at_bad)
            near = int((np.minimum(left, right) <= 4).sum())
    odd = ODD.findall(text)
    odd_hits = sum(weight(x.lower().translate(LEET)) > 0 for x in odd)
    n = max(1, len(text))
    upper = sum(map(str.isupper, text.split()))
    return [seeds / m, n_hits / m, float(np.log1p(n_hits)), float(len(bad)), max(bad.values(), default=0.0), total / m, sum(bad.values()), float(sum(x > 3 for x in bad.values())), sum(bad.values()) / m**0.5, near / m, second / m, upper / m, upper / m * (upper > 1), text.count("!") / n, (text.count("*") + text.count("#") + text.count("$") + text.count("%") + text.count("&")) / n, len(odd) / m, float(np.log1p(odd_hits)), float(np.log1p(m))]


def feature_rows(texts: list[str | None], weight: Matcher) -> np.ndarray:
    return np.array([features(t or "", weight) for t in texts], dtype=np.float64).reshape(-1, len(NAMES))


@dataclass
class Trees:
    """Boosted trees of a fixed depth: at each level every node asks a feature and a threshold."""

    base: float
    depth: int
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - (len(leaf) - 1)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 4.0) -> Trees:
    base = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    model = Trees(base, depth)
    cuts = []
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        cuts.append((values[:-1] + values[1:]) / 2 if len(values) <= bins else np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1])))
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    margin, inner = np.full(len(x), base), 2**depth - 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        feature, cut, node = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf), np.zeros(len(x), dtype=np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.zeros(width)
            at_bin = np.zeros(width, dtype=np.int64)
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                key = (node - first) * (len(c) + 1) + binned[:, j]
                gs = np.bincount(key, g, width * (len(c) + 1)).reshape(width, -1)
                hs = np.bincount(key, h, width * (len(c) + 1)).reshape(width, -1)
                gl, hl = gs.cumsum(axis=1)[:, :-1], hs.cumsum(axis=1)[:, :-1]
                gt, ht = gs.sum(axis=1, keepdims=True), hs.sum(axis=1, keepdims=True)
                gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                gain[(hl < 0.02 * least) | (ht - hl < 0.02 * least)] = 0
                k = gain.argmax(axis=1)
                got = gain[np.arange(width), k]
                better = got > best + 1e-9
                best[better], at_bin[better] = got[better], k[better]
                feature[first : first + width][better], cut[first : first + width][better] = j, c[k[better]]
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
        leaf_of = node - inner
        leaf = rate * np.bincount(leaf_of, g, inner + 1) / (np.bincount(leaf_of, h, inner + 1) + 1)
        margin += leaf[leaf_of]
        model.trees.append((feature, cut, leaf))
    return model


def fit_isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: margins and the probabilities there, to interpolate between. One made-up case of either kind at the ends keeps scores off 0 and 1."""
    order = np.argsort(margin, kind="stable")
    xs = np.concatenate([[margin.min(initial=0) - 1e-6], margin[order], [margin.max(initial=0) + 1e-6]])
    ys = np.concatenate([[0.0], y[order], [1.0]])
    blocks: list[list[float]] = []  # mean, weight, sum of margins
    for a, b in zip(xs, ys, strict=True):
        blocks.append([b, 1.0, a])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, w, s = blocks.pop()
            blocks[-1] = [(blocks[-1][0] * blocks[-1][1] + m * w) / (blocks[-1][1] + w), blocks[-1][1] + w, blocks[-1][2] + s]
    return np.array([s / w for _, w, s in blocks]), np.array([m for m, _, _ in blocks])


@dataclass
class Model:
    weights: dict[str, float]
    trees: Trees | None
    steps: tuple[np.ndarray, np.ndarray]
    rate: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.rate)
        return np.clip(np.interp(self.trees.margin(x), *self.steps), 0, 1)


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """rows (text, y): words and beginnings much more frequent in toxic documents than in others; at most LEXICON_MOST."""
    totals = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return {}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[y].update({x for w in set(WORD.findall((t or "").lower())) for x in beginnings(w)})
            if len(seen[0]) + len(seen[1]) > 300_000:
                yield from given(seen)
        yield from given(seen)

    def given(seen):
        every = list(set(seen[0]) | set(seen[1]))
        yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), pa.array([seen[1][x] for x in every], pa.int64()), pa.array([seen[0][x] for x in every], pa.int64())], names=["w", "a", "b"])
        seen[0].clear()
        seen[1].clear()

    short_batches(rows.sparkSession)
    least = max(3, 0.02 * toxic)
    a, b = F.col("a"), F.col("b")
    odds = F.log((a + 0.5) / (toxic + 1 - a + 0.5)) - F.log((b + 0.5) / (clean + 1 - b + 0.5))
    error = F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    found = rows.select("text", "y").mapInArrow(count, "w string, a long, b long").groupBy("w").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    sure = (F.col("odds") > 3) & (F.col("odds") / error > 1.9) | (F.col("odds") > 1.2) & (F.col("odds") / error > 3.5)
    found = found.filter(a >= least).withColumn("odds", odds).filter(sure)
    return {r["w"]: round(r["odds"], 6) for r in found.orderBy(F.desc("odds"), "w").limit(LEXICON_MOST).collect()}


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held: int = 0, most: int = MOST) -> Model:
    """labels: (doc_id, label). Neither labels nor texts of the held-out fold are read."""
    known = labels.select("doc_id", col(label).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != held))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    rate = known.agg(F.avg("y")).first()[0]
    if rate is None or not 0 < rate < 1:
        return Model({}, None, (np.zeros(1), np.zeros(1)), float(rate or 0))
    picked = sample_ids(known, "doc_id", most)
    part = F.pmod(fold("doc_id", folds) - held, F.lit(folds))
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "y", part.alias("part"))
    weights = learn_lexicon(rows.filter("part <= 2"))
    for w in INSULTS:
        weights[w] = max(weights.get(w, 0.0), 4.0)

    def run(batch: pa.RecordBatch) -> dict:
        return {"f": feature_rows(batch.column(0).to_pylist(), matcher(tuple(sorted(weights.items())))).tolist(), "y": batch.column(1), "part": batch.column(2)}

    got = map_arrow(rows.filter("part > 2"), run, "f array<double>, y int, part long").collect()
    x = np.array([r["f"] for r in got], dtype=np.float64).reshape(-1, len(NAMES))
    y, fitting = np.array([r["y"] for r in got], dtype=np.float64), np.array([r["part"] == 3 for r in got], dtype=bool)
    if not 0 < y[fitting].sum() < fitting.sum():
        return Model(weights, None, (np.zeros(1), np.zeros(1)), float(rate))
    trees = fit_trees(x[fitting], y[fitting])
    return Model(weights, trees, fit_isotonic(trees.margin(x[~fitting]), y[~fitting]), float(rate))


@lru_cache(maxsize=2)
def matcher(weights: tuple) -> Matcher:
    return Matcher(dict(weights))


def score(docs: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """docs with the probability that they are toxic."""
    docs = docs.drop(column)
    at, weights = docs.columns.index(text), tuple(sorted(model.weights.items()))

    def run(batch: pa.RecordBatch) -> dict:
        return dict(enumerate([*batch.columns, pa.array(model.score(feature_rows(batch.column(at).to_pylist(), matcher(weights))))]))

    return map_arrow(docs, run, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


def digests(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    docs = docs.select("doc_id", "text")
    out = score(docs, train(docs, labels)).withColumn("held_out", fold("doc_id", 5) == 0)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
