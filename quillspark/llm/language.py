r"""Language of words and texts by a linear-chain conditional random field.

A text is a sequence of lines, a line a chain of words, however long. The label of a word
is a language. Emissions sum learned weights of the word's affixes and character n-grams (n-grams with marks at the ends
of the word are its affixes) and, for words frequent in the learning sample, of the word itself (the lexicon); learned
transitions tie neighbouring words. Forward-backward gives each word's posterior; a chain of more than BLOCK words is passed in blocks, over which
the weights of all ways through are carried, so that posteriors are those of the whole chain. The text's language has the
largest sum of posteriors, its share of the words is the score.

Learning takes text and language of about `most` documents of each language of the learning folds (those of the smallest
hashes of the id; with more than LANGUAGES languages fewer of each, so that the sample keeps its size), and of each at most `each` pieces, spread over the whole text. Sequences are made of such pieces, so that
transitions between languages are seen.

Cases: a null text, or one without a letter, is `und` with score 0; without any learning rows every text is; repeated rows get equal
results; ties go to the first language in alphabetical order; other columns stay, but for those that are added.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, map_arrow

MOST, LANGUAGES = 1_500, 40
BLOCK = 256
MEMO = 150_000
BUCKETS = 1 << 16
TOKEN = re.compile(r"[^\W\d_]+|\n")


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams (2 to 4) of the marked words: bucket numbers, and how many each word has. Long words' n-grams all count."""
    marked = np.frombuffer("".join(["\x02" + w + "\x03" for w in words]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    lengths = np.fromiter((len(w) + 2 for w in words), dtype=np.int64, count=len(words))
    of = np.repeat(np.arange(len(words)), lengths)
    own, at = [], []
    for n in (2, 3, 4):
        if len(marked) < n:
            continue
        h = np.full(len(marked) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            h = (h * np.uint64(0x100000001B3)) ^ (marked[k : len(marked) - n + 1 + k] * np.uint64(0x9E3779B97F4A7C15))
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        inside = of[: len(h)] == of[n - 1 :]
        own.append(((h >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int64)[inside])
        at.append(of[: len(h)][inside])
    own_, at_ = np.concatenate(own), np.concatenate(at)
    order = np.argsort(at_, kind="stable")
    return own_[order], np.bincount(at_, minlength=len(words))


@dataclass
class Field:
    langs: list[str]
    weights: np.ndarray  # BUCKETS x languages
    lexicon: dict[str, np.ndarray]
    start: np.ndarray
    moves: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros((0, len(self.langs)))
        own, counts = word_features(words)
        out = np.add.reduceat(self.weights[own], np.concatenate([[0], np.cumsum(counts)[:-1]]), axis=0).astype(np.float64)
        for i, w in enumerate(words):
            known = self.lexicon.get(w)
            if known is not None:
                out[i] += known
        return out


def _in_step(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of chains by falling length, and how many go on at each step."""
    order = np.argsort(-size, kind="stable")
    steps = int(size[order[0]]) if len(size) else 0
    return order, np.searchsorted(-size[order], -np.arange(steps), side="left")


def _ways(p: np.ndarray, starts: np.ndarray, lengths: np.ndarray, m: np.ndarray) -> np.ndarray:
    """For each block the weights (up to a factor) of all ways from a label of its first word to one of its last."""
    k = p.shape[1]
    order, active = _in_step(lengths)
    at, out = starts[order], np.tile(np.eye(k), (len(starts), 1, 1))
    for t, n in enumerate(active):
        step = (out[:n] @ m if t else out[:n]) * p[at[:n] + t][:, None, :]
        out[:n] = step / step.sum(axis=(1, 2), keepdims=True)
    back = np.empty_like(out)
    back[order] = out
    return back


def forward_backward(e: np.ndarray, starts: np.ndarray, lengths: np.ndarray, start: np.ndarray, moves: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Posteriors of all rows. e: emissions (log) of the sequences' words, one after another; all blocks of all chains advance together."""
    p = np.exp(e - e.max(axis=1, keepdims=True)) + 1e-30
    m, s = np.exp(moves), np.exp(start - start.max())
    parts = -(-lengths // block)
    chain = np.repeat(np.arange(len(starts)), parts)
    nth = np.arange(len(chain)) - np.repeat(np.cumsum(parts) - parts, parts)
    at, size = starts[chain] + nth * block, np.minimum(block, lengths[chain] - nth * block)
    enter, leave = np.tile(s, (len(at), 1)), np.ones((len(at), p.shape[1]))
    inner = np.flatnonzero(parts[chain] > 1)
    if len(inner):  # what comes into each block from the left and from the right
        ways = _ways(p, at[inner], size[inner], m)
        first, last = nth[inner] == 0, nth[inner] == parts[chain[inner]] - 1
        for i, b in enumerate(inner.tolist()):
            if not first[i]:
                on = enter[b - 1] @ ways[i - 1] @ m
                enter[b] = on / on.sum()
        for i in range(len(inner) - 1, -1, -1):
            if not last[i]:
                on = m @ (ways[i + 1] @ leave[inner[i] + 1])
                leave[inner[i]] = on / on.sum()
    order, active = _in_step(size)
    at, enter, leave = at[order], enter[order], leave[order]
    alpha = np.empty_like(p)
    a = enter
    for t, k in enumerate(active):
        rows = at[:k] + t
        a = (a[:k] @ m if t else a[:k]) * p[rows]
        a /= a.sum(axis=1, keepdims=True)
        alpha[rows] = a
    b = np.ones((0, p.shape[1]))
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        rows = at[:k] + t
        fresh = leave[:k].copy()
        on = (b * p[rows[: len(b)] + 1]) @ m.T
        fresh[: len(b)] = on / on.sum(axis=1, keepdims=True)
        b = fresh
        alpha[rows] *= b
    return alpha / alpha.sum(axis=1, keepdims=True)


def uniform_pass(e: np.ndarray, start: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of n chains of t words (e: n x t x languages) and the expected number of each transition."""
    n, t, k = e.shape
    p, m = np.exp(e - e.max(axis=2, keepdims=True)) + 1e-30, np.exp(moves)
    alpha, post, pairs = np.empty_like(p), np.empty_like(p), np.zeros((k, k))
    a = np.tile(np.exp(start - start.max()), (n, 1))
    for i in range(t):
        a = (a @ m if i else a) * p[:, i]
        a /= a.sum(axis=1, keepdims=True)
        alpha[:, i] = a
    b = np.ones((n, k))
    post[:, t - 1] = alpha[:, t - 1]
    for i in range(t - 2, -1, -1):
        ahead = b * p[:, i + 1]
        joint = alpha[:, i, :, None] * m[None] * ahead[:, None, :]
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        pairs += joint.sum(axis=0)
        post[:, i] = joint.sum(axis=2)
        b = ahead @ m.T
        b /= b.sum(axis=1, keepdims=True)
    return post, pairs


def fit(pieces: list[list[str]], langs: list[str], rounds: int = 40, lexicon: int = 2_000, most: int = 24_000, seed: int = 5) -> Field:
    """pieces: equally many consecutive words each, with their language. Four pieces make a sequence: in half of the
    sequences all of one language, as in most texts, in the others of any."""
    names = sorted(set(langs))
    k = len(names)
    field = Field(names, np.zeros((BUCKETS, k)), {}, np.zeros(k), np.zeros((k, k)))
    if not pieces:
        return field
    rng = np.random.default_rng(seed)
    tags = np.array([names.index(x) for x in langs])
    chosen = np.concatenate([rng.permutation(np.flatnonzero(tags == c))[: max(8, most // k)] for c in range(k)])  # a rare language is learned as well
    chosen = rng.permutation(np.resize(chosen, -(-len(chosen) // 8) * 8))
    half = len(chosen) // 2
    chosen[:half] = chosen[:half][np.argsort(tags[chosen[:half]], kind="stable")]
    spelled = sorted({w for i in chosen for w in pieces[i]})
    number = {w: i for i, w in enumerate(spelled)}
    t = 4 * len(pieces[0])
    words = np.array([[number[w] for w in pieces[i]] for i in chosen]).reshape(-1, t)
    y = np.repeat(tags[chosen], len(pieces[0])).reshape(-1, t)
    truth = np.eye(k)[y]
    pair_truth = np.zeros((k, k))
    np.add.at(pair_truth, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
    counts = np.bincount(words.ravel(), minlength=len(spelled))
    common = np.argsort(-counts, kind="stable")[:lexicon]
    common = common[counts[common] >= 3]
    own, sizes = word_features(spelled)
    ends, of = np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.repeat(np.arange(len(spelled)), sizes)
    known = np.zeros((len(common), k))
    parameters = (field.weights, known, field.start, field.moves)
    sums = [np.full_like(x, 1e-3) for x in parameters]
    for _ in range(rounds):
        emit = np.add.reduceat(field.weights[own], ends, axis=0)
        emit[common] += known
        post, pairs = uniform_pass(emit[words], field.start, field.moves)
        gap = truth - post
        by_word = np.stack([np.bincount(words.ravel(), gap[:, :, c].ravel(), len(spelled)) for c in range(k)], axis=1)
        grads = (np.stack([np.bincount(own, by_word[of, c], BUCKETS) for c in range(k)], axis=1) - 1e-2 * field.weights, by_word[common] - 1e-2 * known, gap[:, 0].sum(axis=0), pair_truth - pairs)
        for x, s, g, rate in zip(parameters, sums, grads, (0.1, 0.1, 0.1, 0.2), strict=True):
            s += g * g
            x += rate * g / np.sqrt(s)
    field.weights = field.weights.astype(np.float32)
    field.lexicon = {spelled[i]: known[j] for j, i in enumerate(common)}
    return field


class Labeller:
    """Labels batches of texts; keeps the emissions of the words it has seen."""

    def __init__(self, field: Field):
        self.field = field
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {"\n": -1}
        self.table = np.zeros((0, len(self.field.langs)))

    def word_posteriors(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The text that each word is in, and its posteriors."""
        if len(self.ids) > MEMO:
            self.clear()
        ids, known, fresh = [], self.ids, []
        sizes = np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            tokens = TOKEN.findall((text or "").lower())
            tokens.append("\n")
            for w in tokens:
                if w not in known:
                    if any(map(str.isalpha, w)):
                        known[w] = len(self.table) + len(fresh)
                        fresh.append(w)
                    else:
                        known[w] = -2
            ids.extend(map(known.__getitem__, tokens))
            sizes[i] = len(tokens)
        if fresh:
            self.table = np.concatenate([self.table, self.field.emissions(fresh)])
        flat, doc = np.array(ids, dtype=np.int64), np.repeat(np.arange(len(texts)), sizes)
        keep = flat != -2
        flat, doc = flat[keep], doc[keep]
        word = flat >= 0
        line = np.cumsum(~word)[word]
        ids_, doc = flat[word], doc[word]
        if not len(ids_):
            return doc, np.zeros((0, len(self.field.langs)))
        starts = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
        lengths = np.diff(np.concatenate([starts, [len(line)]]))
        return doc, forward_backward(self.table[ids_], starts, lengths, self.field.start, self.field.moves)

    def label(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.field.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        doc, post = self.word_posteriors(texts)
        mass = np.stack([np.bincount(doc, post[:, c], len(texts)) for c in range(post.shape[1])], axis=1).round(9)
        total = mass.sum(axis=1)
        best = mass.argmax(axis=1)
        share = np.divide(mass[np.arange(len(texts)), best], total, out=np.zeros(len(texts)), where=total > 0)
        return [self.field.langs[b] if t > 0 else "und" for b, t in zip(best, total, strict=True)], np.clip(share, 0, 1)


def cut_pieces(text: str, size: int, most: int) -> list[str]:
    """At most `most` pieces of consecutive words, spread evenly over the whole text."""
    words = [w for w in TOKEN.findall(text.lower()) if w != "\n" and any(map(str.isalpha, w))]
    begins = range(0, len(words) - size + 1, size)
    if len(words) < size:
        return [" ".join((words * size)[:size])] if words else []
    return [" ".join(words[begins[i * len(begins) // min(most, len(begins))] :][:size]) for i in range(min(most, len(begins)))]


def train(docs: DataFrame, folds: int = 4, held: int = 2, most: int = MOST, size: int = 8, each: int = 40) -> Field:
    """docs: doc_id, text, lang. The held-out fold isn't read. Each language gives its own bounded sample of documents."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != held))
    count = known.select(F.count_distinct("lang")).first()[0]
    most = max(1, most * LANGUAGES // max(LANGUAGES, count))
    order = Window.partitionBy("lang", "part").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = known.select("doc_id", "lang", F.pmod(F.xxhash64("doc_id"), F.lit(64)).alias("part"))
    # of each language, the documents of the smallest hashes: first within parts of it, so no task sorts a whole language
    ids = ids.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= max(1, most // 64)).select("doc_id", "lang").distinct()

    def run(batch: pa.RecordBatch) -> dict:
        return {"pieces": [cut_pieces(t or "", size, each) for t in batch.column(0).to_pylist()], "lang": batch.column(1)}

    rows = map_arrow(known.join(F.broadcast(ids), ["doc_id", "lang"], "left_semi").select("text", "lang"), run, "pieces array<string>, lang string").collect()
    pairs = sorted((p, r["lang"]) for r in rows for p in r["pieces"])
    return fit([p.split(" ") for p, _ in pairs], [x for _, x in pairs])


#: The broadcast in use in this worker and its labeller, which keeps words from task to task.
_HELD: dict = {}


def labeller(key: str, held) -> Labeller:
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = Labeller(held.value)
    return _HELD[key]


def predict(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """docs with lang_pred and score."""
    docs = docs.drop("lang_pred", "score")
    at = docs.columns.index(text)
    held, key = docs.sparkSession.sparkContext.broadcast(field), uuid.uuid4().hex

    def run(batch: pa.RecordBatch) -> dict:
        names, scores = labeller(key, held).label(batch.column(at).to_pylist())
        return dict(enumerate([*batch.columns, names, scores]))

    return map_arrow(docs, run, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def digests(docs: DataFrame) -> DataFrame:
    field = train(docs.select("doc_id", "text", "lang"))
    out = predict(docs.select("doc_id", "text"), field).withColumn("held_out", fold("doc_id", 4) == 2)
    return out.select("doc_id", "held_out", "lang_pred", "score")
