"""Many searches at once: texts to phrase rows on the executors, and all searches over the corpus in two scans."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..errors import QueryError
from ..operators import retrieval
from ..operators.retrieval import PHRASES
from .querylang import parse

NAMES = ("query_id", "phrase_id", "role", "i", "k", "token", "prefix")
#: Rows that are scored at once, words whose phrases are remembered, and scores of all searches that are held at once.
ROWS, REMEMBERED, HELD = 512, 200_000, 2_000_000


def parsed(searches: DataFrame) -> DataFrame:
    """searches (query_id, text): a row for each token of each phrase. A text without search terms has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for q, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    phrases = parse(t)
                except QueryError:
                    continue
                rows += [(q, p, x.role, i, len(x.tokens), w, x.prefix and i == len(x.tokens) - 1) for p, x in enumerate(phrases) for i, w in enumerate(x.tokens)]
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in enumerate(kinds)], names=list(NAMES))

    return searches.select("query_id", "text").mapInArrow(run, PHRASES)


class Searches:
    """All phrases of all searches, each once, and which searches ask for it in which role."""

    def __init__(self, rows: list[tuple]):
        whole: dict[tuple, dict[int, tuple]] = defaultdict(dict)
        for q, p, role, i, _, token, prefix in rows:
            whole[q, p, role][i] = (token, prefix)
        self.queries = sorted({q for q, _, _ in whole})
        place = {q: n for n, q in enumerate(self.queries)}
        ids: dict[tuple, int] = {}
        entries = []
        for (q, p, role), parts in whole.items():
            tokens = tuple(parts[i][0] for i in sorted(parts))
            entries.append((ids.setdefault((tokens, parts[max(parts)][1]), len(ids)), place[q], role, p))
        self.exact = {t[0]: n for (t, prefix), n in ids.items() if len(t) == 1 and not prefix}
        self.begun = {t[0]: n for (t, prefix), n in ids.items() if len(t) == 1 and prefix}
        self.several: dict[int, dict[tuple, int]] = defaultdict(dict)
        self.open: dict[int, dict[tuple, list[tuple]]] = defaultdict(dict)  # by all but the last token: (how the last begins, phrase)
        for (t, prefix), n in ids.items():
            if len(t) > 1 and prefix:
                self.open[len(t)].setdefault(t[:-1], []).append((t[-1], n))
            elif len(t) > 1:
                self.several[len(t)][t] = n
        self.sizes = sorted({len(t) for t in self.begun})
        self.count = len(ids)
        entries.sort()
        self.phrase = np.array([e[0] for e in entries], np.int64)
        self.query = np.array([e[1] for e in entries], np.int64)
        self.role = np.array([("any", "all", "none").index(e[2]) for e in entries], np.int64)
        self.first = np.searchsorted(self.phrase, np.arange(self.count + 1))
        self.asked, self.loose = (np.bincount(self.query[self.role == r], minlength=len(self.queries)) for r in (1, 0))

    def of_word(self, word: str) -> tuple[int, ...]:
        """The phrases of one token that a word is."""
        found = [self.exact[word]] if word in self.exact else []
        for n in self.sizes:
            if n > len(word):
                break
            if (p := self.begun.get(word[:n])) is not None:
                found.append(p)
        return tuple(found)

    def counter(self):
        """A function of a text's words to (phrase: occurrences)."""
        known: dict[str, tuple[int, ...]] = {}

        def count(words: list[str]) -> dict[int, int]:
            out: dict[int, int] = {}
            for w, n in Counter(words).items():
                own = known.get(w)
                if own is None:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    own = known[w] = self.of_word(w)
                for p in own:
                    out[p] = out.get(p, 0) + n
            for k, wanted in self.several.items():
                for t in filter(wanted.__contains__, zip(*[words[i:] for i in range(k)], strict=False)):
                    p = wanted[t]
                    out[p] = out.get(p, 0) + 1
            for k, begins in self.open.items():
                for *head, last in zip(*[words[i:] for i in range(k)], strict=False):
                    for start, p in begins.get(tuple(head), ()):
                        if last.startswith(start):
                            out[p] = out.get(p, 0) + 1
            return out

        return count


def _words(text: Column) -> Column:
    """A text's tokens with single spaces between."""
    return F.trim(F.regexp_replace(retrieval.searchable(text), r"[^\p{L}\p{N}]+", " "))


def _chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[list[list]]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield [c.to_pylist() for c in b.slice(at, rows).columns]


def _rounded(score: float) -> float:
    """As Spark's round()."""
    return float(Decimal(repr(score)).quantize(Decimal(1).scaleb(-retrieval.ROUND), ROUND_HALF_UP))


def best_each(rows: DataFrame, key: str, fields: dict[str, Column], phrase_tokens: DataFrame, weights: dict[str, float], limit: int) -> DataFrame:
    """(query_id, key, score, rank): the best rows of each search, as indexed_search and top_each give them.

    The searches go to each task; a scan counts in how many rows each phrase is, another one scores each row for all searches and holds the best of each.
    Nothing of the corpus is shuffled but the best of each task. The driver's memory goes with the searches, not with the corpus.
    """
    spark = rows.sparkSession
    asked = [tuple(r) for r in phrase_tokens.collect()]
    kind, arrow_kind = rows.schema[key].dataType.simpleString(), to_arrow_type(rows.schema[key].dataType)
    shape = f"query_id bigint, `{key}` {kind}, score double"
    if not asked:
        return spark.createDataFrame([], shape + ", rank int")
    told = spark.sparkContext.broadcast(Searches(asked))
    texts = rows.select(key, *[_words(c).alias(f"__{n}") for n, c in enumerate(fields.values())])
    worth = [float(weights[c]) for c in fields]

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = told.value
        count = searches.counter()
        held, total, length = np.zeros(searches.count, np.int64), 0, 0
        for _, *columns in _chunks(batches, ROWS):
            for row in zip(*columns, strict=True):
                words = [t.split() for t in row]
                total, length = total + 1, length + sum(map(len, words))
                seen = set().union(*map(count, words))
                held[np.fromiter(seen, np.int64, len(seen))] += 1
        own = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *own.tolist()], pa.int64()), pa.array([total, length, *held[own].tolist()], pa.int64())], names=["phrase", "n"])

    found = {r["phrase"]: r["n"] for r in texts.mapInArrow(met, "phrase bigint, n bigint").groupBy("phrase").agg(F.sum("n").alias("n")).collect()}
    total = found.get(-2, 0)
    mean = found.get(-1, 0) / total if total and found[-1] else 1.0
    n = np.array([found.get(p, 0) for p in range(told.value.count)], np.float64)
    idf = spark.sparkContext.broadcast(np.log1p((total - n + 0.5) / (n + 0.5)))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches, rare = told.value, idf.value
        count, many = searches.counter(), len(searches.queries)
        k1, b = retrieval.K1, retrieval.B
        strict = bool((searches.role > 0).any())
        best: list[list[tuple]] = [[] for _ in range(many)]
        least = np.full(many, -np.inf)  # what a row must have to be among a search's best

        def score(row: tuple) -> np.ndarray:
            words = [t.split() for t in row]
            d = sum(map(len, words))
            tf = np.zeros(searches.count)
            hit = []
            for w, x in zip(worth, map(count, words), strict=True):
                own, f = np.fromiter(x.keys(), np.int64, len(x)), np.fromiter(x.values(), np.float64, len(x))
                tf[own] += w * (f * (k1 + 1) / (f + k1 * (1 - b + b * d / mean)))
                hit.append(own)
            hits = np.unique(np.concatenate(hit))
            sizes = searches.first[hits + 1] - searches.first[hits]
            at = np.repeat(searches.first[hits] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            value = np.repeat(rare[hits] * tf[hits], sizes)
            query = searches.query[at]
            if not strict:
                got = np.bincount(query, minlength=many) > 0
                return np.where(got, np.bincount(query, value, many), -np.inf)
            role = searches.role[at]
            any_, all_, none = (np.bincount(query[role == r], minlength=many) for r in range(3))
            fit = (none == 0) & (all_ == searches.asked) & ((searches.loose == 0) | (any_ > 0)) & (any_ + all_ > 0)
            return np.where(fit, np.bincount(query[role < 2], value[role < 2], many), -np.inf)

        for keys, *columns in _chunks(batches, max(1, min(ROWS, HELD // many))):
            points = np.stack([score(row) for row in zip(*columns, strict=True)])
            for q in np.flatnonzero((points >= least - 1e-5).any(axis=0) & (points.max(axis=0) > -np.inf)).tolist():
                column = points[:, q]
                near = np.flatnonzero((column >= least[q] - 1e-5) & (column > -np.inf))
                exact = {x: _rounded(x) for x in set(column[near].tolist())}
                new = [(-exact[column[r]], keys[r] is not None, keys[r]) for r in near.tolist()]
                best[q] = sorted(best[q] + new)[:limit]
                if len(best[q]) == limit:
                    least[q] = -best[q][-1][0]
        out = [(searches.queries[q], x[2], -x[0]) for q in range(many) for x in best[q]]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], arrow_kind), pa.array([r[2] for r in out], pa.float64())], names=["query_id", key, "score"])

    return retrieval.top_each(texts.mapInArrow(scored, shape), "query_id", key, limit)
