"""Near copies: ball hashing of the sets' SimHash fingerprints, an exact check of similarity, and an exact way for pairs that no ball reaches.

Texts link where the Jaccard similarity of their sets of word shingles is at least a threshold. Words are those of `simhash`. Equal sets collapse first.
Each set has the SimHash fingerprint of its shingles; distinct fingerprints meet by ball hashing (`simhash.links`, passed as `near`), the sets of one fingerprint
in a bucket, and all these candidates are verified.

Fingerprints of similar sets may differ in more bits than a ball has, so the other pairs are found as well. Two sets that similar share a shingle among the first
`size - ceil(threshold x size) + 1` of each, in any order that holds for all sets; the order here puts shingles that a sample of the sets
repeats last, so those of common passages are seldom met (the sample affects speed only, no pair is lost). Sets that meet at such a
shingle are verified on their whole sets in two steps, so that a large group costs no square: with the candidates of the balls each with its neighbours by size and with
the leaders of a tree of blocks (at most BLOCK sets each), then only pairs that the first step's links left in different components. In both, sizes, places and sketches
leave out pairs that can't reach the threshold before any pair leaves its task, and wider sketches of either set leave out most of the others. Sets of the pairs that remain are made
again from their texts, where they are: a bitmap of ids tells which texts these are, so no text is dealt out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Marks, map_arrow, stored, whole_buckets
from .components import components

WORDS, SIMILARITY = 5, 0.8
#: Sets of the sample, and the most shingles that are put last.
SAMPLE, LAST = 8_000, 100_000
#: Sets that a leader has, and rows of a bucket that are compared at a time.
BLOCK, STEP = 64, 1024
#: Hashes of a set whose bits are summed at a time.
FEW = 1 << 14
#: Words kept with their hashes.
MEMO = 300_000
#: Words of 64 bits of a sketch.
SKETCH = 4
BITS = tuple(f"s{i}" for i in range(SKETCH))


class _Words(dict):
    """A word's hash; beyond MEMO words it starts anew."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word, 42)
        return out


_WORDS = _Words()


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """The distinct hashes, sorted; none without words. A shingle's hash is mixed from those of its words in their order."""
    w = text.lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(_WORDS.__getitem__, w), dtype=np.uint64, count=len(w))
    long = min(words, len(w))
    out = np.full(len(w) - long + 1, long, dtype=np.uint64)
    for k in range(long):
        out = (out ^ own[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out ^ (out >> np.uint64(32)))


def fingerprint(own: np.ndarray) -> int:
    """SimHash of a set, unsigned: the bits that over half of its hashes have; zero without any."""
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(own), FEW):
        total += np.unpackbits(own[at : at + FEW].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(own), bitorder="little").tobytes(), "little")


def _id(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes(), 42)


def set_ids(docs: DataFrame, text: str = "text", words: int = WORDS, name: str = "set_id", sets: str | None = None) -> DataFrame:
    """docs with the id of their set, the same for equal sets; with `sets` also the set itself."""
    docs = docs.drop(name)
    at = docs.columns.index(text)

    def run(batch: pa.RecordBatch) -> dict:
        own = [shingles(x or b"", words) for x in batch.column(at).cast(pa.binary()).to_pylist()]
        out = [*batch.columns, pa.array(np.array([_id(x) for x in own], dtype=np.uint64).view(np.int64))]
        if sets:
            ends = np.cumsum([0, *map(len, own)], dtype=np.int32)
            out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *own]).view(np.int64))))
        return dict(enumerate(out))

    added = [T.StructField(name, T.LongType()), *([T.StructField(sets, T.ArrayType(T.LongType()))] if sets else [])]
    return map_arrow(docs, run, T.StructType([*docs.schema.fields, *added]))


def _repeated(rows: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a sample of the texts repeats, sorted, and how often."""
    step = max(1, -(-rows.count() // SAMPLE))
    some = set_ids(rows.filter(F.pmod(F.xxhash64("text"), F.lit(step)) == 0), words=words, sets="own").select("set_id", "own").dropDuplicates(["set_id"])
    often = some.select(F.explode("own").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    found = often.orderBy(F.desc("n"), "t").limit(LAST).toPandas().sort_values("t")
    return found["t"].to_numpy(np.int64), found["n"].to_numpy(np.int64)


def sketch(own: np.ndarray, bits: int = 64 * SKETCH) -> np.ndarray:
    """Parities of the counts of the hashes by their value modulo the bits: two sets differ in at least as many hashes as their sketches in bits."""
    odd = (np.bincount((own % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def wide(own: np.ndarray) -> np.ndarray:
    """The sketch in as many bits as there are hashes, a power of two, and those of `sketch` at least; folded, it is the one of fewer bits."""
    return sketch(own, max(64 * SKETCH, 1 << max(0, len(own) - 1).bit_length()))


def _folded(of: str, size: str) -> str:
    """SQL: a wide sketch as it is with fewer bits."""
    return f"if(size({of}) = {size}, {of}, transform(sequence(1, {size}), i -> aggregate(sequence(i, size({of}), {size}), 0L, (s, j) -> s ^ element_at({of}, j))))"


def _firsts(rows: DataFrame, words: int, threshold: float) -> DataFrame:
    """(doc_id, set_id, size, fingerprint, s0 to s3, wide, first): each row's set by its id, its fingerprint, its sketches, and its first shingles."""
    last, times = _repeated(rows, words)

    def run(batch: pa.RecordBatch) -> dict:
        ids, sizes, prints, bits, wides, first = [], [], [], [], [], []
        for x in batch.column(1).cast(pa.binary()).to_pylist():
            own = shingles(x or b"", words)
            ids.append(_id(own))
            sizes.append(len(own))
            prints.append(fingerprint(own))
            bits.append(sketch(own))
            wides.append(wide(own))
            own = own.view(np.int64)
            if len(last) and len(own):
                i = np.minimum(np.searchsorted(last, own), len(last) - 1)
                own = own[np.lexsort((own, np.where(last[i] == own, times[i], 0)))]
            else:
                own = np.sort(own)
            first.append(own[: len(own) - _ceil(threshold * len(own)) + 1])
        lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)], dtype=np.int32)), pa.array(np.concatenate([np.zeros(0, np.int64), *x]))) for x in (wides, first)]
        columns = np.array(bits, dtype=np.int64).reshape(-1, SKETCH).T
        return dict(enumerate([batch.column(0), pa.array(np.array(ids, dtype=np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(np.array(prints, dtype=np.uint64).view(np.int64)), *(pa.array(np.ascontiguousarray(c)) for c in columns), *lists]))

    added = [T.StructField("set_id", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("fingerprint", T.LongType()), *(T.StructField(c, T.LongType()) for c in BITS), *(T.StructField(c, T.ArrayType(T.LongType())) for c in ("wide", "first"))]
    return map_arrow(rows.select("doc_id", "text"), run, T.StructType([rows.schema["doc_id"], *added]))


def _ceil(x: float) -> int:
    return int(np.ceil(x - 1e-9))


def _by_bucket(rows: DataFrame, fn: Callable[[list[np.ndarray]], Iterator[list[np.ndarray]]], schema: str) -> DataFrame:
    """What fn makes of the columns of all whole buckets of t, in order of size; a bucket of one row is left out."""
    return whole_buckets(rows.repartition("t").sortWithinPartitions("t", "size", "set_id"), fn, schema)


class Bucket:
    """Rows of whole buckets, in order of size within each: which pairs of them sizes, places and sketches allow."""

    def __init__(self, columns: list[np.ndarray], threshold: float):
        self.t, self.ids, self.size, self.place, *bits = columns[: 4 + SKETCH]
        self.bits = np.stack(bits, axis=1).view(np.uint64)
        self.threshold = threshold

    def possible(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        total = self.size[i] + self.size[j]
        least = self.threshold * total - 1e-6  # (1 + threshold) x what they must share
        most = np.minimum(self.place[i], self.place[j]) + np.minimum(self.size[i] - self.place[i], self.size[j] - self.place[j])
        apart = np.bitwise_count(self.bits[i] ^ self.bits[j]).sum(axis=-1)
        return (most * (1 + self.threshold) >= least) & ((total - apart) * (1 + self.threshold) >= 2 * least)

    def pairs(self, i: np.ndarray, j: np.ndarray) -> list[np.ndarray]:
        u, v = self.ids[i], self.ids[j]
        return [np.minimum(u, v), np.maximum(u, v)]

    def cuts(self) -> np.ndarray:
        return np.flatnonzero(np.concatenate([[True], self.t[1:] != self.t[:-1], [True]])) if len(self.t) else np.zeros(1, np.int64)


def _nearest(threshold: float) -> Callable[[list[np.ndarray]], Iterator[list[np.ndarray]]]:
    """Pairs of neighbours, and of sets with the leaders of their blocks, blocks of leaders included."""

    def run(c: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
        b = Bucket(c, threshold)
        begin = np.repeat(b.cuts()[:-1], np.diff(b.cuts()))  # each row's bucket
        at = np.arange(len(b.t))
        i = [at[1:][b.t[1:] == b.t[:-1]] - 1]
        j = [i[0] + 1]
        step, longest = 1, int(np.diff(b.cuts()).max(initial=0))
        while step < longest:
            member = at[(at - begin) % step == 0]
            leader = member - (member - begin[member]) % (step * BLOCK)
            own = leader < member
            i.append(leader[own])
            j.append(member[own])
            step *= BLOCK
        i, j = np.concatenate(i), np.concatenate(j)
        ok = b.possible(i, j)
        yield b.pairs(i[ok], j[ok])

    return run


def _across(threshold: float) -> Callable[[list[np.ndarray]], Iterator[list[np.ndarray]]]:
    """Pairs of different roots."""

    def run(c: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
        b, root = Bucket(c, threshold), c[-1]
        cuts, found, held = b.cuts(), [], 0
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if (root[lo:hi] == root[lo]).all():
                continue
            for x in range(lo, hi, STEP):
                i = np.arange(x, min(hi, x + STEP))
                for y in range(x, hi, STEP):
                    j = np.arange(y, min(hi, y + STEP))
                    if b.size[y] * threshold > b.size[i[-1]] + 1e-6:  # sizes only grow from here
                        break
                    p, q = np.nonzero((i[:, None] < j[None]) & (root[i][:, None] != root[j][None]) & (b.size[i][:, None] >= threshold * b.size[j][None] - 1e-6))
                    ok = b.possible(x + p, y + q)
                    found.append(b.pairs(x + p[ok], y + q[ok]))
                    held += int(ok.sum())
                    if held > 1 << 18:
                        yield [np.concatenate(z) for z in zip(*found, strict=True)]
                        found, held = [], 0
        if held:
            yield [np.concatenate(z) for z in zip(*found, strict=True)]

    return run


def _made_again(rows: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(set_id, own): the sets of the rows whose ids docs (one column) may hold, each made in the task that has the text."""
    marks, long = Marks(docs), T.LongType()

    def run(batch: pa.RecordBatch) -> dict:
        here = batch.filter(pa.array(marks.has(batch.column(1).to_numpy())))
        own = [shingles(x or b"", words) for x in here.column(0).cast(pa.binary()).to_pylist()]
        ends = np.cumsum([0, *map(len, own)], dtype=np.int32)
        return {"set_id": pa.array(np.array([_id(x) for x in own], dtype=np.uint64).view(np.int64)), "own": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *own]).view(np.int64)))}

    return map_arrow(rows.select("text", marks.hashed("doc_id").alias("h")), run, T.StructType([T.StructField("set_id", long), T.StructField("own", T.ArrayType(long))]))


def _verified(pairs: DataFrame, rows: DataFrame, once: DataFrame, words: int, threshold: float) -> DataFrame:
    """The pairs that are as similar as the threshold: by their wide sketches first, which bound the difference from below, then by their whole sets."""
    known = once.select("set_id", F.struct("size", "wide").alias("k"))
    both = pairs.join(known.select(F.col("set_id").alias("u"), F.col("k").alias("a")), "u").join(known.select(F.col("set_id").alias("v"), F.col("k").alias("b")), "v")
    size = "least(size(a.wide), size(b.wide))"
    least = F.expr(f"aggregate(zip_with({_folded('a.wide', size)}, {_folded('b.wide', size)}, (x, y) -> bit_count(x ^ y)), 0, (n, x) -> n + x)")
    left = stored(both.filter(least * (1 + threshold) <= (1 - threshold) * (F.col("a.size") + F.col("b.size")) + 1e-6).select("u", "v"), "shingles-left")
    docs = left.select(F.explode(F.array("u", "v")).alias("set_id")).distinct().join(once.select("set_id", "first_doc"), "set_id").select("first_doc").distinct()
    sets = stored(_made_again(rows, docs, words), "shingles-sets")
    both = left.join(sets.select(F.col("set_id").alias("u"), F.col("own").alias("a")), "u").join(sets.select(F.col("set_id").alias("v"), F.col("own").alias("b")), "v")
    both = both.select("u", "v", F.size(F.array_intersect("a", "b")).alias("x"), (F.size("a") + F.size("b")).alias("n"))
    return both.filter(F.col("x") >= F.lit(threshold) * (F.col("n") - F.col("x")) - 1e-9).select("u", "v").distinct()


def in_balls(once: DataFrame, near: Callable[[DataFrame], DataFrame], threshold: float) -> DataFrame:
    """(u, v): candidates by fingerprints. `near` links distinct fingerprints, each of which stands for its least set; sets of one fingerprint are a bucket."""
    least = once.groupBy("fingerprint").agg(F.min("set_id").alias("set_id"))
    held = [least.select(F.col("fingerprint").alias(c), F.col("set_id").alias(f"of_{c}")) for c in ("u", "v")]
    apart = near(once.select("fingerprint").distinct()).join(held[0], "u").join(held[1], "v").select(F.least("of_u", "of_v").alias("u"), F.greatest("of_u", "of_v").alias("v"))
    same = _by_bucket(once.select(F.col("fingerprint").alias("t"), "set_id", "size", F.lit(0).alias("place"), *BITS), _nearest(threshold), "u long, v long")
    return apart.unionByName(same)


def linked(rows: DataFrame, near: Callable[[DataFrame], DataFrame], words: int = WORDS, threshold: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """rows (doc_id, text): (doc_id, set_id) of each, and (u, v): links of set ids that connect all sets that the similarity connects.

    near: links (u, v) of the distinct fingerprints (one column) that lie in one another's balls.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is a similarity over 0")
    own = stored(_firsts(rows, words, threshold), "shingles")
    once = stored(own.groupBy("set_id").agg(F.min("doc_id").alias("first_doc"), *[F.first(c).alias(c) for c in ("size", "fingerprint", *BITS, "wide")]), "shingles-once")
    balls = stored(in_balls(once, near, threshold), "shingles-balls")
    first = own.select("set_id", "size", "first").dropDuplicates(["set_id"]).select("set_id", "size", F.posexplode("first").alias("place", "t")).select("t", "set_id", "size", "place")
    met = _by_bucket(first, lambda c: iter([c]), "t long, set_id long, size int, place int")
    met = stored(met.join(once.select("set_id", *BITS), "set_id").select("t", "set_id", "size", "place", *BITS), "shingles-met")
    pairs = stored(_by_bucket(met, _nearest(threshold), "u long, v long").unionByName(balls).distinct(), "shingles-pairs")
    roots = stored(components(_verified(pairs, rows, once, words, threshold)), "shingles-roots")
    rooted = met.join(roots, F.col("set_id") == F.col("node"), "left").select("t", "set_id", "size", "place", *BITS, F.coalesce("root", "set_id").alias("root"))
    pairs = stored(_by_bucket(rooted, _across(threshold), "u long, v long").distinct(), "shingles-pairs")
    rest = _verified(pairs, rows, once, words, threshold)
    return own.select("doc_id", "set_id"), roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(rest)
