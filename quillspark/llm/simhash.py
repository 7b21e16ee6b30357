r"""SimHash near-dedup by meet-in-the-middle ball hashing, with a block of the fingerprint left out of the ball.

A text in which A-Z are in lower case gives its words `[^\x20\x09-\x0D]+`, these give shingles of `words` words (a
shorter sequence is one shingle; no words give fingerprint zero), and each shingle its XXH64 of seed 42. A bit of the
fingerprint is 1 if it is set in over half of the shingles' hashes, repeats included. Fingerprints link at `radius` = 3 or fewer
differing bits.

Two fingerprints at distance 3 meet between: of the blocks of 16 bits, some block holds one of the differing bits, and
outside it at most two differ. So each distinct fingerprint emits, for each block left out, itself and its variants
within radius 1 outside the block (4 x 49 rows of 48-bit keys instead of the 2,081 of a ball of radius 2, with the
same recall of 1; it is a pigeonhole filter over balls of half the radius, rounded down). Fingerprints are dealt out evenly before they
emit. A shuffle sorts the variants; of each bucket the distances are verified, and of the links of a
bucket a spanning forest leaves the task, never all pairs. Copies of a fingerprint collapse before that. Components are found
over the links of distinct fingerprints.

That is the contract of op2. Without a radius, `groups` and `dedup` take the fingerprints that ball hashing links as candidates, check these by the exact
similarity of their sets of shingles (`shingles`: five words, Jaccard similarity of at least 0.8), and find the similar pairs beyond a distance of 3 by an exact way
of their own, since the ball alone finds almost identical texts only; texts without words are one group in both.

Cases: a null text has no words; repeated rows come back as often as they came; a null doc_id is no candidate for
component_id unless the group has no other; an empty table gives no rows; other columns stay, whatever their names. Where rows share an id (or have none)
`dedup` keeps the row of the least hash among those of the group that have it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shingles
from .common import Marks, col, fresh, map_arrow, stored, whole_buckets
from .components import components

BLOCK, BLOCKS = 16, 4
#: Hashes of one text that are summed at a time.
STEP = 1 << 14
#: Fingerprints whose variants one task emits.
PER_TASK = 20_000


def fingerprint(text: bytes, words: int = 3) -> int:
    """Unsigned."""
    w = text.lower().split()
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, n, STEP):
        h = np.fromiter((xxhash.xxh64_intdigest(b" ".join(w[i : i + words]), 42) for i in range(at, min(n, at + STEP))), dtype="<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", words: int = 3, name: str = "fingerprint") -> DataFrame:
    """docs with their fingerprint as a signed long."""
    docs = docs.drop(name)
    at = docs.columns.index(text)

    def run(batch: pa.RecordBatch) -> dict:
        raw = batch.column(at).cast(pa.binary()).to_pylist()
        own = np.array([fingerprint(x or b"", words) for x in raw], dtype=np.uint64)
        return dict(enumerate([*batch.columns, pa.array(own.view(np.int64))]))

    return map_arrow(docs, run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def forest(fps: np.ndarray, radius: int, step: int = 1024) -> list[tuple[int, int]]:
    """Links between the fingerprints of a bucket that connect all that its links connect."""
    root = list(range(len(fps)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a in range(0, len(fps), step):
        for b in range(a, len(fps), step):
            near = np.bitwise_count(fps[a : a + step, None] ^ fps[None, b : b + step]) <= radius
            for i, j in zip(*np.nonzero(np.triu(near, 1) if a == b else near), strict=True):
                x, y = find(a + int(i)), find(b + int(j))
                if x != y:
                    root[x] = y
                    out.append((a + int(i), b + int(j)))
    return out


def links(distinct: DataFrame, radius: int = 3, name: str = "fingerprint") -> DataFrame:
    """(u, v): links of distinct fingerprints that connect all fingerprints within the radius."""
    if not 0 <= radius <= 3:
        raise ValueError("the variants emitted find distances up to 3")
    outside = 64 - BLOCK
    key = (
        f"transform(sequence(0, {BLOCKS * (outside + 1) - 1}), i -> "
        f"(((f & ~shiftleft({(1 << BLOCK) - 1}L, {BLOCK} * (i div {outside + 1})))"
        f" ^ if(i % {outside + 1} = 0, 0L, shiftleft(1L, i % {outside + 1} - 1 + if(i % {outside + 1} > {BLOCK} * (i div {outside + 1}), {BLOCK}, 0))))"
        f" | shiftleft(1L + i div {outside + 1}, {BLOCK} * (i div {outside + 1}))))"
    )
    key = key.replace(f"i div {outside + 1}", f"cast(i div {outside + 1} as int)")
    own = distinct.select(F.col(name).alias("f"))
    tasks = max(own.sparkSession.sparkContext.defaultParallelism, -(-own.count() // PER_TASK))
    variants = own.repartition(tasks, "f").select(F.explode(F.expr(key)).alias("key"), "f")

    def judged(c: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
        if not len(c[0]):
            return
        k, f = c[0], c[1].view(np.uint64)
        starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        size = np.diff(np.concatenate([starts, [len(k)]]))
        two = starts[size == 2]
        two = two[np.bitwise_count(f[two] ^ f[two + 1]) <= radius]
        u, v = [f[two]], [f[two + 1]]
        for a, b in zip(starts[size > 2], (starts + size)[size > 2], strict=True):
            found = np.asarray(forest(f[a:b], radius), dtype=np.int64).reshape(-1, 2)
            u.append(f[a:b][found[:, 0]])
            v.append(f[a:b][found[:, 1]])
        u, v = np.concatenate(u).view(np.int64), np.concatenate(v).view(np.int64)
        pairs = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)]), axis=1)
        yield [pairs[0], pairs[1]]

    return whole_buckets(variants.repartition("key").sortWithinPartitions("key"), judged, "u long, v long").distinct()


def named(own: DataFrame, edges: DataFrame) -> DataFrame:
    """own (doc_id, fingerprint): (fingerprint, root, component_id) of each distinct fingerprint."""
    first = own.groupBy("fingerprint").agg(F.min("doc_id").alias("first"))
    roots = components(edges)
    tied = first.join(roots, first["fingerprint"] == roots["node"], "left").select("fingerprint", "first", F.coalesce("root", "fingerprint").alias("root"))
    least = tied.groupBy("root").agg(F.min("first").alias("component_id"))
    return tied.join(least, "root").select("fingerprint", "root", "component_id")


def _linked(docs: DataFrame, text: str, doc_id: str, words: int, radius: int | None, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fingerprint) of each row, without a radius the id of its set of shingles in the place of the fingerprint; and `named`."""
    rows = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"))
    if radius is not None:
        own = stored(fingerprints(rows, words=words).drop("text"), "simhash")
        return own, named(own, links(own.select("fingerprint").distinct(), radius))
    own, edges = shingles.linked(rows, links, words, similarity)
    own = own.withColumnRenamed("set_id", "fingerprint")
    return own, named(own, edges)


def groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = shingles.WORDS, radius: int | None = None, similarity: float = shingles.SIMILARITY) -> DataFrame:
    """(doc_id, fingerprint as a long, component_id) for each row of docs; without a radius fingerprint is the id of the set of shingles."""
    own, group = _linked(docs, text, doc_id, words, radius, similarity)
    return own.join(group.drop("root"), "fingerprint").select("doc_id", "fingerprint", "component_id")


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = shingles.WORDS, radius: int | None = None, similarity: float = shingles.SIMILARITY) -> DataFrame:
    """One document of each group, that of the least doc_id."""
    own, group = _linked(docs, text, doc_id, words, radius, similarity)
    n_set, n_root, n_first, n_hash = fresh(docs, "set_id", "root", "first_id", "row_hash")
    same = col(doc_id).eqNullSafe(col(n_first))
    if own.groupBy("doc_id").count().filter("count > 1").limit(1).count():  # an id doesn't name a row: rows are told apart by their own fingerprints
        group = group.select(F.col("fingerprint").alias(n_set), F.col("root").alias(n_root), F.col("component_id").alias(n_first))
        marked = shingles.set_ids(docs, text, words, n_set) if radius is None else fingerprints(docs, text, words, n_set)
        rows = marked.join(group, n_set).filter(same)
        row = F.struct(*[col(c).alias(c) for c in docs.columns])
        one = rows.groupBy(n_root).agg(F.min_by(row, F.struct(F.xxhash64(col(text)), F.xxhash64(*[col(c) for c in docs.columns]))).alias(n_hash))
        return one.select(*[col(n_hash).getField(c).alias(c) for c in docs.columns])
    gone = own.join(group, "fingerprint").filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(n_first))
    gone = stored(gone.distinct(), "simhash-gone")
    marks = Marks(gone)
    hashed = docs.withColumn(n_hash, marks.hashed(doc_id))

    def taken(marked: bool) -> DataFrame:
        def run(batch: pa.RecordBatch) -> dict:
            here = marks.has(batch.column(batch.num_columns - 1).to_numpy()) == marked
            return dict(enumerate(batch.filter(pa.array(here)).columns[:-1]))

        return map_arrow(hashed, run, docs.schema)

    # rows whose ids aren't marked stay; only the others are dealt out to be compared with the ids that go
    return taken(False).unionByName(taken(True).join(gone.hint("shuffle_hash"), same, "left_anti"))


def digests(docs: DataFrame) -> DataFrame:
    out = groups(docs, words=3, radius=3)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
