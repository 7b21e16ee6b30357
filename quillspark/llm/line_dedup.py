r"""Line dedup with sharded cuckoo filters over exact reference-count tables.

A line's key is the line without `[\x20\x09-\x0D]` at its ends and with A-Z in lower case. Keys of at least
`min_chars` code points that occur in at least `min_docs` documents lose their lines in all of them but the one with
the largest doc_id. What is known of the corpus is a `LineState`:

* `refs`: a row (k1, k2, doc_id) for each key (as a 128-bit hash) and document that holds it: the exact references, as a
  log of what came and went, so that a change writes its own rows only;
* `hot`: each key with enough references, their number and the largest doc_id;
* `filters`: for each shard of the hot keys a cuckoo filter, which also supports deletion.

`insert` and `delete` add and take back documents. Only keys that these documents hold are counted anew, and keys that
cross the threshold enter or leave their shard's filter, so deleting what was inserted restores the state.
`apply` deals the distinct keys of its documents to their shards, where the filter is asked first; only keys that it may know are
looked up in the exact table, so a false positive costs a lookup and changes no result. A shard has about SHARD_KEYS keys at any size.

Cases: a null or empty text is one empty line; repeated rows of a doc_id are one document, and each row is treated
alike; a null doc_id counts as the smallest; a document that loses all lines keeps an empty text; other columns stay, but for
those of the two added names.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, fresh, map_arrow, short_batches, stored

BLANK = b" \t\n\x0b\x0c\r"
SHARD_KEYS = 250_000
#: Keys that hold at least this part of all references are broadcast; there are as many at most.
COMMON = 1_000
#: Pieces of the log, after which it is written anew.
MOST_PIECES = 16


class CuckooFilter:
    """Four 16-bit fingerprints a bucket; each key has two buckets, either computed from the other."""

    def __init__(self, keys: int, table: np.ndarray | None = None):
        size = 1 << max(3, int(np.ceil(np.log2(max(1, keys) / 3.2))))
        self.table = np.zeros((size, 4), dtype=np.uint16) if table is None else table
        self.mask = np.uint64(len(self.table) - 1)

    def places(self, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = k2.astype(np.int64).view(np.uint64)
        prints = (h & np.uint64(0xFFFF)).astype(np.uint16)
        prints[prints == 0] = 1
        one = (h >> np.uint64(16)) & self.mask
        return prints, one, (one ^ self._step(prints)) & self.mask

    @staticmethod
    def _step(prints: np.ndarray) -> np.ndarray:
        return (prints.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)

    def contains(self, k2: np.ndarray) -> np.ndarray:
        prints, one, two = self.places(k2)
        own = prints[:, None]
        return (self.table[one] == own).any(axis=1) | (self.table[two] == own).any(axis=1)

    def insert(self, k2: np.ndarray) -> bool:
        """False if it is full: the caller builds a larger one from the exact table."""
        prints, one, two = self.places(k2)
        rng = np.random.default_rng(7)
        for p, a, b in zip(prints, one, two, strict=True):
            at = a
            for kick in range(500):
                for spot in (a, b) if kick == 0 else (at,):
                    free = np.flatnonzero(self.table[spot] == 0)
                    if len(free):
                        self.table[spot, free[0]] = p
                        break
                else:
                    at = b if kick == 0 else at
                    slot = int(rng.integers(4))
                    p, self.table[at, slot] = self.table[at, slot], p
                    at = (at ^ self._step(np.asarray([p], dtype=np.uint16))[0]) & self.mask
                    continue
                break
            else:
                return False
        return True

    def delete(self, k2: np.ndarray) -> None:
        for p, a, b in zip(*self.places(k2), strict=True):
            for spot in (a, b):
                found = np.flatnonzero(self.table[spot] == p)
                if len(found):
                    self.table[spot, found[0]] = 0
                    break


def filled(k2: np.ndarray) -> CuckooFilter:
    room = len(k2)
    while not (out := CuckooFilter(room)).insert(k2):
        room = 2 * room + 8
    return out


def keys_of(text: bytes, min_chars: int) -> list[tuple[bytes, bytes | None]]:
    """Each line, with the 16 bytes of its key's hash if the key is long enough."""
    out = []
    for line in text.split(b"\n"):
        key = line.strip(BLANK)
        if len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars):
            out.append((line, xxhash.xxh3_128_digest(key.lower())))
        else:
            out.append((line, None))
    return out


def _binary(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def references(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = 40) -> DataFrame:
    """(k1, k2, doc_id), once for each key and document."""
    kind = docs.schema[doc_id].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, counts = batch.column(0), [], []
            for raw in _binary(batch.column(1)):
                own = {h for _, h in keys_of(raw, min_chars) if h}
                hashes.extend(own)
                counts.append(len(own))
            k = np.frombuffer(b"".join(hashes), dtype="<i8").reshape(-1, 2)
            rows = pa.array(np.repeat(np.arange(len(counts)), counts))
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(k[:, 0])), pa.array(np.ascontiguousarray(k[:, 1])), ids.take(rows)], names=["k1", "k2", "doc_id"])

    short_batches(docs.sparkSession)
    schema = T.StructType([T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("doc_id", kind)])
    return docs.select(col(doc_id), col(text)).mapInArrow(run, schema).distinct()


@dataclass
class LineState:
    log: list[DataFrame]  # (k1, k2, doc_id, delta): references that came and went
    hot: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int
    min_chars: int

    @property
    def refs(self) -> DataFrame:
        """(k1, k2, doc_id) as they are now."""
        return self.refs_of(None)

    def refs_of(self, keys: DataFrame | None) -> DataFrame:
        """The references of some keys (k1, k2)."""
        own = [x if keys is None else x.join(keys, ["k1", "k2"], "left_semi") for x in self.log]
        if len(own) == 1:
            return own[0].select("k1", "k2", "doc_id")
        every = own[0]
        for x in own[1:]:
            every = every.unionByName(x)
        return every.groupBy("k1", "k2", "doc_id").agg(F.sum("delta").alias("delta")).filter("delta > 0").select("k1", "k2", "doc_id")


def _hot(refs: DataFrame, min_docs: int) -> DataFrame:
    return refs.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last")).filter(F.col("n_docs") >= min_docs)


def _shard(shards: int):
    return F.pmod(F.col("k1"), F.lit(shards)).cast("int").alias("shard")


FILTER = "shard int, slots binary"


def _filters(hot: DataFrame, shards: int) -> DataFrame:
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": pdf["shard"].iloc[:1].astype("int32"), "slots": [filled(pdf["k2"].to_numpy()).table.tobytes()]})

    return hot.select(_shard(shards), "k2").groupBy("shard").applyInPandas(one, FILTER)


def build(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_docs: int = 5, min_chars: int = 40) -> LineState:
    """The state of docs. All its tables are in the shared folder; there are as many shards as references need at SHARD_KEYS each."""
    refs = stored(references(docs, text, doc_id, min_chars), "line-refs")
    hot = stored(_hot(refs, min_docs), "line-hot")
    shards = max(8, -(-refs.count() // SHARD_KEYS))
    return LineState([refs.withColumn("delta", F.lit(1))], hot, stored(_filters(hot, shards), "line-filters"), shards, min_docs, min_chars)


def _touched(state: LineState, log: list[DataFrame], keys: DataFrame) -> LineState:
    """The state with another log, where only `keys` have changed."""
    if len(log) > MOST_PIECES:
        log = [stored(LineState(log, state.hot, state.filters, 1, 1, 1).refs, "line-refs").withColumn("delta", F.lit(1))]
    out = LineState(log, state.hot, state.filters, state.shards, state.min_docs, state.min_chars)
    anew = _hot(out.refs_of(keys), state.min_docs)
    hot = out.hot = stored(state.hot.join(keys, ["k1", "k2"], "left_anti").unionByName(anew), "line-hot")
    mark = lambda df, d: df.select("k1", "k2", F.lit(d).alias("delta"))
    moved = mark(hot, 1).unionByName(mark(state.hot, -1)).groupBy("k1", "k2").agg(F.sum("delta").alias("delta")).filter("delta <> 0")

    def change(old: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        shard = int((old if len(old) else own)["shard"].iloc[0])
        table = np.frombuffer(old["slots"].iloc[0], dtype=np.uint16).reshape(-1, 4).copy() if len(old) else None
        f = CuckooFilter(len(own), table)
        f.delete(own.loc[own["delta"] < 0, "k2"].to_numpy())
        ok = f.insert(own.loc[own["delta"] > 0, "k2"].to_numpy())
        return pd.DataFrame({"shard": [shard], "slots": [f.table.tobytes() if ok else b""]}).astype({"shard": "int32"})

    changed = stored(state.filters.groupBy("shard").cogroup(moved.select(_shard(state.shards), "k2", "delta").groupBy("shard")).applyInPandas(change, FILTER), "line-filters")
    # a filter that ran full is built anew from the exact table
    full = changed.filter(F.length("slots") == 0).select("shard")
    again = _filters(hot.withColumn("shard", _shard(state.shards)).join(full, "shard", "left_semi").drop("shard"), state.shards)
    out.filters = stored(changed.filter(F.length("slots") > 0).unionByName(again), "line-filters")
    return out


def _logged(refs: DataFrame, delta: int) -> DataFrame:
    return stored(refs.select("k1", "k2", "doc_id"), "line-refs").withColumn("delta", F.lit(delta))


def insert(state: LineState, docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> LineState:
    """Writes the references that docs add, not those that are there."""
    new = stored(references(docs, text, doc_id, state.min_chars), "line-refs")
    keys = new.select("k1", "k2").distinct()
    held = state.refs_of(keys).select(*[F.col(c).alias(f"h_{c}") for c in ("k1", "k2", "doc_id")])
    same = (F.col("k1") == F.col("h_k1")) & (F.col("k2") == F.col("h_k2")) & F.col("doc_id").eqNullSafe(F.col("h_doc_id"))
    return _touched(state, [*state.log, _logged(new.join(held, same, "left_anti"), 1)], keys)


def delete(state: LineState, doc_ids: DataFrame, doc_id: str = "doc_id") -> LineState:
    """Writes the references that go with these documents."""
    gone = doc_ids.select(col(doc_id).alias("gone")).distinct()
    out = _logged(state.refs.join(gone, F.col("doc_id").eqNullSafe(F.col("gone")), "left_semi"), -1)
    return _touched(state, [*state.log, out], out.select("k1", "k2").distinct())


def _known(state: LineState, refs: DataFrame) -> DataFrame:
    """(k1, k2, n, last): the hot keys among refs (n references there). Each shard's filter is asked for its keys; what it may know is looked up."""

    def ask(own: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(held) or not len(own):
            return own.iloc[:0][["k1", "k2", "n"]]
        f = CuckooFilter(0, np.frombuffer(held["slots"].iloc[0], dtype=np.uint16).reshape(-1, 4))
        return own.loc[f.contains(own["k2"].to_numpy()), ["k1", "k2", "n"]]

    short_batches(refs.sparkSession)
    keys = refs.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).select("k1", "k2", "n", _shard(state.shards))
    maybe = keys.groupBy("shard").cogroup(state.filters.groupBy("shard")).applyInPandas(ask, "k1 long, k2 long, n long")
    return maybe.join(state.hot.select("k1", "k2", "last"), ["k1", "k2"])


def _lost(state: LineState, refs: DataFrame) -> DataFrame:
    """(lost_id, lost): each document's keys whose lines it loses.

    Keys that hold at least one in COMMON references are COMMON at most and are broadcast, so that no task gets the rows of a very frequent key.
    """
    known = stored(_known(state, refs), "line-known")
    least = -(-refs.count() // COMMON)
    very = F.broadcast(known.filter(F.col("n") >= least).drop("n"))
    rest = known.filter(F.col("n") < least).drop("n")
    seldom = refs.join(very.select("k1", "k2"), ["k1", "k2"], "left_anti")
    out = refs.join(very, ["k1", "k2"]).unionByName(seldom.join(rest, ["k1", "k2"]))
    out = out.filter(~F.col("doc_id").eqNullSafe(F.col("last")))
    return out.groupBy(F.col("doc_id").alias("lost_id")).agg(F.collect_list(F.struct("k1", "k2")).alias("lost"))


def apply(state: LineState, docs: DataFrame, text: str = "text", doc_id: str = "doc_id", refs: DataFrame | None = None, lines: str = "n_lines", dropped: str = "n_dropped") -> DataFrame:
    """docs with the text's kept lines, and with two columns more (which replace those of their names): n_lines (before) and n_dropped.

    refs: the references of docs, if they are known. Texts are dealt out by doc_id once, whatever the size, to meet the narrow table of lost keys.
    """
    min_chars = state.min_chars
    docs = docs.drop(lines, dropped)
    names, at = docs.columns, docs.columns.index(text)
    if refs is None:
        refs = stored(references(docs, text, doc_id, min_chars), "line-refs")
    n_id, n_lost = fresh(docs, "lost_id", "lost")
    lost = _lost(state, refs).select(F.col("lost_id").alias(n_id), F.col("lost").alias(n_lost))
    met = docs.join(lost.hint("merge"), col(doc_id).eqNullSafe(col(n_id)), "left").drop(n_id)

    def cut(batch: pa.RecordBatch) -> dict:
        texts, counts, gone_ = batch.column(at).to_pylist(), [], []
        for i, (raw, gone) in enumerate(zip(_binary(batch.column(at)), batch.column(len(names)).to_pylist(), strict=True)):
            counts.append(raw.count(b"\n") + 1)
            gone_.append(0)
            if gone:
                own = {(g["k1"], g["k2"]) for g in gone}
                kept = [line for line, h in keys_of(raw, min_chars) if h is None or struct.unpack("<qq", h) not in own]
                texts[i] = b"\n".join(kept).decode("utf-8", "replace")
                gone_[-1] = counts[-1] - len(kept)
        columns = list(batch.columns[: len(names)])
        columns[at] = pa.array(texts, pa.string())
        return dict(enumerate([*columns, counts, gone_]))

    return map_arrow(met, cut, T.StructType([*docs.schema.fields, T.StructField(lines, T.LongType()), T.StructField(dropped, T.LongType())]))


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_docs: int = 5, min_chars: int = 40, lines: str = "n_lines", dropped: str = "n_dropped") -> DataFrame:
    """docs without the lines that they repeat from one another."""
    state = build(docs, text, doc_id, min_docs, min_chars)
    return apply(state, docs, text, doc_id, state.refs, lines, dropped)


def digests(docs: DataFrame) -> DataFrame:
    out = dedup(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
    SELECT r, doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
    FROM (SELECT r, doc_id, unnest(a) AS line, unnest(range(len(a))) AS i
          FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents))
), hot AS (
    SELECT k, max(doc_id) AS last FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), m AS (
    SELECT l.*, hot.k IS NOT NULL AND l.doc_id <> hot.last AS gone FROM l LEFT JOIN hot ON l.k = hot.k
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""
