r"""Byte-level BPE encoding and decoding by overlapping chunks.

Every text is cut into chunks of `chunk` characters that overlap; each chunk is split into pre-tokens and
encoded by itself. The pattern looks ahead but never back, so
two chunks that have a boundary at the same place agree from there on. Stitching keeps the pieces of a chunk up to
the first boundary that the next chunk shares, and goes on with the next chunk. Where the overlap has no shared
boundary (a run of letters or white space longer than the overlap), the text is split on from the last sure boundary
until it meets one of a later chunk, so results are always those of the whole text.

Only where chunks are encoded differs: those of a text longer than `spread` characters are rows of their own that are shared out over
tasks, each with its own characters alone; those of the others stay in the task that has the text. Equal long texts are encoded once.

The vocabulary is read by the driver and sent to the executors once; it holds as many entries as there are ids.

Cases: a null text is the empty text and gives no ids; repeated rows give as many rows; other columns are kept,
also where their names are those of working columns; an empty table gives no rows. An added column whose name the
input has already replaces it.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, fresh, map_arrow

CHUNK, OVERLAP, SPREAD = 1 << 13, 1 << 8, 1 << 16
#: Pieces kept with their ids; beyond this the memo starts anew.
MEMO = 150_000


class _Memo(dict):
    """Piece -> its ids as little-endian 32-bit integers."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        out = np.asarray(self.encode(piece), dtype="<u4").tobytes()
        if len(piece) <= 64:
            self[piece] = out
        return out


class Codec:
    """vocabulary: the bytes of a file of ranks."""

    def __init__(self, vocabulary: bytes, pattern: str):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        self.find = regex.compile(pattern)
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.memo = _Memo(self._one)
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for raw, n in ranks.items():
            self.bytes[n] = raw

    def _one(self, piece: str) -> list[int]:
        """A pre-token taken alone may match the pattern otherwise than in its text (white space before a word), so it goes in as bytes."""
        return self.encoding._core_bpe.encode_single_piece(piece.encode("utf-8", "replace"))

    def encode(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> bytes:
        """The ids of a text, by its chunks."""
        parts = [(a, b, *self.pieces(text[a:b])) for a, b in spans(len(text), chunk, overlap)]
        return self.stitched(text, parts)

    def stitched(self, text: str, parts: list[tuple[int, int, np.ndarray, list[bytes]]]) -> bytes:
        if len(parts) == 1:
            return b"".join(parts[0][3])
        return b"".join([self.memo[s] if ids is None else ids for s, ids in stitch(text, parts, self.find)])

    def pieces(self, chunk: str) -> tuple[np.ndarray, list[bytes]]:
        """Ends of the chunk's pieces, and each piece's ids."""
        found = self.find.findall(chunk)
        return np.cumsum([len(x) for x in found], dtype=np.int64), [self.memo[x] for x in found]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


class Held:
    """A vocabulary that executors get once; a worker builds its codec when it first asks for it."""

    def __init__(self, spark, path: str, pattern: str):
        with open(path, "rb") as f:
            raw = f.read()
        self.key, self.pattern = (hashlib.sha256(raw).hexdigest(), pattern), pattern
        self.raw = spark.sparkContext.broadcast(raw)

    def __call__(self) -> Codec:
        if self.key not in _CODECS:
            _CODECS.clear()
            _CODECS[self.key] = Codec(self.raw.value, self.pattern)
        return _CODECS[self.key]


#: The codec in use in this worker.
_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    with open(path, "rb") as f:
        return Codec(f.read(), pattern)


def spans(n: int, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """Where the chunks of a text of n characters begin and end, overlap included."""
    return [(a, min(n, a + chunk + overlap)) for a in range(0, max(n, 1), chunk)]


def stitch(text: str, parts: list[tuple[int, int, np.ndarray, list[bytes]]], find) -> list[tuple[str, bytes | None]]:
    """parts: each chunk's begin, end, piece ends (within the chunk) and ids. Gives runs: ids, or text still to encode.

    A chunk's last piece, and any that touches its end, may depend on what follows the chunk and is not trusted.
    """
    out: list[tuple[str, bytes | None]] = []
    at = 0  # all before is settled, and a boundary is here
    for i, (begin, end, ends, ids) in enumerate(parts):
        last = i + 1 == len(parts)
        bounds = np.concatenate([[0], ends]) + begin
        sure = len(bounds) if last else max(1, int(np.searchsorted(bounds, end - 2)))  # the last pieces may reach on
        k = int(np.searchsorted(bounds, at))
        if k >= len(bounds) or bounds[k] != at:  # no boundary shared here: split on from the settled place
            own = set(bounds[:sure].tolist())
            for m in find.finditer(text, at):
                at = m.end()
                out.append((m.group(), None))
                if at in own or (at >= end and not last):
                    break
            k = int(np.searchsorted(bounds, at))
            if k >= sure or bounds[k] != at:
                continue
        if last:
            stop = len(bounds) - 1
        else:
            ahead = np.concatenate([[0], parts[i + 1][2]]) + parts[i + 1][0]
            both = np.intersect1d(bounds[k:sure], ahead)
            stop = int(np.searchsorted(bounds, both[0])) if len(both) else max(k, sure - 1)
        out.append(("", b"".join(ids[k:stop])))
        at = int(bounds[stop])
    return out


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP, spread: int = SPREAD) -> DataFrame:
    """docs with token_ids (binary: little-endian unsigned 32-bit ids) and n_tokens."""
    docs = docs.drop("token_ids", "n_tokens")
    schema = T.StructType([*docs.schema.fields, T.StructField("token_ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())])
    names = docs.columns
    at = names.index(text)
    held = Held(docs.sparkSession, path, pattern)
    size = F.length(F.coalesce(col(text), F.lit("")))

    def here(batch: pa.RecordBatch) -> dict:
        c = held()
        ids = [c.encode(x or "", chunk, overlap) for x in batch.column(at).to_pylist()]
        return dict(enumerate([*batch.columns, ids, [len(x) // 4 for x in ids]]))

    near = map_arrow(docs.filter(size <= spread), here, schema)

    # long texts: a row for each chunk; the key is that of the text, since ids follow from it alone
    key, same, parted = fresh(docs, "text_key", "text_key_of", "text_parts")
    far = docs.filter(size > spread).withColumn(key, F.sha2(col(text).cast("binary"), 256))
    once = far.select(col(key).alias("key"), col(text).alias("t")).dropDuplicates(["key"])
    parts = T._parse_datatype_string("key string, no int, begin long, end long, part string")
    arrow = pa.schema([("key", pa.string()), ("no", pa.int32()), ("begin", pa.int64()), ("end", pa.int64()), ("part", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = spans(len(t), chunk, overlap)
                for i in range(0, len(own), 256):
                    some = own[i : i + 256]
                    yield pa.RecordBatch.from_pydict({"key": [k] * len(some), "no": range(i, i + len(some)), "begin": [a for a, _ in some], "end": [b for _, b in some], "part": [t[a:b] for a, b in some]}, schema=arrow)

    def coded(batch: pa.RecordBatch) -> dict:
        c, bounds, lens, ids = held(), [], [], []
        for part in batch.column(4).to_pylist():
            e, own = c.pieces(part)
            bounds.append(e.astype("<i8").tobytes())
            ids.append(b"".join(own))
            lens.append(np.asarray([len(x) for x in own], dtype="<i8").tobytes())
        return dict(enumerate([*batch.columns[:4], bounds, lens, ids]))

    chunks = map_arrow(once.mapInArrow(cut, parts).repartition("key", "no"), coded, "key string, no int, begin long, end long, bounds binary, lens binary, ids binary")
    chunks = chunks.groupBy("key").agg(F.collect_list(F.struct("no", "begin", "end", "bounds", "lens", "ids")).alias("parts"))

    def joined(batch: pa.RecordBatch) -> dict:
        c, out = held(), []
        for t, found in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
            own = []
            for p in sorted(found, key=lambda p: p["no"]):
                cuts = np.concatenate([[0], np.cumsum(np.frombuffer(p["lens"], "<i8"))]).tolist()
                own.append((p["begin"], p["end"], np.frombuffer(p["bounds"], "<i8"), [p["ids"][a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]))
            out.append(c.stitched(t, own))
        return dict(enumerate([*batch.columns[: len(names)], out, [len(x) // 4 for x in out]]))

    met = far.join(chunks.select(F.col("key").alias(same), F.col("parts").alias(parted)), col(key) == col(same)).select(*[col(c) for c in names], col(parted))
    return near.unionByName(map_arrow(met, joined, schema))


def decode(tokens: DataFrame, path: str, pattern: str, ids: str = "token_ids") -> DataFrame:
    """tokens with decoded (binary): the bytes of its ids, one after another."""
    tokens = tokens.drop("decoded")
    schema = T.StructType([*tokens.schema.fields, T.StructField("decoded", T.BinaryType())])
    at, held = tokens.columns.index(ids), Held(tokens.sparkSession, path, pattern)

    def run(batch: pa.RecordBatch) -> dict:
        c = held()
        return dict(enumerate([*batch.columns, [c.decode(x or b"") for x in batch.column(at).to_pylist()]]))

    return map_arrow(tokens, run, schema)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document."""
    coded = decode(encode(docs.select("doc_id", "text"), path, pattern).select("doc_id", "token_ids", "n_tokens"), path, pattern)
    return coded.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
