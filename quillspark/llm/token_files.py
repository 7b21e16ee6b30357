r"""Token ids in binary files, compressed by Re-Pair grammars.

Documents are put in ascending doc_id order (range partitions, sorted within), encoded, and an end id is added to each. A
shard is a row of a Parquet file: the whole documents of about SHARD ids, and their ids in blocks of at most BLOCK ids. Each block
is a grammar of its own: in every round the most frequent pairs of neighbouring symbols become nonterminals and are
replaced from left to right, until no pair is frequent enough, the rounds end or symbols run out. A block in bytes:

    magic "RPG1", then little-endian unsigned 32-bit: width of a symbol in bytes (2 or 4), first nonterminal, rules, symbols, ids;
    then the rules' left symbols, right symbols, the lengths of their expansions (32-bit), and the symbols.

Lengths of expansions let a reader find any range of ids and expand only the symbols that cover it (`decode_range`). A lost executor's
tasks write their files anew; a reader sees committed files only.

Cases: a null or empty text is the end id alone; rows of equal doc_id follow one another in the order of their texts' hashes; a null doc_id comes first;
an empty table has no shards; the text's other columns are not stored.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import shared_dir, short_batches

BLOCK, SHARD = 1 << 20, 1 << 20
ROUNDS, PAIRS, LEAST = 8, 2_000, 16
#: Symbols that a round looks at together, which the processor's cache holds.
STEP = 1 << 15
#: Entries of a generation of the encoder's memo of words.
WORDS = 500_000
MAGIC = b"RPG1"


class Generations:
    """A memo of bounded size that keeps what is in use: when it is full it becomes the old one, from which entries come back."""

    def __init__(self, most: int):
        self.most, self.now, self.old = most, {}, {}

    def unknown(self, keys: set) -> list:
        """The keys without an entry; those of the old generation that are asked for come back."""
        if len(self.now) > self.most:
            self.now, self.old = {}, self.now
        now, old, out = self.now, self.old, []
        for k in keys.difference(now):
            v = old.get(k)
            if v is None:
                out.append(k)
            else:
                now[k] = v
        return out


class TextEncoder:
    """The library's ids of whole texts, for any tokenizer."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.kind = "<u2" if self.size < 1 << 16 else "<u4"

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype=self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class WordEncoder(TextEncoder):
    """The same from a memo of the ids of their words, for tokenizers that part texts and lower-case them as the fixed values say (`fits`).

    White space always parts pre-tokens, and so does the place between a word of letters and the signs of `TAIL` after it; words seen before aren't encoded again.
    Unknown words of letters alone go to the library as one text, and are told apart by the ends of words in its tokens.
    """

    TAIL = ".,!?;:%&$#*()-"

    # What a tokenizer's file says of itself where white space parts pre-tokens, letters are one pre-token and ASCII goes to lower case.
    NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
    SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
    BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}

    @classmethod
    def fits(cls, path: str) -> bool:
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model = told["model"]
        plain_model = model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>" and not any(model.get(x) for x in ("continuing_subword_prefix", "dropout", "ignore_merges"))
        parted = not any(any(c.isspace() for c in t["content"]) for t in told.get("added_tokens") or [])
        return plain_model and parted and told.get("normalizer") == cls.NORMALIZER and told.get("pre_tokenizer") == {"type": "Sequence", "pretokenizers": [cls.SPLIT, cls.BYTES]}

    def __init__(self, path: str):
        super().__init__(path)
        self.ends = np.zeros(self.size, dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        told |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"String": " "}, "behavior": "Removed", "invert": False}, self.BYTES]}}
        self.plain = Tokenizer.from_str(json.dumps(told))
        self.words = Generations(WORDS)

    def _learn(self, words: list[str]) -> None:
        """Words of lower-case Latin letters are as the normalizer leaves them, and need only be parted at the blanks between them."""
        latin = [w for w in words if w.isalpha() and w.islower() and max(w) < "\u0100"]
        other = [w for w in words if w.isalpha() and not (w.islower() and max(w) < "\u0100")]
        rest = [w for w in words if not w.isalpha()]
        for tokenizer, own in ((self.plain, latin), (self.tokenizer, other)):
            if own:
                ids = np.asarray(tokenizer.encode_batch_fast([" ".join(own)], add_special_tokens=False)[0].ids, dtype=np.int64)
                cuts = np.flatnonzero(self.ends[ids]) + 1
                if len(cuts) != len(own) or cuts[-1] != len(ids):
                    rest += own
                    continue
                raw, width = ids.astype(self.kind).tobytes(), int(self.kind[-1])
                at = 0
                for w, b in zip(own, (cuts * width).tolist(), strict=True):
                    self.words.now[w] = raw[at:b]
                    at = b
        for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            self.words.now[w] = np.asarray(e.ids, dtype=self.kind).tobytes()

    def _known(self, words: list[str]) -> list[bytes]:
        own = list(map(self.words.now.get, words))
        fresh = [i for i, ids in enumerate(own) if ids is None]
        if fresh:
            self._learn(self.words.unknown({words[i] for i in fresh}))
            for i in fresh:
                own[i] = self.words.now[words[i]]
        return own

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each distinct part is looked up once, and its ids are taken by its number."""
        split = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        trimmed = pc.utf8_rtrim(coded.dictionary, characters=self.TAIL)
        cut = pc.subtract(pc.binary_length(coded.dictionary), pc.binary_length(trimmed)).to_numpy()
        parts, heads = (x.to_numpy(zero_copy_only=False).tolist() for x in (coded.dictionary, pc.ascii_lower(trimmed)))  # the library lower-cases as well
        heads = [h if h.isalpha() else p for h, p in zip(heads, parts, strict=True)]
        own = self._known(heads)
        tailed = [i for i in np.flatnonzero(cut).tolist() if heads[i] is not parts[i]]
        for i, ids in zip(tailed, self._known([parts[i][-n:] for i, n in zip(tailed, cut[tailed].tolist(), strict=True)]), strict=True):
            own[i] += ids
        codes, cuts = coded.indices.to_numpy().tolist(), split.offsets.to_numpy().tolist()
        return [b"".join(map(own.__getitem__, codes[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


@lru_cache(maxsize=2)
def encoder(path: str) -> TextEncoder:
    return WordEncoder(path) if WordEncoder.fits(path) else TextEncoder(path)


class Block:
    """A grammar: first is the number of the first nonterminal, left and right are the rules."""

    def __init__(self, first: int, left: np.ndarray, right: np.ndarray, symbols: np.ndarray, lengths: np.ndarray | None = None, count: int | None = None):
        self.first, self.left, self.right, self.symbols = first, left, right, symbols
        self.lengths = self._lengths() if lengths is None else lengths
        self.count = int(self.sizes().sum()) if count is None else count

    def _lengths(self) -> np.ndarray:
        own = [1] * len(self.left)
        size = lambda s: 1 if s < self.first else own[s - self.first]
        for i, (a, b) in enumerate(zip(self.left.tolist(), self.right.tolist(), strict=True)):
            own[i] = size(a) + size(b)
        return np.array(own, dtype=np.int64)

    def sizes(self) -> np.ndarray:
        """How many ids each symbol stands for."""
        out = np.ones(len(self.symbols), dtype=np.int64)
        inner = self.symbols >= self.first
        out[inner] = self.lengths[self.symbols[inner] - self.first]
        return out

    def pack(self) -> bytes:
        width = 2 if self.first + len(self.left) <= 1 << 16 else 4
        kind = f"<u{width}"
        return b"".join([MAGIC, struct.pack("<5I", width, self.first, len(self.left), len(self.symbols), self.count), self.left.astype(kind).tobytes(), self.right.astype(kind).tobytes(), self.lengths.astype("<u4").tobytes(), self.symbols.astype(kind).tobytes()])

    @staticmethod
    def unpack(raw: bytes) -> Block:
        if raw[:4] != MAGIC:
            raise ValueError("not a block of token ids")
        width, first, rules, symbols, count = struct.unpack_from("<5I", raw, 4)
        at, out = 24, []
        for kind, n in ((f"<u{width}", rules), (f"<u{width}", rules), ("<u4", rules), (f"<u{width}", symbols)):
            a = np.frombuffer(raw, dtype=kind, count=n, offset=at)
            at += a.nbytes
            out.append(a.astype(np.int64))
        return Block(first, out[0], out[1], out[3], out[2], count)

    def _used(self, symbols: np.ndarray) -> list[int]:
        """The rules that symbols need, each after those that it needs itself."""
        used = np.zeros(len(self.left), dtype=bool)
        used[np.unique(symbols[symbols >= self.first]) - self.first] = True
        for i in range(len(used) - 1, -1, -1):  # a rule's sides are older than it is
            if used[i]:
                for side in (self.left[i], self.right[i]):
                    if side >= self.first:
                        used[side - self.first] = True
        return np.flatnonzero(used).tolist()

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids that symbols stand for: the nonterminals that they need are expanded once, one after another, and their stretches gathered."""
        used = self._used(symbols)
        own: dict[int, bytes] = {}
        word = lambda s: s.to_bytes(4, "little") if s < self.first else own[s - self.first]
        for i in used:
            own[i] = word(int(self.left[i])) + word(int(self.right[i]))
        flat = np.concatenate([np.arange(self.first, dtype=np.uint32), np.frombuffer(b"".join(own.values()), dtype="<u4")])
        rules = np.zeros(len(self.left), dtype=np.int64)
        rules[used] = self.lengths[used]
        sizes = np.concatenate([np.ones(self.first, dtype=np.int64), rules])
        begins = np.cumsum(sizes) - sizes
        n = sizes[symbols]
        ends = np.cumsum(n)
        return flat[np.repeat(begins[symbols] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)].astype("<u4", copy=False)

    def decode(self) -> np.ndarray:
        return self._expand(self.symbols)

    def decode_range(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the block, from the symbols that cover them."""
        ends = np.cumsum(self.sizes())
        a, b = int(np.searchsorted(ends, start, side="right")), int(np.searchsorted(ends, stop, side="left")) + 1
        before = int(ends[a - 1]) if a else 0
        return self._expand(self.symbols[a:b])[start - before : stop - before]


def _runs(ordered: np.ndarray, least: int) -> np.ndarray:
    """Where the runs of at least `least` equal values begin."""
    out = ordered[: max(0, len(ordered) - least + 1)] == ordered[least - 1 :]
    out[1:] &= ordered[1 : len(out)] != ordered[: max(0, len(out) - 1)]
    return np.flatnonzero(out)


def re_pair(ids: np.ndarray, first: int, rounds: int = ROUNDS, pairs: int = PAIRS, least: int = LEAST) -> Block:
    s = ids.astype(np.uint32)
    left, right = [], []
    free, room = first, max(1 << 16, first + 1) - first if first < 1 << 16 else 1 << 20
    for _ in range(rounds):
        n = min(pairs, room - (free - first))
        if len(s) < 2 or n <= 0:
            break
        narrow = free <= 1 << 16
        keys = (s[:-1] << np.uint32(16)) | s[1:] if narrow else (s[:-1].astype(np.uint64) << np.uint64(32)) | s[1:].astype(np.uint64)
        ordered = np.sort(keys)
        starts = _runs(ordered, least)
        if not len(starts):
            break
        counts = np.searchsorted(ordered, ordered[starts], side="right") - starts
        if len(starts) > n:
            starts = starts[np.argsort(-counts, kind="stable")[:n]]
        top = ordered[starts]
        # where each position's pair is among the chosen ones: by a hash, in which the more frequent pair wins a shared place
        mix = (lambda k: ((k * np.uint32(2654435761)) >> np.uint32(15)) & np.uint32(0xFFFF)) if narrow else (lambda k: (k * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48))
        place = np.zeros(1 << 16, dtype=np.int32)
        h = mix(top)
        place[h[::-1]] = np.arange(len(top), dtype=np.int32)[::-1]
        won = place[h] == np.arange(len(top))
        number = np.cumsum(won) - 1
        known = top[place]
        at = np.concatenate([a + np.flatnonzero(known[mix(keys[a : a + STEP])] == keys[a : a + STEP]) for a in range(0, len(keys), STEP)])
        # of overlapping finds every second one of a run goes, from the left
        run = np.flatnonzero(np.concatenate([[True], np.diff(at) != 1]))
        rank = np.arange(len(at)) - np.repeat(run, np.diff(np.concatenate([run, [len(at)]])))
        at = at[rank % 2 == 0]
        chosen = number[place[mix(keys[at])]]
        new = top[won]
        left.append((new >> new.dtype.type(16 if narrow else 32)).astype(np.int64))
        right.append((new & new.dtype.type(0xFFFF if narrow else 0xFFFFFFFF)).astype(np.int64))
        s[at] = (free + chosen).astype(np.uint32)
        stays = np.ones(len(s), dtype=bool)
        stays[at + 1] = False
        s = np.concatenate([s[a : a + STEP][stays[a : a + STEP]] for a in range(0, len(s), STEP)])
        free += len(new)
    none = np.zeros(0, dtype=np.int64)
    return Block(first, np.concatenate([none, *left]), np.concatenate([none, *right]), s.astype(np.int64), count=len(ids))


SHARDS = "pid int, no int, doc_ids {id}, n_tokens array<long>, total long, blocks array<binary>"


def write(docs: DataFrame, path: str, tokenizer: str, text: str = "text", doc_id: str = "doc_id", end_id: int = 1, block: int = BLOCK, shard: int = SHARD) -> None:
    """Writes the ids of docs to files under path, in ascending doc_id order."""
    spark = docs.sparkSession
    short_batches(spark)
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text")).repartitionByRange("id", "h").sortWithinPartitions("id", "h").select("id", "text")
    schema = T._parse_datatype_string(SHARDS.format(id=T.ArrayType(docs.schema[doc_id].dataType).simpleString()))
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, pid = encoder(tokenizer), TaskContext.get().partitionId()
        end = np.asarray([end_id], dtype=e.kind).tobytes()
        width, no = len(end), 0
        ids, sizes, parts = [], [], []

        def flushed() -> pa.RecordBatch:
            stream = np.frombuffer(b"".join(parts), dtype=e.kind)
            blocks = [re_pair(stream[a : a + block], e.size).pack() for a in range(0, len(stream), block)]
            return pa.RecordBatch.from_pydict({"pid": [pid], "no": [no], "doc_ids": [ids], "n_tokens": [sizes], "total": [sum(sizes)], "blocks": [blocks]}, schema=arrow)

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                own = batch.slice(at, 1000)
                for i, b in zip(own.column(0).to_pylist(), e.encode(own.column(1).to_pylist()), strict=True):
                    ids.append(i)
                    parts.append(b + end)
                    sizes.append(len(b) // width + 1)
                if sum(sizes) >= shard:
                    yield flushed()
                    no, ids, sizes, parts = no + 1, [], [], []
        if ids:
            yield flushed()

    rows.mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)


def starts(shards: DataFrame) -> DataFrame:
    """(pid, no, first): ids before each shard."""
    from pyspark.sql import Window

    sums = sorted((r["pid"], r["n"]) for r in shards.groupBy("pid").agg(F.sum("total").alias("n")).collect())  # a row for each partition written
    base, rows = 0, []
    for pid, n in sums:
        rows.append((pid, base))
        base += n
    bases = shards.sparkSession.createDataFrame(rows, "pid int, base long")
    before = F.coalesce(F.sum("total").over(Window.partitionBy("pid").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return shards.select("pid", "no", "total").withColumn("before", before).join(bases, "pid").select("pid", "no", (F.col("base") + F.col("before")).alias("first"))


def read(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def documents(shards: DataFrame) -> DataFrame:
    """(pid, no, doc_id, offset in the shard, n_tokens, ids_crc32) of each document, from the stored ids."""
    kind = shards.schema["doc_ids"].dataType.elementType
    schema = T.StructType([*(shards.schema[x] for x in ("pid", "no")), T.StructField("doc_id", kind), *(T.StructField(x, T.LongType()) for x in ("offset", "n_tokens", "ids_crc32"))])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                pid, no, ids, sizes, blocks = (batch.column(c)[r].as_py() for c in range(5))
                raw = memoryview(b"".join(Block.unpack(b).decode().tobytes() for b in blocks))
                ends = np.concatenate([[0], np.cumsum(sizes)]).tolist()
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                n = len(ids)
                yield pa.RecordBatch.from_pydict({"pid": [pid] * n, "no": [no] * n, "doc_id": ids, "offset": ends[:-1], "n_tokens": sizes, "ids_crc32": crcs}, schema=arrow)

    return shards.select("pid", "no", "doc_ids", "n_tokens", "blocks").mapInArrow(run, schema)


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    spark = docs.sparkSession
    path = shared_dir(spark, "token-files")
    write(docs, path, tokenizer)
    shards = read(spark, path)
    return documents(shards).join(starts(shards), ["pid", "no"]).select("doc_id", (F.col("first") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
