r"""Media columns: sniffing signatures, confirming structures, carving what is embedded.

An Aho-Corasick automaton finds all magic bytes of a binary value in one pass. At each find the format's validator
walks the structure (chunks, blocks, segments, header sizes, checksums) and gives the length; finds that it doesn't
confirm are dropped. What is confirmed at offset 0 is the value's type, whatever was declared; what is confirmed elsewhere is
embedded media, of which the outermost and, within containers, the parts are listed with offset and length.

`pack` stores a text losslessly as the samples of an 8-bit WAV file, zeros filling its bytes up to a positive multiple of 64; `unpack` reads the samples of
stored bytes back.

Limits: RIFF files count their bytes in 32 bits, so a text of 4 GB or more can't be packed and raises struct.error. Every gzip signature is inflated to its
end or its first error, so a value made to hold many overlapping streams costs as much as their sum; other validators read headers only.

Cases: null bytes have type null and nothing embedded; empty bytes and unknown ones are `application/octet-stream`; a null text is
packed as the empty one; repeated rows give equal results; an empty table gives no rows; other columns stay, but for
those that are added.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, stored

RATE = 8_000
UNKNOWN = "application/octet-stream"


def _png(b: bytes, at: int) -> int:
    p = at + 8
    first = True
    while p + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, p)
        if first and (kind != b"IHDR" or n != 13) or p + 12 + n > len(b):
            return 0
        if zlib.crc32(b[p + 4 : p + 8 + n]) != struct.unpack_from(">I", b, p + 8 + n)[0]:
            return 0
        p, first = p + 12 + n, False
        if kind == b"IEND":
            return p - at
    return 0


def _gif(b: bytes, at: int) -> int:
    if at + 13 > len(b):
        return 0
    flags = b[at + 10]
    p = at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)
    seen = False

    def blocks(p: int) -> int:
        while p < len(b) and b[p]:
            p += b[p] + 1
        return p + 1

    while p < len(b):
        if b[p] == 0x3B:
            return p + 1 - at if seen else 0
        if b[p] == 0x21:
            p = blocks(p + 2)
        elif b[p] == 0x2C and p + 10 <= len(b):
            local = b[p + 9]
            p = blocks(p + 10 + (3 << ((local & 7) + 1) if local & 0x80 else 0) + 1)
            seen = True
        else:
            return 0
    return 0


def _jpeg(b: bytes, at: int) -> int:
    p = at + 2
    while p + 4 <= len(b):
        if b[p] != 0xFF:
            return 0
        kind = b[p + 1]
        if kind == 0xFF:
            p += 1
            continue
        n = struct.unpack_from(">H", b, p + 2)[0]
        if n < 2 or not 0xC0 <= kind <= 0xFE or 0xD0 <= kind <= 0xD9:
            return 0
        p += 2 + n
        if kind == 0xDA:
            while (p := b.find(b"\xff", p)) >= 0 and p + 1 < len(b):
                if b[p + 1] == 0xD9:
                    return p + 2 - at
                if b[p + 1] and not 0xD0 <= b[p + 1] <= 0xD7:
                    break
                p += 2
            else:
                return 0
    return 0


def _riff(b: bytes, at: int) -> int:
    if at + 12 > len(b):
        return 0
    size, form = struct.unpack_from("<I4s", b, at + 4)
    end = at + 8 + size
    if end > len(b) or form not in (b"WAVE", b"WEBP", b"AVI "):
        return 0
    p, kinds = at + 12, set()
    while p + 8 <= end:
        kind, n = struct.unpack_from("<4sI", b, p)
        kinds.add(kind)
        p += 8 + n + (n & 1)
    if p not in (end, end + 1) or form == b"WAVE" and not {b"fmt ", b"data"} <= kinds:
        return 0
    return end - at


def _bmp(b: bytes, at: int) -> int:
    if at + 30 > len(b):
        return 0
    size, reserved, start, header = struct.unpack_from("<IIII", b, at + 2)
    width, height, planes, bits = struct.unpack_from("<iiHH", b, at + 18)
    if reserved or header not in (40, 108, 124) or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or width <= 0 or not height:
        return 0
    need = start + (width * bits + 31) // 32 * 4 * abs(height)
    return size if 14 + header <= start <= size and size <= len(b) - at and need <= size else 0


def _gzip(b: bytes, at: int) -> int:
    d = zlib.decompressobj(31)
    try:
        p = at
        while p < len(b) and not d.eof:
            d.decompress(b[p : p + 65536], 1 << 20)
            while d.unconsumed_tail:
                d.decompress(d.unconsumed_tail, 1 << 20)
            p += 65536
    except zlib.error:
        return 0
    return min(p, len(b)) - at - len(d.unused_data) if d.eof else 0


def _zip_ends(b: bytes) -> dict[int, int]:
    """Where an archive would begin, by its end record, and where that record ends; the first of several."""
    out: dict[int, int] = {}
    p = -1
    while (p := b.find(b"PK\x05\x06", p + 1)) >= 0:
        if p + 22 <= len(b):
            n, size, start, note = struct.unpack_from("<HIIH", b, p + 10)
            origin = p - size - start
            if n and origin >= 0 and p + 22 + note <= len(b) and b[origin + start : origin + start + 4] == b"PK\x01\x02":
                out.setdefault(origin, p + 22 + note)
    return out


class _Zip:
    """The validator of archives; a value's end records are looked for once, not at each of its local headers."""

    def __init__(self):
        self.of, self.ends = b"", {}

    def __call__(self, b: bytes, at: int) -> int:
        if self.of is not b:
            self.of, self.ends = b, _zip_ends(b)
        return self.ends[at] - at if self.ends.get(at, 0) > at else 0


_zip = _Zip()


def _pdf(b: bytes, at: int) -> int:
    if not b[at + 5 : at + 6].isdigit():
        return 0
    following = b.find(b"%PDF-", at + 5)
    p = b.rfind(b"%%EOF", at, following if following > 0 else len(b))
    return p + 5 - at if p > 0 and b.find(b"startxref", at, p) > 0 else 0


def _ogg(b: bytes, at: int) -> int:
    p = at
    while b[p : p + 5] == b"OggS\0" and p + 27 <= len(b):
        n = b[p + 26]
        last = b[p + 5] & 4
        p += 27 + n + sum(b[p + 27 : p + 27 + n])
        if p > len(b):
            return 0
        if last:
            return p - at
    return 0


def _pnm(b: bytes, at: int) -> int:
    head = b[at : at + 64].split(None, 4)
    if len(head) < 4 or not all(x.isdigit() for x in head[1:4]):
        return 0
    width, height, top = map(int, head[1:4])
    start = b.find(head[3], b.find(head[2], b.find(head[1], at + 2) + len(head[1])) + len(head[2])) + len(head[3]) + 1
    n = start - at + width * height * (3 if head[0] == b"P6" else 1) * (2 if top > 255 else 1)
    return n if width and height and 0 < top < 65536 and at + n <= len(b) else 0


#: Magic bytes, types and validators.
FORMATS = {
    b"\x89PNG\r\n\x1a\n": ("image/png", _png),
    b"GIF87a": ("image/gif", _gif),
    b"GIF89a": ("image/gif", _gif),
    b"\xff\xd8\xff": ("image/jpeg", _jpeg),
    b"RIFF": ("audio/wav", _riff),
    b"BM": ("image/bmp", _bmp),
    b"\x1f\x8b\x08": ("application/gzip", _gzip),
    b"PK\x03\x04": ("application/zip", _zip),
    b"%PDF-": ("application/pdf", _pdf),
    b"OggS": ("audio/ogg", _ogg),
    b"P5\n": ("image/x-portable-graymap", _pnm),
    b"P6\n": ("image/x-portable-pixmap", _pnm),
}
_RIFF = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/x-msvideo"}


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for magic in FORMATS:
        out.add_word(magic.decode("latin-1"), magic)
    out.make_automaton()
    return out


def sniff(value: bytes) -> tuple[str, int, list[tuple[str, int, int]]]:
    """Type, confirmed length (0 if unknown) and what is embedded: (type, offset, length)."""
    kind, size, inside = UNKNOWN, 0, []
    for last, magic in automaton().iter(value.decode("latin-1")):
        at = last - len(magic) + 1
        name, confirm = FORMATS[magic]
        n = confirm(value, at)
        if n:
            name = _RIFF[value[at + 8 : at + 12]] if magic == b"RIFF" else name
            if at == 0:
                kind, size = name, n
            else:
                inside.append((name, at, n))
    return kind, size, sorted(inside, key=lambda x: x[1])


SNIFFED = T.StructType([
    T.StructField("media_type", T.StringType()),
    T.StructField("media_length", T.LongType()),
    T.StructField("type_corrected", T.BooleanType()),
    T.StructField("embedded", T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())]))),
])


def inspect(table: DataFrame, media: str = "media", declared: str | None = None) -> DataFrame:
    """table with media_type (as found), media_length, type_corrected (the declared type was another) and embedded."""
    table = table.drop(*SNIFFED.names)
    at, said = table.columns.index(media), table.columns.index(declared) if declared else None

    def run(batch: pa.RecordBatch) -> dict:
        values = batch.column(at).to_pylist()
        found = [None if v is None else sniff(bytes(v)) for v in values]
        claims = batch.column(said).to_pylist() if said is not None else [None] * len(values)
        return dict(enumerate([
            *batch.columns, [f and f[0] for f in found], [f and f[1] for f in found],
            [None if f is None else c is not None and c != f[0] for f, c in zip(found, claims, strict=True)],
            [None if f is None else [{"type": a, "offset": b, "length": c} for a, b, c in f[2]] for f in found],
        ]))

    return map_arrow(table, run, T.StructType([*table.schema.fields, *SNIFFED.fields]))


def carve(inspected: DataFrame, media: str = "media") -> DataFrame:
    """A row for each embedded medium: the other columns, its type, offset, length and bytes."""
    part = F.col("__part")
    rest = [F.col(f"`{c}`") for c in inspected.columns if c not in (media, *SNIFFED.names)]
    rows = inspected.withColumn("__part", F.explode("embedded"))
    return rows.select(*rest, part["type"].alias("part_type"), part["offset"].alias("part_offset"), part["length"].alias("part_length"), F.substring(F.col(media), (part["offset"] + 1).cast("int"), part["length"].cast("int")).alias("part"))


def wav(samples: bytes) -> bytes:
    """An 8-bit mono WAV file of these samples."""
    pad = len(samples) & 1
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + pad, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples)) + samples + b"\0" * pad


def wav_samples(value: bytes) -> bytes:
    p = 12
    while p + 8 <= len(value):
        kind, n = struct.unpack_from("<4sI", value, p)
        if kind == b"data":
            return value[p + 8 : p + 8 + n]
        p += 8 + n + (n & 1)
    raise ValueError("no data chunk")


def pack(docs: DataFrame, text: str = "text", unit: int = 64) -> DataFrame:
    """docs with media (a WAV file of the text's padded bytes) instead of the text, n_bytes and declared_type."""
    docs = docs.drop("media", "n_bytes", "declared_type")
    at = docs.columns.index(text)

    def run(batch: pa.RecordBatch) -> dict:
        raw = [x or b"" for x in batch.column(at).cast(pa.binary()).to_pylist()]
        media = [wav(x + b"\0" * (-len(x) % unit if x else unit)) for x in raw]
        return dict(enumerate([*(c for i, c in enumerate(batch.columns) if i != at), media, [len(x) for x in raw], [UNKNOWN] * len(raw)]))

    fields = [f for f in docs.schema.fields if f.name != text]
    return map_arrow(docs, run, T.StructType([*fields, T.StructField("media", T.BinaryType()), T.StructField("n_bytes", T.LongType()), T.StructField("declared_type", T.StringType())]))


def described(value: bytes, found: tuple[str, int, list]) -> str:
    samples = np.frombuffer(wav_samples(value), dtype=np.uint8)
    counts = np.bincount(samples, minlength=256)
    p = counts[counts > 0] / len(samples)
    levels = np.arange(256)
    mean = counts @ levels / len(samples)
    spread = float(np.sqrt(max(0.0, counts @ (levels * levels) / len(samples) - mean * mean)))
    inside = ",".join(f"{a}@{b}+{c}" for a, b, c in found[2])
    return f"{found[0]};{RATE}Hz;8bit;samples={len(samples)};mean={mean:.4f};spread={spread:.4f};bits={-(p * np.log2(p)).sum() + 0.0:.4f};embedded=[{inside}]"


def digests(docs: DataFrame) -> DataFrame:
    """Each text packed, stored, read back and sniffed."""
    kept = stored(pack(docs.select("doc_id", "text")), "media").select("doc_id", "n_bytes", "media")

    def run(batch: pa.RecordBatch) -> dict:
        media = batch.column(2).to_pylist()
        found = [sniff(v) for v in media]
        for v, f in zip(media, found, strict=True):
            if f[0] != "audio/wav" or f[1] != len(v):
                raise ValueError("stored bytes are not the medium that was packed")
        samples = [wav_samples(v) for v in media]
        return dict(enumerate([
            batch.column(0), batch.column(1), [len(x) for x in samples], [hashlib.sha256(x).hexdigest() for x in samples], [zlib.crc32(x[-64:]) for x in samples],
            [len(v) for v in media], [hashlib.sha256(v).hexdigest() for v in media], [described(v, f) for v, f in zip(media, found, strict=True)],
        ]))

    id_field = docs.schema["doc_id"]
    long, text = T.LongType(), T.StringType()
    names = [("n_bytes", long), ("payload_bytes", long), ("payload_sha256", text), ("tail_crc32", long), ("media_bytes", long), ("media_sha256", text), ("feature", text)]
    return map_arrow(kept, run, T.StructType([id_field, *(T.StructField(n, t) for n, t in names)]))
