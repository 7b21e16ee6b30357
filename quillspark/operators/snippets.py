"""Snippets: the window of a text that covers most of a search, made after the top-k, so for few rows."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..plans.querylang import Phrase

WINDOW = 24
TOKEN = re.compile(r"[^\W_]+")


def snippet(text: str, phrases: Sequence[Phrase], window: int = WINDOW, analyze=str.lower) -> str:
    """At most `window` tokens around the most phrases, hits in **; its beginning if nothing is hit."""
    spans = [m.span() for m in TOKEN.finditer(text)]
    words = [analyze(text[a:b]) for a, b in spans]
    hits = []  # first token, one past the last, phrase
    for n, p in enumerate(phrases):
        want = [analyze(t) for t in p.tokens]
        for i in range(len(words) - len(want) + 1):
            own = words[i : i + len(want)]
            if own[:-1] == want[:-1] and (own[-1].startswith(want[-1]) if p.prefix else own[-1] == want[-1]):
                hits.append((i, i + len(want), n))
    hits.sort()
    begin, best = 0, (-1, 0)
    for first, _, _ in hits:
        inside = [h for h in hits if first <= h[0] and h[1] <= first + window]
        worth = (len({h[2] for h in inside}) * 1000 + len(inside), -first)
        if worth > best:
            begin, best = first, worth
    if hits:  # the hits stand in the middle where there is room
        last = max(h[1] for h in hits if begin <= h[0] and h[1] <= begin + window)
        begin = max(0, min(begin - (window - (last - begin)) // 2, len(words) - window))
    end = min(len(words), begin + window)
    marked: list[list[int]] = []
    for a, b, _ in hits:
        if begin <= a and b <= end:
            if marked and a <= marked[-1][1]:
                marked[-1][1] = max(b, marked[-1][1])
            else:
                marked.append([a, b])
    if not words:
        return " ".join(text.split())
    start = spans[begin][0] if begin else 0
    stop = spans[end - 1][1] if end < len(words) else len(text)
    out, at = "", start
    for a, b in marked:
        out += text[at : spans[a][0]] + "**" + text[spans[a][0] : spans[b - 1][1]] + "**"
        at = spans[b - 1][1]
    out += text[at:stop]
    return ("…" if begin else "") + " ".join(out.split()) + ("…" if end < len(words) else "")


def snippets(rows: DataFrame, column: str, phrases: Sequence[Phrase]) -> DataFrame:
    """rows with a snippet of the column."""
    at = rows.columns.index(column)
    schema = T.StructType([*rows.schema.fields, T.StructField("snippet", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [snippet(t or "", phrases) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)
