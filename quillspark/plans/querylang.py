"""Free text to phrases: what a search looks for, as rows that plans can join."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..errors import QueryError

# Words that carry no meaning of their own in a question.
STOP_WORDS = frozenset(
    """
    a about after all also am an and any are as at be because been before being both
    but by can could did do does doing during each else for from had has have having
    he her here hers him his how i if in into is it its itself just me might more most
    must my no nor not of on once only or other our ours she should so some such than
    that the their theirs them then there these they this those through to too until
    us very was way we were what when where which while who whom whose why will with
    would you your yours
    """.split()
)
PREFIX_CHARS = 3
QUOTED = re.compile(r'"([^"]*)"')
RUN = re.compile(r"[^\W_]+")
ENDS_PHRASE = frozenset(",;.?!:)")


@dataclass(frozen=True)
class Phrase:
    """Tokens in a row. role: any (one of these must match), all (must match), none (must not). prefix: the last token may go on."""

    tokens: tuple[str, ...]
    role: str
    prefix: bool = False

    @property
    def scores(self) -> bool:
        return self.role != "none"


def words(text: str) -> list[str]:
    return [w.lower() for w in RUN.findall(text)]


def _quoted(text: str) -> tuple[list[tuple[str, ...]], str]:
    """Quoted phrases of several words, and the text without them; a quoted word and a lone quote are ordinary text."""
    phrases = []
    kept = []
    last = 0
    for m in QUOTED.finditer(text):
        inner = tuple(words(m.group(1)))
        kept += [text[last : m.start()], " " if len(inner) > 1 else f" {m.group(1)} "]
        if len(inner) > 1:
            phrases.append(inner)
        last = m.end()
    return phrases, "".join([*kept, text[last:]]).replace('"', " ")


def parse(text: str | None, most: int | None = None) -> list[Phrase]:
    """The phrases of a search text; QueryError if nothing is left to look for.

    Words are alternatives, as they stand and as beginnings of longer words; neighbours form pairs. Quoted phrases must match,
    -words must not. Stop words go, unless there is nothing else. The whole text counts; most: a bound on words and on pairs.
    """
    if not text or not text.strip():
        raise QueryError("the search text is empty")
    phrases, rest = _quoted(text)
    excluded: dict[str, None] = {}
    runs: list[list[str]] = [[]]  # words that are neighbours
    for chunk in rest.split():
        if chunk[0] == "-" and RUN.match(chunk, 1):
            excluded.update(dict.fromkeys(words(chunk[1:])))
            runs.append([])
            continue
        runs[-1] += words(chunk)
        if chunk[-1] in ENDS_PHRASE:
            runs.append([])
    if not all(w in STOP_WORDS for run in runs for w in run):
        split: list[list[str]] = []
        for run in runs:
            split.append([])
            for w in run:
                if w in STOP_WORDS:
                    split.append([])
                else:
                    split[-1].append(w)
        runs = split
    terms = list(dict.fromkeys(w for run in runs for w in run))[:most]
    pairs = list(dict.fromkeys(p for run in runs for p in zip(run, run[1:], strict=False) if p[0] != p[1]))[:most]
    out = []
    for t in terms:
        out.append(Phrase((t,), "any"))
        if len(t) >= PREFIX_CHARS and not t.isdigit():
            out.append(Phrase((t,), "any", prefix=True))
    out += [Phrase(p, "any") for p in pairs]
    out += [Phrase(p, "all") for p in phrases]
    if not out:
        raise QueryError("the search text has no search terms (only exclusions or punctuation)")
    return out + [Phrase((w,), "none") for w in excluded]


def clean_tags(tags) -> list[str]:
    """Tags as they are stored: without #, in lower case, sorted, once each."""
    parts = tags.split(",") if isinstance(tags, str) else list(tags or ())
    return sorted({t for t in (p.strip().lstrip("#").lower() for p in parts) if t})
