"""The Porter stemmer and diacritic folding, applied to vocabularies rather than texts: their cost is that of the distinct words."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# The published algorithm's endings and what they become, longest first within a step.
STEP_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

MEASURE = re.compile("V+C+")


def fold(word: str) -> str:
    """Lower case, without diacritics."""
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if unicodedata.category(c) != "Mn")


def _shape(word: str) -> str:
    """V for each vowel, C for each consonant; y is a vowel after a consonant."""
    out = ""
    for c in word:
        out += "V" if c in "aeiou" or (c == "y" and out.endswith("C")) else "C"
    return out


def _measure(stem: str) -> int:
    return len(MEASURE.findall(_shape(stem)))


def _cvc(word: str) -> bool:
    return _shape(word).endswith("CVC") and word[-1] not in "wxy"


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def porter(word: str) -> str:
    if len(word) < 3 or not word.isascii():
        return word
    w = word
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]

    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        cut = next((w[: -len(e)] for e in ("ed", "ing") if w.endswith(e) and "V" in _shape(w[: -len(e)])), None)
        if cut is not None:
            w = cut
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "C" and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _cvc(w):
                w += "e"

    if w.endswith("y") and "V" in _shape(w[:-1]):
        w = w[:-1] + "i"

    for table in (STEP_2, STEP_3):
        e = _longest(w, table)
        if e and _measure(w[: -len(e)]) > 0:
            w = w[: -len(e)] + table[e]

    e = _longest(w, STEP_4)
    if e and _measure(w[: -len(e)]) > 1 and (e != "ion" or w[: -len(e)].endswith(("s", "t"))):
        w = w[: -len(e)]

    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


def analyzed(word: str) -> str:
    return porter(fold(word))


def stemmed_vocabulary(vocabulary: DataFrame, term: str = "term") -> DataFrame:
    """vocabulary (term) with each term's stem."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if w is None else analyzed(w) for w in words], pa.string())], names=["term", "stem"])

    return vocabulary.select(term).mapInArrow(run, "term string, stem string")
