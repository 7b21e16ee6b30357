"""Suggestions for names that aren't known: the most similar known ones (ratio of matching blocks, at least CUTOFF)."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .retrieval import top_each

CUTOFF, MOST = 0.5, 5
#: Names that hold a letter, for each salt that it gets.
PER_SALT = 20_000


def letters(name: Column) -> Column:
    """A name's letters, numbered where they repeat: two names share as many of these as the matching blocks can hold at most."""
    return F.aggregate(
        F.filter(F.split(name, ""), lambda c: c != ""), F.array().cast("array<string>"),
        lambda own, c: F.concat(own, F.array(F.concat(c, F.size(F.filter(own, lambda x: F.substring(x, 1, 1) == c)).cast("string")))),
    )


def _first(own: str, cutoff: float) -> Column:
    """How many letters of a name, in an order that holds for all, must hold one that a similar name has among its first ones."""
    n = F.size(own)
    return n - F.ceil(n * F.lit(cutoff / (2 - cutoff)) - F.lit(1e-9)).cast("int") + 1


def candidates(asked: DataFrame, names: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """(asked, name): all pairs whose letters allow the ratio. Of two such names the first letters (the rarest come first) meet; each pair counts at the first that they share."""
    rows = names.select("name", letters(F.col("name")).alias("own"))
    known = rows.select("name", F.explode("own").alias("t"))
    often = known.groupBy("t").agg(F.count(F.lit(1)).alias("n"))

    def ranked(df: DataFrame, key: str) -> DataFrame:
        each = df.select(key, F.explode("own").alias("t")).join(often, "t", "left").select(key, F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("t")).alias("o"))
        out = each.groupBy(key).agg(F.array_sort(F.collect_list("o")).alias("o"))
        return out.select(key, F.transform("o", lambda x: x["t"]).alias("own"), "o").select(key, "own", F.explode(F.slice("o", F.lit(1), _first("own", cutoff))).alias("p"))

    salts = F.greatest(F.lit(1), F.ceil(F.col("p.n") / PER_SALT))
    left = ranked(asked.select("asked", letters(F.col("asked")).alias("own")), "asked").select("asked", F.col("own").alias("a"), F.col("p.t").alias("t"), F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"))
    right = ranked(rows, "name").select("name", F.col("own").alias("b"), F.col("p.t").alias("t"), F.pmod(F.xxhash64("name"), salts).alias("salt"))
    n, m = F.size("a"), F.size("b")
    met = left.join(right, ["t", "salt"]).filter(2 * F.least(n, m) >= cutoff * (n + m))
    first = F.array_intersect(F.slice("a", F.lit(1), _first("a", cutoff)), F.slice("b", F.lit(1), _first("b", cutoff)))
    return met.filter((first[0] == F.col("t")) & (2 * F.size(F.array_intersect("a", "b")) >= cutoff * (n + m) - 1e-9)).select("asked", "name")


def suggest(asked: DataFrame, names: DataFrame, most: int = MOST, cutoff: float = CUTOFF) -> DataFrame:
    """asked (asked), names (name), each once: (asked, name, score, rank), the best of each, ties to the smaller name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if (r := SequenceMatcher(None, y, x).ratio()) >= cutoff:
                    rows.append((x, y, round(r, 6)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.float64()))], names=["asked", "name", "score"])

    scored = candidates(asked, names, cutoff).mapInArrow(run, "asked string, name string, score double")
    return top_each(scored, "asked", "name", most)
