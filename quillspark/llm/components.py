"""Connected components of a distributed edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _large_star(e: DataFrame) -> DataFrame:
    """Each node ties its larger neighbours to the least node that it sees."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Each node ties itself and its smaller neighbours to the least of them."""
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (u, v) to (node, root): root is the least node of the component. Nodes without edges are not in it.

    Every round is written to the shared folder; it ends when a round changes nothing. Rounds grow with the logarithm of the longest way between two
    nodes; should `rounds` not be enough, it raises an error.
    """
    e = stored(edges.select("u", "v").filter("u <> v").distinct(), "cc")
    mark = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    before = e.agg(mark.alias("m")).first()["m"]
    for _ in range(rounds):
        if not before[0]:
            break
        e = stored(_small_star(_large_star(e)), "cc")
        now = e.agg(mark.alias("m")).first()["m"]
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components: no end after {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
