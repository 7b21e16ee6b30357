"""Incremental maintenance: what changed between what is found and what is indexed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def changes(found: DataFrame, indexed: DataFrame) -> DataFrame:
    """(path, id, change) by one full outer join on the path.

    found: path, id, hash; indexed: path, id, hash. added, updated, removed, unchanged; a path whose id is another now is removed
    under the old id and added under the new one.
    """
    f, i = found.select("path", F.col("id").alias("new"), F.col("hash").alias("new_hash")), indexed.select("path", F.col("id").alias("old"), F.col("hash").alias("old_hash"))
    both = f.join(i, "path", "full_outer")
    kind = (
        F.when(F.col("old").isNull(), F.array(F.struct(F.col("new").alias("id"), F.lit("added").alias("change"))))
        .when(F.col("new").isNull(), F.array(F.struct(F.col("old").alias("id"), F.lit("removed").alias("change"))))
        .when(F.col("new") != F.col("old"), F.array(F.struct(F.col("old").alias("id"), F.lit("removed").alias("change")), F.struct(F.col("new").alias("id"), F.lit("added").alias("change"))))
        .otherwise(F.array(F.struct(F.col("new").alias("id"), F.when(F.col("new_hash").eqNullSafe(F.col("old_hash")), "unchanged").otherwise("updated").alias("change"))))
    )
    return both.select("path", F.explode(kind).alias("c")).select("path", "c.id", "c.change")


def owners(found: DataFrame, indexed: DataFrame | None = None) -> DataFrame:
    """found (path, id, seq) with kept, the path that owns its id: one that is indexed under it already, or else the first found."""
    rank = F.lit(1)
    rows = found
    if indexed is not None:
        held = indexed.select("path", "id").withColumn("__held", F.lit(True))
        rows, rank = found.join(held, ["path", "id"], "left"), F.when(F.col("__held"), 0).otherwise(1)
    order = Window.partitionBy("id").orderBy(rank, "seq", "path")
    return rows.withColumn("kept", F.first("path").over(order)).drop("__held")


def merged(old: DataFrame, fresh: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """old without the keys that are gone or fresh, and the fresh rows."""
    out = gone.select(key).unionByName(fresh.select(key)).distinct()
    return old.join(out, key, "left_anti").unionByName(fresh)
