"""Connected components of an edge table, by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthspan.session import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) -> (id, component): every id of an edge with the smallest id that it reaches.

    Each round hangs the larger neighbours of every node on its smallest neighbour, then the smaller ones; it ends when every
    component is one star around its smallest id. Minima are combined before the shuffle; nothing is gathered.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = checkpointed(e)
    while not stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        # what had another neighbour below it hangs on its smallest one too
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = checkpointed(small)
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def stars(e: DataFrame) -> bool:
    """Every u hangs on one v, which is smaller and hangs on none."""
    ends = e.select(F.col("u").alias("id"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(e.select(F.col("v").alias("id"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    odd = ends.groupBy("id").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).where("hangs > 1 OR (hangs = 1 AND holds = 1)")
    return odd.isEmpty()
