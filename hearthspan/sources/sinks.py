"""Keyed writes expressed as new versions of a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthspan.functions.rank import newest


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row per key over both; on equal order the new side wins."""
    both = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)))
    return newest(both, keys, [*order, "_side"]).drop("_side")


def upsert_coalesce(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New values win, but a NULL in the new row never wipes the old value."""
    rest = [c for c in old.columns if c not in keys]
    n = new.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in rest])
    return old.join(n, keys, "full_outer").select(*keys, *[F.coalesce(f"_n_{c}", c).alias(c) for c in rest])


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Append only unseen keys, one row each: replaying a batch changes nothing."""
    fresh = newest(new, keys, order, oldest=True).select(*new.columns)
    return old.unionByName(fresh.join(old.select(*keys), keys, "left_anti").select(*old.columns))


def replace_group(df: DataFrame, path: str, by: str) -> None:
    """Rewrite only the partitions present in `df`."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def split_dimensions(wide: DataFrame, key: str, dims: list[str]) -> DataFrame:
    """One row per (key, dimension); a missing value is stored as a no-data marker, not dropped."""
    parts = ", ".join(f"'{d}', CAST({d} AS DOUBLE)" for d in dims)
    long = wide.select(key, F.expr(f"stack({len(dims)}, {parts}) AS (dimension, score)"))
    return long.withColumn("status", F.when(F.col("score").isNull(), "no_data").otherwise("ok"))


def join_dimensions(long: DataFrame, key: str, dims: list[str]) -> DataFrame:
    return long.groupBy(key).pivot("dimension", dims).agg(F.max("score"))


def dimension_lines(long: DataFrame, key: str) -> DataFrame:
    """One JSON line per (key, dimension) and one summary line per key."""
    each = long.select(F.to_json(F.struct(F.lit("dimension").alias("event"), key, "dimension", "score", "status")).alias("value"))
    total = long.groupBy(key).agg(F.count(F.lit(1)).alias("dimensions"), F.count("score").alias("scored"))
    return each.unionByName(total.select(F.to_json(F.struct(F.lit("summary").alias("event"), key, "dimensions", "scored")).alias("value")))


def assemble(docs: DataFrame, key: str, core: list[str], version: str, as_of) -> DataFrame:
    """Per key whether every core dimension is present, unexpired and at the version; partial otherwise.

    docs(key, dimension, data_version, created_on, expires_on): the newest row of a dimension counts.
    """
    live = docs.where((F.col("data_version") == version) & (F.col("expires_on") > as_of))
    latest = live.groupBy(key, "dimension").agg(F.max_by(F.struct("created_on", "expires_on"), F.struct("created_on", "expires_on")).alias("r"))
    has = reduce(lambda a, b: a + b, [F.max((F.col("dimension") == d).cast("int")) for d in core])
    g = latest.groupBy(key).agg(has.alias("held"), F.min("r.created_on").alias("oldest"), F.min("r.expires_on").alias("earliest_expiry"))
    hit = F.col("held") == len(core)
    return g.select(key, hit.cast("int").alias("hit"), ((F.col("held") > 0) & ~hit).cast("int").alias("partial"), F.when(hit, F.col("oldest")).alias("oldest"), F.when(hit, F.col("earliest_expiry")).alias("earliest_expiry"))
