"""Exact order statistics and running totals that never gather a whole group.

A group may hold a third of all rows, so none of these sorts a group in one task.
Values are tallied map-side, the tally is cut into narrow value slabs, and only the
per-slab totals (a bounded number per group) are ordered across a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SLABS_PER_E = 64


def value_slab(value: Column, per_e: int = SLABS_PER_E) -> Column:
    """Monotone whole-number slab of a number, about 1.5 % of its magnitude wide down to 1e-15; a few thousand exist at most."""
    v = value.cast("double")
    size = F.when(F.abs(v) < 1e-15, 1).otherwise(F.floor((F.ln(F.abs(v)) + 36) * per_e))
    return F.when(v == 0, 0).when(v > 0, size).otherwise(-size).cast("int")


def same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality over `keys`."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys], F.lit(True))


def _positions(kind, n: Column) -> tuple[Column, Column, Column]:
    """Zero-based low and high positions and the fraction between them."""
    if kind == "median":
        kind = ("interp", 0.5)
    if kind == "upper":
        at = F.floor(n / 2)
        return at, at, F.lit(0.0)
    name, p = kind
    if name == "index":
        at = F.least(F.floor(n * F.lit(float(p))), n - 1)
        return at, at, F.lit(0.0)
    if name == "interp":
        exact = (n - 1) * F.lit(float(p))
        return F.floor(exact), F.ceil(exact), exact - F.floor(exact)
    raise ValueError(f"unknown quantile kind: {kind!r}")


def group_quantiles(df: DataFrame, keys: list[str], value: str, wanted: dict, count: str | None = "n") -> DataFrame:
    """Exact quantiles of `value` per group.

    `wanted` maps an output name to 'median' (interpolated), 'upper' (position n//2),
    ('index', p) (position min(int(n*p), n-1)) or ('interp', p). Also 'min', 'max', 'mean'.
    Nulls are dropped; a group with no value has no row.
    """
    keys = list(keys)
    tally = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_slab", value_slab(F.col("_v")))
    )
    group = W.partitionBy(*keys)
    slabs = (
        tally.groupBy(*keys, "_slab")
        .agg(
            F.sum("_c").alias("_sc"),
            F.sum(F.col("_v") * F.col("_c")).alias("_ss"),
            F.min("_v").alias("_smin"),
            F.max("_v").alias("_smax"),
        )
        .select(
            *keys,
            "_slab",
            "_sc",
            F.sum("_sc").over(group).alias("_n"),
            (F.sum("_sc").over(group.orderBy("_slab")) - F.col("_sc")).alias("_before"),
            F.sum("_ss").over(group).alias("_sum"),
            F.min("_smin").over(group).alias("_min"),
            F.max("_smax").over(group).alias("_max"),
        )
    )
    plain = {"min": F.col("_min"), "max": F.col("_max"), "mean": F.col("_sum") / F.col("_n")}
    ranked = {k: _positions(v, F.col("_n")) for k, v in wanted.items() if v not in plain}
    touched = F.lit(False)
    for low, high, _ in ranked.values():
        for at in (low, high):
            touched = touched | ((at >= F.col("_before")) & (at < F.col("_before") + F.col("_sc")))
    slabs = slabs.where(touched) if ranked else slabs
    slabs = slabs.withColumnsRenamed({k: f"_k_{k}" for k in keys} | {"_slab": "_slab2"})
    match = reduce(
        lambda a, b: a & b,
        [tally[k].eqNullSafe(slabs[f"_k_{k}"]) for k in keys],
        tally["_slab"] == slabs["_slab2"],
    )
    inside = W.partitionBy(*keys, "_slab").orderBy("_v")
    upto = F.col("_before") + F.sum("_c").over(inside)
    hits = tally.join(slabs, match).select(
        *keys, "_v", "_c", "_n", "_sum", "_min", "_max", upto.alias("_upto")
    )

    def at(position: Column) -> Column:
        held = (position < F.col("_upto")) & (position >= F.col("_upto") - F.col("_c"))
        return F.max(F.when(held, F.col("_v")))

    outs = [F.max("_n").alias("_n"), F.max("_sum").alias("_sum"), F.max("_min").alias("_min"), F.max("_max").alias("_max")]
    for name, (low, high, _) in ranked.items():
        outs += [at(low).alias(f"_lo_{name}"), at(high).alias(f"_hi_{name}")]
    found = hits.groupBy(*keys).agg(*outs) if keys else hits.agg(*outs).where(F.col("_n").isNotNull())
    finals = []
    for name, kind in wanted.items():
        if name in ranked:
            low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
            if kind == "upper" or (isinstance(kind, tuple) and kind[0] == "index"):
                finals.append(low.alias(name))
            else:
                finals.append((low * (1 - ranked[name][2]) + high * ranked[name][2]).alias(name))
        else:
            finals.append(plain[kind].alias(name))
    return found.select(*keys, *([F.col("_n").alias(count)] if count else []), *finals)


def tally_before(df: DataFrame, keys: list[str], value: str, weight: Column | None = None) -> DataFrame:
    """One row per (group, value): its own weight, the weight of smaller values, the group total."""
    keys = list(keys)
    w = F.lit(1) if weight is None else weight
    tally = (
        df.where(F.col(value).isNotNull())
        .withColumn("_w", w)
        .groupBy(*keys, value)
        .agg(F.sum("_w").alias("own"))
        .withColumn("_slab", value_slab(F.col(value)))
    )
    group = W.partitionBy(*keys)
    slabs = tally.groupBy(*keys, "_slab").agg(F.sum("own").alias("_so"))
    slabs = slabs.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_slab").alias("_slab2"),
        F.sum("_so").over(group).alias("total"),
        (F.sum("_so").over(group.orderBy("_slab")) - F.col("_so")).alias("_base"),
    )
    match = reduce(
        lambda a, b: a & b,
        [tally[k].eqNullSafe(slabs[f"_k_{k}"]) for k in keys],
        tally["_slab"] == slabs["_slab2"],
    )
    inside = W.partitionBy(*keys, "_slab").orderBy(value)
    return tally.join(slabs, match).select(
        *keys,
        value,
        "own",
        (F.col("_base") + F.sum("own").over(inside) - F.col("own")).alias("below"),
        "total",
    )


def newest(df: DataFrame, keys: list[str], order: list[str], oldest: bool = False) -> DataFrame:
    """The newest (or oldest) row per key as a map-side combined aggregate, not a sort per key."""
    rest = [c for c in df.columns if c not in keys]
    pick = (F.min_by if oldest else F.max_by)(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(pick.alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def with_previous(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    carry: list[str],
    *,
    prefix: str = "prev_",
    ordinal: str | None = None,
    most: int = 1_000_000,
) -> DataFrame:
    """Attach the preceding row's `carry` columns per key (and, if named, the row's ordinal).

    Keys of at most `most` rows are sorted as they are, which a table bucketed by the key does without a shuffle. Larger ones
    are cut by quarter of the first ordering column (a date, not null), so that no task sorts a whole key; the cuts are
    stitched through their last rows, one a quarter. Sizes are counted first, map-side; keys above the limit are few.
    """
    keys = list(keys)
    large = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > most)
    names = {k: f"_k_{k}" for k in keys}
    large = large.select(*[F.col(k).alias(n) for k, n in names.items()])
    if large.isEmpty():
        return _previous(df, keys, order, carry, prefix, ordinal, None)
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])
    small = _previous(df.join(large, match, "left_anti"), keys, order, carry, prefix, ordinal, None)
    return small.unionByName(_previous(df.join(large, match, "left_semi"), keys, order, carry, prefix, ordinal, F.date_trunc("quarter", order[0])))


def _previous(df: DataFrame, keys: list[str], order: list[str], carry: list[str], prefix: str, ordinal: str | None, cut: Column | None) -> DataFrame:
    """The pairing of `with_previous`, over whole keys or over keys cut by `cut`."""
    d = df if cut is None else df.withColumn("_cut", cut)
    by = keys if cut is None else [*keys, "_cut"]
    w = W.partitionBy(*by).orderBy(*order)
    d = d.withColumn("_prev", F.lag(F.struct(*carry)).over(w))
    if ordinal:
        d = d.withColumn("_ord", F.row_number().over(w))
    if cut is not None:
        edges = d.groupBy(*by).agg(F.max_by(F.struct(*carry), F.struct(*order)).alias("_last"), F.count(F.lit(1)).alias("_cn"))
        across = W.partitionBy(*keys).orderBy("_cut")
        edges = edges.select(
            *[F.col(c).alias(f"_e_{c}") for c in by],
            F.lag("_last").over(across).alias("_in"),
            (F.sum("_cn").over(across) - F.col("_cn")).alias("_ahead"),
        )
        d = d.join(edges, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_e_{c}")) for c in by])).withColumn("_prev", F.coalesce("_prev", "_in"))
    outs = [F.col(f"_prev.{c}").alias(f"{prefix}{c}") for c in carry]
    if ordinal:
        outs.append((F.col("_ord") + (F.col("_ahead") if cut is not None else F.lit(0))).alias(ordinal))
    return d.select(*df.columns, *outs)


def first_k(df: DataFrame, keys: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """First k rows per key. Spark prunes each map task to k rows per key before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)
