"""Nearest-sale joins and neighbourhood medians that never pair whole groups.

Distance depends on the place alone, so places are paired, not sales: a place passes on at most k
sales, and only the places that can still hold one of the k nearest are opened.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hearthspan.functions.rank import first_k, value_slab, with_previous
from hearthspan.operators.spatial import haversine, within_km
from hearthspan.session import checkpointed

RINGS_KM = (1.0, 4.0, 16.0, 25_000.0)


def _beds_near(df: DataFrame) -> DataFrame:
    """One row per bedroom count within one of the subject's."""
    return df.withColumn("c_beds", F.explode(F.array(F.col("beds") - 1, F.col("beds"), F.col("beds") + 1)))


def nearest_places(asks: DataFrame, stock: DataFrame, k: int, rings=RINGS_KM) -> DataFrame:
    """Places to open for each ask (place, segment, beds) so that k sales are certain to be in them.

    asks(place, lat, lon, segment, beds); stock(place, r_lat, r_lon, segment, beds, n). Asks that find
    fewer than k sales inside a ring go on to the next; the last ring is the whole world.
    """
    opened, left = [], asks
    spots = stock.select(F.col("place").alias("c_place"), "r_lat", "r_lon").distinct()
    held = stock.select(F.col("place").alias("c_place"), F.col("segment").alias("c_segment"), F.col("beds").alias("c_beds"), "n")
    for number, km in enumerate(rings):
        near = within_km(left.select("place", "lat", "lon").distinct(), spots, km, distance=haversine, max_lat=60.0 if km < 1000 else 0.0)
        j = _beds_near(left).join(near.select("place", "c_place", "km"), "place").join(held, ["c_place", "c_beds"]).where(F.col("segment") == F.col("c_segment"))
        per = j.groupBy("place", "segment", "beds", "c_place", "km").agg(F.sum("n").alias("n"))
        ask = W.partitionBy("place", "segment", "beds")
        per = per.withColumn("ahead", F.sum("n").over(ask.orderBy("km", "c_place")) - F.col("n")).withColumn("all_n", F.sum("n").over(ask))
        last = number == len(rings) - 1
        # settled rings are written once, so that later rings do not compute them again
        done = checkpointed((per if last else per.where(F.col("all_n") >= k)).where(F.col("ahead") < k).select("place", "segment", "beds", "c_place", "km"))
        opened.append(done)
        if last:
            break
        left = checkpointed(left.join(done.select("place", "segment", "beds").distinct(), ["place", "segment", "beds"], "left_anti"))
        if left.isEmpty():
            break
    return reduce(DataFrame.unionByName, opened)


def knn_sales(subjects: DataFrame, pool: DataFrame, k: int, own: bool = False, rings=RINGS_KM) -> DataFrame:
    """k nearest pool sales of the same segment and bedrooms within one, nearest place first, then newest.

    subjects(subject, place, lat, lon, segment, beds[, address_key]); pool(address_key, place, r_lat,
    r_lon, segment, beds, sale_date, price, area, tie1, tie2, tie3). With `own`, the subject's own
    address is left out: a place keeps k sales per address and 2k in all, enough for any one exclusion; and as
    the own address holds at most k sales under each of three bedroom counts, places are opened for 4k sales.
    What is near is listed once for each (place, segment, beds): its k first, or 4k with `own`; a subject reads its list, less its own address.
    """
    order = [F.desc("sale_date"), "tie1", "tie2", "tie3", "price"]
    cell = ["place", "segment", "beds"]
    want = 2 * k if own else k
    kept = first_k(pool, [*cell, "address_key"], order, k, "_q").drop("_q") if own else pool
    kept = first_k(kept, cell, order, want, "_q").drop("_q")
    stock = kept.groupBy(*cell, "r_lat", "r_lon").agg(F.count(F.lit(1)).alias("n"))
    asks = subjects.select("place", "lat", "lon", "segment", "beds").distinct()
    most = 4 * k if own else k
    opened = nearest_places(asks, stock, most, rings)
    c = kept.select(F.col("place").alias("c_place"), F.col("segment").alias("c_segment"), F.col("beds").alias("c_beds"), F.col("address_key").alias("c_address"),
                    F.col("sale_date").alias("c_date"), F.col("price").alias("c_price"), F.col("area").alias("c_area"), F.col("tie1").alias("c_tie1"), F.col("tie2").alias("c_tie2"), F.col("tie3").alias("c_tie3"))
    j = _beds_near(asks.select(*cell).distinct()).join(opened, cell).join(c, ["c_place", "c_beds"]).where(F.col("segment") == F.col("c_segment"))
    near = first_k(j, cell, ["km", "c_place", F.desc("c_date"), "c_beds", "c_tie1", "c_tie2", "c_tie3", "c_price"], most)
    held = [x for x in near.columns if x not in (*cell, "rank")]
    lists = near.groupBy(*cell).agg(F.sort_array(F.collect_list(F.struct("rank", *held))).alias("_near"))  # `most` sales at most
    found = F.filter("_near", lambda x: x["c_address"] != F.col("address_key")) if own else F.col("_near")
    rows = subjects.join(lists, cell).select(*subjects.columns, F.posexplode(F.slice(found, 1, k)).alias("_at", "_found"))
    return rows.select(*subjects.columns, *[F.col(f"_found.{x}").alias(x) for x in held], (F.col("_at") + 1).alias("rank"))


def knn_before(subjects: DataFrame, pool: DataFrame, k: int, days: int = 1460, km: float = 1.0) -> DataFrame:
    """k nearest sales strictly before the subject's date and within `days`, inside `km`.

    Sales of a place are numbered by date. The subject's date maps to two positions in that order (one
    window over the days of a place), and the newest k between them are fetched by number.
    """
    cell = ["place", "segment", "beds"]
    numbered = with_previous(pool, cell, ["sale_date", "tie1", "tie2", "tie3", "price"], ["price"], ordinal="no")
    held = pool.groupBy(*cell, F.col("sale_date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    spots = pool.select(F.col("place").alias("c_place"), "r_lat", "r_lon").distinct()
    near = within_km(subjects.select("place", "lat", "lon").distinct(), spots, km, distance=haversine)
    asks = _beds_near(subjects.select("place", "segment", "beds", "sale_date").distinct()).join(near.select("place", "c_place", "km"), "place")
    asks = asks.join(pool.select(F.col("place").alias("c_place"), F.col("segment"), F.col("beds").alias("c_beds")).distinct(), ["c_place", "segment", "c_beds"])
    due = asks.select(F.col("c_place").alias("place"), "segment", F.col("c_beds").alias("beds"), F.explode(F.array("sale_date", F.date_sub("sale_date", days))).alias("day")).distinct()
    line = held.unionByName(due.withColumn("n", F.lit(None).cast("bigint")))
    before = W.partitionBy(*cell).orderBy("day").rangeBetween(W.unboundedPreceding, -1)
    # one row per day of a place: bounded by the calendar
    at = line.withColumn("day_no", F.datediff("day", F.lit("1970-01-01").cast("date"))).withColumn(
        "upto", F.coalesce(F.sum("n").over(W.partitionBy(*cell).orderBy("day_no").rangeBetween(W.unboundedPreceding, -1)), F.lit(0))).where("n IS NULL")
    at = at.select(F.col("place").alias("c_place"), "segment", F.col("beds").alias("c_beds"), "day", "upto")
    hi = at.withColumnsRenamed({"day": "sale_date", "upto": "hi"})
    lo = at.withColumnsRenamed({"upto": "lo"})
    span = asks.join(hi, ["c_place", "segment", "c_beds", "sale_date"]).withColumn("day", F.date_sub("sale_date", days)).join(lo, ["c_place", "segment", "c_beds", "day"])
    first = F.greatest(F.col("lo"), F.col("hi") - k) + 1
    nos = span.where(F.col("hi") >= first).select("place", "segment", "beds", "sale_date", "c_place", "c_beds", "km", F.explode(F.sequence(first, F.col("hi"))).alias("no"))
    c = numbered.select(F.col("place").alias("c_place"), "segment", F.col("beds").alias("c_beds"), "no", F.col("sale_date").alias("c_date"), F.col("price").alias("c_price"), F.col("area").alias("c_area"))
    found = first_k(nos.join(c, ["c_place", "segment", "c_beds", "no"]), ["place", "segment", "beds", "sale_date"], ["km", "c_place", F.desc("c_date"), "c_beds", F.desc("no")], k)
    return subjects.join(found.drop("no"), ["place", "segment", "beds", "sale_date"])


def neighbourhood_median(values: DataFrame, near: DataFrame, upper: bool = False) -> DataFrame:
    """(subject, n, mid): median of `v` over all places near each subject, interpolated or upper.

    values(place, v); near(subject, place). Counts per value slab are joined first; only the one or two
    slabs that hold the middle are then opened, so values are not repeated per subject.
    """
    v = values.withColumn("slab", value_slab(F.col("v")))
    tall = v.groupBy("place", "slab", "v").agg(F.count(F.lit(1)).alias("c"))
    slabs = tall.groupBy("place", "slab").agg(F.sum("c").alias("c"))
    seen = near.join(slabs, "place").groupBy("subject", "slab").agg(F.sum("c").alias("c"))
    w = W.partitionBy("subject")
    seen = seen.withColumn("n", F.sum("c").over(w)).withColumn("before", F.sum("c").over(w.orderBy("slab")) - F.col("c"))
    high = F.floor(F.col("n") / 2)
    low = high if upper else F.floor((F.col("n") - 1) / 2)
    holds = lambda at: (at >= F.col("before")) & (at < F.col("before") + F.col("c"))
    at = seen.where(holds(low) | holds(high)).select("subject", "slab", "n", "before")
    inside = near.join(at, "subject").join(tall, ["place", "slab"]).groupBy("subject", "slab", "n", "before", "v").agg(F.sum("c").alias("c"))
    inside = inside.withColumn("before", F.col("before") + F.sum("c").over(W.partitionBy("subject", "slab").orderBy("v")) - F.col("c"))
    pick = lambda at: F.max(F.when(holds(at), F.col("v")))
    return inside.groupBy("subject", "n").agg(((pick(low) + pick(high)) / 2).alias("mid"))


def neighbourhood_upper_median(values: DataFrame, near: DataFrame, least: int) -> DataFrame:
    """Upper median over the neighbourhood, NULL under `least` values."""
    got = neighbourhood_median(values, near, upper=True)
    return got.select("subject", "n", F.when(F.col("n") >= least, F.col("mid")).alias("mid"))


def weighted_quantiles(rows: DataFrame, key: str, value: str, weight: str, shares=(0.25, 0.5, 0.75)) -> DataFrame:
    """First value whose running share of the weight reaches each share.

    Weights are tallied per value and cut into value slabs, so only slab totals are ordered per key.
    """
    tall = rows.groupBy(key, F.col(value).alias("v")).agg(F.sum(weight).alias("w")).withColumn("slab", value_slab(F.col("v")))
    across = W.partitionBy(key)
    slabs = tall.groupBy(key, "slab").agg(F.sum("w").alias("sw"))
    slabs = slabs.select(key, "slab", F.sum("sw").over(across).alias("total"), (F.sum("sw").over(across.orderBy("slab")) - F.col("sw")).alias("base"))
    inside = W.partitionBy(key, "slab").orderBy("v")
    run = tall.join(slabs, [key, "slab"]).withColumn("run", (F.col("base") + F.sum("w").over(inside)) / F.col("total"))
    # a hair of slack: the running sums of slabs and of one long list may differ in the last bit
    return run.groupBy(key).agg(*[F.min(F.when(F.col("run") >= q - 1e-12, F.col("v"))).alias(f"q{int(q * 100)}") for q in shares])
