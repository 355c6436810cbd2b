"""Area scores: dimension scorers, calibration, totals, recalibration."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hearthspan.functions import curves
from hearthspan.functions.rank import first_k, group_quantiles
from hearthspan.operators.spatial import grid, haversine, within_km
from hearthspan.session import checkpointed

# Dimension weights of the total and of each dimension.
WEIGHTS = {"transport": 0.20, "community": 0.25, "environment": 0.20, "price": 0.25, "schools": 0.10}
DIMENSIONS = tuple(WEIGHTS)
# Percentiles of the breakpoints and the raw score at each.
PERCENTILES = (0.02, 0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95, 0.97, 0.99)
BREAKPOINTS = {
    "transport": (8.0, 11.1, 14.4, 17.0, 19.2, 21.3, 23.1, 25.1, 27.3, 29.5, 31.6, 33.6, 35.7, 38.2, 40.8, 44.1, 47.8, 52.6, 59.4, 69.5, 73.8, 79.2),
    "community": (13.6, 18.44, 22.64, 26.28, 30.12, 33.28, 36.6, 39.72, 42.92, 45.84, 49.08, 52.28, 55.2, 59.2, 63.36, 68.16, 73.24, 78.76, 84.68, 91.32, 95.6, 99.04),
    "environment": (44.2, 49.8, 54.9, 58.2, 60.4, 62.4, 64.1, 65.8, 67.5, 69.0, 70.2, 71.6, 73.0, 74.2, 75.5, 77.0, 78.2, 79.8, 81.3, 83.8, 84.8, 87.5),
    "price": (35.0, 39.5, 44.8, 48.2, 50.5, 52.7, 54.5, 56.3, 58.1, 59.9, 61.7, 63.6, 65.6, 67.5, 69.5, 72.1, 74.7, 77.3, 79.9, 83.3, 85.2, 87.7),
    "schools": (55.5, 60.3, 67.5, 72.7, 75.4, 77.2, 80.1, 82.2, 83.5, 84.7, 85.6, 86.5, 87.3, 88.4, 89.6, 90.4, 91.1, 91.8, 92.6, 93.5, 93.9, 94.6),
    "total": (49.6, 52.5, 55.2, 57.2, 58.5, 59.8, 60.9, 62.0, 63.0, 64.1, 65.1, 66.0, 66.8, 67.8, 68.9, 70.0, 71.3, 72.8, 74.5, 77.0, 78.6, 81.5),
}


def breakpoint_table(spark: SparkSession, tables: dict = BREAKPOINTS) -> DataFrame:
    """(dimension, x, y) rows of the stored breakpoints."""
    rows = [(d, float(x), p) for d, xs in tables.items() for x, p in zip(xs, PERCENTILES)]
    return spark.createDataFrame(rows, "dimension string, x double, y double")


def monotone_segments(points: DataFrame) -> DataFrame:
    """Cubic pieces of a monotone (Fritsch-Carlson) curve per dimension, with straight ends.

    A dimension has 22 points, so the ordered windows are bounded.
    """
    w = W.partitionBy("dimension").orderBy("x")
    p = points.withColumn("h", F.lead("x").over(w) - F.col("x")).withColumn("s", (F.lead("y").over(w) - F.col("y")) / F.col("h"))
    p = p.withColumn("h0", F.lag("h").over(w)).withColumn("s0", F.lag("s").over(w))
    p = p.withColumn("h2", F.lead("h").over(w)).withColumn("s2", F.lead("s").over(w))
    p = p.withColumn("hm", F.lag("h", 2).over(w)).withColumn("sm", F.lag("s", 2).over(w))
    wa, wb = 2 * F.col("h") + F.col("h0"), F.col("h") + 2 * F.col("h0")
    inner = F.when(F.col("s") * F.col("s0") <= 0, 0.0).otherwise((wa + wb) / (wa / F.col("s0") + wb / F.col("s")))

    def end(h, s, h2, s2):
        d = ((2 * h + h2) * s - h * s2) / (h + h2)
        return F.when(F.signum(d) != F.signum(s), 0.0).when((F.signum(s) != F.signum(s2)) & (F.abs(d) > 3 * F.abs(s)), 3 * s).otherwise(d)

    first, last = F.col("h0").isNull(), F.col("h").isNull()
    slope = F.when(first, end(F.col("h"), F.col("s"), F.col("h2"), F.col("s2"))).when(last, end(F.col("h0"), F.col("s0"), F.col("hm"), F.col("sm"))).otherwise(inner)
    p = p.withColumn("d", slope).withColumn("d2", F.lead("d").over(w))
    middle = p.where(~last).select(
        "dimension", F.col("x").alias("lo"), (F.col("x") + F.col("h")).alias("hi"), F.col("x").alias("x0"), F.col("y").alias("c0"), F.col("d").alias("c1"),
        ((3 * F.col("s") - 2 * F.col("d") - F.col("d2")) / F.col("h")).alias("c2"), ((F.col("d") + F.col("d2") - 2 * F.col("s")) / F.pow("h", F.lit(2))).alias("c3"),
    )
    straight = lambda rows, lo, hi: rows.select("dimension", lo.alias("lo"), hi.alias("hi"), F.col("x").alias("x0"), F.col("y").alias("c0"), F.col("d").alias("c1"), F.lit(0.0).alias("c2"), F.lit(0.0).alias("c3"))
    far = F.lit(1e300)
    return middle.unionByName(straight(p.where(first), -far, F.col("x"))).unionByName(straight(p.where(last), F.col("x"), far))


def calibrate(long: DataFrame, segments: DataFrame) -> DataFrame:
    """(…, dimension, raw) to percentile (0..1) and calibrated score through the broadcast pieces (23 per dimension)."""
    seg = F.broadcast(segments.withColumnRenamed("dimension", "_dim"))
    j = long.join(seg, (long["dimension"] == F.col("_dim")) & (F.col("raw") > F.col("lo")) & (F.col("raw") <= F.col("hi")))
    t = F.col("raw") - F.col("x0")
    p = F.greatest(F.lit(0.001), F.least(F.lit(0.999), F.col("c0") + t * (F.col("c1") + t * (F.col("c2") + t * F.col("c3")))))
    return j.withColumn("share", p).select(
        *long.columns, F.round(F.col("share") * 100, 1).alias("percentile"), F.round(curves.calibrated(F.col("share")), 1).alias("calibrated"))


def raw_long(scores: DataFrame, key: str) -> DataFrame:
    parts = ", ".join(f"'{d}', CAST({d} AS DOUBLE)" for d in DIMENSIONS)
    return scores.select(key, F.expr(f"stack({len(DIMENSIONS)}, {parts}) AS (dimension, raw)")).where(F.col("raw").isNotNull())


def weighted_totals(calibrated: DataFrame, key: str, weights: dict = WEIGHTS) -> DataFrame:
    """Weighted mean over the dimensions present, in whole units so that order of summing is immaterial."""
    table = F.create_map(*[F.lit(x) for d, w in weights.items() for x in (d, round(w * 100))])
    w = F.element_at(table, F.col("dimension"))
    g = calibrated.groupBy(key).agg(
        F.sum(F.round(F.col("calibrated") * 10).cast("bigint") * w).alias("num"), F.sum(w).alias("den"), F.count(F.lit(1)).alias("dims"))
    return g.select(key, (F.col("num") / F.col("den") / 10).alias("raw"), "dims")


def total_score(scores: DataFrame, key: str, segments: DataFrame, least: int = 3) -> DataFrame:
    """Calibrated total per key; NULL under three dimensions, with the completeness text."""
    mixed = weighted_totals(calibrate(raw_long(scores, key), segments), key).withColumn("dimension", F.lit("total"))
    final = calibrate(mixed, segments)
    score = F.when(F.col("dims") >= least, F.col("calibrated"))
    return final.select(key, score.alias("total"), F.concat(F.col("dims").cast("string"), F.lit(f"/{len(DIMENSIONS)}")).alias("completeness"), curves.rating_text(score).alias("rating"))


def new_breakpoints(long: DataFrame) -> DataFrame:
    """22 index percentiles per dimension, rounded to 0.1 and forced to rise by at least 0.01.

    x_i = max(v_i, x_(i-1) + 0.01) is a running maximum of v_j - j/100 plus i/100, over 22 rows.
    """
    named = {f"p{n}": ("index", p) for n, p in enumerate(PERCENTILES)}
    wide = group_quantiles(long, ["dimension"], "raw", named)
    parts = ", ".join(f"{n}, {p}D, CAST(round(round(p{n}, 1) * 100) AS BIGINT)" for n, p in enumerate(PERCENTILES))
    rows = wide.select("dimension", F.expr(f"stack({len(PERCENTILES)}, {parts}) AS (pos, y, v)"))
    w = W.partitionBy("dimension").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    return rows.select("dimension", ((F.max(F.col("v") - F.col("pos")).over(w) + F.col("pos")) / 100).alias("x"), "y")


def recalibrate(scores: DataFrame, key: str) -> DataFrame:
    """Two passes: breakpoints per dimension, then of the totals calibrated with them."""
    long = raw_long(scores, key)
    first = checkpointed(new_breakpoints(long))  # 22 rows per dimension, read by both passes
    totals = weighted_totals(calibrate(long, monotone_segments(first)), key).where(F.col("dims") >= 3)
    return first.unionByName(new_breakpoints(totals.select(F.lit("total").alias("dimension"), "raw")))


# Points of each line; other lines count 20.
LINE_WEIGHTS = {
    "central": 40, "northern": 40, "elizabeth": 40, "elizabeth-line": 40, "victoria": 40, "jubilee": 40,
    "piccadilly": 35, "district": 35, "metropolitan": 35, "circle": 35,
    "bakerloo": 30, "hammersmith-city": 30, "dlr": 30,
    "london-overground": 25, "overground": 25, "mildmay": 25, "lioness": 25, "windrush": 25, "weaver": 25, "suffragette": 25, "liberty": 25,
    "waterloo-city": 20, "national rail": 20,
}
# Base score of major stations; other stations count 50.
MAJOR_STATIONS = {
    "king's cross": 100, "kings cross": 100, "st pancras": 100, "liverpool street": 100, "paddington": 100, "waterloo": 100, "victoria": 100,
    "oxford circus": 100, "bank": 100, "monument": 100, "london bridge": 100, "euston": 100, "green park": 100, "baker street": 100,
    "bond street": 100, "piccadilly circus": 100, "leicester square": 100, "tottenham court road": 100, "holborn": 100, "moorgate": 100,
    "farringdon": 100, "blackfriars": 100, "embankment": 100, "charing cross": 100, "warren street": 100, "south kensington": 100,
    "earl's court": 100, "earls court": 100, "westminster": 100, "stratford": 90, "canary wharf": 90, "clapham junction": 80, "hammersmith": 80,
    "finsbury park": 70, "highbury & islington": 70, "notting hill gate": 70, "canada water": 70,
}


def near_places(points: DataFrame, places: DataFrame, km: float) -> DataFrame:
    """points(subject, lat, lon) with the places(r_lat, r_lon, …) within `km`."""
    return within_km(points, places, km, distance=haversine)


def simple_station_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), r" underground station| rail station| dlr station| station| underground| dlr| \(london\)", ""))


def merge_stations(stops: DataFrame, key: str = "subject") -> DataFrame:
    """One row per simplified name: union of lines, shortest walk."""
    return stops.groupBy(key, simple_station_name(F.col("name")).alias("station")).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("lines")))).alias("lines"), F.min("minutes").alias("minutes"))


def transit_score(stations: DataFrame, key: str = "subject") -> DataFrame:
    """Best station plus a tenth of each of the next three; a station is its lines' points times the walk coefficient."""
    points = F.create_map(*[F.lit(x) for kv in LINE_WEIGHTS.items() for x in kv])
    summed = F.aggregate("lines", F.lit(0), lambda a, line: a + F.coalesce(F.try_element_at(points, F.lower(line)), F.lit(20)))
    own = F.round(F.least(F.lit(100.0), summed * curves.walk_coefficient(F.col("minutes"))), 1)
    best = first_k(stations.where(F.size("lines") > 0).withColumn("own", own), [key], [F.desc("own"), "minutes", "station"], 4)
    tail = F.sum(F.when(F.col("rank") > 1, F.col("own") * 0.1).otherwise(0.0))
    return best.groupBy(key).agg(F.least(F.lit(100.0), F.max(F.when(F.col("rank") == 1, F.col("own"))) + tail).alias("score"), F.count(F.lit(1)).alias("ranked"))


def covering_stations(stations: DataFrame, key: str = "subject", k: int = 3) -> DataFrame:
    """Nearest first, a station only if it adds a line: those that are first to serve some line, at most k."""
    lines = stations.select(key, "station", "minutes", F.explode(F.transform("lines", lambda x: F.lower(x))).alias("line"))
    first = lines.groupBy(key, "line").agg(F.min_by(F.struct("minutes", "station"), F.struct("minutes", "station")).alias("s"))
    return first_k(first.select(key, "s.station", "s.minutes").distinct(), [key], ["minutes", "station"], k)


def bus_score(stops: DataFrame, key: str = "subject") -> DataFrame:
    """Nearest stop 70 x coefficient, plus five per further stop."""
    g = stops.groupBy(key).agg(F.min("minutes").alias("minutes"), F.count(F.lit(1)).alias("stops"))
    return g.select(key, "stops", F.least(F.lit(100.0), 70 * curves.walk_coefficient(F.col("minutes")) + (F.col("stops") - 1) * 5).alias("score"))


def station_core(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), r"\s+(station|underground station|tube station|rail station|bus station|international|city|high street).*$", ""))


def named_station_score(stops: DataFrame) -> DataFrame:
    """Score from the name alone: base points of the core name times the walk coefficient."""
    base = F.create_map(*[F.lit(x) for kv in MAJOR_STATIONS.items() for x in kv])
    return stops.withColumn("score", F.coalesce(F.try_element_at(base, station_core(F.col("name"))), F.lit(50)) * curves.walk_coefficient(F.col("minutes")))


def dedupe_by_distance(stations: DataFrame, key: str = "subject", km: float = 0.4) -> DataFrame:
    """Keep stations in score order (ties to the smaller place_id), dropping any within `km` of one already kept.

    At one spot only the best can stay. The rest is decided in rounds on a grid of cells no smaller than `km`: the best undecided
    station of a cell is kept if none of the eight cells around holds a better one, and what lies near a kept one is dropped. That
    is what taking them in order gives, without bringing the stations of a place together or pairing them; a cell meets at most
    four kept ones a round, and there are at most as many rounds as cells that one key sees.
    """
    rest = [c for c in stations.columns if c not in (key, "place_id")]
    own = stations.groupBy(key, "place_id").agg(F.max_by(F.struct(*rest), "score").alias("_r")).select(key, "place_id", *[F.col(f"_r.{c}").alias(c) for c in rest])
    order = F.struct(F.col("score").isNull().alias("none"), (-F.col("score")).alias("minus"), F.col("place_id").alias("place_id"))
    # a station without coordinates is near to nothing
    nowhere = F.when(F.col("r_lat").isNull() | F.col("r_lon").isNull(), F.col("place_id"))
    best = own.groupBy(key, "r_lat", "r_lon", nowhere.alias("_nowhere")).agg(F.min_by(F.struct(*[c for c in own.columns if c != key]), order).alias("_r"))
    best = checkpointed(best.select(key, "_nowhere", *[F.col(f"_r.{c}").alias(c) for c in own.columns if c != key]))
    cy, cx = grid(F.col("r_lat"), F.col("r_lon"), km)
    open_ = best.where("_nowhere IS NULL").select(key, "place_id", "r_lat", "r_lon", order.alias("_o"), cy.alias("_cy"), cx.alias("_cx"))
    kept = [best.where("_nowhere IS NOT NULL").select(key, "place_id")]
    around = lambda d: d.withColumn("_cy", F.explode(F.sequence(F.col("_cy") - 1, F.col("_cy") + 1))).withColumn("_cx", F.explode(F.sequence(F.col("_cx") - 1, F.col("_cx") + 1)))
    cell = [key, "_cy", "_cx"]
    while True:
        top = open_.groupBy(*cell).agg(F.min(F.struct("_o", "r_lat", "r_lon")).alias("_t"))
        seen = around(top).groupBy(*cell).agg(F.min("_t._o").alias("_first"))
        won = checkpointed(top.join(seen, cell).where(F.col("_t._o") == F.col("_first")).select(*cell, F.col("_t._o.place_id").alias("won_id"), F.col("_t.r_lat").alias("w_lat"), F.col("_t.r_lon").alias("w_lon")))
        kept.append(won.select(key, F.col("won_id").alias("place_id")))
        a, b = open_.alias("a"), around(won).alias("b")
        dropped = (F.col("a.place_id") == F.col("b.won_id")) | (haversine(F.col("a.r_lat"), F.col("a.r_lon"), F.col("b.w_lat"), F.col("b.w_lon")) < km)
        open_ = checkpointed(a.join(b, reduce(lambda x, y: x & y, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in cell]) & dropped, "left_anti"))
        if open_.isEmpty():
            break
    return best.join(reduce(DataFrame.unionByName, kept), [key, "place_id"], "left_semi").select(*stations.columns)


def long_distance_score(trips: DataFrame, key: str = "subject") -> DataFrame:
    """Per place the better mode, per kind the best place plus five when two reach 70; airports 60 %, rail 40 %.

    trips: key, place_id, kind (airport | rail), mode (TRANSIT | DRIVE), minutes.
    """
    points = trips.withColumn("pts", 100 * curves.travel_coefficient(F.col("minutes"), F.col("kind"), F.col("mode")))
    place = points.groupBy(key, "kind", "place_id").agg(F.max("pts").alias("pts"))
    kind = place.groupBy(key, "kind").agg(F.least(F.lit(100.0), F.max("pts") + F.when(F.count_if(F.col("pts") >= 70) >= 2, 5).otherwise(0)).alias("pts"))
    share = F.when(F.col("kind") == "airport", 0.6).otherwise(0.4)
    return kind.groupBy(key).agg(F.sum(F.col("pts") * share).alias("score"))


def school_score(points: DataFrame, schools: DataFrame, km: float = 1.5) -> DataFrame:
    """Distance-weighted rating 40 %, outstanding nearby 30 %, choice 10 %, avoidance of poor schools 20 %."""
    near = near_places(points, schools, km).withColumn("km", F.round("km", 3))
    rated = near.where(F.col("ofsted").isNotNull())
    w = F.exp(-0.5 * F.col("km"))
    o, close = F.col("ofsted"), F.col("km") <= 1.0
    g = rated.groupBy("subject").agg(
        (F.sum((5 - o) * w) / F.sum(w)).alias("quality"), F.count_if((o == 1) & close).alias("top"), F.count_if((o <= 2) & close).alias("good"),
        F.max(F.col("phase").isin("primary", "all-through")).alias("prim"), F.max(F.col("phase").isin("secondary", "all-through")).alias("sec"), F.count(F.lit(1)).alias("rated"),
        F.count_if(o >= 3).alias("poor"), F.count_if(o == 4).alias("worst"))
    top = F.col("top")
    outstanding = F.when(top == 0, 0).when(top == 1, 40).when(top == 2, 65).when(top == 3, 80).otherwise(F.least(F.lit(100), 80 + top * 5))
    outstanding = F.least(F.lit(100), outstanding + F.least(F.lit(20), F.col("good") * 3))
    choice = reduce(lambda a, b: a + b, [F.when(F.col("rated") >= n, 10).otherwise(0) for n in (2, 5, 10, 15)])
    choice = F.least(F.lit(100), choice + F.when(F.col("prim"), 30).otherwise(0) + F.when(F.col("sec"), 30).otherwise(0))
    avoid = F.when(F.col("poor") == 0, 100.0).otherwise(F.greatest(F.lit(0.0), F.greatest(F.lit(0.0), 100 - F.col("poor") / F.col("rated") * 120) - F.col("worst") * 15))
    scored = g.select("subject", "rated", (0.40 * (F.col("quality") - 1) / 3 * 100 + 0.30 * outstanding + 0.10 * choice + 0.20 * avoid).alias("score"))
    return points.select("subject").join(scored, "subject", "left").select("subject", F.coalesce("rated", F.lit(0)).alias("rated"), F.coalesce("score", F.lit(40.0)).alias("score"))


# Weight of a place by its kind.
CATEGORY_WEIGHTS = {"supermarket": 1.5, "restaurant": 1.2, "gym": 1.0}


def place_stats(near: DataFrame, key: str = "subject") -> DataFrame:
    """Counts, ratings and categories of the venues near each subject."""
    r = F.coalesce("rating", F.lit(0.0))
    weight = F.create_map(*[F.lit(x) for kv in CATEGORY_WEIGHTS.items() for x in kv])
    return near.groupBy(key).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(r >= 4.0).alias("high_rated"), F.count_if(F.col("reviews") >= 100).alias("popular"),
        # ratings carry one decimal: summed as tenths, the mean does not depend on task order
        (F.sum(F.when(r > 0, F.round(r * 10).cast("bigint"))) / F.count(F.when(r > 0, 1)) / 10).alias("mean_rating"), F.sum(F.coalesce(F.try_element_at(weight, F.col("kind")), F.lit(0.0))).alias("weighted"),
        F.count_distinct(F.when(F.col("kind").isin(*CATEGORY_WEIGHTS), F.col("kind"))).alias("categories"))


# Which category a venue's types count for.
TYPE_CATEGORY = {"supermarket": "supermarket", "grocery_store": "supermarket", "restaurant": "restaurant", "gym": "gym"}


def place_categories(near: DataFrame, key: str = "subject", examples: int = 3) -> DataFrame:
    """(key, category, total, mean_rating, examples) of the venues near each subject, by the categories of their types.

    near: key, place_id, name, rating, km, types (array). A venue counts once for each of its types that a category has; the mean is
    over ratings above 0 (0 without any); examples are the nearest names, joined by |.
    """
    category = F.create_map(*[F.lit(x) for kv in TYPE_CATEGORY.items() for x in kv])
    each = near.select(key, "place_id", "name", "rating", "km", F.explode("types").alias("type")).withColumn("category", F.try_element_at(category, F.col("type"))).where("category IS NOT NULL")
    r = F.coalesce("rating", F.lit(0.0))
    mean = F.sum(F.when(r > 0, F.round(r * 10).cast("bigint"))) / F.nullif(F.count(F.when(r > 0, 1)), F.lit(0)) / 10
    stats = each.groupBy(key, "category").agg(F.count(F.lit(1)).alias("total"), F.coalesce(mean, F.lit(0.0)).alias("mean_rating"))
    top = first_k(each, [key, "category"], ["km", "place_id", "type"], examples).groupBy(key, "category").agg(F.array_sort(F.collect_list(F.struct("rank", "name"))).alias("_e"))
    return stats.join(top, [key, "category"]).select(key, "category", "total", "mean_rating", F.array_join(F.transform("_e", lambda e: e["name"]), "|").alias("examples"))


def amenity_score(stats: DataFrame, key: str = "subject") -> DataFrame:
    """Quantity 40, quality 40, diversity 20."""
    w, m, c = F.col("weighted"), F.coalesce("mean_rating", F.lit(0.0)), F.col("categories")
    quantity = F.when(w >= 25, 40.0).when(w >= 20, 35.0).when(w >= 15, 30.0).when(w >= 10, 25.0).when(w >= 5, 20.0).otherwise(w * 3)
    rated = F.when(m >= 4.3, 20.0).when(m >= 4.0, 17.0).when(m >= 3.8, 14.0).when(m >= 3.5, 10.0).otherwise(m * 5)
    quality = F.least(F.lit(40.0), rated + F.col("high_rated") / F.col("total") * 10 + F.col("popular") / F.col("total") * 10)
    diversity = F.when(c >= 10, 20).when(c >= 8, 18).when(c >= 6, 15).when(c >= 4, 12).when(c >= 2, 8).otherwise(c * 3)
    return stats.select(key, (quantity + quality + diversity).alias("score"))


def price_score(rows: DataFrame) -> Column:
    """Level 35 %, long growth 30 %, momentum 20 %, stability 10 %, activity 5 %.

    rows: average_price, cagr_10y, cagr_5y, cagr_3y, return_sd, pairs.
    """
    logistic = lambda x: 100.0 / (1.0 + F.exp(-x))
    level = F.when(F.col("average_price") > 0, logistic(3.0 * (F.col("average_price") / 550000 - 1.0))).otherwise(50.0)
    long = curves.growth_score(F.coalesce("cagr_10y", "cagr_5y"))
    recent = curves.growth_score(F.coalesce("cagr_3y", "cagr_5y"))
    steady = F.when(F.col("return_sd").isNotNull() & (F.col("pairs") >= 5), logistic(-0.15 * (F.col("return_sd") - 10))).otherwise(50.0)
    active = F.when(F.col("pairs") > 0, logistic(0.1 * (F.col("pairs") - 30))).otherwise(50.0)
    return level * 0.35 + long * 0.3 + recent * 0.2 + steady * 0.1 + active * 0.05


def value_for_money(vs_median: Column, percentile: Column) -> Column:
    base = curves.steps(vs_median, [(-15, 100), (-10, 90), (-5, 80), (5, 70), (10, 60), (15, 50)], F.greatest(F.lit(30.0), 50 - (vs_median - 15)))
    return F.when(percentile <= 25, F.least(F.lit(100.0), base + 10)).when(percentile >= 75, F.greatest(F.lit(30.0), base - 10)).otherwise(base)


def appreciation(cagr_5: Column, cagr_3: Column, direction: Column) -> Column:
    c5, c3 = F.coalesce(cagr_5, F.lit(0.0)), F.coalesce(cagr_3, F.lit(0.0))
    base = F.when(c5 >= 8, 100.0).when(c5 >= 5, 85.0).when(c5 >= 3, 70.0).when(c5 >= 1, 55.0).when(c5 >= 0, 45.0).otherwise(F.greatest(F.lit(20.0), 45 + c5 * 5))
    nudge = F.when(direction == "up", 10).when(direction == "down", -15).otherwise(0) + F.when(c3 > c5 + 2, 5).when(c3 < c5 - 2, -5).otherwise(0)
    return F.least(F.lit(100.0), F.greatest(F.lit(20.0), base + nudge))


def fee_score(total: Column) -> Column:
    return curves.steps(total, [(2000, 100), (3000, 85), (4000, 70), (5000, 55)], F.greatest(F.lit(30.0), 100 - (total - 5000) / 100))


def surroundings(crimes: Column, park_m: Column, parks: Column, green_pct: Column, aqi: Column, road_m: Column, clean: Column, events: Column) -> Column:
    """Safety 30 %, greenery 20 %, air 25 %, cleanliness 15 %, community 10 %."""
    green = curves.steps(park_m, [(200, 100), (500, 85), (1000, 70)], F.lit(50.0)) * 0.5 + F.least(F.lit(100), parks * 25) * 0.2 + F.least(F.lit(100.0), green_pct * 2) * 0.3
    air = curves.steps(aqi, [(50, 100), (100, 80), (150, 60)], F.lit(40.0)) * 0.6 + F.least(F.lit(100.0), road_m / 5) * 0.4
    air = F.greatest(F.lit(0.0), F.least(F.lit(100.0), air))
    tidy = F.element_at(F.create_map(*[F.lit(x) for kv in {"Excellent": 100, "Good": 85, "Fair": 70, "Poor": 50, "Very Poor": 30}.items() for x in kv]), clean)
    tidy = tidy * 0.5 + F.lit(50) * 0.2 + tidy * 0.3
    people = F.lit(90) * 0.3 + F.lit(85) * 0.5 + F.least(F.lit(100), events * 20) * 0.2
    return curves.crime_count_score(crimes) * 0.30 + green * 0.20 + air * 0.25 + tidy * 0.15 + people * 0.10


# ---- parks as polygons -------------------------------------------------------------------------

# Origin and metres per degree of the park projection; least area, naming area, saturation.
ORIGIN = (51.50, -0.12)
M_LAT = 111320.0
LEAST_AREA, NAME_AREA, SATURATION = 1000.0, 2000.0, 6.0


def _m_lng() -> Column:
    return F.lit(M_LAT) * F.cos(F.radians(F.lit(ORIGIN[0])))


def polygon_rows(parks: DataFrame) -> DataFrame:
    """rings (array of rings of [lon, lat]) to one row per park with projected edges, area and bounding box."""
    flat = lambda p: F.struct(((p[0] - ORIGIN[1]) * _m_lng()).alias("x"), ((p[1] - ORIGIN[0]) * M_LAT).alias("y"))
    rings = F.transform(F.filter("rings", lambda r: F.size(r) >= 4), lambda r: F.transform(r, flat))
    edge = lambda r: F.arrays_zip(F.slice(r, 1, F.size(r) - 1).alias("a"), F.slice(r, 2, F.size(r) - 1).alias("b"))
    shoelace = lambda r: F.abs(F.aggregate(edge(r), F.lit(0.0), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])) / 2
    shaped = parks.withColumn("_r", rings).where(F.size("_r") > 0)
    shaped = shaped.withColumn("edges", F.flatten(F.transform("_r", edge))).withColumn("area_m2", F.aggregate(F.transform("_r", shoelace), F.lit(0.0), lambda s, x: s + x))
    pts = F.flatten("_r")
    box = [f(F.transform(pts, lambda p: p[c])).alias(n) for f, c, n in ((F.array_min, "x", "x0"), (F.array_max, "x", "x1"), (F.array_min, "y", "y0"), (F.array_max, "y", "y1"))]
    return shaped.where(F.col("area_m2") > 0).select("park_id", "name", "edges", "area_m2", *box)


def parks_near(points: DataFrame, polygons: DataFrame, metres: float = 1000.0, cell: float = 1000.0) -> DataFrame:
    """Parks whose edge is within `metres` of a point (0 inside).

    A shape is listed in every grid cell its widened box touches; points meet shapes by cell. Edges are
    measured inside the row, so no point-edge pairs are shuffled. Parks of one and the same shape are measured once.
    """
    shape = ["edges", "x0", "x1", "y0", "y1"]
    polygons = checkpointed(polygons)
    shapes = checkpointed(polygons.groupBy(*shape).agg(F.min("park_id").alias("_shape")))
    names = polygons.join(shapes, shape).select("_shape", "park_id", "name", "area_m2")
    at = lambda c: F.floor(c / cell).cast("bigint")
    spread = shapes.withColumn("_cx", F.explode(F.sequence(at(F.col("x0") - metres), at(F.col("x1") + metres)))).withColumn(
        "_cy", F.explode(F.sequence(at(F.col("y0") - metres), at(F.col("y1") + metres))))
    p = points.withColumn("px", (F.col("lon") - ORIGIN[1]) * _m_lng()).withColumn("py", (F.col("lat") - ORIGIN[0]) * M_LAT)
    p = p.withColumn("_cx", at(F.col("px"))).withColumn("_cy", at(F.col("py")))
    j = p.join(spread, ["_cx", "_cy"])
    px, py = F.col("px"), F.col("py")

    def gap(e):
        dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide((px - e["a"]["x"]) * dx + (py - e["a"]["y"]) * dy, dx * dx + dy * dy)))
        return F.sqrt(F.pow(e["a"]["x"] + t * dx - px, 2) + F.pow(e["a"]["y"] + t * dy - py, 2))

    def crosses(e):
        spans = (e["a"]["y"] > py) != (e["b"]["y"] > py)
        return spans & (px < (e["b"]["x"] - e["a"]["x"]) * F.try_divide(py - e["a"]["y"], e["b"]["y"] - e["a"]["y"]) + e["a"]["x"])

    inside = F.size(F.filter("edges", crosses)) % 2 == 1
    d = F.when(inside, 0.0).otherwise(F.array_min(F.transform("edges", gap)))
    measured = checkpointed(j.withColumn("metres", d).where(F.col("metres") <= metres).select("subject", "_shape", "metres"))
    return measured.join(names, "_shape").select("subject", "park_id", "name", "area_m2", "metres")


def green_score(near: DataFrame) -> DataFrame:
    big = near.where(F.col("area_m2") >= LEAST_AREA)
    eff = F.sum(F.sqrt(F.col("area_m2") / 10000) * F.greatest(F.lit(0.0), 1 - F.col("metres") / 1000))
    return big.groupBy("subject").agg(
        F.count_if(F.col("metres") <= 500).alias("within_500m"), F.count(F.lit(1)).alias("within_1km"), F.round(100 * (1 - F.exp(-eff / SATURATION))).cast("int").alias("green_score"))


def named_parks(near: DataFrame, k: int = 5) -> DataFrame:
    named = near.where((F.col("area_m2") >= NAME_AREA) & (F.coalesce("name", F.lit("")) != ""))
    closest = named.groupBy("subject", "name").agg(F.min("metres").alias("metres"))
    return first_k(closest, ["subject"], ["metres", "name"], k)
