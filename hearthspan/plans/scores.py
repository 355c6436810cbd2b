"""Area-score queries."""

from pyspark.sql import functions as F

from hearthspan.functions import curves
from hearthspan.functions.rank import first_k, tally_before
from hearthspan.operators import sales as sale_op
from hearthspan.operators import scores as op
from hearthspan.operators.spatial import walk_minutes
from hearthspan.plans.base import query
from hearthspan.plans.sales import PAIRS, YEAR

_BP = "bp(dimension, x, y) AS (VALUES " + ", ".join(f"('{d}', {x}::DOUBLE, {p}::DOUBLE)" for d, xs in op.BREAKPOINTS.items() for x, p in zip(xs, op.PERCENTILES)) + ")"


def _end(a, b):
    d = f"(((2 * {a}.h + {b}.h) * {a}.s - {a}.h * {b}.s) / ({a}.h + {b}.h))"
    return f"(CASE WHEN sign({d}) <> sign({a}.s) THEN 0 WHEN sign({a}.s) <> sign({b}.s) AND abs({d}) > 3 * abs({a}.s) THEN 3 * {a}.s ELSE {d} END)"


def _segments(src, out):
    """The same monotone curve written with numbered rows and self joins."""
    return f"""{out}_n AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY x) AS k, count(*) OVER (PARTITION BY dimension) AS n FROM {src}),
 {out}_e AS (SELECT a.dimension, a.k, a.n, a.x, a.y, b.x - a.x AS h, (b.y - a.y) / (b.x - a.x) AS s FROM {out}_n a JOIN {out}_n b ON b.dimension = a.dimension AND b.k = a.k + 1),
 {out}_d AS (SELECT a.dimension, a.k, CASE
    WHEN a.k = 1 THEN {_end('e1', 'e2')}
    WHEN a.k = a.n THEN {_end('e0', 'em')}
    WHEN e0.s * e1.s <= 0 THEN 0 ELSE (3 * (e0.h + e1.h)) / ((2 * e1.h + e0.h) / e0.s + (e1.h + 2 * e0.h) / e1.s) END AS d
   FROM {out}_n a LEFT JOIN {out}_e e1 ON e1.dimension = a.dimension AND e1.k = a.k LEFT JOIN {out}_e e2 ON e2.dimension = a.dimension AND e2.k = a.k + 1
   LEFT JOIN {out}_e e0 ON e0.dimension = a.dimension AND e0.k = a.k - 1 LEFT JOIN {out}_e em ON em.dimension = a.dimension AND em.k = a.k - 2),
 {out} AS (SELECT e.dimension, CASE WHEN e.k = 1 THEN -1e300 ELSE e.x END AS lo, CASE WHEN e.k = e.n - 1 THEN 1e300 ELSE e.x + e.h END AS hi, e.x, e.x + e.h AS x1, e.y, e.y + e.s * e.h AS y1, e.h, d0.d AS d0, d1.d AS d1
   FROM {out}_e e JOIN {out}_d d0 ON d0.dimension = e.dimension AND d0.k = e.k JOIN {out}_d d1 ON d1.dimension = e.dimension AND d1.k = e.k + 1)"""


# Hermite form on the unit interval, with straight continuation outside
_HERMITE = """CASE WHEN raw <= x THEN y + d0 * (raw - x) WHEN raw >= x1 THEN y1 + d1 * (raw - x1) ELSE
  (2 * pow((raw - x) / h, 3) - 3 * pow((raw - x) / h, 2) + 1) * y + (pow((raw - x) / h, 3) - 2 * pow((raw - x) / h, 2) + (raw - x) / h) * h * d0
  + (3 * pow((raw - x) / h, 2) - 2 * pow((raw - x) / h, 3)) * y1 + (pow((raw - x) / h, 3) - pow((raw - x) / h, 2)) * h * d1 END"""


def _calibrate(src, seg, out):
    return f"""{out}_p AS (SELECT r.*, greatest(0.001, least(0.999, {_HERMITE})) AS p FROM {src} r JOIN {seg} g ON g.dimension = r.dimension AND r.raw > g.lo AND r.raw <= g.hi),
 {out}_t AS (SELECT *, sqrt(-2 * ln(least(p, 1 - p))) AS t FROM {out}_p),
 {out} AS (SELECT * EXCLUDE (t, p), round(p * 100, 1) AS percentile, round(greatest(5, least(98, 65 + 15 * (CASE WHEN p < 0.5 THEN -1 ELSE 1 END) * (t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t)))), 1) AS calibrated FROM {out}_t)"""


_RAW = "raw AS (" + " UNION ALL ".join(f"SELECT postcode, '{d}' AS dimension, {d}::DOUBLE AS raw FROM scores WHERE {d} IS NOT NULL" for d in op.DIMENSIONS) + ")"
_W = "CASE dimension " + " ".join(f"WHEN '{d}' THEN {round(w * 100)}" for d, w in op.WEIGHTS.items()) + " END"


def _totals(src, out):
    return f"{out} AS (SELECT postcode, sum(round(calibrated * 10)::BIGINT * {_W}) / sum({_W}) / 10 AS raw, count(*) AS dims, 'total' AS dimension FROM {src} GROUP BY postcode)"


@query("calibrate_scores", f"WITH {_BP}, {_segments('bp', 'seg')}, {_RAW}, {_calibrate('raw', 'seg', 'cal')} SELECT postcode, dimension, percentile, calibrated FROM cal", "scores")
def _(i):
    seg = op.monotone_segments(op.breakpoint_table(i.spark))
    return op.calibrate(op.raw_long(i.scores, "postcode"), seg).select("postcode", "dimension", "percentile", "calibrated")


@query("total_score", f"""WITH {_BP}, {_segments('bp', 'seg')}, {_RAW}, {_calibrate('raw', 'seg', 'cal')}, {_totals('cal', 'tot')}, {_calibrate('tot', 'seg', 'fin')}
  SELECT postcode, CASE WHEN dims >= 3 THEN calibrated END AS total, dims || '/5' AS completeness FROM fin""", "scores")
def _(i):
    seg = op.monotone_segments(op.breakpoint_table(i.spark))
    return op.total_score(i.scores, "postcode", seg).drop("rating")


def _new_points(src, out):
    ps = ", ".join(f"({n}, {p})" for n, p in enumerate(op.PERCENTILES))
    return f"""{out}_o AS (SELECT dimension, raw, row_number() OVER (PARTITION BY dimension ORDER BY raw) - 1 AS r, count(*) OVER (PARTITION BY dimension) AS n FROM {src}),
 {out}_v AS (SELECT dimension, p.pos, p.y::DOUBLE AS y, round(round(raw, 1) * 100)::BIGINT AS v FROM {out}_o JOIN (VALUES {ps}) p(pos, y) ON r = least(floor(n * p.y::DOUBLE)::BIGINT, n - 1)),
 {out} AS (SELECT a.dimension, (SELECT max(b.v + a.pos - b.pos) FROM {out}_v b WHERE b.dimension = a.dimension AND b.pos <= a.pos) / 100 AS x, a.y FROM {out}_v a)"""


@query("recalibrate", f"""WITH {_RAW}, {_new_points('raw', 'nb')}, {_segments('nb', 'seg')}, {_calibrate('raw', 'seg', 'cal')}, {_totals('cal', 'tot')}, tot3 AS (SELECT dimension, raw FROM tot WHERE dims >= 3), {_new_points('tot3', 'nt')}
  SELECT * FROM nb UNION ALL SELECT * FROM nt""", "scores")
def _(i):
    return op.recalibrate(i.scores, "postcode")


@query("adjusted_weights", "WITH w(k, d, v) AS (VALUES " + ", ".join(f"({n}, '{d}', {w})" for n, (d, w) in enumerate(op.WEIGHTS.items())) + """)
  SELECT c_custkey, d AS dimension, CASE WHEN (c_custkey + k) % 3 = 0 THEN 0 ELSE round(v / sum(CASE WHEN (c_custkey + k) % 3 <> 0 THEN v ELSE 0 END) OVER (PARTITION BY c_custkey), 8) END::DOUBLE AS weight FROM customer CROSS JOIN w""")
def _(i):
    k = F.col("c_custkey")
    on = {d: (k + n) % 3 != 0 for n, d in enumerate(op.DIMENSIONS)}
    total = sum((F.when(on[d], w).otherwise(0.0) for d, w in op.WEIGHTS.items()), F.lit(0.0))
    rows = F.array(*[F.struct(F.lit(d).alias("dimension"), F.when(on[d], F.round(F.lit(w) / total, 8)).otherwise(0.0).alias("weight")) for d, w in op.WEIGHTS.items()])
    return i.table("customer").select("c_custkey", F.inline(rows))


def points(i):
    return i.coords.select(F.col("spaced").alias("subject"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))


def places(i):
    return i.places.withColumnsRenamed({"latitude": "r_lat", "longitude": "r_lon"})


_LINE_SETS = (("central", "northern"), ("DLR",), ("victoria", "mildmay", "bakerloo"), ("bus-link",), ("central", "district"), ())


def stops(i, km=1.2):
    lines = F.element_at(F.array(*[F.array(*[F.lit(x) for x in s]).cast("array<string>") for s in _LINE_SETS]), (F.col("place_id") % len(_LINE_SETS) + 1).cast("int"))
    name = F.concat("name", F.when(F.col("place_id") % 2 == 0, " Underground Station").otherwise(" DLR"))
    near = op.near_places(points(i), places(i), km)
    return near.select("subject", "place_id", name.alias("name"), "r_lat", "r_lon", lines.alias("lines"), walk_minutes(F.col("km")).alias("minutes"))


_LINES_SQL = "CASE place_id % 6 " + " ".join(f"WHEN {n} THEN [{', '.join(repr(x) for x in s)}]::VARCHAR[]" for n, s in enumerate(_LINE_SETS)) + " END"
_NEAR = """near AS (SELECT spaced AS subject, p.*, 2 * 6371 * asin(sqrt(pow(sin(radians(p.latitude - c.latitude) / 2), 2) + cos(radians(c.latitude)) * cos(radians(p.latitude)) * pow(sin(radians(p.longitude - c.longitude) / 2), 2))) AS km FROM coords c CROSS JOIN places p)"""
_STOPS = f"{_NEAR}, stops AS (SELECT subject, place_id, name || CASE WHEN place_id % 2 = 0 THEN ' Underground Station' ELSE ' DLR' END AS name, {_LINES_SQL} AS lines, km * 1.3 / 5 * 60 AS minutes FROM near WHERE km <= 1.2)"
_WALKC = "CASE WHEN minutes <= 5 THEN 1.0 WHEN minutes <= 10 THEN 1.3 - minutes * 0.06 WHEN minutes <= 15 THEN 1.3 - minutes * 0.06 WHEN minutes <= 20 THEN 1.0 - minutes * 0.04 ELSE greatest(0.05, 0.4 - minutes * 0.01) END"
_MERGED = f"""{_STOPS}, lx AS (SELECT subject, lower(replace(replace(name, ' Underground Station', ''), ' DLR', '')) AS station, minutes, unnest(lines) AS line FROM stops),
 mm AS (SELECT subject, lower(replace(replace(name, ' Underground Station', ''), ' DLR', '')) AS station, min(minutes) AS minutes FROM stops GROUP BY ALL), ml AS (SELECT DISTINCT subject, station, line FROM lx)"""


@query("dedupe_stations_name", f"WITH {_MERGED} SELECT mm.subject, mm.station, round(minutes, 6) AS minutes, (SELECT string_agg(line, ',' ORDER BY line) FROM ml WHERE ml.subject = mm.subject AND ml.station = mm.station) AS lines FROM mm", "coords places")
def _(i):
    m = op.merge_stations(stops(i))
    return m.select("subject", "station", F.round("minutes", 6).alias("minutes"), F.nullif(F.array_join("lines", ","), F.lit("")).alias("lines"))


_PTS = "CASE lower(line) WHEN 'central' THEN 40 WHEN 'northern' THEN 40 WHEN 'victoria' THEN 40 WHEN 'district' THEN 35 WHEN 'bakerloo' THEN 30 WHEN 'dlr' THEN 30 WHEN 'mildmay' THEN 25 ELSE 20 END"


@query("score_transit", f"""WITH {_MERGED}, sc AS (SELECT mm.subject, mm.station, mm.minutes, round(least(100, sum({_PTS}) * ({_WALKC.replace('minutes', 'any_value(mm.minutes)')})), 1) AS own FROM mm JOIN ml USING (subject, station) GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY own DESC, minutes, station) AS k FROM sc)
  SELECT subject, round(least(100, max(own) FILTER (WHERE k = 1) + coalesce(sum(own * 0.1) FILTER (WHERE k BETWEEN 2 AND 4), 0)), 6) AS score FROM r GROUP BY subject""", "coords places")
def _(i):
    return op.transit_score(op.merge_stations(stops(i))).select("subject", F.round("score", 6).alias("score"))


@query("set_cover_stations", f"""WITH {_MERGED}, f AS (SELECT ml.subject, ml.line, arg_min(ml.station, (mm.minutes, ml.station)) AS station FROM ml JOIN mm USING (subject, station) GROUP BY ALL),
  d AS (SELECT DISTINCT f.subject, f.station, mm.minutes FROM f JOIN mm USING (subject, station)) SELECT subject, station, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY minutes, station) AS k FROM d) x WHERE k <= 3""", "coords places")
def _(i):
    m = op.merge_stations(stops(i)).withColumn("lines", F.transform("lines", lambda x: x))
    return op.covering_stations(m).select("subject", "station", "rank")


@query("score_bus", f"WITH {_STOPS} SELECT subject, count(*) AS stops, round(least(100, 70 * {_WALKC.replace('minutes', 'min(minutes)')} + (count(*) - 1) * 5), 6) AS score FROM stops WHERE minutes <= 8 GROUP BY subject", "coords places")
def _(i):
    return op.bus_score(stops(i).where("minutes <= 8")).select("subject", "stops", F.round("score", 6).alias("score"))


@query("score_stations_by_place")
def _(i):
    # rows only: the greedy distance rule has no SQL form
    return op.dedupe_by_distance(op.named_station_score(stops(i)).select("subject", "place_id", "name", "r_lat", "r_lon", "minutes", "score"))


def _greedy(score, reach, km, out):
    """The rule taken in order, one station a step."""
    far = "2 * 6371 * asin(sqrt(pow(sin(radians(x.lat - r.lat) / 2), 2) + cos(radians(x.lat)) * cos(radians(r.lat)) * pow(sin(radians(x.lon - r.lon) / 2), 2)))"
    return f"""WITH RECURSIVE {_NEAR}, r AS MATERIALIZED (SELECT subject, place_id, latitude AS lat, longitude AS lon, row_number() OVER (PARTITION BY subject ORDER BY {score} DESC, place_id) AS k FROM near WHERE km <= {reach}),
  f(subject, k, kept) AS (SELECT subject, 0::BIGINT, []::STRUCT(id BIGINT, lat DOUBLE, lon DOUBLE)[] FROM (SELECT DISTINCT subject FROM r)
   UNION ALL SELECT r.subject, r.k, CASE WHEN len(list_filter(kept, lambda x: {far} < {km})) = 0 THEN list_append(kept, {{'id': r.place_id, 'lat': r.lat, 'lon': r.lon}}) ELSE kept END FROM f JOIN r ON r.subject = f.subject AND r.k = f.k + 1),
  g AS (SELECT subject, kept FROM f QUALIFY row_number() OVER (PARTITION BY subject ORDER BY k DESC) = 1) {out}"""


@query("dedupe_stations_geo", _greedy("reviews", 1.2, 0.4, "SELECT subject, k.id AS place_id FROM (SELECT subject, unnest(kept) AS k FROM g) x"), "coords places")
def _(i):
    near = op.near_places(points(i), places(i), 1.2).withColumn("score", F.col("reviews").cast("double"))
    return op.dedupe_by_distance(near.select("subject", "place_id", "r_lat", "r_lon", "score")).select("subject", "place_id")


@query("grouped_map_greedy", _greedy("weight", 0.8, 0.2, "SELECT subject, len(kept) AS kept FROM g"), "coords places")
def _(i):
    near = op.near_places(points(i), places(i), 0.8).withColumn("score", F.col("weight"))
    kept = op.dedupe_by_distance(near.select("subject", "place_id", "r_lat", "r_lon", "score"), km=0.2)
    return kept.groupBy("subject").agg(F.count(F.lit(1)).alias("kept"))


_TRIPS = "trips AS (SELECT l_partkey AS subject, l_suppkey AS place_id, CASE WHEN l_suppkey % 2 = 0 THEN 'airport' ELSE 'rail' END AS kind, CASE WHEN l_linenumber % 2 = 0 THEN 'TRANSIT' ELSE 'DRIVE' END AS mode, l_quantity * 3 AS minutes FROM lineitem)"


@query("score_long_distance", f"""WITH {_TRIPS}, b(kind, mode, a, ya, z, yz) AS (VALUES """ + ", ".join(
    f"('{k}', '{m}', {a}, {ya}, {z}, {yz})" for (k, m), pts in curves.TRAVEL.items() for (a, ya), (z, yz) in zip([(-1, 1.0), *pts], pts)) + """),
  l AS (SELECT kind, mode, max(z) AS z, min(yz) AS y FROM b GROUP BY ALL),
  p AS (SELECT t.subject, t.kind, t.place_id, 100 * coalesce(ya + (minutes - a) * 1.0 / (b.z - a) * (yz - ya), greatest(0.05, l.y - (minutes - l.z) * 0.01)) AS pts FROM trips t JOIN l USING (kind, mode) LEFT JOIN b ON b.kind = t.kind AND b.mode = t.mode AND minutes > a AND minutes <= b.z),
  q AS (SELECT subject, kind, place_id, max(pts) AS pts FROM p GROUP BY ALL), r AS (SELECT subject, kind, least(100, max(pts) + CASE WHEN count(*) FILTER (WHERE pts >= 70) >= 2 THEN 5 ELSE 0 END) AS pts FROM q GROUP BY ALL)
  SELECT subject, round(sum(pts * CASE kind WHEN 'airport' THEN 0.6 ELSE 0.4 END), 6) AS score FROM r GROUP BY subject""")
def _(i):
    trips = i.table("lineitem").select(
        F.col("l_partkey").alias("subject"), F.col("l_suppkey").alias("place_id"), F.when(F.col("l_suppkey") % 2 == 0, "airport").otherwise("rail").alias("kind"),
        F.when(F.col("l_linenumber") % 2 == 0, "TRANSIT").otherwise("DRIVE").alias("mode"), (F.col("l_quantity") * 3).alias("minutes"))
    return op.long_distance_score(trips).select("subject", F.round("score", 6).alias("score"))


@query("topk_destinations", f"""WITH {_NEAR}, r AS (SELECT subject, place_id, row_number() OVER (PARTITION BY subject ORDER BY ofs * 0.7 + least(1.0, reviews / 1000.0) * 0.3 DESC, km, place_id) AS rank FROM (SELECT *, coalesce(ofsted, 0) / 4.0 AS ofs FROM near WHERE km <= 2) n)
  SELECT * FROM r WHERE rank <= 4""", "coords places")
def _(i):
    near = op.near_places(points(i), places(i), 2.0)
    worth = F.coalesce("ofsted", F.lit(0)) / 4.0 * 0.7 + F.least(F.lit(1.0), F.col("reviews") / 1000.0) * 0.3
    return first_k(near.withColumn("worth", worth), ["subject"], [F.desc("worth"), "km", "place_id"], 4).select("subject", "place_id", "rank")


_CDF = "b(t, p, t2, p2) AS (VALUES " + ", ".join(f"({a}, {p}, {b}, {q})" for (a, p), (b, q) in zip(curves.COMMUTE_CDF, curves.COMMUTE_CDF[1:])) + ")"
_BEATS = "(CASE WHEN {m} <= 5 THEN 99 WHEN {m} >= 120 THEN 0.5 ELSE round(100 - (SELECT p + ({m} - t) / (t2 - t) * (p2 - p) FROM b WHERE {m} > t AND {m} <= t2), 1) END)"
_HUBW = "CASE WHEN hub IN ('Bank','Liverpool Street','Oxford Circus','Canary Wharf','London Bridge','Waterloo','Victoria','King''s Cross','Farringdon') THEN 3 WHEN hub IN ('Paddington','Old Street','Stratford','Hammersmith') THEN 2 ELSE 1 END"
# Hub weights; any other hub counts 1.
HUB_WEIGHTS = {3: ("Bank", "Liverpool Street", "Oxford Circus", "Canary Wharf", "London Bridge", "Waterloo", "Victoria", "King's Cross", "Farringdon"), 2: ("Paddington", "Old Street", "Stratford", "Hammersmith")}


def hub_minutes(i):
    w = F.when(F.col("hub").isin(*HUB_WEIGHTS[3]), 3).when(F.col("hub").isin(*HUB_WEIGHTS[2]), 2).otherwise(1)
    return i.commute.where("minutes IS NOT NULL").groupBy("sector").agg((F.sum(F.col("minutes") * w) / F.sum(w)).alias("hub_minutes"), F.avg("minutes").alias("mean_minutes"))


@query("agg_hub_minutes", f"SELECT sector, round(sum(minutes * {_HUBW}) / sum({_HUBW}), 6) AS hub_minutes, round(avg(minutes), 6) AS mean_minutes FROM commute WHERE minutes IS NOT NULL GROUP BY sector", "commute")
def _(i):
    return hub_minutes(i).select("sector", F.round("hub_minutes", 6).alias("hub_minutes"), F.round("mean_minutes", 6).alias("mean_minutes"))


_COMMUTE_SCORE = f"""{_CDF}, hm AS (SELECT sector, sum(minutes * {_HUBW}) / sum({_HUBW}) AS hub_minutes FROM commute WHERE minutes IS NOT NULL GROUP BY sector),
 cs AS (SELECT s.postcode, CASE WHEN hub_minutes IS NULL THEN {_BEATS.format(m='(15 + community / 2)')} ELSE 0.4 * {_BEATS.format(m='(15 + community / 2)')} + 0.6 * {_BEATS.format(m='hub_minutes')} END AS commute_score, s.environment AS transit_score FROM scores s LEFT JOIN hm USING (sector))"""


def commute_scores(i):
    w = F.when(F.col("hub").isin(*HUB_WEIGHTS[3]), 3).when(F.col("hub").isin(*HUB_WEIGHTS[2]), 2).otherwise(1)
    known = i.commute.where("minutes IS NOT NULL")
    hm = known.groupBy("sector").agg((F.sum(F.col("minutes") * w) / F.sum(w)).alias("hub_minutes"))
    direct, hub = curves.commute_percentile(F.col("community") / 2 + 15), curves.commute_percentile(F.col("hub_minutes"))
    mixed = F.when(F.col("hub_minutes").isNull(), direct).otherwise(direct * 0.4 + hub * 0.6)
    return i.scores.join(hm, "sector", "left").select("postcode", mixed.alias("commute_score"), F.col("environment").alias("transit_score"))


@query("score_commute", f"WITH {_COMMUTE_SCORE} SELECT postcode, round(commute_score, 4) AS commute_score FROM cs", "scores commute")
def _(i):
    return commute_scores(i).select("postcode", F.round("commute_score", 4).alias("commute_score"))


@query("score_transport", f"WITH {_COMMUTE_SCORE} SELECT postcode, round(CASE WHEN commute_score IS NULL THEN transit_score WHEN transit_score IS NULL THEN commute_score ELSE commute_score * 0.6 + transit_score * 0.4 END, 4) AS score FROM cs", "scores commute")
def _(i):
    s = curves.weighted_mean([(F.col("commute_score"), 0.6), (F.col("transit_score"), 0.4)])
    return commute_scores(i).select("postcode", F.round(s, 4).alias("score"))


@query("score_community", """SELECT postcode, round(CASE WHEN crime IS NULL AND imd IS NULL THEN NULL WHEN crime IS NULL THEN imd WHEN imd IS NULL THEN crime ELSE crime * 0.4 + imd * 0.6 END, 6) AS score FROM (
   SELECT postcode, CASE WHEN transport IS NOT NULL THEN greatest(2, least(98, 100 - transport)) WHEN community IS NOT NULL THEN CASE WHEN r <= 3 THEN 95 WHEN r <= 6 THEN 110 - r * 5 WHEN r <= 10 THEN 125 - r * 7.5 WHEN r <= 15 THEN 90 - r * 4 WHEN r <= 25 THEN 60 - r * 2 ELSE greatest(2, 22.5 - r * 0.5) END END AS crime,
     CASE WHEN d >= 1 THEN 10 + (d - 1) * 10 END AS imd FROM (SELECT *, community * 15 / 45000 * 1000 AS r, floor(schools / 10)::INT - 4 AS d FROM scores) a) b""", "scores")
def _(i):
    # transport stands for the crime percentile, community for a count, schools for the decile
    rate = F.col("community") * 15 / 45000 * 1000
    d = F.floor(F.col("schools") / 10).cast("int") - 4
    crime = F.when(F.col("transport").isNotNull(), F.greatest(F.lit(2.0), F.least(F.lit(98.0), 100 - F.col("transport")))).otherwise(curves.crime_rate_score(rate))
    imd = F.when(d >= 1, 10.0 + (d - 1) * 10)
    return i.scores.select("postcode", F.round(curves.weighted_mean([(crime, 0.4), (imd, 0.6)]), 6).alias("score"))


@query("score_environment", "SELECT postcode, round((coalesce(transport, 0) + coalesce(community, 0) + coalesce(environment, 0) + coalesce(price, 0)) / nullif((transport IS NOT NULL)::INT + (community IS NOT NULL)::INT + (environment IS NOT NULL)::INT + (price IS NOT NULL)::INT, 0), 6) AS score FROM scores", "scores")
def _(i):
    # four of the stored dimensions stand for noise, flood, air and parks
    return i.scores.select("postcode", F.round(curves.weighted_mean([(F.col(c), 0.25) for c in ("transport", "community", "environment", "price")]), 6).alias("score"))


@query("score_schools", f"""WITH {_NEAR}, n AS (SELECT * EXCLUDE (km), round(km, 3) AS km FROM near WHERE km <= 1.5 AND ofsted IS NOT NULL),
  g AS (SELECT subject, sum((5 - ofsted) * exp(-0.5 * km)) / sum(exp(-0.5 * km)) AS q, count(*) FILTER (WHERE ofsted = 1 AND km <= 1) AS t, count(*) FILTER (WHERE ofsted <= 2 AND km <= 1) AS gd, bool_or(phase IN ('primary', 'all-through')) AS pr, bool_or(phase IN ('secondary', 'all-through')) AS se, count(*) AS rated,
    count(*) FILTER (WHERE ofsted >= 3) AS poor, count(*) FILTER (WHERE ofsted = 4) AS worst FROM n GROUP BY subject),
  s AS (SELECT subject, rated, 0.4 * (q - 1) / 3 * 100 + 0.3 * least(100, CASE t WHEN 0 THEN 0 WHEN 1 THEN 40 WHEN 2 THEN 65 WHEN 3 THEN 80 ELSE least(100, 80 + t * 5) END + least(20, gd * 3))
    + 0.1 * least(100, pr::INT * 30 + se::INT * 30 + (rated >= 2)::INT * 10 + (rated >= 5)::INT * 10 + (rated >= 10)::INT * 10 + (rated >= 15)::INT * 10)
    + 0.2 * CASE WHEN poor = 0 THEN 100 ELSE greatest(0, greatest(0, 100 - poor * 120.0 / rated) - worst * 15) END AS sc FROM g)
  SELECT spaced AS subject, coalesce(rated, 0) AS rated, round(coalesce(sc, 40), 6) AS score FROM coords LEFT JOIN s ON subject = spaced""", "coords places")
def _(i):
    return op.school_score(points(i), places(i)).select("subject", "rated", F.round("score", 6).alias("score"))


_STATS = f"""{_NEAR}, st AS (SELECT subject, count(*) AS total, count(*) FILTER (WHERE rating >= 4.0) AS high_rated, count(*) FILTER (WHERE reviews >= 100) AS popular, (sum(round(rating * 10)::BIGINT) FILTER (WHERE rating > 0)) / (count(*) FILTER (WHERE rating > 0)) / 10 AS mean_rating,
  sum(CASE kind WHEN 'supermarket' THEN 1.5 WHEN 'restaurant' THEN 1.2 WHEN 'gym' THEN 1.0 ELSE 0 END)::DOUBLE AS weighted, count(DISTINCT kind) FILTER (WHERE kind <> 'cafe') AS categories FROM near WHERE km <= 1.0 GROUP BY subject)"""


_TYPES = f"""{_STATS}, t AS (SELECT subject, place_id, name, coalesce(rating, 0) AS rating, km, unnest(CASE place_id % 3 WHEN 0 THEN [kind, 'food'] WHEN 1 THEN [kind, 'grocery_store'] ELSE [kind] END) AS type FROM near WHERE km <= 1.0),
  k AS (SELECT *, row_number() OVER (PARTITION BY subject, category ORDER BY km, place_id, type) AS q FROM (SELECT *, CASE type WHEN 'supermarket' THEN 'supermarket' WHEN 'grocery_store' THEN 'supermarket' WHEN 'restaurant' THEN 'restaurant' WHEN 'gym' THEN 'gym' END AS category FROM t) x WHERE category IS NOT NULL),
  c AS (SELECT subject, category, count(*) AS total, coalesce((sum(round(rating * 10)::BIGINT) FILTER (WHERE rating > 0)) / (count(*) FILTER (WHERE rating > 0)) / 10, 0) AS mean_rating, string_agg(name, '|' ORDER BY q) FILTER (WHERE q <= 3) AS examples FROM k GROUP BY ALL)"""


@query("agg_place_stats", f"""WITH {_TYPES} SELECT subject, 'all' AS category, total, high_rated, popular, round(mean_rating, 6) AS mean_rating, round(weighted, 4) AS weighted, (SELECT count(*) FROM c WHERE c.subject = st.subject) AS categories, NULL AS examples FROM st
  UNION ALL SELECT subject, category, total, NULL, NULL, round(mean_rating, 6), NULL, NULL, examples FROM c""", "coords places")
def _(i):
    # a row for all venues and one for each category; some venues have a second type
    kind = F.col("kind")
    second = F.when(F.col("place_id") % 3 == 0, F.array(kind, F.lit("food"))).when(F.col("place_id") % 3 == 1, F.array(kind, F.lit("grocery_store"))).otherwise(F.array(kind))
    near = op.near_places(points(i), places(i), 1.0).withColumn("types", second)
    by = op.place_categories(near).withColumn("mean_rating", F.round("mean_rating", 6))
    many = by.groupBy("subject").agg(F.count(F.lit(1)).alias("categories"))
    s = op.place_stats(near).drop("categories").join(many, "subject", "left").fillna(0, ["categories"])
    s = s.withColumn("mean_rating", F.round("mean_rating", 6)).withColumn("weighted", F.round("weighted", 4)).withColumn("category", F.lit("all"))
    return s.unionByName(by, allowMissingColumns=True)


@query("score_amenities", f"""WITH {_STATS} SELECT subject, round(CASE WHEN w >= 25 THEN 40 WHEN w >= 20 THEN 35 WHEN w >= 15 THEN 30 WHEN w >= 10 THEN 25 WHEN w >= 5 THEN 20 ELSE w * 3 END
  + least(40, CASE WHEN m >= 4.3 THEN 20 WHEN m >= 4.0 THEN 17 WHEN m >= 3.8 THEN 14 WHEN m >= 3.5 THEN 10 ELSE m * 5 END + high_rated * 10.0 / total + popular * 10.0 / total) + CASE WHEN categories >= 2 THEN 8 ELSE categories * 3 END, 6) AS score
  FROM (SELECT *, round(weighted, 4) AS w, coalesce(mean_rating, 0) AS m FROM st) x""", "coords places")
def _(i):
    s = op.place_stats(op.near_places(points(i), places(i), 1.0)).withColumn("weighted", F.round("weighted", 4))
    return op.amenity_score(s).select("subject", F.round("score", 6).alias("score"))


@query("score_price", f"""WITH {PAIRS}, g AS (SELECT postcode, """ + ", ".join(f"sum(round(annual_return * 100)::BIGINT * round(years_held * 100)::BIGINT) FILTER (WHERE year(sale_date) >= {YEAR - w}) / nullif(sum(round(years_held * 100)::BIGINT) FILTER (WHERE year(sale_date) >= {YEAR - w}), 0) / 100 AS c{w}" for w in (3, 5, 10)) + """,
   stddev_samp(annual_return) AS sd, count(*) AS n FROM pairs GROUP BY postcode), p AS (SELECT postcode, avg(price) AS ap FROM sales GROUP BY postcode),
  x AS (SELECT *, coalesce(c10, c5) AS lt, coalesce(c3, c5) AS mo FROM p LEFT JOIN g USING (postcode))
  SELECT postcode, round(0.35 * 100 / (1 + exp(-3 * (ap / 550000 - 1))) + """ + " + ".join(f"{w} * CASE WHEN {v} IS NULL THEN 50 WHEN {v} >= 10 THEN 100 WHEN {v} >= 7 THEN 92 + ({v} - 7) * 2.67 WHEN {v} >= 5 THEN 82 + ({v} - 5) * 5 WHEN {v} >= 3 THEN 68 + ({v} - 3) * 7 WHEN {v} >= 0 THEN 50 + {v} * 6 ELSE greatest(0, 50 + {v} * 5) END" for w, v in ((0.3, "lt"), (0.2, "mo"))) + """
   + 0.1 * CASE WHEN sd IS NOT NULL AND n >= 5 THEN 100 / (1 + exp(0.15 * (sd - 10))) ELSE 50 END + 0.05 * CASE WHEN n > 0 THEN 100 / (1 + exp(-0.1 * (n - 30))) ELSE 50 END, 4) AS score FROM x""", "sales")
def _(i):
    pairs = sale_op.repeat_sales(i.sales)
    growth = sale_op.area_growth(pairs, ["postcode"], YEAR)
    sd = pairs.groupBy("postcode").agg(F.stddev_samp("annual_return").alias("return_sd"), F.count(F.lit(1)).alias("pairs"))
    rows = i.sales.groupBy("postcode").agg(F.avg("price").alias("average_price")).join(growth, "postcode", "left").join(sd, "postcode", "left")
    return rows.select("postcode", F.round(op.price_score(rows), 4).alias("score"))


@query("score_demographics", "SELECT c_custkey, round(0.30 * s1 + 0.15 * s2 + 0.15 * s3 + 0.15 * s4 + 0.15 * s5 + 0.10 * s6, 6) AS score FROM (SELECT c_custkey, " + ", ".join(f"CASE WHEN (c_custkey // {p}) % 11 BETWEEN 1 AND 10 THEN 22 + ((c_custkey // {p}) % 11) * 7.8::DOUBLE ELSE 50 END AS s{n}" for n, p in enumerate((1, 2, 3, 5, 7, 11), 1)) + " FROM customer) t")
def _(i):
    w = (0.30, 0.15, 0.15, 0.15, 0.15, 0.10)
    parts = [(curves.decile_score(F.floor(F.col("c_custkey") / p) % 11), x) for p, x in zip((1, 2, 3, 5, 7, 11), w)]
    return i.table("customer").select("c_custkey", F.round(curves.weighted_mean(parts), 6).alias("score"))


@query("score_value_for_money", """SELECT id, round(CASE WHEN pc <= 25 THEN least(100, b + 10) WHEN pc >= 75 THEN greatest(30, b - 10) ELSE b END, 6) AS value_score,
   round(CASE WHEN fees <= 2000 THEN 100 WHEN fees <= 3000 THEN 85 WHEN fees <= 4000 THEN 70 WHEN fees <= 5000 THEN 55 ELSE greatest(30, 100 - (fees - 5000) / 100) END, 6) AS fee_score,
   round(least(100, greatest(20, CASE WHEN c5 >= 8 THEN 100 WHEN c5 >= 5 THEN 85 WHEN c5 >= 3 THEN 70 WHEN c5 >= 1 THEN 55 WHEN c5 >= 0 THEN 45 ELSE greatest(20, 45 + c5 * 5) END + CASE WHEN c5 > 3 THEN 10 WHEN c5 < -3 THEN -15 ELSE 0 END + CASE WHEN c3 > c5 + 2 THEN 5 WHEN c3 < c5 - 2 THEN -5 ELSE 0 END)), 6) AS growth_score
  FROM (SELECT *, CASE WHEN vm <= -15 THEN 100 WHEN vm <= -10 THEN 90 WHEN vm <= -5 THEN 80 WHEN vm <= 5 THEN 70 WHEN vm <= 10 THEN 60 WHEN vm <= 15 THEN 50 ELSE greatest(30, 65 - vm) END AS b
   FROM (SELECT id, (id % 61)::DOUBLE - 25 AS vm, id % 100 AS pc, coalesce(service_charge, 0) + coalesce(ground_rent, 0) + 1500 AS fees, (id % 17)::DOUBLE - 5 AS c5, (id % 13)::DOUBLE - 3 AS c3 FROM listings) a) x""", "listings")
def _(i):
    k = F.col("id")
    c5, c3 = (k % 17).cast("double") - 5, (k % 13).cast("double") - 3
    trend = F.when(c5 > 3, "up").when(c5 < -3, "down").otherwise("stable")
    fees = F.coalesce("service_charge", F.lit(0.0)) + F.coalesce("ground_rent", F.lit(0.0)) + 1500
    return i.listings.select("id", F.round(op.value_for_money((k % 61).cast("double") - 25, k % 100), 6).alias("value_score"), F.round(op.fee_score(fees), 6).alias("fee_score"), F.round(op.appreciation(c5, c3, trend), 6).alias("growth_score"))


@query("score_surroundings", """SELECT id, round(0.3 * CASE WHEN cr <= 150 THEN 100 WHEN cr <= 350 THEN 130 - cr * 0.2 ELSE greatest(0, 60 - (cr - 350) * 60.0 / 650) END + 0.2 * (0.5 * CASE WHEN pm <= 200 THEN 100 WHEN pm <= 500 THEN 85 WHEN pm <= 1000 THEN 70 ELSE 50 END + 0.2 * least(100, pk * 25) + 0.3 * least(100, gp * 2))
   + 0.25 * (0.6 * CASE WHEN aq <= 50 THEN 100 WHEN aq <= 100 THEN 80 WHEN aq <= 150 THEN 60 ELSE 40 END + 0.4 * least(100, rd / 5.0)) + 0.15 * (0.8 * cl + 10) + 0.1 * (27 + 42.5 + 0.2 * least(100, ev * 20)), 6)::DOUBLE AS score
  FROM (SELECT id, id % 900 AS cr, (id * 7) % 1300 AS pm, id % 6 AS pk, id % 70 AS gp, (id * 3) % 200 AS aq, (id * 5) % 700 AS rd, CASE id % 5 WHEN 0 THEN 100 WHEN 1 THEN 85 WHEN 2 THEN 70 WHEN 3 THEN 50 ELSE 30 END AS cl, id % 7 AS ev FROM listings) t""", "listings")
def _(i):
    k = F.col("id")
    clean = F.element_at(F.array(*[F.lit(x) for x in ("Excellent", "Good", "Fair", "Poor", "Very Poor")]), (k % 5 + 1).cast("int"))
    return i.listings.select("id", F.round(op.surroundings(k % 900, k * 7 % 1300, k % 6, (k % 70).cast("double"), k * 3 % 200, k * 5 % 700, clean, k % 7), 6).alias("score"))


def parks(i):
    """Square parks around the suppliers, as ring text that the reader parses."""
    half = (F.col("place_id") % 5 + 1) * 0.0006
    lat, lon = F.col("latitude"), F.col("longitude")
    corner = lambda dx, dy: F.array(lon + half * dx, lat + half * dy)
    ring = F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1), corner(-1, -1))
    text = i.places.select(F.col("place_id").alias("park_id"), "name", F.to_json(F.array(ring)).alias("rings_json"))
    return text.withColumn("rings", F.from_json("rings_json", "array<array<array<double>>>"))


@query("scan_polygons")
def _(i):
    # rows only: ring text has no SQL twin; a unit square is pinned in the tests
    return op.polygon_rows(parks(i)).select("park_id", "name", F.round("area_m2", 3).alias("area_m2"))


@query("join_point_polygon_near")
def _(i):
    return op.parks_near(points(i), op.polygon_rows(parks(i))).select("subject", "park_id", F.round("metres", 3).alias("metres"))


@query("score_green")
def _(i):
    return op.green_score(op.parks_near(points(i), op.polygon_rows(parks(i))))


@query("topk_named_parks")
def _(i):
    return op.named_parks(op.parks_near(points(i), op.polygon_rows(parks(i)))).select("subject", "name", "rank", F.floor("metres").alias("metres"))


@query("win_percentile_rank", """WITH w AS (SELECT postcode, score FROM score_docs WHERE score IS NOT NULL AND created_on > DATE '2010-01-01' AND data_version = 'v2')
  SELECT score, count(*) AS at_score, 1 + (SELECT count(*) FROM w b WHERE b.score > a.score) AS rank, (SELECT count(*) FROM w) AS total,
   round(CASE WHEN (SELECT count(*) FROM w) = 1 THEN 100 ELSE greatest(0, ((SELECT count(*) FROM w) - (1 + (SELECT count(*) FROM w b WHERE b.score > a.score))) * 100.0 / ((SELECT count(*) FROM w) - 1)) END, 6) AS percentile FROM w a GROUP BY score""", "score_docs")
def _(i):
    rows = i.score_docs.where("score IS NOT NULL AND created_on > DATE'2010-01-01' AND data_version = 'v2'")
    t = tally_before(rows, [], "score")
    above = F.col("total") - F.col("below") - F.col("own")
    share = F.when(F.col("total") == 1, 100.0).otherwise(F.greatest(F.lit(0.0), (F.col("total") - above - 1) / (F.col("total") - 1) * 100))
    return t.select("score", F.col("own").alias("at_score"), (above + 1).alias("rank"), "total", F.round(share, 6).alias("percentile"))


@query("agg_cache_statistics", "SELECT data_version, count(DISTINCT postcode) AS keys, count(*) AS n, round(avg(score), 6) AS mean, min(score) AS low, max(score) AS high FROM score_docs WHERE created_on > DATE '2022-06-01' - 3650 GROUP BY data_version", "score_docs")
def _(i):
    rows = i.score_docs.where("created_on > date_sub(DATE'2022-06-01', 3650)")
    return rows.groupBy("data_version").agg(F.count_distinct("postcode").alias("keys"), F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.min("score").alias("low"), F.max("score").alias("high"))
