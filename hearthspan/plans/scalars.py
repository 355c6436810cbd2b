"""Scalar queries: postcodes, labels, curves, costs, angles, text."""

from pyspark.sql import functions as F

from hearthspan.functions import curves, geo, labels, money, postcode, text
from hearthspan.functions.rank import group_quantiles
from hearthspan.operators import spatial
from hearthspan.plans.base import query

_C = "upper(regexp_replace(raw, '\\s+', '', 'g'))"


@query("postcode_normalise", f"SELECT k, CASE WHEN length({_C}) < 5 THEN {_C} ELSE {_C}[:-4] || ' ' || {_C}[-3:] END AS pc FROM mixed_postcodes", "mixed_postcodes")
def _(i):
    return i.mixed_postcodes.select("k", postcode.normalise(F.col("raw")).alias("pc"))


@query("postcode_extract", """SELECT address_key, CASE WHEN hit <> '' THEN replace(hit, ' ', '')[:-4] || ' ' || replace(hit, ' ', '')[-3:] END AS pc
  FROM (SELECT DISTINCT address_key, regexp_extract(upper('Flat 2, ' || street || ', London ' || CASE WHEN address_key % 5 = 0 THEN '' ELSE lower(postcode) END), '\\b([A-Z]{1,2}[0-9][0-9A-Z]?\\s*[0-9][A-Z]{2})\\b', 1) AS hit FROM sales) t""", "sales")
def _(i):
    line = F.concat(F.lit("Flat 2, "), "street", F.lit(", London "), F.when(F.col("address_key") % 5 == 0, "").otherwise(F.lower("postcode")))
    return i.sales.select("address_key", postcode.extract(line).alias("pc")).distinct()


@query("postcode_scope", """SELECT k, CASE WHEN regexp_full_match(t, '\\S+ [0-9][A-Z]{2}') THEN 'unit' WHEN regexp_full_match(t, '\\S+ [0-9]') THEN 'sector'
   WHEN regexp_full_match(t, '[A-Z]{1,2}[0-9]{1,2}[A-Z]?[0-9][A-Z]{2}') THEN 'unit' ELSE 'outcode' END AS scope FROM (SELECT k, trim(regexp_replace(upper(raw), '\\s+', ' ', 'g')) AS t FROM mixed_postcodes) x""", "mixed_postcodes")
def _(i):
    return i.mixed_postcodes.select("k", postcode.scope(F.col("raw")).alias("scope"))


@query("postcode_parts", f"""SELECT k, CASE WHEN m[1] <> '' THEN m[1] END AS outcode, CASE WHEN m[1] <> '' THEN m[1] || ' ' || m[2] END AS sector, CASE WHEN m[1] <> '' THEN m[2] END AS digit
  FROM (SELECT k, [regexp_extract({_C}, '^([A-Z]{{1,2}}[0-9][A-Z0-9]?)([0-9])([A-Z]{{2}})$', 1), regexp_extract({_C}, '^([A-Z]{{1,2}}[0-9][A-Z0-9]?)([0-9])([A-Z]{{2}})$', 2)] AS m FROM mixed_postcodes) x""", "mixed_postcodes")
def _(i):
    return i.mixed_postcodes.select("k", postcode.parts(F.col("raw")).alias("p")).select("k", "p.*")


@query("postal_area", f"SELECT regexp_extract({_C}, '^[A-Z]+') AS area, count(*) AS n FROM mixed_postcodes GROUP BY 1", "mixed_postcodes")
def _(i):
    return i.mixed_postcodes.groupBy(postcode.postal_area(F.col("raw")).alias("area")).agg(F.count(F.lit(1)).alias("n"))


@query("coverage_flag", f"SELECT k, CASE WHEN regexp_extract({_C}, '^[A-Z]+') IN ({', '.join(repr(a) for a in postcode.COVERED)}) THEN 1 ELSE 0 END AS is_covered FROM mixed_postcodes", "mixed_postcodes")
def _(i):
    return i.mixed_postcodes.select("k", postcode.covered(F.col("raw")).cast("int").alias("is_covered"))


# the character behind a district decides: a further digit makes it another district
@query("area_type", f"""WITH t AS (SELECT k, upper(replace(trim(raw), ' ', '')) AS c FROM mixed_postcodes), h AS (SELECT t.k, bool_or(starts_with(c, d) AND NOT contains('0123456789', coalesce(nullif(substr(c, len(d) + 1, 1), ''), '-'))) AS hub
    FROM t, (SELECT unnest({list(postcode.HUB_DISTRICTS)}) AS d) x GROUP BY t.k)
  SELECT t.k, CASE WHEN c = '' THEN 'urban' WHEN left(c, 2) IN {postcode.CENTRAL} THEN 'central_commercial' WHEN hub THEN 'major_hub' WHEN left(c, 2) IN {postcode.OUTER} THEN 'residential' ELSE 'urban' END AS area_type FROM t JOIN h USING (k)""", "mixed_postcodes")
def _(i):
    return i.mixed_postcodes.select("k", postcode.area_type(F.col("raw")).alias("area_type"))


@query("property_kind", """SELECT id, CASE WHEN property_type IS NULL OR property_type = 'Land' THEN 'other' WHEN property_type IN ('Flat', 'Maisonette', 'Studio', 'Penthouse') THEN 'flat' ELSE 'house' END AS kind FROM listings""", "listings")
def _(i):
    return i.listings.select("id", labels.property_kind(F.col("property_type")).alias("kind"))


@query("type_bucket", """SELECT id, CASE WHEN property_type IN ('Flat', 'Maisonette', 'Studio', 'Penthouse') THEN 'flat' WHEN property_type IN ('Terraced', 'Semi-Detached', 'Detached', 'Bungalow', 'House') THEN 'house' END AS two,
  CASE WHEN property_type IN ('Flat', 'Maisonette', 'Studio', 'Penthouse') THEN 'flat' WHEN property_type = 'Terraced' THEN 'terraced' WHEN property_type LIKE 'Semi%' THEN 'semi' WHEN property_type = 'Detached' THEN 'detached' WHEN property_type = 'Bungalow' THEN 'other' END AS five FROM listings""", "listings")
def _(i):
    t = F.col("property_type")
    return i.listings.select("id", labels.bucket_of_two(t).alias("two"), labels.bucket_of_five(t).alias("five"))


@query("type_codes", """SELECT id, CASE WHEN property_type IN ('Flat', 'Maisonette', 'Studio', 'Penthouse') THEN 'F' WHEN property_type IN ('Terraced', 'Semi-Detached', 'Detached', 'Bungalow', 'House') THEN 'D,S,T' END AS codes FROM listings""", "listings")
def _(i):
    return i.listings.select("id", F.array_join(labels.type_codes(F.col("property_type")), ",").alias("codes"))


@query("description_contradiction", """SELECT id, trim(t[greatest(1, strpos(t, hit) - 40):strpos(t, hit) + length(hit) + 39]) AS snippet FROM (
   SELECT id, t, regexp_extract(t, '(?i)(maisonette|bedroom apartment|floor apartment|this apartment)', 1) AS hit FROM (
   SELECT id, regexp_replace(regexp_replace(description, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g') AS t FROM listings WHERE property_type IN ('Terraced', 'Semi-Detached', 'Detached', 'Bungalow', 'House')) a) b
  WHERE hit <> '' AND NOT regexp_matches(t, '(?i)family home|freehold house|this house\\b|cottage\\b|bungalow\\b|converted into|arranged as|self[- ]contained')""", "listings")
def _(i):
    rows = i.listings.where(labels.property_kind(F.col("property_type")) == "house")
    return rows.select("id", labels.reads_as_flat(F.col("description")).alias("snippet")).where("snippet IS NOT NULL")


def sale_address():
    return F.concat_ws(", ", "saon", F.when(F.col("address_key") % 2 == 0, F.concat_ws(" ", "paon", "street")).otherwise(F.concat_ws(", ", "paon", "street")))


@query("address_features")
def _(i):
    # rows only: the chain of readings has no short SQL twin; cases are pinned in the tests
    rows = i.sales.select("address_key", sale_address().alias("address")).distinct()
    return labels.with_address_features(rows, "address", "f").select("address_key", "f.*")


@query("address_key", f"""SELECT DISTINCT address_key, CASE WHEN saon IS NOT NULL THEN 'FLAT' || replace(saon, 'FLAT ', '') ELSE paon END AS match_key FROM sales""", "sales")
def _(i):
    rows = i.sales.select("address_key", sale_address().alias("address")).distinct()
    return labels.with_address_features(rows, "address", "f").select("address_key", F.col("f_key").alias("match_key"))


@query("address_match_score", """WITH a AS (SELECT DISTINCT address_key, saon, paon, street FROM sales), b AS (SELECT cert_no, a.saon, a.paon, a.street FROM certificates JOIN a ON a.address_key = cert_no)
  SELECT address_key, CASE WHEN a.saon IS NOT NULL THEN 3 + CASE WHEN address_key % 2 = 0 AND address_key % 3 <> 0 THEN 1 ELSE 0 END ELSE 2 END AS score FROM a JOIN b ON b.cert_no = a.address_key""", "sales certificates")
def _(i):
    rows = i.sales.select("address_key", sale_address().alias("address")).distinct().join(i.certificates.withColumnRenamed("cert_no", "address_key"), "address_key")
    rows = labels.with_address_features(labels.with_address_features(rows, "address", "a"), "cert_address", "b")
    return rows.select("address_key", labels.match_score(F.col("a"), F.col("b")).alias("score"))


_HAV = "2 * {r} * asin(sqrt(pow(sin(radians(51.53 - latitude) / 2), 2) + cos(radians(latitude)) * cos(radians(51.53)) * pow(sin(radians(-0.19 - longitude) / 2), 2)))"


@query("haversine", f"SELECT spaced, round({_HAV.format(r=6371)}, 6) AS km, round({_HAV.format(r=3958.8)}, 6) AS miles FROM coords", "coords")
def _(i):
    at = (F.col("latitude"), F.col("longitude"), F.lit(51.53), F.lit(-0.19))
    return i.coords.select("spaced", F.round(spatial.haversine(*at), 6).alias("km"), F.round(spatial.haversine(*at, radius=3958.8), 6).alias("miles"))


@query("planar_distance", "SELECT spaced, round(sqrt(pow((51.53 - latitude) * 110.574, 2) + pow((-0.19 - longitude) * 111.320 * cos(radians(latitude)), 2)), 6) AS km FROM coords", "coords")
def _(i):
    return i.coords.select("spaced", F.round(spatial.planar_km(F.col("latitude"), F.col("longitude"), F.lit(51.53), F.lit(-0.19)), 6).alias("km"))


@query("grid_to_latlon")
def _(i):
    # rows only: an iterated series; the tests pin a published worked example
    east, north = F.lit(500000.0) + F.col("c_custkey") * 37 % 60000, F.lit(150000.0) + F.col("c_custkey") * 53 % 60000
    return i.table("customer").select("c_custkey", geo.grid_to_lonlat(east, north).alias("p")).select("c_custkey", F.round("p.lat", 7).alias("lat"), F.round("p.lon", 7).alias("lon"))


@query("square_bbox", """SELECT spaced, round(latitude - 0.5 / 111, 8) AS south, round(longitude - 0.5 / (111 * cos(radians(latitude))), 8) AS west, round(latitude + 0.5 / 111, 8) AS north, round(longitude + 0.5 / (111 * cos(radians(latitude))), 8) AS east FROM coords""", "coords")
def _(i):
    boxed = i.coords.select("spaced", geo.square_box(F.col("latitude"), F.col("longitude")).alias("b"))
    return boxed.select("spaced", *[F.round(f"b.{c}", 8).alias(c) for c in ("south", "west", "north", "east")])


@query("walk_minutes", f"SELECT property_id, round(distance_miles * 20, 6) AS station_minutes, round(distance_miles * 1.3 / 5 * 60, 6) AS walk_minutes FROM nearest_stations", "nearest_stations")
def _(i):
    d = F.col("distance_miles")
    return i.nearest_stations.select("property_id", F.round(d * 20, 6).alias("station_minutes"), F.round(spatial.walk_minutes(d), 6).alias("walk_minutes"))


@query("time_adjust", "SELECT address_key, tie1, tie2, price, round(price * pow(1 + 0.031, date_diff('day', sale_date, DATE '2022-06-01') / 365.25), 4) AS adjusted FROM sales", "sales")
def _(i):
    years = F.datediff(F.lit("2022-06-01").cast("date"), "sale_date") / F.lit(365.25)
    return i.sales.select("address_key", "tie1", "tie2", "price", F.round(F.col("price") * F.pow(F.lit(1.031), years), 4).alias("adjusted"))


def _curve_sql(points, x, tail=0.0, floor=None):
    segs = " ".join(f"WHEN {x} <= {b} THEN {y0} + ({x} - {a}) * 1.0 / {b - a} * ({y1 - y0})" for (a, y0), (b, y1) in zip(points, points[1:]))
    last = f"{points[-1][1]} + ({x} - {points[-1][0]}) * {tail}"
    return f"CASE WHEN {x} <= {points[0][0]} THEN {points[0][1]} {segs} ELSE {'greatest(' + str(floor) + ', ' + last + ')' if floor is not None else last} END"


@query("curve_walk_coefficient", f"SELECT property_id, round({_curve_sql(curves.WALK, '(distance_miles * 20)', -0.01, 0.05)}, 6) AS coefficient FROM nearest_stations", "nearest_stations")
def _(i):
    return i.nearest_stations.select("property_id", F.round(curves.walk_coefficient(F.col("distance_miles") * 20), 6).alias("coefficient"))


@query("curve_travel_coefficient", "WITH t AS (SELECT c_custkey, (c_custkey * 7) % 170 AS minutes, CASE WHEN c_custkey % 2 = 0 THEN 'airport' ELSE 'rail' END AS place, CASE WHEN c_custkey % 3 = 0 THEN 'DRIVE' ELSE 'TRANSIT' END AS mode FROM customer) SELECT c_custkey, round(CASE "
       + " ".join(f"WHEN place = '{p}' AND mode = '{m}' THEN {_curve_sql(pts, 'minutes', -0.01, 0.05)}" for (p, m), pts in curves.TRAVEL.items()) + " END, 6) AS coefficient FROM t")
def _(i):
    k = F.col("c_custkey")
    place, mode = F.when(k % 2 == 0, "airport").otherwise("rail"), F.when(k % 3 == 0, "DRIVE").otherwise("TRANSIT")
    return i.table("customer").select("c_custkey", F.round(curves.travel_coefficient(k * 7 % 170, place, mode), 6).alias("coefficient"))


@query("curve_growth_score", """SELECT c_custkey, round(CASE WHEN g >= 10 THEN 100 WHEN g >= 7 THEN 92 + (g - 7) * 2.67 WHEN g >= 5 THEN 82 + (g - 5) * 5 WHEN g >= 3 THEN 68 + (g - 3) * 7 WHEN g >= 0 THEN 50 + g * 6 ELSE greatest(0, 50 + g * 5) END, 6) AS score
  FROM (SELECT c_custkey, c_acctbal / 700 - 3 AS g FROM customer) t""")
def _(i):
    return i.table("customer").select("c_custkey", F.round(curves.growth_score(F.col("c_acctbal") / 700 - 3), 6).alias("score"))


@query("curve_crime_rate", """SELECT c_custkey, round(CASE WHEN r <= 3 THEN 95 WHEN r <= 6 THEN 110 - r * 5 WHEN r <= 10 THEN 125 - r * 7.5 WHEN r <= 15 THEN 90 - r * 4 WHEN r <= 25 THEN 60 - r * 2 ELSE greatest(2, 22.5 - r * 0.5) END, 6) AS rate_score,
   round(CASE WHEN n <= 150 THEN 100 WHEN n <= 350 THEN 130 - n * 0.2 ELSE greatest(0, 60 - (n - 350) * 60.0 / 650) END, 6) AS count_score FROM (SELECT c_custkey, c_acctbal / 300 AS r, c_custkey % 1100 AS n FROM customer WHERE c_acctbal IS NOT NULL) t""")
def _(i):
    return i.table("customer").select("c_custkey", F.round(curves.crime_rate_score(F.col("c_acctbal") / 300), 6).alias("rate_score"), F.round(curves.crime_count_score(F.col("c_custkey") % 1100), 6).alias("count_score"))


@query("curve_commute_steps", """WITH t AS (SELECT c_custkey, c_custkey % 100 AS m, (c_custkey % 27) * 1.0 AS km, CASE c_custkey % 4 WHEN 0 THEN 'TRANSIT' WHEN 1 THEN 'WALK' WHEN 2 THEN 'DRIVE' ELSE 'OTHER' END AS mode FROM customer),
  u AS (SELECT *, CASE WHEN m <= 15 THEN 95 WHEN m <= 25 THEN 85 WHEN m <= 35 THEN 75 WHEN m <= 45 THEN 65 WHEN m <= 60 THEN 50 WHEN m <= 75 THEN 35 ELSE greatest(15, 95 - m) END AS ts, CASE WHEN km <= 5 THEN 100 WHEN km <= 10 THEN 85 WHEN km <= 15 THEN 70 WHEN km <= 20 THEN 55 ELSE 40 END AS ds FROM t)
  SELECT c_custkey, round(CASE WHEN km <= 0 THEN ts WHEN mode = 'WALK' THEN ts * 0.7 + ds * 0.3 WHEN mode = 'DRIVE' THEN ts * 0.8 + ds * 0.2 ELSE ts * 0.9 + ds * 0.1 END, 4)::DOUBLE AS score FROM u""")
def _(i):
    k = F.col("c_custkey")
    mode = F.when(k % 4 == 0, "TRANSIT").when(k % 4 == 1, "WALK").when(k % 4 == 2, "DRIVE").otherwise("OTHER")
    return i.table("customer").select("c_custkey", F.round(curves.commute_steps(k % 100, (k % 27).cast("double"), mode), 4).alias("score"))


@query("commute_percentile", "WITH b(t, p, t2, p2) AS (VALUES " + ", ".join(f"({a}, {p}, {b}, {q})" for (a, p), (b, q) in zip(curves.COMMUTE_CDF, curves.COMMUTE_CDF[1:])) + """)
  SELECT sector, hub, round(CASE WHEN minutes <= 5 THEN 99 WHEN minutes >= 120 THEN 0.5 ELSE 100 - (p + (minutes - t) / (t2 - t) * (p2 - p)) END, 1) AS beats FROM commute LEFT JOIN b ON minutes > t AND minutes <= t2""", "commute")
def _(i):
    return i.commute.select("sector", "hub", curves.commute_percentile(F.col("minutes")).alias("beats"))


@query("noise_combine", """SELECT l_partkey, db, round(5 + 90 / (1 + exp(0.18 * (db - 63))), 1) AS score, CASE WHEN db < 50 THEN 'quiet' WHEN db < 55 THEN 'fairly_quiet' WHEN db < 60 THEN 'moderate' WHEN db < 65 THEN 'noisy' WHEN db < 70 THEN 'very_noisy' ELSE 'extremely_noisy' END AS level
  FROM (SELECT l_partkey, round(10 * log10(sum(pow(10, (40 + l_quantity / 2) / 10))), 1) AS db FROM lineitem GROUP BY l_partkey) t""")
def _(i):
    power = F.sum(F.pow(F.lit(10.0), (F.lit(40.0) + F.col("l_quantity") / 2) / 10))
    out = i.table("lineitem").groupBy("l_partkey").agg(F.round(10 * F.log10(power), 1).alias("db"))
    return out.select("l_partkey", "db", F.round(curves.noise_score(F.col("db")), 1).alias("score"), curves.noise_level(F.col("db")).alias("level"))


@query("risk_max", """WITH r(o, name, score) AS (VALUES (1, 'very_low', 100), (2, 'low', 75), (3, 'medium', 50), (4, 'high', 20)), t AS (SELECT id, coalesce(id % 4 + 1, 1) AS a, CASE WHEN id % 5 = 4 THEN 1 ELSE id % 5 + 1 END AS b FROM listings)
  SELECT id, r.name AS risk, r.score FROM t JOIN r ON r.o = greatest(a, b)""", "listings")
def _(i):
    names = F.array(*[F.lit(n) for n in ("Very low", "low", "Medium", "high")])
    a, b = F.element_at(names, (F.col("id") % 4 + 1).cast("int")), F.when(F.col("id") % 5 != 4, F.element_at(names, (F.least(F.col("id") % 5, F.lit(3)) + 1).cast("int")))
    risk = curves.risk_max(a, b)
    score = F.element_at(F.create_map(*[F.lit(x) for kv in curves.RISK_SCORES.items() for x in kv]), F.col("risk"))
    return i.listings.select("id", risk.alias("risk")).withColumn("score", score)


@query("air_quality_score", """SELECT s_suppkey, CASE WHEN n = 0 THEN 0 ELSE greatest(0, least(100, floor(5 + 95 / (1 + exp(1.5 * (t / n - 2)))))) END::BIGINT AS score, CASE WHEN n = 0 THEN 'moderate' WHEN score >= 80 THEN 'excellent' WHEN score >= 60 THEN 'good' WHEN score >= 40 THEN 'moderate' ELSE 'poor' END AS level FROM (SELECT s_suppkey, (CASE WHEN a IS NULL THEN 0 ELSE 1 END + CASE WHEN b IS NULL THEN 0 ELSE 1 END + CASE WHEN c IS NULL THEN 0 ELSE 1 END) AS n,
   coalesce(a / 10.0, 0) + coalesce(b / 5.0, 0) + coalesce(c / 15.0, 0) AS t FROM (SELECT s_suppkey, nullif(s_suppkey % 40, 0) AS a, nullif(s_suppkey % 13, 0) AS b, nullif(s_suppkey % 30, 0) AS c FROM supplier) x) y""")
def _(i):
    k = F.col("s_suppkey")
    none = (k % 40 == 0) & (k % 13 == 0) & (k % 30 == 0)
    scored = i.table("supplier").select("s_suppkey", curves.air_quality(k % 40, k % 13, k % 30).cast("bigint").alias("score"))
    return scored.withColumn("level", curves.air_level(F.col("score"), none))


@query("decile_score", """SELECT c_custkey, round(""" + " + ".join(f"{w} * CASE WHEN d{j} BETWEEN 1 AND 10 THEN 22 + d{j} * 7.8 ELSE 50 END" for j, w in enumerate((0.30, 0.15, 0.15, 0.15, 0.15, 0.10))) + """, 6)::DOUBLE AS score
  FROM (SELECT c_custkey, """ + ", ".join(f"(c_custkey * {p}) % 12 AS d{j}" for j, p in enumerate((1, 5, 7, 11, 13, 17))) + " FROM customer) t")
def _(i):
    k = F.col("c_custkey")
    parts = [curves.decile_score(k * p % 12) * w for p, w in zip((1, 5, 7, 11, 13, 17), (0.30, 0.15, 0.15, 0.15, 0.15, 0.10))]
    return i.table("customer").select("c_custkey", F.round(sum(parts), 6).alias("score"))


def _band_sql(bands, p):
    low, terms = 0, []
    for high, rate in bands:
        terms.append(f"CASE WHEN {p} > {low} THEN (least({p}, {int(high)}) - {low}) * {rate} ELSE 0 END")
        low = int(high)
    return "round_even(" + " + ".join(terms) + ", 0)::DOUBLE"


@query("banded_tax", f"""SELECT id, {_band_sql(money.STANDARD, 'p')} AS standard, CASE WHEN p <= 500000 THEN {_band_sql(money.FIRST_TIME, 'p')} ELSE {_band_sql(money.STANDARD, 'p')} END AS first_time, {_band_sql(money.NON_RESIDENTIAL, 'p')} AS non_residential
  FROM (SELECT id, asking_price * (id % 4 + 1) // 2 AS p FROM listings WHERE asking_price IS NOT NULL) t""", "listings")
def _(i):
    p = F.floor(F.col("asking_price") * (F.col("id") % 4 + 1) / 2)
    rows = i.listings.where("asking_price IS NOT NULL").select("id", p.alias("p"))
    return rows.select("id", money.banded(F.col("p"), money.STANDARD).alias("standard"), money.stamp_duty(F.col("p"), F.lit(True)).alias("first_time"), money.banded(F.col("p"), money.NON_RESIDENTIAL).alias("non_residential"))


_PAY = """WITH t AS (SELECT id, asking_price AS p, CASE WHEN id % 7 = 0 THEN 150.0 WHEN id % 7 = 1 THEN 100.0 WHEN id % 7 = 2 THEN NULL ELSE (id % 40) * 1.0 END AS d, CASE id % 6 WHEN 0 THEN NULL WHEN 1 THEN 0.0 WHEN 2 THEN 0.0525 ELSE 1.5 + (id % 9) END AS r, CASE id % 5 WHEN 0 THEN 0 ELSE 15 + id % 20 END AS y FROM listings WHERE asking_price IS NOT NULL),
  u AS (SELECT id, p, CASE WHEN d BETWEEN 0 AND 100 THEN d ELSE 10 END AS d, CASE WHEN r IS NULL OR (r > 0 AND r NOT BETWEEN 1 AND 15) THEN 5.25 ELSE r END AS r, CASE WHEN y > 0 THEN y ELSE 30 END AS y FROM t),
  pay AS (SELECT id, CASE WHEN d >= 100 THEN 0 WHEN r = 0 THEN p * (1 - d / 100) / (y * 12) ELSE p * (1 - d / 100) * (r / 1200.0) / (1 - pow(1 + r / 1200.0, -y * 12)) END AS monthly FROM u)"""


def payments(i):
    k = F.col("id")
    d = F.when(k % 7 == 0, 150.0).when(k % 7 == 1, 100.0).when(k % 7 != 2, (k % 40).cast("double"))
    r = F.when(k % 6 == 1, 0.0).when(k % 6 == 2, 0.0525).when(k % 6 != 0, F.lit(1.5) + k % 9)
    y = F.when(k % 5 == 0, 0).otherwise(k % 20 + 15)
    return i.listings.where("asking_price IS NOT NULL").withColumn("monthly", money.monthly_payment(F.col("asking_price"), d, r, y))


@query("mortgage_payment", f"{_PAY} SELECT id, round(monthly, 4) AS monthly FROM pay", "listings")
def _(i):
    return payments(i).select("id", F.round("monthly", 4).alias("monthly"))


@query("ownership_cost", f"""{_PAY} SELECT id, round(monthly + coalesce(tax, 0) / 12 + coalesce(service_charge, 0) / 12 + coalesce(ground_rent, 0) / 12, 4) AS total, CASE WHEN tax IS NULL THEN 0 ELSE 1 END AS tax_included FROM (SELECT l.id, monthly, service_charge, ground_rent,
    CASE l.council_tax_band WHEN 'A' THEN band_a WHEN 'B' THEN band_d * 7 / 9 WHEN 'C' THEN band_d * 8 / 9 WHEN 'D' THEN band_d WHEN 'E' THEN band_d * 11 / 9 WHEN 'F' THEN band_d * 13 / 9 WHEN 'G' THEN band_d * 15 / 9 WHEN 'H' THEN band_h END AS tax
  FROM pay JOIN listings l USING (id) LEFT JOIN boroughs b ON b.outcode = l.outcode LEFT JOIN (SELECT * FROM tax_rates QUALIFY row_number() OVER (PARTITION BY borough ORDER BY tax_year DESC) = 1) t ON t.borough = b.borough) z""", "listings boroughs tax_rates")
def _(i):
    from hearthspan.functions.rank import newest

    rates = newest(i.tax_rates, ["borough"], ["tax_year"])
    rows = payments(i).join(i.boroughs.select("outcode", "borough"), "outcode", "left").join(rates, "borough", "left")
    # A and H are given; the others are ninths of D
    own = F.col("council_tax_band")
    band = F.when(own == "A", F.col("band_a")).when(own == "H", F.col("band_h"))
    for letter, ninths in money.NINTHS_OF_D.items():
        band = band.when(own == letter, F.col("band_d") * ninths / 9)
    total = F.col("monthly") + money.total([band / 12, F.col("service_charge") / 12, F.col("ground_rent") / 12])
    return rows.select("id", F.round(total, 4).alias("total"), band.isNotNull().cast("int").alias("tax_included"))


def _fits(p, first):
    tax = f"CASE WHEN {p} <= 500000 THEN {_exact(money.FIRST_TIME, p)} ELSE {_exact(money.STANDARD, p)} END" if first else _exact(money.STANDARD, p)
    return f"{p} + {tax} + 21000"


def _exact(bands, p):
    low, terms = 0, []
    for high, rate in bands:
        terms.append(f"greatest(0, least({p}, {int(high)}) - {low}) * {rate}")
        low = int(high)
    return "(" + " + ".join(terms) + ")"


# the twin does not solve anything: it checks that the price fits and that one more pound does not
@query("max_affordable", f"""WITH f AS (SELECT c_custkey, 30000 + c_custkey * 1331 % 1900000 AS funds FROM customer), s AS (SELECT c_custkey, funds, unnest([0, 100000, 200000, 400000, 700000, 1100000, 1600000]) AS z FROM f),
  a AS (SELECT c_custkey, funds, funds - 21000 - greatest(0, ({_exact(money.STANDARD, '(funds - 21000)')})) AS lo FROM f),
  g AS (SELECT c_custkey, funds, """ + ", ".join(f"""CASE WHEN funds - 21000 <= 0 THEN 0 ELSE list_max(list_filter([floor(x)::BIGINT FOR x IN [funds - 21000, (funds - 21000 + 125000 * 0.02) / 1.02, (funds - 21000 - 2500 + 250000 * 0.05) / 1.05, (funds - 21000 - 36250 + 925000 * 0.10) / 1.10, (funds - 21000 - 93750 + 1500000 * 0.12) / 1.12{extra}]],
   lambda x: x >= 0 AND {_fits('x', first)} <= funds)) END AS {name}""" for name, first, extra in (("plain", False, ", 125000, 250000, 925000"), ("first_time", True, ", 500000, (funds - 21000 + 300000 * 0.05) / 1.05, 300000"))) + """ FROM f)
  SELECT c_custkey, plain, first_time FROM g""")
def _(i):
    funds = F.lit(30000) + F.col("c_custkey") * 1331 % 1900000
    return i.table("customer").select("c_custkey", money.max_affordable(funds, F.lit(False)).alias("plain"), money.max_affordable(funds, F.lit(True)).alias("first_time"))


@query("epc_council_ordinals", """WITH o AS (SELECT id, outcode, CASE WHEN council_tax_band IN ('A','B','C','D','E','F','G','H') THEN ascii(council_tax_band) - 64 END AS ct FROM listings), m AS (SELECT median(ct) AS med FROM o)
  SELECT id, coalesce(ct, (SELECT med FROM m))::DOUBLE AS band_no, CASE WHEN ct IS NULL THEN 1 ELSE 0 END AS missing FROM o""", "listings")
def _(i):
    rows = i.listings.select("id", F.when(F.col("council_tax_band").rlike("^[A-H]$"), F.ascii("council_tax_band") - 64).alias("ct"))
    med = group_quantiles(rows, [], "ct", {"med": "median"}, count=None)
    return rows.join(F.broadcast(med)).select("id", F.coalesce(F.col("ct").cast("double"), "med").alias("band_no"), F.col("ct").isNull().cast("int").alias("missing"))


@query("area_fusion", """SELECT id, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN (a + b) / 2 ELSE coalesce(a, b) END AS area, CASE WHEN a IS NOT NULL AND b IS NOT NULL AND abs(a - b) / b > 0.15 THEN 1 ELSE 0 END AS disagree
  FROM (SELECT id, nullif(floor_area_sqft, 0)::DOUBLE AS a, CASE WHEN id % 4 = 0 THEN NULL ELSE floor_area_sqft * (0.7 + (id % 7) / 10.0) END::DOUBLE AS b FROM (SELECT id, nullif(floor_area_sqft, 0) AS floor_area_sqft FROM listings) l) t""", "listings")
def _(i):
    a = F.nullif(F.col("floor_area_sqft"), F.lit(0)).cast("double")
    b = F.when(F.col("id") % 4 != 0, a * (F.lit(0.7) + F.col("id") % 7 / 10.0))
    mean = (F.col("a") + F.col("b")) / 2
    rows = i.listings.select("id", a.alias("a"), b.alias("b"))
    return rows.select("id", F.coalesce(mean, "a", "b").alias("area"), F.coalesce((F.abs(F.col("a") - F.col("b")) / F.col("b") > 0.15).cast("int"), F.lit(0)).alias("disagree"))


_BIN = "list_extract(['north','north-east','east','south-east','south','south-west','west','north-west'], ((({x}) % 8 + 8) % 8 + 1)::INT)"


@query("bin8_margin", f"""SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, theta, {_BIN.format(x='c')} AS word, CASE WHEN abs(off) > 17.5 THEN array_to_string(list_sort([{_BIN.format(x='c')}, {_BIN.format(x='CASE WHEN off >= 0 THEN c + 1 ELSE c - 1 END')}]), '|') ELSE {_BIN.format(x='c')} END AS words
  FROM (SELECT *, (theta / 45.0 - c) * 45 AS off FROM (SELECT *, floor(theta / 45.0 + 0.5)::INT AS c FROM (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, (l_orderkey * 7 + l_partkey) % 360 AS theta FROM lineitem) a) b) d""")
def _(i):
    rows = i.table("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", ((F.col("l_orderkey") * 7 + F.col("l_partkey")) % 360).alias("theta"))
    t = F.col("theta").cast("double")
    return rows.select("*", geo.compass_bin(t).alias("word"), F.array_join(geo.compass_set(t, 5.0), "|").alias("words"))


@query("circular_distance", "SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, least(abs(a - b), 360 - abs(a - b))::DOUBLE AS d FROM (SELECT *, (l_orderkey * 7) % 360 AS a, (l_partkey * 11) % 360 AS b FROM lineitem) t")
def _(i):
    a, b = F.col("l_orderkey") * 7 % 360, F.col("l_partkey") * 11 % 360
    return i.table("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", geo.circular_distance(a.cast("double"), b.cast("double")).alias("d"))


_DERIVED = "CASE id % 4 WHEN 0 THEN ['south'] WHEN 1 THEN ['south-west', 'west'] WHEN 2 THEN ['north-east'] ELSE [] END"


@query("facing_match", f"""SELECT id, CASE WHEN garden_facing IN ('south', 'south-west', 'south-east') THEN 1 WHEN garden_facing IS NOT NULL THEN 0 END AS is_south, CASE WHEN garden_facing IN ('west', 'south-west', 'north-west') THEN 1 WHEN garden_facing IS NOT NULL THEN 0 END AS is_west,
   CASE WHEN garden_facing IS NULL OR id % 4 = 3 THEN NULL WHEN len(list_filter({_DERIVED}, lambda w: w = garden_facing OR starts_with(w, garden_facing || '-') OR ends_with(w, '-' || garden_facing) OR starts_with(garden_facing, w || '-') OR ends_with(garden_facing, '-' || w))) > 0 THEN 1 ELSE 0 END AS agrees FROM listings""", "listings")
def _(i):
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    derived = F.when(F.col("id") % 4 == 0, words("south")).when(F.col("id") % 4 == 1, words("south-west", "west")).when(F.col("id") % 4 == 2, words("north-east")).otherwise(F.array().cast("array<string>"))
    g = F.col("garden_facing")
    return i.listings.select("id", geo.facing_matches("south", g).cast("int").alias("is_south"), geo.facing_matches("west", g).cast("int").alias("is_west"), geo.facings_agree(g, derived).cast("int").alias("agrees"))


def room_text():
    feet = F.concat(F.lit(" "), (F.col("area_sqft") / 6 % 14 + 6).cast("int").cast("string"), F.lit("'"), (F.col("room_no") % 12).cast("string"), F.lit('" x '), (F.col("room_no") % 9 + 8).cast("string"), F.lit("'6\""))
    metres = F.concat(F.lit(" "), F.format_string("%.2f", F.col("long_edge_m") * 0.9), F.lit("m x "), F.format_string("%.2f", F.col("area_sqft") / 60), F.lit("m"), F.when(F.col("room_no") % 5 == 0, " max").otherwise(""))
    printed = F.concat(F.lit(" ("), F.format_string("%.1f", F.col("area_sqft") / 10.764), F.lit(" sq m)"))
    kind = F.col("room_no") % 4
    return F.concat("label", F.when(kind == 0, printed).when(kind == 1, metres).when(kind == 2, feet).otherwise(""))


@query("room_area_parse")
def _(i):
    # rows only: three regex tiers over generated labels; cases are pinned in the tests
    return i.rooms.select("id", "room_no", room_text().alias("text")).withColumn("a", labels.room_area(F.col("text"))).select("id", "room_no", "text", "a.*")


@query("outdoor_kind", """SELECT id, room_no, label, CASE WHEN room_type IN ('balcony', 'terrace', 'garden') AND id % 2 = 0 THEN room_type WHEN label IN ('Balcony', 'Front Balcony') THEN 'balcony' WHEN label IN ('Ground Floor Balcony') THEN 'balcony' WHEN label IN ('Roof Terrace', 'Terrace') THEN 'terrace'
   WHEN label IN ('Rear Garden', 'Communal Garden', 'Garden Terrace') THEN 'outdoor' END AS kind FROM rooms""", "rooms")
def _(i):
    typed = F.when((F.col("id") % 2 == 0) & F.col("room_type").isin("balcony", "terrace", "garden"), F.col("room_type")).otherwise("other")
    return i.rooms.select("id", "room_no", "label", labels.outdoor_kind(typed, F.col("label")).alias("kind"))


@query("garden_label", "SELECT label, CASE WHEN label IN ('Rear Garden', 'Garden Terrace') THEN 1 ELSE 0 END AS is_garden, count(*) AS n FROM rooms GROUP BY label", "rooms")
def _(i):
    return i.rooms.groupBy("label", labels.garden_label(F.col("label")).cast("int").alias("is_garden")).agg(F.count(F.lit(1)).alias("n"))


_OPK = """(strpos(t, 'open plan') > 0 AND strpos(seg, 'kitchen') > 0 AND NOT regexp_matches(seg[:greatest(strpos(seg, 'kitchen') - 1, 0)], '"|\\.|;| & |<br|</p>|bedroom|bathroom|shower room|cloakroom|utility|garden|balcony|terrace|hallway|entrance|suite|study|garage|parking|storage')
   AND NOT regexp_matches(pre, 'potential to|scope to|opportunity to|could be made|could be turned'))"""
_OPK_SRC = """(SELECT id, t, t[strpos(t, 'open plan') + 9:strpos(t, 'open plan') + 78] AS seg, t[greatest(strpos(t, 'open plan') - 60, 1):greatest(strpos(t, 'open plan') - 60, 1) + 59] AS pre FROM (SELECT id, regexp_replace(lower(coalesce({c}, '')), 'open-plan|openplan', 'open plan', 'g') AS t FROM listings) a)"""


@query("text_window_predicate", f"SELECT id FROM {_OPK_SRC.format(c='key_features')} WHERE {_OPK} UNION ALL SELECT -id - 1 FROM {_OPK_SRC.format(c='description')} WHERE {_OPK}", "listings")
def _(i):
    a = i.listings.where(text.open_plan_kitchen(F.col("key_features"))).select("id")
    return a.unionByName(i.listings.where(text.open_plan_kitchen(F.col("description"))).select((-F.col("id") - 1).alias("id")))


@query("json_fact", """SELECT l.id, coalesce(nullif(service_charge, 0), nullif((facts_json::JSON->'service_charge_pa'->>'value')::DOUBLE, 0)) AS charge FROM listings l LEFT JOIN text_facts f ON f.id = l.id AND f.ok = 1""", "listings text_facts")
def _(i):
    facts = i.text_facts.where("ok = 1").select("id", "facts_json")
    return i.listings.join(facts, "id", "left").select("id", text.json_fact(F.col("facts_json"), "service_charge_pa", F.col("service_charge")).alias("charge"))


@query("embedded_date", "SELECT id, CASE WHEN update_reason LIKE 'Reduced on %' THEN strftime(strptime(update_reason[12:21], '%d/%m/%Y'), '%Y-%m-%d') END AS reduced FROM listings", "listings")
def _(i):
    return i.listings.select("id", F.date_format(text.reduced_on(F.col("update_reason")), "yyyy-MM-dd").alias("reduced"))


@query("tier_round", "SELECT c_custkey, greatest(1, least(10, floor(c_acctbal / 800 + 0.5)))::INT AS tier FROM customer")
def _(i):
    return i.table("customer").select("c_custkey", text.tier(F.col("c_acctbal") / 800).alias("tier"))


_HUBS = "(SELECT DISTINCT hub AS name FROM commute WHERE hub NOT LIKE 'Minor%')"
_BARE = "trim(regexp_replace(regexp_replace(lower(trim({x})), '[''’]', '', 'g'), '( station| rail| underground| tube)+$', ''))"


@query("name_canonical", f"""WITH h AS (SELECT name, {_BARE.format(x='name')} AS b FROM {_HUBS}), r AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN upper(n) || ' Station' WHEN 1 THEN left(n, 6) WHEN 2 THEN replace(n, '''', '') WHEN 3 THEN 'kx' ELSE 'Nowhere' END AS raw FROM (SELECT c_custkey, list_extract((SELECT list(name ORDER BY name) FROM {_HUBS}), (c_custkey % 20 + 1)::INT) AS n FROM customer) q WHERE n IS NOT NULL),
  k AS (SELECT *, {_BARE.format(x='raw')} AS b FROM r)
  SELECT c_custkey, raw, coalesce((SELECT name FROM h WHERE h.b = k.b), CASE WHEN k.b = 'kx' THEN 'King''s Cross' END, CASE WHEN k.b <> '' AND (SELECT count(*) FROM h WHERE starts_with(h.b, k.b) OR starts_with(k.b, h.b)) = 1 THEN (SELECT name FROM h WHERE starts_with(h.b, k.b) OR starts_with(k.b, h.b)) END, raw) AS canonical FROM k""", "commute")
def _(i):
    hubs = i.commute.where("hub NOT LIKE 'Minor%'").select(F.col("hub").alias("name")).distinct()
    listed = hubs.agg(F.array_sort(F.collect_list("name")).alias("hs"))
    k = F.col("c_custkey")
    n = F.try_element_at(F.col("hs"), (k % 20 + 1).cast("int"))
    raw = F.when(k % 5 == 0, F.concat(F.upper(n), F.lit(" Station"))).when(k % 5 == 1, F.substring(n, 1, 6)).when(k % 5 == 2, F.regexp_replace(n, "'", "")).when(k % 5 == 3, "kx").otherwise("Nowhere")
    asked = i.table("customer").join(F.broadcast(listed)).where(n.isNotNull()).select("c_custkey", raw.alias("raw"))
    aliases = i.spark.sql("SELECT 'kx' AS alias, 'King''s Cross' AS name")
    return text.canonical_names(asked, "raw", hubs, aliases).select("c_custkey", "raw", "canonical")


@query("content_hash", """SELECT conv_id, turn, left(sha1(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))), 12) AS h FROM conversations""")
def _(i):
    rows = i.table("conversations")
    return rows.select("conv_id", "turn", text.content_key(F.col("text")).alias("h"))


@query("probit_score", """SELECT c_custkey, round(greatest(5, least(98, 65 + 15 * CASE WHEN p < 0.5 THEN -z ELSE z END)), 6) AS score FROM (SELECT *, t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t) AS z
  FROM (SELECT c_custkey, p, sqrt(-2 * ln(CASE WHEN p < 0.5 THEN p ELSE 1 - p END)) AS t FROM (SELECT c_custkey, greatest(0.0001, least(0.9999, c_acctbal / 9000)) AS p FROM customer) a) b) c""")
def _(i):
    return i.table("customer").select("c_custkey", F.round(curves.calibrated(F.col("c_acctbal") / 9000), 6).alias("score"))


@query("rating_text", """WITH z AS (SELECT postcode, total_score, abs((total_score - 65) / 15) / sqrt(2) AS x, total_score < 65 AS neg FROM scores), e AS (SELECT *, 1 / (1 + 0.3275911 * x) AS t FROM z),
  f AS (SELECT *, 1 - (((((1.061405429 * t - 1.453152027) * t) + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-x * x) AS erf FROM e)
  SELECT postcode, CASE WHEN total_score IS NULL THEN 'Insufficient data' ELSE 'Better than ' || greatest(1, least(99, round(CASE WHEN neg THEN 0.5 * (1 - erf) ELSE 0.5 * (1 + erf) END * 100)))::INT || '% of postcodes' END AS rating FROM f""", "scores")
def _(i):
    return i.scores.select("postcode", curves.rating_text(F.col("total_score")).alias("rating"))


@query("tool_count", "SELECT msg_id, CASE WHEN (conv_id + turn) % 4 = 0 THEN 2 WHEN (conv_id + turn) % 4 = 3 THEN 3 ELSE 0 END AS tools FROM chats", "chats")
def _(i):
    return i.chats.select("msg_id", text.tool_count(F.col("tool_calls")).alias("tools"))


@query("udf_policy", "SELECT count(*) AS n, count(*) FILTER (WHERE raw <> upper(raw)) AS lower_n FROM mixed_postcodes", "mixed_postcodes")
def _(i):
    # every scalar above is Column -> Column; this counts rows through two of them chained
    pc = postcode.normalise(F.col("raw"))
    return i.mixed_postcodes.where(postcode.scope(pc).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("raw") != F.upper("raw")).alias("lower_n"))
