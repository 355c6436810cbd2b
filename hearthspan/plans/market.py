"""Market queries: baselines, trend by type, risk, flood, overview, cohorts."""

from pyspark.sql import functions as F

from hearthspan.functions import rank
from hearthspan.operators import market as op
from hearthspan.operators import sales as sale_op
from hearthspan.operators.spatial import within_km
from hearthspan.plans.base import query
from hearthspan.plans.sales import AS_OF, GROWTH, HOMES_SQL, PAIRS, YEAR

# The given tables spread sales evenly, so the registered queries use closer thresholds than the
# operator defaults; otherwise no month would be flagged and nothing would be compared.
SPIKE, COLLAPSE, TAIL = 1.10, 0.90, 0.95
EVENTS = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in op.KNOWN_EVENTS.items()) + ") e(ym, event)"
QUALITY = f"""
m AS (SELECT strftime(sale_date, '%Y-%m') AS ym, count(*) AS n FROM sales WHERE category = 'A' GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY ym) AS pos, count(*) OVER () AS months FROM m),
b AS (SELECT a.ym, a.n, a.pos, a.months, CASE WHEN a.pos > 6 AND a.pos + 6 <= a.months THEN 'c' WHEN a.pos + 6 > a.months AND a.pos > 12 THEN 't' END AS side,
   median(x.n) AS base FROM o a LEFT JOIN o x ON (a.pos > 6 AND a.pos + 6 <= a.months AND x.pos BETWEEN a.pos - 6 AND a.pos + 6 AND x.pos <> a.pos)
     OR (a.pos + 6 > a.months AND a.pos > 12 AND x.pos BETWEEN a.pos - 12 AND a.pos - 1) GROUP BY ALL),
r AS (SELECT *, n / base AS ratio, CASE WHEN side = 'c' AND n / base > {SPIKE} THEN 'volume_spike' WHEN side = 'c' AND n / base < {COLLAPSE} THEN 'volume_collapse'
   WHEN side = 't' AND n / base < {TAIL} THEN 'incomplete_filing' END AS reason FROM b),
quality AS (SELECT r.ym, pos, months, n, ratio, CASE WHEN reason IS NULL THEN 0 ELSE 1 END AS is_distorted, reason, CASE WHEN reason IS NOT NULL THEN e.event END AS event FROM r LEFT JOIN {EVENTS} ON e.ym = r.ym)
"""


def quality(i):
    return op.month_quality(i.sales, SPIKE, COLLAPSE, TAIL)


@query("win_month_quality", f"WITH {QUALITY} SELECT ym, n, round(ratio, 6) AS ratio, is_distorted, reason, event FROM quality", "sales")
def _(i):
    return quality(i).select("ym", "n", F.round("ratio", 6).alias("ratio"), "is_distorted", "reason", "event")


SEASON = f"""WITH {QUALITY},
 t AS (SELECT strftime(sale_date, '%Y-%m') AS ym, CASE WHEN property_type IN ('F','T','S','D') THEN property_type ELSE 'O' END AS pt, price FROM sales WHERE category = 'A'),
 u AS (SELECT ym, pt, price FROM t UNION ALL SELECT ym, 'ALL', price FROM t),
 med AS (SELECT ym, pt, median(price) AS med, count(*) AS k FROM u GROUP BY ym, pt),
 h AS (SELECT med.*, q.pos, q.n FROM med JOIN quality q USING (ym) WHERE pt <> 'O' AND is_distorted = 0 AND pos > 6 AND pos + 6 <= months AND k >= 12),
 w AS (SELECT h.pt, h.ym, h.k, h.med, h.n, median(o.med) AS base, count(o.med) AS beside, avg(q.n) AS vb FROM h JOIN quality q ON q.pos BETWEEN h.pos - 6 AND h.pos + 6 AND q.pos <> h.pos AND q.is_distorted = 0
   LEFT JOIN med o ON o.ym = q.ym AND o.pt = h.pt GROUP BY ALL HAVING count(o.med) >= 10)
 SELECT pt AS property_type, ym[6:7]::INT AS month, round(median(med / base), 4) AS price_index, round(median(n / vb), 4) AS volume_index, count(*) AS n_months, sum(k)::BIGINT AS n_sales FROM w GROUP BY ALL"""


@query("win_seasonality", SEASON, "sales")
def _(i):
    return op.seasonality(i.sales, op.month_quality(i.sales, SPIKE, COLLAPSE, TAIL), 12)


@query("market_baselines", f"""WITH {QUALITY}, c AS (SELECT s.* FROM sales s WHERE category = 'A' AND strftime(sale_date, '%Y-%m') NOT IN (SELECT ym FROM quality WHERE is_distorted = 1))
  SELECT outcode, count(*) AS n, median(price) AS med, (SELECT sum(is_distorted)::BIGINT FROM quality) AS excluded_months FROM c GROUP BY outcode""", "sales")
def _(i):
    q = quality(i)
    kept = op.clean_sales(i.sales, q)
    out = rank.group_quantiles(kept, ["outcode"], "price", {"med": "median"})
    return out.join(F.broadcast(q.agg(F.sum("is_distorted").cast("bigint").alias("excluded_months"))))


@query("exclusion_note", f"""WITH {QUALITY} SELECT sum(is_distorted)::BIGINT AS excluded, count(*) AS months,
  coalesce(string_agg(ym || '(x' || round(ratio * 100)::INT::VARCHAR || '%)', ', ' ORDER BY ym) FILTER (WHERE is_distorted = 1), '') AS listed FROM quality""", "sales")
def _(i):
    return op.exclusion_note(quality(i))


@query("freshness_gate", f"""WITH b AS (SELECT 'pairs_' || outcode AS name, max(sale_date) AS source_max_date, DATE '2022-03-01' + (length(outcode) * 30)::INT AS built_on FROM sales WHERE tie1 % 3 = 0 GROUP BY outcode)
  SELECT name, strftime((SELECT max(sale_date) FROM sales), '%Y-%m') AS live_month, strftime(source_max_date, '%Y-%m') AS built_month,
   CASE WHEN strftime((SELECT max(sale_date) FROM sales), '%Y-%m') > strftime(source_max_date, '%Y-%m') THEN 1 ELSE 0 END AS is_stale,
   date_diff('day', built_on, DATE '{AS_OF}')::INT AS age_days, CASE WHEN date_diff('day', built_on, DATE '{AS_OF}') > 45 THEN 1 ELSE 0 END AS too_old FROM b""", "sales")
def _(i):
    # each outcode's table was built from the sales whose first tie-break divides by three
    built = i.sales.where("tie1 % 3 = 0").groupBy(F.concat(F.lit("pairs_"), "outcode").alias("name"), F.length("outcode").alias("w")).agg(F.max("sale_date").alias("source_max_date"))
    return op.freshness(i.sales, built.withColumn("built_on", F.expr("date_add(DATE'2022-03-01', w * 30)")), AS_OF)


def _level_sql(level):
    return f"""m_{level} AS (SELECT {level} AS g, segment, count(*) FILTER (WHERE win = 'now') AS n12, median(price) FILTER (WHERE win = 'now') AS m12, count(*) FILTER (WHERE win = 'prev') AS np, median(price) FILTER (WHERE win = 'prev') AS mp FROM dated GROUP BY ALL),
    c_{level} AS (SELECT {level} AS g, segment, {GROWTH} FROM pt GROUP BY {level}, segment)"""


_PICK = lambda col: "CASE WHEN a.n12 >= 5 THEN " + col.format("a", "ca") + " WHEN b.n12 >= 5 THEN " + col.format("b", "cb") + " WHEN c.n12 >= 5 THEN " + col.format("c", "cc") + " END"


@query("price_trend_by_type", f"""WITH {PAIRS}, rr AS (SELECT *, CASE WHEN property_type = 'F' THEN 'flats' ELSE 'houses' END AS segment FROM sales WHERE property_type IN ('F','D','S','T')),
  pt AS (SELECT *, CASE WHEN property_type = 'F' THEN 'flats' ELSE 'houses' END AS segment FROM pairs WHERE property_type IN ('F','D','S','T')),
  an AS (SELECT outcode, coalesce(max(sale_date) FILTER (WHERE category = 'A'), max(sale_date)) AS anchor FROM rr GROUP BY outcode),
  dated AS (SELECT rr.*, CASE WHEN sale_date > anchor - 365 THEN 'now' ELSE 'prev' END AS win FROM rr JOIN an USING (outcode) WHERE category = 'A' AND sale_date > anchor - 730 AND sale_date <= anchor),
  {_level_sql('postcode')}, {_level_sql('sector')}, {_level_sql('outcode')},
  x AS (SELECT u.postcode, u.segment, {_PICK("'{0}'")} AS lv, coalesce({_PICK('{0}.n12')}, c.n12, 0) AS n12, {_PICK('{0}.m12')} AS median_12m, CASE WHEN a.n12 >= 5 OR b.n12 >= 5 OR c.n12 >= 5 THEN coalesce({_PICK('{0}.np')}, 0) END AS prev_n,
     {_PICK('{0}.mp')} AS mp, {_PICK('{1}.cagr_3y')} AS cagr_3y, {_PICK('{1}.cagr_3y_count')} AS cagr_3y_count
   FROM (SELECT DISTINCT postcode, sector, outcode, segment FROM rr) u
   LEFT JOIN m_postcode a ON a.g = u.postcode AND a.segment = u.segment LEFT JOIN c_postcode ca ON ca.g = u.postcode AND ca.segment = u.segment
   LEFT JOIN m_sector b ON b.g = u.sector AND b.segment = u.segment LEFT JOIN c_sector cb ON cb.g = u.sector AND cb.segment = u.segment
   LEFT JOIN m_outcode c ON c.g = u.outcode AND c.segment = u.segment LEFT JOIN c_outcode cc ON cc.g = u.outcode AND cc.segment = u.segment),
  y AS (SELECT *, CASE WHEN prev_n >= 5 THEN round((median_12m / mp - 1) * 100, 4) END AS yoy_pct FROM x)
  SELECT postcode, segment, CASE lv WHEN 'a' THEN 'postcode' WHEN 'b' THEN 'sector' WHEN 'c' THEN 'outcode' END AS level, n12, median_12m, prev_n, yoy_pct, cagr_3y, cagr_3y_count,
    CASE WHEN abs(yoy_pct - cagr_3y) > 8 THEN 1 WHEN abs(yoy_pct - cagr_3y) <= 8 THEN 0 END AS diverges FROM y""", "sales")
def _(i):
    return op.trend_by_type(i.sales, YEAR)


_ACTIVE = "delisted_date IS NULL AND (canonical_id IS NULL OR canonical_id = id)"


@query("filter_active_canonical", f"SELECT id, postcode, asking_price FROM listings WHERE {_ACTIVE}", "listings")
def _(i):
    return op.active_canonical(i.listings).select("id", "postcode", "asking_price")


_UNDER = f"""k AS (SELECT *, CASE WHEN lower(property_type) IN ('flat','maisonette','studio','penthouse') THEN 'flats' WHEN lower(property_type) IN ('terraced','semi-detached','detached','bungalow','house') THEN 'houses' END AS kind
   FROM listings WHERE {_ACTIVE} AND match_strategy = 'detail_anchored' AND asking_price IS NOT NULL AND prev_sold_price IS NOT NULL AND year(prev_sold_date) BETWEEN 2016 AND 2022 AND shared_ownership = 0 AND is_auction = 0),
 s AS (SELECT coalesce(outcode, 'ALL') AS scope, kind, count(*) AS n, count(*) FILTER (WHERE asking_price < prev_sold_price) AS n_under,
   median((prev_sold_price - asking_price) * 1.0 / prev_sold_price * 100) FILTER (WHERE asking_price < prev_sold_price) AS mid FROM k WHERE kind IS NOT NULL GROUP BY GROUPING SETS ((outcode, kind), (kind)))"""
_UNDER_OUT = "scope, kind, n, n_under, CASE WHEN n >= 10 THEN round(n_under * 100.0 / n, 4) END AS under_pct, CASE WHEN n >= 10 THEN round(mid, 4) END AS median_shortfall"


@query("agg_underwater", f"WITH {_UNDER} SELECT {_UNDER_OUT} FROM s", "listings")
def _(i):
    return op.underwater(i.listings)


@query("market_risk", f"""WITH {_UNDER}, t AS (SELECT {_UNDER_OUT} FROM s) SELECT a.*, b.under_pct AS baseline_pct FROM t a JOIN t b ON b.scope = 'ALL' AND b.kind = a.kind WHERE a.scope <> 'ALL'""", "listings")
def _(i):
    every = op.underwater(i.listings)
    base = every.where("scope = 'ALL'").select("kind", F.col("under_pct").alias("baseline_pct"))
    return every.where("scope <> 'ALL'").join(base, "kind")


@query("join_semi_in", f"SELECT id, outcode FROM listings WHERE {_ACTIVE} AND outcode IN (SELECT outcode FROM boroughs WHERE borough IN ('Borough 1', 'Borough 3'))", "listings boroughs")
def _(i):
    inside = i.boroughs.where(F.col("borough").isin("Borough 1", "Borough 3")).select("outcode")
    return op.active_canonical(i.listings).join(inside, "outcode", "left_semi").select("id", "outcode")


def _flood_sql(area):
    return f"""SELECT {area} AS scope, count(*) AS n_checked, CASE WHEN count(*) >= 20 THEN count(*) FILTER (WHERE flood_zone = 'FZ3') END AS fz3_n, CASE WHEN count(*) >= 20 THEN count(*) FILTER (WHERE flood_zone = 'FZ2') END AS fz2_n,
  CASE WHEN count(*) >= 20 THEN round(count(*) FILTER (WHERE flood_zone = 'FZ3') * 1.0 / count(*), 6) END AS fz3_share, CASE WHEN count(*) >= 20 THEN round(count(*) FILTER (WHERE flood_zone = 'FZ2') * 1.0 / count(*), 6) END AS fz2_share
  FROM listings WHERE {_ACTIVE} AND flood_checked_at IS NOT NULL GROUP BY {area}"""


@query("agg_flood_share", _flood_sql("outcode") + " UNION ALL " + _flood_sql("sector"), "listings")
def _(i):
    return op.flood_share(i.listings, "outcode").unionByName(op.flood_share(i.listings, "sector"))


@query("flood_compare", f"""WITH f AS ({_flood_sql('outcode')}) SELECT scope, n_checked, fz3_share, fz2_share, CASE WHEN fz3_n IS NULL THEN 'too few checked' WHEN fz3_n = 0 AND fz2_n = 0 THEN 'all outside zones 2 and 3'
   WHEN fz3_n > 0 AND fz2_n > 0 THEN 'zones 2 and 3' WHEN fz3_n > 0 THEN 'zone 3' ELSE 'zone 2' END AS reading FROM f""", "listings")
def _(i):
    z3, z2 = F.col("fz3_n"), F.col("fz2_n")
    reading = (F.when(z3.isNull(), "too few checked").when((z3 == 0) & (z2 == 0), "all outside zones 2 and 3")
               .when((z3 > 0) & (z2 > 0), "zones 2 and 3").when(z3 > 0, "zone 3").otherwise("zone 2"))
    return op.flood_share(i.listings, "outcode").select("scope", "n_checked", "fz3_share", "fz2_share", reading.alias("reading"))


@query("agg_recent_sales_by_outcode", f"""SELECT outcode, count(*) FILTER (WHERE category = 'A') AS n, floor(median(price) FILTER (WHERE category = 'A'))::BIGINT AS median_price, min(price) FILTER (WHERE category = 'A') AS low, max(price) FILTER (WHERE category = 'A') AS high,
  count(*) FILTER (WHERE category = 'B') AS excluded_b FROM sales WHERE sale_date >= DATE '{AS_OF}' - INTERVAL 1 YEAR GROUP BY outcode HAVING count(*) FILTER (WHERE category IN ('A','B')) > 0""", "sales")
def _(i):
    return op.recent_sales_by_outcode(i.sales, AS_OF)


@query("agg_active_listings", f"SELECT outcode, count(*) AS n, round(avg(asking_price), 4) AS avg_price, min(asking_price) AS low, max(asking_price) AS high FROM listings WHERE {_ACTIVE} GROUP BY outcode", "listings")
def _(i):
    g = op.active_canonical(i.listings).groupBy("outcode")
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("asking_price"), 4).alias("avg_price"), F.min("asking_price").alias("low"), F.max("asking_price").alias("high"))


_DIMS = (*op.DIMENSIONS, "total_score", "median_price")
_LONG = "l AS (" + " UNION ALL ".join(f"SELECT outcode AS area, '{d}' AS dimension, {d}::DOUBLE AS v FROM scores" for d in _DIMS) + ")"
_AREA_SQL = f"{_LONG}, a AS (SELECT area, dimension, round(median(v), 4) AS mid, round(min(v), 4) AS low, round(max(v), 4) AS high, count(v) AS n FROM l WHERE v IS NOT NULL GROUP BY ALL)"


@query("agg_area_scores", f"WITH {_AREA_SQL} SELECT * FROM a", "scores")
def _(i):
    return op.area_scores(i.scores, "outcode")


@query("area_compare", f"""WITH {_AREA_SQL}, r AS (SELECT * FROM a WHERE area IN ('N1', 'N5', 'N12'))
  SELECT area, dimension, mid, CASE WHEN mid = CASE WHEN dimension = 'median_price' THEN min(mid) OVER (PARTITION BY dimension) ELSE max(mid) OVER (PARTITION BY dimension) END THEN 1 ELSE 0 END AS leads FROM r""", "scores")
def _(i):
    return op.area_compare(op.area_scores(i.scores, "outcode"), ["N1", "N5", "N12"])


@query("council_tax_compare", """WITH l AS (SELECT * FROM tax_rates r WHERE tax_year = (SELECT max(tax_year) FROM tax_rates x WHERE x.borough = r.borough)),
  j AS (SELECT outcode, b.borough, tax_year, band_d AS amount, CASE WHEN coalesce(share, 1) < 0.85 THEN 1 ELSE 0 END AS straddles FROM boroughs b JOIN l USING (borough)),
  c AS (SELECT borough, amount FROM j WHERE straddles = 0 ORDER BY amount, borough LIMIT 1)
  SELECT j.*, (SELECT borough FROM c) AS cheapest, CASE WHEN straddles = 0 THEN amount - (SELECT amount FROM c) END AS dearer_by FROM j""", "boroughs tax_rates")
def _(i):
    return op.council_tax(i.boroughs, i.tax_rates)


@query("topk_screen_areas", """SELECT postcode, transport, community, schools, total_score, median_price FROM scores WHERE transport >= 40 AND community >= 30 AND schools >= 55 AND median_price IS NOT NULL AND median_price <= 900000
  ORDER BY total_score DESC NULLS LAST, postcode LIMIT 40""", "scores")
def _(i):
    floors = {"transport": 40, "community": 30, "schools": 55}
    kept = i.scores
    for name, least in floors.items():
        kept = kept.where(F.col(name) >= least)
    kept = kept.where(F.col("median_price").isNotNull() & (F.col("median_price") <= 900_000))
    return kept.orderBy(F.desc_nulls_last("total_score"), "postcode").limit(40).select("postcode", "transport", "community", "schools", "total_score", "median_price")


@query("topk_screen_commute", "SELECT sector, minutes FROM commute WHERE lower(hub) = 'bank' AND minutes <= 60 ORDER BY minutes, sector LIMIT 25", "commute")
def _(i):
    return i.commute.where((F.lower("hub") == "bank") & (F.col("minutes") <= 60)).orderBy("minutes", "sector").limit(25).select("sector", "minutes")


_RENT_SQL = "rents AS (SELECT outcode, bedrooms, 900 + (price % 900) AS rent FROM sales WHERE tie1 % 4 = 0)"


@query("agg_yield_by_bed", f"""WITH {_RENT_SQL}, p AS (SELECT outcode, bedrooms, median(price) AS price FROM sales GROUP BY ALL), r AS (SELECT outcode, bedrooms, median(rent) AS rent, count(*) AS rent_n FROM rents GROUP BY ALL)
  SELECT outcode, bedrooms, round(rent, 4) AS rent, round(rent * 12 / price * 100, 4) AS gross_pct, round(rent * 12 / price * 100 * 0.75, 4) AS net_pct, rent_n FROM p JOIN r USING (outcode, bedrooms)""", "sales")
def _(i):
    return op.yield_by_bed(i.sales, i.sales.where("tie1 % 4 = 0").withColumn("rent", F.col("price") % 900 + 900))


@query("area_overview", f"""WITH {_AREA_SQL}, {_RENT_SQL},
  t AS (SELECT area, string_agg(dimension || '=' || round(mid * 10)::BIGINT, ';' ORDER BY dimension) AS scores FROM a GROUP BY area),
  li AS (SELECT outcode, count(*) AS listings_n, max(asking_price) AS listings_high FROM listings WHERE {_ACTIVE} GROUP BY outcode),
  sa AS (SELECT outcode, count(*) FILTER (WHERE category = 'A') AS sales_n, floor(median(price) FILTER (WHERE category = 'A'))::BIGINT AS sales_median FROM sales WHERE sale_date >= DATE '{AS_OF}' - INTERVAL 1 YEAR GROUP BY outcode),
  st AS (SELECT outcode, string_agg(station_name, ';' ORDER BY d, station_name) AS stations FROM (SELECT outcode, station_name, min(distance_miles) AS d, row_number() OVER (PARTITION BY outcode ORDER BY min(distance_miles), station_name) AS k
      FROM nearest_stations n JOIN listings l ON l.id = n.property_id GROUP BY outcode, station_name) WHERE k <= 5 GROUP BY outcode),
  yb AS (SELECT outcode, string_agg(bedrooms || ':' || rent_n, ';' ORDER BY bedrooms) AS rents FROM (SELECT outcode, bedrooms, count(*) AS rent_n FROM rents GROUP BY ALL) GROUP BY outcode)
  SELECT area AS outcode, scores, listings_n, listings_high, sales_n, sales_median, stations, rents FROM t LEFT JOIN li ON li.outcode = area LEFT JOIN sa ON sa.outcode = area LEFT JOIN st ON st.outcode = area LEFT JOIN yb ON yb.outcode = area""", "scores listings nearest_stations")
def _(i):
    # every list below has a bounded length: dimensions, five stations, bedroom counts
    t = op.area_scores(i.scores, "outcode").groupBy(F.col("area").alias("outcode")).agg(
        F.array_join(F.array_sort(F.collect_list(F.concat("dimension", F.lit("="), F.round(F.col("mid") * 10).cast("bigint").cast("string")))), ";").alias("scores"))
    li = op.active_canonical(i.listings).groupBy("outcode").agg(F.count(F.lit(1)).alias("listings_n"), F.max("asking_price").alias("listings_high"))
    sa = op.recent_sales_by_outcode(i.sales, AS_OF).select("outcode", F.col("n").alias("sales_n"), F.col("median_price").alias("sales_median"))
    near = i.nearest_stations.join(i.listings.select(F.col("id").alias("property_id"), "outcode"), "property_id").groupBy("outcode", "station_name").agg(F.min("distance_miles").alias("d"))
    top = rank.first_k(near, ["outcode"], ["d", "station_name"], 5)
    st = top.groupBy("outcode").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "station_name"))), lambda x: x["station_name"]), ";").alias("stations"))
    rents = i.sales.where("tie1 % 4 = 0").groupBy("outcode", "bedrooms").agg(F.count(F.lit(1)).alias("rent_n"))
    yb = rents.groupBy("outcode").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", F.col("bedrooms").cast("string"), F.col("rent_n").cast("string")))), ";").alias("rents"))
    return t.join(li, "outcode", "left").join(sa, "outcode", "left").join(st, "outcode", "left").join(yb, "outcode", "left")


NEAR_SQL = "near AS (SELECT a.spaced AS subject, b.spaced AS postcode FROM coords a JOIN coords b ON sqrt(pow((b.latitude - a.latitude) * 110.574, 2) + pow((b.longitude - a.longitude) * 111.320 * cos(radians(a.latitude)), 2)) <= 0.8)"


def near_postcodes(i, km=0.8):
    left = i.coords.select(F.col("spaced").alias("subject"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    right = i.coords.select(F.col("spaced").alias("postcode"), F.col("latitude").alias("r_lat"), F.col("longitude").alias("r_lon"))
    return within_km(left, right, km)


@query("join_radius", f"WITH {NEAR_SQL} SELECT subject, postcode FROM near", "coords")
def _(i):
    return near_postcodes(i).select("subject", "postcode")


_ST = "count(*) AS n, median(pct_change) AS mp, count(*) FILTER (WHERE pct_change < 0) AS losers, median(hold_years) AS mh"


@query("cohort_ladder", f"""WITH {HOMES_SQL}, {NEAR_SQL}, co AS (SELECT * FROM mk WHERE first_date >= DATE '2019-01-01' AND is_single_hold = 1), ti AS (SELECT *, 3 AS tier FROM co UNION ALL SELECT *, 2 FROM co WHERE market UNION ALL SELECT *, 1 FROM co WHERE market AND aa),
  u AS (SELECT DISTINCT spaced AS postcode FROM coords), v AS (SELECT DISTINCT postcode, sector, outcode FROM sales WHERE postcode IN (SELECT postcode FROM u)),
  g AS (SELECT near.subject, 1 AS rung, tier, {_ST} FROM ti JOIN near ON near.postcode = ti.postcode GROUP BY ALL UNION ALL
    SELECT v.postcode, 2, tier, {_ST} FROM ti JOIN v ON v.sector = ti.sector GROUP BY ALL UNION ALL SELECT v.postcode, 3, tier, {_ST} FROM ti JOIN v ON v.outcode = ti.outcode GROUP BY ALL)
  SELECT subject, rung, tier, n, round(mp, 6) AS median_pct, losers, round(100.0 * losers / n, 6) AS loss_share, round(mh, 6) AS median_hold
  FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY tier, rung) AS q FROM g WHERE n >= 3 AND subject IN (SELECT postcode FROM v)) WHERE q = 1""", "sales home_sales coords")
def _(i):
    pairs = sale_op.resale_pairs(i.home_sales).where(F.col("first_date") >= F.lit("2019-01-01").cast("date"))
    subj = i.sales.select("postcode", "sector", "outcode").distinct()
    near = near_postcodes(i).join(subj.select(F.col("postcode").alias("subject")), "subject", "left_semi")
    got = sale_op.cohort_ladder(pairs, subj, near)
    return got.select("subject", "rung", "tier", "n", F.round("median_pct", 6).alias("median_pct"), "losers", F.round("loss_share", 6).alias("loss_share"), F.round("median_hold", 6).alias("median_hold"))
