"""Ledger queries: pairs, growth, price statistics, comparables, cohorts."""

from pyspark.sql import functions as F

from hearthspan.functions import rank
from hearthspan.operators import sales as op
from hearthspan.plans.base import query

AS_OF = "2022-06-01"
YEAR = 2022

PAIRS = """
seq AS (SELECT *, lag(price) OVER w AS p0, lag(sale_date) OVER w AS d0, lag(category) OVER w AS c0 FROM sales
  WINDOW w AS (PARTITION BY address_key ORDER BY sale_date, tie1, tie2, tie3, price)),
pairs AS (SELECT *, round((price - p0) * 100.0 / p0, 2) AS change_pct, round(yrs, 2) AS years_held,
    round(greatest(-100.0, least(100.0, (pow(price * 1.0 / p0, 1 / yrs) - 1) * 100)), 2) AS annual_return
  FROM (SELECT *, date_diff('day', d0, sale_date) / 365.25 AS yrs FROM seq WHERE d0 IS NOT NULL) s
  WHERE yrs >= 0.25 AND p0 > 0 AND coalesce(category, '') <> 'B' AND coalesce(c0, '') <> 'B')
"""

_RH, _H = "round(annual_return * 100)::BIGINT * round(years_held * 100)::BIGINT", "round(years_held * 100)::BIGINT"


def _rate(w):
    inside = f"FILTER (WHERE year(sale_date) >= {YEAR - w})"
    return f"sum({_RH}) {inside} / nullif(sum({_H}) {inside}, 0) / 100"


GROWTH = ", ".join(f"{_rate(w)} AS cagr_{w}y, count(*) FILTER (WHERE year(sale_date) >= {YEAR - w}) AS cagr_{w}y_count" for w in (3, 5, 10)) + f""",
  CASE WHEN count(*) FILTER (WHERE year(sale_date) >= {YEAR - 3}) = 0 THEN 'unknown' WHEN {_rate(3)} > 3 THEN 'up' WHEN {_rate(3)} < -3 THEN 'down' ELSE 'stable' END AS direction, count(*) AS sample_count"""

ROLLED = f"""SELECT CASE WHEN grouping(postcode) = 0 THEN 'unit' WHEN grouping(sector) = 0 THEN 'sector' WHEN grouping(outcode) = 0 THEN 'outcode' ELSE 'market' END AS level,
  coalesce(postcode, sector, outcode, 'ALL') AS geo, {GROWTH} FROM pairs GROUP BY ROLLUP (outcode, sector, postcode)"""


def iso(name: str):
    return F.date_format(name, "yyyy-MM-dd").alias(name)


@query("scan_sales", f"""SELECT address_key, price, strftime(sale_date, '%Y-%m-%d') AS sale_date, property_type, postcode FROM sales
  WHERE price > 0 AND sale_date >= DATE '{AS_OF}' - 365 * 5 AND property_type IN ('D','S','T','F')""", "sales")
def _(i):
    return op.scan_sales(i.sales, AS_OF, 5).select("address_key", "price", iso("sale_date"), "property_type", "postcode")


@query("filter_residential_market", """SELECT property_type, category, count(*) AS n, sum(price)::BIGINT AS total FROM sales
  WHERE property_type IN ('D','S','T','F') AND (category IS NULL OR category <> 'B') GROUP BY ALL""", "sales")
def _(i):
    kept = i.sales.where(F.col("property_type").isin(*op.RESIDENTIAL) & op.not_b(F.col("category")))
    return kept.groupBy("property_type", "category").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("total"))


@query("filter_area_exact", """SELECT outcode, sector, count(*) AS n, min(price) AS low FROM sales
  WHERE outcode = 'N1' AND regexp_extract(postcode, '^[A-Z]+[0-9]+ ([0-9])', 1) = '3' GROUP BY ALL""", "sales")
def _(i):
    hit = i.sales.where((F.col("outcode") == "N1") & (F.col("sector") == "N1 3"))
    return hit.groupBy("outcode", "sector").agg(F.count(F.lit(1)).alias("n"), F.min("price").alias("low"))


@query("sale_category", """SELECT CASE WHEN upper(trim(category)) = 'A' THEN 'standard' WHEN upper(trim(category)) = 'B' THEN 'category B' ELSE 'unrecorded' END AS label,
  count(*) AS n FROM sales GROUP BY ALL""", "sales")
def _(i):
    c = F.upper(F.trim("category"))
    label = F.when(c == "A", "standard").when(c == "B", "category B").otherwise("unrecorded")
    return i.sales.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("filter_outliers", """SELECT s.postcode, s.address_key, s.price, s.tie1, s.tie2, s.tie3 FROM sales s JOIN (
    SELECT postcode, max(p) AS mid, max(n) AS n FROM (SELECT postcode, price AS p, row_number() OVER (PARTITION BY postcode ORDER BY price) AS r,
      count(*) OVER (PARTITION BY postcode) AS n FROM sales) WHERE r = n // 2 + 1 GROUP BY postcode) m USING (postcode)
  WHERE m.n < 3 OR s.price BETWEEN m.mid * 0.85 AND m.mid * 1.2""", "sales")
def _(i):
    # tight bounds here so that rows of the given tables fall on both sides
    return op.drop_outliers(i.sales, ["postcode"], 0.85, 1.2).select("postcode", "address_key", "price", "tie1", "tie2", "tie3")


@query("win_repeat_sales", f"WITH {PAIRS} SELECT address_key, p0 AS prev_price, price, change_pct, years_held, annual_return FROM pairs", "sales")
def _(i):
    return op.repeat_sales(i.sales).select("address_key", "prev_price", "price", "change_pct", "years_held", "annual_return")


@query("join_asof_previous", f"""WITH d AS (SELECT DISTINCT address_key, sale_date FROM sales)
  SELECT s.address_key, strftime(s.sale_date, '%Y-%m-%d') AS sale_date, s.tie1, s.tie2, s.tie3, s.price,
   (SELECT strftime(max(d.sale_date), '%Y-%m-%d') FROM d WHERE d.address_key = s.address_key AND d.sale_date < s.sale_date) AS prior_date FROM sales s""", "sales")
def _(i):
    # strictly earlier: step over the dates of an address, not its rows
    days = i.sales.groupBy("address_key", "sale_date").agg(F.count(F.lit(1)).alias("day_n"))
    prior = rank.with_previous(days, ["address_key"], ["sale_date"], ["sale_date"])
    joined = i.sales.join(prior.select("address_key", "sale_date", "prev_sale_date"), ["address_key", "sale_date"])
    return joined.select("address_key", iso("sale_date"), "tie1", "tie2", "tie3", "price", F.date_format("prev_sale_date", "yyyy-MM-dd").alias("prior_date"))


@query("win_sale_rank", """SELECT address_key, tie1, tie2, tie3, price, sale_no, CASE WHEN held IS NULL THEN -1.0 ELSE least(held, 60.0) END AS held_months FROM (
  SELECT *, row_number() OVER w AS sale_no, round(date_diff('day', lag(sale_date) OVER w, sale_date) / 30.44, 4) AS held FROM sales
  WINDOW w AS (PARTITION BY address_key ORDER BY sale_date, tie1, tie2, tie3, price)) x""", "sales")
def _(i):
    rows = rank.with_previous(i.sales, ["address_key"], op.SALE_ORDER, ["sale_date"], ordinal="sale_no")
    held = F.round(F.datediff("sale_date", "prev_sale_date") / F.lit(30.44), 4)
    return rows.select("address_key", "tie1", "tie2", "tie3", "price", F.col("sale_no").cast("bigint").alias("sale_no"),
                       F.when(held.isNotNull(), F.least(held, F.lit(60.0))).otherwise(F.lit(-1.0)).alias("held_months"))


@query("agg_geo_cagr", f"WITH {PAIRS} SELECT outcode, {GROWTH} FROM pairs GROUP BY outcode", "sales")
def _(i):
    return op.area_growth(op.repeat_sales(i.sales), ["outcode"], YEAR)


@query("agg_geo_rollup", f"WITH {PAIRS} {ROLLED}", "sales")
def _(i):
    return op.growth_rollup(op.repeat_sales(i.sales), YEAR)


@query("price_trend_area", f"""WITH {PAIRS}, g AS ({ROLLED}) SELECT g.*, (SELECT strftime(max(sale_date), '%Y-%m') FROM sales) AS runs_to FROM g WHERE level <> 'unit'""", "sales")
def _(i):
    runs_to = i.sales.agg(F.date_format(F.max("sale_date"), "yyyy-MM").alias("runs_to"))
    return op.growth_rollup(op.repeat_sales(i.sales), YEAR).where("level <> 'unit'").join(F.broadcast(runs_to))


@query("agg_dispersion", f"WITH {PAIRS}, g AS ({ROLLED}) SELECT count(*) AS n, min(cagr_3y) AS low, max(cagr_3y) AS high FROM g WHERE level = 'outcode' AND cagr_3y IS NOT NULL", "sales")
def _(i):
    g = op.area_growth(op.repeat_sales(i.sales), ["outcode"], YEAR).where(F.col("cagr_3y").isNotNull())
    return g.agg(F.count(F.lit(1)).alias("n"), F.min("cagr_3y").alias("low"), F.max("cagr_3y").alias("high"))


@query("price_trend_ladder", f"""WITH {PAIRS}, g AS ({ROLLED}), u AS (SELECT DISTINCT postcode, sector, outcode FROM sales)
  SELECT u.postcode, """ + ", ".join(f"""
   CASE WHEN a.cagr_{w}y_count >= 8 THEN 'postcode' WHEN s.cagr_{w}y_count >= 8 THEN 'sector' WHEN o.cagr_{w}y_count >= 8 THEN 'outcode' WHEN a.cagr_{w}y IS NOT NULL THEN 'postcode' END AS level_{w}y,
   CASE WHEN a.cagr_{w}y_count >= 8 THEN a.cagr_{w}y WHEN s.cagr_{w}y_count >= 8 THEN s.cagr_{w}y WHEN o.cagr_{w}y_count >= 8 THEN o.cagr_{w}y ELSE a.cagr_{w}y END AS rate_{w}y""" for w in (3, 5, 10)) + """
  FROM u LEFT JOIN g a ON a.level = 'unit' AND a.geo = u.postcode LEFT JOIN g s ON s.level = 'sector' AND s.geo = u.sector LEFT JOIN g o ON o.level = 'outcode' AND o.geo = u.outcode""", "sales")
def _(i):
    parts = op.growth_parts(op.repeat_sales(i.sales), ["outcode", "sector", "postcode"], YEAR)
    sums = [F.sum(c).alias(c) for c in parts.columns if c.startswith("_")]
    places = i.sales.select("postcode", "sector", "outcode").distinct()
    out = places
    for col in ("postcode", "sector", "outcode"):
        rates = parts.groupBy(col).agg(*sums).select(col, *op.growth_columns())
        out = out.join(rates.select(col, *[F.col(c).alias(f"{col}_{c}") for c in rates.columns if c.startswith("cagr")]), col, "left")
    outs = []
    for w in (3, 5, 10):
        level, rate = F, F
        for col in ("postcode", "sector", "outcode"):
            enough = F.col(f"{col}_cagr_{w}y_count") >= 8
            level = level.when(enough, col)
            rate = rate.when(enough, F.col(f"{col}_cagr_{w}y"))
        own = F.col(f"postcode_cagr_{w}y")
        outs += [level.when(own.isNotNull(), "postcode").alias(f"level_{w}y"), rate.otherwise(own).alias(f"rate_{w}y")]
    return out.select("postcode", *outs)


@query("agg_return_sd", f"WITH {PAIRS} SELECT postcode, count(*) AS n, round(stddev_samp(annual_return), 4) AS sd FROM pairs GROUP BY postcode HAVING count(*) >= 2", "sales")
def _(i):
    g = op.repeat_sales(i.sales).groupBy("postcode")
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.stddev_samp("annual_return"), 4).alias("sd")).where("n >= 2")


@query("topk_notable", f"""WITH {PAIRS}, r AS (
  SELECT outcode, 'gain' AS kind, change_pct, address_key, row_number() OVER (PARTITION BY outcode ORDER BY change_pct DESC, sale_date, tie1, tie2, tie3, price) AS rank FROM pairs WHERE change_pct > 30 OR annual_return > 10
  UNION ALL SELECT outcode, 'loss', change_pct, address_key, row_number() OVER (PARTITION BY outcode ORDER BY change_pct, sale_date, tie1, tie2, tie3, price) FROM pairs WHERE change_pct < -10)
  SELECT * FROM r WHERE rank <= 3""", "sales")
def _(i):
    return op.notable(op.repeat_sales(i.sales), ["outcode"]).select("outcode", "kind", "change_pct", "address_key", "rank")


@query("topk_repeat_examples", f"""WITH {PAIRS},
  l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY postcode, address_key ORDER BY sale_date DESC, tie1 DESC, tie2 DESC, tie3 DESC, price DESC) AS q FROM pairs) WHERE q = 1),
  a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY postcode ORDER BY sale_date DESC, address_key) AS slot FROM l) WHERE slot <= 3),
  h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY postcode, address_key ORDER BY years_held DESC, sale_date DESC, tie1 DESC, tie2 DESC, tie3 DESC, price DESC) AS q FROM pairs
     WHERE (postcode, address_key) NOT IN (SELECT (postcode, address_key) FROM a)) WHERE q = 1),
  b AS (SELECT * FROM (SELECT h.*, row_number() OVER (PARTITION BY postcode ORDER BY years_held DESC, address_key) AS slot FROM h) h
     WHERE slot <= 5 - (SELECT count(*) FROM a WHERE a.postcode = h.postcode))
  SELECT postcode, address_key, 'recent' AS reason, slot, years_held FROM a UNION ALL SELECT postcode, address_key, 'long_held', slot, years_held FROM b""", "sales")
def _(i):
    return op.repeat_examples(op.repeat_sales(i.sales), ["postcode"]).select("postcode", "address_key", "reason", "slot", "years_held")


SUMMARY_BASE = f"""w AS (SELECT postcode, count(*) FILTER (WHERE sale_date >= DATE '{AS_OF}' - 365) AS w1, count(*) FILTER (WHERE sale_date >= DATE '{AS_OF}' - 1825) AS w5, count(*) FILTER (WHERE sale_date >= DATE '{AS_OF}' - 3650) AS w10 FROM sales GROUP BY postcode),
  c AS (SELECT postcode, CASE WHEN w1 >= 12 THEN 1 WHEN w5 >= 12 THEN 5 WHEN w10 >= 12 THEN 10 END AS window_years FROM w),
  r AS (SELECT s.*, c.window_years FROM sales s JOIN c USING (postcode) WHERE c.window_years IS NULL OR s.sale_date >= DATE '{AS_OF}' - (365 * c.window_years)::INT)"""


@query("agg_price_summary", f"""WITH {SUMMARY_BASE}, o AS (SELECT *, row_number() OVER (PARTITION BY postcode ORDER BY price) AS k, count(*) OVER (PARTITION BY postcode) AS nn FROM r)
  SELECT postcode, window_years, count(*) AS n, round(avg(price), 4) AS average_price, max(CASE WHEN k = nn // 2 + 1 THEN price END) AS median_price, min(price) AS min_price, max(price) AS max_price FROM o GROUP BY postcode, window_years""", "sales")
def _(i):
    # ladder and minimum set so that the given tables reach several rungs
    inside = op.pick_window(i.sales, ["postcode"], AS_OF, ladder=(1, 5, 10), least=12)
    got = rank.group_quantiles(inside, ["postcode", "window_years"], "price", {"average_price": "mean", "median_price": "upper", "min_price": "min", "max_price": "max"})
    return got.withColumn("average_price", F.round("average_price", 4))


@query("agg_price_by_type", """WITH o AS (SELECT *, row_number() OVER (PARTITION BY outcode, property_type ORDER BY price) AS k, count(*) OVER (PARTITION BY outcode, property_type) AS nn FROM sales)
  SELECT outcode, property_type, count(*) AS n, round(avg(price)) AS average_price, max(CASE WHEN k = nn // 2 + 1 THEN price END) AS median_price, min(price) AS min_price, max(price) AS max_price,
    round(avg(price * 1.0 / floor_area_sqft), 4) AS per_area FROM o GROUP BY outcode, property_type""", "sales")
def _(i):
    keys = ["outcode", "property_type"]
    got = rank.group_quantiles(i.sales, keys, "price", {"average_price": "mean", "median_price": "upper", "min_price": "min", "max_price": "max"})
    area = i.sales.groupBy(*keys).agg(F.round(F.avg(F.col("price") / F.col("floor_area_sqft")), 4).alias("per_area"))
    return got.withColumn("average_price", F.round("average_price")).join(area, keys)


@query("agg_price_by_year", f"""WITH {PAIRS}, o AS (SELECT *, year(sale_date) AS y, row_number() OVER (PARTITION BY outcode, year(sale_date) ORDER BY price) AS k, count(*) OVER (PARTITION BY outcode, year(sale_date)) AS nn FROM sales),
  a AS (SELECT outcode, y, count(*) AS n, round(avg(price)) AS average_price, max(CASE WHEN k = nn // 2 + 1 THEN price END) AS median_price FROM o GROUP BY outcode, y),
  b AS (SELECT outcode, year(sale_date) AS y, count(*) AS repeat_count, sum(round(annual_return * 100)::BIGINT) / count(*) / 100 AS avg_return FROM pairs GROUP BY ALL)
  SELECT a.outcode, a.y::INT AS sale_year, n, average_price, median_price, coalesce(repeat_count, 0) AS repeat_count, avg_return FROM a LEFT JOIN b USING (outcode, y)""", "sales")
def _(i):
    s = i.sales.withColumn("sale_year", F.year("sale_date"))
    keys = ["outcode", "sale_year"]
    a = rank.group_quantiles(s, keys, "price", {"average_price": "mean", "median_price": "upper"}).withColumn("average_price", F.round("average_price"))
    pairs = op.repeat_sales(i.sales).withColumn("sale_year", F.year("sale_date"))
    b = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("repeat_count"), (F.sum(F.round(F.col("annual_return") * 100).cast("bigint")) / F.count(F.lit(1)) / 100).alias("avg_return"))
    return a.join(b, keys, "left").fillna({"repeat_count": 0})


@query("target_price_position", f"""WITH {SUMMARY_BASE}, t AS (SELECT postcode, asking_price FROM listings WHERE asking_price IS NOT NULL),
  o AS (SELECT *, row_number() OVER (PARTITION BY postcode ORDER BY price) AS k, count(*) OVER (PARTITION BY postcode) AS nn FROM r),
  m AS (SELECT postcode, avg(price) AS mean, max(CASE WHEN k = nn // 2 + 1 THEN price END) AS med, count(*) AS n FROM o GROUP BY postcode),
  f AS (SELECT t.postcode, t.asking_price, count(*) FILTER (WHERE r.price <= t.asking_price) AS below FROM (SELECT DISTINCT * FROM t) t JOIN r USING (postcode) GROUP BY ALL)
  SELECT postcode, asking_price, round((asking_price / mean - 1) * 100, 2) AS vs_mean, round((asking_price * 1.0 / med - 1) * 100, 2) AS vs_median, round(below * 100.0 / n, 1) AS percentile,
   CASE WHEN asking_price / mean < 0.85 AND asking_price < med * 0.85 THEN 'well below' WHEN asking_price / mean < 0.95 AND asking_price < med * 0.95 THEN 'slightly below'
     WHEN asking_price / mean > 1.15 AND asking_price > med * 1.15 THEN 'well above' WHEN asking_price / mean > 1.05 AND asking_price > med * 1.05 THEN 'slightly above' ELSE 'close' END AS verdict
  FROM f JOIN m USING (postcode)""", "sales listings")
def _(i):
    targets = i.listings.where("asking_price IS NOT NULL").select("postcode", "asking_price").distinct()
    inside = op.pick_window(i.sales, ["postcode"], AS_OF, ladder=(1, 5, 10), least=12)
    mids = rank.group_quantiles(inside, ["postcode"], "price", {"mean": "mean", "med": "upper"})
    # targets join the market as rows of weight zero; the running count below each price is the percentile
    both = inside.select("postcode", "price", F.lit(1).alias("w")).unionByName(targets.select("postcode", F.col("asking_price").alias("price"), F.lit(0).alias("w")))
    below = rank.tally_before(both, ["postcode"], "price", F.col("w")).select("postcode", F.col("price").alias("asking_price"), (F.col("below") + F.col("own")).alias("_below"))
    t = targets.join(below, ["postcode", "asking_price"]).join(mids, "postcode")
    a, m = (F.col("asking_price") / F.col("mean") - 1) * 100, (F.col("asking_price") / F.col("med") - 1) * 100
    verdict = (F.when((a < -15) & (m < -15), "well below").when((a < -5) & (m < -5), "slightly below")
               .when((a > 15) & (m > 15), "well above").when((a > 5) & (m > 5), "slightly above").otherwise("close"))
    return t.select("postcode", "asking_price", F.round(a, 2).alias("vs_mean"), F.round(m, 2).alias("vs_median"),
                    F.round(F.col("_below") * 100.0 / F.col("n"), 1).alias("percentile"), verdict.alias("verdict"))


@query("topk_busiest_postcodes", "SELECT postcode, count(*) AS n FROM sales GROUP BY postcode ORDER BY n DESC, postcode LIMIT 40", "sales")
def _(i):
    return i.sales.groupBy("postcode").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "postcode").limit(40)


RESALE = """
rp AS (SELECT address_key, postcode, outcode, sector, property_type, d0 AS first_date, sale_date AS last_date, p0 AS first_price, price AS last_price,
    (price - p0) * 1.0 / p0 * 100 AS pct_change, date_diff('day', d0, sale_date) / 365.25 AS hold_years, c0 AS first_category, category AS last_category,
    CASE WHEN n = 2 THEN 1 ELSE 0 END AS is_single_hold
  FROM (SELECT *, lag(price) OVER w AS p0, lag(sale_date) OVER w AS d0, lag(category) OVER w AS c0, count(*) OVER (PARTITION BY address_key) AS n FROM sales
    WINDOW w AS (PARTITION BY address_key ORDER BY sale_date, tie1, tie2, tie3, price)) x WHERE d0 IS NOT NULL)
"""
MEDIANS_SQL = "(VALUES " + ", ".join(f"({y}, {m}.0)" for y, m in op.MARKET_MEDIANS.items()) + ") v(y, m)"
MARKET = f"""
{RESALE}, ann AS (SELECT rp.*, CASE WHEN hold_years >= 0.5 THEN (pow(last_price * 1.0 / first_price, 1 / hold_years) - 1) * 100 END AS ann, a.m AS m1, b.m AS m2
   FROM rp LEFT JOIN {MEDIANS_SQL.replace('v(y, m)', 'a(y, m)')} ON a.y = year(first_date) LEFT JOIN {MEDIANS_SQL.replace('v(y, m)', 'b(y, m)')} ON b.y = year(last_date)),
mk AS (SELECT *, coalesce(first_price >= 50000 AND NOT coalesce(pct_change > 80 AND hold_years < 8, false) AND NOT coalesce(ann > 20 OR ann < -35, false), false)
   OR coalesce(year(first_date) < 2005 AND first_price >= least(50000, 0.3 * m1) AND ann IS NOT NULL AND ann - (pow(m2 / m1, 1 / hold_years) - 1) * 100 <= 12 AND ann >= -35, false) AS market,
   coalesce(first_category = 'A' AND last_category = 'A', false) AS aa FROM ann)
"""


@query("resale_pairs", f"""WITH {RESALE} SELECT address_key, postcode, strftime(first_date, '%Y-%m-%d') AS first_date, strftime(last_date, '%Y-%m-%d') AS last_date, first_price, last_price,
  round(pct_change, 6) AS pct_change, round(hold_years, 6) AS hold_years, first_category, last_category, is_single_hold FROM rp""", "sales")
def _(i):
    return op.resale_pairs(i.sales).select("address_key", "postcode", iso("first_date"), iso("last_date"), "first_price", "last_price",
        F.round("pct_change", 6).alias("pct_change"), F.round("hold_years", 6).alias("hold_years"), "first_category", "last_category", "is_single_hold")


@query("filter_market_pair", f"WITH {MARKET} SELECT address_key, first_price, last_price, strftime(last_date, '%Y-%m-%d') AS last_date FROM mk WHERE market", "sales")
def _(i):
    return op.resale_pairs(i.sales).where(op.is_market_pair()).select("address_key", "first_price", "last_price", iso("last_date"))


@query("filter_clean_pair", f"WITH {MARKET} SELECT outcode, count(*) AS n, sum(last_price)::BIGINT AS total FROM mk WHERE aa GROUP BY outcode", "sales")
def _(i):
    return op.resale_pairs(i.sales).where(op.is_clean_pair()).groupBy("outcode").agg(F.count(F.lit(1)).alias("n"), F.sum("last_price").alias("total"))


@query("annualised_return", f"WITH {MARKET} SELECT address_key, first_price, last_price, round(hold_years, 6) AS hold_years, round(ann, 6) AS rate FROM mk", "sales")
def _(i):
    rate = op.annualised(F.col("first_price"), F.col("last_price"), F.col("hold_years"))
    return op.resale_pairs(i.sales).select("address_key", "first_price", "last_price", F.round("hold_years", 6).alias("hold_years"), F.round(rate, 6).alias("rate"))


STATS_SQL = """count(*) AS n, round(median(pct_change), 6) AS median_pct, count(*) FILTER (WHERE pct_change < 0) AS losers, count(*) FILTER (WHERE pct_change >= 0) AS gainers,
  round(100.0 * count(*) FILTER (WHERE pct_change < 0) / count(*), 6) AS loss_share, round(median(hold_years), 6) AS median_hold"""


# homes of their own: most have a handful of sales, many just the two of a single hold
HOMES_SQL = MARKET.replace("FROM sales", "FROM home_sales")


@query("agg_cohort_stats", f"WITH {HOMES_SQL} SELECT year(first_date)::INT AS buy_year, {STATS_SQL} FROM mk WHERE market AND aa AND is_single_hold = 1 GROUP BY year(first_date) HAVING count(*) >= 3", "home_sales")
def _(i):
    pairs = op.resale_pairs(i.home_sales).where(op.is_market_pair() & op.is_clean_pair() & (F.col("is_single_hold") == 1)).withColumn("buy_year", F.year("first_date"))
    got = op.cohort_stats(pairs, ["buy_year"]).where("n >= 3")
    return got.select("buy_year", "n", F.round("median_pct", 6).alias("median_pct"), "losers", "gainers", F.round("loss_share", 6).alias("loss_share"), F.round("median_hold", 6).alias("median_hold"))


SUBJECTS = """subj AS (SELECT id AS subject_id, postcode, outcode, sector, asking_price, CASE WHEN lower(property_type) IN ('flat','maisonette','studio','penthouse') THEN 'F'
   WHEN lower(property_type) LIKE '%house%' OR lower(property_type) LIKE '%terrace%' OR lower(property_type) LIKE '%detached%' OR lower(property_type) LIKE '%bungalow%' THEN 'TSD' END AS codes FROM listings)"""


@query("topk_comparables", f"""WITH {SUBJECTS}, c AS (SELECT subject_id, s.price, s.sale_date, s.tie1, s.tie2, s.tie3, CASE WHEN s.postcode = j.postcode THEN 0 ELSE 1 END AS far,
    CASE WHEN codes IS NULL OR contains(codes, s.property_type) THEN 1 ELSE 0 END AS hit FROM subj j JOIN sales s ON s.outcode = j.outcode AND s.category = 'A' AND s.sale_date >= DATE '2019-06-01'),
  f AS (SELECT *, max(hit) OVER (PARTITION BY subject_id) AS any_hit FROM c),
  r AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY far, sale_date DESC, price, tie1, tie2, tie3) AS rank FROM f WHERE hit = any_hit)
  SELECT subject_id, rank, far, price, any_hit AS typed FROM r WHERE rank <= 10""", "sales listings")
def _(i):
    return op.comparables(i.sales, subjects(i), AS_OF, 10).select("subject_id", "rank", "far", "price", F.col("any_hit").alias("typed"))


def subjects(i):
    t = F.lower("property_type")
    flat = t.rlike("flat|apartment|maisonette|studio|penthouse")
    house = t.rlike("house|terrace|semi|detached|bungalow|mews|cottage")
    codes = F.when(flat, F.array(F.lit("F"))).when(house, F.array(F.lit("T"), F.lit("S"), F.lit("D")))
    return i.listings.select(F.col("id").alias("subject_id"), "postcode", "outcode", "sector", "asking_price", codes.alias("type_codes"))


@query("comparables", f"""WITH {SUBJECTS}, c AS (SELECT subject_id, s.price, s.sale_date, s.category, s.tie1, s.tie2, s.tie3, CASE WHEN s.postcode = j.postcode THEN 0 ELSE 1 END AS far,
    CASE WHEN codes IS NULL OR contains(codes, s.property_type) THEN 1 ELSE 0 END AS hit FROM subj j JOIN sales s ON s.outcode = j.outcode AND s.sale_date >= DATE '2019-06-01'),
  f AS (SELECT *, coalesce(max(CASE WHEN category = 'A' THEN hit END) OVER (PARTITION BY subject_id), 0) AS any_hit FROM c),
  r AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY far, sale_date DESC, price, tie1, tie2, tie3) AS rank FROM f WHERE hit >= any_hit AND category = 'A'),
  st AS (SELECT subject_id, count(*) AS n, floor(median(price))::BIGINT AS median_price, min(price) AS low, max(price) AS high FROM r WHERE rank <= 10 GROUP BY subject_id),
  x AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY far, sale_date DESC, price, tie1, tie2, tie3) AS rank FROM f WHERE hit >= any_hit AND category = 'B'),
  b AS (SELECT subject_id, count(*) AS b_count, string_agg(price || '@' || strftime(sale_date, '%Y-%m-%d'), '|' ORDER BY rank) FILTER (WHERE rank <= 3) AS b_examples FROM x GROUP BY subject_id)
  SELECT j.subject_id, CASE WHEN codes IS NULL THEN 'all' WHEN coalesce((SELECT max(any_hit) FROM r WHERE r.subject_id = j.subject_id), 0) = 1 THEN 'typed' ELSE 'widened' END AS scope,
   CASE WHEN n > 0 THEN 'standard' WHEN b_count > 0 THEN 'only_b' ELSE 'none' END AS basis, coalesce(n, 0) AS n, median_price, low, high, coalesce(b_count, 0) AS b_count, b_examples, round((asking_price - median_price) * 1.0 / median_price * 100, 4) AS asking_vs_median_pct
  FROM subj j LEFT JOIN st USING (subject_id) LEFT JOIN b USING (subject_id)""", "sales listings")
def _(i):
    return op.comparable_report(i.sales, subjects(i), AS_OF, 10)


@query("win_dedupe_sales", """SELECT address, postcode, price, strftime(sale_date, '%Y-%m-%d') AS sale_date, listing_no FROM (SELECT *, row_number() OVER (PARTITION BY address, postcode, sale_date, price ORDER BY listing_no) AS q FROM (
   SELECT upper(concat_ws(' ', saon, paon, street)) AS address, s.*, coalesce(e.p, 0) * 1000000000 + tie1 * 1000 + tie2 * 100 + tie3 AS listing_no FROM sales s LEFT JOIN (SELECT 0 AS p UNION ALL SELECT 1) e ON s.tie1 % 7 = 0)) WHERE q = 1""", "sales")
def _(i):
    # every seventh sale is listed by two agents
    agents = F.when(F.col("tie1") % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    listed = i.sales.withColumn("_agent", F.explode(agents)).withColumn(
        "listing_no", F.col("_agent") * 1_000_000_000 + F.col("tie1") * 1000 + F.col("tie2") * 100 + F.col("tie3"))
    kept = op.dedupe_sales(listed, ["listing_no"])
    return kept.select(F.col("addr").alias("address"), "postcode", "price", iso("sale_date"), "listing_no")


@query("sold_nearby", f"""WITH m AS (SELECT upper(concat_ws(' ', saon, paon, street)) AS address, *, (tie1 + tie3) % 100 AS match_score FROM sales),
  k AS (SELECT outcode, address, postcode, price, sale_date, min(tie1) AS tie FROM m WHERE match_score >= 60 AND bedrooms BETWEEN 1 AND 3 AND property_type = 'F' GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY outcode ORDER BY sale_date DESC, price DESC, address, postcode) AS rank FROM k)
  SELECT outcode, rank, address, price, strftime(sale_date, '%Y-%m-%d') AS sale_date FROM r WHERE rank <= 15""", "sales")
def _(i):
    rows = i.sales.withColumn("match_score", (F.col("tie1") + F.col("tie3")) % 100)
    rows = rows.where((F.col("match_score") >= 60) & F.col("bedrooms").between(2 - 1, 2 + 1) & (F.col("property_type") == "F"))
    kept = op.dedupe_sales(rows, ["tie1", "tie2", "tie3"])
    top = rank.first_k(kept, ["outcode"], [F.desc("sale_date"), F.desc("price"), "addr", "postcode"], 15)
    return top.select("outcode", "rank", F.col("addr").alias("address"), "price", iso("sale_date"))
