"""Valuation and vector queries."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from hearthspan.functions.rank import group_quantiles
from hearthspan.operators import nearest, valuation as op
from hearthspan.operators import vectors as vec
from hearthspan.plans.base import query
from hearthspan.plans.joins import KM_SQL, POOL_SQL, RADIUS_SQL, area_rates, knn_sql, listing_subjects, pool
from hearthspan.plans.sales import RESALE, iso
from hearthspan.session import checkpointed

TREES = 400  # as the reference

_PP = "pp AS (SELECT *, CASE WHEN property_type = 'F' THEN 'flat' ELSE 'house' END AS segment, price * 1.0 / floor_area_sqft AS ppsf, year(sale_date) AS year_sold FROM sales WHERE coalesce(category, '') <> 'B' AND property_type <> 'O' AND year(sale_date) >= 2006)"
_FL = f"{_PP}, md AS (SELECT segment, year_sold // 5 AS span, median(ppsf) AS m FROM pp GROUP BY ALL), fl AS (SELECT pp.* FROM pp JOIN md ON md.segment = pp.segment AND md.span = pp.year_sold // 5 WHERE ppsf >= m * 0.5 AND price BETWEEN 20000 AND 10000000 AND floor_area_sqft BETWEEN 160 AND 10764)"
_PV = f"{_FL}, pv AS (SELECT *, lag(price) OVER w AS prev_price, lag(sale_date) OVER w AS prev_date, row_number() OVER w AS sale_no FROM fl WINDOW w AS (PARTITION BY address_key ORDER BY sale_date, tie1, tie2, tie3, price))"


@query("filter_ppsf_floor", f"WITH {_FL} SELECT segment, year_sold, count(*) AS n, round(min(ppsf), 6) AS low FROM fl GROUP BY ALL", "sales")
def _(i):
    from hearthspan.operators.sales import not_b

    rows = op.with_ppsf(i.sales.where(not_b(F.col("category")) & (F.col("property_type") != "O"))).where("year_sold >= 2006")
    return op.ppsf_floor(rows).groupBy("segment", F.col("year_sold").cast("bigint").alias("year_sold")).agg(F.count(F.lit(1)).alias("n"), F.round(F.min("ppsf"), 6).alias("low"))


@query("win_prev_sale_features", f"""WITH {_PV} SELECT address_key, tie1, tie2, tie3, price, CASE WHEN prev_price IS NULL THEN 0 ELSE 1 END AS has_prev, round(coalesce(date_diff('day', prev_date, sale_date) / 365.25, -1), 6) AS years_since_prev,
  round(ln(greatest(coalesce(prev_price, 0), 1)), 6) AS prev_log_price, round(coalesce(ln(greatest(prev_price * 1.0 / floor_area_sqft, 1)), 0), 6) AS prev_log_ppsf FROM pv""", "sales")
def _(i):
    return op.pool(i.sales).select("address_key", "tie1", "tie2", "tie3", "price", "has_prev", *[F.round(c, 6).alias(c) for c in ("years_since_prev", "prev_log_price", "prev_log_ppsf")])


@query("win_group_median", "SELECT id, coalesce(nullif(floor_area_sqft, 0), m) AS area, CASE WHEN floor_area_sqft = 0 THEN 1 ELSE 0 END AS missing FROM listings JOIN (SELECT outcode, bedrooms, median(nullif(floor_area_sqft, 0)) AS m FROM listings GROUP BY ALL) g USING (outcode, bedrooms)", "listings")
def _(i):
    own = F.nullif(F.col("floor_area_sqft"), F.lit(0))
    rows = i.listings.withColumn("own", own)
    mid = group_quantiles(rows, ["outcode", "bedrooms"], "own", {"m": "median"}, count=None)
    return rows.join(mid, ["outcode", "bedrooms"], "left").select("id", F.coalesce(F.col("own").cast("double"), "m").alias("area"), F.col("own").isNull().cast("int").alias("missing"))


@query("win_hpi_adjust", f"WITH {_PV}, y AS (SELECT year_sold, median(ppsf) AS m FROM pv GROUP BY 1) SELECT address_key, tie1, tie2, tie3, price, round(coalesce(prev_price * a.m / b.m, 0), 4) AS prev_hpi FROM pv JOIN y a ON a.year_sold = pv.year_sold LEFT JOIN y b ON b.year_sold = year(prev_date)", "sales")
def _(i):
    return op.hpi_adjusted(op.pool(i.sales)).select("address_key", "tie1", "tie2", "tie3", "price", F.round("prev_hpi", 4).alias("prev_hpi"))


@query("win_top_quartile_flag", "SELECT id, CASE WHEN n > 4 AND decor_score >= q THEN 1 ELSE 0 END AS top FROM listings JOIN (SELECT outcode, count(decor_score) AS n, quantile_cont(decor_score, 0.75) AS q FROM listings GROUP BY outcode) g USING (outcode) WHERE decor_score IS NOT NULL", "listings")
def _(i):
    q = group_quantiles(i.listings, ["outcode"], "decor_score", {"q": ("interp", 0.75)})
    top = (F.col("n") > 4) & (F.col("decor_score") >= F.col("q"))
    return i.listings.where("decor_score IS NOT NULL").join(q, "outcode").select("id", top.cast("int").alias("top"))


@query("win_weighted_quantile", "WITH r AS (SELECT l_partkey, v, sum(w) OVER (PARTITION BY l_partkey ORDER BY v) / sum(w) OVER (PARTITION BY l_partkey) AS share FROM (SELECT l_partkey, l_extendedprice AS v, sum(l_quantity) AS w FROM lineitem GROUP BY ALL) t) SELECT l_partkey, min(v) FILTER (WHERE share >= 0.25) AS q25, min(v) FILTER (WHERE share >= 0.5) AS q50, min(v) FILTER (WHERE share >= 0.75) AS q75 FROM r GROUP BY l_partkey")
def _(i):
    return nearest.weighted_quantiles(i.table("lineitem"), "l_partkey", "l_extendedprice", "l_quantity")


@query("valuation_pool", f"""WITH {_PV} SELECT address_key, strftime(sale_date, '%Y-%m-%d') AS sale_date, tie1, tie2, tie3, price, segment, year_sold::INT AS year_sold, sale_no, CASE WHEN tenure = 'L' THEN 1 ELSE 0 END AS is_leasehold, CASE WHEN new_build = 'Y' THEN 1 ELSE 0 END AS new, round(ppsf, 6) AS ppsf FROM pv""", "sales")
def _(i):
    return op.pool(i.sales).select("address_key", iso("sale_date"), "tie1", "tie2", "tie3", "price", "segment", "year_sold", F.col("sale_no").cast("bigint").alias("sale_no"), "is_leasehold", "new", F.round("ppsf", 6).alias("ppsf"))


@query("feature_groups", f"WITH {_PV} SELECT segment, count(*) AS n, 11 + 2 AS width, sum(bedrooms * (segment = 'flat')::INT)::BIGINT AS beds_flat, sum(bedrooms * (segment <> 'flat')::INT)::BIGINT AS beds_house FROM pv GROUP BY segment", "sales")
def _(i):
    f = op.features(op.pool(i.sales))
    g = f.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vector_to_array("features"))).alias("width"), F.sum("beds_flat").alias("beds_flat"), F.sum("beds_house").alias("beds_house"))
    return g


@query("valuation_gbt")
def _(i):
    # rows only: fitted trees
    d = op.assembled(op.training_rows(i.sales))
    return op.fit_predict(d.where("year_sold < 2021"), d.where("year_sold >= 2021"), TREES).select("address_key", "price", F.round("pred", 2).alias("pred"))


@query("eval_group_kfold")
def _(i):
    return op.error_metrics(op.kept(op.group_folds(op.assembled(op.training_rows(i.sales)), TREES), ["fold"]), ["fold"])


@query("eval_walk_forward")
def _(i):
    return op.error_metrics(op.kept(op.walk_forward(op.assembled(op.training_rows(i.sales)), list(range(2016, 2023)), TREES), ["year_sold"]), ["year_sold"])


@query("eval_ablation")
def _(i):
    return op.ablation(op.training_rows(i.sales), TREES)


@query("counterfactual_contrib")
def _(i):
    d = op.assembled(op.training_rows(i.sales))
    neutral = {"tenure": {"is_leasehold": 0, "new": 0}, "repeat": {"has_prev": 0, "prev_log_price": 0.0, "years_since_prev": -1.0, "prev_log_ppsf": 0.0}}
    return op.contributions(d.where("year_sold >= 2022"), d.where("year_sold < 2022"), TREES, neutral).groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.avg("delta").alias("mean_delta"))


_ST = "st AS (SELECT address_key, price, year(sale_date)::INT AS year_sold, outcode, price * (0.82 + (tie1 % 45) / 100.0)::DOUBLE AS pred FROM sales)"


def stored(i):
    """Stored predictions: the price moved by a fixed residue."""
    rows = i.sales
    return rows.select("address_key", "price", F.year("sale_date").alias("year_sold"), "outcode", (F.col("price") * (F.lit(0.82) + F.col("tie1") % 45 / 100.0)).alias("pred"))


def _metrics(src, keys):
    k = ", ".join(keys)
    return f"""SELECT {k + ',' if k else ''} count(*) AS n, round(avg(abs(pred - price) / price) * 100, 6) AS mape, round(count(*) FILTER (WHERE abs(pred - price) / price < 0.05) * 100.0 / count(*), 6) AS within5, round(count(*) FILTER (WHERE abs(pred - price) / price < 0.10) * 100.0 / count(*), 6) AS within10,
  round(count(*) FILTER (WHERE abs(pred - price) / price < 0.20) * 100.0 / count(*), 6) AS within20, round(median(abs(pred - price) / price) * 100, 6) AS median_ape, round(median((pred - price) / price) * 100, 6) AS bias FROM {src} {'GROUP BY ' + k if k else ''}"""


@query("agg_error_metrics", f"WITH {_ST} {_metrics('st', ['outcode'])}", "sales")
def _(i):
    return op.error_metrics(stored(i), ["outcode"])


@query("eval_period_detail", f"WITH {_ST} {_metrics('st', ['year_sold'])}", "sales")
def _(i):
    return op.error_metrics(stored(i), ["year_sold"])


@query("bias_correction", f"WITH {_ST}, b AS (SELECT median((pred - price) / price) AS b FROM st), c AS (SELECT price, pred / (1 + (SELECT b FROM b)) AS pred FROM st) SELECT count(*) AS n, round(avg(abs(pred - price) / price) * 100, 6) AS mape, round(median((pred - price) / price) * 100, 6) AS bias FROM c", "sales")
def _(i):
    # abs() keeps a bias of minus zero from printing apart from zero
    return op.error_metrics(op.bias_corrected(stored(i)), []).select("n", "mape", F.round(F.abs("bias"), 6).alias("bias"))


# yearly growth around each place, as `join_radius_pairs` gives it
_GROWTH = f"{RESALE}, {RADIUS_SQL}, gr AS (SELECT subject AS s_place, CASE WHEN max(n) >= 30 THEN max(v) FILTER (WHERE k = n // 2 + 1) END AS rate FROM rc GROUP BY subject)"


def _estimate(ref):
    return f"""mm AS (SELECT subject, max(r) FILTER (WHERE k = c // 2 + 1) AS m, max(c) AS m_n FROM (SELECT subject, c_price * 1.0 / c_area AS r, row_number() OVER (PARTITION BY subject ORDER BY c_price * 1.0 / c_area) AS k, count(*) OVER (PARTITION BY subject) AS c FROM nn) x GROUP BY subject),
 aa AS (SELECT n.*, c_price * 1.0 / c_area * pow(1 + coalesce(rate, 0) / 100, date_diff('day', c_date, {ref}) / 365.25) AS v FROM nn n LEFT JOIN gr USING (s_place)),
 uu AS (SELECT subject, s_area, v, 1 / (km / 1.609344 + 0.05) * exp(-greatest(0, date_diff('day', c_date, {ref}) / 365.25) / 4) AS w FROM aa JOIN mm USING (subject) WHERE rank <= 20 AND v > 0 AND v <= 50000 AND v >= CASE WHEN m_n >= 10 THEN m * 0.5 ELSE 0 END),
 ww AS (SELECT subject, s_area, v, sum(w) AS w FROM uu GROUP BY ALL), qq AS (SELECT *, sum(w) OVER (PARTITION BY subject ORDER BY v) / sum(w) OVER (PARTITION BY subject) + 1e-12 AS share FROM ww),
 ee AS (SELECT subject, (SELECT count(*) FROM uu WHERE uu.subject = qq.subject) AS used, floor(min(v) FILTER (WHERE share >= 0.25) * max(s_area))::BIGINT AS low, floor(min(v) FILTER (WHERE share >= 0.5) * max(s_area))::BIGINT AS mid, floor(min(v) FILTER (WHERE share >= 0.75) * max(s_area))::BIGINT AS high FROM qq GROUP BY subject),
 est AS (SELECT f.subject, CASE WHEN c >= 5 THEN coalesce(used, 0) ELSE c END AS used, CASE WHEN c >= 5 THEN low END AS low, CASE WHEN c >= 5 THEN mid END AS mid, CASE WHEN c >= 5 THEN high END AS high FROM (SELECT subject, count(*) AS c FROM nn GROUP BY subject) f LEFT JOIN ee USING (subject))"""


def growth(i):
    return area_rates(i).select(F.col("subject").alias("place"), F.col("mid").alias("rate"))


@query("valuation_knn", f"WITH {POOL_SQL}, {KM_SQL}, {knn_sql(50)}, {_GROWTH}, {_estimate(chr(68) + 'ATE ' + repr('2022-06-01'))} SELECT * FROM est", "sales listings coords")
def _(i):
    # homes of one place, segment and bedrooms have the same neighbours: they are sought and weighed once
    own = F.struct("place", "segment", "beds")
    homes = listing_subjects(i)
    nn = checkpointed(nearest.knn_sales(homes.select(own.alias("subject"), "place", "lat", "lon", "segment", "beds").distinct(), pool(i), 50))
    return op.knn_estimate(nn, growth(i), F.lit("2022-06-01").cast("date"), areas=homes.select("subject", "area", own.alias("_of")))


@query("valuation_knn_loocv", f"""WITH {POOL_SQL.replace(" subj AS", " unused AS")}, subj AS (SELECT tie1 * 100000 + tie2 * 1000 + tie3 AS subject, place, r_lat AS lat, r_lon AS lon, segment, beds, area, address_key, sale_date, price FROM pool WHERE sale_date >= DATE '2022-03-01'), {KM_SQL},
  {knn_sql(50, 'AND p.address_key <> s.address_key').replace('s.area AS s_area', 's.area AS s_area, s.sale_date AS s_date, s.price AS s_price')}, {_GROWTH}, {_estimate('s_date')},
  e AS (SELECT est.subject, est.mid, s.price FROM est JOIN (SELECT DISTINCT subject, price, area FROM subj) s USING (subject) JOIN mm USING (subject) WHERE est.mid IS NOT NULL AND (mm.m_n < 10 OR s.price * 1.0 / s.area >= mm.m * 0.5))
  SELECT count(*) AS n, round(avg(abs(mid - price) * 1.0 / price) * 100, 6) AS mape, round(median((mid - price) * 1.0 / price) * 100, 6) AS bias FROM e""", "sales listings coords")
def _(i):
    p = pool(i)
    sid = F.col("tie1") * 100000 + F.col("tie2") * 1000 + F.col("tie3")
    s = p.where("sale_date >= DATE'2022-03-01'").select(sid.alias("subject"), "place", F.col("r_lat").alias("lat"), F.col("r_lon").alias("lon"), "segment", "beds", "area", "address_key", F.col("sale_date").alias("s_date"), F.col("price").alias("s_price"))
    nn = checkpointed(nearest.knn_sales(s, p, 50, own=True))
    est = op.knn_estimate(nn, growth(i), F.col("s_date")).where("mid IS NOT NULL")
    raw = nn.withColumn("r", F.col("c_price") / F.col("c_area"))
    mid = group_quantiles(raw, ["subject"], "r", {"m": "upper"}, count="m_n")
    j = est.join(mid, "subject").join(s.select("subject", F.col("s_price").alias("price"), F.col("area").alias("s_area")).distinct(), "subject")
    # a subject far under its neighbours is not a market sale
    j = j.where((F.col("m_n") < 10) | (F.col("price") / F.col("s_area") >= F.col("m") * 0.5))
    return op.error_metrics(j.withColumnRenamed("mid", "pred"), []).select("n", "mape", "bias")


# ---- vectors ------------------------------------------------------------------------------------

_V = "v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)"
_Q = "q AS (SELECT vec_id AS query_id, e AS q FROM v ORDER BY md5('7-' || vec_id) LIMIT 100)"


@query("embed_prompt_score", f"""WITH {_V}, p AS (SELECT CASE vec_id % 4 WHEN 0 THEN 'rich' WHEN 1 THEN 'plain' WHEN 2 THEN 'indoor' ELSE 'outdoor' END AS kind, e FROM v WHERE vec_id < 12), d AS (SELECT v.vec_id, p.kind, avg(list_dot_product(v.e, p.e)) AS s FROM v CROSS JOIN p GROUP BY ALL),
  w AS (SELECT vec_id, max(s) FILTER (WHERE kind = 'rich') AS r, max(s) FILTER (WHERE kind = 'plain') AS b, max(s) FILTER (WHERE kind = 'indoor') AS n, max(s) FILTER (WHERE kind = 'outdoor') AS o FROM d GROUP BY vec_id)
  SELECT vec_id, round(1 / (1 + exp(-(r - b) * 10)), 6) AS score, CASE WHEN n > o THEN 1 ELSE 0 END AS is_interior FROM w""")
def _(i):
    # the first twelve vectors are the prompt sets, three to a set
    e = i.table("embeddings")
    kinds = F.element_at(F.array(*[F.lit(x) for x in ("rich", "plain", "indoor", "outdoor")]), (F.col("vec_id") % 4 + 1).cast("int"))
    prompts = e.where("vec_id < 12").select(kinds.alias("kind"), F.col("embedding").alias("vec"))
    return vec.prompt_score(e, prompts).withColumn("score", F.round("score", 6))


@query("embed_topk_exact", f"WITH {_V}, {_Q}, r AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY list_dot_product(q, e) DESC, vec_id) AS rank, list_dot_product(q, e) AS s FROM q CROSS JOIN v) SELECT query_id, vec_id, rank, round(s, 6) AS score FROM r WHERE rank <= 10")
def _(i):
    e = i.table("embeddings")
    return vec.top_k_exact(e, vec.sample_queries(e, 100, "7"), 10).select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


_QZ = f"""{_V}, u AS (SELECT vec_id, unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM v), rg AS (SELECT pos, min(x) AS lo, max(x) AS hi FROM u GROUP BY pos),
 z AS (SELECT vec_id, u.pos, x, coalesce(round((x - lo) / nullif(hi - lo, 0) * 255), 0) AS c, lo + coalesce(round((x - lo) / nullif(hi - lo, 0) * 255), 0) / 255 * (hi - lo) AS y FROM u JOIN rg USING (pos))"""


@query("embed_quantise_sq8", f"WITH {_QZ} SELECT vec_id, sum(c)::BIGINT AS code_sum, round(max(abs(x - y)), 6) AS worst FROM z GROUP BY vec_id")
def _(i):
    z = vec.quantise(i.table("embeddings"))
    gap = F.array_max(F.zip_with(vec.doubles("embedding"), "decoded", lambda a, b: F.abs(a - b)))
    total = F.aggregate("codes", F.lit(0.0), lambda s, c: s + c)
    return z.select("vec_id", total.cast("bigint").alias("code_sum"), F.round(gap, 6).alias("worst"))


@query("embed_recall_at_k", f"""WITH {_QZ}, {_Q}, d AS (SELECT vec_id, list(y ORDER BY pos) AS y FROM z GROUP BY vec_id), x AS (SELECT query_id, v.vec_id, row_number() OVER (PARTITION BY query_id ORDER BY list_dot_product(q, e) DESC, v.vec_id) AS a, row_number() OVER (PARTITION BY query_id ORDER BY list_dot_product(q, d.y) DESC, v.vec_id) AS b, list_dot_product(q, e) AS se, list_dot_product(q, d.y) AS sy FROM q CROSS JOIN v JOIN d USING (vec_id)),
  p AS (SELECT query_id, count(*) FILTER (WHERE a <= 10 AND b <= 10) / 10.0::DOUBLE AS recall, abs(max(se) - max(sy)) AS gap FROM x GROUP BY query_id)
  SELECT count(*) AS queries, round(avg(recall), 6) AS mean, round(median(recall), 6) AS mid, round(quantile_cont(recall, 0.1), 6) AS p10, round(avg(gap), 6) AS first_offset, CASE WHEN avg(recall) >= 0.9 THEN 1 ELSE 0 END AS passes FROM p""")
def _(i):
    e = i.table("embeddings")
    q = vec.sample_queries(e, 100, "7")
    coded = vec.quantise(e).select("vec_id", F.col("decoded").alias("embedding"))
    out = vec.recall_at_k(vec.top_k_exact(e, q, 10), vec.top_k_exact(coded, q, 10), 10)
    return out.select("queries", *[F.round(c, 6).alias(c) for c in ("mean", "mid", "p10", "first_offset")], "passes")


@query("embed_topk_lsh")
def _(i):
    # rows only: random planes; the tests compare its recall with the exact search
    e = i.table("embeddings")
    return vec.top_k_hashed(e, vec.sample_queries(e, 100, "7"), 10)


@query("embed_pca")
def _(i):
    # rows only: the signs of components are arbitrary
    return vec.project(i.table("embeddings"))
