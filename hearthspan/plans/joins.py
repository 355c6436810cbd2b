"""Join queries."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hearthspan.functions import labels
from hearthspan.functions.rank import newest
from hearthspan.operators import nearest as op
from hearthspan.operators import sales as sale_op
from hearthspan.operators.market import active_canonical, dominated_counts, tag_supersets
from hearthspan.operators.spatial import within_box
from hearthspan.plans.base import query
from hearthspan.plans.sales import RESALE
from hearthspan.plans.scalars import sale_address
from hearthspan.session import checkpointed


@query("join_enrich_left", """WITH s AS (SELECT postcode, sale_date, price, max(new_build) AS new_build FROM sales WHERE tie1 % 3 <> 0 GROUP BY ALL) SELECT a.address_key, a.tie1, a.tie2, a.tie3, a.price, s.new_build FROM sales a LEFT JOIN s USING (postcode, sale_date, price)""", "sales")
def _(i):
    known = i.sales.where("tie1 % 3 <> 0").groupBy("postcode", "sale_date", "price").agg(F.max("new_build").alias("new_build"))
    return i.sales.drop("new_build").join(known, ["postcode", "sale_date", "price"], "left").select("address_key", "tie1", "tie2", "tie3", "price", "new_build")


_DOC = "SELECT DISTINCT postcode FROM score_docs WHERE data_version = '{v}' AND data_json NOT LIKE '%\"_no_data\"%' AND tie3 % 7 = {m}"


@query("join_inner_chain", " INTERSECT ".join(_DOC.format(v=v, m=m) for v, m in (("v1", 0), ("v2", 1), ("v3", 2), ("v1", 3), ("v2", 4), ("v3", 5))), "score_docs")
def _(i):
    out = None
    for v, m in (("v1", 0), ("v2", 1), ("v3", 2), ("v1", 3), ("v2", 4), ("v3", 5)):
        side = i.score_docs.where((F.col("data_version") == v) & ~F.col("data_json").contains('"_no_data"') & (F.col("tie3") % 7 == m)).select("postcode").distinct()
        out = side if out is None else out.join(side, "postcode")
    return out


def lsoa(i):
    k = F.col("c_custkey")
    return i.table("customer").select(k.alias("area_no"), F.col("c_nationkey").alias("lad"), (k % 997).alias("total_12m"), (k % 500).alias("prior_12m"), (k % 13 * 100).alias("pop"))


@query("join_geo_lookup", """SELECT l.id, c.c_custkey AS area_no, c.c_custkey % 997 AS total_12m, c.c_custkey % 10 + 1 AS decile, p.o_n FROM listings l JOIN customer c ON c.c_custkey = l.id AND c.c_custkey % 6 <> 0 LEFT JOIN (SELECT o_custkey, count(*) AS o_n FROM orders GROUP BY 1) p ON p.o_custkey = c.c_custkey""", "listings")
def _(i):
    # listing to small area, inner to crime and deprivation, left to counts
    crime = lsoa(i)
    decile = lsoa(i).where("area_no % 6 <> 0").select("area_no", (F.col("area_no") % 10 + 1).alias("decile"))
    counts = i.table("orders").groupBy(F.col("o_custkey").alias("area_no")).agg(F.count(F.lit(1)).alias("o_n"))
    j = i.listings.select("id", F.col("id").alias("area_no")).join(crime, "area_no").join(decile, "area_no").join(counts, "area_no", "left")
    return j.select("id", "area_no", "total_12m", "decile", "o_n")


@query("join_anti_pending", "SELECT i.property_id, i.image_no, i.tie3 FROM images i WHERE NOT EXISTS (SELECT 1 FROM plans p WHERE p.id = i.property_id AND p.ok = 1) AND model_tag = 'm1'", "images plans")
def _(i):
    done = i.plans.where("ok = 1").select(F.col("id").alias("property_id"))
    return i.images.where("model_tag = 'm1'").join(done, "property_id", "left_anti").select("property_id", "image_no", "tie3")


@query("join_anti_orphans", "SELECT property_id, count(*) AS n FROM price_history h WHERE NOT EXISTS (SELECT 1 FROM listings l WHERE l.id = h.property_id AND l.delisted_date IS NULL) GROUP BY property_id", "price_history listings")
def _(i):
    live = i.listings.where("delisted_date IS NULL").select(F.col("id").alias("property_id"))
    return i.price_history.join(live, "property_id", "left_anti").groupBy("property_id").agg(F.count(F.lit(1)).alias("n"))


@query("join_range_box", """SELECT spaced, place_id FROM (SELECT c.spaced, p.place_id, row_number() OVER (PARTITION BY c.spaced ORDER BY abs(c.latitude - p.latitude) + abs(c.longitude - p.longitude), p.place_id) AS q FROM coords c JOIN places p ON abs(c.latitude - p.latitude) <= 0.0015 AND abs(c.longitude - p.longitude) <= 0.0015) x WHERE q = 1""", "coords places")
def _(i):
    left = i.coords.select("spaced", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    right = i.places.select("place_id", F.col("latitude").alias("r_lat"), F.col("longitude").alias("r_lon"))
    near = within_box(left, right, 0.0015, 0.0015)
    gap = F.abs(F.col("lat") - F.col("r_lat")) + F.abs(F.col("lon") - F.col("r_lon"))
    best = near.groupBy("spaced").agg(F.min_by("place_id", F.struct(gap.alias("g"), "place_id")).alias("place_id"))
    return best.select("spaced", "place_id")


def subject_spots(i):
    return i.coords.select(F.col("spaced").alias("subject"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))


def pair_rates(i):
    p = sale_op.resale_pairs(i.sales).where("last_date > DATE'2018-12-31' AND hold_years >= 0.5")
    rate = (F.pow(F.col("last_price") / F.col("first_price"), 1 / F.col("hold_years")) - 1) * 100
    return p.select(F.col("postcode").alias("place"), rate.alias("v")).where("v > -20 AND v < 30")


_BOX = 0.4 / 69.0
RADIUS_SQL = f"""rate AS (SELECT postcode, v FROM (SELECT postcode, (pow(last_price * 1.0 / first_price, 1 / hold_years) - 1) * 100 AS v FROM rp WHERE last_date > DATE '2018-12-31' AND hold_years >= 0.5) x WHERE v > -20 AND v < 30),
 rc AS (SELECT s.spaced AS subject, r.v, row_number() OVER (PARTITION BY s.spaced ORDER BY r.v) AS k, count(*) OVER (PARTITION BY s.spaced) AS n FROM coords s JOIN coords c ON abs(s.latitude - c.latitude) <= {_BOX} AND abs(s.longitude - c.longitude) <= {_BOX * 1.6} JOIN rate r ON r.postcode = c.spaced)"""


def area_rates(i):
    right = i.coords.select(F.col("spaced").alias("place"), F.col("latitude").alias("r_lat"), F.col("longitude").alias("r_lon"))
    near = within_box(subject_spots(i), right, _BOX, _BOX * 1.6).select("subject", "place")
    return op.neighbourhood_upper_median(pair_rates(i), near, 30)


@query("join_radius_pairs", f"WITH {RESALE}, {RADIUS_SQL} SELECT subject, max(n) AS n, CASE WHEN max(n) >= 30 THEN round(max(v) FILTER (WHERE k = n // 2 + 1), 6) END AS rate FROM rc GROUP BY subject", "sales coords")
def _(i):
    return area_rates(i).select("subject", "n", F.round("mid", 6).alias("rate"))


def pool(i, since="2019-01-01"):
    spot = i.coords.select(F.col("spaced").alias("postcode"), F.col("latitude").alias("r_lat"), F.col("longitude").alias("r_lon"))
    rows = sale_op.since(i.sales, F.lit(since).cast("date")).where(sale_op.not_b(F.col("category")) & (F.col("property_type") != "O"))
    seg = F.when(F.col("property_type") == "F", "flat").otherwise("house")
    return rows.join(spot, "postcode").select("address_key", F.col("postcode").alias("place"), "r_lat", "r_lon", seg.alias("segment"), F.col("bedrooms").alias("beds"), "sale_date", "price",
                                              F.col("floor_area_sqft").alias("area"), "tie1", "tie2", "tie3")


def listing_subjects(i):
    spot = i.coords.select(F.col("spaced").alias("postcode"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    seg = labels.bucket_of_two(F.col("property_type"))
    rows = i.listings.where("floor_area_sqft > 0").join(spot, "postcode").withColumn("segment", seg).where("segment IS NOT NULL")
    return rows.select(F.col("id").alias("subject"), F.col("postcode").alias("place"), "lat", "lon", "segment", F.col("bedrooms").alias("beds"), F.col("floor_area_sqft").alias("area"), "asking_price")


POOL_ONLY = """pool AS (SELECT s.address_key, s.postcode AS place, c.latitude AS r_lat, c.longitude AS r_lon, CASE WHEN property_type = 'F' THEN 'flat' ELSE 'house' END AS segment, bedrooms AS beds, sale_date, price, floor_area_sqft AS area, tie1, tie2, tie3
   FROM sales s JOIN coords c ON c.spaced = s.postcode WHERE sale_date >= DATE '2019-01-01' AND coalesce(category, '') <> 'B' AND property_type <> 'O')"""
POOL_SQL = POOL_ONLY + """,
 subj AS (SELECT id AS subject, l.postcode AS place, c.latitude AS lat, c.longitude AS lon, CASE WHEN property_type IN ('Flat','Maisonette','Studio','Penthouse') THEN 'flat' ELSE 'house' END AS segment, bedrooms AS beds, floor_area_sqft AS area, asking_price
   FROM listings l JOIN coords c ON c.spaced = l.postcode WHERE floor_area_sqft > 0 AND property_type IN ('Flat','Maisonette','Studio','Penthouse','Terraced','Semi-Detached','Detached','Bungalow','House'))"""
# place-to-place distances are computed once, as in the plan under test, so ties agree
KM_SQL = "km AS (SELECT a.spaced AS s_place, b.spaced AS p_place, 2 * 6371 * asin(sqrt(pow(sin(radians(b.latitude - a.latitude) / 2), 2) + cos(radians(a.latitude)) * cos(radians(b.latitude)) * pow(sin(radians(b.longitude - a.longitude) / 2), 2))) AS km FROM coords a CROSS JOIN coords b)"


def knn_sql(k, extra=""):
    return f"""nn AS (SELECT * FROM (SELECT s.subject, s.place AS s_place, s.area AS s_area, p.place AS c_place, p.address_key AS c_address, p.sale_date AS c_date, p.price AS c_price, p.area AS c_area, km.km,
   row_number() OVER (PARTITION BY s.subject ORDER BY km.km, p.place, p.sale_date DESC, p.beds, p.tie1, p.tie2, p.tie3, p.price) AS rank FROM subj s JOIN pool p ON p.segment = s.segment AND abs(p.beds - s.beds) <= 1 {extra} JOIN km ON km.s_place = s.place AND km.p_place = p.place) x WHERE rank <= {k})"""


@query("join_knn", f"WITH {POOL_SQL}, {KM_SQL}, {knn_sql(10)} SELECT subject, rank, c_address, c_price, round(km, 6) AS km FROM nn", "sales listings coords")
def _(i):
    nn = op.knn_sales(listing_subjects(i), pool(i), 10)
    return nn.select("subject", "rank", "c_address", "c_price", F.round("km", 6).alias("km"))


@query("join_knn_asof", f"""WITH {POOL_ONLY}, {KM_SQL}, s AS (SELECT DISTINCT place, segment, beds, sale_date FROM pool WHERE sale_date >= DATE '2022-01-01'),
  n AS (SELECT s.*, p.price AS c_price, p.area AS c_area, row_number() OVER (PARTITION BY s.place, s.segment, s.beds, s.sale_date ORDER BY km.km, p.place, p.sale_date DESC, p.beds, p.tie1 DESC, p.tie2 DESC, p.tie3 DESC, p.price DESC) AS rank FROM s JOIN pool p ON p.segment = s.segment AND abs(p.beds - s.beds) <= 1 AND p.sale_date < s.sale_date AND p.sale_date >= s.sale_date - 1460 JOIN km ON km.s_place = s.place AND km.p_place = p.place AND km.km <= 0.8)
  SELECT place, segment, beds, strftime(sale_date, '%Y-%m-%d') AS sale_date, count(*) AS n, round(median(c_price * 1.0 / c_area), 6) AS ppsf FROM n WHERE rank <= 5 GROUP BY ALL""", "sales coords")
def _(i):
    p = pool(i)
    s = p.where("sale_date >= DATE'2022-01-01'").select("place", F.col("r_lat").alias("lat"), F.col("r_lon").alias("lon"), "segment", "beds", "sale_date").distinct()
    nn = op.knn_before(s, p, 5, 1460, 0.8)
    # at most five rows per subject, so the built-in median holds a bounded group
    g = nn.groupBy("place", "segment", "beds", "sale_date").agg(F.count(F.lit(1)).alias("n"), F.round(F.median(F.col("c_price") / F.col("c_area")), 6).alias("ppsf"))
    return g.withColumn("sale_date", F.date_format("sale_date", "yyyy-MM-dd"))


@query("join_asof_street", """WITH d AS (SELECT DISTINCT street, outcode, sale_date FROM sales WHERE sale_date >= DATE '2021-06-01')
  SELECT d.street, d.outcode, strftime(d.sale_date, '%Y-%m-%d') AS sale_date, count(p.price) AS n, round(median(p.price * 1.0 / p.floor_area_sqft), 6) AS ppsf FROM d LEFT JOIN sales p ON p.street = d.street AND p.outcode = d.outcode AND p.sale_date < d.sale_date AND p.sale_date >= d.sale_date - 730 GROUP BY ALL""", "sales")
def _(i):
    # days of a street are paired, not sales: each asked day with the days before it that have sales,
    # then the median comes from value slabs per day
    day = lambda c: F.concat_ws("|", "street", "outcode", F.col(c).cast("string"))
    values = i.sales.select(day("sale_date").alias("place"), (F.col("price") / F.col("floor_area_sqft")).alias("v"))
    # year-long buckets make the range an equi-join: 730 days touch at most three
    bucket = lambda c: F.floor(F.datediff(c, F.lit("1990-01-01").cast("date")) / 365)
    days = i.sales.select("street", "outcode", F.col("sale_date").alias("p_date")).distinct().withColumn("b", bucket("p_date"))
    asked = sale_op.since(i.sales, sale_op.day("2021-06-01")).select("street", "outcode", "sale_date").distinct()
    a = asked.withColumn("b", F.explode(F.sequence(bucket(F.date_sub("sale_date", 730)), bucket("sale_date"))))
    j = a.join(days, ["street", "outcode", "b"]).where((F.col("p_date") < F.col("sale_date")) & (F.col("p_date") >= F.date_sub("sale_date", 730)))
    near = j.select(day("sale_date").alias("subject"), day("p_date").alias("place"))
    mid = op.neighbourhood_median(values, near)
    out = asked.withColumn("subject", day("sale_date")).join(mid, "subject", "left")
    return out.select("street", "outcode", F.date_format("sale_date", "yyyy-MM-dd").alias("sale_date"), F.coalesce("n", F.lit(0)).alias("n"), F.round("mid", 6).alias("ppsf"))


@query("join_record_linkage", """WITH a AS (SELECT DISTINCT address_key, postcode, saon, paon, street FROM sales),
  s AS (SELECT a.address_key, c.cert_no, a.saon IS NOT DISTINCT FROM b.saon AS same_unit, CASE WHEN a.saon IS NOT NULL AND b.saon IS NOT NULL AND a.saon <> b.saon THEN 0
      ELSE CASE WHEN a.saon IS NOT NULL AND b.saon IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN a.street = b.street THEN 1 ELSE 0 END + CASE WHEN na = nb THEN 1 ELSE 0 END END AS score
    FROM (SELECT *, CASE WHEN saon IS NULL OR address_key % 2 = 0 THEN paon END AS na FROM a) a JOIN certificates c ON c.postcode = a.postcode
    JOIN (SELECT address_key AS k2, saon, street, CASE WHEN saon IS NULL OR address_key % 3 <> 0 THEN paon END AS nb FROM a) b ON b.k2 = c.cert_no)
  SELECT address_key, max(score) AS score FROM s WHERE score >= 2 GROUP BY address_key""", "sales certificates")
def _(i):
    return link_certificates(i).select("address_key", "score")


def link_certificates(i):
    """Addresses to certificates of the same postcode: by unit, else by key, else by the whole postcode.

    The score reads nothing but the two readings, so readings are paired, not addresses: of the certificates that read the same
    the first stands for all. The last block serves only the addresses the first two left unmatched. Both sides are read once,
    written and then joined: join filters on the readings would otherwise be pushed under them and repeat every pattern.
    """
    a = labels.with_address_features(i.sales.select("address_key", "postcode", sale_address().alias("address")).distinct(), "address", "a")
    a = checkpointed(a.select("address_key", "postcode", "a", F.col("a.unit_number").alias("unit"), F.col("a_key").alias("key")))
    c = labels.with_address_features(i.certificates, "cert_address", "b")
    c = c.select("cert_no", "postcode", F.col("b.unit_number").alias("unit"), F.col("b_key").alias("key"), "b", F.col("floor_area_sqft").alias("cert_area"))
    return linked(a, c)


def linked(a, c):
    """The best certificate c(cert_no, postcode, unit, key, b, cert_area) of each address of a(address_key, postcode, a, unit, key)."""
    first = F.min_by(F.struct("cert_no", "cert_area"), "cert_no").alias("m")
    c = checkpointed(c.groupBy("postcode", "unit", "key", "b").agg(first).select("postcode", "unit", "key", "b", "m.*"))
    read = ["postcode", "a"]
    kinds = checkpointed(a.select(*read, "unit", "key").distinct())
    by_unit = kinds.where("unit IS NOT NULL").join(c.drop("key"), ["postcode", "unit"])
    by_key = kinds.where("unit IS NULL").join(c.drop("unit"), ["postcode", "key"])
    cols = [*read, "cert_no", "cert_area", "b"]

    def best(pairs):
        """The best pair of each reading; one that met only poor certificates has a row without one."""
        d = pairs.withColumn("score", labels.match_score(F.col("a"), F.col("b"))).withColumn("good", F.col("score") >= 2)
        return d.groupBy(*read).agg(F.max_by(F.struct("score", "cert_no", "cert_area"), F.when(F.col("good"), F.struct("score", -F.col("cert_no")))).alias("m"))

    near = a.join(best(by_unit.select(*cols).unionByName(by_key.select(*cols))), read).select("address_key", *read, "m")
    near = checkpointed(near)
    left = checkpointed(a.join(near.select("address_key").distinct(), "address_key", "left_anti"))
    rest = left.join(best(left.select(*read).distinct().join(c.drop("unit", "key"), "postcode").select(*cols)), read).select("address_key", "m")
    found = near.select("address_key", "m").unionByName(rest).where("m IS NOT NULL")
    order = F.struct(F.col("m.score"), -F.col("m.cert_no"))
    return found.groupBy("address_key").agg(F.max_by("m", order).alias("m")).select("address_key", "m.*")


@query("join_room_match", """WITH t AS (SELECT *, row_number() OVER (PARTITION BY id, label ORDER BY room_no, area_sqft, long_edge_m) AS q FROM rooms WHERE room_no % 2 = 0), p AS (SELECT *, row_number() OVER (PARTITION BY id, label ORDER BY room_no, area_sqft, long_edge_m) AS q FROM rooms WHERE room_no % 2 = 1),
  m AS (SELECT t.id, t.label, t.q FROM t JOIN p USING (id, label, q)), lt AS (SELECT t.* FROM t WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.id = t.id AND m.label = t.label AND m.q = t.q)), lp AS (SELECT p.* FROM p WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.id = p.id AND m.label = p.label AND m.q = p.q)),
  u AS (SELECT id, room_type FROM lp GROUP BY ALL HAVING count(*) = 1), ut AS (SELECT id, room_type, count(*) AS c FROM lt GROUP BY ALL)
  SELECT id, count(*) AS truth, (SELECT count(*) FROM m WHERE m.id = t.id) AS by_label, (SELECT count(*) FROM u JOIN ut USING (id, room_type) WHERE u.id = t.id) AS by_type FROM t GROUP BY id""", "rooms")
def _(i):
    # labels of one plan: the groups are the rooms of a home
    number = F.row_number().over(W.partitionBy("id", "label").orderBy("room_no", "area_sqft", "long_edge_m"))
    t = i.rooms.where("room_no % 2 = 0").withColumn("q", number)
    p = i.rooms.where("room_no % 2 = 1").withColumn("q", number)
    m = t.join(p.select("id", "label", "q"), ["id", "label", "q"]).select("id", "label", "q")
    lt = t.join(m, ["id", "label", "q"], "left_anti").groupBy("id", "room_type").agg(F.count(F.lit(1)).alias("c"))
    lp = p.join(m, ["id", "label", "q"], "left_anti").groupBy("id", "room_type").agg(F.count(F.lit(1)).alias("c")).where("c = 1")
    second = lt.select("id", "room_type").join(lp.select("id", "room_type"), ["id", "room_type"]).groupBy("id").agg(F.count(F.lit(1)).alias("by_type"))
    truth = t.groupBy("id").agg(F.count(F.lit(1)).alias("truth"))
    out = truth.join(m.groupBy("id").agg(F.count(F.lit(1)).alias("by_label")), "id", "left").join(second, "id", "left")
    return out.select("id", "truth", F.coalesce("by_label", F.lit(0)).alias("by_label"), F.coalesce("by_type", F.lit(0)).alias("by_type"))


@query("join_tag_superset", """WITH a AS (SELECT p_partkey, [p_type, p_brand, CASE WHEN p_size < 25 THEN 'small' ELSE 'big' END] AS tags FROM part), q AS (SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN [['SMALL', 'big'], ['Brand#1']] WHEN 1 THEN [['Brand#' || (n_nationkey + 1)]] ELSE [['LARGE', 'small']] END AS groups FROM nation)
  SELECT n_nationkey, count(*) AS anchors, min(p_partkey) AS first_anchor FROM q JOIN a ON len(list_filter(groups, lambda g: list_has_all(tags, g))) > 0 GROUP BY n_nationkey""")
def _(i):
    tags = F.array("p_type", "p_brand", F.when(F.col("p_size") < 25, "small").otherwise("big"))
    anchors = i.table("part").select(F.col("p_partkey").alias("anchor"), tags.alias("tags"))
    k = F.col("n_nationkey")
    s = lambda *xs: F.array(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    groups = F.when(k % 3 == 0, F.array(s("SMALL", "big"), s("Brand#1"))).when(k % 3 == 1, F.array(s(F.concat(F.lit("Brand#"), (k + 1).cast("string"))))).otherwise(F.array(s("LARGE", "small")))
    met = tag_supersets(i.table("nation").select(k.alias("query"), F.explode(groups).alias("req")), anchors)
    return met.groupBy(F.col("query").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("anchors"), F.min("anchor").alias("first_anchor"))


@query("join_latest_version", "SELECT l.id, r.room_no, r.label FROM listings l JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY room_no DESC, label DESC, area_sqft DESC) AS q FROM rooms) WHERE q = 1) r ON r.id = l.id WHERE l.delisted_date IS NULL", "listings rooms")
def _(i):
    last = newest(i.rooms.select("id", "room_no", "label", "area_sqft"), ["id"], ["room_no", "label", "area_sqft"])
    return i.listings.where("delisted_date IS NULL").select("id").join(last.select("id", "room_no", "label"), "id")


@query("set_union_evidence", """WITH q AS (SELECT DISTINCT upper(replace(raw_postcode, ' ', '')) AS pc FROM listings UNION SELECT upper(regexp_replace(raw, '\\s+', '', 'g')) FROM mixed_postcodes),
  e AS (SELECT replace(spaced, ' ', '') AS pc FROM coords UNION SELECT replace(postcode, ' ', '') FROM sales UNION SELECT upper(replace(raw_postcode, ' ', '')) FROM listings) SELECT pc, CASE WHEN pc IN (SELECT pc FROM e) THEN 1 ELSE 0 END AS known FROM q""", "listings mixed_postcodes coords sales")
def _(i):
    from hearthspan.functions.postcode import compact

    raw = i.mixed_postcodes.select(compact(F.col("raw")).alias("pc"))
    asked = i.listings.select(compact(F.col("raw_postcode")).alias("pc")).unionByName(raw).distinct()
    seen = i.coords.select(compact(F.col("spaced")).alias("pc")).unionByName(i.sales.select(compact(F.col("postcode")).alias("pc"))).unionByName(i.listings.select(compact(F.col("raw_postcode")).alias("pc"))).distinct()
    return asked.join(seen.withColumn("known", F.lit(1)), "pc", "left").select("pc", F.coalesce("known", F.lit(0)).alias("known"))


@query("needle_replay", """WITH c AS (SELECT s_suppkey AS call_id, 'N' || (s_suppkey % 20 + 1) AS outcode, 380000 + s_suppkey * 400 AS price_max, s_suppkey % 4 + 1 AS beds_min, s_suppkey * 20 + s_suppkey % 20 AS target FROM supplier)
  SELECT call_id, count(l.id) AS found, coalesce(max(CASE WHEN l.id = target THEN 1 END), 0) AS hit FROM c LEFT JOIN listings l ON l.outcode = c.outcode AND l.asking_price <= price_max AND l.bedrooms >= beds_min AND l.delisted_date IS NULL AND (l.canonical_id IS NULL OR l.canonical_id = l.id) GROUP BY call_id""", "listings")
def _(i):
    k = F.col("s_suppkey")
    calls = i.table("supplier").select(k.alias("call_id"), F.concat(F.lit("N"), (k % 20 + 1).cast("string")).alias("outcode"), (k * 400 + 380000).alias("price_max"), (k % 4 + 1).alias("beds_min"), (k * 20 + k % 20).alias("target"))
    live = active_canonical(i.listings).select("id", "outcode", "asking_price", "bedrooms")
    # sizes come from running counts, the target from a lookup by id
    size = dominated_counts(calls, live)
    ok = (F.col("asking_price") <= F.col("price_max")) & (F.col("bedrooms") >= F.col("beds_min"))
    hit = calls.join(live.withColumnRenamed("id", "target"), ["target", "outcode"]).where(ok).select("call_id", F.lit(1).alias("hit"))
    return calls.select("call_id").join(size, "call_id", "left").join(hit, "call_id", "left").fillna(0, ["found", "hit"])


# Names that are no more than a generic word.
GENERIC_NAMES = ("THE COURT", "THE HOUSE", "THE MANOR", "THE TOWER", "THE BUILDING", "THE MANSIONS", "THE WHARF", "THE LODGE")
_AZ = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def named_subjects(rows, name, word):
    """Rows whose name has two words at least, is not generic and holds the asked word where a word begins; only a-z are raised."""
    n, w = F.col(name), word.upper()
    return rows.where(F.contains(n, F.lit(" ")) & ~n.isin(*GENERIC_NAMES) & (F.contains(n, F.lit(f" {w}")) | n.startswith(f"{w} ")))


@query("filter_degenerate_name", f"""SELECT doc_id, name FROM (SELECT doc_id, translate(trim(split_part(text, ' of ', 1)), '{_AZ[0]}', '{_AZ[1]}') AS name FROM documents WHERE strpos(text, ' of ') > 0) t
  WHERE strpos(name, ' ') > 0 AND name NOT IN {GENERIC_NAMES} AND (strpos(name, ' THE') > 0 OR starts_with(name, 'THE '))""")
def _(i):
    # the first segment stands for the name
    name = F.translate(F.trim(F.split("text", " of ", 2)[0]), *_AZ)
    return named_subjects(i.table("documents").where(F.instr("text", " of ") > 0).select("doc_id", name.alias("name")), "name", "the")
