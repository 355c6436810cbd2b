"""Scan and sink queries, and profiles of small areas."""

import datetime

from pyspark.sql import functions as F

from hearthspan.operators.market import DIMENSIONS
from hearthspan.plans.base import query
from hearthspan.session import scratch
from hearthspan.sources import readers, sinks


@query("scan_csv_registry", """SELECT s_suppkey AS urn, 'Écolé ' || s_suppkey AS name, CASE WHEN s_suppkey % 3 <> 0 THEN (s_suppkey % 4 + 1)::INT END AS rating FROM supplier WHERE s_suppkey % 4 <> 0 AND s_suppkey % 11 <> 0""")
def _(i):
    k = F.col("s_suppkey")
    path = scratch(i.spark, "registry")
    s = i.table("supplier")
    urn = F.when(k % 11 == 0, F.concat(F.lit("x"), k.cast("string"))).otherwise(k.cast("string"))  # every eleventh row is malformed
    rows = s.select(urn.alias("urn"), F.concat(F.lit("Écolé "), k.cast("string")).alias("name"), F.when(k % 4 == 0, "Closed").otherwise("Open").alias("status"), F.lit(51.5).alias("lat"), F.lit(-0.1).alias("lon"), F.lit("primary").alias("phase"))
    rows.write.options(header=True, encoding="iso-8859-1").csv(f"{path}/places")
    s.where("s_suppkey % 3 <> 0").select(k.alias("urn"), (k % 4 + 1).alias("rating")).write.options(header=True, encoding="iso-8859-1").csv(f"{path}/ratings")
    return readers.csv_registry(i.spark, f"{path}/places", f"{path}/ratings").select("urn", "name", "rating")


@query("scan_deprivation_csv", "SELECT 'E' || c_custkey AS area, CASE WHEN c_custkey % 13 BETWEEN 1 AND 10 THEN (c_custkey % 13)::INT END AS overall, CASE WHEN c_custkey % 7 <> 0 THEN (c_custkey % 10 + 1)::INT END AS income, (c_custkey % 5 + 1)::INT AS crime FROM customer")
def _(i):
    k = F.col("c_custkey")
    path = scratch(i.spark, "deprivation")
    rows = i.table("customer").select(F.concat(F.lit("E"), k.cast("string")).alias("area"), (k % 13).alias("overall"), F.when(k % 7 == 0, "n/a").otherwise((k % 10 + 1).cast("string")).alias("income"), (k % 5 + 1).alias("crime"))
    rows.write.options(header=True).csv(path)
    return readers.deprivation_csv(i.spark, path)


@query("scan_json_documents", """SELECT postcode, data_version, CASE WHEN tie1 % 23 = 0 THEN NULL ELSE tie1 % 100 END AS score, CASE WHEN tie1 % 23 = 0 THEN 1 ELSE 0 END AS no_data FROM (
   SELECT *, doc_no AS tie1, row_number() OVER (PARTITION BY postcode, data_version ORDER BY created_on DESC, doc_no DESC, tie2 DESC, tie3 DESC, price DESC) AS q FROM score_docs WHERE doc_no % 29 <> 0) x WHERE q = 1""", "score_docs")
def _(i):
    d = readers.json_documents(i.score_docs, ["postcode", "data_version"], ["created_on", "doc_no", "tie2", "tie3", "price"], "data_json", "score bigint, count bigint")
    return d.select("postcode", "data_version", F.col("doc.score").alias("score"), F.col("no_data").cast("int").alias("no_data"))


@query("scan_jsonl_kinds", "SELECT 'critic' AS kind, 2 * count(*) AS lines, count(*) AS repeated FROM critic UNION ALL SELECT 'answers', count(*), 0 FROM answers UNION ALL SELECT 'unknown', count(*), 0 FROM chats", "critic answers chats")
def _(i):
    path = scratch(i.spark, "jsonl")
    whole = {"ignoreNullFields": "false"}
    lines = {
        "a": i.critic.select(F.to_json(F.struct("case_id", "verdict", "issues"), whole).alias("value"), F.col("case_id").alias("o")),
        "b": i.critic.select(F.to_json(F.struct("case_id", "verdict", "issues"), whole).alias("value"), F.col("case_id").alias("o")),
        "c": i.answers.select(F.to_json(F.struct("case_id", "response"), whole).alias("value"), F.col("case_id").alias("o")),
        "d": i.chats.select(F.to_json(F.struct("msg_id", "session_id"), whole).alias("value"), F.col("msg_id").alias("o")),
    }
    for name, df in lines.items():
        df.repartition(8, "o").sortWithinPartitions("o", "value").select("value").write.text(f"{path}/kind={name}")
    files = readers.jsonl_kinds(i.spark, f"{path}/*")
    return files.groupBy("kind").agg(F.sum("lines").alias("lines"), F.sum(F.when(F.col("repeats").isNotNull(), F.col("lines")).otherwise(0)).alias("repeated"))


_O = "created_on DESC, doc_no DESC, tie2 DESC, tie3 DESC, price DESC"
_COLS = ["postcode", "data_version", "created_on", "doc_no", "tie2", "tie3", "price"]


def halves(i):
    d = i.score_docs.select(*_COLS)
    return d.where("tie2 < 5"), d.where("tie2 >= 5")


@query("sink_upsert", f"SELECT postcode, data_version, doc_no, price FROM (SELECT *, row_number() OVER (PARTITION BY postcode, data_version ORDER BY {_O}) AS q FROM score_docs) WHERE q = 1", "score_docs")
def _(i):
    old, new = halves(i)
    return sinks.upsert(old, new, ["postcode", "data_version"], _COLS[2:]).select("postcode", "data_version", "doc_no", "price")


@query("sink_upsert_coalesce", "SELECT id, coalesce(CASE WHEN id % 3 = 0 AND id % 2 = 0 THEN NULL WHEN id % 2 = 0 THEN asking_price + 1 END, CASE WHEN id % 5 <> 0 THEN asking_price END) AS asking_price, coalesce(CASE WHEN id % 2 = 0 THEN tenure END, CASE WHEN id % 5 <> 0 THEN tenure END) AS tenure FROM listings WHERE id % 5 <> 0 OR id % 2 = 0", "listings")
def _(i):
    old = i.listings.where("id % 5 <> 0").select("id", "asking_price", "tenure")
    new = i.listings.where("id % 2 = 0").select("id", F.when(F.col("id") % 3 != 0, F.col("asking_price") + 1).alias("asking_price"), "tenure")
    return sinks.upsert_coalesce(old, new, ["id"])


@query("sink_insert_ignore", "SELECT id, CASE WHEN id % 3 <> 0 THEN 'old' ELSE 'new' END AS side FROM listings", "listings")
def _(i):
    old = i.listings.where("id % 3 <> 0").select("id", F.lit("old").alias("side"))
    new = i.listings.select("id", F.lit("new").alias("side"))
    return sinks.insert_ignore(old, new, ["id"], ["side"])


@query("sink_replace_group", "SELECT outcode, count(*) AS n, sum(CASE WHEN outcode IN ('N3', 'N7') THEN 1 ELSE 0 END)::BIGINT AS rewritten FROM listings WHERE outcode NOT IN ('N3', 'N7') OR bedrooms >= 3 GROUP BY outcode", "listings")
def _(i):
    path = scratch(i.spark, "groups")
    first = i.listings.select("id", "bedrooms", F.lit(0).alias("rewritten"), "outcode")
    sinks.replace_group(first, path, "outcode")
    sinks.replace_group(first.where(F.col("outcode").isin("N3", "N7") & (F.col("bedrooms") >= 3)).withColumn("rewritten", F.lit(1)), path, "outcode")
    return i.spark.read.parquet(path).groupBy("outcode").agg(F.count(F.lit(1)).alias("n"), F.sum("rewritten").alias("rewritten"))


@query("sink_dimension_split", "SELECT postcode, transport, community, environment, price::DOUBLE AS price, schools, (transport IS NULL)::INT + (community IS NULL)::INT + (environment IS NULL)::INT + (price IS NULL)::INT + (schools IS NULL)::INT AS missing FROM scores", "scores")
def _(i):
    long = sinks.split_dimensions(i.scores, "postcode", list(DIMENSIONS))
    lost = long.groupBy("postcode").agg(F.count_if(F.col("status") == "no_data").cast("int").alias("missing"))
    return sinks.join_dimensions(long, "postcode", list(DIMENSIONS)).join(lost, "postcode")


@query("sink_dimension_ndjson", "SELECT 'dimension' AS event, count(*) * 5 AS n FROM scores UNION ALL SELECT 'summary', count(*) FROM scores", "scores")
def _(i):
    path = scratch(i.spark, "ndjson")
    sinks.dimension_lines(sinks.split_dimensions(i.scores, "postcode", list(DIMENSIONS)), "postcode").write.text(path)
    return i.spark.read.schema("event string").json(path).groupBy("event").agg(F.count(F.lit(1)).alias("n"))


_DOCS = "docs AS (SELECT postcode, 'd' || (doc_no % 3) AS dimension, data_version, created_on, expires_on FROM score_docs)"


@query("cache_assemble", f"""WITH {_DOCS}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY postcode, dimension ORDER BY created_on DESC, expires_on DESC) AS q FROM docs WHERE data_version = 'v2' AND expires_on > DATE '2021-12-01') WHERE q = 1)
  SELECT postcode, CASE WHEN count(*) = 3 THEN 1 ELSE 0 END AS hit, CASE WHEN count(*) < 3 THEN 1 ELSE 0 END AS partial, CASE WHEN count(*) = 3 THEN strftime(min(created_on), '%Y-%m-%d') END AS oldest, CASE WHEN count(*) = 3 THEN strftime(min(expires_on), '%Y-%m-%d') END AS earliest_expiry FROM l GROUP BY postcode""", "score_docs")
def _(i):
    docs = i.score_docs.select("postcode", F.concat(F.lit("d"), (F.col("doc_no") % 3).cast("string")).alias("dimension"), "data_version", "created_on", "expires_on")
    a = sinks.assemble(docs, "postcode", ["d0", "d1", "d2"], "v2", F.lit("2021-12-01").cast("date"))
    return a.select("postcode", "hit", "partial", *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("oldest", "earliest_expiry")])


_SIZES = ("bed1", "bed2", "bed3", "bed4plus")
_RENT = "r AS (SELECT o_custkey % 60 AS area, CASE o_orderpriority WHEN '1-URGENT' THEN 'all' WHEN '2-HIGH' THEN 'bed1' WHEN '3-MEDIUM' THEN 'bed2' WHEN '5-LOW' THEN 'bed4plus' ELSE 'bed3' END AS size_key, date_trunc('month', o_orderdate) AS month, o_totalprice FROM orders)"


@query("agg_rent_benchmark", f"""WITH {_RENT}, m AS (SELECT max(month) AS month FROM r), l AS (SELECT area, size_key, max(o_totalprice) FILTER (WHERE month = (SELECT month FROM m)) AS rent, max(o_totalprice) FILTER (WHERE month = (SELECT month FROM m) - INTERVAL 1 YEAR) AS past FROM r GROUP BY ALL),
   k AS (SELECT size_key, max(rent) AS market FROM l GROUP BY size_key), a AS (SELECT DISTINCT area FROM l WHERE rent IS NOT NULL), b AS (SELECT unnest({list(_SIZES)}) AS size_key),
   j AS (SELECT a.area, b.size_key, x.rent AS own, x.past AS own_past, y.rent AS every, y.past AS every_past, market FROM a CROSS JOIN b LEFT JOIN l x ON x.area = a.area AND x.size_key = b.size_key LEFT JOIN l y ON y.area = a.area AND y.size_key = 'all' LEFT JOIN k ON k.size_key = b.size_key)
  SELECT area, size_key, strftime((SELECT month FROM m), '%Y-%m') AS month, coalesce(own, every) AS rent, CASE WHEN own IS NOT NULL THEN 'size' WHEN every IS NOT NULL THEN 'all' END AS basis,
   round(CASE WHEN own IS NOT NULL THEN (own - own_past) * 100 / own_past ELSE (every - every_past) * 100 / every_past END, 4) AS yoy_pct, market FROM j""")
def _(i):
    orders = i.table("orders")
    latest = orders.agg(F.max("o_orderdate")).first()[0]  # one value, so that both months are pushed to the scan
    if latest is None:
        latest = datetime.date(1970, 1, 1)
    latest = latest.date() if isinstance(latest, datetime.datetime) else latest
    month, past = latest.replace(day=1), latest.replace(day=1, year=latest.year - 1)
    after = lambda d: (d + datetime.timedelta(days=31)).replace(day=1)
    inside = lambda d: (F.col("o_orderdate") >= F.lit(d)) & (F.col("o_orderdate") < F.lit(after(d)))
    p = F.col("o_orderpriority")
    size = F.when(p == "1-URGENT", "all").when(p == "2-HIGH", "bed1").when(p == "3-MEDIUM", "bed2").when(p == "5-LOW", "bed4plus").otherwise("bed3")
    rows = orders.where(inside(month) | inside(past)).select((F.col("o_custkey") % 60).alias("area"), size.alias("size_key"), inside(month).alias("now"), "o_totalprice")
    known = rows.groupBy("area", "size_key").agg(F.max(F.when(F.col("now"), F.col("o_totalprice"))).alias("rent"), F.max(F.when(~F.col("now"), F.col("o_totalprice"))).alias("past"))
    # one row per area with its bands side by side, then back to the asked sizes
    band = lambda s: F.max(F.when(F.col("size_key") == s, F.struct("rent", "past"))).alias(s)
    wide = known.groupBy("area").agg(F.max("rent").alias("any"), *[band(s) for s in ("all", *_SIZES)]).where("any IS NOT NULL")
    asked = wide.select("area", "all", F.inline(F.array(*[F.struct(F.lit(s).alias("size_key"), F.col(s).alias("own")) for s in _SIZES])))
    market = known.groupBy("size_key").agg(F.max("rent").alias("market"))
    basis = F.when(F.col("own.rent").isNotNull(), "size").when(F.col("all.rent").isNotNull(), "all")
    used = F.when(F.col("own.rent").isNotNull(), F.col("own")).otherwise(F.col("all"))
    rows = asked.join(market, "size_key", "left").withColumn("basis", basis).withColumn("used", used)
    return rows.select("area", "size_key", F.lit(f"{month:%Y-%m}").alias("month"), F.col("used.rent").alias("rent"), "basis", F.round((F.col("used.rent") - F.col("used.past")) * 100 / F.col("used.past"), 4).alias("yoy_pct"), "market")


_CATS = ("anti-social-behaviour", "burglary", "drugs", "robbery", "violent-crime", "shoplifting", "other-theft")

# Categories counted one by one; all others count as other.
CRIME_TARGETS = ("anti-social-behaviour", "burglary", "violent-crime", "robbery", "theft-from-the-person", "drugs", "possession-of-weapons")


@query("agg_crime_profile", f"""WITH c(k, cat) AS (VALUES {', '.join(f"({n}, '{c}')" for n, c in enumerate(_CATS))}), x AS (SELECT c_custkey AS area, cat, (c_custkey * (k + 3)) % 97 AS n FROM customer CROSS JOIN c), r AS (SELECT *, row_number() OVER (PARTITION BY area ORDER BY n DESC, cat) AS q FROM x),
  a AS (SELECT c_custkey AS area, c_custkey % 997 AS t, c_custkey % 500 AS p, c_custkey % 13 * 100 AS pop FROM customer), b AS (SELECT *, t * 1000.0 / nullif(pop, 0) AS rate FROM a)
  SELECT b.area, CASE WHEN p > 0 THEN round((t - p) * 100.0 / p, 4) END AS trend_pct, round(rate, 4) AS per_1000, CASE WHEN rate IS NOT NULL THEN round((SELECT count(*) FROM b z WHERE z.rate < b.rate) * 100.0 / ((SELECT count(rate) FROM b) - 1), 4) END AS pctile,
   (SELECT string_agg(cat || ':' || n, ';' ORDER BY q) FROM r WHERE r.area = b.area AND q <= 5) AS top, o.burglary, o.other, o.total FROM b
   JOIN (SELECT area, sum(n) FILTER (WHERE cat = 'burglary')::BIGINT AS burglary, sum(n) FILTER (WHERE cat NOT IN {CRIME_TARGETS})::BIGINT AS other, sum(n)::BIGINT AS total FROM x GROUP BY area) o ON o.area = b.area""")
def _(i):
    from hearthspan.functions.rank import tally_before

    k = F.col("c_custkey")
    doc = F.to_json(F.create_map(*[x for n, c in enumerate(_CATS) for x in (F.lit(c), k * (n + 3) % 97)]))
    a = i.table("customer").select(k.alias("area"), (k % 997).alias("t"), (k % 500).alias("p"), F.try_divide(k % 997 * 1000, k % 13 * 100).alias("rate"), doc.alias("doc"))
    # seven categories a row: sorting them stays inside the row
    entries = F.map_entries(F.from_json("doc", "map<string,bigint>"))
    top = F.slice(F.array_sort(F.transform(entries, lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("c")))), 1, 5)
    top = F.array_join(F.transform(top, lambda e: F.concat(e["c"], F.lit(":"), (-e["n"]).cast("string"))), ";")
    known = F.from_json("doc", "map<string,bigint>")
    summed = lambda keep: F.aggregate(F.filter(entries, keep), F.lit(0).cast("bigint"), lambda n, e: n + e["value"])
    counts = {c: F.coalesce(F.try_element_at(known, F.lit(c)), F.lit(0).cast("bigint")) for c in CRIME_TARGETS}
    counts |= {"other": summed(lambda e: ~e["key"].isin(*CRIME_TARGETS)), "total": summed(lambda e: F.lit(True))}
    place = tally_before(a, [], "rate").select("rate", (F.col("below") * 100.0 / (F.col("total") - 1)).alias("pctile"))
    j = a.join(place, "rate", "left")
    trend = F.when(F.col("p") > 0, F.round((F.col("t") - F.col("p")) * 100.0 / F.when(F.col("p") > 0, F.col("p")), 4))
    return j.select("area", trend.alias("trend_pct"), F.round("rate", 4).alias("per_1000"), F.round("pctile", 4).alias("pctile"), top.alias("top"), *[counts[c].alias(c) for c in ("burglary", "other", "total")])


# Shares of a census profile, the columns they add up and the total they are taken of.
CENSUS_SHARES = {
    "owned": (("own_outright", "own_mortgage"), "hh_total"), "private_rented": (("private_rented",), "hh_total"), "social_rented": (("social_rented",), "hh_total"),
    "shared_ownership": (("shared_ownership",), "hh_total"),
    "age_0_14": (("age_0_14",), "age_total"), "age_15_24": (("age_15_24",), "age_total"), "age_25_34": (("age_25_34",), "age_total"), "age_35_49": (("age_35_49",), "age_total"),
    "age_50_64": (("age_50_64",), "age_total"), "age_65plus": (("age_65plus",), "age_total"),
    "one_person": (("hc_one_person",), "hc_total"), "couple_no_children": (("hc_couple_no_children",), "hc_total"), "dependent_children": (("hc_dep_children",), "hc_total"),
    "higher_professional": (("nssec_higher_prof",), "nssec_total"), "lower_professional": (("nssec_lower_prof",), "nssec_total"), "intermediate": (("nssec_intermediate",), "nssec_total"),
    "routine": (("nssec_routine",), "nssec_total"), "students": (("nssec_students",), "nssec_total"),
}
_COUNTS = [c for parts, _ in CENSUS_SHARES.values() for c in parts]
_TOTALS = list(dict.fromkeys(whole for _, whole in CENSUS_SHARES.values()))


def census_shares(digits=1):
    """Percentages; a missing part or an empty total gives NULL, never a zero."""
    share = lambda parts, whole: F.try_divide(sum((F.col(c) for c in parts[1:]), F.col(parts[0])) * 100.0, F.nullif(F.col(whole), F.lit(0)))
    return [F.round(share(parts, whole), digits).alias(f"{name}_pct") for name, (parts, whole) in CENSUS_SHARES.items()]


_CENSUS = "c AS (SELECT c_custkey, " + ", ".join([f"CASE WHEN c_custkey % {9 + n} = 0 THEN NULL ELSE (c_custkey * {n + 2}) % 400 END AS {c}" for n, c in enumerate(_COUNTS)] + [f"c_custkey % {8 - n} * 100 AS {t}" for n, t in enumerate(_TOTALS)]) + " FROM customer)"


@query("agg_census_shares", f"WITH {_CENSUS} SELECT c_custkey, " + ", ".join(f"round(({' + '.join(parts)}) * 100.0 / nullif({whole}, 0), 4) AS {name}_pct" for name, (parts, whole) in CENSUS_SHARES.items()) + " FROM c")
def _(i):
    k = F.col("c_custkey")
    counts = [F.when(k % (9 + n) != 0, k * (n + 2) % 400).alias(c) for n, c in enumerate(_COUNTS)]
    profile = i.table("customer").select("c_custkey", *counts, *[(k % (8 - n) * 100).alias(t) for n, t in enumerate(_TOTALS)])
    return profile.select("c_custkey", *census_shares(4))
