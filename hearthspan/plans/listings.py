"""Listing-condition queries: one per condition type, plus the blind-spot report."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthspan.operators import listings as op
from hearthspan.plans.base import query

AS_OF = "2024-09-01"


def lookups(i):
    green = i.scores.select("postcode", F.col("environment").alias("green_score"))
    return {
        "plans": i.plans, "text_facts": i.text_facts, "rooms": i.rooms, "facings": i.facings, "scores": i.scores, "green": green, "commute": i.commute,
        "decor": i.listings.select("id", "decor_score"), "stations": i.nearest_stations, "dp_quality": i.dp_quality, "listings": i.listings, "price_history": i.price_history,
    }


def case(key: str, specs: list[tuple[list[dict], str]], uses: str = ""):
    """Several specs of one condition; `which` tells them apart."""
    sql = " UNION ALL ".join(f"SELECT {n} AS which, o.id FROM listings o WHERE {where}" for n, (_, where) in enumerate(specs))

    def plan(i):
        found = [op.listing_match(i.listings, conds, lookups(i), AS_OF).select(F.lit(n).alias("which"), "id") for n, (conds, _) in enumerate(specs)]
        return reduce(DataFrame.unionByName, found)

    query(key, sql, f"listings {uses}")(plan)


def one(kind, **kw):
    return [{"type": kind, **kw}]


FP = "EXISTS (SELECT 1 FROM plans f WHERE f.id = o.id AND f.ok = 1 AND f.{} = 1)"
TF = "EXISTS (SELECT 1 FROM text_facts t WHERE t.id = o.id AND t.ok = 1 AND {})"
KF, DE, GA, PA = ("lower(coalesce(o.key_features, ''))", "lower(coalesce(o.description, ''))", "lower(coalesce(o.garden, ''))", "lower(coalesce(o.parking, ''))")

case("cond_area", [
    (one("area", value=["N1", "n12"]), "o.outcode IN ('N1', 'N12')"), (one("area", value="N"), "o.outcode LIKE 'N%'"), (one("area", value=["NW", "N3"]), "o.outcode = 'N3'"),
])
case("cond_range", [
    (one("price", min=400000, max=430000), "asking_price BETWEEN 400000 AND 430000"), (one("bedrooms", min=3), "bedrooms >= 3"),
    (one("bathrooms", max=1), "bathrooms <= 1"), (one("sqft", min=900, max=1200), "floor_area_sqft BETWEEN 900 AND 1200"),
    ([{"type": "price", "max": 450000}, {"type": "bedrooms", "min": 4}], "asking_price <= 450000 AND bedrooms >= 4"),
])
case("cond_property_type", [
    (one("property_type", value="house"), "o.property_type IN ('Terraced','Semi-Detached','Detached','Bungalow','House') AND reads_as_flat = 0"),
    (one("property_type", value="flats"), "o.property_type IN ('Flat','Maisonette','Studio','Penthouse')"),
    (one("property_type", value="maisonette"), "o.property_type = 'Maisonette'"), (one("property_type", value="detach"), "o.property_type IN ('Semi-Detached','Detached')"),
    (one("property_type", value=None), "false"), (one("property_type", value="a nice house"), "o.property_type IN ('Terraced','Semi-Detached','Detached','Bungalow','House') AND reads_as_flat = 0"),
])
case("cond_tenure", [(one("tenure", value=["freehold", "Share of Freehold"]), "o.tenure IN ('Freehold', 'SHARE OF FREEHOLD')")])
case("cond_ppsf", [(one("ppsf", min=350, max=500), "floor_area_sqft > 0 AND asking_price * 1.0 / floor_area_sqft BETWEEN 350 AND 500"), (one("ppsf", max=2600), "floor_area_sqft > 0 AND asking_price * 1.0 / floor_area_sqft BETWEEN 300 AND 2500")])
case("cond_postcode_score", [
    (one("postcode_score", dimension="schools", value=70), "EXISTS (SELECT 1 FROM scores s WHERE s.postcode = o.postcode AND s.schools >= 70)"),
    (one("postcode_score", dimension="total", op="lte", value=40), "EXISTS (SELECT 1 FROM scores s WHERE s.postcode = o.postcode AND s.total_score <= 40)"),
], "scores")
case("cond_green_space", [(one("green_space", min=60), "EXISTS (SELECT 1 FROM scores s WHERE s.postcode = o.postcode AND s.environment >= 60)")], "scores")
case("cond_mortgageable", [(one("mortgageable", value=True), "mortgage_flags IS NULL OR mortgage_flags = '[]'"), (one("mortgageable", value=False), "mortgage_flags <> '[]'")])
case("cond_prior_sale", [
    (one("prior_sale", below=True), "prev_sold_price IS NOT NULL AND match_strategy = 'detail_anchored' AND asking_price < prev_sold_price"),
    (one("prior_sale", within_years=5), f"prev_sold_price IS NOT NULL AND match_strategy = 'detail_anchored' AND prev_sold_date >= DATE '{AS_OF}' - INTERVAL 5 YEAR"),
])
case("cond_commute", [
    (one("commute", hub="Bank", max_minutes=40), "EXISTS (SELECT 1 FROM commute c WHERE c.sector = o.sector AND c.hub = 'Bank' AND c.minutes <= 40)"),
    (one("commute", hub="waterloo", max_minutes=20, to_station="drive"), "EXISTS (SELECT 1 FROM commute c WHERE c.sector = o.sector AND c.hub = 'Waterloo' AND c.minutes <= 45)"),
    ([{"type": "commute", "hub": "Bank", "max_minutes": 60}, {"type": "commute", "hub": "Victoria", "max_minutes": 60}],
     "EXISTS (SELECT 1 FROM commute c WHERE c.sector = o.sector AND c.hub = 'Bank' AND c.minutes <= 60) AND EXISTS (SELECT 1 FROM commute c WHERE c.sector = o.sector AND c.hub = 'Victoria' AND c.minutes <= 60)"),
], "commute")
_PCT = "(SELECT decor_score FROM listings WHERE decor_score IS NOT NULL ORDER BY decor_score LIMIT 1 OFFSET (SELECT floor(count(*) * {p})::BIGINT FROM listings WHERE decor_score IS NOT NULL))"
case("cond_decor_tier", [
    (one("decor_tier", min=7.5), f"decor_score >= {_PCT.format(p=0.7)}"), (one("decor_tier", value=["low", "high"]), f"decor_score >= {_PCT.format(p=0.8)} OR decor_score < {_PCT.format(p=0.2)}"),
    (one("decor_tier", value="mid"), f"decor_score >= {_PCT.format(p=0.2)} AND decor_score < {_PCT.format(p=0.8)}"),
])
_GARDEN = f"(coalesce(o.garden, '') = 'Yes' OR {GA} LIKE '%garden%' OR (coalesce(o.garden, '') = '' AND {FP.format('has_garden')}))"
case("cond_garden", [(one("garden", value=True), _GARDEN), (one("garden", value=False), f"NOT {_GARDEN}")], "plans")
_FACE = "(SELECT property_id FROM facings WHERE emitted = 1 AND facing_set IS NOT NULL AND outdoor_type = 'garden' GROUP BY property_id HAVING count(DISTINCT facing_set) = 1 AND min(facing_set) LIKE '{}')"
case("cond_garden_facing", [
    (one("garden_facing", value="south"), f"coalesce(o.garden_facing IN ('south', 'south-west', 'south-east'), false) OR o.id IN {_FACE.format('%|south%')}"),
    (one("garden_facing", value=["east", "north-west"]), f"coalesce(o.garden_facing IN ('east', 'north-east', 'south-east', 'north-west'), false) OR o.id IN {_FACE.format('%east|%')} OR o.id IN {_FACE.format('%|north-west|%')}"),
], "facings")
case("cond_garden_sqft", [(one("garden_sqft", min=250), "(SELECT max(area_sqft) FROM rooms r WHERE r.id = o.id AND r.label IN ('Rear Garden', 'Garden Terrace')) >= 250")], "rooms")
_BALC = f"({KF} LIKE '%balcon%' OR {GA} LIKE '%balcon%' OR {FP.format('has_balcony')} OR ({DE} LIKE '%balcon%' AND {DE} NOT LIKE '%no balcony%' AND {DE} NOT LIKE '%without balcony%' AND {DE} NOT LIKE '%without a balcony%'))"
case("cond_balcony", [(one("balcony", value=True), _BALC), (one("balcony", value=False), f"NOT {_BALC}")], "plans")
_RAISED = "EXISTS (SELECT 1 FROM rooms r WHERE r.id = o.id AND r.label IN ('Balcony', 'Front Balcony', 'Ground Floor Balcony', 'Roof Terrace', 'Terrace') AND ({}))"
case("cond_room_area", [
    (one("room_area", room="bedroom", min_sqm=25), "EXISTS (SELECT 1 FROM rooms r WHERE r.id = o.id AND r.room_type = 'bedroom' AND r.area_sqft >= 25 * 10.764 * 0.9)"),
    (one("room_area", room="reception", min_sqm=6, agg="min"), "EXISTS (SELECT 1 FROM rooms r WHERE r.id = o.id AND r.room_type IN ('reception', 'living') AND r.area_sqft >= 6 * 10.764 * 0.9) AND NOT EXISTS (SELECT 1 FROM rooms r WHERE r.id = o.id AND r.room_type IN ('reception', 'living') AND r.area_sqft < 6 * 10.764 * 0.9)"),
    (one("room_area", room="balcony", min_sqm=28, min_long_edge_m=9), _RAISED.format("r.area_sqft >= 28 * 10.764 * 0.9 OR r.long_edge_m >= 9")),
    (one("room_area", room="kitchen", min_long_edge_m=9), "EXISTS (SELECT 1 FROM rooms r WHERE r.id = o.id AND r.room_type = 'kitchen' AND r.long_edge_m >= 9)"),
], "rooms")
case("cond_chain_free", [(one("chain_free", value=True), TF.format("t.chain_free = 1")), (one("chain_free", value=False), "NOT " + TF.format("t.chain_free = 1"))], "text_facts")
case("cond_ex_council", [(one("ex_council", value=True), "o.ex_council = 'likely'"), (one("ex_council", value=False), "o.ex_council IS NULL OR o.ex_council <> 'likely'")])
_TOLD = f"(({KF} LIKE '%parking%' OR {KF} LIKE '%driveway%' OR {KF} LIKE '%carport%' OR {KF} LIKE '%car port%') AND {KF} NOT LIKE '%no parking%' AND {KF} NOT LIKE '%no allocated parking%')"
_PARK = f"((coalesce(o.parking, '') <> '' AND {PA} NOT LIKE '%no parking%') OR (coalesce(o.parking, '') = '' AND ({_TOLD} OR {FP.format('has_garage')})))"
case("cond_parking", [(one("parking", value=True), _PARK), (one("parking", value=False), f"NOT {_PARK}")], "plans")
_J = "(t.facts_json::JSON->'{}'->>'value')"
case("cond_lease_years", [(one("lease_years", min=90), "coalesce(o.lease_years >= 90, false) OR lower(coalesce(o.tenure, '')) LIKE '%freehold%' OR " + TF.format(_J.format("share_of_freehold") + " = '1'"))], "text_facts")
_READ = "(SELECT {j}::DOUBLE FROM text_facts t WHERE t.id = o.id AND t.ok = 1)"
case("cond_service_charge", [(one("service_charge", max=1500), f"coalesce(nullif(o.service_charge, 0), nullif({_READ.format(j=_J.format('service_charge_pa'))}, 0)) <= 1500")], "text_facts")
case("cond_ground_rent", [(one("ground_rent", max=100), f"coalesce(o.ground_rent, {_READ.format(j=_J.format('ground_rent_pa'))}) <= 100")], "text_facts")
_LIFT = f"""(({TF.format(_J.format('lift') + " = '1'")} OR {KF} LIKE '%"lift%' OR {KF} LIKE '% lift%' OR {KF} LIKE '%elevator%' OR ({DE} LIKE '% lift%' AND {DE} NOT LIKE '%no lift%' AND {DE} NOT LIKE '%without a lift%')) AND NOT {TF.format(_J.format('lift') + " = '0'")})"""
case("cond_lift", [(one("lift", value=True), _LIFT), (one("lift", value=False), f"NOT {_LIFT}")], "text_facts")
_CLAD = TF.format("(t.cladding_issue = 1 OR " + _J.format("ews1_status") + " = 'issue_mentioned')")
case("cond_cladding", [(one("cladding", value=True), _CLAD), (one("cladding", value=False), f"NOT {_CLAD}")], "text_facts")
case("cond_station_walk", [(one("station_walk", max_minutes=6), "EXISTS (SELECT 1 FROM nearest_stations n WHERE n.property_id = o.id AND n.distance_miles <= 0.3)")], "nearest_stations")
case("cond_epc", [(one("epc", min=70), "epc_efficiency >= 70")])
case("cond_council_tax", [(one("council_tax", max="d"), "council_tax_band IN ('A', 'B', 'C', 'D')")])
case("cond_flags", [(one("auction", value=True), "is_auction = 1"), (one("auction", value=False), "is_auction = 0"), (one("shared_ownership", value=True), "shared_ownership = 1")])
case("cond_days_on_market", [(one("days_on_market", min=300), f"coalesce(first_visible_date, date_listed) <= DATE '{AS_OF}' - 300")])
case("cond_relisted", [(one("relisted", value=True), """EXISTS (SELECT 1 FROM listings d JOIN dp_quality q ON q.delivery_point = o.delivery_point WHERE d.delivery_point = o.delivery_point AND d.id <> o.id AND d.delisted_date IS NOT NULL AND q.is_unit_level = 1
   AND d.delisted_date < coalesce(o.first_visible_date, o.date_listed) AND (o.asking_price IS NULL OR d.asking_price IS NULL OR d.asking_price BETWEEN o.asking_price * 0.7 AND o.asking_price * 1.3))""")], "dp_quality")
_DROP = "EXISTS (SELECT 1 FROM price_history p1 JOIN price_history p0 ON p0.property_id = p1.property_id AND p0.price_date < p1.price_date WHERE p1.property_id = o.id AND p1.asking_price < p0.asking_price{})"
_FIRST = "(SELECT max(p.asking_price) FROM price_history p WHERE p.property_id = o.id AND p.price_date = (SELECT min(q.price_date) FROM price_history q WHERE q.property_id = o.id))"
case("cond_price_reduced", [
    (one("price_reduced", value=True), f"({_DROP.format('')} OR coalesce(o.update_reason, '') LIKE 'Reduced%')"),
    (one("price_reduced", min_drop_pct=5), f"({_FIRST} - o.asking_price) * 100.0 / {_FIRST} >= 5"),
    (one("price_reduced", within_days=1400), f"({_DROP.format(f' AND p1.price_date >= DATE {chr(39)}{AS_OF}{chr(39)} - 1400')} OR (o.update_reason LIKE 'Reduced on %' AND strptime(o.update_reason[12:21], '%d/%m/%Y') >= DATE '{AS_OF}' - 1400))"),
], "price_history")
case("cond_feature_text", [
    (one("conservatory", value=True), f"({KF} LIKE '%conservatory%' OR {FP.format('has_conservatory')})"), (one("fireplace", value=False), f"NOT ({KF} LIKE '%fireplace%' OR {FP.format('has_fireplace')})"),
    (one("garage", value=True), f"({KF} LIKE '%garage%' OR {PA} LIKE '%garage%' OR {FP.format('has_garage')})"),
    (one("terrace", value=True), f"({GA} LIKE '%terrace%' OR ({KF} LIKE '%terrace%' AND {KF} NOT LIKE '%terraced%') OR {FP.format('has_terrace')})"),
], "plans")


def _window(c):
    t = f"regexp_replace(lower(coalesce(o.{c}, '')), 'open-plan|openplan', 'open plan', 'g')"
    return f"""(SELECT bool_or(strpos(t, 'open plan') > 0 AND strpos(seg, 'kitchen') > 0 AND NOT regexp_matches(seg[:greatest(strpos(seg, 'kitchen') - 1, 0)], '"|\\.|;| & |bedroom|bathroom|utility|garden|balcony|terrace|study|garage|parking|storage') AND NOT regexp_matches(pre, 'potential to|scope to|opportunity to'))
      FROM (SELECT t, t[strpos(t, 'open plan') + 9:strpos(t, 'open plan') + 78] AS seg, t[greatest(strpos(t, 'open plan') - 60, 1):greatest(strpos(t, 'open plan') - 60, 1) + 59] AS pre FROM (SELECT {t} AS t) a) b)"""


_OPK = f"({_window('key_features')} OR {_window('description')} OR {TF.format(chr(39).join(['t.open_tags LIKE ', '%open_plan_kitchen%', '']))})"
case("cond_open_plan_kitchen", [(one("open_plan_kitchen", value=True), _OPK), (one("open_plan_kitchen", value=False), f"NOT {_OPK}")], "text_facts")


@query("commute_coverage_gap", """SELECT 'N' AS area, count(*) AS n FROM listings o WHERE o.asking_price <= 430000 AND o.delisted_date IS NULL AND (o.canonical_id IS NULL OR o.canonical_id = o.id)
  AND NOT EXISTS (SELECT 1 FROM commute c WHERE c.sector = o.sector AND c.hub = 'Bank' AND c.minutes IS NOT NULL) HAVING count(*) > 0""", "listings commute")
def _(i):
    return op.commute_gap(i.listings, [{"type": "price", "max": 430000}, {"type": "commute", "hub": "Bank", "max_minutes": 30}], lookups(i), AS_OF)


@query("win_price_drops", """WITH d AS (SELECT property_id, price_date, min(asking_price) AS low, max(asking_price) AS high FROM price_history GROUP BY ALL), l AS (SELECT *, lag(high) OVER (PARTITION BY property_id ORDER BY price_date) AS prev FROM d)
  SELECT property_id, arg_min(high, price_date) AS first_price, count(*) FILTER (WHERE low < prev) AS drops, strftime(max(price_date) FILTER (WHERE low < prev), '%Y-%m-%d') AS last_drop, round(max((prev - low) * 100.0 / prev) FILTER (WHERE low < prev), 6) AS biggest_pct FROM l GROUP BY property_id""", "price_history")
def _(i):
    days = op.price_days(i.price_history)
    fell = F.col("low") < F.col("prev_high")
    return days.groupBy("property_id").agg(
        F.min_by("high", "price_date").alias("first_price"), F.count_if(fell).alias("drops"), F.date_format(F.max(F.when(fell, F.col("price_date"))), "yyyy-MM-dd").alias("last_drop"),
        F.round(F.max(F.when(fell, (F.col("prev_high") - F.col("low")) * 100.0 / F.col("prev_high"))), 6).alias("biggest_pct"))


@query("join_self_earlier_lower", "SELECT DISTINCT p1.property_id FROM price_history p1 JOIN price_history p0 ON p0.property_id = p1.property_id AND p0.price_date < p1.price_date AND p1.asking_price < p0.asking_price", "price_history")
def _(i):
    return op.price_days(i.price_history).where("low < prev_high").select("property_id").distinct()


@query("join_semi_exists", f"SELECT o.id, o.postcode FROM listings o WHERE {FP.format('has_garden')}", "listings plans")
def _(i):
    return i.listings.join(i.plans.where("ok = 1 AND has_garden = 1").select("id"), "id", "left_semi").select("id", "postcode")


@query("join_tri_state", f"SELECT o.id, CASE WHEN o.garden = 'Yes' OR {GA} LIKE '%garden%' THEN 'yes' WHEN coalesce(o.garden, '') <> '' THEN 'no' WHEN {FP.format('has_garden')} THEN 'yes' ELSE 'unknown' END AS garden FROM listings o", "listings plans")
def _(i):
    seen = i.plans.where("ok = 1").groupBy("id").agg(F.max("has_garden").alias("seen"))
    g = F.coalesce("garden", F.lit(""))
    state = F.when((g == "Yes") | F.contains(F.lower(g), F.lit("garden")), "yes").when(g != "", "no").when(F.col("seen") == 1, "yes").otherwise("unknown")
    return i.listings.join(seen, "id", "left").select("id", state.alias("garden"))
