"""Market baselines, seasonality, trend by type, risk and area reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hearthspan.functions.rank import group_quantiles, newest, value_slab
from hearthspan.operators.sales import day, growth_columns, growth_parts, is_standard, repeat_sales, since
from hearthspan.session import checkpointed

# Named months.
KNOWN_EVENTS = {
    "2009-01": "financial-crisis trough",
    "2009-02": "financial-crisis trough",
    "2016-03": "rush before the 3% additional-property surcharge (1 Apr 2016)",
    "2020-04": "first COVID lockdown — market effectively closed",
    "2020-05": "first COVID lockdown — market effectively closed",
    "2021-03": "stamp-duty holiday original deadline (31 Mar 2021)",
    "2021-06": "stamp-duty holiday extended deadline (30 Jun 2021)",
    "2021-07": "hangover month after the 30 Jun 2021 deadline",
    "2021-09": "stamp-duty taper ended (30 Sep 2021)",
    "2025-03": "rush before the 1 Apr 2025 threshold change",
    "2025-04": "hangover month after the Apr 2025 threshold change",
}
RADIUS = 6
SPIKE, COLLAPSE, TAIL = 1.40, 0.65, 0.85
SEASON_TYPES = ("F", "T", "S", "D")


def month_counts(sales: DataFrame) -> DataFrame:
    """Standard sales per month with the month's place among the months that exist.

    There is one row per calendar month, so ordering all months is a bounded window.
    """
    counts = sales.where(F.col("category") == "A").groupBy(F.date_format("sale_date", "yyyy-MM").alias("ym")).agg(F.count(F.lit(1)).alias("n"))
    order = W.orderBy("ym")
    return counts.select("ym", "n", F.row_number().over(order).alias("pos"), F.count(F.lit(1)).over(W.partitionBy()).alias("months"))


def month_quality(sales: DataFrame, spike=SPIKE, collapse=COLLAPSE, tail=TAIL) -> DataFrame:
    """Volume of a month against the median of its twelve neighbours; the last months against the twelve before."""
    m = month_counts(sales)
    other = m.select(F.col("pos").alias("o_pos"), F.col("n").alias("o_n"))
    centred = (F.col("pos") > RADIUS) & (F.col("pos") + RADIUS <= F.col("months"))
    trailing = (F.col("pos") + RADIUS > F.col("months")) & (F.col("pos") > 2 * RADIUS)
    gap = F.col("o_pos") - F.col("pos")
    beside = (centred & gap.between(-RADIUS, RADIUS) & (gap != 0)) | (trailing & gap.between(-2 * RADIUS, -1))
    # twelve rows per month, so the built-in median holds a bounded group
    around = m.withColumn("o_pos", F.explode(F.sequence(F.col("pos") - 2 * RADIUS, F.col("pos") + RADIUS))).join(other, "o_pos")
    base = around.where(beside).groupBy("pos").agg(F.median("o_n").alias("base"))
    j = m.join(base, "pos", "left")
    ratio = F.when(F.col("base") > 0, F.col("n") / F.col("base"))
    reason = (
        F.when(centred & (ratio > spike), "volume_spike")
        .when(centred & (ratio < collapse), "volume_collapse")
        .when(trailing & (ratio < tail), "incomplete_filing")
    )
    events = F.create_map(*[F.lit(x) for kv in KNOWN_EVENTS.items() for x in kv])
    return j.select(
        "ym", "pos", "months", "n", ratio.alias("ratio"), reason.isNotNull().cast("int").alias("is_distorted"), reason.alias("reason"),
        F.when(reason.isNotNull(), F.try_element_at(events, F.col("ym"))).alias("event"),
    )


def clean_sales(sales: DataFrame, quality: DataFrame) -> DataFrame:
    """Standard sales outside distorted months."""
    bad = quality.where("is_distorted = 1").select(F.col("ym").alias("_bad"))
    return sales.where(F.col("category") == "A").join(bad, F.date_format("sale_date", "yyyy-MM") == F.col("_bad"), "left_anti")


def seasonality(sales: DataFrame, quality: DataFrame, min_type_sales: int = 200) -> DataFrame:
    """Month-of-year price and volume indices, detrended against clean neighbouring months, per type."""
    standard = sales.where(F.col("category") == "A").withColumn("ym", F.date_format("sale_date", "yyyy-MM"))
    own = F.when(F.col("property_type").isin(*SEASON_TYPES), F.col("property_type")).otherwise("O")
    typed = standard.withColumn("ptype", F.explode(F.array(own, F.lit("ALL"))))
    # (type, month) medians: at most six rows per calendar month from here on
    med = group_quantiles(typed, ["ptype", "ym"], "price", {"med": "median"}, count="sales_n")
    q = quality.select("ym", "pos", "months", F.col("n").alias("month_n"), "is_distorted")
    here = med.where(F.col("ptype") != "O").join(q, "ym").where(
        (F.col("is_distorted") == 0) & (F.col("pos") > RADIUS) & (F.col("pos") + RADIUS <= F.col("months")) & (F.col("sales_n") >= min_type_sales)
    )
    clean = q.where("is_distorted = 0").select(F.col("pos").alias("o_pos"), F.col("month_n").alias("o_n"), F.col("ym").alias("o_ym"))
    other = med.select(F.col("ptype").alias("o_type"), F.col("ym").alias("o_ym"), F.col("med").alias("o_med"))
    around = here.withColumn("o_pos", F.explode(F.sequence(F.col("pos") - RADIUS, F.col("pos") + RADIUS)))
    around = around.where(F.col("o_pos") != F.col("pos")).join(clean, "o_pos")
    around = around.join(other, (around["o_ym"] == other["o_ym"]) & (F.col("ptype") == F.col("o_type")), "left")
    per = around.groupBy("ptype", "ym", "sales_n", "med", "month_n").agg(
        F.count("o_med").alias("beside"), F.median("o_med").alias("base"), F.avg("o_n").alias("vol_base")
    ).where(F.col("beside") >= 10)
    per = per.select(
        "ptype", F.substring("ym", 6, 2).cast("int").alias("month"), "sales_n",
        (F.col("med") / F.col("base")).alias("price_ratio"), (F.col("month_n") / F.col("vol_base")).alias("volume_ratio"),
    )
    # one row per year in each group
    return per.groupBy(F.col("ptype").alias("property_type"), "month").agg(
        F.round(F.median("price_ratio"), 4).alias("price_index"), F.round(F.median("volume_ratio"), 4).alias("volume_index"),
        F.count(F.lit(1)).alias("n_months"), F.sum("sales_n").alias("n_sales"),
    )


def exclusion_note(quality: DataFrame) -> DataFrame:
    """One row: how many months were left out and which, in order. Bounded by the number of months."""
    listed = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("is_distorted") == 1, F.struct("ym", "ratio")))), lambda x: F.concat(x["ym"], F.lit("(x"), F.round(x["ratio"] * 100).cast("int").cast("string"), F.lit("%)"))), ", "
    )
    return quality.agg(F.sum("is_distorted").alias("excluded"), F.count(F.lit(1)).alias("months"), listed.alias("listed"))


def freshness(source: DataFrame, built: DataFrame, as_of: str, max_age_days: int = 45) -> DataFrame:
    """Live month against the month each derived table was built from. built: name, source_max_date, built_on."""
    live = source.agg(F.date_format(F.max("sale_date"), "yyyy-MM").alias("live_month"))
    age = F.datediff(day(as_of), F.col("built_on"))
    return built.join(F.broadcast(live)).select(
        "name", "live_month", F.date_format("source_max_date", "yyyy-MM").alias("built_month"),
        (F.col("live_month") > F.date_format("source_max_date", "yyyy-MM")).cast("int").alias("is_stale"), age.alias("age_days"), (age > max_age_days).cast("int").alias("too_old"),
    )


def trend_by_type(sales: DataFrame, as_of_year: int, least: int = 5, divergence: float = 8.0) -> DataFrame:
    """Flats and houses per unit postcode at the narrowest level with enough sales in the last twelve months.

    The twelve months end at the outcode's latest standard sale. Each level is summarised once and
    joined to the units; pairing sees every category and drops B legs afterwards.
    """
    rows = sales.where(F.col("property_type").isin("D", "S", "T", "F") & (F.col("price") > 0) & F.col("sale_date").isNotNull())
    rows = rows.withColumn("segment", F.when(F.col("property_type") == "F", "flats").otherwise("houses"))
    standard = is_standard(F.col("category"))
    anchors = rows.groupBy("outcode").agg(
        F.coalesce(F.max(F.when(standard, F.col("sale_date"))), F.max("sale_date")).alias("anchor")
    )
    dated = rows.where(standard).join(anchors, "outcode")
    age = F.datediff("anchor", "sale_date")
    dated = dated.withColumn("win", F.when((age >= 0) & (age < 365), "now").when((age >= 365) & (age < 730), "prev")).where("win IS NOT NULL")
    # three levels read these, so the recent rows and the growth sums are written once
    dated = checkpointed(dated.select("outcode", "sector", "postcode", "segment", "win", "price"))
    parts = checkpointed(growth_parts(repeat_sales(rows), ["outcode", "sector", "postcode", "segment"], as_of_year))
    sums = [F.sum(c).alias(c) for c in parts.columns if c.startswith("_")]
    units = rows.select("outcode", "sector", "postcode", "segment").distinct()
    out = units
    for level in ("postcode", "sector", "outcode"):
        keys = [level, "segment"]
        mids = group_quantiles(dated, [*keys, "win"], "price", {"mid": "median"})
        mids = mids.groupBy(*keys).agg(
            F.max(F.when(F.col("win") == "now", F.col("n"))).alias(f"{level}_n12"), F.max(F.when(F.col("win") == "now", F.col("mid"))).alias(f"{level}_m12"),
            F.max(F.when(F.col("win") == "prev", F.col("n"))).alias(f"{level}_np"), F.max(F.when(F.col("win") == "prev", F.col("mid"))).alias(f"{level}_mp"),
        )
        rates = parts.groupBy(*keys).agg(*sums).select(*keys, *growth_columns())
        rates = rates.select(*keys, F.col("cagr_3y").alias(f"{level}_c3"), F.col("cagr_3y_count").alias(f"{level}_k3"))
        out = out.join(mids, keys, "left").join(rates, keys, "left")

    def chosen(suffix: str) -> Column:
        pick = F
        for level in ("postcode", "sector", "outcode"):
            pick = pick.when(F.col(f"{level}_n12") >= least, F.lit(level) if suffix == "level" else F.col(f"{level}_{suffix}"))
        return pick

    enough = F.coalesce(chosen("np"), F.lit(0)) >= least
    yoy = F.when(enough, (chosen("m12") / chosen("mp") - 1) * 100)
    res = out.select(
        "postcode", "segment", chosen("level").alias("level"), F.coalesce(chosen("n12"), F.col("outcode_n12"), F.lit(0)).alias("n12"),
        chosen("m12").alias("median_12m"), F.when(chosen("level").isNotNull(), F.coalesce(chosen("np"), F.lit(0))).alias("prev_n"),
        F.round(yoy, 4).alias("yoy_pct"), chosen("c3").alias("cagr_3y"), chosen("k3").alias("cagr_3y_count"),
    )
    return res.withColumn("diverges", (F.abs(F.col("yoy_pct") - F.col("cagr_3y")) > divergence).cast("int"))


# Listing labels of each kind.
HOUSE_LABELS = ("terraced", "semi-detached", "detached", "end of terrace", "house", "town house", "link detached house",
                "mews", "cottage", "bungalow", "barn conversion", "semi-detached villa")
FLAT_LABELS = ("flat", "apartment", "maisonette", "studio", "ground flat", "penthouse", "duplex", "triplex",
               "ground maisonette", "block of apartments")


def active_canonical(listings: DataFrame) -> DataFrame:
    """Live listings, one per set of multi-agent twins."""
    return listings.where(F.col("delisted_date").isNull() & (F.col("canonical_id").isNull() | (F.col("canonical_id") == F.col("id"))))


def underwater(listings: DataFrame, area: str = "outcode", bought=(2016, 2022), least: int = 10) -> DataFrame:
    """Share of live listings asking less than the owner paid, per area and over the whole market."""
    kind = F.when(F.lower("property_type").isin(*FLAT_LABELS), "flats").when(F.lower("property_type").isin(*HOUSE_LABELS), "houses")
    rows = active_canonical(listings).where(
        (F.col("match_strategy") == "detail_anchored") & F.col("asking_price").isNotNull() & F.col("prev_sold_price").isNotNull()
        & F.year("prev_sold_date").between(*bought) & (F.coalesce("shared_ownership", F.lit(0)) == 0) & (F.coalesce("is_auction", F.lit(0)) == 0)
    ).withColumn("kind", kind).where(F.col("kind").isNotNull())
    rows = rows.withColumn("scope", F.explode(F.array(F.col(area), F.lit("ALL"))))
    under = F.col("asking_price") < F.col("prev_sold_price")
    counts = rows.groupBy("scope", "kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(under).alias("n_under"))
    short = rows.where(under).withColumn("short", (F.col("prev_sold_price") - F.col("asking_price")) / F.col("prev_sold_price") * 100)
    mids = group_quantiles(short, ["scope", "kind"], "short", {"mid": "median"}, count=None)
    enough = F.col("n") >= least
    return counts.join(mids, ["scope", "kind"], "left").select(
        "scope", "kind", "n", "n_under", F.when(enough, F.round(F.col("n_under") / F.col("n") * 100, 4)).alias("under_pct"),
        F.when(enough, F.round("mid", 4)).alias("median_shortfall"),
    )


def flood_share(listings: DataFrame, area: str, least: int = 20) -> DataFrame:
    """Flood-zone shares of checked live listings; thin areas say nothing."""
    rows = active_canonical(listings).where(F.col("flood_checked_at").isNotNull())
    counts = rows.groupBy(F.col(area).alias("scope")).agg(
        F.count(F.lit(1)).alias("n_checked"), F.count_if(F.col("flood_zone") == "FZ3").alias("fz3_n"), F.count_if(F.col("flood_zone") == "FZ2").alias("fz2_n")
    )
    enough = F.col("n_checked") >= least
    return counts.select(
        "scope", "n_checked", *[F.when(enough, F.col(c)).alias(c) for c in ("fz3_n", "fz2_n")],
        *[F.when(enough, F.round(F.col(f"{z}_n") / F.col("n_checked"), 6)).alias(f"{z}_share") for z in ("fz3", "fz2")],
    )


def recent_sales_by_outcode(sales: DataFrame, as_of: str) -> DataFrame:
    """Twelve months of standard sales per outcode with the count of B sales left out; an all-B area keeps its row."""
    rows = since(sales, F.add_months(day(as_of), -12)).where(F.col("price") > 0)
    counts = rows.groupBy("outcode").agg(F.count_if(is_standard(F.col("category"))).alias("n"), F.count_if(F.upper(F.trim("category")) == "B").alias("excluded_b"))
    mids = group_quantiles(rows.where(is_standard(F.col("category"))), ["outcode"], "price", {"mid": "median", "low": "min", "high": "max"}, count=None)
    return counts.join(mids, "outcode", "left").where((F.col("n") > 0) | (F.col("excluded_b") > 0)).select(
        "outcode", "n", F.floor("mid").alias("median_price"), "low", "high", "excluded_b"
    )


DIMENSIONS = ("transport", "community", "environment", "price", "schools")


def area_scores(scores: DataFrame, area: str, dims=(*DIMENSIONS, "total_score", "median_price")) -> DataFrame:
    """Median, range and count of every dimension per area, nulls dropped."""
    long = scores.select(F.col(area).alias("area"), F.expr("stack(" + str(len(dims)) + ", " + ", ".join(f"'{d}', CAST({d} AS DOUBLE)" for d in dims) + ") AS (dimension, score)"))
    got = group_quantiles(long, ["area", "dimension"], "score", {"mid": "median", "low": "min", "high": "max"})
    return got.select("area", "dimension", F.round("mid", 4).alias("mid"), F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), "n")


def area_compare(summary: DataFrame, areas: list[str], lowest_wins=("median_price",)) -> DataFrame:
    """Two to four areas side by side with the leader of each metric."""
    rows = summary.where(F.col("area").isin(*areas))
    best = rows.groupBy("dimension").agg(F.max("mid").alias("hi"), F.min("mid").alias("lo"))
    lead = F.when(F.col("dimension").isin(*lowest_wins), F.col("mid") == F.col("lo")).otherwise(F.col("mid") == F.col("hi"))
    return rows.join(best, "dimension").select("area", "dimension", "mid", lead.cast("int").alias("leads"))


def council_tax(boroughs: DataFrame, rates: DataFrame, band: str = "band_d", straddle: float = 0.85) -> DataFrame:
    """Latest rate of each outcode's main borough, whether the outcode straddles, and the gap to the cheapest."""
    latest = newest(rates, ["borough"], ["tax_year"])
    share = F.coalesce("share", F.lit(1.0))
    rows = boroughs.join(latest, "borough").select("outcode", "borough", "tax_year", F.col(band).alias("amount"), (share < straddle).cast("int").alias("straddles"))
    cheapest = rows.where("straddles = 0").agg(F.min_by("borough", F.struct("amount", "borough")).alias("cheapest"), F.min("amount").alias("_low"))
    gap = F.when(F.col("straddles") == 0, F.col("amount") - F.col("_low"))
    return rows.join(F.broadcast(cheapest)).select("outcode", "borough", "tax_year", "amount", "straddles", "cheapest", gap.alias("dearer_by"))


def yield_by_bed(sales: DataFrame, rents: DataFrame, costs: float = 0.25) -> DataFrame:
    """Gross and net yield per outcode and bedroom count from two grouped medians."""
    price = group_quantiles(sales, ["outcode", "bedrooms"], "price", {"price": "median"}, count=None)
    rent = group_quantiles(rents, ["outcode", "bedrooms"], "rent", {"rent": "median"}, count="rent_n")
    gross = F.col("rent") * 12 / F.col("price") * 100
    return price.join(rent, ["outcode", "bedrooms"]).select(
        "outcode", "bedrooms", F.round("rent", 4).alias("rent"), F.round(gross, 4).alias("gross_pct"), F.round(gross * (1 - costs), 4).alias("net_pct"), "rent_n"
    )


def dominated_counts(calls: DataFrame, stock: DataFrame) -> DataFrame:
    """(call_id, found): how many rows of the stock a call's outcode has at or under its price_max and with its beds_min or more.

    calls(call_id, outcode, price_max, beds_min); stock(outcode, asking_price, bedrooms). For each floor that is asked for, stock
    and calls stand in one line by price and a running sum gives every call its number; the line is cut into price slabs, so
    the work is that of the calls and the stock, and no outcode is ordered in one task.
    """
    asked = calls.agg(F.collect_set("beds_min").alias("floors"))  # one row, as many numbers as there are different floors
    tally = stock.where("asking_price IS NOT NULL").groupBy("outcode", "asking_price", "bedrooms").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(asked))
    held = tally.select("outcode", F.explode(F.filter("floors", lambda f: f <= F.col("bedrooms"))).alias("floor"), F.col("asking_price").alias("price"), "n", F.lit(0).alias("asks"), F.lit(None).cast(dict(calls.dtypes)["call_id"]).alias("call_id"))
    line = held.unionByName(calls.select("outcode", F.col("beds_min").alias("floor"), F.col("price_max").alias("price"), F.lit(0).cast("long").alias("n"), F.lit(1).alias("asks"), "call_id"))
    line = line.withColumn("slab", value_slab(F.col("price")))
    keys = ["outcode", "floor"]
    slabs = line.groupBy(*keys, "slab").agg(F.sum("n").alias("held"))
    slabs = slabs.select(*keys, "slab", (F.sum("held").over(W.partitionBy(*keys).orderBy("slab")) - F.col("held")).alias("base"))
    inside = F.sum("n").over(W.partitionBy(*keys, "slab").orderBy("price", "asks"))
    return line.withColumn("inside", inside).where("asks = 1").join(slabs, [*keys, "slab"]).select("call_id", (F.col("base") + F.col("inside")).alias("found"))


def tag_supersets(needs: DataFrame, anchors: DataFrame) -> DataFrame:
    """(query, anchor) pairs whose anchor holds all tags of one of the query's requirement sets; no pair twice.

    needs(query, req array<string>); anchors(anchor, tags array<string>). Equal requirement sets are searched once, their
    candidates are the anchors of their rarest tag, and the other tags are only checked: a tag that half of all anchors carry
    brings up candidates only where nothing rarer is asked for. A set without tags is met by none.
    """
    needs = needs.select("query", F.array_sort(F.array_distinct("req")).alias("req")).where(F.size("req") > 0)
    tagged = anchors.select("anchor", F.array_distinct("tags").alias("tags"), F.explode(F.array_distinct("tags")).alias("tag"))
    often = tagged.groupBy("tag").agg(F.count(F.lit(1)).alias("often"))
    sets = needs.select("req").distinct()
    # a tag that no anchor has is the rarest of all: the join leaves its set without candidates
    rarest = sets.select("req", F.explode("req").alias("tag")).join(often, "tag", "left").groupBy("req").agg(F.min_by("tag", F.struct(F.coalesce("often", F.lit(0)).alias("often"), "tag")).alias("tag"))
    met = rarest.join(tagged, "tag").where(F.size(F.array_except("req", "tags")) == 0).select("req", "anchor")
    return needs.join(met, "req").select("query", "anchor").distinct()
