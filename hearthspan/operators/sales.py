"""Sale ledger operators: pairing, growth, summaries, filters, comparables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthspan.functions.rank import first_k, group_quantiles, newest, with_previous
from hearthspan.operators.nearest import neighbourhood_median
from hearthspan.session import checkpointed
from hearthspan.sources.tables import has_column

SALE_ORDER = ["sale_date", "tie1", "tie2", "tie3", "price"]
RESIDENTIAL = ("D", "S", "T", "F")
DAYS_PER_YEAR = 365.25


def day(text: str) -> Column:
    return F.to_date(F.lit(text))


def is_standard(category: Column) -> Column:
    """Only an exact A is standard; NULL is neither standard nor B."""
    return F.coalesce(F.upper(F.trim(category)) == "A", F.lit(False))


def not_b(category: Column) -> Column:
    """The laxer rule: anything not marked B counts as a market sale."""
    return F.coalesce(category != "B", F.lit(True))


def since(sales: DataFrame, cut: Column) -> DataFrame:
    """Sales from the date `cut` on; a ledger that is partitioned by year reads only the years that can hold them."""
    rows = sales.where(F.col("sale_date") >= cut)
    return rows.where(F.col("sale_year") >= F.year(cut)) if has_column(sales, "sale_year") else rows


def in_years(sales: DataFrame, as_of: str, years: int) -> DataFrame:
    """Rows no older than `years` x 365 days before `as_of`."""
    return since(sales, F.date_sub(day(as_of), years * 365))


def scan_sales(sales: DataFrame, as_of: str, years: int, types=RESIDENTIAL) -> DataFrame:
    """Sane residential rows; the comparisons are plain so that the scan can take them."""
    ok = (F.col("price") > 0) & F.col("sale_date").isNotNull() & F.col("property_type").isin(*types)
    return in_years(sales.where(ok), as_of, years)


def annualised(first: Column, last: Column, years: Column) -> Column:
    """Yearly rate in percent; NULL below half a year."""
    ok = (years >= 0.5) & (first > 0)
    return F.when(ok, (F.pow(last / first, 1 / years) - 1) * 100)


def consecutive_pairs(sales: DataFrame, key: str = "address_key") -> DataFrame:
    """Each sale beside the sale before it at the same address, over the full sequence."""
    rows = with_previous(
        sales.where(F.col(key).isNotNull() & F.col("sale_date").isNotNull()),
        [key], SALE_ORDER, ["sale_date", "price", "category"],
    )
    return rows.where(F.col("prev_sale_date").isNotNull())


def repeat_sales(sales: DataFrame, key: str = "address_key") -> DataFrame:
    """Repeat-sale returns. Pairs with a B leg go after pairing, so no hold spans a removed sale."""
    held = F.datediff("sale_date", "prev_sale_date") / F.lit(DAYS_PER_YEAR)
    pairs = consecutive_pairs(sales, key).where(
        not_b(F.col("category")) & not_b(F.col("prev_category")) & (F.col("prev_price") > 0)
    )
    pairs = pairs.withColumn("_held", held).where(F.col("_held") >= 0.25)
    rate = (F.pow(F.col("price") / F.col("prev_price"), 1 / F.col("_held")) - 1) * 100
    return pairs.select(
        "*",
        (F.col("price") - F.col("prev_price")).alias("price_change"),
        F.round((F.col("price") - F.col("prev_price")) / F.col("prev_price") * 100, 2).alias("change_pct"),
        F.round("_held", 2).alias("years_held"),
        F.round(F.greatest(F.lit(-100.0), F.least(F.lit(100.0), rate)), 2).alias("annual_return"),
    ).drop("_held")


def growth_parts(pairs: DataFrame, keys: list[str], as_of_year: int, windows=(3, 5, 10)) -> DataFrame:
    """Sums from which hold-weighted growth follows at any coarser level.

    Returns and holds carry two decimals, so they are summed as whole hundredths: the result does
    not depend on the order in which tasks add.
    """
    aggs = []
    ret, held = F.round(F.col("annual_return") * 100).cast("bigint"), F.round(F.col("years_held") * 100).cast("bigint")
    for w in windows:
        inside = F.year("sale_date") >= as_of_year - w
        aggs += [
            F.sum(F.when(inside, ret * held)).alias(f"_num_{w}"),
            F.sum(F.when(inside, held)).alias(f"_den_{w}"),
            F.count(F.when(inside, 1)).alias(f"_cnt_{w}"),
        ]
    return pairs.groupBy(*keys).agg(*aggs, F.count(F.lit(1)).alias("_all"))


def growth_columns(windows=(3, 5, 10)) -> list[Column]:
    """Rates, counts and direction from summed parts."""
    outs = []
    for w in windows:
        rate = F.when(F.col(f"_den_{w}") > 0, F.col(f"_num_{w}") / F.col(f"_den_{w}") / 100)
        outs += [rate.alias(f"cagr_{w}y"), F.col(f"_cnt_{w}").alias(f"cagr_{w}y_count")]
    recent = F.when(F.col("_den_3") > 0, F.col("_num_3") / F.col("_den_3") / 100)
    direction = (
        F.when(F.col("_cnt_3") == 0, "unknown").when(recent > 3, "up").when(recent < -3, "down").otherwise("stable")
    )
    return [*outs, direction.alias("direction"), F.col("_all").alias("sample_count")]


def area_growth(pairs: DataFrame, keys: list[str], as_of_year: int) -> DataFrame:
    return growth_parts(pairs, keys, as_of_year).select(*keys, *growth_columns())


def growth_rollup(pairs: DataFrame, as_of_year: int) -> DataFrame:
    """Growth at unit, sector, outcode and market level from one pass over the pairs.

    Sums are taken per unit postcode first; only those partial rows are rolled up.
    """
    parts = growth_parts(pairs, ["outcode", "sector", "postcode"], as_of_year)
    sums = [c for c in parts.columns if c.startswith("_")]
    rolled = parts.rollup("outcode", "sector", "postcode").agg(
        F.grouping_id().alias("gid"), *[F.sum(c).alias(c) for c in sums]
    )
    level = F.when(F.col("gid") == 0, "unit").when(F.col("gid") == 1, "sector").when(F.col("gid") == 3, "outcode").otherwise("market")
    geo = F.coalesce("postcode", "sector", "outcode", F.lit("ALL"))
    return rolled.select(level.alias("level"), geo.alias("geo"), *growth_columns())


def pick_window(rows: DataFrame, keys: list[str], as_of: str, ladder=(5, 10, 20), least: int = 5) -> DataFrame:
    """Rows inside the first window of the ladder that holds `least` sales per key, else all rows."""
    cuts = {w: F.date_sub(day(as_of), w * 365) for w in ladder}
    counts = rows.groupBy(*keys).agg(*[F.count(F.when(F.col("sale_date") >= c, 1)).alias(f"_w{w}") for w, c in cuts.items()])
    chosen = reduce(
        lambda acc, w: F.when(F.col(f"_w{w}") >= least, F.lit(w)).otherwise(acc), reversed(ladder), F.lit(None).cast("int")
    )
    counts = counts.select(*[F.col(k).alias(f"_p_{k}") for k in keys], chosen.alias("window_years"))
    match = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(counts[f"_p_{k}"]) for k in keys])
    joined = rows.join(counts, match).drop(*[f"_p_{k}" for k in keys])
    cut = F.date_sub(day(as_of), F.coalesce(F.col("window_years"), F.lit(100000)) * 365)
    return joined.where(F.col("window_years").isNull() | (F.col("sale_date") >= cut))


def price_summary(rows: DataFrame, keys: list[str], as_of: str) -> DataFrame:
    """Count, mean, upper median and range of the narrowest window with five sales."""
    inside = pick_window(rows, keys, as_of)
    return group_quantiles(
        inside, [*keys, "window_years"], "price",
        {"average_price": "mean", "median_price": "upper", "min_price": "min", "max_price": "max"},
    )


def drop_outliers(rows: DataFrame, keys: list[str], low: float = 0.17, high: float = 6.0) -> DataFrame:
    """Keep 17 % to 600 % of the group's upper median, where the group has three rows."""
    mid = group_quantiles(rows, keys, "price", {"_mid": "upper"}, count="_mid_n").withColumnsRenamed({k: f"_m_{k}" for k in keys})
    match = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(mid[f"_m_{k}"]) for k in keys])
    joined = rows.join(mid, match, "left")
    keep = F.col("_mid").isNull() | (F.col("_mid_n") < 3) | F.col("price").between(F.col("_mid") * low, F.col("_mid") * high)
    return joined.where(keep).select(*rows.columns)


# Yearly median sale price used as an index of what the market did.
MARKET_MEDIANS = {
    1995: 73_200, 1996: 77_500, 1997: 86_000, 1998: 97_000, 1999: 117_500,
    2000: 137_000, 2001: 154_000, 2002: 180_000, 2003: 199_995, 2004: 219_995,
    2005: 228_000, 2006: 242_425, 2007: 255_000, 2008: 250_000, 2009: 250_000,
    2010: 282_500, 2011: 285_000, 2012: 295_000, 2013: 315_000, 2014: 352_000,
    2015: 390_000, 2016: 425_506, 2017: 449_110, 2018: 450_000, 2019: 455_000,
    2020: 481_000, 2021: 497_000, 2022: 512_500, 2023: 515_000, 2024: 520_000,
    2025: 515_000, 2026: 495_000,
}
ERA_BEFORE = 2005
FLOOR_PRICE = 50_000


def _year_median(year: Column) -> Column:
    last = max(MARKET_MEDIANS)
    lookup = F.create_map(*[F.lit(x) for kv in MARKET_MEDIANS.items() for x in kv])
    return F.when(year <= last, F.try_element_at(lookup, year)).otherwise(F.lit(MARKET_MEDIANS[last]))


def is_market_pair() -> Column:
    """Arm's-length pair by the fixed guards, or by its own era for purchases before 2005."""
    first, last, held = F.col("first_price"), F.col("last_price"), F.col("hold_years")
    rate = annualised(first, last, held)
    never = F.lit(False)
    fixed = (
        (first >= FLOOR_PRICE)
        & ~F.coalesce((F.col("pct_change") > 80) & (held < 8), never)
        & ~F.coalesce((rate > 20) | (rate < -35), never)
    )
    y1, y2 = F.year("first_date"), F.year("last_date")
    m1, m2 = _year_median(y1), _year_median(y2)
    market = (F.pow(m2 / m1, 1 / held) - 1) * 100
    era = (
        (y1 < ERA_BEFORE) & (first >= F.least(F.lit(float(FLOOR_PRICE)), 0.3 * m1))
        & rate.isNotNull() & (rate - market <= 12) & (rate >= -35)
    )
    return F.coalesce(fixed, never) | F.coalesce(era, never)


def is_clean_pair() -> Column:
    return is_standard(F.col("first_category")) & is_standard(F.col("last_category"))


def resale_pairs(sales: DataFrame) -> DataFrame:
    """Buy-to-sell table. Single hold: the address has exactly two sales."""
    per_address = sales.where(F.col("sale_date").isNotNull()).groupBy("address_key").agg(F.count(F.lit(1)).alias("_sales"))
    pairs = consecutive_pairs(sales).join(per_address, "address_key")
    return pairs.select(
        "address_key", "postcode", "outcode", "sector", "property_type",
        F.col("prev_sale_date").alias("first_date"), F.col("sale_date").alias("last_date"),
        F.col("prev_price").alias("first_price"), F.col("price").alias("last_price"),
        F.when(F.col("prev_price") > 0, (F.col("price") - F.col("prev_price")) / F.col("prev_price") * 100).alias("pct_change"),
        (F.datediff("sale_date", "prev_sale_date") / F.lit(DAYS_PER_YEAR)).alias("hold_years"),
        F.col("prev_category").alias("first_category"), F.col("category").alias("last_category"),
        (F.col("_sales") == 2).cast("int").alias("is_single_hold"),
        F.col("tie1"), F.col("tie2"), F.col("tie3"),
    )


def cohort_stats(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Size, median change, losers, gainers, loss share and median hold."""
    counts = pairs.groupBy(*keys).agg(F.count_if(F.col("pct_change") < 0).alias("losers"), F.count(F.lit(1)).alias("_rows"))
    change = group_quantiles(pairs, keys, "pct_change", {"median_pct": "median"}, count="n")
    hold = group_quantiles(pairs, keys, "hold_years", {"median_hold": "median"}, count=None)
    out = change.join(counts, keys).join(hold, keys)
    return out.select(
        *keys, "n", "median_pct", "losers", (F.col("n") - F.col("losers")).alias("gainers"),
        (F.lit(100.0) * F.col("losers") / F.col("n")).alias("loss_share"), "median_hold",
    )


def cohort_ladder(pairs: DataFrame, subjects: DataFrame, near: DataFrame, least: int = 3) -> DataFrame:
    """Cohort outcome per subject postcode at the narrowest rung with enough pairs at the best tier.

    Only single holds count: homes bought and sold once. Rungs: walk radius, sector, outcode. Tiers: clean, market, raw. Each tier of each place is
    summarised once and joined to the subjects; pairs are never repeated per subject.
    """
    flagged = pairs.where("is_single_hold = 1").withColumn("market", is_market_pair()).withColumn("clean", F.col("market") & is_clean_pair())
    tiers = F.array(
        F.when(F.col("clean"), 1), F.when(F.col("market"), 2), F.lit(3)
    )
    # read by every rung, so the flagged pairs are written once
    tiered = checkpointed(flagged.select("postcode", "sector", "outcode", "pct_change", "hold_years", F.explode(F.array_compact(tiers)).alias("tier")))
    near = near.select("subject", "postcode")
    ladder = F.array(*[F.struct(F.lit(r).alias("rung"), F.col(c).alias("place")) for r, c in ((2, "sector"), (3, "outcode"))])
    # counts add up, so the rung and tier are chosen from per-postcode counts before any median is taken
    counts = tiered.groupBy("postcode", "sector", "outcode", "tier").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("pct_change") < 0).alias("losers"))
    sums = [F.sum("n").alias("n"), F.sum("losers").alias("losers")]
    by_walk = counts.join(near, "postcode").groupBy("subject", "tier").agg(*sums)
    by_place = counts.select(F.inline(ladder), "tier", "n", "losers").groupBy("rung", "place", "tier").agg(*sums)
    own = subjects.select(F.col("postcode").alias("subject"), F.inline(ladder))
    walk = by_walk.join(subjects.select(F.col("postcode").alias("subject")), "subject", "left_semi")
    cols = ["subject", "rung", "place", "tier", "n", "losers"]
    options = walk.withColumn("rung", F.lit(1)).withColumn("place", F.col("subject")).select(*cols).unionByName(own.join(by_place, ["rung", "place"]).select(*cols))
    chosen = newest(options.where(F.col("n") >= least), ["subject"], ["tier", "rung"], oldest=True)
    around = tiered.select(F.inline(ladder), "tier", "pct_change", "hold_years")
    keys = ["rung", "place", "tier"]
    mids = group_quantiles(around, keys, "pct_change", {"median_pct": "median"}, count=None).join(
        group_quantiles(around, keys, "hold_years", {"median_hold": "median"}, count=None), keys)
    # the walk rung takes its medians from value slabs, without repeating pairs per subject
    tag = lambda c: F.concat_ws("|", c, F.col("tier").cast("string"))
    ask = chosen.where("rung = 1").select("subject", "tier").join(near, "subject").select("subject", tag("postcode").alias("place"))
    by = lambda c: neighbourhood_median(tiered.select(tag("postcode").alias("place"), F.col(c).alias("v")), ask).select("subject", F.col("mid").alias(f"w_{c}"))
    out = chosen.join(mids, keys, "left").join(by("pct_change"), "subject", "left").join(by("hold_years"), "subject", "left")
    first = F.col("rung") == 1
    return out.select(
        "subject", "rung", "tier", "n", F.when(first, F.col("w_pct_change")).otherwise(F.col("median_pct")).alias("median_pct"), "losers", (F.col("n") - F.col("losers")).alias("gainers"),
        (F.lit(100.0) * F.col("losers") / F.col("n")).alias("loss_share"), F.when(first, F.col("w_hold_years")).otherwise(F.col("median_hold")).alias("median_hold"))


TYPE_NAMES = {"F": "Flat", "T": "Terraced", "S": "Semi-detached", "D": "Detached", "O": "Other"}


NEWEST_FIRST = ["sale_date", "price", "tie1", "tie2", "tie3"]


def nearby_sales(sales: DataFrame, subjects: DataFrame, as_of: str, k: int, category: str) -> DataFrame:
    """Sales of a category in a subject's outcode over three years: far (0 in its own postcode), hit (of its types) and the sale.

    subjects: subject_id, postcode, outcode, type_codes (array or NULL = any type). Candidates are cut to k per (postcode, type)
    and 2k per (outcode, type) before they meet the subjects, so a hot outcode contributes a bounded number of rows to each.
    """
    recent = since(sales, F.add_months(day(as_of), -36)).where(F.col("category") == category)
    order = [F.desc("sale_date"), *NEWEST_FIRST[1:]]
    by_unit = checkpointed(first_k(recent.select(*NEWEST_FIRST, "property_type", "outcode", "postcode"), ["postcode", "property_type"], order, k, "_r").drop("_r"))
    # Each unit holds at most k rows here, so leaving out one unit from the 2k newest of an
    # outcode still leaves its k newest.
    by_area = first_k(by_unit, ["outcode", "property_type"], order, 2 * k, "_r").drop("_r")
    s = subjects.select("subject_id", F.col("postcode").alias("s_postcode"), F.col("outcode").alias("s_outcode"), "type_codes")
    near = by_unit.join(s, F.col("postcode") == F.col("s_postcode")).withColumn("far", F.lit(0))
    wide = by_area.join(s, (F.col("outcode") == F.col("s_outcode")) & (F.col("postcode") != F.col("s_postcode"))).withColumn("far", F.lit(1))
    wanted = F.col("type_codes").isNull() | F.array_contains("type_codes", F.col("property_type"))
    return near.unionByName(wide).withColumn("hit", wanted.cast("int"))


def question() -> Column:
    return F.struct("postcode", "outcode", "type_codes")


def asked(subjects: DataFrame) -> DataFrame:
    """The different questions of the subjects, as subjects themselves: what sells near one depends on its place and types alone."""
    return subjects.select(question().alias("subject_id"), "postcode", "outcode", "type_codes").distinct()


def comparables(sales: DataFrame, subjects: DataFrame, as_of: str, k: int = 10) -> DataFrame:
    """k newest standard same-outcode sales per subject, same postcode first, filtered before the cut; all types where none of its own sold."""
    found = asked_comparables(sales, asked(subjects), as_of, k).withColumnRenamed("subject_id", "_ask")
    return subjects.select("subject_id", question().alias("_ask")).join(found, "_ask").drop("_ask")


def asked_comparables(sales: DataFrame, asks: DataFrame, as_of: str, k: int) -> DataFrame:
    """The comparables of each different question."""
    both = nearby_sales(sales, asks, as_of, k, "A")
    # a question meets a bounded number of sales, so a window over them is one too
    both = both.withColumn("any_hit", F.max("hit").over(Window.partitionBy("subject_id"))).where(F.col("hit") == F.col("any_hit"))
    return first_k(both, ["subject_id"], ["far", F.desc("sale_date"), *NEWEST_FIRST[1:]], k)


def comparable_report(sales: DataFrame, subjects: DataFrame, as_of: str, k: int = 10, examples: int = 3) -> DataFrame:
    """Count, median and range of each subject's comparables; B sales of the same scope are counted and named, never in the figures.

    scope: `typed`, `widened` (no standard sale of its types) or `all`; basis: `standard`, `only_b` (B sales alone: no median) or `none`.
    """
    asks = asked(subjects)
    comps = asked_comparables(sales, asks, as_of, k)
    # at most k rows per subject, so the built-in median holds a bounded group
    stats = checkpointed(comps.groupBy("subject_id").agg(
        F.count(F.lit(1)).alias("n"), F.floor(F.median("price")).alias("median_price"),
        F.min("price").alias("low"), F.max("price").alias("high"), F.max("any_hit").alias("typed"),
    ))
    typed = F.coalesce("typed", F.lit(0))
    b = nearby_sales(sales, asks, as_of, examples, "B").join(stats.select("subject_id", "typed"), "subject_id", "left").where(F.col("hit") >= typed)
    b = first_k(b, ["subject_id"], ["far", F.desc("sale_date"), *NEWEST_FIRST[1:]], examples)
    named = F.concat(F.col("price").cast("string"), F.lit("@"), F.date_format("sale_date", "yyyy-MM-dd"))
    b = b.groupBy("subject_id").agg(F.sort_array(F.collect_list(F.struct("rank", named.alias("text")))).alias("_b"))
    b = b.select("subject_id", F.array_join(F.transform("_b", lambda x: x["text"]), "|").alias("b_examples"))
    recent_b = since(sales, F.add_months(day(as_of), -36)).where(F.col("category") == "B")
    b_counts = recent_b.groupBy("outcode", "property_type").agg(F.count(F.lit(1)).alias("b_n"))
    s = asks.join(stats, "subject_id", "left").join(b_counts, "outcode", "left")
    used = F.col("type_codes").isNull() | (typed == 0) | F.array_contains("type_codes", F.col("property_type"))
    scope = F.when(F.col("type_codes").isNull(), "all").when(typed == 1, "typed").otherwise("widened")
    out = s.groupBy("subject_id", scope.alias("scope"), F.coalesce("n", F.lit(0)).alias("n"), "median_price", "low", "high").agg(
        F.coalesce(F.sum(F.when(used, F.col("b_n"))), F.lit(0)).alias("b_count")
    )
    told = out.join(b, "subject_id", "left").withColumnRenamed("subject_id", "_ask")
    return subjects.select("subject_id", "asking_price", question().alias("_ask")).join(told, "_ask").select(
        "subject_id", "scope", F.when(F.col("n") > 0, "standard").when(F.col("b_count") > 0, "only_b").otherwise("none").alias("basis"), "n", "median_price", "low", "high", "b_count", "b_examples",
        F.round((F.col("asking_price") - F.col("median_price")) / F.col("median_price") * 100, 4).alias("asking_vs_median_pct"),
    )


def notable(pairs: DataFrame, keys: list[str], k: int = 3) -> DataFrame:
    """Biggest gains (over 30 % or 10 % a year) and losses (under -10 %) per group."""
    tail = ["sale_date", "tie1", "tie2", "tie3", "price"]
    gains = pairs.where((F.col("change_pct") > 30) | (F.col("annual_return") > 10))
    losses = pairs.where(F.col("change_pct") < -10)
    up = first_k(gains, keys, [F.desc("change_pct"), *tail], k).withColumn("kind", F.lit("gain"))
    down = first_k(losses, keys, ["change_pct", *tail], k).withColumn("kind", F.lit("loss"))
    return up.unionByName(down)


def repeat_examples(pairs: DataFrame, keys: list[str], recent: int = 3, total: int = 5) -> DataFrame:
    """Up to three newest pairs and the longest held after them, each address once."""
    tail = ["tie1", "tie2", "tie3", "price"]
    latest = newest(pairs.withColumn("_o", F.col("sale_date")), [*keys, "address_key"], ["_o", *tail]).drop("_o")
    new = first_k(latest, keys, [F.desc("sale_date"), "address_key"], recent, "slot").withColumn("reason", F.lit("recent"))
    longest = newest(pairs.withColumn("_h", F.col("years_held")), [*keys, "address_key"], ["_h", "sale_date", *tail]).drop("_h")
    rest = longest.join(new.select(*keys, "address_key"), [*keys, "address_key"], "left_anti")
    taken = new.groupBy(*keys).agg(F.max("slot").alias("_taken"))
    rest = first_k(rest.join(taken, keys), keys, [F.desc("years_held"), "address_key"], total, "slot")
    rest = rest.where(F.col("slot") <= total - F.col("_taken")).withColumn("reason", F.lit("long_held"))
    cols = [*keys, "address_key", "reason", "slot", "sale_date", "years_held", "annual_return"]
    return new.select(*cols).unionByName(rest.select(*cols))


def dedupe_sales(rows: DataFrame, order: list) -> DataFrame:
    """One row per (normalised address, date, price); the first by `order` (column names) wins."""
    addr = F.regexp_replace(F.trim(F.upper(F.concat_ws(" ", "saon", "paon", "street"))), r"\s+", " ")
    return newest(rows.withColumn("addr", addr), ["addr", "postcode", "sale_date", "price"], order, oldest=True)
