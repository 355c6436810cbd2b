"""Valuation: training pool, features, boosted trees, evaluation splits, nearest-sale estimate."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthspan.functions.rank import group_quantiles, with_previous
from hearthspan.operators import boosting
from hearthspan.operators.nearest import weighted_quantiles
from hearthspan.operators.sales import DAYS_PER_YEAR, SALE_ORDER, not_b
from hearthspan.session import checkpointed

ROWS_PER_PART = 50_000

# Hard caps of area (sq ft) and price, and the floor against the group median.
AREA_CAPS, PRICE_CAPS, FLOOR = (160, 10_764), (20_000, 10_000_000), 0.5


def with_ppsf(sales: DataFrame) -> DataFrame:
    seg = F.when(F.col("property_type") == "F", "flat").otherwise("house")
    return sales.withColumn("segment", seg).withColumn("ppsf", F.col("price") / F.col("floor_area_sqft")).withColumn("year_sold", F.year("sale_date"))


def ppsf_floor(rows: DataFrame, ratio: float = FLOOR) -> DataFrame:
    """Drop sales under half of their (segment, five years) median price per area, after the hard caps."""
    rows = rows.where(F.col("floor_area_sqft").between(*AREA_CAPS) & F.col("price").between(*PRICE_CAPS)).withColumn("span", F.floor(F.col("year_sold") / 5) * 5)
    mid = group_quantiles(rows, ["segment", "span"], "ppsf", {"_mid": "median"}, count=None)
    return rows.join(mid, ["segment", "span"]).where(F.col("ppsf") >= F.col("_mid") * ratio).drop("_mid", "span")


def previous_sale(rows: DataFrame) -> DataFrame:
    """Anchor of the sale before: flag, years since (-1 without one), log price and log price per area."""
    d = with_previous(rows, ["address_key"], SALE_ORDER, ["sale_date", "price"], ordinal="sale_no")
    gap = F.datediff("sale_date", "prev_sale_date") / F.lit(DAYS_PER_YEAR)
    return d.withColumn("has_prev", F.col("prev_price").isNotNull().cast("int")).withColumn("years_since_prev", F.coalesce(gap, F.lit(-1.0))).withColumn(
        "prev_log_price", F.log(F.greatest(F.coalesce(F.col("prev_price"), F.lit(0)), F.lit(1)))).withColumn(
        "prev_log_ppsf", F.coalesce(F.log(F.greatest(F.col("prev_price") / F.col("floor_area_sqft"), F.lit(1.0))), F.lit(0.0)))


def hpi_adjusted(rows: DataFrame) -> DataFrame:
    """Previous price carried to the sale year by the ratio of yearly median prices per area (a few dozen years)."""
    mids = group_quantiles(rows, ["year_sold"], "ppsf", {"m": "median"}, count=None)
    now, then = F.broadcast(mids.withColumnRenamed("m", "_m1")), F.broadcast(mids.select(F.col("year_sold").alias("_y0"), F.col("m").alias("_m0")))
    j = rows.join(now, "year_sold").join(then, F.year("prev_sale_date") == F.col("_y0"), "left")
    return j.withColumn("prev_hpi", F.coalesce(F.col("prev_price") * F.col("_m1") / F.col("_m0"), F.lit(0.0))).drop("_m1", "_m0", "_y0")


def pool(sales: DataFrame, since_year: int = 2006) -> DataFrame:
    """Training rows: market sales with caps, floor, anchors and flags."""
    rows = with_ppsf(sales.where(not_b(F.col("category")) & (F.col("property_type") != "O"))).where(F.col("year_sold") >= since_year)
    return previous_sale(ppsf_floor(rows)).withColumn("is_leasehold", F.coalesce((F.col("tenure") == "L").cast("int"), F.lit(0))).withColumn("new", (F.col("new_build") == "Y").cast("int"))


# Feature groups that can be switched on and off.
GROUPS = {
    "base": ["bedrooms", "floor_area_sqft", "year_sold"],
    "type": ["is_flat", "is_house"],
    "tenure": ["is_leasehold", "new"],
    "repeat": ["has_prev", "prev_log_price", "years_since_prev", "prev_log_ppsf"],
    "inter": ["beds_flat", "beds_house"],
}


def feature_columns(rows: DataFrame) -> DataFrame:
    """One-hot segment, interactions and the label: every column that a group may ask for."""
    flat = (F.col("segment") == "flat").cast("int")
    d = rows.withColumn("is_flat", flat).withColumn("is_house", 1 - F.col("is_flat"))
    return d.withColumn("beds_flat", F.col("bedrooms") * F.col("is_flat")).withColumn("beds_house", F.col("bedrooms") * F.col("is_house")).withColumn("label", F.log("price"))


def assembled(rows: DataFrame, groups=tuple(GROUPS)) -> DataFrame:
    """The vector of the enabled groups."""
    return VectorAssembler(inputCols=[c for g in groups for c in GROUPS[g]], outputCol="features").transform(rows.drop("features"))


def features(rows: DataFrame, groups=tuple(GROUPS)) -> DataFrame:
    """Feature columns and the vector of the enabled groups."""
    return assembled(feature_columns(rows), groups)


def training_rows(sales: DataFrame, per_part: int = ROWS_PER_PART) -> DataFrame:
    """Feature columns of the pool, written once: every fit, fold and variant reads them again.

    Parts follow the rows. A boosted model runs a few short jobs a tree, so small data in many parts would only wait.
    """
    rows = checkpointed(feature_columns(pool(sales)))
    parts = -(-rows.count() // per_part)
    return checkpointed(rows.repartition(parts)) if parts < rows.rdd.getNumPartitions() else rows


def predicted(model, rows: DataFrame) -> DataFrame:
    return model.transform(rows).withColumn("pred", F.exp("prediction"))


def fit_predict(train: DataFrame, test: DataFrame, trees: int) -> DataFrame:
    return predicted(boosting.fit(train, trees), test)


def fit_all(pairs: list[tuple[DataFrame, DataFrame]], trees: int) -> list[DataFrame]:
    """(train, test) pairs -> predictions of the tests; the models of all pairs grow level by level in the same jobs."""
    with boosting.together([train for train, _ in pairs]):
        return [fit_predict(train, test, trees) for train, test in pairs]


def kept(preds: DataFrame, keys: list[str]) -> DataFrame:
    """What errors are measured from, written once: every median reads the predictions again, which would be made anew."""
    return checkpointed(preds.select(*keys, "price", "pred"))


def group_folds(rows: DataFrame, trees: int, folds: int = 5, test_year: int = 2020) -> DataFrame:
    """Folds by property: a property's sales never train and test together; tests are sales from `test_year` on."""
    d = rows.withColumn("fold", F.pmod(F.xxhash64("address_key"), F.lit(folds)))
    pairs = [(d.where(F.col("fold") != f), d.where((F.col("fold") == f) & (F.col("year_sold") >= test_year))) for f in range(folds)]
    return reduce(DataFrame.unionByName, fit_all(pairs, trees))


def walk_forward(rows: DataFrame, years: list[int], trees: int, least_test: int = 20, least_train: int = 500) -> DataFrame:
    """For each year train on what was sold before it and test on it; thin years are left out by counts. Without a year left, no rows."""
    counts = {r["year_sold"]: r["count"] for r in rows.groupBy("year_sold").count().collect()}
    fit = [y for y in years if counts.get(y, 0) >= least_test and sum(c for z, c in counts.items() if z < y) >= least_train]
    outs = fit_all([(rows.where(F.col("year_sold") < y), rows.where(F.col("year_sold") == y)) for y in fit], trees)
    return reduce(DataFrame.unionByName, outs) if outs else rows.where("false").withColumn("prediction", F.lit(0.0)).withColumn("pred", F.lit(0.0))


def ablation(rows: DataFrame, trees: int, test_year: int = 2021, base: str = "base") -> DataFrame:
    """Errors of the model with all groups, the base alone, the base and each group, and all without each group; a row a variant."""
    more = [g for g in GROUPS if g != base]
    variants = {"all": tuple(GROUPS), base: (base,)} | {f"{base} and {g}": (base, g) for g in more} | {f"without {g}": tuple(x for x in GROUPS if x != g) for g in GROUPS}
    early, late = F.col("year_sold") < test_year, F.col("year_sold") >= test_year
    own = [assembled(rows, groups) for groups in variants.values()]
    found = fit_all([(d.where(early), d.where(late)) for d in own], trees)
    preds = reduce(DataFrame.unionByName, [p.select("price", "pred", F.lit(v).alias("variant")) for v, p in zip(variants, found)])
    return error_metrics(kept(preds, ["variant"]), ["variant"])


def error_metrics(preds: DataFrame, keys: list[str], actual: str = "price", pred: str = "pred") -> DataFrame:
    """MAPE, median APE, shares within 5/10/20 % and median signed bias."""
    d = preds.withColumn("signed", (F.col(pred) - F.col(actual)) / F.col(actual)).withColumn("ape", F.abs("signed"))
    share = lambda x: F.round(F.count_if(F.col("ape") < x) / F.count(F.lit(1)) * 100, 6)
    g = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ape") * 100, 6).alias("mape"), share(0.05).alias("within5"), share(0.10).alias("within10"), share(0.20).alias("within20"))
    mid = group_quantiles(d, keys, "ape", {"m": "median"}, count=None).select(*keys, F.round(F.col("m") * 100, 6).alias("median_ape"))
    bias = group_quantiles(d, keys, "signed", {"b": "median"}, count=None).select(*keys, F.round(F.col("b") * 100, 6).alias("bias"))
    return g.join(mid, keys).join(bias, keys) if keys else g.join(F.broadcast(mid)).join(F.broadcast(bias))


def bias_corrected(preds: DataFrame, actual: str = "price", pred: str = "pred") -> DataFrame:
    """Predictions times 1 / (1 + median signed error); the median is one row."""
    d = preds.withColumn("_s", (F.col(pred) - F.col(actual)) / F.col(actual))
    b = group_quantiles(d, [], "_s", {"_b": "median"}, count=None)
    return d.join(F.broadcast(b)).withColumn(pred, F.col(pred) / (1 + F.col("_b"))).drop("_s", "_b")


def contributions(rows: DataFrame, train: DataFrame, trees: int, neutral: dict[str, dict[str, float]]) -> DataFrame:
    """Change of the prediction when one feature group is set to neutral values; a row's own prediction goes with it to its variants."""
    model = boosting.fit(train, trees)
    vector = VectorAssembler(inputCols=[c for g in GROUPS.values() for c in g], outputCol="features")
    scored = lambda d, name: model.transform(vector.transform(d)).withColumn(name, F.exp("prediction")).drop("features", "prediction")
    variants = scored(rows.drop("features", "label"), "base").withColumn("variant", F.explode(F.array(*[F.lit(v) for v in neutral])))
    for name, values in neutral.items():
        for c, v in values.items():
            variants = variants.withColumn(c, F.when(F.col("variant") == name, F.lit(v)).otherwise(F.col(c)))
    key = ["address_key", "sale_date", "tie1", "tie2", "tie3"]
    return scored(variants, "pred").select(*key, "variant", (F.col("base") - F.col("pred")).alias("delta"))


def knn_estimate(neighbours: DataFrame, rates: DataFrame, as_of, k: int = 20, local: int = 50, tau: float = 4.0, floor: float = FLOOR, least: int = 5, areas: DataFrame | None = None) -> DataFrame:
    """Weighted quarter, half and three-quarter points of time-adjusted price per area of the k nearest sales.

    neighbours: knn_sales rows with subject, place, area, rank, km, c_price, c_area, c_date and the reference date in `as_of`.
    rates(place, rate): yearly growth in percent around the subject's place; without one a price stays as it was. The `local`
    nearest give the median, as sold, under half of which a comparable is dropped. A subject with fewer than `least` neighbours
    has their number and no estimate; one of which all were dropped has none used. Homes with the same neighbours may share them:
    areas(subject, area, _of) then has the homes and the subject of `neighbours` that each goes by.
    """
    raw = neighbours.withColumn("raw", F.col("c_price") / F.col("c_area"))
    mid = group_quantiles(raw.where(F.col("rank") <= local), ["subject"], "raw", {"m": "upper"}, count="m_n")
    n = raw.where(F.col("rank") <= k).join(mid, "subject").join(rates, "place", "left")
    years = F.datediff(as_of, "c_date") / F.lit(DAYS_PER_YEAR)
    n = n.withColumn("ppsf", F.col("raw") * F.pow(1 + F.coalesce("rate", F.lit(0.0)) / 100, years))
    low = F.when(F.col("m_n") >= 10, F.col("m") * floor).otherwise(0.0)
    n = n.where((F.col("ppsf") > 0) & (F.col("ppsf") <= 50000) & (F.col("ppsf") >= low))
    n = n.withColumn("w", 1 / (F.col("km") / 1.609344 + 0.05) * F.exp(-F.greatest(F.lit(0.0), years) / tau))
    q = weighted_quantiles(n, "subject", "ppsf", "w").join(n.groupBy("subject").agg(F.count(F.lit(1)).alias("used")), "subject")
    found = neighbours.groupBy("subject").agg(F.count(F.lit(1)).alias("found"))
    if areas is None:
        areas = neighbours.groupBy("subject").agg(F.max("area").alias("area")).withColumn("_of", F.col("subject"))
    enough = F.col("found") >= least
    est = lambda c: F.when(enough, F.floor(F.col(c) * F.col("area")))
    used = F.when(enough, F.coalesce("used", F.lit(0))).otherwise(F.col("found")).cast("long")
    told = areas.join(found.join(q, "subject", "left").withColumnRenamed("subject", "_of"), "_of")
    return told.select("subject", used.alias("used"), est("q25").alias("low"), est("q50").alias("mid"), est("q75").alias("high"))
