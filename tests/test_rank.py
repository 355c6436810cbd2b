"""Order statistics and running totals against plain Python."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from hearthspan.functions import rank
from hearthspan.operators.nearest import neighbourhood_upper_median, weighted_quantiles


def hot_rows(spark, n=3000):
    rng = random.Random(5)
    # one group holds most rows; negatives, repeats and a null key are in
    data = [("hot" if rng.random() < 0.6 else rng.choice(["a", "b", None]), round(rng.gauss(0, 50), rng.choice([0, 3]))) for _ in range(n)]
    return data, spark.createDataFrame(data, "k string, v double")


def test_group_quantiles_match_sorted_lists(spark):
    data, df = hot_rows(spark)
    got = {r["k"]: r for r in rank.group_quantiles(df, ["k"], "v", {
        "med": "median", "up": "upper", "p9": ("index", 0.9), "q25": ("interp", 0.25), "lo": "min", "hi": "max", "avg": "mean"}).collect()}
    for key in {k for k, _ in data}:
        v = sorted(x for k, x in data if k == key)
        r, n = got[key], len(v)
        assert r["n"] == n and r["lo"] == v[0] and r["hi"] == v[-1]
        assert r["med"] == np.median(v) and r["up"] == v[n // 2] and r["p9"] == v[min(int(n * 0.9), n - 1)]
        assert abs(r["q25"] - np.quantile(v, 0.25)) < 1e-9 and abs(r["avg"] - np.mean(v)) < 1e-9


def test_group_quantiles_without_keys_and_with_nulls(spark):
    df = spark.createDataFrame([(None,), (3.0,), (1.0,)], "v double")
    assert rank.group_quantiles(df, [], "v", {"med": "median"}).collect()[0].asDict() == {"n": 2, "med": 2.0}
    assert rank.group_quantiles(df.where("v > 9"), [], "v", {"med": "median"}).count() == 0


def test_tally_before_gives_ranks(spark):
    data, df = hot_rows(spark, 800)
    for r in rank.tally_before(df.where("k = 'hot'"), ["k"], "v").collect():
        v = [x for k, x in data if k == "hot"]
        assert (r["own"], r["below"], r["total"]) == (v.count(r["v"]), sum(x < r["v"] for x in v), len(v))


def test_previous_row_is_the_same_however_hot_the_key(spark):
    rng = random.Random(1)
    day = dt.date(2000, 1, 1)
    data = [(rng.choice(["a", "a", "a", "b", None]), day + dt.timedelta(days=rng.randrange(900)), i) for i in range(400)]
    df = spark.createDataFrame(data, "k string, d date, i int")
    plain = rank.with_previous(df, ["k"], ["d", "i"], ["i"], ordinal="no")
    cut = rank.with_previous(df, ["k"], ["d", "i"], ["i"], ordinal="no", most=120)
    assert sorted(map(str, plain.collect())) == sorted(map(str, cut.collect()))
    rows = sorted(r for r in data if r[0] == "a")
    got = {r["i"]: (r["prev_i"], r["no"]) for r in cut.where("k = 'a'").collect()}
    assert all(got[r[2]] == (rows[n - 1][2] if n else None, n + 1) for n, r in enumerate(rows))


def test_weighted_quantiles(spark):
    df = spark.createDataFrame([("x", 1.0, 1.0), ("x", 2.0, 1.0), ("x", 3.0, 6.0), ("y", 5.0, 2.0)], "k string, v double, w double")
    got = {r["k"]: (r["q25"], r["q50"], r["q75"]) for r in weighted_quantiles(df, "k", "v", "w").collect()}
    assert got == {"x": (2.0, 3.0, 3.0), "y": (5.0, 5.0, 5.0)}


def test_neighbourhood_median_equals_brute_force(spark):
    rng = random.Random(3)
    vals = [(rng.choice("pqrs"), round(rng.uniform(-20, 30), 2)) for _ in range(500)]
    near = [("A", "p"), ("A", "q"), ("B", "r"), ("B", "s"), ("B", "p"), ("C", "zz")]
    got = {r["subject"]: (r["n"], r["mid"]) for r in neighbourhood_upper_median(
        spark.createDataFrame(vals, "place string, v double"), spark.createDataFrame(near, "subject string, place string"), 30).collect()}
    for s in "AB":
        v = sorted(x for p, x in vals if (s, p) in near)
        assert got[s] == (len(v), v[len(v) // 2])
    assert "C" not in got


def test_newest_and_first_k(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, t int, v string")
    assert {r["k"]: r["v"] for r in rank.newest(df, ["k"], ["t"]).collect()} == {"a": "y", "b": "z"}
    assert {r["k"]: r["v"] for r in rank.newest(df, ["k"], ["t"], oldest=True).collect()} == {"a": "x", "b": "z"}
    assert rank.first_k(df, ["k"], [F.desc("t")], 1).count() == 2


def test_slabs_of_fractions_stay_narrow(spark):
    d = spark.range(200_000).select((F.pmod(F.xxhash64("id"), F.lit(1_000_000)) / 20_000_000).alias("v"))
    slabs = d.select(rank.value_slab(F.col("v")).alias("s")).groupBy("s").count()
    assert slabs.agg(F.max("count")).first()[0] < 0.05 * 200_000
    order = spark.createDataFrame([(-5.0,), (-0.5,), (-1e-20,), (0.0,), (1e-20,), (1e-9,), (0.3,), (7.0,), (1e12,)], "v double").select(rank.value_slab(F.col("v"))).collect()
    assert [r[0] for r in order] == sorted(r[0] for r in order)
