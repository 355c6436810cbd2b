"""Stateful folds against plain Python, and evaluation splits."""

import random

from pyspark.sql import functions as F

from hearthspan.operators import valuation
from hearthspan.plans.base import Inputs
from hearthspan.plans.streams import ending, stream
from hearthspan.streaming import jobs, stateful

BASE = 1704067200


def played(spark, root, df, job, key="q"):
    """The rows of a job over a stream whose last row, of another key, lets all others be judged."""
    rows_in, steps = stream(Inputs(spark, root), ending(df, key))
    with stateful.rocksdb(spark):
        return jobs.run_and_read(job(rows_in), "append", arrivals=steps).where(f"{key} >= 0").collect()


def test_stall_counter(spark, root):
    rng = random.Random(6)
    rows, size, done = [], 0, 0
    for n in range(60):
        size = 0 if rng.random() < 0.1 else size + rng.choice([0, 5, 20])
        done += rng.random() < 0.2
        rows.append((1, BASE + n * 43200, size, done))
    want, last, n = [], (None, None), 0
    for _, at, s, d in rows:
        if last[0] is None or s < last[0] or d != last[1]:
            n = 0
        elif s - last[0] >= 10:
            n += 1
        last = (s, d)
        want.append((at, n))
    rng.shuffle(rows)
    got = played(spark, root, spark.createDataFrame(rows, "q long, at_s long, size_n long, done_n long"), lambda d: stateful.stall_counter(d, "q", 10))
    assert sorted((r["at_s"], r["stalled"]) for r in got) == want and max(x for _, x in want) >= 2


def test_fix_budget_escalates_once_and_recovers_on_the_next_tick(spark, root):
    ticks = [(0, 1), (60, 1), (120, 1), (180, 0), (240, 0), (5000, 1), (5060, 0), (5120, 1), (5120, 0), (9999, 0)]
    df = spark.createDataFrame([(1, BASE + t, f) for t, f in ticks], "q long, at_s long, faulty int")
    got = played(spark, root, df, lambda d: stateful.fix_budget(d, "q", 1800, 1))
    assert sorted((r["at_s"] - BASE, r["verdict"]) for r in got) == [
        (0, "fix"), (60, "escalate"), (180, "recover-after-escalation"), (5000, "fix"), (5060, "recover"), (5120, "escalate"), (9999, "recover-after-escalation")]


def test_heartbeat_has_own_budgets_and_looks_through_the_lead(spark, root):
    lead, twin, far = (1, 10, stateful.LEAD, 600), (1, 11, stateful.REPLACED, 600), (1, 12, stateful.THROUGH, 900)
    at = {lead: [0, 500, 5000, 5500], twin: [0, 300, 5200], far: [0, 400, 800, 2000, 2800, 5300]}
    df = spark.createDataFrame([(*h, BASE + t) for h, times in at.items() for t in times], "site long, host long, role int, budget long, at_s long")
    got = played(spark, root, df, lambda d: stateful.heartbeat(d, "site", "0 seconds"), "site")
    seen = sorted((r["at_s"] - BASE, r["host"], r["state"]) for r in got if r["at_s"] < BASE + 5800)
    # at 900 the twin is down, at 1100 the lead, whose alert stands for it; the far host's silence of 1700 to 2000 is not seen
    # through a dark lead, nor is that from 3700 on, until the lead is back at 5000
    assert seen == [(900, 11, "down"), (1100, 10, "down"), (5000, 10, "up"), (5000, 11, "down"), (5000, 12, "down"), (5200, 11, "up"), (5300, 12, "up")]


def test_cover_is_the_same_in_any_order():
    rng = random.Random(2)
    times = [rng.randrange(5000) for _ in range(80)]
    found = set()
    for _ in range(20):
        rng.shuffle(times)
        lo, hi = [], []
        for t in times:
            stateful.cover(lo, hi, t, 40)
        found.add((tuple(lo), tuple(hi)))
    times.sort()
    starts = [t for n, t in enumerate(times) if not n or t - times[n - 1] > 40]
    ends = [t + 40 for n, t in enumerate(times) if n == len(times) - 1 or times[n + 1] - t > 40]
    assert found == {(tuple(starts), tuple(ends))}


def test_walk_forward_trains_on_the_past_only(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(valuation, "fit_predict", lambda train, test, trees: calls.append((train, test)) or test)
    df = spark.createDataFrame([(y, n) for y in range(2017, 2022) for n in range(300)], "year_sold int, n int")
    valuation.walk_forward(df, [2018, 2020, 2021, 2030], 1)
    assert len(calls) == 2
    for train, test in calls:
        assert train.agg(F.max("year_sold")).first()[0] < test.agg(F.min("year_sold")).first()[0]


def test_folds_never_share_a_property(spark, monkeypatch):
    pairs = []
    monkeypatch.setattr(valuation, "fit_predict", lambda train, test, trees: pairs.append((train, test)) or test)
    df = spark.createDataFrame([(n % 40, 2021) for n in range(200)], "address_key long, year_sold int")
    got = valuation.group_folds(df, 1)
    assert got.count() == 200 and len(pairs) == 5
    assert all(a.join(b, "address_key", "left_semi").count() == 0 for a, b in pairs)


def test_registered_fits_are_whole(spark, root, monkeypatch):
    from hearthspan.plans import load

    found, _ = load()
    trees, seen = [], []
    names = {c: "double" for g in valuation.GROUPS.values() for c in g} | {"year_sold": "int"}
    df = spark.range(1300).selectExpr("id AS address_key", "cast(2010 + id % 13 as int) AS year_sold", "'2020-01-01' AS sale_date", "0 AS tie1", "0 AS tie2", "0 AS tie3", "1.0D AS price", "1.0D AS pred", "1.0D AS label", *[f"1.0D AS {c}" for c in names if c != "year_sold"])
    monkeypatch.setattr(valuation, "training_rows", lambda sales: df)
    monkeypatch.setattr(valuation, "assembled", lambda rows, groups=tuple(valuation.GROUPS): seen.append(tuple(groups)) or rows)
    monkeypatch.setattr(valuation, "fit_predict", lambda train, test, n: trees.append(n) or test)
    monkeypatch.setattr(valuation, "contributions", lambda rows, train, n, neutral: trees.append(n) or rows.selectExpr("'x' AS variant", "0 AS delta"))
    for key in ("valuation_gbt", "eval_group_kfold", "eval_walk_forward", "counterfactual_contrib"):
        found[key](Inputs(spark, root))
    seen.clear()
    labels = {r.variant for r in found["eval_ablation"](Inputs(spark, root)).select("variant").collect()}
    names = tuple(valuation.GROUPS)
    want = {names, ("base",)} | {("base", g) for g in names[1:]} | {tuple(x for x in names if x != g) for g in names}
    assert set(seen) == want and len(seen) == len(labels) == len(want)
    assert len(trees) == 1 + 5 + 7 + 1 + len(want) and set(trees) == {400}


def tiny(spark):
    """Prices that one split explains: homes of one room cost 100, of two 400; each home is sold in several years."""
    base = {c: 0.0 for g in valuation.GROUPS.values() for c in g}
    rows = [{**base, "address_key": a, "year_sold": y, "bedrooms": float(a % 2), "price": 400.0 if a % 2 else 100.0} for a in range(60) for y in range(2012, 2023)]
    df = spark.createDataFrame(rows)
    return df.withColumn("year_sold", F.col("year_sold").cast("int")).withColumn("label", F.log("price"))


def test_small_fits_give_the_values_that_trees_must(spark):
    rows = valuation.assembled(tiny(spark))
    folds = valuation.group_folds(rows, 3).select("price", "pred", "fold").collect()
    assert len(folds) == 60 * 3 and {r.fold for r in folds} == set(range(5)) and all(abs(r.pred - r.price) < 1e-6 for r in folds)
    walked = valuation.error_metrics(valuation.walk_forward(rows, [2011, 2021, 2022], 3, least_train=100), ["year_sold"]).collect()
    assert {(r.year_sold, r.n, r.mape, r.bias) for r in walked} == {(2021, 60, 0.0, 0.0), (2022, 60, 0.0, 0.0)}
    # without the rooms there is nothing to tell homes apart by: every one gets the mean of the logarithms, 200
    blind = valuation.group_folds(valuation.assembled(tiny(spark), ("tenure",)), 3).collect()
    assert all(150 < r.pred < 270 for r in blind) and len({round(r.pred, 6) for r in blind}) <= 5
    errors = {r.variant: r for r in valuation.ablation(tiny(spark), 3).collect()}
    assert errors["all"].mape == 0 and errors["base and tenure"].mape == 0 and errors["without base"].mape > 50
    assert valuation.walk_forward(rows, [1999], 3).count() == 0
