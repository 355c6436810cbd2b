"""Models asked for together equal those fitted alone, and share their jobs."""

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from hearthspan.operators import boosting, valuation


def made(spark):
    df = spark.range(3000).selectExpr("id", "double(id % 7) AS a", "double(pmod(hash(id), 1000)) AS b").withColumn("label", F.col("a") + F.col("b") / 100)
    return VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)


def test_together_is_as_alone(spark):
    trains = [made(spark).where("id % 3 <> 0"), made(spark).where("id % 3 <> 1")]
    alone = [boosting.fit(t, 6) for t in trains]
    with boosting.together(trains):
        both = [boosting.fit(t, 6) for t in trains]
    for one, other in zip(alone, both):
        for (_, f, b, leaves), (_, g, c, ends) in zip(one.trees, other.trees):
            assert (f == g).all() and (b == c).all() and np.allclose(leaves, ends)


def test_first_tree_is_the_best_of_all_splits(spark):
    rows = made(spark).toPandas()
    model = boosting.fit(made(spark), 1, depth=1, share=1.0)
    y, best = rows.label.to_numpy(), None
    for f, c in enumerate(("a", "b")):
        for k, cut in enumerate(model.cuts[f]):
            low = rows[c].to_numpy() <= cut
            loss = y[low].var() * low.sum() + y[~low].var() * (~low).sum()
            best = min(best or (loss, f, k), (loss, f, k))
    _, feature, most, leaves = model.trees[0]
    assert (feature[0], most[0]) == best[1:]
    low = rows[("a", "b")[feature[0]]].to_numpy() <= model.cuts[feature[0]][most[0]]
    assert np.allclose(leaves, [y[low].mean(), y[~low].mean()])


def test_fits_of_folds_share_their_jobs(spark):
    sc = spark.sparkContext
    rows = made(spark).withColumnRenamed("id", "address_key").withColumn("year_sold", F.lit(2021)).withColumn("price", F.exp("label")).localCheckpoint()
    sc.setJobGroup("folds", "folds")
    valuation.group_folds(rows, 4)
    jobs = len(sc.statusTracker().getJobIdsForGroup("folds"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs <= 4 * 4 + 3  # a level of all five models is one job


def test_few_rows_grow_in_one_job_and_as_the_spread_do(spark, monkeypatch):
    sc = spark.sparkContext
    trains = [made(spark).where("id % 3 <> 0").localCheckpoint(), made(spark).where("id % 3 <> 1").localCheckpoint()]
    sc.setJobGroup("few", "few")
    few = boosting.fit_together(trains, 6, 4, 0.05, 0.8)
    jobs = len(sc.statusTracker().getJobIdsForGroup("few"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs <= 4  # ends, tallies and all trees; it was a job a level
    for most in (0, 2000):  # none alone; all alone
        monkeypatch.setattr(boosting, "ALONE", most)
        for one, other in zip(few, boosting.fit_together(trains, 6, 4, 0.05, 0.8)):
            for (_, f, b, leaves), (_, g, c, ends) in zip(one.trees, other.trees, strict=True):
                assert (f == g).all() and (b == c).all() and np.allclose(leaves, ends)


def test_rows_in_files_and_spread_rows_grow_as_those_alone(spark, monkeypatch):
    sc = spark.sparkContext
    trains = [made(spark).where("id % 3 <> 0").localCheckpoint(), made(spark).where("id % 3 <> 1").localCheckpoint()]
    alone = boosting.fit_together(trains, 6, 4, 0.05, 0.8)
    monkeypatch.setattr(boosting, "ALONE", 0)
    sc.setJobGroup("filed", "filed")
    filed = boosting.fit_together(trains, 6, 4, 0.05, 0.8)
    jobs = len(sc.statusTracker().getJobIdsForGroup("filed"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 6 * 4 + 5  # a level of both is one job
    monkeypatch.setattr(boosting, "FILED", 100)  # many parts
    parted = boosting.fit_together(trains, 6, 4, 0.05, 0.8)
    monkeypatch.setattr(boosting, "_plain", lambda sc: None)
    for found in (filed, parted, boosting.fit_together(trains, 6, 4, 0.05, 0.8)):
        for one, other in zip(alone, found):
            for (_, f, b, leaves), (_, g, c, ends) in zip(one.trees, other.trees, strict=True):
                assert (f == g).all() and (b == c).all() and np.allclose(leaves, ends)


def test_a_level_may_run_again(tmp_path):
    rng = np.random.default_rng(3)
    layout = boosting._Layout([8, 5], 2)
    codes = layout.codes([rng.integers(0, 8, 500), rng.integers(0, 5, 500)])
    files = boosting._Files(str(tmp_path / "m"))
    files.put(codes=codes, left0=rng.normal(size=500), draw=rng.integers(0, 2**32, 500, dtype=np.uint32))
    rows, last = boosting._Rows(codes, files.get("left0", False), files.get("draw")), None
    for t in range(3):

        def level(splits, lesser):
            want = rows.histogram(layout, t, splits[0], lesser[0], 0.8)
            for _ in range(2):
                assert np.allclose(files.histogram(layout, t, splits[0], lesser[0], 0.8, last), want)
            return {0: want}

        _, moved = boosting._tree({0: layout}, 2, 0.5, level)
        last = moved[0]
        rows.advance(layout, t, *last, 0.8)


def test_many_models_of_many_rows_grow_in_one_job(spark):
    rows = {m: 13_000_000 for m in range(5)}
    assert boosting._groups(rows, 8, "/x") == [(boosting._alone, list(rows))]  # they were spread, a job a level
    assert boosting._groups(rows, 12, "/x") == [(boosting._filed, list(rows))] and boosting._groups(rows, 12, None) == [(boosting._spread, list(rows))]
    assert boosting._groups({0: 80_000_000, 1: 2_000_000}, 12, "/x") == [(boosting._filed, [0]), (boosting._alone, [1])]


def test_predictions_follow_every_tree(spark):
    model = boosting.fit(made(spark), 8)
    x = np.array(made(spark).select("a", "b").limit(200).collect())
    want = np.zeros(len(x))
    for weight, feature, most, leaves in model.trees:
        for r, row in enumerate(x):
            node = 0
            for d in range(model.depth):
                own = node + (1 << d) - 1
                node = 2 * node + int((model.cuts[feature[own]] < row[feature[own]]).sum() > most[own])
            want[r] += weight * leaves[node]
    assert np.allclose(model.predict(x), want)


def test_contributions_are_of_the_row_itself(spark):
    zero = {c: F.lit(0.0) for g in valuation.GROUPS.values() for c in g}
    d = spark.range(400).withColumns(zero | {"bedrooms": F.col("id") % 5, "is_leasehold": F.col("id") % 2, "label": F.col("id") % 5 + 5.0 + F.col("id") % 2})
    d = valuation.assembled(d.withColumns({"address_key": F.lit(1), "sale_date": F.lit("x"), "tie1": F.lit(None).cast("long"), "tie2": F.lit(1), "tie3": F.lit(1)}))
    got = valuation.contributions(d, d, 40, {"tenure": {"is_leasehold": 0}}).collect()
    assert len(got) == 400  # rows of one key, or of a key with a null, too
    assert sum(abs(r.delta) < 1e-9 for r in got) == 200 and all(r.delta > -1e-9 for r in got)  # nothing changes where it was 0


def test_predictions_are_made_once(spark):
    rows = made(spark).withColumn("price", F.exp("label")).withColumn("pred", F.exp("label") * 1.1).withColumn("fold", F.col("id") % 2)
    found = valuation.error_metrics(valuation.kept(valuation.fit_predict(rows, rows, 2), ["fold"]), ["fold"])
    assert "ArrowEvalPython" not in found._jdf.queryExecution().toString() and found.count() == 2
