"""Parks of one shape are measured once and all of them are listed."""

from pyspark.sql import functions as F

from hearthspan.operators import scores


def test_parks_of_one_shape_are_measured_once(spark):
    ring = [[-0.121, 51.5], [-0.12, 51.5], [-0.12, 51.501], [-0.121, 51.501], [-0.121, 51.5]]
    rows = [(n, f"park {n}", [ring]) for n in range(40)] + [(99, "far", [[[x + 0.005, y] for x, y in ring]])]
    parks = scores.polygon_rows(spark.createDataFrame(rows, "park_id long, name string, rings array<array<array<double>>>"))
    points = spark.createDataFrame([("in", 51.5005, -0.1205), ("out", 51.5005, -0.3)], "subject string, lat double, lon double")
    near = scores.parks_near(points, parks)
    got = {(r.subject, r.park_id, r.name, r.metres > 0) for r in near.collect()}
    assert got == {("in", n, f"park {n}", False) for n in range(40)} | {("in", 99, "far", True)}
    # what is left to do lists parks beside measured shapes: no edge is looked at again
    assert "array_min(" not in near._jdf.queryExecution().optimizedPlan().toString()
    assert near.agg(F.count(F.lit(1))).first()[0] == 41
