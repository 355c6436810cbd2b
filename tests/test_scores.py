"""Curves, calibration and spatial rules."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from hearthspan.functions import curves, geo, labels
from hearthspan.operators import nearest, scores
from hearthspan.operators.spatial import within_km


def test_calibration_is_monotone_clamped_and_centred(spark):
    seg = scores.monotone_segments(scores.breakpoint_table(spark))
    xs = [x / 4 for x in range(-80, 520)]
    long = spark.createDataFrame([(d, x) for d in scores.BREAKPOINTS for x in xs], "dimension string, raw double")
    got = {}
    for r in scores.calibrate(long, seg).collect():
        got.setdefault(r["dimension"], []).append((r["raw"], r["calibrated"]))
    assert set(got) == set(scores.BREAKPOINTS)
    for rows in got.values():
        ys = [y for _, y in sorted(rows)]
        assert len(ys) == len(xs) and all(a <= b for a, b in zip(ys, ys[1:])) and 5 <= ys[0] and ys[-1] <= 98
    mids = spark.createDataFrame([(d, float(v[scores.PERCENTILES.index(0.5)])) for d, v in scores.BREAKPOINTS.items()], "dimension string, raw double")
    assert {r["calibrated"] for r in scores.calibrate(mids, seg).collect()} == {65.0}


def test_breakpoints_reproduce_their_percentiles(spark):
    seg = scores.monotone_segments(scores.breakpoint_table(spark))
    pts = spark.createDataFrame([(d, float(x), p) for d, v in scores.BREAKPOINTS.items() for x, p in zip(v, scores.PERCENTILES)], "dimension string, raw double, want double")
    assert scores.calibrate(pts, seg).where(F.abs(F.col("percentile") - F.col("want") * 100) > 0.051).count() == 0


def test_tied_breakpoints_rise_by_a_hundredth(spark):
    df = spark.createDataFrame([("d", 5.0)] * 100, "dimension string, raw double")
    xs = [r["x"] for r in scores.new_breakpoints(df).orderBy("y").collect()]
    assert xs == [round(5 + n / 100, 2) for n in range(22)]


def test_phi_and_probit_agree_with_math(spark):
    df = spark.createDataFrame([(z / 10,) for z in range(-35, 36)], "z double")
    for r in df.select("z", curves.phi(F.col("z")).alias("p"), curves.probit(curves.phi(F.col("z"))).alias("back")).collect():
        assert abs(r["p"] - 0.5 * (1 + math.erf(r["z"] / math.sqrt(2)))) < 2e-7 and abs(r["back"] - r["z"]) < 5e-3


def test_grid_reference_worked_example(spark):
    # public worked example of the national grid: 52 39 27.2531 N, 1 43 4.5177 E
    r = spark.range(1).select(geo.grid_to_lonlat(F.lit(651409.903), F.lit(313177.270)).alias("p")).select("p.*").collect()[0]
    assert abs(r["lat"] - (52 + 39 / 60 + 27.2531 / 3600)) < 1e-7 and abs(r["lon"] - (1 + 43 / 60 + 4.5177 / 3600)) < 1e-7


def test_radius_join_equals_brute_force(spark):
    rng = random.Random(2)
    a = [(n, 51.5 + rng.random() / 20, -0.1 + rng.random() / 20) for n in range(150)]
    df = spark.createDataFrame(a, "id int, lat double, lon double")
    right = df.select(F.col("id").alias("r_id"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    got = {(r["id"], r["r_id"]) for r in within_km(df, right, 0.8).collect()}
    want = {(p[0], q[0]) for p in a for q in a if math.hypot((q[1] - p[1]) * 110.574, (q[2] - p[2]) * 111.320 * math.cos(math.radians(p[1]))) <= 0.8}
    assert got == want


def test_nearest_sales_fall_back_to_far_places(spark):
    rng = random.Random(4)
    places = [(f"P{n}", 51.0 + n * 0.05, -0.1) for n in range(12)]
    pool = [(n, *places[rng.randrange(12)], "flat", rng.randrange(1, 4), f"2020-01-{rng.randrange(1, 29):02d}", 100 + n, 50, n, 0, 0) for n in range(90)]
    p = spark.createDataFrame(pool, "address_key int, place string, r_lat double, r_lon double, segment string, beds int, sale_date string, price int, area int, tie1 int, tie2 int, tie3 int")
    s = spark.createDataFrame([(n, *places[n], "flat", 2, 60) for n in range(12)], "subject int, place string, lat double, lon double, segment string, beds int, area int")
    got = {}
    for r in nearest.knn_sales(s, p, 20, rings=(0.5, 8.0, 25_000.0)).collect():
        got.setdefault(r["subject"], set()).add(r["c_tie1"])
    for n, (_, lat, _) in enumerate(places):
        best = sorted((x for x in pool if abs(x[5] - 2) <= 1), key=lambda x: (round(abs(x[2] - lat), 9), x[1], [-ord(c) for c in x[6]], x[5], x[9]))[:20]
        dist = lambda t: round(abs(next(x for x in pool if x[9] == t)[2] - lat), 6)
        # ties between two places at equal distance may go either way in the last bit
        assert sorted(dist(t) for t in got[n]) == sorted(round(abs(x[2] - lat), 6) for x in best)


def square(x, y, half):
    return [[x - half, y - half], [x + half, y - half], [x + half, y + half], [x - half, y + half], [x - half, y - half]]


def test_park_distance_is_zero_inside_and_to_the_edge_outside(spark):
    half = 0.001
    parks = spark.createDataFrame([(1, "Green", [square(-0.12, 51.5, half)])], "park_id long, name string, rings array<array<array<double>>>")
    poly = scores.polygon_rows(parks)
    side_x, side_y = 2 * half * 111320 * math.cos(math.radians(51.5)), 2 * half * 111320
    assert abs(poly.collect()[0]["area_m2"] - side_x * side_y) < 1e-3
    pts = spark.createDataFrame([("in", 51.5, -0.12), ("north", 51.5 + half + 0.002, -0.12), ("far", 51.6, -0.12)], "subject string, lat double, lon double")
    got = {r["subject"]: r["metres"] for r in scores.parks_near(pts, poly).collect()}
    assert got["in"] == 0 and abs(got["north"] - 0.002 * 111320) < 1e-6 and "far" not in got


def test_greedy_dedupe_keeps_the_better_station(spark):
    rows = [("s", 1, 51.5, -0.1, 90.0), ("s", 2, 51.5, -0.1036, 80.0), ("s", 3, 51.5, -0.1072, 70.0), ("t", 4, 51.5, -0.1, 10.0)]
    df = spark.createDataFrame(rows, "subject string, place_id long, r_lat double, r_lon double, score double")
    # 1 drops 2 (250 m); 3 is 500 m from 1 and stays although it is near the dropped 2
    assert sorted(r["place_id"] for r in scores.dedupe_by_distance(df).collect()) == [1, 3, 4]


def test_covering_stations_equal_the_greedy_rule(spark):
    rng = random.Random(9)
    rows = [(s, f"st{n}", rng.random(), rng.sample(["a", "b", "c", "d", "e"], rng.randrange(0, 4))) for s in "xyz" for n in range(8)]
    df = spark.createDataFrame(rows, "subject string, station string, minutes double, lines array<string>")
    got = {(r["subject"], r["station"]) for r in scores.covering_stations(df).collect()}
    want = set()
    for s in "xyz":
        seen, kept = set(), 0
        for r in sorted((r for r in rows if r[0] == s), key=lambda r: r[2]):
            if kept < 3 and set(r[3]) - seen:
                seen |= set(r[3])
                kept += 1
                want.add((s, r[1]))
    assert got == want


def test_address_features(spark):
    cases = {
        "Flat 5, Example Court, 12 High Street": ("5", "EXAMPLE COURT", "12", "HIGH STREET", "FLAT5"), "12, Example Court": ("12", "EXAMPLE COURT", None, None, "FLAT12"),
        "50, Example Road": (None, None, "50", "EXAMPLE ROAD", "50"), "7A Mill Lane, London": (None, None, "7A", "MILL LANE", "7A"), "The Cottage": (None, None, None, None, None),
    }
    df = labels.with_address_features(spark.createDataFrame([(c,) for c in cases], "a string"), "a", "f")
    for r in df.collect():
        assert (*r["f"], r["f_key"]) == cases[r["a"]], r["a"]


def test_room_area_tiers(spark):
    cases = {
        "Bedroom 12.5 sq m": (135, 1, "exact", None), "Kitchen 3.00m x 4.00m": (129, 2, "rectangular", 4.0), "Lounge 3.00m x 4.00m max": (106, 3, "irregular", 4.0),
        "Room 10'0\" x 12'6\"": (125, 2, "rectangular", 3.81), "Hall": None,
    }
    df = spark.createDataFrame([(c,) for c in cases], "t string").select("t", labels.room_area(F.col("t")).alias("r"))
    for r in df.collect():
        want = cases[r["t"]]
        assert (r["r"] is None) if want is None else (r["r"]["area_sqft"], r["r"]["tier"], r["r"]["shape"], r["r"]["long_edge_m"]) == want, r


def test_hashed_search_finds_most_of_the_exact_neighbours(spark, root):
    from hearthspan.operators import vectors

    e = spark.read.parquet(f"{root}/embeddings.parquet")
    q = vectors.sample_queries(e, 30, "t")
    exact = vectors.top_k_exact(e, q, 5, shard_rows=70)
    m = np.array([r["embedding"] for r in e.orderBy("vec_id").collect()], dtype=float)
    ids = [r["vec_id"] for r in e.orderBy("vec_id").collect()]
    for r in q.collect():
        s = m @ m[ids.index(r["vec_id"])]
        want = {ids[j] for j in sorted(range(len(ids)), key=lambda j: (-s[j], ids[j]))[:5]}
        assert {x["vec_id"] for x in exact.where(F.col("query_id") == r["vec_id"]).collect()} == want
        break
    assert vectors.recall_at_k(exact, vectors.top_k_hashed(e, q, 5), 5).collect()[0]["mean"] > 0.6


def test_own_address_does_not_hide_the_next_place(spark):
    """Two own sales under each of two bedroom counts; the neighbours are in another place 111 m away."""
    import datetime

    day = datetime.date(2020, 1, 1)
    own = [(1, "A", 51.5, 0.0, "flat", b, day, 100 + n, 50, n, 0, 0) for b in (2, 3) for n in (1, 2)]
    other = [(2, "B", 51.501, 0.0, "flat", 2, day, 200 + n, 50, n, 0, 0) for n in (1, 2, 3)]
    pool = spark.createDataFrame(own + other, "address_key long, place string, r_lat double, r_lon double, segment string, beds long, sale_date date, price long, area long, tie1 long, tie2 long, tie3 long")
    subject = spark.createDataFrame([(7, "A", 51.5, 0.0, "flat", 2, 1)], "subject long, place string, lat double, lon double, segment string, beds long, address_key long")
    got = nearest.knn_sales(subject, pool, 2, own=True).collect()
    assert len(got) == 2 and {r["c_place"] for r in got} == {"B"}


def test_purchase_tax_rounds_half_to_even(spark):
    from hearthspan.functions import money

    p = spark.createDataFrame([(125025,), (125075,), (250000,)], "p long")
    assert [r[0] for r in p.select(money.banded(F.col("p"), money.STANDARD)).collect()] == [0.0, 2.0, 2500.0]


def test_generic_names_go_and_others_stay(spark):
    from hearthspan.plans.joins import named_subjects

    names = ["THE HOUSE", "THE LODGE", "THE OLD HOUSE", "HOUSE", "SHIPBUILDING WAY", "COURT OF THE ÉTOILE", "BATHE ROAD"]
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    assert [r[0] for r in named_subjects(rows, "name", "the").collect()] == ["THE OLD HOUSE", "COURT OF THE ÉTOILE"]


def test_all_through_schools_count_for_both_stages(spark):
    points = spark.createDataFrame([("p", 51.5, 0.0)], "subject string, lat double, lon double")
    school = lambda phase: spark.createDataFrame([(51.5001, 0.0, 2, phase)], "r_lat double, r_lon double, ofsted int, phase string")
    got = {p: scores.school_score(points, school(p)).first()["score"] for p in ("primary", "all-through", "nursery")}
    assert round(got["all-through"] - got["primary"], 6) == 3.0 and round(got["primary"] - got["nursery"], 6) == 3.0


def test_only_a_running_catch_up_is_exempt(spark):
    from hearthspan.operators import monitor

    runs = spark.createDataFrame([("a", 100, "dispatched", 1, '{"mode": "catchup"}'), ("b", 100, "dispatched", 2, '{"mode": "daily"}'), ("c", 100, "completed", 3, '{"mode": "catchup"}'), ("d", 100, "dispatched", 4, "no json")],
                                 "job string, at_s long, status string, run_id long, summary string")
    budgets = spark.createDataFrame([(j, 60) for j in "abcd"], "job string, budget_s long")
    assert {r["job"]: r["stale"] for r in monitor.stale_jobs(runs, budgets, 1000).collect()} == {"a": 0, "b": 1, "c": 1, "d": 1}
