"""The greedy distance rule against taking the stations in order, and its work on crowded places."""

import math
import random

from pyspark.sql import functions as F

from hearthspan.operators import scores

SCHEMA = "subject string, place_id long, r_lat double, r_lon double, score double"


def far(a, b):
    la, lo, lb, lp = (math.radians(x) for x in (a[2], a[3], b[2], b[3]))
    return 2 * 6371 * math.asin(math.sqrt(math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2))


def written(spark):
    """Rows that all stages so far have written to shuffles."""
    gateway = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return sum(stages.apply(n).shuffleWriteRecords() for n in range(stages.size()))


def test_dedupe_takes_stations_in_order(spark):
    rng = random.Random(4)
    spots = [(51.5 + rng.random() * 0.02, -0.2 + rng.random() * 0.03) for _ in range(60)]
    rows = [(s, n, *rng.choice(spots), float(rng.randrange(6))) for s in "xy" for n in range(200)]
    want = set()
    for s in "xy":
        kept = []
        for r in sorted((r for r in rows if r[0] == s), key=lambda r: (-r[4], r[1])):
            if all(far(r, k) >= 0.4 for k in kept):
                kept.append(r)
        want |= {(s, r[1]) for r in kept}
    got = {(r.subject, r.place_id) for r in scores.dedupe_by_distance(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want


def test_stations_of_one_place_are_not_paired(spark):
    n = 2000
    jitter = (F.pmod(F.xxhash64("id"), F.lit(1000)) * 1e-7)
    rows = spark.range(n).select(F.lit("x").alias("subject"), F.col("id").alias("place_id"), (jitter + 51.5).alias("r_lat"), F.lit(-0.2).alias("r_lon"), F.col("id").cast("double").alias("score"))
    before = written(spark)
    assert [r.place_id for r in scores.dedupe_by_distance(rows).collect()] == [n - 1]
    assert written(spark) - before < 20 * n
