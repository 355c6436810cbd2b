"""Affordable prices at the edge of the funds."""

from pyspark.sql import functions as F

from hearthspan.functions import money


def test_a_price_that_just_fits_is_found(spark):
    # 1,499,980 + tax 93,748 + 21,000 of costs is the whole of the funds
    rows = spark.createDataFrame([(1_614_728,)], "funds long")
    got = rows.select(money.max_affordable(F.col("funds"), F.lit(False)).alias("a"), money.max_affordable(F.col("funds"), F.lit(True)).alias("b")).first()
    assert tuple(got) == (1_499_980, 1_499_980)
