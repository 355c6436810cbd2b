"""Small hand-checked ledgers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hearthspan.operators import listings, market, sales

SALES = "address_key long, sale_date date, price long, category string, property_type string, postcode string, outcode string, sector string, tie1 long, tie2 long, tie3 long"


def ledger(spark, rows):
    full = [(a, dt.date.fromisoformat(d), p, c, t, "N1 1AA", "N1", "N1 1", n, 0, 0) for n, (a, d, p, c, t) in enumerate(rows)]
    return spark.createDataFrame(full, SALES)


def test_pairing_runs_over_all_sales_and_then_drops_b_legs(spark):
    df = ledger(spark, [(1, "2010-01-01", 100, "A", "F"), (1, "2012-01-01", 60, "B", "F"), (1, "2014-01-01", 200, "A", "F"), (1, "2018-01-01", 300, "A", "F")])
    got = sales.repeat_sales(df).collect()
    # A-B and B-A go; nothing is stitched across the removed sale
    assert [(r["prev_price"], r["price"]) for r in got] == [(200, 300)]
    assert got[0]["years_held"] == 4.0 and got[0]["annual_return"] == 10.67


def test_short_holds_go_and_rates_are_clamped(spark):
    df = ledger(spark, [(1, "2010-01-01", 100, "A", "F"), (1, "2010-02-01", 110, "A", "F"), (2, "2010-01-01", 100, "A", "F"), (2, "2011-01-01", 900, "A", "F")])
    assert [(r["address_key"], r["annual_return"]) for r in sales.repeat_sales(df).collect()] == [(2, 100.0)]


def test_growth_is_weighted_by_hold_and_windowed_by_sale_year(spark):
    rows = [("x", 2.0, 10.0, 2021), ("x", 8.0, 5.0, 2021), ("x", 1.0, 50.0, 2015)]
    df = spark.createDataFrame([(k, h, r, dt.date(y, 6, 1)) for k, h, r, y in rows], "k string, years_held double, annual_return double, sale_date date")
    r = sales.area_growth(df, ["k"], 2022).collect()[0]
    assert r["cagr_3y"] == 6.0 and r["cagr_3y_count"] == 2 and r["direction"] == "up" and r["sample_count"] == 3
    assert abs(r["cagr_10y"] - (20 + 40 + 50) / 11) < 1e-12


def test_b_sales_do_not_crowd_out_comparables(spark):
    rows = [(n, f"2022-05-{n + 1:02d}", 900 + n, "B", "F") for n in range(20)] + [(50 + n, f"2021-01-{n + 1:02d}", 100 + n, "A", "F") for n in range(4)]
    subject = spark.createDataFrame([(1, "N1 1AA", "N1", "N1 1", 110, ["F"])], "subject_id long, postcode string, outcode string, sector string, asking_price long, type_codes array<string>")
    r = sales.comparable_report(ledger(spark, rows), subject, "2022-06-01", 10).collect()[0]
    assert (r["n"], r["low"], r["high"], r["median_price"], r["b_count"]) == (4, 100, 103, 101, 20)


def test_missing_type_widens_to_all_types(spark):
    rows = [(n, f"2021-01-{n + 1:02d}", 100 + n, "A", "D") for n in range(3)]
    subject = spark.createDataFrame([(1, "N1 1ZZ", "N1", "N1 1", 110, ["F"])], "subject_id long, postcode string, outcode string, sector string, asking_price long, type_codes array<string>")
    got = sales.comparables(ledger(spark, rows), subject, "2022-06-01").collect()
    assert [r["price"] for r in sorted(got, key=lambda r: r["rank"])] == [102, 101, 100] and got[0]["any_hit"] == 0


def monthly(spark, counts, price=lambda m: 100):
    rows, n = [], 0
    for m, c in enumerate(counts):
        day = dt.date(2000 + m // 12, m % 12 + 1, 10)
        for _ in range(c):
            rows.append((n, day, price(m), "A", "F", "N1 1AA", "N1", "N1 1", n, 0, 0))
            n += 1
    return spark.createDataFrame(rows, SALES)


def test_flat_months_are_clean_and_a_spike_is_named(spark):
    flat = market.month_quality(monthly(spark, [10] * 40))
    assert flat.where("is_distorted = 1").count() == 0
    spiked = market.month_quality(monthly(spark, [10] * 20 + [30] + [10] * 19)).where("is_distorted = 1").collect()
    assert [(r["ym"], r["reason"], r["ratio"]) for r in spiked] == [("2001-09", "volume_spike", 3.0)]


def test_thin_last_month_is_incomplete_filing_not_a_crash(spark):
    got = market.month_quality(monthly(spark, [10] * 39 + [3])).where("is_distorted = 1").collect()
    assert [(r["reason"], r["pos"]) for r in got] == [("incomplete_filing", 40)]


def test_trend_does_not_leak_into_seasonality_and_seasons_are_found(spark):
    trend = monthly(spark, [5] * 60, lambda m: 1000 + 10 * m)
    flat = market.seasonality(trend, market.month_quality(trend), 1)
    assert all(abs(r["price_index"] - 1) < 0.01 for r in flat.collect())
    summer = monthly(spark, [5] * 60, lambda m: 1300 if m % 12 == 6 else 1000)
    july = market.seasonality(summer, market.month_quality(summer), 1).where("month = 7 AND property_type = 'ALL'").collect()
    assert july[0]["price_index"] == 1.3


def test_market_pair_rules(spark):
    cases = [
        (60_000, 90_000, "2012-01-01", "2016-01-01", True), (40_000, 90_000, "2012-01-01", "2020-01-01", False), (100_000, 190_000, "2012-01-01", "2015-01-01", False),
        (35_000, 60_000, "1996-01-01", "2000-01-01", True), (10_000, 60_000, "1996-01-01", "2000-01-01", False),
    ]
    rows = [(a, b, dt.date.fromisoformat(x), dt.date.fromisoformat(y), (b - a) / a * 100, (dt.date.fromisoformat(y) - dt.date.fromisoformat(x)).days / 365.25, w) for a, b, x, y, w in cases]
    df = spark.createDataFrame(rows, "first_price long, last_price long, first_date date, last_date date, pct_change double, hold_years double, want boolean")
    assert df.where(sales.is_market_pair() != F.col("want")).count() == 0


def test_bad_conditions_are_errors(spark):
    df = spark.createDataFrame([(1, "flat")], "id long, property_type string")
    for conds in ([], [{"type": "nope", "value": 1}], [{"type": "price"}], [{"type": "station_walk", "max_minutes": 90}], [{"type": "council_tax", "max": "Z"}], [{"type": "prior_sale", "value": 1}]):
        with pytest.raises(ValueError):
            listings.listing_match(df, conds, {}, "2024-01-01")


def test_relisted_cases(spark):
    d = dt.date.fromisoformat
    rows = [(1, 7, 100, None, d("2024-03-01")), (2, 7, 90, d("2024-01-01"), None), (3, 8, 100, None, d("2024-03-01")), (4, 8, 300, d("2024-01-01"), None), (5, 9, 100, None, d("2024-03-01")), (6, 9, 100, d("2024-05-01"), None)]
    lst = spark.createDataFrame(rows, "id long, delivery_point long, asking_price long, delisted_date date, first_visible_date date").withColumn("date_listed", F.col("first_visible_date"))
    lk = {"listings": lst, "dp_quality": spark.createDataFrame([(7, 1), (8, 1), (9, 1)], "delivery_point long, is_unit_level int")}
    assert [r["id"] for r in listings.listing_match(lst, [{"type": "relisted", "value": True}], lk, "2024-06-01").collect()] == [1]


def test_price_drop_within_days_sees_prices_before_the_window(spark):
    d = dt.date.fromisoformat
    hist = spark.createDataFrame([(1, d("2024-01-01"), 100), (1, d("2024-02-01"), 50), (1, d("2024-08-20"), 60), (2, d("2024-01-01"), 50), (2, d("2024-08-20"), 60)], "property_id long, price_date date, asking_price long")
    lst = spark.createDataFrame([(1, None, 60), (2, None, 60)], "id long, update_reason string, asking_price long")
    got = listings.listing_match(lst, [{"type": "price_reduced", "within_days": 30}], {"price_history": hist}, "2024-09-01")
    assert [r["id"] for r in got.collect()] == [1]
