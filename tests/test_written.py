"""The ledger table: pruned by year, paired without an exchange; comparables over it."""

import datetime as dt
import re

from pyspark.sql import functions as F

import __spark_entry__ as entry
from hearthspan.operators import sales as op
from hearthspan.plans import load
from hearthspan.plans.base import Inputs
from hearthspan.sources import written


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_only_the_years_asked_for(spark, root):
    plan = plan_of(entry.queries()["scan_sales"](spark, root))
    assert re.search(r"PartitionFilters: \[[^\]]*sale_year#\d+ >= 2017", plan)
    assert "PushedFilters: [" in plan and "Join" not in plan


def test_pairs_need_no_exchange(spark, root):
    plan = plan_of(op.repeat_sales(Inputs(spark, root).sales))
    assert "Exchange" not in plan and "Window" in plan


def test_comparables_scan_the_ledger_little(spark, root):
    plan = plan_of(load()[0]["comparables"](Inputs(spark, root)))
    assert plan.count("FileScan") <= 5


def test_table_is_written_once_and_again_after_a_change(spark, root, tmp_path):
    assert written.written(spark, root, "sales").inputFiles() == written.written(spark, root, "sales").inputFiles()
    own = str(tmp_path)
    for name in ("lineitem", "part"):
        spark.read.parquet(f"{root}/{name}.parquet").limit(300).write.parquet(f"{own}/{name}.parquet")
    first = written.written(spark, own, "sales")
    assert first.count() == Inputs(spark, own).sales.count()
    spark.read.parquet(f"{root}/lineitem.parquet").limit(100).write.mode("append").parquet(f"{own}/lineitem.parquet")
    assert set(first.inputFiles()).isdisjoint(written.written(spark, own, "sales").inputFiles())


def ledger(spark, rows):
    day = lambda n: dt.date(2022, 1, 1) + dt.timedelta(days=n)
    return spark.createDataFrame([(price, day(d), t, "N1", "N1 1AA", c, n, 0, 0) for n, (price, d, t, c) in enumerate(rows)], "price long, sale_date date, property_type string, outcode string, postcode string, category string, tie1 long, tie2 long, tie3 long")


def test_category_b_is_named_but_never_in_the_figures(spark):
    subjects = spark.createDataFrame([(1, "N1 1AA", "N1", 500, ["F"]), (2, "N1 1AA", "N1", 500, ["D"]), (3, "N2 1AA", "N2", 500, None), (4, "N1 9ZZ", "N1", None, None)], "subject_id long, postcode string, outcode string, asking_price long, type_codes array<string>")
    sales = ledger(spark, [(100, 1, "F", "A"), (300, 2, "F", "A"), (7, 3, "F", "B"), (8, 4, "F", "B"), (9, 5, "F", "B"), (6, 6, "F", "B"), (5, 7, "D", "B"), (900, 8, "T", None)])
    got = {r.subject_id: r for r in op.comparable_report(sales, subjects, "2022-06-01").collect()}
    assert (got[1].scope, got[1].basis, got[1].n, got[1].median_price, got[1].b_count) == ("typed", "standard", 2, 200, 4)
    assert got[1].b_examples == "6@2022-01-07|9@2022-01-06|8@2022-01-05" and got[1].asking_vs_median_pct == 150.0
    assert (got[2].scope, got[2].n, got[2].b_count) == ("widened", 2, 5)
    assert (got[3].basis, got[3].n, got[3].b_count, got[3].b_examples) == ("none", 0, 0, None)
    only_b = {r.subject_id: r for r in op.comparable_report(sales.where(F.col("category") == "B"), subjects, "2022-06-01").collect()}
    assert (only_b[1].basis, only_b[1].n, only_b[1].median_price, only_b[1].b_count, only_b[1].asking_vs_median_pct) == ("only_b", 0, None, 5, None)
