"""What is near a home depends on its place and kind alone: it is sought once for all homes alike, and read once."""

from pyspark.sql import functions as F

from hearthspan.functions import labels
from hearthspan.operators import nearest, sales
from hearthspan.plans import load
from hearthspan.plans.base import Inputs
from hearthspan.plans.joins import listing_subjects


def test_comparables_are_sought_once_for_homes_alike(spark, root, monkeypatch):
    met, plain = [], sales.nearby_sales
    monkeypatch.setattr(sales, "nearby_sales", lambda s, subjects, *more: met.append(subjects.count()) or plain(s, subjects, *more))
    i = Inputs(spark, root)
    rows = [(n, "N1 0AA" if n % 3 else None, "N1" if n % 3 else None, 100 * n, ["F"] if n % 2 else None) for n in range(60)]
    homes = spark.createDataFrame(rows, "subject_id long, postcode string, outcode string, asking_price long, type_codes array<string>")
    report = sales.comparable_report(i.sales, homes, "2022-06-01").collect()
    assert sorted(r.subject_id for r in report) == list(range(60)) and met == [4, 4]
    assert all((r.n, r.basis) == (0, "none") for r in report if r.subject_id % 3 == 0)
    assert sales.comparables(i.sales, homes, "2022-06-01").where("subject_id % 3 = 0").count() == 0


def test_neighbours_are_sought_once_for_homes_alike(spark, root, monkeypatch):
    met, plain = [], nearest.knn_sales
    monkeypatch.setattr(nearest, "knn_sales", lambda subjects, *more: met.append(subjects) or plain(subjects, *more))
    i = Inputs(spark, root)
    load()[0]["valuation_knn"](i)
    assert met[0].count() == listing_subjects(i).select("place", "segment", "beds").distinct().count()


def test_room_readings_are_bound_once():
    said = str(labels.room_area(F.col("t")))
    assert said.count("regexp_extract_all") == 2
