"""Readings are linked once, whatever the number of addresses and certificates that share them; the ledger is dealt narrow."""

from pyspark.sql import functions as F

from hearthspan.plans.joins import linked
from hearthspan.sources import derived, written

A = "struct<unit_number:string,building_name:string,street_number:string,street_name:string>"


def shuffled(spark):
    """Bytes and rows that all stages so far have written to shuffles, and rows read by them."""
    gateway = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    stages = [stages.apply(n) for n in range(stages.size())]
    return sum(s.shuffleWriteBytes() for s in stages), sum(s.shuffleWriteRecords() for s in stages)


def test_addresses_of_one_reading_share_the_first_certificate(spark):
    flat = [None, None, "5", "ELM ROAD"]
    far = [None, None, "9", "ELM ROAD"]
    a = spark.createDataFrame([(n, "N1 1AA", flat if n < 500 else far if n < 510 else [None, None, "1", "MILL LANE"], None, "5 ELM ROAD" if n < 500 else "9 ELM ROAD" if n < 510 else "1 MILL LANE") for n in range(512)], f"address_key long, postcode string, a {A}, unit string, key string")
    c = spark.createDataFrame([(n, "N1 1AA", None, "5 ELM ROAD", flat, 100 + n) for n in range(700, 100, -1)], f"cert_no long, postcode string, unit string, key string, b {A}, cert_area long")
    got = {tuple(r) for r in linked(a, c).select("address_key", "score", "cert_no", "cert_area").collect()}
    # the others meet the same street under another number only: a score of 1 is no match
    assert got == {(n, 2, 101, 201) for n in range(500)}


def test_an_address_is_linked_by_any_of_its_readings(spark):
    one, other = ["1", None, "5", "ELM ROAD"], [None, None, "7", "MILL LANE"]
    a = spark.createDataFrame([(1, "N1 1AA", one, "1", "k1"), (1, "N1 1AA", other, None, "k2"), (2, "N1 1AA", other, None, "k2")], f"address_key long, postcode string, a {A}, unit string, key string")
    c = spark.createDataFrame([(8, "N1 1AA", "1", "k1", one, 60), (9, "N1 1AA", None, "k9", other, 70)], f"cert_no long, postcode string, unit string, key string, b {A}, cert_area long")
    got = {tuple(r) for r in linked(a, c).select("address_key", "score", "cert_no").collect()}
    # address 1 was matched by unit and does not go on to the whole postcode; address 2 does
    assert got == {(1, 4, 8), (2, 2, 9)}


def test_ledger_rows_are_shuffled_narrow(spark, root):
    before = shuffled(spark)
    written._written.clear()
    rows = written.written(spark, root, "sales").count()
    assert (shuffled(spark)[0] - before[0]) / rows < 45


def test_ledger_equals_its_definition(spark, root):
    held, plain = written.written(spark, root, "sales"), derived.build(spark, root, "sales")
    total = lambda d: d.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*plain.columns).cast("decimal(38,0)"))).first()
    assert total(held) == total(plain)
