"""Readers for registries in CSV, documents in JSON columns and JSON-lines folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthspan.functions.rank import newest


def csv_registry(spark: SparkSession, registry: str, ratings: str, encoding: str = "iso-8859-1") -> DataFrame:
    """Open entries of a registry in a non-UTF-8 CSV with their ratings; malformed rows are dropped.

    Spark reads a fixed list of charsets; windows-1252 needs spark.sql.legacy.javaCharsets.
    """
    options = {"header": True, "encoding": encoding, "mode": "DROPMALFORMED"}
    places = spark.read.options(**options).schema("urn long, name string, status string, lat double, lon double, phase string").csv(registry)
    rated = spark.read.options(**options).schema("urn long, rating int").csv(ratings)
    return places.where(F.col("status") == "Open").join(rated, "urn", "left")


def deprivation_csv(spark: SparkSession, path: str) -> DataFrame:
    """Area code to deciles; values that are no number, or lie outside 1..10, become NULL."""
    raw = spark.read.options(header=True).schema("area string, overall string, income string, crime string").csv(path)
    decile = lambda c: F.when(F.col(c).try_cast("int").between(1, 10), F.col(c).try_cast("int")).alias(c)
    return raw.where(F.coalesce("area", F.lit("")) != "").select("area", *[decile(c) for c in ("overall", "income", "crime")])


def json_documents(rows: DataFrame, keys: list[str], order: list[str], payload: str, schema: str) -> DataFrame:
    """Newest decodable payload per key; an undecodable newer row does not hide an older one."""
    parsed = rows.withColumn("doc", F.from_json(payload, schema, {"mode": "PERMISSIVE"}))
    # a broken text parses to a struct of nulls, so it is told by its own validity
    good = parsed.where(F.try_parse_json(F.col(payload)).isNotNull()).withColumn("no_data", F.coalesce(F.get_json_object(payload, "$._no_data") == "true", F.lit(False)))
    return newest(good.select(*keys, *[o for o in order if o not in keys], "doc", "no_data"), keys, order)


# Fields that tell the kinds of record apart.
def record_kind(line: Column) -> Column:
    has = lambda f: F.array_contains(F.json_object_keys(line), f)
    return (F.when(line.isNull(), "empty").when(has("verdict") & has("issues"), "critic").when(has("thinking") & has("thinking_text"), "thinking")
            .when(has("response") | has("final_answer") | (has("error") & has("query")), "answers").otherwise("unknown"))


def jsonl_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Per JSON-lines file: its kind by the first record, its lines, and the file it repeats if any.

    Files are read by line and fingerprinted by sums of line hashes, so a file is never one row.
    """
    lines = spark.read.text(folder).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"), F.col("_metadata.file_block_start").alias("at"))
    lines = lines.where(F.trim("value") != "").withColumn("n", F.monotonically_increasing_id())
    h = F.xxhash64("value")
    per = lines.groupBy("path", "bytes").agg(
        F.min_by("value", F.struct("at", "n")).alias("first"), F.count(F.lit(1)).alias("lines"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)")).alias("s"))
    copies = per.groupBy("bytes", "lines", "x", "s").agg(F.min("path").alias("first_path"))
    out = per.join(copies, ["bytes", "lines", "x", "s"])
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    return out.select(name(F.col("path")).alias("file"), record_kind(F.col("first")).alias("kind"), "lines", F.when(F.col("path") != F.col("first_path"), name(F.col("first_path"))).alias("repeats"))
