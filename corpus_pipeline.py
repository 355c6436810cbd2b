"""A corpus pipeline: toxic documents go, then copies, then near copies; what is left is mixed by source and encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthspan.llm import bpe, exact_dedup, mixing, near_dedup, toxicity
from hearthspan.session import scratch


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the table's labels, scores under 0.5. Null and empty texts count as clean."""
    labels = spark.read.parquet(f"{str(sf_dir).rstrip('/')}/labels.parquet")
    return toxicity.without_toxic(docs, toxicity.train(docs, labels))


def no_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, up to white space, the row with the smallest id; null counts as empty."""
    return exact_dedup.deduplicated(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 0.8 of their five-word shingles the one with the smallest id; one row for each text of it, if rows of one id differ.
    Documents without words link with nothing and stay; so do rows without an id."""
    kept = near_dedup.near_components(docs, k=5, percent=80).where("kept").select("doc_id").distinct()
    rows = docs.join(kept, "doc_id", "left_semi").withColumn(mark := "_" + max(docs.columns, key=len), F.sha2(F.col("text"), 256))
    return rows.dropDuplicates(["doc_id", mark]).unionByName(docs.where("doc_id IS NULL"), allowMissingColumns=True).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a row for each pass over a document's words, cut to the words taken."""
    out = mixing.mixed_documents(docs)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the ids of every row."""
    return bpe.encoded(docs)


STAGES = [("toxicity", not_toxic), ("exact_dedup", no_copies), ("near_dedup", no_near_copies), ("mixing", mixed), ("bpe", encoded)]

#: Trained scores, sketches and merges are beyond SQL; the stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result but the last is written and read again."""
    docs = spark.read.parquet(f"{str(sf_dir).rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
