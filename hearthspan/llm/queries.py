"""Registered queries over the corpus operators, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthspan.llm import bpe, exact_dedup, langid, mixing, near_dedup, packed, phrases, sharding, span_dedup, topk, toxicity, vector_dedup, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(table(spark, sf_dir, "documents"), with_ids=False)


def op2_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed.written_and_read(table(spark, sf_dir, "documents"))


def op3_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_dedup.repeated(table(spark, sf_dir, "documents"))


def op4_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_inner(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_components(table(spark, sf_dir, "documents"), k=3, percent=85, bands=32)


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.told(docs, langid.learn(docs))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The `key` law: id and shard count decide."""
    out = sharding.shuffled(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", sharding.shard_of(9).cast("int").alias("grown_shard"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_packed_ids, op3_span_dedup, op4_ball_tree, op5_near_dedup, op6_langid, op7_toxicity, op8_mixing, op9_exact_dedup, op10_sharding, op11_phrases, op12_vector_dedup, op13_whitening)}
SQL = {"op4_ball_tree": topk.SQL, "op5_near_dedup": near_dedup.SQL, "op9_exact_dedup": exact_dedup.SQL, "op11_phrases": phrases.SQL, "op12_vector_dedup": vector_dedup.SQL}
