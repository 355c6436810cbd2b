"""Global shuffle into shards in two passes.

Pass 1 scatters records into memory-sized buckets by seeded hashes. Pass 2 shuffles each bucket by Fisher and Yates and
writes it. The shard itself goes by key: the highest of one hash for each shard and id wins, so that a further shard only
takes rows into itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthspan.llm.common import plain
from hearthspan.session import scratch

SEED = 10


def shard_of(shards: int, doc_id: str = "doc_id", seed: int = SEED) -> Column:
    """Rendezvous hashing: the shard with the highest hash of (seed, shard, id)."""
    return F.array_max(F.array(*[F.struct(F.xxhash64(F.lit(seed), F.lit(i), F.col(doc_id)).alias("h"), F.lit(i).alias("i")) for i in range(shards)]))["i"]


def fisher_yates(bucket: pa.Table, seed: int = SEED) -> pa.Table:
    """One bucket in a uniform order, the same in every run: rows are put in id and content order, then swapped from the end."""
    order = pc.sort_indices(bucket, sort_keys=[("doc_id", "ascending"), ("text_crc32", "ascending"), ("size", "ascending")]).to_numpy().copy()
    rng = np.random.default_rng([seed, bucket.column("bucket")[0].as_py()])
    rng.shuffle(order)  # numpy's shuffle is Fisher and Yates
    return bucket.take(pa.array(order)).append_column("place", pa.array(np.arange(len(order), dtype=np.int64)))


def shuffled(docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text", bucket_bytes: int = 16 << 20, seed: int = SEED, path: str | None = None) -> DataFrame:
    """Write all records to `shards` shards and return the written table: doc_id, text, size, text_crc32, shard, bucket, place, slot.

    Size is the text's UTF-8 bytes plus 1 (null: 1); crc32 of null is that of no bytes. Slots count from 0 without gaps in
    each shard: a bucket's place after the earlier buckets of its shard. Buckets hold about `bucket_bytes`, their number
    follows the input. Repeated rows and null ids are records as any other; an empty table gives an empty result.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("size", F.octet_length(plain()).cast("long") + 1).withColumn("text_crc32", F.crc32(plain()))
    d = d.withColumn("shard", shard_of(shards, seed=seed).cast("int"))
    total = d.agg(F.sum("size")).first()[0] or 0
    buckets = max(1, -(-total // (shards * bucket_bytes)))
    d = d.withColumn("bucket", F.col("shard").cast("long") * buckets + F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(buckets)))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in d.schema.fields)
    out = d.groupBy("bucket").applyInArrow(lambda t: fisher_yates(t, seed), f"{schema}, place long")
    path = path or scratch(docs.sparkSession, "shards")
    out.write.partitionBy("shard").option("compression", "zstd").parquet(path)
    names = [f.name for f in out.schema.fields]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields)
    written = docs.sparkSession.read.schema(kinds).parquet(path).select(*names)
    counts = written.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("base"))
    return written.join(counts, ["shard", "bucket"]).withColumn("slot", F.col("base") + F.col("place")).drop("base")
