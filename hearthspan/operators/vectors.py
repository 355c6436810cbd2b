"""Embedding operators: scores against prompts, exact, quantised and hashed search, recall."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthspan.functions.rank import first_k, group_quantiles


def doubles(v) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    return F.transform(v, lambda x: x / F.sqrt(dot(v, v)))


def prompt_score(vectors: DataFrame, prompts: DataFrame, temperature: float = 10.0) -> DataFrame:
    """Mean dot product with each prompt set; sigmoid of rich minus plain; indoor when that set is closer.

    prompts(kind, vec): the mean over a set is the dot product with the set's mean vector, so each set
    becomes one vector and the four of them one broadcast row.
    """
    flat = prompts.select("kind", F.posexplode(doubles("vec")).alias("pos", "x")).groupBy("kind", "pos").agg(F.avg("x").alias("x"))
    mean = flat.groupBy("kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("m"))
    row = mean.groupBy().pivot("kind", ["rich", "plain", "indoor", "outdoor"]).agg(F.first("m"))
    j = vectors.join(F.broadcast(row))
    v = doubles("embedding")
    s = {k: dot(v, F.col(k)) for k in ("rich", "plain", "indoor", "outdoor")}
    return j.select("vec_id", (1 / (1 + F.exp(-(s["rich"] - s["plain"]) * temperature))).alias("score"), (s["indoor"] > s["outdoor"]).cast("int").alias("is_interior"))


def sample_queries(vectors: DataFrame, n: int, seed: str) -> DataFrame:
    """n vectors in seeded hash order: the query set of a recall test."""
    return vectors.orderBy(F.md5(F.concat(F.lit(seed + "-"), F.col("vec_id").cast("string")))).limit(n)


def top_k_exact(vectors: DataFrame, queries: DataFrame, k: int, shard_rows: int = 20_000) -> DataFrame:
    """Exact inner-product top k per query, in one scan of the vectors.

    Vectors are dealt into shards of about `shard_rows`; queries, a distributed side of any size, visit every
    shard and stream past its vectors in one matrix product per batch. At most shards x queries x k rows are
    shuffled and no query-vector pairs exist as rows.
    """
    shards = max(1, -(-vectors.count() // shard_rows))
    held = vectors.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("shard"), F.lit(0).alias("asks"), "vec_id", doubles("embedding").alias("v"))
    asked = queries.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.lit(1).alias("asks"), "vec_id", doubles("embedding").alias("v"))

    def search(batches):
        shard, ids, parts, matrix = None, [], [], None
        for pdf in batches:
            for (at, asks), own in pdf.groupby(["shard", "asks"], sort=True):
                if at != shard:
                    shard, ids, parts, matrix = at, [], [], None
                if not asks:
                    ids.append(own["vec_id"].to_numpy())
                    parts.append(np.array(own["v"].tolist()))
                elif parts:
                    if matrix is None:
                        matrix, names = np.concatenate(parts), np.concatenate(ids)
                    scores = np.array(own["v"].tolist()) @ matrix.T
                    order = np.lexsort((np.broadcast_to(names, scores.shape), -scores), axis=1)[:, :k]
                    yield pd.DataFrame({"query_id": np.repeat(own["vec_id"].to_numpy(), order.shape[1]), "vec_id": names[order].ravel(), "score": np.take_along_axis(scores, order, 1).ravel()})

    rows = held.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "asks")
    return first_k(rows.mapInPandas(search, "query_id long, vec_id long, score double"), ["query_id"], [F.desc("score"), "vec_id"], k)


def ranges(vectors: DataFrame) -> DataFrame:
    """One row with the least and greatest value of every dimension."""
    per = vectors.select(F.posexplode(doubles("embedding")).alias("pos", "x")).groupBy("pos").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "lo", "hi")))
    return per.agg(F.transform(ordered, lambda s: F.struct(s["lo"].alias("lo"), s["hi"].alias("hi"))).alias("span"))


def quantise(vectors: DataFrame) -> DataFrame:
    """8-bit codes per dimension and the vector read back from them."""
    j = vectors.join(F.broadcast(ranges(vectors)))
    code = F.zip_with(doubles("embedding"), "span", lambda x, s: F.round((x - s["lo"]) / F.nullif(s["hi"] - s["lo"], F.lit(0.0)) * 255))
    j = j.withColumn("codes", F.transform(code, lambda c: F.coalesce(c, F.lit(0.0))))
    back = F.zip_with("codes", "span", lambda c, s: s["lo"] + c / 255 * (s["hi"] - s["lo"]))
    return j.withColumn("decoded", back).drop("span")


def hyperplanes(dim: int, tables: int, bits: int, seed: int = 7) -> np.ndarray:
    return np.random.RandomState(seed).normal(size=(tables, bits, dim))


def signatures(vectors: DataFrame, dim: int, tables: int = 8, bits: int = 4) -> DataFrame:
    """(vec_id, band, sig): which side of each random plane a vector lies on."""
    planes = hyperplanes(dim, tables, bits)

    def sign(batches):
        for pdf in batches:
            v = np.array(pdf["v"].tolist())
            for t in range(tables):
                sig = ((v @ planes[t].T) > 0) @ (1 << np.arange(bits))
                yield pd.DataFrame({"vec_id": pdf["vec_id"], "band": t, "sig": sig})

    return vectors.select("vec_id", doubles("embedding").alias("v")).mapInPandas(sign, "vec_id long, band int, sig long")


def top_k_hashed(vectors: DataFrame, queries: DataFrame, k: int, dim: int = 64) -> DataFrame:
    """Approximate search: candidates share a signature with the query, the exact score ranks them.

    Query signatures are few, so a crowded bucket is scanned once, not paired with itself.
    """
    sig = signatures(vectors, dim)
    ask = sig.join(queries.select("vec_id"), "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), "band", "sig")
    pairs = sig.join(F.broadcast(ask), ["band", "sig"]).select("query_id", "vec_id").distinct()
    q = queries.select(F.col("vec_id").alias("query_id"), doubles("embedding").alias("q"))
    scored = pairs.join(vectors.select("vec_id", doubles("embedding").alias("v")), "vec_id").join(F.broadcast(q), "query_id").withColumn("score", dot(F.col("v"), F.col("q")))
    return first_k(scored.select("query_id", "vec_id", "score"), ["query_id"], [F.desc("score"), "vec_id"], k)


def recall_at_k(exact: DataFrame, found: DataFrame, k: int, gate: float = 0.90) -> DataFrame:
    """Mean, median and tenth percentile of the overlap with the exact top k, the mean gap of both first scores, and whether the gate holds."""
    hits = exact.join(found.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi").groupBy("query_id").agg(F.count(F.lit(1)).alias("h"))
    per = exact.select("query_id").distinct().join(hits, "query_id", "left").select((F.coalesce("h", F.lit(0)) / k).alias("recall"))
    stats = group_quantiles(per, [], "recall", {"mean": "mean", "mid": "median", "p10": ("interp", 0.1)}, count="queries")
    top = lambda d, c: d.groupBy("query_id").agg(F.max("score").alias(c))
    offset = top(exact, "a").join(top(found, "b"), "query_id").agg(F.avg(F.abs(F.col("a") - F.col("b"))).alias("first_offset"))  # one row
    return stats.join(F.broadcast(offset)).withColumn("passes", (F.col("mean") >= gate).cast("int"))


def moments(vectors: DataFrame, dim: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of vectors, their mean and covariance (divisor n - 1), from one pass of small sums: the driver receives dim * dim / 2 numbers.

    Sums are taken about the first vector of all, which keeps digits where the mean is far from zero."""
    origin = np.array(vectors.where("embedding IS NOT NULL").select(doubles("embedding")).first()[0])
    upper = np.triu_indices(dim + 1)

    def run(batches):
        held = np.zeros((dim + 1, dim + 1))
        for pdf in batches:
            v = np.array(pdf["v"].tolist()).reshape(-1, dim) - origin
            v = np.column_stack([np.ones(len(v)), v])
            held += v.T @ v
        yield pd.DataFrame({"key": upper[0] * (dim + 1) + upper[1], "value": held[upper]})

    got = vectors.select(doubles("embedding").alias("v")).mapInPandas(run, "key long, value double").groupBy("key").agg(F.sum("value").alias("value")).collect()
    m = np.zeros((dim + 1, dim + 1))
    for key, value in got:
        m[key // (dim + 1), key % (dim + 1)] = m[key % (dim + 1), key // (dim + 1)] = value
    n, mean = int(round(m[0, 0])), m[0, 1:] / m[0, 0]
    return n, mean + origin, (m[1:, 1:] - n * np.outer(mean, mean)) / max(1, n - 1)


def project(vectors: DataFrame, share: float = 0.9, most: int = 128) -> DataFrame:
    """vec_id, projected, components, explained, passes: vectors on as many principal components as reach `share` of the variance.

    `most` components at the most; passes is 0 where even those stay below the share. Vectors without variance keep one component.
    """
    first = vectors.where("embedding IS NOT NULL").select(F.size("embedding").alias("d")).first()
    if first is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, projected array<double>, components int, explained double, passes int")
    usable = vectors.where(F.size("embedding") == first.d)
    _, mean, cov = moments(usable, first.d)
    values, axes = np.linalg.eigh(cov)
    values, axes = np.maximum(values[::-1], 0), axes[:, ::-1]
    held = np.cumsum(values) / values.sum() if values.sum() > 0 else np.ones(len(values))
    k = min(most, len(values), int(np.searchsorted(held, share - 1e-12) + 1))
    turn = axes[:, :k]

    def run(batches):
        for pdf in batches:
            v = np.array(pdf["v"].tolist()).reshape(-1, len(mean))
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "projected": list((v - mean) @ turn)})

    out = usable.select("vec_id", doubles("embedding").alias("v")).mapInPandas(run, "vec_id long, projected array<double>")
    return out.select("vec_id", "projected", F.lit(k).alias("components"), F.lit(float(held[k - 1])).alias("explained"), F.lit(int(held[k - 1] >= share - 1e-12)).alias("passes"))
