"""Exact top-k inner products by ball trees.

Vectors are dealt into shards; each shard builds ball trees over its vectors, with the centre and radius of every node. For a
query no vector of a node can score above q.centre + |q| * radius, so nodes are taken in falling order of that bound and
the search ends when the bound falls below the k-th score known so far. That score is shared: within a shard all nodes
use the query's current one, and a first round over one shard a query gives every other shard a score to start from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthspan.session import checkpointed

LEAF = 256


class BallTree:
    """Nodes as arrays; leaves hold runs of the permuted vectors."""

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(vectors))
        self.lo, self.hi, self.left, self.right, self.centre, self.radius = [], [], [], [], [], []
        stack = [(0, len(vectors), -1, 0)]
        while stack:
            lo, hi, parent, side = stack.pop()
            own = vectors[self.order[lo:hi]]
            centre = own.mean(axis=0)
            far = ((own - centre) ** 2).sum(axis=1)
            node = len(self.lo)
            if parent >= 0:
                (self.right if side else self.left)[parent] = node
            for x, v in ((self.lo, lo), (self.hi, hi), (self.left, -1), (self.right, -1), (self.centre, centre), (self.radius, float(far.max()) ** 0.5)):
                x.append(v)
            if hi - lo > leaf and far.max() > 0:
                # split between the vector farthest from the centre and the one farthest from that
                a = own[far.argmax()]
                b = own[((own - a) ** 2).sum(axis=1).argmax()]
                by = np.argsort((own - (a + b) / 2) @ (b - a), kind="stable")
                self.order[lo:hi] = self.order[lo:hi][by]
                stack += [(lo, (lo + hi) // 2, node, 0), ((lo + hi) // 2, hi, node, 1)]
        self.centre, self.radius = np.array(self.centre), np.array(self.radius)
        self.leaves = [i for i, x in enumerate(self.left) if x < 0]


def exact_scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Integer inner products; by floats only where they are exact, within long by Python integers else (then held to its range)."""
    most = float(np.abs(vectors).max(initial=0)) * float(np.abs(query).max(initial=0)) * max(1, len(query))
    if most < 2.0**53:
        return (vectors @ query).astype(np.int64)
    ends = np.iinfo(np.int64)
    whole = vectors.astype(object) if vectors.dtype != object else vectors
    return np.array([min(max(sum(int(a) * int(b) for a, b in zip(row, query)), ends.min), ends.max) for row in whole], np.int64)


class Shard:
    """A shard's vectors in its tree, ready for queries."""

    def __init__(self, ids: list[np.ndarray], vectors: list[np.ndarray]):
        self.ids = np.concatenate(ids)
        width = max(v.shape[1] for v in vectors)
        whole = np.concatenate([np.pad(v, ((0, 0), (0, width - v.shape[1]))) for v in vectors])
        self.vectors = whole.astype(float) if np.abs(whole).max(initial=0) < 1 << 50 else whole.astype(object)
        self.tree = BallTree(whole.astype(float))
        self.slack = 1e-9 * (1 + float(np.abs(whole.astype(float)).max(initial=0)) * max(1, width) ** 0.5)

    def search(self, query: np.ndarray, own: int, k: int, floor: int | None) -> np.ndarray:
        """(score, id) of the shard's vectors that may be among the query's k best: score >= floor, k rows at most, ties to smaller ids."""
        width, t = self.vectors.shape[1], self.tree
        query = np.pad(query, (0, max(0, width - len(query))))[:width]  # a component that one side lacks counts as 0
        q = query.astype(float)
        length = float(np.sqrt(q @ q))
        bound = t.centre @ q + length * t.radius + self.slack * (1 + length)
        query = query.astype(object) if self.vectors.dtype == object else q
        kth, nodes, leaves = -np.inf if floor is None else floor, [0], []
        while nodes:  # whole branches under the score to beat are left out
            node = nodes.pop()
            if bound[node] >= kth:
                if t.left[node] < 0:
                    leaves.append(node)
                else:
                    nodes += [t.left[node], t.right[node]]
        best = np.zeros((0, 2), np.int64)
        for node in sorted(leaves, key=lambda n: -bound[n]):
            if bound[node] < kth:
                break
            at = t.order[t.lo[node] : t.hi[node]]
            scores = exact_scores(self.vectors[at], query)
            keep = (scores >= kth) & (self.ids[at] != own)
            best = np.concatenate([best, np.stack([scores[keep], self.ids[at][keep]], axis=1)])
            if len(best) >= k:
                best = best[np.lexsort((best[:, 1], -best[:, 0]))][:k]
                kth = max(kth, int(best[-1, 0]))
        return best


def matrix(column: pa.Array) -> np.ndarray:
    """A list column as rows, shorter ones filled up with 0."""
    lengths = pc.list_value_length(column).to_numpy()
    width = int(lengths.max(initial=0))
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = column.flatten().to_numpy()
    return out


def over_shards(rows: DataFrame, k: int) -> DataFrame:
    """Rows (shard, is_query, vec_id, v, floor), vectors before queries in every shard -> (query_id, score, vec_id).

    One shard's vectors are held at a time; queries stream past them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, vectors, ready = None, [], [], None
        for batch in batches:
            of, asks = batch.column("shard").to_numpy(), batch.column("is_query").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(of) != 0) | (asks[1:] != asks[:-1])) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(of)]):
                part = batch.slice(i, j - i)
                if j > i and of[i] != shard:
                    shard, ids, vectors, ready = of[i], [], [], None
                if j > i and not asks[i]:
                    ids.append(part.column("vec_id").to_numpy())
                    vectors.append(matrix(part.column("v")))
                elif j > i and ids:
                    ready = ready or Shard(ids, vectors)
                    out = []
                    for q, v, floor in zip(part.column("vec_id").to_pylist(), matrix(part.column("v")), part.column("floor").to_pylist()):
                        best = ready.search(v, q, k, floor)
                        out.append(np.column_stack([np.full(len(best), q), best]))
                    found = np.concatenate(out)
                    yield pa.RecordBatch.from_arrays([pa.array(found[:, c]) for c in range(3)], names=["query_id", "score", "vec_id"])

    return rows.repartition("shard").sortWithinPartitions("shard", "is_query").mapInArrow(run, "query_id long, score long, vec_id long")


def best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def top_inner(embeddings: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, vec_id: str = "vec_id", vector: str = "embedding", shard_rows: int = 10_000, most_shards: int = 1000) -> DataFrame:
    """Each query's k highest integer inner products over all other rows: query_id, rank (from 1), vec_id, score.

    Components are floor(scale * x), x as double; ties go to the smaller vec_id; a query with fewer candidates has fewer rows.
    Vectors that are null or hold a null or non-finite component, and rows without an id, take no part. Vectors of different
    length are compared as if filled up with 0. Repeated candidates are candidates each; a repeated query is asked once.
    Scores beyond a long are held at its ends. An empty table gives an empty result; other columns are ignored.
    Shards hold about max(shard_rows, rows / most_shards) vectors; every query visits every shard, rows stream.
    """
    rows = embeddings.withColumn("_q", is_query).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("x"), F.col("_q").alias("is_query"))
    sound = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & sound)
    rows = rows.select("vec_id", "is_query", F.transform("x", lambda c: F.floor(F.lit(float(scale)) * c.cast("double"))).alias("v"))
    n = embeddings.count()
    shards = max(1, -(-n // max(shard_rows, n // most_shards)))
    shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards))
    held = checkpointed(rows.withColumn("shard", shard))
    asked = held.where("is_query").groupBy("vec_id").agg(F.min("v").alias("v"))
    vectors = held.select("shard", F.lit(False).alias("is_query"), "vec_id", "v", F.lit(None).cast("long").alias("floor"))
    home = asked.select(shard.alias("shard"), F.lit(True).alias("is_query"), "vec_id", "v", F.lit(None).cast("long").alias("floor"))
    first = checkpointed(best(over_shards(vectors.unionByName(home), k), k))
    floors = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    away = asked.withColumn("home", shard).join(floors, "vec_id", "left").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<long>"))).where("shard <> home")
    away = away.select("shard", F.lit(True).alias("is_query"), "vec_id", "v", "floor")
    rest = over_shards(vectors.unionByName(away), k)
    out = best(first.drop("rank").unionByName(rest), k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10
"""
