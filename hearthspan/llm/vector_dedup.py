"""Near-duplicate vectors by tiled comparison in the order of principal components.

Unit vectors are turned so that leading coordinates hold most of their length. Products over the leading coordinates come
first; the rest of a product is at most the product of the two suffix norms, and a pair is left as soon as even that cannot
bring the cosine to the threshold. The same bound works for whole regions: vectors go to the nearest of some centres, and two
such cells whose boxes of leading coordinates lie too far apart never meet.

A cell's vectors are packed into blocks of bounded size and only blocks meet, in one task a pair of blocks. A task returns
each linked vector once, with its number of links and the smallest id that it reaches there: as many rows as vectors, not
as many as links. Equal vectors count as one throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthspan.llm.components import components
from hearthspan.llm.vectors import finite, matrix, usual_length
from hearthspan.session import checkpointed

LEAD = 16
TILE = 512
SLACK = 1e-9
MOST_CELLS = 4096
SAMPLE = 1 << 16
BLOCK_BYTES = 2 << 20


def scaled(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows as double, each times a power of two (which keeps all digits) so that squares neither vanish nor overflow, and their norms."""
    v = v.astype(float)
    v = np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])
    return v, np.sqrt(np.einsum("ri,ri->r", v, v))


def unit(v: np.ndarray) -> np.ndarray:
    """Rows at length 1, as double."""
    v, norm = scaled(v)
    return v / norm[:, None]


def basis(nodes: DataFrame, d: int) -> np.ndarray:
    """Eigenvectors of the second moments of the unit vectors, the largest first; d * d / 2 sums come to the driver."""
    upper = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((d, d))
        for batch in batches:
            u = unit(matrix(batch.column("v"), d))
            found += u.T @ u
        yield pa.RecordBatch.from_pydict({"key": pa.array(upper[0] * d + upper[1]), "value": pa.array(found[upper])})

    m = np.zeros((d, d))
    for key, value in nodes.select("v").mapInArrow(run, "key long, value double").groupBy("key").agg(F.sum("value")).collect():
        m[key // d, key % d] = m[key % d, key // d] = value
    return np.linalg.eigh(m)[1][:, ::-1]


def led(u: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Leading coordinates and the norm of the rest."""
    x = u @ turn
    return np.column_stack([x[:, :LEAD], np.sqrt((x[:, LEAD:] ** 2).sum(axis=1))])


class Cells:
    """Regions of the nearest of some centres; each centre is the vector of a sample that lies farthest from those before it."""

    def __init__(self, sample: np.ndarray, count: int):
        far, chosen = np.full(len(sample), np.inf), []
        for _ in range(min(count, len(sample))):
            at = int(far.argmax()) if chosen else 0
            if not far[at]:
                break
            chosen.append(sample[at])
            far = np.minimum(far, ((sample - sample[at]) ** 2).sum(axis=1))
        self.centres = np.array(chosen)
        self.half = (self.centres**2).sum(axis=1) / 2

    def of(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([(x[i : i + TILE] @ self.centres.T - self.half).argmax(axis=1) for i in range(0, len(x), TILE)])


def boxes(nodes: DataFrame, d: int, turn: np.ndarray, cells: Cells) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each cell: number of vectors, least and greatest of every leading coordinate and suffix norm."""
    width, count = min(LEAD, d) + 1, len(cells.centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, lo, hi = np.zeros(count, np.int64), np.full((count, width), np.inf), np.full((count, width), -np.inf)
        for batch in batches:
            if batch.num_rows:
                x = led(unit(matrix(batch.column("v"), d)), turn)
                cell = cells.of(x)
                n += np.bincount(cell, minlength=count)
                np.minimum.at(lo, cell, x)
                np.maximum.at(hi, cell, x)
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({
            "cell": pa.array(np.repeat(own, width)), "dim": pa.array(np.tile(np.arange(width), len(own))), "n": pa.array(np.repeat(n[own], width)),
            "lo": pa.array(lo[own].ravel()), "hi": pa.array(hi[own].ravel()),
        })

    n, lo, hi = np.zeros(count, np.int64), np.full((count, width), np.inf), np.full((count, width), -np.inf)
    parts = nodes.select("v").mapInArrow(run, "cell long, dim long, n long, lo double, hi double").groupBy("cell", "dim").agg(F.sum("n"), F.min("lo"), F.max("hi"))
    for cell, dim, size, low, high in parts.collect():
        n[cell], lo[cell, dim], hi[cell, dim] = size, low, high
    return n, lo, hi


def partners(n: np.ndarray, lo: np.ndarray, hi: np.ndarray, cosine: float) -> np.ndarray:
    """Which cells can hold a pair at the threshold, as bits: squared distances of unit vectors are 2 - 2 * cosine at most."""
    out = []
    for i in range(len(n)):
        gap = np.maximum(np.maximum(lo - hi[i], lo[i] - hi), 0)
        with np.errstate(invalid="ignore"):
            out.append(np.packbits((n > 0) & (n[i] > 0) & ((gap**2).sum(axis=1) <= 2 - 2 * cosine + SLACK)))
    return np.stack(out)


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after putting together what the links a-b join; a label is the smallest index of its own."""
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not ((shorter := label[label]) == label).all():
            label = shorter
        label = shorter


def links(x: np.ndarray, y: np.ndarray, plain: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], cosine: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs at or above the threshold, tile by tile. x, y: turned unit vectors; plain: both sides as they were, each with its norms."""
    own_x, norm_x, own_y, norm_y = plain
    d = x.shape[1]
    steps = [LEAD]
    while steps[-1] < d:
        steps.append(min(2 * steps[-1], d))
    tail = lambda z: np.column_stack([np.sqrt((z[:, s:] ** 2).sum(axis=1)) for s in steps])
    tx, ty = tail(x), tail(y)
    ax, ay = np.column_stack([x[:, :LEAD], tx[:, 0]]), np.column_stack([y[:, :LEAD], ty[:, 0]])
    for p in range(0, len(x), TILE):
        for q in range(p if same else 0, len(y), TILE):
            i, j = np.nonzero(ax[p : p + TILE] @ ay[q : q + TILE].T >= cosine - SLACK)
            if same and p == q:
                i, j = i[i < j], j[i < j]
            i, j = i + p, j + q
            if len(i) > TILE * TILE // 8:
                value = (x[p : p + TILE] @ y[q : q + TILE].T)[i - p, j - q]
            else:
                value = np.einsum("ri,ri->r", x[i, :LEAD], y[j, :LEAD])
                for at, (s, t) in enumerate(zip(steps, steps[1:]), 1):
                    value = value + np.einsum("ri,ri->r", x[i, s:t], y[j, s:t])
                    on = value + tx[i, at] * ty[j, at] >= cosine - SLACK
                    i, j, value = i[on], j[on], value[on]
            close = np.abs(value - cosine) <= SLACK
            if close.any():  # turning may have moved the last digits: once more without it
                i_, j_ = i[close], j[close]
                value[close] = np.einsum("ri,ri->r", own_x[i_], own_y[j_]) / (norm_x[i_] * norm_y[j_])
            on = value >= cosine
            yield i[on], j[on]


def linked(pairs: DataFrame, d: int, turn: np.ndarray, cosine: float, kind: np.dtype) -> DataFrame:
    """Pairs (a, b) of blocks -> each vector that has a link there: h1, h2, id, links, low (the smallest id that it reaches in the pair)."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        held = table.sort_by("block").to_pylist()
        data = [{"v": np.frombuffer(r["v"], kind).reshape(-1, d)} | {c: np.frombuffer(r[c], np.int64) for c in ("h1", "h2", "id", "weight")} for r in held]
        same = len(data) == 1
        left, right = data[0], data[-1]
        plain = *scaled(left["v"]), *scaled(right["v"])
        x, y = plain[0] / plain[1][:, None] @ turn, plain[2] / plain[3][:, None] @ turn
        start = 0 if same else len(x)
        total = len(x) + (0 if same else len(y))
        label, count = np.arange(total), np.zeros(total)
        for i, j in links(x, y, plain, cosine, same):
            if len(i):
                count += np.bincount(i, right["weight"][j], total) + np.bincount(j + start, left["weight"][i], total)
                label = joined(label, i, j + start)
        whole = {c: left[c] if same else np.concatenate([left[c], right[c]]) for c in ("h1", "h2", "id")}
        low = np.full(total, np.iinfo(np.int64).max)
        np.minimum.at(low, label, whole["id"])
        on = count > 0
        return pa.table({c: pa.array(whole[c][on]) for c in whole} | {"links": pa.array(count[on].astype(np.int64)), "low": pa.array(low[label][on])})

    return pairs.groupBy("a", "b").applyInArrow(run, "h1 long, h2 long, id long, links long, low long")


def near_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", cosine: float = 0.9, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: vec_id (long), n_links, component_id, kept.

    Vectors whose cosine is `cosine` or more are linked; component_id is the smallest vec_id reachable. Vectors that are null, empty,
    zero, of another than the commonest length, or hold null or non-finite entries link with nothing: n_links 0, their own component,
    kept. Rows without a vec_id take no part: n_links 0, component_id null, kept false. Every row counts as a vector of its own, equal
    ones too; where rows of one vec_id hold different vectors, each has its own links, and groups that both have this id as their
    smallest are one. An empty table gives an empty result; other columns are ignored.

    Bounds: centres come from a sample of about 65,536 vectors' leading coordinates, cells number 4,096 at most, and a block is
    `block_bytes` of vectors, so that neither the driver nor a task grows with the rows. Cells decide only where pairs meet, never which.
    """
    spark = rows.sparkSession
    full = F.col(vector)
    kind = "float" if dict(rows.dtypes)[vector] == "array<float>" else "double"
    plain = rows.select(F.col(vec_id).cast("long").alias("vec_id"), full.alias("raw"))
    good = finite("raw") & F.coalesce(F.exists("raw", lambda x: x != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    v = F.when(good, F.transform("raw", lambda x: x.cast(kind) + F.lit(0.0).cast(kind)))  # -0.0 counts as 0.0
    known = plain.select("vec_id", v.alias("v")).withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(7), "v"))
    some = known.where("v IS NOT NULL")
    d = usual_length(some, "v")
    if not d:
        return plain.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    nodes = checkpointed(some.where(F.size("v") == d).groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("weight"), F.first("v").alias("v")))
    n = nodes.count()
    turn = basis(nodes, d)
    per_block = max(64, block_bytes // (8 * d))
    every = max(1, n // SAMPLE)

    def leading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict({"x": pa.array(led(unit(matrix(batch.column("v"), d)), turn).tolist())})

    sample = [r.x for r in nodes.where(F.pmod("h1", F.lit(every)) == 0).select("v").mapInArrow(leading, "x array<double>").collect()]
    cells = Cells(np.array(sorted(sample)), min(MOST_CELLS, -(-n // per_block)))
    size, lo, hi = boxes(nodes, d, turn, cells)
    meets = partners(size, lo, hi, cosine)
    blocks = -(-size // per_block)
    first = np.cumsum(blocks) - blocks

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = cells.of(led(unit(matrix(batch.column("v"), d)), turn))
                part = (batch.column("h2").to_numpy().view(np.uint64) % blocks[cell].astype(np.uint64)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(first[cell] + part), *batch.columns], ["cell", "block", *batch.schema.names])

    def packed(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        flat = {c: table.column(c).to_numpy().astype(np.int64).tobytes() for c in ("h1", "h2", "id", "weight")}
        v = matrix(table.column("v").combine_chunks(), d).astype(kind + ("32" if kind == "float" else "")).tobytes()
        return pa.table({"cell": [key[0].as_py()], "block": [key[1].as_py()]} | {c: pa.array([x], pa.binary()) for c, x in flat.items()} | {"v": pa.array([v], pa.binary())})

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                own, cell = batch.column("block")[row].as_py(), batch.column("cell")[row].as_py()
                for other in np.flatnonzero(np.unpackbits(meets[cell], count=len(blocks))).tolist():
                    met = np.arange(first[other], first[other] + blocks[other])
                    one = batch.slice(row, 1)
                    for b in met.tolist():
                        yield pa.RecordBatch.from_arrays([pa.array([min(own, b)]), pa.array([max(own, b)]), *one.columns], ["a", "b", *one.schema.names])

    columns = "h1 binary, h2 binary, id binary, weight binary, v binary"
    kept = nodes.select("h1", "h2", "id", "weight", "v").mapInArrow(placed, f"cell long, block long, h1 long, h2 long, id long, weight long, v array<{kind}>")
    packs = checkpointed(kept.groupBy("cell", "block").applyInArrow(packed, f"cell long, block long, {columns}"))
    pairs = packs.mapInArrow(spread, f"a long, b long, cell long, block long, {columns}")
    found = checkpointed(linked(pairs, d, turn, cosine, np.dtype(np.float32 if kind == "float" else np.float64)))
    counts = found.groupBy("h1", "h2").agg(F.sum("links").alias("links"))
    edges = found.select(F.col("id").alias("a"), F.col("low").alias("b"))
    lows = components(edges).groupBy("id").agg(F.min("component").alias("component"))
    known_nodes = nodes.select("h1", "h2", "id", "weight").join(counts, ["h1", "h2"], "left").join(lows, "id", "left")
    known_nodes = known_nodes.select("h1", "h2", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = known.join(known_nodes, (known["h1"] == known_nodes["h1"]) & (known["h2"] == known_nodes["h2"]) & known["v"].isNotNull(), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


SQL = r"""
WITH RECURSIVE u AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS s FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.vec_id < y.vec_id WHERE list_dot_product(x.v, y.v) >= 0.9 * x.s * y.s),
z AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM z GROUP BY 1),
r(vec_id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT z.b, r.root FROM r JOIN z ON z.a = r.vec_id)
SELECT vec_id, coalesce(any_value(n.n_links), 0) AS n_links, min(root) AS component_id, vec_id = min(root) AS kept FROM r LEFT JOIN n USING (vec_id) GROUP BY vec_id
"""
