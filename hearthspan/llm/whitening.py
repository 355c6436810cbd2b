"""Whitening by polarisation.

Entries become whole numbers, so that everything up to the covariance is exact: the sums of the distinct vectors, then, for
every dimension and every sum of two dimensions, the sum of squared centred values. The variance of a sum of two dimensions
less both variances is twice their covariance, so squares alone recover the whole matrix, which the driver takes apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthspan.llm.vectors import finite, limbs, matrix, summed, usual_length
from hearthspan.session import checkpointed

SCALE = 64
SHIFT = 1_000_000
WIDEST = 2.0**60
ROWS = 1 << 12  # rows squared at once; sums of that many squares of 48-bit limbs stay below 2^62


def whole(vector: str, scale: int = SCALE, shift: int = SHIFT):
    """floor(scale * entry) + shift, as long; what would pass 2^60 stays there."""
    bound = lambda c: F.greatest(F.least(c, F.lit(WIDEST)), F.lit(-WIDEST))
    return F.transform(vector, lambda c: F.floor(bound(c.cast("double") * float(scale))) + F.lit(shift))


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S: as int64 where that is safe, else as Python's whole numbers. sums: S as objects."""
    top = int(np.abs(x).max(initial=0)) * n + max(map(abs, sums.tolist()), default=0)
    if top < 1 << 61:
        return x * np.int64(n) - sums.astype(np.int64)
    return x.astype(object) * n - sums


def squares(z: np.ndarray) -> list[int]:
    """Exact sums of squares by column, ROWS rows at most."""
    top = int(np.abs(z).max(initial=0)) if z.size else 0
    if top * top * len(z) < 1 << 62:
        return np.einsum("ri,ri->i", z, z).tolist()
    if top < 1 << 47:
        high, low = z >> 24, z & 0xFFFFFF
        parts = (np.einsum("ri,ri->i", a, b).tolist() for a, b in ((high, high), (high, low), (low, low)))
        return [(a << 48) + (b << 25) + c for a, b, c in zip(*parts)]
    return [sum(v * v for v in column) for column in z.T.astype(object).tolist()]


def totals(fit: DataFrame, d: int) -> tuple[int, np.ndarray]:
    """Number of vectors and exact sums of every dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, found = 0, np.zeros(d, object)
        for batch in batches:
            x = matrix(batch.column("x"), d)
            count += len(x)
            found = found + (x.sum(axis=0) if int(np.abs(x).max(initial=0)) * len(x) < 1 << 62 else x.astype(object).sum(axis=0)).astype(object)
        yield from limbs([(-1, count), *enumerate(map(int, found.tolist()))])

    got = summed(fit.mapInArrow(run, "key long, limb int, value long"))
    return got.get(-1, 0), np.array([got.get(i, 0) for i in range(d)], object)


def covariance(fit: DataFrame, d: int, n: int, sums: np.ndarray) -> np.ndarray:
    """Exact covariances of the distinct vectors (divisor n), each rounded once to double."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single, double = [0] * d, [[0] * (d - i - 1) for i in range(d)]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                y = centred(matrix(batch.column("x").slice(at, ROWS), d), n, sums)
                single = [a + b for a, b in zip(single, squares(y))]
                for i in range(d - 1):
                    double[i] = [a + b for a, b in zip(double[i], squares(y[:, i + 1 :] + y[:, i : i + 1]))]
        yield from limbs((i * d + j, q) for i in range(d) for j, q in enumerate([single[i], *double[i]], i))

    got = summed(fit.mapInArrow(run, "key long, limb int, value long"))
    q = lambda i, j: got.get(i * d + j, 0)
    v = np.zeros((d, d))
    for i in range(d):
        v[i, i] = q(i, i) / n**3
        for j in range(i + 1, d):
            v[i, j] = v[j, i] = (q(i, j) - q(i, i) - q(j, j)) / (2 * n**3)
    return v


def projection(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(unit eigenvectors as columns, eigenvalues) of the k largest eigenvalues, and how many of these are variance, not rounding."""
    e, w = np.linalg.eigh(v)
    e, w = e[::-1][:k], w[:, ::-1][:, :k]
    w = w * np.where(np.take_along_axis(w, np.abs(w).argmax(axis=0)[None, :], 0) < 0, -1.0, 1.0)
    return w, e, int((e > len(v) * np.finfo(float).eps * max(e[0], 0)).sum())


def identity_error(fit: DataFrame, d: int, n: int, sums: np.ndarray, turn: np.ndarray) -> float | None:
    """Largest absolute entry of the covariance of the whitened distinct vectors minus the identity."""
    k = turn.shape[1]
    if not k:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((k, k))
        for batch in batches:
            w = centred(matrix(batch.column("x"), d), n, sums).astype(float) / n @ turn
            found += w.T @ w
        yield pa.RecordBatch.from_pydict({"key": pa.array(np.arange(k * k)), "value": pa.array(found.ravel())})

    got = fit.mapInArrow(run, "key long, value double").groupBy("key").agg(F.sum("value")).collect()
    return max(abs(value / n - (key // k == key % k)) for key, value in got)


def whitened(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = 16, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """For each row and each of the first k components: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or empty, holds null or non-finite entries, or has not the commonest length are dropped. Repeated rows
    each have their result, but count once in the fit; so do different rows that are equal as whole numbers; a null vec_id stays
    null. With fewer than k dimensions there are as many components. A component without variance (one distinct vector, flat
    dimensions) has whitened null. A deviation that doesn't fit a long is null; entries beyond 2^60 / scale count as that. An empty
    table gives no rows; other columns are ignored.

    The driver holds one number a pair of dimensions, whatever the rows.
    """
    out = "vec_id {}, component int, n long, deviation long, whitened double, explained double, identity_error double".format(dict(rows.dtypes)[vec_id])
    usable = rows.where(finite(vector)).select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v"))
    d = usual_length(usable, "v")
    if not d:
        return rows.sparkSession.createDataFrame([], out)
    coded = usable.where(F.size("v") == d).select("vec_id", whole("v", scale, shift).alias("x"))
    fit = checkpointed(coded.select("x").distinct())
    n, sums = totals(fit, d)
    v = covariance(fit, d, n, sums)
    w, e, real = projection(v, min(k, d))
    turn = w[:, :real] / np.sqrt(e[:real])
    trace = float(np.trace(v))
    explained = np.maximum(e, 0) / trace if trace > 0 else np.zeros(len(e))
    off = identity_error(fit, d, n, sums, turn)
    k = len(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                y = centred(matrix(part.column("x"), d), n, sums)
                top = int(np.abs(y).max(initial=0))
                dev = pa.array((y * y).sum(axis=1), pa.int64()) if top * top * d < 1 << 63 and y.dtype != object else pa.array([q if (q := sum(int(c) ** 2 for c in r)) < 1 << 63 else None for r in y.tolist()], pa.int64())
                white = np.full((len(y), k), np.nan)
                white[:, :real] = y.astype(float) / n @ turn
                each = pa.array(np.repeat(np.arange(len(y)), k))
                yield pa.RecordBatch.from_pydict({
                    "vec_id": part.column("vec_id").take(each), "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(y))), "n": pa.array(np.full(len(y) * k, n)),
                    "deviation": dev.take(each), "whitened": pa.array(white.ravel(), from_pandas=True), "explained": pa.array(np.tile(explained, len(y))),
                    "identity_error": pa.array([off] * (len(y) * k), pa.float64()),
                })

    return coded.mapInArrow(run, out)
