import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql.types import ArrayType, DoubleType, FloatType, LongType, StringType, StructField, StructType

from hearthspan.llm import vector_dedup, whitening


@pytest.fixture(scope="module")
def vectors_of(spark):
    def make(rows, kind=FloatType):
        clash = [StructField(c, StringType()) for c in ("x", "v", "id", "h1", "weight", "cell", "block", "component", "n", "links")]
        return spark.createDataFrame([(*r, *["y"] * 10) for r in rows], StructType([StructField("vec_id", LongType()), StructField("embedding", ArrayType(kind())), *clash]))

    return make


def odd(d):
    return [(900, None), (901, []), (902, [0.0] * d), (903, [None] + [1.0] * (d - 1)), (904, [float("nan")] * d), (905, [float("inf")] + [0.0] * (d - 1)), (906, [1.0] * (d + 1))]


def clustered(n, d, seed=3, spread=0.3):
    rng = np.random.default_rng(seed)
    heads = rng.normal(size=(n // 8 + 1, d))
    v = heads[rng.integers(0, len(heads), n)] + rng.normal(size=(n, d)) * spread
    return v.astype(np.float32)


def brute_near(rows, d, cosine):
    usable = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and len(v) == d and None not in v and np.isfinite(v).all() and any(v)}
    ids = sorted(usable)
    root = {i: i for i, _ in rows if i is not None}
    count = defaultdict(int)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            x, y = usable[i], usable[j]
            if x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= cosine:
                count[i] += 1
                count[j] += 1
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {(i, count[i], find(i), find(i) == i) for i in root}


@pytest.mark.parametrize("d,block_bytes", [(40, 1 << 14), (5, 1 << 21), (64, 1 << 21)])
def test_near_vectors_against_all_pairs(vectors_of, d, block_bytes):
    v = clustered(400, d)
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(500 + i, rows[7][1]) for i in range(30)] + [(600 + i, [2.0 * c for c in rows[9][1]]) for i in range(3)] + odd(d)
    got = vector_dedup.near_vectors(vectors_of(rows), block_bytes=block_bytes)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert {tuple(r) for r in got.collect()} == brute_near(rows, d, 0.9)


def test_near_vectors_as_doubles_ties_and_empty(vectors_of, spark):
    exact = [(1, [1.0, 0.0]), (2, [0.9, math.sqrt(1 - 0.81)]), (3, [-1.0, -0.0]), (4, [-1.0, 0.0]), (None, [1.0, 0.0])]
    got = {r.vec_id: tuple(r)[1:] for r in vector_dedup.near_vectors(vectors_of(exact, DoubleType)).collect()}
    x = np.array(exact[1][1])
    linked = x[0] / math.sqrt(x @ x) >= 0.9
    assert got[1] == (int(linked), 1, True) and got[2] == (int(linked), 1 if linked else 2, not linked)
    assert got[3] == (1, 3, True) and got[4] == (1, 3, False) and got[None] == (0, None, False)
    assert vector_dedup.near_vectors(vectors_of([])).count() == 0
    assert [tuple(r) for r in vector_dedup.near_vectors(vectors_of([(1, None)])).collect()] == [(1, 0, 1, True)]


def test_cells_far_apart_never_meet():
    rng = np.random.default_rng(1)
    u = vector_dedup.unit(np.repeat(np.eye(8), 50, axis=0) + rng.normal(size=(400, 8)) * 0.01)
    cells = vector_dedup.Cells(u, 8)
    cell = cells.of(u)
    n = np.bincount(cell, minlength=8)
    lo, hi = (np.stack([f(u[cell == c], axis=0) if n[c] else np.full(8, np.nan) for c in range(8)]) for f in (np.min, np.max))
    meets = np.unpackbits(vector_dedup.partners(n, lo, hi, 0.9), axis=1, count=8).astype(bool)
    met = {(a, b) for a, b in zip(cell[:, None].repeat(400, 1).ravel(), cell[None, :].repeat(400, 0).ravel()) if meets[a, b]}
    near = {(a, b) for i, j in zip(*np.nonzero(u @ u.T >= 0.9)) for a, b in [(cell[i], cell[j])]}
    assert near <= met and len(met) == 8


def brute_whitened(rows, d, k=16):
    x = {i: [math.floor(64 * c) + 1000000 for c in v] for i, v in rows if v is not None and len(v) == d and None not in v and np.isfinite(v).all()}
    fit = sorted({tuple(v) for v in x.values()})
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array([[n * a - b for a, b in zip(v, s)] for v in fit], object)
    v = (y.T @ y / n**3).astype(float)
    e, w = np.linalg.eigh(v)
    e, w = e[::-1], w[:, ::-1]
    dev = {i: sum((n * a - b) ** 2 for a, b in zip(v, s)) for i, v in x.items()}
    white = {i: ((np.array(v, float) - np.array([float(b) / n for b in s])) @ w[:, :k]) / np.sqrt(e[:k]) for i, v in x.items()}
    return n, dev, white, e / e.sum()


@pytest.mark.parametrize("d,scale", [(24, 1.0), (10, 1e9)])
def test_whitened_against_exact_arithmetic(vectors_of, d, scale):
    v = clustered(300, d, spread=1.0) * scale
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(400 + i, v[3].tolist()) for i in range(20)] + [(None, v[5].tolist())] + [r for r in odd(d) if r[0] != 902]
    got = whitening.whitened(vectors_of(rows)).collect()
    n, dev, white, explained = brute_whitened(rows, d)
    k = min(16, d)
    assert len(got) == 321 * k and {r.n for r in got} == {n}
    by = defaultdict(dict)
    for r in got:
        by[r.component][r.vec_id] = r
    for c in range(1, k + 1):
        one, ref = by[c], np.array([white[i][c - 1] for i in sorted(white, key=str)])
        own = np.array([one[i].whitened for i in sorted(white, key=str)])
        assert min(abs(own - ref).max(), abs(own + ref).max()) < 1e-6
        assert all(r.deviation == (dev[i] if dev[i] < 1 << 63 else None) for i, r in one.items())
        assert all(abs(r.explained - explained[c - 1]) <= 1e-9 and r.identity_error < 1e-6 for r in one.values())


def test_squares_of_every_width():
    rng = np.random.default_rng(2)
    for top in (1 << 20, 1 << 40, 1 << 50):
        z = rng.integers(-top, top, (100, 3))
        assert whitening.squares(z) == [sum(int(c) ** 2 for c in col) for col in z.T]


def test_whitened_without_variance_and_empty(vectors_of):
    one = whitening.whitened(vectors_of([(1, [0.5, 0.5]), (2, [0.5, 0.5])])).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one) == [(i, c, 1, 0, None, 0.0, None) for i in (1, 2) for c in (1, 2)]
    flat = whitening.whitened(vectors_of([(1, [0.5, 0.5]), (2, [0.25, 0.5])])).collect()
    assert {r.whitened for r in flat if r.component == 1} == {1.0, -1.0} and {r.whitened for r in flat if r.component == 2} == {None}
    assert whitening.whitened(vectors_of([])).count() == 0 and whitening.whitened(vectors_of([(1, None)])).count() == 0
