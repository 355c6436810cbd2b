"""Boosted regression trees on Spark: rows stay as binned blocks where they are, and models asked for together share every job.

Histograms of a level are added up where the rows lie; the driver sees sums by bin only. As Spark ML's own boosting for squared error, the
first tree has weight 1 and later ones are fitted to twice the residual and weighted by the step. Models of few rows (MOST_ROWS at most, or
ALONE if they are many) grow in one job: the rows of each are dealt to one part, whose task needs no other's sums. Of larger ones a level of
all models is one job. Their rows lie in files of the shared folder, which tasks look at where they are; where only Spark reads that folder
they are kept in its cache and brought to the tasks for every level.
"""

from __future__ import annotations

import os
import pickle
import shutil
import threading
import uuid
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce
from itertools import chain
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthspan.session import shared_folder

BINS, SLABS = 32, 4096
CODES = 4096  # bins of several features are kept as one code while their product is no larger
RUN = 1 << 17  # rows that are moved and summed at a time
ROWS_PER_PART, MOST_ROWS = 50_000, 2_000_000
ALONE = 16_000_000  # rows of a model up to which one part may hold them all, in a gigabyte at most
FILED = 8_000_000  # rows of a part whose rows lie in files, about 50 bytes each while a task reads them
CUT = 20  # trees after which the lineage is cut; until then every job carries the rounds before it, so those hold feature and bin numbers only

_asked = threading.local()


@dataclass
class Model:
    """Thresholds of every feature and, for each tree, its weight, the feature and bin of each inner node, and the leaves."""

    cuts: list[np.ndarray]
    depth: int
    trees: list[tuple[float, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def predict(self, x: np.ndarray) -> np.ndarray:
        layout, out = _Layout([len(c) + 1 for c in self.cuts], self.depth), np.zeros(len(x))
        codes = layout.codes([np.searchsorted(c, x[:, f]) for f, c in enumerate(self.cuts)])
        for weight, feature, most, leaves in self.trees:
            node = np.zeros(len(x), layout.kind)
            for d in range(self.depth):
                own = slice((1 << d) - 1, (1 << (d + 1)) - 1)
                _move(node, codes, layout.moves(feature[own], most[own]))
            out += (weight * leaves).take(node)
        return out

    def transform(self, rows: DataFrame) -> DataFrame:
        """The rows with their `prediction`."""
        score = F.arrow_udf(lambda v: pa.array(self.predict(_matrix(v))), "double")
        return rows.withColumn("prediction", score(vector_to_array("features")))


@dataclass
class _Layout:
    """How features are dealt to codes, and where their bins begin in a histogram."""

    sizes: list[int]
    depth: int = 4

    def __post_init__(self):
        # one bit for each node of the last level that is split
        self.kind = next((k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if 8 * np.dtype(k).itemsize >= 1 << (self.depth - 1)), None)
        if self.kind is None:
            raise ValueError("trees may be seven levels deep")
        # the largest first, each where it first fits: few groups, so few sums a row
        self.groups, products = [], []
        for f in sorted(range(len(self.sizes)), key=lambda f: -self.sizes[f]):
            at = next((b for b, n in enumerate(products) if n * self.sizes[f] <= CODES), None)
            if at is None:
                self.groups.append([])
                products.append(1)
                at = -1
            self.groups[at].append(f)
            products[at] *= self.sizes[f]
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)]).astype(int)
        self.shapes = [[self.sizes[f] for f in g] for g in self.groups]
        self.widths = [int(np.prod(s)) for s in self.shapes]
        self.home = {f: (b, k) for b, g in enumerate(self.groups) for k, f in enumerate(g)}

    def codes(self, binned: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.ravel_multi_index([binned[f] for f in g], s) for g, s in zip(self.groups, self.shapes)]).astype(np.uint16)

    def moves(self, features: np.ndarray, most: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """For the nodes of a level: (group of features, by its code a bit for each node, set where its rows go right)."""
        found: dict = {}
        for n, (f, b) in enumerate(zip(features, most)):
            block, k = self.home[f]
            right = np.unravel_index(np.arange(self.widths[block]), self.shapes[block])[k] > b
            table = found.setdefault(block, np.zeros(self.widths[block], self.kind))
            table |= right.astype(self.kind) << self.kind(n)
        return list(found.items())

    def folded(self, full: list[np.ndarray], nodes: int) -> np.ndarray:
        """Sums by node and bin of every feature, from those by node and code."""
        out = np.zeros((2, nodes, self.starts[-1]))
        for group, shape, sums in zip(self.groups, self.shapes, full):
            own = sums.reshape(2, nodes, *shape)
            for k, f in enumerate(group):
                out[:, :, self.starts[f] : self.starts[f + 1]] = own.sum(axis=tuple(a for a in range(2, own.ndim) if a != k + 2))
        return out


def _move(node: np.ndarray, codes: np.ndarray, step) -> None:
    """From the nodes of a level to those of the next, in place."""
    bits = None
    for block, table in step:
        found = table.take(codes[block])
        bits = found if bits is None else np.bitwise_or(bits, found, out=bits)
    bits >>= node
    bits &= bits.dtype.type(1)
    node += node
    node += bits


class _Rows:
    """Rows of one model: codes, what is left of the labels, draws. Where they got to in a tree is kept, and found again after a copy."""

    def __init__(self, codes: np.ndarray, left: np.ndarray, draw: np.ndarray):
        self.codes, self.left, self.draw, self.at = codes, left, draw, None

    def __getstate__(self):
        return self.codes, self.left, self.draw

    def __setstate__(self, held):
        self.__init__(*held)

    def _runs(self, layout: _Layout, tree: int, splits, share: float):
        """Moves the rows to where the splits lead, a run of rows at a time; gives each run with its nodes and whether its rows are drawn."""
        n = len(self.left)
        if self.at is None or self.at[0] != tree:
            self.node, self.drawn, self.at = np.zeros(n, layout.kind), np.empty(n, bool), (tree, -1)
        done, steps = self.at[1], [layout.moves(*s) for s in splits[max(self.at[1], 0) :]]
        for a in range(0, n, RUN):
            own = slice(a, a + RUN)
            node, drawn = self.node[own], self.drawn[own]
            if done < 0:
                drawn[:] = _drawn(self.draw[own], tree, share)
            for step in steps:
                _move(node, self.codes[:, own], step)
            yield own, node, drawn
        self.at = (tree, len(splits))

    def histogram(self, layout: _Layout, tree: int, splits, lesser, share: float) -> np.ndarray:
        """Rows and sums by node and bin of the drawn rows; below the root only of each parent's lesser child."""
        nodes = len(lesser) if splits else 1
        full = [np.zeros((2, nodes * w)) for w in layout.widths]
        if splits:
            wanted = np.zeros(2 * nodes, bool)
            wanted[2 * np.arange(nodes) + lesser] = True
        for own, node, drawn in self._runs(layout, tree, splits, share):
            keep = np.flatnonzero(drawn & wanted.take(node) if splits else drawn)
            left, parent = self.left[own].take(keep), node.take(keep).astype(np.intp) >> 1 if nodes > 1 else None
            for b, width in enumerate(layout.widths):
                at = self.codes[b, own].take(keep).astype(np.intp)
                if nodes > 1:
                    at += parent * width
                full[b][0] += np.bincount(at, minlength=nodes * width)
                full[b][1] += np.bincount(at, left, nodes * width)
        out = layout.folded(full, nodes)
        out[1] *= 2 if tree else 1
        return out

    def advance(self, layout: _Layout, tree: int, splits, leaves: np.ndarray, share: float) -> "_Rows":
        """After a tree: its leaves are taken from what is left."""
        for own, node, _ in self._runs(layout, tree, splits, share):
            self.left[own] -= leaves.take(node)
        self.at = None
        return self


def _matrix(lists) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(lists), -1)


def _blocks(train: DataFrame, number: int, made, schema: str, whole: bool = True) -> DataFrame:
    """What `made(number, (values, labels, draws) of each Arrow batch)` yields; a row's draw depends on the row alone. Not `whole`: values only."""
    others = [c for c, kind in train.dtypes if c != "features" and kind not in ("vector", "map")]
    rows = train.select(vector_to_array("features").alias("v"), *([F.col("label").cast("double"), F.xxhash64(*others).bitwiseAND(0xFFFFFFFF).alias("draw")] if whole else []))

    def opened(batches):
        for b in batches:
            if b.num_rows:
                yield _matrix(b.column(0)), *([b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy().astype(np.uint32)] if whole else [])

    def run(batches):
        yield from (pa.RecordBatch.from_arrays([pa.array([v]) for v in found], names) for found in made(number, opened(batches)))

    names = [c.split()[0] for c in schema.split(", ")]
    return rows.mapInArrow(run, schema)


def _merged(found, fold) -> dict:
    """Values by model, from (model, value) pairs of all parts."""
    out: dict = {}
    for number, value in found:
        out[number] = fold(out[number], value) if number in out else value
    return out


def _tallied(trains: list[DataFrame], one, fold) -> dict:
    """For each model the fold of `one(model, values)` over all its rows, in one job."""

    def made(number, blocks):
        values = [reduce(fold, (one(number, x) for x, in blocks))] if (blocks := _some(blocks)) else []
        return ((number, pickle.dumps(v)) for v in values)

    rows = [_blocks(t, m, made, "m long, v binary", whole=False) for m, t in enumerate(trains)]
    return _merged(((r.m, pickle.loads(r.v)) for r in reduce(DataFrame.unionAll, rows).collect()), fold)


def _some(it):
    """The same again, or None if there is nothing in it."""
    first = next(it, None)
    return None if first is None else chain([first], it)


def _coded(trains: list[DataFrame], models: list[Model], layouts: list[_Layout]):
    """An RDD of (model, codes, labels, draws), a block for each Arrow batch."""
    cuts = [model.cuts for model in models]

    def made(m, blocks):
        for x, y, draw in blocks:
            yield m, layouts[m].codes([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts[m])]).tobytes(), y.astype(float).tobytes(), draw.tobytes()

    def opened(r):
        y = np.frombuffer(r.y)
        return r.m, np.frombuffer(r.codes, np.uint16).reshape(-1, len(y)), y, np.frombuffer(r.draw, np.uint32)

    sc = trains[0].sparkSession.sparkContext
    return sc.union([_blocks(t, m, made, "m long, codes binary, y binary, draw binary").rdd.map(opened) for m, t in enumerate(trains)])


def _rows_of(part) -> dict:
    """The rows of each model in this part."""
    held: dict = {}
    for m, *block in part:
        held.setdefault(m, []).append(block)
    return {m: _Rows(*(np.concatenate(a, axis=-1) for a in zip(*held.pop(m)))) for m in list(held)}


def _slab(x, low, high):
    wide = np.where(high > low, high - low, 1.0)
    return np.nan_to_num(np.clip((x - low) / wide * SLABS, 0, SLABS - 1)).astype(np.int64)


def _cuts(tally: np.ndarray, low: float, high: float) -> np.ndarray:
    """Thresholds between the values, or, of many, between the 32 parts of equal numbers of rows; all rows are counted."""
    there = np.flatnonzero(tally)
    last = np.arange(len(there) - 1)
    if len(there) > BINS:
        total = np.cumsum(tally[there])
        last = np.unique(np.searchsorted(total, total[-1] * np.arange(1, BINS) / BINS))
        last = last[last < len(there) - 1]
    return low + (high - low) / SLABS * (there[last] + 1 + there[last + 1]) / 2


def _drawn(draw, tree, share):
    """Whether a row is in the tree's sample."""
    h = draw.astype(np.uint64)
    h += np.uint64((tree + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(32)) < np.uint64(int(share * 2**32))


def _split(layout: _Layout, hist: np.ndarray):
    """Of each node: feature, last bin that goes left, and rows and sums of both children. Without a gain all rows go left."""
    nodes = hist.shape[1]
    total = np.cumsum(hist[:, :, : layout.starts[1]], axis=2)[:, :, -1]  # in one order on every machine
    best, feature, most = np.zeros(nodes), np.zeros(nodes, np.int64), np.full(nodes, layout.sizes[0] - 1)
    left = total.copy()
    for f, n in enumerate(layout.sizes):
        if n < 2:
            continue
        upto = np.cumsum(hist[:, :, layout.starts[f] : layout.starts[f + 1]], axis=2)[:, :, :-1]
        over = total[:, :, None] - upto
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = upto[1] ** 2 / upto[0] + over[1] ** 2 / over[0] - (total[1] ** 2 / total[0])[:, None]
        gain = np.where((upto[0] >= 1) & (over[0] >= 1), gain, 0.0)
        at = gain.argmax(axis=1)
        top = gain[np.arange(nodes), at]
        better = top > np.maximum(best * (1 + 1e-9), 1e-12)  # features that split alike: the first
        best, feature, most = np.where(better, top, best), np.where(better, f, feature), np.where(better, at, most)
        left = np.where(better, upto[:, np.arange(nodes), at], left)
    return feature, most, left, total - left


def _paired(a, b):
    """Children of every node side by side, along the axis of nodes."""
    return np.stack([a, b], axis=2).reshape(a.shape[0], -1, *a.shape[2:])


def fit_together(trains: list[DataFrame], trees: int, depth: int, step: float, share: float) -> list[Model]:
    """Models of all given rows (`features`, `label`); `share` of the rows is drawn for each tree, by a hash of row and tree."""
    spark = trains[0].sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark))
    ends = _tallied(trains, lambda m, x: (len(x), np.nanmin(x, axis=0), np.nanmax(x, axis=0)), lambda a, b: (a[0] + b[0], np.fmin(a[1], b[1]), np.fmax(a[2], b[2])))
    if len(ends) < len(trains):
        raise ValueError("no rows to train on")
    tallies = _tallied(trains, lambda m, x: np.stack([np.bincount(s, minlength=SLABS) for s in _slab(x, *ends[m][1:]).T]), np.add)
    models = [Model([_cuts(t, a, b) for t, a, b in zip(tallies[m], *ends[m][1:])], depth) for m in range(len(trains))]
    layouts = [_Layout([len(c) + 1 for c in model.cuts], depth) for model in models]
    rows = {m: e[0] for m, e in sorted(ends.items(), key=lambda e: -e[1][0])}
    for way, group in _groups(rows, sc.defaultParallelism, _plain(sc)):
        coded = _coded([trains[m] for m in group], [models[m] for m in group], [layouts[m] for m in group])
        own = {k: layouts[m] for k, m in enumerate(group)}
        if way is _alone:
            found = dict(coded.map(lambda e: (e[0], e)).partitionBy(len(group), lambda k: k).values().mapPartitions(lambda part: _alone(part, own, trees, depth, step, share)).collect())
        else:
            found = way(coded, sum(rows[m] for m in group), own, trees, depth, step, share)
        for k, m in enumerate(group):
            models[m].trees = found[k]
    return models


def _plain(sc) -> str | None:
    """The shared folder as a path that executors open themselves, or None where only Spark reads and writes it."""
    folder = sc.getCheckpointDir()  # with its file system named, whatever the default is
    return urlparse(folder).path if folder.startswith("file:") else None


def _groups(rows: dict[int, int], slots: int, folder: str | None) -> list:
    """How the models, the largest first, are fitted: (way, those fitted together)."""
    alone = [m for m, n in rows.items() if n <= ALONE]
    if 2 * len(alone) < slots:  # too few to keep the tasks busy, unless they are soon done
        alone = [m for m in alone if rows[m] <= min(MOST_ROWS, ALONE)]
    return [(way, group) for way, group in ((_filed if folder else _spread, [m for m in rows if m not in alone]), (_alone, alone)) if group]


def _alone(part, layouts, trees, depth, step, share):
    """(model, trees) of each model whose rows are all in this part, in an order of their own: which block came first does not count."""
    for m, rows in _rows_of(part).items():
        order, found = np.lexsort((rows.left, rows.draw)), []
        rows = _Rows(np.stack([c[order] for c in rows.codes]), rows.left[order], rows.draw[order])
        for t in range(trees):
            tree, last = _tree({m: layouts[m]}, depth, step if t else 1.0, lambda splits, lesser: {m: rows.histogram(layouts[m], t, splits[m], lesser[m], share)})
            found.append(tree[m])
            rows.advance(layouts[m], t, *last[m], share)
        yield m, found


class _Files:
    """Rows of one model and part in files of the shared folder. A level reads files that it does not write, so a task may run again."""

    def __init__(self, path: str):
        self.path = path

    def put(self, **arrays):
        for kind, a in arrays.items():
            new = f"{self.path}-{kind}-{uuid.uuid4().hex}"
            with open(new, "wb") as out:
                np.save(out, a)
            os.replace(new, f"{self.path}-{kind}.npy")

    def get(self, kind: str, seen: bool = True) -> np.ndarray:
        """Pages of the file as they are looked at, or a copy that may be changed."""
        return np.load(f"{self.path}-{kind}.npy", mmap_mode="r" if seen else None)

    def rows(self, tree: int, level: int, seen: bool = True) -> _Rows:
        """The rows of a tree as its level left them."""
        rows = _Rows(self.get("codes"), self.get(f"left{tree % 2}", seen), self.get("draw"))
        if level:
            rows.node, rows.drawn, rows.at = self.get(f"node{level}", False), self.get(f"drawn{tree % 2}"), (tree, level)
        return rows

    def histogram(self, layout, tree, splits, lesser, share, last) -> np.ndarray:
        if splits:
            rows = self.rows(tree, len(splits) - 1)
            if rows.at is None:
                rows.node, rows.drawn, rows.at = np.zeros(len(rows.left), layout.kind), self.get(f"drawn{tree % 2}"), (tree, 0)
        elif tree:
            rows = self.rows(tree - 1, layout.depth - 1, False).advance(layout, tree - 1, *last, share)
            self.put(**{f"left{tree % 2}": rows.left})
        else:
            rows = self.rows(0, 0)
        out = rows.histogram(layout, tree, splits, lesser, share)
        self.put(**({f"node{len(splits)}": rows.node} if splits else {f"drawn{tree % 2}": rows.drawn}))
        return out


def _filed(coded, rows, layouts, trees, depth, step, share) -> dict:
    """Trees of models whose rows lie in the shared folder; a level of all of them is one job, to which Spark brings sums only."""
    sc, found, last = coded.context, {m: [] for m in layouts}, dict.fromkeys(layouts)
    slots = sc.defaultParallelism
    parts = slots * -(-rows // (slots * FILED))
    folder = f"{_plain(sc)}/boosting-{uuid.uuid4().hex}"
    deal = lambda split, part: (((split + n) % parts, e) for n, e in enumerate(part))

    def write(part, rows):
        os.makedirs(folder, exist_ok=True)
        for m, own in _rows_of(rows).items():
            _Files(f"{folder}/{m}-{part}").put(codes=own.codes, left0=own.left, draw=own.draw)
            yield part, m

    try:
        there = coded.mapPartitionsWithIndex(deal).partitionBy(parts, lambda k: k).values().mapPartitionsWithIndex(write).collect()
        own = sc.parallelize([[m for part, m in there if part == k] for k in range(parts)], parts)
        for t in range(trees):

            def level(splits, lesser, t=t, last=last):
                def one(part, held):
                    return _merged(((m, _Files(f"{folder}/{m}-{part}").histogram(layouts[m], t, splits[m], lesser[m], share, last[m])) for names in held for m in names), np.add).items()

                return _merged(own.mapPartitionsWithIndex(one).collect(), np.add)

            tree, last = _tree(layouts, depth, step if t else 1.0, level)
            for m, made in tree.items():
                found[m].append(made)
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    return found


def _spread(coded, rows, layouts, trees, depth, step, share) -> dict:
    """Trees of models whose rows stay where they are; a level of all of them is one job."""
    sc, found = coded.context, {m: [] for m in layouts}
    parts = max(1, min(-(-rows // ROWS_PER_PART), sc.defaultParallelism), -(-rows // MOST_ROWS))
    state = coded if coded.getNumPartitions() <= parts else coded.coalesce(parts)
    state, before, last = state.mapPartitions(lambda part: _rows_of(part).items()).persist(StorageLevel.MEMORY_AND_DISK), None, None
    for t in range(trees):
        if t:
            moved = lambda e, t=t, last=last: (e[0], e[1].advance(layouts[e[0]], t - 1, *last[e[0]], share))
            before, state = state, state.map(moved).persist(StorageLevel.MEMORY_AND_DISK)
            if t % CUT == 0:
                state.checkpoint()

        def level(splits, lesser, state=state, before=before, t=t):
            one = lambda part: ((m, r.histogram(layouts[m], t, splits[m], lesser[m], share)) for m, r in part)
            sums = _merged(state.mapPartitions(lambda part: _merged(one(part), np.add).items()).collect(), np.add)
            if before is not None and not any(splits.values()):
                before.unpersist()
            return sums

        tree, last = _tree(layouts, depth, step if t else 1.0, level)
        for m, own in tree.items():
            found[m].append(own)
    state.unpersist()
    return found


def _tree(layouts: dict, depth: int, weight: float, level) -> tuple[dict, dict]:
    """A tree of each model, and what moves its rows on; `level(splits, lesser)` gives the sums of the next level."""
    splits, hists, kids, lesser = {m: [] for m in layouts}, {}, {}, dict.fromkeys(layouts)
    for d in range(depth):
        sums = level(splits, lesser)
        for m, layout in layouts.items():
            own = sums[m]
            if d:
                other, right = hists[m] - own, lesser[m][:, None].astype(bool)
                own = _paired(np.where(right, other, own), np.where(right, own, other))
            feature, most, a, b = _split(layout, own)
            splits[m].append((feature, most))
            hists[m], kids[m], lesser[m] = own, _paired(a, b), (b[0] < a[0]).astype(np.int64)
    leaves = {m: np.divide(k[1], k[0], out=np.zeros(1 << depth), where=k[0] >= 0.5) for m, k in kids.items()}
    trees = {m: (weight, np.concatenate([f for f, _ in s]), np.concatenate([b for _, b in s]), leaves[m]) for m, s in splits.items()}
    return trees, {m: (s, weight * leaves[m]) for m, s in splits.items()}


@contextmanager
def together(trains: list[DataFrame]):
    """Inside, the first `fit` of one of these also fits the others, in the same jobs."""
    _asked.trains, _asked.models = list(trains), None
    try:
        yield
    finally:
        _asked.trains = _asked.models = None


def fit(train: DataFrame, trees: int, depth: int = 4, step: float = 0.05, share: float = 0.8) -> Model:
    """One model, or its part of those asked for together."""
    waiting = getattr(_asked, "trains", None) or []
    own = [k for k, t in enumerate(waiting) if t is train]
    if not own:
        return fit_together([train], trees, depth, step, share)[0]
    if _asked.models is None:
        _asked.models = fit_together(waiting, trees, depth, step, share)
    return _asked.models[own[0]]
