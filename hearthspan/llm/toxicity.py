"""Toxicity by a convolutional text classifier in numpy.

A word's embedding is the mean of hashed vectors of the word and its leading letters. Filters of several widths run over the
words, the largest response of each filter goes into a logistic score. Embeddings, filters and output weights are trained by
gradient descent through the maximum; the first embedding dimension starts from each bucket's log odds. Thresholds are then
set for each language on labelled rows that training did not see; which language a text is in is told from its words, too.

All labelled rows outside the held-out fold take part. They are hashed once and lie in parts of about 32 MB of text; every part
starts a round from the same model, passes once over its own texts, and the changes of all parts are averaged on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthspan.llm.chunks import slices
from hearthspan.llm.common import held_out, mixed, ragged, strings, take
from hearthspan.llm.shingles import BYTE, STEP, powers
from hearthspan.session import checkpointed

LETTER = np.isin(np.arange(256), [*range(ord("a"), ord("z") + 1), *range(128, 256)])
LEADS = (4, 5, 6, 7, 8)
BUCKETS = 1 << 18
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
PART, LARGE = 32 << 20, 64 << 20  # bytes of text that one task trains on; the latter if there are over FEW labels
FEW = 1_000_000  # labels up to which texts are joined where they are read, not dealt by id first
ROUNDS, BATCH, MOST_WORDS = 6, 64, 1 << 20  # a step takes that many texts, or fewer of that many words together
SLICES = 16  # what the parts send of the table is added up in as many pieces
SLABS, FAR = 256, 64  # thresholds lie on multiples of 1 / SLABS of a logit, between -FAR and FAR
FIXED = 1 << 32  # sums are made of whole multiples of 1 / FIXED, so that their order does not count


def hashed_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of each different word, -1 where it has fewer letters; which word each position holds; words of each text).

    A word is a run of letters (bytes a-z after lowering, or above ASCII)."""
    lowered = pc.utf8_lower(column.fill_null(""))
    data, offsets = strings(lowered)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    parts, counts, at = [], np.zeros(len(column), np.int64), 0
    cuts = [0]
    while len(column) == 1 and len(data) - cuts[-1] > 2 * STEP:  # a very long text, piece by piece
        gap = np.flatnonzero(~LETTER[data[cuts[-1] + STEP :][:STEP]])
        cuts.append(cuts[-1] + STEP + (int(gap[0]) if len(gap) else STEP))
    for at, end in zip(cuts, [*cuts[1:], len(data)]):
        b = data[at:end]
        edges = (offsets if len(cuts) == 1 else np.array([0, len(b)]))
        letter = LETTER[b]
        inner = edges[1:-1]
        opens, closes = np.concatenate([[True], ~letter[:-1]]), np.concatenate([~letter[1:], [True]])[: len(b)]
        opens = opens[: len(b)]
        opens[inner[inner < len(b)]] = True
        closes[inner[inner > 0] - 1] = True
        starts, ends = np.flatnonzero(letter & opens), np.flatnonzero(letter & closes) + 1
        up, down = powers(max(1, len(b)))
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(BYTE[b] * up[: len(b)], out=sums[1:])
        size = ends - starts
        whole = mixed((sums[ends] - sums[starts]) * down[starts] + size.astype(np.uint64))
        leads = [np.where(size > n, (sums[np.minimum(starts + n, len(b))] - sums[starts]) * down[starts], 0) for n in LEADS]
        parts.append((whole, leads, size))
        counts += np.diff(np.searchsorted(starts, edges)) if len(cuts) == 1 else len(starts)
    whole = np.concatenate([p[0] for p in parts])
    size = np.concatenate([p[2] for p in parts])
    _, first, at = np.unique(whole, return_index=True, return_inverse=True)
    buckets = np.full((len(first), 1 + len(LEADS)), -1, np.int32)
    buckets[:, 0] = whole[first] % np.uint64(BUCKETS)
    for i, n in enumerate(LEADS):
        lead = np.concatenate([p[1][i] for p in parts])[first]
        buckets[:, i + 1] = np.where(size[first] > n, mixed(lead + np.uint64(n)) % np.uint64(BUCKETS), -1)
    return buckets, at, counts


def embedded(table: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """Mean of the rows of each word's buckets."""
    has = buckets >= 0
    out = np.zeros((len(buckets), table.shape[1]), np.float32)
    for i in range(buckets.shape[1]):
        out[has[:, i]] += table[buckets[has[:, i], i]]
    return out / np.maximum(1, has.sum(axis=1))[:, None]


@dataclass
class Model:
    table: np.ndarray
    filters: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    out: np.ndarray
    shift: float
    languages: list[str] = field(default_factory=list)
    words: np.ndarray | None = None
    thresholds: np.ndarray | None = None

    def pooled(self, vectors: np.ndarray, at: np.ndarray, counts: np.ndarray, argmax: bool = False):
        """Largest response of every filter in every text (0 at least), and where it is."""
        ends = np.cumsum(counts)
        pools, places = [], []
        for w in WIDTHS:
            best = np.zeros((len(counts), FILTERS), np.float32)
            place = np.full((len(counts), FILTERS), -1, np.int64)
            each = [vectors @ self.filters[w][j] for j in range(w)]
            n = len(at) - w + 1
            if n > 0:
                z = sum(each[j][at[j : j + n]] for j in range(w)) + self.bias[w]
                lo, hi = ends - counts, ends - w + 1
                some = np.flatnonzero(hi > lo)
                if len(some):
                    # windows that reach over a text's end count for no text
                    inside = np.zeros(n + 1, np.int32)
                    np.add.at(inside, lo[some], 1)
                    np.add.at(inside, hi[some], -1)
                    z[np.cumsum(inside)[:n] == 0] = -np.inf
                    best[some] = np.maximum(np.maximum.reduceat(z, lo[some]), 0)
                    if argmax:
                        for k in some:
                            i = z[lo[k] : hi[k]].argmax(axis=0) + lo[k]
                            place[k] = np.where(z[i, np.arange(FILTERS)] > 0, i, -1)
            pools.append(best)
            places.append(place)
        return np.concatenate(pools, axis=1), places

    def logits(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(logit, language number; -1 unknown) of each text."""
        return self.told(*hashed_words(column))

    def told(self, buckets: np.ndarray, at: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pools, _ = self.pooled(embedded(self.table, buckets), at, counts)
        language = np.full(len(counts), -1)
        if self.words is not None and len(at):
            sums = np.zeros((len(at) + 1, len(self.languages)))
            np.cumsum(self.words[buckets[:, 0]][at], axis=0, out=sums[1:])
            ends = np.cumsum(counts)
            language = np.where(counts > 0, (sums[ends] - sums[ends - counts]).argmax(axis=1), -1)
        return pools @ self.out + self.shift, language

    def scores(self, column: pa.Array) -> np.ndarray:
        logit, language = self.logits(column)
        # thresholds: one for each language, then the common one
        return 1 / (1 + np.exp(-np.clip(logit - self.thresholds[language], -30, 30)))


def blank(names: list[str], seed: int = 3) -> Model:
    """A model before training; the first filter of each width starts as the first dimension alone."""
    rng = np.random.default_rng(seed)
    model = Model(
        rng.standard_normal((BUCKETS, DIM), np.float32) * np.float32(0.05), {w: (rng.standard_normal((w, DIM, FILTERS)) * 0.3).astype(np.float32) for w in WIDTHS},
        {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}, np.full(FILTERS * len(WIDTHS), 0.1, np.float32), -2.0, names, None, np.zeros(len(names) + 1),
    )
    for w in WIDTHS:
        model.filters[w][:, :, 0] = 0
        model.filters[w][0, 0, 0] = 1
    return model


def weights(model: Model) -> list[np.ndarray]:
    """All that is trained but the table and the shift."""
    return [model.out, *model.filters.values(), *model.bias.values()]


@dataclass
class Part:
    """Hashed texts as `hashed_words` gives them, with their labels, languages (-1: none) and whether thresholds are set on them."""

    buckets: np.ndarray
    at: np.ndarray
    counts: np.ndarray
    toxic: np.ndarray
    language: np.ndarray
    rest: np.ndarray

    def words(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of some texts alone: (numbers of their different words, which of those each position holds, words of each text)."""
        ends = np.cumsum(self.counts)
        used, local = np.unique(self.at[ragged(ends[docs] - self.counts[docs], self.counts[docs])], return_inverse=True)
        return used, local, self.counts[docs]

    def runs(self, docs: np.ndarray) -> Iterator[np.ndarray]:
        """The texts in their order, BATCH or MOST_WORDS at once."""
        sums, i = np.concatenate([[0], np.cumsum(self.counts[docs])]), 0
        while i < len(docs):
            j = min(i + BATCH, max(i + 1, int(np.searchsorted(sums, sums[i] + MOST_WORDS, "right")) - 1))
            yield docs[i:j]
            i = j


KINDS = {"buckets": np.int32, "at": np.int32, "counts": np.int64, "toxic": np.int8, "language": np.int32, "rest": np.bool_}
BLOCK = ", ".join(f"{k} binary" for k in KINDS)


def hashed(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """A row for each run of texts; of several rows of an id, which lie side by side, the first counts."""
    number, last = {x: i for i, x in enumerate(names)}, None
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        batch, last = batch.filter(pa.array([x != y for x, y in zip(ids, [last, *ids])], pa.bool_())), ids[-1] if ids else last
        for i, j in slices(batch.column("text"), STEP):
            own = batch.slice(i, j - i)
            language = np.array([number.get(x, -1) for x in own.column("lang").to_pylist()])
            values = (*hashed_words(own.column("text")), own.column("toxic").to_numpy(), language, own.column("rest").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_pydict({k: pa.array([packed(v.astype(kind))], pa.binary()) for (k, kind), v in zip(KINDS.items(), values)})


def packed(x: np.ndarray) -> bytes:
    """The array's length in bytes and its bytes, compressed."""
    return x.nbytes.to_bytes(8, "little") + pa.compress(x.tobytes(), codec="zstd", asbytes=True)


def unpacked(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(b[8:], int.from_bytes(b[:8], "little"), codec="zstd", asbytes=True), kind)


def opened(batches: Iterator[pa.RecordBatch]) -> Part | None:
    """All blocks of a part; a word has a number in each block that holds it."""
    found, words = {k: [] for k in KINDS}, 0
    for batch in batches:
        for row in batch.to_pylist():
            for k, kind in KINDS.items():
                found[k].append(unpacked(row[k], kind))
            found["at"][-1] = found["at"][-1] + np.int32(words)
            words += len(found["buckets"][-1]) // (1 + len(LEADS))
    if not found["counts"]:
        return None
    part = Part(*(np.concatenate(v) for v in found.values()))
    part.buckets = part.buckets.reshape(-1, 1 + len(LEADS))
    return part


def summed(parts: DataFrame, run, width: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Sums over all parts of what `run` gives of a part: rows of the table, `width` values of each, and some values beside."""
    size = BUCKETS // SLICES

    def sent(batches):
        part = opened(batches)
        if part is None:
            return
        rows, values, beside = run(part)
        cuts = np.searchsorted(rows, np.arange(SLICES + 1) * size)
        for s in range(SLICES):
            own = slice(cuts[s], cuts[s + 1])
            yield pa.RecordBatch.from_pydict({"slice": pa.array([s], pa.int32()), "rows": [rows[own].astype(np.int32).tobytes()], "numbers": [values[own].astype(np.float32).tobytes()]})
        yield pa.RecordBatch.from_pydict({"slice": pa.array([SLICES], pa.int32()), "rows": [b""], "numbers": [np.asarray(beside, np.float32).tobytes()]})

    def added(batches):
        sums = {}
        for batch in batches:
            for r in batch.to_pylist():
                whole = np.rint(np.frombuffer(r["numbers"], np.float32).astype(float) * FIXED).astype(np.int64)
                if r["slice"] == SLICES:
                    sums[SLICES] = sums[SLICES] + whole if SLICES in sums else whole
                else:
                    into = sums.setdefault(r["slice"], np.zeros((size, width), np.int64))
                    into[np.frombuffer(r["rows"], np.int32) - r["slice"] * size] += whole.reshape(-1, width)
        for s, x in sums.items():
            yield pa.RecordBatch.from_pydict({"slice": pa.array([s], pa.int32()), "numbers": [(x / FIXED).astype(np.float32).tobytes()]})

    out = np.zeros((BUCKETS, width), np.float32)
    beside = None
    moved = parts.mapInArrow(sent, "slice int, rows binary, numbers binary").repartition(SLICES, "slice").mapInArrow(added, "slice int, numbers binary")
    for r in moved.collect():  # BUCKETS * width numbers in all, however many rows there are
        own = np.frombuffer(r["numbers"], np.float32)
        if r["slice"] == SLICES:
            beside = own
        else:
            out[r["slice"] * size : (r["slice"] + 1) * size] = own.reshape(size, width)
    return out, beside


def tallied(part: Part, languages: int):
    """Texts to train on that hold each bucket, clean ones and toxic ones, and different words of each language; beside: clean and toxic texts."""
    train = np.flatnonzero(~part.rest)
    counts, ends = np.zeros((BUCKETS, 2 + languages), np.float32), np.cumsum(part.counts)
    for d in train:
        held = part.buckets[np.unique(part.at[ends[d] - part.counts[d] : ends[d]])]
        counts[np.unique(held[held >= 0]), part.toxic[d]] += 1
        if part.language[d] >= 0:
            np.add.at(counts[:, 2 + part.language[d]], held[:, 0], 1)
    rows = np.flatnonzero(counts.any(axis=1))
    return rows, counts[rows], np.bincount(part.toxic[train], minlength=2)


def passed(part: Part, model: Model, squares: list[np.ndarray], rng: np.random.Generator):
    """One pass of Adagrad over a part's texts. Of each row of the table that changed: by how much it and its squares did, times the steps
    that touched it, and those steps. Beside: the same of the other weights, times the part's texts, and those texts."""
    model = Model(model.table.copy(), {w: x.copy() for w, x in model.filters.items()}, {w: x.copy() for w, x in model.bias.items()}, model.out.copy(), model.shift)
    before, table_square, *other = (x.copy() for x in [model.table, *squares])
    old, old_squares, old_square, old_shift = [x.copy() for x in weights(model)], [x.copy() for x in other], table_square.copy(), model.shift
    square_of = {id(x): q for x, q in zip(weights(model), other)}
    steps = np.zeros(BUCKETS, np.float32)

    def step(x: np.ndarray, g: np.ndarray) -> None:
        square_of[id(x)] += g * g
        x -= 0.05 * g / np.sqrt(square_of[id(x)])

    train = rng.permutation(np.flatnonzero(~part.rest))
    for docs in part.runs(train):
        used, local, counts = part.words(docs)
        vectors = embedded(model.table, part.buckets[used])
        pools, places = model.pooled(vectors, local, counts, argmax=True)
        p = 1 / (1 + np.exp(-np.clip(pools @ model.out + model.shift, -30, 30)))
        g = ((p - part.toxic[docs]) / len(docs)).astype(np.float32)
        into = np.zeros_like(vectors)
        for k, w in enumerate(WIDTHS):
            d, f = np.nonzero(places[k] >= 0)
            if not len(d):
                continue
            i = places[k][d, f]
            back = g[d] * model.out[k * FILTERS + f]
            grad, bias = np.zeros_like(model.filters[w]), np.zeros_like(model.bias[w])
            np.add.at(bias, f, back)
            for j in range(w):
                word = local[i + j]
                np.add.at(grad[j].T, f, back[:, None] * vectors[word])
                np.add.at(into, word, back[:, None] * model.filters[w][j].T[f])
            step(model.filters[w], grad)
            step(model.bias[w], bias)
        touched = np.flatnonzero(np.abs(into).sum(axis=1))
        b = part.buckets[used[touched]]
        each = into[touched] / (b >= 0).sum(axis=1)[:, None]
        rows, spread = np.unique(b[b >= 0], return_inverse=True)
        sums = np.zeros((len(rows), DIM), np.float32)
        np.add.at(sums, spread, np.repeat(each, (b >= 0).sum(axis=1), axis=0))
        table_square[rows] += sums * sums
        model.table[rows] -= 0.05 * sums / np.sqrt(table_square[rows])
        steps[rows] += 1
        step(model.out, pools.T @ g)
        model.shift -= 0.2 * float(g.sum())
    rows = np.flatnonzero(steps)
    n = steps[rows, None]
    changes = np.concatenate([(model.table[rows] - before[rows]) * n, (table_square[rows] - old_square[rows]) * n, n], axis=1)
    beside = [x - y for x, y in zip([*weights(model), *other], [*old, *old_squares])] + [np.array([model.shift - old_shift, 1])]
    return rows, changes, np.concatenate([x.ravel() for x in beside]) * len(train)


def trained(parts: DataFrame, names: list[str], seed: int = 3) -> Model:
    """All rounds over the parts' texts but those that thresholds are set on, then the thresholds."""
    context, model, n = parts.sparkSession.sparkContext, blank(names, seed), len(names)
    counts, classes = summed(parts, lambda part: tallied(part, n), 2 + n)
    if classes is None or classes.sum() < 6 or classes.min() == 0:  # nothing to tell apart: the share of toxic rows is all there is
        model.out[:] = 0
        model.shift = 4.0 if classes is not None and classes[1] > classes[0] else -4.0
        return model
    share = (counts[:, :2] + 2) / (classes + 4)
    model.table[:, 0] = np.clip(np.log(share[:, 1] / share[:, 0]), -3, 5)
    if names:
        of = counts[:, 2:]
        model.words = np.log((of + 0.5) / (of.sum(axis=0) + 0.5 * BUCKETS)).astype(np.float32)
    del counts
    squares = [np.full(x.shape, 1e-2, np.float32) for x in (model.table, *weights(model))]
    for turn in range(ROUNDS):
        held = context.broadcast((model, squares))  # bounded: BUCKETS * (2 * DIM + languages) numbers

        def run(part, held=held, turn=turn):
            return passed(part, *held.value, np.random.default_rng([seed, turn, TaskContext.get().partitionId()]))

        table, beside = summed(parts, run, 2 * DIM + 1)
        held.destroy()
        table /= np.maximum(table[:, -1:], 1)
        model.table += table[:, :DIM]
        squares[0] += table[:, DIM:-1]
        beside = beside / beside[-1]
        at = 0
        for x in (*weights(model), *squares[1:]):
            x += beside[at : at + x.size].reshape(x.shape)
            at += x.size
        model.shift += float(beside[at])
        del table
    held = context.broadcast(model)

    def logits(batches):
        part = opened(batches)
        if part is None:
            return
        rest, found = np.flatnonzero(part.rest), []
        for docs in part.runs(rest):
            used, local, counts = part.words(docs)
            logit, language = held.value.told(part.buckets[used], local, counts)
            found.append(np.stack([language, np.floor(np.clip(logit, -FAR, FAR) * SLABS), part.toxic[docs]]).astype(np.int64))
        if found:
            of, n = np.unique(np.concatenate(found, axis=1), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([*map(pa.array, of), pa.array(n)], ["language", "slab", "toxic", "n"])

    rows = parts.mapInArrow(logits, "language long, slab long, toxic long, n long").groupBy("language", "slab").agg(F.sum(F.col("n") * F.col("toxic")).alias("hits"), F.sum("n").alias("n"))
    told = np.array([tuple(r) for r in rows.collect()], np.int64).reshape(-1, 4)  # bounded by 2 * FAR * SLABS slabs a language
    held.destroy()
    model.thresholds = thresholds(told[:, 0], told[:, 1], told[:, 2], told[:, 3] - told[:, 2], n)
    return model


def thresholds(language: np.ndarray, slab: np.ndarray, hits: np.ndarray, misses: np.ndarray, n: int, least: int = 10) -> np.ndarray:
    """The cut of best F1 for each language, last one for all, from toxic and clean rows by language and slab of logits; a language with
    under `least` rows of a class has the common one."""

    def best(own: np.ndarray) -> float:
        x, at = np.unique(slab[own], return_inverse=True)
        hit, false = (np.cumsum(np.bincount(at, c[own], len(x))[::-1]) for c in (hits, misses))
        k = int((2 * hit / (hit + false + hit[-1])).argmax())
        x = x[::-1]
        return float((x[k] + x[k + 1] + 1) / 2 / SLABS) if k + 1 < len(x) else float(x[k]) / SLABS - 1e-6

    every = np.ones(len(slab), bool)
    common = best(every) if hits.sum() and misses.sum() else 0.0
    out = [common] * (n + 1)
    for i in range(n):
        own = language == i
        if min(hits[own].sum(), misses[own].sum()) >= least:
            out[i] = best(own)
    return np.array(out)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Fit on the whole texts of all labelled rows outside the held-out fold. A quarter of them, by a hash of the id, sets the thresholds.
    Several labels of one id count as the larger; null labels as none; of several rows of an id the one with the smallest text counts,
    null as empty."""
    known = labels.where(~held_out("doc_id") & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where(~held_out("doc_id"))
    size = texts.select("doc_id", "lang", F.octet_length("text").alias("size")).join(known, "doc_id").groupBy("lang").agg(F.sum("size").alias("size")).collect()
    names = sorted(r["lang"] for r in size if r["lang"] is not None)
    few = known.count() <= FEW
    parts = max(1, -(-sum(r["size"] or 0 for r in size) // (PART if few else LARGE)))
    if few:
        own = texts.join(F.broadcast(known), "doc_id").repartition(parts, "doc_id")
    else:  # both sides are dealt as the parts are, once
        own = texts.repartition(parts, "doc_id").join(known.repartition(parts, "doc_id"), "doc_id")
    dealt = own.coalesce(parts).withColumn("rest", F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0).sortWithinPartitions("doc_id", "text")
    return trained(checkpointed(dealt.mapInArrow(lambda batches: hashed(batches, names), BLOCK)), names)


def scored(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted. Only the text goes into the score; null and empty texts get the
    score of no filter response. Repeated rows and null ids come out as they come in (a null id counts as held out)."""
    kind = dict(docs.dtypes)[doc_id]
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded: BUCKETS * (DIM + languages) numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for i, j in slices(texts, STEP):
                s = held.value.scores(texts.slice(i, j - i))
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(i, j - i), "score": pa.array(s, pa.float64())})

    out = take(docs, doc_id, text).mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of `docs` whose text scores under 0.5, with all their columns."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded, as above
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch.column(at), STEP):
                part = batch.slice(i, j - i)
                yield part.filter(pa.array(held.value.scores(part.column(at)) < 0.5))

    return docs.mapInArrow(run, docs.schema)
