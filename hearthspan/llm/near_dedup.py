"""Near duplicates by SetSketch registers.

A register is the truncated logarithm, to a small base, of the least of exponentially spaced hashes over a document's set of
shingles: registers of a union are the larger of two, and those of similar sets mostly agree. Bands of 8 registers give
candidates; the numbers of registers that are larger, smaller and equal, with both set sizes, give the likeliest similarity;
what comes near the threshold is confirmed on full sets.

Work stays in proportion to links, not to pairs: documents with equal sets count as one; in a first round each bucket's
members meet only its smallest id; with more `rounds` those still apart meet a member of the bucket's largest component; afterwards
only pairs of different components that still share a bucket meet, block by block, so a bucket of any size is split and every
candidate is seen. Rounds decide what the search costs, not what it finds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthspan.llm.common import mixed, take
from hearthspan.llm.components import components
from hearthspan.llm.shingles import shingle_sets
from hearthspan.session import checkpointed

BASE = 1.2
RATE = 20.0
TOP = 127
BAND = 8
DEVIATIONS = 5
ROUNDS = 1
BROADCAST_IDS = 500_000
BROADCAST_BYTES = 16 << 20


def registers(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SetSketch registers of sets of 64-bit hashes, one row a set: floor(1 - log_BASE(least exponential)), kept in 0..TOP."""
    turn = np.random.default_rng(7).integers(0, 1 << 31, m, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    least = np.full((len(sets), m), np.iinfo(np.uint32).max, np.uint32)
    for row, s in enumerate(sets):
        lo, hi = s.astype(np.uint32), (s >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(s), 1024):
            np.minimum(least[row], (turn[:, None] * lo[at : at + 1024] + hi[at : at + 1024]).min(axis=1), out=least[row])
    spaced = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(spaced) / np.log(BASE)), 0, TOP).astype(np.uint8)


def sketches(docs: DataFrame, k: int, m: int) -> DataFrame:
    """doc_id, n (set size), d1, d2 (128-bit digest of the set), registers as m / 8 longs (null for an empty set)."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[np.ndarray] = []
            first = 0

            def out() -> pa.RecordBatch:
                r = registers(held, m).view("<i8")
                ends = np.arange(0, r.size + 1, m // BAND, dtype=np.int32)
                n = np.array(list(map(len, held)), np.int64)
                return pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").slice(first, len(held)), "n": pa.array(n),
                    "d1": pa.array([int(mixed(s + np.uint64(1)).sum().astype(np.int64)) for s in held], pa.int64()),
                    "d2": pa.array([int(mixed(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum().astype(np.int64)) for s in held], pa.int64()),
                    "regs": pa.ListArray.from_arrays(pa.array(ends), pa.array(r.ravel()), mask=pa.array(n == 0)),
                })

            for row, s in shingle_sets(batch.column("text"), k):
                held.append(s)
                if len(held) == 512 or sum(map(len, held[-1:])) > 1 << 20:
                    yield out()
                    first, held = row + 1, []
            if held:
                yield out()

    return docs.mapInArrow(run, f"doc_id {kind}, n long, d1 long, d2 long, regs array<long>")


def apart(x: np.ndarray) -> np.ndarray:
    """Probability that a register exceeds the other's, for a share x of elements on one side only."""
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def likeliest(larger: np.ndarray, smaller: np.ndarray, m: int, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Similarity of greatest joint likelihood, from counts of larger and smaller registers and both set sizes."""
    u = na / (na + nb)
    v = 1 - u
    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)

    def gain(j: np.ndarray) -> np.ndarray:
        p, q = np.maximum(apart(np.maximum(u - v * j, 0)), 1e-12), np.maximum(apart(np.maximum(v - u * j, 0)), 1e-12)
        return larger * np.log(p) + smaller * np.log(q) + (m - larger - smaller) * np.log(np.maximum(1 - p - q, 1e-12))

    for _ in range(40):
        a, b = lo + (hi - lo) * 0.382, lo + (hi - lo) * 0.618
        up = gain(a) < gain(b)
        lo, hi = np.where(up, a, lo), np.where(up, hi, b)
    return (lo + hi) / 2


def margin(t: float, m: int) -> float:
    """DEVIATIONS standard deviations of the estimate at similarity t."""
    p = 1 - 2 * float(apart(np.array((1 - t) / 2)))
    slope = (2 * float(apart(np.array((1 - t) / 2))) - 2 * float(apart(np.array((1 - t - 0.01) / 2)))) / 0.01
    return DEVIATIONS * (p * (1 - p) / m) ** 0.5 / slope


def matrix(column: pa.Array, m: int) -> np.ndarray:
    """An Arrow column of m / 8 longs as bytes, one row each."""
    return column.flatten().to_numpy(zero_copy_only=False).astype("<i8").view(np.uint8).reshape(-1, m)


def near(pairs: DataFrame, m: int, percent: int) -> DataFrame:
    """Pairs (a, na, ra, b, nb, rb) whose likeliest similarity comes near the threshold -> (a, b)."""
    cut = percent / 100 - margin(percent / 100, m)
    kind = dict(pairs.dtypes)["a"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = matrix(batch.column("ra"), m), matrix(batch.column("rb"), m)
                j = likeliest((a > b).sum(axis=1), (a < b).sum(axis=1), m, batch.column("na").to_numpy(), batch.column("nb").to_numpy())
                yield batch.select(["a", "b"]).filter(pa.array(j >= cut))

    return pairs.mapInArrow(run, f"a {kind}, b {kind}")


def confirmed(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) that hold on their full shingle sets: 100 * intersection >= percent * union."""
    kind = dict(pairs.dtypes)["a"]
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()

    def to_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, s in shingle_sets(batch.column("text"), k):
                yield pa.RecordBatch.from_pydict({"id": batch.column("doc_id").slice(row, 1), "held": pa.array([s.tobytes()], pa.binary())})

    def holds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    ids = checkpointed(ids)
    if ids.count() <= BROADCAST_IDS:  # a few MB; beyond that texts and ids are shuffled
        ids = F.broadcast(ids)
    sets = checkpointed(docs.join(ids, "doc_id").mapInArrow(to_set, f"id {kind}, held binary"))
    if (sets.agg(F.sum(F.length("held"))).first()[0] or 0) <= BROADCAST_BYTES:  # beyond that pairs and sets are shuffled
        sets = F.broadcast(sets)
    full = pairs.join(sets.select(F.col("id").alias("a"), F.col("held").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("held").alias("y")), "b")
    return full.select("a", "b", "x", "y").mapInArrow(holds, f"a {kind}, b {kind}").distinct()


def rest_pairs(blocks: DataFrame, m: int, bands: int, percent: int, kind: str) -> DataFrame:
    """Pairs of blocks of one bucket -> near pairs (a, b) of different components, each in the first bucket that both share."""
    cut = percent / 100 - margin(percent / 100, m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("left"), batch.column("right")
            for row in range(batch.num_rows):
                x, y = left.slice(row, 1).flatten(), right.slice(row, 1).flatten()
                rx, ry = matrix(x.field("regs"), m), matrix(y.field("regs"), m)
                nx, ny = x.field("n").to_numpy(), y.field("n").to_numpy()
                ix, iy = x.field("id").to_numpy(zero_copy_only=False), y.field("id").to_numpy(zero_copy_only=False)
                cx, cy = x.field("component").to_numpy(zero_copy_only=False), y.field("component").to_numpy(zero_copy_only=False)
                fits = (cx[:, None] != cy) & (100 * np.minimum(nx[:, None], ny) >= percent * np.maximum(nx[:, None], ny))
                if batch.column("same")[row].as_py():
                    fits &= ix[:, None] < iy
                i, j = np.nonzero(fits)
                if len(i):
                    earlier = rx.view("<i8")[i, :bands] == ry.view("<i8")[j, :bands]
                    first = earlier.argmax(axis=1) == batch.column("band")[row].as_py()
                    i, j = i[first], j[first]
                if len(i):
                    a, b = rx[i], ry[j]
                    good = likeliest((a > b).sum(axis=1), (a < b).sum(axis=1), m, nx[i], ny[j]) >= cut
                    yield pa.RecordBatch.from_pydict({"a": x.field("id").take(pa.array(i[good])), "b": y.field("id").take(pa.array(j[good]))})

    return blocks.mapInArrow(run, f"a {kind}, b {kind}")


def near_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, m: int = 768, bands: int = 48, block: int = 256, rounds: int = ROUNDS) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    A document's set holds its distinct k-word shingles (A-Z as a-z, words without white space); with fewer words the whole
    sequence is the one shingle; without words, or null, the set is empty and links with nothing. Documents are linked when
    100 * intersection >= percent * union; component_id is the smallest doc_id reachable and kept marks the row that has it.
    Repeated rows of one id are the same node and share its result; rows without an id take no part: component_id is null and
    kept false. An empty table gives an empty result; other columns are ignored.

    The first `bands` * 8 of m registers make the bands; all m go into the estimate. A pair at the very threshold shares no band
    with a probability of about 1e-5 (32 bands at 85, 48 at 80) and is estimated too low with one of 3e-7; both fall fast above it.
    """
    rows = take(docs, doc_id, text)
    kind = dict(rows.dtypes)["doc_id"]
    known = checkpointed(sketches(rows, k, m))
    sets = known.where("n > 0 AND doc_id IS NOT NULL")
    classes = sets.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("id"), F.first("regs").alias("regs"))
    nodes = checkpointed(classes)
    texts = rows.where("doc_id IS NOT NULL")

    banded = nodes.select("id", F.posexplode(F.slice("regs", 1, bands)).alias("band", "key"))
    shared = banded.groupBy("band", "key").agg(F.min("id").alias("pivot"), F.count(F.lit(1)).alias("size")).where("size > 1")
    members = checkpointed(banded.join(shared, ["band", "key"]))
    side = lambda p: nodes.select(F.col("id").alias(p), F.col("n").alias(f"n{p}"), F.col("regs").alias(f"r{p}"))
    sized = f"100 * least(na, nb) >= {percent} * greatest(na, nb)"
    lead = F.coalesce("component", "id")

    def tested(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) -> those that hold, by the estimate first."""
        pairs = pairs.distinct().join(side("a"), "a").join(side("b"), "b").where(sized)
        return checkpointed(confirmed(checkpointed(near(pairs, m, percent)), texts, k, percent))

    joined = components(tested(members.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b"))))
    for turn in range(1, rounds):
        # what is still apart in a bucket meets a member of the bucket's largest component there, another one each round
        held = members.where("size > 2").join(joined, "id", "left").select("band", "key", "id", lead.alias("component"))
        own = held.groupBy("band", "key", "component").agg(F.count(F.lit(1)).alias("many"), F.min_by("id", F.xxhash64("id", "band", F.lit(turn))).alias("pivot"))
        top = own.groupBy("band", "key").agg(F.max_by(F.struct("pivot", "component"), F.struct("many", "component")).alias("top"), F.count(F.lit(1)).alias("apart")).where("apart > 1")
        links = tested(held.join(top.select("band", "key", "top"), ["band", "key"]).where("component <> top.component").select(F.col("top.pivot").alias("a"), F.col("id").alias("b")))
        if links.isEmpty():
            break
        joined = components(links.unionByName(joined.select(F.col("id").alias("a"), F.col("component").alias("b"))))

    held = members.where("size > 2").join(joined, "id", "left").select("band", "key", "size", "id", lead.alias("component"))
    split = held.groupBy("band", "key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("band", "key")
    held = held.join(split, ["band", "key"]).join(nodes, "id").withColumn("block", F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / block)))
    blocks = held.groupBy("band", "key", "block").agg(F.collect_list(F.struct("id", "component", "n", "regs")).alias("left"))
    blocks = checkpointed(blocks)
    other = blocks.select("band", "key", F.col("block").alias("other"), F.col("left").alias("right"))
    blocks = blocks.join(other, ["band", "key"]).where("block <= other").select("band", "left", "right", (F.col("block") == F.col("other")).alias("same"))
    rest = checkpointed(rest_pairs(blocks, m, bands, percent, kind).distinct())
    if not rest.isEmpty():
        joined = components(confirmed(rest, texts, k, percent).unionByName(joined.select(F.col("id").alias("a"), F.col("component").alias("b"))))

    found = nodes.join(joined, "id", "left").select("d1", "d2", "n", lead.alias("component_id"))
    out = known.select("doc_id", "n", "d1", "d2").join(found, ["d1", "d2", "n"], "left")
    some = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), some.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT z.b, r.root FROM r JOIN (SELECT a, b FROM e UNION ALL SELECT b, a FROM e) z ON z.a = r.doc_id)
SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(root) AS component_id, doc_id = min(root) AS kept FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""
