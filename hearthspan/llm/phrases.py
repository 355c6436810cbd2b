"""Phrase collocations by counting quotient filters.

Words that are frequent enough to be in a phrase get ids and texts become runs of ids, broken where a piece ends or a rarer word
stands. Level by level, from two words to five, every task counts its n-grams in a counting quotient filter; filters are cut at
ranges of the permuted numbers, which are even whatever the phrases, and those of a range are merged. An n-gram can only be
frequent if both its shorter parts are, so each level passes a sieve of the one before: a bit for each quotient of a frequent
n-gram, of bounded size, that lets some rare ones through to be counted, but stops no frequent one.

What is left is joins of the frequent phrases: cuts with the counts of both sides, longer phrases with as many occurrences, ranks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthspan.llm.chunks import slices
from hearthspan.llm.common import strings
from hearthspan.llm.quotient import counted, decoded, encoded, packed, top, turned, unpacked
from hearthspan.session import checkpointed, scratch

PLAIN = np.arange(256, dtype=np.uint8)
PLAIN[65:91] += 32
PLAIN[9] = 32
PLAIN[[*b".,;:!?", 10, 11, 12, 13]] = 10
MOST_WORDS = 1_000_000
PER_RANGE = 1 << 19
HELD = 1 << 20
SIEVE_BITS = 26
CHUNK = 16


def tokens(column: pa.Array) -> pa.DictionaryArray:
    """Words of all texts one after the other; an end of a piece and the start of a text is a line feed; there may be empty ones."""
    data, offsets = strings(column)
    own = PLAIN[data[offsets[0] : offsets[-1]]]
    plain = pa.StringArray.from_buffers(len(column), pa.py_buffer((offsets - offsets[0]).astype(np.int32)), pa.py_buffer(own))
    spaced = pc.binary_join_element_wise("\n", pc.replace_substring(plain, "\n", " \n "), " ")
    return pc.split_pattern(spaced, " ").flatten().dictionary_encode()


def by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array]]:
    """(lang, texts of about 4 MB) of a batch of lang, text."""
    langs = batch.column("lang")
    for lang in pc.unique(langs).to_pylist():
        own = batch.column("text").filter(pc.equal(langs, lang))
        for i, j in slices(own):
            yield lang, own.slice(i, j - i)


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, n; under the null word the number of all words of the language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[str | None, int]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, found in held.items():
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(found), pa.string()), "word": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())})
            held.clear()

        for batch in batches:
            for lang, part in by_language(batch):
                coded = tokens(part)
                counts = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary)).tolist()
                found = held.setdefault(lang, {None: 0})
                for word, n in zip(coded.dictionary.to_pylist(), counts):
                    if word and word != "\n":
                        found[word] = found.get(word, 0) + n
                        found[None] += n
                if sum(map(len, held.values())) > HELD // 4:
                    yield from out()
        yield from out()

    return docs.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def numbered(rows: DataFrame, by: list[str], per_part: int = 1 << 20) -> DataFrame:
    """id: the place of each row in the order of `by`, from 1; ranges are numbered apart, so no task holds them all."""
    parts = max(1, -(-rows.count() // per_part))
    placed = checkpointed(rows.repartitionByRange(parts, *by).withColumn("part", F.spark_partition_id()))
    first, offsets = 0, []
    for part, n in sorted(map(tuple, placed.groupBy("part").count().collect())):
        offsets.append((part, first))
        first += n
    starts = rows.sparkSession.createDataFrame(offsets, "part int, first long")
    return placed.join(F.broadcast(starts), "part").withColumn("id", F.row_number().over(Window.partitionBy("part").orderBy(*by)) + F.col("first")).drop("part", "first")


def runs(ids: np.ndarray) -> np.ndarray:
    """Ids without breaks beside breaks (0) and without words that stand alone between two."""
    on = np.concatenate([[False], ids > 0, [False]])
    near = on[1:-1] & (on[:-2] | on[2:])
    keep = near | np.concatenate([[False], near[:-1]])
    return np.where(near, ids, 0)[keep].astype(np.int32)


def sequences(docs: DataFrame, words: DataFrame, most_words: int) -> DataFrame:
    """ids: the frequent words of about 4 MB of one language's texts, 0 for what breaks a phrase.

    With `most_words` frequent words or fewer the tasks look ids up; beyond that the words of all texts are joined with theirs."""
    spark, few = docs.sparkSession, words.count() <= most_words
    if few:
        known: dict[str, dict[str, int]] = {}
        for lang, word, i in words.select("lang", "word", "id").toLocalIterator():
            known.setdefault(lang, {})[word] = i
        shared = spark.sparkContext.broadcast(known)

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lang, part in by_language(batch):
                    coded = tokens(part)
                    names = coded.dictionary.to_pylist()
                    of = shared.value.get(lang, {})
                    ids = np.fromiter((of.get(w, 0) if w else -1 for w in names), np.int32, len(names))[coded.indices.to_numpy()]
                    ids = runs(ids[ids >= 0])
                    yield pa.RecordBatch.from_pydict({"ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids))})

        found = docs.mapInArrow(look_up, "ids array<int>")
    else:

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            task, number = TaskContext.get().partitionId(), 0
            for batch in batches:
                for lang, part in by_language(batch):
                    coded = tokens(part)
                    coded = coded.filter(pc.not_equal(coded.cast(pa.string()), ""))
                    word = coded.cast(pa.string())
                    at = np.arange(len(word))
                    on = pc.not_equal(word, "\n")
                    yield pa.RecordBatch.from_pydict({
                        "run": pa.array(np.full(len(word), (task << 32) + number)), "at": pa.array(at), "lang": pa.array([lang] * len(word), pa.string()), "word": word,
                    }).filter(on)
                    number += 1

        def gathered(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            at = table.column("at").to_numpy()
            ids = np.zeros(int(at.max()) + 1, np.int32)
            ids[at] = table.column("id").to_numpy()
            ids = runs(ids)
            return pa.table({"ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids))})

        each = docs.mapInArrow(placed, "run long, at long, lang string, word string")
        found = each.join(words.select("lang", "word", F.col("id").cast("int").alias("id")), ["lang", "word"]).groupBy("run").applyInArrow(gathered, "ids array<int>")
    path = scratch(spark, "phrases")
    found.write.parquet(path)
    if few:
        shared.unpersist()
    return spark.read.parquet(path)


class Pile:
    """N-grams of a task: counted, merged, and given out as filters by range, before they are too many."""

    def __init__(self, k: int, b: int, prefix: int):
        self.k, self.b, self.prefix = k, b, prefix
        self.new: list[list[np.ndarray]] = []
        self.pending, self.held = 0, None

    def add(self, words: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        self.new.append(packed(turned(words, self.b), self.b))
        self.pending += len(words[0])
        if self.pending >= HELD:
            yield from self.merge(2 * HELD)

    def merge(self, most: int) -> Iterator[pa.RecordBatch]:
        """Count what is pending; give all out if that makes more than `most` different n-grams."""
        if self.pending:
            limbs, counts = counted([np.concatenate(x) for x in zip(*self.new)])
            if self.held:
                limbs, counts = [np.concatenate(x) for x in zip(self.held[0], limbs)], np.concatenate([self.held[1], counts])
                limbs, counts = counted(limbs, counts)
            self.held, self.new, self.pending = (limbs, counts), [], 0
        if self.held and len(self.held[1]) > most:
            limbs, counts = self.held
            width = self.k * self.b
            places = top(limbs, width, self.prefix)
            starts = np.flatnonzero(np.append(True, places[1:] != places[:-1]))
            blobs = []
            for i, j in zip(starts, [*starts[1:], len(places)]):
                blobs.append(encoded(below([x[i:j] for x in limbs], width - self.prefix), counts[i:j], width - self.prefix))
            yield pa.RecordBatch.from_pydict({"range": pa.array(places[starts]), "held": pa.array(blobs, pa.binary())})
            self.held = None


def below(limbs: list[np.ndarray], width: int) -> list[np.ndarray]:
    """Without the bits from `width` on."""
    return [x & np.uint64(max(0, (1 << min(64, max(0, width - 64 * i))) - 1)) for i, x in enumerate(limbs)]


def frequent(sequences: DataFrame, k: int, b: int, least: int, prefix: int, sieve: tuple[int, bytes] | None) -> DataFrame:
    """ids, a, slot of the n-grams of k words that occur `least` times or more; slot: upper bits of the permuted number, for the sieve."""
    spark, width = sequences.sparkSession, k * b
    shared = spark.sparkContext.broadcast(sieve)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pile = Pile(k, b, prefix)
        for batch in batches:
            for row in range(batch.num_rows):
                ids = batch.column("ids").slice(row, 1).flatten().to_numpy().astype(np.uint64)
                at = windows(ids, k, b, shared.value)
                if len(at):
                    yield from pile.add([ids[at + t] for t in range(k)])
        yield from pile.merge(0)

    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        limbs = -(-width // 64)
        parts = [decoded(x.as_py(), limbs) for x in table.column("held")]
        found, counts = counted([np.concatenate(x) for x in zip(*(p[0] for p in parts))], np.concatenate([p[1] for p in parts]))
        on = counts >= least
        found, counts = [x[on] for x in found], counts[on]
        if prefix:
            at, shift = divmod(width - prefix, 64)
            high = np.uint64(key[0].as_py())
            found[at] = found[at] | high << np.uint64(shift)
            if shift and at + 1 < limbs:
                found[at + 1] = found[at + 1] | high >> np.uint64(64 - shift)
        words = turned(unpacked(found, k, b), b, back=True)
        flat = np.stack(words, axis=1).astype(np.int32).ravel() if len(counts) else np.zeros(0, np.int32)
        return pa.table({
            "ids": pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, k, dtype=np.int32)), pa.array(flat)), "a": pa.array(counts),
            "slot": pa.array(top(found, width, min(width, SIEVE_BITS))),
        })

    out = checkpointed(sequences.mapInArrow(count, "range long, held binary").groupBy("range").applyInArrow(merge, "ids array<int>, a long, slot long"))
    shared.unpersist()
    return out


def windows(ids: np.ndarray, k: int, b: int, sieve: tuple[int, bytes] | None) -> np.ndarray:
    """Where n-grams of k words begin that have no break and whose shorter parts pass the sieve."""
    on = ids > 0
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    if sieve is None:
        return np.flatnonzero(np.logical_and.reduce([on[t : t + n] for t in range(k)]))
    short = np.flatnonzero(np.logical_and.reduce([on[t : t + n + 1] for t in range(k - 1)]))
    bits, held = sieve
    slot = top(packed(turned([ids[short + t] for t in range(k - 1)], b), b), (k - 1) * b, bits)
    hit = np.frombuffer(held, np.uint8)[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1
    alive = np.zeros(n + 1, bool)
    alive[short[hit == 1]] = True
    return np.flatnonzero(alive[:-1] & alive[1:])


def sieve_of(found: DataFrame, count: int, width: int) -> tuple[int, bytes]:
    """(bits of a slot, a bit for every slot in use), 16 slots an n-gram but 2^26 at most: 8 MB."""
    full = min(width, SIEVE_BITS)
    bits = min(full, count.bit_length() + 4)
    chunk = min(bits, CHUNK)

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        used = np.zeros(1 << chunk, bool)
        used[table.column("slot").to_numpy() & ((1 << chunk) - 1)] = True
        return pa.table({"chunk": [key[0].as_py()], "held": pa.array([np.packbits(used).tobytes()], pa.binary())})

    slots = found.select(F.shiftright("slot", full - bits).alias("slot")).distinct().withColumn("chunk", F.shiftright("slot", chunk))
    parts = dict(map(tuple, slots.groupBy("chunk").applyInArrow(pack, "chunk long, held binary").collect()))
    none = bytes(-(-(1 << chunk) // 8))
    return bits, b"".join(bytes(parts.get(i, none)) for i in range(1 << (bits - chunk)))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, most: int = 2000, longest: int = 5, most_words: int = MOST_WORDS, per_range: int = PER_RANGE) -> DataFrame:
    """Each language's first `most` phrases: lang, rank, phrase, a, l, r, n, score.

    Words are lower-cased (A-Z); phrases of 2 to `longest` words lie within pieces, which end at . , ; : ! ? and line ends. a, l and r are
    exact counts of the phrase and of the two sides of its lowest-scoring cut (the first, of equals), n of all words of the language;
    score is floor(1000 * a * n / (l * r)). Phrases of fewer than `least` occurrences are no candidates; nor stay those that lie inside
    a longer candidate with as many. Order: score and a falling, then the phrase by its bytes.

    A null text counts as empty, a null lang as `und`. Repeated rows count each. An empty table, or one without frequent phrases, gives
    no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    counts = checkpointed(word_counts(rows).where(f"word IS NULL OR n >= {least}"))
    totals = counts.where("word IS NULL").select("lang", F.col("n").alias("total"))
    words = checkpointed(numbered(counts.where("word IS NOT NULL"), ["lang", "word"]).select("lang", "word", "id", "n"))
    vocabulary, everything = words.agg(F.max("id")).first()[0] or 0, totals.agg(F.sum("total")).first()[0] or 0
    none = spark.createDataFrame([], "lang string, rank int, phrase string, a long, l long, r long, n long, score long")
    if not vocabulary:
        return none
    held = sequences(rows, words, most_words)
    b, levels, sieve = int(vocabulary).bit_length(), [words.select(F.array(F.col("id").cast("int")).alias("ids"), F.col("n").alias("a"))], None
    for k in range(2, longest + 1):
        prefix = min(k * b, 30, max(0, int(-(-everything // per_range) - 1).bit_length()))
        found = frequent(held, k, b, least, prefix, sieve)
        many = found.count()
        if not many:
            break
        levels.append(found.select("ids", "a"))
        sieve = sieve_of(found, many, k * b)
    if len(levels) == 1:
        return none
    phrases = levels[0]
    for level in levels[1:]:
        phrases = phrases.unionByName(level)
    candidates = levels[1]
    for level in levels[2:]:
        candidates = candidates.unionByName(level)

    size = F.size("ids")
    inside = candidates.where(size > 2).select(F.explode(F.array(F.slice("ids", F.lit(1), size - 1), F.slice("ids", F.lit(2), size - 1))).alias("ids"), "a").distinct()
    left = candidates.join(inside, ["ids", "a"], "left_anti")
    cuts = left.select("ids", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("cut"))
    cuts = cuts.select("ids", "a", "cut", F.slice("ids", F.lit(1), F.col("cut")).alias("first"), F.slice("ids", F.col("cut") + 1, size - F.col("cut")).alias("rest"))
    cuts = cuts.join(phrases.select(F.col("ids").alias("first"), F.col("a").alias("l")), "first").join(phrases.select(F.col("ids").alias("rest"), F.col("a").alias("r")), "rest")
    spelt = left.select("ids", F.posexplode("ids").alias("at", "id"))
    names = words.select("id", "lang", "word")
    spelt = spelt.join(F.broadcast(names) if vocabulary <= most_words // 4 else names, "id")
    spelt = spelt.groupBy("ids").agg(F.min("lang").alias("lang"), F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]).alias("words"))
    spelt = spelt.select("ids", "lang", F.array_join("words", " ").alias("phrase")).join(totals, "lang")
    scored = cuts.join(spelt, "ids").withColumn("score", F.expr("(cast(a as decimal(19,0)) * cast(total as decimal(19,0)) * 1000BD) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"))
    best = scored.groupBy("ids", "lang", "phrase", "a", F.col("total").alias("n")).agg(F.min_by(F.struct("score", "l", "r"), F.struct("score", "cut")).alias("best"))
    best = checkpointed(best.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score"))
    # first in each of some parts of a language, then among those: no task ranks a whole language
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = max(1, int((best.count() / most) ** 0.5))
    first = best.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(f"rank <= {most}")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(f"rank <= {most}").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH p AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY 1),
g AS (SELECT lang, unnest(flatten(list_transform(range(1, 6), lambda k: list_transform(range(1, greatest(len(ws) - k + 2, 1)), lambda i: ws[i : i + k - 1])))) AS g FROM w),
f AS MATERIALIZED (SELECT lang, g, count(*) AS a FROM g GROUP BY 1, 2 HAVING count(*) >= 100),
c AS MATERIALIZED (SELECT * FROM f WHERE len(g) >= 2),
inside AS (SELECT DISTINCT lang, unnest(flatten(list_transform(range(2, len(g)), lambda k: list_transform(range(1, len(g) - k + 2), lambda i: g[i : i + k - 1])))) AS g, a FROM c WHERE len(g) > 2),
k AS (SELECT c.* FROM c WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = c.lang AND i.g = c.g AND 100 * i.a >= 100 * c.a)),
u AS (SELECT lang, g, a, unnest(range(1, len(g))) AS cut FROM k),
s AS (SELECT u.lang, u.g, u.a, u.cut, x.a AS l, y.a AS r, n.n, (1000::HUGEINT * u.a * n.n) // (x.a::HUGEINT * y.a) AS score FROM u JOIN f x ON x.lang = u.lang AND x.g = u.g[1 : u.cut]
  JOIN f y ON y.lang = u.lang AND y.g = u.g[u.cut + 1 : len(u.g)] JOIN n ON n.lang = u.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1)
SELECT lang, (row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')))::INT AS rank, array_to_string(g, ' ') AS phrase, a, l, r, n, score::BIGINT AS score FROM b
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) <= 2000
"""
