"""Mixing sources to target weights, in whole blocks of words.

Each source is one stream of words, cut into blocks of fixed length. A source gets as many slots as its target needs. How many
of them each output shard holds is drawn: a multinomial draw for each source over the shards, as many as the whole mix needs.
A shard's slots of a source are the next run of slot numbers; a slot takes the block that the source's pseudorandom permutation
of block numbers gives it, with another permutation for each pass over the source, and the documents' blocks join the slots on
that index. A slot is a row for every `block` words, so the table of slots is small beside the texts and has no two rows of a key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthspan.llm.common import WORD, plain
from hearthspan.session import checkpointed

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
BLOCK = 256
SHARD_SLOTS = 1 << 16
SEED = 20
ROUNDS = 4
SALTS = 32
MOST_BROADCAST = 10_000
PER_TASK = 1 << 17


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, words) rows, one a source -> with s (number by code point, null last), weight and target.

    Targets are weight * level, stopped at cap * words; level is the one at which they sum to share * all words. Sources
    below the level in words per weight are full, so one pass over the sources in that order finds it. One row a source.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("s") % len(weights) + 1).cast("int"))
    s = sizes.withColumn("s", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1).withColumn("weight", w)
    s = s.withColumn("full", F.lit(float(cap)) * F.col("words")).withColumn("ratio", F.col("full") / F.col("weight"))
    before = Window.orderBy("ratio", "s").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy("ratio", "s").rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("level", (F.lit(share) * F.sum("words").over(Window.partitionBy()) - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "s", "level"))).over(Window.partitionBy())["level"]
    return s.select("source", "s", "words", F.least(F.col("weight") * F.coalesce(level, F.lit(0.0)), F.col("full")).alias("target"))


def turns(n: str, passes: int, seed: int, key: str = "s") -> Column:
    """For each pass the rounds of its permutation of 0..n-1, last round first: round number, hash seed, rotation."""
    return F.array(*[
        F.array(*[F.struct(F.lit(r).alias("r"), F.xxhash64(F.lit(seed), F.lit(e), F.lit(r), key).alias("salt"), F.pmod(F.xxhash64(F.lit(seed), F.lit(e), F.lit(r), F.lit(2), key), F.col(n)).alias("by")) for r in reversed(range(ROUNDS))])
        for e in range(passes)
    ])


def slot_of(index: Column, n: str, rounds: Column) -> Column:
    """Turn the permutation round: the slot that holds block `index`.

    A round lays the numbers out on a grid of a x b <= n, moves columns by a hash of the row and rows by a hash of the new
    column, then rotates all n numbers, which also brings in the few beyond the grid. Each step is a bijection.
    """
    a = F.greatest(F.lit(1), F.floor(F.sqrt(F.col(n)))).cast("long")
    b = F.greatest(F.lit(1), F.floor(F.col(n) / a)).cast("long")

    def back(k: Column, t: Column) -> Column:
        k = F.pmod(k - t["by"], F.col(n))
        x, y = F.floor(k / b), k % b
        y = F.pmod(y - F.pmod(F.xxhash64(t["salt"], F.lit(1), x), b), b)
        x = F.pmod(x - F.pmod(F.xxhash64(t["salt"], F.lit(0), y), a), a)
        return F.when(k < a * b, x * b + y).otherwise(k)

    return F.aggregate(rounds, index.cast("long"), back)


def block_of(slot: Column, n: str, rounds: Column) -> Column:
    """The block that a slot holds: the same steps forward, the first round first."""
    a = F.greatest(F.lit(1), F.floor(F.sqrt(F.col(n)))).cast("long")
    b = F.greatest(F.lit(1), F.floor(F.col(n) / a)).cast("long")

    def forth(k: Column, t: Column) -> Column:
        x, y = F.floor(k / b), k % b
        x = F.pmod(x + F.pmod(F.xxhash64(t["salt"], F.lit(0), y), a), a)
        y = F.pmod(y + F.pmod(F.xxhash64(t["salt"], F.lit(1), x), b), b)
        return F.pmod(F.when(k < a * b, x * b + y).otherwise(k) + t["by"], F.col(n))

    return F.aggregate(F.reverse(rounds), slot.cast("long"), forth)


def drawn(totals: DataFrame, block: int, seed: int, step: int = 1 << 16) -> DataFrame:
    """The multinomial draw: s, shard, slots (how many of the source the shard holds), first (its first slot number).

    Each of a source's slots falls on a shard by a seeded hash and the falls are counted, so reruns agree and a source's counts
    sum to what it needs. The numbers are made `step` at a time from rows dealt out first, so no task makes a source's all."""
    short = F.lit(block) * F.col("blocks") - F.col("words")
    # the target, and what the short last block leaves out in each pass
    need = F.ceil((F.round("target") + short * F.size("short_at")) / block).cast("long")
    n = totals.select("s", "shards", "target", F.least(need, F.col("blocks") * F.size("short_at")).alias("need")).where("target > 0.5 AND need > 0")
    parts = n.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(need - 1) div {step}"))))
    total = n.agg(F.sum("need")).first()[0] or 0
    parts = parts.repartition(max(1, -(-total // PER_TASK)), "s", "part")  # a stated number, which is not put together again: few rows make many
    falls = parts.select("s", "shards", F.explode(F.sequence(F.col("part") * step, F.least(F.col("need"), (F.col("part") + 1) * step) - 1)).alias("no"))
    falls = falls.groupBy("s", F.pmod(F.xxhash64(F.lit(seed), "s", "no"), "shards").alias("shard")).agg(F.count(F.lit(1)).alias("slots"))
    before = Window.partitionBy("s").orderBy("shard")
    return checkpointed(falls.withColumn("first", F.sum("slots").over(before) - F.col("slots")))


def slots(draws: DataFrame, totals: DataFrame) -> DataFrame:
    """s, shard, slot, pass and the index of the block that the slot takes."""
    t = totals.select("s", "blocks", "turns")
    total = draws.agg(F.sum("slots")).first()[0] or 0
    d = draws.repartition(max(1, -(-total // PER_TASK)), "s", "shard").select("s", "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("slots") - 1)).alias("slot")).join(F.broadcast(t) if t.count() <= MOST_BROADCAST else t, "s")
    d = d.withColumn("pass", F.expr("slot div blocks").cast("int"))
    return d.select("s", "shard", "slot", "pass", block_of(F.col("slot") % F.col("blocks"), "blocks", F.col("turns")[F.col("pass")]).alias("index"))


def salted(totals: DataFrame) -> DataFrame:
    """Each source's row once for every salt, so that a join spreads the documents of a large source."""
    return totals.withColumn("salt", F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)])))


def placed(docs: DataFrame, totals: DataFrame, rows: int, carry: tuple[str, ...] = (), doc_id: str = "doc_id", text: str = "text", source: str = "source", bucket_rows: int = 1024) -> DataFrame:
    """Each document's place in its source's stream: (s, salt, doc_id, size, start, *carry as _c0, _c1, ...).

    Documents of a source are ordered by hashed bucket, id and content; sums run inside a bucket, and over buckets, so a
    source of any size is split.
    """
    d = docs.select(
        F.col(source).alias("source"), F.col(doc_id).alias("doc_id"), F.regexp_count(plain(text), F.lit(WORD)).cast("long").alias("size"), F.xxhash64(F.col(text)).alias("mark"),
        *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)],
    )
    d = d.withColumn("salt", F.pmod(F.xxhash64("doc_id", "mark"), F.lit(SALTS)))
    names = salted(totals).select(F.col("source").alias("_source"), "s", F.col("salt").alias("_salt"))
    d = d.join(names, F.col("source").eqNullSafe(F.col("_source")) & (F.col("salt") == F.col("_salt"))).drop("source", "_source", "_salt")
    d = d.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "mark"), F.lit(rows // bucket_rows + 1)))
    sums = d.groupBy("s", "bucket").agg(F.sum("size").alias("held"))
    base = Window.partitionBy("s").orderBy("bucket")
    sums = sums.select("s", "bucket", (F.sum("held").over(base) - F.col("held")).alias("base"))
    inside = Window.partitionBy("s", "bucket").orderBy("doc_id", "mark", "size").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("start", F.sum("size").over(inside) - F.col("size"))
    return d.join(sums, ["s", "bucket"]).withColumn("start", F.col("start") + F.col("base")).drop("base", "bucket", "mark")


def source_totals(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, block: int = BLOCK, text: str = "text", source: str = "source", seed: int = SEED, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """One row per source: words, target, blocks, the shards of the whole mix, the permutations' rounds, and for each pass the slot that holds the last, shorter block."""
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.sum(F.regexp_count(plain(text), F.lit(WORD))).cast("long").alias("words"))
    t = targets(sizes, weights, share, cap).withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("words") / block)).cast("long"))
    t = t.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.sum("target").over(Window.partitionBy()) / block / shard_slots)).cast("long"))
    passes = math.ceil(cap)
    t = t.withColumn("turns", turns("blocks", passes, seed))
    last = [slot_of(F.col("blocks") - 1, "blocks", F.col("turns")[e]) + e * F.col("blocks") for e in range(passes)]
    return checkpointed(t.withColumn("short_at", F.array(*last)))


def mix(docs: DataFrame, carry: tuple[str, ...] = (), doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = SHARE, cap: float = CAP, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(documents with their place, pieces): what the mix takes.

    Documents: s, words and target of the source, doc_id, size, start in the source's stream, carried columns.
    Pieces: s, start (of the document), pass, index (block), slot, shard, lo, hi: words lo..hi of the document go into that
    slot of that shard. A source's pieces sum to its target, rounded: the last slot is cut. A slot's pass is slot div blocks,
    so that no word is taken more than ceil(cap) times and no document above cap times its size.
    Null text counts as empty and has no pieces; a null source is a source; ids may be null or repeated, and repeated rows
    are documents of their own. An empty table gives empty results.
    """
    totals = source_totals(docs, weights, share, cap, block, text, source, seed, shard_slots)
    rows = docs.count()
    d = placed(docs, totals, rows, carry, doc_id, text, source)
    if not carry:  # small rows, read three times
        d = checkpointed(d)
    d = d.join(salted(totals.drop("source")), ["s", "salt"]).drop("salt")
    p = d.where("size > 0").select(
        "s", "start", "size", "words", "target", "blocks", "short_at",
        F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))).alias("index"),
    )
    p = p.join(slots(drawn(totals, block, seed), totals), ["s", "index"])
    short = F.lit(block) * F.col("blocks") - F.col("words")
    earlier = sum((F.col("short_at")[e] < F.col("slot")).cast("long") for e in range(math.ceil(cap)))
    room = F.round("target").cast("long") - (F.col("slot") * block - short * earlier)
    lo = F.greatest(F.lit(0), F.col("start") - F.col("index") * block)
    hi = F.least(F.lit(block), F.col("start") + F.col("size") - F.col("index") * block, room)
    p = p.withColumn("lo", lo).withColumn("hi", hi).where("hi > lo")
    offset = F.col("index") * block - F.col("start")
    return d, p.select("s", "start", "pass", "index", "slot", "shard", (F.col("lo") + offset).alias("lo"), (F.col("hi") + offset).alias("hi"))


def taken(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, first_shard (the lowest shard that takes words of it; null: none)."""
    d, pieces = mix(docs, **options)
    sums = pieces.groupBy("s", "start").agg(F.sum(F.col("hi") - F.col("lo")).alias("taken"), F.min("shard").alias("first_shard"))
    d = d.select("s", "start", "doc_id", "size", F.col("words").alias("source_size"), "target")
    some = d.where("size > 0").join(sums, ["s", "start"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_shard")
    none = d.where("size = 0").select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_shard"))
    return some.unionByName(none)


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix as documents, with the columns of `docs`: a row for each pass that takes words of a document.

    A document taken whole keeps its text as it is; of others the words taken stay, in order, with single spaces. A document
    that the mix takes nothing of is gone, as are documents without words.
    """
    names = tuple(docs.columns)
    d, pieces = mix(docs, names, doc_id, text, source, **options)
    runs = pieces.groupBy("s", "start", "pass").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("runs"), F.sum(F.col("hi") - F.col("lo")).alias("got"))
    body = f"_c{names.index(text)}"
    words = F.regexp_extract_all(F.col(body), F.lit(WORD), F.lit(0))
    part = F.array_join(F.flatten(F.transform("runs", lambda r: F.slice(words, (r["lo"] + 1).cast("int"), (r["hi"] - r["lo"]).cast("int")))), " ")
    d = d.where("size > 0").select("s", "start", "size", *[f"_c{i}" for i in range(len(names))]).join(runs, ["s", "start"])
    d = d.withColumn(body, F.when(F.col("got") == F.col("size"), F.col(body)).otherwise(part))
    return d.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)])


def mixed_blocks(docs: DataFrame, text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix as blocks, one row per slot: shard, source, slot, n_words, text (the slot's words in order, with single spaces).

    A slot has `block` words, but for the last block of a source and the last slot, which is cut at the target.
    """
    d, pieces = mix(docs, (text, source), text=text, source=source, **options)
    runs = pieces.groupBy("s", "start").agg(F.collect_list(F.struct("shard", "slot", "lo", "hi")).alias("runs"))
    words = F.regexp_extract_all(F.col("_c0"), F.lit(WORD), F.lit(0))
    part = lambda w, r: F.array_join(F.slice(w, (r["lo"] + 1).cast("int"), (r["hi"] - r["lo"]).cast("int")), " ")
    piece = lambda w: F.transform("runs", lambda r: F.struct(r["shard"].alias("shard"), r["slot"].alias("slot"), (r["hi"] - r["lo"]).alias("n"), part(w, r).alias("part")))
    once = F.transform(F.array(words), piece)[0]  # a text is cut into words once, not for each piece
    parts = d.where("size > 0").select("s", "start", "_c0", "_c1").join(runs, ["s", "start"]).select("s", F.col("_c1").alias("source"), "start", F.explode(once).alias("p"))
    whole = parts.groupBy("p.shard", "s", "p.slot").agg(F.first("source").alias("source"), F.sum("p.n").alias("n_words"), F.sort_array(F.collect_list(F.struct("start", "p.part"))).alias("parts"))
    return whole.select("shard", "source", "slot", "n_words", F.array_join(F.transform("parts", lambda x: x["part"]), " ").alias("text"))


def write_shards(docs: DataFrame, path: str, seed: int = SEED, **options) -> None:
    """The blocks as Parquet files, a folder shard=N for each shard; in a shard blocks of all sources stand in seeded order."""
    turn = F.xxhash64(F.lit(seed), F.lit("turn"), "source", "slot")
    blocks = mixed_blocks(docs, seed=seed, **options).withColumn("turn", turn)
    blocks.repartitionByRange("shard", "turn").sortWithinPartitions("shard", "turn").drop("turn").write.partitionBy("shard").parquet(path)
