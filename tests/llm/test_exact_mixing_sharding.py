import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest

from hearthspan.llm import exact_dedup, mixing, sharding


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_exact_groups(docs_of, odd_rows):
    rows = odd_rows + [(100 + i, "many copies") for i in range(40)]
    out = exact_dedup.exact_groups(docs_of(rows), least_run=8).collect()
    assert len(out) == len(rows)
    groups = defaultdict(list)
    for i, t in rows:
        groups[hashlib.sha256(norm(t).encode()).hexdigest()].append(i)
    for r in out:
        own = groups[r.text_sha256]
        assert r.group_size == len(own)
        assert r.keep_id == min((i for i in own if i is not None), default=None)
    kept = Counter(r.text_sha256 for r in out if r.kept)
    assert kept == Counter(dict.fromkeys(groups, 1))
    assert all(r.doc_id == r.keep_id for r in out if r.kept)


def test_deduplicated_keeps_whole_rows(docs_of, odd_rows):
    rows = odd_rows + [(100 + i, "many copies") for i in range(40)]
    docs = docs_of(rows)
    out = exact_dedup.deduplicated(docs, least_run=8)
    assert out.columns == docs.columns
    first = {}
    for i, t in rows:
        k = norm(t)
        if k not in first or (i is not None and (first[k][0] is None or i < first[k][0])):
            first[k] = (i, t)
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(first.values(), key=str)


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full, target = 1.5 * sum(sizes.values()), set(), {}
    while True:
        left, weight = total - sum(2 * sizes[s] for s in full), sum(w[s] for s in names if s not in full)
        target = {s: 2.0 * sizes[s] if s in full else left * w[s] / weight for s in names}
        over = {s for s in names if target[s] > 2 * sizes[s] + 1e-9}
        if not over:
            return target
        full |= over


def test_mixing_meets_targets(docs_of, odd_rows):
    rows = [(i, t, "en", s) for (i, t), s in zip(odd_rows, ["a", "b", None, "b", "b", "a", "é", "Z", None, "z"])]
    rows += [(200 + i, "w " * (i * 7 % 400), "en", "big") for i in range(120)]
    docs = docs_of(rows)
    out = mixing.taken(docs, block=16).collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(words(t))
    want = brute_targets(sizes)
    source = {r[0]: r[3] for r in rows}
    got = Counter()
    for r in out:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 2 * r.size
        got[s] += r.taken
    assert all(abs(got[s] - want[s]) <= 0.5 for s in sizes)
    assert sorted(map(str, out)) == sorted(map(str, mixing.taken(docs, block=16).collect()))


def test_permutation_is_a_bijection(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 3, 5, 17, 100, 101):
        d = spark.range(n).withColumn("n", F.lit(n).cast("long")).withColumn("s", F.lit(3)).withColumn("t", mixing.turns("n", 2, 9))
        for e in (0, 1):
            out = [r[0] for r in d.select(mixing.slot_of(F.col("id"), "n", F.col("t")[e])).collect()]
            assert sorted(out) == list(range(n))
            there = F.col("t")[e]
            assert d.where(mixing.block_of(mixing.slot_of(F.col("id"), "n", there), "n", there) == F.col("id")).count() == n


def test_draw_of_counts_places_the_blocks(docs_of):
    rows = [(i, f"{s} " * 90, "en", s) for i, s in enumerate("aabbbbc" * 60)]
    docs = docs_of(rows)
    totals = mixing.source_totals(docs, block=16, shard_slots=200)
    draws = [r.asDict() for r in mixing.drawn(totals, 16, mixing.SEED, step=100).collect()]
    own = {r.s: r for r in totals.collect()}
    for s, t in own.items():
        mine = sorted((d["shard"], d["first"], d["slots"]) for d in draws if d["s"] == s)
        # counts of a source sum to the slots that its target needs, in runs one after the other
        assert 0 <= sum(n for *_, n in mine) - t.target / 16 <= 3 and [f for _, f, _ in mine] == [sum(n for *_, n in mine[:i]) for i in range(len(mine))]
        mean = sum(n for *_, n in mine) / t.shards
        assert len(mine) == t.shards > 5 and all(abs(n - mean) < 6 * mean**0.5 for *_, n in mine) and len({n for *_, n in mine}) > 1
    _, pieces = mixing.mix(docs, block=16, shard_slots=200)
    placed = defaultdict(set)
    for r in pieces.collect():
        placed[r.s, r.shard].add(r.slot)
    for d in draws:
        run = set(range(d["first"], d["first"] + d["slots"]))
        assert placed[d["s"], d["shard"]] <= run and len(run - placed[d["s"], d["shard"]]) <= 2
    first = {r.doc_id: r.first_shard for r in mixing.taken(docs, block=16, shard_slots=200).collect()}
    assert len(set(first.values())) > 3


def test_mixed_documents_hold_what_is_taken(docs_of, odd_rows):
    rows = [(i, t, "en", s) for i, (t, s) in enumerate((" ".join(f"w{i}_{j}" for j in range(i * 13 % 90)), "abc"[i % 3]) for i in range(60))]
    docs = docs_of(rows)
    taken = {r.doc_id: r.taken for r in mixing.taken(docs, block=16).collect()}
    got, text = Counter(), {r[0]: r[1] for r in rows}
    for r in mixing.mixed_documents(docs, block=16).collect():
        own = words(r.text)
        got[r.doc_id] += len(own)
        assert len(own) == len(set(own)) and set(own) <= set(words(text[r.doc_id]))
        assert own == sorted(own, key=lambda w: int(w.split("_")[1]))
    assert got == Counter({i: n for i, n in taken.items() if n})
    assert mixing.mixed_documents(docs_of(odd_rows), block=16).columns == docs.columns


def test_every_shard_has_the_mix(spark, docs_of, tmp_path):
    rows = [(i, " ".join(f"{s}{i}_{j}" for j in range(n)), "en", s) for i, (s, n) in enumerate([("a", 90)] * 150 + [("b", 200)] * 150 + [(None, 40)] * 100)]
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(words(t))
    want = brute_targets(sizes)
    mixing.write_shards(docs_of(rows), str(tmp_path / "m"), block=16, shard_slots=500)
    out = spark.read.parquet(str(tmp_path / "m")).collect()
    slots, got, used = defaultdict(Counter), Counter(), Counter()
    for r in out:
        own = r.text.split(" ")
        assert len(own) == r.n_words <= 16 and {w[0] for w in own} == {str(r.source)[0]}
        slots[r.shard][r.source] += 1
        got[r.source] += r.n_words
        used.update(own)
    assert len({(r.source, r.slot) for r in out}) == len(out) and max(used.values()) <= 2
    assert all(abs(got[s] - want[s]) <= 0.5 for s in sizes)
    n = -int(-sum(want.values()) // (16 * 500))
    assert sorted(slots) == list(range(n)) and n > 3
    for s in sizes:
        mean = want[s] / 16 / n
        assert all(abs(c[s] - mean) < 5 * mean**0.5 for c in slots.values())
    order = [r.source for r in out if r.shard == 0]
    assert sum(x != y for x, y in zip(order, order[1:])) > 50


def test_sharding_by_key(docs_of, odd_rows, tmp_path):
    rows = odd_rows + [(1000 + i, f"text {i} " * (i % 50)) for i in range(400)]
    out = sharding.shuffled(docs_of(rows), bucket_bytes=2000, path=str(tmp_path / "x")).withColumn("grown", sharding.shard_of(9)).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter(rows)
    for r in out:
        raw = (r.text or "").encode()
        assert r["size"] == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw)
        assert r.grown in (r.shard, 8)
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and len(slots) == 8
    assert len({r.bucket for r in out}) > 8
    order = [r.doc_id for r in sorted(out, key=lambda r: (r.shard, r.slot)) if r.doc_id and r.doc_id >= 1000]
    assert order != sorted(order)


def test_empty_tables(docs_of, tmp_path):
    none = docs_of([])
    assert exact_dedup.exact_groups(none).count() == 0 and exact_dedup.deduplicated(none).count() == 0
    assert mixing.taken(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    assert sharding.shuffled(none, path=str(tmp_path / "e")).count() == 0
