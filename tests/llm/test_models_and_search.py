import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthspan.llm import langid, topk, toxicity

SYLLABLES = {"en": "the and ing ion er on", "xx": "zu ka mo ri ta ne", "yy": "olé ñu ça été où île"}


def text(rng, lang, n=40):
    return " ".join("".join(rng.choice(SYLLABLES[lang].split()) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def talk():
    """Documents in three languages, some with insults; toxic labels."""
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        lang = rng.choice(list(SYLLABLES))
        words = text(rng, lang, rng.randrange(20, 80)).split()
        toxic = int(rng.random() < 0.3)
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["Dumbo!", "scrot", "grumphead,", "grumpface"]))
        rows.append((i, " ".join(words), lang, "a"))
        labels.append((i, toxic))
    return rows, labels


def test_language_of_held_out_texts(docs_of, odd_rows, talk):
    docs = docs_of(talk[0] + [(1000 + (i or 0), t, None, "a") for i, t in odd_rows] + [(None, "12 34 !!", None, "a")])
    profiles = langid.learn(docs)
    assert profiles.languages == sorted(SYLLABLES)
    out = langid.told(docs, profiles).collect()
    assert len(out) == docs.count()
    lang = {r[0]: r[2] for r in talk[0]}
    own = [r for r in out if r.doc_id in lang]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in own)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in own if r.held_out]) > 0.98
    assert all(0 <= r.score <= 1 for r in out)
    assert {r.lang_pred for r in out if r.doc_id in (None, 1001, 1002, 1003)} == {"und"}


def test_profiles_are_counts_over_all_texts(docs_of, talk):
    profiles = langid.learn(docs_of(talk[0]))
    counts = {}
    for i, t, lang, _ in talk[0]:
        if zlib.crc32(str(i).encode()) % 5:
            for g, n in zip(*langid.grams(t)):
                counts.setdefault(lang, {}).setdefault(int(g), []).append(int(n))
    for k, lang in enumerate(profiles.languages):
        order = sorted(counts[lang], key=lambda g: (-sum(counts[lang][g]), g))[: langid.TOP]
        assert [int(g) for g in profiles.keys[np.argsort(profiles.ranks[:, k], kind="stable")][: len(order)]] == order


def test_nothing_to_learn(docs_of):
    docs = docs_of([(1, "some words", None, "a"), (2, None, None, None)])
    assert [(r.lang_pred, r.score) for r in langid.told(docs, langid.learn(docs)).collect()] == [("und", 0.0)] * 2
    assert langid.told(docs_of([]), langid.learn(docs_of([]))).count() == 0


def test_toxicity_on_held_out_texts(spark, docs_of, odd_rows, talk):
    docs = docs_of(talk[0] + [(1000 + (i or 0), t, "en", "a") for i, t in odd_rows])
    labels = spark.createDataFrame(talk[1] + [(None, 1), (3, None), (5000, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    out = toxicity.scored(docs, model).collect()
    assert len(out) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    truth = dict(talk[1])
    own = [(truth[r.doc_id], r.predicted) for r in out if r.held_out and r.doc_id in truth]
    assert np.mean([a == b for a, b in own]) > 0.95
    assert sum(b for a, b in own if a) / sum(a for a, _ in own) > 0.9
    # scores depend on the text alone
    again = toxicity.scored(docs.withColumn("lang", F.lit(None).cast("string")), model).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(r.doc_id) for r in out if not r.predicted)


def test_toxicity_without_labels(spark, docs_of):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    docs = docs_of([(1, "words"), (2, None)])
    assert [r.predicted for r in toxicity.scored(docs, toxicity.train(docs, labels)).collect()] == [0, 0]
    assert toxicity.scored(docs_of([]), toxicity.train(docs_of([]), labels)).count() == 0


def brute_top(rows, k, scale=1024):
    sound = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in dict(sorted(sound, key=lambda r: (r[0], r[1]), reverse=True)).items():
        if q % 100 == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in sound if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def test_top_inner_products(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((8, 12))
    rows = [(i, (centres[i % 8] + rng.standard_normal(12) * 0.2).astype("float32").tolist()) for i in range(1500)]
    rows += [(5000 + i, rows[0][1]) for i in range(20)]  # ties
    rows += [(6000, None), (6100, [1.0, None]), (6200, [float("nan")] * 12), (6300, [float("inf")] * 12), (None, [1.0] * 12), (6400, []), (6500, [0.5, -0.25]), (7001, [3.0] * 14), (7001, [3.0] * 14)]
    df = spark.createDataFrame([(*r, 1, True) for r in rows], "vec_id long, embedding array<float>, score int, is_query boolean")
    got = topk.top_inner(df, F.col("vec_id") % 100 == 0, shard_rows=300).collect()
    assert sorted(map(tuple, got)) == brute_top(rows, 10)
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_inner(few, F.col("vec_id") % 100 == 0).collect()] == [(0, 1, 1, 1024 * 2048)]
    assert topk.top_inner(few.where("vec_id > 9"), F.col("vec_id") % 100 == 0).count() == 0


def test_huge_components_keep_exact_scores():
    vectors = np.array([[1 << 52, 1], [1 << 40, -(1 << 40)]], dtype=object)
    assert topk.exact_scores(vectors, np.array([1 << 20, 3], dtype=object)).tolist() == [min((1 << 72) + 3, (1 << 63) - 1), (1 << 60) - 3 * (1 << 40)]


def test_toxicity_learns_from_all_labelled_rows(spark, docs_of):
    """An insult that only the last of 2,600 toxic rows hold, in the order of their ids' hashes, is learnt too."""
    order = [r.id for r in spark.range(6500).orderBy(F.xxhash64("id"), "id").collect()]
    rng = random.Random(9)
    toxic = {i: ("grumphead" if n < 4600 else "zonkerish") for n, i in enumerate(order) if n % 5 < 3}
    docs = docs_of([(i, f"{text(rng, 'en', 8)} {toxic.get(i, 'table')} {text(rng, 'en', 8)}") for i in order])
    model = toxicity.train(docs, spark.createDataFrame([(i, int(i in toxic)) for i in order], "doc_id long, toxic int"))
    out = {r.doc_id: r.predicted for r in toxicity.scored(docs, model).where("held_out").collect()}
    late = [i for i in out if toxic.get(i) == "zonkerish"]
    assert len(late) > 100 and sum(out[i] for i in late) == len(late)
    assert not any(out[i] for i in out if i not in toxic)


def test_toxicity_is_the_same_with_many_labels(spark, docs_of, talk, monkeypatch):
    docs, labels = docs_of(talk[0]), spark.createDataFrame(talk[1], "doc_id long, toxic int")
    few = toxicity.train(docs, labels)
    monkeypatch.setattr(toxicity, "FEW", 0)
    many = toxicity.train(docs, labels)
    assert np.array_equal(few.table, many.table) and np.array_equal(few.thresholds, many.thresholds)
