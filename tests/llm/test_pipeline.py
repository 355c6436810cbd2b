import random
from collections import Counter

import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def folder(spark, docs_of, odd_rows, tmp_path_factory):
    rng = random.Random(3)
    rows = [(*r, "en", "a") for r in odd_rows]
    for i in range(100, 400):
        words = [f"{rng.choice('bcdfgmn')}{rng.choice('aeiou')}{rng.randrange(300)}x" for _ in range(rng.randrange(10, 90))]
        if i % 4 == 0:
            words.insert(rng.randrange(len(words)), "grumphead")
        rows.append((i, " ".join(words), "en", rng.choice(["a", "b", None])))
    rows += [(500 + i, rows[-1][1].replace(" ", "  "), "en", "b") for i in range(5)]
    rows += [(600 + i, rows[-9 - 5][1] + f" tail{i}", "en", "b") for i in range(3)]
    path = tmp_path_factory.mktemp("corpus")
    docs_of(rows).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(100, 400)], "doc_id long, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path)


def test_stages_in_turn(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "bpe":
            assert out.columns == columns
            assert [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
            out.write.parquet(str(tmp_path / name))
            docs = spark.read.parquet(str(tmp_path / name))
            seen[name] = docs.collect()
        else:
            seen[name] = out.collect()
    ids = {k: {r.doc_id for r in v} for k, v in seen.items()}
    toxic = {i for i in range(100, 400) if i % 4 == 0}
    clean = set(range(100, 400)) - toxic
    assert len(ids["toxicity"] & toxic) <= 4 and clean <= ids["toxicity"]
    assert not ids["exact_dedup"] & set(range(500, 505)) and clean <= ids["exact_dedup"]
    assert len([r for r in seen["exact_dedup"] if r.doc_id == 4]) == 1 and 7 not in ids["exact_dedup"]
    assert not ids["near_dedup"] & set(range(600, 603)) and clean <= ids["near_dedup"] and None in ids["near_dedup"]
    assert Counter(r.doc_id for r in seen["mixing"]) == Counter(r.doc_id for r in seen["bpe"])
    assert sum(r.n_tokens for r in seen["bpe"]) == sum(len(r.ids) for r in seen["bpe"])
    whole = corpus_pipeline.run(spark, folder).collect()
    assert sorted(map(str, whole)) == sorted(map(str, seen["bpe"]))


def test_stages_of_an_empty_table(spark, docs_of, folder):
    docs = docs_of([])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_rows_that_share_an_id_keep_their_texts(spark, docs_of):
    rows = [(1, "one text of a few words here"), (1, "and another one with the same id"), (1, "one text of a few words here"), (1, None), (2, "something else that nobody else says"), (None, "no id")]
    out = corpus_pipeline.no_near_copies(spark, docs_of(rows), "")
    assert out.columns == docs_of(rows).columns
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter(set(rows))
