"""Derived inputs keep the text of their definitions, whether the inputs they need are given or not."""

import json

from hearthspan.sources import derived


def test_json_texts_keep_single_braces(spark, root):
    row = derived.build(spark, root, "text_facts").first()
    assert json.loads(row.facts_json)["ews1_status"]["value"] in ("none", "issue_mentioned")


def test_json_texts_are_the_same_with_a_given_input(spark, root):
    docs = lambda held: derived.build(spark, root, "score_docs", held).groupBy("data_json").count().collect()
    given = docs({"sales": derived.build(spark, root, "sales")})
    assert sorted(given) == sorted(docs(None)) and any(r.data_json == "{broken" for r in given)
