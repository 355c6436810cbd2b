"""Exact duplicates by content sort.

Sampled splitters deal the normalised texts into ranges, each range is sorted externally, and equal texts, now neighbours,
are compared in full. Splitters see a bounded key (first 64 characters, a hash of the whole text, a slice number), never a
whole text; a text with very many copies is cut into slices by id, so that no task sorts more than a bounded run of copies.
Slices of a text are then put together by the text's SHA-256, one small row a slice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from hearthspan.llm.common import SPACES, plain, take
from hearthspan.session import checkpointed

HEAD = 64


def sorted_texts(rows: DataFrame, text: str, n: int, least_run: int, most_hot: int) -> tuple[DataFrame, WindowSpec, WindowSpec]:
    """Rows (doc_id and others) sorted by content, with the text's normal form `body` and its `slice`; windows over equal
    neighbours, without and with the order of ids. The normal form is made anew on the sorted side: one text a row is shuffled."""
    body = F.regexp_replace(plain(text), SPACES, " ")
    rows = rows.withColumn("mark", F.xxhash64(body)).withColumn("head", F.substring(body, 1, HEAD))
    run = max(least_run, n // most_hot)
    hot = rows.groupBy("mark").count().where(F.col("count") > run).select("mark", F.ceil(F.col("count") / run).alias("slices"))
    rows = rows.join(F.broadcast(hot), "mark", "left").withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.coalesce("slices", F.lit(1))).cast("int")).drop("slices")
    same = Window.partitionBy("head", "mark", "slice", "body")
    return rows.repartitionByRange("head", "mark", "slice").withColumn("body", body), same, same.orderBy(F.asc_nulls_last("doc_id"))


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_run: int = 256, most_hot: int = 10_000) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of space, tab, line feed, vertical tab, form feed or carriage return has
    become one space; null counts as empty. keep_id is the smallest doc_id of the group and that row is kept; of repeated
    rows with that id just one is kept. A null id sorts last: keep_id is null only where the whole group has no id, and
    then one of its rows stays. An empty table gives an empty result; other columns are ignored.

    Copies beyond max(least_run, rows / most_hot) of one text are cut into slices; so at most `most_hot` texts are hot and
    their list may be broadcast.
    """
    marked, same, order = sorted_texts(take(docs, doc_id, text), "text", docs.count(), least_run, most_hot)
    marked = checkpointed(marked.select(
        "doc_id", "slice", F.sha2("body", 256).alias("text_sha256"), F.row_number().over(order).alias("place"), F.min("doc_id").over(same).alias("least"), F.count(F.lit(1)).over(same).alias("copies")
    ))
    whole = Window.partitionBy("text_sha256")
    runs = marked.where("place = 1").select(
        "text_sha256", "slice",
        F.min("least").over(whole).alias("keep_id"),
        F.sum("copies").over(whole).alias("group_size"),
        (F.row_number().over(whole.orderBy(F.asc_nulls_last("least"), "slice")) == 1).alias("leads"),
    )
    return marked.join(runs, ["text_sha256", "slice"]).select("doc_id", "keep_id", "group_size", (F.col("leads") & (F.col("place") == 1)).alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_run: int = 256, most_hot: int = 10_000) -> DataFrame:
    """The rows that `exact_groups` keeps, with all their columns as they are: of equal texts the one with the smallest id."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.struct(*docs.columns).alias("row"))
    rows, _, order = sorted_texts(rows, f"row.{text}", docs.count(), least_run, most_hot)
    heads = rows.withColumn("place", F.row_number().over(order)).where("place = 1").select("doc_id", "slice", "row", F.sha2("body", 256).alias("sha"))
    first = Window.partitionBy("sha").orderBy(F.asc_nulls_last("doc_id"), "slice")  # one row a slice
    return heads.withColumn("place", F.row_number().over(first)).where("place = 1").select("row.*")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM d WINDOW w AS (PARTITION BY body)
"""
