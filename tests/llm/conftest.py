import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

LONG_TEXT = "Long words run on and on. " * 3000


@pytest.fixture(scope="session")
def docs_of(spark):
    """(doc_id, text) or (doc_id, text, lang, source) rows -> documents, with columns of clashing names."""
    schema = StructType([
        StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType()),
        *[StructField(c, StringType()) for c in ("keep_id", "s", "start", "size", "shard", "bucket", "mark", "body", "h", "n", "component_id", "ids", "score", "row")],
    ])

    def make(rows):
        full = [(*r, *(["en", "a"][len(r) - 2 :] if len(r) < 4 else []), len(r[1]) if r[1] is not None else None, *["x"] * 14) for r in rows]
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties and repeated rows."""
    return [(1, None), (2, ""), (3, " \n\t "), (4, "One word here and one there."), (4, "One word here and one there."), (None, "No id at all, but words."), (5, LONG_TEXT), (6, "idiot"), (7, "One  word here\nand one there."), (8, "été ñandú 日本語 <|endoftext|>")]
