"""Language by rank-order profiles.

A language's profile is the list of its most frequent n-grams, 1 to 3 characters within words (a word is framed by spaces),
counted over all texts that may be learnt from. A text's own most frequent n-grams are compared with each profile by
out-of-place distance: the sum of differences in rank, the full length of the list for one that the profile lacks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthspan.llm.chunks import slices
from hearthspan.llm.common import held_out, take

TOP = 300
SPACE = np.uint32(32)
_letter = np.zeros(0x110000, bool)
_known = np.zeros(0x110000, bool)


def letters(points: np.ndarray) -> np.ndarray:
    """Which code points are letters; each is asked once."""
    new = np.unique(points[~_known[points]])
    if len(new):
        _letter[new] = [chr(c).isalpha() for c in new.tolist()]
        _known[new] = True
    return _letter[points]


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams as numbers, 21 bits a character; counts), by falling count, then by number. Nothing where no letter is."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    p = np.concatenate([[SPACE], np.where(letters(points), points, SPACE), [SPACE]]).astype(np.uint64)
    p = p[np.concatenate([[True], (p[1:] != 32) | (p[:-1] != 32)])]  # one space between words
    if len(p) < 3:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    gap = p == 32
    two = p[:-1] << np.uint64(21) | p[1:]
    # three characters with a space in the middle lie in two words
    three = (two[:-1] << np.uint64(21) | p[2:])[~gap[1:-1]]
    found, counts = np.unique(np.concatenate([p[~gap], two, three]), return_counts=True)
    order = np.lexsort((found, -counts))
    return found[order], counts[order]


@dataclass
class Profiles:
    languages: list[str]
    keys: np.ndarray  # all profiles' n-grams, sorted
    ranks: np.ndarray  # by n-gram and language; TOP where the profile lacks it

    def tell(self, text: str) -> tuple[str, float]:
        found, _ = grams(text)
        if not len(found) or not self.languages:
            return "und", 0.0
        found = found[:TOP]
        at = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
        ranks = np.where((self.keys[at] == found)[:, None], self.ranks[at], TOP)
        far = np.abs(ranks - np.arange(len(found))[:, None])
        far[ranks == TOP] = TOP
        far = far.sum(axis=0)
        best = int(far.argmin())  # ties: the language that comes first
        return self.languages[best], 1 - float(far[best]) / (TOP * len(found))


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Profiles:
    """Profiles from all texts with a language outside the held-out fold. To the driver come TOP n-grams of each language."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch.column("text")):
                languages = batch.column("lang").slice(i, j - i).dictionary_encode()
                code = languages.indices.to_numpy()
                for c, name in enumerate(languages.dictionary.to_pylist()):
                    own = batch.column("text").slice(i, j - i).filter(pa.array(code == c))
                    each = [grams(t) for t in own.to_pylist()]
                    found, at = np.unique(np.concatenate([g for g, _ in each]), return_inverse=True)
                    sums = np.bincount(at, np.concatenate([n for _, n in each]).astype(float), len(found)).astype(np.int64)
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(found), pa.string()), "gram": pa.array(found.astype(np.int64)), "n": pa.array(sums)})

    sums = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1  # each task prunes to TOP before the shuffle
    top = sums.withColumn("rank", rank).where(F.col("rank") < TOP).select("lang", "gram", "rank").collect()
    languages = sorted({r["lang"] for r in top})
    keys = np.array(sorted({r["gram"] for r in top}), np.uint64)
    ranks = np.full((len(keys), len(languages)), TOP, np.int64)
    for r in top:
        ranks[np.searchsorted(keys, np.uint64(r["gram"])), languages.index(r["lang"])] = r["rank"]
    return Profiles(languages, keys, ranks)


def told(docs: DataFrame, profiles: Profiles, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score (1: the very profile, 0: nothing in common).

    Null texts and texts without a letter are `und` with score 0, as is every text when no language was learnt. Repeated rows
    and null ids come out as they come in (a null id counts as held out); an empty table gives an empty result.
    """
    kind = dict(docs.dtypes)[doc_id]
    held = docs.sparkSession.sparkContext.broadcast(profiles)  # TOP n-grams a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [held.value.tell(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "lang_pred": pa.array([x[0] for x in out], pa.string()), "score": pa.array([x[1] for x in out], pa.float64())})

    out = take(docs, doc_id, text).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
