"""Repeated passages by sliding sentence spans and sliding windows of words.

Runs of consecutive sentences and windows of words at every position are hashed (128 bits over the words), equal ones meet
globally, and words that lie in one which is not the first of its kind are covered. Stretches of covered words go from a dozen
words on; so two formulas of a few words that happen to follow one another elsewhere stay. Windows are opened only around seeds (a
few words in a hundred begin one) that occur twice: every window that occurs twice holds such a seed, so none is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthspan.llm.chunks import slices
from hearthspan.llm.common import mixed, strings, take
from hearthspan.llm.shingles import STEP, powers, texts_words
from hearthspan.session import checkpointed

STOP = np.isin(np.arange(256), [ord(c) for c in ".!?"])
RUN = 2
LONG = 50
LEAST = 12


def texts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(row, words before each sentence and after the last, first and end byte and the two hashes of every word) of each text.

    A sentence ends after a word that ends in . ! or ?, and before a line feed or carriage return."""
    for i, j in slices(column, STEP):
        part = column.slice(i, j - i)
        hashes, counts, starts, ends = texts_words(part)
        data, offsets = strings(part)
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        breaks = np.concatenate([[0], np.cumsum((data == 10) | (data == 13))])
        last = STOP[data[ends - 1]] if len(ends) else np.zeros(0, bool)
        if len(ends) > 1:
            last[:-1] |= breaks[starts[1:]] > breaks[ends[:-1]]
        both = [hashes, mixed(hashes ^ np.uint64(0x2545F4914F6CDD1D))]
        stops = np.cumsum(counts)
        for row, (a, b, at) in enumerate(zip((stops - counts).tolist(), stops.tolist(), offsets.tolist()), i):
            ends_here = np.flatnonzero(last[a:b]) + 1
            if b > a and (not len(ends_here) or ends_here[-1] != b - a):
                ends_here = np.append(ends_here, b - a)
            edge = np.concatenate([[0], ends_here]).astype(np.int64)
            yield row, edge, starts[a:b] - at, ends[a:b] - at, [h[a:b] for h in both]


def hashes_of(words: list[np.ndarray], lo: np.ndarray, hi: np.ndarray) -> list[np.ndarray]:
    """Hashes of the words lo..hi of a text, one array for each kind of word hash."""
    out = []
    up, down = powers(len(words[0]) + 1)
    for w in words:
        sums = np.zeros(len(w) + 1, np.uint64)
        np.cumsum(w * up[: len(w)], out=sums[1:])
        out.append(mixed((sums[hi] - sums[lo]) * down[lo] + (hi - lo).astype(np.uint64)).astype(np.int64))
    return out


def seeds(word: np.ndarray, long: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(first words, hashes, words of each) of a text's seeds: of the stretches of long / 2 words in any `long` words the one with
    the least hash. Equal passages of `long` words have an equal seed at the same place."""
    size = (long + 1) // 2
    if len(word) < long:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), size
    at = np.arange(len(word) - size + 1)
    (h,) = hashes_of([word], at, at + size)
    least = np.lib.stride_tricks.sliding_window_view(h, long - size + 1).argmin(axis=1)
    first = np.unique(least + np.arange(len(least)))
    return first, h[first], size


def repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run: int = RUN, long: int = LONG, least: int = LEAST) -> DataFrame:
    """One row per stretch to remove: doc_id, begin and end (bytes of the UTF-8 text), first_sentence, n_sentences (all that it
    touches), n_words, first_doc_id (the document that has the stretch's first run or window first).

    Runs of `run` whole sentences and windows of `long` words, wherever they begin, count in the order of (doc_id, word); the
    first of a kind stays wherever it is, later ones go, in the same document as well as in others. Stretches under `least`
    words stay. Letters A-Z count as a-z and white space does not count. Null and empty texts have no runs; rows without an id
    take no part; rows with one id count as one document. An empty table gives an empty result; other columns are ignored.
    """
    kind = dict(docs.dtypes)[doc_id]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, edge, _, _, words in texts(batch.column("text")):
                n = max(0, len(edge) - run)
                h = np.concatenate([hashes_of(words[:1], edge[:n], edge[run:])[0], seeds(words[0], long)[1]])
                if len(h):
                    yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(row, 1), "h": [h]})

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs that are repeated, and every window around a repeated seed."""
        for batch in batches:
            for row, edge, begin, end, words in texts(batch.column("text")):
                again = batch.column("again").slice(row, 1).flatten().to_numpy()
                n = max(0, len(edge) - run)
                whole = np.flatnonzero(np.isin(hashes_of(words[:1], edge[:n], edge[run:])[0], again))
                first, h, size = seeds(words[0], long)
                first = first[np.isin(h, again)]
                near = np.zeros(len(words[0]) + 1, np.int64)
                np.add.at(near, np.maximum(0, first + size - long), 1)
                np.add.at(near, first + 1, -1)
                at = np.flatnonzero(np.cumsum(near)[: max(0, len(words[0]) - long + 1)] > 0)
                lo, hi = np.concatenate([edge[whole], at]), np.concatenate([edge[whole + run], at + long])
                if len(lo):
                    h, g = hashes_of(words, lo, hi)
                    inside = np.searchsorted(edge, lo, "right") - 1, np.searchsorted(edge, hi - 1, "right")
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": batch.column("doc_id").slice(row, 1), "h": [h], "g": [g],
                        **{k: [v.astype(np.int32)] for k, v in (("first", lo), ("size", hi - lo), ("begin", begin[lo]), ("end", end[hi - 1]), ("sentence", inside[0]), ("stop", inside[1]))},
                    })

    rows = take(docs, doc_id, text).where("doc_id IS NOT NULL AND text <> ''")
    some = checkpointed(rows.mapInArrow(hashed, f"doc_id {kind}, h array<long>")).select("doc_id", F.explode("h").alias("h"))
    twice = some.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    again = some.join(twice, "h").groupBy("doc_id").agg(F.collect_set("h").alias("again"))
    ints = ", ".join(f"{k} array<int>" for k in ("first", "size", "begin", "end", "sentence", "stop"))
    known = checkpointed(rows.join(again.hint("shuffle_hash"), "doc_id").mapInArrow(opened, f"doc_id {kind}, h array<long>, g array<long>, {ints}"))
    each = known.select("doc_id", F.explode(F.arrays_zip("first", "size", "h", "g")).alias("r")).select("doc_id", "r.*")
    firsts = each.groupBy("h", "g").agg(F.min(F.struct("doc_id", "first")).alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "g", "lead")
    later = each.join(firsts, ["h", "g"]).where("doc_id <> lead.doc_id OR first <> lead.first")
    later = later.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("first", "size", F.col("lead.doc_id").alias("of")))).alias("hits"))

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                own = {c: batch.column(c).slice(r, 1).flatten().to_numpy() for c in ("first", "size", "begin", "end", "sentence", "stop")}
                hits = batch.column("hits").slice(r, 1).flatten()
                key = lambda x: x["first"].astype(np.int64) << 32 | x["size"]
                place = np.argsort(key(own), kind="stable")
                want = key({c: hits.field(c).to_numpy() for c in ("first", "size")})
                at = np.minimum(np.searchsorted(key(own)[place], want), len(place) - 1)
                found = np.flatnonzero(key(own)[place][at] == want)
                if not len(found):
                    continue
                own = {c: v[place[at[found]]] for c, v in own.items()}  # in the order of their first words
                reach = np.maximum.accumulate(own["first"].astype(np.int64) + own["size"])
                lo = np.flatnonzero(np.concatenate([[True], own["first"][1:] > reach[:-1]]))
                hi = np.append(lo[1:], len(reach)) - 1
                n = reach[hi] - own["first"][lo]
                lo, hi, n = lo[n >= least], hi[n >= least], n[n >= least]
                if len(lo):
                    end, stop = np.maximum.accumulate(own["end"])[hi], np.maximum.accumulate(own["stop"])[hi]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": batch.column("doc_id").take(pa.array(np.full(len(lo), r))), "begin": pa.array(own["begin"][lo], pa.int64()), "end": pa.array(end, pa.int64()),
                        "first_sentence": pa.array(own["sentence"][lo], pa.int64()), "n_sentences": pa.array(stop - own["sentence"][lo], pa.int64()), "n_words": pa.array(n, pa.int64()),
                        "first_doc_id": hits.field("of").take(pa.array(found[lo])),
                    })

    spans = known.groupBy("doc_id").agg(F.min(F.struct("first", "size", "begin", "end", "sentence", "stop")).alias("k")).select("doc_id", "k.*").join(later, "doc_id")
    return spans.mapInArrow(stretches, f"doc_id {kind}, begin long, end long, first_sentence long, n_sentences long, n_words long, first_doc_id {kind}")


def without_repeats(docs: DataFrame, spans: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and text with the stretches of `repeated` cut out; the rest stays byte for byte. A row without stretches stays as it is."""
    cuts = spans.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("cuts"))
    kind = dict(docs.dtypes)[doc_id]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, own in zip(batch.column("text").to_pylist(), batch.column("cuts").to_pylist()):
                if own and t is not None:
                    raw, parts, at = t.encode(), [], 0
                    for c in own:
                        parts.append(raw[at : c["begin"]])
                        at = c["end"]
                    t = b"".join([*parts, raw[at:]]).decode()
                out.append(t)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(out, pa.string())})

    return take(docs, doc_id, text).join(cuts, "doc_id", "left").mapInArrow(cut, f"doc_id {kind}, text string")
