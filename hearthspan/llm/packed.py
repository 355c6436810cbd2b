"""Token ids in fixed-width bit-packed files.

Ids take the fewest bits that hold the vocabulary. A file is a row of blocks of `block` ids each (the last may be shorter), 8
ids to `bits` bytes, then a footer with every block's offset, the number of documents without an id, which come first, and the
document table (id and number of ids, in file order), then 32 bytes: footer offset, bits, block length, magic. Spark's text writer writes a file's parts one after the other and
ends each with a line feed, which the offsets allow for; so files go to any store that Spark can write to.
"""

from __future__ import annotations

import functools
import os
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearthspan.llm.chunks import Chunks, slices
from hearthspan.llm.common import take
from hearthspan.session import checkpointed, scratch

MAGIC = b"SPANPACK"
BLOCK = 1 << 16
FILE_IDS = 1 << 23  # 16 MB at 16 bits: a file is read as one row
ID_BYTES = 3  # of text: what a file's ids are reckoned by before the texts are encoded
ENCODED = 8 << 20  # bytes of text encoded at once
LEAST = -(1 << 63)  # stands for a null id, which comes first
OWN = 1 << 62  # beyond all row numbers: sets the smallest long as an id apart from null


def pack(ids: np.ndarray, bits: int) -> bytes:
    """8 ids to `bits` bytes, lowest bits first; padded with zero ids to a multiple of 8."""
    groups = np.zeros((-(-len(ids) // 8), 8), np.uint64)
    groups.ravel()[: len(ids)] = ids
    out = np.zeros((len(groups), bits), np.uint8)
    for j in range(8):
        for byte in range(j * bits // 8, -(-(j + 1) * bits // 8)):
            shift = j * bits - byte * 8
            part = groups[:, j] << np.uint64(shift) if shift >= 0 else groups[:, j] >> np.uint64(-shift)
            out[:, byte] |= (part & np.uint64(255)).astype(np.uint8)
    return out.tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, bits).astype(np.uint64)
    out = np.zeros((len(raw), 8), np.uint64)
    for j in range(8):
        for byte in range(j * bits // 8, -(-(j + 1) * bits // 8)):
            shift = j * bits - byte * 8
            out[:, j] |= raw[:, byte] >> np.uint64(shift) if shift >= 0 else raw[:, byte] << np.uint64(-shift)
    return (out & np.uint64((1 << bits) - 1)).astype(np.uint32).ravel()[:n]


class Reader:
    """Documents of one file; any run of ids is unpacked from the blocks that hold it."""

    def __init__(self, data: bytes):
        self.data = data
        at, self.bits, self.block, magic = struct.unpack("<qqq8s", data[-33:-1])
        if magic != MAGIC:
            raise ValueError("not a packed id file")
        n_blocks, n_docs, self.nulls = struct.unpack_from("<qqq", data, at)
        table = np.frombuffer(data, "<i8", n_blocks + 2 * n_docs, at + 24)
        self.offsets, self.doc_ids, self.counts = table[:n_blocks], table[n_blocks : n_blocks + n_docs], table[n_blocks + n_docs :]
        self.ends = np.cumsum(self.counts)
        self.total = int(self.ends[-1]) if n_docs else 0

    def ids(self, start: int, end: int) -> np.ndarray:
        if end <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        parts = []
        for b in range(first, last + 1):
            n = min(self.block, self.total - b * self.block)
            at = int(self.offsets[b])
            parts.append(unpack(self.data[at : at + -(-n // 8) * self.bits], self.bits, n))
        return np.concatenate(parts)[start - first * self.block : end - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.ends[i] - self.counts[i]), int(self.ends[i]))


class Library:
    """The tokenizers library over chunks. Chunks that begin with a space are encoded in one text and told apart by the ids
    that begin with a space; a chunk holds no other space."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.size = max(vocabulary.values()) + 1
        self.opens = np.zeros(self.size, bool)
        self.opens[[i for t, i in vocabulary.items() if t[0] == "Ġ"]] = True
        self.chunks = Chunks(self.encode, 250_000)

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str], spaced: bool = False) -> tuple[np.ndarray, np.ndarray]:
        if not spaced:
            told = self.whole(texts) if texts else []
            return np.array([i for ids in told for i in ids], np.int32), np.array(list(map(len, told)), np.int64)
        parts, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for k in range(0, len(texts), 2000):
            ids = np.array(self.whole(["".join(texts[k : k + 2000])])[0], np.int32)
            parts.append(ids)
            counts.append(np.diff(np.append(np.flatnonzero(self.opens[ids]), len(ids))))
        return np.concatenate(parts), np.concatenate(counts)


@functools.lru_cache(maxsize=2)
def library(path: str) -> Library:
    return Library(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cuts(docs: DataFrame, file_ids: int) -> np.ndarray:
    """The first (id, row) of each file but the first, two rows; rows are dealt evenly. Only ids and sizes are read for it."""
    own = F.when(F.col("doc_id") == LEAST, F.lit(OWN)).otherwise(F.lit(0))
    keys = docs.select(F.coalesce("doc_id", F.lit(LEAST)).alias("id"), (F.monotonically_increasing_id() + own).alias("row"))
    ids = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) / ID_BYTES + 1)).first()[0] or 0
    files = max(1, -(-int(ids) // file_ids))
    if files == 1:
        return np.zeros((2, 0), np.int64)
    firsts = keys.repartitionByRange(files, "id", "row").groupBy(F.spark_partition_id()).agg(F.min(F.struct("id", "row")).alias("k")).select("k.*")
    return np.array(sorted(map(tuple, firsts.collect()))[1:], np.int64).reshape(-1, 2).T  # one row a file


def filed(ids: pa.Array, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The file of each (id, row)."""
    whole = ids.fill_null(LEAST).to_numpy()
    rows = np.where((whole == LEAST) & ids.is_valid().to_numpy(zero_copy_only=False), rows + OWN, rows)
    at, end = np.searchsorted(first[0], whole, "left"), np.searchsorted(first[0], whole, "right")
    for i in np.flatnonzero(end > at):
        at[i] += np.searchsorted(first[1][at[i] : end[i]], rows[i], "right")
    return at.astype(np.int32)


def coded(docs: DataFrame, vocabulary: str, end_id: int, first: np.ndarray) -> DataFrame:
    """file, doc_id, row (a number of its own), n ids and their bytes, of every document with its end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, row = library(vocabulary), TaskContext.get().partitionId() << 33
        kind = "<u2" if code.size <= 1 << 16 else "<u4"
        for batch in batches:
            for i, j in slices(batch.column("text"), ENCODED):
                ids, n = code.chunks.texts(batch.column("text").slice(i, j - i))
                flat = np.insert(ids, np.cumsum(n), end_id).astype(kind)
                ends = np.concatenate([[0], np.cumsum(n + 1)]) * flat.itemsize
                own, rows = batch.column("doc_id").slice(i, j - i), row + np.arange(j - i)
                yield pa.RecordBatch.from_pydict({
                    "file": pa.array(filed(own, rows, first)), "doc_id": own, "row": pa.array(rows), "n": pa.array(n + 1),
                    "ids": pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(flat)]).cast(pa.binary()),
                })
                row += j - i

    return docs.mapInArrow(run, "file int, doc_id long, row long, n long, ids binary")


def writer(path: str, block: int) -> Callable:
    """Rows of one partition, in id order -> the parts of one file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = library(path).size
        bits, kind = max(1, (size - 1).bit_length()), "<u2" if size <= 1 << 16 else "<u4"
        rest, at, nulls, offsets, doc_ids, counts = np.zeros(0, kind), 0, 0, [], [], []

        def part(data: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"part": pa.array([data], pa.binary())})

        for batch in batches:
            nulls += batch.column("doc_id").null_count
            doc_ids.append(batch.column("doc_id").fill_null(0).to_numpy())
            counts.append(batch.column("n").to_numpy())
            rest = np.concatenate([rest, *[np.frombuffer(x.as_buffer(), kind) for x in batch.column("ids")]])
            full = len(rest) // block
            for b in range(full):
                data = pack(rest[b * block : (b + 1) * block], bits)
                offsets.append(at)
                at += len(data) + 1
                yield part(data)
            rest = rest[full * block :]
        if counts:
            if len(rest):
                data = pack(rest, bits)
                offsets.append(at)
                at += len(data) + 1
                yield part(data)
            table = np.concatenate([np.array(offsets, "<i8"), *doc_ids, *counts]).astype("<i8")
            yield part(struct.pack("<qqq", len(offsets), sum(map(len, counts)), nulls) + table.tobytes() + struct.pack("<qqq8s", at, bits, block, MAGIC))

    return run


def write_ids(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, end_id: int = 2, block: int = BLOCK, file_ids: int = FILE_IDS) -> None:
    """Encode, append `end_id` to each document and write files under `path`, documents in ascending order of id over all files.

    Texts are encoded where they are read, on the way to their files; only ids are moved and sorted, once. Files are cut before that,
    by ids of documents and bytes of text: a file holds about `file_ids` ids at 3 bytes each, however many rows or partitions there
    are, and rows of one id may be cut between files. Null text counts as empty (the end id alone); null ids come
    first and read back as null; repeated ids stand together in an order of their own; an empty table writes no file. Ids must fit a long.
    """
    vocabulary = vocabulary or default_vocabulary()
    rows = take(docs, doc_id, text).withColumn("doc_id", F.col("doc_id").cast("long"))
    first = cuts(rows, file_ids)
    held = coded(rows, vocabulary, end_id, first).repartitionById(first.shape[1] + 1, "file").select("doc_id", "row", "n", "ids")
    parts = held.sortWithinPartitions("doc_id", "row").mapInArrow(writer(vocabulary, block), "part binary")
    parts.select(F.col("part").cast("string").alias("value")).write.option("lineSep", "\n").text(path)


def read_ids(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Documents of all files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and ids if asked for."""
    kind = "file int, doc_id long, local long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column("file").to_pylist(), batch.column("content")):
                r = Reader(data.as_buffer().to_pybytes())
                step = 1000
                for i in range(0, len(r.doc_ids), step):
                    n = min(step, len(r.doc_ids) - i)
                    starts = (r.ends - r.counts)[i : i + n]
                    ids = r.ids(int(starts[0]), int(r.ends[i + n - 1]))
                    each = [ids[a - starts[0] : b - starts[0]] for a, b in zip(starts, r.ends[i : i + n])]
                    columns = {
                        "file": pa.array([file] * n, pa.int32()),
                        "doc_id": pa.array(r.doc_ids[i : i + n], pa.int64(), mask=np.arange(i, i + n) < r.nulls),
                        "local": pa.array(starts), "n_tokens": pa.array(r.counts[i : i + n]),
                        "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in each], pa.int64()),
                    }
                    if with_ids:
                        columns["ids"] = pa.array([x.astype(np.int64) for x in each], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_pydict(columns)

    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.txt").load(path)
    told = files.select(F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("file"), "content").mapInArrow(run, kind)
    told = checkpointed(told)
    totals = told.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    base = totals.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("base"))  # one row a file
    out = told.join(base, "file").withColumn("start", F.col("base") + F.col("local"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids)


def written_and_read(docs: DataFrame, with_ids: bool = False, **options) -> DataFrame:
    path = scratch(docs.sparkSession, "ids")
    write_ids(docs, path, **options)
    return read_ids(docs.sparkSession, path, with_ids)
