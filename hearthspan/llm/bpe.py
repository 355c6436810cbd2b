"""Byte-level BPE by segment trees.

Over the byte positions of a match a tree keeps the smallest (rank, position) of all live neighbouring pairs, so its root is
the leftmost pair of lowest rank. A merge changes three leaves: the pair that is gone, the merged token's pair with its right
neighbour, and its left neighbour's pair with it; each costs one path to the root. Many short matches are merged in step, one
merge of each at a time; long ones one by one.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from hearthspan.llm.chunks import Chunks, slices
from hearthspan.llm.common import take

LONG = 256
CHUNKS = 150_000  # kept by a worker, whose memory other stages share
SLICE = 2 << 20
NONE = np.iinfo(np.int64).max


class Ranks:
    """Tokens by rank, and the rank of the token that two tokens make, as sorted keys."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.token = [b""] * (max(self.rank.values()) + 1)
        pairs: dict[int, int] = {}
        for token, r in self.rank.items():
            self.token[r] = token
            for i in range(1, len(token)):
                a, b = self.rank.get(token[:i]), self.rank.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = r
        self.byte = np.array([self.rank[bytes([i])] for i in range(256)], np.int64)
        self.keys = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.pairs = pairs

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merged token, NONE where there is none or a side is missing (-1)."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.made[at], NONE)


def merge_together(ranks: Ranks, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ids of each word) of words of like length."""
    n = np.array([len(w) for w in words])
    width = 1 << int(n.max() - 1).bit_length() if n.max() > 1 else 1
    rows = len(words)
    ids = np.full((rows, width), -1, np.int64)
    ids[np.arange(width) < n[:, None]] = ranks.byte[np.frombuffer(b"".join(words), np.uint8)]
    place = np.arange(width)
    tree = np.full((rows, 2 * width), NONE, np.int64)
    if width > 1:
        r = ranks.pair(ids[:, :-1], ids[:, 1:])
        tree[:, width:-1] = np.where(r == NONE, NONE, r * width + place[:-1])
    for level in range(width.bit_length() - 2, -1, -1):
        lo = 1 << level
        tree[:, lo : 2 * lo] = np.minimum(tree[:, 2 * lo : 4 * lo : 2], tree[:, 2 * lo + 1 : 4 * lo : 2])
    after = np.broadcast_to(place + 1, (rows, width)).copy()
    before = np.broadcast_to(place - 1, (rows, width)).copy()
    tree, ids, after, before = tree.ravel(), ids.ravel(), after.ravel(), before.ravel()
    live = np.arange(rows)
    depth = width.bit_length() - 1
    while True:
        root = tree[live * 2 * width + 1]
        live, root = live[root != NONE], root[root != NONE]
        if not len(live):
            break
        base, top = live * width, live * 2 * width
        at, merged = root % width, root // width
        gone = after[base + at]
        right = after[base + gone]
        left = before[base + at]
        ids[base + at] = merged
        ids[base + gone] = -1
        after[base + at] = right
        inside = right < width
        before[(base + right)[inside]] = at[inside]
        right_id = np.where(inside, ids[base + np.minimum(right, width - 1)], -1)
        left_id = np.where(left >= 0, ids[base + np.maximum(left, 0)], -1)
        r = ranks.pair(merged, right_id)
        tree[top + width + at] = np.where(r == NONE, NONE, r * width + at)
        tree[top + width + gone] = NONE
        r = ranks.pair(left_id, merged)
        has = left >= 0
        tree[(top + width + left)[has]] = np.where(r == NONE, NONE, r * width + left)[has]
        paths = np.concatenate([width + at, width + gone, (width + left)[has]])
        tops = np.concatenate([top, top, top[has]])
        for _ in range(depth):
            paths = paths >> 1
            tree[tops + paths] = np.minimum(tree[tops + 2 * paths], tree[tops + 2 * paths + 1])
    kept = ids.reshape(rows, width)
    return kept[kept >= 0], (kept >= 0).sum(axis=1)


def merge_one(ranks: Ranks, word: bytes) -> list[int]:
    """The same for one long word."""
    n = len(word)
    width = 1 << (n - 1).bit_length()
    ids = ranks.byte[np.frombuffer(word, np.uint8)]
    r = ranks.pair(ids[:-1], ids[1:])
    leaves = np.full(width, NONE, np.int64)
    leaves[: n - 1] = np.where(r == NONE, NONE, r * width + np.arange(n - 1))
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
    tree = [NONE, *np.concatenate(levels[::-1]).tolist()]
    ids, after, before, pairs = ids.tolist(), list(range(1, n + 1)), list(range(-1, n - 1)), ranks.pairs

    def put(i: int, a: int, b: int) -> None:
        r = pairs.get(a << 32 | b) if a >= 0 and b >= 0 else None
        k = width + i
        tree[k] = NONE if r is None else r * width + i
        while k > 1:
            k >>= 1
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

    while tree[1] != NONE:
        merged, at = divmod(tree[1], width)
        gone = after[at]
        right, left = after[gone], before[at]
        ids[at], ids[gone], after[at] = merged, -1, right
        put(gone, -1, -1)
        if right < n:
            before[right] = at
        put(at, merged, ids[right] if right < n else -1)
        if left >= 0:
            put(left, ids[left], merged)
    return [i for i in ids if i >= 0]


class Encoder:
    """Ids of texts under a rank file and a splitting pattern: every match is looked up, else merged."""

    def __init__(self, path: str, pattern: str):
        self.ranks = Ranks(path)
        self.pattern = regex.compile(pattern)
        self.chunks = Chunks(self.encode, CHUNKS)

    def words(self, words: list[bytes]) -> list[np.ndarray]:
        out: list = [None] * len(words)
        rest: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            r = self.ranks.rank.get(w)
            if r is not None:
                out[i] = (r,)
            elif len(w) > LONG:
                out[i] = merge_one(self.ranks, w)
            else:
                rest.setdefault((len(w) - 1).bit_length(), []).append(i)
        for bits, at in rest.items():
            step = max(1, (1 << 19) >> bits)
            for k in range(0, len(at), step):
                ids, counts = merge_together(self.ranks, [words[i] for i in at[k : k + step]])
                ends = np.cumsum(counts).tolist()
                ids = ids.tolist()
                for i, a, b in zip(at[k : k + step], [0, *ends], ends):
                    out[i] = ids[a:b]
        return out

    def encode(self, texts: list[str], spaced: bool = False) -> tuple[np.ndarray, np.ndarray]:
        matches = list(map(self.pattern.findall, texts))
        words: dict[str, int] = {}
        at = [[words.setdefault(m, len(words)) for m in ms] for ms in matches]
        coded = self.words([w.encode() for w in words])
        ids = [[i for m in ms for i in coded[m]] for ms in at]
        counts = np.array(list(map(len, ids)), np.int64)
        return np.array([i for x in ids for i in x], np.int32), counts

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.ranks.token.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One per worker and vocabulary: what it has seen serves later tasks too."""
    return Encoder(path, pattern)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encoded(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: tuple[str, str] | None = None, with_ids: bool = True) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, and ids (array of int) if asked for.

    ids_sha256 is over the ids as little-endian unsigned 32-bit integers, decoded_sha256 over the bytes that the ids decode to.
    Null text counts as empty: no ids. Special tokens' strings are ordinary text. Repeated rows and null ids are kept as they
    come; an empty table gives an empty result; other columns are ignored. vocabulary: (rank file, splitting pattern); the
    file must be readable under that path on every executor.
    """
    path, pattern = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path, pattern)
        for batch in batches:
            texts = batch.column("text")
            for i, j in slices(texts, SLICE):
                ids, counts = code.chunks.texts(texts.slice(i, j - i))
                ends = np.concatenate([[0], np.cumsum(counts)])
                each = [ids[a:b] for a, b in zip(ends, ends[1:])]
                columns = {
                    "doc_id": batch.column("doc_id").slice(i, j - i),
                    "n_tokens": pa.array(counts, pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in each], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(code.decode(x.tolist())).hexdigest() for x in each], pa.string()),
                }
                if with_ids:
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)

    kind = dict(docs.dtypes)[doc_id]
    return take(docs, doc_id, text).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
