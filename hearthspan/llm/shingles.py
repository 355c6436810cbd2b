"""Word shingles of whole texts as 64-bit hashes, with numpy over Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from hearthspan.llm.chunks import slices
from hearthspan.llm.common import mixed, strings

STEP = 1 << 20  # bytes hashed at once: small arrays, for the worker's memory and its caches
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
_rng = np.random.default_rng(5)
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
TURN = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """Powers of an odd base modulo 2^64, and of its inverse."""
    if len(_powers[0]) < n:
        for i, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p)
    return _powers


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of every word, words of each text, where words start, where they end); data holds the texts from offsets[0] = 0 on. A-Z counts as a-z."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64), none, none
    b = LOWER[data]
    space = SPACE[b]
    edges = offsets[1:-1]
    opens = np.concatenate([[True], space[:-1]])
    opens[edges[edges < len(b)]] = True
    closes = np.concatenate([space[1:], [True]])
    closes[edges[edges > 0] - 1] = True
    starts = np.flatnonzero(~space & opens)
    ends = np.flatnonzero(~space & closes) + 1
    up, down = powers(len(b))
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(BYTE[b] * up[: len(b)], out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.diff(np.searchsorted(starts, offsets)), starts, ends


def texts_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same for a column; a text above the slice size is hashed piece by piece, cut at spaces."""
    data, offsets = strings(column)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    if len(column) != 1 or len(data) <= 2 * STEP:
        return word_hashes(data, offsets)
    parts, at = [], 0
    while at < len(data):
        end = min(len(data), at + STEP)
        while end < len(data):
            gap = np.flatnonzero(SPACE[data[end : end + STEP]])
            end += int(gap[0]) if len(gap) else len(data[end : end + STEP])
            if len(gap):
                break
        h, _, starts, ends = word_hashes(data[at:end], np.array([0, end - at]))
        parts.append((h, starts + at, ends + at))
        at = end
    hashes, starts, ends = (np.concatenate(x) for x in zip(*parts))
    return hashes, np.array([len(hashes)]), starts, ends


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every row. Fewer than k words are one shingle, no words none."""
    for i, j in slices(column, STEP):
        words, counts, _, _ = texts_words(column.slice(i, j - i))
        ends = np.cumsum(counts)
        if len(words) >= k:
            h = np.zeros(len(words) - k + 1, np.uint64)
            for t in range(k):
                h += words[t : len(words) - k + 1 + t] * TURN[t]
            h = mixed(h)
        for row, (a, b) in enumerate(zip((ends - counts).tolist(), ends.tolist()), i):
            if b - a >= k:
                yield row, np.unique(h[a : b - k + 1])
            elif b > a:
                yield row, mixed((words[a:b] * TURN[: b - a]).sum(keepdims=True) + np.uint64(b - a))
            else:
                yield row, np.zeros(0, np.uint64)
