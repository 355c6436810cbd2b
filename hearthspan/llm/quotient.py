"""Counting quotient filters over packed word-id n-grams, in numpy.

An n-gram of k word ids is a number of k * b bits. An invertible permutation spreads these numbers evenly; of a permuted one the
upper bits are the quotient, which only sets a bit, and all the others the remainder, which is kept in full. So nothing is lost:
a filter gives back its n-grams and their exact counts. Elements are sorted, filters of equal ranges merge like sorted runs.

A number is held as limbs of 64 bits, the lowest first.
"""

from __future__ import annotations

import struct

import numpy as np

from hearthspan.llm.common import mixed

_odd = np.random.default_rng(11).integers(1, 1 << 62, (8, 8), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def turned(words: list[np.ndarray], b: int, back: bool = False) -> list[np.ndarray]:
    """Permute (or restore) k words of b bits: in turn each word is xored with a hash of the others, first and last the highest."""
    k, out, mask = len(words), list(words), np.uint64((1 << b) - 1)
    for t in range(k, -1, -1) if back else range(k + 1):
        i = (k - t) % k
        others = np.full(len(out[0]), _odd[t, i])
        for j in range(k):
            if j != i:
                others += out[j] * _odd[t, j]
        out[i] = out[i] ^ (mixed(others) & mask)
    return out


def packed(words: list[np.ndarray], b: int) -> list[np.ndarray]:
    """k words of b bits -> limbs; the first word is the highest."""
    k = len(words)
    limbs = [np.zeros(len(words[0]), np.uint64) for _ in range(-(-k * b // 64))]
    for i, x in enumerate(words):
        at, shift = divmod((k - 1 - i) * b, 64)
        limbs[at] |= x << np.uint64(shift)
        if shift + b > 64:
            limbs[at + 1] |= x >> np.uint64(64 - shift)
    return limbs


def unpacked(limbs: list[np.ndarray], k: int, b: int) -> list[np.ndarray]:
    out = []
    for i in range(k):
        at, shift = divmod((k - 1 - i) * b, 64)
        x = limbs[at] >> np.uint64(shift)
        if shift + b > 64:
            x = x | limbs[at + 1] << np.uint64(64 - shift)
        out.append(x & np.uint64((1 << b) - 1))
    return out


def top(limbs: list[np.ndarray], width: int, bits: int) -> np.ndarray:
    """The upper `bits` (62 at most) of numbers of `width` bits."""
    if not bits:
        return np.zeros(len(limbs[0]), np.int64)
    at, shift = divmod(width - bits, 64)
    x = limbs[at] >> np.uint64(shift)
    if shift and at + 1 < len(limbs):
        x = x | limbs[at + 1] << np.uint64(64 - shift)
    return (x & np.uint64((1 << bits) - 1)).astype(np.int64)


def counted(limbs: list[np.ndarray], counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct numbers with the sums of their counts (1 each, if not given). The stable sort merges runs that are sorted already."""
    n = len(limbs[0])
    if not n:
        return limbs, np.zeros(0, np.int64)
    if counts is None and len(limbs) == 1:
        ordered = [np.sort(limbs[0])]
    else:
        by = np.argsort(limbs[0], kind="stable") if len(limbs) == 1 else np.lexsort(limbs)
        ordered, counts = [x[by] for x in limbs], None if counts is None else counts[by]
    new = np.ones(n, bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in ordered])
    starts = np.flatnonzero(new)
    sums = np.diff(np.append(starts, n)) if counts is None else np.add.reduceat(counts, starts)
    return [x[starts] for x in ordered], sums


def encoded(limbs: list[np.ndarray], counts: np.ndarray, width: int) -> bytes:
    """One filter of sorted distinct numbers of `width` bits: bits of the quotients in use, bits of the ends of their runs, remainders, counters."""
    n = len(counts)
    size = max(0, -(-(width - n.bit_length() + 1) // 8))
    bits = max(0, width - 8 * size)
    quotient = top(limbs, width, bits)
    used = np.zeros(1 << bits, bool)
    used[quotient] = True
    ends = np.append(quotient[1:] != quotient[:-1], True)
    whole = np.stack([x.astype(">u8").view(np.uint8).reshape(n, 8) for x in limbs[::-1]], axis=1).reshape(n, -1)
    rest = whole[:, whole.shape[1] - size :].copy()
    small = np.minimum(counts - 1, 255).astype(np.uint8)
    large = (counts[small == 255]).astype("<i8")
    return struct.pack("<IBB", n, bits, size) + np.packbits(used).tobytes() + np.packbits(ends).tobytes() + rest.tobytes() + small.tobytes() + large.tobytes()


def decoded(data: bytes, limbs: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The numbers (as `limbs` limbs) and counts of a filter."""
    n, bits, size = struct.unpack_from("<IBB", data)
    at = 6
    flat = np.frombuffer(data, np.uint8)

    def take(count: int) -> np.ndarray:
        nonlocal at
        at += count
        return flat[at - count : at]

    used = np.flatnonzero(np.unpackbits(take(-(-(1 << bits) // 8)), count=1 << bits))
    ends = np.unpackbits(take(-(-n // 8)), count=n)
    rest = take(n * size).reshape(n, size)
    small = take(n)
    counts = small.astype(np.int64) + 1
    counts[small == 255] = np.frombuffer(data[at:], "<i8")
    quotient = used[np.cumsum(ends) - ends].astype(np.uint64)
    whole = np.zeros((n, 8 * limbs), np.uint8)
    whole[:, 8 * limbs - size :] = rest
    out = [whole[:, 8 * (limbs - 1 - i) : 8 * (limbs - i)].copy().view(">u8").reshape(n).astype(np.uint64) for i in range(limbs)]
    where, shift = divmod(8 * size, 64)
    if where < limbs:
        out[where] |= quotient << np.uint64(shift)
        if shift and where + 1 < limbs:
            out[where + 1] |= quotient >> np.uint64(64 - shift)
    return out, counts
