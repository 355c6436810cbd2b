"""Encode texts chunk by chunk, each different chunk once.

A chunk is what lies between single spaces. Both tokenizers split a text before a space that stands between two other
characters, whatever surrounds it, so ids of chunks (with the space before them) put together are the ids of the text. A text
with other arrangements of white space around a space is encoded as a whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from hearthspan.llm.common import ragged, strings

SLICE = 4 << 20

# White space as str.isspace() has it; a chunk that is empty, begins or ends with it, or as a text's first ends with it, depends on what is beside it.
_SPACE = r"[\pZ\t-\r\x1c-\x1f\x{85}]"
ODD_INSIDE = rf"\A\z|\A{_SPACE}|{_SPACE}\z"
ODD_FIRST = rf"{_SPACE}\z"


class Growing:
    """An array that grows by doubling."""

    def __init__(self, kind):
        self.data, self.size = np.zeros(1024, kind), 0

    def extend(self, values: np.ndarray) -> None:
        need = self.size + len(values)
        if need > len(self.data):
            self.data = np.concatenate([self.data[: self.size], np.zeros(max(need, 2 * len(self.data)) - self.size, self.data.dtype)])
        self.data[self.size : need] = values
        self.size = need


class Chunks:
    """Ids of the chunks seen so far. encode: list of texts, whether each begins with its only space -> (all ids, ids of each). Beyond `most` chunks it forgets those that few slices held, which only costs time."""

    def __init__(self, encode: Callable[[list[str], bool], tuple[np.ndarray, np.ndarray]], most: int = 400_000):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.ids, self.starts, self.lengths, self.odd, self.uses = Growing(np.int32), Growing(np.int64), Growing(np.int32), Growing(np.bool_), Growing(np.int32)

    def prune(self) -> None:
        uses, least = self.uses.data[: self.uses.size], 2
        while (uses >= least).sum() > self.most // 2:
            least += 1
        keep = np.flatnonzero(uses >= least)
        names = list(self.index)
        names = [names[i] for i in keep]
        lengths, odd, uses = self.lengths.data[keep].astype(np.int64), self.odd.data[keep], uses[keep] // 2
        ids = self.ids.data[ragged(self.starts.data[keep], lengths)]
        self.clear()
        self.index.update(zip(names, range(len(names))))
        for x, v in ((self.ids, ids), (self.starts, np.cumsum(lengths) - lengths), (self.lengths, lengths), (self.odd, odd), (self.uses, uses)):
            x.extend(v)

    def add(self, chunks: list[str], odd: np.ndarray, spaced: bool) -> None:
        ids, lengths = self.encode([chunks[i] for i in np.flatnonzero(~odd)] if odd.any() else chunks, spaced)
        all_lengths = np.zeros(len(chunks), np.int64)
        all_lengths[~odd] = lengths
        self.index.update(zip(chunks, range(len(self.index), len(self.index) + len(chunks))))
        self.starts.extend(self.ids.size + np.cumsum(all_lengths) - all_lengths)
        self.lengths.extend(all_lengths)
        self.odd.extend(odd)
        self.uses.extend(np.zeros(len(chunks), np.int32))
        self.ids.extend(ids)

    def look_up(self, chunks: list[str], odd: pa.Array, spaced: bool) -> np.ndarray:
        """Where each of some different chunks is held; odd: which of them may not be encoded alone; spaced: all begin with their only space."""
        found = np.fromiter(map(self.index.get, chunks, repeat(-1)), np.int64, len(chunks))
        new = np.flatnonzero(found < 0)
        if len(new):
            found[new] = len(self.index) + np.arange(len(new))
            self.add([chunks[i] for i in new.tolist()], odd.take(pa.array(new)).to_numpy(zero_copy_only=False), spaced)
        return found

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids of each text)."""
        if len(self.index) > self.most:
            self.prune()
        parts = pc.split_pattern(column.fill_null(""), " ")
        offsets = parts.offsets.to_numpy().astype(np.int64)
        values = parts.values.slice(offsets[0], offsets[-1] - offsets[0])
        offsets = offsets - offsets[0]
        coded = values.dictionary_encode()
        names = coded.dictionary
        spaced = self.look_up(pc.binary_join_element_wise("", names, " ").to_pylist(), pc.match_substring_regex(names, ODD_INSIDE), True)
        self.uses.data[spaced] += 1
        at = spaced[coded.indices.to_numpy()]
        opening = values.take(pa.array(offsets[:-1])).dictionary_encode()
        first = self.look_up(opening.dictionary.to_pylist(), pc.match_substring_regex(opening.dictionary, ODD_FIRST), False)
        at[offsets[:-1]] = first[opening.indices.to_numpy()]
        lengths = self.lengths.data[at].astype(np.int64)
        ids = self.ids.data[ragged(self.starts.data[at], lengths)]
        sums = np.concatenate([[0], np.cumsum(lengths)])[offsets]
        odd = np.add.reduceat(self.odd.data[at].astype(np.int64), offsets[:-1]) > 0 if len(column) else np.zeros(0, bool)
        counts = np.diff(sums)
        if odd.any():
            whole, whole_counts = self.encode(column.filter(pa.array(odd)).to_pylist(), False)
            pieces = np.split(ids, sums[1:-1])
            for i, x in zip(np.flatnonzero(odd), np.split(whole, np.cumsum(whole_counts)[:-1])):
                pieces[i], counts[i] = x, len(x)
            ids = np.concatenate(pieces)
        return ids, counts


def slices(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """[from, to) of runs of rows with about `size` bytes, one row at least."""
    _, offsets = strings(column)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, len(column))
        i = j
