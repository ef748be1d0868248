"""Words and word-window hashes of Arrow text batches, vectorised with numpy.

A word is a maximal run of bytes other than space and 0x09-0x0D. Every function
takes whole texts; null texts have no words. Hashes are 64-bit.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD1B54A32D192ED03)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise: spread every input bit over the whole 64-bit hash."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


@dataclass
class Words:
    """Words of the documents of one batch; ``bounds[d]:bounds[d + 1]`` are those of document ``d``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    offsets: np.ndarray

    def hashes(self) -> np.ndarray:
        """One 64-bit hash per word."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        lens = self.ends - self.starts
        within = np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(np.cumsum(lens) - lens, lens)
        at = np.repeat(self.starts, lens) + within
        powers = np.full(int(lens.max()), _P)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        value = (self.data[at].astype(np.uint64) + np.uint64(1)) * powers[within]
        return mix(np.add.reduceat(value, np.cumsum(lens) - lens))


def blocks(batch: pa.RecordBatch, text: str = "text", most: int = 2 << 20, at: Sequence[str] | None = None) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``most`` bytes of text (one document at least).

    ``at`` is the path of the text where it is a field of a struct.
    """
    at = at or [text]
    col = batch.column(batch.schema.get_field_index(at[0]))
    for name in at[1:]:
        col = col.field(name)
    size = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(size)
    low = 0
    while low < len(size):
        before = total[low - 1] if low else 0
        end = max(low + 1, int(np.searchsorted(total, before + most, side="right")))
        yield batch.slice(low, end - low)
        low = end


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the document offsets into them."""
    if col.null_count:
        col = pc.fill_null(col, "")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    if data is None or not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def words_of(col: pa.Array, lower: bool = False) -> Words:
    """Find the words of every text of ``col``; ``lower`` turns A-Z into a-z first."""
    data, offsets = text_bytes(col)
    if lower:
        data = LOWER[data]
    n = len(data)
    word = ~SPACE[data]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    first = word.copy()
    first[1:] &= ~word[:-1]
    first[edge] |= word[edge]
    last = word.copy()
    last[:-1] &= ~word[1:]
    last[edge - 1] |= word[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets), offsets)


def windows(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``k`` words inside one document: (hash, position of its first word)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * _Q + hashes[j : j + n]
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    return mix(h[at]), at
