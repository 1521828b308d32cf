"""Texts of an Arrow batch as NumPy arrays: bytes, word bounds and word hashes, without a Python object per word.

A word is a maximal run of `[^\\x20\\x09-\\x0D]`. Texts are handled in slices of SLICE_BYTES (or one longer text), so a
task's memory does not follow the size of an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 128_000
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE (or its inverse) to the powers 0..n-1, modulo 2^64."""
    name = "inverse" if inverse else "base"
    if name not in _powers or len(_powers[name]) < n:
        steps = np.full(max(n, 1 << 16), BASE_INVERSE if inverse else BASE, dtype=np.uint64)
        steps[0] = 1
        _powers[name] = np.multiply.accumulate(steps)
    return _powers[name][:n]


@dataclass
class Words:
    """Some texts, one after another. `text` is the text's number in the slice for each word; bounds are byte offsets."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    first: np.ndarray  # of each text, the number of its first word; one more entry at the end

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        total = byte_sums(self.data)
        return mix((total[self.end] - total[self.start]) * powers(len(self.data) + 1, True)[self.start]
                   + (self.end - self.start).astype(np.uint64))


def byte_sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums of byte * BASE^position: those of a range, divided by BASE^start, are a hash of its bytes."""
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data)), out=total[1:])
    return total


def words_of(data: np.ndarray, bounds: np.ndarray) -> Words:
    """data: the bytes of all texts; bounds: where each text begins, and the end."""
    solid = ~SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[1:-1] = solid[1:] & solid[:-1]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    edge[inner] = False  # a word never spans two texts
    start = np.flatnonzero(solid & ~edge[:-1])
    end = np.flatnonzero(solid & ~edge[1:]) + 1
    first = np.searchsorted(start, bounds)
    return Words(data, start, end, np.repeat(np.arange(len(bounds) - 1), np.diff(first)), first)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of a string column; a null is an empty text."""
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return whole[bounds[0]:bounds[-1]], bounds - bounds[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each batch cut where its texts reach `most` bytes: (rows, bytes, bounds)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        data, bounds = text_buffers(column)
        at = 0
        while at < len(column):
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, side="right")) - 1)
            yield batch.slice(at, to - at), data[bounds[at]:bounds[to]], bounds[at:to + 1] - bounds[at]
            at = to


def spaced(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of each text joined by one space, text after text without a gap: bytes, and each word's start and end in them."""
    kept = ~SPACE[words.data]
    gaps = words.start[1:][words.text[1:] == words.text[:-1]] - 1
    kept[gaps] = True
    data = words.data[kept]
    data[SPACE[data]] = 0x20
    size = words.end - words.start
    gap = np.zeros(len(size), dtype=np.int64)
    gap[1:] = words.text[1:] == words.text[:-1]
    end = np.cumsum(size + gap)
    return data, end - size, end


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive word hashes, whatever text they are in."""
    if len(hashes) < n:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * powers(len(hashes)), out=total[1:])
    return mix((total[n:] - total[:-n]) * powers(len(hashes) + 1, True)[:len(hashes) - n + 1])


def sums_by_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the values between consecutive entries of `first`."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), dtype=np.result_type(values.dtype, np.int64) if values.dtype.kind in "biu" else values.dtype)
    np.cumsum(values, axis=0, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
