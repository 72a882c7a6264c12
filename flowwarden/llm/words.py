"""Words and 64-bit hashes of word sequences, whole Arrow batches at a time.

A word is a run of bytes other than space and the five control characters next to tab.  Hashes are sums of byte (or
word) codes times powers of an odd constant modulo 2**64, so that prefix sums give the hash of any span; every hash is
then scrambled.  They depend on the words alone, not on the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Odd 64-bit multipliers and the scrambling constants of a well-known 64-bit finaliser.
BYTE_BASE, WORD_BASE, OTHER_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
MIX_1, MIX_2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB

#: Text bytes that are turned into words at once; a longer text forms a slice of its own.
SLICE_BYTES = 2 << 20

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_2)
    return x ^ (x >> np.uint64(31))


_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BYTE_BASE))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 .. n of ``base`` and of its inverse modulo 2**64."""
    if base not in _powers or len(_powers[base][0]) <= n:
        size = max(n + 1, 1 << 16)

        def run(b: int) -> np.ndarray:
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            return np.multiply.accumulate(steps)

        _powers[base] = run(base), run(pow(base, -1, 1 << 64))
    return _powers[base]


def spans(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Scrambled hashes of ``values[start:end]``."""
    up, down = powers(base, len(values))
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:len(values)], out=total[1:])
    return mix((total[end] - total[start]) * down[start])


def word_bounds(data: np.ndarray, doc_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-end byte of every word; a word ends where a text ends."""
    inside = ~_SEPARATOR[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cut = doc_start[doc_start < len(data)]
    begins[cut] = inside[cut]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cut = doc_start[doc_start > 0] - 1
    ends[cut] = inside[cut]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


class Texts:
    """A slice of a batch: the words of some rows, as hashes in order, and where each row's words are."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool):
        data = _LOWER[data] if lower else data
        start, end = word_bounds(data, offsets[:-1]) if len(data) else (np.empty(0, np.int64),) * 2
        self.hashes = np.empty(len(start), np.uint64)
        step = 1 << 20  # words are hashed in pieces of about a million bytes, for long texts
        low = 0
        while low < len(start):
            high = max(low + 1, int(np.searchsorted(start, start[low] + step)))
            piece = _BYTE_CODE[data[start[low]:end[high - 1]]]
            self.hashes[low:high] = spans(piece, start[low:high] - start[low], end[low:high] - start[low], BYTE_BASE)
            low = high
        self.hashes = mix(self.hashes + (end - start).astype(np.uint64) * np.uint64(BYTE_BASE))
        self.row_start = np.searchsorted(start, offsets).astype(np.int64)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.row_start))

    def windows(self, n: int) -> np.ndarray:
        """Starts of all runs of n words that lie in one row."""
        if len(self.hashes) < n:
            return np.empty(0, np.int64)
        return np.flatnonzero(self.row[:len(self.row) - n + 1] == self.row[n - 1:])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offset of each row, nulls being empty."""
    column = column.cast(pa.large_binary())
    column = column.fill_null(b"") if column.null_count else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], most: int = SLICE_BYTES, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows of about ``most`` text bytes."""
    for batch in batches:
        offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))[1]
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, "right")) - 1)
            yield batch.slice(low, high - low)
            low = high


def texts(batch: pa.RecordBatch, lower: bool = False, text: str = "text") -> Texts:
    return Texts(*text_bytes(batch.column(batch.schema.get_field_index(text))), lower)
