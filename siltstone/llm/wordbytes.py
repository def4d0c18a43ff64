"""Words of Arrow text columns as NumPy arrays, without a Python object per word.

A slice of a record batch is seen as one byte buffer. Separators are single bytes, so
UTF-8 sequences of other characters are always part of a word and never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    """A 256-entry mask of separator bytes from inclusive ranges."""
    mask = np.zeros(256, bool)
    for low, high in ranges:
        mask[low : high + 1] = True
    return mask


#: Space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = separators((0x20, 0x20), (0x09, 0x0D))
#: Every ASCII character but digits and lower-case letters (texts are lower-cased first).
NOT_ALNUM = separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_slices(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Consecutive row slices of about `most` text bytes; one longer text stays whole."""
    index = batch.schema.get_field_index(column)
    text = batch.column(index)
    if len(text) == 0:
        return
    lengths = np.diff(_offsets(text))
    start, held = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    yield batch.slice(start)


def _offsets(text: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type) else np.int32
    raw = np.frombuffer(text.buffers()[1], kind)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    if text.null_count:  # a null's bytes, if it has any, are not text
        full = np.diff(raw)
        full[~np.asarray(text.is_valid())] = 0
        if full.sum() != raw[-1] - raw[0]:
            text = pa.concat_arrays([text.fill_null("")])
            return _offsets(text)
    return raw


def buffer_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows together, and where each row starts (one more entry than rows)."""
    if text.null_count:
        text = text.fill_null("")
    offsets = _offsets(text)
    data = text.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


class Words:
    """starts, ends: byte positions; row: the row of each word; first: the first word of each row (one more entry)."""

    def __init__(self, text: pa.Array, blank: np.ndarray, lower: bool = False):
        raw, offsets = buffer_of(text)
        self.raw = LOWER[raw] if lower else raw
        n = len(raw)
        self.offsets = offsets
        inside = ~blank[self.raw]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.empty(n, bool)
        before[:1] = False
        before[1:] = inside[:-1]
        starts = inside & (~before | edge[:-1])
        after = np.empty(n, bool)
        after[-1:] = False
        after[:-1] = inside[1:]
        ends = inside & (~after | edge[1:])
        self.starts = np.flatnonzero(starts)
        self.ends = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes, the same wherever the word stands."""
        global _pow, _inv
        n = len(self.raw)
        if len(_pow) < n + 1:
            size = max(n + 1, 1 << 16)
            for name, factor in (("_pow", _P), ("_inv", _P_INV)):
                table = np.full(size, factor, np.uint64)
                table[0] = 1
                np.cumprod(table, out=table)
                globals()[name] = table
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((self.raw.astype(np.uint64) + np.uint64(1)) * _pow[:n], out=total[1:])
        out = mixed((total[self.ends] - total[self.starts]) * _inv[self.starts])
        if n > 1 << 24:  # tables of one very long text are not kept
            _pow, _inv = _pow[: 1 << 22].copy(), _inv[: 1 << 22].copy()
        return out

    def bytes_of(self, low: int, high: int) -> bytes:
        """Words low to high (exclusive), joined by one space."""
        raw, starts, ends = self.raw, self.starts, self.ends
        return b" ".join(raw[starts[i] : ends[i]].tobytes() for i in range(low, high))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def gram_hashes(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k words from each word on; the last k - 1 words start none."""
    n = len(word_hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * _P + word_hashes[j : j + n]
    return mixed(h)


def window_minima(values: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values."""
    n = len(values) - w + 1
    if n <= 0:
        return values[:0]
    low = values[:n].copy()
    for j in range(1, w):
        np.minimum(low, values[j : j + n], out=low)
    return low


def one_row_grams(words: Words, k: int) -> np.ndarray:
    """Whether the k words from each word on are all of one row."""
    n = len(words) - k + 1
    return words.row[:n] == words.row[k - 1 :] if n > 0 else np.zeros(0, bool)
