"""Hashed character n-grams of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_M = np.uint32(0x01000193)
_MIX = np.uint32(0x9E3779B1)
_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """For each code point, whether it is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def row_slices(texts: list[str | None], most: int = 1 << 20, most_rows: int = 512) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` characters; one longer text is alone in its range."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > start and (held + n > most or i - start >= most_rows):
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)


def codes(texts: list[str | None], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of all texts, `pad` zeros after each, and the row of each position."""
    gap = "\0" * pad
    lowered = [(t or "").lower() for t in texts]
    joined = gap.join(lowered) + gap
    found = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    rows = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + pad for t in lowered])
    return found, rows


def buckets(chars: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The bucket of the n characters from each position on (the last n - 1 start none)."""
    size = len(chars) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint32)
    h = np.full(size, n, np.uint32)
    for j in range(n):
        h = h * _M + chars[j : j + size]
    h ^= h >> np.uint32(15)
    return (h * _MIX) >> np.uint32(32 - bits)


def text_list(column: pa.Array) -> list[str | None]:
    return column.to_pylist()
