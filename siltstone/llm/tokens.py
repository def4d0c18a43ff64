"""Token ids of whole texts by a public word-level BPE vocabulary, with a per-worker word cache.

The vocabulary's own pre-tokeniser splits a text into runs of letters, single numbers and
runs of other signs, each encoded by itself. For texts of plain code points (below U+0250,
without apostrophes, controls or `<|`, which the vocabulary treats specially) that split is
made in NumPy, and each distinct word is encoded once by the library. All other texts are
encoded whole by the library. Both ways give the library's ids.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np

from siltstone.llm.chargrams import row_slices

_TOP = 0x250
_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point below U+0250: class, lower-case code point, and whether the NumPy split may see it."""
    kind, lower, plain = np.full(_TOP, _OTHER, np.uint8), np.arange(_TOP, dtype=np.uint32), np.ones(_TOP, bool)
    for i in range(_TOP):
        c = chr(i)
        category = unicodedata.category(c)
        kind[i] = _SPACE if c in " \t\n\r" else _LETTER if category[0] == "L" else _NUMBER if category[0] == "N" else _OTHER
        if len(c.lower()) == 1 and ord(c.lower()) < _TOP:
            lower[i] = ord(c.lower())
        else:
            plain[i] = False
        if (category[0] in "CZM" and c not in " \t\n\r") or c == "'" or unicodedata.normalize("NFC", c) != c:
            plain[i] = False
    return kind, lower, plain


_KIND, _LOWER, _PLAIN = _tables()
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def _powers(factor: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, factor, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


class Encoder:
    """Encodes lists of texts to concatenated ids and lengths; keeps at most `most_cached` words."""

    def __init__(self, path: str, most_cached: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most_cached = most_cached
        ends = [i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith("</w>")]
        self.ends_word = np.zeros(max(self.tokenizer.get_vocab_size(), max(ends) + 1), bool)
        self.ends_word[ends] = True
        self.pow = self.inv = np.ones(0, np.uint64)
        self._clear()

    def _clear(self) -> None:
        self.known: dict[int, int] = {}
        self.first = np.zeros(1 << 16, np.int64)
        self.size = np.zeros(1 << 16, np.int32)
        self.ids = np.zeros(1 << 18, np.uint32)
        self.used = 0

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Each text's ids as uint32."""
        out: list[np.ndarray] = []
        for low, high in row_slices(texts, 1 << 20, 4096):
            out += self._encode([t or "" for t in texts[low:high]])
        return out

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        chars = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len(t) for t in texts])
        starts = np.concatenate([[0], np.cumsum(lengths + 1)])[: len(texts)]
        bounded = np.minimum(chars, _TOP - 1)
        odd = (chars >= _TOP) | ~_PLAIN[bounded]
        hidden = np.zeros(len(texts), bool)
        if odd.any():
            hidden[np.searchsorted(starts, np.flatnonzero(odd), "right") - 1] = True
        hidden |= np.array([("<|" in t) for t in texts], bool)
        kind = _KIND[bounded]
        begins = kind != _SPACE
        begins[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
        first = np.flatnonzero(begins)
        stops = kind != _SPACE
        stops[:-1] &= (kind[1:] != kind[:-1]) | (kind[:-1] == _NUMBER)
        last = np.flatnonzero(stops) + 1
        row = np.searchsorted(starts, first, "right") - 1
        if hidden.any():
            seen = ~hidden[row]
            first, last, row = first[seen], last[seen], row[seen]
        lowered = _LOWER[bounded]
        words = self._words(lowered, first, last)
        size = self.size[words]
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.first[words], size)
        ids = self.ids[at]
        cuts = np.concatenate([[0], np.cumsum(np.bincount(row, size, len(texts)).astype(np.int64))])
        out = [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        for i in np.flatnonzero(hidden).tolist():
            out[i] = np.asarray(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.uint32)
        return out

    def _words(self, chars: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The cache's number of each word."""
        n = len(chars)
        if len(self.pow) < n:
            self.pow, self.inv = _powers(_P, max(n, 1 << 16)), _powers(_P_INV, max(n, 1 << 16))
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * self.pow[:n], out=total[1:])
        h = (total[last] - total[first]) * self.inv[first]
        h ^= h >> np.uint64(29)
        unique, at, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) + len(unique) > self.most_cached:
            self._clear()
        get = self.known.get
        numbers = np.array([get(x, -1) for x in unique.tolist()], np.int64)
        missing = np.flatnonzero(numbers < 0)
        for low in range(0, len(missing), 2000):
            part = missing[low : low + 2000]
            texts = [chars[first[i] : last[i]].tobytes().decode("utf-32-le", "surrogatepass") for i in at[part].tolist()]
            ids = np.asarray(self.tokenizer.encode(" ".join(texts), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            assert len(ends) == len(part) and (not len(ids) or ends[-1] == len(ids))
            numbers[part] = self._add(unique[part], ids, ends)
        return numbers[inverse]

    def _add(self, keys: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n, m = len(self.known), len(keys)
        if n + m > len(self.first):
            self.first, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.size))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        begins = np.concatenate([[0], ends[:-1]])
        self.first[n : n + m] = begins + self.used
        self.size[n : n + m] = ends - begins
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        numbers = np.arange(n, n + m)
        self.known.update(zip(keys.tolist(), numbers.tolist(), strict=True))
        return numbers


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file, made once."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
