"""The index against plain searches: compressed ranks, intervals and streamed statistics."""

import numpy as np
import pytest

from siltstone.llm.fmindex import Bits, FmIndex


@pytest.mark.parametrize("share", [0.0, 0.001, 0.5, 0.999, 1.0])
def test_compressed_ranks(share):
    rng = np.random.default_rng(3)
    for n in (1, 63, 64, 65, 511, 512, 513, 5000):
        bits = rng.random(n) < share
        if n == 5000:
            bits[1000:3000], bits[3000:4500] = True, False
        i = np.arange(n + 1)
        assert (Bits(bits).ones(i) == np.concatenate([[0], np.cumsum(bits)])).all()


@pytest.mark.parametrize("depth", [2, 3, 4, 5, 20])
@pytest.mark.parametrize("symbols", [2, 5, 300])
def test_streamed_intervals(depth, symbols):
    """Each window's interval has the rows of all its places, for texts of the index and for others."""
    rng = np.random.default_rng(depth * 1000 + symbols)
    units = []
    for _ in range(40):
        own = rng.integers(1, symbols, rng.integers(depth, 3 * depth + 1))
        units += [own, own[rng.integers(0, len(own) - depth + 1) :], np.resize(own[:2], depth + 3)]
    line = np.concatenate([np.append(u, 0) for u in units])
    at = np.cumsum([len(u) + 1 for u in units]) - np.array([len(u) + 1 for u in units])
    many = np.array([len(u) - depth + 1 for u in units])
    index = FmIndex(line, symbols, depth)
    places = {}
    for a, m in zip(at, many):
        for p in range(a, a + m):
            places.setdefault(tuple(line[p : p + depth]), set()).add(p)
    low, high = index.stream(line, at, many)
    starts = np.concatenate([np.arange(a, a + m) for a, m in zip(at, many)])
    for p, a, b in zip(starts, low, high):
        assert set(index.suffixes[a:b].tolist()) == places[tuple(line[p : p + depth])]
    other = rng.integers(1, symbols, 6 * depth)
    other[: len(units[0])] = units[0][: len(other)]
    low, high = index.stream(other, np.array([0]), np.array([len(other) - depth + 1]))
    for p, (a, b) in enumerate(zip(low, high)):
        assert set(index.suffixes[a:b].tolist()) == places.get(tuple(other[p : p + depth]), set())
