"""Hashes of words and substrings, computed for a batch of texts at once with numpy."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(29))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


_VALUE = mix(np.arange(1, 257, dtype=np.uint64))  # the value of each byte


def _power(way: str, n: int) -> np.ndarray:
    if len(_powers[way]) < n:
        step = np.full(max(n, (1 << 20) + 4096), _BASE if way == "up" else pow(_BASE, -1, 1 << 64), np.uint64)
        step[0] = 1
        _powers[way] = np.multiply.accumulate(step)
    return _powers[way][:n]


class Hashes:
    """64-bit polynomial hash of any substring of ``data`` (bytes as uint8) in constant time."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUE[data] * _power("up", len(data)), out=self.sums[1:])
        self.back = _power("down", len(data) + 1)

    def __call__(self, start: np.ndarray, length) -> np.ndarray:
        return mix((self.sums[start + length] - self.sums[start]) * self.back[start] + np.asarray(length).astype(np.uint64))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """Per text the hashes of its words, A-Z lower-cased. A word is a run of bytes other than space and 0x09-0x0D."""
    if not texts:
        return []
    data = np.frombuffer(b" ".join(texts).lower() + b" ", np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    hashes = Hashes(data)(start, end - start)
    ends = np.cumsum([len(t) + 1 for t in texts])
    cut = np.searchsorted(start, ends[:-1])
    return np.split(hashes, cut)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``size`` words; of the whole sequence if it is shorter."""
    n = min(size, len(words))
    if not n:
        return words
    total = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        total = mix(total + words[i:len(words) - n + 1 + i]) * _U(2 * i + 3)
    return np.unique(mix(total + _U(n)))
