"""64-bit hashes of all words and word runs of a batch of texts, in numpy.

A word's hash is a polynomial over its bytes modulo 2**64, taken from running sums, then
mixed. Two different words of a corpus agree with a chance of about 2**-64 a pair;
only words of over a thousand bytes built to collide could agree more often.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from codelineage.llm.common import BREAKS

BASE = 0x9E3779B97F4A7C15 | 1
BLOCK = 1 << 19
U = np.uint64


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit; the seed chooses one of many."""
    with np.errstate(over="ignore"):
        x = (x ^ U(seed * 0xD1342543DE82EF95 & (2**64 - 1))) + U(0x9E3779B97F4A7C15)
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


@lru_cache(maxsize=8)
def _letters(lower: bool, alike: tuple[str, str] = ("", "")) -> np.ndarray:
    """A number per byte; with ``alike``, bytes of the first string count as those of the second."""
    values = mix(np.arange(1, 257, dtype=U), 7)
    if lower:
        values[65:91] = values[97:123]
    for x, y in zip(*alike):
        values[ord(x)] = values[ord(y)]
    return values


_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; grown when a longer run of bytes comes."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, BLOCK + 4096)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 2**64))):
            factors = np.full(size, U(base))
            factors[0] = U(1)
            _powers[name] = np.multiply.accumulate(factors)
    return _powers["up"], _powers["down"]


@lru_cache(maxsize=4)
def _inside(extra: str) -> np.ndarray:
    inside = np.ones(256, bool)
    inside[[ord(c) for c in BREAKS + extra]] = False
    return inside


def find_words(raw: np.ndarray, borders: np.ndarray, extra: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the number of words before each text (n + 1 values)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(borders), np.int64)
    inside = _inside(extra)[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[borders] = True
    before = np.r_[False, inside[:-1]] & ~cut[:-1]
    after = np.r_[inside[1:], False] & ~cut[1:]
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, borders)


def hash_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, alike: tuple[str, str] = ("", "")) -> np.ndarray:
    """A 64-bit hash of the bytes of each word; starts and ends must rise."""
    out = np.zeros(len(starts), U)
    letters, first = _letters(lower, alike), 0
    while first < len(starts):
        base = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, base + BLOCK, side="right")))
        block = raw[base : ends[last - 1]]
        up, down = _power(len(block))
        sums = np.zeros(len(block) + 1, U)
        np.cumsum(letters[block] * up[: len(block)], out=sums[1:])
        a, b = starts[first:last] - base, ends[first:last] - base
        out[first:last] = (sums[b] - sums[a]) * down[a] + (b - a).astype(U)
        first = last
    return mix(out)


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k words in a row (over text borders too; callers leave those out)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    total = hashes[:n].copy()
    for j in range(1, k):
        total = total * U(0xA0761D6478BD642F) + hashes[j : n + j]
    return mix(total, k)
