"""Edit distances of many pairs of texts at once.

Columns of the distance table are kept as bits (Myers, Hyyrö), 64 rows to a word, and one numpy step
moves every pair of a piece by one character. A pair is left as soon as its limit is out of reach.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

PIECE = 512  # pairs that move together
TABLE_WORDS = 4_000_000  # words of the character tables of a piece
LOOK = 32  # characters between two looks for pairs that are done


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and where each begins."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return flat, np.concatenate(([0], np.cumsum([len(x) for x in texts])))


def _long_distance(x: str, y: str, limit: int) -> int:
    """One pair whose character table is too large for a piece: the bits of a column are one integer."""
    table: dict[str, int] = {}
    for i, c in enumerate(x):
        table[c] = table.get(c, 0) | 1 << i
    full, top, score = (1 << len(x)) - 1, 1 << len(x) - 1, len(x)
    up, down = full, 0
    for j, c in enumerate(y):
        eq = table.get(c, 0)
        v = eq | down
        h = (((eq & up) + up) ^ up) | eq
        plus, minus = (down | ~(h | up)) & full, up & h
        score += bool(plus & top) - bool(minus & top)
        if score - (len(y) - 1 - j) > limit:
            return -1
        plus, minus = (plus << 1 | 1) & full, minus << 1 & full
        up, down = (minus | ~(v | plus)) & full, plus & v
    return score


def _piece(xs: list[str], ys: list[str], limits: np.ndarray) -> np.ndarray:
    """Distances of pairs, ``xs`` the shorter ones and none empty; -1 over the limit."""
    (a, a_at), (b, b_at) = _codes(xs), _codes(ys)
    m, n = np.diff(a_at), np.diff(b_at)
    letters = np.unique(a)
    pairs, width, size = len(xs), int(-(-m.max() // 64)), len(letters) + 1
    if pairs * width * size > TABLE_WORDS:
        if pairs == 1:
            return np.array([_long_distance(xs[0], ys[0], int(limits[0]))])
        half = pairs // 2
        return np.concatenate((_piece(xs[:half], ys[:half], limits[:half]), _piece(xs[half:], ys[half:], limits[half:])))
    owner = np.repeat(np.arange(pairs), m)
    place = np.arange(len(a)) - np.repeat(a_at[:-1], m)
    table = np.zeros((width, pairs * size), dtype=np.uint64)
    # Bits of a word are all different, so adding them is the same as joining them.
    np.add.at(table, (place // 64, owner * size + np.searchsorted(letters, a)), np.uint64(1) << (place % 64).astype(np.uint64))
    found = np.minimum(np.searchsorted(letters, b), size - 2)
    said = np.full((pairs, int(n.max())), size - 1, dtype=np.int64)  # the last row of a table is empty
    said[np.repeat(np.arange(pairs), n), np.arange(len(b)) - np.repeat(b_at[:-1], n)] = np.where(letters[found] == b, found, size - 1)
    said = np.ascontiguousarray((said + np.arange(pairs)[:, None] * size).T)

    out = np.full(pairs, -1, dtype=np.int64)
    open_ = np.arange(pairs)
    score, word, bit = m.copy(), (m - 1) // 64, ((m - 1) % 64).astype(np.uint64)
    up, down = np.full((width, pairs), ~np.uint64(0)), np.zeros((width, pairs), dtype=np.uint64)
    one, top, row = np.uint64(1), np.uint64(63), np.arange(pairs)
    reach = 0  # words in use
    for j in range(len(said)):
        if reach < width and j + 1 + limits.max() >= 64 * reach:
            # Rows that no pair within its limit has reached still are one more than the row before, each.
            reach = min(width, int(j + 1 + limits.max()) // 64 + 1)
            at, shift = np.minimum(word, reach - 1), np.where(word < reach, bit, top)
        now, was = up[:reach], down[:reach]
        eq = table[:reach].take(said[j] if len(open_) == pairs else said[j, open_], axis=1)
        v = eq | was
        h = eq & now
        total = h + now
        carry = total < h
        if reach > 1:
            total[1:] += carry[:-1]
            w, p = np.nonzero(carry[:-1] & (total[1:] == 0))
            w = w + 2
            while len(w):
                w, p = w[w < reach], p[w < reach]
                total[w, p] += one
                over = total[w, p] == 0
                w, p = w[over] + 1, p[over]
        h = (total ^ now) | eq
        plus, minus = was | ~(h | now), now & h
        step = ((plus[at, row] >> shift) & one).astype(np.int64) - ((minus[at, row] >> shift) & one).astype(np.int64)
        score += step * (n > j)
        over_plus, over_minus = plus[:-1] >> top, minus[:-1] >> top
        plus, minus = plus << one, minus << one
        plus[0] |= one
        plus[1:] |= over_plus
        minus[1:] |= over_minus
        up[:reach], down[:reach] = minus | ~(v | plus), plus & v
        if j % LOOK == LOOK - 1 or j == len(said) - 1:
            left = np.maximum(n - 1 - j, 0)
            over = score - left > limits
            ended = (left == 0) & ~over
            out[open_[ended]] = score[ended]
            keep = ~over & (left > 0)
            if not keep.any():
                break
            if not keep.all():
                open_, score, word, bit, at, shift, n, limits, up, down = (c[..., keep] for c in (open_, score, word, bit, at, shift, n, limits, up, down))
                row = np.arange(len(open_))
    return out


def distances(xs: list, ys: list, limits: list) -> list:
    """Edit distance of each pair in code points, -1 where it is over the limit, none where something is missing."""
    out: list = [None] * len(xs)
    asked = []
    for i, (x, y, limit) in enumerate(zip(xs, ys, limits)):
        if x is None or y is None or limit is None:
            continue
        x, y = (x, y) if len(x) <= len(y) else (y, x)
        if len(y) - len(x) > limit:
            out[i] = -1
        elif x == y or not x:
            out[i] = len(y) - len(x)
        else:
            asked.append((len(x), len(y), i, x, y, limit))
    asked.sort(key=lambda p: p[:3])
    for at in range(0, len(asked), PIECE):
        part = asked[at : at + PIECE]
        found = _piece([p[3] for p in part], [p[4] for p in part], np.array([p[5] for p in part], dtype=np.int64))
        for p, d in zip(part, found.tolist()):
            out[p[2]] = d
    return out


def edit_distance(x: Column, y: Column, limit: Column) -> Column:
    """Edit distance of two text columns up to a limit; -1 above it, null where one of them is null."""

    def batch(xs: pa.Array, ys: pa.Array, limits: pa.Array) -> pa.Array:
        return pa.array(distances(xs.to_pylist(), ys.to_pylist(), limits.to_pylist()), pa.int32())

    return F.arrow_udf(batch, "int").asNondeterministic()(x, y, limit)
