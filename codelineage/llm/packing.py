"""Packing token sequences by best-fit decreasing.

Documents are encoded and given an end token. A document longer than the window is
cut into full windows; its tail and the short documents are packed, longest first,
each into the open window with the least room that still fits. A segment tree indexed by
remaining room finds it. Where gaps are left that no piece fits, the emptiest windows
are dissolved and their pieces are cut to fill gaps until the padding is small.

Pieces are dealt to groups by a hash of document and place, about ``GROUP_PIECES`` documents each,
so that memory is bounded and the number of groups follows the input. The result
does not depend on partitions. Null and empty texts become one end token. Equal rows
are packed as separate documents. An empty table gives no pieces.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelineage.llm.bpe import byte_letters
from codelineage.llm.common import slices

WINDOW = 1024
GROUP_PIECES = 4_000
PADDING = 0.005
# Fixed value: how a byte-level tokenizer parts a text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class RoomTree:
    """Numbers of open windows by remaining room; finds the least room that is at least a given size."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.windows: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, room: int, n: int) -> None:
        i = room + self.size
        while i:
            self.count[i] += n
            i >>= 1

    def put(self, room: int, window: int) -> None:
        if room:
            self.windows[room].append(window)
            self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, window) of the tightest open window, which is then no longer open."""
        count, i = self.count, need + self.size
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if count[2 * i] else 2 * i + 1
        room = i - self.size
        self._add(room, -1)
        return room, self.windows[room].pop()


def fit(lengths: list[int], window: int = WINDOW, padding: float = PADDING) -> list[tuple[int, int, int, int]]:
    """(piece, start in it, length, window) of every part; lengths must not rise and be at most ``window``."""
    tree = RoomTree(window)
    held: list[list[tuple[int, int, int]]] = []
    room: list[int] = []
    for piece, n in enumerate(lengths):
        found = tree.take(n)
        if found is None:
            held.append([])
            room.append(window)
            found = window, len(held) - 1
        at = found[1]
        held[at].append((piece, 0, n))
        room[at] -= n
        tree.put(room[at], at)
    gaps = sum(room)
    order = sorted(range(len(held)), key=lambda w: (room[w], w))
    low, high = 0, len(order) - 1
    while low < high and gaps > padding * window * (high + 1):
        parts, gaps = held[order[high]], gaps - room[order[high]]
        held[order[high]] = []
        while parts:
            while low < high and room[order[low]] == 0:
                low += 1
            if low == high:  # nothing is open any more: what is left keeps its window
                held[order[high]], room[order[high]] = parts, window - sum(p[2] for p in parts)
                gaps += room[order[high]]
                break
            to, (piece, start, n) = order[low], parts.pop()
            cut = min(n, room[to])
            held[to].append((piece, start, cut))
            room[to] -= cut
            gaps -= cut
            if cut < n:
                parts.append((piece, start + cut, n - cut))
        else:
            high -= 1
            continue
        break
    return [(piece, start, n, w) for w, parts in enumerate(p for p in held if p) for piece, start, n in parts]


@lru_cache(maxsize=2)
def encoder(path: str):
    """A byte-level BPE encoder from a tokenizer file: its tokens as bytes, its special tokens, its splitting pattern."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    value = {letter: b for b, letter in enumerate(byte_letters())}
    ranks = {bytes(value[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {token: i for token, i in ranks.items() if i not in special.values()}
    return tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)


def encode(path: str, text: str) -> np.ndarray:
    return encoder(path).encode_to_numpy(text, allowed_special="all")


PIECE = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("row_key", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)
PACKED = T.StructType([*PIECE, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])


def pieces(df: DataFrame, path: str, text: str = "text", key: str = "doc_id", end_id: int = 0, window: int = WINDOW) -> DataFrame:
    """Full windows and tails of every document: ids as little-endian 32-bit integers."""
    rows = df.select(
        F.col(key).cast("long").alias("doc_id"),
        F.xxhash64(F.col(text)).alias("row_key"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )

    def run(batches):
        for batch in slices(batches, "text", 1 << 20):
            out = {f.name: [] for f in PIECE}
            for doc, row, value in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row_key", "text"))):
                ids = np.append(encode(path, value), np.uint32(end_id)).astype("<u4")
                total = len(ids)
                for start in range(0, total, window):
                    part = ids[start : start + window]
                    for name, v in zip(out, (doc, row, start, len(part), total, part.tobytes())):
                        out[name].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([
                ("doc_id", pa.int64()), ("row_key", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary()),
            ]))

    return rows.mapInArrow(run, PIECE)


def pack(df: DataFrame, path: str, text: str = "text", key: str = "doc_id", end_id: int = 0, window: int = WINDOW, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Every part with its ids, its sequence and its offset there; full windows are sequences of their own."""
    groups = max(1, -(-df.count() // group_pieces))
    dealt = pieces(df, path, text, key, end_id, window).withColumn(
        "group", F.pmod(F.xxhash64("doc_id", "row_key", "start"), F.lit(groups)).cast("long")
    )

    def place(parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values(["length", "doc_id", "row_key", "start"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        placed = fit(parts["length"].tolist(), window)
        which, start, n, seq = (np.array(x, np.int64) for x in zip(*placed))
        out = parts.take(which).reset_index(drop=True)
        whole = (n == out["length"].to_numpy()).tolist()
        out["ids"] = [b if all_ else b[4 * s : 4 * (s + k)] for b, s, k, all_ in zip(out["ids"], start.tolist(), n.tolist(), whole)]
        out["start"] += start
        out["length"] = n
        first = np.r_[True, seq[1:] != seq[:-1]]
        before = np.cumsum(n) - n
        out["offset"] = before - np.repeat(before[first], np.diff(np.r_[np.flatnonzero(first), len(n)]))
        out["sequence_id"] = out["group"] * (1 << 32) + seq
        return out[[f.name for f in PACKED]]

    return dealt.groupBy("group").applyInPandas(place, PACKED)


def checksum(df: DataFrame, column: str = "ids") -> DataFrame:
    """Adds ``ids_crc32``, the unsigned CRC-32 of a binary column."""
    return df.withColumn("ids_crc32", F.crc32(column))
