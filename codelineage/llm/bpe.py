"""Byte-pair encoding and decoding by vocabulary file.

A word is merged with a segment tree over the ranks of its adjacent pairs: the root
holds the leftmost pair of the lowest rank, a merge updates two or three leaves, and the
word is done when no pair is left that the vocabulary merges. Words are cached in two
generations with a bound on their number, so that a common word is merged once.

Null and empty texts give no tokens and an empty decoded text. Equal rows are encoded
alike. A text of any length is encoded whole; a word of n characters takes
O(n log n). An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from codelineage.llm.common import list_array, map_added

CACHED_WORDS = 300_000
NONE = 1 << 60
RARE = re.compile("[^\x00-\u052f]")


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: printable Latin-1 keeps its place, the rest follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class MergeTree:
    """Lowest (rank, place) of all adjacent pairs, by a segment tree with one leaf per symbol."""

    def __init__(self, keys: list[int]):
        self.size = 1 << max(0, len(keys) - 1).bit_length()
        self.node = [NONE] * self.size + keys + [NONE] * (self.size - len(keys))
        for i in range(self.size - 1, 0, -1):
            self.node[i] = min(self.node[2 * i], self.node[2 * i + 1])

    def root(self) -> int:
        return self.node[1]

    def update(self, place: int, key: int) -> None:
        node, i = self.node, place + self.size
        node[i] = key
        while i > 1:
            i >>= 1
            low = min(node[2 * i], node[2 * i + 1])
            if node[i] == low:
                return
            node[i] = low


class WordCache(dict):
    """Ids by word; when full, the words become the older half and those met again move back."""

    def __init__(self, merge, limit: int = CACHED_WORDS):
        self.merge, self.limit, self.older = merge, limit, {}

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            found = self.merge(word)
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[word] = found
        return found


class Vocabulary:
    """Merges, ids and special tokens of a tokenizer file of the word-end kind."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(self.ids[a], self.ids[b]): (i, self.ids[a + b]) for i, (a, b) in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.path = path
        steps = spec["pre_tokenizer"]["pretokenizers"]
        self.words = regex.compile(next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split"))
        tokens = [""] * (1 + max([*self.ids.values(), *self.special.values()]))
        for token, i in [*self.ids.items(), *self.special.items()]:
            tokens[i] = token
        self.tokens = tokens
        self.letters = byte_letters()
        self.cache = WordCache(self.word)
        self.library = None

    def merge(self, symbols: list[int]) -> list[int]:
        """The symbols after all merges, lowest rank first and leftmost first among equals."""
        rank, n = self.rank, len(symbols)
        if n < 2:
            return symbols
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        key = lambda i: rank[pair][0] * n + i if after[i] < n and (pair := (symbols[i], symbols[after[i]])) in rank else NONE
        tree = MergeTree([key(i) for i in range(n)])
        while (low := tree.root()) < NONE:
            i = low % n
            j = after[i]
            symbols[i] = rank[symbols[i], symbols[j]][1]
            symbols[j] = -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            tree.update(j, NONE)
            tree.update(i, key(i))
            if before[i] >= 0:
                tree.update(before[i], key(before[i]))
        return [s for s in symbols if s >= 0]

    def word(self, text: str) -> bytes:
        """Ids of one word as little-endian 32-bit integers; letters outside the vocabulary vanish."""
        letters = [self.letters[b] for b in text.encode("utf-8", "surrogatepass")]
        letters[-1] += self.suffix
        return np.array(self.merge([self.ids[x] for x in letters if x in self.ids]), "<i4").tobytes()

    def split(self, text: str) -> list[str]:
        """Words of a text: composed, lower case, parted by the file's pattern.

        Beyond the Latin, Greek and Cyrillic blocks, what counts as a letter depends on
        the Unicode version, so there the library itself normalizes and parts the text.
        """
        if not RARE.search(text):
            return self.words.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.bytes = {letter: b for b, letter in enumerate(self.letters)}
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(self.bytes[c] for c in piece).decode() for piece, _ in pieces]

    def encode(self, text: str) -> np.ndarray:
        parts = self.special_pattern.split(text) if self.special_pattern else [text]
        out, cache = [], self.cache
        for part in parts:
            if part in self.special:
                out.append(np.array([self.special[part]], "<i4").tobytes())
            elif part:
                out.extend([cache[w] for w in self.split(part)])
        return np.frombuffer(b"".join(out), "<i4")

    def decode(self, ids: np.ndarray) -> str:
        """Tokens joined by a space, as the file names no decoder; special tokens stay."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids.tolist()])


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Adds ``token_ids`` and ``decoded``; ``path`` must be readable on every executor."""

    def work(batch: pa.RecordBatch) -> list:
        vocab = vocabulary(path)
        ids = [vocab.encode(t or "") for t in batch.column(text).to_pylist()]
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        return [list_array(flat, [len(x) for x in ids], pa.int32()), pa.array([vocab.decode(x) for x in ids], pa.string())]

    added = T.StructType([T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return map_added(df, text, added, work, limit=1 << 20)
