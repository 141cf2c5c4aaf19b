"""Exact ranked search of many items over all documents with K2-treaps.

Documents are read once into rows of (document, number of terms, items' terms in it, their
counts). A shard of these rows becomes a K2-treap: a quadtree over the grid of terms and
documents whose non-empty cells keep the largest impact below them, stored level by level
as four child bits a cell, child positions following from the bits' running count. An item
descends with the row paths of all its terms at once, document range by document
range, the range with the highest sum of cell maxima first; ranges that cannot reach the
k-th score found so far are dropped. A sixteenth of the documents (by hash of the id) is
searched first, its k-th scores bound the search of the rest.

Scores are those of ``Scoring``, in 64-bit whole numbers. Null and empty texts have no terms; documents
without terms do not count. Repeated rows are documents of their own. Equal scores go by ascending id, null ids
last. Every row of the items is answered on its own, items without terms or hits give no
rows. Very long texts are one row in memory; a shard holds at most ``SHARD_DOCS`` documents, cut earlier at ``SHARD_POSTINGS``
entries. Items are taken in blocks of ``BLOCK_ITEMS``, so the driver and the tasks hold the terms
of one block. Empty tables give no rows. Only the named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelineage.llm.common import BREAKS, list_array, slices, text_bytes
from codelineage.llm.words import find_words, hash_words
from codelineage.session import checkpointed, scratch_path

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
APART = "".join(chr(c) for c in range(128) if not chr(c).isalnum() and chr(c) not in BREAKS)
SHARD_DOCS = 8_192
SHARD_POSTINGS = 1 << 21
BLOCK_ITEMS = 2_048
STEP_CELLS = 1 << 16
FIRST_SHARE = 16
POPCOUNT = np.array([bin(x).count("1") for x in range(16)], np.int64)

ROW = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_terms", T.LongType()),
    T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.IntegerType())),
])
HIT = T.StructType([
    T.StructField("item", T.IntegerType()), T.StructField("item_id", T.LongType()),
    T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType()),
])


def terms_of(text: str | None) -> list[str]:
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


class Vocabulary:
    """The terms of a block of items, found in texts by hash and compared byte by byte."""

    def __init__(self, terms: list[str]):
        raw = [t.encode() for t in terms]
        self.size = len(raw)
        data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
        ends = np.cumsum([len(r) + 1 for r in raw], dtype=np.int64) - 1
        starts = ends - np.array([len(r) for r in raw], np.int64)
        hashes = hash_words(data, starts, ends)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.numbers = hashes[order], order
        self.data, self.starts, self.lengths = data, starts, ends - starts

    def find(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each word's term, -1 for other words."""
        out = np.full(len(starts), -1, np.int64)
        if not len(starts) or not self.size:
            return out
        hashes = hash_words(raw, starts, ends, lower=True)
        first = np.searchsorted(self.hashes, hashes)
        # terms of equal hash stand side by side; usually there is one
        for step in range(int(np.bincount(np.unique(self.hashes, return_inverse=True)[1]).max())):
            at = first + step
            maybe = np.flatnonzero((at < self.size) & (out < 0))
            maybe = maybe[self.hashes[at[maybe]] == hashes[maybe]]
            number = self.numbers[at[maybe]]
            same = ends[maybe] - starts[maybe] == self.lengths[number]
            maybe, number = maybe[same], number[same]
            if not len(maybe):
                continue
            n = self.lengths[number]
            owner = np.repeat(np.arange(len(n)), n)
            inside = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            said = raw[starts[maybe][owner] + inside]
            said = np.where((said >= 65) & (said <= 90), said + 32, said)
            wrong = np.bincount(owner[said != self.data[self.starts[number][owner] + inside]], minlength=len(n)) > 0
            out[maybe[~wrong]] = number[~wrong]
        return out


def rows_of(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents with at least one term: their number of terms, and the vocabulary's terms with counts."""
    size = max(1, vocabulary.size)

    def run(batches):
        for batch in slices(batches, "text"):
            raw, borders = text_bytes(batch.column("text"))
            starts, ends, before = find_words(raw, borders, APART)
            number = vocabulary.find(raw, starts, ends)
            hit = np.flatnonzero(number >= 0)
            doc = np.searchsorted(before, hit, side="right") - 1
            pair, count = np.unique(doc * size + number[hit], return_counts=True)
            per_doc = np.bincount(pair // size, minlength=batch.num_rows)
            n = np.diff(before)
            out = pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), list_array(pair % size, per_doc, pa.int32()), list_array(count, per_doc, pa.int32())],
                names=ROW.names,
            )
            yield out.filter(pa.array(n > 0))

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, ROW)


@dataclass(frozen=True)
class Scoring:
    """Weights and length norms of a collection; ``weights`` by term number."""

    documents: int
    length: int
    weights: np.ndarray

    def impacts(self, terms: np.ndarray, counts: np.ndarray, n_terms: np.ndarray) -> np.ndarray:
        m = 100 - 25 + (25 * n_terms * self.documents) // self.length
        return self.weights[terms] * ((1_000_000_000 * counts) // (1000 * counts + 12 * m))


def scoring_of(rows: DataFrame, size: int) -> Scoring:
    """Counts over all documents; one row a term of the block comes to the driver."""
    total = rows.agg(F.count("*"), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    held = np.zeros(size, np.int64)
    for number, df in rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        held[number] = df
    weights = np.array([math.floor(1000 * math.log((2 * total[0] + 2) / (2 * int(df) + 1))) for df in held], np.int64)
    return Scoring(total[0], total[1], weights)


class Treap:
    """K2-treap of a shard: entries (term, column, impact), one per cell."""

    def __init__(self, terms: np.ndarray, columns: np.ndarray, impacts: np.ndarray, weights: np.ndarray):
        present = np.unique(terms)
        present = present[np.argsort(weights[present], kind="stable")]  # rows of like weight side by side
        self.row = {int(t): i for i, t in enumerate(present)}
        place = np.zeros(len(weights), np.int64)
        place[present] = np.arange(len(present))
        rows = place[terms]
        self.height = max(int(max(rows.max(initial=0), columns.max(initial=0))).bit_length(), 1)
        code = np.zeros(len(rows), np.int64)
        for bit in range(self.height):
            code |= ((rows >> bit) & 1) << (2 * bit + 1) | ((columns >> bit) & 1) << (2 * bit)
        order = np.argsort(code, kind="stable")
        code, best = code[order], impacts[order]
        self.best, self.bits, self.first = [best], [], []
        for _ in range(self.height):
            child = code & 3
            code = code >> 2
            start = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            best = np.maximum.reduceat(best, start)
            self.bits.append(np.bitwise_or.reduceat(1 << child, start).astype(np.uint8))
            self.first.append(start)
            self.best.append(best)
            code = code[start]
        for level in (self.best, self.bits, self.first):
            level.reverse()

    def children(self, level: int, cells: np.ndarray, half: np.ndarray) -> np.ndarray:
        """Numbers of the child cells named by ``half`` (2 * row bit + column bit), -1 where empty."""
        at = np.maximum(cells, 0)
        bits = self.bits[level][at].astype(np.int64)
        child = self.first[level][at] + POPCOUNT[bits & ((1 << half) - 1)]
        return np.where((cells >= 0) & ((bits >> half) & 1 == 1), child, -1)

    def search(self, terms: list[tuple[int, int]], k: int, columns: "Best") -> None:
        """Offer every document of the shard that can be among the best to ``columns``; terms are (number, times)."""
        own = [(self.row[t], times) for t, times in terms if t in self.row]
        if not own:
            return
        rows, times = (np.array(x, np.int64) for x in zip(*own))
        wide = max(1, STEP_CELLS // len(rows))
        root = np.zeros((1, len(rows)), np.int64)
        open_ = [(-int(times.sum() * self.best[0][0]), 0, 0, np.zeros(1, np.int64), root, np.array([times.sum() * self.best[0][0]]))]
        made = 0
        while open_ and -open_[0][0] >= columns.bound:
            _, _, level, cols, cells, limits = heapq.heappop(open_)
            alive = limits >= columns.bound
            cols, cells = cols[alive], cells[alive]
            if level == self.height:
                columns.offer(limits[alive], cols)
                continue
            row_bit = (rows >> (self.height - 1 - level)) & 1
            below = [self.children(level, cells, 2 * row_bit + c) for c in (0, 1)]
            cells, cols = np.concatenate(below), np.concatenate([2 * cols, 2 * cols + 1])
            limits = np.where(cells >= 0, self.best[level + 1][np.maximum(cells, 0)], 0) @ times
            order = np.argsort(-limits, kind="stable")
            order = order[limits[order] >= max(columns.bound, 1)]
            width = wide if columns.bound > 1 else min(wide, k + 3)  # narrow until the first k are found
            for a in range(0, len(order), width):
                part = order[a : a + width]
                made += 1
                heapq.heappush(open_, (-int(limits[part[0]]), made, level + 1, cols[part], cells[part], limits[part]))


class Best:
    """The k best (score, id) of one item; ``bound`` is a score that the k best are known to reach."""

    def __init__(self, k: int, bound: int = 1):
        self.k, self.bound = k, max(1, bound)
        self.scores, self.ids, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.shard_ids = self.shard_null = None

    def offer(self, scores: np.ndarray, columns: np.ndarray) -> None:
        s = np.concatenate([self.scores, scores])
        ids = np.concatenate([self.ids, self.shard_ids[columns]])
        null = np.concatenate([self.null, self.shard_null[columns]])
        order = np.lexsort((ids, null, -s))[: self.k]
        self.scores, self.ids, self.null = s[order], ids[order], null[order]
        if len(order) == self.k:
            self.bound = max(self.bound, int(self.scores[-1]))


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together, or cut, to shards of bounded size."""
    held, docs, entries = [], 0, 0
    for batch in batches:
        sizes = np.cumsum(batch.column("terms").value_lengths().to_numpy(zero_copy_only=False))
        first = 0
        while first < batch.num_rows:
            done = sizes[first - 1] if first else 0
            last = int(np.searchsorted(sizes, done + SHARD_POSTINGS - entries, side="right"))
            last = min(max(last, first + (not docs)), batch.num_rows, first + SHARD_DOCS - docs)
            if last > first:
                held.append(batch.slice(first, last - first))
                docs, entries = docs + last - first, entries + int(sizes[last - 1] - done)
            if last < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, docs, entries = [], 0, 0
            first = last
    if held:
        yield pa.Table.from_batches(held)


def _search(rows: DataFrame, items: list[tuple[int | None, list[tuple[int, int]]]], bounds: dict[int, int], scoring: Scoring, k: int) -> DataFrame:
    """The k best hits of every item in each task's documents that reach the item's bound."""

    def run(batches):
        best = [Best(k, bounds.get(i, 1)) for i in range(len(items))]
        for shard in _shards(batches):
            ids = shard.column("doc_id").combine_chunks()
            null = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            lists = shard.column("terms").combine_chunks()
            sizes = lists.value_lengths().to_numpy()
            terms = lists.flatten().to_numpy().astype(np.int64)
            if not len(terms):
                continue
            counts = shard.column("counts").combine_chunks().flatten().to_numpy().astype(np.int64)
            n_terms = np.repeat(shard.column("n_terms").to_numpy(), sizes)
            treap = Treap(terms, np.repeat(np.arange(len(ids)), sizes), scoring.impacts(terms, counts, n_terms), scoring.weights)
            for (_, asked), found in zip(items, best):
                found.shard_ids, found.shard_null = ids, null
                treap.search(asked, k, found)
        sizes = [len(b.scores) for b in best]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.arange(len(items)), sizes), pa.int32()),
                pa.array([x for (name, _), n in zip(items, sizes) for x in [name] * n], pa.int64()),
                pa.array(np.concatenate([b.ids for b in best]), pa.int64(), mask=np.concatenate([b.null for b in best])),
                pa.array(np.concatenate([b.scores for b in best]), pa.int64()),
            ],
            names=HIT.names,
        )

    return rows.mapInArrow(run, HIT)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _block(docs: DataFrame, items: list[tuple[int | None, list[str]]], k: int) -> DataFrame:
    numbers: dict[str, int] = {}
    asked = [(name, [(numbers.setdefault(t, len(numbers)), n) for t, n in Counter(terms).items()]) for name, terms in items]
    spark = docs.sparkSession
    path = scratch_path(spark, "postings")
    rows_of(docs, Vocabulary(list(numbers))).write.parquet(path)
    rows = spark.read.schema(ROW).parquet(path)
    scoring = scoring_of(rows, len(numbers))
    early = F.pmod(F.xxhash64("doc_id", "n_terms"), F.lit(FIRST_SHARE)) == 0
    first = checkpointed(_ranked(_search(rows.where(early), asked, {}, scoring, k), k).drop("rank"))
    bounds = {r["item"]: r["kth"] for r in first.groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") >= k).collect()}
    return _ranked(first.unionByName(_search(rows.where(~early), asked, bounds, scoring, k)), k)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents (doc_id, text) of every item (item_id, text)."""
    waiting = ((r[0], terms_of(r[1])) for r in items.select(F.col("item_id").cast("long"), "text").toLocalIterator())
    parts = []
    while block := list(islice(waiting, block_items)):
        block = [(name, terms) for name, terms in block if terms]
        if block:
            parts.append(_block(docs, block, k))
    if not parts:
        parts = [docs.sparkSession.createDataFrame([], T.StructType([*HIT, T.StructField("rank", T.IntegerType())]))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
