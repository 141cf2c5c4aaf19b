"""Exact top-k inner-product search with a KD-tree per shard.

Vectors are dealt to shards by a hash of their id. Each shard's tree is built once, by median
splits along the widest side with a tight box around every node, and written as one row of
bounded size. A query descends a tree best-first: a heap holds the open boxes, the box with the
highest possible score is opened next, and the descent ends when no open box can reach the k-th
score found so far. Queries search the shard they lie in first; the k-th score found there goes
with them to the other shards, and only to those whose root box can reach it.

Vectors are shuffled once, trees and packed blocks of queries after that. A task streams the
blocks of a shard past its tree and holds one tree and one block at a time.

Vectors that are null, empty, or hold null or non-finite components take no part; of rows
with the same id the smallest vector counts; rows with a null id are left out. A vector
of another length than the query's is no candidate. Scores must fit 64 bits. Ties go to the smaller id. An empty
table gives no rows. Columns other than the id and the vector, whatever their names, are not read.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelineage.session import checkpointed

LEAF = 1_024
SHARD_ROWS = 16_384
SHARD_BYTES = 8 << 20
BLOCK_QUERIES = 2_048
ROOTS = 64
LOWEST = np.iinfo(np.int64).min


@dataclass
class Tree:
    """Nodes from the root down; node n has children child[n] and child[n] + 1, or none if that is -1.

    A node holds the points ``rows[begin:end]`` inside the box from ``low`` to ``high``.
    """

    rows: np.ndarray
    child: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray


def grow(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """The tree of ``points``, with at most ``leaf`` of them in a node without children."""
    rows = np.arange(len(points))
    spans, child, low, high = [(0, len(points))], [], [], []
    for begin, end in spans:  # grows while it is read: children are appended two by two
        part = points[rows[begin:end]]
        low.append(part.min(axis=0))
        high.append(part.max(axis=0))
        if end - begin <= leaf:
            child.append(-1)
            continue
        axis = int(np.argmax(high[-1] - low[-1]))
        middle = (end - begin) // 2
        rows[begin:end] = rows[begin:end][np.argpartition(part[:, axis], middle)]
        child.append(len(spans))
        spans += [(begin, begin + middle), (begin + middle, end)]
    begin, end = np.array(spans, np.int64).T
    return Tree(rows, np.array(child, np.int64), begin, end, np.stack(low), np.stack(high))


def build(points: np.ndarray, leaf: int = LEAF) -> list[np.ndarray]:
    """Row numbers of the leaves of a tree."""
    tree = grow(points, leaf)
    return [tree.rows[tree.begin[n] : tree.end[n]] for n in np.flatnonzero(tree.child < 0)]


def box_bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each query and box a number that no inner product with a point of the box exceeds."""
    q, low, high = queries.astype(float), low.astype(float), high.astype(float)
    bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    size = np.abs(q) @ np.maximum(np.abs(low), np.abs(high)).T
    # whole numbers below 2**53 are exact in doubles, beyond that rounding is allowed for
    return bounds + np.where(size < 2.0**53, 0.0, size * 1e-9)


def descend(tree: Tree, ids: np.ndarray, points: np.ndarray, query_id: int, query: np.ndarray, bounds: np.ndarray, kth: int, k: int):
    """(ids, scores, boxes opened) of the k best points with a score of at least ``kth``; ids and points in tree order."""
    names, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    opened, open_ = 0, [(-bounds[0], 0)]
    while open_ and -open_[0][0] >= kth:
        node = heapq.heappop(open_)[1]
        opened += 1
        below = tree.child[node]
        if below >= 0:
            for n in (below, below + 1):
                if bounds[n] >= kth:
                    heapq.heappush(open_, (-bounds[n], n))
            continue
        part = slice(tree.begin[node], tree.end[node])
        found = points[part] @ query
        take = np.flatnonzero((found >= kth) & (ids[part] != query_id))
        if not len(take):
            continue
        names, scores = np.r_[names, ids[part][take]], np.r_[scores, found[take].astype(np.int64)]
        if len(scores) >= k:
            best = np.lexsort((names, -scores))[:k]
            names, scores = names[best], scores[best]
            kth = max(kth, int(scores[-1]))
    return names, scores, opened


def search(tree: Tree, ids: np.ndarray, points: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, bound: np.ndarray, k: int):
    """(query id, id, score) of the k best of each query with a score of at least its bound; ids and points in tree order."""
    exact = np.abs(points).max(initial=0) * float(np.abs(queries).max(initial=0)) * points.shape[1] < 2.0**53
    kind = np.float64 if exact else np.int64
    points, queries = points.astype(kind), queries.astype(kind)
    bounds = box_bounds(queries, tree.low, tree.high)
    out = [np.zeros((3, 0), np.int64)]
    for query_id, query, boxes, kth in zip(query_ids.tolist(), queries, bounds, bound.tolist()):
        names, scores, _ = descend(tree, ids, points, query_id, query, boxes, kth, k)
        out.append(np.stack([np.full(len(names), query_id), names, scores]))
    return np.concatenate(out, axis=1)


def usable(vector: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, bad)


def scaled(df: DataFrame, key: str = "vec_id", vector: str = "embedding", factor: int = 64) -> DataFrame:
    """(vec_id, point): usable vectors as whole numbers floor(factor * x)."""
    doubles = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = df.select(F.col(key).cast("long").alias("vec_id"), doubles.alias("point")).where(F.col("vec_id").isNotNull() & usable(F.col("point")))
    whole = F.transform("point", lambda x: F.floor(x * F.lit(float(factor))))
    return rows.select("vec_id", whole.alias("point")).groupBy("vec_id").agg(F.min("point").alias("point"))


HIT = T.StructType([T.StructField(n, T.LongType()) for n in ("query_id", "vec_id", "score")])
PARTS = ("ids", "points", "child", "begin", "end", "low", "high")
TREE = T.StructType(
    [T.StructField("dims", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("width", T.IntegerType())]
    + [T.StructField(n, T.BinaryType()) for n in PARTS]
)
QUERIES = "array<struct<query_id: bigint, bound: bigint, query: array<bigint>>>"
ROUTED = f"dims int, shard int, queries {QUERIES}"


def plant(vectors: DataFrame) -> DataFrame:
    """One row per shard of (dims, shard, vec_id, point): its tree, points in tree order and in as few bytes as they fit."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        points = np.stack(part["point"].tolist())
        tree = grow(points)
        most = max(-int(points.min()), int(points.max()))
        width = 2 if most < 2**15 else 4 if most < 2**31 else 8
        held = {"ids": part["vec_id"].to_numpy()[tree.rows], "points": points[tree.rows].astype(f"i{width}")}
        row = {n: [held.get(n, getattr(tree, n, None)).tobytes()] for n in PARTS}
        return pd.DataFrame({"dims": part["dims"].iloc[:1].to_list(), "shard": part["shard"].iloc[:1].to_list(), "width": [width], **row})

    return vectors.groupBy("dims", "shard").applyInPandas(run, TREE)


def unpack(row: dict) -> tuple[Tree, np.ndarray, np.ndarray]:
    """Tree, ids and points of a row of ``plant``."""
    whole = {n: np.frombuffer(row[n], np.int64) for n in PARTS if n != "points"}
    box = lambda n: whole[n].reshape(-1, row["dims"])
    tree = Tree(np.arange(len(whole["ids"])), whole["child"], whole["begin"], whole["end"], box("low"), box("high"))
    return tree, whole["ids"], np.frombuffer(row["points"], f"i{row['width']}").reshape(-1, row["dims"]).astype(np.int64)


def block_arrays(queries: pa.ListScalar, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, bounds and vectors of a packed block."""
    held = queries.values
    ids, bound = (held.field(n).to_numpy() for n in ("query_id", "bound"))
    return ids, bound, held.field("query").flatten().to_numpy().reshape(-1, dims)


def packed(queries: DataFrame, *keys: str) -> DataFrame:
    """Queries of a block as one list."""
    return queries.groupBy(*keys).agg(F.collect_list(F.struct("query_id", "bound", "query")).alias("queries"))


def routes(blocks: DataFrame, trees: DataFrame, shards: int) -> DataFrame:
    """(dims, shard, queries): of blocks (dims, home, queries) the queries whose bound a shard's root box can reach.

    Roots are gathered ``ROOTS`` at a time, and a block meets every gathering once.
    """
    root = trees.select("dims", "shard", F.substring("low", 1, F.col("dims") * 8).alias("low"), F.substring("high", 1, F.col("dims") * 8).alias("high"))
    team = F.expr(f"shard div {ROOTS}").cast("int")
    roots = root.withColumn("team", team).groupBy("dims", "team").agg(F.collect_list(F.struct("shard", "low", "high")).alias("roots"))
    teams = F.explode(F.sequence(F.lit(0), F.lit((shards - 1) // ROOTS)))
    met = blocks.withColumn("team", teams).join(roots, ["dims", "team"]).select("dims", "home", "queries", "roots")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                dims, home = batch.column("dims")[i].as_py(), batch.column("home")[i].as_py()
                asked, held = batch.column("queries")[i].values, batch.column("roots")[i].values
                ids, bound, queries = block_arrays(batch.column("queries")[i], dims)
                low, high = (np.frombuffer(b"".join(held.field(n).to_pylist()), np.int64).reshape(-1, dims) for n in ("low", "high"))
                reach = box_bounds(queries, low, high) >= bound[:, None]
                for j, shard in enumerate(held.field("shard").to_pylist()):
                    pick = np.flatnonzero(reach[:, j])
                    if shard == home or not len(pick):
                        continue
                    part = asked.take(pa.array(pick))
                    one = pa.ListArray.from_arrays(pa.array([0, len(pick)], pa.int32()), part)
                    yield pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), pa.array([shard], pa.int32()), one], names=["dims", "shard", "queries"])

    return met.mapInArrow(run, ROUTED)


def meet(trees: DataFrame, blocks: DataFrame, k: int, parts: int) -> DataFrame:
    """Hits of packed blocks (dims, shard, queries) in the trees of their shards."""
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in TREE if f.name not in ("dims", "shard")]
    rows = trees.select("dims", "shard", F.lit(0).alias("kind"), *TREE.names[2:], F.lit(None).cast(QUERIES).alias("queries")).unionByName(
        blocks.select("dims", "shard", F.lit(1).alias("kind"), *none, "queries")
    )

    def run(batches):
        at, held = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                key = (batch.column("dims")[i].as_py(), batch.column("shard")[i].as_py())
                if batch.column("kind")[i].as_py() == 0:
                    at, held = key, unpack({n: batch.column(n)[i].as_py() for n in TREE.names})
                    continue
                if at != key:
                    raise ValueError(f"no tree for shard {key}")
                ids, bound, queries = block_arrays(batch.column("queries")[i], key[0])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in search(*held, ids, queries, bound, k)], names=HIT.names)

    # a shard's tree comes first, its blocks follow
    return rows.repartition(parts, "dims", "shard").sortWithinPartitions("dims", "shard", "kind").mapInArrow(run, HIT)


def top_k(points: DataFrame, is_query: Column, k: int, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of ``points`` (vec_id, point) where ``is_query`` holds.

    Shards hold about ``shard_rows`` vectors, fewer if these would take more than ``SHARD_BYTES``.
    """
    points = checkpointed(points.select("vec_id", "point", F.size("point").alias("dims"), is_query.alias("asked")))
    total, asked, widest = points.agg(F.count("*"), F.count_if("asked"), F.max("dims")).first()
    shard_rows = max(1, min(shard_rows, SHARD_BYTES // (8 * (widest or 1))))
    shards = max(1, -(-total // shard_rows))
    blocks = max(1, -(-asked // (shards * block_queries)))
    deal = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    vectors = points.withColumn("shard", deal(shards, 0))
    trees = checkpointed(plant(vectors.select("dims", "shard", "vec_id", "point")))
    queries = vectors.where("asked").select("dims", F.col("shard").alias("home"), deal(blocks, 1).alias("block"), F.col("vec_id").alias("query_id"), F.col("point").alias("query"))
    at_home = packed(queries.withColumn("bound", F.lit(LOWEST)), "dims", "home", "block")
    parts = min(shards, 100_000)
    hits = meet(trees, at_home.withColumnRenamed("home", "shard"), k, parts)
    if shards > 1:
        hits = checkpointed(hits)
        kth = hits.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(LOWEST)).alias("bound"))
        bounded = queries.join(kth, "query_id", "left").fillna({"bound": LOWEST})
        hits = hits.unionByName(meet(trees, routes(packed(bounded, "dims", "home", "block"), trees, shards), k, parts))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
