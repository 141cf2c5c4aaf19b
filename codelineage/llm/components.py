"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelineage.llm.common import kept


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node each node of edges (a, b) is connected with.

    Each round hangs the larger neighbours of a node, then its smaller ones, below the
    smallest; the rounds follow the logarithm of the longest path. Neighbours are
    never gathered: a round is one aggregation and one join.
    """
    pair = lambda x, y: F.struct(F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))
    edges = kept(edges.where("a <> b").select(pair(F.col("a"), F.col("b")).alias("e")).select("e.*").distinct())
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(
            F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("low").alias("b")), F.struct(F.col("a"), F.col("low").alias("b")))).alias("e")
        ).select("e.*")
        edges = kept(small.where("a <> b").distinct())
        after = _state(edges)
        if after == state:
            break
        state = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
