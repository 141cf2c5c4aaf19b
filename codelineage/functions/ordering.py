"""Stable hash order and global ranks that never sort everything in one task."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


# Hash tags whose order or seed must be the same everywhere.
BATCH_TAG = "fusion-guided-llm-batch-v1"
TIE_TAG = "synthetic-training-max-tie-v1"


def stable_digest(tag: str, seed: int, *ids: Column) -> Column:
    """SHA-256 of ``tag NUL seed NUL id``: the same order on any cluster."""
    return F.sha2(F.concat_ws("\0", F.lit(tag), F.lit(str(seed)), *[c.cast("string") for c in ids]), 256)


def digest_bucket(digest: Column, width: int = 4) -> Column:
    """Order-preserving bucket of a hex digest; at most 16**width buckets."""
    return F.substring(digest, 1, width)


def _seeded_indices(seeds: pd.Series, sizes: pd.Series) -> pd.Series:
    pick = lambda seed, n: random.Random(int(seed, 16)).randrange(n) if n else -1
    return pd.Series([[pick(*x) for x in zip(*row)] for row in zip(seeds, sizes)])


def seeded_indices(seeds: Column, sizes: Column) -> Column:
    """For every (hexadecimal seed, size) an index below the size as the seeded generator of Python draws it, -1 for none."""
    return F.pandas_udf(_seeded_indices, "array<int>")(seeds, sizes)


def running_total(
    df: DataFrame, groups: list[str], bucket: Column, order: list[str], weight: Column, name: str
) -> DataFrame:
    """Running sum of ``weight`` inside each group, in two levels.

    ``bucket`` must be monotone in ``order``. Bucket totals are summed first
    (map-side combined, a bounded number of rows per group), their running sum
    gives each bucket an offset, and rows are only sorted inside a bucket. A
    group holding most of the rows is thus spread over all its buckets.

    Both sides of the join grow with the input, and estimates from compressed files are far too low for derived
    rows: the hint keeps either side from being sent through the driver.
    """
    rows = df.withColumn("_bucket", bucket).withColumn("_weight", weight)
    keys = [*groups, "_bucket"]
    before = W.partitionBy(*groups).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*keys)
        .agg(F.sum("_weight").alias("_total"))
        .withColumn("_offset", F.coalesce(F.sum("_total").over(before), F.lit(0)))
        .select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_offset")
    )
    match = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    condition = match[0]
    for part in match[1:]:
        condition = condition & part
    inside = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return (
        rows.join(offsets.hint("merge"), condition)
        .withColumn(name, F.col("_offset") + F.sum("_weight").over(inside))
        .drop("_weight", "_bucket", "_offset", *[f"_k_{k}" for k in keys])
    )


def hash_rank(df: DataFrame, groups: list[str], digest: str, tie: str, name: str = "rank") -> DataFrame:
    """1-based rank by (digest, tie) within each group."""
    return running_total(df, groups, digest_bucket(F.col(digest)), [digest, tie], F.lit(1).cast("long"), name)


def range_bucket(df: DataFrame, column: str, buckets: int = 65536) -> Column:
    """Order-preserving bucket of a non-negative number by its share of the maximum."""
    width = F.ceil((df.agg(F.max(column)).scalar() + 1) / buckets)
    return F.floor(F.col(column) / width)
