"""Readers for the supplied tables and the roles derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for work that is heavy per row (parsing, edit distances, many patterns).

    A table in fewer files than there are cores would leave cores idle, so its
    rows are dealt out; a table in many files is read as it is, without a shuffle.
    """
    df = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat messages: conv_id, turn, role, text."""
    return spread_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def edited(conv: Column, text: Column) -> Column:
    """A third of the conversations untouched, a third edited on every third line, a third on every line."""
    mark = lambda x: F.concat(x, F.lit(" # edited"))
    return F.array_join(
        F.transform(
            F.split(text, "\n"),
            lambda x, i: F.when((conv % 3 == 1) & ((i + 1) % 3 == 0), mark(x))
            .when(conv % 3 == 2, mark(x))
            .otherwise(x),
        ),
        "\n",
    )


def code_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One committed block per message: conv_id, block (its turn), content."""
    return messages(spark, sf_dir).select(
        "conv_id", F.col("turn").alias("block"), edited(F.col("conv_id"), F.col("text")).alias("content")
    )
