"""CSV files with one header line: the requirement taxonomy, the topic table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_header_csv(spark: SparkSession, path: str, columns: Sequence[str] = ()) -> DataFrame:
    """All columns as text; the named ones must be there. Quoted fields may hold line breaks."""
    df = spark.read.options(header=True, multiLine=True, escape='"').csv(path)
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing in {path}: {', '.join(missing)}")
    return df


def read_taxonomy(spark: SparkSession, path: str, categories: Sequence[str]) -> DataFrame:
    """Reviewed requirement categories; every rule's category needs a retained requirement."""
    taxonomy = read_header_csv(spark, path, ("author_final_category", "author_decision"))
    kept = taxonomy.where(F.col("author_decision").isin("accept", "correct"))
    # at most one row per category
    found = {r[0] for r in kept.where(F.col("author_final_category").isin(*categories)).select("author_final_category").distinct().collect()}
    if unsupported := [c for c in categories if c not in found]:
        raise ValueError(f"no retained requirement supports: {', '.join(unsupported)}")
    return taxonomy


def write_topics(report: DataFrame, path: str, words: str = "words") -> None:
    """One row per topic, its words joined by a bar."""
    report.withColumn(words, F.array_join(words, " | ")).write.mode("overwrite").options(header=True, escape='"').csv(path)
