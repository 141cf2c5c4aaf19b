"""Survey exports with two header rows, read as a long table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def long_from_wide(df: DataFrame, respondent: str, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """Wide answers to (respondent, question, option, value); ``columns`` maps a column to its headers."""
    entry = lambda c: F.struct(
        F.lit(columns[c][0]).alias("question"), F.lit(columns[c][1]).alias("option"), F.col(c).cast("string").alias("value")
    )
    return df.select(F.col(respondent).alias("respondent"), F.inline(F.array(*[entry(c) for c in columns])))


def read_two_header_csv(spark: SparkSession, path: str) -> DataFrame:
    """Read one export: question row, option row, answers, hand-made summary rows.

    A blank question repeats the one to its left. Rows without a respondent id
    are summaries and are dropped. Ids are not trusted to be unique, so
    ``respondent`` is a surrogate key.
    """
    raw = spark.read.csv(path, header=False, multiLine=True, quote='"', escape='"', inferSchema=False)
    first, second = raw.limit(2).collect()  # the two header rows only
    columns, question = {}, ""
    for name in raw.columns[1:]:
        question = (first[name] or "").strip() or question
        columns[name] = (question, (second[name] or "").strip() or question)
    id_column = raw.columns[0]
    is_header = F.coalesce(F.col(id_column), F.lit("")) == F.coalesce(F.lit(first[id_column]), F.lit(""))
    answers = raw.where(~is_header & (F.length(F.trim(F.coalesce(id_column, F.lit("")))) > 0))
    keyed = answers.withColumn("respondent", F.monotonically_increasing_id())
    return long_from_wide(keyed, "respondent", columns)
