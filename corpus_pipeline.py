"""Documents to training sequences: filter, thin out, clean, pack.

``STAGES`` lists the stages in order. Each takes (spark, docs, sf_dir) and returns a
DataFrame; ``run`` writes every result as Parquet in the shared folder and reads it again as
the next stage's documents. All stages but the last return the columns of their documents.

Null texts count as empty. Rows with a null id pass the filters on copies and are never
references. Of rows with one id, the near-copy stage keeps the first by hash of text. Other
columns, whatever their names, are carried through untouched, except ``n_chars``, which
follows the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codelineage.llm import jaccard, packing, pii, rlz, toxicity
from codelineage.llm.common import table
from codelineage.session import scratch_path

TOXIC = 0.7
NEAR = jaccard.Rule(words=5, num=80, den=100, lower=True)
TOKENIZER = "byte_bpe_50k.json"


def _apart(docs: DataFrame) -> DataFrame:
    """(rest, doc_id, text): the other columns in one struct, so that no name of theirs can clash."""
    rest = [F.col(c) for c in docs.columns if c != "text"]
    return docs.select(F.struct(*rest).alias("rest"), "doc_id", "text")


def _together(rows: DataFrame, docs: DataFrame, text) -> DataFrame:
    """The columns of ``docs`` again, with a new text and its length."""
    types = dict(docs.dtypes)
    out = rows.select("rest", text.alias("new"))
    columns = [
        F.col("new").alias(c) if c == "text" else F.length("new").cast(types[c]).alias(c) if c == "n_chars" else F.col("rest")[c].alias(c)
        for c in docs.columns
    ]
    return out.select(*columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated toxicity stays below ``TOXIC``."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return _together(toxicity.score(_apart(docs), model).where(F.col("score") < TOXIC), docs, F.col("text"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id."""
    classes = jaccard.near_copies(docs, rule=NEAR)
    copies = classes.where(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct()
    kept = docs.join(copies, "doc_id", "left_anti")
    twice = docs.groupBy("doc_id").count().where("doc_id is not null and count > 1").select("doc_id")
    if not twice.isEmpty():
        order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
        several = _apart(kept.join(twice, "doc_id", "left_semi")).withColumn("nth", F.row_number().over(order)).where("nth = 1")
        kept = kept.join(twice, "doc_id", "left_anti").unionByName(_together(several, docs, F.col("text")))
    return kept.select(*docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 13 words or more that a document with a smaller id holds."""
    found = rlz.remove_repeats(_apart(docs))
    return _together(found, docs, F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text")))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a mark in place of every e-mail and IP address, card and telephone number."""
    found = pii.detect(_apart(docs), pii.learn(docs))
    return _together(found, docs, F.when(F.col("spans") != "", F.col("masked")).otherwise(F.col("text")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document in sequences of at most 1024."""
    import public_tokenizers

    packed = packing.pack(docs, str(public_tokenizers.path(TOKENIZER)))
    return packing.checksum(packed).select("doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("substring_dedup", drop_repeats),
    ("personal_data", mask_personal_data),
    ("packing", pack_sequences),
]

# Fitted models and tokenizer files have no SQL; tests compare every stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
