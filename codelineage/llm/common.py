"""Shared helpers: word patterns, Arrow batches of bounded size, columns added beside a table's own."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelineage.session import checkpointed

# The six characters that part words, and their pattern.
BREAKS = " \t\n\x0b\x0c\r"
BREAK_PATTERN = r"[\x20\x09-\x0D]+"

BATCH_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(df: DataFrame, share: int = 8) -> DataFrame:
    """A result much smaller than its inputs, in the shared folder: a part of the usual partitions holds it."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpointed(df.coalesce(max(4, parts // share)))


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Queries built and run inside drop their shuffle files when they end, and pass rows to Python in small batches.

    What later steps need is checkpointed or written; a lost file is made again from the
    lineage. Sessions that do not know a setting ignore it.
    """
    wanted = {
        "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    }
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where a lambda in ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def word_array(text: Column) -> Column:
    """The words of a text, none for an empty one; null texts count as empty."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BREAKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BREAK_PATTERN))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of a column in a row, and the n + 1 borders between them; nulls are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    borders = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[borders[0] : borders[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, borders - borders[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut to about ``limit`` bytes of text each, one row at least."""
    for batch in batches:
        _, borders = text_bytes(batch.column(column))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(borders, borders[first] + limit, side="right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


def map_added(
    df: DataFrame, column: str, added: T.StructType, work: Callable[[pa.RecordBatch], list], limit: int = BATCH_BYTES
) -> DataFrame:
    """``df`` with columns that ``work`` computes from each batch; columns of the same names are replaced."""
    names = [f.name for f in added]
    kept = df.drop(*[n for n in names if n != column])
    replaced = column in names
    schema = T.StructType([f for f in kept.schema if not (replaced and f.name == column)] + list(added))

    def run(batches):
        for batch in slices(batches, column, limit):
            new = work(batch)
            old = [(n, batch.column(n)) for n in batch.schema.names if not (replaced and n == column)]
            yield pa.RecordBatch.from_arrays([a for _, a in old] + new, names=[n for n, _ in old] + names)

    return kept.mapInArrow(run, schema)


def list_array(flat: np.ndarray, counts, kind: pa.DataType) -> pa.Array:
    """A list column from values in a row and the number of values of each list."""
    borders = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=borders[1:])
    return pa.ListArray.from_arrays(pa.array(borders, pa.int32()), pa.array(flat, kind))
