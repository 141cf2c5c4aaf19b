"""Commit streams with Structured Streaming: dedupe, baseline, attribution and reports.

Every job reads a stream, writes parquet below one output folder and can be
stopped and restarted from its checkpoint. Writes inside ``foreachBatch`` go to
a folder per batch and replace it, so a repeated batch leaves no double rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from codelineage.operators import provenance as p
from codelineage.operators.reports import commit_stats, log_entries
from codelineage.operators.snippets import snippets


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables as a file stream, be it a file or a folder of files.

    A stream refuses the plain path of a file, and a filter on file names misses the parts of a folder; a pattern that
    only this path fits takes both.
    """
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def _start(stream: DataFrame, out: str, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/_checkpoint").trigger(availableNow=True)
    if each is not None:
        return writer.foreachBatch(each).start()
    return writer.format("parquet").option("path", f"{out}/data").start()


def _run(query: StreamingQuery) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


# Known keys: hash buckets, and runs of one level that are merged into one of the next.
KEY_BUCKETS, RUNS = 64, 8


def key_runs(batch_id: int, width: int = RUNS) -> list[tuple[int, int]]:
    """The runs (level, number) that hold the keys of all batches before ``batch_id``.

    Run n of level l holds batches n * width ** l and the following width ** l - 1: fewer than ``width`` runs a level.
    """
    out, level = [], 0
    while batch_id:
        out += [(level, n) for n in range(batch_id - batch_id % width, batch_id)]
        batch_id, level = batch_id // width, level + 1
    return out


def _run_path(out: str, level: int, number: int) -> str:
    return f"{out}/keys/level={level}/run={number}"


def _read_runs(spark: SparkSession, out: str, runs: list[tuple[int, int]], schema: T.StructType) -> DataFrame:
    paths = [_run_path(out, *run) for run in runs]
    return spark.read.schema(schema).option("basePath", f"{out}/keys").parquet(*paths).select(*schema.names)


def merge_runs(spark: SparkSession, out: str, batch_id: int, schema: T.StructType, width: int = RUNS) -> None:
    """Merge full groups of runs before a batch. The names follow from the batch number, so a repeated batch writes the same runs again."""
    level = 1
    while batch_id and batch_id % width**level == 0:
        number = batch_id // width**level - 1
        parts = _read_runs(spark, out, [(level - 1, n) for n in range(number * width, (number + 1) * width)], schema)
        merged = parts.repartition("bucket").write.mode("overwrite").partitionBy("bucket")
        merged.parquet(_run_path(out, level, number))
        level += 1


def known_keys(spark: SparkSession, out: str, batch_id: int, buckets: list[int], schema: T.StructType) -> DataFrame:
    """Keys of earlier batches in some buckets. The bucket numbers are literals, so files of others are not read."""
    runs = key_runs(batch_id)
    if not runs:
        return spark.createDataFrame([], schema)
    return _read_runs(spark, out, runs, schema).where(F.col("bucket").isin(buckets))


def dedupe_commits(commits: DataFrame, out: str, buckets: int = KEY_BUCKETS) -> StreamingQuery:
    """Each (repo, commit) once, however late or often it is announced.

    What was passed on is a table of known keys in hash buckets, written as a run per batch; runs are merged eight by
    eight, so a bucket has a few files, whatever the history. A batch reads the buckets of its own keys only
    (their numbers, at most ``buckets``, come to the driver), and no state expires.
    """
    keys = ["repo", "commit"]
    spread = commits.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    schema = T.StructType([f for f in spread.schema.fields if f.name in (*keys, "bucket")])

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        merge_runs(spark, out, batch_id, schema)
        touched = [r["bucket"] for r in batch.select("bucket").distinct().collect()]
        known = known_keys(spark, out, batch_id, touched, schema).select("bucket", *keys)
        fresh = batch.dropDuplicates(keys).join(known, ["bucket", *keys], "left_anti")
        data = f"{out}/data/batch={batch_id}"
        fresh.write.mode("overwrite").parquet(data)
        new = spark.read.schema(spread.schema).parquet(data).select(*schema.names)
        new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(_run_path(out, 0, batch_id))

    _empty(commits.sparkSession, f"{out}/data/batch=-1", spread.schema)
    return _start(spread, out, each=each)


def skip_baseline(commits: DataFrame, out: str) -> StreamingQuery:
    """Pass every commit except the first one seen per repository.

    The baseline commits are a small table (one row per repository) instead of
    grouped state, so a repository with most of the commits is not gathered in
    one task.
    """
    base_path, schema = f"{out}/baseline", "repo bigint, commit bigint"
    _empty(commits.sparkSession, f"{base_path}/batch=-1", schema)

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = spark.read.schema(f"{schema}, batch bigint").parquet(base_path).where(F.col("batch") < batch_id)
        fresh = (
            batch.groupBy("repo")
            .agg(F.min_by("commit", F.struct("ts", "commit")).alias("commit"))
            .join(seen.select("repo"), "repo", "left_anti")
        )
        fresh.write.mode("overwrite").parquet(f"{base_path}/batch={batch_id}")
        known = spark.read.schema(schema).parquet(f"{base_path}/batch={batch_id}")
        batch.join(known, ["repo", "commit"], "left_anti").write.mode("overwrite").parquet(f"{out}/data/batch={batch_id}")

    return _start(commits, out, each=each)


def _empty(spark: SparkSession, path: str, schema) -> None:
    """An empty table, so that the first batch finds something to read."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def attribute_stream(blocks: DataFrame, lookup: DataFrame, out: str) -> StreamingQuery:
    """Line labels of committed blocks, appended as they come.

    A stream-static join with the table of first lines (``first_lines``
    written once), so the chat history is not read again for every batch.
    """
    return _start(p.label_lines(blocks, lookup), out)


def _of_batch(batch: DataFrame, messages: DataFrame, chats: DataFrame) -> DataFrame:
    """Attributions of a batch; only the chats of its own conversations are parsed."""
    needed = batch.select("conv_id").distinct()
    mine = lambda df: df.join(needed, "conv_id", "left_semi")
    return p.attribute_blocks(batch, snippets(mine(chats)), mine(messages))


def attribute_batches(blocks: DataFrame, messages: DataFrame, out: str, chats: DataFrame | None = None) -> StreamingQuery:
    """Block labels per micro-batch: a block arrives as one row, so its lines are never split over batches.

    ``chats`` are the messages whose code counts, ``messages`` by default; they are filtered before they are parsed.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        labels = _of_batch(batch, messages, messages if chats is None else chats)
        labels.write.mode("overwrite").parquet(f"{out}/data/batch={batch_id}")

    return _start(blocks, out, each=each)


def log_batches(blocks: DataFrame, messages: DataFrame, out: str, describe: Callable[[DataFrame], DataFrame], chats: DataFrame | None = None) -> StreamingQuery:
    """The function log, written as commits arrive: one JSON line per attributed function.

    ``describe`` adds commit, file, function and lines to the attributions of a batch. A batch owns its folder
    and replaces it, so a batch that is run again leaves no double line.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        found = describe(_of_batch(batch, messages, messages if chats is None else chats))
        log_entries(found).select("entry.*").write.mode("overwrite").json(f"{out}/log/batch={batch_id}")

    return _start(blocks, out, each=each)


def read_log(spark: SparkSession, out: str, schema: str) -> DataFrame:
    """All lines of a log written by ``log_batches``."""
    return spark.read.schema(schema).json(f"{out}/log").drop("batch")


def latest_report(attributions: DataFrame, out: str) -> StreamingQuery:
    """Keeps the attributions as they come; ``read_latest`` reports on the newest commit, over all its batches."""

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/data/batch={batch_id}")

    return _start(attributions, out, each=each)


def read_latest(spark: SparkSession, out: str) -> DataFrame:
    rows = spark.read.parquet(f"{out}/data").drop("batch")
    newest = rows.agg(F.max(F.struct("ts", "commit")).alias("m")).select("m.*")
    # one row: the newest commit and its time
    return commit_stats(rows.join(F.broadcast(newest.select("commit")), "commit")).crossJoin(F.broadcast(newest.select("ts")))


def finished(query: StreamingQuery, spark: SparkSession, out: str) -> DataFrame:
    """Wait for the available input and read what was written."""
    _run(query)
    data = spark.read.parquet(f"{out}/data")
    return data.drop("batch", "bucket")
