"""JSON arrays, wrapped results, fixed splits and their sinks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SPLITS = ("train", "validation", "test")


def read_json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Records of files that hold one JSON array of objects; malformed files fail the read."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records under the top-level ``results`` list; a file without that list fails."""
    wrapped = spark.read.schema(f"results array<struct<{schema}>>").option("multiLine", True).json(path)
    checked = F.when(F.col("results").isNull(), F.raise_error(F.lit('input needs a top-level "results" list'))).otherwise(F.col("results"))
    return wrapped.select(F.inline(checked))


def read_optional(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """As ``read_json_array``, or no rows when the path does not exist."""
    try:
        return read_json_array(spark, path, schema)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in (error.getCondition() or ""):
            raise
        return spark.createDataFrame([], schema)


def union_splits(parts: dict[str, DataFrame]) -> DataFrame:
    """Split tables as one, with the split name and its position in the fixed order."""
    out = None
    for rank, name in enumerate(SPLITS):
        part = parts[name].withColumns({"split": F.lit(name), "split_rank": F.lit(rank)})
        out = part if out is None else out.unionByName(part)
    return out


def read_splits(spark: SparkSession, folder: str, schema: StructType | str) -> tuple[DataFrame, DataFrame]:
    """The splits of a folder (``train``, ``validation`` and ``test`` with ``.json``, a file or folder of JSON arrays each)
    in the fixed order, and its checked thresholds record."""
    parts = {name: read_json_array(spark, f"{folder}/{name}.json", schema) for name in SPLITS}
    thresholds = spark.read.option("multiLine", True).json(f"{folder}/thresholds.json")
    return union_splits(parts), check_thresholds(thresholds)


def write_json_arrays(df: DataFrame, path: str, rows: int = 1000) -> None:
    """Records as files that hold one JSON array each, of about ``rows`` records."""
    files = max(1, -(-df.count() // rows))
    file = F.pmod(F.xxhash64(*df.columns), F.lit(files)).alias("file")
    arrays = df.groupBy(file).agg(F.to_json(F.collect_list(F.struct(*df.columns))).alias("value"))
    arrays.write.mode("errorifexists").partitionBy("file").text(path)


def write_ordered(df: DataFrame, path: str, keys: list[str]) -> None:
    """Records as JSON lines in the order of the keys: files by name, lines in a file. Ranges are sorted apart, never all in one task."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("errorifexists").json(path)


def read_ordered(spark: SparkSession, path: str, schema: StructType | str, name: str = "place") -> DataFrame:
    """Records of ``write_ordered`` with their place, from 1. Lines are numbered inside their file, file sizes give the offsets."""
    rows = spark.read.schema(schema).json(path).select(
        "*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line")
    )
    before = W.orderBy("_file").rowsBetween(W.unboundedPreceding, -1)  # one row a file
    sizes = rows.groupBy("_file").agg(F.count("*").alias("_n")).select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(W.partitionBy("_file").orderBy("_block", "_line"))
    return rows.withColumn("_nth", inside).join(sizes, "_file").withColumn(name, F.col("_offset") + F.col("_nth")).drop("_file", "_block", "_line", "_nth", "_offset")


def with_source_index(df: DataFrame, position: str = "position") -> DataFrame:
    """Running index over (split order, position in the split).

    Positions count from 0 inside each split, so the index is the position
    plus the sizes of the earlier splits: three numbers, no global sort.
    """
    counts = df.groupBy("split_rank").agg(F.count("*").alias("n")).withColumnRenamed("split_rank", "_rank")
    pairs = counts.select("_rank", "n", F.explode(F.array(*[F.lit(i) for i in range(len(SPLITS))])).alias("split_rank"))
    offsets = pairs.groupBy("split_rank").agg(
        F.coalesce(F.sum(F.when(F.col("_rank") < F.col("split_rank"), F.col("n"))), F.lit(0)).alias("_offset")
    )
    return df.join(offsets, "split_rank").withColumn("source_index", F.col(position) + F.col("_offset")).drop("_offset")


def check_thresholds(df: DataFrame) -> DataFrame:
    """The thresholds record must hold exactly p33 and p66."""
    if set(df.columns) != {"p33", "p66"}:
        raise ValueError("thresholds must hold exactly p33 and p66")
    return df.select(F.col("p33").cast("double"), F.col("p66").cast("double"))


def write_json(df: DataFrame, path: str, refuse_existing: bool = False) -> None:
    """Records as JSON lines; the commit protocol makes the files appear at once."""
    df.write.mode("errorifexists" if refuse_existing else "overwrite").json(path)


def append_json(df: DataFrame, path: str) -> None:
    """Add records without rewriting the earlier ones."""
    df.write.mode("append").json(path)
