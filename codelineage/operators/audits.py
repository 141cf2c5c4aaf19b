"""Validation, identity joins, split audits and reconciliation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelineage.functions import text as t

SPLITS = ("train", "validation", "test")
PAIRS = (("train", "validation"), ("train", "test"), ("validation", "test"))
REQUIRED = (
    "repo_full_name",
    "file_path",
    "function_name",
    "old_function_code",
    "new_function_code",
    "new_function_code_by_llm",
    "requirement",
)
SAFE_COLUMNS = (
    "source_index", "repo_full_name", "file_path", "function_name", "requirement", "old_function_code",
    "ast_delta_similarity",
)
MANIFEST_COLUMNS = (
    "source_index", "repo_full_name", "file_path", "function_name", "requirement", "ast_delta_similarity",
    "similarity_label", "label_id",
)


def manifest(df: DataFrame, columns: Sequence[str] = MANIFEST_COLUMNS) -> DataFrame:
    """The identifying and label columns only; neither code nor prediction goes into a manifest."""
    return df.select(*columns)


def json_field_problem(record: Column, name: str) -> Column:
    """Missing, null and non-string stay apart because the raw JSON text is inspected."""
    value = F.try_variant_get(record, f"$.{name}", "variant")
    # An absent path gives SQL NULL, a JSON null gives a VOID variant.
    kind = F.schema_of_variant(value)
    return (
        F.when(value.isNull(), f"Missing required field: {name}")
        .when(kind == "VOID", f"Field is None: {name}")
        .when(kind != "STRING", f"Field is not a string: {name}")
    )


def validate_required(df: DataFrame, json: str, fields: Sequence[str] = REQUIRED) -> DataFrame:
    """First failing field of each JSON record, null when the record is good."""
    parsed = df.withColumn("_v", F.try_parse_json(json))
    return parsed.withColumn("error", F.coalesce(*[json_field_problem(F.col("_v"), f) for f in fields])).drop("_v")


def validate_scored(df: DataFrame, json: str) -> DataFrame:
    """Reason a scored JSON record is refused, null when it is good."""
    v = F.col("_v")
    get = lambda f: F.try_variant_get(v, f"$.{f}", "variant")
    kind = lambda f: F.schema_of_variant(get(f))
    needed = ("repo_full_name", "file_path", "function_name", "requirement", "old_function_code", "ast_delta_similarity")
    missing = F.exists(F.array(*[get(f).isNull() for f in needed]), lambda m: m)
    text = lambda f: (kind(f) == "STRING") & (F.length(t.js_trim(F.try_variant_get(v, f"$.{f}", "string"))) > 0)
    score = F.try_variant_get(v, "$.ast_delta_similarity", "double")
    number = kind("ast_delta_similarity").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    reason = (
        F.when(missing, "missing_required_fields")
        .when(~text("old_function_code"), "invalid_old_function_code")
        .when(~text("requirement"), "invalid_requirement")
        .when(~number, "non_numeric_ast_delta_similarity")
        .when(~score.between(0.0, 1.0), "score_outside_zero_one")
    )
    return df.withColumn("_v", F.try_parse_json(json)).withColumn("reason", reason).drop("_v")


def label_pair_problem(label: Column, label_id: Column, labels: Sequence[str] = ("low", "mid", "high")) -> Column:
    names = F.array(*[F.lit(x) for x in labels])
    known = label_id.between(0, len(labels) - 1)
    return (
        F.when(~F.coalesce(known, F.lit(False)), F.concat(F.lit("invalid label_id "), F.coalesce(label_id.cast("string"), F.lit("None"))))
        .when(~label.eqNullSafe(F.try_element_at(names, label_id.cast("int") + 1)), "label name and ID disagree")
    )


def leak_safe(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Only inference-time inputs, target and plain metadata; texts trimmed except code."""
    trimmed = ("repo_full_name", "file_path", "function_name", "requirement")
    return df.select(*[t.js_trim(F.col(c)).alias(c) if c in trimmed else F.col(c) for c in (*SAFE_COLUMNS, *extra)])


def identity(df: DataFrame) -> Column:
    """Five-part identity with squeezed text and the score at 12 decimals."""
    return F.struct(
        t.js_trim(F.col("repo_full_name")).alias("repo"),
        t.js_trim(F.col("file_path")).alias("path"),
        t.js_trim(F.col("function_name")).alias("name"),
        t.squeeze(F.col("requirement")).alias("requirement"),
        F.round("ast_delta_similarity", 12).alias("score"),
    )


def identity_join(source: DataFrame, manifest: DataFrame) -> DataFrame:
    """Attach the manifest index to each source row; ambiguous and missing identities are named."""
    side = (
        manifest.withColumn("identity", identity(manifest))
        .groupBy("identity")
        .agg(F.count("*").alias("copies"), F.min("source_index").alias("source_index"))
    )
    status = F.when(F.col("copies").isNull(), "missing").when(F.col("copies") > 1, "ambiguous").otherwise("joined")
    return (
        source.withColumn("identity", identity(source))
        .join(side, "identity", "left")
        .withColumn("status", status)
        .drop("identity", "copies")
    )


def prediction_audit(predictions: DataFrame, manifest: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Missing rows, field mismatches and duplicate indexes of predictions against their manifest.

    Both sides are reduced to one row per index by a single aggregation, so a
    repeated index is reported instead of multiplied.
    """
    mark = lambda df, side: df.select(
        "source_index", F.lit(side).alias("side"), F.struct(*[F.col(f) for f in fields]).alias("v")
    )
    both = mark(predictions, "p").unionByName(mark(manifest, "m"))
    p, m = F.col("side") == "p", F.col("side") == "m"
    rows = both.groupBy("source_index").agg(
        F.count_if(p).alias("n_p"),
        F.count_if(m).alias("n_m"),
        F.min(F.when(p, F.col("v"))).alias("p"),
        F.min(F.when(m, F.col("v"))).alias("m"),
    )
    both_sides = (F.col("n_p") > 0) & (F.col("n_m") > 0)
    problems = F.array(
        F.when(F.col("n_m") == 0, "missing in manifest"),
        F.when(F.col("n_p") == 0, "missing in predictions"),
        F.when((F.col("n_p") > 1) | (F.col("n_m") > 1), "duplicate index"),
        *[F.when(both_sides & ~F.col(f"p.{f}").eqNullSafe(F.col(f"m.{f}")), f"mismatch {f}") for f in fields],
    )
    return rows.select("source_index", F.explode(F.array_compact(problems)).alias("problem"))


def correct_predictions(predictions: DataFrame, manifest: DataFrame) -> DataFrame:
    hit = predictions.where(F.col("predicted_label") == F.col("true_label"))
    return hit.join(manifest.select("source_index", "requirement"), "source_index")


def split_overlap(df: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Distinct values, shared values and rows of the right split seen in the left, per key.

    All keys go through one aggregation to (key, value) with a count per split.
    """
    entries = F.array(*[F.struct(F.lit(k).alias("key"), c.cast("string").alias("value")) for k, c in keys.items()])
    per_value = (
        df.select("split", F.inline(entries))
        .groupBy("key", "value")
        .agg(*[F.count_if(F.col("split") == s).alias(s) for s in SPLITS])
    )
    has = lambda s: F.col(s) > 0
    counts = per_value.groupBy("key").agg(
        *[F.count_if(has(s)).alias(f"unique_{s}") for s in SPLITS],
        *[F.count_if(has(a) & has(b)).alias(f"shared_{a}_{b}") for a, b in PAIRS],
        *[F.sum(F.when(has(a), F.col(b)).otherwise(0)).alias(f"rows_{b}_in_{a}") for a, b in PAIRS],
    )
    return counts


def values_in_many(df: DataFrame, key: str, part: str) -> DataFrame:
    """Keys that occur in more than one part (leaking sources, shared identities)."""
    out = df.groupBy(key).agg(F.min(part).alias("first_part"), F.max(part).alias("last_part"), F.count("*").alias("n"))
    return out.where(F.col("first_part") != F.col("last_part"))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def reconcile(expected: DataFrame, batches: DataFrame) -> DataFrame:
    """Duplicate, missing and unexpected ids of merged batches, in one shuffle."""
    tagged = expected.select("id", F.lit(1).alias("e"), F.lit(0).alias("b")).unionByName(
        batches.select("id", F.lit(0).alias("e"), F.lit(1).alias("b"))
    )
    counts = tagged.groupBy("id").agg(F.sum("e").alias("e"), F.sum("b").alias("b"))
    problem = (
        F.when(F.col("e") > 1, "duplicate expected")
        .when(F.col("b") > 1, "duplicate")
        .when(F.col("b") == 0, "missing")
        .when(F.col("e") == 0, "unexpected")
    )
    return counts.withColumn("problem", problem).where(F.col("problem").isNotNull()).select("id", "problem")


def set_digest(df: DataFrame, column: str = "id", width: int = 5) -> DataFrame:
    """SHA-256 of a set of ids: digest of the digests of its hash buckets.

    Ids are made distinct and sorted inside 16**width buckets, so no task ever
    holds the whole set (the last step sees at most one digest per bucket);
    equal sets give equal digests on any cluster.
    """
    value = F.col(column).cast("string")
    ids = df.select(value.alias("v")).distinct().withColumn("bucket", F.substring(F.sha2("v", 256), 1, width))
    per_bucket = ids.groupBy("bucket").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("v")).alias("vs"))
    digests = per_bucket.select("bucket", "n", F.sha2(F.array_join("vs", "\n"), 256).alias("d"))
    return digests.agg(
        F.sum("n").alias("n_ids"),
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "d"))), lambda x: x["d"]), "\n"), 256).alias("digest"),
    )


def first_per_key(df: DataFrame, key: str, position: str) -> DataFrame:
    """Distinct keeping the first row by position, by aggregation (combined before the shuffle)."""
    return df.groupBy(key).agg(F.min_by(F.struct(*df.columns), position).alias("r")).select("r.*")


def upsert_in_order(source: DataFrame, done: DataFrame, fresh: DataFrame) -> DataFrame:
    """Newest result per id, listed with the source position."""
    ranked = done.withColumn("_p", F.lit(0)).unionByName(fresh.withColumn("_p", F.lit(1)))
    newest = ranked.groupBy("id").agg(F.max_by(F.struct(*done.columns), "_p").alias("r")).select("r.*")
    return source.select("id", "position").join(newest, "id")


def pending(source: DataFrame, done: DataFrame, only_success: bool = True) -> DataFrame:
    finished = done.where(F.col("status") == "success") if only_success else done
    return source.join(finished.select("id").distinct(), "id", "left_anti")
