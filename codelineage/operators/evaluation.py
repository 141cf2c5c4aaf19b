"""Thresholds, labels, class metrics and reports over scored examples and predictions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelineage.functions.ordering import TIE_TAG, hash_rank, running_total, stable_digest

LABELS = ("low", "mid", "high")

# Reviewed topic names for eight topics.
TOPIC_NAMES = (
    "Function parameters and optional arguments",
    "Documentation and comment language",
    "String formatting and interpolation",
    "Type annotations and docstrings",
    "API, method, and deprecation updates",
    "Code and documentation formatting",
    "File, path, and related error handling",
    "Return values and collection handling",
)


def exact_percentiles(
    df: DataFrame, value: str, at: dict[str, float], low=0.0, high=1.0, buckets: int = 4096
) -> DataFrame:
    """Exact percentiles with linear interpolation, one row, one column per entry of ``at``.

    Values are counted first, so ties are one row, then ranked in two levels;
    ``low``/``high`` (numbers or scalar columns) only place values in buckets.
    """
    low, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    place = F.coalesce(F.try_divide(F.col("v") - low, high - low), F.lit(0.0))
    bucket = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), place)) * buckets)
    ranked = running_total(counts, [], bucket, ["v"], F.col("n"), "upto").withColumn(
        "total", counts.agg(F.sum("n")).scalar()
    )
    picks = []
    for name, q in at.items():
        rank = F.lit(q) * (F.col("total") - 1)
        picks.append(F.min(F.when(F.col("upto") > F.floor(rank), F.col("v"))).alias(f"{name}_lo"))
        picks.append(F.min(F.when(F.col("upto") > F.ceil(rank), F.col("v"))).alias(f"{name}_hi"))
        picks.append(F.max(rank - F.floor(rank)).alias(f"{name}_t"))
    c = F.col
    return ranked.agg(*picks).select(
        *[(c(f"{n}_lo") + (c(f"{n}_hi") - c(f"{n}_lo")) * c(f"{n}_t")).alias(n) for n in at]
    )


def train_thresholds(df: DataFrame, score: str = "score", split: str = "split") -> DataFrame:
    """p33 and p66 of the training scores only (scores lie in [0, 1])."""
    return exact_percentiles(df.where(F.col(split) == "train"), score, {"p33": 0.33, "p66": 0.66})


def percentile_label(score: Column, p33: Column, p66: Column) -> Column:
    return F.when(score <= p33, "low").when(score <= p66, "mid").otherwise("high")


def label_id(label: Column) -> Column:
    return F.when(label == "low", 0).when(label == "mid", 1).when(label == "high", 2)


def assign_labels(df: DataFrame, thresholds: DataFrame, score: str = "score") -> DataFrame:
    both = thresholds.select(F.struct("p33", "p66")).scalar()  # one subquery for both
    named = df.withColumn("label", percentile_label(F.col(score), both["p33"], both["p66"]))
    return named.withColumn("label_id", label_id(F.col("label")))


def tie_cap(df: DataFrame, seed: int, tag: str = TIE_TAG) -> DataFrame:
    """Flag training rows to keep when p33 = p66: at most one top-score row per two below it.

    Input (id, score) of the training split; adds ``kept``.
    """
    raw = exact_percentiles(df, "score", {"p33": 0.33, "p66": 0.66})
    top = df.agg(F.max("score")).scalar()
    flagged = df.withColumn("at_max", F.col("score") == top)
    below = flagged.where(~F.col("at_max")).agg(F.count("*")).scalar()
    tied = raw.select(F.col("p33") == F.col("p66")).scalar()
    # Rank both sides apart: the flag is part of the group, and only top rows use the rank.
    ranked = hash_rank(
        flagged.where(F.col("at_max")).withColumn("_digest", stable_digest(tag, seed, F.col("id"))), [], "_digest", "id"
    )
    keep_top = ranked.withColumn("kept", ~tied | (F.col("rank") <= F.floor(below / 2))).drop("_digest", "rank")
    return keep_top.unionByName(flagged.where(~F.col("at_max")).withColumn("kept", F.lit(True))).drop("at_max")


def zero_filled(df: DataFrame, column: str, values: Sequence[str], count: str = "n") -> DataFrame:
    """Count per listed value in one pass, zeros included."""
    entries = [
        F.struct(F.lit(v).alias(column), F.count_if(F.col(column) == v).alias(count)) for v in values
    ]
    return df.agg(F.array(*entries).alias("e")).select(F.inline("e"))


def confusion_matrix(df: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    t, p = F.col("true_label"), F.col("predicted_label")
    cells = [
        F.struct(
            F.lit(a).alias("true_label"), F.lit(b).alias("predicted_label"), F.count_if((t == a) & (p == b)).alias("n")
        )
        for a in labels
        for b in labels
    ]
    return df.agg(F.array(*cells).alias("c")).select(F.inline("c"))


def classification_report(
    df: DataFrame,
    groups: Sequence[str] = (),
    labels: Sequence[str] = LABELS,
    span_all: bool = False,
    weight: str | None = None,
    extra: Sequence[Column] = (),
) -> DataFrame:
    """Accuracy, balanced accuracy, macro and weighted scores and per-class columns.

    Rows are first counted by truth and prediction, so a group of any size
    is reduced before the shuffle. Macro averages span the classes present in
    truth or prediction, or all of them with ``span_all``; balanced accuracy
    spans the classes present in truth. Every 0/0 is 0.
    """
    if not extra:  # each label is worked out once per row; what follows sees a few cells per group
        each = F.sum(weight) if weight else F.count("*")
        df, weight = df.groupBy(*groups, "true_label", "predicted_label").agg(each.alias("_cell")), "_cell"
    t, p = F.col("true_label"), F.col("predicted_label")
    w = F.col(weight) if weight else F.lit(1)
    count = lambda cond: F.coalesce(F.sum(F.when(cond, w)), F.lit(0))
    aggs = [F.sum(w).alias("n"), count(t == p).alias("_right")]
    for l in labels:
        aggs += [count((t == l) & (p == l)).alias(f"_tp_{l}"), count(t == l).alias(f"_sup_{l}")]
        aggs += [count(p == l).alias(f"_prd_{l}")]
    out = df.groupBy(*groups).agg(*aggs, *extra)
    c = F.col
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    for l in labels:
        out = out.withColumns(
            {
                f"{l}_precision": ratio(c(f"_tp_{l}"), c(f"_prd_{l}")),
                f"{l}_recall": ratio(c(f"_tp_{l}"), c(f"_sup_{l}")),
                f"{l}_f1": ratio(2.0 * c(f"_tp_{l}"), c(f"_prd_{l}") + c(f"_sup_{l}")),
                f"{l}_support": c(f"_sup_{l}"),
            }
        )
    present = {l: F.lit(True) if span_all else (c(f"_sup_{l}") + c(f"_prd_{l}") > 0) for l in labels}
    in_truth = {l: c(f"_sup_{l}") > 0 for l in labels}

    def mean(metric: str, flags: dict[str, Column]) -> Column:
        total = sum((F.when(flags[l], c(f"{l}_{metric}")).otherwise(0.0) for l in labels), F.lit(0.0))
        return ratio(total, sum((flags[l].cast("int") for l in labels), F.lit(0)))

    weighted = sum((c(f"{l}_f1") * c(f"_sup_{l}") for l in labels), F.lit(0.0))
    out = out.withColumns(
        {
            "accuracy": ratio(c("_right"), c("n")),
            "balanced_accuracy": mean("recall", in_truth),
            "macro_precision": mean("precision", present),
            "macro_recall": mean("recall", present),
            "macro_f1": mean("f1", present),
            "weighted_f1": ratio(weighted, c("n")),
        }
    )
    return out.drop(*[x for x in out.columns if x.startswith("_")])


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Round every double column, for comparison between engines."""
    return df.select(*[F.round(n, digits).alias(n) if k == "double" else F.col(n) for n, k in df.dtypes])


def external_report(df: DataFrame, thresholds: DataFrame, field: str, score: str = "score") -> DataFrame:
    """Report per group of outside examples, labelled with saved training thresholds; a missing group is "unknown"."""
    named = assign_labels(df, thresholds, score).withColumnRenamed("label", "true_label")
    return classification_report(named.fillna({field: "unknown"}), [field])


def topic_report(df: DataFrame, min_support: int = 30, labels: Sequence[str] = LABELS) -> DataFrame:
    """Per-topic metrics over all labels, majority baseline and over-trust rates."""
    t, p = F.col("true_label"), F.col("predicted_label")
    extra = [
        F.count_if(t != "high").alias("non_high"),
        F.count_if((t != "high") & (p == "high")).alias("false_high"),
        F.count_if((t == "low") & (p == "high")).alias("low_to_high"),
        F.avg("strength").alias("mean_assignment_strength"),
    ]
    out = classification_report(df, ["topic_id"], labels, span_all=True, extra=extra)
    c = F.col
    names = F.create_map(*[x for i, n in enumerate(TOPIC_NAMES) for x in (F.lit(i), F.lit(n))])
    unnamed = F.format_string("Topic %d (manual name not assigned)", c("topic_id"))
    return out.withColumns(
        {
            "topic_name": F.coalesce(F.try_element_at(names, c("topic_id").cast("int")), unnamed),
            "minimum_support_met": c("n") >= min_support,
            "majority_baseline_accuracy": F.greatest(*[c(f"{l}_support") for l in labels]) / c("n"),
            "false_high_rate": F.try_divide(c("false_high"), c("non_high")),
            "low_to_high_rate": F.try_divide(c("low_to_high"), c("low_support")),
        }
    ).drop("non_high", "false_high", "low_to_high")


def bootstrap_macro_f1(df: DataFrame, samples: int = 2000, seed: int = 42, labels: Sequence[str] = LABELS) -> DataFrame:
    """95 % interval of macro F1 by resampling examples.

    Resampling N examples with replacement is a multinomial draw over the
    confusion cells, so only the cell counts are resampled, however many
    examples there are.
    """
    size = len(labels)
    cells = confusion_matrix(df, labels).agg(
        F.array_sort(F.collect_list(F.struct("true_label", "predicted_label", "n"))).alias("cells")
    )
    replicate = cells.select("cells.n", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("b"))

    @F.pandas_udf("array<bigint>")
    def draw(n: pd.Series, b: pd.Series) -> pd.Series:
        def one(counts, i):
            counts = np.asarray(counts, dtype=np.int64)
            rng = np.random.default_rng([seed, int(i)])
            return rng.multinomial(counts.sum(), counts / counts.sum())

        return pd.Series([one(c, i) for c, i in zip(n, b)])

    drawn = replicate.select(draw("n", "b").alias("m"))
    cell = lambda i, j: F.element_at("m", i * size + j + 1)
    f1 = []
    for i in range(size):
        both = sum((cell(i, j) + cell(j, i) for j in range(size)), F.lit(0))
        f1.append(F.coalesce(F.try_divide(2.0 * cell(i, i), both), F.lit(0.0)))
    scores = drawn.select((sum(f1, F.lit(0.0)) / size).alias("score"))
    bounds = scores.agg(F.percentile("score", [0.025, 0.975]).alias("p"))
    return bounds.select(
        F.lit(samples).alias("samples"), F.element_at("p", 1).alias("lower_95"), F.element_at("p", 2).alias("upper_95")
    )


def metric_summary(df: DataFrame, metrics: Sequence[str], failed: Column) -> DataFrame:
    """Average, minimum and maximum per metric over processed rows; 0.0 when there are none."""
    value = lambda m: F.when(~failed, F.col(m).cast("double"))
    entries = [
        F.struct(
            F.lit(m).alias("metric"),
            F.coalesce(F.avg(value(m)), F.lit(0.0)).alias("average"),
            F.coalesce(F.min(value(m)), F.lit(0.0)).alias("minimum"),
            F.coalesce(F.max(value(m)), F.lit(0.0)).alias("maximum"),
        )
        for m in metrics
    ]
    one = df.agg(
        F.count("*").alias("total_examples"), F.count_if(~failed).alias("processed_examples"),
        F.count_if(failed).alias("skipped_examples"), F.array(*entries).alias("e"),
    )
    return one.select("total_examples", "processed_examples", "skipped_examples", F.inline("e"))


def size_audit(df: DataFrame, size: str, max_length: int) -> DataFrame:
    """Minimum, median, p95, p99, maximum and rows over a limit."""
    low, high = df.agg(F.min(size).cast("double")).scalar(), df.agg(F.max(size).cast("double")).scalar()
    at = {"minimum": 0.0, "median": 0.5, "p95": 0.95, "p99": 0.99, "maximum": 1.0}
    over = df.agg(F.count_if(F.col(size) > max_length)).scalar()
    return exact_percentiles(df, size, at, low, high).withColumn("truncated_examples", over)


def expectation_check(actual: DataFrame, expected: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Named metrics against expected values within an absolute tolerance."""
    return expected.join(actual, "metric", "left").withColumn(
        "ok", F.coalesce(F.abs(F.col("actual") - F.col("expected")) <= tolerance, F.lit(False))
    )


def prediction_rows(df: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """Label ids to names and a label -> probability map."""
    name = lambda c: F.element_at(F.array(*[F.lit(l) for l in labels]), F.col(c) + 1)
    return df.withColumns(
        {
            "true_label": name("true_id"),
            "predicted_label": name("predicted_id"),
            "probabilities": F.map_from_arrays(F.array(*[F.lit(l) for l in labels]), F.col("probability")),
        }
    )
