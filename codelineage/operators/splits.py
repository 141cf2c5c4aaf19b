"""Reproducible splits, quotas and samples in SHA-256 order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelineage.functions.ordering import BATCH_TAG, digest_bucket, hash_rank, running_total, stable_digest


def hash_split(df: DataFrame, seed: int, tag: str = "row-split-v1") -> DataFrame:
    """Random 70/10/20 row split: ranks in hash order cut at int(.7 n) and int(.8 n)."""
    ranked = hash_rank(df.withColumn("_digest", stable_digest(tag, seed, F.col("id"))), [], "_digest", "id")
    total = df.agg(F.count("*")).scalar()
    split = (
        F.when(F.col("rank") <= F.floor(total * 7 / 10), "train")
        .when(F.col("rank") <= F.floor(total * 8 / 10), "validation")
        .otherwise("test")
    )
    return ranked.withColumn("split", split).drop("_digest", "rank")


def grouped_split(df: DataFrame, group: str, seed: int, tag: str = "group-split-v1") -> DataFrame:
    """Greedy 70/10/20 split that keeps each group whole; one row per group.

    Groups in hash order fill train until 70 % of the rows are reached, then
    validation until 10 %, then test. A group is one row here whatever its size.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("size")).withColumn("_digest", stable_digest(tag, seed, F.col(group)))
    summed = running_total(sizes, [], digest_bucket(F.col("_digest")), ["_digest", group], F.col("size"), "_upto")
    placed = summed.withColumn("_before", F.col("_upto") - F.col("size")).withColumn("_all", df.agg(F.count("*")).scalar())
    in_train = F.col("_before") < F.col("_all") * 0.7
    # Rows taken by train, known only after the last group that still fits.
    train_rows = placed.where(in_train).agg(F.max("_upto")).scalar()
    split = (
        F.when(in_train, "train")
        .when(F.col("_before") - train_rows < F.col("_all") * 0.1, "validation")
        .otherwise("test")
    )
    return placed.withColumn("split", split).select(group, "size", "split")


def balanced_quotas(available: DataFrame, targets: dict[str, int] | float) -> DataFrame:
    """Spread each split's target over its categories as evenly as capacity allows.

    ``targets`` names a number per split, or a share of what every split has.

    Input (split, category, available): counts of a short list of categories.
    Rounds share what is left equally over the categories with room, the
    remainder one each in name order, until everything is placed. A round
    that does not finish fills at least one category, so there are at most as many rounds as categories.
    """
    if isinstance(targets, dict):
        named = F.create_map(*[x for k, v in targets.items() for x in (F.lit(k), F.lit(v).cast("long"))])
        goal = F.try_element_at(named, F.col("split"))
    else:
        goal = F.floor(F.col("total") * F.lit(targets))
    zero = F.lit(0).cast("long")
    entry = F.struct("category", F.col("available").cast("long").alias("available"), zero.alias("quota"))
    listed = available.groupBy("split").agg(
        F.array_sort(F.collect_list(entry)).alias("cells"), F.sum("available").alias("total")
    )
    start = F.struct("cells", goal.alias("left"))

    def round_(acc: Column, _: Column) -> Column:
        room = F.filter(acc["cells"], lambda x: x["quota"] < x["available"])
        n = F.size(room)
        share = F.floor(F.try_divide(acc["left"], n))
        place = lambda x: F.size(F.filter(room, lambda y: y["category"] < x["category"]))
        asked = lambda x: share + F.when(place(x) < acc["left"] % n, 1).otherwise(0)
        take = lambda x: F.when(x["quota"] < x["available"], F.least(asked(x), x["available"] - x["quota"])).otherwise(zero)
        cells = F.transform(
            acc["cells"],
            lambda x: F.struct(x["category"].alias("category"), x["available"].alias("available"), (x["quota"] + take(x)).alias("quota")),
        )
        total = lambda arr: F.aggregate(arr, zero, lambda a, x: a + x["quota"])
        after = F.struct(cells.alias("cells"), (acc["left"] - (total(cells) - total(acc["cells"]))).alias("left"))
        return F.when((acc["left"] == 0) | (n == 0), acc).otherwise(after)

    rounds = F.sequence(F.lit(0), F.size("cells"))
    filled = listed.select("split", F.aggregate(rounds, start, round_, lambda acc: acc["cells"]).alias("cells"))
    return filled.select("split", F.inline("cells"))


def quota_batch(df: DataFrame, quotas: DataFrame, seed: int, tag: str = BATCH_TAG) -> DataFrame:
    """Flag the first ``quota`` rows per (split, category) in hash order; the rest stay in the remainder."""
    ranked = hash_rank(
        df.withColumn("_digest", stable_digest(tag, seed, F.col("id"))), ["split", "category"], "_digest", "id"
    )
    limits = quotas.select("split", "category", "quota")
    return (
        ranked.join(limits, ["split", "category"], "left")
        .withColumn("selected", F.col("rank") <= F.coalesce("quota", F.lit(0)))
        .drop("_digest", "quota")
    )


def cohort_sample(df: DataFrame, per_split: dict[str, int], seed: int, tag: str = "cohort-sample-v1") -> DataFrame:
    """The first n rows of each split in hash order."""
    limits = F.create_map(*[x for k, v in per_split.items() for x in (F.lit(k), F.lit(v))])
    ranked = hash_rank(df.withColumn("_digest", stable_digest(tag, seed, F.col("id"))), ["split"], "_digest", "id")
    return ranked.where(F.col("rank") <= F.try_element_at(limits, F.col("split"))).drop("_digest")


def permuted(df: DataFrame, seed: int) -> DataFrame:
    """True labels kept, predictions moved to other rows: ranks of two hash orders joined."""
    a = hash_rank(df.withColumn("_d", stable_digest("permute-a", seed, F.col("id"))), [], "_d", "id", "slot")
    b = hash_rank(df.withColumn("_d", stable_digest("permute-b", seed, F.col("id"))), [], "_d", "id", "slot")
    return a.select("slot", "id", "true_label").join(b.select("slot", "predicted_label"), "slot").drop("slot")


def moved_columns(df: DataFrame, columns: list[str], seed: int) -> DataFrame:
    """The same rows with the values of some columns moved to other rows: ranks of two hash orders joined."""
    tag = "+".join(columns)
    a = hash_rank(df.withColumn("_d", stable_digest(f"move-a-{tag}", seed, F.col("id"))), [], "_d", "id", "slot").drop("_d")
    b = hash_rank(df.select("id", *columns).withColumn("_d", stable_digest(f"move-b-{tag}", seed, F.col("id"))), [], "_d", "id", "slot")
    return a.drop(*columns).join(b.select("slot", *columns), "slot").select(*df.columns)
