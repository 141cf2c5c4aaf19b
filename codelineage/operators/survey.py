"""Practitioner surveys as long tables, and game checks on policy choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Likert scale and policy levels in order.
LIKERT = {"Strongly Agree": 1, "Agree": 2, "Disagree": 3, "Strongly Disagree": 4}
LEVELS = ("No", "Partial", "Full")
RHOS = (0.4, 0.5, 0.6)
TOLERANCE = 1e-9


def single_choice(long: DataFrame) -> DataFrame:
    """Count and share per option of each question."""
    counts = long.where(F.length(F.trim("value")) > 0).groupBy("question", F.col("value").alias("option")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy("question"))
    return counts.withColumn("share", F.col("n") / total)


def multi_select(long: DataFrame) -> DataFrame:
    """Non-blank answers per option and their share of all respondents."""
    per_option = long.groupBy("question", "option").agg(
        F.count_if(F.length(F.trim("value")) > 0).alias("n"), F.count("*").alias("respondents")
    )
    return per_option.withColumn("share", F.col("n") / F.col("respondents")).drop("respondents")


def mean_rank(long: DataFrame) -> DataFrame:
    return long.groupBy("question", "option").agg(F.avg(F.col("value").try_cast("double")).alias("mean_rank"))


def likert_mean(long: DataFrame) -> DataFrame:
    scale = F.create_map(*[x for k, v in LIKERT.items() for x in (F.lit(k), F.lit(v))])
    points = F.try_element_at(scale, F.trim("value"))
    return long.groupBy("question", "option").agg(F.avg(points).alias("mean"), F.count(points).alias("answers"))


def policy_level(value: Column) -> Column:
    """"Full Disclosure", "Partial Human Oversight", ... to the level word."""
    return F.regexp_extract(value, r"^(No|Partial|Limited|Full)\b", 1)


def level_shares(choices: DataFrame, keys: list[str], levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """Count and share per level, zero-filled, in one pass."""
    counts = choices.groupBy(*keys).agg(*[F.count_if(F.col("level") == l).alias(f"n_{l.lower()}") for l in levels])
    total = sum((F.col(f"n_{l.lower()}") for l in levels), F.lit(0))
    share = lambda l: F.coalesce(F.try_divide(F.col(f"n_{l.lower()}"), total), F.lit(0.0))
    return counts.withColumns({f"p_{l.lower()}": share(l) for l in levels})


def strategy_profiles(choices: DataFrame) -> DataFrame:
    """Action probabilities of both players per topic: ``dev`` and ``org`` as arrays in level order."""
    shares = level_shares(choices, ["topic", "player"])
    vector = F.array(*[F.col(f"p_{l.lower()}") for l in LEVELS])
    zero = F.array(*[F.lit(0.0)] * len(LEVELS))
    side = lambda p: F.coalesce(F.max(F.when(F.col("player") == p, vector)), zero)
    return shares.groupBy("topic").agg(side("developer").alias("dev"), side("organization").alias("org"))


def payoffs(rho: Column) -> list[list[Column]]:
    """Common payoff matrix: 1 for equal levels, rho for neighbours, 0 for opposite ends."""
    one, zero = F.lit(1.0), F.lit(0.0)
    return [[one, rho, zero], [rho, one, rho], [zero, rho, one]]


def expected_payoffs(profiles: DataFrame, rho: Column) -> DataFrame:
    """Expected payoff of each pure action against the other player's profile."""
    matrix = payoffs(rho)
    size = range(len(LEVELS))
    get = lambda v, j: F.element_at(v, j + 1)
    dev = F.array(*[sum((matrix[i][j] * get("org", j) for j in size), F.lit(0.0)) for i in size])
    org = F.array(*[sum((get("dev", i) * matrix[i][j] for i in size), F.lit(0.0)) for j in size])
    return profiles.withColumns({"dev_payoff": dev, "org_payoff": org})


def _best(payoff: Column) -> Column:
    named = F.arrays_zip(F.array(*[F.lit(l) for l in LEVELS]).alias("level"), payoff.alias("x"))
    top = F.array_max(payoff) - TOLERANCE
    return F.transform(F.filter(named, lambda e: e["x"] >= top), lambda e: e["level"])


def best_responses(payoff: DataFrame) -> DataFrame:
    """Actions within tolerance of the best, and the pairs in which both answer best."""
    out = payoff.withColumns({"dev_best": _best(F.col("dev_payoff")), "org_best": _best(F.col("org_payoff"))})
    pair = lambda a: F.transform("org_best", lambda b: F.concat(F.lit("("), a, F.lit(", "), b, F.lit(")")))
    return out.withColumn("alignments", F.flatten(F.transform("dev_best", pair)))


def _stable(profile: Column, payoff: Column, rtol: float = 1e-5) -> Column:
    """Used actions pay the same (absolute plus relative tolerance), unused ones no better."""
    both = F.arrays_zip(profile.alias("p"), payoff.alias("x"))
    used = F.filter(both, lambda e: e["p"] > TOLERANCE)
    first = F.try_element_at(used, F.lit(1))["x"]
    equal = F.forall(used, lambda e: F.abs(e["x"] - first) <= TOLERANCE + rtol * F.abs(first))
    unused = F.filter(both, lambda e: e["p"] <= TOLERANCE)
    no_better = F.forall(unused, lambda e: e["x"] <= first + TOLERANCE)
    return F.when(F.size(used) == 0, F.lit(False)).otherwise(equal & no_better)


def mixed_check(payoff: DataFrame) -> DataFrame:
    ok = _stable(F.col("dev"), F.col("dev_payoff")) & _stable(F.col("org"), F.col("org_payoff"))
    return payoff.withColumn("is_mixed_equilibrium", ok)


def rho_sweep(profiles: DataFrame, rhos: tuple[float, ...] = RHOS) -> DataFrame:
    """All checks for each neighbour payoff."""
    each = profiles.withColumn("rho", F.explode(F.array(*[F.lit(r) for r in rhos])))
    return mixed_check(best_responses(expected_payoffs(each, F.col("rho"))))


def pure_equilibria(games: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Cells of ``games(game, i, j, a, b)`` that are best for both players."""
    best_a = F.max("a").over(W.partitionBy("game", "j"))
    best_b = F.max("b").over(W.partitionBy("game", "i"))
    marked = games.withColumns({"_a": best_a, "_b": best_b})
    return marked.where((F.col("a") >= F.col("_a") - tolerance) & (F.col("b") >= F.col("_b") - tolerance)).drop("_a", "_b")
