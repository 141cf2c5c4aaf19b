"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document. The ledger keeps the measurements and
one bit per failed rule; policies are versioned masks over these bits, so that a
new policy, or the effect of leaving a rule out, needs no second look at the text.

Null and empty texts have no words and fail the rules on length; null measurements
do not occur. Equal rows are measured alike and all kept. An empty table gives an
empty ledger. Columns named like a measurement or ``failed_bits`` are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelineage.llm.common import let, word_array

WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"
MEASUREMENTS = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_adjacent_repeats", "n_upper",
)


@dataclass(frozen=True)
class Rule:
    """A document fails the rule where ``fails`` (SQL over the measurements) holds."""

    bit: int
    name: str
    fails: str


@dataclass(frozen=True)
class Policy:
    """A versioned choice of rules; a document is kept if it fails none of them."""

    version: str
    rules: tuple[str, ...]


RULES = (
    Rule(0, "few_words", "n_words < 20"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 8 * word_chars"),
    Rule(3, "repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule(4, "capitals", "100 * n_upper > 50 * word_chars"),
    Rule(5, "stuttering", "100 * n_adjacent_repeats > 40 * n_words"),
    Rule(6, "long_words", "word_chars > 20 * n_words"),
)
BASE = Policy("base-1", ("few_words", "repeated_windows"))
FULL = Policy("full-1", tuple(r.name for r in RULES))


def mask(policy: Policy, rules: tuple[Rule, ...] = RULES) -> int:
    bits = {r.name: 1 << r.bit for r in rules}
    return sum(bits[name] for name in policy.rules)


def _repeat_words(hashes: Column) -> Column:
    """Words inside windows whose hash occurs twice or more; neighbours in sorted order show the repeats."""
    by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))

    def starts(s: Column) -> Column:
        same = lambda j, k: F.coalesce(F.get(s, j)["h"] == F.get(s, k)["h"], F.lit(False))
        hits = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: same(j, j - 1) | same(j, j + 1))
        return F.sort_array(F.transform(hits, lambda j: F.get(s, j)["at"]))

    def covered(p: Column) -> Column:
        step = lambda j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - F.get(p, j), F.lit(WINDOW)))
        return F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), F.lit(0), lambda total, j: total + step(j))

    return let(let(by_hash, starts), covered)


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """The measurements of every text, beside the other columns.

    Windows are compared by their 64-bit hash inside one document: two different
    windows of a text of n words agree with a chance of about n * n / 2**65.
    """
    kept = df.drop(*[m for m in MEASUREMENTS if m != text])
    value = F.coalesce(F.col(text), F.lit(""))
    words = kept.withColumn("_words", word_array(F.col(text))).withColumn(
        "_lines", F.filter(F.split(value, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    )
    n = F.size("_words")
    hashed = words.withColumn(
        "_windows",
        F.when(
            n >= WINDOW,
            F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_words", i, WINDOW))),
        ),
    )
    repeated = F.size(F.array_distinct("_windows")) < F.size("_windows")
    upper = F.length(value) - F.length(F.regexp_replace(value, r"\p{Lu}+", ""))
    symbols = F.length(value) - F.length(F.regexp_replace(value, SYMBOLS + "+", ""))
    repeats = F.size(F.filter("_words", lambda w, i: w == F.get("_words", i - 1)))
    found = {
        "n_words": n,
        "word_chars": F.length(F.array_join("_words", "")),
        "n_symbols": symbols,
        "n_lines": F.size("_lines"),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": F.when(repeated, _repeat_words(F.col("_windows"))).otherwise(0),
        "n_adjacent_repeats": repeats,
        "n_upper": upper,
    }
    return hashed.withColumns({k: v.cast("long") for k, v in found.items()}).drop("_words", "_lines", "_windows")


def ledger(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measurements and ``failed_bits`` of every document."""
    bits = F.lit(0).cast("long")
    for rule in rules:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), 1 << rule.bit).otherwise(0).cast("long"))
    return measure(df, text).withColumn("failed_bits", bits)


def passes(policy: Policy, rules: tuple[Rule, ...] = RULES) -> Column:
    """True where no rule of the policy failed."""
    return F.col("failed_bits").bitwiseAND(F.lit(mask(policy, rules)).cast("long")) == 0


def ablation(entries: DataFrame, policies: list[Policy], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each policy and rule: documents failing it, rejected by it alone, and kept without it.

    The ledger is first counted by its bits (at most 2 ** rules rows), so the
    number of policies does not change what is shuffled.
    """
    by_bits = entries.groupBy("failed_bits").count()
    each = [
        F.struct(
            F.lit(p.version).alias("version"), F.lit(r.name).alias("rule"),
            F.lit(1 << r.bit).cast("long").alias("bit"), F.lit(mask(p, rules)).cast("long").alias("mask"),
        )
        for p in policies for r in rules if r.name in p.rules
    ]
    rows = by_bits.select("failed_bits", "count", F.explode(F.array(*each)).alias("e")).select("failed_bits", "count", "e.*")
    failed = F.col("failed_bits").bitwiseAND(F.col("mask"))
    rest = failed.bitwiseAND(F.bitwise_not("bit"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("count"))), F.lit(0).cast("long"))
    return rows.groupBy("version", "rule").agg(
        total(failed.bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        total(failed == F.col("bit")).alias("n_only"),
        total(failed == 0).alias("n_kept"),
        total(rest == 0).alias("n_kept_without"),
    )
