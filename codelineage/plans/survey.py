"""Queries: chat-sourced checks, surveys, games and JSON sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelineage.functions import text as t
from codelineage.operators import chat as ch
from codelineage.operators import snippets as sn
from codelineage.operators import survey as sv
from codelineage.plans.base import Registry
from codelineage.plans.evaluation import SCORED, scored
from codelineage.plans.provenance import code_chat
from codelineage.session import scratch_path
from codelineage.sources import json_files as js
from codelineage.sources.survey_csv import long_from_wide
from codelineage.sources.tables import code_blocks, messages, table

R = Registry()


# --- chat-sourced content ------------------------------------------------------


TEXT = ("conv_id", "block")


def checked_texts(spark, d):
    """The texts checked in each conversation: the edited copies of all its assistant messages."""
    replies = messages(spark, d).where("role = 'assistant'").select("conv_id", F.col("turn").alias("block"))
    return code_blocks(spark, d).join(replies, ["conv_id", "block"]).select("conv_id", "block", "content")


@R.add("assistant_sourced")
def assistant_sourced(spark, d):
    out = ch.assistant_sourced(checked_texts(spark, d), messages(spark, d), TEXT, ch.LONGEST_GAP)
    return out.withColumn("overall_similarity", F.round("overall_similarity", 6))


@R.add("match_dedupe")
def match_dedupe(spark, d):
    matches = ch.sourced_matches(checked_texts(spark, d), code_chat(spark, d), TEXT, ch.LONGEST_SENTENCE, ch.LONGEST_GAP)
    return ch.dedupe_matches(matches, TEXT, ch.LONGEST_GAP).withColumn("similarity", F.round("similarity", 6))


@R.add("best_sentence")
def best_sentence(spark, d):
    replies = messages(spark, d).where("role = 'assistant'").withColumn("sentences", ch.sentence_forms(F.col("text")))
    texts = checked_texts(spark, d).withColumn("form", t.chat_form(F.col("content"), terms=True))
    found = ch.best_sentence(ch.met(texts, replies, "text"), [*TEXT, "turn"], "content", "text", ch.LONGEST_SENTENCE, ch.LONGEST_GAP, forms=("form", "sentences"))
    return found.withColumn("similarity", F.round("similarity", 6))


@R.add("first_appearance")
def first_appearance(spark, d):
    return ch.first_appearance(checked_texts(spark, d), sn.snippets(code_chat(spark, d)), text_keys=TEXT, gap=ch.LONGEST_GAP)


# --- survey ----------------------------------------------------------------------

SEGMENTS = "Which team are you in?"
PRIORITY = "How urgent is a policy?"
RANKED = "Rank the mechanisms"
AGREE = "The policy helps"
CONCERNS = "Which concerns do you have?"


def wide(spark, d):
    """One answer sheet per order; respondents are orders, roles are customer segments."""
    o = table(spark, d, "orders")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"))
    k = F.col("o_orderkey")
    scale = F.array(*[F.lit(x) for x in sv.LIKERT])
    return o.join(c, "o_custkey").select(
        k.alias("respondent"), "segment", F.col("o_orderpriority").alias("priority"),
        *[((k + i) % 8 + 1).cast("string").alias(f"rank_{i}") for i in range(3)],
        *[F.element_at(scale, ((k + i) % 4 + 1).cast("int")).alias(f"agree_{i}") for i in range(2)],
        *[F.when(k % (i + 2) == 0, F.lit(f"Concern {i}")).otherwise("").alias(f"concern_{i}") for i in range(3)],
    )


COLUMNS = {
    "segment": (SEGMENTS, SEGMENTS), "priority": (PRIORITY, PRIORITY),
    **{f"rank_{i}": (RANKED, f"Mechanism {i}") for i in range(3)},
    **{f"agree_{i}": (AGREE, f"Statement {i}") for i in range(2)},
    **{f"concern_{i}": (CONCERNS, f"Concern {i}") for i in range(3)},
}


def long(spark, d):
    return long_from_wide(wide(spark, d), "respondent", COLUMNS)


LIKERT_SQL = "CASE {x} % 4 WHEN 0 THEN 'Strongly Agree' WHEN 1 THEN 'Agree' WHEN 2 THEN 'Disagree' ELSE 'Strongly Disagree' END"
LONG = f"""sheet AS (SELECT o_orderkey AS k, c_mktsegment AS segment, o_orderpriority AS priority FROM orders JOIN customer ON o_custkey = c_custkey),
  long AS (SELECT k AS respondent, '{SEGMENTS}' AS question, '{SEGMENTS}' AS option, segment AS value FROM sheet
    UNION ALL SELECT k, '{PRIORITY}', '{PRIORITY}', priority FROM sheet
    UNION ALL SELECT k, '{RANKED}', 'Mechanism ' || i, '' || ((k + i) % 8 + 1) FROM sheet, range(3) r(i)
    UNION ALL SELECT k, '{AGREE}', 'Statement ' || i, {LIKERT_SQL.format(x='(k + i)')} FROM sheet, range(2) r(i)
    UNION ALL SELECT k, '{CONCERNS}', 'Concern ' || i, CASE WHEN k % (i + 2) = 0 THEN 'Concern ' || i ELSE '' END FROM sheet, range(3) r(i))"""


@R.add("survey_long", f"WITH {LONG} SELECT * FROM long")
def survey_long(spark, d):
    return long(spark, d)


@R.add(
    "survey_single",
    f"""WITH {LONG} SELECT question, value AS option, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY question), 9) AS share
    FROM long WHERE question IN ('{SEGMENTS}', '{PRIORITY}') GROUP BY question, value""",
)
def survey_single(spark, d):
    picked = long(spark, d).where(F.col("question").isin(SEGMENTS, PRIORITY))
    return sv.single_choice(picked).withColumn("share", F.round("share", 9))


@R.add(
    "survey_multi",
    f"""WITH {LONG} SELECT question, option, count(*) FILTER (WHERE value <> '') AS n,
    round(count(*) FILTER (WHERE value <> '')::DOUBLE / count(*), 9) AS share FROM long WHERE question = '{CONCERNS}' GROUP BY 1, 2""",
)
def survey_multi(spark, d):
    return sv.multi_select(long(spark, d).where(F.col("question") == CONCERNS)).withColumn("share", F.round("share", 9))


@R.add(
    "survey_rank",
    f"WITH {LONG} SELECT question, option, round(avg(value::DOUBLE), 9) AS mean_rank FROM long WHERE question = '{RANKED}' GROUP BY 1, 2",
)
def survey_rank(spark, d):
    return sv.mean_rank(long(spark, d).where(F.col("question") == RANKED)).withColumn("mean_rank", F.round("mean_rank", 9))


@R.add(
    "survey_likert",
    f"""WITH {LONG} SELECT question, option, round(avg(CASE value WHEN 'Strongly Agree' THEN 1 WHEN 'Agree' THEN 2 WHEN 'Disagree' THEN 3 ELSE 4 END), 9) AS mean,
    count(*) AS answers FROM long WHERE question = '{AGREE}' GROUP BY 1, 2""",
)
def survey_likert(spark, d):
    return sv.likert_mean(long(spark, d).where(F.col("question") == AGREE)).withColumn("mean", F.round("mean", 9))


# --- policy choices and games -----------------------------------------------------


def choices(spark, d):
    """Policy level chosen per topic and player: line items returned are the developer's, all others the organization's."""
    flag, q = F.col("l_returnflag"), F.col("l_quantity")
    level = F.when(q <= 17, "No Disclosure").when(q <= 34, "Partial Human Oversight").otherwise("Full Disclosure")
    return table(spark, d, "lineitem").select(
        F.concat_ws("-", "l_linestatus", F.month("l_shipdate")).alias("topic"),
        F.when(flag == "R", "developer").otherwise("organization").alias("player"),
        sv.policy_level(level).alias("level"),
    )


CHOICES = """choices AS (SELECT l_linestatus || '-' || month(l_shipdate) AS topic, CASE l_returnflag WHEN 'R' THEN 'developer' ELSE 'organization' END AS player,
    CASE WHEN l_quantity <= 17 THEN 0 WHEN l_quantity <= 34 THEN 1 ELSE 2 END AS level FROM lineitem),
  shares AS (SELECT topic, player, count(*) FILTER (WHERE level = 0) AS n_no, count(*) FILTER (WHERE level = 1) AS n_partial,
    count(*) FILTER (WHERE level = 2) AS n_full, count(*)::DOUBLE AS n FROM choices GROUP BY ALL),
  prof AS (SELECT d.topic, [d.n_no / d.n, d.n_partial / d.n, d.n_full / d.n] AS dev, [o.n_no / o.n, o.n_partial / o.n, o.n_full / o.n] AS org
    FROM shares d JOIN shares o ON d.topic = o.topic AND d.player = 'developer' AND o.player = 'organization'),
  swept AS (SELECT *, [org[1] + rho * org[2], rho * org[1] + org[2] + rho * org[3], rho * org[2] + org[3]] AS dp,
    [dev[1] + rho * dev[2], rho * dev[1] + dev[2] + rho * dev[3], rho * dev[2] + dev[3]] AS op FROM prof, (SELECT unnest([0.4, 0.5, 0.6])::DOUBLE AS rho)),
  marked AS (SELECT *, list_filter([1, 2, 3], lambda i: dp[i] >= list_max(dp) - 1e-9) AS db, list_filter([1, 2, 3], lambda i: op[i] >= list_max(op) - 1e-9) AS ob,
    list_filter([1, 2, 3], lambda i: dev[i] > 1e-9) AS ds, list_filter([1, 2, 3], lambda i: org[i] > 1e-9) AS os FROM swept),
  checks AS (SELECT *, len(list_filter(ds, lambda i: abs(dp[i] - dp[ds[1]]) > 1e-9 + 1e-5 * abs(dp[ds[1]]))) = 0
      AND len(list_filter(os, lambda i: abs(op[i] - op[os[1]]) > 1e-9 + 1e-5 * abs(op[os[1]]))) = 0
      AND len(list_filter([1, 2, 3], lambda i: dev[i] <= 1e-9 AND dp[i] > dp[ds[1]] + 1e-9)) = 0
      AND len(list_filter([1, 2, 3], lambda i: org[i] <= 1e-9 AND op[i] > op[os[1]] + 1e-9)) = 0 AS mixed,
    list_transform(db, lambda i: ['No', 'Partial', 'Full'][i]) AS dn, list_transform(ob, lambda i: ['No', 'Partial', 'Full'][i]) AS onm FROM marked),
  named AS (SELECT *, array_to_string(flatten(list_transform(dn, lambda a: list_transform(onm, lambda b: '(' || a || ', ' || b || ')'))), '; ') AS alignments FROM checks)"""


@R.add(
    "survey_levels",
    f"""WITH {CHOICES} SELECT topic, player, n_no, n_partial, n_full, round(n_no / n, 9) AS p_no, round(n_partial / n, 9) AS p_partial, round(n_full / n, 9) AS p_full FROM shares""",
)
def survey_levels(spark, d):
    out = sv.level_shares(choices(spark, d), ["topic", "player"])
    return out.withColumns({c: F.round(c, 9) for c in ("p_no", "p_partial", "p_full")})


def _vec(column, alias, digits=9):
    return F.array_join(F.transform(column, lambda v: F.format_string("%.6f", v)), " ").alias(alias)


def _vec_sql(column, alias):
    return f"array_to_string(list_transform({column}, lambda v: format('{{:.6f}}', v)), ' ') AS {alias}"


@R.add("strategy_profiles", f"WITH {CHOICES} SELECT topic, {_vec_sql('dev', 'dev')}, {_vec_sql('org', 'org')} FROM prof")
def strategy_profiles(spark, d):
    return sv.strategy_profiles(choices(spark, d)).select("topic", _vec("dev", "dev"), _vec("org", "org"))


@R.add(
    "expected_payoffs",
    f"WITH {CHOICES} SELECT topic, {_vec_sql('dp', 'dev_payoff')}, {_vec_sql('op', 'org_payoff')} FROM swept WHERE rho = 0.5",
)
def expected_payoffs(spark, d):
    out = sv.expected_payoffs(sv.strategy_profiles(choices(spark, d)), F.lit(0.5))
    return out.select("topic", _vec("dev_payoff", "dev_payoff"), _vec("org_payoff", "org_payoff"))


@R.add(
    "best_responses",
    f"WITH {CHOICES} SELECT topic, array_to_string(dn, ', ') AS dev_best, array_to_string(onm, ', ') AS org_best, alignments FROM named WHERE rho = 0.5",
)
def best_responses(spark, d):
    out = sv.best_responses(sv.expected_payoffs(sv.strategy_profiles(choices(spark, d)), F.lit(0.5)))
    join = lambda c, s: F.array_join(c, s).alias(c)
    return out.select("topic", join("dev_best", ", "), join("org_best", ", "), join("alignments", "; "))


@R.add("mixed_nash_check", f"WITH {CHOICES} SELECT topic, mixed AS is_mixed_equilibrium FROM named WHERE rho = 0.5")
def mixed_nash_check(spark, d):
    out = sv.mixed_check(sv.expected_payoffs(sv.strategy_profiles(choices(spark, d)), F.lit(0.5)))
    return out.select("topic", "is_mixed_equilibrium")


@R.add(
    "rho_sweep",
    f"WITH {CHOICES} SELECT rho, topic, alignments, mixed AS is_mixed_equilibrium, {_vec_sql('dp', 'dev_payoff')} FROM named",
)
def rho_sweep(spark, d):
    out = sv.rho_sweep(sv.strategy_profiles(choices(spark, d)))
    return out.select("rho", "topic", F.array_join("alignments", "; ").alias("alignments"), "is_mixed_equilibrium", _vec("dev_payoff", "dev_payoff"))


@R.add(
    "pure_nash",
    """WITH g AS (SELECT l_suppkey AS game, l_linenumber % 3 AS i, CAST(l_quantity AS BIGINT) % 3 AS j, max(l_extendedprice) AS a, max(l_discount) AS b
      FROM lineitem GROUP BY ALL)
    SELECT game, i, j, a, b FROM g QUALIFY a >= max(a) OVER (PARTITION BY game, j) - 1e-12 AND b >= max(b) OVER (PARTITION BY game, i) - 1e-12""",
)
def pure_nash(spark, d):
    games = table(spark, d, "lineitem").groupBy(
        F.col("l_suppkey").alias("game"), (F.col("l_linenumber") % 3).alias("i"), (F.col("l_quantity").cast("bigint") % 3).alias("j")
    ).agg(F.max("l_extendedprice").alias("a"), F.max("l_discount").alias("b"))
    return sv.pure_equilibria(games)


# --- JSON sources --------------------------------------------------------------------


@R.add("json_roundtrip", "SELECT event_id, event_type, value FROM events")
def json_roundtrip(spark, d):
    """Written as records in two steps (overwrite, then append) and read back."""
    ev, path = table(spark, d, "events").select("event_id", "event_type", "value"), scratch_path(spark, "json")
    js.write_json(ev.where("event_id % 2 = 0"), path)
    js.append_json(ev.where("event_id % 2 = 1"), path)
    return spark.read.schema(ev.schema).json(path)


@R.add("json_payload", "SELECT event_id, event_type FROM events")
def json_payload(spark, d):
    """Records wrapped as {"results": [...]}, one document a file and slice of records, then unwrapped; a path that is not there adds none."""
    ev, path = table(spark, d, "events"), scratch_path(spark, "payload")
    part = F.floor(F.col("event_id") / 1000)
    docs = ev.groupBy(part.alias("part")).agg(F.to_json(F.struct(F.collect_list(F.struct("event_id", "event_type")).alias("results"))).alias("value"))
    docs.write.partitionBy("part").text(path)
    record = "event_id bigint, event_type string"
    return js.read_results(spark, path, record).unionByName(js.read_optional(spark, f"{path}-of-no-run", record))


@R.add(
    "split_union",
    f"""WITH {SCORED}, r AS (SELECT id, split, CASE split WHEN 'train' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END AS o,
      row_number() OVER (PARTITION BY split ORDER BY id) - 1 AS position FROM scored)
    SELECT id, split, row_number() OVER (ORDER BY o, position) - 1 AS source_index FROM r""",
)
def split_union(spark, d):
    from codelineage.functions.ordering import range_bucket, running_total

    df = scored(spark, d).select("id", "split")
    placed = running_total(df, ["split"], range_bucket(df, "id"), ["id"], F.lit(1).cast("long"), "position").withColumn("position", F.col("position") - 1)
    parts = {s: placed.where(F.col("split") == s).drop("split") for s in js.SPLITS}
    return js.with_source_index(js.union_splits(parts)).select("id", "split", "source_index")
