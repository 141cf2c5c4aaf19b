"""Queries: provenance of lines and blocks, snippets and chat statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelineage.functions import text as t
from codelineage.operators import provenance as p
from codelineage.operators import snippets as sn
from codelineage.operators.reports import order_by_confidence
from codelineage.plans import sqltext as q
from codelineage.plans.base import Registry
from codelineage.sources.tables import code_blocks, messages, table

R = Registry()


def fenced(spark: SparkSession, d: str) -> DataFrame:
    """Messages whose text is wrapped as one fenced code block."""
    return messages(spark, d).withColumn("text", F.concat(F.lit("```\n"), "text", F.lit("\n```")))


def code_chat(spark: SparkSession, d: str) -> DataFrame:
    """Messages around code: users show theirs, the assistant answers with a function and an import."""
    name = F.concat(F.lit("f_"), "conv_id", F.lit("_"), "turn")
    user = F.concat(F.lit("My code:\n```\n"), "text", F.lit("\n```\nimport os\n    indented "), name, F.lit("\n\n\tmore\nend"))
    reply = F.concat(
        F.lit("Use:\n```python\ndef "), name, F.lit("(x):\n    return x\n"), "text",
        F.lit("\n```\nfrom "), name, F.lit(" import run\nimport sys\nconst a = 1;\n"),
    )
    return messages(spark, d).withColumn("text", F.when(F.col("role") == "user", user).otherwise(reply))


CODE_CHAT = """code_chat AS (SELECT conv_id, turn, role, CASE WHEN role = 'user'
  THEN 'My code:' || chr(10) || '```' || chr(10) || text || chr(10) || '```' || chr(10) || 'import os' || chr(10)
       || '    indented f_' || conv_id || '_' || turn || chr(10) || chr(10) || chr(9) || 'more' || chr(10) || 'end'
  ELSE 'Use:' || chr(10) || '```python' || chr(10) || 'def f_' || conv_id || '_' || turn || '(x):' || chr(10)
       || '    return x' || chr(10) || text || chr(10) || '```' || chr(10) || 'from f_' || conv_id || '_' || turn
       || ' import run' || chr(10) || 'import sys' || chr(10) || 'const a = 1;' || chr(10) END AS text
  FROM conversations)"""


@R.add(
    "line_provenance",
    f"WITH {q.PROVENANCE} SELECT conv_id, block, line_no, first_turn, label FROM line_labels",
)
def line_provenance(spark, d):
    return p.line_provenance(code_blocks(spark, d), messages(spark, d))


@R.add(
    "block_matches",
    f"""WITH {q.MATCHES} SELECT b.conv_id, b.block, coalesce(n_exact, 0) AS n_exact,
    coalesce(n_whitespace, 0) AS n_whitespace, coalesce(n_normalized, 0) AS n_normalized,
    coalesce(n_fuzzy, 0) AS n_fuzzy, coalesce(n_matches, 0) AS n_matches, round(best_score, 6) AS best_score,
    first_turn, first_kind
    FROM blocks b LEFT JOIN matched m ON b.conv_id = m.conv_id AND b.block = m.block""",
)
def block_matches(spark, d):
    found = p.match_blocks(code_blocks(spark, d), sn.snippets(fenced(spark, d)))
    return found.select(
        "conv_id", "block", "n_exact", "n_whitespace", "n_normalized", "n_fuzzy", "n_matches",
        F.round("best_score", 6).alias("best_score"),
        F.col("first.turn").alias("first_turn"), F.col("first.kind").alias("first_kind"),
    )


ATTRIBUTED = f"""{q.MATCHES},
prev AS (SELECT conv_id, turn, max(CASE WHEN role = 'user' THEN turn END)
  OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_user_turn
  FROM conversations),
joined AS (
  SELECT b.conv_id, b.block, b.content, m.* EXCLUDE (conv_id, block), l.line_label, p.prev_user_turn, c.text AS prompt
  FROM blocks b LEFT JOIN matched m ON b.conv_id = m.conv_id AND b.block = m.block
  LEFT JOIN block_line_label l ON b.conv_id = l.conv_id AND b.block = l.block
  LEFT JOIN prev p ON p.conv_id = b.conv_id AND p.turn = m.first_turn
  LEFT JOIN conversations c ON c.conv_id = b.conv_id AND c.turn = p.prev_user_turn),
flagged AS (SELECT *, coalesce(first_turn IS NOT NULL AND first_role <> 'user' AND (contains(prompt, content)
    OR contains({q.norm_line('prompt')}, {q.norm_line('content')})
    OR {q.share_of_lines_in('content', 'prompt')} > 0.7), false) AS echoed FROM joined),
attributed AS (SELECT conv_id, block,
  coalesce(line_label, CASE WHEN first_turn IS NULL THEN 'HUMAN_WRITTEN' WHEN first_role = 'user' OR echoed
    THEN 'HUMAN_PROMPT_ORIGIN' ELSE 'LLM_GENERATED' END) AS label,
  round(CASE WHEN first_turn IS NULL THEN 0.95 WHEN echoed THEN 0.9 ELSE greatest(0, least(1, 0.5
    + CASE WHEN first_score >= 90 THEN 0.4 WHEN first_score >= 80 THEN 0.3 WHEN first_score >= 70 THEN 0.2 ELSE 0 END
    + CASE WHEN first_kind IN ('exact', 'whitespace') THEN 0.1 ELSE 0 END
    - CASE WHEN n_matches > 3 THEN 0.05 ELSE 0 END)) END::DOUBLE, 6) AS confidence,
  CASE WHEN echoed THEN prev_user_turn ELSE first_turn END AS first_turn,
  CASE WHEN echoed THEN 'user' ELSE first_role END AS first_role
  FROM flagged)"""


def attributions(spark: SparkSession, d: str) -> DataFrame:
    return p.attribute_blocks(code_blocks(spark, d), sn.snippets(fenced(spark, d)), messages(spark, d))


@R.add("block_labels", f"WITH {ATTRIBUTED} SELECT conv_id, block, label, first_turn, first_role FROM attributed")
def block_labels(spark, d):
    return attributions(spark, d).select("conv_id", "block", "label", "first_turn", "first_role")


@R.add("block_confidence", f"WITH {ATTRIBUTED} SELECT conv_id, block, confidence FROM attributed")
def block_confidence(spark, d):
    return attributions(spark, d).select("conv_id", "block", "confidence")


@R.add(
    "confidence_order",
    f"WITH {ATTRIBUTED} SELECT conv_id, block, row_number() OVER (ORDER BY confidence DESC, conv_id, block) AS place FROM attributed",
)
def confidence_order(spark, d):
    """Attributions in report order: the surest first, ranked in two levels."""
    return order_by_confidence(attributions(spark, d), ["conv_id", "block"]).select("conv_id", "block", "place")


@R.add(
    "prev_user_turn",
    """SELECT conv_id, turn, max(CASE WHEN role = 'user' THEN turn END)
    OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_user_turn
    FROM conversations""",
)
def prev_user_turn(spark, d):
    return p.previous_user_turn(messages(spark, d), chunk=3)


def _block_with_prompt(spark, d):
    """Every block beside the user message before it."""
    msgs = messages(spark, d)
    prev = p.previous_user_turn(msgs).withColumnRenamed("turn", "block")
    prompts = msgs.select("conv_id", F.col("turn").alias("prev_user_turn"), F.col("text").alias("prompt"))
    return code_blocks(spark, d).join(prev, ["conv_id", "block"]).join(prompts, ["conv_id", "prev_user_turn"])


BESIDE = f"""{q.BLOCKS}, prev AS (SELECT conv_id, turn, max(CASE WHEN role = 'user' THEN turn END)
  OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_user_turn
  FROM conversations),
beside AS (SELECT b.conv_id, b.block, b.content, c.text AS prompt, p.prev_user_turn FROM blocks b
  JOIN prev p ON b.conv_id = p.conv_id AND b.block = p.turn
  JOIN conversations c ON c.conv_id = b.conv_id AND c.turn = p.prev_user_turn)"""


@R.add(
    "echo_check",
    f"""WITH {q.BLOCKS} SELECT b.conv_id, b.block, contains(c.text, content)
    OR contains({q.norm_line('c.text')}, {q.norm_line('content')})
    OR coalesce({q.share_of_lines_in('content', 'c.text')} > 0.7, false) AS echoed
    FROM blocks b JOIN conversations c ON b.conv_id = c.conv_id AND b.block = c.turn""",
)
def echo_check(spark, d):
    own = messages(spark, d).select("conv_id", F.col("turn").alias("block"), "text")
    both = code_blocks(spark, d).join(own, ["conv_id", "block"])
    return both.select("conv_id", "block", t.echoed_in(F.col("content"), F.col("text")).alias("echoed"))


@R.add(
    "partial_match",
    f"""WITH {q.BLOCKS} SELECT b.conv_id, b.block,
    contains(content, c.text) OR coalesce({q.share_of_lines_in('c.text', 'content')} > 0.7, false) AS is_partial
    FROM blocks b JOIN conversations c ON b.conv_id = c.conv_id AND b.block = c.turn""",
)
def partial_match(spark, d):
    own = messages(spark, d).select("conv_id", F.col("turn").alias("block"), "text")
    both = code_blocks(spark, d).join(own, ["conv_id", "block"])
    return both.select("conv_id", "block", t.partial_match(F.col("text"), F.col("content")).alias("is_partial"))


@R.add(
    "best_match",
    f"WITH {q.MATCHES} SELECT conv_id, block, round(best_score, 6) AS best_score, n_matches FROM matched",
)
def best_match(spark, d):
    found = p.match_blocks(code_blocks(spark, d), sn.snippets(fenced(spark, d)))
    return found.where(F.col("n_matches") > 0).select(
        "conv_id", "block", F.round("best_score", 6).alias("best_score"), "n_matches"
    )


@R.add(
    "ranked_matches",
    f"""WITH {q.MATCHES}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, block ORDER BY score DESC, turn) AS rank FROM hits)
    SELECT conv_id, block, rank, turn, role, kind, round(score, 6) AS score FROM r WHERE rank <= 3""",
)
def ranked_matches(spark, d):
    """The three best matching snippets of every block."""
    found = p.ranked_matches(code_blocks(spark, d), sn.snippets(fenced(spark, d)), 3)
    return found.select("conv_id", "block", "rank", "turn", "role", "kind", F.round("score", 6).alias("score"))


@R.add(
    "attribution_summary",
    f"""WITH {ATTRIBUTED}, n AS (SELECT label, count(*) AS blocks, avg(confidence) AS c FROM attributed GROUP BY 1),
    labels(label) AS (VALUES ('LLM_GENERATED'), ('HUMAN_PROMPT_ORIGIN'), ('HUMAN_WRITTEN'), ('MIXED'), ('UNCERTAIN'))
    SELECT l.label, coalesce(blocks, 0) AS blocks,
      CASE WHEN (SELECT count(*) FROM attributed) = 0 THEN '0'
      ELSE format('{{:.1f}}', coalesce(blocks, 0) * 100.0 / (SELECT count(*) FROM attributed)) END AS percent,
      round(coalesce(c, 0), 6) AS mean_confidence, (SELECT count(*) FROM attributed) AS total,
      (SELECT round(avg(confidence), 6) FROM attributed) AS average_confidence FROM labels l LEFT JOIN n ON l.label = n.label""",
)
def attribution_summary(spark, d):
    from codelineage.operators.reports import attribution_summary as summary

    return summary(attributions(spark, d))


def _per_message(name: str, column, spark, d):
    return code_chat(spark, d).select("conv_id", "turn", F.array_join(column, "␞").alias(name))


@R.add(
    "code_fences",
    f"""WITH {CODE_CHAT}, f AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '(?s)```(\\w*)\\n?(.*?)```', 1)) AS l,
    unnest(regexp_extract_all(text, '(?s)```(\\w*)\\n?(.*?)```', 2)) AS c FROM code_chat)
    SELECT conv_id, turn, CASE WHEN l = '' THEN 'unknown' ELSE l END AS language, {q.js_trim('c')} AS code
    FROM f WHERE length({q.js_trim('c')}) > 0""",
)
def code_fences(spark, d):
    found = code_chat(spark, d).select("conv_id", "turn", F.explode(sn.code_fences(F.col("text"))).alias("f"))
    return found.select("conv_id", "turn", "f.language", "f.code")


def _kept_sql(x: str) -> str:
    return f"list_distinct(list_filter(list_transform({x}, lambda v: {q.js_trim('v')}), lambda v: length(v) > 0))"


@R.add(
    "inline_code",
    f"""WITH {CODE_CHAT} SELECT conv_id, turn, array_to_string(list_sort({_kept_sql("flatten([" + ", ".join(
        "regexp_extract_all(text, '" + pat.replace("'", "''") + "')" for pat in sn.INLINE) + "])")}), '␞') AS found
    FROM code_chat""",
)
def inline_code(spark, d):
    return _per_message("found", F.array_sort(sn.inline_code(F.col("text"))), spark, d)


@R.add("definitions")
def definitions(spark, d):
    return _per_message("found", sn.definitions(F.col("text")), spark, d)


@R.add(
    "imports",
    f"""WITH {CODE_CHAT} SELECT conv_id, turn, array_to_string(list_sort({_kept_sql(
        "regexp_extract_all(text, '(?m)(?:^|" + chr(92) + "n)(import" + chr(92) + "s+.+|from" + chr(92) + "s+.+"
        + chr(92) + "s+import" + chr(92) + "s+.+)', 1)")}), '␞') AS found FROM code_chat""",
)
def imports(spark, d):
    return _per_message("found", F.array_sort(sn.imports(F.col("text"))), spark, d)


@R.add(
    "context_code",
    f"""WITH {CODE_CHAT}, l AS (SELECT conv_id, turn, unnest({q.lines('text')}) AS line,
      unnest(range(1, len({q.lines('text')}) + 1)) AS n FROM code_chat),
    m AS (SELECT *, regexp_matches(line, '^(\\s{{4,}}|\\t+)\\S') AS ind FROM l),
    ends AS (SELECT *, sum(CASE WHEN NOT ind AND length({q.js_trim('line')}) > 0 THEN 1 ELSE 0 END)
      OVER (PARTITION BY conv_id, turn ORDER BY n) AS run FROM m),
    runs AS (SELECT conv_id, turn, {q.js_trim("string_agg(" + q.js_trim('line') + ", chr(10) ORDER BY n)")} AS code
      FROM ends WHERE ind GROUP BY conv_id, turn, run),
    marked AS (SELECT conv_id, turn, {q.js_trim("regexp_extract(text, '(?is)My code[:" + chr(92) + "s]*```?(.*?)```', 1)")} AS code
      FROM code_chat)
    SELECT conv_id, turn, code FROM runs UNION ALL SELECT conv_id, turn, code FROM marked WHERE code <> ''""",
)
def context_code(spark, d):
    return code_chat(spark, d).select("conv_id", "turn", F.explode(sn.context_code(F.col("text"))).alias("code"))


@R.add("snippets")
def snippets(spark, d):
    return sn.snippets(code_chat(spark, d))


@R.add(
    "conversation_stats",
    f"""WITH {CODE_CHAT}, s AS (SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE role = 'user') AS u,
      count(*) FILTER (WHERE role = 'assistant') AS a FROM conversations GROUP BY 1)
    SELECT c.conv_id, count(*) AS total_messages, count(*) FILTER (WHERE c.role = 'user') AS user_messages,
      count(*) FILTER (WHERE c.role = 'assistant') AS assistant_messages,
      60 * (max(turn) - min(turn)) AS duration_sec,
      any_value(s.n) AS total_snippets, any_value(s.u) AS user_snippets, any_value(s.a) AS assistant_snippets
    FROM conversations c JOIN s ON c.conv_id = s.conv_id GROUP BY 1""",
)
def conversation_stats(spark, d):
    timed = fenced(spark, d).withColumn("ts", F.timestamp_seconds(F.col("turn") * 60))
    return sn.conversation_stats(timed, sn.snippets(timed))
