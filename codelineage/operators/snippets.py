"""Code snippets inside chat messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelineage.functions import text as t

# Patterns of fenced code, inline code, definitions, imports and context markers.
FENCE = r"(?s)```(\w*)\n?(.*?)```"
INLINE = (
    r"def\s+\w+\s*\([^)]*\):[^\n]*",
    r"class\s+\w+[^\n]*",
    r"function\s+\w+\s*\([^)]*\)\s*\{[^}]*\}",
    r"const\s+\w+\s*=\s*[^;]+;?",
    r"let\s+\w+\s*=\s*[^;]+;?",
    r"import\s+[^\n]+from\s+['\"][^'\"]+['\"]",
    r"async\s+(?:function|def)\s+[^\n]+",
    r"await\s+[^\n]+",
)
DEFINITION = r"(?s)(?:async\s+)?(?:def|function|class)\s+\w+.*?(?=\n(?:def|function|class|\z))"
IMPORT = r"(?md)(?:^|\n)(import\s+.+|from\s+.+\s+import\s+.+)"
CONTEXT_MARKERS = (
    r"(?is)Current file[:\s]*```?(.*?)```",
    r"(?is)My code[:\s]*```?(.*?)```",
    r"(?is)Here'?s my code[:\s]*```?(.*?)```",
    r"(?sm)^[Cc]ode[:\s]*```?(.*?)```",
)


def _kept(found: Column) -> Column:
    """Trimmed, non-empty, first occurrences only."""
    return F.array_distinct(F.filter(F.transform(found, t.js_trim), lambda x: F.length(x) > 0))


def code_fences(text: Column) -> Column:
    """Array of (language, code) for each fenced block with a body."""
    langs = F.regexp_extract_all(text, F.lit(FENCE), 1)
    codes = F.regexp_extract_all(text, F.lit(FENCE), 2)
    pairs = F.zip_with(
        langs,
        codes,
        lambda l, c: F.struct(F.when(l == "", F.lit("unknown")).otherwise(l).alias("language"), t.js_trim(c).alias("code")),
    )
    return F.filter(pairs, lambda p: F.length(p["code"]) > 0)


def inline_code(text: Column) -> Column:
    return _kept(F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), 0) for p in INLINE])))


def definitions(text: Column) -> Column:
    return _kept(F.regexp_extract_all(text, F.lit(DEFINITION), 0))


def imports(text: Column) -> Column:
    return _kept(F.regexp_extract_all(text, F.lit(IMPORT), 1))


def indented_runs(text: Column) -> Column:
    """Runs of lines indented by four blanks or a tab; blank lines do not end a run.

    A fold finds first and last line of each run, the texts are cut out afterwards.
    """

    def cut(lines: Column) -> Column:
        indented = lambda line: line.rlike(r"^(?:[ \t\n\x0B\f\r]{4,}|\t+)[^ \t\n\x0B\f\r]")
        marks = F.transform(lines, lambda l: F.struct(indented(l).alias("in"), (F.length(t.js_trim(l)) > 0).alias("text")))
        run = lambda acc: F.array(F.struct(acc["first"].alias("first"), acc["last"].alias("last")))
        start = F.struct(
            F.lit(0).alias("i"), F.lit(-1).alias("first"), F.lit(-1).alias("last"), F.expr("cast(array() AS array<struct<first:int,last:int>>)").alias("done")
        )

        def step(acc: Column, m: Column) -> Column:
            closes = ~m["in"] & (acc["first"] >= 0) & m["text"]
            return F.struct(
                (acc["i"] + 1).alias("i"),
                F.when(closes, -1).when(m["in"] & (acc["first"] < 0), acc["i"]).otherwise(acc["first"]).alias("first"),
                F.when(m["in"], acc["i"]).otherwise(acc["last"]).alias("last"),
                F.when(closes, F.concat(acc["done"], run(acc))).otherwise(acc["done"]).alias("done"),
            )

        runs = F.aggregate(marks, start, step, lambda acc: F.when(acc["first"] >= 0, F.concat(acc["done"], run(acc))).otherwise(acc["done"]))
        of = lambda r: F.filter(F.slice(lines, r["first"] + 1, r["last"] - r["first"] + 1), indented)
        return F.transform(runs, lambda r: t.js_trim(F.array_join(F.transform(of(r), t.js_trim), "\n")))

    return t.let(t.split_lines(text), cut)


def context_code(text: Column) -> Column:
    """Code a user shows as context: marked fences, then indented runs."""
    marked = [F.regexp_extract(text, p, 1) for p in CONTEXT_MARKERS]
    return F.concat(_kept(F.array(*marked)), indented_runs(text))


def snippets(messages: DataFrame) -> DataFrame:
    """All snippets in message order: conv_id, turn, snippet_no, role, kind, language, code."""
    none = F.lit(None).cast("string")

    def tagged(kind: str, codes: Column) -> Column:
        return F.transform(
            codes, lambda c: F.struct(F.lit(kind).alias("kind"), none.alias("language"), c.alias("code"))
        )

    text = F.col("text")
    fenced = F.transform(
        code_fences(text),
        lambda p: F.struct(F.lit("fence").alias("kind"), p["language"].alias("language"), p["code"].alias("code")),
    )
    shown = F.when(F.col("role") == "user", context_code(text)).otherwise(F.array().cast("array<string>"))
    parts = F.concat(
        fenced,
        tagged("inline", inline_code(text)),
        tagged("definition", definitions(text)),
        tagged("import", imports(text)),
        tagged("context", shown),
    )
    # The outer form spares the optimizer's "list is not empty" test, which would run every pattern twice.
    listed = messages.select("conv_id", "turn", "role", F.posexplode_outer(parts).alias("snippet_no", "s"))
    return listed.where(F.col("snippet_no").isNotNull()).select(
        "conv_id", "turn", "snippet_no", "role", "s.kind", "s.language", "s.code"
    )


def conversation_stats(messages: DataFrame, found: DataFrame) -> DataFrame:
    """Message and snippet counts by role and the duration in seconds."""
    per_conv = messages.groupBy("conv_id").agg(
        F.count("*").alias("total_messages"),
        F.count_if(F.col("role") == "user").alias("user_messages"),
        F.count_if(F.col("role") == "assistant").alias("assistant_messages"),
        (F.unix_timestamp(F.max_by("ts", "turn")) - F.unix_timestamp(F.min_by("ts", "turn"))).alias("duration_sec"),
    )
    per_snippet = found.groupBy("conv_id").agg(
        F.count("*").alias("total_snippets"),
        F.count_if(F.col("role") == "user").alias("user_snippets"),
        F.count_if(F.col("role") == "assistant").alias("assistant_snippets"),
    )
    return per_conv.join(per_snippet, "conv_id", "left").fillna(
        0, ["total_snippets", "user_snippets", "assistant_snippets"]
    )
