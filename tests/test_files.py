"""Diffs, blocks, sections, tags and logs on small files."""

import json
import re
import random

from pyspark.sql import functions as F

from codelineage.functions import text as t
from codelineage.operators import files as f, reports


def one(spark, fn, *args):
    df = spark.createDataFrame([tuple(args)], ", ".join(f"c{i} string" for i in range(len(args))))
    return df.select(fn(*[F.col(f"c{i}") for i in range(len(args))])).first()[0]


def test_positional_diff_has_no_alignment(spark):
    assert one(spark, f.positional_diff, "a\nb\n", "x\na\nb\n") == (
        "--- a/file\n+++ b/file\n@@ -1,3 +1,4 @@\n-a\n+x\n-b\n+a\n+b\n \n"
    )


def test_diff_lines_numbers_counts_and_lost_lines(spark):
    diff = "--- a\n+++ b\n@@ -5 +7,0 @@ tail\n ctx\n-old\n+new\n+++lost\n@@ -20,2 +30,2 @@\n+x\n y"
    df = spark.createDataFrame([(1, diff)], "id int, diff string")
    got = [(r.hunk, r.kind, r.content, r.old_no, r.new_no) for r in f.diff_lines(df, "id", "diff").orderBy("pos").collect()]
    assert got == [
        (1, "context", "ctx", 5, 7), (1, "remove", "old", 6, None), (1, "add", "new", None, 8),
        (2, "add", "x", None, 30), (2, "context", "y", 20, 31),
    ]
    texts = {r.hunk: (r.added, r.modified, r.start.old_count, r.start.new_count) for r in f.hunk_texts(f.diff_lines(df, "id", "diff"), "id").collect()}
    assert texts == {1: ("new", "C ctx\nR old\nA new", 1, 1), 2: ("x", "A x\nC y", 2, 2)}


SOURCE = """import os
# @Authorship: human | timestamp=2024-01-01

def top(a):
    def inner():
        pass
    return inner
class K:
    def m(self):
        pass
    # note
const x = 1
tail()"""


def test_function_blocks_skip_nested(spark):
    df = spark.createDataFrame([("a/b.py", SOURCE)], "path string, content string")
    got = [(r.function_name, r.start_line, r.end_line, r.has_tag, r.language) for r in f.function_blocks(df).orderBy("start_line").collect()]
    assert got == [("top", 3, 6, True, "python"), ("K", 7, 10, False, "python"), ("x", 11, 12, False, "python")]


def test_hunk_falls_back_when_the_header_is_late(spark):
    files = spark.createDataFrame([(1, "a\nb\nc\ndef f():\n    pass"), (2, "def g():\n    pass")], "id int, content string")
    diffs = files.select("id", f.positional_diff(F.lit(""), F.col("content")).alias("diff"))
    got = {r.id: (r.function_name, r.start_line, r.end_line) for r in f.hunk_blocks(files, f.hunk_texts(f.diff_lines(diffs, "id", "diff"), "id"), "id").collect()}
    assert got == {1: ("HunkAt1", 1, 5), 2: ("g", 0, 1)}


def test_containing_function_looks_back_fifty_lines(spark):
    lines = "def far():\n" + "\n".join("x" for _ in range(60))
    df = spark.createDataFrame([(lines,)], "c string").select(t.split_lines("c").alias("l"))
    at = lambda n, back: f.containing_function(F.col("l"), F.lit(n), back)["name"].alias(f"n{n}")
    assert tuple(df.select(*[at(n, 50) for n in (0, 50, 51)]).first()) == ("far", "far", None)
    assert tuple(df.select(*[at(n, None) for n in (0, 50, 60)]).first()) == ("far", "far", "far")
    owners = df.withColumn("s", f.header_spans(F.col("l"))).select(f.line_owners(F.col("l"), F.col("s"), 50)).first()[0]
    assert [o and o["name"] for o in owners] == ["far"] * 51 + [None] * 10


def plain_spans(lines):
    heads = [(i, len(l) - len(l.lstrip()), l) for i, l in enumerate(lines) if re.match(r"\s*(def|class) ", l)]
    return [(i, next((j - 1 for j, other, _ in heads if j > i and other <= indent), len(lines) - 1)) for i, indent, _ in heads]


def test_extents_of_a_long_file(spark):
    rng = random.Random(6)
    lines = [" " * (2 * rng.randrange(6)) + rng.choice(["def f():", "class K:", "x = 1", "", "y"]) for _ in range(6000)]
    df = spark.createDataFrame([("a.py", "\n".join(lines))], "path string, content string")
    got = [(s["start"], s["end"]) for s in df.select(f.header_spans(t.split_lines("content"))).first()[0]]
    want = plain_spans(lines)
    assert got == want
    outer, upto = [], -1
    for start, end in want:
        if start > upto:
            outer.append((start, end, "\n".join(lines[start : end + 1])))
            upto = end
    assert [(r.start_line, r.end_line, r.block) for r in f.function_blocks(df).orderBy("start_line").collect()] == outer
    cut = df.select(f.sections(F.col("content"))).first()[0]
    assert "".join(cut) == "\n".join(lines) + "\n" and len(cut) > 1000
    assert sum(map(len, df.select(f.segments(F.col("content"))).first()[0])) > 10_000


def test_sections_and_segments(spark):
    assert one(spark, f.sections, "a = 1\ndef f():\n  x\nclass K:\n  y") == ["a = 1\n", "def f():\n  x\n", "class K:\n  y\n"]
    code = "import something\ndef f(a):\n    return a\n\nrun_it_now(1)\nshort\nconst g = (x) => x + 100"
    assert one(spark, f.segments, code) == ["import something", "def f(a):\n    return a", "run_it_now(1)", "const g = (x) => x + 100"]


def test_line_ranges(spark):
    df = spark.createDataFrame([([9, 1, 2, 3, 5, 6, 2],), ([],)], "n array<int>")
    assert [r[0] for r in df.select(f.line_ranges(F.col("n"))).collect()] == ["1-3,5-6,9", ""]


def test_name_and_language(spark):
    assert [one(spark, f.function_name, x) for x in ("async def a(b):", "function go()", "export const z = 1", "class Q:", "public int x")] == ["a", "go", "z", "Q", "Unknown"]
    assert [one(spark, f.language_of, x) for x in ("a/b.TSX", "x.tar.gz", "Makefile", "q.rs")] == ["typescript", "unknown", "unknown", "rust"]


def test_tag_parse_and_signature(spark):
    df = spark.createDataFrame([("# [AUTHORSHIP: MIXED] | origin=chat | timestamp=2024-01-02",), ("x = 1",)], "c string")
    a, b = [r[0] for r in df.select(f.parse_tag(F.col("c"))).collect()]
    assert (a.label, a.origin, a.timestamp, b) == ("MIXED", "chat", "2024-01-02", None)
    assert one(spark, f.tag_signature, "# @authorship: human - file lines 1-2 | timestamp=1") == "human - file lines 1-2"


def test_detailed_tag(spark):
    df = spark.createDataFrame([("python", "MIXED", 0.855, "r" * 80)], "l string, b string, c double, r string")
    text = df.select(f.detailed_tag(F.col("l"), F.col("b"), F.col("c"), F.col("r"), F.lit("2024-05-06").cast("timestamp"))).first()[0]
    assert text == f'# [AUTHORSHIP: MIXED] | confidence=86% | reason="{"r" * 60}..." | timestamp=2024-05-06'


def test_line_delta_counts_copies(spark):
    df = spark.createDataFrame([(1, "a\na\nb", "a\nb\nc\n")], "id int, old string, new string")
    assert f.line_delta(df, "id", "old", "new").first().delta == "- a\n+ c\n+ "


def test_commit_log_is_one_document_and_keeps_flaws(spark):
    rows = [("c1", f"f{i}.py", "fn", 0, 4, "MIXED", 0.5, "why", None, None, 0) for i in range(5)]
    schema = "commit string, file_path string, function_name string, start_line int, end_line int, label string, confidence double, reason string, first_turn bigint, first_role string, n_matches bigint"
    df = spark.createDataFrame(rows, schema)
    logs = sorted(reports.commit_log(df).collect(), key=lambda r: r.line_no)
    assert [r.line_no for r in logs] == list(range(6))
    entries = [json.loads(r.line) for r in logs[1:]]
    assert len(entries) == 5 and {e["commitHash"] for e in entries} == {f"f{i}.py" for i in range(5)}
    assert {e["commit"] for e in entries} == {"c1"} and {e["firstMatchSource"] for e in entries} == {"not_found"}
    head = json.loads(logs[0].line)
    assert head["statistics"]["total_new_lines"] == 20 and head["statistics"]["total_new_lines_inclusive"] == 25
    assert head["statistics"]["mixed"] == 5 and head["statistics"]["uncertain"] == 0


def test_attr_csv_has_all_eight_columns(spark, tmp_path):
    from codelineage.plans.files import attr_csv

    said = [(0, "user", "total = price + tax"), (2, "assistant", "total = price + tax"), (4, "assistant", "def load(path): return path")]
    rows = [(3, turn, role, text) for turn, role, text in said] + [(4, 3, "user", "one"), (5, 1, "assistant", "rows = merge(left, right)")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    out = attr_csv(spark, str(tmp_path))
    assert out.columns == ["file_path", "function_name", "line_range", "label", "confidence", "first_appearance", "source_role", "reasoning"]
    reasons = {(r.file_path, r.first_appearance): r.reasoning for r in out.collect()}
    assert reasons["src/m2.py", "Message 0"] == '"first seen in user message 0"'
    assert reasons["src/m4.py", "Message 4"] == '"first seen in assistant message 4"'
    assert all(x[0] == x[-1] == '"' for x in reasons.values()) and len(reasons) == 5


def test_tag_line_numbers_count_the_new_tag(spark):
    blocks = spark.createDataFrame(
        [("a", "python", 4, False, "MIXED"), ("b", "sql", 4, True, "MIXED"), ("c", "go", 0, False, "HUMAN_WRITTEN")],
        "id string, language string, start_line int, has_tag boolean, label string",
    ).withColumn("day", F.lit("2024-05-06").cast("timestamp"))
    lines = spark.createDataFrame(
        [(i, n, l) for i in "ab" for n, l in ((1, "LLM_GENERATED"), (2, "LLM_GENERATED"), (3, "HUMAN_WRITTEN"), (5, "HUMAN_PROMPT_ORIGIN"))],
        "id string, line_no int, label string",
    )
    got = {r.id: r.tag for r in f.block_tags(blocks, lines, ["id"]).collect()}
    assert got == {
        "a": "# @Authorship: human - file lines 8,10; llm - file lines 6-7 | timestamp=2024-05-06",
        "b": "-- @Authorship: human - file lines 7,9; llm - file lines 5-6 | timestamp=2024-05-06",
        "c": "// @Authorship: HUMAN_WRITTEN | timestamp=2024-05-06",
    }
