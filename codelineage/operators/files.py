"""Source files as rows: diffs, function blocks, headers, authorship tags.

A file is one row; its lines are worked on with array expressions inside the
row, so no shuffle is needed. Only the unified-diff parser explodes lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codelineage.functions import text as t

# Header patterns, languages by extension, comment prefix by language, tag patterns.
HEADER = r"^\s*(async\s+)?(def|function|class|const|let|var|public|private|protected)\s+\w+"
LIKELY_HEADER = (
    r"(?i)^\s*(def|class|function|async\s+def|async\s+function|public\s+|private\s+|protected\s+"
    r"|const\s+\w+\s*=\s*\(|let\s+\w+\s*=\s*\(|var\s+\w+\s*=\s*\()"
)
SECTION = r"^\s*(def|function|class|async)\s+"
LANGUAGES = {
    "py": "python", "js": "javascript", "ts": "typescript", "jsx": "javascript", "tsx": "typescript",
    "java": "java", "c": "c", "cpp": "cpp", "cs": "csharp", "go": "go", "rs": "rust", "rb": "ruby",
    "php": "php", "sh": "bash",
}
COMMENTS = {
    "python": "#", "javascript": "//", "typescript": "//", "java": "//", "c": "//", "cpp": "//", "csharp": "//",
    "go": "//", "rust": "//", "php": "//", "ruby": "#", "shell": "#", "bash": "#", "yaml": "#", "toml": "#",
    "sql": "--", "haskell": "--", "lua": "--",
}
TAG = r"(?i)(\[AUTHORSHIP:\s*(LLM_GENERATED|HUMAN_PROMPT_ORIGIN|HUMAN_WRITTEN|MIXED|UNCERTAIN)\])|(@Authorship:)"
HUNK = r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@(.*)"


def _lookup(key: Column, table: dict[str, str], default: str) -> Column:
    entries = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(entries, key), F.lit(default))


def language_of(path: Column) -> Column:
    return _lookup(F.lower(F.element_at(F.split(path, r"\."), -1)), LANGUAGES, "unknown")


def comment_prefix(language: Column) -> Column:
    return _lookup(language, COMMENTS, "//")


def is_header(line: Column) -> Column:
    return line.rlike(HEADER)


def function_name(line: Column) -> Column:
    found = [
        F.regexp_extract(line, r"def\s+(\w+)", 1),
        F.regexp_extract(line, r"function\s+(\w+)|(?:const|let|var)\s+\w+", 1),
        F.regexp_extract(line, r"(?:const|let|var)\s+(\w+)", 1),
        F.regexp_extract(line, r"class\s+(\w+)", 1),
    ]
    return F.coalesce(*[F.when(x != "", x) for x in found], F.lit("Unknown"))


def indent_of(line: Column) -> Column:
    return F.length(F.regexp_extract(line, r"^\s*", 0))


def positional_diff(old: Column, new: Column) -> Column:
    """Unified diff that compares line i with line i; blank lines give no +/- entry."""
    a, b = t.split_lines(old), t.split_lines(new)

    def entry(x: Column, y: Column) -> Column:
        x, y = F.coalesce(x, F.lit("")), F.coalesce(y, F.lit(""))
        minus = F.when(x != "", F.concat(F.lit("-"), x, F.lit("\n"))).otherwise("")
        plus = F.when(y != "", F.concat(F.lit("+"), y, F.lit("\n"))).otherwise("")
        return F.when(x == y, F.concat(F.lit(" "), x, F.lit("\n"))).otherwise(F.concat(minus, plus))

    head = F.format_string("--- a/file\n+++ b/file\n@@ -1,%d +1,%d @@\n", F.size(a), F.size(b))
    return F.concat(head, F.array_join(F.zip_with(a, b, entry), ""))


def diff_lines(df: DataFrame, key: str, diff: str) -> DataFrame:
    """Lines of unified diffs with their hunk, kind and old / new line numbers.

    A ``+++`` or ``---`` line is never content, so an added line that itself
    starts with ``++`` is lost, as in the format this follows.
    """
    lines = df.select(key, F.posexplode_outer(t.split_lines(diff)).alias("pos", "line"))
    line = F.col("line")
    header = line.rlike(HUNK)
    kind = (
        F.when(header, "hunk")
        .when(line.startswith("+") & ~line.startswith("+++"), "add")
        .when(line.startswith("-") & ~line.startswith("---"), "remove")
        .when(line.startswith(" "), "context")
    )
    number = lambda g: F.regexp_extract(line, HUNK, g).try_cast("int")
    # A missing or zero count reads as 1.
    size = lambda g: F.coalesce(F.nullif(number(g), F.lit(0)), F.lit(1))
    start = F.when(
        header,
        F.struct(
            number(1).alias("old_start"), size(2).alias("old_count"), number(3).alias("new_start"),
            size(4).alias("new_count"), F.regexp_extract(line, HUNK, 5).alias("header"),
        ),
    )
    so_far = W.partitionBy(key).orderBy("pos")
    up_to = so_far.rowsBetween(W.unboundedPreceding, 0)
    rows = (
        lines.withColumn("kind", kind)
        .where(F.col("kind").isNotNull())
        .withColumn("start", F.last(start, ignorenulls=True).over(up_to))
        .withColumn("hunk", F.count_if(F.col("kind") == "hunk").over(up_to))
    )
    inside = W.partitionBy(key, "hunk").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    before = lambda *kinds: F.coalesce(F.count_if(F.col("kind").isin(*kinds)).over(inside), F.lit(0))
    old_no, new_no = before("remove", "context"), before("add", "context")
    base = lambda side: F.coalesce(F.col(f"start.{side}_start"), F.lit(0))
    return (
        rows.withColumn("old_no", F.when(F.col("kind").isin("remove", "context"), base("old") + old_no))
        .withColumn("new_no", F.when(F.col("kind").isin("add", "context"), base("new") + new_no))
        .where(F.col("kind") != "hunk")
        .select(key, "hunk", "pos", "kind", F.expr("substring(line, 2)").alias("content"), "old_no", "new_no", "start")
    )


def hunk_texts(lines: DataFrame, key: str) -> DataFrame:
    """Added text and kind-prefixed text of each hunk."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "kind", "content")))
    added = F.transform(F.filter(ordered, lambda x: x["kind"] == "add"), lambda x: x["content"])
    marked = F.transform(ordered, lambda x: F.concat(F.upper(F.left(x["kind"], F.lit(1))), F.lit(" "), x["content"]))
    return lines.groupBy(key, "hunk").agg(
        F.first("start").alias("start"), F.array_join(added, "\n").alias("added"), F.array_join(marked, "\n").alias("modified"),
        F.count_if(F.col("kind") == "add").alias("n_added"),
    )


def header_spans(lines: Column) -> Column:
    """Header lines in order, each with its indent and the last line of its block.

    A block ends before the next header that is not indented deeper. One pass from the last header back keeps
    a stack of headers with rising indents, at most as many as there are levels.
    """
    marked = F.transform(
        lines, lambda l, i: F.struct(i.alias("start"), indent_of(l).alias("indent"), is_header(l).alias("is_header"), l.alias("line"))
    )

    def spans(heads: Column) -> Column:
        none = F.struct(
            F.expr("cast(array() AS array<struct<start:int,indent:int>>)").alias("stack"), F.array().cast("array<int>").alias("ends")
        )

        def step(acc: Column, h: Column) -> Column:
            lower = F.filter(acc["stack"], lambda s: s["indent"] <= h["indent"])
            end = F.coalesce(F.try_element_at(lower, F.lit(-1))["start"], F.size(lines)) - 1
            own = F.array(F.struct(h["start"].alias("start"), h["indent"].alias("indent")))
            stack = F.concat(F.filter(lower, lambda s: s["indent"] < h["indent"]), own)
            return F.struct(stack.alias("stack"), F.concat(acc["ends"], F.array(end)).alias("ends"))

        ends = F.aggregate(F.reverse(heads), none, step, lambda acc: F.reverse(acc["ends"]))
        whole = lambda h, e: F.struct(h["start"].alias("start"), h["indent"].alias("indent"), h["line"].alias("line"), e.alias("end"))
        return F.zip_with(heads, ends, whole)

    return t.let(F.filter(marked, lambda x: x["is_header"]), spans)


def has_tag_above(lines: Column, at: Column) -> Column:
    """A tag on the line above, or two above when the first is blank."""
    above = lambda n: F.when(at - n >= 0, F.trim(F.get(lines, at - n)))
    near, far = above(1), above(2)
    blank = F.coalesce(F.length(t.js_trim(near)) == 0, F.lit(False))
    return F.coalesce(F.when(blank, far.rlike(t.TAG_LINE)).otherwise(near.rlike(t.TAG_LINE)), F.lit(False))


def tags_above(lines: Column) -> Column:
    """``has_tag_above`` of every line, in one array."""
    return F.transform(lines, lambda _, i: has_tag_above(lines, i))


def tag_line_above(lines: Column, at: Column) -> Column:
    """Position of the tag found by the same look-back, with the strict tag pattern."""
    near, far = F.when(at >= 1, F.get(lines, at - 1)), F.when(at >= 2, F.get(lines, at - 2))
    blank = F.coalesce(F.length(t.js_trim(near)) == 0, F.lit(False))
    return F.when(blank, F.when(far.rlike(TAG), at - 2)).otherwise(F.when(near.rlike(TAG), at - 1))


def function_blocks(df: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """All function and class blocks of a file; blocks nested in an earlier block are skipped.

    A header opens an outer block exactly if no header before it is indented less. Only finished blocks
    leave the file's row.
    """
    lines = F.col("_lines")
    none = F.struct(F.lit(2**31 - 1).alias("low"), F.slice("_spans", 1, 0).alias("kept"))
    outer = F.aggregate(
        "_spans",
        none,
        lambda acc, s: F.when(
            s["indent"] <= acc["low"], F.struct(s["indent"].alias("low"), F.concat(acc["kept"], F.array(s)).alias("kept"))
        ).otherwise(acc),
        lambda acc: acc["kept"],
    )
    block = lambda b: F.struct(
        function_name(b["line"]).alias("function_name"), b["start"].alias("start_line"), b["end"].alias("end_line"),
        has_tag_above(lines, b["start"]).alias("has_tag"),
        F.array_join(F.slice(lines, b["start"] + 1, b["end"] - b["start"] + 1), "\n").alias("block"),
    )
    cut = df.withColumn("_lines", t.split_lines(content)).withColumn("_spans", header_spans(lines)).withColumn("_blocks", F.transform(outer, block))
    rows = cut.select(*df.columns, F.explode_outer("_blocks").alias("_b")).where(F.col("_b").isNotNull())
    b = F.col("_b")
    return rows.select(
        *df.columns, b["function_name"].alias("function_name"), b["start_line"].alias("start_line"), b["end_line"].alias("end_line"),
        language_of(F.col(path)).alias("language"), b["has_tag"].alias("has_tag"), b["block"].alias("block"),
    )


def _owner(span: Column) -> Column:
    return F.struct(function_name(span["line"]).alias("name"), span["start"].alias("start"), span["end"].alias("end"))


def containing_function(lines: Column, at: Column, look_back: int | None = None, spans: Column | None = None) -> Column:
    """Nearest header at or above a 0-based position, at most ``look_back`` lines where given: (name, start, end) or null.

    ``spans`` are the ``header_spans`` of the lines, where a caller has them already.
    """
    near = F.filter(header_spans(lines) if spans is None else spans, lambda s: s["start"] <= at)
    last = F.try_element_at(near, F.lit(-1))
    close = last.isNotNull() if look_back is None else last["start"] >= at - look_back
    return F.when(close, _owner(last))


def line_owners(lines: Column, spans: Column, look_back: int | None = None) -> Column:
    """``containing_function`` of every line in one array: each header owns the lines up to the next one."""
    nothing = F.expr("cast(null AS struct<name:string,start:int,end:int>)")
    begin = F.coalesce(F.get(spans, F.lit(0))["start"], F.size(lines))

    def own(span: Column, i: Column) -> Column:
        upto = F.coalesce(F.get(spans, i + 1)["start"], F.size(lines))
        reach = F.lit(None).cast("int") if look_back is None else span["start"] + look_back
        held = lambda who: F.transform(F.sequence(span["start"], upto - 1), lambda at: F.when(F.coalesce(at <= reach, F.lit(True)), who))
        return t.let(_owner(span), held)

    return F.concat(F.array_repeat(nothing, begin), F.flatten(F.transform(spans, own)))


def hunk_blocks(df: DataFrame, hunks: DataFrame, key: str, look_back: int | None = None) -> DataFrame:
    """Blocks of changed hunks: the containing function, else the hunk itself (HunkAt<n>).

    The 1-based hunk start is used as a 0-based position. A file meets the list of its hunks, so its lines
    are not repeated per hunk.
    """
    listed = hunks.where(F.col("n_added") > 0).groupBy(key).agg(
        F.collect_list(F.struct("hunk", F.col("start.new_start").alias("at"), F.col("start.new_count").alias("size"), F.col("added").alias("context"))).alias("_hunks")
    )
    lines = F.col("_lines")
    files = df.select(key, t.split_lines("content").alias("_lines")).withColumn("_spans", header_spans(lines)).join(listed, key)

    def block(h: Column) -> Column:
        def with_owner(owner: Column) -> Column:
            first, last = F.coalesce(owner["start"], h["at"]), F.coalesce(owner["end"], h["at"] + h["size"] - 1)
            # slice(max(0, first), end): nothing when the span starts behind the text
            text = F.array_join(F.slice(lines, F.greatest(first, F.lit(0)) + 1, F.greatest(last - first + 1, F.lit(0))), "\n")
            return F.struct(
                h["hunk"].alias("hunk"), F.coalesce(owner["name"], F.concat(F.lit("HunkAt"), h["at"])).alias("function_name"),
                first.alias("start_line"), last.alias("end_line"), text.alias("block"), h["context"].alias("context"),
            )

        return t.let(containing_function(lines, h["at"], look_back, F.col("_spans")), with_owner)

    return files.select(key, F.inline(F.transform("_hunks", block)))


def block_coverage(functions: DataFrame, hunks: DataFrame, key: str) -> DataFrame:
    """All function blocks of a file, or its changed hunks when it has none."""
    cols = [key, "function_name", "start_line", "end_line", "block"]
    rest = hunks.join(functions.select(key).distinct(), key, "left_anti")
    return functions.select(*cols, F.lit("functions").alias("coverage")).unionByName(
        rest.select(*cols, F.lit("hunks").alias("coverage"))
    )


def name_status(df: DataFrame, key: str, output: str) -> DataFrame:
    """Commit file lists: status letter and path per line."""
    lines = df.select(key, F.explode_outer(F.transform(t.split_lines(output), t.js_trim)).alias("line"))
    parts = F.split("line", r"\s+")
    return lines.where(F.size(parts) >= 2).select(
        key,
        F.upper(F.left(parts[0], F.lit(1))).alias("status"),
        F.array_join(F.slice(parts, 2, F.size(parts)), " ").alias("path"),
    )


def without_deleted(changes: DataFrame) -> DataFrame:
    """Commit file lists without the files a commit removes: these are never analysed."""
    return changes.where(F.col("status") != "D")


def _ranges(marks: Column, state: dict[str, Column], step, finish) -> Column:
    """A fold over the marks of all lines whose result is ranges of line numbers; texts are cut out afterwards."""
    none = F.expr("cast(array() AS array<struct<first:int,size:int>>)")
    start = F.struct(F.lit(0).alias("i"), none.alias("done"), *[v.alias(k) for k, v in state.items()])
    return F.aggregate(marks, start, step, finish)


def _range(first: Column, size: Column) -> Column:
    return F.array(F.struct(first.alias("first"), size.alias("size")))


def sections(code: Column) -> Column:
    """Text cut before every definition line that follows some text."""

    def cut(lines: Column) -> Column:
        marks = F.transform(lines, lambda l: F.struct(l.rlike(SECTION).alias("cut"), (F.length(t.js_trim(l)) > 0).alias("text")))

        def step(acc: Column, m: Column) -> Column:
            here = m["cut"] & acc["text"]
            return F.struct(
                (acc["i"] + 1).alias("i"),
                F.when(here, F.concat(acc["done"], _range(acc["first"], acc["i"] - acc["first"]))).otherwise(acc["done"]).alias("done"),
                F.when(here, acc["i"]).otherwise(acc["first"]).alias("first"),
                (m["text"] | (acc["text"] & ~here)).alias("text"),
            )

        tail = lambda acc: F.when(acc["text"], F.concat(acc["done"], _range(acc["first"], acc["i"] - acc["first"]))).otherwise(acc["done"])
        found = _ranges(marks, {"first": F.lit(0), "text": F.lit(False)}, step, tail)
        texts = F.transform(found, lambda r: F.concat(F.array_join(F.slice(lines, r["first"] + 1, r["size"]), "\n"), F.lit("\n")))
        return t.let(texts, lambda every: F.when(F.size(every) == 0, F.array(code)).otherwise(every))

    return t.let(t.split_lines(code), cut)


def segments(code: Column) -> Column:
    """Code cut into definitions and standalone lines, longer than 10 characters."""

    def mark(line: Column) -> Column:
        def of(trimmed: Column) -> Column:
            arrow = F.contains(trimmed, F.lit("= function")) | F.contains(trimmed, F.lit("=> "))
            opens = trimmed.rlike("^(def |class |function |async |export function)") | (trimmed.rlike("^(const |let |var |export const)") & arrow)
            return F.struct(
                (F.length(trimmed) == 0).alias("blank"), opens.alias("opens"), indent_of(line).alias("indent"),
                trimmed.rlike("^(#|//|\"\"\"|'')").alias("comment"),
            )

        return t.let(t.js_trim(line), of)

    def cut(lines: Column) -> Column:
        # ``size`` counts the lines of the definition that is open from ``first`` on; 0 means none is.
        def step(acc: Column, m: Column) -> Column:
            inside, held = acc["size"] > 0, _range(acc["first"], acc["size"])
            ends = ~m["blank"] & (m["indent"] <= acc["base"]) & ~m["comment"] & (acc["size"] > 1)
            alone = _range(acc["i"], F.lit(1))
            state = lambda done, first, size, base: F.struct(
                (acc["i"] + 1).alias("i"), done.alias("done"), first.alias("first"), size.alias("size"), base.alias("base")
            )
            flushed = F.when(inside, F.concat(acc["done"], held)).otherwise(acc["done"])
            return (
                F.when(m["blank"] & ~inside, state(acc["done"], acc["first"], acc["size"], acc["base"]))
                .when(m["opens"], state(flushed, acc["i"], F.lit(1), m["indent"]))
                .when(inside & ends, state(F.concat(acc["done"], held, alone), acc["first"], F.lit(0), acc["base"]))
                .when(inside, state(acc["done"], acc["first"], acc["size"] + 1, acc["base"]))
                .otherwise(state(F.concat(acc["done"], alone), acc["first"], F.lit(0), acc["base"]))
            )

        tail = lambda acc: F.when(acc["size"] > 0, F.concat(acc["done"], _range(acc["first"], acc["size"]))).otherwise(acc["done"])
        found = _ranges(F.transform(lines, mark), {"first": F.lit(0), "size": F.lit(0), "base": F.lit(0)}, step, tail)
        texts = F.transform(found, lambda r: t.js_trim(F.array_join(F.slice(lines, r["first"] + 1, r["size"]), "\n")))
        return F.filter(texts, lambda s: F.length(s) > 10)

    return t.let(t.split_lines(code), cut)


def line_ranges(numbers: Column) -> Column:
    """[1,2,3,5] to "1-3,5"."""
    ordered = F.array_sort(F.array_distinct(numbers))
    starts = F.filter(ordered, lambda n: ~F.array_contains(ordered, n - 1))
    ends = F.filter(ordered, lambda n: ~F.array_contains(ordered, n + 1))
    text = lambda s, e: F.when(s == e, s.cast("string")).otherwise(F.concat(s.cast("string"), F.lit("-"), e.cast("string")))
    return F.array_join(F.zip_with(starts, ends, text), ",")


def line_summary(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Compact human / llm line ranges of each block: islands by window, then joined in order."""
    side = F.when(F.col("label") == "LLM_GENERATED", "llm").otherwise("human")
    w = W.partitionBy(*keys, "side").orderBy("line_no")
    islands = (
        lines.select(*keys, "line_no", side.alias("side"))
        .distinct()
        .withColumn("island", F.col("line_no") - F.row_number().over(w))
        .groupBy(*keys, "side", "island")
        .agg(F.min("line_no").alias("a"), F.max("line_no").alias("b"))
    )
    part = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    ranges = islands.groupBy(*keys, "side").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct(F.col("a"), part.alias("p")))), lambda x: x["p"]), ","
        ).alias("ranges")
    )
    return ranges


def block_tags(attributions: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """New tag of each attributed block: its line ranges in the file, or its label when it has no lines.

    ``attributions`` adds language, start_line (0-based), has_tag, label and
    day to the keys. Line numbers count the tag line that will be inserted.
    """
    place = attributions.select(*keys, "start_line", "has_tag")
    offset = F.when(F.col("has_tag"), 0).otherwise(1)
    in_file = lines.join(place, keys).withColumn("line_no", F.col("start_line") + F.col("line_no") + offset)
    ranges = line_summary(in_file, keys)
    part = lambda side: F.max(F.when(F.col("side") == side, F.concat(F.lit(f"{side} - file lines "), "ranges")))
    summary = ranges.groupBy(*keys).agg(F.concat_ws("; ", part("human"), part("llm")).alias("summary"))
    text = tag_text(F.col("language"), F.coalesce("summary", "label"), F.col("day"))
    return attributions.join(summary, keys, "left").select(*keys, text.alias("tag"))


def tag_text(language: Column, summary: Column, day: Column) -> Column:
    return F.concat(
        comment_prefix(language), F.lit(" @Authorship: "), summary, F.lit(" | timestamp="), F.date_format(day, "yyyy-MM-dd")
    )


def detailed_tag(language: Column, label: Column, confidence: Column, reason: Column, day: Column) -> Column:
    return F.format_string(
        '%s [AUTHORSHIP: %s] | confidence=%d%% | reason="%s..." | timestamp=%s',
        comment_prefix(language), label, F.floor(confidence * 100 + 0.5).cast("int"), F.left(reason, F.lit(60)),
        F.date_format(day, "yyyy-MM-dd"),
    )


def tag_signature(line: Column) -> Column:
    found = line.rlike(r"(?i)@Authorship:\s*[^|]+")
    return F.when(found, t.js_trim(F.regexp_extract(line, r"(?i)@Authorship:\s*([^|]+)", 1)))


def parse_tag(line: Column) -> Column:
    """(label, origin, timestamp) of a tag line, null when it holds no label."""
    pattern = r"(?i)\[AUTHORSHIP:\s*(\w+)\]|@Authorship:\s*(\w+)"
    some = lambda x: F.when(x != "", x)
    label = F.coalesce(some(F.regexp_extract(line, pattern, 1)), some(F.regexp_extract(line, pattern, 2)))
    return F.when(
        line.rlike(pattern),
        F.struct(
            label.alias("label"),
            some(F.regexp_extract(line, r"origin=(\w+)", 1)).alias("origin"),
            some(F.regexp_extract(line, r"timestamp=([^\s|]+)", 1)).alias("timestamp"),
        ),
    )


def tag_actions(df: DataFrame) -> DataFrame:
    """insert, replace or keep for a new tag at a line of a file.

    Input adds ``lines``, ``at`` and ``tag`` to any columns.
    """
    lines = F.col("lines")
    last = F.greatest(F.lit(0), F.size(lines) - 1)
    clamp = lambda n: F.greatest(F.lit(0), F.least(n, last))
    here, up = clamp(F.col("at")), clamp(F.col("at") - 1)
    likely = lambda n: F.coalesce(F.get(lines, n).rlike(LIKELY_HEADER), F.lit(False))
    line_index = F.when(likely(here), here).when(likely(up), up).otherwise(here)
    old = F.get(lines, F.col("tag_line"))
    same = tag_signature(old).isNotNull() & (tag_signature(old) == tag_signature(F.col("tag")))
    return (
        df.withColumn("line_index", line_index)
        .withColumn("tag_line", tag_line_above(lines, F.col("line_index")))
        .withColumn(
            "action",
            F.when(F.col("tag_line").isNull(), "insert").when(F.coalesce(same, F.lit(False)), "keep").otherwise("replace"),
        )
        .withColumn("text", F.concat(F.regexp_extract(F.get(lines, F.col("line_index")), r"^\s*", 0), "tag"))
        .drop("lines", "at")
    )


def tag_band_join(existing: DataFrame, new: DataFrame, key: str, reach: int = 5) -> DataFrame:
    """For every existing tag the first new tag less than ``reach`` lines away.

    Lines are cut into bands of ``reach``; a match lies in the same or a
    neighbouring band, so the join stays an equi-join.
    """
    a = existing.select(key, "line").distinct().withColumn("band", F.floor(F.col("line") / reach))
    # One candidate per line: of several tags at a line the first one wins anyway.
    firsts = new.groupBy(key, "at").agg(F.min(F.struct("tag_order", "tag")).alias("n"))
    b = firsts.select(
        key, F.col("at"), F.col("n.tag_order").alias("tag_order"), F.col("n.tag").alias("tag"),
        F.explode(F.array(*[F.floor(F.col("at") / reach) + i for i in (-1, 0, 1)])).alias("band"),
    )
    near = a.join(b, [key, "band"]).where(F.abs(F.col("line") - F.col("at")) < reach)
    return near.groupBy(key, "line").agg(F.min(F.struct("tag_order", "tag")).alias("n")).select(
        key, "line", F.col("n.tag_order").alias("tag_order"), F.col("n.tag").alias("new_tag")
    )


def line_delta(df: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """Lines only in the old ("-") or only in the new text ("+"), counted as multisets.

    The n-th copy of a line pairs with the n-th copy on the other side; moved
    lines are therefore not changes.
    """
    def numbered(column: str, side: str) -> DataFrame:
        lines = df.select(key, F.posexplode_outer(t.split_lines(column)).alias("pos", "line")).where(F.col("pos").isNotNull())
        nth = F.row_number().over(W.partitionBy(key, "line").orderBy("pos"))
        return lines.withColumn("nth", nth).select(key, "line", "nth", F.col("pos").alias(side))

    both = numbered(old, "old_pos").join(numbered(new, "new_pos"), [key, "line", "nth"], "full")
    kept = both.where(F.col("old_pos").isNull() | F.col("new_pos").isNull())
    sign = F.when(F.col("new_pos").isNull(), "- ").otherwise("+ ")
    entry = F.struct(F.coalesce("old_pos", "new_pos").alias("pos"), F.col("new_pos").isNotNull().alias("added"), F.concat(sign, "line").alias("text"))
    return kept.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["text"]), "\n").alias("delta")
    )
