"""Queries: text functions, source files, diffs, tags and commit reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelineage.functions import text as t
from codelineage.operators import files as f
from codelineage.operators import provenance as p
from codelineage.operators import reports
from codelineage.operators.chat import LONGEST_GAP
from codelineage.operators import snippets as sn
from codelineage.plans import sqltext as q
from codelineage.plans.base import Registry
from codelineage.plans.provenance import ATTRIBUTED, BESIDE, _block_with_prompt, attributions, code_chat, fenced
from codelineage.session import scratch_path
from codelineage.sources.tables import code_blocks, messages, spread_table, table

R = Registry()


def source_files(spark, d):
    """Two versions of a generated file per part; every fourth starts with a tag."""
    k, size = F.col("p_partkey"), F.col("p_size")
    tag = F.when(k % 4 == 0, "# @Authorship: human | timestamp=2024-01-01\n").otherwise("")
    body = lambda n: F.concat(
        F.lit("def f_"), k, F.lit("(x):\n    return x + "), n, F.lit("\n\nclass C_"), k,
        F.lit(":\n    def g(self):\n        return '"), F.col("p_name"), F.lit("'\n\n"),
    )
    tail = F.concat(F.lit("async def h_"), k, F.lit("(y):\n    return y\n"))
    return spread_table(spark, d, "part").select(
        k.alias("id"), F.concat(F.lit("src/P_"), k, F.when(k % 2 == 0, ".py").otherwise(".JS")).alias("path"),
        body(size).alias("old"), F.concat(tag, body(size + 1), tail).alias("content"),
        size.alias("size"),
    )


FILES = """files AS (SELECT *, CASE WHEN k % 4 = 0 THEN '# @Authorship: human | timestamp=2024-01-01' || chr(10) ELSE '' END || b2
    || 'async def h_' || k || '(y):' || chr(10) || '    return y' || chr(10) AS content, b1 AS old, k AS id,
    'src/P_' || k || CASE WHEN k % 2 = 0 THEN '.py' ELSE '.JS' END AS path FROM (
  SELECT p_partkey AS k, p_size AS size, p_name AS name,
    'def f_' || p_partkey || '(x):' || chr(10) || '    return x + ' || p_size || chr(10) || chr(10) || 'class C_' || p_partkey
      || ':' || chr(10) || '    def g(self):' || chr(10) || '        return ''' || p_name || '''' || chr(10) || chr(10) AS b1,
    'def f_' || p_partkey || '(x):' || chr(10) || '    return x + ' || (p_size + 1) || chr(10) || chr(10) || 'class C_' || p_partkey
      || ':' || chr(10) || '    def g(self):' || chr(10) || '        return ''' || p_name || '''' || chr(10) || chr(10) AS b2
  FROM part)),
  flines AS (SELECT id, path, unnest(string_split(content, chr(10))) AS line,
    unnest(range(0, len(string_split(content, chr(10))))) AS n, len(string_split(content, chr(10))) AS total FROM files),
  heads AS (SELECT *, regexp_matches(line, '^\\s*(async\\s+)?(def|function|class|const|let|var|public|private|protected)\\s+\\w+') AS is_header,
    length(regexp_extract(line, '^\\s*')) AS indent FROM flines)"""

NAME = """CASE WHEN regexp_matches(line, 'def\\s+(\\w+)') THEN regexp_extract(line, 'def\\s+(\\w+)', 1)
  WHEN regexp_matches(line, 'class\\s+(\\w+)') THEN regexp_extract(line, 'class\\s+(\\w+)', 1) ELSE 'Unknown' END"""


@R.add(
    "norm_ws", f"SELECT doc_id, {q.squeeze('text')} AS norm FROM documents"
)
def norm_ws(spark, d):
    return spread_table(spark, d, "documents").select("doc_id", t.norm_ws(F.col("text")).alias("norm"))


@R.add("norm_syntax", f"SELECT page_id, {q.norm_syntax('html')} AS norm FROM pages")
def norm_syntax(spark, d):
    return spread_table(spark, d, "pages").select("page_id", t.norm_syntax(F.col("html")).alias("norm"))


@R.add(
    "fuzzy_lines",
    f"""WITH {BESIDE}, x AS (SELECT conv_id, block, {q.features('content')} AS f, {q.features('prompt')} AS g FROM beside)
    SELECT conv_id, block, round({q.fuzzy_score('f', 'g')}, 6) AS score FROM x""",
)
def fuzzy_lines(spark, d):
    both = _block_with_prompt(spark, d)
    return both.select("conv_id", "block", F.round(t.fuzzy_lines(F.col("content"), F.col("prompt")), 6).alias("score"))


@R.add(
    "token_sim",
    f"""WITH {BESIDE}, x AS (SELECT conv_id, block, {q.tokens('content')} AS f, {q.tokens('prompt')} AS g FROM beside)
    SELECT conv_id, block, round({q.token_similarity('f', 'g')}, 6) AS score FROM x""",
)
def token_sim(spark, d):
    both = _block_with_prompt(spark, d)
    score = t.token_similarity(t.tokens(F.col("content")), t.tokens(F.col("prompt")))
    return both.select("conv_id", "block", F.round(score, 6).alias("score"))


def _structural_sql() -> str:
    n = lambda c, p: f"len(regexp_extract_all({c}, '{p}'))"
    score, checks = "0.0::DOUBLE", "1"
    for w in t.STRUCTURE_WORDS:
        a, b = n("content", rf"\b{w}\b"), n("prompt", rf"\b{w}\b")
        score += f" + CASE WHEN {a} > 0 OR {b} > 0 THEN greatest(0, 10 - abs({a} - {b})) ELSE 0 END"
        checks += f" + CASE WHEN {a} > 0 OR {b} > 0 THEN 1 ELSE 0 END"
    a, b = f"len({q.lines('content')})", f"len({q.lines('prompt')})"
    score += f" + (1 - abs({a} - {b})::DOUBLE / greatest({a}, {b})) * 30"
    a, b = n("content", "[+\\-*/=<>!&|]"), n("prompt", "[+\\-*/=<>!&|]")
    score += f" + CASE WHEN {a} > 0 OR {b} > 0 THEN (1 - abs({a} - {b})::DOUBLE / greatest({a}, {b}) / 2) * 30 ELSE 0 END"
    checks += f" + CASE WHEN {a} > 0 OR {b} > 0 THEN 1 ELSE 0 END"
    return f"round(({score}) / ({checks}), 6)"


@R.add("structural_score", f"WITH {BESIDE} SELECT conv_id, block, {_structural_sql()} AS score FROM beside")
def structural_score(spark, d):
    both = _block_with_prompt(spark, d)
    return both.select("conv_id", "block", F.round(t.structural_score(F.col("content"), F.col("prompt")), 6).alias("score"))


@R.add(
    "line_jaccard",
    f"""WITH {q.BLOCKS}, x AS (SELECT b.conv_id, b.block, list_distinct({q.trimmed_lines('content')}) AS a,
      list_distinct({q.trimmed_lines('text')}) AS b FROM blocks b JOIN conversations c ON b.conv_id = c.conv_id AND b.block = c.turn)
    SELECT conv_id, block, CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 WHEN len(a) = 0 OR len(b) = 0 THEN 0.0
      ELSE round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 6) END AS score FROM x""",
)
def line_jaccard(spark, d):
    own = messages(spark, d).select("conv_id", F.col("turn").alias("block"), "text")
    both = code_blocks(spark, d).join(own, ["conv_id", "block"])
    return both.select("conv_id", "block", F.round(t.line_jaccard(F.col("content"), F.col("text")), 6).alias("score"))


SIGNIFICANT = """list_transform(list_filter({lines}, lambda l: NOT regexp_matches(l, '^(#|//|\"\"\"|'''''')')), lambda l: {norm})"""


def _significant(x: str) -> str:
    return SIGNIFICANT.format(lines=q.trimmed_lines(x), norm=q.norm_line("l"))


@R.add(
    "subset_match",
    f"""WITH {q.BLOCKS}, x AS (SELECT b.conv_id, b.block, {_significant('content')} AS a, {_significant('text')} AS b
      FROM blocks b JOIN conversations c ON b.conv_id = c.conv_id AND b.block = c.turn)
    SELECT conv_id, block, len(a) > 0 AND len(b) > 0 AND coalesce(len(list_filter(a, lambda l: len(list_filter(b,
      lambda r: contains(r, l) OR contains(l, r))) > 0))::DOUBLE / nullif(len(a), 0) >= 0.9, false) AS is_subset FROM x""",
)
def subset_match(spark, d):
    own = messages(spark, d).select("conv_id", F.col("turn").alias("block"), "text")
    both = code_blocks(spark, d).join(own, ["conv_id", "block"])
    return both.select("conv_id", "block", t.subset_match(F.col("content"), F.col("text")).alias("is_subset"))


def _shape_sql(x: str) -> str:
    """Words one by one instead of a lookahead; other characters are folded to ASCII on both sides."""
    keep = "|".join(t.SHAPE_KEYWORDS)
    folded = f"regexp_replace({x}, '[^\\x00-\\x7F]', '?', 'g')"
    bare = q.sub(q.sub(folded, '"[^"]*"', '""'), "'[^']*'", "''" * 2)
    word = f"CASE WHEN regexp_matches(w, '^\\w') AND NOT regexp_matches(w, '^({keep})') THEN 'ID' ELSE w END"
    words = f"list_transform(regexp_extract_all({bare}, '\\w+|[^\\w]+'), lambda w: {word})"
    return q.norm_line(f"array_to_string({words}, '')")


@R.add(
    "shape_sim",
    f"""WITH {q.BLOCKS}, x AS (SELECT b.conv_id, b.block, {_shape_sql('content')} AS a, {_shape_sql('text')} AS b
      FROM blocks b JOIN conversations c ON b.conv_id = c.conv_id AND b.block = c.turn)
    SELECT conv_id, block, round(CASE WHEN a = b THEN 1.0
      WHEN contains(a, b) OR contains(b, a) THEN least(length(a), length(b))::DOUBLE / greatest(length(a), length(b))
      WHEN abs(length(a) - length(b)) > 1000 THEN 0.0
      ELSE 1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)) END::DOUBLE, 6) AS score FROM x""",
)
def shape_sim(spark, d):
    own = messages(spark, d).select("conv_id", F.col("turn").alias("block"), "text")
    both = code_blocks(spark, d).join(own, ["conv_id", "block"])
    fold = lambda c: F.regexp_replace(c, r"[^\x00-\x7F]", "?")
    return both.select("conv_id", "block", F.round(t.shape_similarity(fold("content"), fold("text"), LONGEST_GAP), 6).alias("score"))


# DuckDB counts bytes, so both sides fold other characters to one ASCII mark.
@R.add(
    "bounded_lev",
    f"""WITH {BESIDE}, x AS (SELECT conv_id, block, regexp_replace(content, '[^\\x00-\\x7F]', '?', 'g') AS a,
      regexp_replace(prompt, '[^\\x00-\\x7F]', '?', 'g') AS b FROM beside)
    SELECT conv_id, block, CASE WHEN abs(length(a) - length(b)) > 1000 THEN greatest(length(a), length(b))
      ELSE levenshtein(a, b) END AS distance FROM x""",
)
def bounded_lev(spark, d):
    both = _block_with_prompt(spark, d)
    fold = lambda c: F.regexp_replace(c, r"[^\x00-\x7F]", "?")
    return both.select("conv_id", "block", t.bounded_levenshtein(fold("content"), fold("prompt"), LONGEST_GAP).alias("distance"))


@R.add(
    "word_overlap",
    f"""WITH {BESIDE}, x AS (SELECT conv_id, block, list_distinct(string_split_regex({q.norm_line('content')}, '{q.WS}+')) AS a,
      list_distinct(string_split_regex({q.norm_line('prompt')}, '{q.WS}+')) AS b FROM beside)
    SELECT conv_id, block, round(len(list_intersect(a, b))::DOUBLE / greatest(len(a), len(b)), 6) AS score FROM x""",
)
def word_overlap(spark, d):
    both = _block_with_prompt(spark, d)
    score = t.word_overlap(t.norm_line(F.col("content")), t.norm_line(F.col("prompt")))
    return both.select("conv_id", "block", F.round(score, 6).alias("score"))


def _clean_sql(x: str) -> str:
    x = q.sub(q.js_trim(x), r"^[A-Z][A-Z_]{2,}:\s*", "")
    for pattern in t.BOILERPLATE:
        x = q.sub(x, pattern, "")
    x = q.sub(q.sub(x, q.WS + "+", " "), q.WS + "+([,.;:])", r"\1")
    x = q.sub(x, "^[ ,.;:]+|[ ,.;:]+$", "")
    return f"CASE WHEN {x} = '' THEN 'empty' ELSE {x} END"


def requirement_texts(spark, d):
    """Documents as change requests: some with a prefix, some with boilerplate."""
    i, text = F.col("doc_id"), F.col("text")
    wrapped = (
        F.when(i % 4 == 0, F.concat(F.lit("REFACTOR_CHANGE: "), text, F.lit(" without changing the function's existing behavior .")))
        .when(i % 4 == 1, F.concat(F.lit("Add an optional parameter and return it, while preserving its current functionality ;"), text))
        .when(i % 4 == 2, F.concat(F.lit("Rename the variable name. "), text))
        .otherwise(text)
    )
    return spread_table(spark, d, "documents").select("doc_id", "lang", wrapped.alias("requirement"))


REQUIREMENTS = """requirements AS (SELECT doc_id, lang, CASE doc_id % 4
  WHEN 0 THEN 'REFACTOR_CHANGE: ' || text || ' without changing the function''s existing behavior .'
  WHEN 1 THEN 'Add an optional parameter and return it, while preserving its current functionality ;' || text
  WHEN 2 THEN 'Rename the variable name. ' || text ELSE text END AS requirement FROM documents)"""


@R.add("clean_text", f"WITH {REQUIREMENTS} SELECT doc_id, {_clean_sql('requirement')} AS clean FROM requirements")
def clean_text(spark, d):
    return requirement_texts(spark, d).select("doc_id", t.clean_requirement(F.col("requirement")).alias("clean"))


@R.add(
    "identifier_tokens",
    """SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(
      p_name || ' ' || p_name || ' ' || p_brand || ' ' || p_partkey, '[A-Za-z]+|[0-9]+'), lambda w: lower(w)), ' ') AS tokens FROM part""",
)
def identifier_tokens(spark, d):
    both = F.concat_ws("_", "p_name", F.initcap("p_name"), "p_brand", "p_partkey")
    return table(spark, d, "part").select("p_partkey", F.array_join(t.identifier_tokens(both), " ").alias("tokens"))


@R.add(
    "code_normalize",
    """SELECT p_partkey AS id, 'def f_' || p_partkey || '(x):' || chr(10) || '    return x + ' || p_size || chr(10) || chr(10) || '' || chr(10) AS code FROM part""",
)
def code_normalize(spark, d):
    k, pad = F.col("p_partkey"), F.repeat(F.lit(" "), (F.col("p_partkey") % 7).cast("int"))
    raw = F.concat(pad, F.lit("def f_"), k, F.lit("(x):  \n"), pad, F.lit("    return x + "), F.col("p_size"), F.lit("\t \n\n   \n"))
    return table(spark, d, "part").select(k.alias("id"), t.normalize_code(raw).alias("code"))


@R.add(
    "clean_generated",
    """SELECT p_partkey AS id, 'def f_' || p_partkey || '(x):' || chr(10) || '    return ' || CASE WHEN p_partkey % 5 = 0 THEN '<deleted>' ELSE 'x' END AS code,
    p_partkey % 5 = 0 AS has_marker FROM part""",
)
def clean_generated(spark, d):
    k = F.col("p_partkey")
    code = F.concat(F.lit("def f_"), k, F.lit("(x):\n    return "), F.when(k % 5 == 0, "<deleted>").otherwise("x"))
    fenced = F.when(k % 2 == 0, F.concat(F.lit(" ```Python\n"), code, F.lit("\n```\n"))).otherwise(F.concat(F.lit("\n"), code, F.lit("\n")))
    clean = t.strip_fence(fenced)
    return table(spark, d, "part").select(k.alias("id"), clean.alias("code"), F.contains(clean, F.lit("<deleted>")).alias("has_marker"))


@R.add(
    "header_parse",
    f"""WITH {FILES} SELECT id, n, {NAME} AS name, CASE WHEN id % 2 = 0 THEN 'python' ELSE 'javascript' END AS language
    FROM heads WHERE is_header""",
)
def header_parse(spark, d):
    rows = source_files(spark, d).select("id", "path", F.posexplode(t.split_lines("content")).alias("n", "line"))
    return rows.where(f.is_header(F.col("line"))).select(
        "id", "n", f.function_name(F.col("line")).alias("name"), f.language_of(F.col("path")).alias("language")
    )


@R.add(
    "function_blocks",
    f"""WITH {FILES}, top AS (SELECT *, lead(n) OVER (PARTITION BY id ORDER BY n) AS nxt FROM heads WHERE is_header AND indent = 0),
    b AS (SELECT id, {NAME} AS function_name, n AS start_line, coalesce(nxt - 1, total - 1) AS end_line FROM top)
    SELECT b.*, b.start_line = 1 AS has_tag, (SELECT string_agg(line, chr(10) ORDER BY n) FROM flines l
      WHERE l.id = b.id AND l.n BETWEEN b.start_line AND b.end_line) AS block FROM b""",
)
def function_blocks(spark, d):
    return f.function_blocks(source_files(spark, d).select("id", "path", "content")).select(
        "id", "function_name", "start_line", "end_line", "has_tag", "block"
    )


# Fixed value: lines above a place where the queries look for its function.
LOOK_BACK = 50


@R.add(
    "containing_function",
    f"""WITH {FILES}, h AS (SELECT id, n, {NAME} AS name FROM heads WHERE is_header)
    SELECT l.id, l.n AS at, (SELECT arg_max(name, n) FROM h WHERE h.id = l.id AND h.n <= l.n AND h.n >= l.n - 50) AS name FROM flines l""",
)
def containing_function(spark, d):
    rows = source_files(spark, d).select("id", t.split_lines("content").alias("lines")).withColumn("spans", f.header_spans(F.col("lines")))
    owners = f.line_owners(F.col("lines"), F.col("spans"), LOOK_BACK)
    return rows.select("id", F.posexplode(owners).alias("at", "owner")).select("id", "at", F.col("owner.name").alias("name"))


@R.add(
    "tag_above",
    f"""WITH {FILES}, p AS (SELECT id, n, lag(line, 1) OVER w AS a, lag(line, 2) OVER w AS b FROM flines WINDOW w AS (PARTITION BY id ORDER BY n))
    SELECT id, n AS at, coalesce(CASE WHEN trim(a) = '' THEN b ELSE a END LIKE '%@Authorship:%', false) AS has_tag FROM p""",
)
def tag_above(spark, d):
    rows = source_files(spark, d).select("id", t.split_lines("content").alias("lines"))
    return rows.select("id", F.posexplode(f.tags_above(F.col("lines"))).alias("at", "has_tag"))


DIFFS = f"""{FILES}, o AS (SELECT id, unnest(string_split(old, chr(10))) AS line, unnest(range(0, len(string_split(old, chr(10))))) AS n FROM files),
  both_lines AS (SELECT coalesce(a.id, b.id) AS id, coalesce(a.n, b.n) AS n, coalesce(a.line, '') AS x, coalesce(b.line, '') AS y
    FROM o a FULL JOIN flines b ON a.id = b.id AND a.n = b.n),
  entries AS (SELECT id, n, CASE WHEN x = y THEN ' ' || x || chr(10) ELSE
    CASE WHEN x <> '' THEN '-' || x || chr(10) ELSE '' END || CASE WHEN y <> '' THEN '+' || y || chr(10) ELSE '' END END AS e FROM both_lines)"""


def diffs(spark, d):
    return source_files(spark, d).select("id", f.positional_diff(F.col("old"), F.col("content")).alias("diff"))


@R.add(
    "positional_diff",
    f"""WITH {DIFFS}, s AS (SELECT id, string_agg(e, '' ORDER BY n) AS body FROM entries GROUP BY 1)
    SELECT f.id, '--- a/file' || chr(10) || '+++ b/file' || chr(10) || '@@ -1,' || len(string_split(old, chr(10))) || ' +1,'
      || len(string_split(content, chr(10))) || ' @@' || chr(10) || body AS diff FROM files f JOIN s ON f.id = s.id""",
)
def positional_diff(spark, d):
    return diffs(spark, d)


@R.add(
    "diff_lines",
    f"""WITH {DIFFS}, parts AS (
      SELECT id, n, 0 AS o, 'context' AS kind, x AS content FROM both_lines WHERE x = y
      UNION ALL SELECT id, n, 1, 'remove', x FROM both_lines WHERE x <> y AND x <> ''
      UNION ALL SELECT id, n, 2, 'add', y FROM both_lines WHERE x <> y AND y <> '')
    SELECT id, kind, content,
      CASE WHEN kind <> 'add' THEN count(*) FILTER (WHERE kind <> 'add') OVER w END AS old_no,
      CASE WHEN kind <> 'remove' THEN count(*) FILTER (WHERE kind <> 'remove') OVER w END AS new_no
    FROM parts WINDOW w AS (PARTITION BY id ORDER BY n, o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def diff_lines(spark, d):
    return f.diff_lines(diffs(spark, d), "id", "diff").select("id", "kind", "content", "old_no", "new_no")


@R.add(
    "hunk_texts",
    f"""WITH {DIFFS} SELECT id, string_agg(y, chr(10) ORDER BY n) FILTER (WHERE x <> y AND y <> '') AS added,
    count(*) FILTER (WHERE x <> y AND y <> '') AS n_added FROM both_lines GROUP BY 1""",
)
def hunk_texts(spark, d):
    return f.hunk_texts(f.diff_lines(diffs(spark, d), "id", "diff"), "id").select("id", "added", "n_added")


@R.add(
    "block_coverage",
    f"""WITH {FILES}, top AS (SELECT *, lead(n) OVER (PARTITION BY id ORDER BY n) AS nxt FROM heads
      WHERE is_header AND indent = 0 AND id % 3 <> 0),
    b AS (SELECT id, {NAME} AS function_name, n AS start_line, coalesce(nxt - 1, total - 1) AS end_line, 'functions' AS coverage FROM top
      UNION ALL SELECT id, 'HunkAt1', 1, total, 'hunks' FROM flines WHERE id % 3 = 0 AND n = 0)
    SELECT b.*, (SELECT string_agg(CASE WHEN b.coverage = 'hunks' THEN regexp_replace(line, '(def|class|async) ', 'text ', 'g')
      ELSE line END, chr(10) ORDER BY n) FROM flines l WHERE l.id = b.id AND l.n BETWEEN b.start_line AND b.end_line) AS block FROM b""",
)
def block_coverage(spark, d):
    files = source_files(spark, d)
    # Every third file is plain text, so its hunks stand in for blocks.
    plain = F.regexp_replace("content", "(def|class|async) ", "text ")
    files = files.withColumn("content", F.when(F.col("id") % 3 == 0, plain).otherwise(F.col("content")))
    diff = files.select("id", f.positional_diff(F.col("old"), F.col("content")).alias("diff"))
    hunks = f.hunk_blocks(files, f.hunk_texts(f.diff_lines(diff, "id", "diff"), "id"), "id", LOOK_BACK)
    return f.block_coverage(f.function_blocks(files), hunks, "id")


@R.add(
    "name_status",
    """SELECT o_orderkey AS id, unnest(['M', 'A', 'D']) AS status, unnest(['src/a_' || o_custkey || '.py', 'docs/read me.md', 'old_' || o_orderkey]) AS path FROM orders""",
)
def name_status(spark, d):
    return file_lists(spark, d)


@R.add(
    "analyzed_files",
    """SELECT o_orderkey AS id, unnest(['M', 'A']) AS status, unnest(['src/a_' || o_custkey || '.py', 'docs/read me.md']) AS path FROM orders""",
)
def analyzed_files(spark, d):
    return f.without_deleted(file_lists(spark, d))


def file_lists(spark, d):
    text = F.concat(
        F.lit("M\tsrc/a_"), "o_custkey", F.lit(".py\n\nA\tdocs/read me.md\nbroken\nd100  old_"), "o_orderkey", F.lit("\n")
    )
    return f.name_status(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), text.alias("out")), "id", "out")


@R.add(
    "sections",
    f"""WITH {FILES}, c AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^\\s*(def|function|class|async)\\s+') THEN 1 ELSE 0 END)
      OVER (PARTITION BY id ORDER BY n) AS run FROM flines)
    SELECT id, string_agg(line || chr(10), '' ORDER BY n) AS section FROM c GROUP BY id, run""",
)
def sections(spark, d):
    return source_files(spark, d).select("id", F.explode_outer(f.sections(F.col("content"))).alias("section"))


@R.add(
    "segments",
    f"""WITH {FILES}, s AS (SELECT id, unnest(['# @Authorship: human | timestamp=2024-01-01',
      'def f_' || id || '(x):' || chr(10) || '    return x + ' || (size + 1), 'class C_' || id || ':',
      'def g(self):' || chr(10) || '        return ''' || name || '''', 'async def h_' || id || '(y):' || chr(10) || '    return y']) AS segment FROM files)
    SELECT id, segment FROM s WHERE length(segment) > 10 AND (id % 4 = 0 OR NOT starts_with(segment, '#'))""",
)
def segments(spark, d):
    return source_files(spark, d).select("id", F.explode_outer(f.segments(F.col("content"))).alias("segment"))


RANGES = f"""{q.PROVENANCE}, sided AS (SELECT DISTINCT conv_id, block, line_no, CASE WHEN label = 'LLM_GENERATED' THEN 'llm' ELSE 'human' END AS side FROM line_labels),
  isl AS (SELECT *, line_no - row_number() OVER (PARTITION BY conv_id, block, side ORDER BY line_no) AS g FROM sided),
  runs AS (SELECT conv_id, block, side, min(line_no) AS a, max(line_no) AS b FROM isl GROUP BY conv_id, block, side, g),
  ranges AS (SELECT conv_id, block, side, string_agg(CASE WHEN a = b THEN '' || a ELSE a || '-' || b END, ',' ORDER BY a) AS ranges
    FROM runs GROUP BY ALL)"""


@R.add("line_ranges", f"WITH {RANGES} SELECT * FROM ranges")
def line_ranges(spark, d):
    lines = p.line_provenance(code_blocks(spark, d), messages(spark, d))
    return f.line_summary(lines, ["conv_id", "block"])


def tags_of(spark, d):
    """New tag per block; language by conversation, every second block already has a tag."""
    lines = p.line_provenance(code_blocks(spark, d), messages(spark, d))
    blocks = code_blocks(spark, d).select(
        "conv_id", "block", F.when(F.col("conv_id") % 2 == 0, "python").otherwise("sql").alias("language"),
        (F.col("block") * 10).alias("start_line"), (F.col("block") % 2 == 0).alias("has_tag"),
        F.lit("HUMAN_WRITTEN").alias("label"), F.lit("2024-05-06").cast("timestamp").alias("day"),
    )
    return f.block_tags(blocks, lines, ["conv_id", "block"])


TAGS = f"""{q.PROVENANCE}, moved AS (SELECT DISTINCT conv_id, block, block * 10 + line_no + CASE WHEN block % 2 = 0 THEN 0 ELSE 1 END AS line_no,
    CASE WHEN label = 'LLM_GENERATED' THEN 'llm' ELSE 'human' END AS side FROM line_labels),
  isl AS (SELECT *, line_no - row_number() OVER (PARTITION BY conv_id, block, side ORDER BY line_no) AS g FROM moved),
  runs AS (SELECT conv_id, block, side, min(line_no) AS a, max(line_no) AS b FROM isl GROUP BY conv_id, block, side, g),
  ranges AS (SELECT conv_id, block, side, string_agg(CASE WHEN a = b THEN '' || a ELSE a || '-' || b END, ',' ORDER BY a) AS ranges FROM runs GROUP BY ALL),
  sums AS (SELECT conv_id, block, string_agg(side || ' - file lines ' || ranges, '; ' ORDER BY side) AS summary FROM ranges GROUP BY ALL),
  tags AS (SELECT b.conv_id, b.block, CASE WHEN b.conv_id % 2 = 0 THEN '#' ELSE '--' END || ' @Authorship: '
    || coalesce(summary, 'HUMAN_WRITTEN') || ' | timestamp=2024-05-06' AS tag FROM blocks b LEFT JOIN sums s ON b.conv_id = s.conv_id AND b.block = s.block)"""


@R.add(
    "tags",
    f"""WITH {TAGS} SELECT conv_id, block, tag, {q.js_trim("regexp_extract(tag, '@Authorship:" + chr(92) + "s*([^|]+)', 1)")} AS signature,
    split_part(split_part(tag, ': ', 2), ' ', 1) AS label, '2024-05-06' AS stamp FROM tags""",
)
def tags(spark, d):
    parsed = f.parse_tag(F.col("tag"))
    return tags_of(spark, d).select(
        "conv_id", "block", "tag", f.tag_signature(F.col("tag")).alias("signature"),
        parsed["label"].alias("label"), parsed["timestamp"].alias("stamp"),
    )


@R.add(
    "tag_actions",
    f"""WITH {FILES} SELECT id, CASE WHEN id % 4 <> 0 THEN 'insert' WHEN id % 8 = 0 THEN 'keep' ELSE 'replace' END AS action,
    CASE WHEN id % 4 = 0 THEN 1 ELSE 0 END AS line_index,
    '# @Authorship: ' || CASE WHEN id % 8 = 0 THEN 'human' ELSE 'llm' END || ' | timestamp=2024-05-06' AS text FROM files""",
)
def tag_actions(spark, d):
    k = F.col("id")
    new = F.when(k % 8 == 0, "# @Authorship: human | timestamp=2024-05-06").otherwise("# @Authorship: llm | timestamp=2024-05-06")
    rows = source_files(spark, d).select(
        "id", t.split_lines("content").alias("lines"), F.when(k % 4 == 0, 2).otherwise(1).alias("at"), new.alias("tag")
    )
    return f.tag_actions(rows).select("id", "action", "line_index", "text")


@R.add(
    "tag_band_join",
    """WITH a AS (SELECT DISTINCT o_custkey AS id, o_orderkey % 1000 AS line FROM orders),
    b AS (SELECT o_custkey AS id, o_orderkey * 7 % 1000 AS at, o_orderkey AS tag_order, 'tag ' || o_orderkey AS tag FROM orders)
    SELECT a.id, a.line, min(tag_order) AS tag_order, arg_min(tag, tag_order) AS new_tag FROM a JOIN b ON a.id = b.id AND abs(a.line - b.at) < 5 GROUP BY ALL""",
)
def tag_band_join(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    old = o.select(F.col("o_custkey").alias("id"), (k % 1000).alias("line")).distinct()
    new = o.select(F.col("o_custkey").alias("id"), (k * 7 % 1000).alias("at"), k.alias("tag_order"), F.concat(F.lit("tag "), k).alias("tag"))
    return f.tag_band_join(old, new, "id")


@R.add(
    "line_delta",
    f"""WITH {DIFFS}, ol AS (SELECT id, line, n, row_number() OVER (PARTITION BY id, line ORDER BY n) AS c FROM o),
    nl AS (SELECT id, line, n, row_number() OVER (PARTITION BY id, line ORDER BY n) AS c FROM flines),
    chg AS (SELECT coalesce(a.id, b.id) AS id, coalesce(a.n, b.n) AS n, b.n IS NOT NULL AS added, CASE WHEN b.n IS NULL THEN '- ' ELSE '+ ' END || coalesce(a.line, b.line) AS txt
      FROM ol a FULL JOIN nl b ON a.id = b.id AND a.line = b.line AND a.c = b.c WHERE a.n IS NULL OR b.n IS NULL)
    SELECT id, string_agg(txt, chr(10) ORDER BY n, added) AS delta FROM chg GROUP BY 1""",
)
def line_delta(spark, d):
    return f.line_delta(source_files(spark, d), "id", "old", "content")


@R.add("mixed_blocks")
def mixed_blocks(spark, d):
    """Blocks that end in a function of their own, against the code chat."""
    own = F.concat("content", F.lit("\ndef own_"), "conv_id", F.lit("_"), "block", F.lit("(x):\n    return x"))
    chat = code_chat(spark, d)
    return p.mixed_authorship(code_blocks(spark, d).withColumn("content", own), sn.snippets(chat), chat)


def attributed_blocks(spark, d):
    return placed(attributions(spark, d))


def placed(found):
    """Attributions with a commit per conversation and a file per message."""
    return found.select(
        F.concat(F.lit("c"), "conv_id").alias("commit"), F.concat(F.lit("src/m"), "block", F.lit(".py")).alias("file_path"),
        F.concat(F.lit("f_"), "block").alias("function_name"), F.lit(0).alias("start_line"), F.col("block").alias("end_line"),
        "label", "confidence", "reason", "first_turn", "first_role", "first_score", "n_matches",
    )


COMMITS = f"""{ATTRIBUTED}, commits AS (SELECT 'c' || conv_id AS commit, 'src/m' || block || '.py' AS file_path, 'f_' || block AS function_name,
  0 AS start_line, block AS end_line, label, confidence, first_turn, first_role FROM attributed)"""


@R.add(
    "commit_stats",
    f"""WITH {COMMITS} SELECT commit, CAST(sum(end_line - start_line) AS BIGINT) AS total_new_lines, count(*) AS analyzed_lines,
    CAST(sum(end_line - start_line + 1) AS BIGINT) AS total_new_lines_inclusive,
    count(*) FILTER (WHERE label = 'LLM_GENERATED') AS llm_generated, count(*) FILTER (WHERE label = 'HUMAN_PROMPT_ORIGIN') AS human_prompt,
    count(*) FILTER (WHERE label = 'HUMAN_WRITTEN') AS human_written, count(*) FILTER (WHERE label = 'MIXED') AS mixed,
    count(*) FILTER (WHERE label = 'UNCERTAIN') AS uncertain FROM commits GROUP BY 1""",
)
def commit_stats(spark, d):
    return reports.commit_stats(attributed_blocks(spark, d))


def logged_blocks(spark, d):
    """The attributions with the tag each block would get and its three best matching snippets."""
    keys = ["conv_id", "block"]
    found, ranked = p.attribute_and_rank(code_blocks(spark, d), sn.snippets(fenced(spark, d)), messages(spark, d), 3)
    language = F.when(F.col("conv_id") % 2 == 0, "python").otherwise("go")
    tag = f.tag_text(language, F.col("label"), F.lit("2024-05-06").cast("timestamp"))
    return reports.with_matches(found, ranked, tuple(keys)).select(
        F.concat(F.lit("c"), "conv_id").alias("commit"), F.concat(F.lit("src/m"), "block", F.lit(".py")).alias("file_path"),
        F.concat(F.lit("f_"), "block").alias("function_name"), F.lit(0).alias("start_line"), F.col("block").alias("end_line"),
        "label", "confidence", "reason", "first_turn", "first_role", "first_score", "n_matches", tag.alias("tag"), "matches",
    )


@R.add("commit_log")
def commit_log(spark, d):
    return reports.commit_log(logged_blocks(spark, d))


@R.add(
    "commit_log_matches",
    f"""WITH {ATTRIBUTED}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, block ORDER BY score DESC, turn) AS rank FROM hits),
    m AS (SELECT conv_id, block, rank, turn, role, kind, round(score, 6) AS score FROM r WHERE rank <= 3)
    SELECT 'c' || a.conv_id AS commit, 'src/m' || a.block || '.py' AS file, CASE WHEN a.conv_id % 2 = 0 THEN '#' ELSE '//' END || ' @Authorship: ' || label || ' | timestamp=2024-05-06' AS tag,
      rank, turn, role, kind, score
    FROM attributed a LEFT JOIN m ON a.conv_id = m.conv_id AND a.block = m.block""",
)
def commit_log_matches(spark, d):
    """Tags and ranked matches as they read back from the log documents."""
    shape = "struct<commit:string,filePath:string,tag:string,matches:array<struct<rank:int,messageIndex:bigint,messageRole:string,similarityScore:double,matchType:string>>>"
    lines = commit_log(spark, d).where("line_no > 0").select(F.from_json("line", shape).alias("e")).select("e.*")
    return lines.select("commit", F.col("filePath").alias("file"), "tag", F.explode_outer("matches").alias("m")).select(
        "commit", "file", "tag", "m.rank", F.col("m.messageIndex").alias("turn"), F.col("m.messageRole").alias("role"), F.col("m.matchType").alias("kind"),
        F.col("m.similarityScore").alias("score"),
    )


@R.add(
    "attr_csv",
    f"""WITH {COMMITS}, reasons AS (SELECT 'c' || conv_id AS commit, block AS end_line, CASE WHEN first_turn IS NULL THEN 'not found in the conversation'
      WHEN first_role = 'user' THEN 'first seen in user message ' || first_turn WHEN echoed THEN 'taken from the user prompt before the reply'
      ELSE 'first seen in assistant message ' || first_turn END AS reason FROM flagged)
    SELECT file_path, function_name, start_line || '-' || end_line AS line_range, label,
    format('{{:.1f}}%', confidence * 100) AS confidence, CASE WHEN first_turn IS NULL THEN 'Not Found' ELSE 'Message ' || first_turn END AS first_appearance,
    coalesce(first_role, 'N/A') AS source_role, '"' || reason || '"' AS reasoning FROM commits JOIN reasons USING (commit, end_line)""",
)
def attr_csv(spark, d):
    return reports.csv_rows(attributed_blocks(spark, d))


@R.add(
    "prompt_table",
    """SELECT doc_id AS id, length(text) AS n, 'controlled_exact_edit_v2_deletion_marker' AS prompt_version FROM documents""",
)
def prompt_table(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit("x = 1").alias("old_code"), F.col("text").alias("requirement"))
    made = reports.prompt_table(rows)
    frame = F.length(F.lit(reports.FUNCTION_PROMPT)) - len("{old_code}") - len("{requirement}") + len("x = 1")
    return made.select("id", (F.length("user_prompt") - frame).alias("n"), "prompt_version")


LOG_SCHEMA = "commit string, commitHash string, functionName string, detectedLabel string, confidenceScore double, firstMatchSource string"


@R.add(
    "function_log",
    f"""WITH {COMMITS} SELECT commit, file_path AS "commitHash", function_name AS "functionName", label AS "detectedLabel", confidence AS "confidenceScore",
    CASE WHEN first_turn IS NULL THEN 'not_found' WHEN first_role = 'user' THEN 'user_prompt' ELSE 'chatbot_response' END AS "firstMatchSource" FROM commits""",
)
def function_log(spark, d):
    """The per-function log, appended as JSON lines and read back."""
    path = scratch_path(spark, "log")
    reports.append_log(attributed_blocks(spark, d), path)
    return spark.read.schema(LOG_SCHEMA).json(path)
