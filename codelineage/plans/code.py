"""Queries: parsing, edit scripts, change mining, mutations and syntax graphs."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codelineage.functions import pycode
from codelineage.functions.text import normalize_code
from codelineage.operators import astdelta as x
from codelineage.operators import mining as m
from codelineage.operators import mutation as mu
from codelineage.plans.base import Registry
from codelineage.plans.sqltext import MERSENNE
from codelineage.session import scratch_path
from codelineage.sources.csv_files import read_header_csv, read_taxonomy, write_topics
from codelineage.session import checkpointed
from codelineage.sources.tables import spread_table, table

R = Registry()


def one_liner(key, value):
    return F.concat(F.lit("def f_"), key, F.lit("(x):\n    return x + "), value, F.lit("\n"))


def triples(spark, d):
    """Old, human and generated function per part; the generated edit is right, wrong or missing by thirds."""
    k, s = F.col("p_partkey"), F.col("p_size")
    llm = F.when(k % 3 == 0, one_liner(k, s + 1)).when(k % 3 == 1, one_liner(k, s + 2)).otherwise(one_liner(k, s))
    return spread_table(spark, d, "part").select(
        k.alias("id"), one_liner(k, s).alias("old"), one_liner(k, s + 1).alias("human"), llm.alias("llm")
    )


@R.add(
    "parse_modes",
    """SELECT p_partkey AS id, ['module', 'wrapped_function_body', NULL][p_partkey % 3 + 1] AS mode,
    CASE WHEN p_partkey % 3 = 2 THEN 'SyntaxError: unmatched '')'' (<unknown>, line 3)' END AS error FROM part""",
)
def parse_modes(spark, d):
    """A third of the texts are whole functions, a third bodies under a comment, a third broken."""
    k = F.col("id")
    body = F.lit("# note\n    y = 1\n    return y\n")
    code = F.when(k % 3 == 0, F.col("old")).when(k % 3 == 1, body).otherwise(F.concat("old", F.lit(")")))
    info = triples(spark, d).select("id", pycode.parse_info(normalize_code(code)).alias("i"))
    return info.select("id", "i.mode", "i.error")


def modules(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    return spread_table(spark, d, "part").select(
        k.alias("id"),
        F.concat(
            F.lit("class C_"), k, F.lit(":\n    def g(self):\n        def h():\n            return "), s,
            F.lit("\n        return h\n\nasync def g():\n    pass\n\ndef g():\n    return 2\n"),
        ).alias("code"),
    )


@R.add(
    "functions",
    """SELECT p_partkey AS id, unnest(['C_' || p_partkey || '.g', 'C_' || p_partkey || '.g.h', 'g']) AS name,
    unnest([2, 3, 10]) AS start_line, unnest([5, 4, 11]) AS end_line FROM part""",
)
def functions(spark, d):
    found = modules(spark, d).select("id", pycode.extract_functions(F.col("code")).alias("found"))
    return found.select("id", F.inline("found")).select("id", "name", "start_line", "end_line")


@R.add(
    "ast_changed",
    "SELECT p_partkey AS id, p_partkey % 3 <> 2 AS changed FROM part",
)
def ast_changed(spark, d):
    t = triples(spark, d)
    return t.select("id", (pycode.tree_fingerprint(F.col("old")) != pycode.tree_fingerprint(F.col("llm"))).alias("changed"))


# The generated one-liner has ten nodes: (type, parent, field, path, statement, detail).
FEATURES = """shape(node_type, parent_type, field, path, statement, detail) AS (VALUES
  ('Module', 'ROOT', 'root', '', 'ROOT', ''),
  ('FunctionDef', 'Module', 'body[0]', 'Module', 'FunctionDef:F', 'F'),
  ('arguments', 'FunctionDef', 'args', 'Module>FunctionDef', 'FunctionDef:F', ''),
  ('arg', 'arguments', 'args[0]', 'Module>FunctionDef>arguments', 'FunctionDef:F', 'x'),
  ('Return', 'FunctionDef', 'body[0]', 'Module>FunctionDef', 'Return', ''),
  ('BinOp', 'Return', 'value', 'Module>FunctionDef>Return', 'Return', ''),
  ('Name', 'BinOp', 'left', 'Module>FunctionDef>Return>BinOp', 'Return', 'x'),
  ('Load', 'Name', 'ctx', 'FunctionDef>Return>BinOp>Name', 'Return', ''),
  ('Add', 'BinOp', 'op', 'Module>FunctionDef>Return>BinOp', 'Return', 'Add'),
  ('Constant', 'BinOp', 'right', 'Module>FunctionDef>Return>BinOp', 'Return', 'N'))"""


@R.add(
    "ast_features",
    f"""WITH {FEATURES} SELECT p_partkey AS id, node_type, parent_type, field, path,
    replace(statement, ':F', ':f_' || p_partkey) AS statement,
    CASE detail WHEN 'F' THEN 'f_' || p_partkey WHEN 'N' THEN '' || p_size ELSE detail END AS detail, 1 AS n FROM part, shape""",
)
def ast_features(spark, d):
    counts = x.feature_counts(x.parsed_sides(triples(spark, d), {"o": "old"}), ["o"])
    return counts.select("id", *x.KEY, F.col("n_o").alias("n"))


@R.add(
    "multiset_except",
    """SELECT p_partkey AS id, 'Constant' AS node_type, '' || p_size AS detail, 1 AS surplus FROM part WHERE p_partkey % 3 <> 2""",
)
def multiset_except(spark, d):
    counts = x.feature_counts(x.parsed_sides(triples(spark, d), {"o": "old", "g": "llm"}), ["o", "g"])
    return x.multiset_except(counts, "o", "g").select("id", "node_type", "detail", "surplus")


@R.add(
    "edit_script",
    """SELECT p_partkey AS id, 'Update' AS operation, 'Constant' AS node_type, 'BinOp' AS parent_type, 'right' AS field,
    'Module>FunctionDef>Return>BinOp' AS path, 'Return' AS statement, p_size || '->' || (p_size + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 2 END) AS detail,
    1 AS n FROM part WHERE p_partkey % 3 <> 2""",
)
def edit_script(spark, d):
    counts = x.feature_counts(x.parsed_sides(triples(spark, d), {"o": "old", "g": "llm"}), ["o", "g"])
    return x.edit_script(counts, "o", "g")


@R.add(
    "ast_delta_scores",
    """SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS ast_delta_similarity,
    CASE WHEN p_partkey % 3 = 0 THEN 1.0 ELSE 0.9 END::DOUBLE AS final_ast_similarity, 1 AS human_edits,
    CASE WHEN p_partkey % 3 = 2 THEN 0 ELSE 1 END AS llm_edits, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS matched_edits FROM part""",
)
def ast_delta_scores(spark, d):
    scores = x.delta_scores(triples(spark, d))
    return scores.select(
        "id", F.round("ast_delta_similarity", 9).alias("ast_delta_similarity"), F.round("final_ast_similarity", 9).alias("final_ast_similarity"),
        "human_edits", "llm_edits", "matched_edits",
    )


WORD_COUNTS = """words AS (SELECT conv_id AS id, w, count(*) FILTER (WHERE role = 'user') AS a, count(*) FILTER (WHERE role = 'assistant') AS b
  FROM (SELECT conv_id, role, unnest(string_split(text, ' ')) AS w FROM conversations) GROUP BY ALL),
  sums AS (SELECT id, CAST(sum(least(a, b)) AS BIGINT) AS matched, CAST(sum(a) AS BIGINT) AS l, CAST(sum(b) AS BIGINT) AS r FROM words GROUP BY 1)"""


def word_counts(spark, d):
    """Word multisets of the user and the assistant side of each conversation."""
    w = table(spark, d, "conversations").select(
        F.col("conv_id").alias("id"), "role", F.explode(F.split("text", " ")).alias("w")
    )
    return w.groupBy("id", "w").agg(F.count_if(F.col("role") == "user").alias("a"), F.count_if(F.col("role") == "assistant").alias("b"))


@R.add(
    "multiset_f1",
    f"""WITH {WORD_COUNTS} SELECT id, matched, round(CASE WHEN l = 0 AND r = 0 THEN 1 WHEN l = 0 OR r = 0 THEN 0 ELSE matched::DOUBLE / r END::DOUBLE, 9) AS precision,
    round(CASE WHEN l = 0 AND r = 0 THEN 1 WHEN l = 0 OR r = 0 THEN 0 ELSE matched::DOUBLE / l END::DOUBLE, 9) AS recall,
    round(CASE WHEN l = 0 AND r = 0 THEN 1 WHEN l = 0 OR r = 0 THEN 0 ELSE 2.0 * matched / (l + r) END::DOUBLE, 9) AS f1 FROM sums""",
)
def multiset_f1(spark, d):
    s = x.multiset_scores(word_counts(spark, d), "a", "b")
    scores = x.precision_recall_f1(F.col("matched"), F.col("left"), F.col("right"))
    return s.select("id", "matched", *[F.round(c, 9).alias(n) for n, c in scores.items()])


@R.add(
    "multiset_dice",
    f"WITH {WORD_COUNTS} SELECT id, round(CASE WHEN l = 0 AND r = 0 THEN 1 WHEN l = 0 OR r = 0 THEN 0 ELSE 2.0 * matched / (l + r) END::DOUBLE, 9) AS dice FROM sums",
)
def multiset_dice(spark, d):
    s = x.multiset_scores(word_counts(spark, d), "a", "b")
    return s.select("id", F.round(x.dice(F.col("matched"), F.col("left"), F.col("right")), 9).alias("dice"))


# Node, parent, type, field, depth of the generated one-liner.
NODES = """nodes AS (SELECT p_partkey AS id, * FROM part, (VALUES (0, NULL, 'Module', 'root', 0), (1, 0, 'FunctionDef', 'body', 1), (2, 1, 'arguments', 'args', 2),
  (3, 2, 'arg', 'args', 3), (4, 1, 'Return', 'body', 2), (5, 4, 'BinOp', 'value', 3), (6, 5, 'Name', 'left', 4), (7, 6, 'Load', 'ctx', 5),
  (8, 5, 'Add', 'op', 4), (9, 5, 'Constant', 'right', 4)) s(node, parent, type, field, depth))"""


@R.add(
    "ast_nodes",
    f"""WITH {NODES} SELECT id, node, parent, type, field, depth, CASE type WHEN 'FunctionDef' THEN 'f ' || id WHEN 'arg' THEN 'x' WHEN 'Name' THEN 'x'
    WHEN 'Constant' THEN '' || p_size ELSE '' END AS lexemes FROM nodes""",
)
def ast_nodes(spark, d):
    return x.ast_nodes(triples(spark, d), "old").withColumn("lexemes", F.array_join("lexemes", " "))


@R.add(
    "ast_edges",
    f"""WITH {NODES} SELECT id, parent AS src, node AS dst, 'ast_parent_to_child' AS relation FROM nodes WHERE parent IS NOT NULL
    UNION ALL SELECT id, node, parent, 'ast_child_to_parent' FROM nodes WHERE parent IS NOT NULL""",
)
def ast_edges(spark, d):
    return x.ast_edges(x.ast_nodes(triples(spark, d), "old"))


@R.add(
    "neighbor_agg",
    """WITH nodes AS (SELECT o_custkey AS graph, o_orderkey AS node, o_totalprice AS v FROM orders),
    up AS (SELECT graph, node AS src, lead(node) OVER (PARTITION BY graph ORDER BY node) AS dst FROM nodes),
    edges AS (SELECT * FROM up WHERE dst IS NOT NULL UNION ALL SELECT graph, dst, src FROM up WHERE dst IS NOT NULL),
    m1 AS (SELECT e.graph, e.dst AS node, avg(s.v) AS m FROM edges e JOIN nodes s ON s.node = e.src AND s.graph = e.graph GROUP BY ALL),
    s1 AS (SELECT n.graph, n.node, v + coalesce(m, 0) AS v FROM nodes n LEFT JOIN m1 ON n.graph = m1.graph AND n.node = m1.node),
    m2 AS (SELECT e.graph, e.dst AS node, avg(s.v) AS m FROM edges e JOIN s1 s ON s.node = e.src AND s.graph = e.graph GROUP BY ALL),
    s2 AS (SELECT n.graph, n.node, v + coalesce(m, 0) AS v FROM s1 n LEFT JOIN m2 ON n.graph = m2.graph AND n.node = m2.node)
    SELECT graph, round(avg(v), 6) AS mean_state, round(max(v), 6) AS max_state FROM s2 GROUP BY 1""",
)
def neighbor_agg(spark, d):
    """Orders of a customer as a chain graph with edges both ways."""
    nodes = table(spark, d, "orders").select(
        F.col("o_custkey").alias("graph"), F.col("o_orderkey").alias("node"), F.col("o_totalprice").alias("v")
    )
    nxt = F.lead("node").over(W.partitionBy("graph").orderBy("node"))
    up = nodes.select("graph", F.col("node").alias("src"), nxt.alias("dst")).where(F.col("dst").isNotNull())
    edges = up.unionByName(up.select("graph", F.col("dst").alias("src"), F.col("src").alias("dst")))
    pooled = x.graph_pool(x.neighbor_mean(nodes, edges, "v"))
    return pooled.select("graph", F.round("mean_state", 6).alias("mean_state"), F.round("max_state", 6).alias("max_state"))


RELATIONS = {"next": 1.0, "previous": 0.5, "same_priority_next": 0.25, "same_priority_previous": 0.125}


def _relation_round(n: int) -> str:
    """One round over the states of the round before."""
    return f"""m{n} AS (SELECT e.graph, e.dst AS node, relation, avg(s.v) AS m FROM edges e JOIN s{n - 1} s ON s.node = e.src AND s.graph = e.graph GROUP BY ALL),
    t{n} AS (SELECT graph, node, sum(m * w) AS told FROM m{n} JOIN weights USING (relation) GROUP BY ALL),
    s{n} AS (SELECT s.graph, s.node, v + coalesce(told, 0) AS v FROM s{n - 1} s LEFT JOIN t{n} t ON s.graph = t.graph AND s.node = t.node)"""


@R.add(
    "relation_agg",
    f"""WITH s0 AS (SELECT o_custkey AS graph, o_orderkey AS node, o_totalprice AS v, o_orderpriority AS kind FROM orders),
    up AS (SELECT graph, node AS src, lead(node) OVER (PARTITION BY graph ORDER BY node) AS a, lead(node) OVER (PARTITION BY graph, kind ORDER BY node) AS b FROM s0),
    edges AS (SELECT graph, src, a AS dst, 'next' AS relation FROM up WHERE a IS NOT NULL UNION ALL SELECT graph, a, src, 'previous' FROM up WHERE a IS NOT NULL
      UNION ALL SELECT graph, src, b, 'same_priority_next' FROM up WHERE b IS NOT NULL UNION ALL SELECT graph, b, src, 'same_priority_previous' FROM up WHERE b IS NOT NULL),
    weights(relation, w) AS (VALUES {", ".join(f"('{r}', {w}::DOUBLE)" for r, w in RELATIONS.items())}),
    {_relation_round(1)}, {_relation_round(2)}, {_relation_round(3)}
    SELECT graph, round(avg(v), 4) AS mean_state, round(max(v), 4) AS max_state FROM s3 GROUP BY 1""",
)
def relation_agg(spark, d):
    """Orders of a customer in two chains, of all and of equal priority, each with edges both ways; three rounds."""
    nodes = table(spark, d, "orders").select(
        F.col("o_custkey").alias("graph"), F.col("o_orderkey").alias("node"), F.col("o_totalprice").alias("v"), F.col("o_orderpriority").alias("kind")
    )
    chain = lambda *by: F.lead("node").over(W.partitionBy("graph", *by).orderBy("node"))
    up = nodes.select("graph", "node", chain().alias("a"), chain("kind").alias("b"))
    edge = lambda src, dst, kind: F.when(F.col(src).isNotNull() & F.col(dst).isNotNull(), F.struct(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(kind).alias("relation")))
    listed = F.array(edge("node", "a", "next"), edge("a", "node", "previous"), edge("node", "b", "same_priority_next"), edge("b", "node", "same_priority_previous"))
    edges = up.select("graph", F.inline(F.array_compact(listed)))
    pooled = x.graph_pool(x.relation_mean(nodes, edges, "v", RELATIONS, rounds=3))
    return pooled.select("graph", F.round("mean_state", 4).alias("mean_state"), F.round("max_state", 4).alias("max_state"))


@R.add(
    "vocabulary",
    """WITH t AS (SELECT event_id, event_type || '_' || CAST(json_extract_string(props, '$.k') AS INTEGER) AS value FROM events WHERE event_id % 10 < 7),
    f AS (SELECT value, min(event_id) AS first FROM t GROUP BY 1), v AS (SELECT value, row_number() OVER (ORDER BY first) + 1 AS value_id FROM f),
    a AS (SELECT event_type || '_' || CAST(json_extract_string(props, '$.k') AS INTEGER) AS value FROM events)
    SELECT a.value, coalesce(v.value_id, 1) AS value_id, count(*) AS n FROM a LEFT JOIN v ON a.value = v.value GROUP BY ALL""",
)
def vocabulary(spark, d):
    rows = table(spark, d, "events").select("event_id", F.concat_ws("_", "event_type", F.get_json_object("props", "$.k")).alias("value"))
    vocab = x.vocabulary(rows.where(F.col("event_id") % 10 < 7), "value", ["event_id"])
    return x.encode(rows, vocab, "value").groupBy("value", "value_id").agg(F.count("*").alias("n"))


# --- mining ------------------------------------------------------------------


def repos(spark, d):
    """A repository per ten customers, as in ``files``, with attributes from all of them."""
    k = F.col("c_custkey")
    late = F.count_if(k % 170 == 6) > 0
    return table(spark, d, "customer").groupBy(F.floor(k / 10).alias("n")).agg(
        (F.sum("c_nationkey") * 10).alias("stars"),
        F.when(F.count_if(F.col("c_mktsegment") == "BUILDING") < 4, "Python").otherwise("Go").alias("language"),
        (F.count_if(k % 70 == 3) > 0).alias("private"), (F.count_if(k % 110 == 4) > 0).alias("archived"),
        F.when(F.count_if(k % 130 == 5) > 0, True).alias("fork"),
        F.when(late, F.lit("2023-01-01 00:00:00")).otherwise(F.lit("2022-12-31 23:59:59")).cast("timestamp").alias("created_at"),
    ).withColumn("repo", F.concat(F.lit("repo_"), F.col("n"))).drop("n")


REPOS = """repos AS (SELECT 'repo_' || (c_custkey // 10) AS repo, CAST(sum(c_nationkey) * 10 AS BIGINT) AS stars, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS building,
    count(*) FILTER (WHERE c_custkey % 70 = 3 OR c_custkey % 110 = 4 OR c_custkey % 130 = 5 OR c_custkey % 170 = 6) AS out FROM customer GROUP BY 1),
  good AS (SELECT * FROM repos WHERE building < 4 AND out = 0)"""


@R.add("repo_rules", f"WITH {REPOS} SELECT repo, stars FROM good")
@R.add("all_repo_rules", f"WITH {REPOS} SELECT repo, stars FROM good")
def repo_rules(spark, d):
    return m.repo_rules(repos(spark, d)).select("repo", "stars")


def files(spark, d):
    """Ten files per repository; a README now and then."""
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        F.concat(F.lit("repo_"), F.floor(k / 10)).alias("repo"),
        F.concat(F.lit("src/f_"), k, F.when(k % 13 == 0, ".md").otherwise(".py")).alias("path"),
        F.when(k % 17 == 0, "tree").otherwise("blob").alias("type"), (k % 10).alias("tree_pos"),
    )


FILES = """tree AS (SELECT 'repo_' || (c_custkey // 10) AS repo, 'src/f_' || c_custkey || '.py' AS path, c_custkey % 10 AS tree_pos,
    row_number() OVER (PARTITION BY c_custkey // 10 ORDER BY c_custkey) AS nth FROM customer WHERE c_custkey % 13 <> 0 AND c_custkey % 17 <> 0)"""


@R.add("file_cap", f"WITH {FILES} SELECT repo, path, nth FROM tree WHERE nth <= 6")
def file_cap(spark, d):
    return m.file_cap(files(spark, d), 6).select("repo", "path", "nth")


def commits(spark, d):
    """Orders as commits of one file per customer, newest first."""
    k = F.col("o_custkey")
    newest = W.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return table(spark, d, "orders").select(
        F.concat(F.lit("repo_"), F.floor(k / 10)).alias("repo"), F.concat(F.lit("src/f_"), k, F.lit(".py")).alias("path"),
        F.col("o_orderkey").alias("sha"), F.col("o_orderdate").alias("author_date"), F.col("o_orderpriority").alias("message"),
        F.row_number().over(newest).alias("list_pos"),
    )


def versions(spark, d):
    """File text per commit: one function follows the price level, one never changes; some versions do not decode."""
    k, level = F.col("o_custkey"), F.floor(F.col("o_totalprice") / 100000)
    text = F.concat(F.lit("def f(x):\n    return x + "), level, F.lit("\n\n\ndef g(y):\n    # "), F.col("o_orderkey"), F.lit("\n    return y\n"))
    bad = F.col("o_orderkey") % 9 == 0
    raw = F.when(bad, F.unhex(F.lit("FFFE"))).otherwise(F.encode(text, "UTF-8"))
    return m.decoded(
        spread_table(spark, d, "orders").select(
            F.concat(F.lit("repo_"), F.floor(k / 10)).alias("repo"), F.concat(F.lit("src/f_"), k, F.lit(".py")).alias("path"),
            F.col("o_orderkey").alias("sha"), F.base64(raw).alias("content_b64"),
        ),
        limit=m.MAX_FILE_BYTES,
    ).drop("content_b64")


CUTOFF = "2001-06-30 00:00:00"
PAIRS = f"""ranked AS (SELECT o_custkey AS k, o_orderkey AS sha, o_orderdate, o_orderpriority, floor(o_totalprice / 100000) AS level,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS nth FROM orders WHERE o_orderdate <= TIMESTAMP '{CUTOFF}'),
  adj AS (SELECT *, lead(sha) OVER w AS old_sha, lead(level) OVER w AS old_level, lead(o_orderdate) OVER w AS old_date, lead(o_orderpriority) OVER w AS old_message FROM ranked WHERE nth <= 50 WINDOW w AS (PARTITION BY k ORDER BY nth)),
  hit AS (SELECT * FROM adj WHERE sha % 9 <> 0 AND old_sha % 9 <> 0 AND level <> old_level QUALIFY row_number() OVER (PARTITION BY k ORDER BY nth) = 1),
  pairs AS (SELECT 'repo_' || (k // 10) AS repo, 'src/f_' || k || '.py' AS path, k, sha AS new_sha, old_sha, nth,
    level AS new_level, old_level, o_orderdate AS new_date, old_date, o_orderpriority AS new_message, old_message FROM hit)"""


def considered(spark, d):
    return m.considered_commits(commits(spark, d), CUTOFF, m.COMMITS_PER_FILE)


def changes(spark, d):
    """The changed functions by name; their code is fetched only where a query shows it."""
    return m.changed_names(considered(spark, d), versions(spark, d))


@R.add(
    "changed_functions",
    f"""WITH {PAIRS} SELECT repo, path, 'f' AS function_name, old_sha, new_sha, nth AS pair, CAST(new_level AS BIGINT)::VARCHAR AS new_value,
    CAST(old_level AS BIGINT)::VARCHAR AS old_value, 1 AS new_start_line, 2 AS old_end_line, new_message, old_message FROM pairs""",
)
def changed_functions(spark, d):
    """Both versions of every changed function; the value is what its code returns beyond the argument."""
    found = m.changed_functions(considered(spark, d), versions(spark, d))
    value = lambda side: F.regexp_extract(f"{side}_code", r"(?s)^def f\(x\):\n    return x \+ (\d+)\n$", 1).alias(f"{side}_value")
    return found.select(
        "repo", "path", "function_name", "old_sha", "new_sha", "pair", value("new"), value("old"), "new_start_line", "old_end_line", "new_message", "old_message"
    )


@R.add("latest_change_pair", f"WITH {PAIRS} SELECT repo, path, old_sha, new_sha, nth AS pair FROM pairs")
def latest_change_pair(spark, d):
    return changes(spark, d).select("repo", "path", "old_sha", "new_sha", "pair").distinct()


@R.add(
    "changed_files",
    f"WITH {PAIRS} SELECT repo, path, old_sha, new_sha, date_diff('day', old_date, new_date) AS days, 1 AS changed_functions FROM pairs",
)
def changed_files(spark, d):
    both = m.with_commits(changes(spark, d), considered(spark, d))
    days = F.datediff("new_author_date", "old_author_date").cast("long").alias("days")
    return m.changed_files(both).select("repo", "path", "old_sha", "new_sha", days, "changed_functions")


VALID = f"""{REPOS}, {FILES}, {PAIRS}, placed AS (SELECT p.*, t.tree_pos, row_number() OVER (PARTITION BY p.repo ORDER BY t.tree_pos) AS n
    FROM pairs p JOIN tree t ON p.path = t.path AND p.repo = t.repo),
  valid AS (SELECT * FROM placed WHERE n <= 5 AND repo IN (SELECT repo FROM placed GROUP BY 1 HAVING count(*) >= 5)),
  ranked_repos AS (SELECT g.repo, g.stars, row_number() OVER (ORDER BY g.stars DESC, g.repo) AS rank FROM good g WHERE repo IN (SELECT repo FROM valid))"""


def _valid(spark, d):
    funcs = changes(spark, d)
    return funcs, m.valid_files_cap(m.changed_files(funcs), m.file_cap(files(spark, d), m.FILES_PER_REPO), m.VALID_FILES)


@R.add("valid_files_cap", f"WITH {VALID} SELECT repo, path, 5 AS valid_files, n AS nth FROM valid")
def valid_files_cap(spark, d):
    return _valid(spark, d)[1].select("repo", "path", "valid_files", "nth")


RANKED = f"WITH {VALID} SELECT repo, stars, rank FROM ranked_repos WHERE rank <= 1000"


@R.add("repo_rank", RANKED)
@R.add("all_repo_rank", RANKED)
def repo_rank(spark, d):
    return m.repo_rank(m.repo_rules(repos(spark, d)), _valid(spark, d)[1]).select("repo", "stars", "rank")


FUNCTION_IDS = f"""WITH {VALID} SELECT 'function_' || row_number() OVER (ORDER BY rank, tree_pos) AS id, v.repo, path, rank
    FROM valid v JOIN ranked_repos r ON v.repo = r.repo WHERE rank <= 1000"""


@R.add("function_ids", FUNCTION_IDS)
@R.add("all_function_ids", FUNCTION_IDS)
def function_ids(spark, d):
    # The mined names feed three branches: keep them instead of parsing again. Places come from the code.
    funcs = checkpointed(m.with_code(changes(spark, d), versions(spark, d)))
    valid = m.valid_files_cap(m.changed_files(funcs), m.file_cap(files(spark, d), m.FILES_PER_REPO), m.VALID_FILES)
    ranked = m.repo_rank(m.repo_rules(repos(spark, d)), valid)
    return m.function_ids(ranked, valid, funcs).select("id", "repo", "path", "rank")


@R.add(
    "repo_summary",
    f"WITH {PAIRS} SELECT repo, count(*) AS valid_files, count(*) AS changed_functions FROM pairs GROUP BY 1",
)
def repo_summary(spark, d):
    per_file = m.changed_files(changes(spark, d))
    return per_file.groupBy("repo").agg(F.count("*").alias("valid_files"), F.sum("changed_functions").alias("changed_functions"))


# --- mutations ---------------------------------------------------------------


def mutation_sources(spark, d):
    """Generated functions of different make-up: each rule applies to some of them."""
    k, s = F.col("p_partkey"), F.col("p_size")
    rich = F.concat(
        F.lit("def f_"), k, F.lit("(self, value):\n    \"\"\"Return a value.\"\"\"\n    print(value)\n    total = value + "), s,
        F.lit("\n    try:\n        if total < 10:\n            return f'total={total}'\n    except ValueError:\n        return super(Base, self).run()\n    return total\n"),
    )
    broken = F.concat(F.lit("def f_"), k, F.lit("(:\n"))
    split = F.when(k % 10 < 7, "train").when(k % 10 == 7, "validation").otherwise("test")
    code = F.when(k % 4 == 0, rich).when(k % 97 == 1, broken).otherwise(one_liner(k, s))
    return spread_table(spark, d, "part").select(k.alias("source_index"), split.alias("split"), code.alias("code"))


def reviews(spark, d):
    """Reviewed requirement categories, one per customer."""
    names = F.array(*[F.lit(c) for c in mu.RULES.values()], F.lit("other"))
    segment = F.col("c_mktsegment")
    decision = F.when(segment == "BUILDING", "accept").when(segment == "MACHINERY", "correct").otherwise("reject")
    return table(spark, d, "customer").select(
        F.element_at(names, (F.col("c_custkey") % 11 + 1).cast("int")).alias("author_final_category"), decision.alias("author_decision")
    )


@R.add(
    "taxonomy_csv",
    """WITH cats(c, i) AS (VALUES ('documentation_edit', 0), ('statement_removal', 1), ('literal_path_url_or_config', 2), ('return_statement_edit', 3),
      ('condition_or_comparison_edit', 4), ('exception_handling_edit', 5), ('string_formatting_edit', 6), ('type_annotation_edit', 7), ('super_call_modernization', 8),
      ('identifier_rename', 9), ('other', 10))
    SELECT c AS category, count(*) AS reviewed, count(*) FILTER (WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')) AS retained
    FROM customer JOIN cats ON i = c_custkey % 11 GROUP BY 1""",
)
def taxonomy_csv(spark, d):
    """The reviews written as CSV with a header and read back, checked for support of every rule."""
    path = scratch_path(spark, "taxonomy")
    reviews(spark, d).write.option("header", True).csv(path)
    rows = read_taxonomy(spark, path, list(mu.RULES.values()))
    retained = F.col("author_decision").isin("accept", "correct")
    return rows.groupBy(F.col("author_final_category").alias("category")).agg(F.count("*").alias("reviewed"), F.count_if(retained).alias("retained"))


@R.add(
    "topic_csv",
    """SELECT p_brand AS topic, count(*)::VARCHAR AS documents, string_agg(DISTINCT p_type, ' | ' ORDER BY p_type) AS words FROM part GROUP BY 1""",
)
def topic_csv(spark, d):
    """A topic per brand with its part types as words, written as CSV and read back."""
    path = scratch_path(spark, "topics")
    words = F.array_sort(F.collect_set("p_type"))  # at most one per part type
    write_topics(table(spark, d, "part").groupBy(F.col("p_brand").alias("topic")).agg(F.count("*").alias("documents"), words.alias("words")), path)
    return read_header_csv(spark, path, ("topic", "documents", "words"))


@R.add(
    "taxonomy_support",
    """WITH cats AS (SELECT unnest(['documentation_edit', 'statement_removal', 'literal_path_url_or_config', 'return_statement_edit', 'condition_or_comparison_edit',
      'exception_handling_edit', 'string_formatting_edit', 'type_annotation_edit', 'super_call_modernization', 'identifier_rename']) AS c, unnest(range(10)) AS i)
    SELECT c AS taxonomy_category, (SELECT count(*) FROM part) AS attempts, (SELECT count(*) FROM customer WHERE c_custkey % 11 = i AND c_mktsegment IN ('BUILDING', 'MACHINERY')) AS support FROM cats""",
)
def taxonomy_support(spark, d):
    """Reviewed requirement categories (from customers) that support each mutation rule."""
    reviewed = reviews(spark, d)
    grid = mu.cohort_grid(table(spark, d, "part").select(F.col("p_partkey").alias("source_index")))
    tried = grid.groupBy("mutation_operator").agg(F.count("*").alias("attempts"))
    named = tried.withColumn("taxonomy_category", mu._from(mu.RULES, F.col("mutation_operator")))
    return mu.with_support(named, reviewed).select("taxonomy_category", "attempts", "support")


# Every option of every rule over the sources above, as (place of a text, its replacement).
MUTATION_OPTIONS = r"""sources AS (
    SELECT p_partkey AS k, p_size AS s, p_partkey % 4 = 0 AS rich, CASE WHEN p_partkey % 10 < 7 THEN 'train' WHEN p_partkey % 10 = 7 THEN 'validation' ELSE 'test' END AS split,
      'def f_' || p_partkey || CASE WHEN p_partkey % 4 = 0 THEN
        '(self, value):\n    """ + '"""Return a value."""' + r"""\n    print(value)\n    total = value + ' || p_size
        || '\n    try:\n        if total < 10:\n            return f''total={total}''\n    except ValueError:\n        return super(Base, self).run()\n    return total\n'
        ELSE '(x):\n    return x + ' || p_size || '\n' END AS raw
    FROM part WHERE p_partkey % 4 = 0 OR p_partkey % 97 <> 1
  ), code AS (SELECT k, s, rich, split, replace(raw, '\n', chr(10)) AS old_code FROM sources),
  fixed(op, nth, line, col, old, new, find, put) AS (VALUES
    ('modify_docstring_text', 1, 2, 4, '''Return a value.''', '''Return a value. Synthetic clarification added.''', 'Return a value.', 'Return a value. Synthetic clarification added.'),
    ('remove_output_statement', 1, 3, 4, 'print(value)', '<deleted>', '    print(value)' || chr(10), ''),
    ('replace_literal_value', 2, 6, 19, '10', '11', 'total < 10', 'total < 11'),
    ('modify_return_expression', 1, 10, 4, 'total', 'None', '    return total' || chr(10), '    return None' || chr(10)),
    ('modify_return_expression', 2, 7, 12, 'f''total={total}''', 'None', 'return f''total={total}''', 'return None'),
    ('modify_return_expression', 3, 9, 8, 'super(Base, self).run()', 'None', 'return super(Base, self).run()', 'return None'),
    ('modify_comparison_operator', 1, 6, 11, 'total < 10', 'total <= 10', 'total < 10', 'total <= 10'),
    ('modify_exception_handler', 1, 8, 4, 'except ValueError', 'except Exception', 'except ValueError', 'except Exception'),
    ('modernize_string_formatting', 1, 7, 19, 'f''total={total}''', '''total={}''.format(total)', 'f''total={total}''', '''total={}''.format(total)'),
    ('modernize_super_call', 1, 9, 15, 'super(Base, self)', 'super()', 'super(Base, self)', 'super()'),
    ('rename_local_identifier', 1, 4, 4, 'total', 'total_updated', NULL, NULL)
  ), options AS (
    SELECT k, op, nth, line, col, old, new, CASE WHEN find IS NULL THEN replace(replace(old_code, 'total', 'total_updated'), 'total_updated={', 'total={')
      ELSE replace(old_code, find, put) END AS result FROM code, fixed WHERE rich
    UNION ALL SELECT k, 'replace_literal_value', 1, 4, 20, '' || s, '' || (s + 1), replace(old_code, 'value + ' || s, 'value + ' || (s + 1)) FROM code WHERE rich
    UNION ALL SELECT k, 'modify_type_annotation', 1, 1, length('def f_' || k || '(self, '), 'value', 'value: object', replace(old_code, '(self, value)', '(self, value: object)') FROM code WHERE rich
    UNION ALL SELECT k, 'replace_literal_value', 1, 2, 15, '' || s, '' || (s + 1), replace(old_code, 'x + ' || s, 'x + ' || (s + 1)) FROM code WHERE NOT rich
    UNION ALL SELECT k, 'modify_return_expression', 1, 2, 4, 'x + ' || s, 'None', replace(old_code, 'x + ' || s, 'None') FROM code WHERE NOT rich
    UNION ALL SELECT k, 'modify_type_annotation', 1, 1, length('def f_' || k || '('), 'x', 'x: object', replace(old_code, '(x)', '(x: object)') FROM code WHERE NOT rich
  )"""
# The pick among several options by the seeded generator, and the finished mutations.
MUTATED = f"""RECURSIVE {MUTATION_OPTIONS},
  counted AS (SELECT k, op, count(*) AS n FROM options GROUP BY ALL),
  asked AS (SELECT k, op, n, substr(sha256('fusion-guided-v1' || chr(0) || op || chr(0) || old_code), 1, 16) AS seed FROM counted JOIN code USING (k)),
  seeds AS (SELECT DISTINCT seed, n FROM asked WHERE n > 1), {MERSENNE},
  rules(op, category, said) AS (VALUES {", ".join(f"('{r}', '{c}', '{mu.INSTRUCTIONS[r]}')" for r, c in mu.RULES.items())}),
  mutated AS (
    SELECT 'fgm_cohort_v1_' || split || '_' || k || '_' || op AS id, k AS source_index, split AS source_split, op AS mutation_operator, category AS taxonomy_category,
      'valid' AS status, NULL::VARCHAR AS reason, old_code, result AS expected_mutated_function,
      'In the old function, ' || said || ' at function line ' || line || ', column ' || col || '. Change the exact fragment <before>' || old || '</before> to <after>' || new
        || '</after>. Leave everything else unchanged.' AS requirement, old AS old_fragment, new AS new_fragment, line
    FROM options JOIN asked USING (k, op) LEFT JOIN picks p USING (seed) JOIN code USING (k) JOIN rules USING (op) WHERE nth = coalesce(p.pick, 0) + 1
  )"""
# Fixed value: the longest fragment that the queries take.
LONGEST_FRAGMENT = 300


def mutated(spark, d, **options):
    return mu.mutate(mutation_sources(spark, d), longest=LONGEST_FRAGMENT, **options)


@R.add(
    "mutation_candidates",
    f"""WITH {MUTATION_OPTIONS} SELECT k AS source_index, op AS mutation_operator, nth, line, col AS "column", old, new FROM options""",
)
def mutation_candidates(spark, d):
    """Every place where a rule could edit a source."""
    return mu.mutation_candidates(mutation_sources(spark, d), LONGEST_FRAGMENT).select(
        "source_index", "mutation_operator", "nth", "line", "column", "old", "new"
    )


@R.add("mutations", f"WITH {MUTATED} SELECT * FROM mutated")
def mutations(spark, d):
    out = mutated(spark, d).where("status = 'valid'")
    return out.withColumn("line", F.col("mutation_location.line")).drop("mutation_location")


LITERALS = f"""WITH {MUTATED} SELECT source_index, old_fragment, new_fragment, expected_mutated_function, requirement FROM mutated
    WHERE mutation_operator = 'replace_literal_value'"""


@R.add("literal_mutations", LITERALS)
@R.add("literal_mutations_all", LITERALS)
def literal_mutations(spark, d):
    """Literal edits of every source; rich functions hold two literals, of which the seeded generator picks one."""
    return mutated(spark, d, rules=["replace_literal_value"]).where("status = 'valid'").select(
        "source_index", "old_fragment", "new_fragment", "expected_mutated_function", "requirement"
    )


@R.add(
    "cohort_audit",
    """WITH s AS (SELECT count(*) AS n, count(*) FILTER (WHERE p_partkey % 4 = 0) AS rich, count(*) FILTER (WHERE p_partkey % 4 <> 0 AND p_partkey % 97 = 1) AS broken FROM part)
    SELECT op AS mutation_operator, n AS attempts, CASE WHEN op IN ('replace_literal_value', 'modify_return_expression', 'modify_type_annotation') THEN n - broken ELSE rich END AS valid,
    broken AS failed, n - broken - CASE WHEN op IN ('replace_literal_value', 'modify_return_expression', 'modify_type_annotation') THEN n - broken ELSE rich END AS inapplicable
    FROM s, (SELECT unnest(['modify_docstring_text', 'remove_output_statement', 'replace_literal_value', 'modify_return_expression', 'modify_comparison_operator',
    'modify_exception_handler', 'modernize_string_formatting', 'modify_type_annotation', 'modernize_super_call', 'rename_local_identifier']) AS op)""",
)
def cohort_audit(spark, d):
    return mu.cohort_audit(mutated(spark, d, texts=False))


@R.add(
    "mutations_per_source",
    """SELECT CASE WHEN p_partkey % 4 = 0 THEN 10 WHEN p_partkey % 97 = 1 THEN 0 ELSE 3 END AS mutations, count(*) AS sources FROM part GROUP BY 1""",
)
def mutations_per_source(spark, d):
    return mu.mutations_per_source(mutated(spark, d, texts=False))


@R.add(
    "mutation_quota",
    """WITH rules AS (SELECT unnest(['modify_docstring_text', 'remove_output_statement', 'replace_literal_value', 'modify_return_expression',
      'modify_comparison_operator', 'modify_exception_handler', 'modernize_string_formatting', 'modify_type_annotation', 'modernize_super_call',
      'rename_local_identifier']) AS op),
    v AS (SELECT p_partkey AS k, op, CASE WHEN p_partkey % 10 < 7 THEN 'train' WHEN p_partkey % 10 = 7 THEN 'validation' ELSE 'test' END AS split
      FROM part, rules WHERE p_partkey % 4 = 0
      OR (p_partkey % 97 <> 1 AND op IN ('replace_literal_value', 'modify_return_expression', 'modify_type_annotation'))),
    r AS (SELECT 'fgm_cohort_v1_' || split || '_' || k || '_' || op AS id, split AS source_split, op AS mutation_operator,
      row_number() OVER (PARTITION BY split, op
        ORDER BY sha256('mutation-quota-v1' || chr(0) || '42' || chr(0) || split || chr(0) || op || chr(0) || k)) AS rank,
      CASE split WHEN 'train' THEN 20 WHEN 'validation' THEN 5 ELSE 10 END AS quota FROM v)
    SELECT * FROM r WHERE rank <= quota""",
)
def mutation_quota(spark, d):
    picked = mu.mutation_quota(mutated(spark, d, texts=False), {"train": 20, "validation": 5, "test": 10}, 42)
    return picked.select("id", "source_split", "mutation_operator", "rank", "quota")


@R.add(
    "faithful_check",
    """SELECT p_partkey AS id, p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AS faithful FROM part""",
)
def faithful_check(spark, d):
    k = F.col("p_partkey")
    old = F.when(k % 5 == 0, F.concat("p_name", F.lit("</before>"))).otherwise(F.col("p_name"))
    new = F.concat("p_name", F.lit(" v2"))
    shown = F.when(k % 7 == 0, F.lit("other")).otherwise(new)
    text = F.concat(F.lit("Change <before>"), old, F.lit("</before> to <after>"), shown, F.lit("</after>."))
    return spread_table(spark, d, "part").select(k.alias("id"), mu.is_faithful(text, old, new).alias("faithful"))
