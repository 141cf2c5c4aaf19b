"""Parsing, features, edit scripts, mutations and mining."""

import ast
import hashlib
import random
import re
import weakref
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codelineage.functions import pycode
from codelineage.operators import astdelta as x, mining as m, mutation as mu


def test_parse_modes():
    assert pycode.checked("x = 1")[0] == "module"
    assert pycode.checked("    a = 1\n    return a")[0] == "wrapped_function_body"
    assert pycode.checked("def f(:")[1].startswith("SyntaxError")


def test_functions_nested_last_wins():
    src = "class A:\n    def m(self):\n        def n():\n            pass\n@deco\nasync def f():\n    return 1\ndef f():\n    return 2\n"
    got = {n: (s, e) for n, s, e, *_ in pycode.functions(src)}
    assert got == {"A.m": (2, 4), "A.m.n": (3, 4), "f": (8, 9)}
    assert pycode.functions("def broken(") == []


def test_formatting_does_not_change_the_body_fingerprint():
    a, b = pycode.functions("def f():\n    return 1 + 2")[0], pycode.functions("def f( ):\n\n    return (1+2)  # c")[0]
    assert a[4] == b[4] and a[3] != b[3]


@pytest.mark.parametrize(
    "a, b",
    [
        ("x: Optional[int]", "x: int | None"),
        ("x: typing.Optional[int]", "x: None | int"),
        ("f'{a:>3}'", "format(a, '>3')"),
        ("f'v={a} {b}'", "'v={} {}'.format(a, b)"),
    ],
)
def test_equal_spellings_share_features(a, b):
    feats = lambda code: Counter(pycode.features(code)["features"])
    assert feats(a) == feats(b)
    assert feats("f'{a!r}'") != feats("'{}'.format(a)")


def test_feature_context():
    feats = pycode.features("a = 1\nb = 2\nc = 3\nd = [x for x in y]\n")["features"]
    fields = {f[2] for f in feats if f[0] == "Assign"}
    assert fields == {"body[0]", "body[1]", "body[2]", "body[3-9]"}
    assert ("comprehension", "ListComp", "generators[0]", "Module>Assign>ListComp", "Assign:d", "sync") in feats


def script(spark, old, new):
    df = spark.createDataFrame([(1, old, new)], "id int, o string, n string")
    counts = x.feature_counts(x.parsed_sides(df, {"o": "o", "n": "n"}), ["o", "n"])
    out = Counter()
    for r in x.edit_script(counts, "o", "n").collect():
        out[(r.operation, r.node_type, r.detail)] += r.n
    return out


def test_update_takes_one_candidate_and_the_surplus_is_deleted(spark):
    # two equal constants against one replacement: one update, one delete
    got = script(spark, "f(1); f(1)", "f(2)")
    assert got[("Update", "Constant", "1->2")] == 1
    # one insert left over stays an insert
    got = script(spark, "x = 5", "x = 6")
    assert got == {("Update", "Constant", "5->6"): 1}


def plain_script(old, new):
    """The pairing rule as a plain loop over counters."""
    a = Counter(tuple(f) for f in pycode.features(old)["features"])
    b = Counter(tuple(f) for f in pycode.features(new)["features"])
    deletes, inserts = a - b, b - a
    used, ops = Counter(), Counter()
    for d, n in deletes.items():
        target = next((i for i, c in inserts.items() if used[i] < c and i[:5] == d[:5]), None)
        take = min(n, inserts[target] - used[target]) if target else 0
        if take:
            ops[("Update", *d[:5], f"{d[5]}->{target[5]}")] += take
            used[target] += take
        if n - take:
            ops[("Delete", *d)] += n - take
    for i, n in inserts.items():
        if n - used[i]:
            ops[("Insert", *i)] += n - used[i]
    return ops


PAIRS = [
    ("def f(a, b):\n    return g(a, 1) + g(b, 1) + g(a, 2)", "def f(a, c):\n    if c:\n        return g(a, 3) + g(c, 4)\n    return 0"),
    ("x = [1, 1, 1, 2, 2, 3, 4]", "x = [5, 5, 6, 2, 7]"),
    ("for i in range(3):\n    print(i, i)", "for j in range(4):\n    log.debug(j)"),
    ("a = 1", "a = 1"),
    ("return x", "return y"),
]


def test_edit_scripts_and_scores_match_the_plain_rule(spark):
    rows = [(i, o, n, PAIRS[(i + 1) % len(PAIRS)][1]) for i, (o, n) in enumerate(PAIRS)]
    rows.append((99, "def f(:", "x = 1", "x = 1"))
    df = spark.createDataFrame(rows, "id int, old string, human string, llm string")
    counts = x.feature_counts(x.parsed_sides(df, {"o": "old", "h": "human"}), ["o", "h"])
    got = defaultdict(Counter)
    for r in x.edit_script(counts, "o", "h").collect():
        got[r.id][(r.operation, *[r[c] for c in x.PLACE], r.detail)] += r.n
    scores = {r.id: r for r in x.delta_scores(df, scripts=True).collect()}
    for i, old, human, llm in rows[:-1]:
        h, g = plain_script(old, human), plain_script(old, llm)
        assert got[i] == h
        s, n_h, n_g, both = scores[i], sum(h.values()), sum(g.values()), sum((h & g).values())
        assert (s.human_edits, s.llm_edits, s.matched_edits) == (n_h, n_g, both)
        assert [tuple(o) for o in s.human_edit_script] == sorted(h.elements())
        assert [tuple(o) for o in s.llm_edit_script] == sorted(g.elements())
        want = 1.0 if n_h == n_g == 0 else 2 * both / (n_h + n_g) if n_h and n_g else 0.0
        assert s.ast_delta_similarity == pytest.approx(want)
        fh, fg = (Counter(map(tuple, pycode.features(c)["features"])) for c in (human, llm))
        assert s.final_ast_similarity == pytest.approx(2 * sum((fh & fg).values()) / (sum(fh.values()) + sum(fg.values())))
    assert scores[99].error.startswith("SyntaxError") and scores[99].ast_delta_similarity is None


def test_golden_one_constant_edit(spark):
    f = lambda n: f"def f(x):\n    return x + {n}\n"
    df = spark.createDataFrame([(0, f(1), f(2), f(2)), (1, f(1), f(2), f(3)), (2, f(1), f(2), f(1)), (3, f(1), f(1), f(1))], "id int, old string, human string, llm string")
    got = {r.id: (r.ast_delta_similarity, r.final_ast_similarity) for r in x.delta_scores(df).collect()}
    assert got == {0: (1.0, 1.0), 1: (0.0, 0.9), 2: (0.0, 0.9), 3: (1.0, 1.0)}


def test_graph_edges(spark):
    nodes = x.ast_nodes(spark.createDataFrame([(1, "a = 1\nb = 2")], "id int, code string"), "code")
    edges = Counter(r.relation for r in x.ast_edges(nodes).collect())
    assert edges == {"ast_parent_to_child": 8, "ast_child_to_parent": 8, "ast_next_sibling": 1, "ast_previous_sibling": 1}


# --- mutations ------------------------------------------------------------------

SAMPLES = {
    "modify_docstring_text": ('def s(v):\n    """Explain it."""\n    return v\n', "'Explain it.'", "'Explain it. Synthetic clarification added.'"),
    "remove_output_statement": ("def s(v):\n    log.debug(v)\n    return v\n", "log.debug(v)", "<deleted>"),
    "replace_literal_value": ("def s():\n    flag = True\n    return flag\n", "True", "False"),
    "modify_return_expression": ("def s(v):\n    return v, 'x'\n", "(v, 'x')", "None"),
    "modify_comparison_operator": ("def s(v):\n    return v in 'ab'\n", "v in 'ab'", "v not in 'ab'"),
    "modify_exception_handler": ("def s():\n    try:\n        go()\n    except:\n        pass\n", "except", "except Exception"),
    "modernize_string_formatting": ("def s(v):\n    return f'é {v} {{}}'\n", "f'é {v} {{}}'", "'é {} {{}}'.format(v)"),
    "modify_type_annotation": ("def s(self, *, key):\n    pass\n", "key", "key: object"),
    "modernize_super_call": ("def s(self):\n    super(Base, self).s()\n", "super(Base, self)", "super()"),
    "rename_local_identifier": ("def s(v):\n    kept = v\n    return kept\n", "kept", "kept_updated"),
}


def test_bags_hold_what_the_nodes_hold(spark):
    df = spark.createDataFrame([(1, "def f_12(a):\n    return a + 3\n"), (2, "x = 'two Words'"), (3, "def (")], "id int, code string")
    want = defaultdict(Counter)
    for r in x.ast_nodes(df, "code").collect():
        want[r.id].update([f"t:{r.type}", f"f:{r.field}", *r.lexemes])
    assert {r.id: Counter(r.bag) for r in x.ast_bags(df, "code").collect()} == want and set(want) == {1, 2}


def mutated(spark, sources):
    rows = [(i, "train", c) for i, c in enumerate(sources)]
    return mu.mutate(spark.createDataFrame(rows, "source_index int, split string, code string"))


def test_every_rule_on_its_sample(spark):
    got = {(r.source_index, r.mutation_operator): r for r in mutated(spark, [c for c, *_ in SAMPLES.values()]).collect()}
    assert list(SAMPLES) == list(mu.RULES)
    for i, (rule, (code, old, new)) in enumerate(SAMPLES.items()):
        r = got[(i, rule)]
        assert r.status == "valid", rule
        assert (r.old_fragment, r.new_fragment) == (old, new)
        assert f"<before>{old}</before>" in r.requirement and r.requirement.endswith("Leave everything else unchanged.")
        assert ast.dump(ast.parse(code)) != ast.dump(ast.parse(r.expected_mutated_function))
        assert r.expected_mutated_function == ast.unparse(ast.parse(r.expected_mutated_function)).strip() + "\n"
        assert all(r.requirement.count(d) == 1 for d in mu.DELIMITERS)
    assert got[(8, "modernize_super_call")].expected_mutated_function == "def s(self):\n    super().s()\n"
    assert got[(9, "rename_local_identifier")].expected_mutated_function == "def s(v):\n    kept_updated = v\n    return kept_updated\n"
    assert got[(1, "remove_output_statement")].expected_mutated_function == "def s(v):\n    return v\n"


def test_inapplicable_and_failed(spark):
    sources = [
        "def e():\n    pass\n",
        "def e():\n    print('only')\n",
        "def e():\n    return 'get'\n",
        "def e(o):\n    return super(B, o).run()\n",
        "def e():\n    return f'plain'\n",
        "def o():\n    r = 1\n    def i():\n        return r\n    return r\n",
        "def e(vs):\n    return [v for v in vs]\n",
        "x = 1\n",
        "def e(:\n",
        "def e(v, w):\n    g(f'{v:{w}}')\n",
    ]
    got = {(r.source_index, r.mutation_operator): r.status for r in mutated(spark, sources).collect()}
    never = lambda i, rule: got[(i, rule)] == "inapplicable"
    assert all(never(0, r) for r in mu.RULES) and all(never(7, r) for r in mu.RULES)
    assert never(1, "remove_output_statement") and never(2, "replace_literal_value") and never(3, "modernize_super_call")
    assert never(4, "modernize_string_formatting") and never(5, "rename_local_identifier") and never(6, "rename_local_identifier")
    assert all(got[(8, r)] == "failed" for r in mu.RULES)


def test_chosen_rules_and_bare_checks_are_the_same_attempts(spark):
    sources = [*(c for c, *_ in SAMPLES.values()), "def broken(", "x = 1"]
    rows = spark.createDataFrame([(i, "train", c) for i, c in enumerate(sources)], "source_index int, split string, code string")
    every = {r.id: r.asDict(recursive=True) for r in mu.mutate(rows).collect()}
    few = {r.id: r.asDict(recursive=True) for r in mu.mutate(rows, rules=["replace_literal_value", "modernize_super_call"]).collect()}
    assert few == {k: v for k, v in every.items() if k in few} and len(few) == 2 * len(sources)
    bare = mu.mutate(rows, texts=False)
    assert "expected_mutated_function" not in bare.columns
    assert {r.id: r.status for r in bare.collect()} == {k: v["status"] for k, v in every.items()}


def test_equal_trees_differ_in_places_only():
    codes = ["x = 1", "x = True", "x = 1.0", "x = (1)", "x=1", "x = y", "def f():\n    return 1", "def f():\n  return (1)", "f(a, b)", "f(a)"]
    for a in codes:
        for b in codes:
            one, other = ast.parse(a), ast.parse(b)
            assert pycode.same_tree(one, other) == (ast.dump(one) == ast.dump(other))


def test_a_batch_is_done_piece_by_piece():
    class Row(dict):
        pass

    alive, most = weakref.WeakSet(), 0

    def each(text):
        nonlocal most
        row = Row(name=text, mark=b"m")
        Row.__hash__ = object.__hash__
        alive.add(row)
        most = max(most, len(alive))
        return [row]

    kind = pa.list_(pa.struct([("name", pa.string()), ("mark", pa.binary())]))
    texts = [str(i) for i in range(1000)]
    got = pycode._in_pieces(each, kind, (pa.array(texts),)).to_pylist()
    assert [r[0]["name"] for r in got] == texts and most <= 2 * pycode.PIECE
    assert pycode._in_pieces(each, kind, (pa.array([], pa.string()),)).to_pylist() == []


def test_rename_stays_out_of_nested_scopes(spark):
    code = "def o(v):\n    outer = v\n    def i():\n        result = 10\n        return result\n    return outer\n"
    r = mutated(spark, [code]).where("mutation_operator = 'rename_local_identifier'").first()
    assert r.old_fragment == "outer" and "result = 10" in r.expected_mutated_function


RICH = {
    "def s(a, b):\n    return a < b <= (a, b) and (a if b else a) not in [b == a]\n": [
        ("modify_comparison_operator", 2, 11, "a < b <= (a, b)", "a <= b <= (a, b)"),
        ("modify_comparison_operator", 2, 11, "a < b <= (a, b)", "a < b < (a, b)"),
        ("modify_comparison_operator", 2, 31, "(a if b else a) not in [b == a]", "(a if b else a) in [b == a]"),
        ("modify_comparison_operator", 2, 55, "b == a", "b != a"),
        ("modify_return_expression", 2, 4, "a < b <= (a, b) and (a if b else a) not in [b == a]", "None"),
        ("modify_type_annotation", 1, 6, "a", "a: object"),
        ("modify_type_annotation", 1, 9, "b", "b: object"),
    ],
    "def s(self, *v, k: int=1.5, **o):\n    é = f'{{é}}{v[0]}{(v, k)}\"{True}'\n    self.log.debug(f'{k!r}')\n    return\n": [
        ("modernize_string_formatting", 2, 8, "f'{{é}}{v[0]}{(v, k)}\"{True}'", "'{{é}}{}{}\"{}'.format(v[0], (v, k), True)"),
        ("remove_output_statement", 3, 4, "self.log.debug(f'{k!r}')", "<deleted>"),
        ("replace_literal_value", 1, 23, "1.5", "2.5"),
        ("replace_literal_value", 2, 18, "0", "1"),
        ("replace_literal_value", 2, 31, "True", "False"),
        ("rename_local_identifier", 2, 4, "é", "é_updated"),
    ],
    "async def s(x, /, y):\n    try:\n        a_ = y = -10 ** 20\n    except:\n        b = [y for y in x]\n    except_ = lambda: a_\n    b_updated = super(x, self).q\n    return None\n": [
        ("modify_exception_handler", 4, 4, "except", "except Exception"),
        ("modernize_super_call", 7, 16, "super(x, self)", "super()"),
        ("modify_type_annotation", 1, 12, "x", "x: object"),
        ("modify_type_annotation", 1, 18, "y", "y: object"),
        ("replace_literal_value", 3, 18, "10", "11"),
        ("replace_literal_value", 3, 24, "20", "21"),
        ("rename_local_identifier", 7, 4, "b_updated", "b_updated_updated"),
        ("rename_local_identifier", 6, 4, "except_", "except__updated"),
    ],
}


def test_candidates_of_rich_functions(spark):
    df = spark.createDataFrame([(i, "train", c) for i, c in enumerate(RICH)], "source_index int, split string, code string")
    got = {}
    for r in mu.mutation_candidates(df).collect():
        got.setdefault(r.source_index, []).append((r.mutation_operator, r.line, r.column, r.old, r.new))
        canonical = ast.unparse(ast.parse(list(RICH)[r.source_index])) + "\n"
        edited = canonical
        for e in reversed(r.edits):
            edited = edited[: e.start] + e.text + edited[e.end :]
        assert ast.dump(ast.parse(edited)) != ast.dump(ast.parse(canonical))
    for i, (code, want) in enumerate(RICH.items()):
        assert code == ast.unparse(ast.parse(code)) + "\n"
        column = lambda line, c: len(code.splitlines()[line - 1][:c].encode())
        assert sorted(got[i]) == sorted((rule, line, column(line, c), *rest) for rule, line, c, *rest in want)
    assert mu.mutation_candidates(df, longest=12).where("old = 'a < b <= (a, b)'").count() == 0


def test_mutation_is_the_same_on_any_partitioning(spark):
    rows = [(i, "train", f"def f{i}(a):\n    if a < {i}:\n        return a + {i}\n    return {i} * 2\n") for i in range(12)]
    df = spark.createDataFrame(rows, "source_index int, split string, code string")
    pick = lambda d: sorted((r.id, r.new_fragment) for r in mu.mutate(d).where("status = 'valid'").collect())
    assert pick(df.repartition(1)) == pick(df.repartition(5))


def test_literal_edits_of_every_source(spark):
    """Rich functions hold two literals: the generator seeded by rule and source picks one."""
    from codelineage.plans.code import literal_mutations, mutation_sources

    sf = "/root/testdata/sf0.001"
    want, rich = {}, Counter()
    for r in mutation_sources(spark, sf).collect():
        if "(:" in r.code:
            continue
        lines = [line for line in r.code.splitlines() if "value + " in line or "x + " in line or "total < " in line]
        seed = hashlib.sha256(f"fusion-guided-v1\0replace_literal_value\0{r.code}".encode()).digest()[:8]
        line = random.Random(int.from_bytes(seed, "big")).choice(lines)
        old = re.search(r"\d+", line)[0]
        changed = r.code.replace(line, line.replace(old, str(int(old) + 1)))
        want[r.source_index] = old, str(int(old) + 1), ast.unparse(ast.parse(changed)).strip() + "\n"
        rich[r.source_index % 4 == 0, "total" in line and "<" in line] += 1
    got = {r[0]: (r[1], r[2], r[3]) for r in literal_mutations(spark, sf).collect()}
    assert got == want and min(rich[True, True], rich[True, False]) > 0


def test_quota_and_shortfall(spark):
    rows = [(i, "train" if i < 8 else "test", "def f(a):\n    return a\n") for i in range(10)]
    att = mu.mutate(spark.createDataFrame(rows, "source_index int, split string, code string"))
    want = {"train": 5, "test": 5}
    picked = mu.mutation_quota(att, want, 1)
    got = Counter((r.source_split, r.mutation_operator) for r in picked.collect())
    assert got[("train", "modify_return_expression")] == 5 and got[("test", "modify_return_expression")] == 2
    short = {(r.source_split, r.mutation_operator): r.missing for r in mu.shortfall(att, picked, want).collect()}
    assert short[("test", "modify_return_expression")] == 3 and short[("train", "modernize_super_call")] == 5


# --- mining -----------------------------------------------------------------------


def test_latest_pair_across_looks(spark):
    f = lambda n: f"def f():\n    return {n}\n"
    texts = {
        "same": [f(1)] * 4 + [f(2)] * 2,  # the pair (4, 5) is on the border of the first look
        "late": [f(1)] * 6 + [f(2)],
        "gap": [f(1), None, f(2), f(3)],  # an undecodable version breaks both its pairs
        "none": [f(1)] * 3,
        "broken": [f(1), "def (", f(2)],
        "one": [f(1)],
    }
    commits, versions = [], []
    for path, ts in texts.items():
        for i, text in enumerate(ts, 1):
            commits.append(("r", path, f"{path}{i}", f"2020-01-{28 - i:02d} 00:00:00", "m", i))
            versions.append(("r", path, f"{path}{i}", text))
    c = spark.createDataFrame(commits, "repo string, path string, sha string, author_date string, message string, list_pos int")
    v = spark.createDataFrame(versions, "repo string, path string, sha string, content string")
    seen = m.considered_commits(c.withColumn("author_date", F.to_timestamp("author_date")))
    got = {r.path: (r.old_sha, r.new_sha) for r in m.changed_functions(seen, v).collect()}
    assert got == {"same": ("same5", "same4"), "late": ("late7", "late6"), "gap": ("gap4", "gap3")}
    names = m.changed_names(seen, v).collect()
    assert {r.path: (r.old_sha, r.new_sha) for r in names} == got and {r.function_name for r in names} == {"f"}
    full = {r.path: (r.old_code, r.new_code, r.old_author_date < r.new_author_date) for r in m.changed_functions(seen, v).collect()}
    assert full == {"same": (f(2), f(1), True), "late": (f(2), f(1), True), "gap": (f(3), f(2), True)}


def test_marks_are_equal_where_dumps_are():
    from codelineage.functions.pycode import function_marks, functions

    bodies = ["return 1", "return 1.0", "return True", "return  1  # c", "return u'a'", "return 'a'", "return b'a'", "pass", "return x", "return (x)", "x: int = 1", "x = 1", "def g(): return 1", "return '\\ud800'"]
    sources = [f"class C:\n  def f(x):\n    {b}\nasync def h():\n  class D:\n    def f(self): {b}\ndef h(): {b}\n" for b in bodies]
    for a in sources:
        want = {f[0] for f in functions(a)}
        got = {f["name"]: f["mark"] for f in function_marks(a)}
        assert set(got) == want
        for b in sources:
            other, dumps = {f["name"]: f["mark"] for f in function_marks(b)}, dict((f[0], f[4]) for f in functions(b))
            same = {n for n, *_, d in functions(a) if dumps.get(n) == d}
            assert {n for n in got if other.get(n) == got[n]} == same
    assert function_marks("def (") == [] and function_marks("") == []


def test_cutoff_applies_before_adjacency(spark):
    f = lambda n: f"def f():\n    return {n}\n"
    c = spark.createDataFrame(
        [("r", "p", "a", "2023-06-01", "m", 1), ("r", "p", "b", "2022-06-01", "m", 2), ("r", "p", "c", "2024-01-01", "m", 3), ("r", "p", "d", "2021-01-01", "m", 4)],
        "repo string, path string, sha string, author_date string, message string, list_pos int",
    ).withColumn("author_date", F.to_timestamp("author_date"))
    v = spark.createDataFrame([("r", "p", s, f(i)) for i, s in enumerate("abcd")], "repo string, path string, sha string, content string")
    r = m.changed_functions(m.considered_commits(c), v).first()
    assert (r.old_sha, r.new_sha) == ("d", "b")


def test_content_guard(spark):
    import base64

    b64 = lambda b: base64.b64encode(b).decode()
    df = spark.createDataFrame([("ok", b64("é".encode())), ("bad", b64(b"\xff\xfe")), ("empty", ""), ("none", None), ("big", b64(b"x" * 20))], "sha string, content_b64 string")
    got = {r.sha: r.content for r in m.decoded(df, limit=10).collect()}
    assert got == {"ok": "é", "bad": None, "empty": None, "none": None, "big": None}


def test_repo_rules(spark):
    ok = ("Python", False, False, False, "2022-12-31 23:59:59")
    rows = [("ok", *ok), ("go", "Go", *ok[1:]), ("private", "Python", True, *ok[2:]), ("late", *ok[:4], "2023-01-01 00:00:00"), ("fork", "Python", False, False, True, ok[4]), ("nulls", "Python", None, None, None, ok[4]), ("undated", *ok[:4], None)]
    df = spark.createDataFrame(rows, "repo string, language string, private boolean, archived boolean, fork boolean, created_at string").withColumn("created_at", F.to_timestamp("created_at"))
    assert {r.repo for r in m.repo_rules(df).collect()} == {"ok", "nulls"}


def test_every_customer_counts_for_its_repository(spark, tmp_path):
    from codelineage.plans.code import repo_rules

    rows = [(k, 1, "BUILDING" if 30 <= k < 34 else "MACHINERY") for k in range(1, 50) if k != 20]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r.repo: r.stars for r in repo_rules(spark, str(tmp_path)).collect()}
    # 3, 4, 5 and 6 shut out the first, the building customers the fourth; 20 is missing
    assert got == {"repo_1": 100, "repo_2": 90, "repo_4": 100}


def test_nothing_is_cut_unless_asked(spark):
    import base64

    from codelineage.operators.chat import best_sentence

    files = spark.range(201).selectExpr("'r' AS repo", "concat('f', id, '.py') AS path", "'blob' AS type", "id AS tree_pos")
    assert m.file_cap(files).count() == 201 and m.file_cap(files, 200).count() == 200
    commits = spark.range(51).selectExpr("'r' AS repo", "'p' AS path", "id AS sha", "timestamp '2020-01-01' AS author_date", "id AS list_pos")
    assert m.considered_commits(commits).count() == 51 and m.considered_commits(commits, cap=50).count() == 50
    big = spark.createDataFrame([(base64.b64encode(b"x" * 750_001).decode(),)], "content_b64 string")
    assert len(m.decoded(big).first().content) == 750_001 and m.decoded(big, limit=750_000).first().content is None
    changed = files.select("repo", "path")
    assert m.valid_files_cap(changed, files).count() == 201 and m.valid_files_cap(changed, files, 5).count() == 5
    assert m.valid_files_cap(changed.limit(4), files).count() == 4 and m.valid_files_cap(changed.limit(4), files, 5).count() == 0
    text = "same words again " * 30
    chat = spark.createDataFrame([(1, text, text)], "k int, content string, text string")
    whole, short = (best_sentence(chat, ["k"], "content", "text", n).first().sentence for n in (None, 300))
    assert whole == text.strip() and short == text[:300] + "..."


def test_taxonomy_rules_run_once_and_look_for_their_hints_first(spark):
    import random
    import re

    from codelineage.operators import topics as tp

    rng = random.Random(6)
    words = sorted({w for _, p in tp.RULES for w in re.findall(r"[a-z/]+", p.replace("\\b", " ")) if len(w) > 1} | {h for hints in tp.HINTS.values() for h in hints})
    parts = [*words, *[w + "s" for w in words], "x" , "add a type hint", "use of type annotations", "replace it with", "constructor may accept", "directory is named", "command-line option", "underscore to separate words", "accepts an"]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.choice([1, 2, 3, 8])))) for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, requirement string")
    plain = F.array_compact(F.array(*[F.when(F.col("requirement").rlike(f"(?U){p}"), F.lit(n)) for n, p in tp.RULES]))
    assert df.where(~tp.rule_signals(F.col("requirement")).eqNullSafe(plain)).count() == 0
    assert set(df.select(F.explode(plain)).distinct().toPandas()["col"]) == {n for n, _ in tp.RULES} == set(tp.HINTS)
    out = tp.taxonomy_summary(tp.classify_requirements(df.withColumn("label", F.lit("low")), "requirement"), ["low"])
    assert "rlike" not in out._jdf.queryExecution().optimizedPlan().toString().lower()


def test_picked_versions_are_parsed_once_for_both_sides(spark):
    rows = [("r", "p.py", n, f"def f(x):\n    return {n // 2}\n") for n in range(4)]
    v = spark.createDataFrame(rows, "repo string, path string, sha long, content string")
    c = spark.createDataFrame([(*r[:3], f"m{r[2]}", 4 - r[2]) for r in rows], "repo string, path string, sha long, message string, nth int").withColumn(
        "author_date", F.timestamp_seconds(F.col("sha"))
    )
    found = m.changed_functions(c, v)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    r = found.collect()
    assert [(x.old_sha, x.new_sha, x.old_code, x.new_code, x.old_message, x.new_message, x.pair) for x in r] == [
        (1, 2, "def f(x):\n    return 0\n", "def f(x):\n    return 1\n", "m1", "m2", 2)
    ]
