"""Provenance rules on small hand-written conversations."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from codelineage.functions import text as t
from codelineage.operators import chat, provenance as p, snippets as sn

MSG = "conv_id bigint, turn bigint, role string, text string"
BLK = "conv_id bigint, block bigint, content string"
SNP = "conv_id bigint, turn bigint, snippet_no int, role string, code string"


def rows(df, *keys):
    return {tuple(r[k] for k in keys): r.asDict() for r in df.collect()}


def test_line_labels_first_speaker_wins(spark):
    msgs = spark.createDataFrame(
        [(1, 0, "user", "Use A = 1\n\tfoo()"), (1, 1, "assistant", "use a  = 1\nbar()\n}"), (1, 2, "system", "setup()"), (2, 0, "assistant", "foo()")], MSG
    )
    blocks = spark.createDataFrame(
        [(1, 0, "USE a = 1\n\n bar() \n}\nsetup()\n# @Authorship: x\nnew()"), (2, 0, "bar()"), (3, 0, "foo()")], BLK
    )
    got = {(r.conv_id, r.line_no): r.label for r in p.line_provenance(blocks, msgs).collect()}
    assert got == {
        (1, 1): p.PROMPT,  # user said it first, assistant echoed
        (1, 3): p.LLM,
        (1, 4): p.HUMAN,  # "}" is never looked up
        (1, 5): p.HUMAN,  # first said by system
        (1, 7): p.HUMAN,
        (2, 1): p.HUMAN,  # other conversation
        (3, 1): p.HUMAN,  # empty history
    }


def test_previous_user_turn_crosses_chunks(spark):
    roles = ["user"] + ["assistant"] * 5 + ["user", "assistant"]
    msgs = spark.createDataFrame([(1, i, r, "x") for i, r in enumerate(roles)], MSG)
    got = {r.turn: r.prev_user_turn for r in p.previous_user_turn(msgs, chunk=2).collect()}
    assert got == {0: None, 1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 0, 7: 6}


def label(spark, blocks, snippets, msgs):
    return rows(p.attribute_blocks(spark.createDataFrame(blocks, BLK), spark.createDataFrame(snippets, SNP), spark.createDataFrame(msgs, MSG)), "block")


def test_block_label_and_confidence(spark):
    code = "def f(x):\n    return x"
    got = label(
        spark,
        [(1, 0, code), (1, 1, "unknown = 3"), (1, 2, "def  f(x):\n  return x"), (1, 3, "def g(y):\n    return y")],
        [(1, 1, 0, "assistant", code)],
        [(1, 0, "user", "please"), (1, 1, "assistant", code)],
    )
    assert (got[(0,)]["label"], got[(0,)]["confidence"], got[(0,)]["first_turn"]) == (p.LLM, 1.0, 1)
    # no block match: fixed confidence, label from the lines alone
    assert (got[(1,)]["label"], got[(1,)]["confidence"]) == (p.HUMAN, 0.95)
    assert got[(2,)]["first_score"] == 95.0 and got[(2,)]["confidence"] == 1.0
    # same syntax shape: 0.5 + 0.3; its lines are not in the chat, so the line rule turns the label
    assert got[(3,)]["first_score"] == 85.0 and got[(3,)]["confidence"] == 0.8 and got[(3,)]["label"] == p.HUMAN


def test_line_labels_decide_without_block_match(spark):
    got = label(spark, [(1, 0, "a = compute()\nb = other()")], [(9, 0, 0, "user", "zzz")], [(1, 0, "assistant", "a = compute()")])
    assert got[(0,)]["label"] == p.MIXED and got[(0,)]["confidence"] == 0.95


def test_echoed_prompt_is_prompt_origin(spark):
    code = "total = 1"
    got = label(
        spark, [(1, 0, "#\n" + code)], [(1, 1, 0, "assistant", "#\n" + code)], [(1, 0, "user", "my #\ntotal = 1 here"), (1, 1, "assistant", "#\n" + code)]
    )
    assert got[(0,)]["confidence"] == 0.9 and got[(0,)]["first_role"] == "user" and got[(0,)]["first_turn"] == 0


def test_many_matches_reduce_confidence_and_first_is_earliest(spark):
    code = "x = 1"
    snips = [(1, i, 0, "user", "y = 1" if i == 0 else code) for i in range(5)]
    got = label(spark, [(1, 0, code)], snips, [(1, i, "user", "hello") for i in range(5)])
    # the earliest match is the syntax match, not the best one
    assert got[(0,)]["first_score"] == 85.0 and got[(0,)]["best_score"] == 100.0
    assert got[(0,)]["confidence"] == 0.75 and got[(0,)]["n_matches"] == 5


# --- fuzzy matching against a plain double loop --------------------------------


def py_tokens(line):
    return re.findall(r"\w+|[^\w\s]", line, re.ASCII)


def py_similar(a, b):
    shape = lambda s: re.sub(r"\b[a-zA-Z_]\w*\b", "VAR", s, flags=re.ASCII)
    squeeze = lambda s: " ".join(s.split())
    if squeeze(a) == squeeze(b) or shape(a) == shape(b):
        return True
    x, y = py_tokens(a), py_tokens(b)
    return sum(i == j for i, j in zip(x, y)) / max(len(x), len(y)) > 0.7


def py_fuzzy(a, b):
    x = [s.strip() for s in a.split("\n") if s.strip()]
    y = [s.strip() for s in b.split("\n") if s.strip()]
    if not x or not y:
        return 100.0 if not x and not y else 0.0
    return sum(py_similar(i, j) for i, j in zip(x, y)) / max(len(x), len(y)) * 100


@pytest.mark.parametrize("seed", [1, 2])
def test_fuzzy_candidates_lose_no_pair(spark, seed):
    rng = random.Random(seed)
    words = ["a", "b", "foo", "(", ")", "=", "1", "22", "+", "return"]
    base = ["\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 9))) for _ in range(8)]

    def vary(code):
        lines = code.split("\n")
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(lines))
            parts = lines[i].split(" ")
            parts[rng.randrange(len(parts))] = rng.choice(words)
            lines[i] = " ".join(parts)
        return "\n".join(lines[: max(1, len(lines) - rng.randint(0, 1))])

    blocks = [(1, i, vary(rng.choice(base))) for i in range(40)]
    snips = [(1, i, 0, "user", vary(rng.choice(base))) for i in range(40)]
    b, s = spark.createDataFrame(blocks, BLK), spark.createDataFrame(snips, SNP)
    got = {r.block: r.n_fuzzy for r in p.fuzzy_matches(b, s).collect()}
    syn = {r.c: r.s for r in spark.createDataFrame([(x,) for x in {c for *_, c in blocks} | {c for *_, c in snips}], "c string").select("c", t.norm_syntax(F.col("c")).alias("s")).collect()}
    want = {}
    for (_, i, code), (*_, other) in itertools.product(blocks, snips):
        if syn[code] != syn[other] and py_fuzzy(code, other) >= 70:
            want[i] = want.get(i, 0) + 1
    assert got == want


# --- text rules -------------------------------------------------------------------


def one(spark, column_fn, *args):
    df = spark.createDataFrame([tuple(args)], ", ".join(f"c{i} string" for i in range(len(args))))
    return df.select(column_fn(*[F.col(f"c{i}") for i in range(len(args))])).first()[0]


def test_syntax_form_keeps_its_quirks(spark):
    # newlines are squeezed before comments are cut, so the first marker ends the text
    assert one(spark, t.norm_syntax, "x = 1 # note\ny = 2") == "VAR = NUM "
    # identifiers are replaced first, strings afterwards, keywords too
    assert one(spark, t.norm_syntax, "return 'abc'") == 'VAR "STR"'
    assert one(spark, t.norm_syntax, "if x :") == "VAR VAR:"


def test_structural_score_cannot_reach_its_threshold(spark):
    same = "def f():\n    return 1 + 2"
    assert one(spark, t.structural_score, same, same) <= 30


def test_token_and_jaccard(spark):
    assert one(spark, lambda a, b: t.token_similarity(t.tokens(a), t.tokens(b)), "a b c", "a x c d") == 0.5
    assert one(spark, t.line_jaccard, "a\nb\n\nb", " b\nc") == pytest.approx(1 / 3)
    assert one(spark, t.line_jaccard, "", "\n") == 1.0


def test_shape_similarity(spark):
    assert one(spark, t.code_shape, "return define + foo('x')") == "return define + id('')"
    assert one(spark, t.shape_similarity, "x = foo(1)", "y = bar(2)") == 1.0


def test_bounded_levenshtein(spark):
    assert one(spark, t.bounded_levenshtein, "kitten", "sitting") == 3
    assert one(spark, t.bounded_levenshtein, "a" * 1002, "a") == 1001
    assert one(spark, lambda a, b: t.bounded_levenshtein(a, b, 1000), "a" * 1002, "a") == 1002


def test_clean_requirement(spark):
    assert one(spark, t.clean_requirement, "REFACTOR_CHANGE: Tidy up without changing its behavior.") == "Tidy up"
    assert one(spark, t.clean_requirement, "  ;. ") == "empty"


def test_identifier_tokens(spark):
    assert one(spark, t.identifier_tokens, "parseHTTPResponse_v2 URL") == ["parse", "http", "response", "v", "2", "url"]


@pytest.mark.parametrize("code", ["    a\n      b\n\n    c  \n", "\ta\n\t\tb", "a\n  b\t\n", "  \n   x\n  y \r\n", "", "   "])
def test_normalize_code_matches_dedent(spark, code):
    import textwrap

    want = re.sub(r"[ \t]+(?=\r?(\n|$))", "", textwrap.dedent(code))
    assert one(spark, t.normalize_code, code) == want


# --- snippets ----------------------------------------------------------------------


def test_snippet_kinds(spark):
    text = "Look:\n```python\nx = 1\n```\n```\n\n```\nimport os\nfrom a import b\ndef f(a): return 1\nclass K:\n    pass\n"
    msgs = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", "    indented\n")], MSG)
    got = [(r.turn, r.kind, r.code) for r in sn.snippets(msgs).orderBy("turn", "snippet_no").collect()]
    assert got == [
        (0, "fence", "x = 1"),
        (0, "inline", "def f(a): return 1"),
        (0, "inline", "class K:"),
        (0, "definition", "def f(a): return 1"),
        (0, "definition", "class K:\n    pass"),
        (0, "import", "import os"),
        (0, "import", "from a import b"),
        (0, "context", "pass"),
    ]


def test_context_runs_survive_blank_lines(spark):
    assert one(spark, sn.context_code, "My code: ```a```\n    x\n\n    y\nz\n\tw") == ["a", "x\ny", "w"]


# --- chat checks --------------------------------------------------------------------


def py_lev(a, b):
    if abs(len(a) - len(b)) > 1000:
        return max(len(a), len(b))
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(prev[j - 1] if x == y else 1 + min(prev[j - 1], prev[j], cur[-1]))
        prev = cur
    return prev[-1]


def py_chat(a, b):
    norm = lambda s: " ".join(s.split()).lower()
    x, y = norm(a), norm(b)
    if len(x) < 20 or len(y) < 20:
        return 1.0 if x == y else 0.0
    comment = ("#", "//", '"""', "'''")
    if not x.startswith(comment) and not y.startswith(comment) and (x in y or y in x):
        return 1.0
    keep = "|".join(t.SHAPE_KEYWORDS)

    def shape(s):
        s = re.sub("'[^']*'", "''", re.sub('"[^"]*"', '""', s))
        return norm(re.sub(rf"\b(?!{keep})\w+\b", "ID", s, flags=re.ASCII))

    s1, s2 = shape(a), shape(b)
    short, long = sorted((len(s1), len(s2)))
    sim = 1.0 if s1 == s2 else short / long if s1 in s2 or s2 in s1 else 1 - py_lev(s1, s2) / long
    if sim > 0.9:
        return sim
    short, long = sorted((len(x), len(y)))
    if x in y or y in x:
        return short / long
    if (long - short) / long < 0.5:
        return 1 - py_lev(x, y) / long
    w1, w2 = set(x.split()), set(y.split())
    return len(w1 & w2) / max(len(w1), len(w2))


def test_chat_similarity_matches_plain_code(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "return", "x", "(", "'lit'", "# c", "\n", "if", "42", "gamma_delta"]
    pairs = []
    for _ in range(150):
        a = " ".join(rng.choice(words) for _ in range(rng.randint(1, 14)))
        parts = a.split(" ")
        for _ in range(rng.randint(0, 6)):
            parts[rng.randrange(len(parts))] = rng.choice(words)
        b = " ".join(parts) if rng.random() < 0.7 else " ".join(rng.choice(words) for _ in range(rng.randint(1, 30)))
        pairs.append((len(pairs), a, b))
    df = spark.createDataFrame(pairs, "i int, a string, b string")
    full = {r.i: r.similarity for r in t.chat_similarity(df, "a", "b").collect()}
    cut = {r.i: r.similarity for r in t.chat_similarity(df, "a", "b", floor=0.7).collect()}
    for i, a, b in pairs:
        want = py_chat(a, b)
        assert full[i] == pytest.approx(want), (a, b)
        assert (cut[i] > 0.7) == (want > 0.7) and (want <= 0.7 or cut[i] == pytest.approx(want))


def test_match_groups_keep_the_best(spark):
    base = "value = compute(alpha, beta)"
    data = [
        (1, 0, 0, 0.8, base), (1, 1, 0, 0.95, base.upper()), (1, 2, 0, 0.9, "something else entirely, quite long"),
        (1, 3, 0, 0.85, base + "!"), (2, 0, 0, 0.75, base),
    ]
    df = spark.createDataFrame(data, "conv_id bigint, turn bigint, piece_no int, similarity double, portion string")
    got = {(r.conv_id, r.turn): (r.similarity, r.portions) for r in chat.dedupe_matches(df).collect()}
    assert got == {(1, 0): (0.95, 3), (1, 2): (0.9, 1), (2, 0): (0.75, 1)}


def chat_texts(rng, n):
    """Texts of all kinds: code, prose, comments, copies with edits, parts of one another."""
    words = ["alpha", "beta", "return", "x", "(", "'lit'", "# c", "\n", "if", "42", "gamma_delta", "und", "the"]
    out = []
    while len(out) < n:
        if out and rng.random() < 0.6:
            parts = rng.choice(out).split(" ")
            for _ in range(rng.choice([0, 1, 2, 5])):
                parts[rng.randrange(len(parts))] = rng.choice(words)
            parts = parts[: rng.choice([len(parts), len(parts), max(1, len(parts) // 2)])]
            parts = ["# " + parts[0], *parts[1:]] if rng.random() < 0.1 else parts
        else:
            parts = [rng.choice(words) for _ in range(rng.choice([1, 3, 6, 12]))]
        out.append(" ".join(parts))
    return out


@pytest.mark.parametrize("task_rows", [7, 1024])
def test_similar_pairs_are_those_of_the_double_loop(spark, task_rows):
    rng = random.Random(9)
    left = [(c, i, x) for c in (1, 2) for i, x in enumerate(chat_texts(rng, 30))]
    right = [(c, i, x) for c in (1, 2, 3) for i, x in enumerate(chat_texts(rng, 30) + [x for k, _, x in left if k == c][:6])]
    a = spark.createDataFrame(left, "conv_id long, i int, a string")
    b = spark.createDataFrame(right, "conv_id long, j int, b string")
    got = {(r.conv_id, r.i, r.j): r.similarity for r in chat.similar_pairs(a, "a", b, "b", 0.7, task_rows=task_rows).collect()}
    want = {(c, i, j): py_chat(x, y) for c, i, x in left for k, j, y in right if c == k and py_chat(x, y) > 0.7}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
    met = a.join(b, "conv_id").withColumns({"f": t.chat_form(F.col("a")), "g": t.chat_form(F.col("b"))})
    listed = met.where(t.may_be_similar(F.col("f"), F.col("g"), 0.7)).count()
    assert len(want) <= listed < 0.5 * met.count()


def py_groups(rows):
    """First-fit groups, portion after portion: {(turn, piece): (best similarity, portions)}."""
    reps, out = [], {}
    for turn, piece, similarity, portion in sorted(rows):
        norm = " ".join(portion.split()).lower()
        home = next((r for r in reps if r[2] == norm or py_chat(r[1], portion) > 0.9), None)
        if home is None:
            home = ((turn, piece), portion, norm)
            reps.append(home)
        best, n = out.get(home[0], (0.0, 0))
        out[home[0]] = (max(best, similarity), n + 1)
    return out


def test_groups_are_those_of_the_loop(spark, monkeypatch):
    rng = random.Random(12)
    rows = {c: [(i, 0, round(0.7 + 0.3 * rng.random(), 3), x) for i, x in enumerate(chat_texts(rng, n))] for c, n in ((1, 26), (2, 9), (3, 1))}
    df = spark.createDataFrame([(c, *r) for c, own in rows.items() for r in own], "conv_id long, turn long, piece_no int, similarity double, portion string")
    for sizes in ((64, 512), (4, 16)):
        monkeypatch.setattr(chat, "ROUND_PORTIONS", sizes)
        got = {c: {} for c in rows}
        for r in chat.dedupe_matches(df).collect():
            got[r.conv_id][(r.turn, r.piece_no)] = (r.similarity, r.portions)
        assert got == {c: py_groups(own) for c, own in rows.items()}


def test_rounds_follow_hundreds_of_groups(spark, monkeypatch):
    rows = [(1, i, 0, 0.8, f"piece {i}") for i in range(2000)] + [(2, 0, 0, 0.9, "alone")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, piece_no int, similarity double, portion string")
    calls, plain = [], chat.checkpointed
    monkeypatch.setattr(chat, "checkpointed", lambda d: calls.append(1) or plain(d))
    assert chat.dedupe_matches(df).count() == 2001
    assert len(calls) - 1 < 10


def test_long_conversation_in_parts(spark):
    """2 000 replies against 20 texts: rows that are compared follow the matches, and several tasks share the conversation."""
    rng = random.Random(2)
    replies = [(1, i, " ".join(f"w{rng.randrange(9000)}" for _ in range(5 + i % 40))) for i in range(2000)]
    texts = [(1, k, replies[k * 99][2] + " more") for k in range(20)]
    a = spark.createDataFrame(texts, "conv_id long, k int, content string")
    b = spark.createDataFrame(replies, "conv_id long, turn int, piece string")
    got = {(r.k, r.turn) for r in chat.similar_pairs(a, "content", b, "piece", 0.7).select("k", "turn").collect()}
    assert {(k, k * 99) for k in range(20)} <= got


def test_assistant_sourced(spark):
    msgs = spark.createDataFrame(
        [(1, 0, "user", "hi"), (1, 1, "assistant", "Sure:\n```py\ndef add(a, b):\n    return a + b\n```\n"), (2, 0, "assistant", "Nothing about that topic at all.")], MSG
    )
    texts = spark.createDataFrame([(1, "def add(a, b):\n    return a + b"), (2, "def other(q):\n    yield q * 2")], "conv_id bigint, content string")
    got = {r.conv_id: (r.is_assistant_sourced, r.overall_similarity) for r in chat.assistant_sourced(texts, msgs).collect()}
    assert got == {1: (True, 1.0), 2: (False, 0.0)}


def test_edit_distances_of_many_pairs(monkeypatch):
    from codelineage.functions import edits

    rng = random.Random(3)
    texts = ["".join(rng.choice(rng.choice(["ab", "abcdefgh é中"])) for _ in range(rng.choice([0, 1, 20, 63, 64, 65, 128, 130]))) for _ in range(120)]
    pairs = [(x, rng.choice([x[: len(x) // 2] + "q" + x[len(x) // 2 + 2 :], rng.choice(texts)]), rng.choice([0, 2, 20, 60, 500])) for x in texts]
    want = [d if (d := py_lev(x, y)) <= limit else -1 for x, y, limit in pairs]
    assert edits.distances(*zip(*pairs)) == want and any(d > 2 for d in want) and -1 in want
    monkeypatch.setattr(edits, "TABLE_WORDS", 10)  # every pair alone, its bits in one integer
    assert edits.distances(*zip(*pairs)) == want
    assert edits.distances([None, "a", "a"], ["a", None, "a"], [1, 1, None]) == [None] * 3


def test_edit_distances_are_left_when_out_of_reach(spark):
    """In 20 s; the full table of these pairs has 9 billion cells."""
    import time

    from codelineage.functions import edits

    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdefghij") for _ in range(3000)) for _ in range(100)]
    began = time.time()
    assert set(edits.distances([x for x in texts[:10] for _ in range(100)], texts * 10, [300] * 1000)) == {0, -1}
    assert time.time() - began < 20


@pytest.mark.parametrize("task_rows", [2, 64])
def test_best_sentence_with_forms_made_before(spark, task_rows):
    rng = random.Random(8)
    texts, replies = chat_texts(rng, 12), [". ".join(chat_texts(rng, 4)) for _ in range(6)]
    a = spark.createDataFrame([(c, i, x) for c in (1, 2) for i, x in enumerate(texts)], "conv_id long, i int, content string")
    b = spark.createDataFrame([(1, j, x) for j, x in enumerate(replies)], "conv_id long, j int, text string")
    formed = chat.met(a.withColumn("form", t.chat_form(F.col("content"), terms=True)), b.withColumn("sentences", chat.sentence_forms(F.col("text"))), "text", task_rows)
    keys = ["conv_id", "i", "j"]
    got = {(r.i, r.j): (r.similarity, r.sentence) for r in chat.best_sentence(formed, keys, "content", "text", forms=("form", "sentences")).collect()}
    assert len(got) == 72
    assert got == {(r.i, r.j): (r.similarity, r.sentence) for r in chat.best_sentence(a.join(b, "conv_id"), keys, "content", "text").collect()}
    for (i, j), (similarity, _) in got.items():
        sentences = [s for s in re.split(r"[.!?\n]+", replies[j]) if len(s.strip()) > 10]
        assert similarity == pytest.approx(max((py_chat(texts[i], s) for s in sentences), default=0))


def test_texts_are_compared_once_for_code_and_whole_replies(spark):
    said = "one long sentence about nothing at all. and another one that is here"
    chat_rows = [(1, 0, "user", "q"), (1, 1, "assistant", said), (1, 2, "assistant", "see\n```python\nvalue = compute(alpha, beta)\n```")]
    messages = spark.createDataFrame(chat_rows, "conv_id long, turn long, role string, text string")
    contents = spark.createDataFrame([(1, 7, said + "!"), (1, 8, "value = compute(alpha, beta)")], "conv_id long, block long, content string")
    out = chat.sourced_matches(contents, messages, ("conv_id", "block"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2  # shapes and texts of sentences; no pair of texts is compared again
    got = {(r.block, r.turn): r.portion for r in out.collect()}
    # six words of the text are in its first sentence, five in the second
    assert got == {(7, 1): "one long sentence about nothing at all", (8, 2): "value = compute(alpha, beta)"}


def test_identifiers_and_numbers_start_where_no_word_goes_on(spark):

    draw = random.Random(6)
    parts = ["a", "Z9", "_", "7", "42", "é", "漢", "😀", " ", "-", ".", "\n", "x1", "\u0085", "٣"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 12))) for _ in range(2000)]
    df = spark.createDataFrame([(x,) for x in texts], "s string")
    got = df.select("s", F.regexp_extract_all("s", F.lit(t.IDENTIFIER), 0), F.regexp_extract_all("s", F.lit(t.NUMBER), 0)).collect()
    for s, words, numbers in got:
        assert words == re.findall(r"(?<![A-Za-z0-9_])[A-Za-z_][A-Za-z0-9_]*", s)
        assert numbers == re.findall(r"(?<![A-Za-z0-9_])[0-9]+(?![A-Za-z0-9_])", s)


def test_probes_are_made_once_per_text(spark):
    """No filter makes the lists of words again to see that they are not empty."""
    blocks = spark.createDataFrame([(1, 0, "a = b + c\nreturn a")], BLK)
    codes = spark.createDataFrame([(1, 0, 0, "user", "a = b + d\nreturn a")], "conv_id long, turn long, snippet_no int, role string, code string")
    own, others = p._both_prepared(blocks, codes)
    plan = p._fuzzy_pairs(own, others)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "xxhash64" in line]


def test_attribution_and_ranks_from_one_set_of_pairs(spark):
    said = ["x = load(a)\ny = x + 1\nreturn y", "x = load(b)\ny = x + 1\nprint(y)", "if q:\n    return None", "x = load(a)\ny = x + 1\nreturn y"]
    blocks = spark.createDataFrame([(1, i, s + tail) for i, s in enumerate(said) for tail in [["", "\nfinish"][i % 2]]], BLK)
    codes = spark.createDataFrame([(1, i, 0, "user" if i % 2 else "assistant", s) for i, s in enumerate(said)], "conv_id long, turn long, snippet_no int, role string, code string")
    msgs = spark.createDataFrame([(1, i, "user" if i % 2 else "assistant", s) for i, s in enumerate(said)], MSG)
    found, ranked = p.attribute_and_rank(blocks, codes, msgs, 3)
    rows = lambda df: sorted(str(r) for r in df.select(*sorted(df.columns)).collect())
    assert rows(found) == rows(p.attribute_blocks(blocks, codes, msgs))
    assert rows(ranked) == rows(p.ranked_matches(blocks, codes, 3)) and ranked.count() > 4
