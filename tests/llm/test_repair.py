import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codelineage.llm import grammar, repair
from codelineage.llm.grammar import SYMBOLS, solve

LAWFUL = re.compile(r"(s?(ua)+)?")


def cheapest_by_enumeration(sequence):
    """All ways to treat every turn, with up to two inserts in every gap; ? stands for user or assistant."""
    best = None
    options = [[("D", 2, "")] if c == "d" else [("K", 5 * c.isupper(), c.lower()), ("R", 1 + 5 * c.isupper(), "?"), ("D", 2, "")] for c in sequence]
    for edits in itertools.product(*options):
        for gaps in itertools.product(range(3), repeat=len(sequence) + 1):
            cost = sum(e[1] for e in edits) + 5 * sum(gaps)
            if best is not None and cost > best[0]:
                continue
            audit = "".join("I" * g + e[0] for g, e in zip(gaps, edits)) + "I" * gaps[-1]
            roles = "".join("?" * g + e[2] for g, e in zip(gaps, edits)) + "?" * gaps[-1]
            if best is not None and (cost, audit) >= best:
                continue
            filled = "".join(("u" if (i - roles.startswith("s")) % 2 == 0 else "a") if c == "?" else c for i, c in enumerate(roles))
            if LAWFUL.fullmatch(filled):
                best = (cost, audit)
    return best


def cheapest_by_turns(sequence):
    """The usual table, turn after turn, with whole audits."""
    best = {grammar.START: (0, "")}
    for c in sequence:
        new = {}
        matrix = grammar.symbol_matrix(c)
        for i, (cost, audit) in best.items():
            for j in range(4):
                if matrix.cost[4 * i + j] < grammar.NEVER:
                    entry = (cost + matrix.cost[4 * i + j], audit + matrix.middle[4 * i + j])
                    new[j] = min(new.get(j, entry), entry)
        best = new
    return min((cost + 5 * n, audit + "I" * n) for s, n in ((0, 0), (1, 2), (2, 1), (3, 0)) if s in best for cost, audit in [best[s]])


def test_short_sequences_against_all_ways():
    rng = random.Random(11)
    cases = [""] + list(SYMBOLS) + ["".join(rng.choice(SYMBOLS) for _ in range(n)) for n in (2, 2, 2, 2, 3, 3, 3, 3, 3, 3, 4, 4, 4, 4)]
    assert solve(cases) == [cheapest_by_enumeration(c) for c in cases]


@given(st.lists(st.text(SYMBOLS, max_size=60), max_size=12))
@settings(max_examples=60, deadline=None)
def test_grammar_gives_what_the_table_gives(sequences):
    assert solve(sequences) == [cheapest_by_turns(s) for s in sequences]


def test_long_sequences_in_pieces(monkeypatch):
    monkeypatch.setattr(grammar, "PIECE", 50)
    rng = random.Random(3)
    sequences = ["ua" * 300, "u" * 333, "", "s" + "uA" * 77, "".join(rng.choice(SYMBOLS) for _ in range(700)), "d" * 101]
    assert solve(sequences) == [cheapest_by_turns(s) for s in sequences]


def test_rules_spell_the_sequences_and_are_shared():
    rng = random.Random(5)
    pieces = [np.array([rng.choice([1, 2, 2, 5]) for _ in range(n)], np.int64) for n in (0, 1, 2, 50, 400)] + [np.array([1, 2] * 64, np.int64)] * 20
    solver = grammar.Solver(pieces)

    def spelled(s):
        return [s] if s < len(SYMBOLS) else [x for half in solver.rules[s - len(SYMBOLS)] for x in spelled(half)]

    assert [[x for s in p.tolist() for x in spelled(s)] for p in solver.pieces] == [p.tolist() for p in pieces]
    left = np.concatenate([np.r_[p, -1] for p in solver.pieces])
    pairs = [(a, b) for a, b in zip(left[:-1], left[1:]) if a >= 0 and b >= 0 and a != b]
    assert len(pairs) == len(set(pairs))  # no pair twice
    assert sum(len(p) for p in solver.pieces) < sum(map(len, pieces)) / 4


def plain_repair(rows):
    """Every conversation by lists; rows are (conv, turn, role, text)."""
    name = lambda x: " " if x is None else str(x)
    convs = {r[0]: [] for r in rows}
    for conv, turn, role, text in rows:
        role, text = name(role), name(text)
        kind = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        convs[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, symbols, counts = set(), "", [0, 0, 0]
        for _, role, text in own:
            core = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = 1 if not core else 2 if (role, text) in seen else 3 if core[-1] not in ".!?" else 0
            seen.add((role, text))
            letter = role[:1] if role[:1] in ("s", "u", "a") and role else "x"
            symbols += "d" if fault in (1, 2) else letter.upper() if fault == 3 else letter
            if fault:
                counts[fault - 1] += 1
        illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(own, own[1:]))
        numbers = [r[0] for r in own if r[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        cost, audit = cheapest_by_turns(symbols)
        lines, todo, last = [], iter(own), "a"
        for edit in audit:
            _, role, text = next(todo) if edit != "I" else (None, None, "")
            if edit == "D":
                continue
            if edit != "K":
                role = "assistant" if last == "u" else "user"
            last = role[:1]
            lines.append(f"{role}:{text}")
        assert LAWFUL.fullmatch("".join(x[0] for x in lines))
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def test_conversations_against_lists(spark):
    rng = random.Random(8)
    texts = ["Yes.", "no", " ", "", None, "Stop! \t\n", "é. 日本語", "a\nuser:b.", "?" * 9000, "x" * 20000]
    rows = [(c, rng.choice([None, *range(12)]), rng.choice(["user", "user", "assistant", "system", "tool", "", None]), rng.choice(texts)) for c in range(60) for _ in range(rng.randrange(1, 14))]
    rows += [(None, None, None, None), (None, 1, "user", "a."), (70, 3, "user", "Hi.")] + [(71, 4, "assistant", "Same.")] * 9
    rows += [(72, t, ["user", "assistant"][t % 2], f"turn {t}.") for t in range(5000)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, cost int, audit string").repartition(6)
    base = repair.turns(df)
    damaged = repair.damage(base)
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.repair(base, damaged).collect()}
    want = plain_repair(rows)
    assert got == want
    back = {}
    audits = repair.diagnose(damaged).select("conv_id", "audit")
    for r in repair.repaired_turns(damaged, audits).collect():
        back.setdefault(r["conv_id"], []).append((r["seq"], f"{r['role']}:{r['text']}"))
    for conv, row in want.items():
        lines = sorted(back.get(conv, []))
        assert [n for n, _ in lines] == list(range(1, len(lines) + 1))
        assert hashlib.sha256("\n".join(x for _, x in lines).encode()).hexdigest() == row[-1]
    none = base.limit(0)
    assert repair.repair(none, repair.damage(none)).count() == 0


@pytest.mark.parametrize("conv,rows", [(1, [(1, 1, "user", "Hi.")])])
def test_a_conversation_of_which_nothing_is_left(spark, conv, rows):
    turn = next(t for t in range(1000) if zlib.crc32(f"{conv}:{t}".encode()) % 20 == 0)
    base = repair.turns(spark.createDataFrame([(conv, turn, "user", "Hi.")], "conv_id long, turn long, role string, text string"))
    assert tuple(repair.repair(base, repair.damage(base)).first()) == (conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
