import random
from collections import Counter

import numpy as np
import pyarrow as pa
from helpers import AWKWARD, lower, words

from codelineage.llm import quality
from codelineage.llm import words as W
from codelineage.llm.components import components


def test_words_are_split_and_hashed_alike():
    rng = random.Random(1)
    texts = ["".join(rng.choice("aB \n\té.") for _ in range(rng.randrange(40))) for _ in range(300)] + ["", "y" * 700000]
    raw, borders = __import__("codelineage.llm.common", fromlist=["x"]).text_bytes(pa.array([*texts, None], pa.string()))
    starts, ends, first = W.find_words(raw, borders)
    found = [raw[a:b].tobytes().decode() for a, b in zip(starts, ends)]
    assert found == [w for t in texts for w in words(t)]
    assert np.diff(first).tolist() == [len(words(t)) for t in [*texts, None]]
    for fold in (False, True):
        hashes = W.hash_words(raw, starts, ends, fold)
        by_hash = {}
        for w, h in zip(found, hashes.tolist()):
            by_hash.setdefault(lower(w) if fold else w, set()).add(h)
        assert all(len(s) == 1 for s in by_hash.values())
        assert len({next(iter(s)) for s in by_hash.values()}) == len(by_hash)


def test_components_match_a_plain_search(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {x: x for p in pairs for x in p}
    for _ in range(200):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if x != r}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def measured(text):
    w, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {i + o for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for o in range(8)}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(cover)


def test_ledger_measures_every_text_like_a_plain_loop(spark):
    rng = random.Random(3)
    made = [(100 + i, "\n".join(" ".join(rng.choice("ab") for _ in range(rng.randrange(14))) for _ in range(6))) for i in range(60)]
    rows = AWKWARD + made + [made[0], (500, "x * $ | " * 40)]
    df = spark.createDataFrame([(i, t, 7, 8) for i, t in rows], "doc_id long, text string, n_words int, failed_bits int")
    got = quality.ledger(df).select("doc_id", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert sorted(map(str, (tuple(r)[0:1] + tuple(r)[2:] for r in got))) == sorted(map(str, ((i, *measured(t)) for i, t in rows)))
    assert quality.ledger(df.limit(0)).count() == 0


def test_policies_and_ablation_read_the_bits(spark):
    rules = quality.RULES
    df = spark.createDataFrame([(b,) for b in (0, 1, 1, 2, 3, 4, 5)], "failed_bits long")
    kept = df.where(quality.passes(quality.BASE)).count()
    assert kept == 2 and df.where(quality.passes(quality.FULL)).count() == 1
    got = {(r["version"], r["rule"]): tuple(r)[2:] for r in quality.ablation(df, [quality.BASE, quality.FULL]).collect()}
    assert got["base-1", "few_words"] == (4, 3, 2, 5)
    assert got["full-1", "symbols"] == (2, 1, 1, 2)
    assert len(got) == len(rules) + 2


def test_clean_text_is_kept_and_junk_is_not(spark):
    rng = random.Random(4)
    clean = " ".join("".join(rng.choice("aeinrst") for _ in range(rng.randrange(2, 9))) for _ in range(200))
    rows = [(1, clean), (2, clean.upper()), (3, " ".join(w + "%%%" for w in clean.split())), (4, "again " * 200), (5, "too short")]
    got = quality.ledger(spark.createDataFrame(rows, "doc_id long, text string")).where(quality.passes(quality.FULL)).select("doc_id").collect()
    assert [r[0] for r in got] == [1]
