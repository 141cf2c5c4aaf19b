import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import AWKWARD, classes, near_copy_rows, sentence, without_repeats
from pyspark.sql import functions as F

from codelineage.llm import jaccard, rlz


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id long, text string, component_id string, n_words int")


@pytest.mark.parametrize("k,num,short", [(4, 85, 256), (5, 80, 4)])
def test_classes_match_all_pairs(spark, monkeypatch, k, num, short):
    monkeypatch.setattr(jaccard, "SHORT_ENTRY", short)
    rows = near_copy_rows(seed=k)
    got = jaccard.near_copies(frame(spark, rows), rule=jaccard.Rule(words=k, num=num)).collect()
    assert {tuple(r) for r in got} == classes(rows, k, num)
    assert len(got) == len(rows)


def test_classes_of_awkward_rows(spark):
    rows = AWKWARD + [(4, "one"), (11, "ONE"), (12, "Two  WORDS"), (7, "word " * 4000), (0, "two words")]
    got = jaccard.near_copies(frame(spark, rows)).collect()
    # ids 4, 5, 11 are the one word; 0, 6, 12 the two words; 10 and the second text of 7 the repeated word
    known = {4: 4, 5: 4, 11: 4, 0: 0, 6: 0, 12: 0, 7: 7, 10: 7}
    for r in got:
        assert r["component_id"] == known.get(r["doc_id"], r["doc_id"])
    assert len(got) == len(rows)
    assert jaccard.near_copies(frame(spark, rows).limit(0)).count() == 0


def test_one_class_of_many_near_copies(spark):
    """A third of all rows near one another, and chains that only link step by step."""
    rng = random.Random(8)
    base = sentence(rng, 120, 4000).split()
    rows = []
    for i in range(150):
        text = list(base)
        text[rng.randrange(120)] = f"n{i}"
        rows.append((i, " ".join(text)))
    step = sentence(rng, 200, 9000).split()
    for i in range(40):
        step[(i * 5) % 200] = f"s{i}"
        rows.append((1000 + i, " ".join(step)))
    rows += [(2000 + i, sentence(rng, 80, 9000)) for i in range(200)]
    rng.shuffle(rows)
    got = {tuple(r) for r in jaccard.near_copies(frame(spark, rows)).collect()}
    assert got == classes(rows)


@pytest.mark.parametrize("short", [8])
def test_a_family_around_the_limit(spark, monkeypatch, short):
    """Many edits of one text: some link with it, most only with a few others, none is lost."""
    monkeypatch.setattr(jaccard, "SHORT_ENTRY", short)
    rng = random.Random(26)
    base = sentence(rng, 90, 4000).split()
    rows = []
    for i in range(160):
        text = list(base)
        for _ in range(rng.randrange(1, 6)):
            at = rng.randrange(len(text))
            rng.choice([lambda: text.pop(at), lambda: text.insert(at, "x" + str(rng.randrange(9))), lambda: text.__setitem__(at, "y" + str(rng.randrange(9)))])()
        rows.append((3 * i, " ".join(text)))
    rng.shuffle(rows)
    got = {tuple(r) for r in jaccard.near_copies(frame(spark, rows)).collect()}
    assert got == classes(rows) and 3 < len({c for *_, c in got}) < 150


@pytest.mark.parametrize("extra", ["rows", "capitals", "texts"])
def test_a_long_entry_with_repeated_ids(spark, monkeypatch, extra):
    """All sets in one entry only, and rows that repeat an id with its text, its words or another text: no link is lost."""
    one_entry = lambda docs, schemes, rule: docs.select(F.lit(128 + schemes[-1].band).cast("long").alias("key"), F.col("id").alias("doc")).distinct()
    monkeypatch.setattr(jaccard, "SHORT_ENTRY", 8)
    monkeypatch.setattr(jaccard, "index_entries", one_entry)
    rng = random.Random(26)
    base = sentence(rng, 90, 4000).split()

    def edited(places):
        return " ".join(f"x{places[0]}_{i}" if i in places else w for i, w in enumerate(base))

    rows = [(0, " ".join(base))]
    for i in range(30):
        at = rng.sample(range(5, 85, 5), 3)
        rows += [(10 + 2 * i, edited(at[:2])), (11 + 2 * i, edited(at))]
    more = {"rows": rows[:1] * 3 + rows[10:20], "capitals": [(i, t.upper()) for i, t in rows[:1] + rows[10:20]], "texts": [(0, edited([7, 47])), (15, edited([8, 48]))]}
    rows += more[extra]
    rng.shuffle(rows)
    got = jaccard.near_copies(frame(spark, rows)).collect()
    assert {tuple(r) for r in got} == classes(rows) and len(got) == len(rows)
    assert 10 < len({r["component_id"] for r in got}) < 40


def test_long_entries_are_looked_through_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 5)
    rows = [(7, 40, d) for d in range(40)] + [(8, 5, d) for d in range(100, 105)] + [(9, 11, d) for d in range(200, 211)]
    cut = jaccard.in_blocks(spark.createDataFrame(rows, "key long, rows long, doc long")).select("key", "doc").collect()
    entries = {}
    for r in cut:
        entries.setdefault(r["key"], set()).add(r["doc"])
    assert entries.pop(8) == set(range(100, 105))
    met = {(a, b) for docs in entries.values() for a in docs for b in docs if a < b}
    assert met == {(a, b) for first, n in ((0, 40), (200, 11)) for a in range(first, first + n) for b in range(a + 1, first + n)}
    assert max(map(len, entries.values())) < 30 and len(entries) == 8 * 9 // 2 + 3 * 4 // 2


def test_links_among_unrelated_sets_of_one_entry_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SHORT_ENTRY", 4)
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 3)
    one_entry = lambda docs, schemes, rule: docs.select(F.lit(128 + schemes[-1].band).cast("long").alias("key"), F.col("id").alias("doc")).distinct()
    monkeypatch.setattr(jaccard, "index_entries", one_entry)
    cut, in_blocks = [], jaccard.in_blocks
    monkeypatch.setattr(jaccard, "in_blocks", lambda rows: cut.append(rows.agg(F.max("rows")).first()[0]) or in_blocks(rows))
    rng = random.Random(33)
    rows = []
    for i in range(60):  # sets with nothing in common but for a copy with one word changed of every third
        words = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        rows.append((i, " ".join(words)))
        if i % 3 == 0:
            words[-1] = "other"
            rows.append((1000 + i, " ".join(words)))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_copies(frame(spark, rows)).collect()}
    assert got == {i: i - 1000 if i >= 1000 else i for i, _ in rows}
    assert max(c or 0 for c in cut) > 3


def test_rows_are_settled_by_both_hashes():
    one, two = np.array([5, 5, 5, 6], np.uint64), np.array([1, 1, 2, 1], np.uint64)
    a, b, low, known = rlz.resolved(one, two, np.array([9, 4, 9, 9]), np.arange(4))
    assert known.tolist() == [True, False, False, False] and low[0] == 4
    assert a[1:].tolist() == [5, 5, 6] and b[1:].tolist() == [1, 2, 1] and (a[0], b[0]) != (5, 1)


def test_linked_sets_share_an_index_entry_after_the_common_ones_are_left_out():
    """The allowances of every scheme suffice, whatever counts the entries have."""
    rng = np.random.default_rng(9)
    rule = jaccard.Rule()
    for low, high in jaccard.bands(300)[4:]:
        for sets in (10, 10**4, 10**7):
            s = jaccard.allocate(3, low, high, sets, rule)
            if s is None:
                continue
            borders = jaccard.segment_borders(s)
            for _ in range(8):
                n = int(rng.integers(low, high + 1))
                a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
                b = set(a.tolist())
                while True:  # change b while it still links
                    c = set(b)
                    c.discard(next(iter(c))) if rng.random() < 0.5 else c.add(int(rng.integers(0, 2**63)))
                    if len(c) > high or 100 * len(c & set(a.tolist())) < 85 * len(c | set(a.tolist())):
                        break
                    b = c
                b = np.array(sorted(b), np.uint64)
                x, y = (jaccard.index_keys(v, s, borders).tolist() for v in (a, b))
                count = {k: int(rng.integers(0, 4)) for k in {*x, *y}}
                order = lambda keys: sorted((k for k in keys if not k & 128), key=lambda k: (-count[k], k))[s.spare :]
                kept = lambda keys: {*order(keys), *(k for k in keys if k & 128)}
                assert kept(x) & kept(y), (low, high, s)


def test_repeats_match_a_lookup_of_every_window(spark):
    rng = random.Random(10)
    passages = [sentence(rng, n, 3000) for n in (12, 13, 14, 30, 80)]
    rows = []
    for i in range(120):
        text = []
        for _ in range(rng.randrange(4)):
            text += [sentence(rng, rng.randrange(20), 3000), rng.choice(passages)]
        rows.append((i * 2, "  ".join(text)))
    rows += [(1, sentence(rng, 40, 2)), (3, sentence(rng, 60, 2)), (999, rows[5][1]), (1000, rows[6][1] + " end")]
    rng.shuffle(rows)
    got = rlz.remove_repeats(frame(spark, rows).repartition(5)).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert sorted(tuple(r) for r in got) == sorted(without_repeats(rows))


def test_repeats_of_awkward_rows(spark):
    rows = AWKWARD + [(4, "p q r s t u v w x y z a b c"), (4, "z p q r s t u v w x y z a b c"), (3, "p q r s t u v w x y z a b c d"), (None, "p q r s t u v w x y z a b c")]
    rows += [(20, "word " * 20)]
    got = rlz.remove_repeats(frame(spark, rows)).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, without_repeats(rows)))
    assert rlz.remove_repeats(frame(spark, rows).limit(0)).count() == 0


def test_factors_join_windows_of_one_reference():
    at = np.array([3 * 16 + 4, 7 * 16 + 2, 9 * 16 + 1, 40 * 16 + 5])
    start, size, ref = rlz.factors(at, np.array([1, 1, 2, 2]))
    assert start.tolist() == [3, 9, 40] and size.tolist() == [18, 13, 17] and ref.tolist() == [1, 2, 2]


def test_phrases_cover_every_window_once():
    rng = random.Random(11)
    texts = [sentence(rng, n, 50) for n in (5, 13, 60, 0, 300)]
    _, _, _, _, first, hashes = rlz.batch_words(pa.array(texts, pa.string()))
    text, start, count, _, _ = rlz.phrases(hashes, first)
    seen = sorted(s + j for s, c in zip(start.tolist(), count.tolist()) for j in range(c))
    assert seen == [a + j for a, b in zip(first[:-1].tolist(), first[1:].tolist()) for j in range(b - a - 12)]
    assert (count <= 10).all()
