import math
import random
from collections import Counter

import numpy as np
import pytest
from helpers import AWKWARD, sentence

from codelineage.llm import k2treap


def plain_search(docs, items, k):
    """Every item against every document; (item, rank, doc, score) sorted."""
    bags = [(i, Counter(k2treap.terms_of(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for i, bag in bags:
            m = 100 - 25 + (25 * sum(bag.values()) * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * bag[t] // (1000 * bag[t] + 12 * m)) for t in k2treap.terms_of(text) if bag[t])
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scores)[:k])]
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, x or 0) for x in r))


def cases(seed):
    rng = random.Random(seed)
    docs = AWKWARD + [(20 + i, sentence(rng, rng.choice([1, 3, 30, 200]), 150)) for i in range(300)]
    docs += [(500, "W1 w2,w3;ÉTÉ")] * 3 + [(20, "w1 w1 w1"), (400, docs[40][1]), (401, "é à 日本語 W7")]
    items = [(i, sentence(rng, rng.choice([1, 5, 25]), 160)) for i in range(12)]
    items += [(50, None), (51, "  \t ."), (52, "ÉTÉ w2 w2 nowhere"), (0, "w5 w6"), (None, "w3"), (None, "w3"), (53, "日本語 one two words x")]
    return docs, items


@pytest.mark.parametrize("seed,k,shard,step,blocks", [(1, 20, 8192, 1 << 16, 2048), (2, 3, 16, 8, 5), (3, 1, 1, 1 << 16, 2048)])
def test_equal_to_scoring_everything(spark, monkeypatch, seed, k, shard, step, blocks):
    docs, items = cases(seed)
    docs_df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, item string, score int").repartition(3)
    items_df = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(k2treap, "SHARD_DOCS", shard)
    monkeypatch.setattr(k2treap, "STEP_CELLS", step)
    got = k2treap.ranked_search(docs_df, items_df, k, block_items=blocks)
    assert ordered(got.collect()) == ordered(plain_search(docs, items, k))
    assert k2treap.ranked_search(docs_df.limit(0), items_df, k).count() == 0
    assert k2treap.ranked_search(docs_df, items_df.limit(0), k).count() == 0


def test_shards_are_cut_by_documents_and_by_entries(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(k2treap, "SHARD_DOCS", 4)
    monkeypatch.setattr(k2treap, "SHARD_POSTINGS", 10)
    sizes = [1, 1, 1, 1, 1, 9, 1, 30, 0, 0, 2, 9]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(12), pa.int64()), pa.array(sizes, pa.int64()), pa.array([list(range(n)) for n in sizes], pa.list_(pa.int32()))],
        names=["doc_id", "n_terms", "terms"],
    )
    shards = [s.column("doc_id").to_pylist() for s in k2treap._shards(iter([batch.slice(0, 7), batch.slice(7)]))]
    assert [i for s in shards for i in s] == list(range(12))
    for s in shards:
        assert len(s) <= 4 and (len(s) == 1 or sum(sizes[i] for i in s) <= 10)


def test_treap_holds_the_maxima_and_opens_few_ranges():
    rng = np.random.default_rng(3)
    cells = np.unique(rng.integers(0, 40 * 1000, 9000))
    terms, columns = cells // 1000, cells % 1000
    impacts = rng.integers(1, 1000, len(cells))
    impacts[columns == 77] += 100_000
    treap = k2treap.Treap(terms, columns, impacts, np.arange(40)[::-1].copy())
    assert int(treap.best[0][0]) == impacts.max() and len(treap.best[-1]) == len(cells)
    opened = []
    plain = treap.children
    treap.children = lambda level, at, half: (opened.append(at.size), plain(level, at, half))[1]
    best = k2treap.Best(1)
    best.shard_ids, best.shard_null = np.arange(1000), np.zeros(1000, bool)
    asked = [(t, 1 + t % 2) for t in range(0, 40, 3)]
    treap.search(asked, 1, best)
    total = np.zeros(1000, np.int64)
    times = dict(asked)
    for t, c, v in zip(terms, columns, impacts):
        total[c] += times.get(t, 0) * v
    assert (best.ids[0], best.scores[0]) == (77, total[77]) and total.argmax() == 77
    assert sum(opened) < 14 * 2000 / 4  # far from all 1000 documents


def test_terms_of_equal_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(k2treap, "hash_words", lambda raw, starts, ends, lower=False: np.zeros(len(starts), np.uint64))
    found = k2treap.Vocabulary(["ab", "cd", "abc"])
    raw = np.frombuffer("CD zz abc ab é".encode(), np.uint8)
    starts, ends = np.array([0, 3, 6, 10, 13]), np.array([2, 5, 9, 12, 15])
    assert found.find(raw, starts, ends).tolist() == [1, -1, 2, 0, -1]
