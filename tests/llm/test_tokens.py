import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from helpers import AWKWARD
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from codelineage.llm import bpe, packing
from codelineage.llm.queries import R, tokenizer_file

WORDY, BYTES = tokenizer_file("word_bpe_49k.json"), tokenizer_file("byte_bpe_50k.json")
ODD = ["İstanbul ΣΑΣ <|endoftext|> a<|startoftext|>b", "é ﬁ ² Ⅷ it's I'LL", "ab" * 4000, "\x00\x1c\x85᠎", "don’t <|endoftext|><|endoftext|>"]


@given(st.lists(st.integers(0, 50), max_size=40), st.data())
@settings(max_examples=60, deadline=None)
def test_merge_tree_keeps_the_lowest(keys, data):
    tree, keys = bpe.MergeTree(list(keys)), list(keys)
    for _ in range(8):
        assert tree.root() == min(keys, default=bpe.NONE)
        if keys:
            i = data.draw(st.integers(0, len(keys) - 1))
            keys[i] = data.draw(st.integers(0, 60))
            tree.update(i, keys[i])


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_any_text_is_encoded_like_the_library(text):
    vocab = bpe.vocabulary(WORDY)
    assert vocab.encode(text).tolist() == Tokenizer_.encode(text, add_special_tokens=False).ids


Tokenizer_ = Tokenizer.from_file(WORDY)


def test_op2_rows(spark):
    rows = AWKWARD + [(50 + i, t) for i, t in enumerate(ODD)] + [(50, ODD[0])]
    df = spark.createDataFrame([(i, t, "mine") for i, t in rows], "doc_id long, text string, decoded string")
    got = sorted((str(r["doc_id"]), list(r["token_ids"]), r["decoded"]) for r in bpe.encode(df, WORDY).collect())
    want = []
    for i, t in rows:
        ids = Tokenizer_.encode(t or "", add_special_tokens=False).ids
        want.append((str(i), ids, Tokenizer_.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)
    assert bpe.encode(df.limit(0), WORDY).count() == 0


def test_word_cache_keeps_its_bound():
    vocab = bpe.Vocabulary(WORDY)
    vocab.cache.limit = 50
    texts = [f"w{i}x{i * 7}" for i in range(400)]
    assert [vocab.encode(t).tolist() for t in texts] == [Tokenizer_.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(vocab.cache) <= 51 and len(vocab.cache.older) <= 51


@pytest.mark.parametrize("lengths", [[], [1], [1024] * 3, [700] * 900 + [300] * 10, list(range(1024, 0, -1)), [513] * 40])
def test_fit_places_every_token_once_with_little_padding(lengths):
    parts = packing.fit(lengths)
    seen = {}
    for piece, start, n, window in parts:
        seen.setdefault(piece, []).append((start, n))
    for piece, n in enumerate(lengths):
        at = 0
        for start, size in sorted(seen[piece]):
            assert start == at and size > 0
            at += size
        assert at == n
    fill = np.bincount([w for *_, w in parts], [n for _, _, n, _ in parts]) if parts else np.zeros(0)
    assert (fill <= 1024).all() and (fill > 0).all()
    assert len(fill) <= -(-sum(lengths) // 1024) * (1 + packing.PADDING) + 1


def test_best_fit_takes_the_tightest_window():
    tree = packing.RoomTree(1024)
    rooms = {}
    rng = random.Random(6)
    for i in range(300):
        if rooms and rng.random() < 0.5:
            need = rng.randrange(1, 1025)
            best = min((r for r in rooms.values() if r >= need), default=None)
            got = tree.take(need)
            assert (got and got[0]) == best
            if got:
                assert rooms.pop(got[1]) == best
        else:
            rooms[i] = rng.randrange(1, 1025)
            tree.put(rooms[i], i)


def check_packing(rows, got, window=1024):
    library = Tokenizer.from_file(BYTES)
    want = sorted((str(i), library.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in rows)
    by_doc, by_seq = {}, {}
    for r in got:
        ids = np.frombuffer(bytes(r["ids"]), "<u4")
        assert len(ids) == r["length"] and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
        by_doc.setdefault((str(r["doc_id"]), r["row_key"]), []).append((r["start"], ids.tolist(), r["doc_tokens"]))
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_seq.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= window
    if len({str(i) for i, _ in rows}) == len(rows):
        found = []
        for (doc, _), parts in by_doc.items():
            ids = []
            for start, part, total in sorted(parts):
                assert start == len(ids)
                ids += part
            assert len(ids) == total
            found.append((doc, ids))
        assert sorted(found) == want
    assert sum(r["length"] for r in got) == sum(len(x) for _, x in want)
    return by_seq


def test_op4_on_awkward_rows(spark):
    rows = [r for r in AWKWARD if r[0] is not None] + [(None, "alone")] + [(60 + i, t) for i, t in enumerate(ODD)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, offset int")
    check_packing(rows, packing.checksum(packing.pack(df, BYTES)).collect())
    twice = spark.createDataFrame([(1, "same same")] * 3, "doc_id long, text string")
    assert sum(r["length"] for r in packing.pack(twice, BYTES).collect()) == 3 * packing.pack(twice.limit(1), BYTES).agg(F.sum("length")).first()[0]
    assert packing.pack(df.limit(0), BYTES).count() == 0


def test_op4_on_documents_in_several_groups(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    packed = packing.checksum(packing.pack(docs, BYTES, group_pieces=40)).collect()
    rows = pq.read_table("/root/testdata/sf0.001/documents.parquet").select(["doc_id", "text"]).to_pylist()
    by_seq = check_packing([(r["doc_id"], r["text"]) for r in rows], packed)
    tokens = sum(r["length"] for r in packed)
    assert len(by_seq) <= -(-tokens // 1024) * 1.02 + 8


def test_registered_queries():
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in R.queries if k.startswith("op")}
    assert "pipeline" in R.queries
