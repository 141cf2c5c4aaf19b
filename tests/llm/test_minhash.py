import hashlib
import random

import numpy as np
import pytest
import xxhash
from helpers import AWKWARD, sentence, words
from pyspark.sql import functions as F

from codelineage.llm import minhash
from codelineage.llm.queries import op13_fingerprints


def plain_fingerprint(text, sketch):
    """Bins by a dictionary, each empty one filled by trying the others in its fixed order."""
    w, hashes = words(text), []
    for i in range(max(1, len(w) - sketch.words + 1) if w else 0):
        h = 42
        for x in w[i : i + sketch.words]:
            h = xxhash.xxh64_intdigest(x.encode(), seed=h)
        hashes.append(h ^ (1 << 63))
    if not hashes:
        return ""
    least = {}
    for h in hashes:
        b, rest = h >> sketch.shift, h & ((1 << sketch.shift) - 1)
        least[b] = min(least.get(b, rest), rest)

    def tries(b, depth):
        """The bin itself, then at every level the order of the bin named by that level's permutation."""
        if depth == 0:
            yield b
        else:
            yield from tries(b, depth - 1)
            yield from tries(minhash.rounds(sketch.bins, sketch.seed)[depth - 1][b], depth - 1)

    depth = len(minhash.rounds(sketch.bins, sketch.seed))
    values = [least[next(t for t in tries(b, depth) if t in least)] & ((1 << sketch.bits) - 1) for b in range(sketch.bins)]
    each = 4 // sketch.bits
    return "".join(f"{sum(values[i + r] << (r * sketch.bits) for r in range(each)):x}" for i in range(0, sketch.bins, each))


def plain_likeness(a, b, bits):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    unpack = lambda f: [int(c, 16) >> (r * bits) & ((1 << bits) - 1) for c in f for r in range(4 // bits)]
    x, y = unpack(a), unpack(b)
    chance = 2.0**-bits
    return max(0.0, (sum(p == q for p, q in zip(x, y)) / len(x) - chance) / (1 - chance))


def plain_rows(rows, sketch):
    key = lambda r: (r[0] is not None, r[0] or 0)
    by_id = {}
    for i, t in rows:
        by_id.setdefault(i, []).append(t or "")
    ids = sorted(by_id, key=lambda i: (i is not None, i or 0))
    unsigned = lambda t: (xxhash.xxh64_intdigest(t.encode(), seed=42) + (1 << 63)) % (1 << 64)
    out = []
    for n, i in enumerate(ids):
        after = min(by_id[ids[(n + 1) % len(ids)]], key=unsigned)
        for t in by_id[i]:
            q = len(t) // 4
            edited = t[: len(t) - q] + after[:q]
            f, e, x = (plain_fingerprint(s, sketch) for s in (t, edited, after))
            digest = hashlib.sha256(edited.encode()).hexdigest()
            out.append((i, len(t), digest, f, e, plain_likeness(f, e, sketch.bits), plain_likeness(f, x, sketch.bits)))
    return sorted(out, key=lambda r: (key(r), r[1:]))


@pytest.mark.parametrize("sketch", [minhash.Sketch(), minhash.Sketch(words=2, bins=64, bits=2, seed=3), minhash.Sketch(bins=128, bits=1)])
def test_equal_to_bins_in_a_dictionary(spark, sketch):
    rng = random.Random(13)
    rows = AWKWARD + [(20 + i, sentence(rng, n)) for i, n in enumerate([4, 5, 6, 12, 40, 90, 300, 1500])]
    rows += [(4, "one"), (25, rows[-1][1]), (24, "another text of that id")]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, text string, fingerprint string, head int").repartition(5)
    got = minhash.edited_pairs(df, sketch).withColumn("edited", F.sha2("edited", 256)).collect()
    got = sorted((tuple(r) for r in got), key=lambda r: ((r[0] is not None, r[0] or 0), r[1:]))
    want = plain_rows(rows, sketch)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want])
    assert minhash.edited_pairs(df.limit(0), sketch).count() == 0


def test_likeness_is_near_the_share_of_common_shingles(spark):
    rng = random.Random(4)
    rows, truth = [], []
    for n in (30, 120, 400, 2000):
        for changes in (0, 1, 4, 12, 40):
            a = [f"w{rng.randrange(5000)}" for _ in range(n)]
            b = list(a)
            for _ in range(changes):
                b[rng.randrange(n)] = f"v{rng.randrange(5000)}"
            s, t = ({tuple(x[i : i + 5]) for i in range(n - 4)} for x in (a, b))
            truth.append(len(s & t) / len(s | t))
            rows.append((len(rows), " ".join(a), " ".join(b)))
    df = spark.createDataFrame(rows, "n int, a string, b string")
    df = minhash.fingerprint(minhash.fingerprint(df, "a", name="fa"), "b", name="fb")
    got = [r[0] for r in df.orderBy("n").select(minhash.likeness(F.col("fa"), F.col("fb"))).collect()]
    errors = np.abs(np.array(got) - truth)
    assert errors.mean() < 0.04 and errors.max() < 0.15, list(zip(got, truth))


def test_one_document_follows_itself(spark):
    df = spark.createDataFrame([(3, "a b c d e f g h")], "doc_id long, text string")
    assert minhash.edited_pairs(df).first()["edited"] == "a b c d e f a b"
    nulls = spark.createDataFrame([(None, None)], "doc_id long, text string")
    assert tuple(minhash.edited_pairs(nulls).first()) == (None, 0, "", "", "", 1.0, 1.0)


def test_query_over_its_table_and_native_plan(spark):
    sf = "/root/testdata/sf0.001"
    frame = op13_fingerprints(spark, sf)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = plain_rows(docs, minhash.Sketch())
    got = sorted(map(tuple, frame.collect()))
    assert [r[:5] for r in got] == [r[:5] for r in want] and np.allclose([r[5:] for r in got], [r[5:] for r in want])
