import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from helpers import AWKWARD, sentence
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codelineage.llm import pii, toxicity

PLAIN = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
)


@given(st.text(alphabet="a1.@-+ 0(2)_9é", max_size=50))
@settings(max_examples=600, deadline=None)
def test_rules_match_the_plain_patterns(text):
    want = sorted((m.start(), k, m.end()) for k, p in enumerate(PLAIN) for m in re.finditer(p, text))
    assert pii.candidates(text) == want


def test_checks():
    assert pii.fits(1, "255.0.00000255.9") and not pii.fits(1, "1.2.3.256") and not pii.fits(1, "1.2.3." + "9" * 9000)
    assert pii.fits(2, "4111 1111 1111 1111") and not pii.fits(2, "4111 1111 1111 1112") and not pii.fits(2, "0" * 20)
    assert pii.fits(3, "+1 (212) 555-0100") and not pii.fits(3, "+1 555") and not pii.fits(3, "+" + "1" * 16)


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    tagger = pii.Tagger.new(rng)
    x = rng.integers(0, pii.N_CLASSES, (2, 9))
    y = np.stack([pii.tags_of([(0, 2, 3), (3, 1, 4), (6, 0, 9)], 9), pii.tags_of([(2, 3, 7)], 9)])

    def loss():
        e, w = tagger.emissions(x), {**tagger.w, "trans": tagger.w["trans"] + pii.FORBIDDEN, "begin": tagger.w["begin"] + pii.NO_START}
        total = lambda v, a: (m := v.max(axis=a, keepdims=True)).squeeze(a) + np.log(np.exp(v - m).sum(axis=a))
        ahead, gold = w["begin"] + e[:, 0], w["begin"][y[:, 0]] + e[np.arange(2), 0, y[:, 0]]
        for t in range(1, 9):
            ahead = total(ahead[:, :, None] + w["trans"], 1) + e[:, t]
            gold = gold + w["trans"][y[:, t - 1], y[:, t]] + e[np.arange(2), t, y[:, t]]
        return (total(ahead, 1) - gold).mean()

    grad = tagger.gradients(x, y)
    for name, values in tagger.w.items():
        at = tuple(rng.integers(0, n) for n in values.shape)
        old = values[at]
        values[at] = old + 1e-5
        high = loss()
        values[at] = old - 1e-5
        low = loss()
        values[at] = old
        assert abs((high - low) / 2e-5 - grad[name][at]) < 1e-6, name


def prose(rng, n):
    return " ".join("".join(rng.choice("aeinrst") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def card(rng):
    body = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    return next(body + d for d in "0123456789" if pii.luhn(body + d))


def labelled_texts(rng, n):
    rows = []
    for i in range(n):
        kind = i % 5
        value = (
            f"{rng.choice(['ann', 'joe.b', 'k_w'])}{rng.randrange(99)}@mail{rng.randrange(9)}.example.com", ".".join(str(rng.randrange(256)) for _ in range(4)),
            card(rng), f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}", f"{rng.randrange(10**6)}",
        )[kind]
        rows.append(f"{prose(rng, rng.randrange(3, 9))} {value} {prose(rng, 6)}.")
    return rows


def test_tagger_parts_what_the_rules_cannot(spark):
    rng = random.Random(12)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(labelled_texts(rng, 500))], "doc_id long, text string")
    tagger = pii.learn(docs)
    hits = total = 0
    for _ in range(40):
        phone, number = f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}", card(rng)
        text = f"call me at {phone} {number} or later"
        assert pii.rule_spans(text) == []
        (_, added), = pii.find([text], tagger)
        total += 2
        hits += sum(text[s:e] in (phone, number) for s, _, e in added)
    assert hits >= 0.8 * total
    clean = [prose(rng, 50) + f" in {rng.randrange(2000)} and {rng.randrange(99)}" for _ in range(60)]
    assert all(not added for _, added in pii.find(clean, tagger))


def test_rule_spans_stay_and_awkward_rows_have_a_result(spark):
    rows = AWKWARD + [(30, "a@b.c d 1.2.3.4"), (30, "a@b.c d 1.2.3.4"), (31, "é\U0001f600 x@y.zz " + "1" * 5000 + " " + "a" * 200000)]
    df = spark.createDataFrame([(i, t, "own") for i, t in rows], "doc_id long, text string, masked string")
    got = pii.detect(df, None).collect()
    assert len(got) == len(rows)
    for r, in zip([r for r in got if r["doc_id"] == 30]):
        assert r["rule_spans"] == "email:0:5,ip:8:15" == r["spans"] and r["masked"] == "[EMAIL] d [IP]"
    assert [r["spans"] for r in got if r["doc_id"] == 31] == ["email:3:9"]
    assert pii.detect(df.limit(0), None).count() == 0
    assert pii.learn(spark.createDataFrame([(1, "no data")], "doc_id long, text string")) is None


def test_windows_cover_all_hints_and_spans_are_reconciled():
    text = "x" * 100 + "1" * 500 + "y" * 300 + "@"
    parts = pii.windows_of(text)
    covered = {at + i for at, p in parts for i in range(len(p))}
    assert all(i in covered for i, c in enumerate(text) if c in "1@") and all(len(p) <= pii.LENGTH for _, p in parts)
    line = "10.0.0.1 and 10.0.0.22"
    found = [(True, (0, 1, 7)), (False, (0, 1, 8)), (False, (13, 1, 22)), (False, (13, 1, 21))]
    assert sorted(pii.reconcile(found, [], line)) == [(0, 1, 8), (13, 1, 22)]
    assert pii.reconcile(found, [(13, 1, 22)], line) == [(0, 1, 8)]
    assert pii.masked(line, [(0, 1, 8), (4, 3, 10)]) == "[IP]nd 10.0.0.22"


def toxic_rows(rng, n):
    rows = []
    for i in range(n):
        text, toxic = sentence(rng, rng.randrange(20, 80)).split(), int(rng.random() < 0.3)
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["grumbol", "snarfy", "blorpish", f"vexqu{rng.randrange(50)}"]))
        rows.append((i, " ".join(text), toxic))
    return rows


def test_held_out_texts_are_told_apart(spark):
    rows = toxic_rows(random.Random(13), 1500)
    docs = spark.createDataFrame([(i, t, -1.0) for i, t, _ in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    scored = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.learn(docs, labels)).withColumn("out", toxicity.held_out(F.col("doc_id"))).collect()}
    out = [(scored[i], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(r["out"] for r, _ in out) and sum(r["out"] for r in scored.values()) == len(out)
    assert np.mean([(r["score"] >= 0.7) == bool(y) for r, y in out]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in scored.values())


def test_scores_of_awkward_rows_and_of_no_labels(spark):
    rows = toxic_rows(random.Random(14), 600)
    texts = pa.array([t for _, t, _ in rows], pa.string())
    model = toxicity.fit(texts, np.array([float(y) for *_, y in rows]))
    df = spark.createDataFrame(AWKWARD + [(77, "grumbol " * 50), (77, "grumbol " * 50)], "doc_id long, text string")
    got = toxicity.score(df, model).collect()
    assert len(got) == len(AWKWARD) + 2 and all(0 <= r["score"] <= 1 for r in got)
    again = [r["score"] for r in got if r["doc_id"] == 77]
    assert again[0] == again[1] > 0.7
    assert toxicity.score(df.limit(0), model).count() == 0
    none = toxicity.learn(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.score(df, none).collect()} == {0.0}


def test_model_learnt_in_spark_is_that_of_the_texts_at_hand(spark):
    rows = toxic_rows(random.Random(21), 900) + [(9000 + i, "", 0) for i in range(5)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(3, rows[3][1], "y")], "doc_id long, text string, part string").repartition(7)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (4, None)], "doc_id long, toxic int")
    found = toxicity.fitting_texts(docs, labels, "doc_id", "text", "toxic", 700).withColumn("h", F.xxhash64("k")).orderBy("h", "k").collect()
    assert len(found) == len({r["k"] for r in found}) <= 700 and [r["part"] for r in found] == [i % 5 for i in range(len(found))]
    assert not any(zlib.crc32(str(r["k"]).encode()) % 3 == 1 for r in found)
    want = toxicity.fit(pa.array([r["text"] for r in found], pa.string()), np.array([float(r["y"]) for r in found]))
    got = toxicity.learn(docs, labels, rows=700)
    assert np.array_equal(got.lexicon.words, want.lexicon.words) and np.allclose(got.lexicon.word_weights, want.lexicon.word_weights)
    assert all(np.array_equal(got.lexicon.starts[n][0], want.lexicon.starts[n][0]) for n in toxicity.PREFIXES)
    texts = pa.array([t for _, t, _ in rows], pa.string())
    assert np.allclose(got.score(texts), want.score(texts))
    assert len(got.lexicon.words)


def test_lexicon_counts_texts_by_a_plain_loop():
    texts = ["Bad bad word here", "bad? words", "", None, "here here", "badness badly"]
    toxic = np.array([1.0, 0.0, 1.0, 0.0, 1.0, 1.0])
    n, keys, bad, good = toxicity.word_counts(pa.array(texts, pa.string()), toxic)
    got = {(a, k): (b, g) for a, k, b, g in zip(n.tolist(), keys.tolist(), bad.tolist(), good.tolist())}
    words = [{w.strip("?") for w in (t or "").lower().split()} for t in texts]
    plain = {}
    for length in (0, *toxicity.PREFIXES):
        for own, y in zip(words, toxic):
            for w in {w[:length] if length else w for w in own if len(w) > length}:
                one = plain.setdefault((length, int(toxicity._hash([w])[0])), [0, 0])
                one[0 if y else 1] += 1
    assert got == {k: tuple(v) for k, v in plain.items()}


def test_isotonic_means_rise_and_keep_the_total():
    rng = np.random.default_rng(15)
    raw = np.round(rng.normal(size=300), 1)
    y = (rng.random(300) < 1 / (1 + np.exp(-raw))).astype(float)
    starts, values = toxicity.isotonic(raw, y)
    assert (np.diff(starts) > 0).all() and (np.diff(values) > 0).all()
    at = np.searchsorted(starts, raw, side="right") - 1
    assert abs(values[at].sum() - y.sum()) < 1e-6


def test_query_over_its_table_against_the_plain_patterns(spark):
    """Counts, digest and presence of the rules' spans for every document, by the patterns and checks alone."""
    from codelineage.llm.queries import op5_pii

    def valid(k, x):
        digits = re.sub("[^0-9]", "", x)
        if k == 1:
            return all(int(n) <= 255 for n in x.split("."))
        if k == 2:
            odd = sum(int(c) for c in digits[::-1][::2]) + sum(sum(divmod(2 * int(c), 10)) for c in digits[::-1][1::2])
            return 14 <= len(digits) <= 19 and odd % 10 == 0
        return k == 0 or 10 <= len(digits) <= 15

    sf, kinds = "/root/testdata/sf0.001", ("email", "ip", "card", "phone")
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        text = r.text or ""
        found = sorted((m.start(), k, m.end()) for k, p in enumerate(PLAIN) for m in re.finditer(p, text) if valid(k, m[0]))
        want[r.doc_id] = ([sum(k == n for _, k, _ in found) for n in range(4)], ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in found))
    rows = op5_pii(spark, sf).collect()
    assert len(rows) == len(want)
    for r in rows:
        counts, base = want[r.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert set(base.split(",")) - {""} <= set(spans)
        place = [(int(a), kinds.index(k), int(b)) for k, a, b in (x.split(":") for x in spans)]
        assert place == sorted(place) and len(place) == len(set(place))
