"""Thresholds, reports, audits, splits and quotas."""

import hashlib
import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from codelineage.functions.ordering import hash_rank, stable_digest
from codelineage.operators import audits as a, evaluation as e, splits as s


@pytest.mark.parametrize("values", [[0.5], [0.1, 0.9], [1.0] * 9 + [0.0], [0.3, 0.3, 0.7, 0.2, 0.25, 0.9999, 0.0001]])
def test_percentiles_equal_numpy(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "score double")
    got = e.exact_percentiles(df, "score", {"p33": 0.33, "p66": 0.66, "top": 1.0}).first()
    assert list(got) == pytest.approx(list(np.percentile(values, [33, 66, 100])))


def test_percentiles_outside_the_unit_range(spark):
    values = [random.Random(3).randint(-50, 10_000) for _ in range(500)]
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = e.exact_percentiles(df, "x", {"m": 0.5, "q": 0.95}, min(values), max(values)).first()
    assert list(got) == pytest.approx(list(np.percentile(values, [50, 95])))


def test_label_borders(spark):
    df = spark.createDataFrame([(0.3,), (0.31,), (0.9,), (0.91,)], "score double")
    limits = spark.createDataFrame([(0.3, 0.9)], "p33 double, p66 double")
    assert [(r.label, r.label_id) for r in e.assign_labels(df, limits).collect()] == [("low", 0), ("mid", 1), ("mid", 1), ("high", 2)]


def golden(spark):
    cells = [[198, 62, 32], [87, 160, 47], [66, 65, 155]]
    rows = [(e.LABELS[i], e.LABELS[j], n) for i, row in enumerate(cells) for j, n in enumerate(row)]
    df = spark.createDataFrame(rows, "true_label string, predicted_label string, n int")
    return df.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("n", "i")


def test_golden_report(spark):
    r = e.classification_report(golden(spark)).first()
    assert r.accuracy == pytest.approx(0.588302752293578, abs=1e-12)
    assert r.macro_f1 == pytest.approx(0.5875971714520309, abs=1e-12)
    assert (r.low_support, r.mid_support, r.high_support) == (292, 294, 286)


def test_weighted_report_equals_repeated_rows(spark):
    df = spark.createDataFrame([("low", "low", 3), ("low", "high", 1), ("mid", "mid", 2)], "true_label string, predicted_label string, w int")
    r = e.classification_report(df, weight="w").first()
    assert (r.n, r.accuracy) == (6, pytest.approx(5 / 6))


def test_macro_spans_present_classes_only(spark):
    df = spark.createDataFrame([("low", "low"), ("low", "mid")], "true_label string, predicted_label string")
    present, every = e.classification_report(df).first(), e.classification_report(df, span_all=True).first()
    assert present.macro_f1 == pytest.approx((2 / 3) / 2) and every.macro_f1 == pytest.approx((2 / 3) / 3)
    assert present.balanced_accuracy == 0.5 and present.high_f1 == 0.0


def test_topic_rates_are_null_without_a_base(spark):
    df = spark.createDataFrame([(0, "high", "high", 0.5), (9, "low", "high", 0.5)], "topic_id int, true_label string, predicted_label string, strength double")
    got = {r.topic_id: r for r in e.topic_report(df).collect()}
    assert got[0].false_high_rate is None and got[0].low_to_high_rate is None and not got[0].minimum_support_met
    assert got[9].low_to_high_rate == 1.0 and got[9].topic_name == "Topic 9 (manual name not assigned)"


def test_bootstrap_interval_holds_the_score(spark):
    r = e.bootstrap_macro_f1(golden(spark), samples=2000).first()
    rng, flat = np.random.default_rng(0), np.array([198, 62, 32, 87, 160, 47, 66, 65, 155])

    def f1(m):
        m = m.reshape(3, 3)
        return np.mean(2 * m.diagonal() / (m.sum(0) + m.sum(1)))

    # resampling the 872 examples one by one
    ids = np.repeat(np.arange(9), flat)
    plain = [f1(np.bincount(rng.choice(ids, ids.size), minlength=9)) for _ in range(2000)]
    low, high = np.percentile(plain, [2.5, 97.5])
    assert r.lower_95 < 0.5876 < r.upper_95
    assert r.lower_95 == pytest.approx(low, abs=0.006) and r.upper_95 == pytest.approx(high, abs=0.006)


def test_tie_cap(spark):
    rows = [(i, 1.0 if i < 80 else i / 1000) for i in range(100)]
    df = spark.createDataFrame(rows, "id int, score double")
    got = {r.id for r in e.tie_cap(df, 42).where("kept").collect()}
    key = lambda i: hashlib.sha256(f"synthetic-training-max-tie-v1\0{42}\0{i}".encode()).hexdigest()
    assert got == set(range(80, 100)) | set(sorted(range(80), key=key)[:10])
    spread = spark.createDataFrame([(i, i / 100) for i in range(100)], "id int, score double")
    assert e.tie_cap(spread, 42).where("kept").count() == 100


def test_metric_summary_of_nothing(spark):
    df = spark.createDataFrame([(0.5, True)], "score double, failed boolean")
    r = e.metric_summary(df, ["score"], F.col("failed")).first()
    assert (r.total_examples, r.processed_examples, r.skipped_examples, r.average, r.minimum) == (1, 0, 1, 0.0, 0.0)


# --- ordering ----------------------------------------------------------------------


def test_hash_rank_with_one_hot_group(spark):
    rows = [("hot" if i % 3 else f"g{i % 7}", i) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, id int").withColumn("d", stable_digest("t", 1, F.col("id")))
    got = {(r.g, r.id): r.rank for r in hash_rank(df.repartition(7), ["g"], "d", "id").collect()}
    key = lambda i: hashlib.sha256(f"t\0{1}\0{i}".encode()).hexdigest()
    groups = {}
    for g, i in rows:
        groups.setdefault(g, []).append(i)
    want = {(g, i): n for g, ids in groups.items() for n, i in enumerate(sorted(ids, key=key), 1)}
    assert got == want


def test_hash_rank_sends_no_side_through_the_driver(spark, capsys):
    df = spark.createDataFrame([("a", i) for i in range(50)], "g string, id int").withColumn("d", stable_digest("t", 1, F.col("id")))
    df.write.mode("overwrite").parquet(path := tempfile.mkdtemp() + "/rows")
    hash_rank(spark.read.parquet(path), ["g"], "d", "id").explain()
    assert "Broadcast" not in capsys.readouterr().out


def test_grouped_split_is_greedy(spark):
    sizes = {f"r{i}": random.Random(i).randint(1, 30) for i in range(40)} | {"hot": 300}
    df = spark.createDataFrame([(r,) for r, n in sizes.items() for _ in range(n)], "repo string")
    got = {r.repo: r.split for r in s.grouped_split(df, "repo", 7).collect()}
    total, filled, want = sum(sizes.values()), {"train": 0, "validation": 0, "test": 0}, {}
    for r in sorted(sizes, key=lambda r: hashlib.sha256(f"group-split-v1\0{7}\0{r}".encode()).hexdigest()):
        to = "train" if filled["train"] < total * 0.7 else "validation" if filled["validation"] < total * 0.1 else "test"
        want[r], filled[to] = to, filled[to] + sizes[r]
    assert got == want


def water_fill(available, target):
    quota, left = {k: 0 for k in available}, target
    while left:
        live = sorted(k for k in available if quota[k] < available[k])
        share, extra = divmod(left, len(live))
        for i, k in enumerate(live):
            take = min(share + (i < extra), available[k] - quota[k])
            quota[k] += take
            left -= take
    return quota


@pytest.mark.parametrize("seed", range(3))
def test_quotas_are_even_and_complete(spark, seed):
    rng = random.Random(seed)
    available = {f"c{i}": rng.choice([0, 1, 2, 3, 50, 51, 400]) for i in range(9)}
    target = rng.randint(0, sum(available.values()))
    df = spark.createDataFrame([("train", k, n) for k, n in available.items()], "split string, category string, available bigint")
    got = {r.category: r.quota for r in s.balanced_quotas(df, {"train": target}).collect()}
    want = water_fill(available, target)
    assert got == want and sum(got.values()) == target


def test_batch_and_remainder_rebuild_the_input(spark):
    rows = [(i, "train" if i % 4 else "test", f"c{i % 3}") for i in range(200)]
    df = spark.createDataFrame(rows, "id int, split string, category string")
    quotas = s.balanced_quotas(df.groupBy("split", "category").agg(F.count("*").alias("available")), {"train": 60, "test": 20})
    out = s.quota_batch(df, quotas, 42)
    assert out.where("selected").groupBy("split").count().orderBy("split").collect() == [("test", 20), ("train", 60)]
    assert sorted(r.id for r in out.collect()) == list(range(200))


def test_permutation_keeps_both_margins(spark):
    rows = [(i, f"t{i % 3}", f"p{i % 5}") for i in range(90)]
    out = s.permuted(spark.createDataFrame(rows, "id int, true_label string, predicted_label string"), 3).collect()
    assert sorted(r.true_label for r in out) == sorted(t for _, t, _ in rows)
    assert sorted(r.predicted_label for r in out) == sorted(p for _, _, p in rows)


# --- audits ---------------------------------------------------------------------------


def test_prediction_audit_reports_everything(spark):
    p = spark.createDataFrame([(1, "a", "low"), (2, "b", "mid"), (3, "c", None), (5, "e", "low"), (5, "e", "low")], "source_index int, path string, label string")
    m = spark.createDataFrame([(1, "a", "low"), (2, "x", "high"), (3, "c", None), (4, "d", "low"), (5, "e", "low")], "source_index int, path string, label string")
    got = {(r.source_index, r.problem) for r in a.prediction_audit(p, m, ["path", "label"]).collect()}
    assert got == {(2, "mismatch path"), (2, "mismatch label"), (4, "missing in predictions"), (5, "duplicate index")}


def test_required_fields_in_order(spark):
    rows = [
        (1, '{"a": "x", "b": "y"}'), (2, '{"b": "y"}'), (3, '{"a": null, "b": "y"}'), (4, '{"a": 3}'), (5, '{"a": "x", "b": true}'),
    ]
    df = spark.createDataFrame(rows, "id int, j string")
    got = {r.id: r.error for r in a.validate_required(df, "j", ["a", "b"]).collect()}
    assert got == {1: None, 2: "Missing required field: a", 3: "Field is None: a", 4: "Field is not a string: a", 5: "Field is not a string: b"}


def test_scored_records(spark):
    base = '{"repo_full_name":"r","file_path":"p","function_name":"f","old_function_code":"x","requirement":%s,"ast_delta_similarity":%s}'
    rows = [(1, base % ('"q"', "0.5")), (2, base % ('"  "', "0.5")), (3, base % ('"q"', "true")), (4, base % ('"q"', "1.01")), (5, base % ('"q"', '"0.5"')), (6, base % ('"q"', "1")), (7, "{}")]
    got = {r.id: r.reason for r in a.validate_scored(spark.createDataFrame(rows, "id int, j string"), "j").collect()}
    assert got == {
        1: None, 2: "invalid_requirement", 3: "non_numeric_ast_delta_similarity", 4: "score_outside_zero_one",
        5: "non_numeric_ast_delta_similarity", 6: None, 7: "missing_required_fields",
    }


def test_leak_safe_columns(spark):
    cols = [*a.SAFE_COLUMNS, "new_function_code", "new_function_code_by_llm", "human_delta"]
    df = spark.createDataFrame([tuple(str(i) for i in range(len(cols)))], ", ".join(f"{c} string" for c in cols))
    assert a.leak_safe(df).columns == list(a.SAFE_COLUMNS)


def test_set_digest_ignores_order_and_copies(spark):
    x = spark.createDataFrame([(str(i),) for i in range(50)], "id string")
    y = spark.createDataFrame([(str(i),) for i in reversed(range(50))] + [("7",)], "id string")
    assert a.set_digest(x).first() == a.set_digest(y).first()
    assert a.set_digest(x).first().digest != a.set_digest(x.where("id <> '7'")).first().digest
