"""Surveys, games, JSON sources and streams."""

import json
import random
import re

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelineage.operators import survey as sv
from codelineage.sources import json_files as js
from codelineage.sources.survey_csv import read_two_header_csv
from codelineage.streaming import commits as st

CSV = '''Respondent ID,"What do you
expect?",,Your view,
,Purpose,"Access, level",,Comment
1.1002E+11,Full Disclosure,No Disclosure,Agree,fine
1.1002E+11,Partial Disclosure,Full Disclosure,Strongly Agree,
,,,,
,Total Full = 1,Total Full = 1,,
'''


def test_two_header_csv(spark, tmp_path):
    (tmp_path / "s.csv").write_text(CSV)
    long = read_two_header_csv(spark, str(tmp_path / "s.csv"))
    got = sorted((r.question, r.option, r.value) for r in long.where("value IS NOT NULL").collect())
    q = "What do you\nexpect?"
    assert got == sorted([
        (q, "Purpose", "Full Disclosure"), (q, "Purpose", "Partial Disclosure"), (q, "Access, level", "No Disclosure"),
        (q, "Access, level", "Full Disclosure"), ("Your view", "Your view", "Agree"), ("Your view", "Your view", "Strongly Agree"), ("Your view", "Comment", "fine"),
    ])
    assert long.select("respondent").distinct().count() == 2  # the ids repeat, the surrogate does not


def answers(spark, values, question="q", option="o"):
    return spark.createDataFrame([(i, question, option, v) for i, v in enumerate(values)], "respondent int, question string, option string, value string")


def test_golden_tallies(spark):
    likert = ["Strongly Disagree"] * 4 + ["Disagree"] * 12 + ["Agree"] * 2 + ["Strongly Agree"]
    assert sv.likert_mean(answers(spark, likert)).first()["mean"] == pytest.approx(3.0)
    concern = sv.multi_select(answers(spark, ["Concern"] * 64 + [""] * 20)).first()
    assert concern.n == 64 and round(concern.share * 100, 2) == 76.19
    levels = ["No"] * 1 + ["Partial"] * 9 + ["Full"] * 4
    df = spark.createDataFrame([("t", l) for l in levels] + [("all", "Full")] * 19, "topic string, level string")
    got = {r.topic: (r.n_no, r.n_partial, r.n_full, round(r.p_full, 4)) for r in sv.level_shares(df, ["topic"]).collect()}
    assert got == {"t": (1, 9, 4, 0.2857), "all": (0, 0, 19, 1.0)}


def plain_check(dev, org, rho):
    m = np.array([[1, rho, 0], [rho, 1, rho], [0, rho, 1]])
    dp, op = m @ org, dev @ m

    def stable(p, x):
        use = p > 1e-9
        return bool(np.allclose(x[use], x[use][0], atol=1e-9) and np.all(x[~use] <= x[use][0] + 1e-9)) if use.any() else False

    best = lambda x: [sv.LEVELS[i] for i in np.where(x >= x.max() - 1e-9)[0]]
    return dp, op, best(dp), best(op), stable(dev, dp) and stable(org, op)


def test_games_match_plain_arrays(spark):
    rng = random.Random(2)
    profiles = [([1, 0, 0], [1, 0, 0]), ([0.5, 0, 0.5], [0.5, 0, 0.5]), ([0, 0, 1], [1, 0, 0]), ([0.5, 0.5, 0], [0.5, 0.5, 0]), ([0, 0, 0], [0.2, 0.3, 0.5])]
    for _ in range(6):
        draw = np.array([rng.randint(0, 4) + 0.01 for _ in range(6)]).reshape(2, 3)
        profiles.append(tuple((row / row.sum()).tolist() for row in draw))
    df = spark.createDataFrame([(str(i), [float(v) for v in d], [float(v) for v in o]) for i, (d, o) in enumerate(profiles)], "topic string, dev array<double>, org array<double>")
    for r in sv.rho_sweep(df).collect():
        dev, org = (np.array(v, dtype=float) for v in profiles[int(r.topic)])
        dp, op, db, ob, mixed = plain_check(dev, org, r.rho)
        assert r.dev_payoff == pytest.approx(list(dp)) and r.org_payoff == pytest.approx(list(op))
        assert (r.dev_best, r.org_best, r.is_mixed_equilibrium) == (db, ob, mixed)
        assert r.alignments == [f"({a}, {b})" for a in db for b in ob]


def test_pure_equilibria_of_the_common_game(spark):
    for rho in sv.RHOS:
        m = [[1, rho, 0], [rho, 1, rho], [0, rho, 1]]
        cells = [("g", i, j, float(m[i][j]), float(m[i][j])) for i in range(3) for j in range(3)]
        df = spark.createDataFrame(cells, "game string, i int, j int, a double, b double")
        assert sorted((r.i, r.j) for r in sv.pure_equilibria(df).collect()) == [(0, 0), (1, 1), (2, 2)]


def test_strategy_profile_without_answers_is_zero(spark):
    df = spark.createDataFrame([("t", "developer", "Full")], "topic string, player string, level string")
    r = sv.strategy_profiles(df).first()
    assert (r.dev, r.org) == ([0.0, 0.0, 1.0], [0.0, 0.0, 0.0])


# --- JSON ------------------------------------------------------------------------------


def test_json_array_results_and_missing_file(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1, "t": "x\ny"}, {"id": 2, "t": None}], indent=2))
    assert [r.id for r in js.read_json_array(spark, str(tmp_path / "a.json"), "id int, t string").orderBy("id").collect()] == [1, 2]
    (tmp_path / "r.json").write_text(json.dumps({"results": [{"id": 5}], "summary": {}}))
    assert js.read_results(spark, str(tmp_path / "r.json"), "id:int").first().id == 5
    (tmp_path / "bad.json").write_text(json.dumps({"rows": []}))
    with pytest.raises(Exception, match="results"):
        js.read_results(spark, str(tmp_path / "bad.json"), "id:int").collect()
    assert js.read_optional(spark, str(tmp_path / "none.json"), "id int").count() == 0


def test_json_sinks(spark, tmp_path):
    df, path = spark.range(3), str(tmp_path / "out")
    js.write_json(df, path)
    js.append_json(df, path)
    assert spark.read.schema("id bigint").json(path).count() == 6
    with pytest.raises(AnalysisException):
        js.write_json(df, path, refuse_existing=True)
    js.write_json(df, path)
    assert spark.read.schema("id bigint").json(path).count() == 3


def test_thresholds_must_be_exact(spark):
    with pytest.raises(ValueError):
        js.check_thresholds(spark.createDataFrame([(0.1, 0.2, 0.3)], "p33 double, p66 double, p99 double"))


# --- streams -----------------------------------------------------------------------------


def commit_files(spark, path, batches):
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "repo bigint, commit bigint, ts string").withColumn("ts", F.to_timestamp("ts"))
        df.coalesce(1).write.mode("append").parquet(path)


def commit_stream(spark, path):
    return spark.readStream.schema("repo bigint, commit bigint, ts timestamp").option("maxFilesPerTrigger", 1).parquet(path)


def test_baseline_over_several_batches(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    commit_files(spark, src, [[(1, 10, "2024-01-01 00:00:02"), (1, 9, "2024-01-01 00:00:01")], [(1, 11, "2024-01-02"), (2, 20, "2024-01-02")], [(2, 21, "2024-01-03")]])
    got = st.finished(st.skip_baseline(commit_stream(spark, src), out), spark, out)
    passed = {(r.repo, r.commit) for r in got.collect()}
    assert len(passed) == 3 and (2, 21) in passed | {(2, 20)}
    # restart: nothing new, nothing doubled
    again = st.finished(st.skip_baseline(commit_stream(spark, src), out), spark, out)
    assert {(r.repo, r.commit) for r in again.collect()} == passed
    commit_files(spark, src, [[(1, 12, "2024-01-04"), (3, 30, "2024-01-04")]])
    more = st.finished(st.skip_baseline(commit_stream(spark, src), out), spark, out)
    assert {(r.repo, r.commit) for r in more.collect()} == passed | {(1, 12)}


def test_dedupe_passes_late_commits_and_no_repeats(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    hourly = [(1, 1, f"2024-01-10 0{h}:00:00") for h in range(4)]
    batches = [
        [*hourly[:2], *[(1, c, "2024-01-10 00:00:00") for c in range(2, 7)]],
        [hourly[2], *[(2, c, "2024-01-10 00:00:00") for c in range(4)]],
        [hourly[3], *[(3, c, "2024-01-01 00:00:00") for c in range(5)], (2, 1, "2024-01-10 00:00:00")],
    ]
    for batch in batches:
        commit_files(spark, src, [batch])
        got = st.finished(st.dedupe_commits(commit_stream(spark, src), out), spark, out)
    found = sorted((r.repo, r.commit) for r in got.collect())
    assert found == sorted({(r, c) for batch in batches for r, c, _ in batch}) and len(found) == 15
    again = st.finished(st.dedupe_commits(commit_stream(spark, src), out), spark, out)
    assert again.count() == 15


def test_runs_of_known_keys_cover_all_earlier_batches():
    for width in (2, 3, 8):
        for batch in range(200):
            runs = st.key_runs(batch, width)
            assert sorted(b for level, n in runs for b in range(n * width**level, (n + 1) * width**level)) == list(range(batch))
            assert max([sum(l == level for l, _ in runs) for level, _ in runs], default=0) < width


def test_a_batch_reads_the_files_of_its_own_buckets(spark, tmp_path):
    out, schema = str(tmp_path), T.StructType([T.StructField(c, k) for c, k in (("repo", T.LongType()), ("commit", T.LongType()), ("bucket", T.IntegerType()))])
    for batch in range(10):
        st.merge_runs(spark, out, batch, schema)
        rows = spark.createDataFrame([(batch, c, c % 6) for c in range(12)] if batch != 4 else [], schema)
        rows.coalesce(1).write.mode("overwrite").partitionBy("bucket").parquet(st._run_path(out, 0, batch))
    assert sorted(st.key_runs(10)) == [(0, 8), (0, 9), (1, 0)]
    known = st.known_keys(spark, out, 10, [3], schema)
    assert {(r.repo, r.commit) for r in known.collect()} == {(b, c) for b in range(10) for c in (3, 9) if b != 4}
    scan = known._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*bucket#\d+ = 3", scan)
    read = known.select(F.input_file_name().alias("f")).distinct().count()
    assert read == 3  # one bucket of one merged and two single runs
    assert len(list(tmp_path.glob("keys/level=*/run=*/bucket=*/*.parquet"))) == 6 * 9 + 6
    # a repeated batch merges again without another result
    st.merge_runs(spark, out, 8, schema)
    assert st.known_keys(spark, out, 10, list(range(6)), schema).count() == 12 * 9


def test_log_of_a_repeated_batch_has_no_double_line(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    messages = spark.createDataFrame([(c, 0, "assistant", f"```py\nx{c} = call({c})\n```") for c in range(3)], "conv_id long, turn long, role string, text string")
    blocks = lambda rows: spark.createDataFrame(rows, "conv_id long, block long, content string").coalesce(1).write.mode("append").parquet(src)
    blocks([(0, 0, "x0 = call(0)"), (1, 0, "mine = 1")])
    describe = lambda found: found.withColumns({"commit": F.lit("c"), "file_path": F.lit("f"), "function_name": F.col("conv_id").cast("string"), "start_line": F.lit(0), "end_line": F.lit(1)})
    run = lambda: st._run(st.log_batches(spark.readStream.schema("conv_id long, block long, content string").parquet(src), messages, out, describe))
    read = lambda: sorted((r.functionName, r.detectedLabel) for r in st.read_log(spark, out, "functionName string, detectedLabel string").collect())
    run()
    first = read()
    assert first == [("0", "LLM_GENERATED"), ("1", "HUMAN_WRITTEN")]
    for name in ("0", ".0.crc"):  # as after a crash between the write and its commit
        (tmp_path / "out" / "_checkpoint" / "commits" / name).unlink(missing_ok=True)
    run()
    assert read() == first
    blocks([(2, 0, "x2 = call(2)")])
    run()
    assert read() == [*first, ("2", "LLM_GENERATED")]


def test_latest_report_counts_a_commit_over_all_its_batches(spark, tmp_path):
    out = str(tmp_path / "out")
    columns = "commit long, ts timestamp, label string, start_line int, end_line int"
    day = lambda d: __import__("datetime").datetime(2024, 1, d)
    for i, rows in enumerate([[(7, day(2), "LLM_GENERATED", 1, 3)] * 3 + [(6, day(1), "MIXED", 1, 2)], [(7, day(2), "HUMAN_WRITTEN", 4, 5)] * 3]):
        spark.createDataFrame(rows, columns).write.parquet(f"{out}/data/batch={i}")
    r = st.read_latest(spark, out).first()
    assert (r["commit"], r["analyzed_lines"], r["llm_generated"], r["human_written"]) == (7, 6, 3, 3)

def test_table_stream_reads_files_and_folders(spark, tmp_path):
    rows = spark.range(20).withColumn("text", F.lit("x"))
    rows.repartition(3).write.parquet(str(tmp_path / "parts.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "one"))
    next((tmp_path / "one").glob("part-*.parquet")).rename(tmp_path / "single.parquet")
    for name in ("parts", "single"):
        out = str(tmp_path / f"out-{name}")
        got = st.finished(st.latest_report(st.table_stream(spark, str(tmp_path), name), out), spark, out)
        assert sorted(r.id for r in got.collect()) == list(range(20))
