"""Queries: thresholds, labels, class metrics, audits, splits and reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelineage.functions.ordering import BATCH_TAG, stable_digest
from codelineage.functions.text import iso_utc, js_trim
from codelineage.operators import audits as a
from codelineage.operators import evaluation as e
from codelineage.operators import splits as s
from codelineage.plans import sqltext as q
from codelineage.plans.base import Registry
from codelineage.session import scratch_path
from codelineage.sources import json_files as js
from codelineage.sources.tables import table

R = Registry()
SEED = 42


def scored(spark, d):
    """Scored examples from the event stream; score = value / (value + 50)."""
    ev = table(spark, d, "events")
    digest = stable_digest("example-split-v1", SEED, F.col("event_id"))
    k = F.get_json_object("props", "$.k").cast("int")
    return ev.select(
        F.col("event_id").alias("id"),
        F.col("event_id").alias("source_index"),
        F.concat(F.lit("repo_"), "user_id").alias("repo_full_name"),
        F.concat(F.lit("src/"), "event_type", F.lit(".py")).alias("file_path"),
        F.col("event_type").alias("function_name"),
        F.concat(F.lit("Return the  "), "event_type", F.lit(" value "), k).alias("requirement"),
        F.concat(F.lit("def "), "event_type", F.lit("(x):\n    return x + "), k, F.lit("\n")).alias("old_function_code"),
        F.round(F.col("value") / (F.col("value") + 50), 6).alias("score"),
        k.alias("k"),
        F.when(digest < "b3", "train").when(digest < "cd", "validation").otherwise("test").alias("split"),
    )


SCORED = """scored AS (SELECT event_id AS id, event_id AS source_index, 'repo_' || user_id AS repo_full_name,
  'src/' || event_type || '.py' AS file_path, event_type AS function_name,
  'Return the  ' || event_type || ' value ' || k AS requirement,
  'def ' || event_type || '(x):' || chr(10) || '    return x + ' || k || chr(10) AS old_function_code,
  round(value / (value + 50), 6) AS score, k,
  CASE WHEN h < 'b3' THEN 'train' WHEN h < 'cd' THEN 'validation' ELSE 'test' END AS split
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
        sha256('example-split-v1' || chr(0) || '42' || chr(0) || event_id) AS h FROM events))"""

LABELLED = f"""{SCORED}, th AS (SELECT quantile_cont(score, 0.33) AS p33, quantile_cont(score, 0.66) AS p66
  FROM scored WHERE split = 'train'),
labelled AS (SELECT s.*, CASE WHEN score <= p33 THEN 'low' WHEN score <= p66 THEN 'mid' ELSE 'high' END AS label,
  CASE WHEN score <= p33 THEN 0 WHEN score <= p66 THEN 1 ELSE 2 END AS label_id FROM scored s, th)"""


def labelled(spark, d):
    df = scored(spark, d)
    return e.assign_labels(df, e.train_thresholds(df))


def _guess(k):
    return F.when(k < 33, "low").when(k < 66, "mid").otherwise("high")


def predictions(spark, d):
    """Label of each example and a guess that is right on every third id."""
    df = labelled(spark, d).withColumnRenamed("label", "true_label")
    guess = F.when(F.col("id") % 3 == 0, F.col("true_label")).otherwise(_guess(F.col("k")))
    return df.withColumn("predicted_label", guess)


PREDICTED = f"""{LABELLED}, predictions AS (SELECT *, label AS true_label, CASE WHEN id % 3 = 0 THEN label
  WHEN k < 33 THEN 'low' WHEN k < 66 THEN 'mid' ELSE 'high' END AS predicted_label FROM labelled)"""


def line_predictions(spark, d):
    """Three-class truth from the return flag, guess from quantity thirds."""
    li = table(spark, d, "lineitem")
    flag = F.col("l_returnflag")
    return li.select(
        F.when(flag == "A", "low").when(flag == "N", "mid").otherwise("high").alias("true_label"),
        F.when(F.col("l_quantity") <= 17, "low").when(F.col("l_quantity") <= 34, "mid").otherwise("high").alias("predicted_label"),
        (F.col("l_partkey") % 9).alias("topic_id"),
        F.col("l_discount").alias("strength"),
        F.when(F.col("l_suppkey") % 5 != 0, F.concat(F.lit("clone_"), F.col("l_suppkey") % 5)).alias("clone_type"),
    )


LINES = """lines AS (SELECT CASE l_returnflag WHEN 'A' THEN 'low' WHEN 'N' THEN 'mid' ELSE 'high' END AS true_label,
  CASE WHEN l_quantity <= 17 THEN 'low' WHEN l_quantity <= 34 THEN 'mid' ELSE 'high' END AS predicted_label,
  l_partkey % 9 AS topic_id, l_discount AS strength,
  CASE WHEN l_suppkey % 5 <> 0 THEN 'clone_' || (l_suppkey % 5) END AS clone_type FROM lineitem)"""


def report_sql(source: str, group: str | None, span_all: bool = False, labels=("low", "mid", "high"), extra: str = "") -> str:
    g = group or "0"
    present = "true" if span_all else "sup > 0 OR prd > 0"
    per_class = ", ".join(
        f"max(round({m}, 9)) FILTER (WHERE label = '{l}') AS {l}_{n}"
        for l in labels
        for m, n in (("pr", "precision"), ("rc", "recall"), ("f", "f1"))
    )
    supports = ", ".join(f"CAST(max(sup) FILTER (WHERE label = '{l}') AS BIGINT) AS {l}_support" for l in labels)
    return f"""cls AS (SELECT {g} AS g, l.label, sum((true_label = l.label AND predicted_label = l.label)::INT)::DOUBLE AS tp,
      sum((true_label = l.label)::INT) AS sup, sum((predicted_label = l.label)::INT) AS prd
      FROM {source} CROSS JOIN (VALUES {", ".join(f"('{l}')" for l in labels)}) l(label) GROUP BY 1, 2),
    m AS (SELECT *, coalesce(tp / nullif(prd, 0), 0) AS pr, coalesce(tp / nullif(sup, 0), 0) AS rc,
      coalesce(2 * tp / nullif(prd + sup, 0), 0) AS f FROM cls),
    rep AS (SELECT g, CAST(sum(sup) AS BIGINT) AS n, round(sum(tp) / sum(sup), 9) AS accuracy,
      round(avg(rc) FILTER (WHERE sup > 0), 9) AS balanced_accuracy,
      round(avg(pr) FILTER (WHERE {present}), 9) AS macro_precision, round(avg(rc) FILTER (WHERE {present}), 9) AS macro_recall,
      round(avg(f) FILTER (WHERE {present}), 9) AS macro_f1, round(sum(f * sup) / sum(sup), 9) AS weighted_f1,
      {per_class}, {supports} FROM m GROUP BY g)"""


@R.add("train_thresholds", f"WITH {LABELLED} SELECT round(p33, 9) AS p33, round(p66, 9) AS p66 FROM th")
def train_thresholds(spark, d):
    return e.rounded(e.train_thresholds(scored(spark, d)))


@R.add("score_labels", f"WITH {LABELLED} SELECT id, split, score, label, label_id FROM labelled")
def score_labels(spark, d):
    return labelled(spark, d).select("id", "split", "score", "label", "label_id")


@R.add(
    "class_distribution",
    f"""WITH {LABELLED}, names(label) AS (VALUES ('low'), ('mid'), ('high'), ('unused'))
    SELECT n.label, count(l.id) AS n FROM names n LEFT JOIN labelled l ON n.label = l.label GROUP BY 1""",
)
def class_distribution(spark, d):
    return e.zero_filled(labelled(spark, d), "label", [*e.LABELS, "unused"])


@R.add(
    "confusion_matrix",
    f"""WITH {LINES}, names(label) AS (VALUES ('low'), ('mid'), ('high'))
    SELECT a.label AS true_label, b.label AS predicted_label, count(l.strength) AS n FROM names a CROSS JOIN names b
    LEFT JOIN lines l ON l.true_label = a.label AND l.predicted_label = b.label GROUP BY 1, 2""",
)
def confusion_matrix(spark, d):
    return e.confusion_matrix(line_predictions(spark, d))


@R.add(
    "classification_report",
    f"WITH {PREDICTED}, {report_sql('predictions', None)} SELECT * EXCLUDE (g) FROM rep",
)
def classification_report(spark, d):
    return e.rounded(e.classification_report(predictions(spark, d)))


@R.add(
    "binary_report",
    f"""WITH two AS (SELECT CASE quality WHEN 1 THEN 'pos' ELSE 'neg' END AS true_label,
    CASE toxic WHEN 0 THEN 'pos' ELSE 'neg' END AS predicted_label FROM labels),
    {report_sql('two', None, labels=('neg', 'pos'))} SELECT * EXCLUDE (g) FROM rep""",
)
def binary_report(spark, d):
    two = table(spark, d, "labels").select(
        F.when(F.col("quality") == 1, "pos").otherwise("neg").alias("true_label"),
        F.when(F.col("toxic") == 0, "pos").otherwise("neg").alias("predicted_label"),
    )
    return e.rounded(e.classification_report(two, labels=("neg", "pos")))


@R.add(
    "grouped_report",
    f"""WITH {LINES}, {report_sql('lines', "coalesce(clone_type, 'unknown')")} SELECT g AS clone_type, * EXCLUDE (g) FROM rep""",
)
def grouped_report(spark, d):
    df = line_predictions(spark, d).fillna({"clone_type": "unknown"})
    return e.rounded(e.classification_report(df, ["clone_type"]))


TOPICS = f"""{LINES}, {report_sql('lines', 'topic_id', span_all=True)},
  more AS (SELECT topic_id AS g, round(avg(strength), 9) AS mean_assignment_strength,
    round(count(*) FILTER (WHERE true_label <> 'high' AND predicted_label = 'high')::DOUBLE
      / nullif(count(*) FILTER (WHERE true_label <> 'high'), 0), 9) AS false_high_rate,
    round(count(*) FILTER (WHERE true_label = 'low' AND predicted_label = 'high')::DOUBLE
      / nullif(count(*) FILTER (WHERE true_label = 'low'), 0), 9) AS low_to_high_rate FROM lines GROUP BY 1),
  topics AS (SELECT rep.g AS topic_id, rep.* EXCLUDE (g), mean_assignment_strength, false_high_rate, low_to_high_rate,
    n >= 30 AS minimum_support_met, round(greatest(low_support, mid_support, high_support)::DOUBLE / n, 9) AS majority_baseline_accuracy,
    CASE rep.g {' '.join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(e.TOPIC_NAMES))}
      ELSE 'Topic ' || rep.g || ' (manual name not assigned)' END AS topic_name
    FROM rep JOIN more ON rep.g = more.g)"""


@R.add("topic_report", f"WITH {TOPICS} SELECT * FROM topics")
def topic_report(spark, d):
    return e.rounded(e.topic_report(line_predictions(spark, d)))


@R.add(
    "split_folder",
    f"""WITH {LABELLED} SELECT id, split, function_name, label, row_number() OVER (ORDER BY CASE split WHEN 'train' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END, repo_full_name, id) AS place
    FROM labelled""",
)
def split_folder(spark, d):
    """A folder of splits with its thresholds, read as one source, labelled, written in order and read back with places."""
    folder, ordered = scratch_path(spark, "splits"), scratch_path(spark, "ordered")
    df = scored(spark, d).select("id", "repo_full_name", "function_name", "score", "split")
    for name in js.SPLITS:
        js.write_json_arrays(df.where(F.col("split") == name).drop("split"), f"{folder}/{name}.json")
    js.write_json(e.train_thresholds(df), f"{folder}/thresholds.json")
    rows, thresholds = js.read_splits(spark, folder, "id long, repo_full_name string, function_name string, score double")
    labels = e.assign_labels(rows, thresholds)
    js.write_ordered(labels, ordered, ["split_rank", "repo_full_name", "id"])
    return js.read_ordered(spark, ordered, "id long, split string, function_name string, label string")


@R.add(
    "external_report",
    f"""WITH {PREDICTED}, ext AS (SELECT label AS true_label, CASE WHEN k < 33 THEN 'low' WHEN k < 66 THEN 'mid' ELSE 'high' END AS predicted_label,
      CASE WHEN function_name = 'error' THEN 'unknown' ELSE function_name END AS clone_type FROM predictions WHERE split = 'test'),
    {report_sql('ext', 'clone_type')} SELECT g AS clone_type, * EXCLUDE (g) FROM rep""",
)
def external_report(spark, d):
    """Test examples as outside data, scored with the thresholds of the training split."""
    df = scored(spark, d)
    kind = F.when(F.col("function_name") != "error", F.col("function_name"))
    outside = df.where("split = 'test'").withColumns({"predicted_label": _guess(F.col("k")), "clone_type": kind})
    return e.rounded(e.external_report(outside, e.train_thresholds(df), "clone_type"))


@R.add("bootstrap_ci")
def bootstrap_ci(spark, d):
    return e.bootstrap_macro_f1(line_predictions(spark, d))


@R.add(
    "metric_summary",
    f"""WITH {SCORED} SELECT m AS metric, count(*) AS total_examples, count(*) FILTER (WHERE ok) AS processed_examples,
    count(*) FILTER (WHERE NOT ok) AS skipped_examples, round(coalesce(avg(v) FILTER (WHERE ok), 0), 9) AS average,
    coalesce(min(v) FILTER (WHERE ok), 0) AS minimum, coalesce(max(v) FILTER (WHERE ok), 0) AS maximum
    FROM (SELECT function_name <> 'error' AS ok, unnest(['score', 'k']) AS m, unnest([score, k::DOUBLE]) AS v FROM scored)
    GROUP BY 1""",
)
def metric_summary(spark, d):
    return e.rounded(e.metric_summary(scored(spark, d), ["score", "k"], F.col("function_name") == "error"))


@R.add(
    "split_operator_counts",
    f"WITH {SCORED} SELECT split, function_name, count(*) AS n FROM scored GROUP BY ALL",
)
def split_operator_counts(spark, d):
    return scored(spark, d).groupBy("split", "function_name").agg(F.count("*").alias("n"))


@R.add(
    "status_distribution",
    """WITH o AS (SELECT CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderstatus END AS status, o_orderpriority AS model FROM orders)
    SELECT 'status' AS field, status AS value, count(*) AS n FROM o GROUP BY ALL
    UNION ALL SELECT 'model', model, count(*) FROM o GROUP BY ALL""",
)
def status_distribution(spark, d):
    o = table(spark, d, "orders").select(
        F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderstatus")).alias("status"), F.col("o_orderpriority").alias("model")
    )
    sets = o.groupingSets([["status"], ["model"]], "status", "model").agg(
        F.count("*").alias("n"), F.grouping("status").alias("g")
    )
    by_status = F.col("g") == 0
    return sets.select(
        F.when(by_status, "status").otherwise("model").alias("field"),
        F.when(by_status, F.col("status")).otherwise(F.col("model")).alias("value"), "n",
    )


@R.add(
    "score_ties",
    f"WITH {SCORED} SELECT score, count(*) AS n FROM scored GROUP BY 1 ORDER BY n DESC, score LIMIT 10",
)
def score_ties(spark, d):
    counts = scored(spark, d).groupBy("score").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "score").limit(10)


@R.add(
    "size_audit",
    """SELECT min(n_chars)::DOUBLE AS minimum, round(quantile_cont(n_chars, 0.5), 9) AS median,
    round(quantile_cont(n_chars, 0.95), 9) AS p95, round(quantile_cont(n_chars, 0.99), 9) AS p99,
    max(n_chars)::DOUBLE AS maximum, count(*) FILTER (WHERE n_chars > 2000) AS truncated_examples FROM documents""",
)
def size_audit(spark, d):
    return e.rounded(e.size_audit(table(spark, d, "documents"), "n_chars", 2000))


def tie_scores(spark, d):
    """Training scores where most rows share the maximum."""
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.least(F.lit(1.0), F.floor(F.col("o_totalprice") / 10) / 10000).alias("score")
    )


TIES = """ties AS (SELECT o_orderkey AS id, least(1.0::DOUBLE, floor(o_totalprice / 10) / 10000) AS score FROM orders),
  st AS (SELECT max(score) AS top, quantile_cont(score, 0.33) = quantile_cont(score, 0.66) AS tied FROM ties),
  capped AS (SELECT id, score, score < top OR NOT tied OR row_number() OVER (PARTITION BY score = top
    ORDER BY sha256('synthetic-training-max-tie-v1' || chr(0) || '42' || chr(0) || id), id)
    <= (SELECT count(*) // 2 FROM ties, st WHERE score < top) AS kept FROM ties, st)"""


@R.add("tie_cap", f"WITH {TIES} SELECT id, score, kept FROM capped")
def tie_cap(spark, d):
    return e.tie_cap(tie_scores(spark, d), SEED)


@R.add(
    "train_variants",
    f"""WITH {TIES}, th AS (SELECT quantile_cont(score, 0.33) AS p33, quantile_cont(score, 0.66) AS p66 FROM capped WHERE kept),
    v AS (SELECT id, score, 'imbalanced' AS variant FROM capped UNION ALL SELECT id, score, 'balanced' FROM capped WHERE kept)
    SELECT variant, id, CASE WHEN score <= p33 THEN 'low' WHEN score <= p66 THEN 'mid' ELSE 'high' END AS label FROM v, th""",
)
def train_variants(spark, d):
    capped = e.tie_cap(tie_scores(spark, d), SEED)
    limits = e.exact_percentiles(capped.where("kept"), "score", {"p33": 0.33, "p66": 0.66})
    variants = F.when(F.col("kept"), F.array(F.lit("imbalanced"), F.lit("balanced"))).otherwise(F.array(F.lit("imbalanced")))
    both = capped.select("id", "score", F.explode(variants).alias("variant"))
    return e.assign_labels(both, limits).select("variant", "id", "label")


@R.add(
    "split_overlap",
    f"""WITH {SCORED}, k AS (SELECT split, unnest(['repository', 'function_identity', 'requirement_text', 'old_function_code']) AS key,
      unnest([repo_full_name, repo_full_name || '|' || file_path || '|' || function_name, {q.norm_line('requirement')}, {q.js_trim('old_function_code')}]) AS v FROM scored),
    c AS (SELECT key, v, count(*) FILTER (WHERE split = 'train') AS a, count(*) FILTER (WHERE split = 'validation') AS b,
      count(*) FILTER (WHERE split = 'test') AS c FROM k GROUP BY ALL)
    SELECT key, count(*) FILTER (WHERE a > 0) AS unique_train, count(*) FILTER (WHERE b > 0) AS unique_validation,
      count(*) FILTER (WHERE c > 0) AS unique_test, count(*) FILTER (WHERE a > 0 AND b > 0) AS shared_train_validation,
      count(*) FILTER (WHERE a > 0 AND c > 0) AS shared_train_test, count(*) FILTER (WHERE b > 0 AND c > 0) AS shared_validation_test,
      CAST(sum(CASE WHEN a > 0 THEN b ELSE 0 END) AS BIGINT) AS rows_validation_in_train,
      CAST(sum(CASE WHEN a > 0 THEN c ELSE 0 END) AS BIGINT) AS rows_test_in_train,
      CAST(sum(CASE WHEN b > 0 THEN c ELSE 0 END) AS BIGINT) AS rows_test_in_validation FROM c GROUP BY 1""",
)
def split_overlap(spark, d):
    from codelineage.functions import text as t

    keys = {
        "repository": F.col("repo_full_name"),
        "function_identity": F.concat_ws("|", "repo_full_name", "file_path", "function_name"),
        "requirement_text": t.norm_line(F.col("requirement")),
        "old_function_code": t.js_trim(F.col("old_function_code")),
    }
    return a.split_overlap(scored(spark, d), keys)


@R.add(
    "leakage_check",
    f"""WITH {SCORED} SELECT repo_full_name, min(split) AS first_part, max(split) AS last_part, count(*) AS n FROM scored
    GROUP BY 1 HAVING count(DISTINCT split) > 1""",
)
def leakage_check(spark, d):
    return a.values_in_many(scored(spark, d), "repo_full_name", "split")


@R.add(
    "split_identity",
    f"""WITH {SCORED} SELECT requirement, min(split) AS first_part, max(split) AS last_part, count(*) AS n FROM scored
    GROUP BY 1 HAVING count(DISTINCT split) > 1""",
)
def split_identity(spark, d):
    return a.values_in_many(scored(spark, d), "requirement", "split")


@R.add(
    "duplicate_ids",
    "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
)
def duplicate_ids(spark, d):
    return a.duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@R.add(
    "id_digest",
    """WITH b AS (SELECT substr(sha256(id), 1, 5) AS bucket, sha256(string_agg(id, chr(10) ORDER BY id)) AS d, count(*) AS n
      FROM (SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS id FROM orders) GROUP BY 1)
    SELECT CAST(sum(n) AS BIGINT) AS n_ids, sha256(string_agg(d, chr(10) ORDER BY bucket)) AS digest FROM b""",
)
def id_digest(spark, d):
    return a.set_digest(table(spark, d, "orders"), "o_orderkey")


@R.add(
    "stable_hash",
    "SELECT event_id AS id, sha256('fusion-guided-llm-batch-v1' || chr(0) || '42' || chr(0) || event_id) AS digest FROM events",
)
def stable_hash(spark, d):
    key = stable_digest(BATCH_TAG, SEED, F.col("event_id"))
    return table(spark, d, "events").select(F.col("event_id").alias("id"), key.alias("digest"))


@R.add(
    "hash_split",
    """WITH r AS (SELECT event_id AS id, row_number() OVER (ORDER BY sha256('row-split-v1' || chr(0) || '42' || chr(0) || event_id), event_id) AS k,
      count(*) OVER () AS n FROM events)
    SELECT id, CASE WHEN k <= floor(n * 7 / 10) THEN 'train' WHEN k <= floor(n * 8 / 10) THEN 'validation' ELSE 'test' END AS split FROM r""",
)
def hash_split(spark, d):
    return s.hash_split(table(spark, d, "events").select(F.col("event_id").alias("id")), SEED)


@R.add(
    "grouped_split",
    """WITH g AS (SELECT user_id AS repo, count(*) AS size, sha256('group-split-v1' || chr(0) || '42' || chr(0) || user_id) AS h FROM events GROUP BY 1),
    p AS (SELECT *, coalesce(sum(size) OVER (ORDER BY h, repo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
      sum(size) OVER () AS n FROM g),
    t AS (SELECT sum(size) AS train_rows FROM p WHERE before < n * 0.7)
    SELECT repo, size, CASE WHEN before < n * 0.7 THEN 'train' WHEN before - train_rows < n * 0.1 THEN 'validation' ELSE 'test' END AS split
    FROM p, t""",
)
def grouped_split(spark, d):
    return s.grouped_split(table(spark, d, "events").select(F.col("user_id").alias("repo")), "repo", SEED)


@R.add(
    "permuted_report",
    f"""WITH {PREDICTED}, x AS (SELECT true_label, row_number() OVER (ORDER BY sha256('permute-a' || chr(0) || '42' || chr(0) || id), id) AS r FROM predictions),
    y AS (SELECT predicted_label, row_number() OVER (ORDER BY sha256('permute-b' || chr(0) || '42' || chr(0) || id), id) AS r FROM predictions),
    perm AS (SELECT true_label, predicted_label FROM x JOIN y ON x.r = y.r),
    {report_sql('perm', None)} SELECT * EXCLUDE (g) FROM rep""",
)
def permuted_report(spark, d):
    df = predictions(spark, d).select("id", "true_label", "predicted_label")
    return e.rounded(e.classification_report(s.permuted(df, SEED)))


def _manifest(spark, d):
    """The examples again, with an index lost, a label changed or a path changed now and then."""
    label = F.when(F.col("id") % 101 == 0, "none").otherwise(F.col("label"))
    path = F.when(F.col("id") % 103 == 0, "moved.py").otherwise(F.col("file_path"))
    kept = labelled(spark, d).where(F.col("id") % 97 != 0)
    return kept.select("source_index", "repo_full_name", path.alias("file_path"), "function_name", label.alias("label"))


@R.add(
    "pred_manifest_audit",
    f"""WITH {LABELLED} SELECT id AS source_index, 'missing in manifest' AS problem FROM labelled WHERE id % 97 = 0
    UNION ALL SELECT id, 'mismatch label' FROM labelled WHERE id % 101 = 0 AND id % 97 <> 0
    UNION ALL SELECT id, 'mismatch file_path' FROM labelled WHERE id % 103 = 0 AND id % 97 <> 0""",
)
def pred_manifest_audit(spark, d):
    fields = ["repo_full_name", "file_path", "function_name", "label"]
    return a.prediction_audit(labelled(spark, d), _manifest(spark, d), fields)


@R.add(
    "correct_predictions",
    f"""WITH {PREDICTED} SELECT id AS source_index, true_label, requirement FROM predictions
    WHERE true_label = predicted_label AND id % 97 <> 0""",
)
def correct_predictions(spark, d):
    manifest = scored(spark, d).where(F.col("id") % 97 != 0).select("source_index", "requirement")
    hits = a.correct_predictions(predictions(spark, d).drop("requirement"), manifest)
    return hits.select("source_index", "true_label", "requirement")


IDENTITY = f"""{SCORED}, src AS (SELECT id, repo_full_name AS r, file_path AS f, function_name AS n,
  {q.squeeze('requirement')} AS q, round(score, 12) AS s FROM scored)"""


@R.add(
    "identity_join",
    f"""WITH {IDENTITY}, m AS (SELECT r, f, n, q, s, count(*) AS copies, min(id) AS idx FROM src WHERE id % 50 <> 0 GROUP BY ALL)
    SELECT a.id, m.idx AS source_index, CASE WHEN copies IS NULL THEN 'missing' WHEN copies > 1 THEN 'ambiguous' ELSE 'joined' END AS status
    FROM src a LEFT JOIN m ON a.r = m.r AND a.f = m.f AND a.n = m.n AND a.q = m.q AND a.s = m.s""",
)
def identity_join(spark, d):
    source = scored(spark, d).withColumnRenamed("score", "ast_delta_similarity")
    padded = source.where(F.col("id") % 50 != 0).withColumn("requirement", F.concat(F.lit("  "), "requirement", F.lit("\n")))
    return a.identity_join(source.drop("source_index"), padded).select("id", "source_index", "status")


def done_and_fresh(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus", "o_custkey")
    status = F.when(F.col("o_orderstatus") == "F", "success").otherwise("failed")
    done = o.where(F.col("id") % 3 == 0).select("id", status.alias("status"), F.lit("first run").alias("run"))
    fresh = o.where(F.col("id") % 5 == 0).select("id", F.lit("success").alias("status"), F.lit("second run").alias("run"))
    return o, done, fresh


@R.add(
    "resume_pending",
    "SELECT o_orderkey AS id FROM orders WHERE NOT (o_orderkey % 3 = 0 AND o_orderstatus = 'F')",
)
def resume_pending(spark, d):
    o, done, _ = done_and_fresh(spark, d)
    return a.pending(o, done).select("id")


@R.add(
    "resume_upsert",
    """SELECT o_orderkey AS id, o_custkey AS position, CASE WHEN o_orderkey % 5 = 0 OR o_orderstatus = 'F' THEN 'success' ELSE 'failed' END AS status,
    CASE WHEN o_orderkey % 5 = 0 THEN 'second run' ELSE 'first run' END AS run FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 5 = 0""",
)
def resume_upsert(spark, d):
    o, done, fresh = done_and_fresh(spark, d)
    return a.upsert_in_order(o.withColumnRenamed("o_custkey", "position"), done, fresh)


def batches(spark, d):
    """Order ids in three slices, one id in fifty lost, one in forty doubled, plus ids nobody asked for."""
    ids = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    one = ids.where((F.col("id") % 3 == 0) & (F.col("id") % 50 != 0))
    two = ids.where((F.col("id") % 3 == 1) & (F.col("id") % 50 != 0))
    three = ids.where((F.col("id") % 3 == 2) & (F.col("id") % 50 != 0))
    again = ids.where((F.col("id") % 40 == 0) & (F.col("id") % 50 != 0))
    odd = ids.where(F.col("id") % 60 == 0).select((-F.col("id") - 1).alias("id"))
    return one.union(two).union(three).union(again).union(odd)


@R.add(
    "batch_reconcile",
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 50 = 0 THEN 'missing' ELSE 'duplicate' END AS problem FROM orders
    WHERE o_orderkey % 50 = 0 OR o_orderkey % 40 = 0
    UNION ALL SELECT -o_orderkey - 1, 'unexpected' FROM orders WHERE o_orderkey % 60 = 0""",
)
def batch_reconcile(spark, d):
    expected = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return a.reconcile(expected, batches(spark, d))


@R.add(
    "batch_union",
    "SELECT o_orderkey AS id, o_custkey AS position, CASE WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS batch FROM orders",
)
def batch_union(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("position"))
    even = o.where("id % 2 = 0").select("id", F.lit("even").alias("batch"))
    odd = o.where("id % 2 = 1").select(F.lit("odd").alias("batch"), "id")
    return o.join(even.unionByName(odd), "id")




def operator_rows(spark, d):
    return scored(spark, d).select("id", "split", F.col("function_name").alias("category"))


def quotas(spark, d):
    available = operator_rows(spark, d).groupBy("split", "category").agg(F.count("*").alias("available"))
    return s.balanced_quotas(available, 0.5)


# Half of each split over categories of similar size: the even share plus name-order extras is the whole answer;
# categories that run out are tested on a fixture.
QUOTAS = f"""{SCORED}, av AS (SELECT split, function_name AS category, count(*) AS available FROM scored GROUP BY ALL),
  qt AS (SELECT *, CAST(sum(available) OVER (PARTITION BY split) // 2 AS BIGINT) AS goal,
    count(*) OVER (PARTITION BY split) AS c, row_number() OVER (PARTITION BY split ORDER BY category) AS r FROM av),
  quotas AS (SELECT split, category, available, CAST(goal // c + CASE WHEN r <= goal % c THEN 1 ELSE 0 END AS BIGINT) AS quota FROM qt),
  ranked AS (SELECT id, s.split, function_name AS category, row_number() OVER (PARTITION BY s.split, function_name
    ORDER BY sha256('fusion-guided-llm-batch-v1' || chr(0) || '42' || chr(0) || id), id) AS rank FROM scored s),
  picked AS (SELECT r.*, rank <= quota AS selected FROM ranked r JOIN quotas USING (split, category))"""


@R.add("quota_table", f"WITH {QUOTAS} SELECT * FROM quotas")
def quota_table(spark, d):
    return quotas(spark, d)


@R.add("quota_batch", f"WITH {QUOTAS} SELECT id, split, category, rank FROM picked WHERE selected")
def quota_batch(spark, d):
    picked = s.quota_batch(operator_rows(spark, d), quotas(spark, d), SEED)
    return picked.where("selected").select("id", "split", "category", "rank")


@R.add("batch_complement", f"WITH {QUOTAS} SELECT id, split, category FROM picked WHERE NOT selected")
def batch_complement(spark, d):
    picked = s.quota_batch(operator_rows(spark, d), quotas(spark, d), SEED)
    return picked.where("NOT selected").select("id", "split", "category")


@R.add(
    "cohort_sample",
    f"""WITH {SCORED}, r AS (SELECT id, split, row_number() OVER (PARTITION BY split ORDER BY
    sha256('cohort-sample-v1' || chr(0) || '42' || chr(0) || id), id) AS rank FROM scored)
    SELECT id, split, rank FROM r WHERE rank <= CASE split WHEN 'train' THEN 700 WHEN 'validation' THEN 100 ELSE 200 END""",
)
def cohort_sample(spark, d):
    rows = scored(spark, d).select("id", "split")
    return s.cohort_sample(rows, {"train": 700, "validation": 100, "test": 200}, SEED)


@R.add(
    "cohort_grid",
    """SELECT p_partkey AS source_index, op AS mutation_operator FROM part, (SELECT unnest(['modify_docstring_text',
    'remove_output_statement', 'replace_literal_value', 'modify_return_expression', 'modify_comparison_operator',
    'modify_exception_handler', 'modernize_string_formatting', 'modify_type_annotation', 'modernize_super_call',
    'rename_local_identifier']) AS op)""",
)
def cohort_grid(spark, d):
    from codelineage.operators.mutation import cohort_grid as grid

    return grid(table(spark, d, "part").select(F.col("p_partkey").alias("source_index")))


@R.add(
    "distinct_first",
    f"""SELECT lower({q.squeeze('text')}) AS clean, min(doc_id) AS doc_id FROM documents GROUP BY 1""",
)
def distinct_first(spark, d):
    from codelineage.functions import text as t

    docs = table(spark, d, "documents").select("doc_id", t.norm_line(F.col("text")).alias("clean"))
    return a.first_per_key(docs, "clean", "doc_id")


@R.add("limit_n", "SELECT event_id, value FROM events ORDER BY event_id LIMIT 100")
def limit_n(spark, d):
    return table(spark, d, "events").select("event_id", "value").orderBy("event_id").limit(100)


@R.add(
    "expectation_check",
    f"""WITH {PREDICTED}, {report_sql('predictions', None)}, act AS (SELECT unnest(['accuracy', 'macro_f1']) AS metric, unnest([accuracy, macro_f1]) AS actual FROM rep)
    SELECT x.metric, round(x.expected, 9) AS expected, round(actual, 9) AS actual, coalesce(abs(actual - x.expected) <= 1e-12, false) AS ok
    FROM (SELECT 'accuracy' AS metric, accuracy AS expected FROM rep UNION ALL SELECT 'macro_f1', macro_f1 + 1e-9 FROM rep
      UNION ALL SELECT 'validation_macro_f1', 0.6112061648445745::DOUBLE) x
    LEFT JOIN act ON act.metric = x.metric""",
)
def expectation_check(spark, d):
    """One metric as expected, one off by little, one that is missing."""
    report = e.classification_report(predictions(spark, d))
    actual = report.unpivot([], ["accuracy", "macro_f1"], "metric", "actual")
    right = report.select(F.lit("accuracy").alias("metric"), F.col("accuracy").alias("expected"))
    off = report.select(F.lit("macro_f1").alias("metric"), (F.col("macro_f1") + 1e-9).alias("expected"))
    missing = spark.createDataFrame([("validation_macro_f1", 0.6112061648445745)], "metric string, expected double")
    return e.rounded(e.expectation_check(actual, right.unionByName(off).unionByName(missing))).select("metric", "expected", "actual", "ok")


# Records as raw JSON text, with a field missing, null or of another type now and then.
RAW = """raw AS (SELECT event_id AS id, '{"repo_full_name": "repo_' || user_id || '", "file_path": '
  || CASE WHEN event_id % 7 = 0 THEN 'null' ELSE '"src/a.py"' END || ', "function_name": '
  || CASE WHEN event_id % 11 = 0 THEN '12' ELSE '"f"' END
  || CASE WHEN event_id % 13 = 0 THEN '' ELSE ', "old_function_code": "x = 1"' END
  || ', "new_function_code": "x = 2", "new_function_code_by_llm": "x = 3", "requirement": '
  || CASE WHEN event_id % 17 = 0 THEN '"   "' ELSE '"Return two"' END || ', "ast_delta_similarity": '
  || CASE WHEN event_id % 19 = 0 THEN 'true' WHEN event_id % 23 = 0 THEN '"0.5"' WHEN event_id % 29 = 0 THEN '1.5' ELSE '0.5' END
  || '}' AS record FROM events)"""


def raw_records(spark, d):
    i = F.col("event_id")
    every = lambda n, a, b: F.when(i % n == 0, F.lit(a)).otherwise(F.lit(b))
    score = F.when(i % 19 == 0, "true").when(i % 23 == 0, '"0.5"').when(i % 29 == 0, "1.5").otherwise("0.5")
    record = F.concat(
        F.lit('{"repo_full_name": "repo_'), F.col("user_id").cast("string"), F.lit('", "file_path": '),
        every(7, "null", '"src/a.py"'), F.lit(', "function_name": '), every(11, "12", '"f"'),
        every(13, "", ', "old_function_code": "x = 1"'),
        F.lit(', "new_function_code": "x = 2", "new_function_code_by_llm": "x = 3", "requirement": '),
        every(17, '"   "', '"Return two"'), F.lit(', "ast_delta_similarity": '), score, F.lit("}"),
    )
    return table(spark, d, "events").select(i.alias("id"), record.alias("record"))


def _required_sql() -> str:
    cases = []
    for f in a.REQUIRED:
        kind = f"json_type(record, '$.{f}')"
        cases.append(f"WHEN {kind} IS NULL THEN 'Missing required field: {f}'")
        cases.append(f"WHEN {kind} = 'NULL' THEN 'Field is None: {f}'")
        cases.append(f"WHEN {kind} <> 'VARCHAR' THEN 'Field is not a string: {f}'")
    return "CASE " + " ".join(cases) + " END"


@R.add("validate_errors", f"WITH {RAW} SELECT id, {_required_sql()} AS error FROM raw")
def validate_errors(spark, d):
    return a.validate_required(raw_records(spark, d), "record").select("id", "error")


@R.add(
    "validate_scored",
    f"""WITH {RAW} SELECT id, CASE WHEN json_type(record, '$.old_function_code') IS NULL THEN 'missing_required_fields'
    WHEN id % 17 = 0 THEN 'invalid_requirement'
    WHEN json_type(record, '$.ast_delta_similarity') NOT IN ('DOUBLE', 'BIGINT', 'UBIGINT') THEN 'non_numeric_ast_delta_similarity'
    WHEN NOT CAST(json_extract_string(record, '$.ast_delta_similarity') AS DOUBLE) BETWEEN 0 AND 1 THEN 'score_outside_zero_one' END AS reason FROM raw""",
)
def validate_scored(spark, d):
    return a.validate_scored(raw_records(spark, d), "record").select("id", "reason")


@R.add(
    "label_pair_check",
    """SELECT event_id AS id, CASE WHEN event_id % 4 = 3 THEN 'invalid label_id 3'
    WHEN event_id % 5 <> event_id % 4 THEN 'label name and ID disagree' END AS problem FROM events""",
)
def label_pair_check(spark, d):
    i = F.col("event_id")
    name = F.element_at(F.array(*[F.lit(x) for x in ("low", "mid", "high", "top", "none")]), (i % 5 + 1).cast("int"))
    rows = table(spark, d, "events").select(i.alias("id"), (i % 4).alias("label_id"), name.alias("label"))
    return rows.select("id", a.label_pair_problem(F.col("label"), F.col("label_id")).alias("problem"))


@R.add(
    "leak_safe",
    f"""WITH {SCORED} SELECT source_index, repo_full_name, file_path, function_name, {q.js_trim('requirement')} AS requirement,
    old_function_code, score AS ast_delta_similarity FROM scored""",
)
def leak_safe(spark, d):
    full = scored(spark, d).withColumnRenamed("score", "ast_delta_similarity").withColumn("new_function_code", F.lit("x"))
    return a.leak_safe(full)


@R.add(
    "status_split",
    """SELECT event_id AS id, event_type = 'error' AS is_error, CASE WHEN event_type = 'error' THEN 'generation_not_successful' END AS error FROM events""",
)
def status_split(spark, d):
    failed = F.col("event_type") == "error"
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"), failed.alias("is_error"), F.when(failed, "generation_not_successful").alias("error")
    )


@R.add(
    "manifest",
    f"""WITH {LABELLED} SELECT source_index, repo_full_name, file_path, function_name, {q.js_trim('requirement')} AS requirement,
    score AS ast_delta_similarity, label AS similarity_label, label_id FROM labelled""",
)
def manifest(spark, d):
    """Identity and label of every row, without its code."""
    rows = labelled(spark, d).withColumnsRenamed({"score": "ast_delta_similarity", "label": "similarity_label"})
    return a.manifest(rows.withColumn("requirement", js_trim(F.col("requirement"))))


@R.add(
    "iso_times",
    """SELECT event_id AS id, CAST(ts AS TIMESTAMP) AS zulu, CAST(ts AS TIMESTAMP) AS naive, CAST(ts AS TIMESTAMP) - INTERVAL 2 HOUR AS shifted,
    NULL::TIMESTAMP AS broken FROM events""",
)
def iso_times(spark, d):
    """The time of every event, read back from three spellings and one that is no time."""
    text = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    spelled = {"zulu": F.concat(text, F.lit("Z")), "naive": text, "shifted": F.concat(text, F.lit("+02:00")), "broken": F.concat(F.lit("at "), text)}
    return table(spark, d, "events").select(F.col("event_id").alias("id"), *[iso_utc(c).alias(n) for n, c in spelled.items()])


@R.add(
    "prediction_rows",
    f"""WITH {PREDICTED} SELECT id, true_label, predicted_label, round(k / 100.0, 6)::DOUBLE AS p_low FROM predictions""",
)
def prediction_rows(spark, d):
    p = predictions(spark, d)
    share = F.col("k") / 100.0
    ids = p.select(
        "id", F.col("label_id").alias("true_id"), e.label_id(F.col("predicted_label")).alias("predicted_id"),
        F.array(share, (1 - share) / 2, (1 - share) / 2).alias("probability"),
    )
    rows = e.prediction_rows(ids)
    return rows.select("id", "true_label", "predicted_label", F.round(F.col("probabilities")["low"], 6).alias("p_low"))
