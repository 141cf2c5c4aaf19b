import random

import pytest
from helpers import AWKWARD, classes, near_copy_rows, sentence, without_repeats
from test_pii_toxicity import toxic_rows
from test_tokens import check_packing
from pyspark.sql import functions as F

import corpus_pipeline as P
from codelineage.llm import pii, toxicity

COLUMNS = "doc_id long, text string, lang string, source string, n_chars int, score string, rest int, kept string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "own", 1, "own") for i, t in rows], COLUMNS)


def ordered(rows):
    return sorted(rows, key=str)


def values(df):
    return sorted(((str(r["doc_id"]), r["text"]) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows = toxic_rows(random.Random(20), 900)
    path = str(tmp_path_factory.mktemp("sf"))
    near = [(100000 + i, t) for i, t in near_copy_rows(21)]
    frame(spark, [(i, t) for i, t, _ in rows] + AWKWARD + near).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_keep_the_columns_and_names():
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_copies", "substring_dedup", "personal_data", "packing"]
    assert P.ORACLE_SQL is None


def test_toxic_documents_go(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = P.drop_toxic(spark, docs, folder)
    assert out.dtypes == docs.dtypes
    model = toxicity.learn(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    plain = docs.select("doc_id", "text").toArrow()
    scores = model.score(plain.column("text").combine_chunks())
    want = ordered((str(i), t) for i, t, s in zip(plain.column("doc_id").to_pylist(), plain.column("text").to_pylist(), scores) if s < P.TOXIC)
    assert values(out) == want and 0 < len(want) < docs.count()


def test_one_of_each_group_stays(spark):
    rows = near_copy_rows(22) + [r for r in AWKWARD if r[0] is not None] + [(None, "no id"), (None, "no id"), (500000, "twice here"), (500000, "twice here")]
    docs = frame(spark, rows)
    out = P.drop_near_copies(spark, docs, "")
    assert out.dtypes == docs.dtypes
    keep = {i for i, _, c in classes(rows, 5, 80) if i == c}
    want = ordered([(str(i), t) for i, t in {r for r in rows if r[0] is not None} if i in keep] + [("None", "no id")] * 2)
    assert values(out) == want


def test_repeats_are_cut_and_the_rest_is_left_alone(spark):
    rng = random.Random(23)
    shared = sentence(rng, 60, 5000)
    rows = [(1000 + i, f"{sentence(rng, 30, 5000)}\n {shared}  {sentence(rng, 9, 5000)}") for i in range(30)] + AWKWARD[:8]
    docs = frame(spark, rows)
    out = P.drop_repeats(spark, docs, "")
    assert out.dtypes == docs.dtypes
    plain = {str(i): (kept if gone else t) for (i, t), (_, _, gone, kept) in zip(rows, without_repeats(rows))}
    assert dict(values(out)) == plain
    assert all(r["n_chars"] == len(r["text"]) for r in out.where("text is not null").collect())


def test_personal_data_is_masked(spark):
    rng = random.Random(24)
    rows = [(i, f"{sentence(rng, 5)} mail u{i}@host{i}.org or +1 (212) 555-{1000 + i} {sentence(rng, 4)}") for i in range(60)] + AWKWARD
    docs = frame(spark, rows)
    out = P.mask_personal_data(spark, docs, "")
    assert out.dtypes == docs.dtypes
    tagger = pii.learn(docs)
    want = []
    for i, t in rows:
        (own, more), = pii.find([t or ""], tagger)
        want.append((str(i), pii.masked(t, own + more) if own or more else t))
    assert values(out) == ordered(want)


def test_whole_run_and_empty_run(spark, folder, tmp_path):
    out = P.run(spark, folder)
    assert out.columns == ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, folder)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    check_packing(rows, out.withColumn("row_key", F.lit(0)).where("doc_id is not null").unionByName(out.withColumn("row_key", F.lit(1)).where("doc_id is null")).collect())
    empty = str(tmp_path / "none")
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{empty}/labels.parquet")
    assert P.run(spark, empty).count() == 0
