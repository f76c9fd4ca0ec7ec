"""The stages of the pipeline on rows with null and repeated ids."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"
RNG = np.random.default_rng(6)
A, B, C, D = (" ".join(RNG.choice([f"w{i}" for i in range(400)], 60)) for _ in range(4))
NEAR = A.rsplit(" ", 1)[0] + " changed"
ROWS = [(None, A), (3, B), (3, B), (1, B), (None, C), (None, C), (7, D), (7, NEAR), (8, None), (9, ""), (10, "mail ann@example.com")]


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{k}", len(t or "")) for k, (i, t) in enumerate(rows)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    _docs(spark, ROWS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def _told(df):
    return collections.Counter((r.doc_id, r.text) for r in df.collect())


def test_toxicity_keeps_rows_apart(spark, folder):
    assert _told(cp.drop_toxic(spark, _docs(spark, ROWS), folder)) == collections.Counter(ROWS)


def test_exact_dedup_keeps_one_row_of_each_text(spark, folder):
    got = _told(cp.drop_copies(spark, _docs(spark, ROWS), folder))
    assert got == collections.Counter([(None, A), (3, B), (None, C), (7, D), (7, NEAR), (9, ""), (10, ROWS[-1][1])])


def test_near_duplicates_keep_one_row_of_each_class(spark, folder):
    rows = [(None, A), (3, B), (3, B), (None, C), (None, C), (7, D), (7, NEAR), (5, D + " more")]
    got = _told(cp.drop_near_copies(spark, _docs(spark, rows), folder))
    assert got == collections.Counter([(7, NEAR), (3, B), (None, C), (5, D + " more")])


def test_personal_data_and_packing(spark, folder):
    got = cp.redact(spark, _docs(spark, ROWS), folder).collect()
    assert len(got) == len(ROWS) and [(r.text, r.n_chars) for r in got if r.doc_id == 10] == [("mail <EMAIL>", 12)]
    assert [r.text for r in got if r.doc_id == 8] == [None]
    packed = cp.pack(spark, _docs(spark, ROWS), folder)
    assert packed.where(F.col("piece") == 0).count() == len(ROWS)


def test_run(spark, folder):
    assert cp.run(spark, folder).where("piece = 0").count() == 6  # NEAR (or A), B, C, D, the empty text, the mail


def _odd(spark, rows):
    """Columns whose names clash with those that stages use, or hold a point."""
    df = _docs(spark, rows)
    return df.select("*", F.col("source").alias("_row"), F.col("source").alias("a.b"), F.col("source").alias("_metadata"), F.col("source").alias("rest"), F.col("source").alias("score"), F.col("source").alias("base"), F.col("source").alias("_row0"))


STAGES = cp.STAGES[:-1]


@pytest.mark.parametrize("name,stage", STAGES)
@pytest.mark.parametrize("scan", [True, False])
def test_stages_keep_other_columns(spark, folder, tmp_path, name, stage, scan):
    df = _odd(spark, ROWS)
    if scan:
        df.write.parquet(f"{tmp_path}/odd")
        df = spark.read.parquet(f"{tmp_path}/odd")
    got = stage(spark, df, folder)
    assert got.columns == df.columns and got.schema["a.b"].dataType == df.schema["a.b"].dataType
    source = {r.source: r for r in df.collect()}
    rows = got.collect()
    assert rows and all(r["_row"] == r["a.b"] == r["_metadata"] == r["rest"] == r["score"] == r["base"] == r["_row0"] == r["source"] for r in rows)
    assert all(source[r.source].doc_id == r.doc_id for r in rows)
    assert stage(spark, df.where("false"), folder).count() == 0


@pytest.mark.parametrize("stage", [cp.drop_copies, cp.drop_near_copies])
def test_rows_of_one_place_in_a_file_are_told_apart(spark, folder, tmp_path, stage):
    """Exploded, joined or united rows share their file's places."""
    _docs(spark, [(1, A), (2, B), (3, A)]).write.parquet(f"{tmp_path}/in")
    docs = spark.read.parquet(f"{tmp_path}/in")
    twice = docs.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2))))
    assert sorted(r.text for r in stage(spark, twice, folder).collect()) == sorted([A, B])
    assert sorted(r.text for r in stage(spark, docs.union(docs), folder).collect()) == sorted([A, B])
    assert sorted(r.text for r in stage(spark, docs.join(spark.range(2).withColumnRenamed("id", "k"), F.lit(True)), folder).collect()) == sorted([A, B])
    assert cp._bare_scan(docs.where("doc_id > 0").select("doc_id")) and not cp._bare_scan(twice) and not cp._bare_scan(docs.union(docs))


def test_a_scan_is_keyed_by_its_places(spark, tmp_path):
    _docs(spark, [(1, A), (2, B)]).write.parquet(f"{tmp_path}/in")
    rows, name = cp._keyed(spark.read.parquet(f"{tmp_path}/in"))
    assert name == "_row" and set(rows.first()[name].asDict()) == {"file_path", "row_index"} and rows.select(name).distinct().count() == 2
