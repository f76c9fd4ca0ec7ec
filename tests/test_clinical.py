import itertools
import json

import duckdb
import pytest
from pyspark.sql import functions as F

from pneuma.functions import clinical, text
from pneuma.operators import boxes, metrics
from pneuma.plans import catalogue
from pneuma.sources import files
from pneuma.streaming import events
from tools.compare_sql import TABLES, canonical

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, con, name):
    mine, theirs = catalogue.QUERIES[name](spark, SF).toPandas(), con.execute(catalogue.ORACLES[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert canonical(mine) == canonical(theirs)


def test_pattern_boundaries(spark):
    grid = [None, -5.0, -4.0, -3.0, -2.5, -2.0, -1.64, -1.0, 0.0]
    rows = list(itertools.product(grid, repeat=3))

    def expected(f, e, r):
        at_least = lambda v, c: v is not None and v >= c
        under = lambda v, c: v is not None and v < c
        low = -1.64
        kinds = [
            ("Isolated", at_least(r, low) and at_least(f, low) and under(e, low)), ("Obstructive", under(r, low) and at_least(f, low)),
            ("Restrictive", at_least(r, low) and under(f, low)), ("Mixed", under(r, low) and under(f, low)),
        ]
        kind = next((k for k, ok in kinds if ok), "Normal")
        return kind, "normal" if kind == "Normal" else "mild" if at_least(e, -2.5) else "moderate" if at_least(e, -4.0) else "severe"

    df = spark.createDataFrame(rows, "f double, e double, r double")
    kind = clinical.pattern(F.col("f"), F.col("e"), F.col("r"))
    for row in df.select("f", "e", "r", kind.alias("k"), clinical.severity(kind, F.col("e")).alias("s")).collect():
        assert (row.k, row.s) == expected(row.f, row.e, row.r)


def test_cell_text(spark):
    cells = [("3 . 08", "3.08"), ("− 1.2", "-1.2"), ("a\n b", "a b"), (None, ""), ("“x”", '"x"'), ("12 %", "12%")]
    got = spark.createDataFrame(cells, "c string, want string").select(text.clean_cell(F.col("c")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)
    x = spark.createDataFrame([(0.125, "0.12"), (1234.5, "1234.50")], "v double, want string").select(text.fixed(F.col("v"), 2).alias("got"), "want").collect()
    assert all(r.got == r.want for r in x)


def test_suppression(spark):
    rows = [(1, 0, 0, 0, 100, 100), (1, 1, 5, 5, 100, 90), (1, 2, 300, 0, 50, 50), (1, 3, 310, 0, 40, 40), (2, 0, 0, 0, 1, 1)]
    got = boxes.suppress(spark.createDataFrame(rows, "case_no int, pos int, x int, y int, w int, h int")).collect()
    assert sorted((r.case_no, r["rank"], r.pos) for r in got) == [(1, 1, 0), (1, 2, 2), (2, 1, 0)]


def test_early_stop(spark):
    rows = [("a", i, v) for i, v in enumerate([3.0, 2.0, 2.5, 2.6, 2.7, 1.0])] + [("b", i, v) for i, v in enumerate([3.0, 2.0, 1.0])]
    got = {r.run: r.stop_epoch for r in metrics.early_stop(spark.createDataFrame(rows, "run string, epoch int, loss double"), 3, 0.1).collect()}
    assert got == {"a": 4, "b": None}


def test_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.PDF").write_bytes(b"x")
    (tmp_path / "in/b.txt").write_bytes(b"x")
    assert files.list_reports(spark, [str(tmp_path / "in")]).count() == 1
    (tmp_path / "bmi.csv").write_text("case_id,bmi\n a ,20\na,31.5\nb,\n")
    assert {r.case_id: r.bmi for r in files.read_lookup(spark, str(tmp_path / "bmi.csv")).collect()} == {"a": 31.5}
    (tmp_path / "labels.json").write_text(json.dumps({"i1": ["x", "y"], "i2": []}))
    assert files.read_labels(spark, str(tmp_path / "labels.json")).count() == 2
    (tmp_path / "grid.csv").write_text("﻿case_id,metric," + ",".join(files.COLUMNS) + "\nc1,FVC,3.1,,,,,,,,\n", encoding="utf-8")
    row = files.read_grid(spark, str(tmp_path / "grid.csv")).first()
    assert row.case_id == "c1" and row["PRE-BEST"] == "3.1" and row.LLN is None


def test_stream_first_seen(spark, tmp_path):
    data = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:01"), ("b", "2024-01-01 00:00:02")], "k string, t string").select("k", F.to_timestamp("t").alias("t"))
    data.write.parquet(str(tmp_path / "in"))
    stream = events.first_seen(spark.readStream.schema(data.schema).parquet(str(tmp_path / "in")), "k", "t", "1 hour")
    q = stream.writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("seen").count() == 2
