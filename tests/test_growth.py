"""What must not grow with the tables: broadcasts, shuffles of the same rows, rows of one task."""

import contextlib
import io

from pneuma.operators import geometry, layout
from pyspark.sql import functions as F


def _plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as told:
        df.explain()
    return told.getvalue()


def test_tables_that_grow_with_the_cases_are_not_broadcast(spark):
    cases = spark.range(4).select(F.col("id").alias("case_no"))
    pages = cases.selectExpr("case_no", "10D as body_y0", "20D as data_x0", "60D as split_x", "100D as w", "100D as h")
    rows = cases.selectExpr("case_no", "explode(sequence(0, 12)) as idx").selectExpr("case_no", "idx", "10D + idx as lo", "11D + idx as hi")
    columns = rows.selectExpr("case_no", "if(idx < 5, 'pre', 'post') as zone", "'LLN' as col", "idx", "lo", "hi")
    tokens = cases.selectExpr("case_no", "0 as pos", "11.5D as cx", "12D as cy", "'7' as text")
    heads = cases.selectExpr("case_no", "'POST-BEST' as col")
    for df in (layout.zone_cells(tokens, pages, rows, columns), layout.assign(tokens, rows), layout.token_parts(tokens, pages), layout.post_warning(tokens, pages, heads), geometry.cell_boxes(rows, columns, pages)):
        assert "Broadcast" not in _plan(df)


def test_cases_meet_numpy_by_batches(spark):
    df = spark.range(3000).selectExpr("id % 1000 as case_no", "double(id * 37 % 101) as x")
    plan = _plan(layout.k_medians(df, 2))
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
    rows = [(1, 1.0), (1, 2.0), (1, 9.0), (1, 10.0), (1, 11.0), (2, 4.0), (3, None), (4, 7.0), (4, 7.0), (4, 7.0)]
    found = layout.k_medians(spark.createDataFrame(rows, "case_no int, x double"), 2).orderBy("case_no", "idx").collect()
    assert [(r.case_no, r.idx, r.centre) for r in found] == [(1, 0, 2.0), (1, 1, 10.0), (2, 0, 4.0), (2, 1, 4.0), (4, 0, 7.0), (4, 1, 7.001)]


def test_tasks_grow_with_the_table_and_rows_move_once(spark, tmp_path):
    from pneuma.operators import classify
    from pneuma.plans import catalogue, grid
    from pneuma.sources.tables import dealt, table

    small = "/root/testdata/sf0.001"
    one = spark.read.parquet(f"{small}/lineitem.parquet")
    assert dealt(one, "l_orderkey").rdd.getNumPartitions() == 24
    one.repartition(3).write.parquet(f"{tmp_path}/lineitem.parquet")
    splits = table(spark, str(tmp_path), "lineitem").rdd.getNumPartitions()
    assert dealt(table(spark, str(tmp_path), "lineitem"), "l_orderkey").rdd.getNumPartitions() == 24 * splits
    for df in (catalogue.QUERIES["fitted_rows"](spark, small), catalogue.QUERIES["column_centres"](spark, small), classify.pivot_cases(grid.grid(spark, small))):
        assert _plan(df).count("Exchange ") == 1


def test_cases_are_pivoted_without_a_sort_and_dealt_without_holding_a_split(spark):
    from pneuma.operators import classify
    from pneuma.plans import grid
    from pneuma.sources.tables import dealt

    small = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    assert [dealt(small, "l_orderkey", each=each, least=least).rdd.getNumPartitions() for each, least in ((24, 6), (300, 6), (300, 250))] == [24, 200, 250]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        assert 24 * spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").rdd.getNumPartitions() > 200
        plan = _plan(grid.QUERIES["pivot_cases"](spark, "/root/testdata/sf0.001"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert "Sort" not in plan and ", 200), REPARTITION_BY_NUM" in plan and plan.count("Exchange ") == 1
    nan = float("nan")
    rows = [(1, "FVC", 2, 1.0, 2.0, 3.0), (1, "FVC", 1, None, nan, -0.5), (1, "VC", 0, 9.0, 9.0, 9.0), (2, "VC", 1, 9.0, 9.0, 9.0), (3, "FEV1", None, 9.0, 9.0, 9.0)]
    df = spark.createDataFrame(rows, "case_no long, metric string, pos int, pre_z double, post_z double, pct_chg double")
    for kind in ("double", "string"):  # in a text column a null is blank too
        cells = df.select("case_no", "metric", "pos", *[F.col(c).cast(kind) for c in ("pre_z", "post_z", "pct_chg")])
        got = {r.case_no: r.asDict() for r in classify.pivot_cases(cells).collect()}
        told = {k: v for k, v in got[1].items() if "fvc" in k}
        assert told == {"pre_fvc": None, "pre_fvc_missing": False, "post_fvc": None, "post_fvc_missing": False, "chg_fvc": -0.5, "chg_fvc_missing": False}
        assert all(v is (True if k.endswith("missing") else None) for n in (2, 3) for k, v in got[n].items() if k != "case_no")


def test_orders_meet_customers_without_a_broadcast_in_tasks_that_grow_with_the_orders(spark, tmp_path):
    from pneuma.plans import grid

    small = "/root/testdata/sf0.001"
    for t in ("lineitem", "customer"):
        spark.read.parquet(f"{small}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    orders = spark.read.parquet(f"{small}/orders.parquet")
    # One order of a customer without a balance above 0, one of no customer, and one twice: each stays a row of its case.
    (spared,) = spark.read.parquet(f"{small}/customer.parquet").where("c_acctbal <= 0").select("c_custkey").first()
    odd = orders.withColumn("o_custkey", F.when(F.col("o_orderkey") == 0, spared).when(F.col("o_orderkey") != 1, F.col("o_custkey")))
    odd.union(odd.where("o_orderkey = 2")).repartition(3).write.parquet(f"{tmp_path}/orders.parquet")
    dealt, df = 24 * spark.read.parquet(f"{tmp_path}/orders.parquet").rdd.getNumPartitions(), grid.QUERIES["classify_cases"](spark, str(tmp_path))
    plan = _plan(df)
    assert "SortMergeJoin [o_custkey" in plan and dealt > 24 and f", {dealt}), REPARTITION_BY_NUM" in plan
    told = lambda df: {(r.case_no, r.bmi_used) for r in df.select("case_no", "bmi_used").collect()}
    cases = spark.read.parquet(f"{small}/lineitem.parquet").select(F.col("l_orderkey").alias("case_no")).distinct()
    funds = spark.read.parquet(f"{small}/customer.parquet").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_acctbal") / 250).alias("bmi_used"))
    asked = cases.join(spark.read.parquet(f"{tmp_path}/orders.parquet").join(funds, "o_custkey").select(F.col("o_orderkey").alias("case_no"), "bmi_used"), "case_no", "left")
    assert told(df) == told(asked) and df.count() == asked.count()


def test_readings_beside_their_row_are_ranked_where_they_lie(spark):
    from pneuma.functions.cells import COLUMNS
    from pneuma.operators import candidates
    from pneuma.plans import grid

    assert _plan(grid.QUERIES["ranked_candidates"](spark, "/root/testdata/sf0.001")).count("Exchange ") == 1
    held = {"pre_best": "3.00", "pred": "4.00", "lln": "3.20", "pre_pct": "75.0"}
    rows = spark.createDataFrame([(1, "FVC", *[held.get(c, "") for c in COLUMNS]), (2, "MVV", *[""] * len(COLUMNS))], "case_no int, metric string, " + ", ".join(f"{c} string" for c in COLUMNS))
    texts = {"Pre_Z-Score": ["1.90", "-1.90", "-1.90", None], "LLN": ["x", "", None, "y"], "Pred": ["4.00", "400", "40", "4"]}
    cells = F.array(*[F.struct(F.lit(c).alias("col"), F.array(*[F.struct(F.lit(k).alias("cand_pos"), F.lit(t).cast("string").alias("text")) for k, t in enumerate(ts)]).alias("readings")) for c, ts in texts.items()])
    long = rows.select("case_no", "metric", F.inline(cells).alias("col", "readings")).select("case_no", "metric", "col", F.inline("readings").alias("cand_pos", "text"))
    told = lambda df: {(r.case_no, r.col): (r.text, r.ok) for r in df.collect()}
    found = told(candidates.rank_beside(rows, cells))
    assert found == told(candidates.rank_candidates(long, rows))
    assert found == {(1, "Pre_Z-Score"): ("-1.90", True), (1, "LLN"): ("x", False), (1, "Pred"): ("4.00", True), (2, "Pre_Z-Score"): ("1.90", True), (2, "LLN"): ("x", True), (2, "Pred"): ("4.00", True)}


def test_repair_of_whole_cases_needs_no_window_and_gives_what_the_rules_by_rows_give(spark):
    from pneuma.functions.cells import COLUMNS
    from pneuma.operators import repair, repair_cases
    from pneuma.plans import grid

    small = "/root/testdata/sf0.001"
    for name in ("repair_rows_strict", "quality_of_cases"):
        plan = _plan(grid.QUERIES[name](spark, small))
        assert "Window" not in plan and plan.count("Exchange ") == 1, name
    rows = grid.grid(spark, small).where("case_no % 40 < 3").selectExpr("case_no", "if(pos = 9 and case_no % 2 = 0, 'FVC', metric) as metric", *[f"if(case_no % 3 = 0 and hash(case_no, pos, '{c}') % 4 = 0, null, {c}) as {c}" for c in COLUMNS])
    odd = spark.createDataFrame([
        (-1, "FEV1/FVC", "3.08 2.10", "4 5 6"), (-1, "Grade FVC N", "A 10.53", "C9"), (-1, "Grade FEV1 N", "b 7", "x 8 A"), (-1, "MVV", "3", "4"), (-2, "VC", "4.5", "+5"), (-2, "FEV1", "3", "-3"), (-3, "no row", "1", "2"), (-4, None, "1", "2"),
    ], "case_no long, metric string, pre_best string, post_best string").select("case_no", "metric", *[F.col(c) if c in ("pre_best", "post_best") else F.lit(None).cast("string").alias(c) for c in COLUMNS])
    rows = rows.unionByName(odd).coalesce(1).repartition(1, "case_no").cache()
    told = lambda df: sorted(map(str, df.withColumn("warnings", F.col("warnings.message")).collect()))
    by_rows = repair.repair(repair.complete(rows), strict=True).cache()
    assert told(repair_cases.rows(rows, strict=True)) == told(by_rows) and by_rows.where("size(warnings) > 1").count() > 20
    assert sorted(map(str, repair_cases.quality(rows, strict=True).collect())) == sorted(map(str, repair.quality(by_rows).collect()))


def test_readings_in_columns_are_ranked_by_the_batch_as_readings_in_rows_are(spark):
    import random

    from pneuma.functions.cells import COLUMNS, HEADINGS, ROWS
    from pneuma.operators import candidates
    from pneuma.plans import grid

    plan = _plan(grid.QUERIES["ranked_candidates"](spark, "/root/testdata/sf0.001"))
    assert "MapInArrow" in plan and plan.count("Exchange ") == 1 and "array_min" not in plan
    texts = [
        None, "", " ", "1.90", "-1.90", "+1.9", "190", "-060", "1 60", "-0 49", "x 1,5 y 2.25", "1.2.3", "--5", "1e5", "12.", ".20", "-0.00", "0.00", "000", "0", "-0", "9999.994", "9999.996", "0.005", "1.005", "2.675", "00.10",
        " 3.4 ", " ? ", "n/a", "5 7 9", "150.4", "19.5", "20.5", "21,5", "80 7 140", "9" * 400, "A 10.5", "b", "x 8 A", "É A", "3.08 2.10", "+", "٣.٤", "1\n", "\x1c?", "4.00", "3.20", "-3.28", "328", "0.34", "1e-1",
    ]
    pick, least = random.Random(4), ["4.00", "3.20", "3.00", "75.0"]
    rows = [(k, m, *[pick.choice(least if k % 3 else texts) for _ in COLUMNS], *[pick.choice(texts) for _ in range(3)]) for k in range(150) for m in [*ROWS, "no row"]]
    df = spark.createDataFrame(rows, "case_no int, metric string, " + ", ".join(f"{c} string" for c in [*COLUMNS, "x", "y", "z"])).repartition(3).cache()
    readings = {HEADINGS[c]: [*pick.sample(["x", "y", "z", c], 3), c] for c in COLUMNS} | {"Pred": ["pred"]}
    each = F.array(*[F.struct(F.lit(h).alias("col"), F.lit(k).alias("cand_pos"), F.col(c).alias("text")) for h, cs in readings.items() for k, c in enumerate(cs)])
    told = lambda df: {(r.case_no, r.metric, r.col): (r.text, r.ok) for r in df.collect()}
    found = told(candidates.rank_columns(df, readings))
    assert found == told(candidates.rank_candidates(df.select("case_no", "metric", F.inline(each)), df)) and len(found) == len(rows) * len(readings)
    assert {ok for _, ok in found.values()} == {True, False} and len({t for t, _ in found.values()}) > 60
