"""Hand-made rows for each rule of the grid, after the rules themselves and not after the code."""

import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pneuma.functions import cells, clinical, colour, small
from pneuma.operators import batch, boxes, candidates, classify, geometry, labels, layout, metrics, repair, reports
from pneuma.sources import files
from pneuma.streaming import events

COLUMNS = cells.COLUMNS


def _grid(spark, rows):
    """rows: (case, metric, {column: text})."""
    return spark.createDataFrame([(k, m, *[v.get(c) for c in COLUMNS]) for k, m, v in rows], "case_no long, metric string, " + ", ".join(f"{c} string" for c in COLUMNS))


def _repaired(spark, rows, strict=False):
    done = repair.repair(repair.complete(_grid(spark, rows)), strict).collect()
    return {(r.case_no, r.metric): r for r in done}


@pytest.mark.parametrize("raw,metric,column,want", [
    ("308", "FVC", "pre_best", "3.08"), ("49", "FVC", "pre_z", "0.49"), ("-0 49", "FVC", "pre_z", "0.49"), ("FEF25-75%1.89", "FEF25%-75%", "pre_best", "1.89"), ("1 21", "FVC", "pre_best", "0.21"),
    ("$", "FVC", "pre_best", None), ("", "FVC", "pre_best", None), ("3,5", "PEF", "lln", "3.50"), ("75.5", "FEV1/FVC", "pred", "76"), ("80 9", "FEV1/FVC", "pre_best", "80"), ("1205", "FVC", "pre_pct", "120.5"),
    ("b", "Grade FVC N", "pre_best", "B"), ("3.1", "MVV", "pre_best", None), ("2.5", "FVC", "post_best", "2.50"), ("7", "FEV1/VC", "post_best", None),
])
def test_cells_in_normal_form(spark, raw, metric, column, want):
    df = spark.createDataFrame([(raw, metric)], "raw string, metric string")
    got = df.select(cells.normalise(F.col("raw"), cells.cell_spec("metric", column))).first()[0]
    assert got == want


def test_numbers_in_noise(spark):
    want = {"-0 49": -0.49, "1 21": 1.21, " 3,5 L": 3.5, "x": None, "": None, None: None, "1e2": 100.0, "A 10.53": 10.53}
    got = spark.createDataFrame([(k,) for k in want], "t string").select("t", cells.num(F.col("t")).alias("v")).collect()
    assert {r.t: r.v for r in got} == want


def test_restricted_rows_stay_blank(spark):
    full = {c: "2.0" for c in COLUMNS}
    got = _repaired(spark, [(1, m, full) for m in cells.ROWS])
    for m in cells.RESTRICTED:
        assert all(got[1, m][c] == "" for c in COLUMNS if c not in cells.BESTS), m
    assert all(got[1, "MVV"][c] == "" for c in COLUMNS)
    assert got[1, "VC"].pre_best == "2.0" and len(got) == 13


def test_rules_before_and_after(spark):
    got = _repaired(spark, [
        (1, "PEF", {"pred": "3.93", "lln": "10.90"}),
        (2, "FVC", {"pre_best": "3.00", "pct_chg": "10", "post_best": "0.33", "pred": "4.00"}),
        (3, "FVC", {"pre_best": "3.00", "post_best": "3.30", "pred": "4.00", "pre_z": "1.50", "post_z": "1.50", "pre_pct": "50", "pct_chg": "44.0"}),
        (4, "FVC", {"pre_best": "9.00", "pred": "3.00", "pre_pct": "90"}),
        (5, "FET", {"pre_best": "5", "post_best": "6", "pct_chg": "20.0"}),
    ])
    assert got[1, "PEF"].lln == "1.09" and "PEF LLN scaled from 10.9 to 1.09" in got[1, "PEF"].warnings[0].message
    assert got[2, "FVC"].post_best == "3.30" and got[2, "FVC"].post_pct == "82.5"
    r = got[3, "FVC"]
    assert (r.pre_z, r.post_z, r.pre_pct, r.post_pct, r.pct_chg) == ("-1.50", "-1.50", "75.0", "82.5", "10.0")
    assert [w.message for w in r.warnings] == [
        "%Pred fix: FVC Pre_%Pred replaced 50.0->75.0", "%CHG fix: FVC %CHG replaced 44.0->10.0 from BEST values",
        "Z-sign fix: FVC Pre_Z-Score flipped to negative (best<pred)", "Z-sign fix: FVC Post_Z-Score flipped to negative (best<pred)",
    ]
    assert got[4, "FVC"].pre_pct == "300.0" and got[4, "FVC"].pre_best == "9.00"  # %Pred follows BEST first
    assert got[5, "FET"].pct_chg == "" and got[5, "FET"].pre_best == "5"


def test_rules_over_several_rows(spark):
    got = _repaired(spark, [
        (1, "Grade FVC N", {"pre_best": "A 10.53", "post_best": "C9"}), (1, "Grade FEV1 N", {"pre_best": "b 7"}),
        (2, "FEV1/FVC", {"pre_best": "3.08 2.10"}),
        (3, "FVC", {"pre_best": "4.00"}), (3, "FEV1", {"pre_best": "3.00"}), (3, "FEV1/FVC", {"pre_best": "7"}), (3, "VC", {"pre_best": "4.50"}),
        (4, "FVC", {"pre_best": "4.00"}), (4, "FEV1", {"pre_best": "3.00"}), (4, "FEV1/FVC", {"pre_best": "70"}),
    ])
    assert got[1, "Grade FVC N"].pre_best == "A" and got[1, "Grade FEV1 N"].pre_best == "B" and got[1, "FET"].pre_best == "10.53"
    assert got[1, "FET"].post_best == "9.00" and got[1, "Grade FVC N"].post_best == "C9"
    assert (got[2, "FVC"].pre_best, got[2, "FEV1"].pre_best, got[2, "FEV1/FVC"].pre_best) == ("3.08", "2.10", "68")
    assert got[3, "FEV1/FVC"].pre_best == "75" and got[3, "FEV1/VC"].pre_best == "66.67"
    assert got[4, "FEV1/FVC"].pre_best == "70"  # off by less than 8


def test_strict_blanks_contradictions_of_sound_rows(spark):
    rows = [
        (1, "FVC", {"pre_best": "2.00", "pred": "4.00", "lln": "3.00", "pre_z": "-0.50", "post_best": "4.50", "post_z": "0.00"}),
        (2, "FVC", {"pre_best": "2.00", "pred": "4.00", "lln": "0.50", "pre_z": "-0.50"}),
    ]
    loose, strict = _repaired(spark, rows), _repaired(spark, rows, strict=True)
    assert loose[1, "FVC"].pre_z == "-0.50" and strict[1, "FVC"].pre_z == "" and strict[1, "FVC"].post_z == "0.00"
    assert strict[2, "FVC"].pre_z == "-0.50"  # LLN under 0.15 of Pred: not trusted
    assert strict[1, "FVC"].warnings[-1].message == "STRICT: FVC Pre_Z-Score violates BEST<LLN (best=2.00, lln=3.00, z=-0.50); blanked"


def test_single_rules_and_quality(spark):
    one = repair.flip_sign(_grid(spark, [(1, "FVC", {"pre_best": "1.0", "pred": "2.0", "pre_z": "1.0"})])).first()
    assert one.pre_z == "-1.00" and len(one.warnings) == 1
    two = repair.derive_ratios(_grid(spark, [(1, "FVC", {"pre_best": "2"}), (1, "FEV1", {"pre_best": "1"}), (1, "FEV1/FVC", {})])).where("metric = 'FEV1/FVC'").first()
    assert two.pre_best == "50"
    told = repair.quality(repair.repair(repair.complete(_grid(spark, [(1, "FVC", {"pre_best": "2"}), (2, "FVC", {})])))).orderBy("case_no").collect()
    assert [(r.rows_found, r.warnings) for r in told] == [(1, []), (0, [])]
    assert repair.repair(repair.complete(_grid(spark, []))).count() == 0


def test_warnings_finish_one_side_before_the_next(spark):
    off = {"pre_best": "3.00", "post_best": "3.00", "pred": "4.00", "pre_z": "1.50", "post_z": "1.50", "pre_pct": "75.0", "post_pct": "75.0", "pct_chg": "0.0"}
    rows = [(1, "FVC", off), (1, "FEV1", off | {"pre_best": "2.00", "post_best": "2.00", "pre_pct": "50.0", "post_pct": "50.0"}), (1, "FEV1/FVC", {}), (1, "VC", {"pre_best": "4.00"}), (1, "Grade FVC N", {"post_best": "A 3"}), (1, "Grade FEV1 N", {"pre_best": "B 4"})]
    told = repair.quality(repair.repair(repair.complete(_grid(spark, rows)))).first().warnings
    assert told == [
        "Grade splitter: moved 3 from Grade FVC N/POST-BEST to FET/POST-BEST", "Grade splitter: moved 4 from Grade FEV1 N/PRE-BEST to FET/PRE-BEST",
        "Derived PRE-BEST FEV1/FVC=67", "Derived PRE-BEST FEV1/VC=50.00", "Derived POST-BEST FEV1/FVC=67",
        "Z-sign fix: FVC Pre_Z-Score flipped to negative (best<pred)", "Z-sign fix: FEV1 Pre_Z-Score flipped to negative (best<pred)",
        "Z-sign fix: FVC Post_Z-Score flipped to negative (best<pred)", "Z-sign fix: FEV1 Post_Z-Score flipped to negative (best<pred)",
    ]


def test_cells_that_are_never_read_are_not_suspicious(spark):
    rows = _grid(spark, [(1, "VC", {}), (1, "FVC", {}), (2, "FVC", {}), (1, "MVV", {})]).withColumn("post", F.col("case_no") == 1)
    flags = lambda df: {(r.case_no, r.metric): [c for c in COLUMNS if r[f"re_{c}"]] for r in df.collect()}
    before = ["pre_best", "lln", "pred", "pre_pct", "pre_z"]
    want = {(1, "VC"): ["pre_best", "post_best"], (1, "FVC"): COLUMNS, (2, "FVC"): before, (1, "MVV"): COLUMNS}
    assert flags(repair.suspicious(rows, post="post")) == want == flags(repair.suspicious(rows, "force", post="post"))
    assert flags(repair.suspicious(rows))[2, "FVC"] == COLUMNS


def test_classification_tells_missing_values_apart(spark):
    z = lambda k, m, pre, post, chg: (k, m, 1, pre, post, chg)
    rows = [
        *[z(1, m, "-2", "", "n/a") for m in ("FVC", "FEV1", "FEV1/FVC")],  # blank: present, nothing is low
        *[z(2, m, "x 1", "y", "11") for m in ("FVC", "FEV1", "FEV1/FVC")],  # texts that are no numbers: missing
        z(3, "FVC", "-2", "-2", "10"), z(3, "FEV1", "-3", "-3", "nan"),  # a row is absent
        *[z(4, m, "NaN", "-2", "NaN") for m in ("FVC", "FEV1", "FEV1/FVC")],
    ]
    df = spark.createDataFrame(rows, "case_no long, metric string, pos int, pre_z string, post_z string, pct_chg string")
    got = {r.case_no: r for r in classify.classify(classify.pivot_cases(df), None).collect()}
    pre, post = "Missing pre Z-scores for FVC/FEV1/FEV1-FVC.", "Partial post Z-scores present; classification may be unreliable."
    assert (got[1].pre_pattern, got[1].post_pattern, got[1].warnings) == ("Mixed", "Normal", [])
    assert (got[2].pre_pattern, got[2].post_pattern, got[2].warnings) == ("Unknown", "N/A", [pre])
    assert (got[3].pre_pattern, got[3].post_pattern, got[3].warnings) == ("Unknown", "Unknown", [pre, post])
    assert (got[4].pre_pattern, got[4].post_pattern) == ("Normal", "Mixed")
    assert "no significant" in got[4].bronchodilator_response and "is Significant" in got[2].bronchodilator_response and "no significant" in got[3].bronchodilator_response


def test_candidates(spark):
    g = _grid(spark, [(1, "FVC", {"pre_best": "2.00", "pred": "4.00", "lln": "3.00"})])
    reads = spark.createDataFrame([(1, "FVC", "Pre_Z-Score", i, t) for i, t in enumerate(["3.28", "-3.28", "328", "-3.28"])] + [(1, "MVV", "Pred", 0, " x "), (1, "FVC", "Pred", 0, "?"), (9, "FVC", "LLN", 0, "3.0")], "case_no long, metric string, col string, cand_pos int, text string")
    got = {(r.case_no, r.metric, r.col): (r.text, r.ok) for r in candidates.rank_candidates(reads, g).collect()}
    assert got == {(1, "FVC", "Pre_Z-Score"): ("-3.28", True), (1, "MVV", "Pred"): ("x", True), (1, "FVC", "Pred"): ("?", False), (9, "FVC", "LLN"): ("3.00", True)}


def test_z_target_needs_a_percentage_to_fall_back_on(spark):
    rows = [(2.0, 4.0, 3.0, 50.0), (2.0, 4.0, None, 40.0), (2.0, 4.0, None, None), (4.0, 4.0, None, 90.0), (5.0, 4.0, None, 400.0)]
    df = spark.createDataFrame(rows, "b double, y double, l double, p double")
    got = [r.z for r in df.select(clinical.z_target(F.col("b"), F.col("y"), F.col("l"), F.col("p")).alias("z")).collect()]
    assert got == [pytest.approx(-3.28), -4.0, None, None, 6.0]


def test_k_medians(spark):
    rows = [(1, 0.0), (1, 10.0), (2, 5.0), (3, None), (4, 1.0), (4, 1.0005), (4, 1.0), (4, 9.0), (4, 9.0)]
    df = spark.createDataFrame(rows, "case_no long, x double")
    got = {}
    for r in layout.k_medians(df, 5).orderBy("idx").collect():
        got.setdefault(r.case_no, []).append(r.centre)
    assert got[1] == [0.0, 2.5, 5.0, 7.5, 10.0] and got[2] == [5.0] * 5 and 3 not in got
    assert got[4] == pytest.approx([1.0, 1.001, 1.002, 9.0, 9.001])


def _plain_medians(xs, k):
    xs = sorted(xs)
    centres = [xs[round(i / (k - 1) * (len(xs) - 1))] for i in range(k)]
    for _ in range(50):
        groups = [[] for _ in range(k)]
        for v in xs:
            groups[min(range(k), key=lambda i: abs(v - centres[i]))].append(v)
        new = [sorted(b)[len(b) // 2] if b else centres[i] for i, b in enumerate(groups)]
        done = all(abs(a - b) < 1e-3 for a, b in zip(new, centres, strict=True))
        centres = new
        if done:
            break
    centres.sort()
    for i in range(1, k):
        if centres[i] <= centres[i - 1]:
            centres[i] = centres[i - 1] + 1e-3
    return centres


def test_k_medians_against_plain_python(spark):
    rng = np.random.default_rng(3)
    cases = {c: [float(x) for x in rng.choice([10, 50, 90], n) + rng.normal(0, 4, n).round(1)] for c, n in enumerate((4, 7, 30, 61))}
    df = spark.createDataFrame([(c, x) for c, xs in cases.items() for x in xs], "case_no long, x double")
    got = {}
    for r in layout.k_medians(df, 4).orderBy("idx").collect():
        got.setdefault(r.case_no, []).append(r.centre)
    assert {c: pytest.approx(_plain_medians(xs, 4)) for c, xs in cases.items()} == got


def test_zones(spark):
    tokens = spark.createDataFrame([(1, "7" if i < 10 else "x", 20.0 + i, 50.0) for i in range(14)] + [(2, "y", 30.0, 50.0)], "case_no long, text string, cx double, cy double")
    zones = spark.createDataFrame([(1, 0.0, 100.0, 40.0), (2, 0.0, 100.0, 40.0), (3, 0.0, 100.0, 40.0)], "case_no long, x0 double, x1 double, body_y0 double")
    values = geometry.zone_values(tokens, zones)
    assert sorted((r.case_no, r.x) for r in values.collect()) == [(1, 20.0 + i) for i in range(10)] + [(2, 30.0)]
    found = geometry.even_centres(zones, layout.k_medians(values, 2), 2)
    assert sorted((r.case_no, r.centre) for r in found.where("case_no = 3").collect()) == [(3, 25.0), (3, 75.0)]


def test_unique_names_pass_given_ones(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a_1", 3), ("a", 4), ("a_1", 5), (None, 6), (None, 7)], "base string, seq int")
    got = {r.seq: r.name for r in batch.unique_names(df, "base", "seq").collect()}
    assert got == {1: "a", 2: "a_2", 3: "a_1", 4: "a_3", 5: "a_1_1", 6: None, 7: None}
    hot = spark.range(5000).select(F.lit("s").alias("base"), F.col("id").alias("seq"))
    assert {r.name for r in batch.unique_names(hot, "base", "seq").collect()} == {"s", *(f"s_{i}" for i in range(1, 5000))}


def test_first_wins_and_fit_from_right(spark):
    df = spark.createDataFrame([("a", 2, "y", 4.0), ("a", 1, "x", 4.0), ("b", 3, "z", 99.0), ("a", 3, "w", 3.0)], "k string, seq int, v string, w double")
    assert {(r.k, r.v) for r in batch.first_wins(df, "k", "seq").collect()} == {("a", "x"), ("b", "z")}
    assert {(r.k, r.v) for r in batch.fit_from_right(df, 8.0, "k", "seq", "w").collect()} == {("a", "w"), ("a", "y"), ("b", "z")}


def test_splits_early_stop_and_suppression(spark):
    rows = spark.range(3000).select("id", metrics.split_of(F.col("id")).alias("s")).collect()
    share = lambda i: zlib.crc32(str(i).encode()) % 100_000 / 100_000
    assert all(r.s == ("test" if share(r.id) < 0.1 else "val" if share(r.id) < 0.1 + 0.9 * 0.11 else "train") for r in rows)
    rng = np.random.default_rng(4)
    courses = {k: [float(x) for x in rng.integers(0, 6, 12) / 2] for k in range(30)}
    df = spark.createDataFrame([(k, e, x) for k, xs in courses.items() for e, x in enumerate(xs)], "run long, epoch long, loss double")
    for r in metrics.early_stop(df, 3, 0.5).collect():
        least, bad, stop = math.inf, 0, None
        for e, x in enumerate(courses[r.run]):
            if x < least:
                least, bad = x, 0
            elif x > least + 0.5:
                bad += 1
                if bad >= 3:
                    stop = e
                    break
        assert r.stop_epoch == stop
    found = [(c, p, *[int(v) for v in rng.integers(0, 60, 2)], *[int(v) for v in rng.integers(10, 50, 2)]) for c in range(20) for p in range(8)]
    got = {}
    for r in boxes.suppress(spark.createDataFrame(found, "case_no long, pos long, x long, y long, w long, h long")).orderBy("case_no", "rank").collect():
        got.setdefault(r.case_no, []).append(r.pos)
    for c in range(20):
        kept = []
        for b in sorted((b for b in found if b[0] == c), key=lambda b: (-b[4] * b[5], b[1])):
            over = lambda k: max(0, min(k[2] + k[4], b[2] + b[4]) - max(k[2], b[2])) * max(0, min(k[3] + k[5], b[3] + b[5]) - max(k[3], b[3]))  # noqa: B023, E731
            if len(kept) < 4 and all(over(k) / (k[4] * k[5] + b[4] * b[5] - over(k)) < 0.15 for k in kept):
                kept.append(b)
        assert got[c] == [b[1] for b in kept]


def test_small_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("v")).first()["v"]
    lit = F.lit
    assert get(small.slider_value(lit(150), 5, 50, 300)) == 27 and get(small.slider_place(lit(9), 9, 9, 10)) == 0
    assert get(small.progress_text("%p%", lit(0), 5, 5)) == "100%"
    for k in ("none", "constant", "linear", "quadratic", "cosine"):
        steps = [get(small.scroll_step(lit(120.0), lit(n), 1000, k)) for n in (1, 500, 1000)]
        assert k == "none" and steps == [0.0] * 3 or steps[1] >= steps[0] >= 0 and steps[1] >= steps[2] >= 0
    assert get(small.scroll_step(lit(120.0), lit(30), 60, "linear")) == 4.0 and get(small.scroll_step(lit(120.0), lit(60), 60, "cosine")) == 0.0
    assert get(small.valid_date(lit(2023), lit(2), lit(29))) is None and str(get(small.valid_date(lit(2024), lit(2), lit(29)))) == "2024-02-29"
    ab = F.array(lit("a"), lit("b"))
    assert get(small.repeated(ab, 2)) == ["a", "b", "a", "b"] and get(small.padded(ab, 1)) == ["", "a", "b", ""]
    assert get(small.first_place(ab, lit("b"))) == 1 and get(small.first_place(ab, lit("z"))) == -1 and get(small.kept_to(ab, lit(0))) == ["a"]
    m = lambda *kv: F.create_map(*[lit(x) for x in kv])
    assert get(small.merged_settings(m("a", "1"), m("a", "0", "b", "2"))) == {"a": "1", "b": "2"}
    assert get(small.without_prefix(m("module.x", "1", "y", "2"), "module.")) == {"x": "1", "y": "2"}
    assert get(small.existing(ab, F.array(lit("b")))) == ["b"] and get(small.month_page(lit("2024-03-05").cast("date"), 2023)) == 14
    assert [get(small.hour24(lit(h), lit(x))) for h, x in ((12, "AM"), (12, "PM"), (1, "PM"))] == [0, 12, 13]
    assert get(clinical.overall_label(lit(True), lit(None).cast("boolean"))) == "Expiratory truncation"


def test_reports_and_overrides(spark, tmp_path):
    words = spark.createDataFrame([("bee", 1), ("Bee", 2), ("beach", 3), ("be-1", 4), ("a", 5)], "word string, seq int")
    assert [r.word for r in reports.prefix_search(words, "BE").collect()] == ["Bee", "beach"]
    rows = spark.createDataFrame([("Failed", 1, True), ("Completed", 2, True), ("Completed", 3, None)], "status string, seq int, checked boolean")
    assert [r.seq for r in reports.completed_first(rows).collect()] == [2, 3, 1] and [r.seq for r in reports.chosen(rows).collect()] == [2]
    paths = spark.createDataFrame([("/x/build/predicted_reports/a.pdf",), ("/x/b.pdf",)], "path string")
    valid, left = reports.keep_valid(paths, paths.withColumn("status", F.lit("q")))
    assert [r.path for r in valid.collect()] == ["/x/b.pdf"] == [r.path for r in left.collect()]
    (tmp_path / "o.json").write_text('{"global": {"dx": 0.1}, "per_file": {"a.pdf": {"rel_left": 0.5}}}')
    general, own = files.read_overrides(spark, str(tmp_path / "o.json"))
    base = spark.createDataFrame([("a.pdf", 0.1, 0.2, 0.6, 0.4), ("b.pdf", 0.1, 0.2, 0.6, 0.4)], "file string, rel_left double, rel_top double, rel_right double, rel_bottom double")
    got = {r.file: (round(r.rel_left, 6), round(r.rel_right, 6)) for r in geometry.override_rect(base, general, own).collect()}
    assert got == {"a.pdf": (0.6, 0.7), "b.pdf": (0.2, 0.7)}
    bad = geometry.crop_band(geometry.override_rect(base, None, None).withColumns({"w": F.lit(1), "h": F.lit(1)})).first()
    assert bad.band is None and re.match("Invalid band", bad.error)
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "b.json").write_text('{"x": 2}')
    (tmp_path / "docs" / "a.json").write_text('{"x": 1}')
    assert [r.x for r in files.read_first(spark, str(tmp_path / "docs"), "x int").collect()] == [1]
    with pytest.raises(FileNotFoundError):
        files.list_reports(spark, [str(tmp_path / "docs")])


def test_label_matching_without_aliases(spark):
    import difflib

    df = spark.createDataFrame([("Gr#de FVC N",), ("FEV1",), ("zzzz",), (None,)], "label string")
    got = {r.label: r.name for r in labels.match_labels(df, files.METRICS).collect()}
    plain = lambda x: re.sub("[^a-z0-9%/]+", "", x.lower())

    def best(t):
        scores = [difflib.SequenceMatcher(None, plain(t), plain(m)).ratio() for m in files.METRICS]
        return files.METRICS[scores.index(max(scores))] if max(scores) >= 0.55 else None

    assert got == {t: (best(t) if t else None) for t in ("Gr#de FVC N", "FEV1", "zzzz", None)}


def test_dominant_colour(spark):
    def plain(palette):
        import colorsys

        def dim(c):
            h, s, v = colorsys.rgb_to_hsv(*(x / 255 for x in c))
            v *= 0.8 if v > 0.9 else 0.9 if v > 0.8 else 0.95 if v > 0.7 else 1
            return tuple(int(x * 255 + 1e-9) for x in colorsys.hsv_to_rgb(h, s, v))

        left = [dim(c) for c in palette]
        for c in left[:]:
            if colorsys.rgb_to_hsv(*(x / 255 for x in c))[0] * 360 < 0.02:
                left.remove(c)
                if len(left) <= 2:
                    break
        score = lambda c: ((c[0] - c[1]) ** 2 + (0.5 * (c[0] + c[1]) - c[2]) ** 2) ** 0.5
        return max(left[:5], key=score) if left else None

    palettes = [[(10, 20, 30), (200, 10, 30), (9, 9, 9)], [(5, 5, 5), (6, 6, 6), (7, 7, 7), (1, 2, 3)], [(9, 9, 9)], [(20, 200, 60), (250, 240, 10), (3, 3, 3), (90, 20, 200), (1, 1, 1), (30, 60, 90), (250, 0, 255)]]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(palettes)], "i int, p array<struct<r:int,g:int,b:int>>")
    got = {r.i: r.c and tuple(r.c) for r in df.select("i", colour.dominant(F.col("p")).alias("c")).collect()}
    for i, p in enumerate(palettes):
        want = plain(p)
        assert (got[i] is None) == (want is None) and (want is None or max(abs(a - b) for a, b in zip(got[i], want, strict=True)) <= 1)


def test_cells_are_mended_as_they_grow(spark):
    tokens = spark.createDataFrame([(1, 0, "3 ."), (1, 1, "08"), (2, 1, "x"), (2, 0, "−")], "case_no long, pos int, text string")
    assert {(r.case_no, r.n, r.cell) for r in layout.assemble(tokens, ["case_no"], clean=True).collect()} == {(1, 2, "3.08"), (2, 2, "- x")}
    assert {r.cell for r in layout.assemble(tokens, ["case_no"]).collect()} == {"3 . 08", "− x"}


def _drained(spark, out, path, name, mode):
    query = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{path}/{name}").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name).collect()


def test_streams(spark, tmp_path):
    rows = [("a", "x", 1, 0.0), ("a", "x", 2, 0.1), ("a", "y", 3, 0.2), ("b", "x", 4, 0.9), ("a", "x", 5, 0.9)]
    df = spark.createDataFrame(rows, "k string, v string, seq long, s double").withColumn("t", F.timestamp_seconds(F.col("s") + 1_700_000_000))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    told = _drained(spark, events.changes(stream(), "k", "v"), tmp_path, "told", "append")
    assert sorted((r.k, r.v, r.seq) for r in told) == [("a", "x", 1), ("a", "x", 5), ("a", "y", 3), ("b", "x", 4)]
    last = _drained(spark, events.status_table(stream(), "k", "v", "seq"), tmp_path, "last", "complete")
    assert sorted((r.k, r.v) for r in last) == [("a", "x"), ("b", "x")]
    counts = _drained(spark, events.sliding_counts(stream(), "k", "t", "500 milliseconds", "500 milliseconds", "1 second"), tmp_path, "counts", "complete")
    assert sorted((r.k, r.n) for r in counts) == [("a", 1), ("a", 3), ("b", 1)]
