"""Histories, splits, sinks, settings, widths and zones against plain Python."""

import collections
import json
import math
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings as rules
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pneuma.functions import clinical, small, text
from pneuma.operators import history, layout, metrics, reports
from pneuma.sources import files, settings

QUICK = dict(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def _walked(ops, start):
    """A history as the widget keeps it: pushes that are not on top, removals of all but the lowest, then no equal neighbours."""
    past = [start]
    for gone, route in ops:
        if not gone and past[-1] != route:
            past.append(route)
        elif gone and route in past:
            past = [past[0], *[r for r in past[1:] if r != route]]
            past = [r for i, r in enumerate(past) if not i or r != past[i - 1]]
    return past


@rules(**QUICK)
@given(st.lists(st.lists(st.tuples(st.sampled_from([False, False, True]), st.sampled_from("abc")), min_size=1, max_size=14), min_size=20, max_size=40))
def test_history(spark, cases):
    df = spark.createDataFrame([(k, i, r, g) for k, ops in enumerate(cases) for i, (g, r) in enumerate(ops)], "k long, seq long, route string, gone boolean")
    start = spark.createDataFrame([(k, "a") for k in range(0, len(cases), 2)], "k long, route string")
    got = collections.defaultdict(dict)
    for r in history.history(df, "k", "seq", "route", "gone", start).collect():
        got[r.k][r.place] = r.route
    for k, ops in enumerate(cases):
        assert [got[k][i] for i in range(len(got[k]))] == _walked(ops, "a" if k % 2 == 0 else None)


def test_order_in_a_hot_key(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = spark.range(20_000).select(F.when(F.col("id") % 3 > 0, "hot").alias("k"), F.col("id").alias("seq"), (F.col("id") % 7).alias("v"))
    rows = history.with_previous(df, "k", "seq", "v").orderBy("seq").collect()
    placed = {r.seq: r._n for r in history.places(df, "k", "seq").collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    last, n = {}, collections.Counter()
    for r in rows:
        assert r._before == last.get(r.k) and placed[r.seq] == n[r.k]
        last[r.k] = r.v
        n[r.k] += 1
    assert history.places(df.limit(0), "k", "seq").count() == 0


def test_exact_split(spark):
    for n in (0, 1, 9, 10, 101, 3000):
        df = spark.range(n).withColumn("x", F.lit(1))
        split = collections.Counter(r.split for r in metrics.exact_split(df, "id").collect())
        tests = math.ceil(0.1 * n)
        vals = math.ceil(0.11 * (n - tests))
        assert (split["test"], split["val"], split["train"]) == (tests, vals, n - tests - vals)
    a, b = ({r.id: r.split for r in metrics.exact_split(spark.range(500).repartition(p), "id").collect()} for p in (3, 7))
    assert a == b and metrics.exact_split(spark.range(10), "id").columns == ["id", "split"]
    same = spark.createDataFrame([(None,)] * 30 + [(5,)] * 70, "id long")
    assert metrics.of_mode(metrics.exact_split(same, "id"), "test").count() == 10 and metrics.of_mode(metrics.exact_split(same, "id"), "all").count() == 100


def _grid(spark, cases, mark):
    rows = [(c, m, *[f"{mark}{i}{k}" if k % 2 else None for k in range(9)]) for c in cases for i, m in enumerate(files.METRICS)]
    return spark.createDataFrame(rows, files.GRID).orderBy(F.rand(3))


@pytest.mark.parametrize("form", ["csv", "parquet"])
def test_a_folder_a_case(spark, tmp_path, form):
    path = str(tmp_path / "cases")
    files.write_cases(_grid(spark, ["007", "X_12", "b"], "a"), path, form)
    files.write_cases(_grid(spark, ["X_12", "new"], "z"), path, form)  # again: only its own cases change
    assert sorted(p.name for p in (tmp_path / "cases").iterdir() if p.is_dir()) == ["case_id=007", "case_id=X_12", "case_id=b", "case_id=new"]
    rows = files.read_cases(spark, path, form).select("*", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i")).collect()
    per = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.f, r.i)):
        per[r.case_id].append((r.metric, r.LLN))
    assert {c: [m for m, _ in rs] for c, rs in per.items()} == dict.fromkeys(["007", "X_12", "b", "new"], files.METRICS)
    assert per["007"][0][1] == "a01" and per["X_12"][0][1] == "z01" and all(len({r.f for r in rows if r.case_id == c}) == 1 for c in per)


def test_grid_in_total_order(spark, tmp_path):
    path = str(tmp_path / "grid")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    files.write_grid(_grid(spark, [f"c{i:03}" for i in range(60)], "a"), path, most_rows=50)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    names = sorted((tmp_path / "grid").glob("*.parquet"))
    assert len(names) > 8
    rows = [(r.case_id, r.metric) for n in names for r in spark.read.parquet(str(n)).collect()]
    assert rows == [(f"c{i:03}", m) for i in range(60) for m in files.METRICS] and max(spark.read.parquet(str(n)).count() for n in names) <= 50


def test_overrides_and_results(spark, tmp_path):
    (tmp_path / "o.yaml").write_text("global:\n  dx: 0.25\nper_file:\n  a.pdf: {rel_left: 0.5}\n")
    general, own = files.read_overrides(spark, str(tmp_path / "o.yaml"))
    assert general.first().dx == 0.25 and [(r.file, r.rel_left) for r in own.collect()] == [("a.pdf", 0.5)]
    (tmp_path / "empty.json").write_text("")
    assert files.read_overrides(spark, str(tmp_path / "empty.json"))[1].count() == 0
    for name, body in (("bad.json", '{"global": '), ("bad.yaml", "a: [1")):
        (tmp_path / name).write_text(body)
        with pytest.raises(ValueError):
            files.read_overrides(spark, str(tmp_path / name))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.read_overrides(spark, str(tmp_path / "none.json"))
    (tmp_path / "r.json").write_text('{"case_id": "a", "z": NaN}\n{"case_id": "b", "z": 1.5}\n')
    got = {r.case_id: r.z for r in files.read_json(spark, str(tmp_path / "r.json"), "case_id string, z double").collect()}
    assert math.isnan(got["a"]) and got["b"] == 1.5
    files.export_json(spark.createDataFrame([("a", float("nan"))], "case_id string, z double"), str(tmp_path / "out"))
    assert math.isnan(files.read_json(spark, str(tmp_path / "out"), "case_id string, z double").first().z)
    (tmp_path / "bmi.csv").write_text("case_id,bmi\na,NaN\nb,31\nc,x\n")
    assert [(r.case_id, r.bmi) for r in files.read_lookup(spark, str(tmp_path / "bmi.csv")).collect()] == [("b", 31.0)]


def test_bmi_that_is_no_number(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (30.9,), (29.9,)], "bmi double")
    told = [r.s for r in df.select(clinical.sentence(F.lit("Mixed"), F.lit("mild"), F.col("bmi")).alias("s")).collect()]
    assert [("BMI 30" in t, "BMI" in t) for t in told] == [(False, False), (False, False), (True, True), (False, False)]


def test_medians_of_named_cases(spark):
    df = spark.createDataFrame([("X_12", 1.0), ("X_12", 9.0), ("case a", 5.0)], "case_no string, x double")
    got = {(r.case_no, r.centre) for r in layout.k_medians(df, 2).collect()}
    assert got == {("X_12", 1.0), ("X_12", 9.0), ("case a", 5.0)} and layout.k_medians(df, 2).where("case_no = 'case a'").count() == 2


def _wide(t):
    return sum(2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in t)


@rules(**QUICK)
@given(st.lists(st.text("ab あ中ｅ😀ｱ́\n", max_size=40), min_size=8, max_size=30))
def test_widths_and_lines(spark, texts):
    def lines(t, width):
        t = t.strip()
        if _wide(t) <= width:
            return [t]
        filled, line = [], None
        for w in t.split():
            if line is None:
                line = w
            elif _wide(f"{line} {w}") <= width:
                line = f"{line} {w}"
            else:
                filled, line = [*filled, line], w
        out = []
        for part in [*filled, line]:
            piece = ""
            for ch in part:
                if piece and _wide(piece + ch) > width:
                    out, piece = [*out, piece], ch
                else:
                    piece += ch
            out.append(piece)
        return out

    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("i", text.display_width(F.col("t")).alias("w"), text.wrapped(F.col("t"), 6, text.display_width).alias("x")).collect():
        assert (r.w, r.x) == (_wide(texts[r.i]), lines(texts[r.i], 6))
    assert df.select(text.display_width(F.lit(None).cast("string"))).first()[0] == 0
    assert text.line_chars(100, 10) == 18 and text.line_chars(55, 10) == 9  # 10 * 10 * 0.55 is a little more than 55


def test_parallel_arrays(spark):
    df = spark.createDataFrame([(1, ["a", "b"], [0.5]), (2, None, [0.1]), (3, [], None)], "i int, name array<string>, p array<double>")
    assert sorted(tuple(r) for r in reports.aligned(df, ["name", "p"], ["i"]).collect()) == [(1, 0, "a", 0.5), (1, 1, "b", None), (2, 0, None, 0.1)]
    one = df.select(reports.without(F.col("name"), F.lit("a")).alias("x"), reports.without(F.col("name"), F.lit(None).cast("string")).alias("y")).first()
    assert one.x == ["b"] and one.y == ["a", "b"]


def test_settings_there_and_back(spark):
    items = [settings.Item("Dpi", "range", "96", 50, 300), settings.Item("Main.on", "bool", "true"), settings.Item("Main.colour", "colour", "#ff0000"), settings.Item("Main.mode", "options", "a", options=("a", "b")), settings.Item("Main.name", "text")]
    docs = {1: '{"Dpi": 1000, "Main": {"on": false, "colour": "red", "mode": "z", "name": "q\\"x", "odd": 1}, "Other": {"x": 1}}', 2: "{", 3: None, 4: '{"Dpi": "x", "Main": 7}', 5: '{"Dpi": 72.5, "Main": {"mode": "b", "on": 3, "name": null}}'}
    df = spark.createDataFrame(list(docs.items()), "i int, doc string")
    got = collections.defaultdict(dict)
    held = settings.loaded(df, "doc", ["i"], items)
    for r in held.collect():
        got[r.i][r.key] = r.value
    plain = {"Dpi": "96", "Main.on": "true", "Main.colour": "#ff0000", "Main.mode": "a", "Main.name": None}
    assert got == {1: {"Dpi": "300", "Main.on": "false", "Main.colour": "#ff0000", "Main.mode": "a", "Main.name": 'q"x'}, 2: plain, 3: plain, 4: plain, 5: plain | {"Dpi": "72.5", "Main.mode": "b"}}
    back = {r.i: json.loads(r.doc) for r in settings.saved(held, ["i"]).collect()}
    assert back[1] == {"Dpi": 300, "Main": {"on": False, "colour": "#ff0000", "mode": "a", "name": 'q"x'}} and back[3]["Main"]["name"] is None
    again = settings.loaded(settings.saved(held, ["i"]), "doc", ["i"], items)
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, held.collect()), key=str)
    keys = {r.key for r in settings.known(settings.given(df, "doc", ["i"]), spark.createDataFrame([("Main.odd",), ("Dpi",)], "key string")).collect()}
    assert keys == {"Main.odd", "Dpi"}


def test_shown_cards_keep_their_order(spark):
    cards = spark.createDataFrame([(2, "c"), (0, "a"), (1, "b")], "idx int, name string")
    hits = spark.createDataFrame([(2,), (0,), (2,)], "idx int")
    assert [r.name for r in settings.shown_cards(cards, hits).collect()] == ["a", "c"]


def test_times_of_day(spark):
    rows = spark.createDataFrame([(23, 59, 59), (24, 0, 0), (0, 60, 0), (0, 0, 0), (None, 1, 1)], "h int, m int, s int")
    assert [r.v for r in rows.select(small.valid_time(F.col("h"), F.col("m"), F.col("s")).alias("v")).collect()] == [86399, None, None, 0, None]


def test_zones_and_shared_edges(spark):
    pages = spark.createDataFrame([(1, 10.0, 20.0, 60.0), (2, 10.0, 20.0, 60.0)], "case_no int, body_y0 double, data_x0 double, split_x double")
    rows = spark.createDataFrame([(c, i, 10.0 + 20 * i, 30.0 + 20 * i) for c in (1, 2) for i in range(2)], "case_no int, idx int, lo double, hi double")
    columns = spark.createDataFrame([(c, z, i, x + 20 * i, x + 20 * (i + 1)) for c in (1, 2) for z, x in (("pre", 20.0), ("post", 60.0)) for i in range(2)], "case_no int, zone string, idx int, lo double, hi double")
    tokens = [
        (1, 0, 40.0, 30.0, "a"), (1, 1, 60.0, 40.0, "7"), (1, 2, 59.9, 40.0, "b"), (1, 3, 19.0, 40.0, "label"), (1, 4, 30.0, 10.0, "head"), (1, 5, 99.0, 51.0, "9"), (1, 6, 80.0, 50.0, "c"),
        (2, 0, 70.0, 20.0, "no number"), (2, 1, 70.0, 9.0, "5"), (2, 2, 50.0, 20.0, "3"),
    ]
    df = spark.createDataFrame(tokens, "case_no int, pos int, cx double, cy double, text string")
    got = {(r.case_no, r.pos): (r.row_idx, r.zone, r.col_idx) for r in layout.zone_cells(df, pages, rows, columns).collect()}
    assert got == {(1, 0): (0, "pre", 0), (1, 1): (1, "post", 0), (1, 2): (1, "pre", 1), (1, 6): (1, "post", 0), (2, 2): (0, "pre", 1)}
    heads = spark.createDataFrame([(1, "POST-BEST"), (2, "POST-BEST"), (2, "LLN")], "case_no int, col string")
    assert [r.case_no for r in layout.post_warning(df, pages, heads).collect()] == [2]
