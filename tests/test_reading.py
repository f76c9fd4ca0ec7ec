"""Labels, header positions, wrapped text and colours against plain Python."""

import colorsys
import textwrap

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pneuma.functions import colour, text
from pneuma.operators import labels, layout, repair
from pneuma.sources import files


def test_labels(spark):
    given_ = [("FEF25-75%",), ("fvc",), ("Ratio",), ("zzzz",), ("",), (None,), ("FEV1/FVCx",), ("fvc",)]
    rows = labels.match_labels(spark.createDataFrame(given_, "label string"), files.METRICS, {"ratio": "FEV1/FVC"}).collect()
    found = {r["label"]: (r["name"], r["score"]) for r in rows}
    assert len(rows) == len(given_)
    assert found["fvc"] == ("FVC", 1.0) and found["Ratio"] == ("FEV1/FVC", 1.0)
    assert found["FEF25-75%"][0] == "FEF25%-75%" and 0.55 <= found["FEF25-75%"][1] < 1
    assert found["FEV1/FVCx"][0] == "FEV1/FVC"
    assert found["zzzz"] == found[""] == found[None] == (None, None)
    assert not labels.match_labels(spark.createDataFrame([], "label string"), files.METRICS).count()


COLUMNS = ["a", "b", "c", "d"]


def positions(centres, known):
    left, out = sorted(centres), []
    if not left:
        return []
    for name in COLUMNS:
        if name in known:
            out.append(known[name])
            while left and left[0] <= known[name]:
                left.pop(0)
        else:
            out.append(left.pop(0) if left else out[-1] + 8)
    for i in range(1, len(out)):
        out[i] = out[i] if out[i] > out[i - 1] else out[i - 1] + 1
    return out


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.lists(st.integers(0, 60).map(float), max_size=6), st.dictionaries(st.sampled_from(COLUMNS), st.integers(0, 60).map(float))), min_size=8, max_size=40))
def test_anchored_centres(spark, cases):
    df = spark.createDataFrame([(i, c, k) for i, (c, k) in enumerate(cases)], "i int, centres array<double>, known map<string,double>")
    got = df.select("i", layout.anchored_centres(F.col("centres"), F.col("known"), COLUMNS).alias("x")).collect()
    assert {r["i"]: r["x"] for r in got} == {i: positions(c, k) for i, (c, k) in enumerate(cases)}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab é\n", max_size=90), min_size=8, max_size=40))
def test_wrapped(spark, texts):
    def lines(t):
        t = t.strip()
        if len(t) <= 12:
            return [t]
        filled = textwrap.wrap(" ".join(t.split()), 12, break_long_words=False, break_on_hyphens=False)
        return [line[i : i + 12] for line in filled for i in range(0, len(line), 12)]

    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert {r["i"]: r["x"] for r in df.select("i", text.wrapped(F.col("t"), 12).alias("x")).collect()} == {i: lines(t) for i, t in enumerate(texts)}
    assert df.select(text.wrapped(F.lit(None).cast("string"), 12)).first()[0] == [""]


def test_colours(spark):
    rows = [(r, g, b) for r in range(0, 256, 51) for g in range(0, 256, 51) for b in range(0, 256, 51)]
    df = spark.createDataFrame(rows, "r int, g int, b int").withColumn("c", colour.to_hsv(F.col("r"), F.col("g"), F.col("b")))
    for row in df.withColumn("back", colour.to_rgb(F.col("c.h"), F.col("c.s"), F.col("c.v"))).collect():
        h, s, v = colorsys.rgb_to_hsv(row["r"] / 255, row["g"] / 255, row["b"] / 255)
        assert max(abs(row["c"]["h"] - h * 360), abs(row["c"]["s"] - s), abs(row["c"]["v"] - v)) < 1e-9
        assert all(0 <= want - got <= 1 for want, got in zip((row["r"], row["g"], row["b"]), row["back"], strict=True))  # cut, not rounded
    top = df.select(colour.shade(F.col("c"), "LIGHT_1").alias("x"), colour.shade(F.col("c"), "DARK_1", "dark").alias("y")).agg(F.max("x.v"), F.max("y.v")).first()
    assert top[0] == 1.0 and abs(top[1] - 0.9) < 1e-12


def test_merge_neighbours(spark):
    tokens = [(1, 0, 5.0, 1.0, "PRE", 0.9, 0.0, 0.0, 10.0, 2.0), (1, 1, 20.0, 3.0, "BEST", 0.5, 15.0, 1.0, 25.0, 4.0), (1, 2, 70.0, 2.0, "LLN", 0.8, 60.0, 0.0, 80.0, 2.0), (2, 0, 5.0, 1.0, "x", 0.1, 0.0, 0.0, 10.0, 2.0)]
    df = spark.createDataFrame(tokens, "line int, pos int, cx double, cy double, text string, conf double, x0 double, y0 double, x1 double, y1 double")
    got = {(r["line"], r["text"]): (r["cx"], r["cy"], r["conf"], r["x0"], r["x1"], r["y0"], r["y1"]) for r in layout.merge_neighbours(df, ["line"]).collect()}
    assert got == {(1, "PRE BEST"): (12.5, 2.0, 0.5, 0.0, 25.0, 0.0, 4.0), (1, "LLN"): (70.0, 2.0, 0.8, 60.0, 80.0, 0.0, 2.0), (2, "x"): (5.0, 1.0, 0.1, 0.0, 10.0, 0.0, 2.0)}


def test_suspicious_modes(spark):
    df = spark.createDataFrame([("FVC", "1.00", "1.00", "0.80", "100.0", "0.10"), ("MVV", None, None, None, None, None)], "metric string, pre_best string, pred string, lln string, pre_pct string, pre_z string")
    df = df.withColumns({c: F.lit(None).cast("string") for c in ("post_best", "post_pct", "post_z", "pct_chg")})
    flags = lambda mode: [tuple(r) for r in repair.suspicious(df, mode).select("re_pred", "re_lln", "re_pre_pct", "re_pre_z").collect()]
    assert flags("auto") == [(False,) * 4, (True,) * 4] and flags("force") == [(True,) * 4] * 2 and flags("off") == [(False,) * 4] * 2
