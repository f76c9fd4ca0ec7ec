"""Where a table lies on its page: rectangles, edges, centres of rows and zones, boxes of cells.

Tokens have a case, a text and a box (cx, cy, x0, y0, x1, y1); pages have a case and their width w and height h. Each
operator aggregates the tokens of a case, with map-side combine, and gives one row for each page (or row, or cell).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import HEADINGS, ROWS
from ..functions.clinical import clamp
from ..functions.text import has_digit, normalize_key

# Header texts, normalised, and the columns they stand for (fixed values).
HEADER_ALIASES = {
    "prebest": "PRE-BEST", "pre-best": "PRE-BEST", "pre": "PRE-BEST", "lln": "LLN", "pred": "Pred", "prediction": "Pred",
    "%pred": "Pre_%Pred", "pred%": "Pre_%Pred", "pre%pred": "Pre_%Pred", "prepred": "Pre_%Pred",
    "zscore": "Pre_Z-Score", "prezscore": "Pre_Z-Score", "prez": "Pre_Z-Score",
    "postbest": "POST-BEST", "post-best": "POST-BEST", "post": "POST-BEST", "post%pred": "Post_%Pred", "postpred": "Post_%Pred",
    "postzscore": "Post_Z-Score", "postz": "Post_Z-Score", "%chg": "%CHG", "pctchg": "%CHG", "chg": "%CHG",
}
RECT = ("rel_left", "rel_top", "rel_right", "rel_bottom")


def override_rect(df: DataFrame, general: DataFrame | None, own: DataFrame | None, key: str = "file", extra: bool = False) -> DataFrame:
    """df's rectangles (RECT, and extra_bottom_frac) after overrides: general, a table of one row, then own, by key.

    Edges are replaced; dx, dy and grow of both add up: shift, grow about the centre, clamp to the page, and 0.01 at
    least. Without extra, extra_bottom_frac is 0; with it, it is replaced too and clamped to 0..0.2. A missing column
    or a null value overrides nothing; of several own rows of a key each gives a result.
    """
    names = [*RECT, "dx", "dy", "grow", "extra_bottom_frac"]
    out = df if "extra_bottom_frac" in df.columns else df.withColumn("extra_bottom_frac", F.lit(0.0))
    have = lambda t, n: F.col(n).cast("double") if t is not None and n in t.columns else F.lit(None).cast("double")
    if general is not None:
        first = general.select(*[have(general, n).alias(f"_g_{n}") for n in names]).limit(1)
        out = out.join(F.broadcast(first), F.lit(True), "left")  # one row
    else:
        out = out.withColumns({f"_g_{n}": F.lit(None).cast("double") for n in names})
    if own is not None:
        out = out.join(own.select(key, *[have(own, n).alias(f"_o_{n}") for n in names]), key, "left")
    else:
        out = out.withColumns({f"_o_{n}": F.lit(None).cast("double") for n in names})
    put = lambda n: F.coalesce(f"_o_{n}", f"_g_{n}", F.col(n).cast("double"))
    total = lambda n: F.coalesce(f"_g_{n}", F.lit(0.0)) + F.coalesce(f"_o_{n}", F.lit(0.0))
    out = out.withColumns({"_l": put("rel_left") + total("dx"), "_r": put("rel_right") + total("dx"), "_t": put("rel_top") + total("dy"), "_b": put("rel_bottom") + total("dy"), "_s": 1.0 + total("grow"), "_e": put("extra_bottom_frac")})
    for low, high in (("_l", "_r"), ("_t", "_b")):
        centre, half = (F.col(low) + F.col(high)) / 2.0, (F.col(high) - F.col(low)) / 2.0 * F.col("_s")
        out = out.withColumns({low: clamp(centre - half, 0.0, 1.0), high: clamp(centre + half, 0.0, 1.0)})
        out = out.withColumn(high, F.when(F.col(high) <= F.col(low), F.least(F.lit(1.0), F.col(low) + 0.01)).otherwise(F.col(high)))
    bottom = clamp(F.col("_e"), 0.0, 0.2) if extra else F.lit(0.0)
    results = {"rel_left": F.col("_l"), "rel_top": F.col("_t"), "rel_right": F.col("_r"), "rel_bottom": F.col("_b"), "extra_bottom_frac": bottom}
    return out.withColumns(results).drop("_l", "_r", "_t", "_b", "_s", "_e", *[f"_{p}_{n}" for p in "go" for n in names])


def crop_band(df: DataFrame, w: str = "w", h: str = "h") -> DataFrame:
    """band (x, y, width, height in pixels, truncated) of each rectangle, or null and an error where nothing is left. The
    words of the error are fixed values."""
    cut = lambda c: c.cast("int")
    x0, y0 = F.greatest(F.lit(0), cut(F.col(w) * F.col("rel_left"))), F.greatest(F.lit(0), cut(F.col(h) * F.col("rel_top")))
    x1 = F.least(F.col(w).cast("int"), cut(F.col(w) * F.col("rel_right")))
    y1 = F.least(F.col(h).cast("int"), cut(F.col(h) * F.least(F.lit(1.0), F.col("rel_bottom") + F.col("extra_bottom_frac"))))
    good = (x1 > x0) & (y1 > y0)
    band = F.struct(x0.alias("x"), y0.alias("y"), (x1 - x0).alias("width"), (y1 - y0).alias("height"))
    return df.withColumns({"band": F.when(good, band), "error": F.when(~good, "Invalid band crop; adjust rel rect / extra-bottom.")})


def body_top(tokens: DataFrame, pages: DataFrame, key: str = "case_no") -> DataFrame:
    """pages with body_y0: 8 under the lowest header near the top, within 0.08 to 0.35 of the height; 0.16 without one."""
    met = tokens.join(pages.select(key, F.col("h").alias("_h")), key).where((F.col("cy") <= F.col("_h") * 0.30) & F.col("text").rlike("[A-Za-z%]") & normalize_key(F.col("text")).isin(list(HEADER_ALIASES)))
    low = met.groupBy(key).agg(F.max("y1").alias("_y"))
    return pages.join(low, key, "left").withColumn("body_y0", F.coalesce(clamp(F.col("_y") + 8.0, F.col("h") * 0.08, F.col("h") * 0.35), F.col("h") * 0.16)).drop("_y")


def headings(tokens: DataFrame, key: str = "case_no") -> DataFrame:
    """key, col, cx: the position of each column, from header tokens (merged already) with a confidence.

    %Pred and Z-Score stand for both sides: more than 30 right of the rightmost POST-BEST they are those after. Of
    several tokens of a column the most confident counts, the leftmost of equals.
    """
    name = normalize_key(F.col("text"))
    alias = F.create_map(*[F.lit(x) for kv in HEADER_ALIASES.items() for x in kv])
    named = tokens.select(key, name.alias("_norm"), F.try_element_at(alias, name).alias("col"), "cx", "conf").where("col is not null")
    post = named.groupBy(key).agg(F.max(F.when(F.col("col") == "POST-BEST", F.col("cx"))).alias("_post"))
    after = F.col("cx") > F.col("_post") + 30
    side = F.when(after & F.col("_norm").isin("%pred", "pred%", "prepred", "pre%pred"), "Post_%Pred").when(after & F.col("_norm").isin("zscore", "prezscore", "prez"), "Post_Z-Score").otherwise(F.col("col"))
    best = F.max(F.struct("conf", (-F.col("cx")).alias("left")))["left"]
    return named.join(post, key).withColumn("col", side).groupBy(key, "col").agg((-best).alias("cx"))


def _at(values: Column, index: Column) -> Column:
    """The sorted value at a place from 0; null of an empty list."""
    return F.try_element_at(F.array_sort(values), F.greatest(F.lit(0), index.cast("int")) + 1)


def data_left(tokens: DataFrame, pages: DataFrame, key: str = "case_no") -> DataFrame:
    """pages (with body_y0) with data_x0, the left edge of the numbers.

    8 left of the 5th percentile (by place, halves to even) of their left edges, within 0.12 to 0.45 of the width; else
    10 right of the 90th percentile (by place, cut) of the labels' right edges, within 0.10 to 0.45; else 0.22.
    """
    met = tokens.join(pages.select(key, F.col("w").alias("_w"), F.col("body_y0").alias("_top")), key).where(F.col("cy") > F.col("_top"))
    digit, label = has_digit(F.col("text")), (F.col("cx") <= F.col("_w") * 0.45) & F.col("text").rlike("[A-Za-z]")
    edges = met.groupBy(key).agg(F.collect_list(F.when(digit, F.col("x0"))).alias("_x0"), F.collect_list(F.when(label, F.col("x1"))).alias("_x1"))
    w = F.col("w")
    low = _at(F.col("_x0"), F.bround((F.size("_x0") - 1) * F.lit(0.05), 0)) - 8.0
    right = _at(F.col("_x1"), F.floor((F.size("_x1") - 1) * F.lit(0.9))) + 10.0
    out = pages.join(edges, key, "left")
    return out.withColumn("data_x0", F.coalesce(clamp(low, w * 0.12, w * 0.45), clamp(right, w * 0.10, w * 0.45), w * 0.22)).drop("_x0", "_x1")


def split_x(pages: DataFrame, heads: DataFrame, key: str = "case_no") -> DataFrame:
    """pages (with data_x0) with split_x, between the columns before and after.

    25 left of POST-BEST, 20 right of data_x0 at least; 0.58 of the way to the right edge without it. Then 30 right of
    data_x0 at least, and at most 0.92 of the width, which the former bound outweighs.
    """
    post = heads.where(F.col("col") == "POST-BEST").groupBy(key).agg(F.max("cx").alias("_post"))
    left, w = F.col("data_x0"), F.col("w")
    guess = F.coalesce(F.when(F.col("_post").isNotNull(), F.greatest(left + 20.0, F.col("_post") - 25.0)), left + (w - left) * 0.58)
    return pages.join(post, key, "left").withColumn("split_x", F.greatest(left + 30.0, F.least(w * 0.92, guess))).drop("_post")


def row_centres(pages: DataFrame, anchors: DataFrame, key: str = "case_no", rows: int = len(ROWS)) -> DataFrame:
    """key, idx, centre of all rows of each page, from anchors (key, idx, y), of which repeated ones count by their mean.

    Six anchors or more: least squares. Two or more: upper median of the spacing, from the first anchor on. Fewer: even
    spacing. The first two are kept 5 within the body.
    """
    known = anchors.groupBy(key, "idx").agg(F.avg("y").alias("y"))
    fit = known.groupBy(key).agg(F.count("*").alias("_n"), F.regr_slope("y", "idx").alias("_a"), F.regr_intercept("y", "idx").alias("_b"), F.array_sort(F.collect_list(F.struct("idx", "y"))).alias("_at"))
    step = lambda i: (F.col("_at")[i]["y"] - F.col("_at")[i - 1]["y"]) / F.greatest(F.lit(1), F.col("_at")[i]["idx"] - F.col("_at")[i - 1]["idx"])
    steps = F.array_sort(F.transform(F.sequence(F.lit(1), F.size("_at") - 1), step))
    out = pages.select(key, "h", "body_y0").join(fit, key, "left").withColumn("_d", F.when(F.col("_n").between(2, 5), F.element_at(steps, F.floor((F.col("_n") - 1) / 2).cast("int") + 1)))
    out = out.withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    idx, h, top = F.col("idx"), F.col("h"), F.col("body_y0")
    inside = lambda y: F.least(h - 5, F.greatest(top + 5, y))
    first = F.col("_at")[0]
    low, high = top + (h - top) * 0.06, h * 0.98
    centre = F.when(F.col("_n") >= 6, inside(F.col("_a") * idx + F.col("_b"))).when(F.col("_n") >= 2, inside(F.col("_d") * idx + (first["y"] - F.col("_d") * first["idx"]))).otherwise(low + (high - low) * (idx + 0.5) / rows)
    return out.select(key, "idx", centre.alias("centre"))


def cell_boxes(rows: DataFrame, columns: DataFrame, pages: DataFrame, key: str = "case_no") -> DataFrame:
    """key, idx, col and the padded box of each cell, in whole pixels within the page.

    rows: key, idx, lo, hi; columns: key, col (a heading), lo, hi. Cells are padded by 0.08 of their width (2 at least)
    and 0.15 of their height (2 at least), z-scores by 0.14 and percentages by 0.10 to the left.
    """
    met = rows.select(key, "idx", F.col("lo").alias("y0"), F.col("hi").alias("y1")).join(columns.select(key, "col", F.col("lo").alias("x0"), F.col("hi").alias("x1")).hint("merge"), key).join(pages.select(key, "w", "h").hint("merge"), key)
    wide, high = F.greatest(F.lit(1.0), F.col("x1") - F.col("x0")), F.greatest(F.lit(1.0), F.col("y1") - F.col("y0"))
    side, over = F.greatest(F.lit(2.0), 0.08 * wide), F.greatest(F.lit(2.0), 0.15 * high)
    zscore, percent = F.col("col").isin(HEADINGS["pre_z"], HEADINGS["post_z"]), F.col("col").isin(HEADINGS["pre_pct"], HEADINGS["post_pct"], HEADINGS["pct_chg"])
    left = F.when(zscore, F.greatest(side, 0.14 * wide)).when(percent, F.greatest(side, 0.10 * wide)).otherwise(side)
    cut = lambda c: c.cast("int")
    return met.select(
        key, "idx", "col", cut(F.greatest(F.lit(0.0), F.col("x0") - left)).alias("x0"), cut(F.greatest(F.lit(0.0), F.col("y0") - over)).alias("y0"),
        cut(F.least(F.col("w") - 1, F.col("x1") + side)).alias("x1"), cut(F.least(F.col("h") - 1, F.col("y1") + over)).alias("y1"),
    )


def zone_values(tokens: DataFrame, zones: DataFrame, key: str = "case_no") -> DataFrame:
    """key, x: what the centres of a zone (key, x0, x1, body_y0) are made from: its numbers if there are ten, else all."""
    met = tokens.select(key, "text", "cx", "cy").join(zones.select(key, F.col("x0").alias("_lo"), F.col("x1").alias("_hi"), "body_y0"), key)
    body = met.where((F.col("cy") > F.col("body_y0")) & F.col("cx").between(F.col("_lo"), F.col("_hi")))
    held = body.groupBy(key).agg(F.collect_list(F.when(has_digit(F.col("text")), F.col("cx"))).alias("_numbers"), F.collect_list("cx").alias("_all"))
    return held.select(key, F.explode(F.when(F.size("_numbers") >= 10, F.col("_numbers")).otherwise(F.col("_all"))).alias("x"))


def even_centres(zones: DataFrame, centres: DataFrame, k: int, key: str = "case_no") -> DataFrame:
    """key, idx, centre: the centres found, and k evenly spread ones for zones without any."""
    empty = zones.join(centres.select(key).distinct(), key, "left_anti").select(key, "x0", "x1", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("idx"))
    return centres.select(key, "idx", "centre").unionByName(empty.select(key, "idx", (F.col("x0") + (F.col("x1") - F.col("x0")) * (F.col("idx") + 0.5) / k).alias("centre")))


def wanted_tables(files: DataFrame, wanted: list[str], name: str = "name") -> DataFrame:
    """Files asked for by name, by stem, or by the case id of the stem; all of them if nothing is asked for."""
    from ..functions.text import case_id

    stem = lambda c: F.regexp_replace(c, r"(?<=.)\.[^.]*$", "")
    asked = [w.strip() for w in wanted if w.strip()]
    if not asked:
        return files
    ids = F.array(*[case_id(stem(F.lit(w))) for w in asked])
    own = F.col(name)
    return files.where(own.isin(asked) | stem(own).isin(asked) | F.array_contains(ids, case_id(stem(own))))


def wanted_classes(files: DataFrame, wanted: list[str], name: str = "name", tail: str = "_p2_table") -> DataFrame:
    """Grid files asked for by name, stem or stem without its tail, in any case; here ids are compared as they are."""
    asked = [w.strip().lower() for w in wanted if w.strip()]
    if not asked:
        return files
    low = F.lower(F.col(name))
    stem = F.regexp_replace(low, r"(?<=.)\.[^.]*$", "")
    return files.where(low.isin(asked) | stem.isin(asked) | F.replace(stem, F.lit(tail), F.lit("")).isin(asked))


def first_files(files: DataFrame, limit: int, name: str = "name") -> DataFrame:
    """The first files by name; 0 is no limit."""
    return files.orderBy(name).limit(limit) if limit else files.orderBy(name)
