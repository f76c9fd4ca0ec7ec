"""Rectangles: overlap, filters, extent and greedy suppression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def iou(a: str, b: str) -> Column:
    """Intersection over union of the boxes in structs a and b."""
    left = lambda s, o, d: F.col(f"{s}.{o}")
    w = F.greatest(F.lit(0), F.least(F.col(f"{a}.x") + F.col(f"{a}.w"), F.col(f"{b}.x") + F.col(f"{b}.w")) - F.greatest(left(a, "x", 0), left(b, "x", 0)))
    h = F.greatest(F.lit(0), F.least(F.col(f"{a}.y") + F.col(f"{a}.h"), F.col(f"{b}.y") + F.col(f"{b}.h")) - F.greatest(left(a, "y", 0), left(b, "y", 0)))
    union = F.col(f"{a}.w") * F.col(f"{a}.h") + F.col(f"{b}.w") * F.col(f"{b}.h") - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def overlapping_pairs(boxes: DataFrame, least: float, key: str = "case_no", tie: str = "pos") -> DataFrame:
    """Pairs of boxes of a case that overlap by more than least."""
    one = lambda n: boxes.select(key, F.struct(tie, "x", "y", "w", "h").alias(n))
    met = one("a").join(one("b"), key).where(F.col(f"a.{tie}") < F.col(f"b.{tie}"))
    return met.select(key, F.col(f"a.{tie}").alias("pos_a"), F.col(f"b.{tie}").alias("pos_b"), iou("a", "b").alias("iou")).where(F.col("iou") > least)


def plausible(boxes: DataFrame, page: float, smallest: float, largest: float, narrow: float = 0.6, wide: float = 2.8, left: int = 0, top: int = 0) -> DataFrame:
    """Area share and aspect within bounds, and the box not beyond the left or top margin."""
    share, aspect = F.col("w") * F.col("h") / page, F.col("w") / F.greatest(F.lit(1), F.col("h"))
    return boxes.where(share.between(smallest, largest) & aspect.between(narrow, wide) & (F.col("x") >= left) & (F.col("y") >= top))


def extent(boxes: DataFrame, key: str = "case_no", tie: str = "pos") -> DataFrame:
    """Bounding box of all boxes of a case, and the largest one's place."""
    return boxes.groupBy(key).agg(
        F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("w")).alias("x1"), F.max(F.col("y") + F.col("h")).alias("y1"),
        F.max_by(tie, F.struct(F.col("w") * F.col("h"), -F.col(tie))).alias("largest"),
    )


def suppress(boxes: DataFrame, most_overlap: float = 0.15, keep: int = 4, best: int | None = None, key: str = "case_no", tie: str = "pos") -> DataFrame:
    """Greedy: largest first, a box stays if it overlaps none that stays by most_overlap or more; at most keep, of which
    the best largest are returned if that is given.

    The boxes of a page are few; the fold runs on a case's sorted array.
    """
    box = F.struct((-F.col("w") * F.col("h")).alias("neg_area"), F.col(tie).alias("pos"), F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    grouped = boxes.groupBy(key).agg(F.array_sort(F.collect_list(box)).alias("all"))
    clash = (
        "exists(acc, k -> greatest(0, least(k.x + k.w, b.x + b.w) - greatest(k.x, b.x)) * greatest(0, least(k.y + k.h, b.y + b.h) - greatest(k.y, b.y)) >= "
        f"{most_overlap}D * (k.w * k.h + b.w * b.h - greatest(0, least(k.x + k.w, b.x + b.w) - greatest(k.x, b.x)) * greatest(0, least(k.y + k.h, b.y + b.h) - greatest(k.y, b.y))))"
    )
    kept = F.expr(f"aggregate(all, slice(all, 1, 0), (acc, b) -> if(size(acc) >= {keep} or {clash}, acc, concat(acc, array(b))))")
    kept = F.slice(kept, 1, best) if best else kept
    return grouped.select(key, F.posexplode(kept).alias("rank", "b")).select(key, (F.col("rank") + 1).alias("rank"), F.col("b.pos").alias(tie))


def table_box(boxes: DataFrame, bands: DataFrame, key: str = "case_no", tie: str = "pos") -> DataFrame:
    """key, x, y, w, h: the crop of each band (key, band_w, band_h) to the boxes found in it.

    All boxes together, or the largest alone if they are over 1.18 times as high and it is 0.55 of the band wide. 10 is
    added around (0.04 of the width to the left, 0.02 of the height below, if more), and everything to the left if it
    begins beyond 0.03. The whole band stands in for a crop under 0.25 of its area, 0.55 of its width or 0.5 of its
    height, and where there are no boxes.
    """
    found = extent(boxes, key, tie).join(boxes.select(key, F.col(tie).alias("largest"), *[F.col(c).alias(f"_{c}") for c in "xywh"]), [key, "largest"])
    bw, bh = F.col("band_w"), F.col("band_h")
    cut = lambda c, share: (c * F.lit(share)).cast("int")
    met = bands.join(found, key, "left")
    alone = (F.col("_h") > 0) & (F.col("y1") - F.col("y0") > F.col("_h") * 1.18) & (F.col("_w") >= cut(bw, 0.55))
    pick = lambda one, whole: F.when(alone, one).otherwise(whole)
    met = met.withColumns({"_l": pick(F.col("_x"), F.col("x0")), "_t": pick(F.col("_y"), F.col("y0")), "_r": pick(F.col("_x") + F.col("_w"), F.col("x1")), "_b": pick(F.col("_y") + F.col("_h"), F.col("y1"))})
    left = F.when(F.col("_l") > cut(bw, 0.03), 0).otherwise(F.greatest(F.lit(0), F.col("_l") - F.greatest(F.lit(10), cut(bw, 0.04))))
    top = F.greatest(F.lit(0), F.col("_t") - 10)
    wide, high = F.least(F.col("_r") + 10, bw) - left, F.least(F.col("_b") + F.greatest(F.lit(10), cut(bh, 0.02)), bh) - top
    area = F.greatest(wide, F.lit(1)) * F.greatest(high, F.lit(1))
    poor = F.col("_l").isNull() | (area < bw * bh * 0.25) | (wide / F.greatest(bw, F.lit(1)) < 0.55) | (high / F.greatest(bh, F.lit(1)) < 0.5)
    value = lambda crop, whole: F.when(poor, whole).otherwise(crop).cast("long")
    return met.select(key, value(left, 0).alias("x"), value(top, 0).alias("y"), value(wide, bw).alias("w"), value(high, bh).alias("h"))
