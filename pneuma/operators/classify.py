"""From the long grid of cells to one classified row for each case."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clinical
from ..functions.cells import blank, strict_num

METRICS = {"fvc": "FVC", "fev1": "FEV1", "ratio": "FEV1/FVC"}


def pivot_cases(cells: DataFrame, key: str = "case_no", order: str = "pos") -> DataFrame:
    """One row a case: z-scores before and after, and %change, of three metrics; the first row of a metric counts.

    <name>_missing tells of a value that is None: the metric has no row, or its cell is a text but no number. A blank
    cell of a text column, or a null one of a number column, is not missing but a value that no comparison holds for,
    as is NaN, which comes out as null. One shuffle, with partial aggregation, and no sort: what is kept of a case is numbers
    and flags only.
    """
    kinds, nan, none = dict(cells.dtypes), F.lit(float("nan")), F.lit(None).cast("double")
    columns = {"pre_z": "pre", "post_z": "post", "pct_chg": "chg"}
    # One number tells a cell: NaN for a value that no comparison holds for, null for None.
    told = lambda c: F.coalesce(strict_num(F.col(c)), F.when(blank(F.col(c)), nan)) if kinds[c] == "string" else F.coalesce(F.col(c).cast("double"), nan)
    own = F.col("metric").isin(*METRICS.values())
    read = cells.select(key, order, "metric", *[F.when(own, told(c)).alias(when) for c, when in columns.items()])
    first = [F.min_by(when, F.when(F.col("metric") == metric, F.col(order))).alias(f"{when}_{name}") for name, metric in METRICS.items() for when in columns.values()]
    kept = read.groupBy(key).agg(*first)
    return kept.select(key, *[x for c in kept.columns if c != key for x in (F.nanvl(c, none).alias(c), F.col(c).isNull().alias(f"{c}_missing"))])


def classify(cases: DataFrame, bmi: DataFrame | None, key: str = "case_no", default_bmi: float | None = None, missing: str = "parity") -> DataFrame:
    """Patterns, severities, sentences and warnings of each case.

    bmi: (key, bmi) or None; if given, a case that it lacks has none, and default_bmi isn't used. missing "parity" lets a
    blank z-score pass as not low; "safe" makes any blank or NaN one missing too.
    """
    joined = cases.join(bmi, key, "left") if bmi is not None else cases.withColumn("bmi", F.lit(default_bmi).cast("double"))
    out, notes = joined, {}
    gone = lambda when, m: F.col(f"{when}_{m}_missing") | (F.lit(missing != "parity") & F.col(f"{when}_{m}").isNull())
    any_post = ~(gone("post", "fvc") & gone("post", "fev1") & gone("post", "ratio"))
    for when in ("pre", "post"):
        z = [F.col(f"{when}_{m}") for m in METRICS]
        known = ~(gone(when, "fvc") | gone(when, "fev1") | gone(when, "ratio"))
        kind = clinical.pattern(*z)
        absent = F.lit(False) if when == "pre" else ~any_post
        notes[when] = ~absent & ~known
        out = (
            out.withColumn(f"{when}_pattern", F.when(absent, "N/A").when(~known, "Unknown").otherwise(kind))
            .withColumn(f"{when}_severity", F.when(absent, "n/a").when(~known, "unknown").otherwise(clinical.severity(kind, z[1])))
            .withColumn(
                f"{when}_report",
                F.when(absent, "").when(~known, f"Insufficient data to classify {when}-bronchodilator spirometry.")
                .otherwise(clinical.sentence(F.col(f"{when}_pattern"), F.col(f"{when}_severity"), F.col("bmi"))),
            )
        )
    same = (F.col("pre_pattern") == F.col("post_pattern")) & (F.col("pre_severity") == F.col("post_severity"))
    # Warnings (fixed values).
    told = F.array_compact(F.array(F.when(notes["pre"], "Missing pre Z-scores for FVC/FEV1/FEV1-FVC."), F.when(notes["post"], "Partial post Z-scores present; classification may be unreliable.")))
    return out.select(
        key, F.col("bmi").alias("bmi_used"), *[f"{p}_{m}" for p in ("pre", "post", "chg") for m in METRICS],
        "pre_pattern", "pre_severity", "post_pattern", "post_severity", F.col("pre_report").alias("report_pre"), F.col("post_report").alias("report_post"),
        clinical.combined(F.col("pre_report"), F.col("post_report"), same, any_post).alias("report_combined"),
        clinical.bronchodilator(clinical.any_above(*[F.col(f"chg_{m}") for m in METRICS])).alias("bronchodilator_response"), told.alias("warnings"),
    )
