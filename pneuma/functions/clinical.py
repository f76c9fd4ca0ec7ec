"""Threshold rules that turn z-scores into patterns, severities and sentences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cut-offs (fixed values).
LOWER_LIMIT, MILD, MODERATE, RAISED_BMI, SIGNIFICANT_CHANGE = -1.64, -2.50, -4.00, 30.0, 10.0


def number(c: Column) -> Column:
    """NaN as null, as Spark holds NaN to be larger than any number, while a comparison with it should fail."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def any_above(*values: Column, limit: float = SIGNIFICANT_CHANGE) -> Column:
    """Whether any of the values is over the limit; missing ones and NaN aren't."""
    return F.coalesce(F.greatest(*[number(v) for v in values]) > limit, F.lit(False))


def pattern(fvc: Column, fev1: Column, ratio: Column) -> Column:
    """Blank z-scores are null or NaN: each comparison with one fails, so an all-blank row is Normal."""
    low = F.lit(LOWER_LIMIT)
    fvc, fev1, ratio = number(fvc), number(fev1), number(ratio)
    return (
        F.when((ratio >= low) & (fvc >= low) & (fev1 < low), "Isolated").when((ratio < low) & (fvc >= low), "Obstructive")
        .when((ratio >= low) & (fvc < low), "Restrictive").when((ratio < low) & (fvc < low), "Mixed").otherwise("Normal")
    )


def severity(kind: Column, fev1: Column) -> Column:
    fev1 = number(fev1)
    return F.when(kind == "Normal", "normal").when(fev1 >= MILD, "mild").when(fev1 >= MODERATE, "moderate").otherwise("severe")


def sentence(kind: Column, degree: Column, bmi: Column) -> Column:
    """The sentence of a pattern and a severity; a missing or NaN BMI adds nothing."""
    bmi = number(bmi)
    # Sentences of the report (fixed values).
    advice = "perform lung volumes & diffusion capacity if clinically indicated."
    heavy = F.when(bmi >= RAISED_BMI, F.concat(F.lit(" The restrictive picture may be contributed by raised BMI (BMI "), bmi.cast("int").cast("string"), F.lit(")."))).otherwise("")
    limits = lambda how, lead: F.concat(degree, F.lit(f" ventilatory limitation which appears to be {how} in pattern.\nSuggest to correlate clinically for possibility of {lead}restrictive lung disease and {advice}"), heavy)
    return (
        F.when(kind == "Isolated", F.concat(degree, F.lit(" ventilatory limitation (isolated reduced FEV1).")))
        .when(kind == "Obstructive", F.concat(degree, F.lit(" airflow obstruction.")))
        .when(kind == "Restrictive", limits("restrictive", ""))
        .when(kind == "Mixed", limits("both obstructive and restrictive", "concomitant "))
        .otherwise(F.concat(degree, F.lit(" limits")))
    )


def combined(pre: Column, post: Column, same: Column, post_present: Column) -> Column:
    return (
        F.when(~post_present, F.concat(F.lit("Spirometry demonstrates "), pre))
        .when(same, F.concat(F.lit("Both pre- and post- bronchodilator spirometry demonstrate "), pre))
        .otherwise(F.concat(F.lit("Pre- bronchodilator spirometry demonstrates "), pre, F.lit("\nPost- bronchodilator spirometry demonstrates "), post))
    )


def bronchodilator(changed: Column) -> Column:
    return F.concat(
        F.when(changed, "There is Significant").otherwise("There is no significant"), F.lit(" bronchodilator response to 400mcg of inhaled Salbutamol.")
    )


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def clamp(c: Column, low, high) -> Column:
    """Within low and high, numbers or columns; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def over_threshold(logit: Column, limit: float = 0.5) -> Column:
    """Whether the sigmoid of a model's output is over the limit."""
    return sigmoid(logit) > limit


def overall_label(expiratory: Column, inspiratory: Column) -> Column:
    """One label of two truncation flags; a missing flag counts as not set. The words are fixed values."""
    e, i = F.coalesce(expiratory, F.lit(False)), F.coalesce(inspiratory, F.lit(False))
    return F.when(e & i, "Expiratory + Inspiratory truncation").when(e, "Expiratory truncation").when(i, "Inspiratory truncation").otherwise("Normal")


def z_target(best: Column, pred: Column, lln: Column, pct: Column | None = None) -> Column:
    """The z-score that BEST implies, from Pred at 0 and LLN at -1.64, within +-10; null unless the three are plausible.

    With pct, the %Pred, an implausible row falls back to (pct - 100) / 15, within +-6, where BEST is clearly off Pred.
    """
    width = pred - lln
    sound = (pred > lln) & (lln > 0) & (width >= 0.05) & (lln / F.nullif(pred, F.lit(0.0))).between(0.15, 1.10) & (best / F.nullif(pred, F.lit(0.0))).between(0.05, 2.50)
    strong = F.when(sound, clamp(F.when(best >= lln, (best - pred) / width * 1.64).otherwise(-1.64 - (lln - best) / width * 1.64), -10.0, 10.0))
    if pct is None:
        return strong
    clear = F.abs(best - pred) >= F.greatest(F.lit(0.02), 0.01 * F.greatest(F.lit(1.0), F.abs(pred)))
    return F.coalesce(strong, F.when(clear, clamp((pct - 100.0) / 15.0, -6.0, 6.0)))
