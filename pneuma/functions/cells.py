"""Cells of the measurement grid: what each may hold, and how its text becomes a number."""

from __future__ import annotations

import functools
import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fixed, parse_grade, read

# Rows and columns of the grid, in order (fixed values); a column's name here and its heading.
ROWS = ["FVC", "FEV1", "FEV1/FVC", "VC", "FEV1/VC", "FEF25%-75%", "PEF", "MVV", "Grade FVC N", "Grade FEV1 N", "FET", "FIVC", "BEV"]
HEADINGS = {
    "pre_best": "PRE-BEST", "lln": "LLN", "pred": "Pred", "pre_pct": "Pre_%Pred", "pre_z": "Pre_Z-Score",
    "post_best": "POST-BEST", "post_pct": "Post_%Pred", "post_z": "Post_Z-Score", "pct_chg": "%CHG",
}
COLUMNS = list(HEADINGS)
BESTS = ["pre_best", "post_best"]
# Rows that only hold the BEST columns (fixed values); MVV holds none.
RESTRICTED = ["VC", "FEV1/VC", "Grade FVC N", "Grade FEV1 N", "FET", "FIVC", "BEV"]
GRADES = ["Grade FVC N", "Grade FEV1 N"]
# Kind, least, largest and decimals of BEST, LLN and Pred by row (fixed values).
MEASURES = {
    "FVC": ("float", 0.2, 10.0, 2), "FEV1": ("float", 0.2, 10.0, 2), "VC": ("float", 0.2, 10.0, 2), "FIVC": ("float", 0.2, 10.0, 2),
    "FEV1/FVC": ("int", 20.0, 150.0, None), "FEF25%-75%": ("float", 0.05, 15.0, 2), "PEF": ("float", 0.1, 20.0, 2),
}
BEST_MEASURES = {"FEV1/VC": ("percent", 20.0, 150.0, 2), "FET": ("float", 0.1, 60.0, 2), "BEV": ("float", 0.0, 2.0, 2)}
ANY_MEASURE, PERCENT, ZSCORE, GRADE = ("float", -9999.0, 9999.0, 2), ("percent", -200.0, 400.0, 1), ("zscore", -10.0, 10.0, 2), ("grade", 0.0, 0.0, None)


def strip(c: Column) -> Column:
    text = F.coalesce(c, F.lit(""))
    return F.when(text.rlike(r"(?U)^\s|\s$"), F.regexp_replace(text, r"(?U)^\s+|\s+$", "")).otherwise(text)


def blank(c: Column) -> Column:
    return ~F.coalesce(c, F.lit("")).rlike(r"(?U)\S")


def let(value: Column, use) -> Column:
    """use(value), with the value computed once however often use() names it.

    It also keeps use() out of the code of a whole stage, where a long expression in each of many columns makes a method
    that the JVM does not compile.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def _spec(values: tuple) -> str:
    kind, low, high, decimals = values
    return f"named_struct('kind', '{kind}', 'lo', {low}D, 'hi', {high}D, 'decimals', cast({'null' if decimals is None else decimals} as int))"


def cell_spec(metric: str, column: str) -> Column:
    """Kind, lo, hi and decimals of a cell, by its row, which the column metric names; null where a cell holds nothing that
    can be checked. Said in SQL, as a long expression takes many calls to put together otherwise."""
    rules = [f"when {metric} = 'MVV' then null"]
    if column in BESTS:
        rules += [f"when {metric} = '{m}' then {_spec(v)}" for m, v in (dict.fromkeys(GRADES, GRADE) | BEST_MEASURES).items()]
    rest = PERCENT if column in ("pre_pct", "post_pct", "pct_chg") else ZSCORE if column in ("pre_z", "post_z") else ANY_MEASURE
    if rest is ANY_MEASURE:
        rules += [f"when {metric} = '{m}' then {_spec(v)}" for m, v in MEASURES.items()]
    return F.expr(f"case {' '.join(rules)} else {_spec(rest)} end")


def _noisy(c: Column) -> Column:
    s = F.translate(strip(c), ",", ".")
    s = F.regexp_replace(s, r"^\s*([+-]?\d+)\s+(\d{1,3})\s*$", "$1.$2")
    s = F.regexp_replace(s, r"[^0-9eE.+-]", "")
    return read(F.regexp_extract(s, r"[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?", 0))


def num(c: Column) -> Column:
    """The number in a noisy text: "-0 49" is -0.49, a comma is a point, other signs are passed over; null if none.

    Most cells are blank or plain numbers, which need no mending.
    """
    return F.when(c.isNull() | (c == ""), F.lit(None).cast("double")).when(c.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?$"), c.try_cast("double")).otherwise(let(c, _noisy))


def strict_num(c: Column) -> Column:
    """A cell that is a number as a whole; null if it isn't, and NaN stays. blank() tells a blank cell from another text."""
    return read(strip(c))


def pick(c: Column, spec: Column) -> Column:
    """Of several numbers in a cell the one that suits it: the last decimal where decimals are due, the last whole number
    in range for whole ones, else the last."""
    found = F.regexp_extract_all(F.translate(strip(c), ",", "."), F.lit(r"([-+]?\d+(?:\.\d+)?)"), F.lit(1))
    pointed = lambda xs: F.filter(xs, lambda x: F.contains(x, F.lit(".")))
    whole = lambda xs: F.filter(xs, lambda x: ~F.contains(x, F.lit(".")) & x.try_cast("double").between(spec["lo"], spec["hi"]))
    last = lambda xs: F.try_element_at(xs, F.lit(-1))
    return let(found, lambda xs: F.coalesce(F.when(spec["decimals"].isNotNull(), last(pointed(xs))), F.when(spec["kind"] == "int", last(whole(xs))), last(xs)))


def _shown(value: Column, spec: Column) -> Column:
    text = F.when(spec["kind"] == "int", F.bround(value, 0).cast("long").cast("string")).when(spec["decimals"] == 1, fixed(value, 1)).otherwise(fixed(value, 2))
    return F.when((spec["kind"] != "grade") & value.between(spec["lo"], spec["hi"]), text)


def shown(value: Column, spec: Column) -> Column:
    """A number as the cell's text: null if it is out of range, else whole (halves to even) or with the cell's decimals."""
    return let(F.struct(value.alias("v"), spec.alias("spec")), lambda x: _shown(x["v"], x["spec"]))


def _mended(chosen: Column, spec: Column) -> Column:
    digits = F.char_length(F.regexp_replace(chosen, "[^0-9]", ""))
    pointless = spec["kind"].isin("float", "percent", "zscore") & (digits > 0) & ~chosen.rlike("[.,]")
    hundred_first = (spec["decimals"] == 2) & (digits >= 2)
    inside = lambda x: x.between(spec["lo"], spec["hi"])
    tries = lambda v: F.when(hundred_first, F.array(v / 100, v / 10, v / 1000)).otherwise(F.array(v / 10, v / 100, v / 1000))
    return let(num(chosen), lambda v: F.when(pointless & ~inside(v), F.coalesce(F.try_element_at(F.filter(tries(v), inside), F.lit(1)), v)).otherwise(v))


# Numbers written as shown() writes them: with two decimals, with one, or whole (fixed values).
_TWO, _ONE, _WHOLE = (rf"^(?!-[0.]+\z)-?(?:0|[1-9][0-9]{{0,8}}){tail}\z" for tail in (r"\.[0-9]{2}", r"\.[0-9]", ""))


def _noisy_cell(c: Column, spec: Column) -> Column:
    def checked(x: Column) -> Column:
        text, rule = x["text"], x["spec"]
        value = let(F.coalesce(pick(text, rule), text), lambda chosen: _mended(chosen, rule))
        return F.when((text == "") | rule.isNull(), F.lit(None)).when(rule["kind"] == "grade", parse_grade(text)).otherwise(let(value, lambda v: _shown(v, rule)))

    return let(F.struct(strip(c).alias("text"), spec.alias("spec")), checked)


def normalise(c: Column, spec: Column) -> Column:
    """The cell's text in its normal form, or null if it holds nothing valid.

    A number without a point that is out of range is tried with a point one to three places in. Most cells are blank, in
    their normal form or whole numbers, and need none of the steps for noisy ones.
    """
    t = F.replace(c, F.lit(","), F.lit("."))
    kind, decimals, v = spec["kind"], spec["decimals"], t.try_cast("double")
    inside = lambda x: x.between(spec["lo"], spec["hi"])
    normal = ((decimals == 2) & t.rlike(_TWO)) | ((decimals == 1) & t.rlike(_ONE)) | ((kind == "int") & t.rlike(_WHOLE))
    whole = kind.isin("float", "percent", "zscore") & c.rlike(_WHOLE)
    hundred_first = (decimals == 2) & ~c.rlike("^-?[0-9]$")
    put = lambda x: F.when(decimals == 1, fixed(x, 1)).otherwise(fixed(x, 2))
    pointed = F.when(inside(v), v).when(hundred_first & inside(v / 100), v / 100).when(inside(v / 10), v / 10).when(inside(v / 100), v / 100).when(inside(v / 1000), v / 1000)
    return (
        F.when(c.isNull() | (c == "") | spec.isNull(), F.lit(None).cast("string"))
        .when(F.coalesce(normal, F.lit(False)), F.when(inside(v), t))
        .when(F.coalesce(whole, F.lit(False)), put(pointed))
        .otherwise(_noisy_cell(c, spec))
    )


# The numbers of a text, a grade that stands alone, and white space as (?U)\\s has it (fixed values).
_NUMBERS, _LETTER = re.compile(r"[-+]?[0-9]+(?:\.[0-9]+)?"), re.compile(r"\b[A-F]\b")
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def cell_rule(metric: str | None, column: str) -> tuple | None:
    """The values of cell_spec(), for a task's own use."""
    if metric == "MVV":
        return None
    if column in BESTS and metric in (special := dict.fromkeys(GRADES, GRADE) | BEST_MEASURES):
        return special[metric]
    if column in ("pre_pct", "post_pct", "pct_chg"):
        return PERCENT
    return ZSCORE if column in ("pre_z", "post_z") else MEASURES.get(metric, ANY_MEASURE)


def normal_form(text: str | None, rule: tuple | None) -> tuple[str, float] | None:
    """normalise() of one text and the number of that form (NaN of a grade), or None if it holds nothing valid.

    For tasks that take the different texts of a batch. Those of cells are short and few, so the forms of some are kept.
    """
    return None if not text or rule is None else _kept_form(text, rule) if len(text) <= 32 else _normal_form(text, rule)


def _normal_form(text: str, rule: tuple) -> tuple[str, float] | None:
    kind, low, high, decimals = rule
    if kind == "grade":
        return (letter[0], math.nan) if (letter := _LETTER.search(text.upper())) else None
    found = _NUMBERS.findall(text.replace(",", "."))
    suits = (lambda x: "." in x) if decimals is not None else (lambda x: "." not in x and low <= float(x) <= high)
    if not found:
        return None
    chosen = next(filter(suits, reversed(found)), found[-1])
    value = float(chosen)
    if decimals is not None and "." not in chosen and not low <= value <= high:
        tries = (100, 10, 1000) if decimals == 2 and len(chosen.lstrip("+-")) > 1 else (10, 100, 1000)
        value = next((value / x for x in tries if low <= value / x <= high), value)
    if not low <= value <= high:
        return None
    form = str(round(value)) if kind == "int" else f"{value:.{1 if decimals == 1 else 2}f}"
    return form, float(form)


_kept_form = functools.lru_cache(1 << 16)(_normal_form)
