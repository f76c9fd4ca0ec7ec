"""Consistency rules over the text grid of a case, as expressions; their order matters.

A grid has one row for each case and metric, the columns of cells.COLUMNS as texts (blank or null: missing) and
`warnings`, an array of (seq, message) that the rules append to. Rules over one row are projections; rules over several
rows of a case are windows over the case, so the whole chain needs one shuffle by case. complete() gives each case all
its rows; without it, of repeated rows each is mended by itself, the largest text standing for its siblings.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import BESTS, COLUMNS, GRADES, HEADINGS, RESTRICTED, ROWS, blank, cell_spec, let, normalise, num, shown
from ..functions.text import fixed, parse_float, parse_grade

_SIDES = [("pre_best", "pre_pct", "pre_z"), ("post_best", "post_pct", "post_z")]
# Rules by number, as their warnings come (fixed values). The rules of several rows run twice at first.
SPLIT, REALIGN, DERIVE, AFRESH, SCALE, POST, AGAIN, PERCENT, BEST, CHANGE, SIGN, STRICT = range(12)
_NOTES = "array<struct<seq:int,turn:int,message:string>>"


def grid(df: DataFrame) -> DataFrame:
    """df with blank texts for null cells, the number of each cell beside it as _n_<column>, and no warnings yet."""
    df = df.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in COLUMNS})
    return df.withColumns({f"_n_{c}": num(F.col(c)) for c in COLUMNS} | {"_notes": F.array().cast(_NOTES)})


def _n(column: str) -> Column:
    return F.col(f"_n_{column}")


def _changed(df: DataFrame, rule: int, puts: dict[str, Column], message, told=lambda c: F.lit(True), turn: int = 0, drop: tuple[str, ...] = ()) -> DataFrame:
    """df with the texts that are not null put into their columns, and a warning for each where told(column) holds.

    message: from a column and what is put there to a text, of values as they were. A rule takes its columns in turn: all
    rows of the first, from turn on, are told of before those of the next.
    """
    df = df.withColumns({f"_put_{c}": put for c, put in puts.items()})
    out, notes = {}, []
    for i, c in enumerate(puts):
        put = F.col(f"_put_{c}")
        out |= {c: F.coalesce(put, c), f"_n_{c}": F.when(put.isNull(), _n(c)).when(put.rlike("[0-9]"), put.try_cast("double"))}
        notes.append(F.when(put.isNotNull() & told(c), F.struct(F.lit(rule).alias("seq"), F.lit(turn + i).alias("turn"), message(c, put).alias("message"))))
    any_put = functools.reduce(operator.or_, [F.col(f"_put_{c}").isNotNull() for c in puts])
    out["_notes"] = F.when(any_put, let(F.array(*notes), lambda new: F.concat("_notes", F.array_compact(new)))).otherwise(F.col("_notes"))
    return df.select(*[out.get(c, F.col(c)).alias(c) for c in df.columns if not c.startswith("_put_") and c not in drop])


def messages(df: DataFrame) -> DataFrame:
    """The columns as they came, and the warnings in the order of the rules."""
    return df.withColumn("warnings", F.col("_notes")).select(*[c for c in df.columns if not c.startswith("_")], "warnings")


def _words(*parts) -> Column:
    """A message; texts in it are fixed values."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def complete(df: DataFrame, key: str = "case_no") -> DataFrame:
    """All rows of every case in order, as row_no from 1: rows that a case lacks are blank, of repeated ones the least stays.

    One shuffle by case, which the rules over several rows then reuse.
    """
    rows = F.array_sort(F.collect_list(F.struct("metric", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in COLUMNS])))
    cases = df.groupBy(key).agg(rows.alias("_rows"))
    empty = lambda m: F.struct(m.alias("metric"), *[F.lit("").alias(c) for c in COLUMNS])
    whole = F.transform(F.array(*[F.lit(m) for m in ROWS]), lambda m: F.coalesce(F.try_element_at(F.filter("_rows", lambda r: r["metric"] == m), F.lit(1)), empty(m)))
    return cases.select(key, F.posexplode(whole).alias("row_no", "_row")).select(key, (F.col("row_no") + 1).alias("row_no"), "_row.*")


def _free() -> Column:
    return ~F.col("metric").isin(RESTRICTED)


def blank_restricted(df: DataFrame) -> DataFrame:
    """Restricted rows keep only the BEST columns; MVV keeps none."""
    names = ", ".join(f"'{m}'" for m in RESTRICTED)
    gone = lambda c: "metric = 'MVV'" if c in BESTS else f"metric in ('MVV', {names})"
    return df.withColumns({c: F.expr(f"if({gone(c)}, '', {c})") for c in COLUMNS} | {f"_n_{c}": F.expr(f"if({gone(c)}, null, _n_{c})") for c in COLUMNS})


# Rows that others are mended by (fixed values), and the names of their cells beside each row.
_OTHERS = {"fvc": "FVC", "fev1": "FEV1", "ratio": "FEV1/FVC", "vc": "VC", "g0": GRADES[0], "g1": GRADES[1]}
_BESIDE = tuple(f"_{side}_{k}" for side in BESTS for k in _OTHERS)


def _beside(df: DataFrame, key: str) -> DataFrame:
    """df with the BEST cells of the rows of _OTHERS beside each row of their case; one window for all."""
    over = f"over (partition by `{key}`)"
    return df.withColumns({f"_{side}_{k}": F.expr(f"coalesce(max(if(metric = '{m}', {side}, null)) {over}, '')") for side in BESTS for k, m in _OTHERS.items()})


def _split(df: DataFrame) -> DataFrame:
    """"A 10.53" in a grade row: the grade stays, the number goes to a blank FET. The row of FVC comes first."""
    strict = r"^\s*([A-Fa-f])\s+([-+]?\d+(?:\.\d+)?)\s*$"
    metric = F.col("metric")

    def parted(side: str, name: str, c: Column) -> Column:
        exact, loose = c.rlike(strict), F.upper(c).rlike("[A-F]") & c.rlike(r"\d")
        grade = F.when(exact, F.upper(F.regexp_extract(c, strict, 1))).when(loose, parse_grade(c))
        number = F.when(exact, F.regexp_extract(c, strict, 2)).when(loose, fixed(parse_float(c), 2))
        return F.when(metric == name, grade).when((metric == "FET") & blank(F.col(side)), number)

    for turn, (k, name) in enumerate((("g0", GRADES[0]), ("g1", GRADES[1]))):
        moves, exactly = {}, {}
        for side in BESTS:
            cell = F.col(f"_{side}_{k}")
            moves[side] = F.when(metric.isin(name, "FET") & (cell != ""), let(cell, functools.partial(parted, side, name)))
            exactly[side] = cell.rlike(strict)
        how = lambda c, put: _words(F.when(exactly[c], "Grade splitter: moved ").otherwise("Grade splitter (soft): moved "), put, f" from {name}/{HEADINGS[c]} to FET/{HEADINGS[c]}")  # noqa: B023, E731
        df = _changed(df, SPLIT, moves, how, lambda c: metric == "FET", turn=2 * turn)
    return df


def _realign(df: DataFrame) -> DataFrame:
    """FVC and FEV1 blank while FEV1/FVC holds two numbers or more: the first two are theirs."""
    metric = F.col("metric")
    two = {}
    for side in BESTS:
        fvc, fev1, ratio = (F.col(f"_{side}_{k}") for k in ("fvc", "fev1", "ratio"))
        found = let(ratio, lambda c: F.regexp_extract_all(c, F.lit(r"([-+]?\d+(?:\.\d+)?)"), F.lit(1)))
        two[f"_{side}_two"] = F.when(blank(fvc) & blank(fev1) & (ratio != ""), let(found, lambda x: F.when(F.size(x) >= 2, F.slice(x, 1, 2))))
    df = df.withColumns(two)
    pair = lambda side: F.col(f"_{side}_two")
    puts = {side: F.when(pair(side).isNotNull(), F.when(metric == "FVC", pair(side)[0]).when(metric == "FEV1", pair(side)[1]).when(metric == "FEV1/FVC", "")) for side in BESTS}
    df = _changed(df, REALIGN, puts, lambda c, put: _words("Row realign: pulled ", F.array_join(pair(c), ","), f" from FEV1/FVC/{HEADINGS[c]} into FVC+FEV1"), lambda c: metric == "FEV1/FVC")
    beside = {f"_{side}_{k}": F.coalesce(pair(side)[i], F.col(f"_{side}_{k}")) for side in BESTS for i, k in enumerate(("fvc", "fev1"))}
    return df.withColumns(beside).drop(*two)


def _derive(df: DataFrame, rule: int, drop: tuple[str, ...] = ()) -> DataFrame:
    """FEV1/FVC (whole) and FEV1/VC (two decimals) from their sibling rows, where missing, outside 20..150 or off by 8."""
    metric = F.col("metric")
    due = {}
    for side in BESTS:
        of = lambda k: F.nullif(let(F.col(f"_{side}_{k}"), parse_float), F.lit(0.0))  # noqa: B023, E731
        due[f"_{side}_due"] = F.when(metric == "FEV1/FVC", F.bround(of("fev1") / of("fvc") * 100, 0)).when(metric == "FEV1/VC", of("fev1") / of("vc") * 100)
    df = df.withColumns(due)
    puts = {}
    for side in BESTS:
        x, now = F.col(f"_{side}_due"), _n(side)
        off = x.isNotNull() & (now.isNull() | (now < 20) | (now > 150) | (F.abs(now - x) >= 8))
        puts[side] = F.when(off, F.when(metric == "FEV1/FVC", x.cast("long").cast("string")).otherwise(fixed(x, 2)))
    return _changed(df, rule, puts, lambda c, put: _words(f"Derived {HEADINGS[c]} ", metric, "=", put), drop=(*due, *drop))


def _scale_lln(df: DataFrame) -> DataFrame:
    """LLN over 1.10 * Pred is divided by 10, 100 or 1000, whichever first brings it down."""
    lln, pred = _n("lln"), _n("pred")
    down = F.try_element_at(F.filter(F.array(lln / 10, lln / 100, lln / 1000), lambda x: x <= pred * 1.10), F.lit(1))
    df = df.withColumn("_to", F.when((pred > 0) & (lln > pred * 1.10), down))
    put = F.when(F.col("_to").isNotNull(), shown(F.col("_to"), cell_spec("metric", "lln")))
    return _changed(df, SCALE, {"lln": put}, lambda c, put: _words("Constraint fix: ", F.col("metric"), " LLN scaled from ", lln.cast("string"), " to ", F.col("_to").cast("string")), drop=("_to",))


def _post_from_change(df: DataFrame, but: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """POST-BEST from PRE-BEST and %CHG where missing, or under 0.30 or over 2 times PRE-BEST; rows named in but stay."""
    pre, post, chg = F.nullif(_n("pre_best"), F.lit(0.0)), _n("post_best"), _n("pct_chg")
    off = (post.isNull() | (post / pre < 0.30) | (post / pre > 2.0)) & pre.isNotNull() & chg.isNotNull()
    off = off & ~F.col("metric").isin(list(but)) if but else off
    put = F.when(off, shown(pre * (1.0 + chg / 100.0), cell_spec("metric", "post_best")))
    return _changed(df, POST, {"post_best": put}, lambda c, put: _words("POST-BEST fix: ", F.col("metric"), " replaced ", fixed(post, 2), "->", fixed(put.try_cast("double"), 2), " using %CHG"), lambda c: _n(c).isNotNull())


def _fill_percent(df: DataFrame) -> DataFrame:
    """%Pred where missing or off by 6 or more."""
    due = lambda best: _n(best) / F.nullif(_n("pred"), F.lit(0.0)) * 100.0
    puts = {pct: F.when(_free() & (_n(pct).isNull() | (F.abs(_n(pct) - due(best)) >= 6.0)), fixed(due(best), 1)) for best, pct, _ in _SIDES}
    return _changed(df, PERCENT, puts, lambda c, put: _words("%Pred fix: ", F.col("metric"), f" {HEADINGS[c]} replaced ", fixed(_n(c), 1), "->", put), lambda c: _n(c).isNotNull())


def _fill_best(df: DataFrame) -> DataFrame:
    """BEST where missing, or under 0.30 or over 2 times Pred, from %Pred."""
    pred = F.nullif(_n("pred"), F.lit(0.0))
    puts = {best: F.when(_free() & (_n(best).isNull() | (_n(best) / pred > 2.0) | (_n(best) / pred < 0.30)), fixed(pred * (_n(pct) / 100.0), 2)) for best, pct, _ in _SIDES}
    return _changed(df, BEST, puts, lambda c, put: _words("BEST fix: ", F.col("metric"), f" {HEADINGS[c]} replaced ", fixed(_n(c), 2), "->", put, " using %Pred"), lambda c: _n(c).isNotNull())


def _fill_change(df: DataFrame) -> DataFrame:
    """%CHG where missing or off by 1.2 or more."""
    pre, now = F.nullif(_n("pre_best"), F.lit(0.0)), _n("pct_chg")
    due = (_n("post_best") - pre) / pre * 100.0
    put = F.when(_free() & (now.isNull() | (F.abs(now - due) >= 1.2)), fixed(due, 1))
    return _changed(df, CHANGE, {"pct_chg": put}, lambda c, put: _words("%CHG fix: ", F.col("metric"), " %CHG replaced ", fixed(now, 1), "->", put, " from BEST values"), lambda c: now.isNotNull())


def expected_sign(best: Column, pred: Column) -> Column:
    """-1 or 1 as BEST lies clearly under or over Pred; 0 within the dead band; null where either is missing."""
    delta = best - pred
    return F.when(F.abs(delta) >= F.greatest(F.lit(0.02), 0.01 * F.greatest(F.lit(1.0), F.abs(pred))), F.signum(delta).cast("int")).when(delta.isNotNull(), 0)


def _flip_sign(df: DataFrame) -> DataFrame:
    """The sign of z follows that of BEST - Pred, outside a small band."""
    puts = {z: F.when(_free() & (expected_sign(_n(best), _n("pred")) * _n(z) < 0), fixed(-_n(z), 2)) for best, _, z in _SIDES}
    way = lambda put: F.when(put.startswith("-"), "negative (best<pred)").otherwise("positive (best>pred)")
    return _changed(df, SIGN, puts, lambda c, put: _words("Z-sign fix: ", F.col("metric"), f" {HEADINGS[c]} flipped to ", way(put)))


def _blank_contradictions(df: DataFrame) -> DataFrame:
    """Strict mode: a z-score that contradicts BEST against LLN or Pred is blanked, given plausible values."""
    pred, lln = _n("pred"), _n("lln")
    puts, told = {}, {}
    for column, _, name in _SIDES:
        best, z = _n(column), _n(name)
        sound = _free() & (pred > lln) & (lln > 0) & (lln / pred).between(0.15, 1.10) & (best / pred).between(0.05, 2.50)
        low = F.coalesce(sound & (best < lln - 0.01) & (z > -1.20), F.lit(False))
        # let() keeps the conditions out of the code of a whole stage, where they make a method that the JVM does not compile.
        puts[name] = F.when(low | (sound & (best > pred + 0.01) & (z < -0.50)), let(F.col(name), lambda c: F.lit("")))
        tell = lambda against, label, value: _words(f" violates BEST{against} (best=", fixed(best, 2), f", {label}=", fixed(value, 2), ", z=", fixed(z, 2), "); blanked")  # noqa: B023, E731
        told[name] = F.when(low, tell("<LLN", "lln", lln)).otherwise(tell(">Pred", "pred", pred))
    return _changed(df, STRICT, puts, lambda c, put: _words("STRICT: ", F.col("metric"), f" {HEADINGS[c]}", told[c]))


def _rule(step):
    """A rule over one row, by itself: from a grid to a grid with warnings."""

    @functools.wraps(step)
    def alone(df: DataFrame) -> DataFrame:
        return messages(step(grid(df)))

    return alone


def _case_rule(step, *args):
    """A rule over several rows of a case, by itself."""

    @functools.wraps(step)
    def alone(df: DataFrame, key: str = "case_no") -> DataFrame:
        return messages(step(_beside(grid(df), key), *args))

    return alone


split_grades, realign_top, derive_ratios = _case_rule(_split), _case_rule(_realign), _case_rule(_derive, DERIVE)
scale_lln, post_from_change, fill_percent, fill_best = _rule(_scale_lln), _rule(_post_from_change), _rule(_fill_percent), _rule(_fill_best)
fill_change, flip_sign, blank_contradictions = _rule(_fill_change), _rule(_flip_sign), _rule(_blank_contradictions)


def repair(df: DataFrame, strict: bool = False, key: str = "case_no") -> DataFrame:
    """All rules in order.

    The rules over several rows are run on the fresh grid and again before those over one row; splitting and realigning
    find nothing the second time, so only the ratios are derived anew.
    """
    df = _derive(_realign(_split(_beside(blank_restricted(grid(df)), key))), DERIVE)
    df = _derive(df, AFRESH, drop=_BESIDE)
    df = _derive(_beside(_post_from_change(_scale_lln(df)), key), AGAIN, drop=_BESIDE)
    for rule in (_fill_percent, _fill_best, _fill_change, _flip_sign, *([_blank_contradictions] if strict else [])):
        df = rule(df)
    return messages(df)


def quality(df: DataFrame, key: str = "case_no") -> DataFrame:
    """For each case the rows with any content, and its warnings: rule by rule, in each all rows of one column before the
    next."""
    filled = F.exists(F.array(*COLUMNS), lambda c: ~blank(c))
    row = F.array_position(F.array(*[F.lit(m) for m in ROWS]), F.col("metric"))
    notes = F.transform("warnings", lambda w: F.struct(w["seq"], w["turn"], row.alias("row"), w["message"].alias("message")))
    out = df.groupBy(key).agg(F.count_if(filled).alias("rows_found"), F.array_sort(F.flatten(F.collect_list(notes))).alias("notes"))
    return out.select(key, "rows_found", F.transform("notes", lambda n: n["message"]).alias("warnings"))


def suspicious(rows: DataFrame, mode: str = "auto", post: str | None = None) -> DataFrame:
    """rows with a flag re_<column> for each column: cells to be read again, as they hold nothing valid or contradict
    their row.

    Cells that are never read are not flagged: of restricted rows all but BEST, and columns after the bronchodilator where
    the boolean column post (if given) does not hold. mode "force" flags every other cell, and any but "auto" none. A rule
    that needs a missing value does not flag.
    """
    shown_post = F.coalesce(F.col(post), F.lit(False)) if post else F.lit(True)
    seen = {c: (_free() | F.lit(c in BESTS)) & (shown_post if c.startswith("post") or c == "pct_chg" else F.lit(True)) for c in COLUMNS}
    if mode != "auto":
        return rows.withColumns({f"re_{c}": seen[c] & F.lit(mode == "force") for c in COLUMNS})
    none = F.lit(False)
    row = rows.withColumns({f"_{c}": num(F.col(c)) for c in (*BESTS, "pred", "lln")})
    read = {name: F.struct(normalise(F.col(name), cell_spec("metric", name)).alias("text"), cell_spec("metric", name)["kind"].alias("kind")) for name in COLUMNS}
    row = row.withColumns({f"_r_{name}": r for name, r in read.items()})

    def contradicts(name, x):
        v, kind, best, pred, lln, sign = (x[k] for k in ("v", "kind", "best", "pred", "lln", "sign"))
        tests = [(kind == "percent") & (F.abs(v - best / F.nullif(pred, F.lit(0.0)) * 100) >= 5)]
        if name == "pred":
            tests += [v <= lln + 0.01]
        if name == "lln":
            tests += [v > pred + 0.01, (pred > 0) & (v / F.nullif(pred, F.lit(0.0)) < 0.2)]
        tests += [(kind == "zscore") & sign.isNotNull() & t for t in (sign * v < 0, (best < lln - 0.01) & (v > -1.2), F.abs(v) > 6)]
        return F.greatest(*[F.coalesce(t, none) for t in tests])

    flags = {}
    for name in COLUMNS:
        best = F.col("_pre_best" if name in ("lln", "pred", "pre_pct", "pre_z") else "_post_best")
        told = F.col(f"_r_{name}")
        x = F.struct(num(told["text"]).alias("v"), told["kind"].alias("kind"), best.alias("best"), F.col("_pred").alias("pred"), F.col("_lln").alias("lln"), expected_sign(best, F.col("_pred")).alias("sign"))
        flags[f"re_{name}"] = seen[name] & (told["text"].isNull() | let(x, functools.partial(contradicts, name)))
    return row.withColumns(flags).select(*rows.columns, *flags)
