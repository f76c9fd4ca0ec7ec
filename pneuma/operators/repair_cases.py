"""The repair chain of repair.py over whole cases: the rules over several rows are looked at on one row a case, with a column
for each BEST cell that they read, and need no window; those over one row only on the five rows that they can change.

The first are said in SQL, as many expressions take many calls to put together otherwise; the second are those of repair.py.
test_growth.py holds the chain against repair.repair().
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import ANY_MEASURE, BEST_MEASURES, BESTS, COLUMNS, GRADES, HEADINGS, MEASURES, RESTRICTED, ROWS, num
from . import repair
from .repair import AFRESH, AGAIN, DERIVE, POST, REALIGN, SPLIT

# Rows with all columns, and of them those that others follow from (fixed values); MVV holds nothing.
_FREE = [m for m in ROWS if m not in RESTRICTED and m != "MVV"]
_TOP = ["FVC", "FEV1", "FEV1/FVC"]
_FLAT = [*_TOP, "VC", "FEV1/VC", *GRADES, "FET"]
_NUMBERS = [(m, c) for m in (*_TOP, "FEV1/VC") for c in BESTS] + [(m, "pct_chg") for m in _TOP]
_TOLD = [*_TOP, "FEV1/VC", "FET"]
_NONE = "cast(array() as array<struct<seq:int,turn:int,message:string>>)"


class _Put(NamedTuple):
    """What a rule puts into a cell, null where it doesn't; its warning, if any, where told holds, among those of row at."""

    row: str
    column: str
    value: str
    message: str = ""
    told: str = "true"
    turn: int = 0
    at: str = ""

    @property
    def name(self) -> str:
        return f"`put {self.row} {self.column}`"


def _c(row: str, column: str) -> str:
    return f"`{row} {column}`"


def _n(row: str, column: str) -> str:
    return f"`n {row} {column}`"


def _some(x: str) -> str:
    return f"if({x} = 0, null, {x})"


def _fixed(x: str, decimals: int) -> str:
    return f"format_number({x}, '0.{'0' * decimals}')"


def _blank(c: str) -> str:
    return rf"not {c} rlike r'(?U)\S'"


def _float(c: str) -> str:
    return rf"if({c} = '', null, try_cast(regexp_extract(translate({c}, ',', '.'), r'[-+]?\d+(\.\d+)?', 0) as double))"


def _shown(x: str, row: str) -> str:
    """cells.shown() for a BEST cell of a row that is known."""
    kind, low, high, decimals = MEASURES.get(row, BEST_MEASURES.get(row, ANY_MEASURE))
    text = f"cast(cast(bround({x}, 0) as bigint) as string)" if kind == "int" else _fixed(x, 1 if decimals == 1 else 2)
    return f"case when {x} between {low}D and {high}D then {text} end"


def _with(df: DataFrame, columns: dict[str, str], drop: tuple[str, ...] = ()) -> DataFrame:
    """df with columns added or replaced, all from the values as they were."""
    kept = [columns.get(f"`{c}`", f"`{c}`") + f" as `{c}`" for c in df.columns if f"`{c}`" not in drop]
    return df.selectExpr(*kept, *[f"{x} as {c}" for c, x in columns.items() if c.strip("`") not in df.columns])


def _changed(df: DataFrame, rule: int, puts: list[_Put], drop: tuple[str, ...] = ()) -> DataFrame:
    df = _with(df, {p.name: p.value for p in puts})
    out, notes = {}, {}
    for p in puts:
        out[_c(p.row, p.column)] = f"coalesce({p.name}, {_c(p.row, p.column)})"
        if (p.row, p.column) in _NUMBERS:
            out[_n(p.row, p.column)] = f"case when {p.name} is null then {_n(p.row, p.column)} when {p.name} rlike '[0-9]' then try_cast({p.name} as double) end"
        if p.message:
            at = p.at or p.row
            note = f"named_struct('seq', {rule}, 'turn', {p.turn}, 'message', {p.message})"
            notes.setdefault(at, []).append((f"{p.name} is not null and {p.told}", note))
    for at, told in notes.items():
        new = ", ".join(f"if({when}, array({note}), {_NONE})" for when, note in told)
        out[f"`notes {at}`"] = f"if({' or '.join(f'({when})' for when, _ in told)}, concat(`notes {at}`, {new}), `notes {at}`)"
    return _with(df, out, drop=(*[p.name for p in puts], *drop))


def wide(df: DataFrame, key: str = "case_no") -> DataFrame:
    """One row a case from a grid: its rows as structs, of repeated ones the least, the cells of _FLAT as columns, the
    numbers that the rules need beside them, and no warnings yet."""
    cells = F.struct(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in COLUMNS])
    cases = df.groupBy(key).agg(*[F.min(F.when(F.col("metric") == m, cells)).alias(m) for m in ROWS if m != "MVV"])
    flat = cases.selectExpr("*", *[f"coalesce(`{m}`.{c}, '') as {_c(m, c)}" for m in _FLAT for c in BESTS])
    held = lambda m, c: F.col(_c(m, c)) if c in BESTS else F.col(f"`{m}`.{c}")
    return flat.select("*", *[num(held(m, c)).alias(_n(m, c).strip("`")) for m, c in _NUMBERS], *[F.expr(_NONE).alias(f"notes {m}") for m in _TOLD])


def _split(df: DataFrame) -> DataFrame:
    strict = r"r'^\s*([A-Fa-f])\s+([-+]?\d+(?:\.\d+)?)\s*$'"
    for turn, name in enumerate(GRADES):
        puts = []
        for i, side in enumerate(BESTS):
            c = _c(name, side)
            exact, loose = f"{c} rlike {strict}", rf"upper({c}) rlike '[A-F]' and {c} rlike r'\d'"
            letter = rf"regexp_extract(upper({c}), r'(?U)\b([A-F])\b', 1)"
            grade = f"case when {c} = '' then null when {exact} then upper(regexp_extract({c}, {strict}, 1)) when {loose} then if({letter} = '', null, {letter}) end"
            number = f"case when {c} = '' or not ({_blank(_c('FET', side))}) then null when {exact} then regexp_extract({c}, {strict}, 2) when {loose} then {_fixed(_float(c), 2)} end"
            how = f"concat(if({exact}, 'Grade splitter: moved ', 'Grade splitter (soft): moved '), `put FET {side}`, ' from {name}/{HEADINGS[side]} to FET/{HEADINGS[side]}')"
            puts += [_Put(name, side, grade), _Put("FET", side, number, how, turn=2 * turn + i)]
        df = _changed(df, SPLIT, puts)
    return df


def _realign(df: DataFrame) -> DataFrame:
    two, puts = {}, []
    for i, side in enumerate(BESTS):
        ratio, pair = _c("FEV1/FVC", side), f"`two {side}`"
        found = rf"regexp_extract_all({ratio}, r'([-+]?\d+(?:\.\d+)?)', 1)"
        two[pair] = f"case when {ratio} <> '' and {_blank(_c('FVC', side))} and {_blank(_c('FEV1', side))} then if(size({found}) >= 2, slice({found}, 1, 2), null) end"
        message = f"concat('Row realign: pulled ', array_join({pair}, ','), ' from FEV1/FVC/{HEADINGS[side]} into FVC+FEV1')"
        puts += [_Put("FVC", side, f"{pair}[0]"), _Put("FEV1", side, f"{pair}[1]"), _Put("FEV1/FVC", side, f"if({pair} is null, null, '')", message, turn=i)]
    return _changed(_with(df, two), REALIGN, puts, drop=tuple(two))


def _derive(df: DataFrame, *rules: int) -> DataFrame:
    """FEV1/FVC and FEV1/VC by one rule after another; what they follow from stays meanwhile."""
    due = {}
    for side in BESTS:
        due |= {f"`of {m} {side}`": _float(_c(m, side)) for m in ("FVC", "FEV1", "VC")}
    df = _with(df, due)
    x = lambda side, m: f"{_some(f'`of FEV1 {side}`')} / {_some(f'`of {m} {side}`')} * 100D"
    df = _with(df, {f"`due {m} {side}`": f"bround({x(side, m)}, 0)" if m == "FVC" else x(side, m) for side in BESTS for m in ("FVC", "VC")}, drop=tuple(due))
    for k, rule in enumerate(rules):
        puts = []
        for i, side in enumerate(BESTS):
            for m in ("FVC", "VC"):
                row, to = f"FEV1/{m}", f"`due {m} {side}`"
                now = _n(row, side)
                text = f"cast(cast({to} as bigint) as string)" if m == "FVC" else _fixed(to, 2)
                put = f"case when {to} is not null and ({now} is null or {now} < 20 or {now} > 150 or abs({now} - {to}) >= 8) then {text} end"
                puts.append(_Put(row, side, put, f"concat('Derived {HEADINGS[side]} {row}=', `put {row} {side}`)", turn=i))
        df = _changed(df, rule, puts, drop=tuple(f"`due {m} {side}`" for side in BESTS for m in ("FVC", "VC")) if k == len(rules) - 1 else ())
    return df


def _post_from_change(df: DataFrame) -> DataFrame:
    puts = []
    for m in _TOP:
        pre, post, chg = _some(_n(m, "pre_best")), _n(m, "post_best"), _n(m, "pct_chg")
        off = f"{pre} is not null and {chg} is not null and ({post} is null or {post} / {pre} < 0.3D or {post} / {pre} > 2D)"
        put = f"case when {off} then {_shown(f'({pre} * (1D + {chg} / 100D))', m)} end"
        puts.append(_Put(m, "post_best", put, f"concat('POST-BEST fix: {m} replaced ', {_fixed(post, 2)}, '->', {_fixed(f'try_cast(`put {m} post_best` as double)', 2)}, ' using %CHG')", f"{post} is not null"))
    return _changed(df, POST, puts)


def _row(row_no: int, m: str) -> str:
    """A row of a case as it stands after the rules over several rows."""
    def cell(c: str) -> str:
        if m == "MVV" or (m not in _FREE and c not in BESTS):
            return "''"
        return _c(m, c) if m in _FLAT and c in BESTS else f"coalesce(`{m}`.{c}, '')"

    return f"{row_no} as row_no, '{m}' as metric, {', '.join(f'{cell(c)} as {c}' for c in COLUMNS)}, {f'`notes {m}`' if m in _TOLD else _NONE} as _notes"


def _mended(df: DataFrame, strict: bool, key: str) -> DataFrame:
    """The rows of _FREE with all rules done; the last of a case carries the others as _rest."""
    df = _derive(_realign(_split(wide(df, key))), DERIVE, AFRESH)
    df = _derive(_post_from_change(df), AGAIN)
    rest = f"array({', '.join(f'struct({_row(k, m)})' for k, m in enumerate(ROWS, 1) if m not in _FREE)})"
    each = [f"struct({_row(k, m)}, {'' if m == _FREE[-1] else 'if(true, null, '}{rest}{'' if m == _FREE[-1] else ')'} as _rest)" for k, m in enumerate(ROWS, 1) if m in _FREE]
    df = df.selectExpr(f"`{key}`", f"array({', '.join(each)}) as _rows").selectExpr(f"`{key}`", "inline_outer(_rows)")
    df = df.withColumns({f"_n_{c}": num(F.col(c)) for c in COLUMNS})
    df = repair._post_from_change(repair._scale_lln(df), but=_TOP)
    for rule in (repair._fill_percent, repair._fill_best, repair._fill_change, repair._flip_sign, *([repair._blank_contradictions] if strict else [])):
        df = rule(df)
    return df.withColumn("_notes", F.sort_array("_notes"))


def rows(df: DataFrame, strict: bool = False, key: str = "case_no") -> DataFrame:
    """All rules in order over the cases of a grid, which needn't be complete: what repair.repair(repair.complete(df)) gives."""
    own = f"struct(row_no, metric, {', '.join(COLUMNS)}, _notes)"
    # inline_outer: for inline() the optimizer asks for arrays that aren't empty, and says all rules again in that question.
    put = _mended(df, strict, key).selectExpr(f"`{key}`", f"if(_rest is null, array({own}), concat(array({own}), _rest)) as _rows")
    return put.selectExpr(f"`{key}`", "inline_outer(_rows)").withColumnRenamed("_notes", "warnings")


def quality(df: DataFrame, strict: bool = False, key: str = "case_no") -> DataFrame:
    """repair.quality() of the mended rows of a grid."""
    held = rf"int(concat({', '.join(COLUMNS)}) rlike r'(?U)\S')"
    others = [k for k, m in enumerate(ROWS, 1) if m not in _FREE]
    full = " + ".join(rf"int(concat(_rest[{i}].pre_best, _rest[{i}].post_best) rlike r'(?U)\S')" for i in range(len(others)))
    narrow = _mended(df, strict, key).selectExpr(f"`{key}`", "row_no", f"bigint({held} + if(_rest is null, 0, {full})) as _found", "_notes", "_rest._notes as _others")
    mine = [k for k, m in enumerate(ROWS, 1) if m in _FREE]
    told = narrow.groupBy(key).agg(F.sum("_found").alias("rows_found"), F.max("_others").alias("_others"), *[F.max(F.when(F.col("row_no") == k, F.col("_notes"))).alias(f"_notes_{k}") for k in mine])
    arrays = {k: f"_notes_{k}" for k in mine} | {k: f"_others[{i}]" for i, k in enumerate(others) if ROWS[k - 1] in _TOLD}
    numbered = ", ".join(f"transform({x}, n -> struct(n.seq, n.turn, {k} as row, n.message))" for k, x in arrays.items())
    return told.selectExpr(f"`{key}`", "rows_found", f"sort_array(concat({numbered})) as _notes").selectExpr(f"`{key}`", "rows_found", "_notes.message as warnings")
