"""Choice among several readings of a cell by what its row and its siblings make likely."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import COLUMNS, HEADINGS, SPACES, cell_rule, cell_spec, normal_form, normalise, num, strip
from ..functions.clinical import z_target
from .repair import expected_sign

_CONTEXT = ["pre_best", "post_best", "pred", "lln", "pre_pct", "post_pct"]
_BEFORE = [HEADINGS[c] for c in ("pre_pct", "pre_z", "pred", "lln")]
# The facts that each part of a score takes.
_NEEDED = {"zscore": ("sign", "target", "clear", "low"), "lower": ("lower", "pred"), "own_pred": ("lln",)}
# Points of a cell whose decimals are known (a fixed value).
_KNOWN = 0.60


def _put(test: Column, then, other=0.0) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), then).otherwise(other)


def _context(grid: DataFrame, key: str, *more) -> DataFrame:
    """Numbers of a row of the grid; a comma is a point for num() too, and put first it leaves most texts plain."""
    return grid.select(key, "metric", *[num(F.replace(F.col(c), F.lit(","), F.lit("."))).alias(f"_{c}") for c in _CONTEXT], *more)


def _facts(col: Column) -> dict[str, Column]:
    """What a row of _context tells of a cell by its heading, for _score()."""
    best, pct = F.when(col.isin(_BEFORE), F.col("_pre_best")).otherwise(F.col("_post_best")), F.when(col.startswith("Pre_"), F.col("_pre_pct")).otherwise(F.col("_post_pct"))
    pred, lln = F.col("_pred"), F.col("_lln")
    clear = F.abs(best - pred) >= F.greatest(F.lit(0.06), 0.03 * F.greatest(F.lit(1.0), F.abs(pred)))
    lower = (col == "LLN") & (pred > 0) & (F.col("metric") != "FEV1/FVC")
    return {"sign": expected_sign(best, pred), "target": z_target(best, pred, lln, pct), "clear": clear, "low": best < lln - 0.01, "lower": lower, "pred": F.nullif(pred, F.lit(0.0)), "lln": lln}


def _score(v, own, of: dict, put=_put, size=F.abs, parts=tuple(_NEEDED)):
    """How unlikely a value is, by _facts() and by the parts that its heading has; own are the points of the cell's kind.

    Of columns, or, with their put() and size(), of arrays, where NaN is null.
    """
    if "own_pred" in parts:
        own = own + put(of["own_pred"] & (v <= of["lln"] + 0.01), 5.0)
    score = own
    if "zscore" in parts:
        sign, target, clear, low = (of[k] for k in _NEEDED["zscore"])
        of_z = (
            own + put(sign * v < 0, 6.0) + put((sign != 0) & (size(v) < 0.15) & clear, 2.5) + put(low & (v > -1.20), 6.0)
            + put(target == target, 0.75 * size(v - target)) + put((size(target) >= 1.0) & (size(v) < 0.35), 1.5) + put(size(v) > 6.0, 3.0)
        )
        score = put(of["zscore"], of_z, own)
    if "lower" in parts:
        score = score + put(of["lower"], put(v / of["pred"] < 0.30, 4.0) + put(v > of["pred"], 2.0))
    return score


def _ranked(rows: DataFrame, key: str) -> DataFrame:
    """rows of _context with col and readings, an array of (cand_pos, text): with the best of each row's readings as _best
    (score, rarity, cand_pos, norm), the first as _first (cand_pos, text), and whether the column can be checked."""
    col = F.col("col")
    rows = rows.withColumn("_spec", F.coalesce(*[F.when(col == HEADINGS[c], cell_spec("metric", c)) for c in COLUMNS]))
    facts = _facts(col) | {"zscore": F.col("_spec.kind") == "zscore", "own_pred": col == "Pred", "points": _put(F.col("_spec.decimals").isNotNull(), _KNOWN)}
    rows = rows.withColumns({f"_is_{k}": v for k, v in facts.items()})
    score = lambda v: _score(v, F.col("_is_points"), {k: F.col(f"_is_{k}") for k in facts})

    read = F.transform("readings", lambda r: F.struct(r["cand_pos"].alias("cand_pos"), normalise(r["text"], F.col("_spec")).alias("norm")))
    rows = rows.withColumn("_read", F.transform(read, lambda r: F.struct(r["cand_pos"].alias("cand_pos"), r["norm"].alias("norm"), num(r["norm"]).alias("v"))))
    often = lambda r: F.size(F.filter("_read", lambda other: other["norm"] == r["norm"]))
    scored = F.transform(F.filter("_read", lambda r: r["v"].isNotNull()), lambda r: F.struct(score(r["v"]).alias("score"), (-often(r)).alias("rarity"), r["cand_pos"].alias("cand_pos"), r["norm"].alias("norm")))
    first = F.array_min(F.transform("readings", lambda r: F.struct(r["cand_pos"].alias("cand_pos"), strip(r["text"]).alias("text"))))
    return rows.select(key, "metric", "col", F.array_min(scored).alias("_best"), first.alias("_first"), F.col("_spec").isNotNull().alias("_checked"))


def _told(ranked: DataFrame, key: str) -> DataFrame:
    chosen = F.col("_best.norm")
    return ranked.select(key, "metric", "col", F.coalesce(chosen, "_first.text").alias("text"), (chosen.isNotNull() | ~F.col("_checked")).alias("ok"))


def rank_columns(grid: DataFrame, readings: dict[str, list[str]], key: str = "case_no") -> DataFrame:
    """rank_candidates() for readings in columns of the grid: readings names, for each heading, the columns that hold them,
    in order. Rows of the grid are unique; none is moved.

    Spark does not compile functions of arrays, which take most of the time of the other two. Here the rows of an Arrow
    batch are taken together: each different text of a column is read once, and numpy scores all readings.
    """
    import numpy as np

    columns = {h: next(c for c in COLUMNS if HEADINGS[c] == h) for h in readings}
    parts = {h: [p for p, due in (("zscore", c in ("pre_z", "post_z")), ("lower", h == "LLN"), ("own_pred", h == "Pred")) if due] for h, c in columns.items()}
    facts = {h: [name for p in parts[h] for name in _NEEDED[p]] for h in readings}
    place, texts = {h: k for k, h in enumerate(readings)}, list(dict.fromkeys(c for cs in readings.values() for c in cs))
    rows = _context(grid, key, *[F.col(c).alias(f"_as_{c}") for c in texts])
    rows = rows.select(key, "metric", *[f"_as_{c}" for c in texts], *[_facts(F.lit(h))[name].cast("double").alias(f"_{name}_{place[h]}") for h, names in facts.items() for name in names])
    put = lambda test, then, other=0.0: np.where(test, then, other)

    def coded(column):
        """The different values of a column, None last, and the place of each row's."""
        held = column.dictionary_encode()
        values = held.dictionary.to_pylist()
        return [*values, None], held.indices.fill_null(len(values)).to_numpy(zero_copy_only=False)

    def read(values, at, rules, rule_at, forms):
        """The place in forms of each row's normal form, -1 if it has none, and its number. New forms are added."""
        each, size = rule_at * len(values) + at, len(rules) * len(values)
        form, number = np.full(size, -1), np.full(size, np.nan)
        for x in np.flatnonzero(np.bincount(each, minlength=size)).tolist():
            if found := normal_form(values[x % len(values)], rules[x // len(values)]):
                form[x], number[x] = forms.setdefault(found[0], len(forms)), found[1]
        return form[each], number[each]

    def best(seen, own, of, kinds):
        """The form of each row's likeliest reading, -1 if none is valid."""
        chosen, least, most = np.full(len(own), -1), np.full(len(own), np.inf), np.zeros(len(own), int)
        for form, v in seen:
            score, often = _score(v, own, of, put, np.abs, kinds), sum(other == form for other, _ in seen)
            closer = ~np.isnan(v) & ((chosen < 0) | (score < least) | ((score == least) & (often > most)))
            chosen, least, most = np.where(closer, form, chosen), np.where(closer, score, least), np.where(closer, often, most)
        return chosen

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            (metrics, metric_at), held = coded(batch.column("metric")), {c: coded(batch.column(f"_as_{c}")) for c in texts}
            for h, cs in readings.items():
                each = [cell_rule(m, columns[h]) for m in metrics]
                rules, forms = list(dict.fromkeys(each)), {}
                rule_at = np.array([rules.index(r) for r in each])[metric_at]
                found = {c: read(*held[c], rules, rule_at, forms) for c in dict.fromkeys(cs)}
                of = {name: batch.column(f"_{name}_{place[h]}").to_numpy(zero_copy_only=False) for name in facts[h]}
                of = dict.fromkeys(parts[h], True) | {name: v == 1 if name in ("clear", "low", "lower") else v for name, v in of.items()}
                own = np.array([_KNOWN if r and r[3] is not None else 0.0 for r in rules])[rule_at]
                with np.errstate(all="ignore"):
                    chosen = best([found[c] for c in cs], own, of, parts[h])
                firsts, first_at = held[cs[0]]
                told = pa.array([*forms, *[(t or "").strip(SPACES) for t in firsts]], pa.string()).take(pa.array(np.where(chosen < 0, len(forms) + first_at, chosen)))
                ok = (chosen >= 0) | np.array([r is None for r in rules])[rule_at]
                yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("metric"), pa.repeat(h, batch.num_rows), told, pa.array(ok)], [key, "metric", "col", "text", "ok"])

    return rows.mapInArrow(run, f"`{key}` {grid.schema[key].dataType.simpleString()}, metric string, col string, text string, ok boolean")


def rank_beside(grid: DataFrame, cells: Column, key: str = "case_no") -> DataFrame:
    """rank_candidates() for readings that lie beside their row of the grid: cells is an array of (col, readings), readings
    one of (cand_pos, text). Rows of the grid are unique; none is moved."""
    return _told(_ranked(_context(grid, key, F.inline(cells).alias("col", "readings")), key), key)


def rank_candidates(readings: DataFrame, grid: DataFrame, key: str = "case_no") -> DataFrame:
    """Of the readings (key, metric, col, cand_pos, text) of each cell the likeliest, in its normal form.

    col is a heading. Readings that hold nothing valid are passed over; the others are scored against the row of the
    grid (lower is better), equal scores go to the form read most often, then to the first reading. Returns key, metric,
    col, text, ok: a cell whose column can't be checked keeps its first reading as it is, and one without a valid
    reading its first reading with ok false. Cells without a row in the grid are scored without context.
    """
    packed = readings.groupBy(key, "metric", "col").agg(F.collect_list(F.struct("cand_pos", "text")).alias("readings"))
    ranked = _ranked(packed.join(_context(grid, key), [key, "metric"], "left"), key)
    return _told(ranked.groupBy(key, "metric", "col").agg(F.min("_best").alias("_best"), F.min("_first").alias("_first"), F.bool_or("_checked").alias("_checked")), key)
