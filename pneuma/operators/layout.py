"""Positioned tokens to rows, columns and cells; always within a case, which is the key of each shuffle.

Pages, rows and columns grow with the cases. Their size is guessed from the files under them, before rows are exploded, so
joins with them name the merge join: a broadcast would gather them on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_cell, has_digit


def group_lines(tokens: DataFrame, max_gap: float, key: str = "case_no", at: str = "cy", tie: str = "pos") -> DataFrame:
    """Gaps and islands: a new line where the gap to the token before exceeds max_gap."""
    w = Window.partitionBy(key).orderBy(at, tie)
    opens = F.when(F.col(at) - F.lag(at).over(w) > max_gap, 1).otherwise(0)
    return tokens.withColumn("opens", opens).withColumn("line", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("opens")


def windows_from_centres(centres: DataFrame, low: float, high: float, key: str = "case_no", idx: str = "idx", centre: str = "centre") -> DataFrame:
    """Interval of each centre: edges half-way to its neighbours, the outermost at low and high."""
    w = Window.partitionBy(key).orderBy(idx)
    before, after = (F.lag(centre).over(w) + F.col(centre)) / 2, (F.col(centre) + F.lead(centre).over(w)) / 2
    return centres.select(key, idx, F.coalesce(before, F.lit(low)).alias("lo"), F.coalesce(after, F.lit(high)).alias("hi"))


def assign(tokens: DataFrame, windows: DataFrame, key: str = "case_no", at: str = "cy", tie: str = "pos", idx: str = "idx") -> DataFrame:
    """Range join within a case, both ends closed; on a shared edge the lowest index wins; tokens outside are dropped."""
    met = tokens.join(windows.select(key, F.col(idx).alias("_idx"), "lo", "hi").hint("merge"), key).where(F.col(at).between(F.col("lo"), F.col("hi")))
    names = [c for c in tokens.columns if c not in (key, tie)]
    least = met.groupBy(key, tie).agg(F.min(F.struct("_idx", *names)).alias("_row"))
    return least.select(key, tie, F.col("_row._idx").alias(idx), *[F.col(f"_row.`{c}`").alias(c) for c in names])


def token_parts(tokens: DataFrame, pages: DataFrame, key: str = "case_no") -> DataFrame:
    """Tokens with what part of their page they are: header (down to body_y0) or body, label (body within 0.28 of the
    width), number (has a digit), and their zone, pre left of split_x, else post. pages: key, w, body_y0, split_x."""
    met = tokens.join(pages.select(key, F.col("w").alias("_w"), "body_y0", "split_x").hint("merge"), key)
    body = F.col("cy") > F.col("body_y0")
    zone = F.when(F.col("cx") < F.col("split_x"), "pre").otherwise("post")
    return met.withColumns({"header": ~body, "body": body, "label": body & (F.col("cx") <= 0.28 * F.col("_w")), "number": has_digit(F.col("text")), "zone": zone}).drop("_w", "body_y0", "split_x")


def in_body(tokens: DataFrame, pages: DataFrame, key: str = "case_no") -> DataFrame:
    """Tokens under the header, each with its zone."""
    met = tokens.join(pages.select(key, "body_y0", "data_x0", "split_x").hint("merge"), key).where(F.col("cy") > F.col("body_y0"))
    return met.withColumn("zone", F.when(F.col("cx") < F.col("split_x"), "pre").otherwise("post"))


def zone_cells(tokens: DataFrame, pages: DataFrame, rows: DataFrame, columns: DataFrame, key: str = "case_no", tie: str = "pos") -> DataFrame:
    """key, tie, row_idx, zone, col_idx, text of each token that lies in a cell.

    pages: key, body_y0, data_x0, split_x. rows: key, idx, lo, hi of cy. columns: key, zone, idx, lo, hi of cx. Tokens
    left of data_x0 or above body_y0 are labels and headers. Both range joins are closed at both ends; on a shared edge
    the lowest index wins. The columns of a case's post zone take part only if a token with a digit lies in that zone.

    All joins and groups are within the case, so tokens are shuffled once.
    """
    body = in_body(tokens, pages, key)
    shown = body.where((F.col("zone") == "post") & has_digit(F.col("text"))).select(key).distinct()
    posts = columns.where("zone = 'post'").join(shown.hint("merge"), key, "left_semi")  # EXISTS such a token in the case
    enabled = columns.where("zone = 'pre'").unionByName(posts).select(key, "zone", F.col("idx").alias("_col"), F.col("lo").alias("_x0"), F.col("hi").alias("_x1"))
    inside = body.where(F.col("cx") >= F.col("data_x0")).select(key, tie, "zone", "cx", "cy", "text")
    by_row = inside.join(rows.select(key, F.col("idx").alias("_row"), F.col("lo").alias("_y0"), F.col("hi").alias("_y1")).hint("merge"), key).where(F.col("cy").between(F.col("_y0"), F.col("_y1")))
    in_row = by_row.groupBy(key, tie).agg(F.min(F.struct("_row", "zone", "cx", "text")).alias("_t")).select(key, tie, "_t.*")
    by_column = in_row.join(enabled.hint("merge"), [key, "zone"]).where(F.col("cx").between(F.col("_x0"), F.col("_x1")))
    return by_column.groupBy(key, tie).agg(F.min(F.struct("_col", "_row", "zone", "text")).alias("_t")).select(key, tie, F.col("_t._row").alias("row_idx"), "_t.zone", F.col("_t._col").alias("col_idx"), "_t.text")


def post_warning(tokens: DataFrame, pages: DataFrame, heads: DataFrame, key: str = "case_no") -> DataFrame:
    """key and warning of cases that have a POST-BEST header and no number in their post zone. Its words are fixed values."""
    shown = in_body(tokens, pages, key).where((F.col("zone") == "post") & has_digit(F.col("text"))).select(key).distinct()
    headed = heads.where("col = 'POST-BEST'").select(key).distinct().join(pages.select(key).hint("merge"), key, "left_semi")
    return headed.join(shown.hint("merge"), key, "left_anti").withColumn("warning", F.lit("POST section appears missing; POST columns left blank."))


def assemble(tokens: DataFrame, keys: list[str], text: str = "text", tie: str = "pos", clean: bool = False) -> DataFrame:
    """The text of each cell, its tokens in order joined by spaces, and their number n; with clean mended after each token."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(tie, text))), lambda t: t[text])
    cells = tokens.groupBy(*keys).agg(F.count("*").alias("n"), ordered.alias("_texts"))
    joined = F.array_join("_texts", " ")
    if clean:
        joined = F.reduce("_texts", F.lit(""), lambda whole, t: clean_cell(F.concat_ws(" ", F.nullif(whole, F.lit("")), t)))
    return cells.select(*keys, "n", joined.alias("cell"))


def fit_line(anchors: DataFrame, key: str = "case_no", idx: str = "idx", y: str = "y", least: int = 6) -> DataFrame:
    """Least squares y = a * idx + b where a case has enough anchors."""
    return anchors.groupBy(key).agg(F.regr_slope(y, idx).alias("slope"), F.regr_intercept(y, idx).alias("intercept"), F.count("*").alias("n")).where(F.col("n") >= least)


def spacing(anchors: DataFrame, key: str = "case_no", idx: str = "idx", y: str = "y") -> DataFrame:
    """Upper median of the distance a step between successive anchors."""
    w = Window.partitionBy(key).orderBy(idx)
    step = anchors.withColumn("d", (F.col(y) - F.lag(y).over(w)) / (F.col(idx) - F.lag(idx).over(w))).where("d is not null")
    return step.groupBy(key).agg(F.array_sort(F.collect_list("d")).alias("ds")).select(key, F.element_at("ds", (F.size("ds") / 2).cast("int") + 1).alias("spacing"))


def index_percentile(df: DataFrame, value: str, share: float, key: str = "case_no") -> DataFrame:
    """The sorted value at round(share * (n - 1)), halves to even."""
    return df.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias("xs")).select(key, F.element_at("xs", F.bround(share * (F.size("xs") - 1), 0).cast("int") + 1).alias("value"))


def best_per_group(df: DataFrame, keys: list[str], by: str, tie: str) -> DataFrame:
    """The row of the highest value in each group; the first in order wins ties."""
    w = Window.partitionBy(*keys).orderBy(F.desc(by), F.asc(tie))
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def k_medians(df: DataFrame, k: int, value: str = "x", key: str = "case_no", rounds: int = 50) -> DataFrame:
    """Centres of one-dimensional k-medians of each case: quantile start, nearest centre, upper median.

    Fewer values than k are spread evenly from the least to the largest. Equal centres are 1e-3 apart. Nulls are passed
    over; a case without values has no centres. The values of a case meet in one task, so they are those of one table;
    numpy takes the cases of a batch together.
    """
    import numpy as np

    def centres(xs):
        """Of each row of a table of sorted values, all of one width."""
        n, width = xs.shape
        if width < k:
            return xs[:, :1] + (xs[:, -1:] - xs[:, :1]) / max(k - 1, 1) * np.arange(k)
        c = xs[:, [int(round(i / max(k - 1, 1) * (width - 1))) for i in range(k)]]
        due = np.arange(n)  # rows whose centres still move
        for _ in range(rounds):
            x, old = xs[due], c[due]
            new, near, least = old.copy(), np.zeros(x.shape, int), np.abs(x - old[:, :1])
            for j in range(1, k):
                far = np.abs(x - old[:, j : j + 1])
                closer = (far < least) | (np.isnan(far) & ~np.isnan(least))  # as argmin has it
                near[closer], least = j, np.where(closer, far, least)
            for j in range(k):
                own = near == j
                held = own.sum(1)
                at = (own & (np.cumsum(own, 1) == (held // 2 + 1)[:, None])).argmax(1)  # the upper median of its own, which are sorted
                new[:, j] = np.where(held > 0, x[np.arange(len(x)), at], old[:, j])
            c[due] = new
            due = due[~(np.abs(new - old).max(1) < 1e-3)]
            if not len(due):
                break
        c = np.sort(c, 1)
        for j in range(1, k):
            c[:, j] = np.where(c[:, j] <= c[:, j - 1], c[:, j - 1] + 1e-3, c[:, j])
        return c

    kind = df.schema[key].dataType

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sizes, values = np.diff(batch.column("xs").offsets.to_numpy()), batch.column("xs").flatten().to_numpy(zero_copy_only=False)
            first, out = np.cumsum(sizes) - sizes, np.empty((len(sizes), k))
            for width in np.unique(sizes):  # cases of as many values at once
                rows = np.flatnonzero(sizes == width)
                step = max(1, 2**20 // int(width))
                for part in (rows[i : i + step] for i in range(0, len(rows), step)):
                    out[part] = centres(values[first[part, None] + np.arange(width)])
            keys = batch.column(key).take(pa.array(np.repeat(np.arange(len(sizes)), k)))
            yield pa.RecordBatch.from_arrays([keys, pa.array(np.tile(np.arange(k, dtype=np.int32), len(sizes))), pa.array(out.ravel())], [key, "idx", "centre"])

    held = df.select(key, F.col(value).cast("double").alias("x")).where("x is not null").groupBy(key).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return held.select(key, "xs").mapInArrow(run, f"`{key}` {kind.simpleString()}, idx int, centre double")


def merge_neighbours(tokens: DataFrame, keys: list[str], max_gap: float = 18, tie: str = "pos") -> DataFrame:
    """Tokens of a line whose gap to what lies left of them is at most max_gap become one.

    Texts are joined by spaces, the box is the union, the confidence the least, and the centre the running mean of two
    (of what was merged so far and the next token). Columns: text, conf, cx, cy, x0, y0, x1, y1.
    """
    w = Window.partitionBy(*keys).orderBy("cx", tie)
    opens = F.when(F.col("x0") - F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1)) > max_gap, 1).otherwise(0)
    part = tokens.withColumn("_opens", opens).withColumn("part", F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ordered = F.array_sort(F.collect_list(F.struct("cx", tie, "cy", "text")))
    whole = part.groupBy(*keys, "part").agg(ordered.alias("_t"), F.min("conf").alias("conf"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    centre = lambda c: F.reduce(F.slice("_t", 2, F.size("_t")), F.col("_t")[0][c].cast("double"), lambda a, t: (a + t[c]) / 2)
    return whole.select(*keys, "part", F.array_join(F.transform("_t", lambda t: t["text"]), " ").alias("text"), "conf", centre("cx").alias("cx"), centre("cy").alias("cy"), "x0", "y0", "x1", "y1")


def anchored_centres(centres: Column, headers: Column, columns: list[str], step: float = 8.0) -> Column:
    """One increasing position for each column, from cluster centres (array) and header positions (map by column).

    A known header gives its position and passes over the centres up to it; another column takes the next centre, or
    lies step beyond the column before where none is left. A position not beyond the one before moves 1 past it.
    Without centres there are no positions.
    """
    ordered = F.array_sort(F.transform(F.coalesce(centres, F.array().cast("array<double>")), lambda c: c.cast("double")))

    def take(state: Column, name: Column) -> Column:
        head = F.try_element_at(headers, name).cast("double")
        next_centre = F.get(ordered, state["j"])
        at = F.coalesce(head, next_centre, F.element_at(state["out"], -1) + step)
        passed = F.when(head.isNotNull(), F.greatest(state["j"], F.size(F.filter(ordered, lambda c: c <= head)))).otherwise(state["j"] + 1)
        return F.struct(F.concat(state["out"], F.array(at)).alias("out"), passed.alias("j"))

    start = F.struct(F.array().cast("array<double>").alias("out"), F.lit(0).alias("j"))
    raw = F.reduce(F.array(*[F.lit(c) for c in columns]), start, take, lambda s: s["out"])
    rising = F.reduce(raw, F.array().cast("array<double>"), lambda out, x: F.concat(out, F.array(F.coalesce(F.greatest(x, F.when(x <= F.try_element_at(out, F.lit(-1)), F.try_element_at(out, F.lit(-1)) + 1)), x))))
    return F.when(F.size(ordered) > 0, rising).otherwise(F.array().cast("array<double>"))
