"""Reports of cases: what was read, classified and predicted put together, told as text, and listed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clinical import overall_label, over_threshold
from ..functions.text import base_name, first_line, fixed, or_missing

# Rows told in a report (fixed values).
KEY_ROWS = ["FVC", "FEV1", "FEV1/FVC"]


def key_rows(grid: DataFrame, key: str = "case_no", order: str = "row_no") -> DataFrame:
    """For each case an array of metric, pre_z, post_z and pct of its key rows, in order; none for cases without any."""
    rows = grid.where(F.trim("metric").isin(KEY_ROWS)).select(key, F.struct(F.col(order).alias("at"), F.trim("metric").alias("metric"), F.col("pre_z"), F.col("post_z"), F.col("pct_chg").alias("pct")).alias("row"))
    listed = rows.groupBy(key).agg(F.array_sort(F.collect_list("row")).alias("rows"))
    return listed.select(key, F.transform("rows", lambda r: r.dropFields("at")).alias("table_rows"))


def predictions(outputs: DataFrame, name: str = "name", logits: str = "logits") -> DataFrame:
    """name, flags and confidences from the two outputs of a model in one array; a missing output gives nulls."""
    out = lambda i: F.try_element_at(logits, F.lit(i)).cast("double")
    flag, share = lambda x: over_threshold(x), lambda x: 1 / (1 + F.exp(-x))
    return outputs.select(name, flag(out(1)).alias("exp_label"), flag(out(2)).alias("insp_label"), share(out(1)).alias("exp_conf"), share(out(2)).alias("insp_conf"))


def aligned(df: DataFrame, arrays: list[str], keep: list[str], at: str = "place") -> DataFrame:
    """Parallel arrays as rows: keep, the place from 0, and the element of each array there.

    There are as many rows as the longest array has elements; where a shorter or null one has none it is null. Rows
    whose arrays are all empty or null give none.
    """
    filled = [F.coalesce(F.col(a), F.array().cast(df.schema[a].dataType)).alias(a) for a in arrays]
    zipped = df.select(*keep, *filled).select(*keep, F.arrays_zip(*arrays).alias("_rows"))
    return zipped.select(*keep, F.posexplode("_rows").alias(at, "_row")).select(*keep, at, "_row.*")


def without(items: Column, item: Column) -> Column:
    """A list without any occurrence of an item; a null item takes out nothing."""
    return F.coalesce(F.array_remove(items, item), items)


def assemble(cases: DataFrame, classes: DataFrame, rows: DataFrame, predicted: DataFrame, key: str = "case_no") -> DataFrame:
    """One row a case: its classification (null without one), key rows (empty without any), flags and confidences."""
    told = classes.select(key, F.struct(*[c for c in classes.columns if c != key]).alias("classification"))
    out = cases.join(told, key, "left").join(rows, key, "left").join(predicted, key, "left")
    return out.withColumn("table_rows", F.coalesce("table_rows", F.array().cast(rows.schema["table_rows"].dataType)))


def prediction_line(status: Column, expiratory: Column, inspiratory: Column, exp_conf: Column, insp_conf: Column) -> Column:
    """The line of a list of reports. Its words are fixed values."""
    yes = lambda c: F.when(F.coalesce(c, F.lit(False)), "Yes").otherwise("No")
    share = lambda c: F.coalesce(fixed(c, 2), F.lit("N/A"))
    line = F.concat(F.lit("Expiratory truncation: "), yes(expiratory), F.lit(" ("), share(exp_conf), F.lit(") | Inspiratory truncation: "), yes(inspiratory), F.lit(" ("), share(insp_conf), F.lit(")"))
    return (
        F.when(~status.eqNullSafe(F.lit("Completed")), "Prediction failed.")
        .when(expiratory.isNull() & inspiratory.isNull(), "Prediction results will appear after generation.").otherwise(line)
    )


def report_text(df: DataFrame, made: Column, source: str = "source_path", error: str = "table_error") -> Column:
    """The text of the report of each row that assemble() gives. Its words are fixed values."""
    exp, insp = F.coalesce("exp_label", F.lit(False)), F.coalesce("insp_label", F.lit(False))
    yes = lambda c, p: F.concat(F.when(c, "Yes").otherwise("No"), F.lit(" (confidence "), fixed(F.coalesce(p, F.lit(0.0)), 2), F.lit(")"))
    c = lambda n: F.col(f"classification.{n}")
    known = F.array(
        F.concat(F.lit("Pre pattern: "), c("pre_pattern"), F.lit(" ("), c("pre_severity"), F.lit(")")), F.concat(F.lit("Post pattern: "), c("post_pattern"), F.lit(" ("), c("post_severity"), F.lit(")")),
        F.concat(F.lit("Report: "), c("report_combined")), F.concat(F.lit("Bronchodilator response: "), c("bronchodilator_response")),
    )
    warned = or_missing(F.col(error), "")
    rows = F.transform("table_rows", lambda r: F.concat(r["metric"], F.lit(": Pre Z "), or_missing(r["pre_z"]), F.lit(", Post Z "), or_missing(r["post_z"]), F.lit(", %CHG "), or_missing(r["pct"])))
    none = F.array().cast("array<string>")
    lines = F.concat(
        F.array(
            F.concat(F.lit("Source PDF: "), base_name(F.col(source))), F.concat(F.lit("Generated: "), F.date_format(made, "yyyy-MM-dd HH:mm:ss")), F.lit(""), F.lit("GRAPH PREDICTION"),
            F.concat(F.lit("Overall result: "), overall_label(exp, insp)), F.concat(F.lit("Expiratory truncation: "), yes(exp, F.col("exp_conf"))), F.concat(F.lit("Inspiratory truncation: "), yes(insp, F.col("insp_conf"))),
            F.lit(""), F.lit("TABLE CLASSIFICATION"),
        ),
        F.when(F.col("classification").isNotNull(), known).otherwise(F.array(F.lit("Table classification not available."))),
        F.when(warned != "", F.array(F.concat(F.lit("Table extraction warning: "), first_line(warned)))).otherwise(none),
        F.when(F.size("table_rows") > 0, F.concat(F.array(F.lit(""), F.lit("KEY TABLE Z-SCORES")), rows)).otherwise(none),
    )
    return F.array_join(lines, "\n")


def completed_first(df: DataFrame, status: str = "status", seq: str = "seq") -> DataFrame:
    """Completed reports before the others, each in their order."""
    return df.orderBy(F.col(status) != "Completed", seq)


def chosen(df: DataFrame, status: str = "status", checked: str = "checked") -> DataFrame:
    """The completed reports that are ticked."""
    return df.where((F.col(status) == "Completed") & F.coalesce(F.col(checked), F.lit(False)))


def is_source(path: Column, matched: bool = False) -> Column:
    """Whether a path is a source and no output of an earlier run, told by its folder; with matched, by its name too."""
    low = F.lower(F.replace(path, F.lit("/"), F.lit("\\")))
    made = F.contains(low, F.lit("\\build\\predicted_reports\\")) | F.contains(low, F.lit("\\asp_python_app\\extracted\\"))
    return ~(made | low.rlike(r"_predicted(_\d+)?\.pdf$")) if matched else ~made


def keep_valid(paths: DataFrame, statuses: DataFrame, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """Paths that may be run, and the statuses of those alone."""
    valid = paths.where(is_source(F.col(path)))
    return valid, statuses.join(valid.select(path).distinct(), path, "left_semi")


def augmented(rows: DataFrame, copies: int = 10, column: str = "copy") -> DataFrame:
    """The rows and so many full copies of them, numbered from 0."""
    return rows.withColumn(column, F.explode(F.sequence(F.lit(0), F.lit(copies))))


def prefix_search(words: DataFrame, prefix: str, word: str = "word", seq: str = "seq") -> DataFrame:
    """Words that begin with a prefix, in any case, the shortest first, then by letters.

    Only words of the letters a to z are found. Of words that differ in case alone the one put in last counts.
    """
    low = F.lower(F.col(word))
    hits = words.where(low.rlike("^[a-z]*$") & low.startswith(prefix.lower())).groupBy(low.alias("key")).agg(F.max_by(word, seq).alias(word))
    return hits.orderBy(F.char_length("key"), "key")


def calendar(dates: DataFrame, date: str) -> DataFrame:
    """A row for each day from the first to the last date of a table: weekday (Monday is 0), number from the first, name of
    the month, days in it, its page. A table without dates gives none; the days are as many as its dates span."""
    ends = dates.agg(F.min(F.col(date).cast("date")).alias("_first"), F.max(F.col(date).cast("date")).alias("_last")).where("_first is not null")
    days = ends.select("_first", F.explode(F.sequence("_first", "_last")).alias("day"))
    page = (F.year("day") - F.year("_first")) * 12 + F.month("day") - 1
    return days.select("day", F.weekday("day").alias("weekday"), F.date_diff("day", "_first").alias("n"), F.date_format("day", "MMMM").alias("month"), F.day(F.last_day("day")).alias("days"), page.alias("page"))


def spread_sides(boxes: DataFrame, swap: bool = False, key: str = "case_no", tie: str = "pos") -> DataFrame:
    """Of the boxes of a case the two largest as left and right by x (the other way round with swap); one alone is left."""
    area = F.struct((-F.col("w") * F.col("h")).alias("minus"), F.col(tie).alias("pos"), F.col("x"))
    two = F.slice(F.array_sort(F.collect_list(area)), 1, 2)
    order = F.array_sort(F.transform(two, lambda b: F.struct(b["x"], b["pos"])))
    sides = F.array(*[F.lit(s) for s in (("right", "left") if swap else ("left", "right"))])
    out = boxes.groupBy(key).agg(order.alias("_two")).select(key, F.posexplode("_two").alias("at", "box"))
    return out.select(key, F.element_at(sides, F.col("at") + 1).alias("side"), F.col("box.pos").alias(tie))
