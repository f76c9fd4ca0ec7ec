"""Bookkeeping of a batch: statuses, first-wins sets, names and progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .history import places, running


def latest(df: DataFrame, key: str, value: str, seq: str) -> DataFrame:
    """The last value of each key."""
    return df.groupBy(key).agg(F.max_by(value, seq).alias(value))


def first_wins(df: DataFrame, key: str, seq: str) -> DataFrame:
    """The first row of each key, found with map-side combine; of equal places the least row."""
    rest = [c for c in df.columns if c not in (key, seq)]
    first = df.groupBy(key).agg(F.min(F.struct(seq, *rest)).alias("_row"))
    return first.select(*[F.col(key) if c == key else F.col(f"_row.`{c}`").alias(c) for c in df.columns])


def unseen(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return df.join(seen.select(key).distinct(), key, "left_anti")


def unique_names(df: DataFrame, base: str, seq: str) -> DataFrame:
    """Names without clashes: the first keeps its own, the next ones get _1, _2 and so on, past names that are given.

    Numbers that make a name which is given as a base somewhere are passed over, in order. The k-th number so given for a
    base (from 1), say g, has g - k free ones below it, so the n-th free number is n and the count of given ones with
    g - k < n: a running count over rows and given numbers together, though a base holds any share of either.
    """
    rows = places(df, base, seq)
    number = F.regexp_extract(base, r"^(.*)_([1-9][0-9]*)$", 2)
    given = df.where(number != "").select(F.regexp_extract(base, r"^(.*)_([0-9]+)$", 1).alias(base), number.try_cast("long").alias("_g")).where("_g is not null").distinct()
    given = given.join(df.select(base).distinct(), base, "left_semi")
    below = places(given, base, "_g").select(base, (F.col("_g") - F.col("_n") - 1).alias("_free"))
    both = rows.withColumn("_free", F.col("_n") - 1).unionByName(below, allowMissingColumns=True)
    is_given = F.col("_n").isNull()
    counted = running(both.withColumn("_row", (~is_given).cast("int")), base, ["_free", "_row"], is_given.cast("int"), "_passed")
    name = F.when(F.col("_n") == 0, F.col(base)).otherwise(F.concat(base, F.lit("_"), (F.col("_n") + F.col("_passed")).cast("string")))
    return counted.where(~is_given).withColumn("name", name).drop("_n", "_free", "_row", "_passed")


def progress(df: DataFrame, key: str, seq: str) -> DataFrame:
    """Whole percent done after each item."""
    own = Window.partitionBy(key)
    return df.withColumn("percent", F.floor(F.row_number().over(own.orderBy(seq)) / F.greatest(F.lit(1), F.count("*").over(own)) * 100).cast("int"))


def summary(df: DataFrame, key: str, status: str, message: str, seq: str) -> DataFrame:
    """Completed and failed items, and the first message that isn't empty."""
    told = F.when(F.col(message) != "", F.col(seq))
    return df.groupBy(key).agg(F.count_if(F.col(status) == "Completed").alias("completed"), F.count_if(F.col(status) == "Failed").alias("failed"), F.min_by(message, told).alias("first_message"))


def changes_only(df: DataFrame, key: str, value: str, seq: str) -> DataFrame:
    """Rows whose value differs from the one before."""
    w = Window.partitionBy(key).orderBy(seq)
    return df.withColumn("_before", F.lag(value).over(w)).where(~F.col(value).eqNullSafe(F.col("_before"))).drop("_before")


def fit_from_right(df: DataFrame, width: float, key: str, seq: str, size: str) -> DataFrame:
    """The last item of each key, and those before it while their running width fits."""
    w = Window.partitionBy(key).orderBy(F.desc(seq))
    return df.withColumn("taken", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_r", F.row_number().over(w)).where((F.col("_r") == 1) | (F.col("taken") <= width)).drop("_r")


def offsets(df: DataFrame, key: str, seq: str, size: str) -> DataFrame:
    """Where each item begins: the sum of the sizes before it."""
    w = Window.partitionBy(key).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("offset", F.coalesce(F.sum(size).over(w), F.lit(0)))
