"""Order within a key that may hold any share of the rows: places, the row before, and histories with removal."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _stretches(df: DataFrame, key: str, seq: list[str]) -> DataFrame:
    """df in ranges of (key, seq) of about equal size, as _part; a key's rows of a range are a stretch of it."""
    return df.repartitionByRange(key, *seq).withColumn("_part", F.spark_partition_id()).checkpoint()  # two reads may sample other ranges


def _beside(numbered: DataFrame, told: DataFrame, key: str) -> DataFrame:
    """Each row with what the table of stretches (_part, _key, ...) says of its own."""
    told = told.withColumnRenamed("_part", "_tpart")
    return numbered.join(told, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_tpart"))).drop("_key", "_tpart")


def running(df: DataFrame, key: str, seq: list[str], value: F.Column, name: str) -> DataFrame:
    """df with the sum of value over the rows of its key before each row.

    Summed within a stretch; what the earlier stretches of the key sum up to comes from a table of one row for each
    stretch.
    """
    ranged = _stretches(df, key, seq)
    sums = ranged.groupBy("_part", F.col(key).alias("_key")).agg(F.sum(value).alias("_s"))
    ahead = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_part", "_key", F.coalesce(F.sum("_s").over(ahead), F.lit(0)).alias("_ahead"))
    own = Window.partitionBy("_part", key).orderBy(*seq).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("_own", F.coalesce(F.sum(value).over(own), F.lit(0)))
    return _beside(summed, before, key).withColumn(name, F.col("_own") + F.col("_ahead")).drop("_own", "_ahead", "_part")


def places(df: DataFrame, key: str, seq: str | list[str]) -> DataFrame:
    """df with _n, the place of each row in its key from 0."""
    return running(df, key, [seq] if isinstance(seq, str) else seq, F.lit(1), "_n")


def with_previous(df: DataFrame, key: str, seq: str, value: str, name: str = "_before") -> DataFrame:
    """df with the value of the row before in its key; null for the first one.

    Within a stretch by lag; the first row of a stretch takes the last value of the stretch before, from a table of one
    row for each stretch.
    """
    ranged = _stretches(df, key, [seq])
    last = ranged.groupBy("_part", F.col(key).alias("_key")).agg(F.max(F.struct(F.col(seq).alias("s"), F.col(value).alias("v")))["v"].alias("_v"))
    carried = last.select("_part", "_key", F.lag("_v").over(Window.partitionBy("_key").orderBy("_part")).alias("_carried"))
    own = Window.partitionBy("_part", key).orderBy(seq)
    lagged = ranged.withColumns({"_first": F.row_number().over(own) == 1, "_lag": F.lag(value).over(own)})
    met = _beside(lagged, carried, key)
    return met.withColumn(name, F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_lag"))).drop("_first", "_lag", "_carried", "_part")


def history(events: DataFrame, key: str, seq: str, route: str, removed: str, start: DataFrame | None = None) -> DataFrame:
    """key, place (from 0), route: what is left of each key's history after all its pushes and removals.

    events: key, seq (unique in a key), route, and removed: true if the row takes the route out of the history, else it
    is pushed. A push of what is on top is passed over. A removal takes out every earlier push of its route, and equal
    neighbours that then meet become one. start: key and route of the lowest entry, which no removal takes out; keys
    without one begin with null. Null routes are passed over.

    Passing over and merging neighbours can be put off to the end, as they keep a run of equal entries if any of it
    is left. So a push is left if no removal of its route comes later (an anti join against the last removal of each
    route), and entries are the first rows of the islands of equal routes. A key may hold any share of the rows.
    """
    rows = events.where(F.col(route).isNotNull()).select(key, seq, route, F.coalesce(F.col(removed), F.lit(False)).alias("_gone"))
    last = rows.where("_gone").groupBy(key, route).agg(F.max(seq).alias("_last"))
    dead = last.select(F.col(key).alias("_k"), F.col(route).alias("_r"), "_last")
    pushes = rows.where("not _gone").join(dead, F.col(key).eqNullSafe(F.col("_k")) & (F.col(route) == F.col("_r")) & (F.col(seq) < F.col("_last")), "left_anti")
    keys = rows.select(key).distinct()
    lowest = keys.join(start.select(F.col(key).alias("_k"), F.col(route)), F.col(key).eqNullSafe(F.col("_k")), "left").drop("_k") if start is not None else keys.withColumn(route, F.lit(None).cast(rows.schema[route].dataType))
    base = lowest.select(key, F.lit(None).cast(rows.schema[seq].dataType).alias(seq), route)
    entries = with_previous(pushes.select(key, seq, route).unionByName(base), key, seq, route)
    kept = entries.where(F.col(seq).isNull() | ~F.col(route).eqNullSafe(F.col("_before")))
    return places(kept.select(key, seq, route), key, seq).select(key, F.col("_n").cast("long").alias("place"), route)
