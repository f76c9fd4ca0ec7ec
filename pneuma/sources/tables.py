"""The given tables, and how their rows are dealt."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


#: As many partitions as a task writes one beside the other (spark.shuffle.sort.bypassMergeThreshold, as it is unless set).
UNHELD = 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, *keys: str, each: int = 24, least: int | None = None) -> DataFrame:
    """A table as read, dealt by its keys into `each` partitions for each split of its files.

    Their number grows with the table, so the share of one task doesn't; groups, windows and joins by the keys, or by more,
    take the rows as they lie. Beyond UNHELD partitions a task that deals rows holds all those of its split in memory; with
    `least`, for shares that take little memory, there are no more than that while each split has `least` partitions.
    """
    splits = max(1, df.rdd.getNumPartitions())
    return df.repartition(max(min(each * splits, UNHELD), least * splits) if least else each * splits, *keys)
