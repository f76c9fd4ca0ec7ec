"""Results as they finish: a sink that a replayed batch does not change, and the status of each item so far."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def finished(path: str) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch: each batch is a partition of the table at path, written anew if the batch comes again.

    So a batch that is replayed after a failure replaces what it had written, wholly or in part, and adds nothing. Only
    the batch's own partition is touched, whatever the size of the table.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return write


def _log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(path)


def statuses(spark: SparkSession, path: str, schema: T.StructType, key: str, seq: str) -> DataFrame:
    """The last row of each key so far, by seq (of equal ones the greatest row), with map-side combine."""
    names = [f.name for f in schema.fields if f.name not in (key, seq)]
    last = _log(spark, path, schema).groupBy(key).agg(F.max(F.struct(seq, *names)).alias("_row"))
    return last.select(*[F.col(key) if f.name == key else F.col(f"_row.`{f.name}`").alias(f.name) for f in schema.fields])


def merged(spark: SparkSession, path: str, schema: T.StructType, key: str, seq: str, upto: int) -> None:
    """Merge all batches up to a number that the stream has committed into one partition: the last row of each key.

    The merged partition is written before the others are emptied, and merging is idempotent, so a failure between the
    two leaves rows twice but the statuses as they were.
    """
    old = _log(spark, path, schema).where(F.col("batch") <= upto)
    names = [f.name for f in schema.fields if f.name not in (key, seq)]
    last = old.groupBy(key).agg(F.max(F.struct(seq, *names)).alias("_row"))
    rows = last.select(*[F.col(key) if f.name == key else F.col(f"_row.`{f.name}`").alias(f.name) for f in schema.fields])
    batches = [r.batch for r in old.select("batch").distinct().collect()]  # one a batch that is not merged yet
    finished(path)(rows, -1 - upto)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    for b in batches:
        if b != -1 - upto:
            gone = fs_path(f"{path}/batch={b}")
            gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)


def progress(statuses: DataFrame, total: int, status: str = "status") -> DataFrame:
    """One row: completed and failed items, whole percent done of total, and the message that tells it."""
    done = statuses.agg(F.count_if(F.col(status) == "Completed").alias("completed"), F.count_if(F.col(status) == "Failed").alias("failed"))
    n = F.col("completed") + F.col("failed")
    return done.withColumns({"percent": (n / F.lit(max(1, total)) * 100).cast("int"), "message": F.concat(F.lit("Processed "), n.cast("string"), F.lit(f"/{total}"))})
