"""Evaluation of label predictions, and the course of training."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .history import places


def confusion(df: DataFrame, label: str = "label", truth: str = "truth", guess: str = "guess") -> DataFrame:
    """tn, fp, fn, tp of each label."""
    n = lambda t, g: F.count_if((F.col(truth) == t) & (F.col(guess) == g))
    return df.groupBy(label).agg(n(0, 0).alias("tn"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(1, 1).alias("tp"))


def per_label(counts: DataFrame, label: str = "label") -> DataFrame:
    """Accuracy and F1 of each label; F1 is 1 where nothing is true and nothing guessed."""
    d = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return counts.select(label, ((F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))).alias("accuracy"), F.when(d == 0, 1.0).otherwise(2 * F.col("tp") / d).alias("f1"))


def label_report(counts: DataFrame, label: str = "label") -> DataFrame:
    """Precision, recall, F1 (each 1 where it has nothing to count) and support of each label, and their plain mean."""
    over = lambda a, b: F.when(b == 0, 1.0).otherwise(a / b)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    each = counts.select(F.col(label).cast("string").alias(label), over(tp, tp + fp).alias("precision"), over(tp, tp + fn).alias("recall"), over(2 * tp, 2 * tp + fp + fn).alias("f1"), (tp + fn).alias("support"))
    mean = each.agg(F.lit("macro avg").alias(label), *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")], F.sum("support").alias("support"))
    return each.unionByName(mean)


def mean_losses(batches: DataFrame, keys: list[str], loss: str = "loss") -> DataFrame:
    """The mean loss of each epoch."""
    return batches.groupBy(*keys).agg(F.avg(loss).alias(loss), F.count("*").alias("batches"))


def subset_accuracy(df: DataFrame, key: str, truth: str = "truth", guess: str = "guess") -> DataFrame:
    """Share of rows whose labels are all right."""
    return df.groupBy(key).agg(F.bool_and(F.col(truth) == F.col(guess)).alias("right")).agg(F.avg(F.col("right").cast("double")).alias("accuracy"), F.count("*").alias("n"))


def multi_hot(df: DataFrame, key: str, label: str, labels: list[str]) -> DataFrame:
    """A column for each label, 1 where the row bears it; labels are given, so there is no pass to find them."""
    return df.groupBy(key).agg(*[F.max((F.col(label) == x).cast("int")).alias(x) for x in sorted(labels)])


def early_stop(losses: DataFrame, patience: int, delta: float, key: str = "run") -> DataFrame:
    """The epoch at which training stops: losses over the least so far plus delta count up, a new least resets."""
    fold = (
        f"aggregate(course, named_struct('least', cast('inf' as double), 'bad', 0, 'stop', cast(null as bigint)), (s, e) -> "
        f"if(s.stop is not null, s, if(e.loss < s.least, named_struct('least', e.loss, 'bad', 0, 'stop', s.stop), "
        f"if(e.loss > s.least + {delta}D, named_struct('least', s.least, 'bad', s.bad + 1, 'stop', if(s.bad + 1 >= {patience}, e.epoch, s.stop)), s))))"
    )
    return losses.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("epoch").cast("long").alias("epoch"), F.col("loss").cast("double").alias("loss")))).alias("course")).select(key, F.expr(fold)["stop"].alias("stop_epoch"))


def best_epoch(losses: DataFrame, key: str = "run") -> DataFrame:
    """The epoch of the least loss, the first of equals."""
    return losses.groupBy(key).agg(F.min_by("epoch", F.struct("loss", "epoch")).alias("best_epoch"), F.min("loss").alias("least_loss"))


def split_of(key: Column, test: float = 0.1, val: float = 0.11) -> Column:
    """train, val or test by a hash of the key: test first, then val of the rest."""
    at = F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(100_000)) / 100_000
    return F.when(at < test, "test").when(at < test + (1 - test) * val, "val").otherwise("train")


def exact_split(df: DataFrame, key: str, seed: int = 42, test: float = 0.1, val: float = 0.11) -> DataFrame:
    """df with split: exactly ceil(test * n) rows are test, ceil(val * rest) of the others val, and what is left train.

    Rows stand in the order of the sha256 of "<seed>:<key>", then of the key; the first are test, the next val. Their
    places come from sizes of ranges, not from one sorted task. A null key is an empty one; rows with the same key stand
    beside each other, in any order, and may be in several ranges. The driver sees the number of rows.
    """
    n = df.count()
    tests = math.ceil(test * n)
    vals = math.ceil(val * (n - tests))
    told = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256)
    placed = places(df.withColumns({"_all": F.lit(0), "_hash": told, "_row": F.monotonically_increasing_id()}), "_all", ["_hash", key, "_row"])
    return placed.withColumn("split", F.when(F.col("_n") < tests, "test").when(F.col("_n") < tests + vals, "val").otherwise("train")).drop("_all", "_hash", "_row", "_n")


def of_mode(df: DataFrame, mode: str) -> DataFrame:
    """The rows of a split: train, val or test; any other mode has all rows."""
    return df.where(F.col("split") == mode) if mode in ("train", "val", "test") else df


def window_count(events: DataFrame, ms: int, key: str, at: str) -> DataFrame:
    """Events of the key in the last ms milliseconds, both ends included."""
    w = Window.partitionBy(key).orderBy(at).rangeBetween(-ms, 0)
    return events.withColumn("recent", F.count("*").over(w))
