"""Streams: results as they finish, seen keys, and sliding counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_seen(stream: DataFrame, key: str, at: str, within: str) -> DataFrame:
    """The first row of each key; state is kept for as long as `within`."""
    return stream.withWatermark(at, within).dropDuplicatesWithinWatermark([key])


def sliding_counts(stream: DataFrame, key: str, at: str, width: str, slide: str, late: str) -> DataFrame:
    """Events of each key in sliding windows; rows later than `late` are dropped."""
    return stream.withWatermark(at, late).groupBy(key, F.window(at, width, slide)).agg(F.count("*").alias("n")).select(key, F.col("window.start").alias("start"), "n")


def status_table(stream: DataFrame, key: str, status: str, seq: str) -> DataFrame:
    """The latest status of each key so far (output mode complete or update)."""
    return stream.groupBy(key).agg(F.max_by(status, seq).alias(status))


def changes(stream: DataFrame, key: str, value: str) -> DataFrame:
    """key, value and seq whenever the value of a key differs from the one it had before, across batches.

    A stream of key, value and seq (long); a key's rows of a batch are taken in the order of seq. The state of a key is
    its last value.
    """
    import pandas as pd

    kind = stream.schema[value].dataType.simpleString()

    def told(own, batches, state):
        last = state.get[0] if state.exists else None
        fresh = not state.exists
        out = []
        for frame in [pd.concat(list(batches)).sort_values("seq")]:
            for v, s in zip(frame[value], frame["seq"], strict=True):
                if fresh or v != last:
                    out.append((own[0], v, s))
                fresh, last = False, v
        state.update((last,))
        yield pd.DataFrame(out, columns=[key, value, "seq"])

    rows = stream.select(key, value, F.col("seq").cast("long").alias("seq"))
    return rows.groupBy(key).applyInPandasWithState(told, f"{key} {stream.schema[key].dataType.simpleString()}, {value} {kind}, seq long", f"last {kind}", "append", "NoTimeout")
