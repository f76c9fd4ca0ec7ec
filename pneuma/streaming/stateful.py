"""Streams that keep state of their own for each key: exact sliding counts, and changes without flutter.

Both need the RocksDB state store, which holds state on disk and not in the executors' memory: see use_rocksdb().
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

#: Milliseconds of the sliding window and of the pause after a change, and the count that makes a ratio of 1 (fixed values).
WINDOW_MS, PAUSE_MS, FULL = 500, 2000, 15


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Recent(StatefulProcessor):
    """Events wait until the watermark has passed them, as any earlier one may still come; then each is counted with those
    of the window before it, and only times that a later window can reach are kept."""

    def __init__(self, key: str, window: int):
        self.key, self.window = key, window

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ms bigint, seq bigint")
        self.passed = handle.getListState("passed", "ms bigint")
        self.done = handle.getValueState("done", "ms bigint")

    def handleInputRows(self, key, rows, timerValues):
        told = self.done.get() if self.done.exists() else None
        fresh = [(r["ms"], r["seq"]) for r in rows if told is None or r["ms"] > told[0]]
        if fresh:
            self.waiting.appendList(fresh)
            self.handle.registerTimer(min(fresh)[0] + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        mark = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(self.waiting.get())
        ready = waiting[: bisect_left(waiting, (mark,))]
        passed = sorted(ms for (ms,) in self.passed.get())
        times = sorted(passed + [ms for ms, _ in ready])
        out = [Row(**{self.key: key[0], "seq": seq, "ms": ms, "recent": bisect_right(times, ms) - bisect_left(times, ms - self.window)}) for ms, seq in ready]
        left = waiting[len(ready) :]
        kept = times[bisect_left(times, mark - self.window) :]
        for state, values in ((self.waiting, left), (self.passed, [(ms,) for ms in kept])):
            state.put(values) if values else state.clear()
        if left or kept:  # wake for the next event, or to drop the last times
            self.handle.registerTimer(left[0][0] + 1 if left else kept[-1] + self.window + 1)
            if ready:
                self.done.update((ready[-1][0],))
        else:
            self.done.clear()
        return iter(out)


def recent_counts(stream: DataFrame, key: str, at: str, seq: str, late: str, window_ms: int = WINDOW_MS) -> DataFrame:
    """Every event with the number of its key's events in the window_ms milliseconds before it, both ends and events of
    the same millisecond included: what metrics.window_count() gives for the whole table at once.

    An event is told once the watermark, `late` behind the latest event, has passed it; until then events that come late
    still count. Those later than the watermark are dropped. State of a key: events not told yet, and the times of one
    window; none once a window has passed without events. Columns: key, seq, ms, recent, ratio (recent / 15, at most 1).
    """
    rows = stream.withWatermark(at, late).select(F.col(key).alias("_k"), at, F.unix_millis(at).alias("ms"), F.col(seq).cast("long").alias("seq"))
    kind = stream.schema[key].dataType.simpleString()
    told = rows.groupBy("_k").transformWithState(_Recent("_k", window_ms), f"_k {kind}, seq bigint, ms bigint, recent bigint", "Append", "EventTime")
    return told.withColumn("ratio", F.least(F.col("recent") / FULL, F.lit(1.0))).withColumnRenamed("_k", key)


class _Settled(StatefulProcessor):
    """Last value told, last value seen, its seq, end of the pause and the time at which to forget."""

    def __init__(self, kind: str, pause: int, forget: int, event_time: bool):
        self.kind, self.pause, self.forget, self.event_time = kind, pause, forget, event_time

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", f"told {self.kind}, seen {self.kind}, seq bigint, until bigint, forget bigint")

    def _tell(self, key, value, seq, now):
        """The row, and the state after it: a pause begins, and its end is a timer."""
        self.handle.registerTimer(now + self.pause)
        return Row(key=key[0], value=value, seq=seq, ms=now), (value, value, seq, now + self.pause, now + self.forget)

    def handleInputRows(self, key, rows, timerValues):
        out, state = [], self.state.get() if self.state.exists() else None
        for ms, seq, value in sorted((r["ms"], r["seq"], r["value"]) for r in rows):
            now = ms if self.event_time else timerValues.getCurrentProcessingTimeInMs()
            if self.event_time and state:
                more, state = self._passed(key, state, now - 1)
                out += more
            if state is None or (now >= state[3] and value != state[0]):
                row, state = self._tell(key, value, seq, now)
                out.append(row)
            else:
                state = (state[0], value, seq, state[3], now + self.forget)
        self.state.update(state)
        self.handle.registerTimer(state[4])
        return iter(out)

    def _passed(self, key, state, now):
        """What the end of the pause tells: the value seen last, if it is another. Then the next pause begins."""
        out = []
        while state[3] <= now and state[1] != state[0]:
            row, after = self._tell(key, state[1], state[2], state[3])
            out.append(row)
            state = (*after[:4], max(after[4], state[4]))
        return out, state if state[4] > now else None

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if not self.state.exists():
            return iter(())
        now = timerValues.getCurrentWatermarkInMs() if self.event_time else timerValues.getCurrentProcessingTimeInMs()
        out, state = self._passed(key, self.state.get(), now)
        self.state.update(state) if state else self.state.clear()
        return iter(out)


def settled_changes(
    stream: DataFrame, key: str, value: str, seq: str, at: str | None = None, late: str = "0 seconds", pause_ms: int = PAUSE_MS, forget_ms: int = 3_600_000
) -> DataFrame:
    """A row whenever the value of a key is another than the one told last, but none within pause_ms after such a row.

    The first value of a key is told, and so is a change outside a pause, at once. At the end of a pause the value seen
    last is told if it is another than before, and a new pause begins; so a burst that ends where it began to change gives
    one row. By processing time, or by the event time `at`; then events must come in order within each key (`late` is
    the watermark's delay, by which ends of pauses are told). State of a key is dropped forget_ms after its last event;
    what comes later counts as a first value. Columns: key, value, seq (of the event that brought the value), ms (when).
    """
    by_event = at is not None
    rows = stream.withWatermark(at, late) if by_event else stream
    ms = F.unix_millis(at) if by_event else F.lit(0).cast("long")
    rows = rows.select(F.col(key).alias("key"), *([at] if by_event else []), ms.alias("ms"), F.col(seq).cast("long").alias("seq"), F.col(value).alias("value"))
    kinds = {c: stream.schema[c].dataType.simpleString() for c in (key, value)}
    told = rows.groupBy("key").transformWithState(
        _Settled(kinds[value], pause_ms, forget_ms, by_event), f"key {kinds[key]}, value {kinds[value]}, seq bigint, ms bigint", "Append", "EventTime" if by_event else "ProcessingTime"
    )
    return told.select(F.col("key").alias(key), F.col("value").alias(value), "seq", "ms")
