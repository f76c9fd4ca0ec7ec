"""Streams against a plain replay of their events, batch by batch."""

import collections
import random
import time

import pytest
from pyspark.sql import functions as F

from pneuma.operators import metrics
from pneuma.streaming import results, stateful

BASE = 1_700_000_000_000


@pytest.fixture(scope="module", autouse=True)
def rocksdb(spark):
    stateful.use_rocksdb(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def _source(spark, path, batches, schema):
    """A stream that reads one batch a trigger, in order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).withColumn("t", F.timestamp_millis(F.col("ms"))).coalesce(1).write.parquet(f"{path}/all/{i}")
    kind = spark.read.parquet(f"{path}/all/0").schema
    return kind


def _feed(spark, path, kind, out, name, batches):
    """Run the stream over the batches, each put in place once the one before is done."""
    stream = spark.readStream.schema(kind).parquet(f"{path}/in")
    query = out(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{path}/ck-{name}").start()
    try:
        for i in range(batches):
            spark.read.parquet(f"{path}/all/{i}").write.mode("append").parquet(f"{path}/in")
            query.processAllAvailable()
        time.sleep(1)
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.table(name).collect()


def test_recent_counts_are_those_of_the_batch(spark, tmp_path):
    """Late rows within the watermark count, those beyond it are left out of all counts."""
    rng = random.Random(5)
    events, seq = [], 0
    for batch in range(4):
        rows = []
        for _ in range(60):
            seq += 1
            rows.append((rng.choice("aab"), BASE + batch * 900 + rng.randrange(-700, 900), seq))
        events.append(rows)
    events[1] += [("a", BASE + 500, 900), ("a", BASE + 500, 901)]  # the same millisecond
    events[3].append(("a", BASE - 5000, 902))  # beyond the watermark
    events.append([("z", BASE + 60_000, 903)])  # moves the watermark on
    events.append([("z", BASE + 90_000, 904)])
    (tmp_path / "in").mkdir()
    kind = _source(spark, str(tmp_path), events, "k string, ms long, seq long")
    got = _feed(spark, str(tmp_path), kind, lambda s: stateful.recent_counts(s, "k", "t", "seq", "2 seconds"), "recent", len(events))
    every = spark.createDataFrame([r for b in events for r in b if r[2] < 902], "k string, ms long, seq long")
    want = {(r.k, r.seq, r.recent) for r in metrics.window_count(every, 500, "k", "ms").collect()}
    assert {(r.k, r.seq, r.recent) for r in got if r.k != "z"} == want and len(got) == len(want) + 1
    assert all(r.ratio == min(r.recent / 15, 1) for r in got) and max(r.recent for r in got) > 15


def _replayed(events, pause, forget):
    """The changes told, from events (ms, seq, value) of one key in order."""
    out, told, seen, until, last = [], None, None, None, None
    for ms, seq, value in [*events, (10**15, None, None)]:
        while until is not None and until < ms and seen[0] != told:
            told = seen[0]
            out.append((told, seen[1], until))
            until += pause
        if until is not None and ms > last + forget:
            told = seen = until = None
        if seq is None:
            break
        last = ms
        if until is None or (ms >= until and value != told):
            out.append((value, seq, ms))
            told, until = value, ms + pause
        seen = (value, seq)
    return out


def test_settled_changes_by_event_time(spark, tmp_path):
    rng = random.Random(3)
    keys = {k: [] for k in "ab"}
    seq, now, batches = 0, BASE, []
    for _ in range(5):
        rows = []
        for _ in range(25):
            now += rng.choice([50, 400, 900, 2500])
            seq += 1
            row = (rng.choice("ab"), now, seq, rng.choice(["dark", "light", "light"]))
            rows.append(row)
            keys[row[0]].append((row[1], row[2], row[3]))
        batches.append(rows)
    late = now + 1_000_000  # long after: the state is dropped, and the same value is told anew
    batches += [[("a", late, 900, keys["a"][-1][2])], [("z", late + 50_000, 901, "x")], [("z", late + 90_000, 902, "x")]]
    keys["a"].append((late, 900, keys["a"][-1][2]))
    (tmp_path / "in").mkdir()
    kind = _source(spark, str(tmp_path), batches, "k string, ms long, seq long, v string")
    got = _feed(spark, str(tmp_path), kind, lambda s: stateful.settled_changes(s, "k", "v", "seq", at="t", forget_ms=60_000), "settled", len(batches))
    for k, events in keys.items():
        assert sorted((r.v, r.seq, r.ms) for r in got if r.k == k) == sorted(_replayed(events, 2000, 60_000)), k
    assert any(r.seq == 900 for r in got)


def test_settled_changes_by_the_clock(spark, tmp_path):
    """A burst that ends at the value it changed to gives one row; state goes after a while."""
    batches = [[("a", 0, 1, "x")], [("a", 0, s, v) for s, v in enumerate(["y", "x", "y", "x"], 2)], [("a", 0, 9, "x")]]
    (tmp_path / "in").mkdir()
    kind = _source(spark, str(tmp_path), batches, "k string, ms long, seq long, v string")
    stream = spark.readStream.schema(kind).parquet(f"{tmp_path}/in")
    told = stateful.settled_changes(stream, "k", "v", "seq", pause_ms=4000, forget_ms=6000)
    query = told.writeStream.format("memory").queryName("clock").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").start()
    rows = lambda: [(r.v, r.seq) for r in spark.table("clock").collect()]

    def wait(n):  # batches go on without data, as timers are due by the clock
        end = time.time() + 40
        while len(rows()) < n and time.time() < end:
            time.sleep(0.2)
        return rows()

    try:
        spark.read.parquet(f"{tmp_path}/all/0").write.mode("append").parquet(f"{tmp_path}/in")
        assert wait(1) == [("x", 1)]
        spark.read.parquet(f"{tmp_path}/all/1").write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(14)
        assert rows() == [("x", 1)]
        spark.read.parquet(f"{tmp_path}/all/2").write.mode("append").parquet(f"{tmp_path}/in")
        assert wait(2) == [("x", 1), ("x", 9)]
    finally:
        query.stop()


def test_results_sink_is_idempotent(spark, tmp_path):
    out = str(tmp_path / "table")
    batches = [[("p1", 1, "Queued", ""), ("p2", 2, "Queued", ""), ("p1", 3, "Completed", "")], [("p2", 4, "Failed", "no page"), ("p3", 5, "Queued", "")], [("p3", 6, "Completed", "")]]
    schema = "path string, seq long, status string, message string"
    frames = [spark.createDataFrame(b, schema) for b in batches]
    (tmp_path / "in").mkdir()
    query = spark.readStream.schema(frames[0].schema).parquet(f"{tmp_path}/in").writeStream.foreachBatch(results.finished(out)).option("checkpointLocation", f"{tmp_path}/ck").start()
    seen = []
    try:
        for f in frames:
            f.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            query.processAllAvailable()
            seen.append({r.path: r.status for r in results.statuses(spark, out, f.schema, "path", "seq").collect()})
    finally:
        query.stop()
    assert seen == [{"p1": "Completed", "p2": "Queued"}, {"p1": "Completed", "p2": "Failed", "p3": "Queued"}, {"p1": "Completed", "p2": "Failed", "p3": "Completed"}]
    now = lambda: collections.Counter(tuple(r) for r in results.statuses(spark, out, frames[0].schema, "path", "seq").collect())
    before, rows = now(), spark.read.parquet(out).count()
    results.finished(out)(frames[1], 1)  # the batch comes again
    assert now() == before and spark.read.parquet(out).count() == rows == 6
    results.merged(spark, out, frames[0].schema, "path", "seq", 1)
    assert now() == before and spark.read.parquet(out).count() == 4
    results.merged(spark, out, frames[0].schema, "path", "seq", 1)
    assert now() == before
    told = results.progress(results.statuses(spark, out, frames[0].schema, "path", "seq"), 4).first()
    assert (told.completed, told.failed, told.percent, told.message) == (2, 1, 75, "Processed 3/4")
