"""Sharding by sampled splitters, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, written

#: Expected size of the key sample on the driver, and the most ranges it is cut into.
SAMPLE_KEYS, MOST_RANGES = 40_000, 4_096


def _bisect(bounds: list[int], key: F.Column) -> F.Column:
    """How many of the sorted bounds are <= key, by binary search."""
    if not bounds:
        return F.lit(0)
    found = F.array(*[F.lit(b) for b in bounds])
    hops = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(hops, F.lit(0), lambda at, hop: F.when((at + hop <= len(bounds)) & (F.try_element_at(found, at + hop) <= key), at + hop).otherwise(at))


def _quantiles(keys: list[int], n: int) -> list[int]:
    """n - 1 cuts of the sorted keys into parts of equal number; a key that fills several parts comes several times."""
    return [keys[len(keys) * k // n] for k in range(1, n)] if len(keys) >= n else []


def _drawn(rows: DataFrame, chance: F.Column, seed: int) -> DataFrame:
    return rows.where((F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(1 << 30)) / float(1 << 30)) < chance)


def shard(docs: DataFrame, shards: int = 24, rows_per_range: int = 500_000, by: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Deal the rows of docs out to shards of near equal bytes.

    1. A size-weighted sample of the key (a hash of the text) gives quantile boundaries, at least twice as many ranges
       as shards; records are range-partitioned there.
    2. Ranges of more than twice the mean rows are subdivided at quantiles of a second sample, drawn from them alone.
       A key that fills two quantiles or more is a range of its own, and is cut by row into as many parts.
    3. Exact running totals of the ranges' sizes place each record: shard = the part of the total, in key order, that
       holds the record's middle byte. So a shard's bytes differ from the mean by at most the largest record.
    Equal texts have one key. A group of them no larger than the largest record moves as one, unless it is itself cut
    for filling more than a range.

    Size: UTF-8 bytes plus 8; a null text counts as empty, and its crc32 is 0.
    Null or repeated ids are dealt out like others, row by row; an empty table gives no rows.
    Only id_col and the text are read, so other columns may have any names.
    The driver sees two bounded samples of keys and one row a range (MOST_RANGES, and as many once subdivided).
    """
    text = F.col(by)
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("key"),
        F.monotonically_increasing_id().alias("row"),
    ).checkpoint()
    rows, total, largest = base.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()
    n_ranges = min(MOST_RANGES, max(2 * shards, rows // rows_per_range))

    picked = _drawn(base, F.lit(SAMPLE_KEYS / max(total, 1)) * F.col("size"), 3)
    keys = sorted(r[0] for r in picked.select("key").limit(4 * SAMPLE_KEYS).collect())
    bounds = sorted(set(_quantiles(keys, n_ranges)))
    most = max(1.0, 2.0 * rows / (len(bounds) + 1))
    ranged = base.withColumn("range", _bisect(bounds, F.col("key")))
    full = {r[0]: r[1] for r in ranged.groupBy("range").count().where(F.col("count") > most).collect()}
    alone: dict[int, int] = {}
    if full:
        chosen = _drawn(ranged.where(F.col("range").isin(sorted(full))), F.lit(SAMPLE_KEYS / sum(full.values())), 5)
        again: dict[int, list[int]] = {}
        for at, key in chosen.select("range", "key").limit(4 * SAMPLE_KEYS).collect():
            again.setdefault(at, []).append(key)
        for at, found in again.items():
            cuts = _quantiles(sorted(found), max(2, min(MOST_RANGES // len(full), 1 + int(2 * full[at] // most))))
            bounds.extend(cuts)
            for key in {k for k in cuts if cuts.count(k) > 1}:
                alone[key] = cuts.count(key)
                bounds.append(min(key + 1, (1 << 63) - 1))
        bounds = sorted(set(bounds))
        ranged = base.withColumn("range", _bisect(bounds, F.col("key")))
    parts = {bounds.index(key) + 1: n for key, n in alone.items()} or {-1: 1}
    cut = F.create_map(*[F.lit(x) for pair in sorted(parts.items()) for x in pair])
    part = F.pmod(F.xxhash64(F.lit(7), "row"), F.coalesce(F.try_element_at(cut, F.col("range")), F.lit(1))).cast("int")
    # A checkpoint would keep that range follows from key, and the optimizer then looks for key among the offsets.
    ranged = written(ranged.withColumn("part", part), "sharding-ranges")

    # One row for each range: where its bytes and rows begin in the whole order.
    ahead = Window.orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("range", "part").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
        .select("range", "part", F.coalesce(F.sum("b").over(ahead), F.lit(0)).alias("b0"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("n0"))
    )
    inside = Window.partitionBy("range", "part").orderBy("key", "row")
    group = Window.partitionBy("range", "part", "key")
    placed = (
        ranged.join(F.broadcast(offsets), ["range", "part"])
        .withColumn("nth", F.row_number().over(inside) - 1)
        .withColumn("start", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("unit", F.sum("size").over(group))
        .withColumn("unit_start", F.min("start").over(group))
        .withColumn("middle", F.col("b0") + F.when(F.col("unit") <= largest, F.col("unit_start") + F.col("unit") / 2).otherwise(F.col("start") + F.col("size") / 2))
        .withColumn("shard", F.least(F.lit(shards - 1), F.floor(F.col("middle") * shards / F.lit(float(max(total, 1))))).cast("int"))
        .withColumn("index", (F.col("n0") + F.col("nth")).cast("long"))
        .select("doc_id", "size", "text_crc32", "shard", "index")
        .checkpoint()
    )
    dropped(ranged)
    first = placed.groupBy("shard").agg(F.min("index").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("index") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
