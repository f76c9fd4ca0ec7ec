"""Exact deduplication by distributed most-significant-digit radix partitioning."""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written

#: Bytes that each level of the recursion splits by.
FIRST_DIGIT, GROWTH = 56, 16


def _normalised(batches):
    for batch in batches:
        text = pc.fill_null(batch.column("text"), "")
        low = pc.ascii_lower(text)
        sha = [hashlib.sha256(x.as_buffer()).hexdigest() for x in low]
        yield pa.record_batch([batch.column("doc_id"), pa.array(sha, pa.string()), pc.cast(low, pa.binary())], ["doc_id", "text_sha256", "rest"])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group documents whose texts are equal after lower-casing A-Z; of each group the row of the largest id stays.

    A document is read as its length in bytes followed by its bytes. The first level splits all documents by the
    length and the first FIRST_DIGIT bytes; each next level splits the groups that are left by GROWTH times as many
    successive bytes, until a group is a single document or its bytes have ended. Groups are compared by the bytes
    themselves, never by a digest. Each level counts with map-side combine and joins the counts back, so a group that
    holds a third of the rows is spread by the skew join and never gathered.

    Null text: empty, so null and empty texts are equal. Null id: smaller than any other id; keep_id is null if a
    group has no other. Rows that repeat an id are rows of their own: kept is true for all rows that bear keep_id.
    Returns doc_id, keep_id, group_size, kept, text_sha256, one row for each row of docs; nothing for no rows.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    base = (
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        .mapInArrow(_normalised, f"doc_id {id_type}, text_sha256 string, rest binary")
    )
    digit = lambda n: F.substring("rest", 1, n)
    left = base.select("doc_id", "text_sha256", F.octet_length("rest").alias("n_bytes"), F.lit(0).cast("long").alias("gid"), "rest")
    width, used, done = FIRST_DIGIT, 0, []
    while True:
        used += width
        split = left.withColumn("digit", digit(width))
        groups = split.groupBy("gid", "n_bytes", "digit").agg(F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id")).where("group_size > 1")
        # Ids of groups are fixed by writing them: a lost executor can't renumber them.
        groups = written(groups.withColumn("next_gid", F.monotonically_increasing_id()), "radix-groups")
        # The groups grow with the documents, so they are merged in and not broadcast, at any size.
        met = split.join(groups.hint("merge"), ["gid", "n_bytes", "digit"], "left")
        ended = F.col("group_size").isNull() | (F.col("n_bytes") <= used)
        level = written(
            met.select(
                "doc_id", "text_sha256", "n_bytes", ended.alias("ended"), F.col("next_gid").alias("gid"),
                F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
                F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
                F.when(~ended, F.expr(f"substring(rest, {width + 1})")).alias("rest"),
            ),
            "radix-level",
        )
        dropped(groups)
        done.append(level.where("ended"))
        left = level.where("not ended").select("doc_id", "text_sha256", "n_bytes", "gid", "rest")
        if left.isEmpty():
            break
        width *= GROWTH
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
