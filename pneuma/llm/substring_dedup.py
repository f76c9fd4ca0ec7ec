"""Removal of repeated passages of words, by a count-min prefilter and an exact second pass."""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, bit_filter, bytes_column, filter_bits, in_filter, mix, steps, window_hashes, word_hashes, word_keys, words, written

#: Words of the short run that stands for the windows around it; bytes of text to one such run, for the sketch's width.
ANCHOR, BYTES_PER_ANCHOR = 8, 80
_SEED = U64(0xA5B35705F2D1E9C7)


def _windows(column: pa.Array, width: int):
    """For each row: its number of words and their keys; the anchor of each window (its least run of ANCHOR words, by
    hash); and whether a window's anchor stands elsewhere than that of the window before."""
    anchor = min(ANCHOR, width)
    span = width - anchor + 1
    for _, data, off in steps(column):
        starts, ends, first = words(data, off)
        keys = word_keys(data, starts, ends)
        runs = window_hashes(word_hashes(keys), anchor)
        m = len(keys) - width + 1
        if m > 0:
            # Place of the least run in the next `span` ones, the leftmost of equals, by doubling.
            at, reach = np.arange(len(runs)), 1
            while 2 * reach <= span:
                a, b = at[:-reach], at[reach:]
                at, reach = np.where(runs[b] < runs[a], b, a), 2 * reach
            if reach < span:
                a, b = at[:m], at[span - reach : span - reach + m]
                at = np.where(runs[b] < runs[a], b, a)
            at = at[:m]
        for a, b in zip(first[:-1], first[1:], strict=True):
            n = int(b - a) - width + 1
            if n > 0:
                p = at[a : a + n]
                new = np.ones(n, bool)
                new[1:] = p[1:] != p[:-1]
                yield int(b - a), keys[a:b], runs[p], new
            else:
                yield int(b - a), None, None, None


def _digests(keys: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    """128 bits of BLAKE2b of the windows that begin at these words, as two columns."""
    flat = memoryview(np.ascontiguousarray(keys)).cast("B")
    size, blake = 16 * width, hashlib.blake2b
    told = b"".join([blake(flat[i : i + size], digest_size=16).digest() for i in (16 * at).tolist()])
    return np.frombuffer(told, "<i8").reshape(-1, 2)


def _counters(anchors: np.ndarray, wide: int) -> np.ndarray:
    """The counters of both rows of the sketch, the second row after the first."""
    a = mix(anchors + _SEED)
    return np.concatenate([anchors & U64(wide - 1), (a & U64(wide - 1)) + U64(wide)])


def _sketch(width: int, wide: int):
    """Counters that the windows of a batch touch, with their counts: a window counts once for each place of its anchor."""

    def run(batches):
        for batch in batches:
            parts = [anchor[new] for _, _, anchor, new in _windows(batch.column("text"), width) if anchor is not None]
            at, n = np.unique(_counters(np.concatenate(parts) if parts else np.zeros(0, U64), wide), return_counts=True)
            yield pa.record_batch([pa.array(at.astype(np.int64)), pa.array(n.astype(np.int64))], ["counter", "n"])

    return run


def _repeated(bits: np.ndarray, wide: int, anchor: np.ndarray) -> np.ndarray:
    """Whether both counters of each anchor are 2 or more."""
    both = in_filter(bits, _counters(anchor, wide))
    return both[: len(anchor)] & both[len(anchor) :]


def _candidates(width: int, wide: int, sketch):
    def run(batches):
        bits = np.asarray(sketch.value)
        for batch in batches:
            held, rows = [], 0
            k1, k2 = (batch.column(c).to_numpy() for c in ("k1", "k2"))
            for i, (_, keys, anchor, _) in enumerate(_windows(batch.column("text"), width)):
                at = np.flatnonzero(_repeated(bits, wide, anchor)) if keys is not None else ()
                for lo in range(0, len(at), 1 << 16):
                    part = at[lo : lo + (1 << 16)]
                    held.append((_digests(keys, width, part), np.full(len(part), k1[i]), np.full(len(part), k2[i]), part))
                    rows += len(part)
                    if rows >= 1 << 16:
                        yield _candidate_batch(held)
                        held, rows = [], 0
            if held:
                yield _candidate_batch(held)

    return run


def _candidate_batch(held) -> pa.RecordBatch:
    digest, k1, k2, pos = (np.concatenate(c) for c in zip(*held, strict=True))
    return pa.record_batch([pa.array(np.ascontiguousarray(c)) for c in (digest[:, 0], digest[:, 1], k1, k2, pos)], ["h1", "h2", "k1", "k2", "pos"])


def _cleaned(width: int, wide: int, sketch):
    def run(batches):
        bits = np.asarray(sketch.value)
        for batch in batches:
            n_words, n_removed, kept_text = [], [], []
            for text, single, (n, keys, anchor, _) in zip(batch.column("text"), batch.column("singles"), _windows(batch.column("text"), width), strict=True):
                parts = text.as_py().split()
                removed = 0
                if keys is not None:
                    starts = _repeated(bits, wide, anchor)
                    if single.is_valid:
                        starts[single.values.to_numpy()] = False
                    if starts.any():
                        edge = np.zeros(n + 1, np.int32)
                        edge[: len(starts)] += starts
                        edge[width : width + len(starts)] -= starts
                        keep = np.cumsum(edge)[:n] == 0
                        removed = n - int(keep.sum())
                        parts = compress(parts, keep.tolist())
                kept = b" ".join(parts)
                n_words.append(n), n_removed.append(removed), kept_text.append(kept)
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept_text, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"]
            )

    return run


def remove_repeats(docs: DataFrame, width: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each word covered by a window of width consecutive words that also starts anywhere else.

    Words are runs without \\x20 \\x09-\\x0D, as they are. Windows are judged on the input.

    1. Every partition sketches its windows in a count-min sketch of two rows; the sums of the partitions' sketches
       overestimate how often a window occurs. A window is counted under its anchor, the least of its runs of ANCHOR
       words, once for each place in which the anchor stands: equal windows have equal anchors, in different places, so
       the estimate of a repeated window is 2 or more. Counters of 2 or more go out as a bitmap of bounded size.
    2. Windows that are estimated repeated are grouped exactly, by 128 bits of BLAKE2b over their words' keys, with
       map-side combine. Those that turn out to be alone go back to their text; all other estimated windows are repeated.
    A sketch too narrow for its input lets more windows through to the second pass and changes no result.

    Null text: no words. Null or repeated ids are kept row by row; rows of equal text repeat each other.
    Returns doc_id, n_words, n_removed, kept (the kept words joined by one space, as UTF-8).
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col(id_col).alias("doc_id"), bytes_column(text_col).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    wide = filter_bits(size // BYTES_PER_ANCHOR, per_row=8, most=1 << 27)
    counters = rows.select("text").mapInArrow(_sketch(width, wide), "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n"))
    sketch = sc.broadcast(bit_filter(counters.where("n > 1").select("counter"), 2 * wide))

    keyed = rows.withColumn("k1", F.xxhash64("text")).withColumn("k2", F.xxhash64(F.lit(7), "text"))  # 128 bits name a text
    found = keyed.select("text", "k1", "k2").mapInArrow(_candidates(width, wide, sketch), "h1 long, h2 long, k1 long, k2 long, pos long")
    alone = found.groupBy("h1", "h2").agg(F.count("*").alias("n"), *[F.min(c).alias(c) for c in ("k1", "k2", "pos")]).where("n = 1")
    singles = written(alone.groupBy("k1", "k2").agg(F.collect_list(F.col("pos").cast("int")).alias("singles")), "windows-alone")
    # A text that occurs twice has no window alone, so each key of singles is that of one row; the rows of such a text
    # meet nothing in the join, and the adaptive skew join parts them.
    return (
        keyed.join(singles.hint("merge"), ["k1", "k2"], "left").select("doc_id", "text", "singles")
        .mapInArrow(_cleaned(width, wide, sketch), f"doc_id {id_type}, n_words long, n_removed long, kept binary")
    )
