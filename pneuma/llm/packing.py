"""Vector best-fit packing of tokenised documents into training sequences."""

from __future__ import annotations

import functools
import os
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_column

#: Words in each of the two generations that a worker remembers; marks that are split off words.
CACHE_WORDS, _MARKS = 500_000, b".,;:!?%&*#$|()"
PIECE = "doc_id {id}, piece int, start long, length long, ids_crc32 long, lot long"


@functools.cache
def word_ids(tokenizer_path: str):
    """A function from a text's bytes to its ids as little-endian 32-bit integers.

    The vocabulary drops white space and never merges across it, so the ids of a text are those of its words;
    the words' ids are remembered, the longest unused ones given up first.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks share the cores already
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path)
    known: dict[bytes, bytes] = {}
    older: dict[bytes, bytes] = {}

    def look_up(new: list[bytes]) -> None:
        """Put the ids of new words into known: from the older ones, or from the tokenizer."""
        for w in new:
            if w in older:
                known[w] = older[w]
        new = [w for w in new if w not in known]
        for w, e in zip(new, tok.encode_batch_fast([w.decode("utf-8", "replace") for w in new], add_special_tokens=False), strict=True):
            known[w] = array("I", e.ids).tobytes()

    def encode(text: bytes) -> bytes:
        nonlocal known, older
        if b"<|" not in text:  # the vocabulary lower-cases all but its special tokens
            text = text.lower()
        parts = text.split()
        if new := {w for w in parts if w not in known}:
            if len(known) > CACHE_WORDS:
                known, older = {}, known
                new = set(parts)
            # Marks after an ASCII letter or digit are tokens of their own, so such a word is its stem and its marks.
            ends = {}
            for w in new:
                stem = w.rstrip(_MARKS)
                if len(stem) < len(w) and stem and stem[-1:].isalnum():
                    ends[w] = stem, w[len(stem) :]
            whole = new - ends.keys()
            whole.update(x for pair in ends.values() for x in pair if x not in known)
            look_up(list(whole))
            for w, (stem, marks) in ends.items():
                known[w] = known[stem] + known[marks]
        return b"".join(map(known.__getitem__, parts))

    return encode


def _pieces(tokenizer_path: str, capacity: int):
    def run(batches):
        encode = word_ids(tokenizer_path)
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column("text")):
                ids = encode(text.as_py()) + b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row.append(i), piece.append(k), start.append(at // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
            lot = np.asarray(batch.column("row"))[row] * 31 + np.asarray(piece, np.int64)
            yield pa.record_batch(
                [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(lot, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "lot"],
            )

    return run


def best_fit(lengths: np.ndarray, capacity: int, most_docs: int, most_cost: int, weights: tuple[float, float, float], rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, longest first.

    Each bin has three residuals: tokens, documents and attention cost (the sum of squared lengths). Of the bins that
    can take the item under all three, "norm" picks the one whose weighted residual vector is shortest afterwards,
    "dot" the one whose residual has the largest weighted dot product with the item.
    """
    n = len(lengths)
    full = np.array([capacity, most_docs, most_cost], float)
    w = np.asarray(weights, float)
    free = np.empty((n, 3))
    used = np.zeros(n, np.int64)
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    open_ids = np.empty(n, np.int64)  # bins with room for a token
    n_bins = n_open = 0
    for i in np.argsort(-lengths, kind="stable"):
        need = np.array([lengths[i], 1.0, float(lengths[i]) ** 2])
        best = -1
        if n_open:
            at = free[:n_open]
            fits = np.flatnonzero((at[:, 0] >= need[0]) & (at[:, 1] >= 1) & (at[:, 2] >= need[2]))
            if len(fits):
                if rule == "norm":
                    score = (((at[fits] - need) / full) ** 2) @ w
                    best = fits[np.argmin(score)]
                else:
                    best = fits[np.argmax(((at[fits] / full) * (need / full)) @ w)]
        if best < 0:
            best = n_open
            free[best], open_ids[best] = full, n_bins
            n_open, n_bins = n_open + 1, n_bins + 1
        k = open_ids[best]
        bins[i], offsets[i] = k, used[k]
        used[k] += lengths[i]
        free[best] -= need
        if free[best, 0] < 1 or free[best, 1] < 1 or free[best, 2] < 1:  # closed: the last open one takes its place
            n_open -= 1
            free[best], open_ids[best] = free[n_open], open_ids[n_open]
    return bins, offsets


def _packed(capacity, most_docs, most_cost, weights, rule):
    def run(key, table):
        table = table.sort_by([("length", "descending"), ("lot", "ascending"), ("piece", "ascending")])
        bins, offsets = best_fit(table["length"].to_numpy(), capacity, most_docs, most_cost, weights, rule)
        seq = (np.int64(key[0].as_py()) << 32) + bins
        return pa.table({n: table[n] for n in ("doc_id", "piece", "start", "length", "ids_crc32")} | {"sequence_id": pa.array(seq, pa.int64()), "offset": pa.array(offsets, pa.int64())})

    return run


def pack(
    docs: DataFrame, tokenizer_path: str, capacity: int = 2048, most_docs: int | None = None, most_cost: int | None = None,
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01), rule: str = "norm", lot_rows: int = 8_000, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Pack all documents into sequences of at most capacity tokens, as few as best-fit decreasing finds.

    A document is its ids and a final 0; only longer ones are cut, into pieces of capacity tokens. Pieces are dealt
    out to lots of about lot_rows at random, each lot is packed by best_fit(). The limits on documents and on
    attention cost are off (never binding) unless given. A lot leaves less than one sequence open, so lots cost at
    most one sequence in some thousands.

    Null or empty text: the single id 0. Null and repeated ids are packed row by row. No rows give no rows.
    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    lots = max(1, round(docs.count() / lot_rows))
    most_docs, most_cost = most_docs or capacity, most_cost or capacity * capacity
    pieces = docs.select(F.col(id_col).alias("doc_id"), bytes_column(text_col).alias("text"), F.monotonically_increasing_id().alias("row")).mapInArrow(
        _pieces(tokenizer_path, capacity), PIECE.format(id=id_type)
    )
    # The longest first: capacity pieces fill a sequence each, whichever lot they are in.
    dealt = pieces.withColumn("lot_key", F.pmod(F.xxhash64("lot"), F.lit(lots)))
    return dealt.groupBy("lot_key").applyInArrow(
        _packed(capacity, most_docs, most_cost, weights, rule), f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
