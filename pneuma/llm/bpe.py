"""Byte-level BPE by merge ranks, with a segment tree over byte positions."""

from __future__ import annotations

import base64
import functools
import struct

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_column

#: Chunks of text (between single spaces) in each of the two generations that a worker remembers.
CACHE_CHUNKS = 400_000
_NONE = 1 << 62


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int], pairs: list[int]) -> list[int]:
    """The ids of one match of the pattern; pairs has the rank of each two bytes, or -1.

    A segment tree with eight children a node. The leaf of position i holds the rank of the pair that starts there,
    above the position; so the root is the leftmost of the lowest pairs. A merge empties one leaf and sets those of the merged part and of the live
    neighbour before it, each a point update of logarithmic cost. A part's rank is its id.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    shift = n.bit_length()
    mask = (1 << shift) - 1
    leaves = [_NONE] * n
    last = piece[0]
    for i in range(1, n):
        byte = piece[i]
        r = pairs[last << 8 | byte]
        if r >= 0:
            leaves[i - 1] = r << shift | i - 1
        last = byte
    blocks = [min(leaves[k : k + 8]) for k in range(0, n, 8)]
    levels = [blocks]
    while len(low := levels[-1]) > 8:
        levels.append([min(low[k : k + 8]) for k in range(0, len(low), 8)])
    root, upper = levels[-1], list(zip(levels[:-1], levels[1:], strict=True))
    ids: list[int | None] = [None] * n
    after = list(range(1, n + 2))
    before = list(range(-1, n))
    get = ranks.get
    while (top := min(root)) != _NONE:
        i = top & mask
        ids[i] = top >> shift
        j = after[i]
        end = after[i] = after[j]
        before[end] = i
        ids[j] = None
        leaves[j] = leaves[i] = _NONE
        if end < n and (r := get(piece[i : after[end]])) is not None:
            leaves[i] = r << shift | i
        k = i >> 3
        if (m := j >> 3) != k:
            blocks[m] = min(leaves[8 * m : 8 * m + 8])
        if i:
            h = before[i]
            if (r := get(piece[h:end])) is None:
                leaves[h] = _NONE
            else:
                leaves[h] = r << shift | h
            if (g := h >> 3) != k:
                blocks[g] = min(leaves[8 * g : 8 * g + 8])
        else:
            g = k
        blocks[k] = min(leaves[8 * k : 8 * k + 8])
        touched = {g >> 3, k >> 3, m >> 3} if upper else ()
        for low, high in upper:
            for k in touched:
                high[k] = min(low[8 * k : 8 * k + 8])
            touched = {k >> 3 for k in touched}
    out, i = [], 0
    while i < n:
        r = ids[i]
        out.append(get(piece[i : i + 1]) if r is None else r)
        i = after[i]
    return out


class Codec:
    """encode() and decode() with a bounded memory of chunks."""

    def __init__(self, rank_path: str, pattern: str):
        self.ranks = load_ranks(rank_path)
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        self.pairs = [self.ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pieces: dict[str, list[int]] = {}

    def _chunk(self, chunk: str) -> bytes:
        out = self.known.get(chunk) or self.older.get(chunk)
        if out is None:
            ids: list[int] = []
            for m in self.find(chunk):
                found = self.pieces.get(m)
                if found is None:
                    found = merge(m.encode(), self.ranks, self.pairs)
                    if len(m) <= 32:
                        if len(self.pieces) >= CACHE_CHUNKS:
                            self.pieces.clear()
                        self.pieces[m] = found
                ids += found
            out = struct.pack(f"<{len(ids)}i", *ids)
        if len(chunk) <= 64:
            if len(self.known) >= CACHE_CHUNKS:
                self.known, self.older = {}, self.known
            self.known[chunk] = out
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers.

        A match of the pattern never spans the place before a single space that a word follows, so text without
        double spaces is looked up in chunks there; other text goes to the pattern whole.
        """
        if "  " in text:
            return b"".join([self._chunk(m) for m in self.find(text)])
        parts = text.split(" ")
        chunk = self._chunk
        out = [chunk(parts[0])] if parts[0] else []
        for p in parts[1:]:
            p = " " + p
            out.append(self.known.get(p) or chunk(p))
        return b"".join(out)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@functools.cache
def codec(rank_path: str, pattern: str) -> Codec:
    """One for each worker process, so that what it remembers outlasts a task."""
    return Codec(rank_path, pattern)


def _run(rank_path: str, pattern: str, decode: bool):
    def run(batches):
        own = codec(rank_path, pattern)
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                packed = [own.encode(t.as_py().decode("utf-8", "replace")) for t in part.column("text")]
                offsets = np.zeros(len(packed) + 1, np.int32)
                np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
                values = np.frombuffer(b"".join(packed), "<i4")
                columns = [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))]
                if decode:
                    ids = values.tolist()
                    columns.append(pa.array([own.decode(ids[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary()))
                yield pa.record_batch(columns, ["doc_id", "ids", "decoded"][: len(columns)])

    return run


def encode(docs: DataFrame, rank_path: str, pattern: str, decode: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids of every whole text; with decode also the bytes that those ids stand for.

    Null text: empty, and so no ids. Ids may be null or repeated: rows are independent. No shuffle.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), bytes_column(text_col).alias("text")).mapInArrow(
        _run(rank_path, pattern, decode), f"doc_id {id_type}, ids array<int>" + ", decoded binary" * decode
    )
