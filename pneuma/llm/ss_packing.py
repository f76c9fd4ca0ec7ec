"""Sum-of-squares online packing of tokenised documents into training sequences."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_column
from .packing import word_ids

#: How many rows of a lot bring their ids along, as a multiple of the square root of its rows.
FILL = 8.0
_PIECE = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, row long, ids binary"


class Levels:
    """Partly filled windows, counted by fill level.

    count[h] is the number of windows with h of `capacity` tokens. Placing an item of s tokens into a window of level h
    takes one from count[h] and adds one to count[h + s] (0 and capacity are not counted). The item goes where the sum of
    the squared counts becomes least; of equal sums to the fullest window, and to an empty one last.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.windows = 0

    def place(self, s: int) -> tuple[int, int]:
        """Window of an item, and its offset there."""
        c, count = self.capacity, self.count
        level = 0
        if s < c:
            # How the sum changes: 2 (count[h + s] - count[h]) + 2 within, 1 - 2 count[c - s] where the window is full.
            before, after = count[1 : c - s + 1], count[1 + s : c + 1]
            change = np.where(before > 0, 2 * (after - before) + 2, 1 << 40)
            if before[-1]:
                change[-1] = 1 - 2 * before[-1]
            k = len(change) - 1 - int(np.argmin(change[::-1]))
            if change[k] <= 2 * count[s] + 1:
                level = k + 1
        if level:
            window = self.at[level].pop()
            count[level] -= 1
        else:
            window = self.windows
            self.windows += 1
        if level + s < c:
            self.at[level + s].append(window)
            count[level + s] += 1
        return window, level

    def open(self) -> list[tuple[int, int]]:
        """(level, window) of all windows that are partly filled and would be padded: not those at a power of two."""
        return [(h, w) for h in np.flatnonzero(self.count).tolist() if h & (h - 1) for w in self.at[h]]


def pack_lot(lengths: list[int], ids: list[bytes | None], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(item, start in it, length, window, offset) of the pieces of a lot's items, which come in this order.

    Items without ids are placed whole by Levels, and then those with ids, as long as what is left of them can still
    fill every window that is open. The rest is cut to fill these windows, the fullest first, and what is over makes
    full windows and, of its last tokens, windows at powers of two. If the items with ids are too few, some windows
    stay open.
    """
    levels, out = Levels(capacity), []

    def whole(i: int) -> None:
        window, offset = levels.place(lengths[i])
        out.append((i, 0, lengths[i], window, offset))

    order = [i for i in range(len(lengths)) if ids[i] is None]
    for i in order:
        whole(i)
    loose = [i for i in range(len(lengths)) if ids[i] is not None]
    left = sum(lengths[i] for i in loose)
    while loose:
        i = loose[0]
        whole(i)
        if sum(capacity - h for h, _ in levels.open()) > left - lengths[i]:  # too late: this one is taken back and cut with the others
            _, _, length, window, offset = out.pop()
            _take_back(levels, window, offset, length)
            break
        left -= lengths[i]
        loose.pop(0)
    gaps = [(w, h, capacity) for h, w in sorted(levels.open(), reverse=True)]
    over = left - sum(end - h for _, h, end in gaps)
    while over > 0:  # new windows: full ones, then the powers of two that make up the remainder
        size = capacity if over >= capacity else 1 << (over.bit_length() - 1)
        gaps.append((levels.windows, 0, size))
        levels.windows, over = levels.windows + 1, over - size
    k, start = 0, 0
    for window, at, end in gaps:
        while at < end and k < len(loose):
            n = min(end - at, lengths[loose[k]] - start)
            out.append((loose[k], start, n, window, at))
            at, start = at + n, start + n
            if start == lengths[loose[k]]:
                k, start = k + 1, 0
    return out


def _take_back(levels: Levels, window: int, offset: int, length: int) -> None:
    level = offset + length
    if level < levels.capacity:
        levels.at[level].remove(window)
        levels.count[level] -= 1
    if offset:
        levels.at[offset].append(window)
        levels.count[offset] += 1
    else:
        levels.windows -= 1


def _pieces(tokenizer_path: str, capacity: int, last_id: int, one_in: int):
    end = int(last_id).to_bytes(4, "little")

    def run(batches):
        encode = word_ids(tokenizer_path)
        for batch in batches:
            rows = batch.column("row").to_pylist()
            at, start, length, crc, tokens, kept = [], [], [], [], [], []
            for i, text in enumerate(batch.column("text")):
                ids = encode(text.as_py()) + end
                for k in range(0, len(ids), 4 * capacity):
                    part = ids[k : k + 4 * capacity]
                    loose = len(part) < 4 * capacity and zlib.crc32(b"%d" % rows[i]) % one_in == 0
                    at.append(i), start.append(k // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part)), tokens.append(len(ids) // 4), kept.append(part if loose else None)
            longs = lambda x: pa.array(x, pa.int64())
            yield pa.record_batch(
                [batch.column("doc_id").take(longs(at)), longs(start), longs(length), longs(crc), longs(tokens), longs([rows[i] for i in at]), pa.array(kept, pa.binary())],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "row", "ids"],
            )

    return run


def _packed(capacity: int):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(key, table):
        # The order in which a lot's pieces come: any that does not follow their sizes.
        rows = table["row"].to_numpy().astype(np.uint64)
        table = table.take(pa.array(np.lexsort((table["start"].to_numpy(), rows * np.uint64(0x9E3779B97F4A7C15)))))
        ids, lengths = table["ids"].to_pylist(), table["length"].to_pylist()
        item, start, length, window, offset = (np.array(x, np.int64) for x in zip(*pack_lot(lengths, ids, capacity), strict=True))
        own = table.take(pa.array(item))
        crc = own["ids_crc32"].to_numpy().copy()
        for k in np.flatnonzero(length < own["length"].to_numpy()).tolist():  # cut: they have their ids
            crc[k] = zlib.crc32(ids[item[k]][4 * start[k] : 4 * (start[k] + length[k])])
        seq = (np.int64(key[0].as_py()) << 32) + window
        columns = [own["doc_id"], pa.array(own["start"].to_numpy() + start), pa.array(length), pa.array(crc), own["doc_tokens"], pa.array(seq), pa.array(offset)]
        return pa.table(dict(zip(names, columns, strict=True)))

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, last_id: int = 2, lot_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most capacity tokens with little padding, none at a power of two.

    A document is its ids and last_id. Of longer ones, pieces of capacity tokens are sequences of their own; what is
    left, and every shorter document, is placed whole and online by sum of squares (Levels), in lots of about lot_rows
    documents dealt out by row. Windows that are open at the end are filled by cutting the last documents of the lot:
    about FILL times the square root of its rows bring their ids along for this, the others only lengths and checksums.

    Null or empty text: last_id alone. Null and repeated ids are packed row by row. No rows give no rows.
    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    count = docs.count()
    lots = max(1, round(count / lot_rows))
    one_in = max(1, int((count / lots) ** 0.5 / FILL))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), bytes_column(f"`{text_col}`").alias("text"), F.monotonically_increasing_id().alias("row"))
    pieces = rows.mapInArrow(_pieces(tokenizer_path, capacity, last_id, one_in), _PIECE.format(id=id_type))
    dealt = pieces.withColumn("lot", F.pmod(F.xxhash64("row", "start"), F.lit(lots)))
    return dealt.groupBy("lot").applyInArrow(_packed(capacity), f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
