"""Helpers shared by the corpus operators."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_P = U64(0x9E3779B97F4A7C15 | 1)
_Q = U64(0xD6E8FEB86659FD93)
_PINV = U64(pow(int(_P), -1, 1 << 64))
#: Bytes of text that one numpy step works on (a longer document is a step of its own).
STEP_BYTES = 1 << 21


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a temporary one only where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is unset; a cluster needs a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-pneuma-")
        spark.sparkContext.setCheckpointDir(base)
        spark.conf.set("pneuma.shared.dir", base)
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete what written() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for d in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = spark._jvm.org.apache.hadoop.fs.Path(d)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def bytes_column(name: str = "text") -> F.Column:
    """The column as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b"").cast("binary"))


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3, on unsigned arrays."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


_powers = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        base = np.full(n, _P if kind == "up" else _PINV, U64)
        base[0] = 1
        _powers[kind] = np.cumprod(base)
    return _powers[kind][:n]


def steps(column: pa.Array):
    """(first row, numpy bytes, row offsets) for runs of rows of about STEP_BYTES of a binary column without nulls."""
    column = column.cast(pa.large_binary())
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(off, off[i] + STEP_BYTES, "right")) - 1)
        j = min(j, len(column))
        yield i, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word (runs without \\x20 \\x09-\\x0D, never across rows), and the first word of each row."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    solid = (data != 32) & ((data < 9) | (data > 13))
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def word_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128 bits for each word, as two columns: the bytes themselves and their number up to 15 bytes, or else a digest.

    So different words of up to 15 bytes always differ; longer ones by 120 bits of BLAKE2b.
    """
    if not len(starts):
        return np.zeros((0, 2), U64)
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    eight = np.ndarray((len(data) + 9,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    length = ends - starts
    keys = np.empty((len(starts), 2), U64)
    keys[:, 0] = eight[starts] & _MASK[np.minimum(length, 8)]
    keys[:, 1] = (eight[np.minimum(starts + 8, len(data))] & _MASK[np.clip(length - 8, 0, 7)]) | (np.minimum(length, 15).astype(U64) << U64(56))
    long = np.flatnonzero(length > 15)
    if len(long):
        whole = data.tobytes()
        told = b"".join([hashlib.blake2b(whole[i:j], digest_size=16).digest() for i, j in zip(starts[long].tolist(), ends[long].tolist(), strict=True)])
        keys[long] = np.frombuffer(told, "<u8").reshape(-1, 2)
        keys[long, 1] |= U64(0xFF) << U64(56)
    return keys


def word_hashes(keys: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's key."""
    return mix(mix(keys[:, 0] + _Q) * _P + mix(keys[:, 1] ^ _Q))


def window_hashes(h: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of width consecutive hashes (one fewer than len(h) - width + 2 of them)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    h = mix(h + U64(seed)) if seed else h
    if width <= 8:
        out = np.zeros(n, U64)
        for k in range(width):
            out = out * _P + h[k : k + n]
        return mix(out)
    total = np.zeros(len(h) + 1, U64)
    np.cumsum(h * _power("up", len(h)), out=total[1:])
    return mix((total[width:] - total[:n]) * _power("down", len(h))[:n])


def bit_filter(hashes: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of `bits` bits, a power of two from 2^15, that has the bit h mod bits of every h in the one column.

    It is built by Spark's bitmap aggregates and gathered as blocks of 4 KB, so its size is that of the bitmap.
    """
    at = (F.pmod(F.col(hashes.columns[0]), F.lit(bits)) + 1).alias("at")
    blocks = hashes.select(at).groupBy(F.expr("bitmap_bucket_number(at)").alias("block")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at))").alias("bitmap"))
    out = np.zeros(bits // 8, np.uint8)
    for block, bitmap in blocks.collect():
        out[(block - 1) * 4096 : block * 4096] = np.frombuffer(bitmap, np.uint8)
    return out


def filter_bits(rows: int, per_row: int = 16, most: int = 1 << 27) -> int:
    """Bits for a filter over so many rows: a power of two from 2^16 to most."""
    return max(1 << 16, min(most, 1 << max(1, rows * per_row - 1).bit_length()))


def in_filter(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the bit of each unsigned hash is set."""
    at = (h & U64(8 * len(bitmap) - 1)).astype(np.int64)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
