"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of the training sample: confirmed toxic ones, and unlabelled text. Features that the classifier keeps.
MOST_POSITIVE, MOST_UNLABELLED, MOST_FEATURES = 3_000, 6_000, 4_000
#: Buckets of the feature hash, words whose features a worker remembers at most, and the longest of them.
BUCKETS, CACHE_WORDS, CACHED_LENGTH = 1 << 22, 150_000, 100
_WORD = re.compile(r"[^\W_]+")


def text_words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def features(word: str) -> list[int]:
    """Hashed features of a word: itself, its first 4 to 6 letters and its 5-letter parts, however long it is."""
    w = f"^{word}$"
    parts = {w, *(w[:n] for n in (5, 6, 7) if n < len(w)), *(w[i : i + 5] for i in range(1, len(w) - 4))}
    return [zlib.crc32(p.encode()) % BUCKETS for p in parts]


def _remainder(column: str) -> F.Column:
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 5


def _sampled(batches):
    for part in (b.slice(lo, 250) for b in batches for lo in range(0, len(b), 250)):  # a few texts at once, as words take much memory
        words = pa.array([sorted(text_words(t.as_py())) for t in part.column("text")], pa.list_(pa.string()))
        yield pa.record_batch([part.column("positive"), part.column("other"), words], ["positive", "other", "words"])


def fit(table: pa.Table, prior: float, epochs: int = 300, rate: float = 0.05, decay: float = 1e-4) -> dict:
    """Weights of a logistic model under the non-negative risk of Kiryo et al. (2017).

    risk = prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)]); where the second part falls below 0,
    the step goes against it. Features present in a text count once; those kept are the ones whose share of positive
    texts most exceeds that of unlabelled ones (by the G statistic).
    """
    empty = {"weights": {}, "bias": -2.0}
    lists = pc.list_flatten(table["words"]).combine_chunks().dictionary_encode()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    vocabulary = [features(w) for w in lists.dictionary.to_pylist()]
    n_of = np.array([len(v) for v in vocabulary], np.int64)
    flat = np.fromiter((x for v in vocabulary for x in v), np.int64, n_of.sum())
    begin = np.concatenate([[0], np.cumsum(n_of)])
    codes = lists.indices.to_numpy(zero_copy_only=False)
    rows = np.concatenate([[0], np.cumsum(pc.list_value_length(table["words"]).to_numpy())])
    positive, other = table["positive"].to_numpy(), table["other"].to_numpy()
    n_pos, n_other = int(positive.sum()), int(other.sum())
    if not n_pos or not n_other:
        return empty

    def present(i: int) -> np.ndarray:
        w = codes[rows[i] : rows[i + 1]]
        return np.unique(np.concatenate([flat[begin[k] : begin[k + 1]] for k in w])) if len(w) else np.zeros(0, np.int64)

    of_row = [present(i).astype(np.int32) for i in range(len(positive))]
    in_pos, in_other = np.zeros(BUCKETS, np.int32), np.zeros(BUCKETS, np.int32)
    for at, pos, oth in zip(of_row, positive, other, strict=True):
        in_pos[at] += pos
        in_other[at] += oth
    often = np.flatnonzero(in_pos >= 3)
    x, y = in_pos[often], in_other[often]
    p, u = (x + 0.5) / (n_pos + 1), (y + 0.5) / (n_other + 1)
    gain = np.where(p > 1.3 * u, x * np.log(p / u) - (x + y * n_pos / n_other) * np.log((p + u) / (2 * u)) * 0.5, 0.0)
    best = np.argsort(-gain, kind="stable")[:MOST_FEATURES]
    chosen = np.sort(often[best[gain[best] > 3]])
    if not len(chosen):
        return empty
    where = np.full(BUCKETS, -1, np.int32)
    where[chosen] = np.arange(len(chosen))
    cols, ptr = [], [0]
    for at in of_row:
        c = where[at]
        cols.append(c[c >= 0])
        ptr.append(ptr[-1] + len(cols[-1]))
    cols, row_of = np.concatenate(cols), np.repeat(np.arange(len(positive)), np.diff(ptr))
    share_p, share_u = positive / n_pos, other / n_other
    theta = np.zeros(len(chosen) + 1)
    theta[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, epochs + 1):
        z = np.bincount(row_of, theta[cols], len(positive)) + theta[-1]
        s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        soft = np.logaddexp(0, z)
        rest = (share_u * soft).sum() - prior * (share_p * soft).sum()
        d_rest = (share_u - prior * share_p) * s
        d = prior * share_p * (s - 1) + d_rest if rest >= 0 else -d_rest
        grad = np.append(np.bincount(cols, d[row_of], len(chosen)) + decay * theta[:-1], d.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return {"weights": {int(k): float(w) for k, w in zip(chosen, theta[:-1], strict=True)}, "bias": float(theta[-1])}


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Fit on a bounded sample (MOST_POSITIVE confirmed toxic rows, MOST_UNLABELLED rows whatever their label).

    Only ids whose crc32 leaves a remainder other than 0 by 5 are read. Labels other than 1 serve to estimate the
    class prior alone. Rows are drawn by a hash of the id. Without toxic labels, or without documents, the model
    scores all texts alike.
    """
    known = labels.where(_remainder(id_col) != 0).select(F.col(id_col).alias("id"), F.col("toxic").alias("toxic")).where("id is not null and toxic is not null")
    n_toxic, n_known = known.agg(F.count(F.when(F.col("toxic") == 1, 1)), F.count("*")).first()
    n_docs = docs.count()
    if not n_toxic or not n_docs:
        return {"weights": {}, "bias": -2.0}
    drawn = lambda col, seed: F.pmod(F.xxhash64(F.lit(seed), col), F.lit(1 << 20)) / float(1 << 20)
    toxic = known.where((F.col("toxic") == 1) & (drawn("id", 11) < MOST_POSITIVE / n_toxic)).select("id").distinct().withColumn("positive", F.lit(1))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where(_remainder("id") != 0)
    picked = (
        rows.join(F.broadcast(toxic), "id", "left")  # at most about MOST_POSITIVE ids
        .select(F.coalesce("positive", F.lit(0)).alias("positive"), (drawn("id", 12) < MOST_UNLABELLED / n_docs).cast("int").alias("other"), "text")
        .where("positive = 1 or other = 1")
    )
    table = picked.mapInArrow(_sampled, "positive int, other int, words array<string>").toArrow()
    return fit(table, min(0.5, max(0.005, n_toxic / n_known)))


def _run(model: dict):
    def run(batches):
        weights, bias = model["weights"], model["bias"]
        known: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            scores = []
            for t in batch.column("text"):
                hit: set[int] = set()
                for w in text_words(t.as_py()):
                    f = known.get(w)
                    if f is None:
                        if len(known) >= CACHE_WORDS:
                            known.clear()
                        f = tuple(x for x in features(w) if x in weights)
                        if len(w) <= CACHED_LENGTH:
                            known[w] = f
                    if f:
                        hit.update(f)
                scores.append(1 / (1 + np.exp(-min(30.0, max(-30.0, bias + sum(weights[x] for x in sorted(hit)))))))
            yield pa.record_batch([*(batch.column(n) for n in batch.schema.names), pa.array(scores, pa.float64())], [*batch.schema.names, "score"])

    return run


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted of every whole text.

    Null text: empty, which scores by the bias alone. Null ids count as "" for held_out. Ids may repeat. No shuffle.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    scored = rows.mapInArrow(_run(model), f"doc_id {id_type}, text string, score double")
    return scored.select("doc_id", (_remainder("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def kept(docs: DataFrame, model: dict, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """docs without the rows that score least or more."""
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    told = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())])  # names may hold any characters
    return rows.mapInArrow(_run(model), told).where(F.col("score") < least).select(*[F.col(f"row.`{n}`").alias(n) for n in names])
