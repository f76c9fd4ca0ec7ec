"""Approximate nearest neighbours: a neighbour graph by NN-descent, and greedy search in it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, written

#: Neighbours that descent keeps, links of a node that meet (nearest ones, reverse ones included), pairs that one node
#: may tell of each of its links in a round, and rounds; random orders to begin with and rows that meet in each.
NEIGHBOURS, LINKS, TOLD, ROUNDS, ORDERS, BLOCK = 40, 48, 10, 6, 12, 1024
#: Search: entries kept for a query, entries opened in a round, rounds, entries scored exactly.
POOL, OPENED, SEARCH_ROUNDS, RESCORED = 160, 24, 4, 60
#: Rows that a worker holds at once (a node's rows are never parted, and are bounded by the numbers above).
HELD_ROWS = 20_000
_EDGES = "node long, other long, near double, fresh boolean"


def _combined(kind: str, k: int):
    """Of each batch: the distinct vectors, as bytes, with their k least ids."""

    def run(batches):
        for batch in batches:
            vectors = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(kind)
            ids = batch.column("vec_id").to_numpy()
            if not len(ids):
                continue
            vectors = vectors.reshape(len(ids), -1) + 0.0  # -0.0 is 0.0
            groups: dict[bytes, list[int]] = {}
            for i in np.argsort(ids, kind="stable"):
                own = groups.setdefault(vectors[i].tobytes(), [])
                if len(own) < k:
                    own.append(int(ids[i]))
            yield pa.record_batch([pa.array(list(groups), pa.binary()), pa.array(list(groups.values()), pa.list_(pa.int64()))], ["vec", "ids"])

    return run


def _keyed(kind: str):
    def run(batches):
        for batch in batches:
            ids = batch.column("vec_id")
            vectors = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(kind)
            vectors = vectors.reshape(len(ids), -1) + 0.0 if len(ids) else vectors
            yield pa.record_batch([ids, pa.array([v.tobytes() for v in vectors], pa.binary())], ["vec_id", "vec"])

    return run


def _tables(batches, whole: str | None = None):
    """Tables of HELD_ROWS rows or more; rows of one value of `whole`, by which a partition is sorted, stay together."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows >= HELD_ROWS:
            table = pa.Table.from_batches(held).combine_chunks()
            cut = rows
            if whole:
                key = table[whole].to_numpy()
                cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield table.slice(0, cut)
                table = table.slice(cut)
            held, rows = table.to_batches(), len(table)
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _matrix(table: pa.Table, name: str, kind: str, dim: int) -> np.ndarray:
    """A column of vectors as bytes, as a matrix in double precision."""
    parts = []
    for chunk in table[name].chunks:
        off = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
        parts.append(np.frombuffer(chunk.buffers()[2], np.uint8)[off[0] : off[-1]].view(kind).reshape(-1, dim))
    return np.concatenate(parts).astype(float)


def _runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin of each run of equal keys, and its length."""
    begin = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)
    return begin, np.diff(np.append(begin, len(sorted_keys)))


def _orders(kind: str, dim: int, bits: int):
    """The vector, and its place in each of the random orders: signs on random planes, then a projection."""
    planes = [np.random.default_rng(100 + t).standard_normal((dim, bits + 1)) for t in range(ORDERS)]

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            v = _matrix(pa.Table.from_batches([batch]), "vec", kind, dim)
            for t, p in enumerate(planes):
                z = v @ p
                code = (z[:, :-1] > 0) @ (1 << np.arange(bits))
                yield pa.record_batch([batch.column("node"), batch.column("vec"), pa.array(np.full(len(v), t, np.int32)), pa.array(code.astype(np.int64)), pa.array(z[:, -1].astype(float))], ["node", "q", "tree", "code", "along"])

    return run


def _edge_batch(node, other, near, fresh) -> pa.RecordBatch:
    return pa.record_batch([pa.array(node.astype(np.int64)), pa.array(other.astype(np.int64)), pa.array(near.astype(float)), pa.array(fresh.astype(bool))], ["node", "other", "near", "fresh"])


def _best(near: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value of the k largest of each row; -inf doesn't count."""
    k = min(k, near.shape[1])
    at = np.argpartition(-near, k - 1, axis=1)[:, :k]
    value = np.take_along_axis(near, at, 1)
    ok = np.isfinite(value)
    return np.repeat(np.arange(len(near)), ok.sum(1)), at[ok], value[ok]


def _first(kind: str, dim: int):
    """Nearest rows among the BLOCK next to each in its order."""

    def run(batches):
        for table in _tables(batches):
            node, tree = table["node"].to_numpy(), table["tree"].to_numpy()
            v = _matrix(table, "q", kind, dim)
            for lo in range(0, len(node), BLOCK):
                ids, trees, x = node[lo : lo + BLOCK], tree[lo : lo + BLOCK], v[lo : lo + BLOCK]
                near = x @ x.T
                near = np.maximum(near, near.T)  # one value a pair
                near[trees[:, None] != trees[None, :]] = -np.inf
                np.fill_diagonal(near, -np.inf)
                i, j, value = _best(near, NEIGHBOURS)
                yield _edge_batch(ids[i], ids[j], value, np.ones(len(i)))

    return run


def _top(node, other, near, fresh, k):
    """Indices of the k nearest distinct others of each node, nearest first; of a pair given twice the older counts."""
    # The values of a pair may differ in the last place, as sums are taken in another order; the first given stays.
    order = np.lexsort((fresh, other, node))
    n, o = node[order], other[order]
    keep = n != o
    keep[1:] &= (n[1:] != n[:-1]) | (o[1:] != o[:-1])
    order = order[keep]
    order = order[np.lexsort((other[order], -near[order], node[order]))]
    begin, length = _runs(node[order])
    return order[np.arange(len(order)) - np.repeat(begin, length) < k]


def _nearest(k: int, sorted_by: str | None = "node"):
    """The k nearest of each node; where the partition isn't sorted by node, of each stretch of it."""

    def run(batches):
        for table in _tables(batches, sorted_by):
            columns = [table[c].to_numpy() for c in ("node", "other", "near", "fresh")]
            at = _top(*columns, k)
            yield _edge_batch(*[c[at] for c in columns])

    return run


def _nearest_of(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest of each node, cut before the shuffle too, so a node that is everyone's neighbour gathers few rows."""
    cut = edges.mapInArrow(_nearest(k, None), _EDGES)
    return cut.repartition("node").sortWithinPartitions("node").mapInArrow(_nearest(k), _EDGES)


def _introduced(kind: str, dim: int):
    """The local join: at each node its links meet, and tell each other of those nearer than their bound.

    Pairs of two links that had met before are left out; each link hears of TOLD others at most.
    """

    def run(batches):
        for table in _tables(batches, "node"):
            other, fresh, bound = (table[c].to_numpy() for c in ("other", "fresh", "bound"))
            v = _matrix(table, "q", kind, dim)
            begin, length = _runs(table["node"].to_numpy())
            found = []
            for lo in range(0, len(begin), 128):
                b, m = begin[lo : lo + 128], length[lo : lo + 128]
                place = np.arange(m.max())
                real = place < m[:, None]
                at = np.where(real, b[:, None] + place, b[:, None])
                x = v[at]
                near = x @ x.transpose(0, 2, 1)
                near = np.maximum(near, near.transpose(0, 2, 1))  # one value a pair
                ids, new = other[at], fresh[at]
                met = real[:, :, None] & real[:, None, :] & (new[:, :, None] | new[:, None, :]) & (near > bound[at][:, :, None])
                met &= ids[:, :, None] != ids[:, None, :]
                near[~met] = -np.inf
                i, j, value = _best(near.reshape(-1, near.shape[2]), TOLD)
                found.append((ids.ravel()[i], ids[i // near.shape[1], j], value))
            node, named, near = (np.concatenate(c) for c in zip(*found, strict=True))
            told = np.ones(len(node), bool)
            at = _top(node, named, near, told, NEIGHBOURS)
            yield _edge_batch(node[at], named[at], near[at], told[at])

    return run


_POOL = "node long, other long, near double, done boolean, next boolean"


def _pool(batches):
    """The POOL nearest entries of each query; next marks the nearest OPENED that haven't been opened."""
    for table in _tables(batches, "node"):
        node, other, near, done = (table[c].to_numpy() for c in ("node", "other", "near", "done"))
        at = _top(node, other, near, ~done, POOL)
        node, other, near, done = node[at], other[at], near[at], done[at]
        begin, length = _runs(node)
        waiting = np.cumsum(~done)
        before = np.repeat(waiting[begin] - ~done[begin], length) if len(node) else waiting
        chosen = ~done & (waiting - before <= OPENED)
        yield pa.record_batch([pa.array(node), pa.array(other), pa.array(near), pa.array(done | chosen), pa.array(chosen)], ["node", "other", "near", "done", "next"])


def _scores(kind: str, dim: int):
    """The inner product of a and b in double precision, beside the other columns."""

    def run(batches):
        for batch in batches:
            if len(batch):
                table = pa.Table.from_batches([batch])
                rest = [n for n in batch.schema.names if n not in ("a", "b")]
                score = np.einsum("ij,ij->i", _matrix(table, "a", kind, dim), _matrix(table, "b", kind, dim))
                yield pa.record_batch([*(batch.column(n) for n in rest), pa.array(score)], [*rest, "score"])

    return run


def neighbours(embeddings: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, the k nearest other rows found.

    Nearness is the inner product in double precision of the vectors as given; ties go to the smaller id. Equal vectors
    are one node of the graph, with their k + 1 least ids, which is all that any query can return of them. All rows are
    in the graph. Descent and search compare the vectors as given, in double precision, so neither one large component
    nor a group of nearly equal vectors makes others tie.

    1. Random orders of the nodes give first lists of neighbours.
    2. NN-descent: in each round the links of a node (its nearest, forward and reverse) meet at that node, where the
       join brings their vectors, and hear of each other; only pairs with a new link meet. It ends when few lists change.
    3. Greedy search from each query's own node and a few fixed ones: the nearest unopened entries of its pool are
       opened, their links scored and merged in. The RESCORED best and ties of the last are scored once more.
    Links are cut to the nearest before they are shuffled and after, so a vector that is near all others gathers a
    bounded number of rows a partition; a join on such a vector's id is left to the adaptive skew join.

    Rows take no part if the id is null, or the vector is null, zero, holds null, NaN or infinite components, or has
    another length than most. Rows that bear the query's own id are passed over. Fewer rows than k: all are returned.
    """
    element = embeddings.schema[vec_col].dataType.elementType.simpleString()
    kind = "<f4" if element == "float" else "<f8"
    raw = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(f"array<{'float' if kind == '<f4' else 'double'}>").alias("embedding"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = raw.where(F.col("vec_id").isNotNull() & F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0))
    sizes = rows.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"))
    usual = sizes.orderBy(F.desc("n"), "dim").first()
    if usual is None:
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = usual["dim"]
    rows = rows.where(F.size("embedding") == dim)

    least = lambda c: F.slice(F.array_sort(F.flatten(F.collect_list(c))), 1, k + 1)
    some = rows.mapInArrow(_combined(kind, k + 1), "vec binary, ids array<long>")
    some = some.groupBy("vec", F.pmod(F.xxhash64("ids"), F.lit(64)).alias("salt")).agg(least("ids").alias("ids"))
    nodes = written(some.groupBy("vec").agg(least("ids").alias("ids")).select(F.element_at("ids", 1).alias("node"), "vec", "ids"), "ann-nodes")
    n = nodes.count()

    bits = max(1, min(16, (n // BLOCK).bit_length()))
    ordered = nodes.select("node", "vec").mapInArrow(_orders(kind, dim, bits), "node long, q binary, tree int, code long, along double")
    parts = max(1, ORDERS * n // 20_000)
    met = ordered.repartitionByRange(parts, "tree", "code", "along").sortWithinPartitions("tree", "code", "along").mapInArrow(_first(kind, dim), _EDGES)
    lists = written(_nearest_of(met, NEIGHBOURS), "ann-lists")
    vectors = nodes.select(F.col("node").alias("other"), F.col("vec").alias("q"))

    def links_of(lists: DataFrame) -> DataFrame:
        return _nearest_of(lists.union(lists.select("other", "node", "near", "fresh")), LINKS)

    for _ in range(ROUNDS if n > 1 else 0):
        bound = lists.groupBy(F.col("node").alias("other")).agg(F.when(F.count("*") >= NEIGHBOURS, F.min("near")).otherwise(float("-inf")).cast("double").alias("bound"))
        held = links_of(lists).join(vectors.join(bound, "other"), "other").select("node", "other", "fresh", "bound", "q")
        found = held.repartition("node").sortWithinPartitions("node").mapInArrow(_introduced(kind, dim), _EDGES)
        new = written(_nearest_of(lists.withColumn("fresh", F.lit(False)).union(found), NEIGHBOURS), "ann-lists")
        dropped(lists)
        lists = new
        if lists.where("fresh").count() < 0.005 * n * NEIGHBOURS:
            break

    links = written(links_of(lists).groupBy("node").agg(F.collect_list("other").alias("links")), "ann-links")
    queries = rows.where(F.col("vec_id") % every == 0).mapInArrow(_keyed(kind), "vec_id long, vec binary").join(nodes.select("vec", "node"), "vec").select(F.col("vec_id").alias("query_id"), "node")
    queries = written(queries, "ann-queries")
    asking = written(queries.select("node").distinct().join(nodes.select("node", F.col("vec").alias("a")), "node"), "ann-asking")
    doors = [r[0] for r in nodes.select("node").orderBy(F.xxhash64("node"), "node").limit(4).collect()]
    scored = lambda pairs: pairs.join(vectors.withColumnRenamed("q", "b"), "other").join(asking, "node").select("node", "other", "a", "b").mapInArrow(_scores(kind, dim), "node long, other long, score double")
    start = asking.select("node", F.explode(F.array(*[F.lit(d).cast("long") for d in doors])).alias("other")).where("node <> other")
    known = lists.join(asking.select("node"), "node", "left_semi").select("node", "other", "near")
    entries = known.union(scored(start)).withColumn("done", F.lit(False))
    pool = None
    for turn in range(SEARCH_ROUNDS + 1):
        new = written(entries.repartition("node").sortWithinPartitions("node").mapInArrow(_pool, _POOL), "ann-pool")
        if pool is not None:
            dropped(pool)
        pool = new
        if turn == SEARCH_ROUNDS:
            break
        opened = pool.where("next").select("node", F.col("other").alias("opened"))
        beyond = opened.join(links.withColumnRenamed("node", "opened"), "opened").select("node", F.explode("links").alias("other")).where("node <> other").distinct()
        beyond = beyond.join(pool.select("node", "other"), ["node", "other"], "left_anti")
        entries = pool.select("node", "other", "near", "done").union(scored(beyond).withColumn("done", F.lit(False)))

    best = Window.partitionBy("node").orderBy(F.desc("near"))
    close = pool.withColumn("r", F.rank().over(best)).where(F.col("r") <= RESCORED).select("node", "other").union(asking.select("node", F.col("node")))
    exact = (
        close.join(nodes.select(F.col("node").alias("other"), F.col("vec").alias("b"), "ids"), "other").join(asking, "node")
        .select("node", "a", "b", "ids").mapInArrow(_scores(kind, dim), "node long, ids array<long>, score double")
    )
    order = Window.partitionBy("node").orderBy(F.desc("score"), "vec_id")
    named = exact.select("node", "score", F.explode("ids").alias("vec_id")).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    answers = named.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("answers"))
    own = queries.join(answers, "node").select("query_id", F.slice(F.filter("answers", lambda a: a["vec_id"] != F.col("query_id")), 1, k).alias("answers"))
    told = own.select("query_id", F.posexplode("answers").alias("at", "a")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "a.vec_id", "a.score")
    result = written(told, "ann-answers")
    for table in (nodes, lists, links, queries, asking, pool):
        dropped(table)
    return result
