"""A Merkle manifest of a dataset: an external-memory store of nodes, and proofs by coordinate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of texts one after the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_digest(values: list[Column]) -> Column:
    """The digest of a row: each value as its number of UTF-8 bytes, a colon and itself; a null is a hyphen."""
    told = [v.cast("string") for v in values]
    return digest(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in told])


def _numbered(rows: DataFrame, group: list[str], order: list[str], name: str, beside: DataFrame | None = None) -> DataFrame:
    """rows with _idx, the place of each in its group from 0, and _total, the rows of the group, though a group holds
    any share of them; and with the columns that the table beside has for the group.

    Rows are written as runs, sorted within and between them. A run's part of a group is a stretch of places in it, so
    a place in the group is that place, less the stretch's first, plus the rows of the group in earlier runs; these come
    from a table of one row for each run and group in it, which the runs meet by both.
    """
    sort = [*group, *order]
    runs = rows.repartitionByRange(*sort).sortWithinPartitions(*sort)
    runs = written(runs.select("*", F.spark_partition_id().alias("_run"), F.monotonically_increasing_id().alias("_at")), name)
    own = Window.partitionBy(*(group or [F.lit(0)]))
    stretches = runs.groupBy("_run", *group).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(own.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    told = stretches.withColumns({"_shift": before - F.col("_first"), "_total": F.sum("_n").over(own)}).drop("_first", "_n")
    more = []
    if beside is not None:
        more = [c for c in beside.columns if c not in group]
        told = _met(told, beside, group)
    return _met(runs, told, ["_run", *group]).select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("_idx"), "_total", *more)


def _met(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Inner join by columns in which null equals null."""
    b = b.withColumnsRenamed({c: f"_of_{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return a.join(b, same).drop(*[f"_of_{c}" for c in by])


def _levels(nodes: DataFrame, store: str, most: int, fan_out: int) -> list[DataFrame]:
    """The levels above nodes (g, idx, n, digest), each written under store once the one below is: while a tree g has n > 1
    nodes, every fan_out consecutive ones make one. A level has g, idx, n, digest and its nodes' children in order."""
    spark, out = nodes.sparkSession, []
    while most > 1:
        up = F.floor(F.col("idx") / fan_out).alias("idx")
        members = F.array_sort(F.collect_list(F.struct(F.col("idx").alias("at"), "digest")))
        level = nodes.where("n > 1").groupBy("g", up).agg(F.ceil(F.max("n") / fan_out).alias("n"), F.transform(members, lambda m: m["digest"]).alias("children"))
        path = f"{store}/level={len(out) + 1}"
        level.withColumn("digest", digest(F.array_join("children", ""))).sortWithinPartitions("g", "idx").write.parquet(path)
        nodes = spark.read.parquet(path)
        out.append(nodes)
        most = -(-most // fan_out)
    return out


def _with_paths(levels: list[DataFrame], tops: DataFrame, fan_out: int) -> DataFrame:
    """The lowest level with what its nodes' trees have in tops (g, path, ...), path grown to that of the node: for each level
    up to the top, the digests before and after it in its run, each as one text. From the top down, each level meets the
    one above at its nodes' coordinates."""
    more = [c for c in tops.columns if c not in ("g", "path")]
    above = None
    for nodes in reversed(levels):
        met = nodes.where("n = 1").join(tops, "g")
        if above is not None:
            parents = above.select(F.col("g").alias("_g"), F.col("idx").alias("_up"), F.col("children").alias("_all"), F.col("path").alias("_path"), *more)
            lower = nodes.where("n > 1").join(parents, (F.col("g") == F.col("_g")) & (F.floor(F.col("idx") / fan_out) == F.col("_up")))
            at = (F.col("idx") % fan_out).cast("int")
            told = lambda first, n: F.array_join(F.slice("_all", first, n), "")
            step = F.struct(told(F.lit(1), at).alias("before"), told(at + 2, F.lit(fan_out)).alias("after"))
            met = met.unionByName(lower.withColumn("path", F.concat(F.array(step), "_path")).select(*met.columns))
        above = met
    return above


def proof_digest(path: Column) -> Column:
    """The digest of all siblings on the way to the root, left to right, level by level."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf has with the siblings of a path."""
    return F.reduce(path, leaf, lambda h, s: digest(s["before"], h, s["after"]))


@dataclass
class Manifest:
    """Levels of the trees of all groups, leaves first, and those of the tree over their roots."""

    levels: list[DataFrame]
    top: list[DataFrame]
    fan_out: int

    def proofs(self) -> DataFrame:
        """key, the columns kept beside it, digest, path, subroot and root of every leaf."""
        none = F.array().cast("array<struct<before:string,after:string>>")
        root = self.top[-1].where("n = 1").select("g", none.alias("path"), F.col("digest").alias("root"))
        groups = _with_paths(self.top, root, self.fan_out)  # the nodes of one tree, whose idx is the g of a group
        groups = groups.select(F.col("idx").alias("g"), "path", F.col("digest").alias("subroot"), "root")
        return _with_paths(self.levels, groups, self.fan_out).drop("g", "idx", "n")


def build(docs: DataFrame, store: str, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", group: str = "source", carry: dict[str, Column] | None = None, fan_out: int = 16) -> Manifest:
    """The manifest of docs, written under store: trees/level=0 (leaves), 1, ... and top/level=0 (roots of groups), 1, ...

    A row's leaf is the digest of its fields. The leaves of a group ascend by key (null first), rows of one key by their
    leaf; every fan_out consecutive nodes are one of the next level, until one is left. The groups' roots, by group
    (null first, by bytes), make the tree of the root. carry: names and expressions over docs to keep beside each leaf.

    Texts are read once and only digests are shuffled. Rows are sorted into runs with a number of their own as last key,
    so a hot group, key or repeated row is split among runs; equal rows are leaves beside each other. Then each level
    is made from that below, which it reads once in the order it was written. Nulls in any field count as such; an empty
    table has no nodes and no root. Other columns, whatever their names, are not read.
    """
    spark, carry = docs.sparkSession, carry or {}
    quoted = lambda c: F.col(f"`{c}`")
    leaves = docs.select(quoted(key).alias("_key"), quoted(group).alias("_group"), leaf_digest([quoted(f) for f in fields]).alias("digest"), *[v.alias(f"_c_{n}") for n, v in carry.items()])
    leaves = written(leaves.withColumn("_row", F.monotonically_increasing_id()), "merkle-leaves")
    groups = written(leaves.groupBy("_group").agg(F.count("*").alias("_size")), "merkle-groups")
    count, most = groups.agg(F.count("*"), F.coalesce(F.max("_size"), F.lit(0))).first()
    places = _numbered(groups, [], ["_group"], "merkle-places")
    ranks = written(places.select("_group", F.col("_idx").alias("g")), "merkle-ranks")
    placed = _numbered(leaves, ["_group"], ["_key", "digest", "_row"], "merkle-runs", ranks)
    path = f"{store}/trees/level=0"
    placed.select("g", F.col("_idx").alias("idx"), F.col("_total").alias("n"), "digest", F.col("_key").alias("key"), *[F.col(f"_c_{n}").alias(n) for n in carry]).write.parquet(path)
    trees = [spark.read.parquet(path)]
    trees += _levels(trees[0], f"{store}/trees", most, fan_out)
    for df in (leaves, places, placed):  # with what they were made from
        dropped(df)
    single = None
    for level in trees:
        own = level.where("n = 1").select(F.lit(0).cast("long").alias("g"), F.col("g").alias("idx"), F.lit(count).cast("long").alias("n"), "digest")
        single = own if single is None else single.unionByName(own)
    path = f"{store}/top/level=0"
    single.write.parquet(path)
    top = [spark.read.parquet(path)]
    return Manifest(trees, top + _levels(top[0], f"{store}/top", count, fan_out), fan_out)
