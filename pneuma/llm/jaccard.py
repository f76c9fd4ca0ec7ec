"""Exact self-join of documents by the Jaccard similarity of their word shingles, with set-relation skipping."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, bit_filter, bytes_column, dropped, filter_bits, in_filter, steps, window_hashes, word_hashes, word_keys, words, written

#: One text in ORDER_SAMPLE is read for the order of shingles, and the most frequent ones kept. The order is a matter of
#: speed alone: any order gives the same result.
ORDER_SAMPLE, MOST_FREQUENT = 32, 1_000_000
#: Pairs in one numpy step of list_pairs(); rows of text in one output batch.
STEP_PAIRS, STEP_ROWS = 1 << 20, 1_000
#: Lists longer than this are settled in groups, by blocks of about so many sets, or so many shingles of longer sets.
LONG_LIST, GROUP_BLOCK, BLOCK_SHINGLES = 48, 400, 400_000
#: Digests that a task remembers, so that it sends a repeated set once.
REMEMBERED = 100_000


def _row_sets(column: pa.Array, width: int):
    """For each row: the sorted hashes of its distinct shingles, after lower-casing A-Z."""
    for _, data, off in steps(column):
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        starts, ends, first = words(data, off)
        h = word_hashes(word_keys(data, starts, ends))
        all_shingles = window_hashes(h, width)
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= width:
                yield np.unique(all_shingles[a : b - width + 1])
            else:
                yield window_hashes(h[a:b], int(b - a), int(b - a)) if b > a else np.zeros(0, U64)


def _digest(s: np.ndarray) -> bytes:
    """The name of a set: 128 bits of BLAKE2b over its shingles."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _halves(digests: list[bytes]) -> list[pa.Array]:
    return [pa.array(np.ascontiguousarray(c)) for c in np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2).T]


def _longs(parts: list[np.ndarray]) -> pa.Array:
    return pa.array((np.concatenate(parts) if parts else np.zeros(0, U64)).astype(U64).view(np.int64), pa.int64())


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), _longs(parts))


def _all_shingles(width):
    def run(batches):
        for part in (b.slice(lo, STEP_ROWS) for b in batches for lo in range(0, len(b), STEP_ROWS)):
            yield pa.record_batch([_longs(list(_row_sets(part.column("text"), width)))], ["token"])

    return run


def _needed(n, percent):
    """The least intersection of a set of n with any set that it is linked to."""
    return -(-percent * n // 100)


def _least(a, b, percent):
    """The least intersection of linked sets of sizes a and b."""
    return -(-percent * (a + b) // (100 + percent))


def _headers(width, percent, frequent):
    """Of each row its id, the size and digest of its set, and the set's prefix: what is left of a set that need not
    be shared, rare shingles first. A task gives the prefix of a set that it has just seen as null."""

    def run(batches):
        rare_last = np.asarray(frequent.value)
        seen: set[bytes] = set()
        for part in (b.slice(lo, STEP_ROWS) for b in batches for lo in range(0, len(b), STEP_ROWS)):
            sizes, digests, prefixes, again = [], [], [], []
            for s in _row_sets(part.column("text"), width):
                n, digest = len(s), _digest(s)
                sizes.append(n), digests.append(digest), again.append(digest in seen or not n)
                if again[-1]:
                    prefixes.append(s[:0])
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(digest)
                at = np.minimum(np.searchsorted(rare_last, s), max(len(rare_last) - 1, 0))
                often = rare_last[at] == s if len(rare_last) else np.zeros(n, bool)
                prefixes.append((np.concatenate([s[~often], s[often]]) if often.any() else s)[: n - _needed(n, percent) + 1])
            lists = _lists(prefixes)
            lists = pa.ListArray.from_arrays(lists.offsets, lists.values, mask=pa.array(again, pa.bool_()))
            yield pa.record_batch([part.column("doc_id"), pa.array(sizes, pa.int64()), *_halves(digests), lists], ["doc_id", "n_shingles", "d1", "d2", "prefix"])

    return run


def _table(batches, names):
    """The columns of a whole partition as numpy arrays."""
    batches = list(batches)
    return [np.concatenate([b.column(n).to_numpy(zero_copy_only=False) for b in batches]) if batches else np.zeros(0, np.int64) for n in names]


def _runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin of each run of equal keys, and its length."""
    begin = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)
    return begin, np.diff(np.append(begin, len(sorted_keys)))


def _counted(a, b, na, nb, weight=None):
    """Rows of distinct pairs with how often each occurs."""
    if not len(a):
        return None
    order = np.lexsort((b, a))
    a, b, na, nb = a[order], b[order], na[order], nb[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(a))) if weight is None else np.add.reduceat(weight[order], first)
    return a[first], b[first], na[first], nb[first], count


_PAIRS = "a long, b long, na int, nb int, shared long"


def _pair_batch(x):
    return pa.record_batch([pa.array(x[0]), pa.array(x[1]), pa.array(x[2].astype(np.int32)), pa.array(x[3].astype(np.int32)), pa.array(x[4].astype(np.int64))], ["a", "b", "na", "nb", "shared"])


def list_pairs(token, sid, label, n, pos, percent):
    """Pairs of sets with unlike labels that share a token, with the number of shared tokens; in several parts.

    Each list is sorted by label and size. The stretch of a list that has a set's own label is skipped as a block:
    those sets' answers follow from the answer of the set that they are linked to. What is left is met at growing
    distance, so a pair costs one element of a numpy step; pairs that sizes and positions rule out are left out.
    """
    order = np.lexsort((n, label, token))
    token, sid, label, n, pos = token[order], sid[order], label[order], n[order], pos[order]
    begin, length = _runs(token)
    list_end = np.repeat(begin + length, length)
    key_begin = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (label[1:] != label[:-1])])) if len(token) else np.zeros(0, np.int64)
    block_end = np.repeat(np.append(key_begin[1:], len(token)), np.diff(np.append(key_begin, len(token)))) if len(token) else np.zeros(0, np.int64)
    here = np.arange(len(token))
    there = block_end.copy()
    parts, held = [], 0
    live = np.flatnonzero(there < list_end)
    while len(live):
        for lo in range(0, len(live), STEP_PAIRS):
            i = live[lo : lo + STEP_PAIRS]
            j = there[i]
            a, b = n[i], n[j]
            least = _least(a, b, percent)
            most = np.minimum(pos[i], pos[j]) + np.minimum(a - pos[i], b - pos[j])
            ok = (100 * np.minimum(a, b) >= percent * np.maximum(a, b)) & (most >= least)
            i, j = here[i[ok]], j[ok]
            swap = sid[i] > sid[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            parts.append((sid[i], sid[j], n[i], n[j], np.ones(len(i), np.int64)))
            held += len(i)
            if held > 4 * STEP_PAIRS:
                x = _counted(*(np.concatenate(c) for c in zip(*parts, strict=True)))
                parts, held = [x], len(x[0])
                if held > 2 * STEP_PAIRS:
                    yield x
                    parts, held = [], 0
        there[live] += 1
        live = live[there[live] < list_end[live]]
    if parts and held:
        yield _counted(*(np.concatenate(c) for c in zip(*parts, strict=True)))


def _cross(percent):
    """Of a partition by token: the pairs of unlike labels in lists of LONG_LIST sets at most."""

    def run(batches):
        columns = _table(batches, ["token", "sid", "label", "n", "pos"])
        for x in list_pairs(*columns, percent):
            if x is not None:
                yield _pair_batch(x)

    return run


def _cell(percent):
    """Links that join unlike labels, within a block of a group or between two."""

    def run(table):
        sid, label, side = table["sid"].to_numpy(), table["label"].to_numpy(), table["side"].to_numpy()
        sets = [x.values.to_numpy() for x in table["shingles"]]
        size = np.array([len(x) for x in sets])
        row = np.repeat(np.arange(len(sets)), size)
        _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        place = np.cumsum(count > 1) - 1
        often = count[column] > 1
        row, column = row[often], place[column[often]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        left = np.flatnonzero(side == side.min())
        right = np.flatnonzero(side == side.max())
        of_left, of_right = np.full(len(sets), -1), np.full(len(sets), -1)
        of_left[left], of_right[right] = np.arange(len(left)), np.arange(len(right))
        common = np.zeros((len(left), len(right)), np.float32)
        for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
            a, b = np.searchsorted(column, [lo, lo + 2048])
            r, c = row[a:b], column[a:b] - lo
            x, y = np.zeros((len(left), 2048), np.float32), np.zeros((len(right), 2048), np.float32)
            x[of_left[r][of_left[r] >= 0], c[of_left[r] >= 0]] = 1
            y[of_right[r][of_right[r] >= 0], c[of_right[r] >= 0]] = 1
            common += x @ y.T
        total = size[left][:, None] + size[right][None, :] - common
        i, j = np.nonzero((100 * common >= percent * total) & (label[left][:, None] != label[right][None, :]))
        parent: dict[int, int] = {}

        def top(v):
            while parent.get(v, v) != v:
                v = parent[v]
            return v

        a, b = [], []
        for x, y in zip(left[i].tolist(), right[j].tolist(), strict=True):
            u, v = top(label[x]), top(label[y])
            if u != v:
                parent[max(u, v)] = min(u, v)
                a.append(sid[x]), b.append(sid[y])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _chosen_sets(width, bitmap):
    """The sets whose digest is in the filter; so some others too."""

    def run(batches):
        bits = np.asarray(bitmap.value)
        seen: set[bytes] = set()
        for part in (b.slice(lo, STEP_ROWS) for b in batches for lo in range(0, len(b), STEP_ROWS)):
            digests, sets = [], []
            for s in _row_sets(part.column("text"), width):
                digest = _digest(s)
                if len(s) and digest not in seen and in_filter(bits, np.frombuffer(digest, "<u8", 1))[0]:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(digest)
                    digests.append(digest), sets.append(s)
            yield pa.record_batch([*_halves(digests), _lists(sets)], ["d1", "d2", "shingles"])

    return run


def _merged(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the documents: never broadcast, at any size; the other side may be skewed."""
    return df.hint("merge")


def _sets_of(rows: DataFrame, sets: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(sid, shingles) of the sets named in the one column of ids, once each; written."""
    chosen = written(sets.select("sid", "d1", "d2").join(_merged(ids), "sid", "left_semi"), "jaccard-chosen")
    bitmap = rows.sparkSession.sparkContext.broadcast(bit_filter(chosen.select("d1"), filter_bits(chosen.count())))
    found = rows.select("text").mapInArrow(_chosen_sets(width, bitmap), "d1 long, d2 long, shingles array<long>")
    out = written(found.dropDuplicates(["d1", "d2"]).join(_merged(chosen), ["d1", "d2"]).select("sid", "shingles"), "jaccard-shingles")
    dropped(chosen)
    return out


def _grouped_links(rows: DataFrame, sets: DataFrame, members: DataFrame, labels: DataFrame, width: int, percent: int) -> DataFrame:
    """Of groups (group, sid) links a, b that join all sets of a group which links join. The result is written.

    A group's sets are parted by kind - a label of many sets, or none for those of rarer labels - and by size class, as
    sets of classes that aren't neighbours can't be linked; a part is cut into blocks of about GROUP_BLOCK sets or
    BLOCK_SHINGLES shingles. Every two blocks that may hold a link between unlike labels meet in a task of their own,
    which returns no more links than it has sets; blocks of one and the same label are skipped.
    """
    members = members.join(_merged(sets.select("sid", "n")), "sid").join(_merged(labels.withColumnRenamed("v", "sid")), "sid", "left")
    members = members.select("group", "sid", "n", F.coalesce("label", "sid").alias("label"), F.floor(F.log(F.col("n")) / F.log(F.lit(max(100 / percent, 1.01)))).cast("int").alias("cls"))
    members = written(members, "jaccard-members")
    if members.isEmpty():
        return members.select(F.col("group").alias("a"), F.col("sid").alias("b"))
    shingles = _sets_of(rows, sets, members.select("sid").distinct(), width)
    big = members.groupBy("group", "label").count().where(F.col("count") >= GROUP_BLOCK // 2).select("group", "label", F.col("label").alias("kind"))
    kinds = members.join(big, ["group", "label"], "left")
    parts = kinds.groupBy("group", "kind", "cls").agg(F.ceil(F.greatest(F.count("*") / GROUP_BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    parts = written(parts.withColumn("part", F.monotonically_increasing_id()), "jaccard-parts")
    near = parts.select("group", F.explode(F.sequence(F.col("cls") - 1, F.col("cls") + 1)).alias("cls"), F.col("kind").alias("kind_b"), F.col("part").alias("part_b"), F.col("blocks").alias("blocks_b"))
    met = parts.join(near, ["group", "cls"]).where((F.col("part") <= F.col("part_b")) & F.coalesce(F.col("kind") != F.col("kind_b"), F.lit(True)))
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    cells = met.select("part", "part_b", "blocks_b", upto("blocks").alias("i")).select("part", "part_b", "i", upto("blocks_b").alias("j"))
    cells = cells.where((F.col("part") < F.col("part_b")) | (F.col("i") <= F.col("j")))
    cell = F.struct("part", "i", "part_b", "j").alias("cell")
    asked = cells.select(cell, "part", F.col("i").alias("block"), F.lit(0).alias("side")).union(cells.select(cell, F.col("part_b"), F.col("j"), F.lit(1))).where((F.col("side") == 0) | (F.col("cell.part") < F.col("cell.part_b")) | (F.col("cell.i") < F.col("cell.j")))
    own = kinds.join(parts, (kinds["group"] == parts["group"]) & kinds["kind"].eqNullSafe(parts["kind"]) & (kinds["cls"] == parts["cls"])).select("part", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int").alias("block"), "sid", "label")
    dealt = own.join(asked, ["part", "block"]).join(_merged(shingles), "sid").select("cell", "sid", "label", "side", "shingles")
    links = written(dealt.groupBy("cell").applyInArrow(_cell(percent), "a long, b long"), "jaccard-links")
    dropped(shingles), dropped(parts), dropped(members)
    return links


def _linked(rows: DataFrame, sets: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Of the pairs a, b those whose sets are linked, by their exact intersection. The result is written."""
    pairs = written(pairs.select("a", "b"), "jaccard-pairs")
    if pairs.isEmpty():
        return pairs
    shingles = _sets_of(rows, sets, pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct(), width)
    a = shingles.select(F.col("sid").alias("a"), F.col("shingles").alias("sa"))
    b = shingles.select(F.col("sid").alias("b"), F.col("shingles").alias("sb"))
    met = pairs.join(_merged(a), "a").join(_merged(b), "b").select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("i"))
    out = written(met.where(F.col("i") * 100 >= percent * (F.col("na") + F.col("nb") - F.col("i"))).select("a", "b"), "jaccard-links")
    dropped(shingles), dropped(pairs)
    return out


def connected(edges: DataFrame) -> DataFrame:
    """(v, label): the least vertex reachable from each vertex of the edges a, b.

    Each round takes the least label among neighbours and then the label of that label; it ends when none changes.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "edges")
    now = written(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(_merged(now.select(F.col("v").alias("b"), "label")), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        low = now.join(_merged(near), "v", "left").select("v", "label", F.least("label", "near").alias("low"))
        jump = now.select(F.col("v").alias("low"), F.col("label").alias("next"))
        new = written(low.join(_merged(jump), "low", "left").select("v", F.least("low", "next").alias("label"), (F.least("low", "next") != F.col("label")).alias("moved")), "labels")
        moved = not new.where("moved").isEmpty()
        dropped(now)
        now = new.select("v", "label")
        if not moved:
            dropped(both)
            return now


def components(docs: DataFrame, width: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of near-duplicates: doc_id, n_shingles and component_id, the least id reachable by links.

    Two documents are linked when 100 * intersection >= percent * union of their sets of distinct width-word shingles
    (words: runs without \\x20 \\x09-\\x0D, A-Z lower-cased; a shorter text is one shingle as a whole).

    1. Equal sets count as one, by 128 bits of a digest; each gets a number of its own.
    2. Each set gives its prefix, in an order that puts frequent shingles last; linked sets share a token of their
       prefixes. Lists of one set are dropped.
    3. In each list the most central set is held against the others; what is linked to it gets its label.
    4. Of each list only sets with unlike labels still meet; their exact number of shared prefix tokens, sizes and
       positions bound the intersection, and pairs that may reach the threshold are settled by their whole sets.
       The sets of long lists meet in groups instead, in blocks, from which only joining links come back.
    No pair of sets with unlike labels that can be linked is left out, so the classes are exact. Shingles are compared
    by 64-bit hashes of their words' keys: a pair of sets of a thousand shingles each meets a false equal in 2e13 pairs.
    Counts and centres of lists are aggregated before the shuffle; joins on a token, centre or label that many sets
    share are parted by the adaptive skew join, and no task holds more than a list of LONG_LIST sets or two blocks.

    Null, empty or blank texts have 0 shingles and are a class of their own, under their own id. Null ids are passed
    over by component_id unless a class has no other. Rows that repeat an id are rows of their own.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), bytes_column(text_col).alias("text"))
    sample = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(ORDER_SAMPLE)) == 0).select("text")
    often = sample.mapInArrow(_all_shingles(width), "token long").groupBy("token").count().where("count > 1")
    often = often.orderBy(F.desc("count"), "token").limit(MOST_FREQUENT).select("token").toArrow()
    frequent = spark.sparkContext.broadcast(np.sort(often["token"].to_numpy().view(U64)))

    read = written(rows.mapInArrow(_headers(width, percent, frequent), f"doc_id {id_type}, n_shingles long, d1 long, d2 long, prefix array<long>"), "jaccard-read")
    headers = written(read.drop("prefix"), "jaccard-headers")
    prefixes = read.where("prefix is not null").select("d1", "d2", F.col("n_shingles").alias("n"), "prefix").dropDuplicates(["d1", "d2"])
    prefixes = written(prefixes.withColumn("sid", F.monotonically_increasing_id()), "jaccard-prefixes")
    sets = written(prefixes.drop("prefix"), "jaccard-sets")
    dropped(read)
    tokens = prefixes.select("sid", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "token"))
    lists = written(tokens.join(_merged(tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")), "token"), "jaccard-lists")
    dropped(prefixes)

    # How much the other sets share of a set's prefix tells the centre of a group from its edited copies.
    scores = lists.groupBy("sid").agg((F.sum("df") / F.min("n")).alias("score"))
    centres = lists.join(_merged(scores), "sid").groupBy("token").agg(F.max(F.struct("score", (-F.col("sid")).alias("minus"), F.col("n").alias("nb"))).alias("top"))
    fits = lambda a, b: 100 * F.least(a, b) >= percent * F.greatest(a, b)
    stars = lists.join(_merged(centres), "token").select(F.col("sid").alias("a"), (-F.col("top.minus")).alias("b"), F.col("n").alias("na"), F.col("top.nb").alias("nb")).where((F.col("a") != F.col("b")) & fits(F.col("na"), F.col("nb")))
    rest = lambda n: F.ceil(n * percent / 100) - 1
    may = lambda p: (F.col("shared") + F.greatest(rest(p["na"]), rest(p["nb"]))) * (100 + percent) >= percent * (F.col("na") + F.col("nb"))
    stars = stars.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("shared"))
    links = _linked(rows, sets, stars.where(may(stars)), width, percent)
    labels = connected(links)

    labelled = lists.join(_merged(labels.withColumnRenamed("v", "sid")), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    unlike = labelled.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("token")
    crossing = written(labelled.join(_merged(unlike), "token"), "jaccard-crossing")
    dropped(lists)
    short = crossing.where(F.col("df") <= LONG_LIST).select("token", "sid", "label", F.col("n").cast("long").alias("n"), F.col("pos").cast("long").alias("pos"))
    pairs = short.repartition("token").mapInArrow(_cross(percent), _PAIRS).groupBy("a", "b", "na", "nb").agg(F.sum("shared").alias("shared"))
    long = crossing.where(F.col("df") > LONG_LIST)
    group = long.groupBy("token", "label").count().groupBy("token").agg(F.max(F.struct("count", "label"))["label"].alias("group"))
    grouped = _grouped_links(rows, sets, long.join(_merged(group), "token").select("group", "sid").distinct(), labels, width, percent)
    # A pair that also shares a token of a longer list meets in a group, so here it doesn't matter that it counts for less.
    more = _linked(rows, sets, pairs.where(may(pairs)), width, percent)
    classes = connected(links.union(grouped).union(more))
    for table in (links, labels, crossing, grouped, more):
        dropped(table)

    # The least id of each class, over its distinct sets.
    least = headers.where("n_shingles > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("least")).join(_merged(sets.select("d1", "d2", "sid")), ["d1", "d2"])
    classed = least.join(_merged(classes.withColumnRenamed("v", "sid")), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    named = classed.select("d1", "d2", "label").join(_merged(classed.groupBy("label").agg(F.min("least").alias("component_id"))), "label").select("d1", "d2", "component_id")
    told = headers.select("doc_id", "n_shingles", "d1", "d2").join(named.hint("merge"), ["d1", "d2"], "left")
    result = written(told.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")), "jaccard-classes")
    for table in (headers, sets, classes):
        dropped(table)
    return result
