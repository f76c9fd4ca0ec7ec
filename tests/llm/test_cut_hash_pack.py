"""Fill-in-middle, the Merkle manifest and sum-of-squares packing against brute force and exact round trips."""

import collections
import hashlib
import re
import uuid
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pneuma.llm import fim, merkle, queries, ss_packing
from pneuma.llm.common import shared_dir
from pneuma.llm.packing import word_ids

SHA = lambda t: hashlib.sha256(t.encode()).hexdigest()
RNG = np.random.default_rng(8)
WORDS = [f"Wort{i}" for i in range(300)]
TEXTS = [
    None, "", " ", "a", "ab", "é", "€uro a😀b", "has <P> in it", "has <S> and <M>", "< P >x<", "One two,\nthree", "one two", "One two,\nthree", "zzz" * 5000,
    *[" ".join(RNG.choice(WORDS, n)) for n in (3, 30, 300, 3000, 9000)], "<" * 700, "1" * 3000 + "ab",
]
ROWS = [(i, t, None if i % 7 == 3 else f"s{i % 3}", "en" if i % 2 else None, None if i % 5 == 0 else len(t or ""), "x") for i, t in enumerate(TEXTS)]
ROWS += [(None, "no id", "s1", "de", 5, "x"), (None, "no id, Too", "s1", "de", 5, "x"), ROWS[10], ROWS[10], (10, "same id", "s1", "en", 7, "x"), (-3, "low", None, "en", 3, "x")]
SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, output string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    docs.write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none"))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/documents.parquet")
    return path


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("abZ <>PSM1\né€😀"), max_size=80), st.integers(1, 9))
def test_checkpoints_find_every_cut(text, every):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    index = fim.Checkpoints(text.encode(), every)
    assert index.n == len(units) and len(index.units) == len(units) // every + 1
    for u in range(len(units) + 1):
        before = "".join(units[:u])
        assert index.cut(u) == (len(before.encode()), len(before))


def _fim(i, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    told = SHA(f"1:{'' if i is None else i}")
    h = [int(told[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, SHA(text), SHA(text)
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return len(units), form, len(p), len(m), SHA(out), SHA(text)


def test_fill_in_middle(spark, folder, empty):
    got = queries.op11_fill_in_middle(spark, folder).collect()
    told = lambda r: (r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256)
    assert collections.Counter(map(told, got)) == collections.Counter((r[0], *_fim(r[0], r[1])) for r in ROWS)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert queries.op11_fill_in_middle(spark, empty).count() == 0


def _manifest(rows, fan_out):
    """(doc_id, leaf, subroot, root, proof, folded root) of each row, by plain lists."""
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: SHA("".join(enc(r[k]) for k in (0, 2, 3, 4, 1)))

    def tree(nodes):
        """Root and, for each node, its (before, after) level by level."""
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, i in enumerate(at):
                run = nodes[i // fan_out * fan_out : i // fan_out * fan_out + fan_out]
                paths[k].append((run[: i % fan_out], run[i % fan_out + 1 :]))
            nodes = [SHA("".join(nodes[i : i + fan_out])) for i in range(0, len(nodes), fan_out)]
            at = [i // fan_out for i in at]
        return nodes[0], paths

    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    sets = {s: sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in order}
    trees = {s: tree([leaf(r) for r in sets[s]]) for s in order}
    root, tops = tree([trees[s][0] for s in order])
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    out = []
    for s, top in zip(order, tops, strict=True):
        for r, path in zip(sets[s], trees[s][1], strict=True):
            path = path + top
            found = (r[0], r[1] and r[1].translate(low), *r[2:]) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else r
            h = leaf(found)
            for before, after in path:
                h = SHA("".join(before) + h + "".join(after))
            out.append((r[0], leaf(r), trees[s][0], root, SHA("".join(x for b, a in path for x in b + a)), h))
    return out


def test_merkle_manifest(spark, folder, empty):
    got = queries.op12_merkle_manifest(spark, folder).collect()
    want = _manifest(ROWS, 16)
    assert collections.Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root) for r in got) == collections.Counter(want)
    assert all(r.verified == (r.folded_root == r.root) for r in got) and {r.verified for r in got} == {True, False}
    assert queries.op12_merkle_manifest(spark, empty).count() == 0


@pytest.mark.parametrize("fan_out", [2, 3])
def test_merkle_trees_of_many_heights(spark, fan_out):
    rows = [(i, f"T{i}", f"k{s}", None, None, "x") for s, n in enumerate((1, 2, 3, 8, 9, 27, 28)) for i in range(n)] + [(7, "only", None, "en", 1, "x")]
    made = merkle.build(spark.createDataFrame(rows, SCHEMA).repartition(3), f"{shared_dir(spark)}/m-{uuid.uuid4().hex}", fan_out=fan_out).proofs()
    back = made.select("key", "digest", "subroot", "root", merkle.proof_digest(F.col("path")).alias("p"), merkle.folded(F.col("digest"), F.col("path")).alias("f"))
    assert collections.Counter(tuple(r)[:5] for r in back.collect()) == collections.Counter(w[:5] for w in _manifest(rows, fan_out))
    assert back.where("f = root").count() == len(rows)


def test_merkle_hot_group_is_split(spark):
    hot = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("hot").alias("source"), F.lit("en").alias("lang"), F.lit(1).alias("n_chars"))
    same = spark.range(10_000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("t").alias("text"), F.lit("hot").alias("source"), F.lit("en").alias("lang"), F.lit(1).alias("n_chars"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # 40,000 rows would be one run
    numbered = merkle._numbered(hot.union(same).withColumn("r", F.monotonically_increasing_id()), ["source"], ["doc_id", "r"], "t")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = numbered.selectExpr("doc_id", "_idx", "_total").orderBy("_idx").toPandas()
    assert rows["_idx"].tolist() == list(range(40_000)) and rows["doc_id"].is_monotonic_increasing and set(rows["_total"]) == {40_000}
    sizes = spark.read.parquet(*{f.rsplit("/", 1)[0] for f in numbered.inputFiles()}).groupBy("_run").count().toPandas()["count"]
    assert sizes.max() < 3 * 40_000 / 8


def _place(windows, s, capacity):
    """The window that makes the sum of squared counts least, by trying each."""
    def total(ws):
        return sum(v * v for h, v in collections.Counter(ws).items() if 0 < h < capacity)

    tries = [(total([h + s if k == i else h for k, h in enumerate(windows)]), -windows[i], i) for i in range(len(windows)) if windows[i] + s <= capacity]
    tries.append((total([*windows, s]), 0, len(windows)))
    return min(tries)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=40))
def test_levels_take_the_least_sum_of_squares(lengths):
    levels, windows = ss_packing.Levels(16), []
    for s in lengths:
        want = _place(windows, s, 16)
        window, offset = levels.place(s)
        if window == len(windows):
            windows.append(0)
        assert windows[window] == offset
        windows[window] += s
        again = sum(v * v for h, v in collections.Counter(windows).items() if 0 < h < 16)
        assert (again, -offset) == want[:2]
        assert levels.count[1:16].tolist() == [windows.count(h) for h in range(1, 16)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 16), st.booleans()), max_size=50))
def test_lots_hold_every_token_once(items):
    lengths = [s for s, _ in items]
    pieces = ss_packing.pack_lot(lengths, [b"." if loose else None for _, loose in items], 16)
    held = collections.defaultdict(list)
    for i, start, n, window, offset in pieces:
        assert n > 0 and (items[i][1] or (start, n) == (0, lengths[i]))
        held[i].append((start, n))
    assert {i: sum(n for _, n in p) for i, p in held.items()} == dict(enumerate(lengths))
    for p in held.values():
        ends = [0, *[a + n for a, n in sorted(p)]]
        assert ends[:-1] == [a for a, _ in sorted(p)]
    fill = collections.defaultdict(int)
    for _, _, n, window, offset in sorted(pieces, key=lambda p: (p[3], p[4])):
        assert fill[window] == offset
        fill[window] += n
    assert max(fill.values(), default=0) <= 16
    if all(loose for _, loose in items):
        assert all(h & (h - 1) == 0 for h in fill.values())


def test_sum_of_squares_packing(spark, docs, folder, empty):
    got = queries.op13_sum_of_squares_packing(spark, folder).collect()
    encode = word_ids(queries.WORD_BPE)
    ids = collections.defaultdict(list)
    for r in ROWS:
        ids[r[0]].append(encode((r[1] or "").encode()) + b"\2\0\0\0")
    fill = collections.defaultdict(int)
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill[r.sequence_id] and r.length > 0
        fill[r.sequence_id] += r.length
        assert any(len(x) == 4 * r.doc_tokens and zlib.crc32(x[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32 for x in ids[r.doc_id])
    assert sum(fill.values()) == sum(len(x) // 4 for xs in ids.values() for x in xs) == sum(r.length for r in got)
    assert all(h <= 4096 and h & (h - 1) == 0 for h in fill.values())
    assert queries.op13_sum_of_squares_packing(spark, empty).count() == 0
    small = ss_packing.pack(docs.where("doc_id < 3 and doc_id >= 0"), queries.WORD_BPE, capacity=8).collect()
    assert sorted((r.length, r.offset) for r in small) == [(1, 0), (1, 0), (1, 1)]  # three ids: two windows, of 2 and of 1
