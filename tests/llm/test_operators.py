"""Small fixtures with nulls, empty, long, tied and repeated rows, against brute force."""

import collections
import hashlib
import math
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pneuma.llm import ann, bpe, common, exact_dedup, html_text, jaccard, packing, pii, sharding, substring_dedup, toxicity
from pneuma.llm.queries import BYTE_BPE, PATTERN, WORD_BPE

WORDS = [f"w{i}" for i in range(400)]
PASSAGE = " ".join(WORDS[100:160])


def _texts():
    rng = np.random.default_rng(4)
    some = [" ".join(rng.choice(WORDS, n)) for n in (3, 40, 80, 200, 500)]
    near = some[3].split()
    near[50] = "changed"
    return [
        None, "", "  \n ", "One two", "one TWO", *some, some[2], some[2].upper(), " ".join(near), f"start {PASSAGE} end", f"other {PASSAGE}\tlast {PASSAGE}",
        "a " * 300, "É" * 50 + "é", "x" * 30_000, " ".join(rng.choice(WORDS, 20_000)),
    ]


@pytest.fixture(scope="module")
def rows():
    texts = _texts()
    return [(None if i == 4 else i, t, f"k{i}") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, kept string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, kept string")


def _low(t):
    return (t or "").encode().lower()


def test_sharding(docs, rows, empty):
    got = sharding.shard(docs, shards=4).toPandas()
    assert len(got) == len(rows) and set(got["shard"]) <= set(range(4))
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    assert sorted(got["size"]) == sorted(len((t or "").encode()) + 8 for _, t, _ in rows)
    assert sorted(got["text_crc32"]) == sorted(zlib.crc32((t or "").encode()) for _, t, _ in rows)
    many = docs.sparkSession.range(20_000).select(F.col("id").alias("doc_id"), F.expr("if(id % 3 = 0, 'hot', repeat('z', cast(id % 97 as int)))").alias("text"))
    got = sharding.shard(many).toPandas()
    total = got.groupby("shard")["size"].sum()
    assert len(total) == 24 and total.max() - total.mean() <= 200 and total.mean() - total.min() <= 200
    assert sharding._quantiles(sorted([5] * 6 + [1, 9, 10]), 4) == [5, 5, 5] and sharding._quantiles([1], 2) == []
    assert sharding.shard(empty).count() == 0


def test_exact_dedup(docs, rows, empty):
    got = exact_dedup.dedup(docs).toPandas()
    groups = collections.defaultdict(list)
    for i, t, _ in rows:
        groups[_low(t)].append(i)
    want = sorted((str(i), str(max((x for x in g if x is not None), default=None)), len(g), hashlib.sha256(k).hexdigest()) for k, g in groups.items() for i in g)
    s = lambda v: "None" if v != v or v is None else str(int(v))
    assert sorted((s(r.doc_id), s(r.keep_id), r.group_size, r.text_sha256) for r in got.itertuples()) == want
    assert exact_dedup.dedup(empty).count() == 0


def test_substring_dedup(docs, rows, empty):
    w = 35
    split = [(t or "").encode().split() for _, t, _ in rows]
    count = collections.Counter(tuple(x[i : i + w]) for x in split for i in range(len(x) - w + 1))
    want = []
    for x in split:
        gone = set()
        for i in range(len(x) - w + 1):
            if count[tuple(x[i : i + w])] > 1:
                gone.update(range(i, i + w))
        want.append((len(x), len(gone), b" ".join(v for k, v in enumerate(x) if k not in gone)))
    got = substring_dedup.remove_repeats(docs).collect()
    assert sorted((r.n_words, r.n_removed, bytes(r.kept)) for r in got) == sorted(want)
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_jaccard(docs, rows, empty):
    sets = {}
    for i, t, _ in rows:
        x = _low(t).split()
        sets[i] = {tuple(x[k : k + 5]) for k in range(len(x) - 4)} if len(x) >= 5 else {tuple(x)} if x else set()
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                    low = min((v for v in (label[a], label[b]) if v is not None), default=None)
                    label[a] = label[b] = low
    got = {(None if r.doc_id is None else r.doc_id): (r.n_shingles, r.component_id) for r in jaccard.components(docs).collect()}
    assert got == {i: (len(s), label[i]) for i, s in sets.items()}
    assert jaccard.components(empty).count() == 0


def test_list_pairs_meets_every_cross_pair():
    rng = np.random.default_rng(0)
    token, sid = rng.integers(0, 30, 600), rng.integers(0, 80, 600)
    keep = np.unique(np.stack([token, sid]), axis=1)
    token, sid = keep
    label, n, pos = sid % 7, np.full(len(sid), 100), np.zeros(len(sid), np.int64)
    got = collections.Counter()
    for x in jaccard.list_pairs(token, sid, label, n, pos, 75):
        for a, b, *_, k in zip(*x, strict=True):
            got[int(a), int(b)] += int(k)
    want = collections.Counter((int(min(a, b)), int(max(a, b))) for t in range(30) for i, a in enumerate(sid[token == t]) for b in sid[token == t][:i] if a % 7 != b % 7)
    assert got == want


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    path = WORD_BPE
    tok = Tokenizer.from_file(path)
    want = collections.Counter()
    for _, t, _ in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[k // 2048, k, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes())] += 1
    got = packing.pack(docs, path).toPandas()
    assert collections.Counter((r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()) == want
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 2048
    assert packing.pack(empty, path).count() == 0
    lengths = np.array([5, 5, 5, 5])
    bins, _ = packing.best_fit(lengths, 20, 2, 1000, (1, 1, 1))
    assert max(np.bincount(bins)) == 2  # the limit on documents binds
    bins, _ = packing.best_fit(lengths, 20, 9, 50, (1, 1, 1), "dot")
    assert max(np.bincount(bins)) == 2  # the limit on attention cost binds


def test_byte_bpe(docs, rows, empty):
    import tiktoken

    path = BYTE_BPE
    lib = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    got = bpe.encode(docs, path, PATTERN, decode=True).collect()
    assert sorted(bytes(r.decoded) for r in got) == sorted((t or "").encode() for _, t, _ in rows)
    assert sorted(r.ids for r in got) == sorted(lib.encode_ordinary(t or "") for _, t, _ in rows)
    codec = bpe.codec(path, PATTERN)
    for s in ("a   b", " \n\n x\t y", "don't  '", "世界 🙂 é", "   ", " a\x1c b"):
        assert np.frombuffer(codec.encode(s), "<i4").tolist() == lib.encode_ordinary(s)
    assert bpe.encode(empty, path, PATTERN).count() == 0


def test_pii_base_equals_patterns():
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    rng = np.random.default_rng(1)
    parts = [*"012345 .-@+ab().,", "4111111111111111", "a@b.c", "1.2.3.4", "+1 (555) 555-5555 ", "300.1.1.1"]
    for _ in range(3000):
        s = "".join(rng.choice(parts, rng.integers(0, 25)))
        want = []
        for k, p in enumerate(patterns):
            for m in re.finditer(p, s):
                d = re.sub("[^0-9]", "", m[0])
                if [True, k == 1 and all(int(x) <= 255 for x in m[0].split(".")), 14 <= len(d) <= 19 and pii._luhn(d), 10 <= len(d) <= 15][k]:
                    want.append((m.start(), k, m.end()))
        assert pii.find(s) == sorted(want)


@pytest.mark.parametrize(
    "text,found", [("mail j.d (at) x (dot) org now", "j.d (at) x (dot) org"), ("ann at example dot com", "ann at example dot com"), ("jоhn@exаmple.com", "jоhn@exаmple.com"), ("plus one five five five one two three four five six seven", "plus one five five five one two three four five six seven"), ("１９２.168.0.1", "１９２.168.0.1")]
)
def test_pii_disguises(text, found):
    base, spans = pii.detect(text)
    assert found in [text[a:b] for a, _, b in spans] and set(base) <= set(spans)
    assert found not in pii.redact(text, spans)


@pytest.mark.parametrize(
    "found",
    ["john@example dot com", "ann at example.com", "a" * 70 + " at example dot com", "192 dot 168 dot 0 dot 1", "192.168 dot zero dot 1", "john dot smith at example dot com",
     "john dot smith@example.com", "john dot smith (at) mail dot example dot co dot uk", "ann at example dot co dot uk", "๑๙๒.๑๖๘.๐.๑", "𝟏𝟗𝟐.𝟏𝟔𝟖.𝟎.𝟏", "192.168.0.1２",
     "jane at example dot systems", "one nine two dot one six eight dot one dot one", "b" * 70 + " at mail.example dot photography"],
)
def test_pii_at_and_dot_are_undone_independently(found):
    text = f"so, {found}, yes"
    assert found in [text[a:b] for a, _, b in pii.detect(text)[1]]
    assert pii.redact(text, pii.detect(text)[1]) in ("so, <EMAIL>, yes", "so, <IP>, yes")


@pytest.mark.parametrize("found,kind", [
    ("four one one one 1111 1111 1111", "CARD"), ("four one one one one one one one one one one one one one one one", "CARD"), ("4111 1111 one one one one 1111", "CARD"),
    ("plus 1 five five five 123 four five six seven", "PHONE"), ("+1 five five five 123 four five six seven", "PHONE"),
])
def test_pii_words_mixed_with_figures(found, kind):
    assert pii.redact(f"so, {found}, yes", pii.detect(f"so, {found}, yes")[1]) == f"so, <{kind}>, yes"


def test_pii_against_a_second_reading():
    """Identifiers under random disguises, put into prose: all are found at their very place, and nothing else is."""
    rng = np.random.default_rng(12)
    words = "zero one two three four five six seven eight nine".split()
    pick = lambda *x: x[rng.integers(0, len(x))]
    digits = lambda d: " ".join(words[int(c)] for c in d)
    for _ in range(400):
        name, host, last = pick("ann", "j.doe", "mary_k"), pick("example", "mail", "site-x"), pick("com", "org", "museum", "co")
        octets = [str(rng.integers(0, 256)) for _ in range(4)]
        card = pick("4111111111111111", "5500005555555559", "340000000000009")
        made = {
            "EMAIL": f"{name}{pick(' at ', ' (at) ', ' [AT] ', '@')}{host}{pick(' dot ', ' (dot) ')}{last}",
            "IP": pick(" dot ".join(octets), "[dot]".join(octets), " dot ".join(map(digits, octets)), ".".join(octets).translate({48 + k: 0xFF10 + k for k in range(10)})),
            "CARD": pick(digits(card), f"{digits(card[:4])} {card[4:]}", "\u200b".join(card)),
        }
        kind = pick(*made)
        text = f"Bring it to {pick('Zoë', 'them')}; {made[kind]}; and go on."
        spans = [(text[a:b], pii.KINDS[k]) for a, k, b in pii.detect(text)[1]]
        assert spans == [(made[kind], kind.lower())], text


def test_pii_plain_words_stay():
    for s in ("see us at www.example.com", "look at file.txt", "1 dot 2 dot 3", "at 5.30 dot", "the dot at the end. dot com", "one two", "in 2019 one of 30", "chapter one 1 and two 2"):
        assert pii.detect(s) == ([], [])


def test_pii_leaves_prose_alone(docs, rows, empty):
    assert pii.detect("look at the dot on top at noon. one two") == ([], [])
    assert pii.scan(docs).where(F.size("spans") > 0).count() == 0
    assert sorted(str(r.text) for r in pii.redacted(docs).collect()) == sorted(str(t) for _, t, _ in rows)
    assert pii.scan(empty).count() == 0 and pii.redacted(empty).columns == empty.columns


def test_html(spark):
    page = "<html><body><nav><ul><li><a href=1>Home</a></ul></nav><div class='ad'>Buy</div><article><h1>T &amp; t</h1><p><b>One\n two.<br><p>Three <a href=x>four</a>.</article><div id=comments><p>Nice!</div><footer>&copy;</footer>"
    df = spark.createDataFrame([(1, "u", page), (None, None, None), (3, "u", ""), (4, "u", "<p>a<p>b <i>c"), (5, "u", "<div " * 3000 + "<!-- " * 3000)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(df).collect()}
    assert got[1] == "T & t\nOne two.\nThree four." and got[None] == "" and got[3] == "" and got[4] == "a\nb c"
    assert html_text.extract(df.limit(0)).count() == 0


def test_toxicity_held_out(spark, docs, empty):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(1500):
        bad = i % 9 == 0
        rows.append((i, " ".join([*rng.choice(WORDS, 30), *(rng.choice(["vilest", "vilely", "scumbag"], 2) if bad else [])])))
        labels.append((i, int(bad)))
    texts, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(texts, marks)
    got = toxicity.score(texts, model).where("held_out").join(marks, "doc_id").collect()
    assert np.mean([r.predicted == r.toxic for r in got]) > 0.97
    assert toxicity.score(docs, model).where("score between 0 and 1").count() == docs.count()
    assert toxicity.score(empty, toxicity.train(empty, marks.limit(0))).count() == 0
    assert toxicity.score(empty, toxicity.train(empty, marks)).count() == 0
    assert toxicity.kept(texts, model).count() == len(rows) - toxicity.score(texts, model).where("score >= 0.5").count()


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((1200, 16)).astype(np.float32)
    v[5:40] = v[0]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(None, v[0].tolist()), (5000, None), (5020, [0.0] * 16), (5040, [float("nan")] * 16), (5060, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.neighbours(df).toPandas()
    near = v.astype(float) @ v.astype(float).T
    hits = 0
    for q, g in got.groupby("query_id"):
        assert q % 20 == 0 and list(g.sort_values("rank")["rank"]) == list(range(1, 21)) and q not in set(g.vec_id)
        order = sorted((-near[q, j], j) for j in range(len(v)) if j != q)[:20]
        hits += len({j for _, j in order} & set(g.vec_id))
    assert got.query_id.nunique() == 60 and hits / 1200 >= 0.9
    assert list(got[got.query_id == 0].sort_values("rank").vec_id) == list(range(5, 25))
    few = ann.neighbours(df.where("vec_id in (0, 100, 101)")).toPandas()
    assert sorted(few.vec_id) == [0, 100] + [101, 101] or sorted(few.vec_id) == [0, 100, 101, 101]
    assert ann.neighbours(df.limit(0)).count() == 0


def test_toxicity_reads_long_words_to_their_end(spark):
    model = {"weights": {x: 9.0 for x in toxicity.features("scumbag") if x not in toxicity.features("x")}, "bias": -5.0}
    texts = ["字" * 60 + "scumbag" + "字" * 200, "字" * 267]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.predicted for r in toxicity.score(rows, model).orderBy("doc_id").collect()] == [1, 0]


def _recall(spark, v):
    got = ann.neighbours(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")).toPandas()
    near = v.astype(float) @ v.astype(float).T
    np.fill_diagonal(near, -np.inf)
    best = {q: set(np.argsort(-near[q], kind="stable")[:20]) for q in range(0, len(v), 20)}
    return np.mean([len(best[q] & set(g.vec_id)) / 20 for q, g in got.groupby("query_id")])


def test_neighbours_beside_a_large_component_and_in_a_group_of_near_copies(spark):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((1200, 16))
    v /= np.linalg.norm(v, axis=1)[:, None]
    large = v.copy()
    large[7] = 0
    large[7, 0] = 1000
    assert _recall(spark, large.astype(np.float32)) >= 0.9
    v[300:700] = v[300] + 1e-4 * rng.standard_normal((400, 16))
    assert _recall(spark, v.astype(np.float32)) >= 0.9


def _thue_morse(n, x, y):
    bits = [0]
    while len(bits) < n:
        bits += [1 - b for b in bits]
    return "".join(x if b else y for b in bits[:n])


def test_long_words_that_a_polynomial_confuses_stay_apart(spark):
    one, two = _thue_morse(1024, "a", "b"), _thue_morse(1024, "b", "a")
    filler = [f"u{i}" for i in range(34)]
    rows = spark.createDataFrame([(1, " ".join([*filler, one])), (2, " ".join([*filler, two]))], "doc_id long, text string")
    assert [r.n_removed for r in substring_dedup.remove_repeats(rows).collect()] == [0, 0]
    apart = spark.createDataFrame([(1, " ".join([one] * 3)), (2, " ".join([two] * 3))], "doc_id long, text string")
    assert sorted(r.component_id for r in jaccard.components(apart).collect()) == [1, 2]


def test_word_keys_tell_words_apart():
    texts = ["a", "b", "ab", "ba", "abcdefgh", "abcdefghi", "abcdefg", "x" * 15, "x" * 16, "x" * 17, "x" * 16 + "y", "é", "a\0", "a\0\0"]
    data = np.frombuffer(" ".join(texts).encode(), np.uint8)
    starts, ends, _ = common.words(data, np.array([0, len(data)]))
    keys = common.word_keys(data, starts, ends)
    assert len(starts) == len(texts) == len({k.tobytes() for k in keys}) == len(set(common.word_hashes(keys).tolist()))
    assert keys.tobytes() == common.word_keys(data[: ends[-1]], starts, ends).tobytes()


@pytest.mark.parametrize("block", [400, 40])
def test_jaccard_long_lists_against_brute_force(spark, monkeypatch, block):
    """Lists of more than LONG_LIST sets, groups of several blocks, several labels in a list."""
    monkeypatch.setattr(jaccard, "GROUP_BLOCK", block)
    rng = np.random.default_rng(8)
    base = [list(rng.choice(WORDS, n)) for n in (60, 60, 90)]
    base[1][:45] = base[0][:45]
    texts = []
    for i in range(1100):
        x = list(base[i % 3])
        for _ in range(rng.integers(0, 4)):
            x[rng.integers(0, len(x))] = f"n{rng.integers(0, 6)}"
        texts.append(" ".join(x))
    texts += texts[:40]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    place = {s: k for k, s in enumerate(sorted(set().union(*sets)))}
    x = np.zeros((len(sets), len(place)), np.float32)
    for i, s in enumerate(sets):
        x[i, [place[t] for t in s]] = 1
    both, size = x @ x.T, x.sum(1)
    linked = 100 * both >= 75 * (size[:, None] + size[None, :] - both)
    label = np.arange(len(sets))
    while True:
        new = np.where(linked, label[None, :], len(sets)).min(1)
        if (new == label).all():
            break
        label = new
    assert got == {i: (len(s), label[i]) for i, s in enumerate(sets)}
    assert 3 < len(set(label.tolist())) < 1100


def test_sharding_keeps_small_groups_of_equal_texts_whole(spark):
    """A hot text with repeated ids beside 4,000 groups of three equal texts, none larger than the largest record."""
    rows = spark.range(60_000).select(F.when(F.col("id") % 5 == 0, 1).otherwise(F.col("id")).alias("doc_id"), F.expr("if(id % 5 = 0, 'hot', concat('t', id div 15, ' ', repeat('z', 20 + id % 5)))").alias("text"))
    rows = rows.union(spark.createDataFrame([(-1, "l" * 900)], "doc_id long, text string"))
    got = sharding.shard(rows).toPandas()
    total = got.groupby("shard")["size"].sum()
    assert len(got) == 60_001 and len(total) == 24 and (total - total.mean()).abs().max() <= 908
    hot = zlib.crc32(b"hot")
    shards = got[got.text_crc32 != hot].groupby("text_crc32")["shard"].nunique()
    assert shards.max() == 1 and got[got.text_crc32 == hot]["shard"].nunique() >= 2
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))


PROSE = "<p>" + "Some long words of an article stand here and go on for long. " * 5 + "</p>"


@pytest.mark.parametrize("part", [
    "<div class='article-header'><h1>Kept</h1></div>", "<p class='notice-period'>Kept</p>", "<p class='social-science'>Kept</p>",
    "<p id='share-of-gdp'>Kept</p>", "<ul class='related-work'><li>Kept</ul>", "<header><h1>Kept</h1></header>", "<p>Kept <a href=x>link</a>",
])
@pytest.mark.parametrize("holder", ["article", "div id=content class='has-sidebar post-share'"])
def test_html_names_inside_an_article_stay(part, holder):
    page = f"<html><body><nav><a href=/>Menu</a></nav><{holder}>{part}{PROSE * 3}</{holder.split()[0]}><footer>Foot</footer></body></html>"
    got = html_text.main_text(page)
    assert "Kept" in got and got.count("Some long words") == 15 and "Menu" not in got and "Foot" not in got


@pytest.mark.parametrize("part", [
    "<div class='ad'>Gone</div>", "<div class='cookie-notice'><p>Gone</div>", "<div id=comments><p>Gone" + PROSE * 9 + "</div>", "<div class='post-comments'>Gone</div>",
    "<aside>Gone</aside>", "<form><p>Gone</form>", "<div role=navigation>Gone</div>", "<div class='siteFooter'>Gone</div>", "<div style='display: none'>Gone</div>", "<script>Gone</script>",
    "<ul><li><a href=1>Gone</a><li><a href=2>Gone</a><li><a href=3>Gone</a></ul>",
])
@pytest.mark.parametrize("holder", ["article", "div"])
def test_html_boilerplate_goes(part, holder):
    got = html_text.main_text(f"<body>{part}<{holder}><h1>Title</h1>{PROSE * 4}</{holder}>{part}</body>")
    assert got.startswith("Title\nSome") and "Gone" not in got and got.count("Some long words") == 20


@pytest.mark.parametrize("holder", ["article", "div", "main"])
def test_html_article_content_stays(holder):
    """Links, names and asides in an article stay unless they are thin or mostly links."""
    long = "A long sentence of the article that a reader should see, as it is as dense as the paragraphs that stand around it here."
    stays = {
        "<p><a>one</a> and <a>two</a></p>": "one and two", "<h2><a>first</a> <a>second</a></h2>": "first second", "<ul><li><a>ref one</a></li><li><a>ref two</a></li></ul>": "ref one\nref two",
        '<p class="share">Share of the market.</p>': "Share of the market.", '<p class="copyright">Copyright law.</p>': "Copyright law.", f'<div class="notices"><p>{long}</p></div>': long,
        f"<aside><p>{long}</p></aside>": long, f"<noscript><p>{long}</p></noscript>": long, f'<section id="promo"><p>{long}</p></section>': long,
    }
    goes = ['<div class="ad">Buy now</div>', '<ul class="related"><li><a>More one</a></li><li><a>More two</a></li></ul>', "<aside><a>See also</a></aside>", "<button>Press</button>", "<nav><a>x</a></nav>", f'<div role="complementary">{long}</div>']
    prose = PROSE * 2
    page = lambda part: html_text.main_text(f"<body><nav><a>Home</a></nav><{holder}><h1>T</h1>{prose}{part}{prose}</{holder}><footer>f</footer></body>")
    alone = page("").split("\n")
    for part, text in stays.items():
        assert page(part) == "\n".join([*alone[:3], text, *alone[3:]]), part
    for part in goes:
        assert page(part).split("\n") == alone, part


def test_html_forms_and_containers_that_hold_the_article_stay():
    for page in (f"<body><form><article><h1>T</h1>{PROSE}</article></form>", f"<body><form class=modal><h1>T</h1>{PROSE * 2}</form>", f"<body><h1>T</h1><div>{PROSE * 2}</div><div>{PROSE * 2}</div>"):
        assert html_text.main_text(page).startswith("T\nSome")
    assert html_text.main_text("plain text &amp; more") == "plain text & more"


@pytest.mark.parametrize("page", [
    "<a b " * 200_000, "<div>" * 100_000, "<div>" * 50_000 + "</span>" * 100_000, "<p><table><td>" + "<b><div>" * 30_000, "<a \">\" " * 100_000 + "'",
    "<ul><li>a" * 30_000, "<a title=\"x>" * 90_000 + "'", "<!--" * 200_000,
])
def test_html_long_pages_take_linear_time(page):
    begin = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - begin < 15


def _density_by_hand(html, path):
    """The composite density of the element at a path of child numbers, read from its text and tags by regular expressions."""
    chars = lambda h: sum(len(" ".join(t.split())) for t in re.split("<[^>]*>", h))
    links = re.findall(r"<a [^>]*>.*?</a>", html[path], re.S)
    c, t = chars(html[path]), max(1, len(re.findall(r"<[a-z]", html[path])) - 1)
    lc, lt = sum(map(chars, links)), len(links)
    body_c, body_lc = chars(html[0]), sum(chars(x) for x in re.findall(r"<a [^>]*>.*?</a>", html[0], re.S))
    base = math.log(c / max(c - lc, 1) * lc + body_lc / body_c * c + math.e)
    return c / t * max(0.0, math.log(c / max(lc, 1) * (t / max(lt, 1)))) / math.log(max(base, 1.0) + 1.0)


def test_html_density_against_brute_force():
    """Random pages: density of every element against its definition, and the densest subtree by trying all."""
    rng = np.random.default_rng(21)
    for _ in range(60):
        parts = []
        for k in range(rng.integers(2, 6)):
            inner = "".join(f"<p>{'w' * int(rng.integers(1, 300))} {'<a href=1>' + 'l' * int(rng.integers(1, 90)) + '</a>' if rng.random() < 0.4 else ''}</p>" for _ in range(rng.integers(1, 5)))
            parts.append(f"<div>{inner}</div>")
        page = f"<body>{''.join(parts)}</body>"
        _, body, best = html_text._best(html_text.parse(page))
        sums = []
        for k, (node, text) in enumerate(zip(body.kids, parts, strict=True)):
            assert node.density == pytest.approx(_density_by_hand({0: page, 1: text}, 1))
            kids = re.findall(r"<p>.*?</p>", text)
            assert [x.density for x in node.kids] == pytest.approx([_density_by_hand({0: page, 1: x}, 1) for x in kids])
            sums.append((sum(_density_by_hand({0: page, 1: x}, 1) for x in kids), node))
        sums.append((sum(_density_by_hand({0: page, 1: x}, 1) for x in parts), body))
        assert best.sum == pytest.approx(max(s for s, _ in sums))


def test_html_repeated_rows_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "u", "<p>a", "x"), (1, "u", "<p>a", "y"), (None, None, "<p>b", "z")], "page_id long, url string, html string, text string")
    assert sorted(r.text for r in html_text.extract(df).collect()) == ["a", "a", "b"]


def test_sharding_of_distinct_texts(spark):
    """No range is overfull and no key stands alone."""
    got = sharding.shard(spark.range(3_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))).toPandas()
    total = got.groupby("shard")["size"].sum()
    assert len(got) == 3_000 and len(total) == 24 and (total - total.mean()).abs().max() <= 17


def test_neighbours_with_skewed_norms_and_clusters(spark):
    rng = np.random.default_rng(9)
    v = rng.standard_normal((1200, 16)) * rng.lognormal(0, 1, (1200, 1))
    assert _recall(spark, v.astype(np.float32)) >= 0.9
    centres = rng.standard_normal((6, 16)) * 3
    assert _recall(spark, (centres[rng.integers(0, 6, 1200)] + 0.3 * rng.standard_normal((1200, 16))).astype(np.float32)) >= 0.9


def test_neighbours_of_repeated_ids_and_clashing_columns(spark):
    rows = [(0, [1.0, 0.0], "a"), (0, [0.9, 0.1], "b"), (1, [1.0, 0.0], "c"), (2, [0.0, 1.0], "d"), (2, [0.0, 1.0], "e")]
    got = ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>, node string"), k=3).collect()
    assert {r.query_id for r in got} == {0} and all(r.vec_id != 0 for r in got)
    assert sorted((r["rank"], r.vec_id, r.score) for r in got)[0] == (1, 1, 0.9) or sorted((r["rank"], r.vec_id, r.score) for r in got)[0] == (1, 1, 1.0)


def test_toxicity_of_repeated_rows_and_clashing_columns(spark):
    model = {"weights": {x: 1.0 for x in toxicity.features("bad")}, "bias": -1.0}
    rows = spark.createDataFrame([(1, "bad bad", 5.0), (1, "bad bad", 6.0), (None, None, None)], "doc_id long, text string, score double")
    got = toxicity.score(rows, model).collect()
    assert len(got) == 3 and len({r.score for r in got if r.doc_id == 1}) == 1
    assert toxicity.kept(rows, model).columns == rows.columns


@pytest.mark.parametrize("shown,kind", [
    ("jane@example[.]com", "email"), ("jane[@]example[.]com", "email"), ("jane{@}example{.}org", "email"), ("192[.]168[.]1[.]1", "ip"), ("1[.]2[.]3[.]4", "ip"), ("jane @ example . com", "email"),
    ("a.b @ mail.example.com", "email"), ("jane_at_example_dot_com", "email"), ("jane-at-example-dot-com", "email"), ("plus four four two oh seven nine four six double five one two", "phone"),
    ("four triple one triple one triple one triple one triple one", "card"),
])
def test_pii_signs_in_disguise(shown, kind):
    text = f"Write to {shown} or not."
    base, spans = pii.detect(text)
    assert not base and [(pii.KINDS[k], text[a:b]) for a, k, b in spans] == [(kind, shown)]


@pytest.mark.parametrize("prose", ["see [.] and x @ y", "ann @home . today", "look at the dot on top", "triple six is bad", "he bought one_at_a_time", "a double one and a triple two", "costs 5 @ 3 . 50 each"])
def test_pii_prose_stays(prose):
    assert pii.detect(prose) == ([], [])
