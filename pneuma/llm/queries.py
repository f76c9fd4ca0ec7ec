"""The registered queries of the corpus operators: fn(spark, sf_dir) with production parameters over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, exact_dedup, fim, html_text, jaccard, merkle, packing, pii, sharding, ss_packing, substring_dedup, toxicity
from .common import shared_dir

#: Files of the vocabularies, and the pattern that splits text before the merges of the byte-level one.
WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"), shards=24)


def op2_substring_dedup(spark, sf_dir):
    done = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), width=35)
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_nearest_neighbours(spark, sf_dir):
    return ann.neighbours(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op4_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), WORD_BPE, capacity=2048)


def op5_exact_dedup(spark, sf_dir):
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark, sf_dir):
    coded = bpe.encode(table(spark, sf_dir, "documents"), BYTE_BPE, PATTERN, decode=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_ngram_jaccard_join(spark, sf_dir):
    return jaccard.components(table(spark, sf_dir, "documents"), width=5, percent=75)


def op8_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op9_html_extraction(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op10_pii(spark, sf_dir):
    found = pii.scan(table(spark, sf_dir, "documents"))
    told = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in pii.KINDS], F.sha2(told("base").cast("binary"), 256).alias("base_sha256"), told("spans").alias("spans"))


def op11_fill_in_middle(spark, sf_dir):
    done = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    hashed = lambda c: F.sha2(c.cast("binary"), 256)
    back = fim.restored(F.col("output"), F.col("form"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", hashed(F.col("output")).alias("output_sha256"), hashed(back).alias("restored_sha256"))


def op12_merkle_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    # Tampering lower-cases the text of a fifth of the ids; the leaf of what is then found goes beside the original one.
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    text = F.when(tampered, F.translate("text", upper, lower)).otherwise(F.col("text"))
    found = merkle.leaf_digest([text if f == "text" else F.col(f) for f in merkle.FIELDS])
    proofs = merkle.build(docs, f"{shared_dir(spark)}/merkle-{uuid.uuid4().hex}", carry={"found": F.when(tampered, found)}).proofs()
    again = merkle.folded(F.coalesce("found", "digest"), F.col("path"))
    told = proofs.select(F.col("key").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), again.alias("folded_root"))
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_sum_of_squares_packing(spark, sf_dir):
    return ss_packing.pack(table(spark, sf_dir, "documents"), WORD_BPE, capacity=4096, last_id=2)


_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

_HEX = "('0x' || substring({0}, {1}, 8))::bigint"

#: Fill-in-the-middle over lists of units.
_FIM = f"""
        with d as (select doc_id, coalesce(text, '') as text, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
        u as (select *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') as u from d),
        c as (select *, len(u)::bigint as n, {_HEX.format("h", 1)} % (len(u) + 1) as x, {_HEX.format("h", 9)} % (len(u) + 1) as y,
                     text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or {_HEX.format("h", 17)} % 100 >= 90 as plain, {_HEX.format("h", 25)} % 100 < 20 as spm from u),
        p as (select *, array_to_string(u[1:least(x, y)], '') as p, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') as m, array_to_string(u[greatest(x, y) + 1:], '') as s from c)
        select doc_id, n, case when plain then 'plain' when spm then 'spm' else 'psm' end as form, case when not plain then length(p)::bigint end as prefix_chars,
               case when not plain then length(m)::bigint end as middle_chars,
               sha256(case when plain then text when spm then '<S>' || s || '<P>' || p || '<M>' || m else '<P>' || p || '<S>' || s || '<M>' || m end) as output_sha256, sha256(text) as restored_sha256
        from p"""


def _merkle_sql(levels: int = 6, top_levels: int = 4, fan: int = 16) -> str:
    """The manifest level by level: for a group of up to fan ** levels leaves, and fan ** top_levels groups."""
    enc = lambda c: f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')"
    leaf = lambda text: "sha256(" + " || ".join(enc(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    # crc32 bit by bit: each byte goes in with the first of eight shifts.
    crc = ("xor(list_reduce(list_concat([4294967295::bigint], flatten(list_transform(regexp_extract_all(doc_id::varchar, '.'), lambda x: [ord(x)::bigint, 0, 0, 0, 0, 0, 0, 0]))), "
           "lambda c, b: xor(xor(c, b) >> 1, 3988292384::bigint * (xor(c, b) & 1))), 4294967295::bigint)")
    at = f"over (partition by g, i // {fan} order by i rows between"
    steps = [f"""with recursive d as (select *, row_number() over () as id, {leaf('text')} as leaf,
            case when {crc} % 5 = 0 then {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} else {leaf('text')} end as found from documents),
        s as (select source, row_number() over (order by source nulls first) - 1 as g from (select distinct source from documents)),
        n0 as (select id, doc_id, leaf, found, g, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as i, leaf as h from d join s on d.source is not distinct from s.source)"""]

    def climb(name: str, levels: int) -> None:
        for k in range(levels):
            steps.append(f"""{name}p{k} as (select g, i, h, count(*) over (partition by g) as n, coalesce(string_agg(h, '') {at} unbounded preceding and 1 preceding), '') as b,
                coalesce(string_agg(h, '') {at} 1 following and unbounded following), '') as a from {name}{k})""")
            steps.append(f"{name}{k + 1} as (select g, i // {fan} as i, sha256(string_agg(h, '' order by i)) as h from {name}p{k} where n > 1 group by g, i // {fan})")

    climb("n", levels)
    steps.append("t0 as (select 0 as g, g as i, h from (" + " union all ".join(f"select g, h from np{k} where n = 1" for k in range(levels)) + "))")
    climb("t", top_levels)
    # From a leaf up: siblings so far, and the digest of what was found there.
    steps.append("w0 as (select id, doc_id, leaf, found as f, '' as proof, g, i from n0)")
    last = 0
    for name, k in [("n", k) for k in range(levels)] + [("t", k) for k in range(top_levels)]:
        g, i = ("w.g", f"w.i // {fan ** k}") if name == "n" else ("0", f"w.g // {fan ** k}")
        steps.append(f"""w{last + 1} as (select id, doc_id, leaf, case when p.n > 1 then sha256(p.b || w.f || p.a) else w.f end as f, w.proof || coalesce(case when p.n > 1 then p.b || p.a end, '') as proof, w.g, w.i
            from w{last} w left join {name}p{k} p on p.g = {g} and p.i = {i})""")
        last += 1
    root = " union all ".join(f"select h from tp{k} where n = 1" for k in range(top_levels))
    return ", ".join(steps) + f""" select doc_id, leaf, t0.h as subroot, r.h as root, sha256(proof) as proof_sha256, f as folded_root, f = r.h as verified
        from w{last} w join t0 on t0.i = w.g cross join ({root}) r"""


ORACLES: dict[str, str] = {
    "op11_fill_in_middle": _FIM,
    "op12_merkle_manifest": _merkle_sql(),
    "op2_substring_dedup": f"""
        with d as (select doc_id, {_WORDS.format("coalesce(text, '')")} as w from documents),
        windows as (select doc_id, i, list_aggregate(w[i:i + 34], 'string_agg', ' ') as s
                    from (select doc_id, w, unnest(range(1, len(w) - 33)) as i from d)),
        repeated as (select doc_id, i from windows where s in (select s from windows group by s having count(*) > 1)),
        words as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as k from d),
        covered as (select distinct doc_id, i + j as k from repeated, range(0, 35) t(j)),
        marked as (select words.*, covered.k is not null as gone from words left join covered using (doc_id, k)),
        kept as (select doc_id, count(*) as n_words, sum(gone::int)::bigint as n_removed,
                        coalesce(string_agg(word, ' ' order by k) filter (where not gone), '') as t
                 from marked group by doc_id)
        select d.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256
        from d left join kept using (doc_id)""",
    "op7_ngram_jaccard_join": f"""
        with recursive d as (select doc_id, {_WORDS.format(_LOWER.format("text"))} as w from documents),
        shingles as (
            select distinct doc_id, list_aggregate(w[i:i + 4], 'string_agg', ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from d)
            union all select doc_id, list_aggregate(w, 'string_agg', ' ') from d where len(w) between 1 and 4),
        n as (select doc_id, count(*) as n from shingles group by doc_id),
        links as (
            select x.a, x.b from (select p.doc_id as a, q.doc_id as b, count(*) as i from shingles p join shingles q on p.s = q.s and p.doc_id <> q.doc_id group by 1, 2) x
            join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * i >= 75 * (na.n + nb.n - i)),
        reach as (select doc_id as v, doc_id as u from d union select r.v, l.b from reach r join links l on l.a = r.u)
        select d.doc_id, coalesce(n, 0) as n_shingles, (select min(u) from reach where v = d.doc_id) as component_id
        from d left join n on n.doc_id = d.doc_id""",
    "op5_exact_dedup": f"""
        select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
               doc_id = max(doc_id) over w as kept, sha256(t) as text_sha256
        from (select doc_id, {_LOWER.format('text')} as t from documents)
        window w as (partition by t)""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}
