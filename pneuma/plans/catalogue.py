"""Queries of the clinical operators over views of the driver's tables, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clinical, colour, text
from ..operators import batch, boxes, labels, layout, metrics, reports
from ..sources import files
from ..sources.tables import dealt
from ..sources.tables import table as _table
from . import further, grid, pages, told

QUERIES: dict = grid.QUERIES | pages.QUERIES | told.QUERIES | further.QUERIES
ORACLES: dict[str, str] = grid.ORACLES | pages.ORACLES | told.ORACLES | further.ORACLES


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


# Tokens: the events of a user; their place is the second since the user's first one.
_TOKENS = "select user_id as case_no, event_id as pos, epoch(ts)::double - min(epoch(ts)::double) over (partition by user_id) as cy, value as x, event_type as text from events"


def _tokens(spark, sf_dir):
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    events = _table(spark, sf_dir, "events")
    first = events.groupBy("user_id").agg(F.min(at).alias("_at0"))  # one row a user beside the events, which are not sorted
    return events.join(first, "user_id").select(F.col("user_id").alias("case_no"), F.col("event_id").alias("pos"), (at - F.col("_at0")).alias("cy"), F.col("value").alias("x"), F.col("event_type").alias("text"))


@query(f"""with g as (select *, case when cy - lag(cy) over (partition by case_no order by cy, pos) > 1800 then 1 else 0 end as o from ({_TOKENS})),
    l as (select *, sum(o) over (partition by case_no order by cy, pos rows unbounded preceding) as line from g)
    select case_no, line::bigint as line, count(*) as n, string_agg(text, ' ' order by pos) as cell from l group by case_no, line""")
def lines_of_tokens(spark, sf_dir):
    lines = layout.group_lines(_tokens(spark, sf_dir), 1800.0)
    return layout.assemble(lines, ["case_no", "line"]).select("case_no", F.col("line").cast("long").alias("line"), "n", "cell")


_CENTRES = "select o_custkey as case_no, o_orderkey as idx, epoch(o_orderdate)::double / 86400 as centre from orders"


def _centres(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_no"), F.col("o_orderkey").alias("idx"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6 / 86400).alias("centre"))


_WINDOWS = f"""select case_no, idx, coalesce((lag(centre) over w + centre) / 2, 0) as lo, coalesce((centre + lead(centre) over w) / 2, 100000) as hi from ({_CENTRES}) window w as (partition by case_no order by idx)"""


@query(_WINDOWS)
def windows_of_centres(spark, sf_dir):
    return layout.windows_from_centres(_centres(spark, sf_dir), 0.0, 100000.0)


_SHIPPED = "select o_custkey as case_no, l_orderkey * 10 + l_linenumber as pos, epoch(l_shipdate)::double / 86400 as cy from (select l_orderkey, l_linenumber, min(l_shipdate) as l_shipdate from lineitem group by all) join orders on l_orderkey = o_orderkey"


@query(f"select t.case_no, t.pos, min(w.idx) as idx from ({_SHIPPED}) t join ({_WINDOWS}) w on t.case_no = w.case_no and t.cy between w.lo and w.hi group by t.case_no, t.pos")
def tokens_in_windows(spark, sf_dir):
    items = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_shipdate").alias("at"))
    tokens = items.join(_table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("case_no"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), (F.unix_micros(F.col("at").cast("timestamp")) / 1e6 / 86400).alias("cy"))
    return layout.assign(tokens, layout.windows_from_centres(_centres(spark, sf_dir), 0.0, 100000.0)).select("case_no", "pos", "idx")


_ANCHORS = "select l_orderkey as case_no, l_linenumber as idx, min(l_extendedprice) as y from lineitem group by all"


def _anchors(spark, sf_dir):
    """Anchors dealt by case: what follows within a case moves no rows."""
    return dealt(_table(spark, sf_dir, "lineitem"), "l_orderkey").groupBy(F.col("l_orderkey").alias("case_no"), F.col("l_linenumber").alias("idx")).agg(F.min("l_extendedprice").alias("y"))


@query(f"select case_no, round(regr_slope(y, idx), 4) as slope, round(regr_intercept(y, idx), 4) as intercept, count(*) as n from ({_ANCHORS}) group by case_no having count(*) >= 6")
def fitted_rows(spark, sf_dir):
    return layout.fit_line(_anchors(spark, sf_dir)).select("case_no", F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"), "n")


@query(f"""with d as (select case_no, (y - lag(y) over w) / (idx - lag(idx) over w) as d from ({_ANCHORS}) window w as (partition by case_no order by idx)),
    s as (select case_no, list_sort(list(d)) as ds from d where d is not null group by case_no)
    select case_no, round(ds[(len(ds) // 2)::bigint + 1], 6) as spacing from s""")
def row_spacing(spark, sf_dir):
    return layout.spacing(_anchors(spark, sf_dir)).select("case_no", F.round("spacing", 6).alias("spacing"))


@query("with s as (select user_id as case_no, list_sort(list(value)) as xs from events where value is not null group by user_id) select case_no, xs[round_even(0.05 * (len(xs) - 1), 0)::bigint + 1] as value from s")
def left_edge(spark, sf_dir):
    return layout.index_percentile(_table(spark, sf_dir, "events").where("value is not null").select(F.col("user_id").alias("case_no"), "value"), "value", 0.05)


@query("select user_id as case_no, event_type, event_id as pos, value from (select *, row_number() over (partition by user_id, event_type order by value desc nulls last, event_id) as r from events) where r = 1")
def best_headers(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select(F.col("user_id").alias("case_no"), "event_type", F.col("event_id").alias("pos"), "value")
    return layout.best_per_group(rows, ["case_no", "event_type"], "value", "pos")


@query()
def column_centres(spark, sf_dir):
    return layout.k_medians(_anchors(spark, sf_dir).where("y is not null"), 2, value="y")


_BOXES = "select l_orderkey as case_no, l_linenumber as pos, min(l_partkey % 1000) as x, min(l_suppkey % 1000) as y, min(20 + l_quantity * 5) as w, min(20 + l_linenumber * 30) as h from lineitem group by l_orderkey, l_linenumber"


def _boxes(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("case_no"), F.col("l_linenumber").alias("pos")).agg(
        F.min(F.col("l_partkey") % 1000).alias("x"), F.min(F.col("l_suppkey") % 1000).alias("y"), F.min(20 + F.col("l_quantity") * 5).alias("w"), F.min(20 + F.col("l_linenumber") * 30).alias("h"))


_IOU = "greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))"


@query(f"""with b as ({_BOXES}), o as (select a.case_no, a.pos as pos_a, b.pos as pos_b, {_IOU} as i, a.w * a.h + b.w * b.h as s from b a join b on a.case_no = b.case_no and a.pos < b.pos)
    select case_no, pos_a, pos_b, round(i / (s - i), 9) as iou from o where i / (s - i) > 0.05""")
def box_overlaps(spark, sf_dir):
    return boxes.overlapping_pairs(_boxes(spark, sf_dir), 0.05).withColumn("iou", F.round("iou", 9))


@query(f"select case_no, min(x) as x0, min(y) as y0, max(x + w) as x1, max(y + h) as y1, max_by(pos, w * h * 1000 - pos) as largest from ({_BOXES}) group by case_no")
def box_extent(spark, sf_dir):
    return boxes.extent(_boxes(spark, sf_dir))


@query(f"select case_no, pos from ({_BOXES}) where w * h / 1000000.0 between 0.005 and 0.05 and w / h between 0.6 and 2.8 and x >= 30 and y >= 5")
def box_filter(spark, sf_dir):
    return boxes.plausible(_boxes(spark, sf_dir), 1e6, 0.005, 0.05, left=30, top=5).select("case_no", "pos")


_OVER = "greatest(0, least(k.x + k.w, e.b.x + e.b.w) - greatest(k.x, e.b.x)) * greatest(0, least(k.y + k.h, e.b.y + e.b.h) - greatest(k.y, e.b.y))"


@query(f"""with b as (select case_no, -w * h as a, {{'pos': pos, 'x': x::double, 'y': y::double, 'w': w::double, 'h': h::double}} as b from ({_BOXES})),
    g as (select case_no, list({{'kept': [b], 'b': b}} order by a, b.pos) as l from b group by case_no),
    f as (select case_no, list_reduce(l, lambda s, e: case when len(s.kept) >= 4 or len(list_filter(s.kept, lambda k: {_OVER} >= 0.15::double * (k.w * k.h + e.b.w * e.b.h - {_OVER}))) > 0 then s
        else {{'kept': list_append(s.kept, e.b), 'b': e.b}} end).kept as kept from g)
    select case_no, r::int as rank, kept[r].pos as pos from f, unnest(range(1, len(kept) + 1)) as u(r)""")
def box_suppression(spark, sf_dir):
    return boxes.suppress(_boxes(spark, sf_dir))


# Predictions: returned against open lines, by line number.
_GUESSES = "select l_orderkey as item, 'L' || l_linenumber::varchar as label, max((l_returnflag = 'R')::int) as truth, max((l_linestatus = 'F')::int) as guess from lineitem group by all"


def _guesses(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("item"), F.concat(F.lit("L"), F.col("l_linenumber").cast("string")).alias("label")).agg(
        F.max((F.col("l_returnflag") == "R").cast("int")).alias("truth"), F.max((F.col("l_linestatus") == "F").cast("int")).alias("guess"))


_CONFUSION = f"select label, count(*) filter (where truth = 0 and guess = 0) as tn, count(*) filter (where truth = 0 and guess = 1) as fp, count(*) filter (where truth = 1 and guess = 0) as fn, count(*) filter (where truth = 1 and guess = 1) as tp from ({_GUESSES}) group by label"


@query(_CONFUSION)
def label_confusion(spark, sf_dir):
    return metrics.confusion(_guesses(spark, sf_dir))


@query(f"select label, (tp + tn) / (tp + tn + fp + fn)::double as accuracy, case when 2 * tp + fp + fn = 0 then 1 else 2 * tp / (2 * tp + fp + fn)::double end as f1 from ({_CONFUSION})")
def label_scores(spark, sf_dir):
    return metrics.per_label(metrics.confusion(_guesses(spark, sf_dir)))


@query(f"select avg(r::int) as accuracy, count(*) as n from (select item, bool_and(truth = guess) as r from ({_GUESSES}) group by item)")
def subset_accuracy(spark, sf_dir):
    return metrics.subset_accuracy(_guesses(spark, sf_dir), "item")


@query("select o_custkey, max((o_orderstatus = 'F')::int) as F, max((o_orderstatus = 'O')::int) as O, max((o_orderstatus = 'P')::int) as P from orders group by 1")
def multi_hot(spark, sf_dir):
    return metrics.multi_hot(_table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", ["P", "O", "F"])


_LOSSES = "select o_custkey as run, o_orderkey as epoch, o_totalprice as loss from orders"


def _losses(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("epoch"), F.col("o_totalprice").alias("loss"))


@query(f"select run, min_by(epoch, loss) as best_epoch, min(loss) as least_loss from ({_LOSSES}) group by run")
def best_epoch(spark, sf_dir):
    return metrics.best_epoch(_losses(spark, sf_dir))


@query(f"""with c as (select run, list({{'epoch': epoch, 'loss': loss, 'bad': 0, 'stop': null::bigint}} order by epoch) as course from ({_LOSSES}) group by run)
    select run, list_reduce(course, lambda s, e: case when s.stop is not null then s when e.loss < s.loss then {{'epoch': e.epoch, 'loss': e.loss, 'bad': 0, 'stop': null::bigint}}
        when e.loss > s.loss then {{'epoch': e.epoch, 'loss': s.loss, 'bad': s.bad + 1, 'stop': case when s.bad + 1 >= 3 then e.epoch end}} else s end).stop as stop_epoch from c""")
def early_stop(spark, sf_dir):
    return metrics.early_stop(_losses(spark, sf_dir), patience=3, delta=0.0)


@query("select user_id, event_id, count(*) over (partition by user_id order by epoch_ms(ts) range between 3600000 preceding and current row) as recent from events")
def recent_events(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return metrics.window_count(rows, 3_600_000, "user_id", "ms").select("user_id", "event_id", "recent")


@query("select user_id, max_by(event_type, event_id) as event_type from events group by user_id")
def latest_status(spark, sf_dir):
    return batch.latest(_table(spark, sf_dir, "events"), "user_id", "event_type", "event_id")


@query("select o_custkey, min(o_orderkey) as o_orderkey from orders group by 1")
def first_reports(spark, sf_dir):
    return batch.first_wins(_table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey")


@query("select p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 49)")
def unseen_parts(spark, sf_dir):
    seen = _table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return batch.unseen(_table(spark, sf_dir, "part").select("p_partkey"), seen, "p_partkey")


@query("select doc_id, source || case when r = 0 then '' else '_' || r::varchar end as name from (select doc_id, source, row_number() over (partition by source order by doc_id) - 1 as r from documents)")
def unique_names(spark, sf_dir):
    return batch.unique_names(_table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id").select("doc_id", "name")


@query("select o_orderkey, floor(row_number() over (partition by o_custkey order by o_orderkey) / (count(*) over (partition by o_custkey))::double * 100)::int as percent from orders")
def batch_progress(spark, sf_dir):
    return batch.progress(_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey").select("o_orderkey", "percent")


@query("select o_custkey, count(*) filter (where o_orderstatus = 'F') as completed, count(*) filter (where o_orderstatus = 'P') as failed, min_by(o_orderpriority, o_orderkey) filter (where o_orderstatus = 'P') as first_message from orders group by 1")
def batch_summary(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "F", "Completed").when(F.col("o_orderstatus") == "P", "Failed").otherwise("Queued").alias("status"), F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).otherwise("").alias("message"))
    return batch.summary(rows, "o_custkey", "status", "message", "o_orderkey")


@query("select user_id, event_id, event_type from (select *, lag(event_type) over (partition by user_id order by event_id) as b from events) where event_type is distinct from b")
def status_changes(spark, sf_dir):
    return batch.changes_only(_table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_type", "event_id")


@query("select l_orderkey, l_linenumber, l_partkey, coalesce(sum(q) over (partition by l_orderkey order by l_linenumber, l_partkey rows between unbounded preceding and 1 preceding), 0) as \"offset\" from (select l_orderkey, l_linenumber, l_partkey, sum(l_quantity) as q from lineitem group by all)")
def item_offsets(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.sum("l_quantity").alias("q"))
    return batch.offsets(rows.withColumn("seq", F.struct("l_linenumber", "l_partkey")), "l_orderkey", "seq", "q").select("l_orderkey", "l_linenumber", "l_partkey", "offset")


@query(r"""select doc_id, regexp_replace(lower(source || ' ' || lang || '-%/'), '[^a-z0-9%/]+', '', 'g') as key, regexp_replace(trim('  ' || source || '  ' || lang || ' '), '\s+', '_', 'g') as case_id,
    regexp_extract('/a/b/' || source || '.pdf', '[^/\\]+$') as file, string_split(coalesce(text, ''), chr(10))[1] as line from documents""")
def text_functions(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    return d.select(
        "doc_id", text.normalize_key(F.concat_ws("", "source", F.lit(" "), "lang", F.lit("-%/"))).alias("key"), text.case_id(F.concat(F.lit("  "), "source", F.lit("  "), "lang", F.lit(" "))).alias("case_id"),
        text.base_name(F.concat(F.lit("/a/b/"), "source", F.lit(".pdf"))).alias("file"), text.first_line(F.coalesce("text", F.lit(""))).alias("line"),
    )


@query(r"""select doc_id, try_cast(nullif(regexp_extract(replace(coalesce(text, ''), ',', '.'), '[-+]?[0-9]+(\.[0-9]+)?'), '') as double) as number, nullif(regexp_extract(regexp_replace(upper(coalesce(text, '')), '[\x{C0}-\x{24F}]', 'Z', 'g'), '\b([A-F])\b', 1), '') as grade from documents""")
def cell_parsing(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", text.parse_float(F.col("text")).alias("number"), text.parse_grade(F.col("text")).alias("grade"))


# crc32 of a number's digits, bit by bit: each byte goes in with the first of eight shifts.
_CRC = """xor(list_reduce(list_concat([4294967295::bigint], flatten(list_transform(regexp_extract_all(o_orderkey::varchar, '.'), lambda x: [ord(x)::bigint, 0, 0, 0, 0, 0, 0, 0]))),
    lambda c, b: xor(xor(c, b) >> 1, 3988292384::bigint * (xor(c, b) & 1))), 4294967295::bigint)"""


@query(f"with a as (select o_orderkey, {_CRC} % 100000 / 100000.0::double as share from orders) select o_orderkey, case when share < 0.1::double then 'test' when share < 0.1::double + (1 - 0.1::double) * 0.11::double then 'val' else 'train' end as split from a")
def training_splits(spark, sf_dir):
    """By crc32 of the key."""
    return _table(spark, sf_dir, "orders").select("o_orderkey", metrics.split_of(F.col("o_orderkey")).alias("split"))


@query("""with recursive e as (select min(o_orderdate)::date as a, max(o_orderdate)::date as z from orders), d(day) as (select a from e union all select (day + interval 1 day)::date from d, e where day < z)
    select day, (isodow(day) - 1)::int as weekday, date_diff('day', a, day)::int as n, monthname(day) as month, day(last_day(day))::int as days, ((year(day) - year(a)) * 12 + month(day) - month(a) + month(a) - 1)::int as page from d, e""")
def calendar(spark, sf_dir):
    """The days that orders span."""
    return reports.calendar(_table(spark, sf_dir, "orders"), "o_orderdate").withColumn("day", F.col("day").cast("timestamp_ntz"))


@query("select key, arg_max(word, seq) as word from (select c_name as n, lower(split_part(c_mktsegment, ' ', 1)) as key, c_mktsegment as word, c_custkey as seq from customer) where regexp_full_match(key, '[a-z]*') group by key union all select key, arg_max(word, seq) from (select lower(n_name) as key, n_name as word, n_nationkey as seq from nation) where regexp_full_match(key, '[a-z]*') and starts_with(key, 'b') group by key")
def prefix_search(spark, sf_dir):
    """Market segments, and nations that begin with b; other than letters rules a word out."""
    segments = _table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("word"), F.col("c_custkey").alias("seq"))
    nations = _table(spark, sf_dir, "nation").select(F.col("n_name").alias("word"), F.col("n_nationkey").alias("seq"))
    return reports.prefix_search(segments, "").unionByName(reports.prefix_search(nations, "B"))


@query("select event_id, 'event.k' as name, (json_extract(props, '$.k'))::varchar as value from events where props is not null and json_extract(props, '$.k') is not null")
def flat_properties(spark, sf_dir):
    nested = _table(spark, sf_dir, "events").where("props is not null").select("event_id", F.concat(F.lit('{"event": '), "props", F.lit("}")).alias("doc"))
    return files.flatten_config(nested, "doc", ["event_id"]).where("name = 'event.k' and value is not null")


@query()
def matched_labels(spark, sf_dir):
    """Labels read with lost and wrong letters, one for each line item, against the metric names."""
    name = F.element_at(F.array(*[F.lit(m) for m in files.METRICS]), (F.col("l_partkey") % 13 + 1).cast("int"))
    label = F.overlay(name, F.lit("#"), (F.col("l_suppkey") % 9 + 1).cast("int"), F.lit(1))
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_no"), F.col("l_linenumber").alias("pos"), F.when(F.col("l_orderkey") % 5 == 0, name).otherwise(label).alias("label"))
    return labels.match_labels(rows, files.METRICS, {"fef2575%": "FEF25%-75%", "ratio": "FEV1/FVC"})


_HEADS = """select l_orderkey as case_no, l_linenumber::bigint as pos, min(l_partkey % 200)::double as cx, min(l_suppkey % 30)::double as cy, min(l_returnflag) as text, min(l_tax)::double as conf,
    min(l_partkey % 200)::double - min(l_quantity)::double / 4 as x0, min(l_partkey % 200)::double + min(l_quantity)::double / 4 as x1, min(l_suppkey % 30)::double - 5 as y0, min(l_suppkey % 30)::double + 5 as y1 from lineitem group by l_orderkey, l_linenumber"""


@query(f"""with a as (select *, max(x1) over (partition by case_no order by cx, pos rows between unbounded preceding and 1 preceding) as reach from ({_HEADS})),
    b as (select *, sum(case when x0 - reach > 18 then 1 else 0 end) over (partition by case_no order by cx, pos rows unbounded preceding)::bigint as part from a)
    select case_no, part, string_agg(text, ' ' order by cx, pos) as text, min(conf) as conf, list_reduce(list(cx order by cx, pos), lambda u, v: (u + v) / 2) as cx,
        list_reduce(list(cy order by cx, pos), lambda u, v: (u + v) / 2) as cy, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from b group by case_no, part""")
def merged_headers(spark, sf_dir):
    cx, cy, half = F.min(F.col("l_partkey") % 200).cast("double"), F.min(F.col("l_suppkey") % 30).cast("double"), F.min("l_quantity").cast("double") / 4
    heads = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("case_no"), F.col("l_linenumber").cast("long").alias("pos")).agg(
        cx.alias("cx"), cy.alias("cy"), F.min("l_returnflag").alias("text"), F.min("l_tax").cast("double").alias("conf"), (cx - half).alias("x0"), (cx + half).alias("x1"), (cy - 5).alias("y0"), (cy + 5).alias("y1"))
    return layout.merge_neighbours(heads, ["case_no"])


@query("""with c as (select l_orderkey as case_no, list((l_partkey % 200)::double order by l_partkey % 200) as cs from lineitem group by 1),
    n as (select case_no, cs, [{'head': null::double, 'j': 1::bigint, 'o': []::double[]}, {'head': null::double, 'j': 0::bigint, 'o': []::double[]}, {'head': case when case_no % 90 % 3 <> 0 then (case_no % 90)::double end, 'j': 0::bigint, 'o': []::double[]},
        {'head': null::double, 'j': 0::bigint, 'o': []::double[]}, {'head': case when case_no % 170 % 3 <> 0 then (case_no % 170)::double end, 'j': 0::bigint, 'o': []::double[]}] as names from c),
    r as (select case_no, list_reduce(names, lambda s, e: {'head': null::double, 'j': case when e.head is not null then greatest(s.j, len(list_filter(cs, lambda x: x <= e.head)) + 1) else s.j + 1 end,
        'o': list_append(s.o, coalesce(e.head, cs[s.j], s.o[-1] + 8))}).o as raw from n),
    q as (select case_no, list_reduce(list_transform(raw, lambda x: [x]), lambda o, x: list_append(o, case when x[1] <= o[-1] then o[-1] + 1 else x[1] end)) as o from r)
    select case_no, (i - 1)::int as idx, o[i] as x from q, unnest(range(1, len(o) + 1)) as u(i)""")
def anchored_columns(spark, sf_dir):
    """Positions of four columns of each order, two of whose headers may be known."""
    rows = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("case_no")).agg(F.collect_list((F.col("l_partkey") % 200).cast("double")).alias("centres"))
    known = F.map_filter(F.create_map(F.lit("b"), (F.col("case_no") % 90).cast("double"), F.lit("d"), (F.col("case_no") % 170).cast("double")), lambda k, v: v % 3 != 0)
    return rows.select("case_no", F.posexplode(layout.anchored_centres(F.col("centres"), known, ["a", "b", "c", "d"])).alias("idx", "x"))


_RGB = "select p_partkey, p_partkey % 256 as r, p_partkey * 7 % 256 as g, p_partkey * p_partkey % 251 as b from part"


@query(f"""with a as (select *, greatest(r, g, b) / 255.0::double as v, least(r, g, b) / 255.0::double as m from ({_RGB})),
    b as (select p_partkey, v, case when v = 0 then 0 else (v - m) / v end as s, case when v = m then 0 when greatest(r, g, b) = r then 60 * ((g - b) / 255.0::double) / (v - m)
        when greatest(r, g, b) = g then 60 * ((b - r) / 255.0::double) / (v - m) + 120 else 60 * ((r - g) / 255.0::double) / (v - m) + 240 end as h from a)
    select p_partkey, round(case when h < 0 then h + 360 else h end, 6) as h, round(s, 9) as s, round(v, 9) as v, round(least(s * 1.05::double, 1), 9) as dark_s, round(v * 0.5::double, 9) as dark_v from b""")
def colours(spark, sf_dir):
    k = F.col("p_partkey").cast("long")
    hsv = _table(spark, sf_dir, "part").select("p_partkey", colour.to_hsv(k % 256, k * 7 % 256, k * k % 251).alias("c"))
    dark = hsv.withColumn("d", colour.shade(F.col("c"), "DARK_2"))
    return dark.select("p_partkey", F.round("c.h", 6).alias("h"), *[F.round(f"c.{x}", 9).alias(x) for x in "sv"], F.round("d.s", 9).alias("dark_s"), F.round("d.v", 9).alias("dark_v"))


@query(r"""with a as (select conv_id, turn, trim(text, chr(32) || chr(9) || chr(10) || chr(13)) as t from conversations where text is not null),
    b as (select *, list_reduce(regexp_split_to_array(t, '\s+'), lambda u, v: case when length(split_part(u, chr(10), -1)) + 1 + length(v) <= 60 then u || ' ' || v else u || chr(10) || v end) as f from a)
    select conv_id, turn, case when length(t) <= 60 then t else array_to_string(flatten(list_transform(string_split(f, chr(10)), lambda x: regexp_extract_all(x, '.{1,60}'))), chr(10)) end as lines from b""")
def wrapped_turns(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").where("text is not null")
    return rows.select("conv_id", "turn", F.array_join(text.wrapped(F.col("text"), 60), "\n").alias("lines"))
