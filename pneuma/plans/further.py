"""Queries of splits, histories, zones of a page, widths, parallel arrays and settings, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import history, layout, metrics, reports
from ..sources import settings

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SPLIT = """with o as (select o_orderkey, row_number() over (order by sha256('42:' || o_orderkey::varchar), o_orderkey) - 1 as n, count(*) over () as m from orders),
    t as (select *, ceil(0.1::double * m) as tests from o)
    select o_orderkey, case when n < tests then 'test' when n < tests + ceil(0.11::double * (m - tests)) then 'val' else 'train' end as split from t"""


@query(_SPLIT)
def exact_splits(spark, sf_dir):
    return metrics.exact_split(_table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


@query(f"select * from ({_SPLIT}) where split = 'val'")
def validation_rows(spark, sf_dir):
    return metrics.of_mode(exact_splits(spark, sf_dir), "val")


@query("""with e as (select user_id, event_id, event_type, coalesce(value > 60, false) as gone from events),
    base as (select user_id, -1 as event_id, 'view' as event_type from (select distinct user_id from e)),
    alive as (select user_id, event_id, event_type from e where not gone and not exists (select 1 from e x where x.gone and x.user_id = e.user_id and x.event_type = e.event_type and x.event_id > e.event_id) union all select * from base),
    marked as (select *, lag(event_type) over (partition by user_id order by event_id) as b from alive)
    select user_id, row_number() over (partition by user_id order by event_id) - 1 as place, event_type from marked where event_type is distinct from b""")
def route_history(spark, sf_dir):
    """Pages a user went through, of which events of a large value take one out."""
    events = _table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", (F.col("value") > 60).alias("gone"))
    start = events.select("user_id").distinct().withColumn("event_type", F.lit("view"))
    return history.history(events, "user_id", "event_id", "event_type", "gone", start)


# Pages of orders: five columns before and four after the split, thirteen rows of 70; edges are shared by neighbours.
_PAGES = "select o_orderkey as case_no, 90.0::double + o_custkey % 5 * 10 as body_y0, 100.0::double + o_orderkey % 4 * 20 as data_x0, 500.0::double + o_custkey % 7 * 30 as split_x, 1000.0::double as w from orders"
_PLACED = "select l_orderkey as case_no, l_linenumber as pos, min(l_partkey % 100 * 10)::double as cx, min(l_quantity * 20)::double as cy, min(case when l_returnflag = 'R' then 'x' else l_linestatus || l_linenumber::varchar end) as text from lineitem group by l_orderkey, l_linenumber"


def _pages(spark, sf_dir):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return _table(spark, sf_dir, "orders").select(key.alias("case_no"), (90.0 + cust % 5 * 10).alias("body_y0"), (100.0 + key % 4 * 20).alias("data_x0"), (500.0 + cust % 7 * 30).alias("split_x"), F.lit(1000.0).alias("w"))


def _placed(spark, sf_dir):
    word = F.when(F.col("l_returnflag") == "R", "x").otherwise(F.concat("l_linestatus", F.col("l_linenumber").cast("string")))
    return _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("case_no"), F.col("l_linenumber").alias("pos")).agg(
        F.min(F.col("l_partkey") % 100 * 10).cast("double").alias("cx"), F.min(F.col("l_quantity") * 20).cast("double").alias("cy"), F.min(word).alias("text"))


@query(f"""with p as ({_PAGES}), t as (select t.*, body_y0, data_x0, split_x, case when cx < split_x then 'pre' else 'post' end as zone from ({_PLACED}) t join p using (case_no) where cy > body_y0),
    r as (select case_no, i as idx, 100.0::double + i * 70 as lo, 170.0::double + i * 70 as hi from p, (select unnest(range(13)) as i)),
    c as (select case_no, 'pre' as zone, i as idx, data_x0 + (split_x - data_x0) * i / 5 as lo, data_x0 + (split_x - data_x0) * (i + 1) / 5 as hi from p, (select unnest(range(5)) as i)
        union all select case_no, 'post', i, split_x + (998 - split_x) * i / 4, split_x + (998 - split_x) * (i + 1) / 4 from p, (select unnest(range(4)) as i) where exists (select 1 from t where t.case_no = p.case_no and zone = 'post' and regexp_matches(text, '[0-9]')))
    select t.case_no, t.pos, min(r.idx)::int as row_idx, t.zone, min(c.idx)::int as col_idx, t.text from t join r on r.case_no = t.case_no and t.cy between r.lo and r.hi
        join c on c.case_no = t.case_no and c.zone = t.zone and t.cx between c.lo and c.hi where t.cx >= t.data_x0 group by all""")
def cells_of_tokens(spark, sf_dir):
    """Tokens to their row, zone and column; the columns after the split only where a number stands there."""
    pages = _pages(spark, sf_dir)
    rows = pages.select("case_no", F.explode(F.sequence(F.lit(0), F.lit(12))).alias("idx")).select("case_no", "idx", (100.0 + F.col("idx") * 70).alias("lo"), (170.0 + F.col("idx") * 70).alias("hi"))
    x0, x1, i = F.col("x0"), F.col("x1"), F.col("idx")
    zones = pages.select("case_no", F.explode(F.array(F.struct(F.lit("pre").alias("zone"), F.col("data_x0").alias("x0"), F.col("split_x").alias("x1"), F.lit(5).alias("k")), F.struct(F.lit("post").alias("zone"), F.col("split_x").alias("x0"), F.lit(998.0).alias("x1"), F.lit(4).alias("k")))).alias("z")).select("case_no", "z.*")
    columns = zones.withColumn("idx", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select("case_no", "zone", "idx", (x0 + (x1 - x0) * i / F.col("k")).alias("lo"), (x0 + (x1 - x0) * (i + 1) / F.col("k")).alias("hi"))
    return layout.zone_cells(_placed(spark, sf_dir), pages, rows, columns)


@query(f"""with p as ({_PAGES}), t as (select t.case_no from ({_PLACED}) t join p using (case_no) where cy > body_y0 and cx >= split_x and regexp_matches(text, '[0-9]'))
    select o_orderkey as case_no, 'POST section appears missing; POST columns left blank.' as warning from orders where o_orderpriority like '1%' and o_orderkey not in (select case_no from t)""")
def post_warnings(spark, sf_dir):
    heads = _table(spark, sf_dir, "orders").where(F.col("o_orderpriority").startswith("1")).select(F.col("o_orderkey").alias("case_no"), F.lit("POST-BEST").alias("col"))
    return layout.post_warning(_placed(spark, sf_dir), _pages(spark, sf_dir), heads)


@query(f"""select case_no, pos, cy <= body_y0 as header, cy > body_y0 as body, cy > body_y0 and cx <= 0.28::double * w as label, regexp_matches(text, '[0-9]') as number, case when cx < split_x then 'pre' else 'post' end as zone
    from ({_PLACED}) join ({_PAGES}) using (case_no)""")
def token_parts(spark, sf_dir):
    return layout.token_parts(_placed(spark, sf_dir), _pages(spark, sf_dir)).select("case_no", "pos", "header", "body", "label", "number", "zone")


# Letters that give way to wide, half-wide, emoji and combining characters (U+0301).
_FROM, _TO = "aeiouTnx", "あ中가ｅ😀ｱ́ÿ"


@query(f"""with t as (select conv_id, turn, translate(coalesce(text, ''), '{_FROM}', '{_TO}') as t from conversations),
    c as (select conv_id, turn, unnest(string_split(t, '')) as ch from t),
    r as (select * from (values {', '.join(f'({a}, {b})' for a, b in text.wide_ranges())}) as r(lo, hi)),
    w as (select ch, 1 + count(lo) as w from (select distinct ch from c where ch <> '') left join r on ord(ch) between lo and hi group by ch),
    s as (select conv_id, turn, sum(w)::int as width from c join w using (ch) group by conv_id, turn)
    select t.conv_id, t.turn, coalesce(width, 0) as width from t left join s using (conv_id, turn)""")
def display_widths(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", text.display_width(F.translate("text", _FROM, _TO)).alias("width"))


@query("""with a as (select l_orderkey as case_no, list(l_quantity order by l_linenumber, l_quantity, l_partkey) as quantities, list(l_tax order by l_linenumber, l_tax) filter (where l_returnflag = 'R') as taxes from lineitem group by l_orderkey)
    select case_no, (i - 1)::int as place, quantities[i] as quantity, taxes[i] as tax from a, unnest(range(1, greatest(len(quantities), coalesce(len(taxes), 0)) + 1)) as u(i)""")
def aligned_arrays(spark, sf_dir):
    """Quantities of an order's lines beside the taxes of its returned lines, which are fewer."""
    ordered = lambda *cols: F.array_sort(F.collect_list(F.struct(*cols)))
    returned = F.array_sort(F.collect_list(F.when(F.col("l_returnflag") == "R", F.struct("l_linenumber", "l_tax"))))
    rows = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("case_no")).agg(
        F.transform(ordered("l_linenumber", "l_quantity", "l_partkey"), lambda r: r["l_quantity"]).alias("quantity"), F.transform(returned, lambda r: r["l_tax"]).alias("tax"))
    return reports.aligned(rows, ["quantity", "tax"], ["case_no"])


@query("select user_id, list_filter(list(event_type order by event_id), lambda x: x <> 'error') as kinds from events group by user_id")
def kinds_without_errors(spark, sf_dir):
    listed = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda e: e["event_type"])
    rows = _table(spark, sf_dir, "events").groupBy("user_id").agg(listed.alias("kinds"))
    return rows.select("user_id", reports.without(F.col("kinds"), F.lit("error")).alias("kinds"))


# Settings that the documents may hold: {"Limits": {"<event type>": k}, "User": id, "Mode": event type}.
_ITEMS = [
    settings.Item("Limits.view", "range", "50", 20, 80), settings.Item("Limits.click", "options", "1", options=("1", "5", "7")), settings.Item("Limits.purchase", "text", "none"),
    settings.Item("User", "range", "0", 10, 40), settings.Item("Mode", "options", "view", options=("view", "click")),
]
_GIVEN = "select event_id, 'Limits.' || event_type as key, json_extract_string(props, '$.k') as value from events where props is not null union all select event_id, 'User', user_id::varchar from events where props is not null union all select event_id, 'Mode', event_type from events where props is not null"
_KEYS = ", ".join(f"'{i.key}'" for i in _ITEMS)


def _documents(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    doc = F.concat(F.lit('{"Limits": {"'), "event_type", F.lit('": '), k, F.lit('}, "User": '), F.col("user_id").cast("string"), F.lit(', "Mode": "'), "event_type", F.lit('"}'))
    return _table(spark, sf_dir, "events").where("props is not null").select("event_id", doc.alias("doc"))


@query(f"select * from ({_GIVEN}) where key in ({_KEYS}) and value is not null")
def known_settings(spark, sf_dir):
    """Settings of documents that have an item; others are dropped."""
    items = spark.createDataFrame([(i.key,) for i in _ITEMS], "key string")
    return settings.known(settings.given(_documents(spark, sf_dir), "doc", ["event_id"]), items).select("event_id", "key", "value")


@query(f"""with g as ({_GIVEN}), i as (select * from (values ('Limits.view', '50'), ('Limits.click', '1'), ('Limits.purchase', 'none'), ('User', '0'), ('Mode', 'view')) as i(key, d)),
    m as (select e.event_id, i.key, d, value from (select event_id from events where props is not null) e cross join i left join g on g.event_id = e.event_id and g.key = i.key)
    select event_id, key, case when value is null then d when key = 'Limits.view' then case when value::double between 20 and 80 then value when value::double < 20 then '20' else '80' end
        when key = 'User' then case when value::double between 10 and 40 then value when value::double < 10 then '10' else '40' end
        when key = 'Limits.click' then case when value in ('1', '5', '7') then value else '1' end when key = 'Mode' then case when value in ('view', 'click') then value else 'view' end else value end as value from m""")
def loaded_settings(spark, sf_dir):
    return settings.loaded(_documents(spark, sf_dir), "doc", ["event_id"], _ITEMS).select("event_id", "key", "value")


@query("""with l as ({loaded}) select event_id, '{"Limits": {"click": "' || max(value) filter (where key = 'Limits.click') || '", "purchase": "' || max(value) filter (where key = 'Limits.purchase') || '", "view": ' || max(value) filter (where key = 'Limits.view')
    || '}, "Mode": "' || max(value) filter (where key = 'Mode') || '", "User": ' || max(value) filter (where key = 'User') || '}' as doc from l group by event_id""".replace("{loaded}", ORACLES["loaded_settings"]))
def saved_settings(spark, sf_dir):
    return settings.saved(settings.loaded(_documents(spark, sf_dir), "doc", ["event_id"], _ITEMS), ["event_id"])


@query("select p_partkey, p_name from part where p_partkey in (select l_partkey from lineitem where l_quantity > 49)")
def shown_cards(spark, sf_dir):
    hits = _table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return settings.shown_cards(_table(spark, sf_dir, "part").select("p_partkey", "p_name"), hits, "p_partkey")
