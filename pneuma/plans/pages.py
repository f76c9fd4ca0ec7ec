"""Queries of page geometry, file choice and small functions, with the same in SQL.

Tokens and pages stand-ins: line items placed on the page of their order, some as header texts, some as labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clinical, small
from ..operators import geometry

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


_HEADS = ["LLN", "Pred", "% Pred", "Z-Score", "PRE BEST", "POST BEST", "%CHG", "Notes"]
_TOKENS = f"""select l_orderkey as case_no, l_partkey * 10000 + l_suppkey * 10 + l_linenumber as pos, cast(l_partkey % 900 as double) as cx, cast(l_suppkey * 7 % 600 as double) as cy,
    l_partkey % 900 - l_quantity / 2 as x0, l_partkey % 900 + l_quantity / 2 as x1, l_suppkey * 7 % 600 - 6.0 as y0, l_suppkey * 7 % 600 + 6.0 as y1, l_tax as conf,
    case when l_suppkey * 7 % 600 <= 150 then case l_linenumber {' '.join(f"when {k} then '{v}'" for k, v in enumerate(_HEADS, 1))} end
         when l_returnflag = 'R' then concat('FVC', cast(l_linenumber as string)) when l_returnflag = 'A' then 'label' else '-' end as text from {{lineitem}}"""
_PAGES = "select o_orderkey as case_no, 1000.0 as w, 600.0 + cast(floor(o_totalprice) as int) % 300 as h from {orders}"
_SQL_TOKENS, _SQL_PAGES = _TOKENS.replace("{lineitem}", "lineitem"), _PAGES.replace("{orders}", "orders")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    double = ["cx", "cy", "x0", "x1", "y0", "y1", "conf"]
    return spark.sql(_TOKENS, lineitem=_table(spark, sf_dir, "lineitem")).withColumns({c: F.col(c).cast("double") for c in double})


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_PAGES, orders=_table(spark, sf_dir, "orders")).withColumns({c: F.col(c).cast("double") for c in "wh"})


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens, pages = _tokens(spark, sf_dir), geometry.body_top(_tokens(spark, sf_dir), _pages(spark, sf_dir))
    return geometry.split_x(geometry.data_left(tokens, pages), geometry.headings(tokens))


# Written from the rules: the lowest header near the top, percentiles by place, the two bounds of the split.
_KEY = "regexp_replace(lower(text), '[^a-z0-9%/]+', '', 'g')"
_ALIAS = f"case {' '.join(f'''when {_KEY} = '{k}' then '{v}' ''' for k, v in geometry.HEADER_ALIASES.items())} end"
_EDGES = f"""
    with t as ({_SQL_TOKENS}), p as (select case_no, w::double as w, h::double as h from ({_SQL_PAGES})), tp as (select t.*, w, h from t join p using (case_no)),
    top as (select p.*, case when y is null then 0.16::double * h else greatest(0.08::double * h, least(0.35::double * h, y + 8)) end as body_y0
        from p left join (select case_no, max(y1)::double as y from tp where cy <= 0.3::double * h and {_ALIAS} is not null group by 1) using (case_no)),
    body as (select tp.*, body_y0 from tp join top using (case_no) where cy > body_y0),
    e as (select case_no, list_sort(list(x0::double) filter (where regexp_matches(text, '[0-9]'))) as xs, list_sort(list(x1::double) filter (where cx <= 0.45::double * w and regexp_matches(text, '[A-Za-z]'))) as ls from body group by 1),
    d as (select top.*, case when len(xs) > 0 then greatest(0.12::double * w, least(0.45::double * w, xs[round_even(0.05::double * (len(xs) - 1), 0)::int + 1] - 8))
        when len(ls) > 0 then greatest(0.1::double * w, least(0.45::double * w, ls[floor(0.9::double * (len(ls) - 1))::int + 1] + 10)) else 0.22::double * w end as data_x0 from top left join e using (case_no)),
    a as (select case_no, {_KEY} as k, {_ALIAS} as col, cx, conf from t),
    b as (select *, max(case when col = 'POST-BEST' then cx end) over (partition by case_no) as px from a where col is not null),
    c as (select case_no, cx, conf, case when cx > px + 30 and k in ('%pred', 'pred%', 'prepred', 'pre%pred') then 'Post_%Pred' when cx > px + 30 and k in ('zscore', 'prezscore', 'prez') then 'Post_Z-Score' else col end as col from b),
    heads as (select case_no, col, arg_min(cx, (-conf, cx)) as cx from c group by 1, 2)"""


@query(_EDGES + """ select case_no, body_y0, data_x0, greatest(data_x0 + 30, least(0.92::double * w, case when cx is null then data_x0 + (w - data_x0) * 0.58::double else greatest(data_x0 + 20, cx - 25) end)) as split_x
    from d left join (select case_no, cx from heads where col = 'POST-BEST') using (case_no)""")
def page_edges(spark, sf_dir):
    return _edges(spark, sf_dir).select("case_no", "body_y0", "data_x0", "split_x")


@query(_EDGES + " select * from heads")
def column_headings(spark, sf_dir):
    return geometry.headings(_tokens(spark, sf_dir))


_ANCHORS = "select l_orderkey as case_no, l_linenumber * 2 - 2 as idx, 150.0 + 25 * l_linenumber + l_quantity / 10 as y from {lineitem} where l_returnflag <> 'N'"
_CENTRES = f"""
    known as (select case_no, idx, avg(y::double) as y from ({_ANCHORS.replace('{lineitem}', 'lineitem')}) group by 1, 2),
    s as (select *, (y - lag(y) over q) / greatest(1, idx - lag(idx) over q) as step from known window q as (partition by case_no order by idx)),
    f as (select case_no, count(*) as n, regr_slope(y, idx) as a, regr_intercept(y, idx) as b, list_sort(list(step) filter (where step is not null)) as ds, min(idx) as i0, arg_min(y, idx) as y0 from s group by 1),
    r as (select top.case_no, h, body_y0, n, a, b, ds[len(ds) // 2 + 1] as d, i0, y0, unnest(range(0, 13)) as idx from top left join f using (case_no))
    select case_no, idx::int as idx, round(case when n >= 6 then least(h - 5, greatest(body_y0 + 5, a * idx + b)) when n >= 2 then least(h - 5, greatest(body_y0 + 5, d * idx + y0 - d * i0))
        else body_y0 + 0.06::double * (h - body_y0) + (0.98::double * h - body_y0 - 0.06::double * (h - body_y0)) * (idx + 0.5::double) / 13 end, 6) as centre from r"""


@query(_EDGES + ", " + _CENTRES)
def row_centres(spark, sf_dir):
    anchors = spark.sql(_ANCHORS, lineitem=_table(spark, sf_dir, "lineitem")).withColumn("y", F.col("y").cast("double"))
    pages = geometry.body_top(_tokens(spark, sf_dir), _pages(spark, sf_dir))
    return geometry.row_centres(pages, anchors).select("case_no", "idx", F.round("centre", 6).alias("centre"))


_ROWS = "select l_orderkey as case_no, l_linenumber as idx, min(l_quantity) * 10.0 as lo, min(l_quantity) * 10.0 + max(l_tax) * 400 as hi from {lineitem} group by l_orderkey, l_linenumber"
_COLS = "select o_orderkey as case_no, c.col as col, o_custkey % 700 + c.k * 50.0 as lo, o_custkey % 700 + c.k * 50.0 + 10 + c.k * 9 as hi from {orders} cross join (values ('LLN', 0), ('Pre_Z-Score', 1), ('%CHG', 2), ('Post_%Pred', 3)) as c(col, k)"


@query(f"""with m as (select r.case_no, r.idx, c.col, c.lo::double as x0, c.hi::double as x1, r.lo::double as y0, r.hi::double as y1, p.h::double as h from ({_ROWS.replace('{lineitem}', 'lineitem')}) r join ({_COLS.replace('{orders}', 'orders')}) c using (case_no) join ({_SQL_PAGES}) p using (case_no)),
    n as (select *, greatest(1, x1 - x0) as wide, greatest(1, y1 - y0) as high from m)
    select case_no, idx, col, trunc(greatest(0, x0 - greatest(2, 0.08::double * wide, case when col like '%Z-Score' then 0.14::double * wide when col in ('Pre_%Pred', 'Post_%Pred', '%CHG') then 0.1::double * wide else 0 end)))::int as x0,
        trunc(greatest(0, y0 - greatest(2, 0.15::double * high)))::int as y0, trunc(least(999, x1 + greatest(2, 0.08::double * wide)))::int as x1, trunc(least(h - 1, y1 + greatest(2, 0.15::double * high)))::int as y1 from n""")
def padded_cells(spark, sf_dir):
    rows = spark.sql(_ROWS, lineitem=_table(spark, sf_dir, "lineitem")).withColumns({c: F.col(c).cast("double") for c in ("lo", "hi")})
    columns = spark.sql(_COLS, orders=_table(spark, sf_dir, "orders")).withColumns({c: F.col(c).cast("double") for c in ("lo", "hi")})
    return geometry.cell_boxes(rows, columns, _pages(spark, sf_dir))


_BASE = "select p_partkey, p_brand as file, cast(p_size as double) / 100 as rel_left, 0.3 as rel_top, cast(p_size + 40 as double) / 100 as rel_right, 0.3 + p_retailprice / 10000 as rel_bottom, 0.02 as extra_bottom_frac from {part}"
_OWN = "select distinct p_brand as file, case when p_brand like '%1' then 0.9 end as rel_left, case when p_brand like '%2' then 0.1 end as dx, case when p_brand like '%3' then -0.9 end as grow, case when p_brand like '%4' then 0.5 end as extra_bottom_frac, 0.01 as dy from {part} where p_brand not like '%5'"


@query(f"""with m as (select b.*, o.rel_left as ol, coalesce(o.dx, 0) + 0.05::double as sx, coalesce(o.dy, 0) as sy, 1 + coalesce(o.grow, 0) as s, o.extra_bottom_frac as oe from ({_BASE.replace('{part}', 'part')}) b left join ({_OWN.replace('{part}', 'part')}) o using (file)),
    n as (select p_partkey, coalesce(ol, rel_left)::double + sx as l, 0.25::double + sy as t, rel_right::double + sx as r, rel_bottom::double + sy as b, s::double as s, coalesce(oe, extra_bottom_frac)::double as e from m),
    k as (select p_partkey, e, greatest(0, least(1, (l + r) / 2 - (r - l) / 2 * s)) as l, greatest(0, least(1, (l + r) / 2 + (r - l) / 2 * s)) as r, greatest(0, least(1, (t + b) / 2 - (b - t) / 2 * s)) as t, greatest(0, least(1, (t + b) / 2 + (b - t) / 2 * s)) as b from n),
    f as (select p_partkey, l, t, case when r <= l then least(1, l + 0.01::double) else r end as r, case when b <= t then least(1, t + 0.01::double) else b end as b, greatest(0, least(0.2::double, e)) as e from k),
    q as (select *, greatest(0, trunc(800 * l)::int) as x0, greatest(0, trunc(600 * t)::int) as y0, least(800, trunc(800 * r)::int) as x1, least(600, trunc(600 * least(1, b + e))::int) as y1 from f)
    select p_partkey, round(l, 9) as l, round(t, 9) as t, round(r, 9) as r, round(b, 9) as b, round(e, 9) as e, case when x1 > x0 and y1 > y0 then x0 || ',' || y0 || ',' || (x1 - x0) || ',' || (y1 - y0) end as band from q""")
def page_bands(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    base = spark.sql(_BASE, part=part)
    base = base.withColumns({c: F.col(c).cast("double") for c in (*geometry.RECT, "extra_bottom_frac")})
    general = spark.createDataFrame([(0.25, 0.05)], "rel_top double, dx double")
    bands = geometry.crop_band(geometry.override_rect(base, general, spark.sql(_OWN, part=part), extra=True).withColumns({"w": F.lit(800), "h": F.lit(600)}))
    names = {"l": "rel_left", "t": "rel_top", "r": "rel_right", "b": "rel_bottom", "e": "extra_bottom_frac"}
    return bands.select("p_partkey", *[F.round(v, 9).alias(k) for k, v in names.items()], F.concat_ws(",", "band.x", "band.y", "band.width", "band.height").alias("band")).withColumn("band", F.nullif("band", F.lit("")))


@query(r"""with f as (select p_partkey, 'Part ' || p_size || case when p_partkey > 50 then '.pdf' else '.PDF' end as name from part)
    select p_partkey, name, name in ('Part 7.pdf', 'Part_8', 'part 9') or regexp_replace(name, '\.[^.]*$', '') in ('Part 7.pdf', 'Part_8', 'part 9') or replace(regexp_replace(name, '\.[^.]*$', ''), ' ', '_') in ('Part_7', 'Part_8', 'part_9') as by_table,
        lower(name) in ('part 7.pdf', 'part_8', 'part 9') or lower(regexp_replace(name, '\.[^.]*$', '')) in ('part 7.pdf', 'part_8', 'part 9') as by_class from f""")
def wanted_files(spark, sf_dir):
    """Which files two ways of asking choose: they differ in case and in what becomes of spaces."""
    files = _table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("Part "), "p_size", F.when(F.col("p_partkey") > 50, ".pdf").otherwise(".PDF")).alias("name"))
    asked = ["Part 7.pdf", " Part_8", "part 9", ""]
    one, two = geometry.wanted_tables(files, asked).select("p_partkey", F.lit(True).alias("one")), geometry.wanted_classes(files, asked).select("p_partkey", F.lit(True).alias("two"))
    met = files.join(one, "p_partkey", "left").join(two, "p_partkey", "left")
    return met.select("p_partkey", "name", F.coalesce("one", F.lit(False)).alias("by_table"), F.coalesce("two", F.lit(False)).alias("by_class"))


@query("select c_custkey, c_name from customer order by c_name limit 25")
def first_files(spark, sf_dir):
    """The feature is the limit: the first 25 by name."""
    return geometry.first_files(_table(spark, sf_dir, "customer").select("c_custkey", "c_name"), 25, "c_name")


@query("""select event_id, case when hour(ts) % 12 = 0 then 12 else hour(ts) % 12 end::int as hour12, case when hour(ts) < 12 then 'AM' else 'PM' end as half, lpad(minute(ts)::varchar, 2, '0') as minute,
    strftime(ts, '%Y%m%d_%H%M%S') as run, hour(ts)::int as hour24, floor((year(ts) - 1900) / 12)::int as year_page, minute(ts) || '分' as suffixed, minute(ts)::varchar as plain from events""")
def clock_parts(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    shown = small.with_suffix(F.minute(ts).cast("string"), "分")
    return _table(spark, sf_dir, "events").select(
        "event_id", small.hour12(F.hour(ts)).alias("hour12"), small.half_of_day(F.hour(ts)).alias("half"), small.two_digits(F.minute(ts)).alias("minute"), small.run_id(ts).alias("run"),
        small.hour24(small.hour12(F.hour(ts)), small.half_of_day(F.hour(ts))).alias("hour24"), small.year_page(F.year(ts), 1900).alias("year_page"), shown.alias("suffixed"), small.without_suffix(shown).alias("plain"))


@query("""select p_partkey, least(40, greatest(10, p_size)) as clamped, case when p_brand in ('Brand#12', 'Brand#23') then p_brand else 'Brand#12' end as chosen,
    trunc((p_size - 5) / 45.0::double * 300)::int as place, 'p' || (p_size * 2) || '% of ' || p_size || '/50' as told, case when p_size % 2 = 0 then p_size end as even,
    p_brand || ';' || p_type as joined from part""")
def widget_values(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    size = F.col("p_size")
    return part.select(
        "p_partkey", clinical.clamp(size, 10, 40).alias("clamped"), small.one_of(F.col("p_brand"), ["Brand#12", "Brand#23"]).alias("chosen"),
        small.slider_place(size, 5, 50, 300).alias("place"), small.progress_text("p%p% of %v/%m", size, 0, 50).alias("told"),
        F.when(small.same_bag(F.array(size % 2, F.lit(0)), F.array(F.lit(0), F.lit(0))), size).alias("even"), small.distinct_joined(F.array("p_brand", "p_type", "p_brand"), ";").alias("joined"))


@query("""select o_orderkey, (decade::int) as decade from (select o_orderkey, arg_min(d, (-n, d)) as decade from (select o_orderkey, (y + k) // 10 * 10 as d, count(*) as n from (select o_orderkey, year(o_orderdate) as y, unnest(range(0, 16)) as k from orders) group by 1, 2) group by 1)""")
def shown_decades(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_orderkey", small.decade_of(F.year("o_orderdate")).alias("decade"))
