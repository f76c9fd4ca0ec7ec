"""Queries of report assembly, reports as text, evaluation and choice of paths, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import small
from ..operators import boxes as box_ops
from ..operators import metrics, reports
from . import grid

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


_ROWS = f"""select case_no, string_agg(metric || ' ' || pre_z || ' ' || post_z || ' ' || pct_chg, ';' order by pos) as told from ({grid._SQL_GRID}) where metric in ('FVC', 'FEV1', 'FEV1/FVC') group by case_no"""


@query(_ROWS)
def key_rows(spark, sf_dir):
    rows = reports.key_rows(grid.grid(spark, sf_dir), order="pos")
    return rows.select("case_no", F.array_join(F.transform("table_rows", lambda r: F.concat_ws(" ", r["metric"], r["pre_z"], r["post_z"], r["pct"])), ";").alias("told"))


# Outputs of a model: a hundredth of the price, and of the customer's number, about zero; no row for some orders.
_OUTPUTS = "select o_orderkey as case_no, (o_totalprice - 150000.0) / 100000 as a, (o_custkey - 500.0) / 400 as b from {orders} where o_orderpriority not like '5%'"


def _yes(flag: str, share: str) -> str:
    return f"case when coalesce({flag}, false) then 'Yes' else 'No' end || ' (confidence ' || printf('%.2f', coalesce({share}, 0.0)) || ')'"


_TEXT = f"""
    with c as ({grid._CLASSIFIED}), k as (select case_no, string_agg(metric || ': Pre Z ' || coalesce(nullif(pre_z, ''), 'N/A') || ', Post Z ' || coalesce(nullif(post_z, ''), 'N/A') || ', %CHG ' || coalesce(nullif(pct_chg, ''), 'N/A'), chr(10) order by pos) as rows
        from ({grid._SQL_GRID}) where metric in ('FVC', 'FEV1', 'FEV1/FVC') group by case_no),
    p as (select case_no, 1 / (1 + exp(-a::double)) > 0.5 as e, 1 / (1 + exp(-b::double)) > 0.5 as i, 1 / (1 + exp(-a::double)) as ep, 1 / (1 + exp(-b::double)) as ip from ({_OUTPUTS.replace('{orders}', 'orders')}))
    select o.o_orderkey as case_no, 'Source PDF: case ' || o_orderkey || '.pdf' || chr(10) || 'Generated: ' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || chr(10) || chr(10) || 'GRAPH PREDICTION' || chr(10) || 'Overall result: ' ||
        case when e and i then 'Expiratory + Inspiratory truncation' when e then 'Expiratory truncation' when i then 'Inspiratory truncation' else 'Normal' end || chr(10) ||
        'Expiratory truncation: ' || {_yes('e', 'ep')} || chr(10) || 'Inspiratory truncation: ' || {_yes('i', 'ip')} || chr(10) || chr(10) || 'TABLE CLASSIFICATION' || chr(10) ||
        case when c.case_no is null then 'Table classification not available.' else 'Pre pattern: ' || pre_pattern || ' (' || pre_severity || ')' || chr(10) || 'Post pattern: ' || post_pattern || ' (' || post_severity || ')' || chr(10) ||
            'Report: ' || report_combined || chr(10) || 'Bronchodilator response: ' || bronchodilator_response end ||
        case when o_orderstatus = 'F' then chr(10) || 'Table extraction warning: late' else '' end || case when rows is not null then chr(10) || chr(10) || 'KEY TABLE Z-SCORES' || chr(10) || rows else '' end as text,
        case when o_orderstatus = 'P' then 'Prediction failed.' when p.case_no is null then 'Prediction results will appear after generation.'
            else 'Expiratory truncation: ' || case when e then 'Yes' else 'No' end || ' (' || printf('%.2f', ep) || ') | Inspiratory truncation: ' || case when i then 'Yes' else 'No' end || ' (' || printf('%.2f', ip) || ')' end as line
    from orders o left join c on c.case_no = o_orderkey left join k on k.case_no = o_orderkey left join p on p.case_no = o_orderkey"""


@query(_TEXT)
def report_texts(spark, sf_dir):
    """The text of every order's report, and its line in a list: cases without rows or predictions included."""
    orders = _table(spark, sf_dir, "orders")
    outputs = spark.sql(_OUTPUTS, orders=orders).select("case_no", F.array(F.col("a").cast("double"), F.col("b").cast("double")).alias("logits"))
    predicted = reports.predictions(outputs, "case_no")
    classes = grid.QUERIES["classify_cases"](spark, sf_dir)
    cases = orders.select(F.col("o_orderkey").alias("case_no"), F.concat(F.lit("in/case "), "o_orderkey", F.lit(".pdf")).alias("source_path"), F.when(F.col("o_orderstatus") == "F", "late\nmore").otherwise("").alias("table_error"), "o_orderdate", F.when(F.col("o_orderstatus") == "P", "Failed").otherwise("Completed").alias("status"))
    whole = reports.assemble(cases, classes, reports.key_rows(grid.grid(spark, sf_dir), order="pos"), predicted)
    return whole.select("case_no", reports.report_text(whole, F.col("o_orderdate")).alias("text"), reports.prediction_line(F.col("status"), F.col("exp_label"), F.col("insp_label"), F.col("exp_conf"), F.col("insp_conf")).alias("line"))


_COUNTS = """select 'L' || l_linenumber::varchar as label, count(*) filter (where t and g) as tp, count(*) filter (where not t and g) as fp, count(*) filter (where t and not g) as fn
    from (select l_orderkey, l_linenumber, bool_or(l_returnflag = 'R') as t, bool_or(l_linestatus = 'F') as g from lineitem group by 1, 2) group by 1"""
_EACH = f"select label, case when tp + fp = 0 then 1 else tp / (tp + fp) end as p, case when tp + fn = 0 then 1 else tp / (tp + fn) end as r, case when 2 * tp + fp + fn = 0 then 1 else 2 * tp / (2 * tp + fp + fn) end as f, tp + fn as n from ({_COUNTS})"


@query(f"with e as ({_EACH}) select label, round(p, 9) as precision, round(r, 9) as recall, round(f, 9) as f1, n::bigint as support from e union all select 'macro avg', round(avg(p), 9), round(avg(r), 9), round(avg(f), 9), sum(n)::bigint from e")
def label_report(spark, sf_dir):
    guesses = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.concat(F.lit("L"), F.col("l_linenumber").cast("string")).alias("label")).agg(
        F.max((F.col("l_returnflag") == "R").cast("int")).alias("truth"), F.max((F.col("l_linestatus") == "F").cast("int")).alias("guess"))
    told = metrics.label_report(metrics.confusion(guesses))
    return told.select("label", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("select l_suppkey as run, l_linenumber as epoch, round(avg(l_tax), 9) as loss, count(*) as batches from lineitem group by 1, 2")
def mean_losses(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("run"), F.col("l_linenumber").alias("epoch"), F.col("l_tax").alias("loss"))
    return metrics.mean_losses(rows, ["run", "epoch"]).withColumn("loss", F.round("loss", 9))


_PATHS = r"select o_orderkey, case o_orderstatus when 'F' then 'C:/app/build/predicted_reports/' when 'P' then 'D:\asp_python_app\Extracted\' else '/in/' end || 'r' || o_orderkey || case when o_custkey % 2 = 0 then '_predicted_1.pdf' else '.pdf' end as path from orders"


@query(rf"select o_orderkey, not (contains(p, '\build\predicted_reports\') or contains(p, '\asp_python_app\extracted\')) as by_folder, not (contains(p, '\build\predicted_reports\') or contains(p, '\asp_python_app\extracted\') or regexp_matches(p, '_predicted(_\d+)?\.pdf$')) as by_name from (select o_orderkey, lower(replace(path, '/', '\')) as p from ({_PATHS}))")
def source_paths(spark, sf_dir):
    folder = F.when(F.col("o_orderstatus") == "F", "C:/app/build/predicted_reports/").when(F.col("o_orderstatus") == "P", "D:\\asp_python_app\\Extracted\\").otherwise("/in/")
    path = F.concat(folder, F.lit("r"), "o_orderkey", F.when(F.col("o_custkey") % 2 == 0, "_predicted_1.pdf").otherwise(".pdf"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", reports.is_source(path).alias("by_folder"), reports.is_source(path, matched=True).alias("by_name"))


_BOXES = "select l_orderkey as case_no, l_linenumber as pos, min(l_partkey % 1000) as x, min(20 + l_quantity * 5) as w, min(20 + l_linenumber * 30) as h from lineitem group by l_orderkey, l_linenumber"


@query(f"with b as (select *, row_number() over (partition by case_no order by w * h desc, pos) as r from ({_BOXES})) select case_no, pos, case when row_number() over (partition by case_no order by x, pos) = 1 then 'left' else 'right' end as side from b where r <= 2")
def box_sides(spark, sf_dir):
    boxes = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("case_no"), F.col("l_linenumber").alias("pos")).agg(
        F.min(F.col("l_partkey") % 1000).alias("x"), F.min(20 + F.col("l_quantity") * 5).alias("w"), F.min(20 + F.col("l_linenumber") * 30).alias("h"))
    return reports.spread_sides(boxes)


@query("select event_id, (json_extract(props, '$.k'))::int as k from events where props is not null")
def marked_outputs(spark, sf_dir):
    out = F.concat(F.lit('log\nRESULT:{"k": -1}\nRESULT:'), "props", F.lit("\nbye RESULT:{}"))
    return _table(spark, sf_dir, "events").where("props is not null").select("event_id", small.marked_json(out, "RESULT:", "k int")["k"].alias("k"))


@query("select r_regionkey, unnest(range(0, 4))::int as copy from region")
def augmented_rows(spark, sf_dir):
    return reports.augmented(_table(spark, sf_dir, "region").select("r_regionkey"), 3)


_WHOLE = _BOXES.replace("min(l_partkey % 1000) as x", "min(l_partkey % 300) as x, min(l_suppkey * 7 % 200) as y").replace("min(20 + l_quantity * 5) as w", "min(20 + l_quantity * 12) as w").replace("l_linenumber * 30", "l_linenumber * 40")


@query(f"""with b as ({_WHOLE}), u as (select case_no, min(x) as x0, min(y) as y0, max(x + w) as x1, max(y + h) as y1, arg_max(pos, w * h * 1000 - pos) as pos from b group by 1),
    m as (select o_orderkey as case_no, 600 as bw, 300 + o_custkey % 300 as bh, u.* exclude (case_no), x, y, w, h, h > 0 and y1 - y0 > h * 1.18::double and w >= 330 as alone from orders left join u on u.case_no = o_orderkey left join b on b.case_no = u.case_no and b.pos = u.pos),
    c as (select case_no, bw, bh, case when alone then x else x0 end as l, case when alone then y else y0 end as t, case when alone then x + w else x1 end as r, case when alone then y + h else y1 end as b from m),
    d as (select *, case when l > 18 then 0 else greatest(0, l - 24) end as xx, greatest(0, t - 10) as yy from c),
    e as (select *, least(r + 10, bw) - xx as ww, least(b + greatest(10, trunc(bh * 0.02::double)), bh) - yy as hh from d),
    f as (select *, l is null or greatest(ww, 1) * greatest(hh, 1) < bw * bh * 0.25::double or ww / bw < 0.55::double or hh / bh < 0.5::double as poor from e)
    select case_no, case when poor then 0 else xx end::bigint as x, case when poor then 0 else yy end::bigint as y, case when poor then bw else ww end::bigint as w, case when poor then bh else hh end::bigint as h from f""")
def table_boxes(spark, sf_dir):
    found = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("case_no"), F.col("l_linenumber").alias("pos")).agg(
        F.min(F.col("l_partkey") % 300).alias("x"), F.min(F.col("l_suppkey") * 7 % 200).alias("y"), F.min(20 + F.col("l_quantity") * 12).alias("w"), F.min(20 + F.col("l_linenumber") * 40).alias("h"))
    bands = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_no"), F.lit(600).alias("band_w"), (300 + F.col("o_custkey") % 300).alias("band_h"))
    return box_ops.table_box(found, bands)
