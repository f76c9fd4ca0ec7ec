"""Sources and sinks: report folders, grid and lookup tables, configuration, results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import HEADINGS, ROWS

METRICS, COLUMNS = ROWS, list(HEADINGS.values())
GRID = T.StructType([T.StructField(c, T.StringType()) for c in ("case_id", "metric", *COLUMNS)])


def list_reports(spark: SparkSession, folders: list[str], suffix: str = ".pdf", recursive: bool = False, least: int = 1) -> DataFrame:
    """path and length of report files in order, the suffix compared without case; contents are not read.

    folders may name files too. A missing folder, or fewer than `least` files, is an error.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    found = reader.load(folders).select("path", "length").where(F.lower("path").endswith(suffix))
    if least and found.limit(least).count() < least:
        raise FileNotFoundError(f"No {suffix} files in {folders}")
    return found.orderBy("path")


def read_overrides(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The overrides of rectangles in one document, JSON or YAML by its name: general ones (one row), and those of files
    (file, values). A document that is missing, can't be read, or is no object is an error; an empty one has no overrides.
    """
    kind = "struct<rel_left:double,rel_top:double,rel_right:double,rel_bottom:double,dx:double,dy:double,grow:double,extra_bottom_frac:double>"
    whole = spark.read.text(path, wholetext=True)
    text = (whole.first() or [""])[0]  # one small document of settings
    if path.lower().endswith((".yaml", ".yml")):
        import json

        import yaml

        try:
            text = json.dumps(yaml.safe_load(text) or {})
        except (yaml.YAMLError, TypeError) as e:
            raise ValueError(f"{path} is no YAML document: {e}") from e
    shape = spark.range(1).select(F.from_json(F.lit(text or "{}"), f"struct<global:{kind},per_file:map<string,{kind}>,_bad:string>", {"columnNameOfCorruptRecord": "_bad"}).alias("doc"))
    doc = shape.select("doc.*")
    if doc.where("_bad is not null").count():
        raise ValueError(f"{path} is no JSON object of overrides")
    return doc.select("global.*"), doc.select(F.explode("per_file").alias("file", "values")).select("file", "values.*")


def read_first(spark: SparkSession, folder: str, schema: str, pattern: str = "*.json") -> DataFrame:
    """The first JSON document of a folder by name; no row without files, and null columns for one that can't be read."""
    docs = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("_file"), "value")
    first = docs.agg(F.min_by("value", "_file").alias("value")).where("value is not null")
    return first.select(F.from_json("value", schema).alias("doc")).select("doc.*")


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """Grid tables as text with a fixed schema; a byte-order mark is dropped, blanks are null."""
    return spark.read.csv(path, header=True, schema=GRID, enforceSchema=True)


def read_lookup(spark: SparkSession, path: str) -> DataFrame:
    """case_id and bmi; of repeated ids the last row wins, files in order of their names; rows without a number, or with NaN,
    are passed over."""
    at = F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    rows = spark.read.csv(path, header=True).select(F.trim("case_id").alias("case_id"), F.col("bmi").try_cast("double").alias("bmi"), at.alias("pos"))
    return rows.where("case_id <> '' and bmi is not null and not isnan(bmi)").groupBy("case_id").agg(F.max_by("bmi", "pos").alias("bmi"))


def flatten_config(df: DataFrame, column: str, keep: list[str] | None = None) -> DataFrame:
    """A two-level JSON object as rows group.name and value, beside the columns to keep; other shapes give none."""
    keep = keep or []
    groups = F.from_json(column, "map<string,map<string,string>>")
    return df.select(*keep, F.explode(groups).alias("group", "items")).select(*keep, "group", F.explode("items").alias("name", "value")).select(*keep, F.concat_ws(".", "group", "name").alias("name"), "value")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """image and label from one JSON object {image: [label, ...]} a file."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("image", "labels")).select("image", F.explode("labels").alias("label"))


def _metric_at() -> F.Column:
    """Where a row of the grid stands in its case; rows of other names come last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(m) for m in METRICS]), F.col("metric")), F.lit(0)), F.lit(len(METRICS) + 1))


def in_order(df: DataFrame, key: str = "case_id") -> DataFrame:
    """Grid rows as they are written: key, metric and the columns in order, a missing cell blank, by case and row of the
    grid, as ranges that are sorted within and between them."""
    cells = [F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in COLUMNS]
    rows = df.select(F.col(key).cast("string").alias("case_id"), "metric", *cells, _metric_at().alias("_at"))
    return rows.repartitionByRange("case_id", "_at", "metric").sortWithinPartitions("case_id", "_at", "metric").drop("_at")


def write_grid(df: DataFrame, path: str, mode: str = "errorifexists", most_rows: int = 2_000_000) -> None:
    """The canonical sink, one table of all cases: Parquet files of at most most_rows rows, which in order of their names
    hold the cases in order, and each case its rows in that of the grid."""
    in_order(df).write.mode(mode).option("maxRecordsPerFile", most_rows).parquet(path)


def write_cases(df: DataFrame, path: str, form: str = "csv", most_rows: int = 2_000_000) -> None:
    """A folder a case, path/case_id=<id>/, with its rows in order; form is csv (with a header) or parquet.

    Cases that were written before and are in df are replaced, others stay as they are. Cases come in ranges, so a task
    writes a few whole cases after each other and no case is in more files than its rows need.
    """
    out = in_order(df).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", most_rows).partitionBy("case_id")
    out.option("header", True).format(form).save(path)


def read_cases(spark: SparkSession, path: str, form: str = "csv") -> DataFrame:
    """What write_cases() wrote, as text, ids as they were; a blank cell is null in csv."""
    return spark.read.format(form).option("header", True).schema(GRID).load(path).select("case_id", "metric", *[f"`{c}`" for c in COLUMNS])


def export_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header; arrays and structs as JSON."""
    flat = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, T.ArrayType | T.StructType | T.MapType) else F.col(f"`{f.name}`") for f in df.schema]
    df.select(*flat).write.mode(mode).csv(path, header=True)


def export_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object a line; NaN is written as a text, as JSON has none."""
    df.write.mode(mode).json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON results with their schema: a number may be a bare NaN or "NaN", which reads as NaN; a line that can't be read is
    a row of nulls."""
    return spark.read.option("allowNonNumericNumbers", True).schema(schema).json(path)
