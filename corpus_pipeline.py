"""A corpus pipeline: toxicity, exact dedup, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Each result is written and read again as the next stage's docs. Rows are told apart by a key of their own and not by
doc_id, so ids may be null or repeated in every stage; a null text counts as empty. Other columns, whatever their names,
go through every stage but the last as they are; a table without rows gives none.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pneuma.llm import exact_dedup, jaccard, packing, pii, toxicity
from pneuma.llm.common import dropped, written
from pneuma.llm.queries import WORD_BPE, table


def _quoted(names: list[str]) -> list[F.Column]:
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def _bare_scan(docs: DataFrame) -> bool:
    """Whether docs is one table of files and nothing else but columns and filters of it, so a row is one row of a file."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.children().size() == 1 and plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().apply(0)
    return plan.children().size() == 0 and plan.nodeName() == "LogicalRelation"


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a unique key that is the same in every read, and the key's name, which no column of docs has.

    The key is a row's file and place in it if docs is a bare scan of Parquet files. Otherwise, as where rows were exploded,
    joined or put together, rows are numbered and written.
    """
    taken = {c.lower() for c in docs.columns}
    name = next(n for n in ("_row", *(f"_row{k}" for k in range(len(taken) + 1))) if n not in taken)
    if "_metadata" not in taken and _bare_scan(docs):
        try:
            return docs.select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias(name)), name
        except AnalysisException:  # no files, or of another format
            pass
    return written(docs.select("*", F.struct(F.monotonically_increasing_id().alias("row_index")).alias(name)), "pipeline-rows"), name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go, each row by its own text."""
    return toxicity.kept(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts (A-Z lower-cased) one stays: that of the largest id, null being the smallest; of equal ids any one."""
    rows, row = _keyed(docs)
    key = F.struct(F.col("doc_id"), F.col(row).alias("row"))
    stays = exact_dedup.dedup(rows.select(key.alias("key"), "text"), "key").where("kept")
    return rows.join(stays.select(F.col("doc_id.row").alias(row)), row, "left_semi").select(*_quoted(docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates one row stays: that of the least id, null being the largest; of equal ids any one.

    Rows without words are classes of their own, and stay.
    """
    rows, row = _keyed(docs)
    key = F.struct(F.col("doc_id").isNull().alias("absent"), F.col("doc_id"), F.col(row).alias("row"))
    stays = jaccard.components(rows.select(key.alias("key"), "text"), id_col="key").where(F.col("doc_id") == F.col("component_id"))
    return rows.join(stays.select(F.col("doc_id.row").alias(row)), row, "left_semi").select(*_quoted(docs.columns))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts gives way to its kind in angle brackets; n_chars follows. Null texts stay null."""
    return pii.redacted(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*_quoted(docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every remaining row, tokenised and packed into sequences; a null text is packed as empty."""
    return packing.pack(docs, WORD_BPE, capacity=2048)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_duplicates", drop_near_copies), ("personal_data", redact), ("packing", pack)]
#: Learning, deobfuscation and packing have no SQL form; tests/llm/test_pipeline.py holds the stages and run() against small cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
