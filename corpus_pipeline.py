"""The corpus pipeline: documents without toxic ones, repeated lines, near-duplicates and benchmark passages, mixed by source.

Each stage takes what its predecessor kept, written as Parquet and read again; the first takes documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varspark.llm import common as c
from varspark.llm.decontaminate import decontaminate
from varspark.llm.line_dedup import line_dedup
from varspark.llm.mixing import mix
from varspark.llm.near_dedup import near_rows
from varspark.llm.toxicity import toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go."""
    return toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("predicted = 0").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 10 characters or more stay only in the smallest doc_id; n_chars follows the text."""
    return line_dedup(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays, that with the smallest doc_id (null comes last)."""
    rows = c.row_key(docs.select(*COLUMNS))
    gone = near_rows(rows.select("doc_id", "text", "_file", "_row"), longs=("_file", "_row")).where("NOT first").select("_file", "_row")
    return rows.join(gone, ["_file", "_row"], "left_anti").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold at least half of a benchmark item go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("NOT contaminated").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture, with their places in it."""
    return mix(docs).select(*COLUMNS, "mix_slot", "mix_pos").orderBy("mix_slot", "mix_pos")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mixing", mix_sources),
]

ORACLE_SQL = None  # SQL can't express the classifier; tests/llm/test_pipeline.py has a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, c.keep_only(lambda docs=docs, stage=stage: stage(spark, docs, sf_dir), f"pipeline-{name}")
        if hasattr(before, "kept_at"):
            c.drop(before)
    return docs
