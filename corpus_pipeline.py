"""Documents to packed training bins, in four stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from taxloom.llm.line_dedup import drop_repeated_lines
from taxloom.llm.ngram_join import drop_near_copies
from taxloom.llm.packing import pack
from taxloom.llm.quality import keep_good
from taxloom.llm.scratch import settle


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand, nearly the same, elsewhere before."""
    return drop_repeated_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return drop_near_copies(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in which bin."""
    return pack(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each on the whole of what the one before kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can't express a trained classifier; tests hold the stages against brute-force versions.
ORACLE_SQL = None
