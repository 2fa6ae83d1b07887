"""From documents to packed sequences: quality, exact and near copies, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm.common import remove, scratch, stable
from tickloom.llm.exact_dedup import drop_copies
from tickloom.llm.mixing import mix
from tickloom.llm.near_dedup import drop_near_copies
from tickloom.llm.packing import pack_documents
from tickloom.llm.quality_model import drop_poor


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine accepts."""
    return drop_poor(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents, the one with the smallest id."""
    return drop_near_copies(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of all sources by the target weights, repeated as often as the mix takes them."""
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("exact_dedup", exact_copies), ("near_dedup", near_copies), ("mixing", mixture), ("packing", packing)]

#: No SQL says what a fitted model or a seeded sample keeps; tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces. Each stage's own tables, and the documents before it, are deleted once what it keeps is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES[:-1]:
        with scratch(spark) as made:
            docs = stable(stage(spark, docs, sf_dir))
            written = made.pop()
        remove(spark, before)
        before = [written]
    return STAGES[-1][1](spark, docs, sf_dir)
