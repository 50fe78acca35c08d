"""The corpus pipeline: each stage is one operator of ``tidemark.llm`` over all that the stage before it kept.

Columns of documents pass through all stages but the last, further ones too, whatever their names. Null texts count as
empty and go at the first stage, as blank ones do; texts of any length are read whole. Repeated rows are judged alike,
and of rows with equal or similar texts one stays; of equal ids with different texts each is judged by its own text. Rows
with null ids are judged like others and stay where no row of their class has an id. An empty table gives no
rows at every stage. Where a label or the benchmark is missing, the stage that needs it keeps every row with a text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, common, decontaminate, near_dedup, quality, toxicity


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from labelled rows of the whole documents table."""
    return quality.accepted(docs, quality.train(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject; it too learns from the whole documents table."""
    return toxicity.accepted(docs, toxicity.train(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_dedup.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks."""
    return decontaminate.without_leaks(docs, common.table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids' digests and counts of what is left."""
    return bpe.encode_documents(docs)


STAGES = [("quality", good_quality), ("toxicity", not_toxic), ("near_dedup", deduplicated), ("decontamination", decontaminated), ("bpe", encoded)]

#: Trained models, signatures and a tokenizer's merges are beyond SQL; tests/llm checks the stages instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = docs
        with common.scratch(spark) as made:
            docs = common.written(stage(spark, before, sf_dir), f"stage-{name}")
            made.keep_last()
        if name != STAGES[0][0]:
            common.drop_written(spark, before)
    return docs
