"""The corpus pipeline: five stages, each over all its predecessor kept.

Stages filter rows or edit text and keep the columns of documents; the last one lists every kept document with the words the mix
takes of it. A text that loses all its lines to line dedup goes. Rows that share a doc_id count as one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontamination, line_dedup, mixing, ngram_join, quality
from tidemark.llm.common import stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept_only(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated(docs, keep_empty=False)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, with_text=False)


STAGES = [("quality_rules", quality_rules), ("line_dedup", dedup_lines), ("ngram_join", dedup_documents), ("decontamination", decontaminate), ("mixing", mix_sources)]

#: Trained labelling, similarity joins over token sets and a schedule aren't expressible; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
