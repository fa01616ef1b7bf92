"""The corpus pipeline: quality rules, line dedup, near duplicates, decontamination, source mixing.

Each stage works on what its predecessor kept, written as Parquet in the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagequality.llm import decontaminate, line_dedup, mixing, ngram_join, quality_rules
from pagequality.llm.common import stash, table
from pagequality.operators.interim import passing


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.filter_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier line is like; those with nothing left go."""
    return line_dedup.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, Jaccard 0.8 or more."""
    return ngram_join.keep_one(docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return decontaminate.filter_documents(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the target weights, with topic, n_tokens and copies."""
    return mixing.sample(docs)


STAGES = [("quality rules", quality), ("line dedup", lines), ("near duplicates", near_duplicates),
          ("benchmark decontamination", benchmarks), ("source mixing", mixture)]

#: Estimated rates, set-similarity joins and edit distances are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def _after(spark: SparkSession, sf_dir: str, stages: list) -> DataFrame:
    """What the last of ``stages`` keeps, written; what it was made of goes."""
    if not stages:
        return table(spark, sf_dir, "documents")
    name, stage = stages[-1]
    with passing() as keep:
        docs = stage(spark, _after(spark, sf_dir, stages[:-1]), sf_dir)
        return keep(stash(docs, f"pipeline-{name.replace(' ', '-')}"))


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return STAGES[-1][1](spark, _after(spark, sf_dir, STAGES[:-1]), sf_dir)
