"""Corpus pipeline over ``documents``: toxic documents go, one of each near-duplicate group stays, benchmark leaks go, live secrets are
blanked, and sources are mixed to their target weights.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet to the shared folder and hands the written table
to the next stage. All stages but the last return the columns of ``documents``. Documents with null or empty texts pass every filter; rows
without a doc_id pass too and form no near duplicates. Every stage works on all its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, ngram_join, secret_scan, source_mix, weak_toxicity
from tidemark.llm.common import materialise
from tidemark.llm.queries import repository, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic go."""
    return weak_toxicity.drop_toxic(docs, weak_toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with similar 5-gram sets stays: the one with the least doc_id."""
    return ngram_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, up to its share of edited words, go."""
    return decontaminate.drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live credentials are blanked; no document goes."""
    return secret_scan.blank_live(docs, repo=repository(), owner="source")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated to the target weights of their sources and shuffled; adds n_copies, copy and shuffle_key."""
    return source_mix.mix_sources(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("mixing", mixing),
]

#: The toxicity model is trained by numpy, which SQL cannot express; the tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
