"""The corpus pipeline: toxicity, near duplicates, decontamination, mixing, sharding.

Every stage works on all rows that the one before kept and is written as Parquet in the shared folder before the next
one reads it; all but the last return the columns of documents. SQL can't express the stages with learned or
iterative parts, so ORACLE_SQL is None and tests hold each stage against a plain version.

All stages read whole texts of any length, take columns beside those of documents along, whatever their names, and make
an empty table of an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairnmark.llm.common import materialize, table
from cairnmark.llm.decontamination import decontaminate
from cairnmark.llm.jaccard import keep_one
from cairnmark.llm.mixing import mixed_documents
from cairnmark.llm.sharding import assign_shards
from cairnmark.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go.

    Null and empty texts score less and stay, as do rows without an id; repeated rows go or stay together.
    """
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one of the least id, then of the least MD5 of its text.

    Documents without words are in no group and all stay, repeated or not; null ids come last; of rows that are alike in
    id and text one stays.
    """
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold none and stay, as do rows without an id; repeated rows go or stay together; items without
    text are none.
    """
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them; the last one of a source in part.

    Documents without words (null, empty or white) take up nothing and go; null sources are one source; null ids are
    drawn as one id; rows that are alike tie, and share what is left if they stand on the edge.
    """
    return mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document that is left gets a shard and a slot: one row for each, null or repeated ids as well."""
    return assign_shards(docs)


STAGES = [("toxicity", toxicity), ("ngram_jaccard", ngram_jaccard), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
