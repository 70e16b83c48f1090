"""Corpus pipeline: quality, exact copies, near copies, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; its result is written as Parquet and read again as the next one's docs.
All stages but the last return the columns of ``documents``.

Defined results: a null text counts as empty, equals an empty one, and is scored, kept
and encoded like any other; texts without words link with nothing and are left out of
the mix; very long texts are read whole by every stage; of repeated rows one goes on;
rows with null ids are never learnt from and count as rows of their own; ties go to the
smallest id; an empty table gives an empty result at every stage; further columns of
``documents``, whatever their names, are passed through to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelframe.llm.exact_dedup import drop_copies
from duelframe.llm.mixing import mix
from duelframe.llm.ngram_join import keep_one_of_similar
from duelframe.llm.quality import DECISION, keep_quality
from duelframe.llm.queries import token_digests
from duelframe.llm.tables import table
from duelframe.session import bounded_batches, stored

#: Documents below this score go: those that op4 predicts as poor.
LEAST_QUALITY = DECISION

#: The classifier, the token ids and the mix's seeded blocks are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    bounded_batches(spark)
    return keep_quality(docs, table(spark, sf_dir, "labels"), LEAST_QUALITY)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with the same text the one with the smallest id."""
    return drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the one with the smallest id."""
    bounded_batches(spark)
    return keep_one_of_similar(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: documents repeated, kept, cut at the end of a run of blocks, or left out."""
    return mix(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and their digests for each document of the mix."""
    return token_digests(spark, docs, with_ids=True)


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("mixing", mixing_stage),
          ("token_ids", token_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
