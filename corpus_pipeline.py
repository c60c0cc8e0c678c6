"""From raw documents to packed training sequences: each stage works on all that the stage before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs; all but the last return the columns of ``documents``. Near duplicates are documents whose shingle
sets have a similarity of ``NEAR_PERCENT`` % or more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ruleweft.llm.common import shared_dir, stash, table
from ruleweft.llm.minhash import one_of_each
from ruleweft.llm.packing import best_fit_packing
from ruleweft.llm.quality import only_good, train
from ruleweft.llm.suffix_dedup import without_repeats
from ruleweft.llm.toxicity import without_toxic

NEAR_PERCENT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return only_good(docs, train(docs, table(spark, sf_dir, "labels")))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs, NEAR_PERCENT)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit_packing(docs)


STAGES = [("quality rules", quality_rules), ("toxicity", toxicity), ("MinHash near-dedup", near_duplicates), ("suffix-array dedup", repeated_passages), ("best-fit packing", packing)]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, where = table(spark, sf_dir, "documents"), shared_dir(spark)
    for i, (_, stage) in enumerate(STAGES):
        docs = stash(stage(spark, docs, sf_dir), f"{where}/stage{i}")
    return docs
