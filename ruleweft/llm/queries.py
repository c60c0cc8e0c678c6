"""The queries ``opN_*`` and ``pipeline``, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ruleweft.llm import html_extract, licenses, sharding
from ruleweft.llm.bpe import bpe_round_trip
from ruleweft.llm.common import table
from ruleweft.llm.embed_dedup import embedding_near_dedup
from ruleweft.llm.minhash import minhash_near_dedup
from ruleweft.llm.packing import best_fit_packing
from ruleweft.llm.quality import quality, train
from ruleweft.llm.suffix_dedup import suffix_dedup
from ruleweft.llm.toxicity import toxicity


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_dedup(table(spark, sf_dir, "embeddings"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality(docs, train(docs, table(spark, sf_dir, "labels")))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.size_tiered_shards(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(licenses.with_paths(table(spark, sf_dir, "documents")))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_near_dedup(table(spark, sf_dir, "documents"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.train(pages))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_embedding_dedup, op2_bpe, op3_quality, op4_suffix_dedup, op5_sharding, op6_packing, op7_licenses, op8_minhash, op9_html, op10_toxicity, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op5_sharding": sharding.ORACLE_SQL, "op7_licenses": licenses.ORACLE_SQL}
