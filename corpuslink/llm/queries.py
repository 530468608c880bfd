"""The queries of this subpackage: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .html import main_text
from .mixing import mixture
from .mixing import sql as mixing_sql
from .packing import pack
from .periodic import periodic_runs
from .quality import quality_rules
from .quality import sql as quality_sql
from .sharding import shard
from .simhash import simhash_components
from .spelling import spelling_variants
from .substrings import remove_repeats
from .tokens import token_counts
from .urls import filter_urls
from .vectors import near_vectors
from .warc import round_trip


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_read(spark, sf_dir, "documents"), 1024)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(_read(spark, sf_dir, "documents"), 2)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_read(spark, sf_dir, "documents"), 35)


def op4_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_read(spark, sf_dir, "pages"), 0)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(_read(spark, sf_dir, "pages"))


def op6_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(_read(spark, sf_dir, "documents"), 8)


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(_read(spark, sf_dir, "documents")).withColumn("probability", F.round("probability", 9))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_read(spark, sf_dir, "embeddings"), 0.9)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_read(spark, sf_dir, "documents"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_read(spark, sf_dir, "pages"), _read(spark, sf_dir, "labels"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_read(spark, sf_dir, "documents"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_read(spark, sf_dir, "documents"), 2048)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(_read(spark, sf_dir, "documents"), plant=True)


QUERIES = {f.__name__: f for f in (
    op1_best_fit_packing, op2_simhash_near_dedup, op3_substring_dedup, op4_warc_salvage, op5_html_extraction,
    op6_minimax_sharding, op7_source_mixing, op8_embedding_near_dedup, op9_quality_rules, op10_url_filters,
    op11_spelling_variants, op12_token_counts, op13_periodic_runs,
)}
ORACLE_SQL: dict[str, str] = {"op7_source_mixing": mixing_sql(), "op9_quality_rules": quality_sql()}


def queries() -> dict:
    """All queries by name, with that of the pipeline."""
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
