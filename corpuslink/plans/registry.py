"""Every query of the library by name, with the SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from ..operators.expansion import apply_context
from ..operators.ranking import hybrid_search, postings
from . import catalog_queries, graph_queries, pipeline_queries, search_queries, text_queries
from .tables import Tables, with_models

MODULES = [catalog_queries, text_queries, search_queries, graph_queries, pipeline_queries]


def _run(query, spark: SparkSession, sf_dir: str) -> DataFrame:
    return query(Tables(spark, sf_dir))


def queries() -> dict:
    return {name: partial(_run, f) for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: with_models(sql) for m in MODULES for name, sql in m.SQL.items()}


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:  # noqa: N802
    """Hybrid search of a table of queries, with the context of what it finds."""
    t = Tables(spark, sf_dir)
    corpus = search_queries.corpus_of(t)
    found = hybrid_search(search_queries.asked(t), corpus, postings(corpus), 10, 0.1)
    return apply_context(found, corpus).select("query_id", "rank", "id", "score", "context")
