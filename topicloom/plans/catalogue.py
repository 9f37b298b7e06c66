"""All queries of the core by name, each with the SQL that states the same result where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from topicloom.plans import corpus_queries, model_queries, preparation_queries, run_queries, selection_queries, step_queries, topic_queries, vector_queries
from topicloom.plans.base import Base

ALL = {**topic_queries.QUERIES, **corpus_queries.QUERIES, **vector_queries.QUERIES, **run_queries.QUERIES, **model_queries.QUERIES, **preparation_queries.QUERIES, **step_queries.QUERIES, **selection_queries.QUERIES}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document coherence of the topics of every run."""
    return queries()["coherence_doc_npmi"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: lambda spark, sf_dir, f=f: f(Base(spark, sf_dir)) for name, (f, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql() for name, (_, sql) in ALL.items() if sql}
