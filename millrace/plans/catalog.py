"""Names of the queries, each with the Spark job and, where SQL can express it, the oracle's text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.plans import audio_queries, dataset_queries, event_queries, metric_queries, model_queries, series_queries, text_queries

MODULES = (series_queries, text_queries, metric_queries, audio_queries, event_queries, dataset_queries, model_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: job for module in MODULES for name, job in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for module in MODULES for name, text in module.ORACLES.items()}
