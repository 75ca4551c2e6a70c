"""All registered queries over the reference tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import q_events, q_kernels, q_more, q_series, q_study

_MODULES = (q_series, q_events, q_study, q_kernels, q_more)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in _MODULES for k, v in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q_events.flagship_event_pipeline(spark, sf_dir)
