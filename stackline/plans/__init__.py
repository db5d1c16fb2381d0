"""Registered queries of the holdings engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stackline.plans import holdings, review


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (*holdings.QUERIES, *review.QUERIES)}


def oracle_sql() -> dict[str, str]:
    return {**holdings.ORACLE, **review.ORACLE}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements to records' numbered fields, from end to end."""
    return holdings.record_links(spark, sf_dir)
