"""The queries of the analytics engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

AREAS = ("screens", "portfolios", "returns", "sequences", "companies", "decisions", "strategies", "values")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for a in AREAS for k, f in import_module(f"gristmill.queries.{a}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for a in AREAS for k, q in import_module(f"gristmill.queries.{a}").SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gristmill.queries.screens import screen_topn

    return screen_topn(spark, sf_dir)
