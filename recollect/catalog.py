"""Every query of the engine by name, with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .queries import graphs, lifecycle, relational, scalar

_PARTS = (scalar, relational, graphs, lifecycle)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for p in _PARTS for k, f in p.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for p in _PARTS for k, s in p.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["recall_knn"](spark, sf_dir)
