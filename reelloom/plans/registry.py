"""Every query of the library by name, and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import catalogue, logs, sheets, texts

Query = Callable[[SparkSession, str], DataFrame]
MODULES = [catalogue, logs, sheets, texts]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.flagship(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: q for m in MODULES for name, q in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.S.items()}
