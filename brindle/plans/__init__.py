"""The registered queries and the DuckDB SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import further, library, relational
from .tables import sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = {name: (lambda spark, sf_dir, text=text: sql(spark, sf_dir, text)) for name, text in relational.SQL.items()}
    return made | relational.QUERIES | library.QUERIES | further.QUERIES


def oracles() -> dict[str, str]:
    return relational.SQL | library.ORACLE | further.ORACLE
