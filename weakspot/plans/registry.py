"""How a module of queries registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def registrar(registry: dict):
    def query(name: str, sql: str | None = None):
        def keep(f):
            registry[name] = (f, sql)
            return f

        return keep

    return query


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """df with its doubles rounded; adding 0 turns -0 into 0."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r(*columns: str, digits: int = 6) -> str:
    """The same for SQL: round(x, 6) + 0 AS x for each column."""
    return ", ".join(f"round({c}, {digits}) + 0e0 AS {c}" for c in columns)
