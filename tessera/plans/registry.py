"""Where query modules register their queries and SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.functions.scalars import q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def rounded(df: DataFrame, digits: int = 6, **more: int) -> DataFrame:
    """row and col as i and j, and doubles rounded without negative zero."""
    out = df.withColumnsRenamed({"row": "i", "col": "j"})
    return out.select(*[q(out[c], more.get(c, digits)).alias(c) if t == "double" else out[c] for c, t in out.dtypes])


def r6(*columns: str, digits: int = 6) -> str:
    """SQL for the same rounding."""
    return ", ".join(f"round({c}, {digits}) + 0.0::DOUBLE AS {c}" for c in columns)
