"""Registry of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from creditmill.functions.names import quoted
from creditmill.session import tune

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def single(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Round doubles to single precision.

    Sums of doubles depend on the order of addition in their last digits, in Spark and in SQL alike.
    """
    chosen = {n for n, t in df.dtypes if t == "double"} if columns is None else set(columns)
    return df.selectExpr(*[f"CAST(CAST({quoted(n)} AS FLOAT) AS DOUBLE) AS {quoted(n)}" if n in chosen
                           else quoted(n) for n in df.columns])


def single_sql(sql: str, columns: Sequence[str]) -> str:
    replaced = ", ".join(f'CAST(CAST("{c}" AS FLOAT) AS DOUBLE) AS "{c}"' for c in columns)
    return f"SELECT * REPLACE ({replaced}) FROM ({sql})" if columns else sql


def query(name: str, sql: str | None = None, singles: Sequence[str] = ()) -> Callable[[Query], Query]:
    """Register a query; ``singles`` are the doubles compared at single precision."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return single(function(tune(spark), sf_dir), singles)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = single_sql(sql, singles)
        return function

    return register
