"""Shape a frame to a column contract."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditmill.functions.missing import finite_sql
from creditmill.functions.names import col, first_occurrences, quoted, safe_names


def align(df: DataFrame, contract: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` plus the contract's columns in order: missing ones NULL, others dropped, no infinities."""
    have = set(df.columns)
    return df.selectExpr(*[quoted(c) for c in keep],
                         *[f"{finite_sql(quoted(c)) if c in have else 'CAST(NULL AS DOUBLE)'} AS {quoted(c)}"
                           for c in contract])


def contract_gaps(columns: Sequence[str], contract: Sequence[str]) -> tuple[list[str], list[str]]:
    """Contract columns the frame lacks, and frame columns the contract does not know."""
    have, want = set(columns), set(contract)
    return [c for c in contract if c not in have], [c for c in columns if c not in want]


def column_report(df: DataFrame, contract: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(column, in_contract, filled) of every column but ``keep``, and of contract columns the frame lacks (filled NULL).

    One aggregate row, however many columns.
    """
    missing, unknown = contract_gaps([c for c in df.columns if c not in set(keep)], contract)
    have = [c for c in df.columns if c not in set(keep)]
    counts = df.agg(*[F.count(col(c)).alias(f"c{i}") for i, c in enumerate(have)])
    pairs = [F.struct(F.lit(c).alias("column"), F.lit(c not in set(unknown)).alias("in_contract"), F.col(f"c{i}").alias("filled"))
             for i, c in enumerate(have)]
    pairs += [F.struct(F.lit(c).alias("column"), F.lit(True).alias("in_contract"), F.lit(None).cast("bigint").alias("filled"))
              for c in missing]
    return counts.select(F.inline(F.array(*pairs)))


def sanitize(df: DataFrame) -> DataFrame:
    return df.toDF(*safe_names(df.columns))


def to_single_precision(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    chosen = set(columns)
    return df.selectExpr(*[f"CAST({quoted(c)} AS FLOAT) AS {quoted(c)}" if c in chosen else quoted(c) for c in df.columns])


def beside(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join on ``key``; a column both sides have is taken from the left."""
    taken = set(left.columns)
    extra = [c for c in right.columns if c == key or c not in taken]
    return left.join(right.select(*[col(c) for c in extra]), key, how)


def common_columns(left: Sequence[str], right: Sequence[str]) -> list[str]:
    other = set(right)
    return [c for c in first_occurrences(left) if c in other]


def filled_columns(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns with at least one value on both sides; one aggregate row per side reaches the driver."""
    filled = [df.agg(*[F.count(col(c)).alias(f"c{i}") for i, c in enumerate(columns)]).first()
              for df in (left, right)]
    return [c for i, c in enumerate(columns) if all(row[i] > 0 for row in filled)]
