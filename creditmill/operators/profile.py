"""Column profiles in one pass, returned as one row per column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditmill.functions.names import col, quoted, text


def _inline(df: DataFrame, fields: dict[str, dict[str, str]]) -> DataFrame:
    """``fields``: column -> {output field: aggregate SQL}; gives one row per column."""
    aggregates = [F.expr(f"{sql} AS {quoted(f'{i}_{field}')}")
                  for i, per_column in enumerate(fields.values()) for field, sql in per_column.items()]
    one_row = df.agg(*aggregates)
    rows = []
    for i, (name, per_column) in enumerate(fields.items()):
        cells = ", ".join(f"'{field}', {quoted(f'{i}_{field}')}" for field in per_column)
        rows.append(f"named_struct('column', {text(name)}, {cells})")
    return one_row.selectExpr(f"inline(array({', '.join(rows)}))")


def _number(sql: str, numeric: bool) -> str:
    return f"CAST({sql} AS DOUBLE)" if numeric else "CAST(NULL AS DOUBLE)"


def column_profile(df: DataFrame, key: str) -> DataFrame:
    """Type, missing count, and for numbers min, max and the value of the first row (by key) that has one."""
    fields = {}
    for name, kind in df.dtypes:
        c, numeric = quoted(name), kind != "string"
        fields[name] = {
            "dtype": f"max('{kind}')",
            "n_missing": f"count_if({c} IS NULL)",
            "min": _number(f"min({c})", numeric),
            "max": _number(f"max({c})", numeric),
            "sample": _number(f"min_by({c}, CASE WHEN {c} IS NOT NULL THEN {quoted(key)} END)", numeric),
        }
    return _inline(df, fields)


def missing_table(df: DataFrame) -> DataFrame:
    """Columns with missing values, most missing first, percent to one decimal."""
    counts = _inline(df, {c: {"missing": f"count_if({quoted(c)} IS NULL)", "n": "count(1)"} for c in df.columns})
    percent = F.bround(100 * F.col("missing") / F.col("n"), 1)
    return (counts.where(F.col("missing") > 0).select("column", "missing", percent.alias("percent"))
            .orderBy(F.desc(F.col("missing")), "column"))


def type_counts(profile: DataFrame) -> DataFrame:
    return profile.groupBy("dtype").agg(F.count(F.lit(1)).alias("n_columns"), F.sum("n_missing").alias("n_missing"))


def vocabulary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sorted distinct values per column, long form (column, value)."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), col(c).alias("value")) for c in columns]))
    return (df.select(cells.alias("cell")).select("cell.*").where(F.col("value").isNotNull())
            .distinct().orderBy("column", "value"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))
