"""Application features: binary codes, pinned dummies, sentinel clean-up and ratios.

One list of expressions serves the training matrix and scoring, so the two cannot drift apart.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from creditmill.contract import vocabulary
from creditmill.contract.features import RATIOS
from creditmill.contract.schema import GENDER_TO_DROP, KEY, LABEL
from creditmill.functions.missing import ratio, sentinel_to_null
from creditmill.functions.names import col, quoted, text


def drop_gender(df: DataFrame) -> DataFrame:
    """Leave out the one invalid gender; a missing gender stays."""
    return df.where(~F.col("CODE_GENDER").eqNullSafe(GENDER_TO_DROP))


def encode_binary(column: str, codes: Mapping[str, int]) -> Column:
    """Code of a binary category; unknown and missing become missing."""
    cases = " ".join(f"WHEN {text(value)} THEN {code}" for value, code in codes.items())
    return F.expr(f"CASE {quoted(column)} {cases} END")


def dummies(vocab: Mapping[str, Sequence[str]], columns: Sequence[str]) -> list[Column]:
    """0/1 columns; unknown and missing values, and absent columns, give zeros."""
    present = set(columns)
    return [F.expr((f"CASE WHEN {quoted(c)} = {text(v)} THEN 1 ELSE 0 END" if c in present else "0")
                   + f" AS {quoted(f'{c}_{v}')}")
            for c, values in vocab.items() for v in values]


def clean_number(column: str) -> Column:
    value = col(column)
    return sentinel_to_null(value) if column == "DAYS_EMPLOYED" else value


def ratios() -> list[Column]:
    return [ratio(clean_number(a), clean_number(b)).alias(name) for name, (a, b) in RATIOS.items()]


def application_columns(columns: Sequence[str], vocab: Mapping[str, Sequence[str]] | None = None,
                        codes: Mapping[str, Mapping[str, int]] | None = None) -> list[Column]:
    """Features of an application row: plain and binary columns, dummies, ratios."""
    vocab = vocabulary.APPLICATION if vocab is None else vocab
    codes = vocabulary.BINARY_CODES if codes is None else codes
    plain = [encode_binary(c, codes[c]).alias(c) if c in codes else clean_number(c).alias(c)
             for c in columns if c not in (KEY, LABEL) and c not in vocab]
    return plain + dummies(vocab, columns) + ratios()


def application_matrix(app: DataFrame) -> DataFrame:
    """Key, label if there is one, and the application features, without the invalid gender."""
    keep = [c for c in (KEY, LABEL) if c in app.columns]
    return drop_gender(app).select(*keep, *application_columns(app.columns))


def fit_binary_codes(df: DataFrame, columns: Sequence[str], order: str) -> DataFrame:
    """Codes by first occurrence in ``order``; long form (column, value, code)."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), col(c).alias("value")) for c in columns]))
    first = (df.select(col(order).alias("_order"), cells.alias("cell")).select("_order", "cell.*")
             .where(F.col("value").isNotNull())
             .groupBy("column", "value").agg(F.min("_order").alias("_first")))
    by_first = Window.partitionBy("column").orderBy("_first", "value")
    return first.select("column", "value", (F.row_number().over(by_first) - 1).alias("code"))
