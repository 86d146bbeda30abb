"""Request rules as one array of failed rule names per row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditmill.contract import schema as S
from creditmill.functions.names import quoted, text

ERRORS = "errors"


def range_rules(columns: Sequence[str]) -> dict[str, str]:
    """Rule name -> SQL that is true when the rule is broken. Missing values break no range."""
    rules = {}
    for (low, high), names in S.RANGES.items():
        rules |= {f"range:{c}": f"{quoted(c)} < {low} OR {quoted(c)} > {high} OR isnan({quoted(c)})"
                  for c in names if c in columns}
    # NaN sorts above every number, so it needs its own test
    rules |= {f"positive:{c}": f"{quoted(c)} <= 0 OR isnan({quoted(c)})" for c in S.POSITIVE if c in columns}
    return rules


def flag_rules(columns: Sequence[str]) -> dict[str, str]:
    return {f"flag:{c}": f"{quoted(c)} NOT IN (0, 1)" for c in S.FLAGS if c in columns}


def enum_rules(columns: Sequence[str]) -> dict[str, str]:
    return {f"enum:{c}": f"{quoted(c)} NOT IN ({', '.join(text(v) for v in values)})"
            for c, values in S.ENUMS.items() if c in columns}


def required_rules(columns: Sequence[str]) -> dict[str, str]:
    """A required column that is absent altogether is broken on every row."""
    return {f"required:{c}": f"{quoted(c)} IS NULL" if c in columns else "true" for c in S.REQUIRED}


def all_rules(columns: Sequence[str]) -> dict[str, str]:
    columns = set(columns)
    return range_rules(columns) | flag_rules(columns) | enum_rules(columns) | required_rules(columns)


def failed(rules: dict[str, str]) -> Column:
    cases = ", ".join(f"CASE WHEN {broken} THEN {text(name)} END" for name, broken in rules.items())
    return F.expr(f"array_compact(array({cases}))")


def unknown_columns(columns: Sequence[str], label: str | None = S.LABEL) -> list[str]:
    known = set(S.REQUEST_COLUMNS) | ({label} if label else set())
    return [c for c in columns if c not in known]


def unknown_fields(payload: Column, label: str | None = None) -> Column:
    """Names in a JSON request that the schema does not know, sorted; such a request is refused.

    A request that is no JSON object has NULL.
    """
    known = S.REQUEST_COLUMNS + [label] if label else S.REQUEST_COLUMNS
    return F.sort_array(F.array_except(F.json_object_keys(payload), F.lit(list(known))))


def absent_fields(payload: Column) -> Column:
    """Required names that a JSON request does not have, sorted; a field that is there with null is not absent."""
    return F.sort_array(F.array_except(F.lit(list(S.REQUIRED)), F.json_object_keys(payload)))


def check_requests(df: DataFrame, label: str | None = S.LABEL) -> DataFrame:
    """Add ``errors``. A column the schema does not know fails the whole job."""
    unknown = unknown_columns(df.columns, label)
    if unknown:
        raise ValueError(f"columns not in the request schema: {unknown}")
    return df.withColumn(ERRORS, failed(all_rules(df.columns)))


def split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and rejected rows with their reasons for the quarantine table."""
    return (checked.where(F.size(ERRORS) == 0).drop(ERRORS), checked.where(F.size(ERRORS) > 0))


def broken_per_rule(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Long form (rule, broken) with a row for every rule, also the unbroken ones."""
    totals = df.agg(*[F.expr(f"count_if({broken})").alias(f"r{i}") for i, broken in enumerate(rules.values())])
    pairs = ", ".join(f"named_struct('rule', {text(name)}, 'broken', r{i})" for i, name in enumerate(rules))
    return totals.selectExpr(f"inline(array({pairs}))")


def score_rules() -> dict[str, str]:
    """The output contract of a scored row."""
    return {
        "probability": "probability_default IS NULL OR isnan(probability_default) "
                       "OR probability_default < 0 OR probability_default > 1",
        "threshold": "threshold IS NULL OR threshold < 0 OR threshold > 1",
        "decision": "decision IS NULL OR decision NOT IN ('GRANTED', 'REFUSED')",
    }
