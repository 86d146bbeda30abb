"""Places of regular-expression matches as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_RUN = 128


def with_matches(df: DataFrame, text: str, pattern: str, out: str, group: int | None = None) -> DataFrame:
    """Adds ``out``: an array of (start, end, hit), code points, end exclusive, and with ``group`` also (value).

    Texts between matches and matches take turns, so a match ends where the lengths so far add up to. Sums are taken
    in runs of 128, which keeps texts with very many matches cheap.
    """
    found = F.col(text).rlike(pattern)
    none = F.array().cast("array<string>")
    hits, gaps, values, sizes, runs = (f"{out}_{n}" for n in ("hits", "gaps", "values", "sizes", "runs"))
    df = df.withColumns({
        hits: F.when(found, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none),
        gaps: F.when(found, F.split(text, pattern, -1)).otherwise(none),
        **({} if group is None else {values: F.when(found, F.regexp_extract_all(
            text, F.lit(pattern), F.lit(group))).otherwise(none)}),
    })
    df = df.withColumn(sizes, F.expr(f"transform({hits}, (x, i) -> length({gaps}[i]) + length(x))")).drop(gaps)
    add = "(a, x) -> a + x"
    df = df.withColumn(runs, F.expr(
        f"CASE WHEN size({sizes}) = 0 THEN array() ELSE transform(sequence(0, (size({sizes}) - 1) DIV {_RUN}),"
        f" r -> aggregate(slice({sizes}, CAST(r * {_RUN} + 1 AS INT), {_RUN}), 0, {add})) END"))
    before = (f"aggregate(slice({runs}, 1, CAST(i DIV {_RUN} AS INT)), 0, {add})"
              f" + aggregate(slice({sizes}, CAST((i DIV {_RUN}) * {_RUN} + 1 AS INT), i % {_RUN} + 1), 0, {add})")
    ends = f"{out}_ends"
    df = df.withColumn(ends, F.expr(f"transform({sizes}, (s, i) -> {before})")).drop(sizes, runs)
    value = "" if group is None else f", {values}[i] AS value"
    df = df.withColumn(out, F.expr(
        f"transform({hits}, (x, i) -> struct({ends}[i] - length(x) AS start, {ends}[i] AS end, x AS hit{value}))"))
    return df.drop(hits, ends, values)


def joined(spans: Column) -> Column:
    """``kind:start:end`` by start, then rank, comma-joined; spans have (start, rank, end, kind)."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
