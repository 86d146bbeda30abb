"""Missing values, infinities and bounds, with one rule: a missing number is always NULL.

Spark keeps NaN as an ordinary value (it is the largest double and spoils averages), so NaN is
turned into NULL where data enters and where an aggregate can produce it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed value: day offset that stands for "not employed" / "no date"
NO_DATE = 365243


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def finite_or_null(c: Column) -> Column:
    """Drop NaN and both infinities; used at the model boundary and before JSON."""
    value = c.cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


def finite_sql(value: str) -> str:
    """``finite_or_null`` as SQL, for selects of many columns. NaN sorts above infinity."""
    return f"CASE WHEN abs(CAST({value} AS DOUBLE)) < double('Infinity') THEN CAST({value} AS DOUBLE) END"


def sentinel_to_null(c: Column, sentinel: int = NO_DATE) -> Column:
    return F.nullif(c, F.lit(sentinel))


def ratio(a: Column, b: Column) -> Column:
    """a / b; missing when b is zero or either side is missing."""
    return finite_or_null(F.try_divide(a.cast("double"), b.cast("double")))


def ratio_keep_inf(a: Column, b: Column) -> Column:
    """a / b where x/0 is signed infinity and 0/0 is missing."""
    a, b = a.cast("double"), b.cast("double")
    inf = F.lit(float("inf"))
    return F.when(b == 0, F.when(a > 0, inf).when(a < 0, -inf)).otherwise(F.try_divide(a, b))


def not_below(c: Column, low: float = 0) -> Column:
    """Clip from below; ``greatest`` alone would turn a missing value into the bound."""
    return F.when(c.isNotNull(), F.greatest(c, F.lit(low)))


def within(c: Column, low: float, high: float) -> Column:
    """Clamp to [low, high], keeping missing values missing."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def round_half_even(c: Column) -> Column:
    return F.bround(c, 0).cast("int")


def share_of(part: Column, whole: Column) -> Column:
    """part / whole with 0 for an empty whole."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))
