"""Joins that keep every row: hot keys are spread, missing group values match each other."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditmill.functions.names import col

HOT_SHARE = 0.001
#: Keys of a batch up to which a lookup table is filtered by them.
PRUNE_KEYS = 10_000


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE) -> DataFrame:
    """Keys that hold at least ``share`` of the rows and 1000 of them; there can be no more than 1/share."""
    counts = df.where(col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    least = F.greatest(F.lit(1000), share * counts.agg(F.sum("_rows")).scalar())
    return counts.where(F.col("_rows") >= least).select(key)


def lookup_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``left`` with the columns of ``right`` (unique on ``key``); unmatched rows get NULLs.

    The keys of ``left`` are counted first. Rows of a hot key stay where they are and are joined to a broadcast of the
    at most 1/HOT_SHARE rows that ``right`` has for such keys; rows without a key are not joined at all. The rest is
    joined on the key alone, so a ``right`` that is bucketed by it is not shuffled. ``left`` is read once per part and
    should be a table or a plain projection of one.
    """
    rows, given = left.agg(F.count(F.lit(1)), F.count(col(key))).first()
    hot = [r[0] for r in hot_keys(left, key).collect()]
    is_hot = col(key).isin(hot)
    rest = left.where(col(key).isNotNull())
    out = (rest.where(~is_hot) if hot else rest).join(right, key, "left")
    if hot:
        out = out.unionByName(left.where(is_hot).join(F.broadcast(right.where(is_hot)), key, "left"))
    if given < rows:
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema if f.name != key]
        out = out.unionByName(left.where(col(key).isNull()).select("*", *none))
    return out


def rows_for(right: DataFrame, batch: DataFrame, key: str, most: int = PRUNE_KEYS) -> DataFrame:
    """The rows of ``right`` that a small ``batch`` can look up.

    Up to ``most`` different keys become a filter, by which Spark reads only their buckets of a bucketed table; with
    more keys the whole of ``right`` is left to the join.
    """
    keys = [r[0] for r in batch.select(key).where(col(key).isNotNull()).distinct().limit(most + 1).collect()]
    return right if len(keys) > most else right.where(col(key).isin(keys))


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on group columns where a missing value equals a missing value, as in ``groupBy``."""
    renamed = right.withColumnsRenamed({k: f"_other_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [col(k).eqNullSafe(col(f"_other_{k}")) for k in keys])
    return left.join(renamed, same).drop(*[f"_other_{k}" for k in keys])
