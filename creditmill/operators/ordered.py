"""Exact order statistics without sending a whole group to one task.

Values are first counted, so copies of a value collapse on the map side. The distinct values are then
cut into ranges of about equal size; running sums inside a piece plus the totals of earlier pieces
give exact running sums for any group, however large.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from creditmill.operators.lookup import join_groups
from creditmill.session import cut_lineage

#: Distinct values of one piece, on average.
PIECE_ROWS = 1_000_000


def _placed(counted: DataFrame, groups: Sequence[str], value: str, piece_rows: int) -> DataFrame:
    """``counted`` with ``_piece``: pieces are ranges of (groups, value) of about ``piece_rows`` rows each.

    Spark samples the counted rows for the split points, so a group has as many pieces as its distinct values need, and
    small groups share one. The pieces are written, because every reader must see the same ones.
    """
    written = cut_lineage(counted, "counted")
    pieces = -(-written.count() // piece_rows)
    if pieces <= 1:
        return written.withColumn("_piece", F.lit(0))
    ranged = written.repartitionByRange(pieces, *[F.col(c) for c in [*groups, value]])
    return cut_lineage(ranged.withColumn("_piece", F.spark_partition_id()), "pieces")


def running_sums(counted: DataFrame, groups: Sequence[str], value: str, weights: Sequence[str],
                 piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Add ``<w>_before`` and ``<w>_total`` for every weight column.

    ``counted`` has one row per (groups, value) with a non-NULL value. ``<w>_before`` sums the weight over
    smaller values of the same group.
    """
    groups = list(groups)
    placed = _placed(counted, groups, value, piece_rows)
    piece_totals = placed.groupBy(*groups, "_piece").agg(*[F.sum(w).alias(f"_{w}") for w in weights])
    per_group = Window.partitionBy(*(groups or [F.lit(0)]))
    earlier = per_group.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = piece_totals.select(
        *groups, "_piece",
        *[F.coalesce(F.sum(f"_{w}").over(earlier), F.lit(0)).alias(f"_{w}_offset") for w in weights],
        *[F.sum(f"_{w}").over(per_group).alias(f"{w}_total") for w in weights])

    inside = (Window.partitionBy(*groups, "_piece").orderBy(value)
              .rowsBetween(Window.unboundedPreceding, -1))
    local = placed.select("*", *[F.coalesce(F.sum(w).over(inside), F.lit(0)).alias(f"_{w}_local")
                                 for w in weights])
    joined = join_groups(local, offsets, [*groups, "_piece"])
    return joined.select(
        *counted.columns,
        *[(F.col(f"_{w}_local") + F.col(f"_{w}_offset")).alias(f"{w}_before") for w in weights],
        *[F.col(f"{w}_total") for w in weights])


def _long(df: DataFrame, groups: Sequence[str], values: Mapping[str, Column],
          count: Column | None = None) -> DataFrame:
    """One row per (group, column, value) with its count, missing values left out."""
    count = F.lit(1) if count is None else count
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("column"), c.cast("double").alias("value"))
                                for n, c in values.items()])).alias("cell")
    return (df.select(*groups, count.cast("bigint").alias("n"), cells)
            .select(*groups, "n", "cell.column", "cell.value").where(F.col("value").isNotNull())
            .groupBy(*groups, "column", "value").agg(F.sum("n").alias("n")))


def _pick(name: str, rank: Column) -> Column:
    """The value of column ``name`` at a 0-based rank."""
    here = (F.col("column") == name) & (F.col("n_before") <= rank) & (rank < F.col("n_before") + F.col("n"))
    return F.max(F.when(here, F.col("value")))


def values_at(df: DataFrame, groups: Sequence[str], values: Mapping[str, Column],
              ranks: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """Per group, the values at given 0-based ranks; a rank is a function of the group's count.

    The result has columns ``<name>_<rank name>``.
    """
    ranked = running_sums(_long(df, groups, values), [*groups, "column"], "value", ["n"])
    picked = [_pick(name, rank(F.col("n_total"))).alias(f"{name}_{label}")
              for name in values for label, rank in ranks.items()]
    return ranked.groupBy(*groups).agg(*picked)


def quantiles(df: DataFrame, groups: Sequence[str], values: Mapping[str, Column],
              probabilities: Mapping[str, float]) -> DataFrame:
    """Exact quantiles, linearly interpolated between neighbours; ``<name>_<label>`` per column.

    A group whose values are all missing in every column has no row.
    """
    return counted_quantiles(df, groups, values, probabilities, F.lit(1))


def counted_quantiles(df: DataFrame, groups: Sequence[str], values: Mapping[str, Column],
                      probabilities: Mapping[str, float], count: Column) -> DataFrame:
    """``quantiles`` of rows that each stand for ``count`` equal ones."""
    ranked = running_sums(_long(df, groups, values, count), [*groups, "column"], "value", ["n"])
    total = F.col("n_total")
    parts, finals = [], []
    for name in values:
        parts.append(F.max(F.when(F.col("column") == name, total)).alias(f"_{name}_n"))
        for label, q in probabilities.items():
            spot = (total - 1) * F.lit(float(q))
            parts.append(_pick(name, F.floor(spot)).alias(f"_{name}_{label}_low"))
            parts.append(_pick(name, F.ceil(spot)).alias(f"_{name}_{label}_high"))
            low, high = F.col(f"_{name}_{label}_low"), F.col(f"_{name}_{label}_high")
            spot_out = (F.col(f"_{name}_n") - 1) * F.lit(float(q))
            finals.append((low + (high - low) * (spot_out - F.floor(spot_out))).alias(f"{name}_{label}"))
    return ranked.groupBy(*groups).agg(*parts).select(*groups, *finals)


def nearest_ranks() -> dict[str, Callable[[Column], Column]]:
    """Ranks of the median and the 95th percentile without interpolation."""
    return {"p50": lambda n: F.floor(n / 2),
            "p95": lambda n: F.least(n - 1, F.floor(n * F.lit(0.95)))}
