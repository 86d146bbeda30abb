"""Fixed-bin histograms and the frozen snapshot of a score distribution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditmill.operators.ordered import quantiles
from creditmill.operators.sampling import uniform_sample

BINS = 40  # fixed value
SNAPSHOT_VALUES = 5000  # fixed value: most values a snapshot keeps


def bin_of(value: Column, bins: int = BINS, low: float = 0.0, high: float = 1.0) -> Column:
    """1-based bin; the last bin also holds ``high``; values outside are missing."""
    inside = (value >= low) & (value <= high)
    return F.when(inside, F.least(F.width_bucket(value, F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins)))


def histogram(df: DataFrame, value: Column, by: Sequence[str] = (), bins: int = BINS) -> DataFrame:
    """(by..., bin, low, high, count, density); bins without values are listed with 0."""
    by = list(by)
    counted = (df.select(*by, bin_of(value, bins).alias("bin")).where(F.col("bin").isNotNull())
               .groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("count")))
    # few rows from here on: at most ``bins`` per group
    filled = F.transform(F.sequence(F.lit(1), F.lit(bins)), lambda b: F.struct(
        b.cast("bigint").alias("bin"),
        F.coalesce(F.try_element_at("_counts", b.cast("bigint")), F.lit(0)).alias("count")))
    grouped = counted.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("bin").cast("bigint"), "count"))).alias("_counts"),
        F.sum("count").alias("_total"))
    return grouped.select(*by, "_total", F.inline(filled)).select(
        *by, "bin", ((F.col("bin") - 1) / bins).alias("low"), (F.col("bin") / bins).alias("high"),
        "count", (F.col("count") / F.col("_total")).alias("density"))


def score_snapshot(scored: DataFrame, key: str, score: str, seed: int = 42, bins: int = BINS,
                   values: int = SNAPSHOT_VALUES) -> DataFrame:
    """One row (n, mean, median, p95, bins, counts, values) to compare later scores with.

    The arrays have fixed maximum lengths: bins + 1, bins and ``values``.
    """
    rows = scored.where(F.col(score).isNotNull()).withColumn("_all", F.lit(1))
    base = rows.groupBy("_all").agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean"))
    spread = (quantiles(rows, ["_all"], {"s": F.col(score)}, {"median": 0.5, "p95": 0.95})
              .withColumnsRenamed({"s_median": "median", "s_p95": "p95"}))
    counts = (histogram(rows, F.col(score), ["_all"], bins).groupBy("_all")
              .agg(F.sort_array(F.collect_list(F.struct("bin", "count"))).alias("_c"))
              .select("_all", F.col("_c.count").alias("counts")))
    sampled = (uniform_sample(rows.select("_all", key, score), key, values, seed)
               .groupBy("_all").agg(F.sort_array(F.collect_list(score)).alias("values")))
    edges = F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda b: b / F.lit(bins))
    return (base.join(spread, "_all").join(counts, "_all").join(sampled, "_all")
            .select("n", "mean", "median", "p95", edges.alias("bins"), "counts", "values"))
