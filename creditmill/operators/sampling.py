"""Seeded, exact-size sampling. Rows are ordered by the md5 of their key, never by partition.

Every function needs a key that is unique per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from creditmill.functions.hashing import digest, uniform
from creditmill.functions.names import col
from creditmill.operators.lookup import join_groups

_BUCKET_DIGITS = 3  # 16**3 hash buckets per stratum, all of about the same size
BROADCAST_KEYS = 1_000_000  # a sample of at most this many keys is joined back by broadcast


def _bucketed(df: DataFrame, key: str, seed: int) -> DataFrame:
    return (df.withColumn("_digest", digest(seed, col(key)))
            .withColumn("_bucket", F.substring("_digest", 1, _BUCKET_DIGITS)))


def _bucket_starts(bucketed: DataFrame, strata: Sequence[str]) -> DataFrame:
    """Rows of the stratum before each bucket, and in the whole stratum."""
    sizes = bucketed.groupBy(*strata, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    per = Window.partitionBy(*(strata or [F.lit(0)]))
    before = per.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(*strata, "_bucket", "_size",
                        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"),
                        F.sum("_size").over(per).alias("_stratum_size"))


def hash_rank(df: DataFrame, key: str, seed: int, strata: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """Add the exact 0-based rank of each row in md5 order within its stratum.

    A stratum is ranked bucket by bucket, so a stratum with half of all rows is still spread evenly.
    """
    strata = list(strata)
    bucketed = _bucketed(df, key, seed)
    starts = _bucket_starts(bucketed, strata).drop("_size", "_stratum_size")
    inside = Window.partitionBy(*strata, "_bucket").orderBy("_digest", col(key))
    numbered = bucketed.withColumn("_row", F.row_number().over(inside))
    return (join_groups(numbered, starts, [*strata, "_bucket"])
            .withColumn(name, F.col("_start") + F.col("_row") - 1)
            .select(*df.columns, name))


def stratified_folds(df: DataFrame, key: str, label: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """Add ``fold``: every fold has the same label mix, up to one row per label."""
    ranked = hash_rank(df, key, seed, [label], "_rank")
    return ranked.withColumn("fold", (F.col("_rank") % folds).cast("int")).drop("_rank")


def holdout_split(df: DataFrame, key: str, test_share: float = 0.2, seed: int = 78) -> DataFrame:
    """Add ``is_test``; not stratified, and stable when rows are added or repartitioned."""
    return df.withColumn("is_test", uniform(seed, col(key)) < test_share)


def uniform_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows without replacement, in random order; each task keeps only its ``n`` best rows."""
    return df.orderBy(digest(seed, col(key)), col(key)).limit(n)


def allocation(sizes: DataFrame, stratum: str, n: int) -> DataFrame:
    """Rows to take per stratum by largest remainder. ``sizes`` has one row per label value."""
    everything = Window.partitionBy(F.lit(0))
    by_remainder = everything.orderBy(F.desc("_remainder"), col(stratum))
    total = F.sum("_stratum_size").over(everything)
    goal = F.least(F.lit(n), total)
    # integers throughout: n * size may be large, its quotient and remainder are exact
    scaled = F.col("_stratum_size") * F.col("_goal")
    return (sizes.withColumn("_total", total).withColumn("_goal", goal)
            .withColumn("_base", F.expr("(_stratum_size * _goal) div _total"))
            .withColumn("_remainder", scaled % F.col("_total"))
            .withColumn("_short", F.col("_goal") - F.sum("_base").over(everything))
            .withColumn("_take", F.col("_base")
                        + F.when(F.row_number().over(by_remainder) <= F.col("_short"), 1).otherwise(0))
            .select(stratum, "_take"))


def stratified_sample(df: DataFrame, key: str, stratum: str, n: int, seed: int) -> DataFrame:
    """Exactly ``min(n, rows)`` rows with the label mix of the whole table.

    Keys are picked on a two-column projection; the wide rows are only filtered by the picked keys.
    """
    narrow = _bucketed(df.select(key, stratum), key, seed)
    starts = _bucket_starts(narrow, [stratum])
    quota = allocation(starts.groupBy(stratum).agg(F.max("_stratum_size").alias("_stratum_size")), stratum, n)
    # buckets past the quota hold no sampled row
    needed = join_groups(starts, quota, [stratum]).where(F.col("_start") < F.col("_take"))
    inside = Window.partitionBy(stratum, "_bucket").orderBy("_digest", col(key))
    picked = (join_groups(narrow, needed, [stratum, "_bucket"])
              .withColumn("_rank", F.col("_start") + F.row_number().over(inside))
              .where(F.col("_rank") <= F.col("_take")).select(key))
    return df.join(F.broadcast(picked) if n <= BROADCAST_KEYS else picked, key, "left_semi")


def sample_with_replacement(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` independent draws; adds ``draw`` (0..n-1). A row may come back several times."""
    rows = hash_rank(df, key, seed, name="_index")
    size = df.agg(F.count(F.lit(1))).scalar()
    draws = (df.sparkSession.range(n).withColumnRenamed("id", "draw")
             .withColumn("_index", F.floor(uniform(f"{seed}d", F.col("draw")) * size).cast("bigint")))
    return draws.join(rows, "_index").drop("_index")
