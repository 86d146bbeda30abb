"""Feature store, training matrix and their joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditmill.contract.features import feature_names
from creditmill.contract.schema import KEY, LABEL
from creditmill.functions.names import col
from creditmill.operators.align import align, beside
from creditmill.operators.encode import application_matrix
from creditmill.plans.families import all_families


def merge_families(families: list[DataFrame]) -> DataFrame:
    """Families side by side, one row per client of any of them; equal to a chain of full outer joins.

    Each family is one column of structs, their rows are stacked and meet again by client. The families come out of
    their roll-ups placed by client, and a union keeps a placement its inputs share, so stacking and meeting need no
    shuffle, and no second scan lists the clients. A family has one row per client: a client meets at most as many rows
    as there are families.
    """
    packed = [family.select(col(KEY).alias(KEY), F.struct(*[col(c) for c in family.columns if c != KEY]).alias(f"_family{i}"))
              for i, family in enumerate(families)]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), packed)
    names = [f"_family{i}" for i in range(len(families))]
    met = stacked.groupBy(KEY).agg(*[F.first(n, ignorenulls=True).alias(n) for n in names])
    return met.select(KEY, *[F.col(f"{n}.*") for n in names])


def feature_store(tables: dict[str, DataFrame], buckets: int | None = None) -> DataFrame:
    """The five families side by side, one row per client of any of them; every table is scanned once."""
    return merge_families(all_families(tables, buckets))


def full_outer_store(families: list[DataFrame]) -> DataFrame:
    """The same rows from families that are already tables; those in equal buckets by client are not shuffled.

    A chain of full joins would shuffle all but the first, because a key out of a full join is placed by neither side.
    """
    return merge_families(families)


def training_matrix(app: DataFrame, tables: dict[str, DataFrame], buckets: int | None = None) -> DataFrame:
    """Key, label and all contract features for every application.

    The families meet as in the store and the applications meet them once: a join for each family would sort and copy
    ever wider rows five times.
    """
    joined = beside(application_matrix(app), feature_store(tables, buckets), KEY)
    return align(joined, feature_names(), keep=[KEY, LABEL])


def reference_rows(app: DataFrame, store: DataFrame) -> DataFrame:
    """Applications that have a store row, in contract shape."""
    return align(beside(application_matrix(app), store, KEY, "inner"), feature_names(), keep=[KEY, LABEL])


def dropped_applications(app: DataFrame, store: DataFrame) -> DataFrame:
    """How many applications have no store row; one row (applications, joined, dropped)."""
    flagged = application_matrix(app).select(KEY).join(
        store.select(KEY, F.lit(True).alias("_known")), KEY, "left")
    known = F.count_if(F.col("_known"))
    return flagged.agg(F.count(F.lit(1)).alias("applications"), known.alias("joined"),
                       (F.count(F.lit(1)) - known).alias("dropped"))
