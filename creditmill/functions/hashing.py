"""Seeded, engine-independent pseudo-random numbers derived from a row's key.

``rand()`` depends on partitioning and changes when a task is retried; md5 of the key does not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HEX_DIGITS = 8


def digest(seed: int | str, *parts: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def hash_int(seed: int | str, *parts: Column) -> Column:
    """Uniform integer in [0, 2**32)."""
    return F.conv(F.substring(digest(seed, *parts), 1, _HEX_DIGITS), 16, 10).cast("bigint")


def uniform(seed: int | str, *parts: Column) -> Column:
    """Uniform double in [0, 1)."""
    return hash_int(seed, *parts) / F.lit(float(16**_HEX_DIGITS))
