"""The append-only prediction log as a date-partitioned table."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditmill.contract.schema import PREDICTION_LOG
from creditmill.functions.missing import round_half_even
from creditmill.functions.names import col
from creditmill.session import cut_lineage, passing_tables

DAY = "log_date"
FILE_BYTES = 256 << 20
CODEC = "zstd"


def with_defaults(rows: DataFrame) -> DataFrame:
    """All log columns in order; absent ones get their default: a fresh id, now, status 200, else NULL."""
    defaults = {"id": F.expr("uuid()"), "timestamp": F.current_timestamp(), "status_code": F.lit(200)}
    have = set(rows.columns)

    def column(field) -> Column:
        default = defaults.get(field.name, F.lit(None)).cast(field.dataType)
        if field.name not in have:
            return default.alias(field.name)
        value = col(field.name).cast(field.dataType)
        return (F.coalesce(value, default) if field.name in defaults else value).alias(field.name)

    return rows.select(*[column(f) for f in PREDICTION_LOG.fields])


def append_log(rows: DataFrame, path: str) -> None:
    """Append log rows, one folder per day, so trailing-window reads skip old days.

    Nearly all of a log is JSON with the same names in every row, which Zstandard makes far smaller than Snappy.
    """
    (with_defaults(rows).withColumn(DAY, F.to_date("timestamp"))
     .write.mode("append").option("compression", CODEC).partitionBy(DAY).parquet(path))


def create_log(spark: SparkSession, path: str, truncate: bool = False) -> None:
    """Create an empty log if there is none; ``truncate`` empties an existing one."""
    empty = spark.createDataFrame([], PREDICTION_LOG).withColumn(DAY, F.lit(None).cast("date"))
    empty.write.mode("overwrite" if truncate else "ignore").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log with its day, by which trailing windows leave out whole folders."""
    return spark.read.parquet(path)


def latest_versions(versions: DataFrame, key: str, version: str) -> DataFrame:
    """One row per key, the one with the highest version; of equal versions the one with the largest row hash.

    An aggregate, not a row number: versions of a key written very often are reduced before the shuffle.
    """
    order = F.struct(col(version), F.xxhash64(*[col(c) for c in versions.columns]))
    newest = F.max_by(F.struct(*[col(c) for c in versions.columns]), order).alias("row")
    return versions.groupBy(key).agg(newest).select("row.*")


def evolve(old: DataFrame, new: DataFrame, to_int: list[str]) -> DataFrame:
    """Old rows gain the new nullable columns; double milliseconds become integers, half to even."""
    kinds = dict(old.dtypes)
    converted = old.select(*[round_half_even(col(c)).alias(c) if c in to_int and kinds[c] == "double" else col(c)
                             for c in old.columns])
    return converted.unionByName(new, allowMissingColumns=True)


def versioned_update(base: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The next version of the rows that ``updates`` (unique on ``key``) names, with ``columns`` replaced."""
    renamed = updates.select(col(key), *[col(c).alias(f"_new_{c}") for c in columns])
    joined = base.join(renamed, key)
    return joined.select(*[col(f"_new_{c}").alias(c) if c in columns else col(c) for c in base.columns])


# --- changes in place, day by day ---------------------------------------------------------------------
def rewrite_days(rows: DataFrame, path: str) -> None:
    """Replace the day folders that ``rows`` have, and no other.

    Tasks write beside the log and the folders are exchanged when all have ended, so ``rows`` may come from the
    log itself and a lost executor or a failed job leaves the log as it was.
    """
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", CODEC)
     .partitionBy(DAY).parquet(path))


def touched_days(log: DataFrame, updates: DataFrame, key: str) -> list[dt.date]:
    """The days with a row that ``updates`` names. Of the log only the keys are read, of the updates' days if they have them."""
    known = [key, DAY] if DAY in updates.columns else [key]
    days = log.join(updates.select(*known), known, "left_semi").select(DAY).distinct()
    return sorted(r[0] for r in days.collect())


def update_log(updates: DataFrame, path: str, key: str, columns: Sequence[str], version: str) -> list[dt.date]:
    """Set ``columns`` of the log rows that ``updates`` names by ``key``; the days rewritten.

    Of several updates of a key the one with the highest ``version`` counts, also where it sets NULL. A key the log does
    not have changes nothing. Only days with such a row are read as a whole and rewritten; the same update again
    gives the same log.
    """
    spark = updates.sparkSession
    names = [key, version, *([DAY] if DAY in updates.columns else []), *columns]
    with passing_tables(spark):
        newest = cut_lineage(latest_versions(updates.select(*[col(c) for c in names]), key, version), "updates")
        log = read_log(spark, path)
        days = touched_days(log, newest, key)
        if days:
            new = newest.select(key, F.struct(*[col(c) for c in columns]).alias("_new"))
            met = log.where(F.col(DAY).isin(days)).join(new, key, "left")
            changed = met.select(*[
                F.when(F.col("_new").isNotNull(), F.col("_new")[c].cast(log.schema[c].dataType)).otherwise(col(c)).alias(c)
                if c in columns else col(c) for c in log.columns])
            rewrite_days(changed.hint("rebalance", DAY), path)
    return days


def compact_log(spark: SparkSession, path: str, key: str = "id", file_bytes: int = FILE_BYTES) -> list[dt.date]:
    """Join the many small files of days that appends have left into files of about ``file_bytes``; the days rewritten.

    A day is rewritten if it has more files than its bytes need, so a second call finds nothing to do.
    """
    log = read_log(spark, path)
    files = log.select(DAY, "_metadata.file_path", "_metadata.file_size").distinct()
    pieces = F.ceil(F.sum("file_size") / file_bytes)
    scattered = (files.groupBy(DAY).agg(pieces.cast("int").alias("pieces"), F.count(F.lit(1)).alias("files"))
                 .where("files > pieces").orderBy(DAY).collect())  # a row per day
    if scattered:
        days = spark.createDataFrame([(r[DAY], r.pieces) for r in scattered], f"{DAY} date, _pieces int")
        placed = (log.where(F.col(DAY).isin([r[DAY] for r in scattered])).join(F.broadcast(days), DAY)
                  .repartition(DAY, F.pmod(F.xxhash64(col(key)), F.col("_pieces"))).select(*log.columns))
        rewrite_days(placed, path)
    return [r[DAY] for r in scattered]


def evolve_log(spark: SparkSession, path: str, to_int: list[str], until: dt.date) -> list[dt.date]:
    """Give the days before ``until``, written with an older schema, the present columns; the days rewritten.

    Missing columns become NULL and double milliseconds integers. Later days are neither read nor rewritten.
    """
    days = [day for day in log_days(spark, path) if day < until]
    if days:
        old = spark.read.option("basePath", path).parquet(*[f"{path}/{DAY}={day}" for day in days])
        present = spark.createDataFrame([], PREDICTION_LOG)
        evolved = evolve(old, present, to_int)
        typed = evolved.select(*[col(f.name).cast(f.dataType).alias(f.name) for f in PREDICTION_LOG.fields], DAY)
        rewrite_days(typed.hint("rebalance", DAY), path)
    return days


def log_days(spark: SparkSession, path: str) -> list[dt.date]:
    """The days the log has a folder for."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed = place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)
    names = [entry.getPath().getName() for entry in listed]
    return sorted(dt.date.fromisoformat(n.split("=")[1]) for n in names if n.startswith(f"{DAY}=") and n[-1].isdigit())
