"""Input tables, feature-store tables and small JSON artefacts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditmill.contract.schema import INPUT_TABLES, KEY
from creditmill.functions.missing import nan_to_null
from creditmill.functions.names import col

DEBUG_ROWS = 30000  # fixed value: rows read per table in debug mode
LEAST_BUCKETS = 8
#: Clients of a bucket; a store row takes about 4 KB in memory.
KEYS_PER_BUCKET = 10_000
#: Rows of one key that a single task may always take.
LARGE_KEY_ROWS = 100_000


def without_nan(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating-point column, so it never reaches an aggregate."""
    return df.select(*[nan_to_null(col(n)).alias(n) if t in ("double", "float") else col(n)
                       for n, t in df.dtypes])


def read_csv(spark: SparkSession, path: str, schema: T.StructType, limit: int | None = None) -> DataFrame:
    """CSV with header; the columns of ``schema`` by name, in any order and among others; empty cells are missing.

    The header names the file's columns: known ones get their type, others are read as text and left out. ``limit``
    takes the first rows by the leading column, so every run reads the same ones.
    """
    header = spark.read.option("header", True).option("inferSchema", False).csv(path).columns
    known = {f.name: f for f in schema.fields}
    absent = [n for n in known if n not in header]
    if absent:
        raise ValueError(f"{path} has no column {', '.join(absent)}")
    found = T.StructType([T.StructField(n, known[n].dataType if n in known else T.StringType()) for n in header])
    df = without_nan(spark.read.schema(found).option("header", True).csv(path).select(*[col(n) for n in known]))
    return df if limit is None else first_rows(df, limit, schema.names[0])


def first_rows(df: DataFrame, n: int, order: str) -> DataFrame:
    """The ``n`` first rows by a key; unlike a plain limit it gives the same rows every time."""
    return df.orderBy(col(order)).limit(n)


def read_input(spark: SparkSession, folder: str, debug: bool = False) -> dict[str, DataFrame]:
    """The seven credit CSV files."""
    limit = DEBUG_ROWS if debug else None
    return {name: read_csv(spark, f"{folder}/{name}.csv", schema, limit) for name, schema in INPUT_TABLES.items()}


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return without_nan(spark.read.parquet(path))


def write_parquet(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    writer = df.write.mode("overwrite").option("compression", "snappy")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def buckets_by(df: DataFrame, key: str) -> tuple[int, bool]:
    """How many buckets by ``key`` suit ``df``, and whether they come out even.

    The number grows with the different keys. Buckets are uneven if one key has more rows than a bucket has on average,
    and more than a task handles with ease.
    """
    counts = df.where(col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    keys, rows, most = counts.agg(F.count(F.lit(1)), F.sum("n"), F.max("n")).first()
    buckets = max(LEAST_BUCKETS, -(-keys // KEYS_PER_BUCKET))
    return buckets, (most or 0) <= max(LARGE_KEY_ROWS, (rows or 0) / buckets)


def save_bucketed(df: DataFrame, table: str, buckets: int, key: str = KEY, path: str | None = None) -> None:
    """Bucket and sort by client, so joins between such tables need no shuffle and few clients are read from few files.

    ``path`` puts the files elsewhere than the warehouse.
    """
    writer = df.repartition(buckets, col(key)).write.mode("overwrite").option("compression", "snappy")
    (writer.option("path", path) if path else writer).bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def write_artefact(spark: SparkSession, value, path: str) -> None:
    """A small JSON document (contract, vocabulary, codes, template, snapshot) as one text file."""
    line = spark.createDataFrame([(json.dumps(value),)], "value string")
    line.coalesce(1).write.mode("overwrite").text(path)


def read_artefact(spark: SparkSession, path: str):
    return json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def to_payload(df: DataFrame, columns: list[str], integers: list[str]) -> DataFrame:
    """One JSON document per row: schema columns only, NaN as null, integer fields as integers."""
    whole = set(integers)
    kinds = dict(df.dtypes)
    fields = []
    for c in columns:
        value = col(c)
        if kinds[c] in ("double", "float"):
            value = nan_to_null(value)
        fields.append((value.cast("bigint") if c in whole else value).alias(c))
    return df.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("payload"))
