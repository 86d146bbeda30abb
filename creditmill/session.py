"""Session defaults and the shared folder that jobs write intermediate tables to."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_LOCAL_ROOTS: dict[str, str] = {}
_SCOPE = threading.local()


def build_session(app_name: str = "creditmill", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster use the session you are given."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )


def tune(spark: SparkSession) -> SparkSession:
    """Session settings the jobs rely on, for sessions built elsewhere."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # the JVM never compiles larger methods, and interpreted a wide projection takes several times as long
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session may go without that setting; it then gets a temporary folder,
    because its driver and executors share one machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    app = context.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="creditmill-")
    return _LOCAL_ROOTS[app]


def new_table_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; every call gives another one."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    if getattr(_SCOPE, "paths", None) is not None:
        _SCOPE.paths.append(path)
    return path


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table written to a path of ``new_table_path``; one that is not there is no error."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Tables whose paths this thread takes within the block are deleted at its end.

    What is read from them must be written elsewhere before, under a path taken outside. After an error they stay.
    """
    outer, _SCOPE.paths = getattr(_SCOPE, "paths", None), []
    try:
        yield
        for path in _SCOPE.paths:
            drop_table(spark, path)
    finally:
        _SCOPE.paths = outer


@contextmanager
def small_reads(spark: SparkSession, most: int) -> Iterator[None]:
    """Scans planned within the block give a task at most ``most`` bytes of files, or one row group that is larger."""
    setting = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(most))
    try:
        yield
    finally:
        spark.conf.set(setting, before)


@contextmanager
def joins_in_place(spark: SparkSession) -> Iterator[None]:
    """Joins run within the block leave sides where they lie that are placed alike by some of the keys of the join.

    Spark moves them otherwise, because few values of those keys may hold most rows; only for tables known to be even.
    """
    setting = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def cut_lineage(df, name: str, file_rows: int = 0):
    """Write ``df`` to the shared folder and read it back, so later stages survive executor loss.

    ``file_rows`` bounds the rows of a file; 0 leaves it to the tasks.
    """
    path = new_table_path(df.sparkSession, name)
    df.write.mode("overwrite").option("maxRecordsPerFile", file_rows).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
