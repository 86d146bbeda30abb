"""Continuous scoring, log append, hourly reports and retry-safe intake.

Every job takes what its source has now and stops; started again with the same folders it goes on where
it stopped. Outputs and checkpoints live in the shared folder, so another machine can take over.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditmill.contract.schema import KEY
from creditmill.functions.names import col
from creditmill.operators.lookup import rows_for
from creditmill.operators.ordered import counted_quantiles
from creditmill.plans.prediction_log import HALVES, OK_STATUS
from creditmill.plans.scoring import assemble
from creditmill.sources.log_store import DAY, with_defaults

WATERMARK = "1 hour"


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet",
                files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def _run(writer, checkpoint: str) -> None:
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def append_to(stream: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Append to a parquet table exactly once."""
    writer = stream.writeStream.format("parquet").option("path", path).outputMode("append")
    _run(writer.partitionBy(*partition_by) if partition_by else writer, f"{path}_checkpoint")


def score_stream(requests: DataFrame, store: DataFrame, respond: Callable[[DataFrame], DataFrame], path: str,
                 contract: Sequence[str] | None = None, request_id: str = "SK_ID_CURR") -> None:
    """Score requests as they come, with the same plan as a batch.

    A batch that is tried again overwrites its own folder, so no request is scored into the table twice. Of a store
    bucketed by client, a batch reads the buckets of its own clients.
    """
    def score(batch: DataFrame, number: int) -> None:
        known = rows_for(store, batch, KEY)
        out = respond(assemble(batch, known, contract, request_id=request_id))
        out.write.mode("overwrite").parquet(f"{path}/batch={number}")

    _run(requests.writeStream.foreachBatch(score), f"{path}_checkpoint")


def append_log_stream(calls: DataFrame, path: str) -> None:
    append_to(with_defaults(calls).withColumn(DAY, F.to_date("timestamp")), path, [DAY])


def hourly_counts(calls: DataFrame) -> DataFrame:
    """Calls per hour and latency value, emitted once the hour is closed.

    The state holds one row per hour and distinct millisecond, so a busy hour is spread over all tasks
    and no task holds an hour's values.
    """
    hour = F.window("timestamp", "1 hour")
    return (calls.withWatermark("timestamp", WATERMARK).groupBy(hour, "latency_ms")
            .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status_code") != OK_STATUS).alias("errors"))
            .select(F.col("window.start").alias("hour"), "latency_ms", "n", "errors"))


def open_hours(log: DataFrame, closed: DataFrame) -> DataFrame:
    """Counts like those of ``hourly_counts`` for the hours after the last closed one, from the log.

    Hours close in order, so no later hour is in ``closed``; while none is closed, all are open. A log with days is
    read from the day of the last closed hour on.
    """
    last = closed.agg(F.max("hour")).scalar()
    rows = log.where(last.isNull() | (F.col(DAY) >= F.to_date(last))) if DAY in log.columns else log
    rows = rows.where(last.isNull() | (F.col("timestamp") >= last + F.expr("INTERVAL 1 HOUR")))
    return (rows.groupBy(F.date_trunc("hour", F.col("timestamp")).alias("hour"), "latency_ms")
            .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status_code") != OK_STATUS).alias("errors")))


def refresh_hourly(calls: DataFrame, log: DataFrame, path: str) -> DataFrame:
    """Close the hours that the calls so far allow, then report all hours; run again at each refresh.

    ``path`` keeps the counts of closed hours, ``log`` is the table that ``append_log_stream`` fills from the same
    calls. A call that comes after its hour was closed is not in the report.
    """
    counts = hourly_counts(calls)
    append_to(counts, path)
    closed = calls.sparkSession.read.schema(counts.schema).parquet(path)
    return hourly_report(closed.unionByName(open_hours(log, closed)))


def hourly_report(counts: DataFrame) -> DataFrame:
    """The hourly report from counts such as those of ``hourly_counts``."""
    totals = counts.groupBy("hour").agg(F.sum("n").alias("total"), F.sum("errors").alias("errors"))
    spread = counted_quantiles(counts, ["hour"], {"latency": col("latency_ms")}, HALVES, F.col("n"))
    return (totals.join(spread, "hour", "left")
            .withColumnsRenamed({"latency_p50": "p50", "latency_p95": "p95"}))


def without_retries(calls: DataFrame, key: str, watermark: str = WATERMARK) -> DataFrame:
    """Keep the first of the rows a client sent again within the watermark."""
    return calls.withWatermark("timestamp", watermark).dropDuplicatesWithinWatermark([key])
