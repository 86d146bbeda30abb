"""Streaming jobs over the test tables, compared with the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditmill.checks.joins import MODEL, saved_store
from creditmill.checks.registry import SQL, query
from creditmill.checks.roles import ROLES, table, with_roles
from creditmill.contract.features import feature_names
from creditmill.plans import scoring as SC
from creditmill.session import new_table_path
from creditmill.sources import log_store as LS
from creditmill.streaming import jobs as J


def stream(spark, sf, relation, name):
    """A role over the stream of a test table's file."""
    schema = table(spark, sf, relation).schema
    rows = J.file_stream(spark, sf, schema, f"{relation}.parquet")
    out = rows.selectExpr(*[f"{sql} AS `{column}`" for column, sql in ROLES[name][1]])
    return out.withColumn("timestamp", F.col("timestamp").cast("timestamp")) if "timestamp" in out.columns else out


def log_stream(spark, sf):
    return stream(spark, sf, "events", "prediction_log")


def stream_score(spark, sf):
    out = new_table_path(spark, "scores")
    J.score_stream(stream(spark, sf, "customer", "request"), saved_store(spark, sf),
                   lambda rows: SC.respond(rows, SC.income_credit_score(), MODEL, feature_names()), out)
    return spark.read.parquet(out).drop("batch")


query("stream_score", SQL["score_batch"], ["probability_default", *feature_names()])(stream_score)


@query("stream_log", with_roles("""SELECT id, timestamp, sk_id_curr, latency_ms, status_code, decision,
    probability_default FROM prediction_log""", "prediction_log"))
def stream_log(spark, sf):
    path = new_table_path(spark, "log_stream")
    J.append_log_stream(log_stream(spark, sf), path)
    return LS.read_log(spark, path).select(
        "id", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "sk_id_curr", "latency_ms",
        "status_code", "decision", "probability_default")


@query("stream_hourly", with_roles("""SELECT date_trunc('hour', timestamp) AS hour, count(*) AS total,
    count(*) FILTER (WHERE status_code <> 200) AS errors, quantile_cont(latency_ms, 0.5) AS p50,
    quantile_cont(latency_ms, 0.95) AS p95 FROM prediction_log GROUP BY 1""", "prediction_log"), ["p50", "p95"])
def stream_hourly(spark, sf):
    # the stream closes hours that the watermark has passed, the log gives the open ones
    log_path, path = new_table_path(spark, "log"), new_table_path(spark, "hourly")
    J.append_log_stream(log_stream(spark, sf), log_path)
    report = J.refresh_hourly(log_stream(spark, sf), LS.read_log(spark, log_path), path)
    return report.withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query("stream_dedup", with_roles("SELECT id, sk_id_curr, latency_ms FROM prediction_log", "prediction_log"))
def stream_dedup(spark, sf):
    # every call arrives twice
    path = new_table_path(spark, "intake")
    twice = log_stream(spark, sf).union(log_stream(spark, sf))
    J.append_to(J.without_retries(twice, "id").select("id", "sk_id_curr", "latency_ms"), path)
    return spark.read.parquet(path)
