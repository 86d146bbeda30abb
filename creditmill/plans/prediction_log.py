"""Prediction-log rows and the reports over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditmill.functions.missing import finite_sql, round_half_even
from creditmill.functions.names import col, quoted
from creditmill.operators.ordered import quantiles

# --- fixed values ---------------------------------------------------------------------------
RECENT_ROWS = 5000
LAST_CALLS = 50
KEEP_ALIVE_CLIENT = 282751
BORDERLINE = (0.325, 0.335)
OK_STATUS = 200
REPORT_TIMINGS = {  # report name -> log column
    "": "latency_ms", "asm_": "feature_assembly_ms", "inf_": "inference_ms",
    "inf_cpu_": "inference_cpu_ms", "db_log_": "db_log_ms", "plumbing_": "plumbing_ms",
}
HALVES = {"p50": 0.5, "p95": 0.95}
CALL_COLUMNS = ["timestamp", "sk_id_curr", "client_known", "probability_default", "decision", "latency_ms",
                "model_version"]
RECENT_COLUMNS = ["timestamp", "sk_id_curr", "client_known", "latency_ms", "status_code", "error_message",
                  "probability_default", "decision", "threshold", "model_version", "features"]
COMPONENTS = {
    "feature_assembly_p50": "Feature assembly",
    "inference_p50": "Model inference",
    "plumbing_p50": "Plumbing",
    "db_log_p50": "DB log",
}


# --- rows -----------------------------------------------------------------------------------
def features_json(columns: Sequence[str]) -> Column:
    """All features as one JSON object; NaN and infinities are null, nulls are kept."""
    fields = ", ".join(f"{finite_sql(quoted(c))} AS {quoted(c)}" for c in columns)
    return F.expr(f"to_json(struct({fields}), map('ignoreNullFields', 'false'))")


def expand_features(df: DataFrame, names: Sequence[str], column: str = "features") -> DataFrame:
    """JSON object to one double column per name; names that are absent give NULL."""
    parsed = df.withColumn("_map", F.from_json(col(column), "MAP<STRING, DOUBLE>"))
    return parsed.select(*[col(c) for c in df.columns if c != column],
                         *[F.try_element_at("_map", F.lit(n)).alias(n) for n in names])


def log_rows(calls: DataFrame) -> DataFrame:
    """Shape finished calls for the log.

    Measured durations are rounded half to even; a failed call has decision ERROR, an empty feature
    object, no probability and no breakdown. Plumbing is what the two timed steps leave over, not below 0.
    """
    failed = F.col("status_code") != OK_STATUS
    latency = round_half_even(F.col("latency"))
    assembly, inference = round_half_even(F.col("feature_assembly")), round_half_even(F.col("inference"))
    both = assembly.isNotNull() & inference.isNotNull()
    return calls.select(
        "id", "timestamp", "sk_id_curr", "client_known",
        latency.alias("latency_ms"),
        assembly.alias("feature_assembly_ms"),
        inference.alias("inference_ms"),
        F.when(both, F.greatest(F.lit(0), latency - assembly - inference)).alias("plumbing_ms"),
        "status_code", "error_message",
        F.when(failed | F.col("features").isNull(), "{}").otherwise(F.col("features")).alias("features"),
        F.when(~failed, F.col("probability_default")).alias("probability_default"),
        F.when(failed, "ERROR").otherwise(F.coalesce(F.col("decision"), F.lit("ERROR"))).alias("decision"),
        "threshold", "model_version")


# --- windows and samples of the log -----------------------------------------------------------
def since(log: DataFrame, hours: int, now: Column | None = None) -> DataFrame:
    """Rows of the trailing window; a log with days is read from the first day of the window on."""
    now = F.current_timestamp() if now is None else now
    start = now - F.expr(f"INTERVAL {int(hours)} HOURS")
    rows = log.where(F.col("log_date") >= F.to_date(start)) if "log_date" in log.columns else log
    return rows.where(F.col("timestamp") >= start)


def newest(log: DataFrame) -> DataFrame:
    return log.orderBy(F.desc("timestamp"), "id")


def successful(log: DataFrame) -> DataFrame:
    return log.where(F.col("status_code") == OK_STATUS)


def recent(log: DataFrame, hours: int, now: Column | None = None, limit: int = RECENT_ROWS) -> DataFrame:
    """Newest rows of the trailing window, capped; the cap is what this report is."""
    return newest(since(log, hours, now)).limit(limit).select("id", *RECENT_COLUMNS)


def last_calls(recent_rows: DataFrame, n: int = LAST_CALLS) -> DataFrame:
    return newest(successful(recent_rows)).limit(n).select("id", *CALL_COLUMNS)


def recent_probabilities(log: DataFrame, limit: int) -> DataFrame:
    scored = successful(log).where(F.col("probability_default").isNotNull())
    return newest(scored).limit(limit).select("id", "probability_default")


def current_features(log: DataFrame, limit: int, keep_alive: int = KEEP_ALIVE_CLIENT) -> DataFrame:
    """Feature objects of the last successful calls, without the client that only keeps the service awake.

    The last calls are found by time and id alone. Sorting calls with their objects would move ``limit`` of them for every
    task; now only those no older than the last ones are sorted with them.
    """
    calls = successful(log).where(F.col("sk_id_curr") != keep_alive)
    last = newest(calls.select("timestamp", "id")).limit(limit)
    # calls without a time count as the oldest
    end = last.agg(F.struct(F.min("timestamp").alias("time"), F.bool_or(F.col("timestamp").isNull()).alias("open"))).scalar()
    recent_calls = calls.where(end["open"] | (F.col("timestamp") >= end["time"]))
    return newest(recent_calls).limit(limit).select("id", "features")


# --- reports ----------------------------------------------------------------------------------
def summary(log: DataFrame, hours: int, now: Column | None = None) -> DataFrame:
    """One row of counts, exact latency percentiles and the mean probability; an empty window has a row of zeros."""
    rows = since(log, hours, now).withColumn("_all", F.lit(1))
    counts = rows.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status_code") == OK_STATUS).alias("ok"),
        F.count_if(F.col("status_code") != OK_STATUS).alias("errors"),
        F.count_if(F.col("decision") == "GRANTED").alias("granted"),
        F.count_if(F.col("decision") == "REFUSED").alias("refused"),
        F.count_if(~F.col("client_known")).alias("unknowns"),
        F.avg("probability_default").alias("avg_proba")).withColumn("_all", F.lit(1))
    spread = quantiles(rows, ["_all"], {c: col(c) for c in REPORT_TIMINGS.values()}, HALVES)
    renamed = spread.select("_all", *[col(f"{c}_{p}").alias(f"{name}{p}")
                                      for name, c in REPORT_TIMINGS.items() for p in HALVES])
    return counts.join(renamed, "_all", "left").drop("_all")


def kpis(summary_row: DataFrame) -> DataFrame:
    """Headline figures from the summary: whole milliseconds and rates in percent."""
    def ms(name: str) -> Column:
        return F.coalesce(round_half_even(col(name)), F.lit(0))

    def percent(part: str) -> Column:
        return 100 * (col(part) / F.greatest(F.col("total"), F.lit(1)))

    return summary_row.select(
        "total", "errors", percent("errors").alias("error_pct"),
        *[(ms(p) + ms(f"db_log_{p}")).alias(f"total_{p}") for p in HALVES],
        *[ms(f"{name}{p}").alias(f"{'handler_' if not name else name}{p}_ms")
          for name in REPORT_TIMINGS for p in HALVES],
        percent("refused").alias("refused_pct"), percent("unknowns").alias("unknown_pct"))


def _by_hour(rows: DataFrame) -> DataFrame:
    return rows.withColumn("hour", F.date_trunc("hour", F.col("timestamp")))


def hourly(log: DataFrame, hours: int, now: Column | None = None) -> DataFrame:
    rows = _by_hour(since(log, hours, now))
    counts = rows.groupBy("hour").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status_code") != OK_STATUS).alias("errors"))
    spread = quantiles(rows, ["hour"], {"latency": F.col("latency_ms")}, HALVES)
    return (counts.join(spread, "hour", "left")
            .withColumnsRenamed({"latency_p50": "p50", "latency_p95": "p95"}).orderBy("hour"))


def latency_breakdown(log: DataFrame, hours: int, now: Column | None = None) -> DataFrame:
    """Hourly medians of each timing over successful calls."""
    rows = _by_hour(successful(since(log, hours, now)))
    timings = {"total": "latency_ms", "feature_assembly": "feature_assembly_ms", "inference": "inference_ms",
               "inference_cpu": "inference_cpu_ms", "db_log": "db_log_ms"}
    medians = quantiles(rows, ["hour"], {n: col(c) for n, c in timings.items()}, {"p50": 0.5})
    return rows.select("hour").distinct().join(medians, "hour", "left").orderBy("hour")


def latency_components(breakdown: DataFrame) -> DataFrame:
    """Long form (hour, component, ms) with the plumbing that the medians leave over."""
    def zero(c: str) -> Column:
        return F.coalesce(col(c), F.lit(0.0))

    rest = zero("total_p50") - zero("feature_assembly_p50") - zero("inference_p50")
    wide = breakdown.withColumn("plumbing_p50", F.greatest(F.lit(0.0), rest))
    labels = F.create_map(*[F.lit(x) for pair in COMPONENTS.items() for x in pair])
    return (wide.unpivot(["hour"], list(COMPONENTS), "component", "ms")
            .withColumn("component", F.element_at(labels, F.col("component"))))


def latency_long(hourly_rows: DataFrame) -> DataFrame:
    return hourly_rows.unpivot(["hour"], ["p50", "p95"], "variable", "value")


def decision_mix(rows: DataFrame) -> DataFrame:
    return successful(rows).groupBy("decision").agg(F.count(F.lit(1)).alias("count"))


def known_mix(rows: DataFrame) -> DataFrame:
    label = F.when(F.col("client_known"), "known").otherwise("unknown")
    return successful(rows).groupBy(label.alias("type")).agg(F.count(F.lit(1)).alias("count"))


def borderline(log: DataFrame, low: float = BORDERLINE[0], high: float = BORDERLINE[1]) -> DataFrame:
    """Share granted among scores next to the threshold."""
    near = successful(log).where(F.col("probability_default").between(low, high))
    return near.agg(F.count(F.lit(1)).alias("rows"),
                    F.avg((F.col("decision") == "GRANTED").cast("int")).alias("granted_share"))


def fill_ground_truth(log: DataFrame, truth: DataFrame) -> DataFrame:
    """Log rows with the outcome observed later (``truth``: id, ground_truth; unique on id)."""
    known = truth.select("id", F.col("ground_truth").alias("_truth"))
    return (log.join(known, "id", "left")
            .withColumn("ground_truth", F.coalesce("_truth", "ground_truth")).drop("_truth"))
