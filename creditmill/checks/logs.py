"""Prediction log: rows, tables and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditmill.checks.registry import query
from creditmill.checks.roles import role, role_sql, table, with_roles
from creditmill.operators import histogram as H
from creditmill.plans import prediction_log as L
from creditmill.session import new_table_path
from creditmill.sources import log_store as LS

HOURS = 24 * 14
LOG = role_sql("prediction_log")
WINDOW = f"(SELECT * FROM prediction_log WHERE timestamp >= (SELECT max(timestamp) FROM prediction_log) " \
         f"- INTERVAL {HOURS} HOURS)"


def log(spark, sf):
    return role(spark, sf, "prediction_log")


def latest(df):
    """Test data has no present; its newest row stands in."""
    return df.agg(F.max("timestamp")).scalar()


def naive(df, column):
    return df.withColumn(column, F.col(column).cast("timestamp_ntz"))


# --- rows and tables ---------------------------------------------------------------------------------
_CALLS = """SELECT id, timestamp, sk_id_curr, client_known, status_code, error_message, threshold, model_version,
    features, probability_default, CASE WHEN decision <> 'ERROR' THEN decision END AS decision,
    latency_ms + 0.5 AS latency, feature_assembly_ms + 0.5 AS feature_assembly, inference_ms + 0.25 AS inference
    FROM prediction_log"""


@query("log_rows", with_roles(f"""
    SELECT id, CAST(round_even(latency, 0) AS INT) AS latency_ms,
      CAST(round_even(feature_assembly, 0) AS INT) AS feature_assembly_ms,
      CAST(round_even(inference, 0) AS INT) AS inference_ms,
      CASE WHEN feature_assembly IS NOT NULL AND inference IS NOT NULL THEN greatest(0,
        CAST(round_even(latency, 0) AS INT) - CAST(round_even(feature_assembly, 0) AS INT)
        - CAST(round_even(inference, 0) AS INT)) END AS plumbing_ms,
      status_code, error_message, CASE WHEN status_code <> 200 THEN '{{}}' ELSE features END AS features,
      CASE WHEN status_code = 200 THEN probability_default END AS probability_default,
      CASE WHEN status_code <> 200 THEN 'ERROR' ELSE coalesce(decision, 'ERROR') END AS decision
    FROM ({_CALLS})""".replace("{{}}", "{}"), "prediction_log"))
def log_rows(spark, sf):
    measured = log(spark, sf).select(
        "id", "timestamp", "sk_id_curr", "client_known", "status_code", "error_message", "threshold",
        "model_version", "features", "probability_default",
        F.when(F.col("decision") != "ERROR", F.col("decision")).alias("decision"),
        (F.col("latency_ms") + 0.5).cast("double").alias("latency"),
        (F.col("feature_assembly_ms") + 0.5).cast("double").alias("feature_assembly"),
        (F.col("inference_ms") + 0.25).cast("double").alias("inference"))
    return L.log_rows(measured).select(
        "id", "latency_ms", "feature_assembly_ms", "inference_ms", "plumbing_ms", "status_code", "error_message",
        "features", "probability_default", "decision")


@query("log_append", with_roles("""
    SELECT strftime(timestamp, '%Y-%m-%d') AS day, count(*) AS rows, count(DISTINCT id) AS ids,
      count(*) FILTER (WHERE status_code = 200) AS ok, count(probability_default) AS scored
    FROM prediction_log GROUP BY 1""", "prediction_log"))
def log_append(spark, sf):
    path = new_table_path(spark, "prediction_log")
    LS.create_log(spark, path)
    rows = log(spark, sf)
    LS.append_log(rows.where(F.col("status_code") == 200), path)
    # failed calls arrive without an id; the table gives them one
    LS.append_log(rows.where(F.col("status_code") != 200).drop("id"), path)
    stored = LS.read_log(spark, path)
    return stored.groupBy(F.date_format("timestamp", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("id").alias("ids"),
        F.count_if(F.col("status_code") == 200).alias("ok"), F.count("probability_default").alias("scored"))


@query("log_latest_version", with_roles(
    "SELECT id, sk_id_curr, db_log_ms, CASE WHEN db_log_ms IS NULL THEN 0 ELSE 1 END AS version FROM prediction_log",
    "prediction_log"))
def log_latest_version(spark, sf):
    rows = log(spark, sf).select("id", "sk_id_curr", "db_log_ms", F.lit(0).alias("version"))
    inserted = rows.withColumn("db_log_ms", F.lit(None).cast("int"))
    measured = rows.where(F.col("db_log_ms").isNotNull()).select("id", "db_log_ms", F.lit(1).alias("version"))
    updated = LS.versioned_update(inserted, measured, "id", ["db_log_ms", "version"])
    return LS.latest_versions(inserted.unionByName(updated), "id", "version")


@query("log_update", with_roles("SELECT id, sk_id_curr, status_code, db_log_ms FROM prediction_log", "prediction_log"))
def log_update(spark, sf):
    """The log time comes after the row: successes first, failures later, each rewriting the days it touches."""
    path = new_table_path(spark, "prediction_log")
    rows = log(spark, sf)
    LS.append_log(rows.withColumn("db_log_ms", F.lit(None).cast("int")), path)
    measured = rows.where(F.col("db_log_ms").isNotNull())
    late = measured.select("id", F.to_date("timestamp").alias(LS.DAY), "db_log_ms", F.lit(1).alias("version"))
    early = late.withColumns({"db_log_ms": F.lit(-1), "version": F.lit(0)})
    LS.update_log(early.unionByName(late).where("db_log_ms % 2 = 0 OR version = 0"), path, "id", ["db_log_ms"], "version")
    LS.update_log(late.drop(LS.DAY), path, "id", ["db_log_ms"], "version")
    LS.compact_log(spark, path)
    return LS.read_log(spark, path).select("id", "sk_id_curr", "status_code", "db_log_ms")


@query("log_schema_evolve", with_roles("""
    SELECT id, CAST(round_even(latency_ms + 0.5, 0) AS INT) AS latency_ms, CAST(NULL AS INT) AS inference_ms,
      CAST(NULL AS INT) AS db_log_ms FROM prediction_log WHERE status_code <> 200
    UNION ALL SELECT id, latency_ms, inference_ms, db_log_ms FROM prediction_log WHERE status_code = 200""",
    "prediction_log"))
def log_schema_evolve(spark, sf):
    rows = log(spark, sf)
    old = rows.where(F.col("status_code") != 200).select(
        "id", (F.col("latency_ms") + 0.5).cast("double").alias("latency_ms"))
    new = rows.where(F.col("status_code") == 200).select("id", "latency_ms", "inference_ms", "db_log_ms")
    return LS.evolve(old, new, ["latency_ms"])


@query("ground_truth_join", with_roles("""
    SELECT l.id, CAST(t.toxic AS INT) AS ground_truth FROM prediction_log l
    LEFT JOIN labels t ON l.id = concat('log-', CAST(t.doc_id AS STRING))""", "prediction_log"))
def ground_truth_join(spark, sf):
    truth = table(spark, sf, "labels").select(F.concat(F.lit("log-"), F.col("doc_id").cast("string")).alias("id"),
                                              F.col("toxic").cast("int").alias("ground_truth"))
    return L.fill_ground_truth(log(spark, sf), truth).select("id", "ground_truth")


FEATURES = ["EXT_SOURCE_1", "AMT_CREDIT", "AMT_INCOME_TOTAL", "DAYS_EMPLOYED", "CODE_GENDER", "NOT_THERE"]
EXPANDED = ", ".join(f"""CAST(json_extract_string(features, '$.{f}') AS DOUBLE) AS "{f}" """ for f in FEATURES)


@query("features_from_json", with_roles(f"SELECT id, {EXPANDED} FROM prediction_log", "prediction_log"))
def features_from_json(spark, sf):
    return L.expand_features(log(spark, sf).select("id", "features"), FEATURES)


# --- windows -------------------------------------------------------------------------------------------
_RECENT = f"SELECT * FROM {WINDOW} ORDER BY timestamp DESC, id LIMIT {L.RECENT_ROWS}"


@query("log_recent", with_roles(f"SELECT id, {', '.join(L.RECENT_COLUMNS)} FROM ({_RECENT})", "prediction_log"))
def log_recent(spark, sf):
    rows = log(spark, sf)
    return L.recent(rows, HOURS, latest(rows))


@query("log_last50", with_roles(f"""SELECT id, {', '.join(L.CALL_COLUMNS)} FROM ({_RECENT})
    WHERE status_code = 200 ORDER BY timestamp DESC, id LIMIT 50""", "prediction_log"))
def log_last50(spark, sf):
    rows = log(spark, sf)
    return L.last_calls(L.recent(rows, HOURS, latest(rows)))


_LAST = 500


@query("proba_recent", with_roles(f"""SELECT id, probability_default FROM prediction_log
    WHERE status_code = 200 AND probability_default IS NOT NULL ORDER BY timestamp DESC, id LIMIT {_LAST}""",
    "prediction_log"))
def proba_recent(spark, sf):
    return L.recent_probabilities(log(spark, sf), _LAST)


@query("drift_current", with_roles(f"""SELECT id, features FROM prediction_log
    WHERE status_code = 200 AND sk_id_curr <> 100008 ORDER BY timestamp DESC, id LIMIT {_LAST}""",
    "prediction_log"))
def drift_current(spark, sf):
    return L.current_features(log(spark, sf), _LAST, keep_alive=100008)


# --- reports -------------------------------------------------------------------------------------------
_QUANTILES = ", ".join(f'quantile_cont({c}, {q}) AS "{n}{p}"' for n, c in L.REPORT_TIMINGS.items()
                       for p, q in L.HALVES.items())
_SUMMARY = f"""SELECT count(*) AS total, count(*) FILTER (WHERE status_code = 200) AS ok,
    count(*) FILTER (WHERE status_code <> 200) AS errors, count(*) FILTER (WHERE decision = 'GRANTED') AS granted,
    count(*) FILTER (WHERE decision = 'REFUSED') AS refused, count(*) FILTER (WHERE NOT client_known) AS unknowns,
    avg(probability_default) AS avg_proba, {_QUANTILES} FROM {WINDOW}"""
_SUMMARY_DOUBLES = ["avg_proba"] + [f"{n}{p}" for n in L.REPORT_TIMINGS for p in L.HALVES]


@query("log_summary", with_roles(_SUMMARY, "prediction_log"), _SUMMARY_DOUBLES)
def log_summary(spark, sf):
    rows = log(spark, sf)
    return L.summary(rows, HOURS, latest(rows))


_MS = {f"{n}{p}": f'CAST(round_even(coalesce("{n}{p}", 0), 0) AS INT)' for n in L.REPORT_TIMINGS for p in L.HALVES}
_KPI_NAMES = {f"{n}{p}": f"{'handler_' if not n else n}{p}_ms" for n in L.REPORT_TIMINGS for p in L.HALVES}


@query("log_kpis", with_roles(f"""SELECT total, errors, 100 * (errors / greatest(total, 1)) AS error_pct,
    {_MS['p50']} + {_MS['db_log_p50']} AS total_p50, {_MS['p95']} + {_MS['db_log_p95']} AS total_p95,
    {', '.join(f'{_MS[k]} AS "{v}"' for k, v in _KPI_NAMES.items())},
    100 * (refused / greatest(total, 1)) AS refused_pct, 100 * (unknowns / greatest(total, 1)) AS unknown_pct
    FROM ({_SUMMARY})""", "prediction_log"), ["error_pct", "refused_pct", "unknown_pct"])
def log_kpis(spark, sf):
    return L.kpis(log_summary(spark, sf))


_HOURLY = f"""SELECT date_trunc('hour', timestamp) AS hour, count(*) AS total,
    count(*) FILTER (WHERE status_code <> 200) AS errors, quantile_cont(latency_ms, 0.5) AS p50,
    quantile_cont(latency_ms, 0.95) AS p95 FROM {WINDOW} GROUP BY 1"""


@query("log_hourly", with_roles(_HOURLY, "prediction_log"), ["p50", "p95"])
def log_hourly(spark, sf):
    rows = log(spark, sf)
    return naive(L.hourly(rows, HOURS, latest(rows)), "hour")


@query("latency_long", with_roles(f"""SELECT hour, variable, value FROM
    (UNPIVOT (SELECT hour, p50, p95 FROM ({_HOURLY})) ON p50, p95 INTO NAME variable VALUE value)""",
    "prediction_log"), ["value"])
def latency_long(spark, sf):
    return L.latency_long(log_hourly(spark, sf))


_MEDIANS = {"total_p50": "latency_ms", "feature_assembly_p50": "feature_assembly_ms", "inference_p50": "inference_ms",
            "inference_cpu_p50": "inference_cpu_ms", "db_log_p50": "db_log_ms"}
_BREAKDOWN = f"""SELECT date_trunc('hour', timestamp) AS hour,
    {', '.join(f'quantile_cont({c}, 0.5) AS {n}' for n, c in _MEDIANS.items())}
    FROM {WINDOW} WHERE status_code = 200 GROUP BY 1"""


@query("log_latency_hourly", with_roles(_BREAKDOWN, "prediction_log"), list(_MEDIANS))
def log_latency_hourly(spark, sf):
    rows = log(spark, sf)
    return naive(L.latency_breakdown(rows, HOURS, latest(rows)), "hour")


@query("latency_components_long", with_roles(" UNION ALL ".join(
    f"SELECT hour, '{label}' AS component, {sql} AS ms FROM breakdown" for label, sql in {
        "Feature assembly": "feature_assembly_p50", "Model inference": "inference_p50",
        "Plumbing": "greatest(0, coalesce(total_p50, 0) - coalesce(feature_assembly_p50, 0) "
                    "- coalesce(inference_p50, 0))",
        "DB log": "db_log_p50"}.items()), "prediction_log", breakdown=_BREAKDOWN), ["ms"])
def latency_components_long(spark, sf):
    return L.latency_components(log_latency_hourly(spark, sf))


@query("decision_mix", with_roles(
    "SELECT decision, count(*) AS count FROM prediction_log WHERE status_code = 200 GROUP BY decision",
    "prediction_log"))
def decision_mix(spark, sf):
    return L.decision_mix(log(spark, sf))


@query("known_mix", with_roles("""SELECT CASE WHEN client_known THEN 'known' ELSE 'unknown' END AS type,
    count(*) AS count FROM prediction_log WHERE status_code = 200 GROUP BY 1""", "prediction_log"))
def known_mix(spark, sf):
    return L.known_mix(log(spark, sf))


@query("borderline_share", with_roles("""SELECT count(*) AS rows,
    avg(CASE WHEN decision = 'GRANTED' THEN 1.0 ELSE 0.0 END) AS granted_share FROM prediction_log
    WHERE status_code = 200 AND probability_default BETWEEN CAST(0.325 AS DOUBLE) AND CAST(0.335 AS DOUBLE)""",
    "prediction_log"), ["granted_share"])
def borderline_share(spark, sf):
    return L.borderline(log(spark, sf))


_BIN = "CAST(CASE WHEN p = 1 THEN 40 ELSE floor(p * 40) + 1 END AS BIGINT)"
_HISTOGRAM = f"""SELECT {{by}} b AS bin, (b - 1) / 40 AS low, b / 40 AS high, coalesce(n, 0) AS count,
    coalesce(n, 0) / total AS density
    FROM (SELECT {{by}} count(*) AS total FROM scores GROUP BY ALL) CROSS JOIN (SELECT unnest(range(1, 41)) AS b)
    LEFT JOIN (SELECT {{by}} {_BIN} AS b, count(*) AS n FROM scores GROUP BY ALL) USING ({{using}} b)"""
_SCORES = "SELECT decision, probability_default AS p FROM prediction_log WHERE probability_default IS NOT NULL"


@query("proba_histogram", with_roles(_HISTOGRAM.format(by="", using=""), "prediction_log", scores=_SCORES),
       ["low", "high", "density"])
def proba_histogram(spark, sf):
    return H.histogram(log(spark, sf), F.col("probability_default"))


@query("histogram_by_decision", with_roles(_HISTOGRAM.format(by="decision,", using="decision,"), "prediction_log",
                                           scores=_SCORES), ["low", "high", "density"])
def histogram_by_decision(spark, sf):
    return H.histogram(log(spark, sf), F.col("probability_default"), ["decision"])


@query("proba_snapshot", with_roles(f"""
    SELECT count(p) AS n, avg(p) AS mean, quantile_cont(p, 0.5) AS median, quantile_cont(p, 0.95) AS p95,
      (SELECT string_agg(CAST(count AS STRING), ',' ORDER BY bin) FROM ({_HISTOGRAM.format(by='', using='')})) AS counts,
      (SELECT count(*) FROM (SELECT p FROM scores ORDER BY md5(concat('42|', id)), id LIMIT 5000)) AS kept,
      (SELECT sum(p) FROM (SELECT p FROM scores ORDER BY md5(concat('42|', id)), id LIMIT 5000)) AS kept_sum
    FROM scores""", "prediction_log",
    scores="SELECT id, probability_default AS p FROM prediction_log WHERE probability_default IS NOT NULL"),
    ["mean", "median", "p95", "kept_sum"])
def proba_snapshot(spark, sf):
    snapshot = H.score_snapshot(log(spark, sf), "id", "probability_default")
    return snapshot.select(
        "n", "mean", "median", "p95", F.array_join("counts", ",").alias("counts"),
        F.size("values").cast("bigint").alias("kept"),
        F.aggregate("values", F.lit(0.0), lambda acc, v: acc + v).alias("kept_sum"))


@query("percentile_nearest", with_roles("""
    SELECT model_version, list_sort(list(latency_ms))[count(*) // 2 + 1] AS p50,
      list_sort(list(latency_ms))[least(count(*) - 1, CAST(floor(count(*) * 0.95) AS BIGINT)) + 1] AS p95
    FROM prediction_log WHERE status_code = 200 GROUP BY model_version""", "prediction_log"))
def percentile_nearest(spark, sf):
    from creditmill.operators.ordered import nearest_ranks, values_at

    picked = values_at(L.successful(log(spark, sf)), ["model_version"], {"l": F.col("latency_ms")}, nearest_ranks())
    return picked.select("model_version", F.col("l_p50").cast("int").alias("p50"),
                         F.col("l_p95").cast("int").alias("p95"))
