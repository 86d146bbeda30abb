"""Sampling, scenarios and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditmill.checks import family_sql as FS
from creditmill.checks.joins import REFERENCE_SQL, contract_sql, saved_store
from creditmill.checks.logs import EXPANDED, FEATURES, log
from creditmill.checks.registry import query
from creditmill.checks.roles import role, role_sql, table, with_roles
from creditmill.contract import schema as S
from creditmill.contract import vocabulary as V
from creditmill.contract.features import feature_names
from creditmill.operators import align as A
from creditmill.operators import drift as D
from creditmill.operators import sampling as SM
from creditmill.plans import families as P
from creditmill.plans import monitoring as MO
from creditmill.plans import prediction_log as L
from creditmill.plans import scenario as SC
from creditmill.plans import scoring as PS
from creditmill.session import new_table_path
from creditmill.sources import log_store as LS

K = S.KEY


def hashed(seed, *parts: str) -> str:
    """SQL of the md5 that orders and draws use."""
    joined = ", '|', ".join([f"'{seed}'", *[f"CAST({p} AS STRING)" for p in parts]])
    return f"md5(concat({joined}))"


def number(seed, *parts: str) -> str:
    return f"CAST(('0x' || substr({hashed(seed, *parts)}, 1, 8)) AS BIGINT)"


# --- sampling --------------------------------------------------------------------------------------
@query("sample_uniform", f"SELECT event_id, event_type FROM events ORDER BY {hashed(7, 'event_id')}, event_id LIMIT 1000")
def sample_uniform(spark, sf):
    return SM.uniform_sample(table(spark, sf, "events"), "event_id", 1000, 7).select("event_id", "event_type")


@query("sample_replacement", f"""
    SELECT d.draw, e.event_id FROM
      (SELECT r AS draw, CAST(floor({number('7d', 'r')} / 4294967296 * (SELECT count(*) FROM events)) AS BIGINT) AS i
       FROM (SELECT unnest(range(2000)) AS r)) d
    JOIN (SELECT event_id, row_number() OVER (ORDER BY {hashed(7, 'event_id')}, event_id) - 1 AS i FROM events) e
    USING (i)""")
def sample_replacement(spark, sf):
    return SM.sample_with_replacement(table(spark, sf, "events").select("event_id"), "event_id", 2000, 7)


_SAMPLE = 700


@query("reference_sample", with_roles(f"""
    SELECT {K}, TARGET, n AS "POS_COUNT" FROM (
      SELECT *, row_number() OVER (PARTITION BY TARGET ORDER BY {hashed(42, K)}, {K}) AS rn FROM rows_)
    JOIN quota USING (TARGET) WHERE rn <= take""", "application", "POS_CASH_balance",
    rows_=f"""SELECT a.{K}, TARGET, s.n FROM application a JOIN
      (SELECT {K}, CAST(count(*) AS DOUBLE) AS n FROM POS_CASH_balance GROUP BY {K}) s USING ({K})
      WHERE CODE_GENDER IS DISTINCT FROM 'XNA'""",
    sizes=f"""SELECT TARGET, count(*) AS c, (SELECT count(*) FROM rows_) AS total,
      least({_SAMPLE}, (SELECT count(*) FROM rows_)) AS goal FROM rows_ GROUP BY TARGET""",
    quota="""SELECT TARGET, c * goal // total + CASE WHEN row_number() OVER (ORDER BY c * goal % total DESC, TARGET)
      <= goal - sum(c * goal // total) OVER () THEN 1 ELSE 0 END AS take FROM sizes"""))
def reference_sample(spark, sf):
    store = P.pos_family(role(spark, sf, "POS_CASH_balance"))
    reference = MO.build_reference(role(spark, sf, "application"), store, _SAMPLE)
    return reference.select(K, "TARGET", "POS_COUNT")


# --- scenarios --------------------------------------------------------------------------------------
_CLEAN = "SELECT * FROM application WHERE CODE_GENDER IS DISTINCT FROM 'XNA' AND DAYS_BIRTH IS NOT NULL"


@query("cohort_known_unknown", with_roles(f"""
    SELECT CASE WHEN i > 90 THEN 999100 + i - 91 ELSE {K} END AS {K}, {K} AS source_id, AMT_CREDIT FROM
      (SELECT *, row_number() OVER (ORDER BY {hashed(42, K)}, {K}) AS i FROM ({_CLEAN})) WHERE i <= 100""",
    "application"))
def cohort_known_unknown(spark, sf):
    return SC.cohort(role(spark, sf, "application"), 90, 10, 42).select(K, "source_id", "AMT_CREDIT")


@query("scenario_income", with_roles(f"""
    SELECT {K}, AMT_INCOME_TOTAL * CAST(1.3 AS DOUBLE) AS AMT_INCOME_TOTAL,
      AMT_INCOME_TOTAL * CAST(1.3 AS DOUBLE) / nullif(AMT_CREDIT, 0) AS INCOME_CREDIT_PERC,
      AMT_INCOME_TOTAL * CAST(1.3 AS DOUBLE) / nullif(CNT_FAM_MEMBERS, 0) AS INCOME_PER_PERSON,
      AMT_ANNUITY / nullif(AMT_INCOME_TOTAL * CAST(1.3 AS DOUBLE), 0) AS ANNUITY_INCOME_PERC FROM application""",
    "application"), ["AMT_INCOME_TOTAL", "INCOME_CREDIT_PERC", "INCOME_PER_PERSON", "ANNUITY_INCOME_PERC"])
def scenario_income(spark, sf):
    from creditmill.operators.encode import ratios

    scaled = SC.scale_income(role(spark, sf, "application"))
    return scaled.select("*", *ratios()).select(
        K, "AMT_INCOME_TOTAL", "INCOME_CREDIT_PERC", "INCOME_PER_PERSON", "ANNUITY_INCOME_PERC")


def _jitter_sql() -> str:
    # the bounds are stated here once more, from the request rules, by column
    bounds = {c: b for b, cs in S.RANGES.items() for c in cs} | {c: (1, None) for c in S.POSITIVE}
    cells = []
    for field in S.APPLICATION.fields:
        c, kind = field.name, field.dataType.typeName()
        chance = f"({number(42, K, repr(c))} / 4294967296)"
        if c in (K, "TARGET") or c in S.DOCUMENT_FLAGS:
            cells.append(c)
        elif c in V.APPLICATION:
            values = V.APPLICATION[c]
            listed = "['" + "', '".join(values) + "']"
            cells.append(f"CASE WHEN {c} IS NULL THEN NULL WHEN {chance} < 0.1 "
                         f"THEN {listed}[1 + {number('42c', K, repr(c))} % {len(values)}] ELSE {c} END AS {c}")
        elif kind == "string":
            cells.append(c)
        else:
            low, high = bounds.get(c, (0, 1) if c in S.FLAGS else (None, None))
            moved = f"(CAST({c} AS DOUBLE) * (1 + 0.1 * (2 * {chance} - 1)))"
            if c in S.FLAGS and not c.startswith("FLAG_"):
                low, high = None, None
            if c in S.CONTACT_FLAGS:
                low, high = None, None
            if high is not None:
                moved = f"least({high}, {moved})"
            if low is not None:
                moved = f"greatest({low}, {moved})"
            if kind == "long":
                moved = f"CAST(round_even({moved}, 0) AS BIGINT)"
            if c in S.CONTACT_FLAGS:
                moved = (f"CASE WHEN {c} IN (0, 1) THEN CASE WHEN {chance} < 0.05 THEN 1 - {c} ELSE {c} END "
                         f"ELSE {moved} END")
            cells.append(f"CASE WHEN {c} IS NOT NULL THEN {moved} END AS {c}")
    return f"SELECT {', '.join(cells)} FROM application"


_DOUBLES = [f.name for f in S.APPLICATION.fields if f.dataType.typeName() == "double"]


@query("scenario_jitter", with_roles(_jitter_sql(), "application"), _DOUBLES)
def scenario_jitter(spark, sf):
    return SC.jitter(role(spark, sf, "application"), 42)


# --- drift ------------------------------------------------------------------------------------------
CUT = "2024-01-15"
_TESTED = ["AMT_CREDIT", "AMT_INCOME_TOTAL", "CODE_GENDER", "EXT_SOURCE_1"]
_EXPAND = f"SELECT id, timestamp, {EXPANDED} FROM prediction_log WHERE status_code = 200"
SIDES = {
    "ref": f"SELECT * FROM ({_EXPAND}) WHERE timestamp < TIMESTAMP '{CUT}'",
    "cur": f"""SELECT * REPLACE (AMT_INCOME_TOTAL * CAST(1.3 AS DOUBLE) AS AMT_INCOME_TOTAL)
        FROM ({_EXPAND}) WHERE timestamp >= TIMESTAMP '{CUT}'""",
}


def sides(spark, sf):
    """Features logged before the cut, and after it with a scaled income."""
    ok = L.successful(log(spark, sf)).select("id", "timestamp", "features")
    wide = L.expand_features(ok, FEATURES)
    cut = F.lit(CUT).cast("timestamp_ntz")
    return wide.where(F.col("timestamp") < cut), SC.scale_income(wide.where(F.col("timestamp") >= cut))


def statistic_sql(features, source="both_"):
    """Largest distance of the cumulative shares, per feature."""
    cells = " UNION ALL ".join(f"""SELECT '{f}' AS feature, side, "{f}" AS v FROM {source} WHERE "{f}" IS NOT NULL"""
                               for f in features)
    return f"""SELECT feature, max(abs(r / n - c / m)) AS statistic, CAST(any_value(n) AS BIGINT) AS ref_n,
        CAST(any_value(m) AS BIGINT) AS cur_n
      FROM (SELECT feature, sum(rn) OVER w AS r, sum(cn) OVER w AS c, sum(rn) OVER (PARTITION BY feature) AS n,
              sum(cn) OVER (PARTITION BY feature) AS m
            FROM (SELECT feature, v, CAST(count(*) FILTER (WHERE side = 'ref') AS DOUBLE) AS rn,
                    CAST(count(*) FILTER (WHERE side = 'cur') AS DOUBLE) AS cn FROM ({cells}) GROUP BY feature, v)
            WINDOW w AS (PARTITION BY feature ORDER BY v)) GROUP BY feature"""


_LAMBDA = "statistic * sqrt(CAST(ref_n AS DOUBLE) * cur_n / (ref_n + cur_n))"
_TAIL = "2 * list_sum([(CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * j * j * z * z) FOR j IN range(1, 61)])"
_BODY = ("1 - sqrt(2 * pi()) / z * list_sum([exp(-(2.0 * j - 1) * (2.0 * j - 1) * pi() * pi() / (8.0 * z * z)) "
         "FOR j IN range(1, 61)])")


def tested_sql(features, source="both_"):
    return f"""SELECT feature, 'K-S p_value' AS method, statistic, ref_n, cur_n, score,
    CAST(0.05 AS DOUBLE) AS threshold, score < 0.05 AS detected
    FROM (SELECT *, greatest(0, least(1, CASE WHEN z < 0.04 THEN 1 WHEN z < 1.18 THEN {_BODY} ELSE {_TAIL} END)) AS score
      FROM (SELECT *, {_LAMBDA} AS z FROM ({statistic_sql(features, source)})))"""


TESTED_SQL = tested_sql(_TESTED)
_BOTH = "SELECT 'ref' AS side, * FROM ref UNION ALL SELECT 'cur' AS side, * FROM cur"


def drift_sql(body: str, **ctes: str) -> str:
    return with_roles(body, "prediction_log", **SIDES, both_=_BOTH, **ctes)


def tested(spark, sf, method="asymptotic"):
    reference, current = sides(spark, sf)
    shared = A.common_columns([c for c in FEATURES if c in reference.columns], current.columns)
    return D.ks_test(reference, current, A.filled_columns(reference, current, shared), method=method)


@query("ks_features", drift_sql(TESTED_SQL), ["statistic", "score"])
def ks_features(spark, sf):
    return tested(spark, sf)


@query("ks_features_exact")
def ks_features_exact(spark, sf):
    return tested(spark, sf, method="exact")


@query("drift_common_columns", drift_sql(
    'SELECT side, id, "AMT_CREDIT", "EXT_SOURCE_1" FROM both_'))
def drift_common_columns(spark, sf):
    reference, current = sides(spark, sf)
    reference, current = reference.drop("CODE_GENDER", "timestamp"), current.drop(
        "AMT_INCOME_TOTAL", "timestamp", "DAYS_EMPLOYED", "NOT_THERE")
    shared = A.common_columns(reference.columns, current.columns)
    return (reference.select(F.lit("ref").alias("side"), *shared)
            .unionByName(current.select(F.lit("cur").alias("side"), *shared)))


@query("drift_nonempty_columns", drift_sql(
    "SELECT side, id, " + ", ".join(f'"{c}"' for c in _TESTED) + " FROM both_"), ["AMT_INCOME_TOTAL"])
def drift_nonempty_columns(spark, sf):
    reference, current = sides(spark, sf)
    kept = A.filled_columns(reference, current, FEATURES)
    return (reference.select(F.lit("ref").alias("side"), "id", *kept)
            .unionByName(current.select(F.lit("cur").alias("side"), "id", *kept)))


@query("chi_square_features", drift_sql("""
    SELECT feature, sum((rn - er) * (rn - er) / er + (cn - ec) * (cn - ec) / ec) AS statistic, count(*) - 1 AS degrees
    FROM (SELECT *, (rn + cn) * n / (n + m) AS er, (rn + cn) * m / (n + m) AS ec FROM (
      SELECT *, sum(rn) OVER () AS n, sum(cn) OVER () AS m FROM (
        SELECT 'CODE_GENDER' AS feature, "CODE_GENDER" AS v, CAST(count(*) FILTER (WHERE side = 'ref') AS DOUBLE) AS rn,
          CAST(count(*) FILTER (WHERE side = 'cur') AS DOUBLE) AS cn FROM both_ GROUP BY 2))) GROUP BY feature"""),
    ["statistic"])
def chi_square_features(spark, sf):
    return D.chi_square_statistics(*sides(spark, sf), ["CODE_GENDER"])


_SCORES = """SELECT CASE WHEN timestamp < TIMESTAMP '2024-01-15' THEN 'ref' ELSE 'cur' END AS side,
    probability_default AS p FROM prediction_log WHERE probability_default IS NOT NULL"""


@query("ks_output", with_roles(f"""
    SELECT statistic, ref_n, cur_n, score, detected, avg(p) FILTER (WHERE side = 'ref') AS ref_mean,
      avg(p) FILTER (WHERE side = 'cur') AS cur_mean,
      round(avg(p) FILTER (WHERE side = 'cur') - avg(p) FILTER (WHERE side = 'ref'), 9) AS delta
    FROM scores CROSS JOIN ({tested_sql(['p'], 'scores')}) GROUP BY ALL""", "prediction_log", scores=_SCORES),
    ["statistic", "score", "ref_mean", "cur_mean", "delta"])
def ks_output(spark, sf):
    rows = log(spark, sf).where(F.col("probability_default").isNotNull())
    cut = F.lit(CUT).cast("timestamp_ntz")
    reference, current = rows.where(F.col("timestamp") < cut), rows.where(F.col("timestamp") >= cut)
    test = D.ks_test(reference, current, ["probability_default"])
    means = D.mean_shift(reference, current, "probability_default")
    return test.join(means.withColumn("feature", F.lit("probability_default")), "feature").select(
        "statistic", "ref_n", "cur_n", "score", "detected", "ref_mean", "cur_mean", F.round("delta", 9).alias("delta"))


# --- all features against the frozen reference ------------------------------------------------------
_CURRENT = 1000
_FEATURE_LIST = feature_names()


def _cells_sql(side: str) -> str:
    """Counted cells of a side whose columns are the contract's, at single precision as the model sees them."""
    return f"""SELECT feature, v, count(*) AS n FROM (UNPIVOT (SELECT {', '.join(
        f'CAST(CAST("{c}" AS FLOAT) AS DOUBLE) AS "{c}"' for c in _FEATURE_LIST)} FROM {side})
        ON COLUMNS(*) INTO NAME feature VALUE v) GROUP BY ALL"""


# chance of a larger chi-square by the series of the lower incomplete gamma function, whose terms are all positive
_UPPER = """CASE WHEN degrees = 0 THEN 1 WHEN statistic > 600 THEN 0 ELSE greatest(0, 1 - list_sum([exp(
    (degrees / 2 + j) * ln(greatest(statistic, 1e-300) / 2) - statistic / 2 - lgamma(degrees / 2 + j + 1)) FOR j IN range(0, 1500)])) END"""
_DRIFT_CTES = {
    "store": FS.store_sql(),
    "ref_rows": REFERENCE_SQL,
    "cur_rows": f"""SELECT {contract_sql('request')} FROM (SELECT * FROM request ORDER BY {K} DESC LIMIT {_CURRENT}) request
        LEFT JOIN store s ON s.{K} = request.{K}""",
    "both_cells": f"""SELECT feature, v, CAST(coalesce(r.n, 0) AS DOUBLE) AS rn, CAST(coalesce(c.n, 0) AS DOUBLE) AS cn
        FROM ({_cells_sql('ref_rows')}) r FULL JOIN ({_cells_sql('cur_rows')}) c USING (feature, v)""",
    "kinds": """SELECT feature, count(*) <= 5 AS category, sum(rn) AS n, sum(cn) AS m FROM both_cells GROUP BY feature
        HAVING sum(rn) > 0 AND sum(cn) > 0""",
    "ks": f"""SELECT feature, 'K-S p_value' AS method, statistic, CAST(NULL AS BIGINT) AS degrees, ref_n, cur_n,
        greatest(0, least(1, CASE WHEN z < 0.04 THEN 1 WHEN z < 1.18 THEN {_BODY} ELSE {_TAIL} END)) AS score
        FROM (SELECT *, {_LAMBDA} AS z FROM (SELECT feature, max(abs(r / n - c / m)) AS statistic,
          CAST(any_value(n) AS BIGINT) AS ref_n, CAST(any_value(m) AS BIGINT) AS cur_n FROM (
            SELECT feature, n, m, sum(rn) OVER w AS r, sum(cn) OVER w AS c FROM both_cells JOIN kinds USING (feature)
            WHERE NOT category WINDOW w AS (PARTITION BY feature ORDER BY v)) GROUP BY feature))""",
    "expected": """SELECT feature, v, rn, cn, (rn + cn) * n / (n + m) AS er, (rn + cn) * m / (n + m) AS ec
        FROM both_cells JOIN kinds USING (feature) WHERE category""",
    "pooled": """SELECT feature, CASE WHEN er >= 5 AND ec >= 5 THEN v END AS v, sum(rn) AS rn, sum(cn) AS cn, sum(er) AS er,
        sum(ec) AS ec FROM expected GROUP BY ALL""",
    "chi": f"""SELECT feature, 'chi-square p_value' AS method, statistic, degrees, ref_n, cur_n, {_UPPER} AS score FROM (
        SELECT feature, sum((rn - er) * (rn - er) / er + (cn - ec) * (cn - ec) / ec) AS statistic, count(*) - 1 AS degrees,
          CAST(sum(rn) AS BIGINT) AS ref_n, CAST(sum(cn) AS BIGINT) AS cn_, CAST(sum(cn) AS BIGINT) AS cur_n
        FROM pooled GROUP BY feature)""",
}


def _rounded(df):
    # a chance computed by two formulas agrees to many places after the point, not in all its digits
    return df.withColumns({"statistic": F.round("statistic", 6), "score": F.round("score", 6)})


@query("drift_report", with_roles("""SELECT feature, method, round(statistic, 6) AS statistic, degrees, ref_n, cur_n,
    round(score, 6) AS score, CAST(0.05 AS DOUBLE) AS threshold, score < 0.05 AS detected
    FROM (SELECT * FROM ks UNION ALL SELECT * FROM chi)""", "application", "request", **_DRIFT_CTES), ["statistic", "score"])
def drift_report(spark, sf):
    store = saved_store(spark, sf)
    path = new_table_path(spark, "reference-cells")
    reference = MO.build_reference(role(spark, sf, "application"), store)
    MO.freeze_reference(A.to_single_precision(reference, _FEATURE_LIST), _FEATURE_LIST, path)
    assembled = PS.assemble(role(spark, sf, "request"), store)
    features = assembled.selectExpr(K, *[f"CAST(CAST(`{c}` AS FLOAT) AS DOUBLE) AS `{c}`" for c in _FEATURE_LIST])
    log_path = new_table_path(spark, "full-log")
    LS.append_log(features.select(
        F.col(K).cast("string").alias("id"), F.timestamp_seconds(F.col(K)).alias("timestamp"), F.col(K).alias("sk_id_curr"),
        F.lit(200).alias("status_code"), L.features_json(_FEATURE_LIST).alias("features")), log_path)
    return _rounded(MO.drift_report(spark.read.parquet(path), LS.read_log(spark, log_path), _FEATURE_LIST, _CURRENT))


# --- report and verdicts ----------------------------------------------------------------------------
@query("drift_parse", drift_sql(f"""SELECT feature, score, threshold, method AS stattest, detected
    FROM ({TESTED_SQL})"""), ["score"])
def drift_parse(spark, sf):
    return D.parse_report(D.report_document(tested(spark, sf)))


_SHARE = """SELECT count(*) FILTER (WHERE detected) AS count,
    avg(CASE WHEN detected THEN 1.0 ELSE 0.0 END) AS share, CAST(0.5 AS DOUBLE) AS threshold"""


@query("drift_share", drift_sql(f"SELECT *, share >= 0.5 AS dataset_drift FROM ({_SHARE} FROM ({TESTED_SQL}))"),
       ["share"])
def drift_share(spark, sf):
    return D.drift_summary(tested(spark, sf))


@query("drift_summary_parse", drift_sql(f"{_SHARE} FROM ({TESTED_SQL})"), ["share"])
def drift_summary_parse(spark, sf):
    return D.parse_summary(D.report_document(tested(spark, sf)))


# fixed values of the test: weights of a linear score
_WEIGHTS = {"EXT_SOURCE_1": 0.5, "AMT_CREDIT": 0.00048828125, "AMT_INCOME_TOTAL": 0.0001220703125, "CODE_GENDER": 0.25,
            "UNTESTED": 0.125}
_CONTRIBUTIONS = " UNION ALL ".join(
    f"""SELECT '{f}' AS feature, {w!r} * ("{f}" - avg("{f}") OVER ()) AS value FROM importance_rows"""
    for f, w in _WEIGHTS.items())
_IMPORTANCE = f"SELECT feature, avg(abs(value)) AS importance FROM ({_CONTRIBUTIONS}) GROUP BY feature"
_TOP = """SELECT *, CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INT) AS rank FROM importance_
    ORDER BY importance DESC, feature LIMIT 4"""
_IMPORTANCE_CTES = {
    "importance_rows": """SELECT *, "AMT_CREDIT" / 16384 AS "UNTESTED" FROM both_""",
    "importance_": _IMPORTANCE, "top_": _TOP, "tested_": TESTED_SQL}


def importance(spark, sf):
    reference, current = sides(spark, sf)
    both = reference.unionByName(current).withColumn("UNTESTED", F.col("AMT_CREDIT") / 16384)
    return D.mean_abs(D.linear_contributions(both, _WEIGHTS))


@query("importance_mean_abs", drift_sql("SELECT * FROM importance_", **_IMPORTANCE_CTES), ["importance"])
def importance_mean_abs(spark, sf):
    return importance(spark, sf)


@query("importance_topk", drift_sql("SELECT * FROM top_", **_IMPORTANCE_CTES), ["importance"])
def importance_topk(spark, sf):
    return D.top_importance(importance(spark, sf), 4)


@query("critical_features", drift_sql("""
    SELECT rank, feature, round_even(importance, 4) AS importance,
      CASE WHEN detected THEN 'detected' WHEN NOT detected THEN 'stable' ELSE 'unknown' END AS status, score,
      coalesce(method, '—') AS stattest FROM top_ LEFT JOIN tested_ USING (feature) WHERE rank <= 10""",
    **_IMPORTANCE_CTES), ["importance", "score"])
def critical_features(spark, sf):
    return D.critical_features(importance_topk(spark, sf), tested(spark, sf))


@query("weighted_drift", drift_sql("""
    SELECT *, CASE WHEN weighted_ratio >= 0.3 THEN 'alert' ELSE 'ok' END AS verdict FROM (
      SELECT coalesce(sum(importance) FILTER (WHERE detected), 0) / sum(importance) AS weighted_ratio,
        count(tested_.feature) AS covered, count(*) AS features
      FROM top_ LEFT JOIN tested_ ON top_.feature = tested_.feature)""", **_IMPORTANCE_CTES), ["weighted_ratio"])
def weighted_drift(spark, sf):
    return D.weighted_drift(importance_topk(spark, sf), tested(spark, sf))
