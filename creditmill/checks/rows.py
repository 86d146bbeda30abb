"""Scans, projections, filters and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditmill.checks.registry import query
from creditmill.checks.roles import role, role_sql, with_roles
from creditmill.checks import family_sql as FS
from creditmill.contract import schema as S
from creditmill.contract.features import RATIOS
from creditmill.functions import missing as M
from creditmill.functions.names import col, safe_name
from creditmill.operators import align as A
from creditmill.operators import encode as E
from creditmill.operators import validate as V
from creditmill.plans import families as P
from creditmill.plans import scenario
from creditmill.plans.prediction_log import successful
from creditmill.session import new_table_path
from creditmill.sources import tables as T

K = S.KEY


# --- scans and sinks ---------------------------------------------------------------------------
@query("scan_csv_roundtrip", role_sql("bureau"))
def scan_csv_roundtrip(spark, sf):
    path = new_table_path(spark, "bureau_csv")
    T.write_csv(role(spark, sf, "bureau"), path)
    return T.read_csv(spark, path, S.BUREAU)


@query("scan_limit", f"SELECT * FROM ({role_sql('bureau')}) ORDER BY SK_ID_BUREAU LIMIT {T.DEBUG_ROWS}")
def scan_limit(spark, sf):
    return T.first_rows(role(spark, sf, "bureau"), T.DEBUG_ROWS, "SK_ID_BUREAU")


# every column with missing cells or integers that were read as doubles
_PAYLOAD = [K, "CNT_CHILDREN", "OWN_CAR_AGE", "NAME_TYPE_SUITE", "FLAG_MOBIL", "AMT_INCOME_TOTAL"]


@query("payload_rows", with_roles(f"""
    SELECT {K}, CNT_CHILDREN, OWN_CAR_AGE, NAME_TYPE_SUITE, FLAG_MOBIL, AMT_INCOME_TOTAL,
           CAST({len(S.REQUEST_COLUMNS)} AS INT) AS fields FROM application""", "application"))
def payload_rows(spark, sf):
    # integers arrive as doubles when a column has missing cells
    wide = role(spark, sf, "application").withColumn("CNT_CHILDREN", F.col("CNT_CHILDREN").cast("double"))
    payload = T.to_payload(wide, S.REQUEST_COLUMNS, S.INTEGER_FIELDS)
    kinds = {f.name: f.dataType.simpleString() for f in S.APPLICATION.fields}
    parsed = F.from_json("payload", ", ".join(f"{c} {kinds[c]}" for c in _PAYLOAD))
    return (payload.select(parsed.alias("p"), F.size(F.json_object_keys("payload")).alias("fields"))
            .select("p.*", "fields"))


# --- projections and filters ---------------------------------------------------------------------
@query("filter_category", with_roles(
    f"SELECT {K}, CODE_GENDER FROM application WHERE CODE_GENDER IS DISTINCT FROM 'XNA'", "application"))
def filter_category(spark, sf):
    return E.drop_gender(role(spark, sf, "application")).select(K, "CODE_GENDER")


@query("filter_notnull", with_roles(
    f"SELECT {K}, AMT_INCOME_TOTAL FROM application WHERE AMT_INCOME_TOTAL IS NOT NULL", "application"))
def filter_notnull(spark, sf):
    return role(spark, sf, "application").where(F.col("AMT_INCOME_TOTAL").isNotNull()).select(K, "AMT_INCOME_TOTAL")


@query("sentinel_null", f"""
    SELECT SK_ID_PREV, {', '.join(f'nullif({c}, 365243) AS {c}' for c in P.PREVIOUS_DATES)}
    FROM ({role_sql('previous_application')})""")
def sentinel_null(spark, sf):
    return P.clean_previous(role(spark, sf, "previous_application")).select("SK_ID_PREV", *P.PREVIOUS_DATES)


def ratio_sql(a: str, b: str) -> str:
    clean = {"DAYS_EMPLOYED": "nullif(DAYS_EMPLOYED, 365243)"}
    return f"CAST({clean.get(a, a)} AS DOUBLE) / nullif({clean.get(b, b)}, 0)"


@query("app_ratios", with_roles(
    f"SELECT {K}, " + ", ".join(f"{ratio_sql(a, b)} AS {n}" for n, (a, b) in RATIOS.items())
    + " FROM application", "application"), list(RATIOS))
def app_ratios(spark, sf):
    return role(spark, sf, "application").select(K, *E.ratios())


@query("child_ratio_inf", f"""
    SELECT SK_ID_PREV, CASE WHEN AMT_CREDIT = 0 AND AMT_APPLICATION > 0 THEN CAST('inf' AS DOUBLE)
        WHEN AMT_CREDIT = 0 THEN NULL ELSE AMT_APPLICATION / AMT_CREDIT END AS APP_CREDIT_PERC
    FROM ({role_sql('previous_application')})""", ["APP_CREDIT_PERC"])
def child_ratio_inf(spark, sf):
    return P.clean_previous(role(spark, sf, "previous_application")).select("SK_ID_PREV", "APP_CREDIT_PERC")


@query("payment_diff", f"SELECT SK_ID_PREV, PAYMENT_DIFF FROM ({FS.payment_sql()})", ["PAYMENT_DIFF"])
def payment_diff(spark, sf):
    return P.payment_measures(role(spark, sf, "installments_payments")).select("SK_ID_PREV", "PAYMENT_DIFF")


@query("dpd_dbd", f"SELECT SK_ID_PREV, DPD, DBD FROM ({FS.payment_sql()})")
def dpd_dbd(spark, sf):
    return P.payment_measures(role(spark, sf, "installments_payments")).select("SK_ID_PREV", "DPD", "DBD")


_CLAMPED = {"DAYS_BIRTH": (-25550, -6570), "CNT_CHILDREN": (0, 20), "CNT_FAM_MEMBERS": (1, 20),
            "EXT_SOURCE_1": (0, 1), "OWN_CAR_AGE": (0, 100)}


@query("clamp_bounds", with_roles(
    f"SELECT {K}, " + ", ".join(
        f"CASE WHEN {c} * 1.5 < {lo} THEN {lo} WHEN {c} * 1.5 > {hi} THEN {hi} ELSE CAST({c} * 1.5 AS DOUBLE) END "
        f"AS {c}" for c, (lo, hi) in _CLAMPED.items())
    + ", CASE WHEN c_sum < 1 THEN 1 ELSE c_sum END AS AMT_ANNUITY "
    "FROM (SELECT *, CAST(AMT_ANNUITY - 800 AS DOUBLE) AS c_sum FROM application)", "application"))
def clamp_bounds(spark, sf):
    app = role(spark, sf, "application")
    return app.select(K, *[scenario.clamp(c, col(c).cast("double") * 1.5).alias(c) for c in _CLAMPED],
                      scenario.clamp("AMT_ANNUITY", F.col("AMT_ANNUITY") - 800).alias("AMT_ANNUITY"))


@query("inf_to_null", f"""
    SELECT SK_ID_PREV, CASE WHEN AMT_INSTALMENT = 0 THEN NULL ELSE AMT_PAYMENT / AMT_INSTALMENT END AS PAYMENT_PERC
    FROM ({role_sql('installments_payments')})""", ["PAYMENT_PERC"])
def inf_to_null(spark, sf):
    rows = P.payment_measures(role(spark, sf, "installments_payments"))
    return rows.select("SK_ID_PREV", M.finite_or_null(F.col("PAYMENT_PERC")).alias("PAYMENT_PERC"))


def dummy_sql(column: str, value: str) -> str:
    return f"CASE WHEN {column} = '{value}' THEN 1 ELSE 0 END"


_DUMMIES = [(c, v) for c, values in E.vocabulary.APPLICATION.items() for v in values]


@query("sanitize_names", with_roles(
    f"SELECT {K}, " + ", ".join(f'{dummy_sql(c, v)} AS "{safe_name(f"{c}_{v}")}"' for c, v in _DUMMIES)
    + " FROM application", "application"))
def sanitize_names(spark, sf):
    app = role(spark, sf, "application")
    return A.sanitize(app.select(K, *E.dummies(E.vocabulary.APPLICATION, app.columns)))


@query("onehot_pinned", with_roles(
    f"SELECT {K}, " + ", ".join(f'{dummy_sql(c, v)} AS "{c}_{v}"' for c, v in _DUMMIES if c != "EMERGENCYSTATE_MODE")
    + ', 0 AS "EMERGENCYSTATE_MODE_No", 0 AS "EMERGENCYSTATE_MODE_Yes" FROM application', "application"))
def onehot_pinned(spark, sf):
    # a column that is not there at all gives zeros
    app = role(spark, sf, "application").drop("EMERGENCYSTATE_MODE")
    return app.select(K, *E.dummies(E.vocabulary.APPLICATION, app.columns))


_CONTRACT = ["AMT_CREDIT", "EXT_SOURCE_1", "NOT_THERE", "INCOME_CREDIT_PERC"]


@query("align_contract", with_roles(f"""
    SELECT {K}, AMT_CREDIT, EXT_SOURCE_1, CAST(NULL AS DOUBLE) AS NOT_THERE,
           AMT_INCOME_TOTAL / nullif(AMT_CREDIT, 0) AS INCOME_CREDIT_PERC FROM application""", "application"),
       ["INCOME_CREDIT_PERC"])
def align_contract(spark, sf):
    app = role(spark, sf, "application")
    return A.align(app.select("*", *E.ratios()), _CONTRACT, keep=[K])


@query("dedup_columns", with_roles(f"""
    SELECT a.{K}, a.AMT_ANNUITY, b.n FROM application a LEFT JOIN
    (SELECT {K}, max(AMT_ANNUITY) AS AMT_ANNUITY, count(*) AS n FROM bureau GROUP BY {K}) b USING ({K})""",
    "application", "bureau"))
def dedup_columns(spark, sf):
    per_client = role(spark, sf, "bureau").groupBy(K).agg(F.max("AMT_ANNUITY").alias("AMT_ANNUITY"),
                                                         F.count(F.lit(1)).alias("n"))
    return A.beside(role(spark, sf, "application").select(K, "AMT_ANNUITY"), per_client, K)


_FLOATS = ["EXT_SOURCE_1", "EXT_SOURCE_2", "APARTMENTS_AVG"]


@query("cast_float32", with_roles(
    f"SELECT {K}, " + ", ".join(f"CAST({c} AS FLOAT) AS {c}" for c in _FLOATS) + " FROM application", "application"))
def cast_float32(spark, sf):
    return A.to_single_precision(role(spark, sf, "application").select(K, *_FLOATS), _FLOATS)


@query("log_success", with_roles("SELECT id, probability_default FROM prediction_log WHERE status_code = 200",
                                 "prediction_log"))
def log_success(spark, sf):
    return successful(role(spark, sf, "prediction_log")).select("id", "probability_default")


@query("relabel", with_roles("""
    SELECT id, CASE WHEN client_known THEN 'known' ELSE 'unknown' END AS type,
           CASE decision WHEN 'GRANTED' THEN 'yes' WHEN 'REFUSED' THEN 'no' END AS granted
    FROM prediction_log""", "prediction_log"))
def relabel(spark, sf):
    answers = F.create_map(F.lit("GRANTED"), F.lit("yes"), F.lit("REFUSED"), F.lit("no"))
    return role(spark, sf, "prediction_log").select(
        "id", F.when(F.col("client_known"), "known").otherwise("unknown").alias("type"),
        F.try_element_at(answers, "decision").alias("granted"))


# --- validation ------------------------------------------------------------------------------------
def _union_sql(tests: dict[str, str]) -> str:
    counts = ", ".join(f'count(*) FILTER (WHERE {test}) AS "{name}"' for name, test in tests.items())
    return with_roles(f"UNPIVOT (SELECT {counts} FROM application) ON COLUMNS(*) INTO NAME rule VALUE broken",
                      "application")


_RANGE_SQL = {f"range:{c}": f"NOT ({c} BETWEEN {lo} AND {hi})" for (lo, hi), cs in S.RANGES.items() for c in cs}
_RANGE_SQL |= {f"positive:{c}": f"NOT ({c} > 0)" for c in S.POSITIVE}
_FLAG_SQL = {f"flag:{c}": f"{c} <> 0 AND {c} <> 1" for c in S.FLAGS}
_ENUM_SQL = {f"enum:{c}": f"{c} NOT IN (" + ", ".join(f"'{v}'" for v in vs) + ")" for c, vs in S.ENUMS.items()}
_REQUIRED_SQL = {f"required:{c}": f"{c} IS NULL" for c in S.REQUIRED}


def _rules(name: str, make, tests: dict[str, str]) -> None:
    @query(name, _union_sql(tests))
    def run(spark, sf):
        app = role(spark, sf, "application")
        return V.broken_per_rule(app, make(app.columns))


_rules("validate_ranges", V.range_rules, _RANGE_SQL)
_rules("validate_flags", V.flag_rules, _FLAG_SQL)
_rules("validate_enums", V.enum_rules, _ENUM_SQL)
_rules("validate_required", V.required_rules, _REQUIRED_SQL)


def _reasons_sql() -> str:
    tests = {**_RANGE_SQL, **_FLAG_SQL, **_ENUM_SQL, **_REQUIRED_SQL}
    one = ", ".join(f"CASE WHEN {t} THEN '{n}' END" for n, t in tests.items())
    return (f"SELECT {K}, coalesce(array_to_string(list_sort([x FOR x IN [{one}] IF x IS NOT NULL]), ','), '') "
            "AS reasons FROM application")


@query("validate_quarantine", with_roles(
    f"SELECT {K}, CASE WHEN reasons = '' THEN 'valid' ELSE 'rejected' END AS verdict, reasons "
    f"FROM ({_reasons_sql()})", "application"))
def validate_quarantine(spark, sf):
    valid, rejected = V.split(V.check_requests(role(spark, sf, "application")))
    return (valid.select(K, F.lit("valid").alias("verdict"), F.lit("").alias("reasons"))
            .unionByName(rejected.select(K, F.lit("rejected").alias("verdict"),
                                         F.array_join(F.array_sort(V.ERRORS), ",").alias("reasons"))))


_REQUEST = f"""concat('{{"{K}": ', CAST({K} AS STRING), ', "AMT_CREDIT": 1.5, ',
    CASE WHEN {K} % 4 = 0 THEN '"AMT_CREDITS": 2, ' WHEN {K} % 4 = 1 THEN '"NOTE": "x, y", "TARGET": 1, ' ELSE '' END,
    '"CODE_GENDER": null}}')"""


@query("validate_unknown", with_roles(f"""SELECT {K}, array_to_string(list_sort(
      [f FOR f IN json_keys(payload) IF f NOT IN ({', '.join(repr(c) for c in S.REQUEST_COLUMNS)})]), ',') AS unknown,
    len([c FOR c IN [{', '.join(repr(c) for c in S.REQUIRED)}] IF NOT list_contains(json_keys(payload), c)]) AS n_absent
    FROM (SELECT {K}, {_REQUEST} AS payload FROM application)""", "application"))
def validate_unknown(spark, sf):
    requests = role(spark, sf, "application").select(K, F.expr(_REQUEST).alias("payload"))
    payload = F.col("payload")
    return requests.select(K, F.concat_ws(",", V.unknown_fields(payload)).alias("unknown"),
                           F.size(V.absent_fields(payload)).cast("bigint").alias("n_absent"))
