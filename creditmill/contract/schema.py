"""Schemas of the seven input tables and the prediction log, and the request rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from creditmill.contract import vocabulary

KEY = "SK_ID_CURR"
LABEL = "TARGET"
GENDER_TO_DROP = "XNA"  # fixed value

# --- fixed values: names of the application columns ---------------------------------------
_BUILDING = ["APARTMENTS", "BASEMENTAREA", "YEARS_BEGINEXPLUATATION", "YEARS_BUILD", "COMMONAREA", "ELEVATORS",
             "ENTRANCES", "FLOORSMAX", "FLOORSMIN", "LANDAREA", "LIVINGAPARTMENTS", "LIVINGAREA",
             "NONLIVINGAPARTMENTS", "NONLIVINGAREA"]
BUILDING_RATIOS = [f"{name}_{kind}" for kind in ("AVG", "MODE", "MEDI") for name in _BUILDING]
EXTERNAL_SCORES = [f"EXT_SOURCE_{i}" for i in (1, 2, 3)]
DOCUMENT_FLAGS = [f"FLAG_DOCUMENT_{i}" for i in range(2, 22)]
CONTACT_FLAGS = ["FLAG_MOBIL", "FLAG_EMP_PHONE", "FLAG_WORK_PHONE", "FLAG_CONT_MOBILE", "FLAG_PHONE", "FLAG_EMAIL"]
ADDRESS_FLAGS = ["REG_REGION_NOT_LIVE_REGION", "REG_REGION_NOT_WORK_REGION", "LIVE_REGION_NOT_WORK_REGION",
                 "REG_CITY_NOT_LIVE_CITY", "REG_CITY_NOT_WORK_CITY", "LIVE_CITY_NOT_WORK_CITY"]
SOCIAL_CIRCLE = [f"{kind}_{days}_CNT_SOCIAL_CIRCLE" for days in (30, 60) for kind in ("OBS", "DEF")]
BUREAU_REQUESTS = [f"AMT_REQ_CREDIT_BUREAU_{unit}" for unit in ("HOUR", "DAY", "WEEK", "MON", "QRT", "YEAR")]

_COLUMN_ORDER: list[tuple[str, str]] = (
    [(KEY, "int"), (LABEL, "int"), ("NAME_CONTRACT_TYPE", "string"), ("CODE_GENDER", "string"),
     ("FLAG_OWN_CAR", "string"), ("FLAG_OWN_REALTY", "string"), ("CNT_CHILDREN", "int"),
     ("AMT_INCOME_TOTAL", "double"), ("AMT_CREDIT", "double"), ("AMT_ANNUITY", "double"),
     ("AMT_GOODS_PRICE", "double"), ("NAME_TYPE_SUITE", "string"), ("NAME_INCOME_TYPE", "string"),
     ("NAME_EDUCATION_TYPE", "string"), ("NAME_FAMILY_STATUS", "string"), ("NAME_HOUSING_TYPE", "string"),
     ("REGION_POPULATION_RELATIVE", "double"), ("DAYS_BIRTH", "int"), ("DAYS_EMPLOYED", "int"),
     ("DAYS_REGISTRATION", "double"), ("DAYS_ID_PUBLISH", "int"), ("OWN_CAR_AGE", "double")]
    + [(name, "int") for name in CONTACT_FLAGS]
    + [("OCCUPATION_TYPE", "string"), ("CNT_FAM_MEMBERS", "double"), ("REGION_RATING_CLIENT", "int"),
       ("REGION_RATING_CLIENT_W_CITY", "int"), ("WEEKDAY_APPR_PROCESS_START", "string"),
       ("HOUR_APPR_PROCESS_START", "int")]
    + [(name, "int") for name in ADDRESS_FLAGS]
    + [("ORGANIZATION_TYPE", "string")]
    + [(name, "double") for name in EXTERNAL_SCORES + BUILDING_RATIOS]
    + [("FONDKAPREMONT_MODE", "string"), ("HOUSETYPE_MODE", "string"), ("TOTALAREA_MODE", "double"),
       ("WALLSMATERIAL_MODE", "string"), ("EMERGENCYSTATE_MODE", "string")]
    + [(name, "double") for name in SOCIAL_CIRCLE]
    + [("DAYS_LAST_PHONE_CHANGE", "double")]
    + [(name, "int") for name in DOCUMENT_FLAGS]
    + [(name, "double") for name in BUREAU_REQUESTS]
)


def _struct(columns: list[tuple[str, str]]) -> T.StructType:
    kinds = {"int": T.LongType(), "double": T.DoubleType(), "string": T.StringType()}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in columns])


APPLICATION = _struct(_COLUMN_ORDER)
REQUEST_COLUMNS = [name for name, _ in _COLUMN_ORDER if name != LABEL]

# --- fixed values: request rules -------------------------------------------------------------
# (low, high) closed bounds; None = open on that side
RANGES: dict[tuple[float | None, float | None], list[str]] = {
    (100000, 999999999): [KEY],
    (0, 20): ["CNT_CHILDREN"],
    (0, 1): ["REGION_POPULATION_RELATIVE", *EXTERNAL_SCORES, *BUILDING_RATIOS, "TOTALAREA_MODE"],
    (-25550, -6570): ["DAYS_BIRTH"],
    (-25000, 365243): ["DAYS_EMPLOYED"],
    (-25000, 0): ["DAYS_REGISTRATION"],
    (-10000, 0): ["DAYS_ID_PUBLISH"],
    (0, 100): ["OWN_CAR_AGE"],
    (1, 20): ["CNT_FAM_MEMBERS"],
    (1, 3): ["REGION_RATING_CLIENT", "REGION_RATING_CLIENT_W_CITY"],
    (0, 23): ["HOUR_APPR_PROCESS_START"],
    (0, 500): [*SOCIAL_CIRCLE, *BUREAU_REQUESTS],
    (-15000, 0): ["DAYS_LAST_PHONE_CHANGE"],
}
POSITIVE = ["AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "AMT_GOODS_PRICE"]
FLAGS = CONTACT_FLAGS + ADDRESS_FLAGS + DOCUMENT_FLAGS
ENUMS: dict[str, list[str]] = {
    **vocabulary.APPLICATION,
    **{name: sorted(codes) for name, codes in vocabulary.BINARY_CODES.items()},
}
OPTIONAL = (
    ["AMT_ANNUITY", "AMT_GOODS_PRICE", "NAME_TYPE_SUITE", "OWN_CAR_AGE", "OCCUPATION_TYPE", "FONDKAPREMONT_MODE",
     "HOUSETYPE_MODE", "TOTALAREA_MODE", "WALLSMATERIAL_MODE", "EMERGENCYSTATE_MODE"]
    + EXTERNAL_SCORES + BUILDING_RATIOS + SOCIAL_CIRCLE + BUREAU_REQUESTS
)
REQUIRED = [name for name in REQUEST_COLUMNS if name not in set(OPTIONAL)]
INTEGER_FIELDS = [name for name, kind in _COLUMN_ORDER if kind == "int" and name != LABEL]

# --- fixed values: child tables ---------------------------------------------------------------
BUREAU = _struct([
    (KEY, "int"), ("SK_ID_BUREAU", "int"), ("CREDIT_ACTIVE", "string"), ("CREDIT_CURRENCY", "string"),
    ("DAYS_CREDIT", "int"), ("CREDIT_DAY_OVERDUE", "int"), ("DAYS_CREDIT_ENDDATE", "double"),
    ("AMT_CREDIT_MAX_OVERDUE", "double"), ("CNT_CREDIT_PROLONG", "int"), ("AMT_CREDIT_SUM", "double"),
    ("AMT_CREDIT_SUM_DEBT", "double"), ("AMT_CREDIT_SUM_LIMIT", "double"), ("AMT_CREDIT_SUM_OVERDUE", "double"),
    ("CREDIT_TYPE", "string"), ("DAYS_CREDIT_UPDATE", "int"), ("AMT_ANNUITY", "double"),
])
BUREAU_BALANCE = _struct([("SK_ID_BUREAU", "int"), ("MONTHS_BALANCE", "int"), ("STATUS", "string")])
PREVIOUS = _struct(
    [("SK_ID_PREV", "int"), (KEY, "int")]
    + [(name, "double") for name in ("AMT_ANNUITY", "AMT_APPLICATION", "AMT_CREDIT", "AMT_DOWN_PAYMENT",
                                     "AMT_GOODS_PRICE")]
    + [("HOUR_APPR_PROCESS_START", "int"), ("RATE_DOWN_PAYMENT", "double"), ("DAYS_DECISION", "int"),
       ("CNT_PAYMENT", "double")]
    + [(name, "double") for name in ("DAYS_FIRST_DRAWING", "DAYS_FIRST_DUE", "DAYS_LAST_DUE_1ST_VERSION",
                                     "DAYS_LAST_DUE", "DAYS_TERMINATION")]
    + [(name, "string") for name in vocabulary.PREVIOUS]
)
POS_CASH = _struct([("SK_ID_PREV", "int"), (KEY, "int"), ("MONTHS_BALANCE", "int"), ("SK_DPD", "int"),
                    ("SK_DPD_DEF", "int"), ("NAME_CONTRACT_STATUS", "string")])
INSTALLMENTS = _struct([("SK_ID_PREV", "int"), (KEY, "int"), ("NUM_INSTALMENT_VERSION", "double"),
                        ("DAYS_INSTALMENT", "double"), ("DAYS_ENTRY_PAYMENT", "double"),
                        ("AMT_INSTALMENT", "double"), ("AMT_PAYMENT", "double")])
CREDIT_CARD_NUMBERS = [
    "MONTHS_BALANCE", "AMT_BALANCE", "AMT_CREDIT_LIMIT_ACTUAL", "AMT_DRAWINGS_ATM_CURRENT", "AMT_DRAWINGS_CURRENT",
    "AMT_DRAWINGS_OTHER_CURRENT", "AMT_DRAWINGS_POS_CURRENT", "AMT_INST_MIN_REGULARITY", "AMT_PAYMENT_CURRENT",
    "AMT_PAYMENT_TOTAL_CURRENT", "AMT_RECEIVABLE_PRINCIPAL", "AMT_RECIVABLE", "AMT_TOTAL_RECEIVABLE",
    "CNT_DRAWINGS_ATM_CURRENT", "CNT_DRAWINGS_CURRENT", "CNT_DRAWINGS_OTHER_CURRENT", "CNT_DRAWINGS_POS_CURRENT",
    "CNT_INSTALMENT_MATURE_CUM", "SK_DPD", "SK_DPD_DEF"]
CREDIT_CARD = _struct([("SK_ID_PREV", "int"), (KEY, "int")] + [(name, "double") for name in CREDIT_CARD_NUMBERS]
                      + [("NAME_CONTRACT_STATUS", "string")])

# table name -> (file name, schema)
INPUT_TABLES: dict[str, T.StructType] = {
    "application_train": APPLICATION,
    "bureau": BUREAU,
    "bureau_balance": BUREAU_BALANCE,
    "previous_application": PREVIOUS,
    "POS_CASH_balance": POS_CASH,
    "installments_payments": INSTALLMENTS,
    "credit_card_balance": CREDIT_CARD,
}


# --- fixed values: prediction log --------------------------------------------------------------
PREDICTION_LOG = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("timestamp", T.TimestampType(), False),
    T.StructField("sk_id_curr", T.LongType(), False),
    T.StructField("client_known", T.BooleanType(), False),
    T.StructField("latency_ms", T.IntegerType(), False),
    T.StructField("feature_assembly_ms", T.IntegerType()),
    T.StructField("inference_ms", T.IntegerType()),
    T.StructField("inference_cpu_ms", T.IntegerType()),
    T.StructField("plumbing_ms", T.IntegerType()),
    T.StructField("db_log_ms", T.IntegerType()),
    T.StructField("status_code", T.IntegerType(), False),
    T.StructField("error_message", T.StringType()),
    T.StructField("raw_input", T.StringType(), False),
    T.StructField("features", T.StringType(), False),
    T.StructField("probability_default", T.DoubleType()),
    T.StructField("decision", T.StringType(), False),
    T.StructField("threshold", T.DoubleType(), False),
    T.StructField("model_version", T.StringType(), False),
    T.StructField("top_shap", T.StringType()),
    T.StructField("ground_truth", T.IntegerType()),
])
TIMINGS = ["latency_ms", "feature_assembly_ms", "inference_ms", "inference_cpu_ms", "db_log_ms", "plumbing_ms"]


@dataclass(frozen=True)
class Model:
    """What a scoring run needs to know of the model besides its scorer."""

    threshold: float = 0.33  # fixed value: default decision threshold
    version: str = "unknown"
