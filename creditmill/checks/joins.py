"""Small roll-ups, store joins and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditmill.checks import family_sql as FS
from creditmill.checks.registry import SQL, query
from creditmill.checks.roles import bucketed, child_tables, placed_role, role, role_sql, with_roles
from creditmill.checks.rows import dummy_sql, ratio_sql
from creditmill.contract import features as C
from creditmill.contract import schema as S
from creditmill.contract import vocabulary as V
from creditmill.contract.schema import Model
from creditmill.functions.names import col
from creditmill.operators import align as A
from creditmill.operators import encode as E
from creditmill.operators import evaluate as EV
from creditmill.operators import profile as PR
from creditmill.operators import validate as VA
from creditmill.operators.rollup import Rollup
from creditmill.plans import families as P
from creditmill.plans import feature_store as FST
from creditmill.plans import scoring as SC
from creditmill.plans.prediction_log import features_json
from creditmill.session import joins_in_place, new_table_path
from creditmill.sources import tables as T

K = S.KEY
MODEL = Model(threshold=0.33, version="2")


# --- one statistic at a time -----------------------------------------------------------------------
def _rollup(name: str, spec: Rollup, source: str, prepare=lambda df: df, source_sql: str | None = None) -> None:
    @query(name, FS.family_sql(spec, source_sql or role_sql(source)), spec.output_columns())
    def run(spark, sf):
        return spec.apply(prepare(role(spark, sf, source)), K)


_AMOUNTS = ("AMT_BALANCE", "AMT_CREDIT_LIMIT_ACTUAL", "AMT_DRAWINGS_CURRENT", "AMT_DRAWINGS_ATM_CURRENT")
_rollup("agg_basic", Rollup("CC", {c: ("min", "max", "mean", "sum") for c in _AMOUNTS}), "credit_card_balance")
_rollup("agg_var", Rollup("CC", {c: ("var",) for c in _AMOUNTS}), "credit_card_balance")
_rollup("agg_size", Rollup("POS", {"MONTHS_BALANCE": ("size",)}, count="POS_COUNT"), "POS_CASH_balance")
_VERSIONS = {"NUM_INSTALMENT_VERSION": ("nunique",)}
_rollup("agg_nunique", Rollup("INSTAL", _VERSIONS, gather=False), "installments_payments")
_rollup("agg_nunique_codes", Rollup("INSTAL", _VERSIONS, codes=tuple(_VERSIONS), gather=False), "installments_payments")
_rollup("category_share", Rollup("POS", shares=V.POS_CASH), "POS_CASH_balance")
_NUMBERS = {"AMT_CREDIT_SUM_DEBT": ("max", "mean", "sum"), "DAYS_CREDIT": ("min", "var"), "AMT_CREDIT_SUM": ("sum",)}
_rollup("agg_subset_active", Rollup("BURO", _NUMBERS, subsets=P.BUREAU.subsets), "bureau")
_rollup("agg_subset_status", Rollup("PREV", {"AMT_DOWN_PAYMENT": ("mean",), "CNT_PAYMENT": ("mean", "sum")},
                                    subsets=P.PREVIOUS.subsets), "previous_application")

_TWO_LEVEL = Rollup("BURO", {k: v for k, v in P.BUREAU.numeric.items() if k.startswith("MONTHS_")},
                    carried=P.BUREAU.carried)
_WITH_BALANCE = (f"SELECT * FROM ({role_sql('bureau')}) LEFT JOIN "
                 f"({FS.family_sql(P.BALANCE, role_sql('bureau_balance'), 'SK_ID_BUREAU')}) USING (SK_ID_BUREAU)")


@query("two_level_rollup", FS.family_sql(_TWO_LEVEL, _WITH_BALANCE), _TWO_LEVEL.output_columns())
def two_level_rollup(spark, sf):
    joined = P.attach_balance(role(spark, sf, "bureau"), role(spark, sf, "bureau_balance"))
    return _TWO_LEVEL.apply(joined, K)


_BALANCE_COLUMNS = P.BALANCE.output_columns()


@query("join_balance_to_bureau", "SELECT SK_ID_BUREAU, " + ", ".join(f'"{c}"' for c in _BALANCE_COLUMNS)
       + f" FROM ({_WITH_BALANCE})", _BALANCE_COLUMNS)
def join_balance_to_bureau(spark, sf):
    joined = P.attach_balance(role(spark, sf, "bureau"), role(spark, sf, "bureau_balance"))
    return joined.select("SK_ID_BUREAU", *_BALANCE_COLUMNS)


_SUBSET_COLUMNS = [f"{p}_AMT_CREDIT_SUM_DEBT_{s}" for p in ("BURO", "ACTIVE", "CLOSED") for s in ("MAX", "SUM")]


@query("join_subset_left", with_roles(f"""
    SELECT * FROM (SELECT {K}, max(AMT_CREDIT_SUM_DEBT) AS "BURO_AMT_CREDIT_SUM_DEBT_MAX",
      coalesce(sum(AMT_CREDIT_SUM_DEBT), 0) AS "BURO_AMT_CREDIT_SUM_DEBT_SUM" FROM bureau GROUP BY {K})
    LEFT JOIN (SELECT {K}, max(AMT_CREDIT_SUM_DEBT) AS "ACTIVE_AMT_CREDIT_SUM_DEBT_MAX",
      coalesce(sum(AMT_CREDIT_SUM_DEBT), 0) AS "ACTIVE_AMT_CREDIT_SUM_DEBT_SUM"
      FROM bureau WHERE CREDIT_ACTIVE = 'Active' GROUP BY {K}) USING ({K})
    LEFT JOIN (SELECT {K}, max(AMT_CREDIT_SUM_DEBT) AS "CLOSED_AMT_CREDIT_SUM_DEBT_MAX",
      coalesce(sum(AMT_CREDIT_SUM_DEBT), 0) AS "CLOSED_AMT_CREDIT_SUM_DEBT_SUM"
      FROM bureau WHERE CREDIT_ACTIVE = 'Closed' GROUP BY {K}) USING ({K})""", "bureau"), _SUBSET_COLUMNS)
def join_subset_left(spark, sf):
    spec = Rollup("BURO", {"AMT_CREDIT_SUM_DEBT": ("max", "sum")}, subsets=P.BUREAU.subsets)
    return spec.apply(role(spark, sf, "bureau"), K)


# --- store -----------------------------------------------------------------------------------------
@query("feature_store", FS.store_sql(), C.store_features())
def feature_store(spark, sf):
    children = child_tables(spark, sf)
    return FST.feature_store(children.tables, children.family_buckets)


def saved_store(spark, sf):
    """The store as scoring finds it: built before, in buckets."""
    return with_store(spark, sf)[1]


def with_store(spark, sf, name=None):
    """The rows of a role, placed as the store is, and the saved store."""
    children = child_tables(spark, sf)
    with joins_in_place(spark):
        store = bucketed(FST.feature_store(children.tables, children.family_buckets), "store", children.buckets)
    return name and placed_role(spark, sf, name, children.buckets), store


@query("feature_store_roundtrip", FS.store_sql(), C.store_features())
def feature_store_roundtrip(spark, sf):
    children = child_tables(spark, sf)
    families = P.all_families(children.tables, children.family_buckets)
    with joins_in_place(spark):
        kept = [bucketed(f, f"family{i}", children.buckets) for i, f in enumerate(families)]
    return FST.full_outer_store(kept)


def _app_sql(source: str) -> dict[str, str]:
    """Feature name -> SQL over an application row."""
    plain = {}
    for name in C.application_features():
        if name in V.BINARY_CODES:
            cases = " ".join(f"WHEN '{v}' THEN {i}" for v, i in V.BINARY_CODES[name].items())
            plain[name] = f"CASE {source}.{name} {cases} END"
        elif name == "DAYS_EMPLOYED":
            plain[name] = f"nullif({source}.{name}, 365243)"
        elif name in S.REQUEST_COLUMNS:
            plain[name] = f"{source}.{name}"
    plain |= {f"{c}_{v}": dummy_sql(f"{source}.{c}", v) for c, vs in V.APPLICATION.items() for v in vs}
    plain |= {n: ratio_sql(f"{a}", f"{b}") for n, (a, b) in C.RATIOS.items()}
    return plain


def _finite(sql: str) -> str:
    return f"CASE WHEN isfinite(CAST({sql} AS DOUBLE)) THEN CAST({sql} AS DOUBLE) END"


def contract_sql(source: str) -> str:
    app = _app_sql(source)
    cells = []
    for name in C.feature_names():
        if name in app:
            cells.append(f'{_finite(app[name])} AS "{name}"')
        else:
            value = _finite(f's."{name}"')
            if name in ("POS_COUNT", "INSTAL_COUNT", "CC_COUNT") and source == "request":
                value = f"CASE WHEN s.{K} IS NULL THEN 0 ELSE {value} END"
            cells.append(f'{value} AS "{name}"')
    return ", ".join(cells)


_GENDER = "CODE_GENDER IS DISTINCT FROM 'XNA'"


@query("training_matrix", with_roles(
    f"SELECT application.{K}, TARGET, {contract_sql('application')} FROM application "
    f"LEFT JOIN store s ON s.{K} = application.{K} WHERE {_GENDER}", "application", store=FS.store_sql()),
    C.feature_names())
def training_matrix(spark, sf):
    children = child_tables(spark, sf)
    return FST.training_matrix(role(spark, sf, "application"), children.tables, children.family_buckets)


@query("reference_join", with_roles(f"""
    SELECT count(*) AS applications, count(s.k) AS joined, count(*) - count(s.k) AS dropped
    FROM application a LEFT JOIN (SELECT {K} AS k FROM store) s ON s.k = a.{K}
    WHERE {_GENDER}""", "application", store=FS.store_sql()))
def reference_join(spark, sf):
    return FST.dropped_applications(role(spark, sf, "application"), saved_store(spark, sf))


REFERENCE_SQL = (f"SELECT application.{K}, TARGET, {contract_sql('application')} FROM application "
                 f"JOIN store s ON s.{K} = application.{K} WHERE {_GENDER}")


@query("reference_rows", with_roles(REFERENCE_SQL, "application", store=FS.store_sql()), C.feature_names())
def reference_rows(spark, sf):
    return FST.reference_rows(*with_store(spark, sf, "application"))


# --- scoring ---------------------------------------------------------------------------------------
@query("score_assemble", with_roles(
    f"SELECT request.{K}, s.{K} IS NOT NULL AS client_known, {contract_sql('request')} FROM request "
    f"LEFT JOIN store s ON s.{K} = request.{K}", "request", store=FS.store_sql()), C.feature_names())
def score_assemble(spark, sf):
    return SC.assemble(*with_store(spark, sf, "request"))


def scored(spark, sf, keep=()):
    """Requests with the whole contract from the whole store, scored with the test scorer."""
    assembled = SC.assemble(*with_store(spark, sf, "request"))
    return SC.respond(assembled, SC.income_credit_score(), MODEL, keep)


_P = ("greatest(0, least(1, 1 - CAST(CAST(coalesce(AMT_INCOME_TOTAL, 0) AS FLOAT) AS DOUBLE) / "
      "greatest(CAST(CAST(coalesce(AMT_CREDIT, 1) AS FLOAT) AS DOUBLE), 1)))")
SCORED_SQL = f"SELECT *, CASE WHEN p >= {0.33} THEN 'REFUSED' ELSE 'GRANTED' END AS d FROM " \
             f"(SELECT *, {_P} AS p FROM request)"


@query("score_batch", with_roles(f"""
    SELECT request.{K} AS sk_id_curr, {contract_sql('request')},
      p AS probability_default, d AS decision, CAST(0.33 AS DOUBLE) AS threshold, '2' AS model_version,
      s.{K} IS NOT NULL AS client_known
    FROM ({SCORED_SQL}) request LEFT JOIN store s ON s.{K} = request.{K}""", "request", store=FS.store_sql()),
    ["probability_default", *C.feature_names()])
def score_batch(spark, sf):
    return scored(spark, sf, C.feature_names())


@query("decide", with_roles(f"SELECT {K} AS sk_id_curr, p AS probability_default, d AS decision FROM ({SCORED_SQL})",
                            "request"), ["probability_default"])
def decide(spark, sf):
    requests = role(spark, sf, "request")
    p = SC.income_credit_score()
    return requests.select(col(K).alias("sk_id_curr"), p.alias("probability_default"),
                           SC.decide(p, MODEL.threshold).alias("decision"))


@query("score_external", with_roles(f"SELECT {K}, p AS probability_default FROM ({SCORED_SQL})", "request"),
       ["probability_default"])
def score_external(spark, sf):
    names = C.feature_names()
    of_credit, of_income = names.index("AMT_CREDIT"), names.index("AMT_INCOME_TOTAL")

    def load():
        import numpy as np

        def predict(batch):
            if batch.shape[1] != len(names) or batch.dtype != np.float32:
                raise ValueError("the scorer takes the whole contract at single precision")
            credit = np.maximum(np.nan_to_num(batch[:, of_credit].astype("float64"), nan=1.0), 1.0)
            income = np.nan_to_num(batch[:, of_income].astype("float64"), nan=0.0)
            p = np.clip(1.0 - income / credit, 0.0, 1.0)
            return np.column_stack([1.0 - p, p])

        return predict

    assembled = SC.assemble(*with_store(spark, sf, "request"))
    return SC.score_with(assembled, names, load, [K])


@query("client_known", with_roles(f"""
    SELECT r.{K} AS sk_id_curr, s.{K} IS NOT NULL AS client_known
    FROM request r LEFT JOIN store s ON s.{K} = r.{K}""", "request", store=FS.store_sql()))
def client_known(spark, sf):
    return scored(spark, sf).select("sk_id_curr", "client_known")


@query("validate_scores", with_roles(f"""
    UNPIVOT (SELECT count(*) FILTER (WHERE NOT (p BETWEEN 0 AND 1)) AS probability,
      count(*) FILTER (WHERE NOT (0.33 BETWEEN 0 AND 1)) AS threshold,
      count(*) FILTER (WHERE d NOT IN ('GRANTED', 'REFUSED')) AS decision FROM ({SCORED_SQL}))
    ON COLUMNS(*) INTO NAME rule VALUE broken""", "request"))
def validate_scores(spark, sf):
    return VA.broken_per_rule(scored(spark, sf), VA.score_rules())


@query("features_to_json", with_roles(f"""
    SELECT request.{K}, {contract_sql('request')}, CAST({len(C.feature_names())} AS INT) AS fields
    FROM request LEFT JOIN store s ON s.{K} = request.{K}""", "request", store=FS.store_sql()),
    C.feature_names())
def features_to_json(spark, sf):
    # the text of a double differs between engines, so the document is read back
    assembled = SC.assemble(*with_store(spark, sf, "request"))
    doc = assembled.select(K, features_json(C.feature_names()).alias("doc"))
    parsed = F.from_json("doc", ", ".join(f"`{c}` DOUBLE" for c in C.feature_names()))
    return doc.select(K, parsed.alias("p"), F.size(F.json_object_keys("doc")).alias("fields")).select(
        K, "p.*", "fields")


# --- encoders fitted on data -------------------------------------------------------------------------
@query("binary_encode", with_roles(
    f"SELECT {K}, " + ", ".join(
        f"CASE {c} " + " ".join(f"WHEN '{v}' THEN {i}" for v, i in codes.items()) + f" END AS {c}"
        for c, codes in V.BINARY_CODES.items()) + " FROM application", "application"))
def binary_encode(spark, sf):
    return role(spark, sf, "application").select(
        K, *[E.encode_binary(c, codes).alias(c) for c, codes in V.BINARY_CODES.items()])


@query("binary_fit", with_roles(
    " UNION ALL ".join(f"""SELECT '{c}' AS "column", {c} AS value,
      CAST(row_number() OVER (ORDER BY min({K})) - 1 AS INT) AS code
      FROM application WHERE {c} IS NOT NULL AND CODE_GENDER IS DISTINCT FROM 'XNA' GROUP BY {c}"""
                       for c in V.BINARY_CODES), "application"))
def binary_fit(spark, sf):
    return E.fit_binary_codes(E.drop_gender(role(spark, sf, "application")), list(V.BINARY_CODES), K)


_TEXT = list(V.APPLICATION) + list(V.BINARY_CODES)


@query("vocabulary", with_roles(" UNION ALL ".join(
    f"""SELECT DISTINCT '{c}' AS "column", {c} AS value FROM application WHERE {c} IS NOT NULL""" for c in _TEXT),
    "application"))
def vocabulary(spark, sf):
    return PR.vocabulary(role(spark, sf, "application"), _TEXT)


@query("artefact_roundtrip", SQL["vocabulary"])
def artefact_roundtrip(spark, sf):
    # a vocabulary is one JSON document: as many entries as the columns have categories
    listed = {r.column: r["values"] for r in PR.vocabulary(role(spark, sf, "application"), _TEXT)
              .groupBy("column").agg(F.sort_array(F.collect_list("value")).alias("values")).collect()}
    path = new_table_path(spark, "vocabulary")
    T.write_artefact(spark, listed, path)
    back = T.read_artefact(spark, path)
    return spark.createDataFrame([(c, v) for c, values in back.items() for v in values], "column string, value string")


_KINDS = {f.name: {"long": "bigint", "double": "double", "string": "string"}[f.dataType.typeName()]
          for f in S.APPLICATION.fields}


def _profile_sql() -> str:
    parts = []
    for c, kind in _KINDS.items():
        number = "CAST(NULL AS DOUBLE)" if kind == "string" else None
        parts.append(f"""SELECT '{c}' AS "column", '{kind}' AS dtype, count(*) FILTER (WHERE {c} IS NULL) AS n_missing,
          {number or f'CAST(min({c}) AS DOUBLE)'} AS "min", {number or f'CAST(max({c}) AS DOUBLE)'} AS "max",
          {number or f'CAST(arg_min({c}, {K}) FILTER (WHERE {c} IS NOT NULL) AS DOUBLE)'} AS sample
          FROM application""")
    return " UNION ALL ".join(parts)


@query("column_profile", with_roles(_profile_sql(), "application"))
def column_profile(spark, sf):
    return PR.column_profile(role(spark, sf, "application"), K)


@query("dtype_counts", with_roles(
    "SELECT dtype, count(*) AS n_columns, CAST(sum(n_missing) AS BIGINT) AS n_missing "
    f"FROM ({_profile_sql()}) GROUP BY dtype", "application"))
def dtype_counts(spark, sf):
    return PR.type_counts(PR.column_profile(role(spark, sf, "application"), K))


@query("missing_table", with_roles("""SELECT "column", missing, round_even(100 * missing / n, 1) AS percent FROM ("""
       + " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE {c} IS NULL) AS missing,
         count(*) AS n FROM application""" for c in _KINDS) + ") WHERE missing > 0", "application"))
def missing_table(spark, sf):
    return PR.missing_table(role(spark, sf, "application"))


@query("target_distribution", with_roles("""SELECT TARGET, count(*) AS count,
    count(*) / (SELECT count(*) FROM application) AS share FROM application GROUP BY TARGET""", "application"))
def target_distribution(spark, sf):
    counts = PR.value_counts(role(spark, sf, "application"), S.LABEL)
    return counts.select(S.LABEL, "count", (F.col("count") / counts.agg(F.sum("count")).scalar()).alias("share"))


@query("no_history_template", with_roles(f"""
    SELECT request.{K}, {contract_sql('request')} FROM request LEFT JOIN store s ON s.{K} = request.{K}
    WHERE s.{K} IS NULL""", "request", store=FS.store_sql()), C.feature_names())
def no_history_template(spark, sf):
    assembled = SC.assemble(*with_store(spark, sf, "request"))
    return assembled.where(~F.col("client_known")).select(K, *[col(c) for c in C.feature_names()])


_POS_FILLED = """MONTHS_BALANCE:MAX MONTHS_BALANCE:MEAN MONTHS_BALANCE:SIZE SK_DPD:MAX SK_DPD:MEAN SK_DPD_DEF:MAX
    SK_DPD_DEF:MEAN""".split()
_POS_NAMES = ([f"POS_{n.replace(':', '_')}" for n in _POS_FILLED] + ["POS_COUNT"]
              + [f"POS_NAME_CONTRACT_STATUS_{v}_MEAN" for v in [*V.POS_CASH["NAME_CONTRACT_STATUS"], "nan"]])


@query("template_contract", with_roles(" UNION ALL ".join(
    [f"""SELECT '{n}' AS "column", true AS in_contract, count("{n}") AS filled FROM pos""" for n in _POS_NAMES]
    + ["SELECT 'LEGACY_SCORE', false, count(*) FROM pos"]
    + [f"""SELECT '{n}', true, CAST(NULL AS BIGINT)""" for n in ("PAYMENT_RATE", "CC_COUNT")]), pos=FS.pos_sql()))
def template_contract(spark, sf):
    # a store of one family with a column of an older contract, against a contract with two names it lacks
    store = P.pos_family(role(spark, sf, "POS_CASH_balance")).withColumn("LEGACY_SCORE", F.lit(0.5))
    contract = [n for n in C.feature_names() if n.startswith("POS_") or n in ("PAYMENT_RATE", "CC_COUNT")]
    return A.column_report(store, contract, [K])
