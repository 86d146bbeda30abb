"""Contract, encoding, assembly, decisions, validation."""

import pytest
from pyspark.sql import functions as F

from creditmill.contract import features as C
from creditmill.contract import schema as S
from creditmill.contract import vocabulary as V
from creditmill.contract.schema import Model
from creditmill.operators import validate as VA
from creditmill.operators.align import align, beside, contract_gaps
from creditmill.operators.encode import application_matrix, dummies, encode_binary, fit_binary_codes
from creditmill.operators.lookup import hot_keys, lookup_join
from creditmill.plans import scoring as SC
from creditmill.plans.families import FAMILIES

VALUES = {
    "SK_ID_CURR": 100002, "NAME_CONTRACT_TYPE": "Cash loans", "CODE_GENDER": "M", "FLAG_OWN_CAR": "N",
    "FLAG_OWN_REALTY": "Y", "CNT_CHILDREN": 0, "AMT_INCOME_TOTAL": 202500.0, "AMT_CREDIT": 406597.5,
    "AMT_ANNUITY": 24700.5, "AMT_GOODS_PRICE": 351000.0, "NAME_TYPE_SUITE": "Unaccompanied",
    "NAME_INCOME_TYPE": "Working", "NAME_EDUCATION_TYPE": "Higher education", "NAME_FAMILY_STATUS": "Married",
    "NAME_HOUSING_TYPE": "House / apartment", "REGION_POPULATION_RELATIVE": 0.0188, "DAYS_BIRTH": -9461,
    "DAYS_EMPLOYED": -637, "DAYS_REGISTRATION": -3648.0, "DAYS_ID_PUBLISH": -2120, "OCCUPATION_TYPE": "Laborers",
    "CNT_FAM_MEMBERS": 1.0, "REGION_RATING_CLIENT": 2, "REGION_RATING_CLIENT_W_CITY": 2,
    "WEEKDAY_APPR_PROCESS_START": "WEDNESDAY", "HOUR_APPR_PROCESS_START": 10,
    "ORGANIZATION_TYPE": "Business Entity Type 3", "DAYS_LAST_PHONE_CHANGE": -1134.0}


def request(spark, *changes):
    fields = [f for f in S.APPLICATION.fields if f.name in S.REQUEST_COLUMNS]
    rows = []
    for change in changes or ({},):
        values = {**VALUES, **change}
        rows.append(tuple(values.get(f.name, 0 if f.name in S.FLAGS else None) for f in fields))
    from pyspark.sql.types import StructType

    return spark.createDataFrame(rows, StructType(fields))


def store(spark):
    return spark.createDataFrame(
        [(100002, -1234.5, 12.0, 25.0, 3.0, 15000.0), (100003, -890.2, 5.0, 10.0, 0.0, float("inf"))],
        "SK_ID_CURR long, BURO_DAYS_CREDIT_MEAN double, POS_COUNT double, INSTAL_COUNT double, CC_COUNT double, "
        "PREV_AMT_ANNUITY_MEAN double")


def test_contract_widths():
    assert len(C.application_features()) == 240
    assert [len(f.output_columns()) for f in FAMILIES] == [62 + 27 + 27, 189 + 30 + 30, 18, 26, 114]
    names = C.feature_names()
    assert len(names) == len({n.lower() for n in names}) == 768
    assert names[0] == "CODE_GENDER" and names[245] == "BURO_DAYS_CREDIT_MIN" and names[-1] == "CC_COUNT"
    assert len(S.REQUEST_COLUMNS) == 121 and len(S.OPTIONAL) == 65 and len(S.REQUIRED) == 56
    assert sum(map(len, V.APPLICATION.values())) == 133


def test_no_history_template():
    template = C.no_history_template()
    assert len(template) == 523
    assert {k for k, v in template.items() if v is not None} == {"POS_COUNT", "INSTAL_COUNT", "CC_COUNT"}
    assert C.outside_contract(list(template)) == [] and C.outside_contract(["X"]) == ["X"]


def test_application_matrix(spark):
    row = application_matrix(request(spark, {}, {"CODE_GENDER": "XNA"}, {"DAYS_EMPLOYED": 365243})).collect()
    assert len(row) == 2
    assert row[0].CODE_GENDER == 0 and row[0].FLAG_OWN_REALTY == 0
    assert row[0]["NAME_INCOME_TYPE_Working"] == 1 and row[0]["NAME_INCOME_TYPE_Student"] == 0
    assert row[0].INCOME_CREDIT_PERC == 202500.0 / 406597.5
    assert row[1].DAYS_EMPLOYED is None and row[1].DAYS_EMPLOYED_PERC is None


def test_unknown_and_missing_categories(spark):
    df = spark.createDataFrame([("nope",), (None,), ("Yes",)], "EMERGENCYSTATE_MODE string")
    out = df.select(*dummies({"EMERGENCYSTATE_MODE": ["No", "Yes"], "GONE": ["x"]}, df.columns)).collect()
    assert [tuple(r) for r in out] == [(0, 0, 0), (0, 0, 0), (0, 1, 0)]
    coded = spark.createDataFrame([("M",), ("XNA",), (None,)], "g string").select(encode_binary("g", {"M": 0, "F": 1}))
    assert [r[0] for r in coded.collect()] == [0, None, None]


def test_fit_codes_by_first_occurrence(spark):
    df = spark.createDataFrame([(3, "a"), (1, "b"), (2, None), (4, "b")], "k long, c string")
    assert {(r.value, r.code) for r in fit_binary_codes(df, ["c"], "k").collect()} == {("b", 0), ("a", 1)}


def test_assemble_known_and_unknown(spark):
    out = {r.SK_ID_CURR: r for r in SC.assemble(
        request(spark, {}, {"SK_ID_CURR": 100003}, {"SK_ID_CURR": 999100}), store(spark)).collect()}
    known, infinite, unknown = out[100002], out[100003], out[999100]
    assert known.client_known and known.POS_COUNT == 12 and known.BURO_DAYS_CREDIT_MEAN == -1234.5
    assert known.AMT_CREDIT == 406597.5 and known.CODE_GENDER == 0
    assert infinite.PREV_AMT_ANNUITY_MEAN is None
    assert not unknown.client_known and unknown.POS_COUNT == 0 and unknown.BURO_DAYS_CREDIT_MEAN is None
    assert len(known) == 2 + 768 - 0
    assert known["POS_SK_DPD_MAX"] is None  # in the contract but not in this store


def test_known_client_keeps_missing_counts(spark):
    """No history of a kind is missing for a known client, but 0 for an unknown one."""
    gap = spark.createDataFrame([(100002, None)], "SK_ID_CURR long, POS_COUNT double")
    out = SC.assemble(request(spark, {}, {"SK_ID_CURR": 999100}), gap, ["POS_COUNT"]).collect()
    assert {(r.client_known, r.POS_COUNT) for r in out} == {(True, None), (False, 0.0)}


@pytest.mark.parametrize("p, decision", [(0.3299, "GRANTED"), (0.33, "REFUSED"), (0.9, "REFUSED"), (None, None)])
def test_threshold_refuses(spark, p, decision):
    df = spark.createDataFrame([(p,)], "p double")
    assert df.select(SC.decide(F.col("p"), 0.33).alias("d")).first().d == decision


def test_external_scorer_gets_single_precision(spark):
    def load():
        def predict(batch):
            import numpy as np

            assert batch.dtype == np.float32
            return np.column_stack([batch[:, 0], batch[:, 1]])

        return predict

    df = spark.createDataFrame([(1, 0.25, 0.75)], "k long, a double, b double")
    assert SC.score_with(df, ["a", "b"], load, ["k"]).first().probability_default == 0.75


def test_respond(spark):
    assembled = SC.assemble(request(spark), store(spark), ["AMT_INCOME_TOTAL", "AMT_CREDIT"])
    row = SC.respond(assembled, SC.income_credit_score(), Model(0.33, "test-1")).first()
    assert row.probability_default == pytest.approx(1 - 202500 / 406597.5)
    assert row.decision == "REFUSED" and row.model_version == "test-1" and row.client_known


@pytest.mark.parametrize("change, rule", [
    ({}, None), ({"SK_ID_CURR": 5}, "range:SK_ID_CURR"), ({"CODE_GENDER": "X"}, "enum:CODE_GENDER"),
    ({"AMT_CREDIT": 0.0}, "positive:AMT_CREDIT"), ({"AMT_CREDIT": None}, "required:AMT_CREDIT"),
    ({"AMT_ANNUITY": None}, None), ({"FLAG_MOBIL": 2}, "flag:FLAG_MOBIL"), ({"EXT_SOURCE_1": 1.5}, "range:EXT_SOURCE_1"),
    ({"DAYS_EMPLOYED": 365243}, None), ({"DAYS_BIRTH": -1}, "range:DAYS_BIRTH"),
    ({"EXT_SOURCE_2": float("nan")}, "range:EXT_SOURCE_2")])
def test_validation(spark, change, rule):
    errors = VA.check_requests(request(spark, change)).first().errors
    assert errors == ([rule] if rule else [])


def test_unknown_column_is_refused(spark):
    with pytest.raises(ValueError):
        VA.check_requests(request(spark).withColumn("EXTRA", F.lit(1)))


def test_absent_required_column_breaks_every_row(spark):
    assert VA.check_requests(request(spark).drop("AMT_CREDIT")).first().errors == ["required:AMT_CREDIT"]


def test_align(spark):
    df = spark.createDataFrame([(1, 2.0, float("inf"))], "k long, a double, b double")
    out = align(df, ["b", "gone", "a"], keep=["k"])
    assert out.columns == ["k", "b", "gone", "a"] and tuple(out.first()) == (1, None, None, 2.0)
    assert contract_gaps(df.columns, ["a", "gone"]) == (["gone"], ["k", "b"])
    both = beside(df, spark.createDataFrame([(1, 9.0, 8.0)], "k long, a double, z double"), "k").first()
    assert both.a == 2.0 and both.z == 8.0


def test_lookup_join_with_hot_and_missing_keys(spark):
    left = spark.range(20000).selectExpr(
        "id", "CASE WHEN id % 3 = 0 THEN 7 WHEN id % 3 = 1 THEN NULL ELSE id END AS k")
    right = spark.range(0, 20000, 2).selectExpr("id AS k", "id * 10 AS v").union(
        spark.createDataFrame([(7, 70)], "k long, v long"))
    assert [r.k for r in hot_keys(left, "k").collect()] == [7]
    out = lookup_join(left, right, "k")
    assert out.count() == 20000
    expected = left.join(right, "k", "left")
    assert sorted(map(tuple, out.select("id", "k", "v").collect()), key=lambda r: r[0]) == \
        sorted(map(tuple, expected.select("id", "k", "v").collect()), key=lambda r: r[0])


@pytest.fixture
def fixed_plans(spark):
    """Shuffled joins into as many tasks as set, so that rows per task can be counted."""
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_hot_and_missing_keys_spread(spark, fixed_plans):
    left = spark.range(20000).selectExpr(
        "id", "CASE WHEN id % 3 = 0 THEN 7 WHEN id % 3 = 1 THEN NULL ELSE id END AS k")
    right = spark.range(1, 20000, 2).selectExpr("id AS k", "id * 10 AS v")
    out = lookup_join(left, right, "k").withColumn("task", F.spark_partition_id())
    loads = out.where("k = 7 OR k IS NULL").groupBy("k").agg(F.count_distinct("task").alias("tasks")).collect()
    tasks = {r.k: r.tasks for r in loads}
    assert tasks[7] > 2 and tasks[None] == 8


def test_assemble_spreads_hot_and_missing_clients(spark, fixed_plans):
    requests = request(spark).crossJoin(spark.range(8000)).withColumn("AMT_INCOME_TOTAL", F.col("id").cast("double"))
    requests = requests.withColumn("SK_ID_CURR", F.when(F.col("id") % 2 == 0, F.col("SK_ID_CURR"))).drop("id")
    store = request(spark).select("SK_ID_CURR").withColumn("POS_COUNT", F.lit(3.0))
    out = SC.assemble(requests, store, ["POS_COUNT", "AMT_INCOME_TOTAL"]).withColumn("task", F.spark_partition_id())
    loads = {r.client_known: r for r in out.groupBy("client_known").agg(
        F.count_distinct("task").alias("tasks"), F.sum("POS_COUNT").alias("total"), F.count("*").alias("n")).collect()}
    assert loads[True].tasks > 1 and loads[False].tasks == 8
    assert loads[True].n == loads[False].n == 4000 and loads[True].total == 12000.0
