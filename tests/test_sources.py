"""Readers, writers, the log table, the store and the streams."""

import datetime as dt
import os
import uuid
from functools import reduce

import oracle
import pytest
from pyspark.sql import functions as F

from creditmill.checks.roles import child_tables
from creditmill.contract import schema as S
from creditmill.contract.schema import KEY
from creditmill.operators.align import filled_columns
from creditmill.plans import families as P
from creditmill.operators.rollup import Rollup
from creditmill.plans import feature_store as FST
from creditmill.plans import prediction_log as L
from creditmill.plans import training as TR
from creditmill.session import cut_lineage, new_table_path
from creditmill.sources import log_store as LS
from creditmill.sources import tables as T
from creditmill.streaming import jobs as J


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_csv_empty_and_nan_are_missing(spark, tmp_path):
    (tmp_path / "b.csv").write_text("SK_ID_BUREAU,MONTHS_BALANCE,STATUS\n1,-1,C\n2,,\n")
    rows = T.read_csv(spark, str(tmp_path / "b.csv"), S.BUREAU_BALANCE).collect()
    assert [tuple(r) for r in rows] == [(1, -1, "C"), (2, None, None)]
    df = T.without_nan(spark.createDataFrame([(float("nan"), "x")], "a double, b string"))
    assert tuple(df.first()) == (None, "x")


def test_all_input_files(spark, tmp_path):
    for name, schema in S.INPUT_TABLES.items():
        header = ",".join(schema.fieldNames())
        (tmp_path / f"{name}.csv").write_text(header + "\n" + "," * (len(schema) - 1) + "\n")
    tables = T.read_input(spark, str(tmp_path), debug=True)
    assert {name: df.schema for name, df in tables.items()} == S.INPUT_TABLES
    assert all(df.count() == 1 for df in tables.values())


def test_artefact(spark):
    path = new_table_path(spark, "artefact")
    T.write_artefact(spark, {"a": [1, None], "b": {"x é": 0.5}}, path)
    assert T.read_artefact(spark, path) == {"a": [1, None], "b": {"x é": 0.5}}


def test_payload(spark):
    df = spark.createDataFrame([(1.0, float("nan"), "x", 1)], "n double, m double, s string, TARGET int")
    assert T.to_payload(df, ["n", "m", "s"], ["n"]).first().payload == '{"n":1,"m":null,"s":"x"}'


def test_bucketed_families_join_without_shuffle(spark):
    spark.sql("DROP TABLE IF EXISTS test_pos")
    spark.sql("DROP TABLE IF EXISTS test_instal")
    pos = spark.range(100).selectExpr("id AS SK_ID_CURR", "id * 2 AS a")
    T.save_bucketed(pos, "test_pos", 4)
    T.save_bucketed(pos.withColumnRenamed("a", "b"), "test_instal", 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = FST.full_outer_store([spark.table("test_pos"), spark.table("test_instal")])
        assert exchanges(joined) == 0 and joined.count() == 100
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE test_pos")
        spark.sql("DROP TABLE test_instal")


@pytest.fixture(scope="module")
def children(spark):
    """Client 1 has everything, client 2 only installments, one row has no client, one credit no id."""
    def make(schema, rows):
        return spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema)

    return {
        "bureau": make(S.BUREAU, [
            {KEY: 1, "SK_ID_BUREAU": 10, "CREDIT_ACTIVE": "Active", "AMT_CREDIT_SUM": 5.0},
            {KEY: 1, "SK_ID_BUREAU": None, "CREDIT_ACTIVE": "Closed", "AMT_CREDIT_SUM": 7.0}]),
        "bureau_balance": make(S.BUREAU_BALANCE, [
            {"SK_ID_BUREAU": 10, "MONTHS_BALANCE": -1, "STATUS": "C"},
            {"SK_ID_BUREAU": 10, "MONTHS_BALANCE": -4, "STATUS": None}]),
        "previous_application": make(S.PREVIOUS, [
            {KEY: 1, "NAME_CONTRACT_STATUS": "Approved", "AMT_APPLICATION": 5.0, "AMT_CREDIT": 0.0}]),
        "POS_CASH_balance": make(S.POS_CASH, [{KEY: 1, "SK_DPD": 3}, {KEY: None, "SK_DPD": 9}]),
        "installments_payments": make(S.INSTALLMENTS, [
            {KEY: 1, "AMT_INSTALMENT": 10.0, "AMT_PAYMENT": 5.0},
            {KEY: 2, "DAYS_INSTALMENT": -5.0, "DAYS_ENTRY_PAYMENT": -2.0}]),
        "credit_card_balance": make(S.CREDIT_CARD, [{KEY: 1, "AMT_BALANCE": 1.0}]),
    }


def test_store(children):
    rows = {r[KEY]: r for r in FST.feature_store(children).collect()}
    assert set(rows) == {1, 2}
    one, two = rows[1], rows[2]
    assert one.BURO_AMT_CREDIT_SUM_SUM == 12 and one.ACTIVE_AMT_CREDIT_SUM_SUM == 5 and one.BURO_MONTHS_BALANCE_MIN_MIN == -4
    assert one["BURO_STATUS_C_MEAN_MEAN"] == 0.5 and one["BURO_STATUS_nan_MEAN_MEAN"] == 0.5
    assert one.APPROVED_APP_CREDIT_PERC_MAX == float("inf") and one.REFUSED_CNT_PAYMENT_SUM is None
    assert one.INSTAL_DPD_SUM == 0 and one.INSTAL_PAYMENT_PERC_MAX == 0.5
    assert two.POS_COUNT is None and two.INSTAL_DPD_MAX == 3 and two.INSTAL_DBD_MAX == 0


def test_store_equals_full_outer_chain(children):
    a = FST.feature_store(children)
    b = FST.full_outer_store(P.all_families(children)).select(*a.columns)
    assert sorted(a.collect(), key=lambda r: r[KEY]) == sorted(b.collect(), key=lambda r: r[KEY])


def test_missing_dates_as_zero(children):
    row = P.installments_family(children["installments_payments"], missing_as_zero=True).where(F.col(KEY) == 1).first()
    assert row.INSTAL_DPD_MAX == 0
    row = P.installments_family(children["installments_payments"]).where(F.col(KEY) == 1).first()
    assert row.INSTAL_DPD_MAX is None


def test_balance_join_keeps_the_spread_key(children, spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = P.attach_balance(children["bureau"], children["bureau_balance"])
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(SK_ID_BUREAU" in text and ", _spread" in text.split("hashpartitioning(SK_ID_BUREAU")[1][:40]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


# --- log -----------------------------------------------------------------------------------------
def test_log_defaults_and_truncate(spark):
    path = new_table_path(spark, "log")
    LS.create_log(spark, path)
    LS.create_log(spark, path)  # a second call changes nothing
    LS.append_log(spark.createDataFrame([(5,), (6,)], "sk_id_curr int"), path)
    rows = LS.read_log(spark, path).collect()
    assert len(rows) == 2 and len({r.id for r in rows}) == 2
    assert all(r.status_code == 200 and r.timestamp is not None for r in rows)
    assert set(LS.read_log(spark, path).columns) == {*S.PREDICTION_LOG.fieldNames(), LS.DAY}


def test_latest_version_of_a_hot_id(spark):
    versions = spark.range(9000).selectExpr("if(id % 3 = 0, 1, id) AS id", "id AS version", "id * 2 AS v")
    out = {r.id: r.v for r in LS.latest_versions(versions, "id", "version").collect()}
    assert out[1] == 8997 * 2 and len(out) == 6000


def test_features_json(spark):
    df = spark.createDataFrame([(1.5, float("inf"), None)], "a double, b double, c double")
    assert df.select(L.features_json(df.columns).alias("j")).first().j == '{"a":1.5,"b":null,"c":null}'


def test_filled_columns(spark):
    a = spark.createDataFrame([(1.0, None)], "x double, y double")
    assert filled_columns(a, a, ["x", "y"]) == ["x"]


def test_cut_lineage(spark):
    df = cut_lineage(spark.range(5).withColumn("x", F.col("id") * 2), "numbers")
    assert df.count() == 5 and "Range" not in df._jdf.queryExecution().optimizedPlan().toString()


# --- registry ------------------------------------------------------------------------------------
def test_model_defaults(spark):
    docs = [("m", 1, '{"version": "7", "metrics": {"best_threshold_mean": 0.4}}'), ("m", 2, '{"metrics": {}}'), ("m", 3, "{}")]
    got = TR.resolve_model(spark.createDataFrame(docs, "model_name string, number int, document string"))
    assert [(r.threshold, r.version) for r in got.orderBy("number").collect()] == \
        [(0.4, "7"), (0.33, "unknown"), (0.33, "unknown")]


# --- streams --------------------------------------------------------------------------------------
def calls(spark, start, n):
    return spark.range(start, start + n).selectExpr(
        "CAST(id AS STRING) AS id", "timestamp_seconds(1700000000 + id * 60) AS timestamp",
        "CAST(id % 50 AS INT) AS latency_ms", "if(id % 10 = 0, 500, 200) AS status_code")


def test_stream_resumes_and_matches_batch(spark):
    folder, out = new_table_path(spark, "calls"), new_table_path(spark, "hours")
    for start in (0, 600):  # two runs over a growing folder
        calls(spark, start, 600).coalesce(1).write.mode("append").parquet(folder)
        stream = J.file_stream(spark, folder, calls(spark, 0, 1).schema)
        J.append_to(J.hourly_counts(stream), out)
    report = {r.hour: r for r in J.hourly_report(spark.read.parquet(out)).collect()}
    batch = {r.hour: r for r in L.hourly(calls(spark, 0, 1200), 10**5).collect()}
    closed = sorted(batch)[:-2]
    assert set(closed) <= set(report) <= set(batch)
    for hour in report:
        assert tuple(report[hour]) == tuple(batch[hour].asDict()[c] for c in report[hour].__fields__)


def test_refreshed_report_has_open_hours(spark):
    folder, out = new_table_path(spark, "calls"), new_table_path(spark, "hours")
    for start, n in ((0, 20), (20, 580), (600, 600)):  # nothing is closed after the first
        calls(spark, start, n).coalesce(1).write.mode("append").parquet(folder)
        stream = J.file_stream(spark, folder, calls(spark, 0, 1).schema)
        log = spark.read.parquet(folder).withColumn("log_date", F.to_date("timestamp"))
        report = {r.hour: r for r in J.refresh_hourly(stream, log, out).collect()}
        batch = {r.hour: r for r in L.hourly(calls(spark, 0, start + n), 10**5).collect()}
        assert set(report) == set(batch)
        for hour in report:
            assert tuple(report[hour]) == tuple(batch[hour].asDict()[c] for c in report[hour].__fields__)


def test_stream_drops_retries(spark):
    folder, out = new_table_path(spark, "calls"), new_table_path(spark, "intake")
    calls(spark, 0, 100).coalesce(1).write.mode("append").parquet(folder)
    J.append_to(J.without_retries(J.file_stream(spark, folder, calls(spark, 0, 1).schema), "id"), out)
    calls(spark, 90, 20).coalesce(1).write.mode("append").parquet(folder)  # ten are sent again
    J.append_to(J.without_retries(J.file_stream(spark, folder, calls(spark, 0, 1).schema), "id"), out)
    assert spark.read.parquet(out).count() == 110


def test_csv_columns_are_found_by_name(spark, tmp_path):
    path = tmp_path / "pos.csv"
    names = [f.name for f in S.POS_CASH.fields]
    rows = [{n: k for n in names} | {"NAME_CONTRACT_STATUS": "Active", "OTHER": "x"} for k in (3, 1, 2)]
    header = [*reversed(names), "OTHER"]
    path.write_text("\n".join([",".join(header), *(",".join(str(r[n]) for n in header) for r in rows)]) + "\n")
    got = T.read_csv(spark, str(path), S.POS_CASH)
    assert got.columns == names and got.schema["SK_DPD"] == S.POS_CASH["SK_DPD"]
    assert sorted(r.SK_DPD for r in got.collect()) == [1, 2, 3]
    assert [r.SK_DPD for r in T.read_csv(spark, str(path), S.POS_CASH, limit=2).collect()] == [1, 2]
    path.write_text("SK_ID_PREV,OTHER\n1,2\n")
    with pytest.raises(ValueError, match="SK_ID_CURR"):
        T.read_csv(spark, str(path), S.POS_CASH)


def test_trailing_window_skips_days_and_reports_an_empty_window(spark, tmp_path):
    path, now = str(tmp_path / "log"), F.to_timestamp(F.lit("2024-01-30 12:00:00"))
    log = spark.range(30).select(
        F.timestamp_add("DAY", F.col("id").cast("int"), F.to_timestamp(F.lit("2024-01-01 10:00:00"))).alias("timestamp"),
        F.lit(200).alias("status_code"), F.lit("GRANTED").alias("decision"), F.lit(True).alias("client_known"),
        F.lit(0.1).alias("probability_default"), *[F.lit(5).alias(c) for c in S.TIMINGS])
    LS.append_log(LS.with_defaults(log), path)
    window = L.since(LS.read_log(spark, path), 24, now)
    plan = window._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: []" not in plan and "log_date" in plan.split("PartitionFilters:")[1][:120]
    assert window.count() == 1
    empty = L.summary(LS.read_log(spark, path), 24, F.to_timestamp(F.lit("2030-01-01 00:00:00"))).collect()
    assert len(empty) == 1 and empty[0].total == 0 and empty[0].avg_proba is None


def test_equal_versions_have_one_winner(spark):
    rows = spark.createDataFrame([(1, 7, c) for c in "abcdef"], "id long, version long, value string")
    winners = {LS.latest_versions(rows.repartition(k), "id", "version").first().value for k in (1, 2, 3, 5)}
    assert len(winners) == 1


def test_passing_tables_are_deleted(spark):
    from creditmill.session import cut_lineage, new_table_path, passing_tables

    outside = new_table_path(spark, "kept")
    with passing_tables(spark):
        first = cut_lineage(spark.range(10), "passing")
        where = first.inputFiles()[0]
        first.where("id > 4").write.parquet(outside)
    assert spark.read.parquet(outside).count() == 5
    assert not os.path.exists(where.removeprefix("file://"))
    with pytest.raises(ValueError):
        with passing_tables(spark):
            left = cut_lineage(spark.range(3), "left")
            raise ValueError
    assert left.count() == 3


def test_store_scans_each_table_once_and_merges_without_shuffle(spark, tmp_path):
    families, shapes = [], [("a", [(1, 1.0), (2, 2.0)]), ("b", [(2, 5.0), (2, 7.0), (3, None)]), ("c", [])]
    for name, data in shapes:
        spark.createDataFrame(data, f"{KEY} bigint, v double").write.parquet(f"{tmp_path}/{name}")
        families.append(Rollup(name, numeric={"v": ("max", "size")}).apply(spark.read.parquet(f"{tmp_path}/{name}"), KEY))
    store = FST.merge_families(families)
    got = {r[0]: tuple(r[1:]) for r in store.collect()}
    assert store.columns[1:] == [f"{n}_v_{s}" for n in "abc" for s in ("MAX", "SIZE")]
    # b has client 3 with a missing value: a row of the family, unlike client 1 there
    assert got == {1: (1.0, 1.0, None, None, None, None), 2: (2.0, 1.0, 7.0, 2.0, None, None),
                   3: (None, None, None, 1.0, None, None)}
    plan = store.select("*")._jdf.queryExecution().executedPlan().toString()  # not yet run
    assert plan.count("FileScan") == 3
    assert "Exchange" not in plan[:plan.index("Union")]


def test_applications_meet_all_families_in_one_join(spark):
    from creditmill.checks.roles import child_tables, role

    sf = f"{oracle.TESTDATA}/sf0.001"
    children = child_tables(spark, sf)
    made = FST.training_matrix(role(spark, sf, "application"), children.tables, children.family_buckets)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 2  # the other one brings the balances to their credits


def test_queries_keep_generated_methods_small_enough_to_compile(spark):
    from creditmill.session import tune

    assert int(tune(spark).conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_history_in_buckets_is_rolled_up_where_it_lies(spark):
    rows = spark.range(4000).selectExpr(f"id % 37 AS {KEY}", "CAST(id % 11 AS DOUBLE) AS v")
    name = "history_" + uuid.uuid4().hex
    T.save_bucketed(rows, name, 5, path=new_table_path(spark, name))
    specs = [Rollup(n, numeric={"v": ("max", "var", "size")}) for n in "ab"]
    store = FST.merge_families([s.apply(spark.table(name), KEY, 5) for s in specs])
    assert "Exchange" not in store._jdf.queryExecution().executedPlan().toString()
    kept = []
    for family in (s.apply(spark.table(name), KEY, 5) for s in [*specs, Rollup("c", numeric={"v": ("min",)})]):
        kept.append("family_" + uuid.uuid4().hex)
        T.save_bucketed(family, kept[-1], 5, path=new_table_path(spark, kept[-1]))
    saved = FST.full_outer_store([spark.table(n) for n in kept])
    assert "Exchange" not in saved._jdf.queryExecution().executedPlan().toString()
    assert saved.select(KEY, "c_v_MIN").count() == 37
    plain = FST.merge_families([s.apply(rows, KEY) for s in specs])
    for ours, theirs in zip(sorted(map(tuple, store.collect())), sorted(map(tuple, plain.collect())), strict=True):
        assert ours == pytest.approx(theirs)


def test_a_large_client_is_not_put_into_one_bucket(spark, monkeypatch):
    rows = spark.range(30000).selectExpr("if(id % 3 = 0, 7, id) AS k").union(spark.sql("SELECT CAST(NULL AS BIGINT)"))
    assert T.buckets_by(rows, "k") == (T.LEAST_BUCKETS, True)  # a task takes 10 000 rows
    monkeypatch.setattr(T, "LARGE_KEY_ROWS", 100)
    assert T.buckets_by(rows, "k") == (T.LEAST_BUCKETS, False)
    assert T.buckets_by(rows.where("k <> 7"), "k") == (T.LEAST_BUCKETS, True)
    assert T.buckets_by(rows.limit(0), "k") == (T.LEAST_BUCKETS, True)
    monkeypatch.setattr(T, "KEYS_PER_BUCKET", 1000)
    assert T.buckets_by(rows, "k")[0] == 20


def test_child_tables_give_the_same_families_either_way(spark, monkeypatch):
    folder = "/root/testdata/sf0.001"
    placed = child_tables(spark, folder)
    monkeypatch.setattr(T, "LARGE_KEY_ROWS", 0)
    monkeypatch.setattr(T, "LEAST_BUCKETS", 500)
    split = child_tables(spark, folder)
    assert placed.family_buckets == 8 and split.family_buckets is None
    for name, df in split.tables.items():
        assert df.dtypes == placed.tables[name].dtypes
        assert df.exceptAll(placed.tables[name]).count() == placed.tables[name].exceptAll(df).count() == 0, name


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_balances_are_shuffled_once_for_their_credits(children, no_broadcast):
    assert exchanges(P.attach_balance(children["bureau"], children["bureau_balance"])) == 2  # each side once


def test_balances_meet_their_credits_where_both_lie(spark, no_broadcast):
    from creditmill.session import joins_in_place

    placed = child_tables(spark, f"{oracle.TESTDATA}/sf0.001")
    with joins_in_place(spark):
        store = FST.feature_store(placed.tables, placed.family_buckets)
        assert "Exchange" not in store._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("twice", [False, True])
def test_credits_without_id_client_or_balances_and_of_one_id(spark, no_broadcast, tmp_path, twice):
    from creditmill.checks.roles import role
    from creditmill.session import joins_in_place

    folder = str(tmp_path)
    orders = spark.read.parquet(f"{oracle.TESTDATA}/sf0.001/orders.parquet")
    first = orders.where("o_orderkey < 9")
    odd = [orders, *[orders.where("o_orderkey IN (1, 2)").withColumn("o_orderkey", F.lit(None).cast("bigint"))] * 2,
           first.withColumn("o_custkey", F.lit(None).cast("bigint")),  # known credits of no client
           first.withColumn("o_custkey", F.col("o_custkey") + 1000),  # the same ids at other clients
           first.withColumn("o_orderkey", F.col("o_orderkey") + 10**9)]  # credits without balances
    odd += [first.withColumn("o_totalprice", F.col("o_totalprice") + 1)] if twice else []
    reduce(lambda a, b: a.unionByName(b), odd).write.parquet(f"{folder}/orders.parquet")
    lines = spark.read.parquet(f"{oracle.TESTDATA}/sf0.001/lineitem.parquet")
    some = lines.limit(50)
    (lines.unionByName(some.withColumn("l_orderkey", F.lit(2 * 10**9)))  # balances of unknown credits and of none
     .unionByName(some.withColumn("l_orderkey", F.lit(None).cast("bigint"))).write.parquet(f"{folder}/lineitem.parquet"))
    placed = child_tables(spark, folder)
    assert placed.family_buckets == 8 and (P.CLIENT_BALANCE in placed.tables) != twice
    with joins_in_place(spark):
        made = sorted(map(tuple, P.all_families(placed.tables, 8)[0].collect()))
    plain = P.bureau_family(role(spark, folder, "bureau"), role(spark, folder, "bureau_balance"))
    assert len(made) > 100
    for ours, theirs in zip(made, sorted(map(tuple, plain.collect())), strict=True):
        assert ours == pytest.approx(theirs)


def test_joins_in_place_ends_with_its_block(spark):
    from creditmill.session import joins_in_place

    setting = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(setting)
    with pytest.raises(ValueError), joins_in_place(spark):
        assert spark.conf.get(setting) == "false"
        raise ValueError
    assert spark.conf.get(setting) == before == "true"


@pytest.mark.parametrize("name", ["score_assemble", "reference_rows"])
def test_requests_move_before_their_columns_are_spread_out(spark, no_broadcast, name):
    from creditmill.checks import joins

    plan = getattr(joins, name)(spark, f"{oracle.TESTDATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    moved = plan[plan.index("Exchange"):].splitlines()[1]
    assert "Project" in moved and "more fields" not in moved


def test_requests_of_a_large_client_or_of_none_are_not_placed(spark, monkeypatch, tmp_path):
    from creditmill.checks import roles

    customers = spark.read.parquet(f"{oracle.TESTDATA}/sf0.001/customer.parquet")
    none = spark.range(20).join(customers.limit(1)).withColumn("c_custkey", F.lit(None).cast("bigint")).drop("id")
    hot = spark.range(200).join(customers.where("c_custkey = 1")).drop("id")
    monkeypatch.setattr(roles, "LARGE_KEY_ROWS", 10)
    monkeypatch.setattr(T, "LARGE_KEY_ROWS", 10)
    for i, (extra, placed) in enumerate([(none.limit(5), True), (none, False), (hot, False)]):
        folder = f"{tmp_path}/{i}"
        customers.unionByName(extra).write.parquet(f"{folder}/customer.parquet")
        made, plain = roles.placed_role(spark, folder, "request", 8), roles.role(spark, folder, "request")
        assert (exchanges(made) == 1) == placed
        assert made.dtypes == plain.dtypes
        assert made.exceptAll(plain).count() == plain.exceptAll(made).count() == 0


def logged(spark, days):
    """Ten rows a day from 1 January 2024 on, ids 0, 1, ..."""
    at = F.timestamp_add("DAY", (F.col("k") / 10).cast("int"), F.to_timestamp(F.lit("2024-01-01 10:00:00")))
    return LS.with_defaults(spark.range(days * 10).select(
        F.col("id").alias("k"), F.col("id").cast("string").alias("id")).withColumn("timestamp", at).drop("k"))


def day_files(path):
    return {day: sorted(f for f in os.listdir(f"{path}/{day}") if f.endswith(".parquet"))
            for day in os.listdir(path) if day.startswith(LS.DAY)}


@pytest.mark.parametrize("days_known", [True, False])
def test_update_rewrites_only_its_days(spark, tmp_path, days_known):
    path = str(tmp_path / "log")
    LS.append_log(logged(spark, 6), path)
    before = day_files(path)
    third, fifth = dt.date(2024, 1, 3), dt.date(2024, 1, 5)
    updates = spark.createDataFrame(
        [("25", third, 1, 7), ("25", third, 2, 8), ("41", fifth, 1, 5), ("41", fifth, 2, None), ("999", fifth, 1, 1),
         (None, None, 1, 1)], f"id string, {LS.DAY} date, version int, db_log_ms int")
    updates = updates if days_known else updates.drop(LS.DAY)
    LS.update_log(updates.where("version = 1"), path, "id", ["db_log_ms"], "version")
    assert LS.update_log(updates, path, "id", ["db_log_ms"], "version") == [third, fifth]
    after = day_files(path)
    assert {d for d in before if before[d] != after[d]} == {f"{LS.DAY}=2024-01-03", f"{LS.DAY}=2024-01-05"}
    stored = {r.id: r.db_log_ms for r in LS.read_log(spark, path).collect()}
    assert len(stored) == 60 and {k: v for k, v in stored.items() if v is not None} == {"25": 8}
    assert LS.update_log(updates.where("id = '999'"), path, "id", ["db_log_ms"], "version") == []
    assert LS.update_log(updates.limit(0), path, "id", ["db_log_ms"], "version") == []
    assert day_files(path) == after


def test_known_days_prune_the_scan(spark, tmp_path):
    path = str(tmp_path / "log")
    LS.append_log(logged(spark, 3), path)
    wanted = spark.createDataFrame([("11", dt.date(2024, 1, 2))], f"id string, {LS.DAY} date")
    log = LS.read_log(spark, path)
    assert LS.touched_days(log, wanted, "id") == [dt.date(2024, 1, 2)]
    plan = log.join(wanted, ["id", LS.DAY], "left_semi").select(LS.DAY)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:string>" in plan


def test_compaction_joins_small_files_once(spark, tmp_path):
    path = str(tmp_path / "log")
    for part in logged(spark, 2).randomSplit([1.0] * 4, seed=1):
        LS.append_log(part.repartition(2), path)
    LS.append_log(logged(spark, 3).where("timestamp >= '2024-01-03'").coalesce(1), path)
    rows = sorted(map(tuple, LS.read_log(spark, path).select("id", LS.DAY).collect()))
    third = day_files(path)[f"{LS.DAY}=2024-01-03"]
    assert LS.compact_log(spark, path) == [dt.date(2024, 1, 1), dt.date(2024, 1, 2)]
    files = day_files(path)
    assert [len(f) for f in files.values()] == [1, 1, 1] and files[f"{LS.DAY}=2024-01-03"] == third
    assert sorted(map(tuple, LS.read_log(spark, path).select("id", LS.DAY).collect())) == rows
    assert LS.compact_log(spark, path) == [] and day_files(path) == files


def test_evolution_rewrites_the_old_days(spark, tmp_path):
    path = str(tmp_path / "log")
    old = logged(spark, 2).withColumn("latency_ms", F.lit(2.5)).drop("inference_ms", "db_log_ms")
    old.withColumn(LS.DAY, F.to_date("timestamp")).write.partitionBy(LS.DAY).parquet(path)
    LS.append_log(logged(spark, 3).where("timestamp >= '2024-01-03'").withColumn("latency_ms", F.lit(9)), path)
    kept = day_files(path)[f"{LS.DAY}=2024-01-03"]
    assert LS.evolve_log(spark, path, ["latency_ms"], dt.date(2024, 1, 3)) == [dt.date(2024, 1, 1), dt.date(2024, 1, 2)]
    stored = LS.read_log(spark, path)
    assert set(stored.columns) == {*S.PREDICTION_LOG.fieldNames(), LS.DAY}
    assert {(r.latency_ms, r.inference_ms) for r in stored.collect()} == {(2, None), (9, None)} and stored.count() == 30
    assert day_files(path)[f"{LS.DAY}=2024-01-03"] == kept


def test_log_is_kept_small(spark, tmp_path):
    """JSON objects with the same names in every row: far less than Snappy makes of them, also after a rewrite."""
    fields = ", ".join(f"'\"FEATURE_{i}\":', round(rand({i}), 6), ','" for i in range(60))
    rows = spark.range(0, 2000, 1, 1).selectExpr("CAST(id AS STRING) AS id", "timestamp_seconds(id * 60) AS timestamp",
                                                 f"concat('{{', {fields}, '}}') AS features")
    plain, log = f"{tmp_path}/plain", f"{tmp_path}/log"
    rows.write.option("compression", "snappy").parquet(plain)
    LS.append_log(rows, log)

    def size(folder):
        return sum(f.stat().st_size for f in folder.rglob("*.parquet"))

    assert size(tmp_path / "log") < 0.6 * size(tmp_path / "plain")
    LS.rewrite_days(spark.read.parquet(log), log)
    assert size(tmp_path / "log") < 0.6 * size(tmp_path / "plain") and spark.read.parquet(log).count() == 2000
