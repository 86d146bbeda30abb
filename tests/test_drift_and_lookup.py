"""Category tests and the choice of a test, pieces of order statistics, lookups that leave a bucketed store in place."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from test_scoring import request

from creditmill.operators import drift as D
from creditmill.operators import ordered
from creditmill.operators.lookup import lookup_join, rows_for
from creditmill.plans import monitoring as MO
from creditmill.plans import prediction_log as L
from creditmill.plans import scoring as SC
from creditmill.session import new_table_path
from creditmill.sources import tables as T
from creditmill.streaming import jobs as J

# upper points of the chi-square distribution as printed in tables: (chance, degrees, statistic)
TABLE = [(0.05, 1, 3.841459), (0.01, 1, 6.634897), (0.05, 2, 5.991465), (0.001, 2, 13.815511), (0.95, 3, 0.351846), (0.05, 3, 7.814728),
         (0.05, 4, 9.487729), (0.10, 5, 9.236357), (0.05, 10, 18.307038), (0.99, 10, 2.558212), (0.05, 30, 43.772972),
         (0.01, 100, 135.806723), (0.95, 100, 77.929465)]


def test_chi_square_tail_has_the_tabled_values(spark):
    df = spark.createDataFrame([(p, k, x) for p, k, x in TABLE], "p double, k long, x double")
    for r in df.select("p", D.chi_square_tail(F.col("x"), F.col("k")).alias("got")).collect():
        assert r.got == pytest.approx(r.p, rel=2e-6)


def test_chi_square_tail_at_its_ends(spark):
    rows = [(0.0, 3, 1.0), (5.0, 0, 1.0), (1e4, 2, 0.0), (2000.0, 2000, 0.4958), (1e-9, 4, 1.0), (60.0, 2, 9.357622968840175e-14)]
    df = spark.createDataFrame(rows, "x double, k long, p double")
    for r in df.select("p", D.chi_square_tail(F.col("x"), F.col("k")).alias("got")).collect():
        assert r.got == pytest.approx(r.p, rel=1e-9, abs=2e-5 if r.p == 0.4958 else 1e-12)


def cells(spark, values):
    return spark.createDataFrame([(f, float(v), n) for f, counted in values.items() for v, n in Counter(counted).items()],
                                 "feature string, value double, n long")


def test_test_is_chosen_by_the_kind_of_column(spark):
    rng = random.Random(5)
    ref = {"flag": [0] * 600 + [1] * 400, "same": [0] * 500 + [1] * 500, "number": [rng.gauss(0, 1) for _ in range(1000)],
           "still": [rng.gauss(0, 1) for _ in range(1000)], "only_ref": [1, 2], "constant": [7] * 50,
           "rare": [0] * 990 + [1] * 6 + [2] * 2 + [3] * 2}
    cur = {"flag": [0] * 400 + [1] * 600, "same": [0] * 250 + [1] * 250, "number": [rng.gauss(1, 1) for _ in range(300)],
           "still": [rng.gauss(0, 1) for _ in range(300)], "only_cur": [1], "constant": [7] * 9,
           "rare": [0] * 98 + [3] * 2}
    got = {r.feature: r for r in D.drift_tests(cells(spark, ref), cells(spark, cur)).collect()}
    assert set(got) == {"flag", "same", "number", "still", "constant", "rare"}
    assert {f for f, r in got.items() if r.method == D.CHI_METHOD} == {"flag", "same", "constant", "rare"}
    assert {f for f, r in got.items() if r.detected} == {"flag", "number"}
    assert got["flag"].statistic == pytest.approx(2 * (100**2 / 500) * 2)
    assert (got["same"].statistic, got["same"].score) == (0.0, 1.0) and got["constant"].score == 1.0 and got["constant"].degrees == 0
    # 1, 2 and 3 are expected less than 5 times in the current rows: one cell of 10 and 2
    rare = ((10 - 12 * 10 / 11) ** 2 / (12 * 10 / 11) + (2 - 12 / 11) ** 2 / (12 / 11)
            + (990 - 1088 * 10 / 11) ** 2 / (1088 * 10 / 11) + (98 - 1088 / 11) ** 2 / (1088 / 11))
    assert got["rare"].degrees == 1 and got["rare"].statistic == pytest.approx(rare)
    assert got["number"].degrees is None and got["number"].ref_n == 1000 and got["number"].cur_n == 300


def test_frozen_reference_gives_the_same_as_the_rows(spark):
    rng = random.Random(6)
    names = ["a", "b, c", "d.e", "gone"]
    rows = [(float(i), rng.choice([0.0, 1.0]), rng.gauss(0, 1) if i % 5 else None, None) for i in range(400)]
    reference = spark.createDataFrame(rows, ", ".join(f"`{n}` double" for n in names))
    path = new_table_path(spark, "frozen")
    MO.freeze_reference(reference, [*names, "never there"], path)
    calls = reference.limit(120).withColumn("b, c", F.lit(1.0)).select(
        F.monotonically_increasing_id().cast("string").alias("id"), F.current_timestamp().alias("timestamp"), F.lit(5).alias("sk_id_curr"),
        F.lit(200).alias("status_code"), F.to_json(F.struct(*[F.col(f"`{n}`") for n in names])).alias("features"))
    got = {r.feature: r for r in MO.drift_report(spark.read.parquet(path), calls, names, 120).collect()}
    assert set(got) == {"a", "b, c", "d.e"} and got["b, c"].detected and got["b, c"].method == D.CHI_METHOD
    wide = calls.select(F.from_json("features", ", ".join(f"`{n}` double" for n in names)).alias("f")).select("f.*")
    plain = {r.feature: r for r in D.ks_test(reference, wide, ["a", "d.e"]).collect()}
    assert all(got[f].statistic == plain[f].statistic and got[f].score == plain[f].score for f in plain)


def test_last_calls_are_found_before_their_features_move(spark, monkeypatch):
    path = new_table_path(spark, "calls")
    spark.range(0, 900, 1, 6).selectExpr(
        "CAST(id AS STRING) AS id", "CASE WHEN id % 90 <> 0 THEN timestamp_seconds(id % 300) END AS timestamp",
        f"IF(id % 7 = 0, {L.KEEP_ALIVE_CLIENT}, id) AS sk_id_curr", "IF(id % 11 = 0, 500, 200) AS status_code",
        "concat('{\"a\":', id, '}') AS features").write.parquet(path)
    calls = spark.read.parquet(path)
    good = [r for r in calls.collect() if r.status_code == 200 and r.sk_id_curr != L.KEEP_ALIVE_CLIENT]
    good.sort(key=lambda r: (r.timestamp is None, -r.timestamp.timestamp() if r.timestamp else 0, r.id))
    sorted_, newest = [], L.newest
    monkeypatch.setattr(L, "newest", lambda df: sorted_.append((df.columns, df.count())) or newest(df))
    for limit in (1, 50, len(good) - 2, len(good) + 5):
        del sorted_[:]
        got = L.current_features(calls, limit).collect()
        assert [(r.id, r.features) for r in got] == [(r.id, r.features) for r in good[:limit]]
        assert sorted_[0] == (["timestamp", "id"], len(good)) and "features" in sorted_[1][0]
        if limit <= 50:
            assert sorted_[1][1] <= limit + 2  # those of the oldest time; three calls share one
    assert L.current_features(calls.where("id < 0"), 5).count() == 0


# -- order statistics --------------------------------------------------------------------------------

def test_pieces_follow_the_data(spark):
    """One feature with very many values beside hundreds of small ones: pieces of like size, and right sums."""
    large = spark.range(200_000).selectExpr("'f0' AS feature", "CAST(pmod(hash(id), 1000003) AS DOUBLE) AS value")
    small = spark.range(768 * 40).selectExpr("concat('s', id % 768) AS feature", "CAST(id AS DOUBLE) AS value")
    counted = large.union(small).groupBy("feature", "value").agg(F.count("*").alias("n"))
    placed = ordered._placed(counted, ["feature"], "value", 10_000)
    sizes = sorted(r["count"] for r in placed.groupBy("_piece").count().collect())
    assert len(sizes) > 15 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    got = ordered.running_sums(counted, ["feature"], "value", ["n"], piece_rows=10_000)
    seen = defaultdict(list)
    for r in got.collect():
        seen[r.feature].append((r.value, r.n, r.n_before, r.n_total))
    assert len(seen) == 769
    for rows in seen.values():
        before = 0
        for _, n, b, total in sorted(rows):
            assert b == before
            before += n
        assert {t for *_, t in rows} == {before}


# -- lookups -----------------------------------------------------------------------------------------

@pytest.fixture
def store(spark):
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1",
                # else a scan that no join follows does not say which buckets it takes
                "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    path = new_table_path(spark, "lookup_store")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    rows = spark.range(4000).selectExpr("id AS SK_ID_CURR", "CAST(id AS DOUBLE) AS POS_COUNT", "CAST(id AS DOUBLE) AS INSTAL_COUNT")
    T.save_bucketed(rows, name, 16, path=path)
    yield spark.table(name)
    for k, v in before.items():
        spark.conf.set(k, v)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def buckets_read(df) -> int:
    return int(re.search(r"SelectedBucketsCount: (\d+) out of 16", plan_of(df))[1])


def test_lookup_leaves_a_bucketed_store_in_place(spark, store):
    left = spark.range(9000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 WHEN id % 3 = 1 THEN NULL ELSE id END AS SK_ID_CURR", "id AS n")
    joined = lookup_join(left, store, "SK_ID_CURR")
    plan = plan_of(joined)
    # one shuffle, of the requests; the hot rows meet a broadcast, the rows without a key no join
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("BroadcastExchange") == 1 and "SortMergeJoin" in plan
    expected = left.join(store, "SK_ID_CURR", "left").select(joined.columns)
    assert Counter(map(tuple, joined.collect())) == Counter(map(tuple, expected.collect()))
    assert joined.count() == 9000


def asked(spark, clients):
    return clients.crossJoin(request(spark).drop("SK_ID_CURR"))


def test_assembling_shuffles_no_store(spark, store):
    requests = asked(spark, spark.range(3000).selectExpr("id * 2 AS SK_ID_CURR"))
    out = SC.assemble(requests, store, ["POS_COUNT", "AMT_CREDIT", "INSTAL_COUNT"])
    assert plan_of(out).count("Exchange hashpartitioning") == 1
    rows = {r.SK_ID_CURR: r for r in out.collect()}
    assert rows[10].POS_COUNT == 10.0 and rows[10].client_known and rows[5000].POS_COUNT == 0.0 and not rows[5000].client_known


def test_a_small_batch_reads_only_its_buckets(spark, store):
    batch = spark.createDataFrame([(3,), (3,), (None,), (1234,)], "SK_ID_CURR long")
    found = rows_for(store, batch, "SK_ID_CURR")
    assert {r.SK_ID_CURR for r in found.collect()} == {3, 1234}
    assert buckets_read(found) <= 2 and buckets_read(store) == 16
    assert rows_for(store, batch, "SK_ID_CURR", most=1).count() == 4000
    assert rows_for(store, batch.where("SK_ID_CURR IS NULL"), "SK_ID_CURR").count() == 0


def test_stream_reads_the_buckets_of_its_batches(spark, store):
    """As the stream's batches ask for single clients, few of the store's files are read, however large the store is."""
    source, out = new_table_path(spark, "requests"), new_table_path(spark, "scored")
    for k in (5, 9):
        asked(spark, spark.createDataFrame([(k,)], "SK_ID_CURR long")).coalesce(1).write.mode("append").parquet(source)
    stream = J.file_stream(spark, source, spark.read.parquet(source).schema, files_per_trigger=1)
    seen = []

    def respond(rows):
        seen.append(buckets_read(rows))
        return rows.select("SK_ID_CURR", "POS_COUNT")

    J.score_stream(stream, store, respond, out, ["POS_COUNT", "AMT_CREDIT"])
    assert sorted(map(tuple, spark.read.parquet(out).select("SK_ID_CURR", "POS_COUNT").collect())) == [(5, 5.0), (9, 9.0)]
    assert seen == [1, 1]
