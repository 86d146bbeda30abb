"""Order statistics, sampling, drift, evaluation against brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditmill.operators import drift as D
from creditmill.operators import evaluate as EV
from creditmill.operators import histogram as H
from creditmill.operators import ordered as O
from creditmill.operators import sampling as SM
from creditmill.plans import scenario


@pytest.fixture(scope="module")
def values(spark):
    """Two groups; one holds most rows, and a third of all rows are one value."""
    rng = random.Random(3)
    rows = [("big" if i % 10 else "small", 5.0 if i % 3 == 0 else round(rng.gauss(0, 1), 2)) for i in range(6000)]
    rows += [("big", None), ("empty", None), (None, 1.0), (None, 4.0), (None, 2.0)]
    return rows, spark.createDataFrame(rows, "g string, v double")


def by_group(rows):
    out = {}
    for g, v in rows:
        if v is not None:
            out.setdefault(g, []).append(v)
    return out


def test_quantiles(values):
    rows, df = values
    got = {r.g: r for r in O.quantiles(df, ["g"], {"v": F.col("v")}, {"a": 0.5, "b": 0.95, "c": 0.0, "d": 1.0}).collect()}
    assert set(got) == {"big", "small", None}
    for g, vs in by_group(rows).items():
        for name, q in (("a", 0.5), ("b", 0.95), ("c", 0), ("d", 1)):
            assert got[g][f"v_{name}"] == pytest.approx(np.quantile(vs, q))


def test_counted_quantiles(spark):
    df = spark.createDataFrame([(1.0, 3), (2.0, 1), (10.0, 2)], "v double, n int").withColumn("g", F.lit(1))
    got = O.counted_quantiles(df, ["g"], {"v": F.col("v")}, {"p": 0.7}, F.col("n")).first()
    assert got.v_p == pytest.approx(np.quantile([1, 1, 1, 2, 10, 10], 0.7))


def test_nearest_rank(values):
    rows, df = values
    for r in O.values_at(df, ["g"], {"v": F.col("v")}, O.nearest_ranks()).collect():
        vs = sorted(by_group(rows)[r.g])
        assert r.v_p50 == vs[len(vs) // 2] and r.v_p95 == vs[min(len(vs) - 1, int(len(vs) * 0.95))]


def test_running_sums_across_pieces(spark):
    df = spark.range(5000).selectExpr("id % 2 AS g", "CAST(id AS DOUBLE) AS v", "id % 7 AS w")
    got = {(r.g, r.v): (r.w_before, r.w_total) for r in O.running_sums(df, ["g"], "v", ["w"]).collect()}
    assert len(got) == 5000
    for g in (0, 1):
        total, running = sum(i % 7 for i in range(g, 5000, 2)), 0
        for i in range(g, 5000, 2):
            assert got[(g, float(i))] == (running, total)
            running += i % 7


def test_stratified_sample_is_exact(spark):
    df = spark.range(5000).selectExpr("id", "CASE WHEN id % 12 = 0 THEN 1 ELSE 0 END AS y", "id * 2 AS wide")
    out = SM.stratified_sample(df, "id", "y", 1000, 42)
    counts = {r.y: r["count"] for r in out.groupBy("y").count().collect()}
    assert sum(counts.values()) == 1000 and counts[1] in (83, 84)
    again = SM.stratified_sample(df.repartition(17), "id", "y", 1000, 42)
    assert {r.id for r in out.collect()} == {r.id for r in again.collect()}
    assert SM.stratified_sample(df, "id", "y", 99999, 42).count() == 5000


def test_missing_label_is_a_stratum(spark):
    df = spark.range(1000).selectExpr("id", "CASE WHEN id % 4 = 0 THEN 1 WHEN id % 4 = 1 THEN 0 END AS y")
    counts = {r.y: r["count"] for r in SM.stratified_sample(df, "id", "y", 100, 1).groupBy("y").count().collect()}
    assert counts == {1: 25, 0: 25, None: 50}


def test_folds_are_balanced(spark):
    df = spark.range(1003).selectExpr("id", "CASE WHEN id % 10 = 0 THEN 1 WHEN id % 10 > 4 THEN 0 END AS y")
    counts = SM.stratified_folds(df, "id", "y").groupBy("y", "fold").count().collect()
    assert sum(r["count"] for r in counts) == 1003
    for y in (0, 1, None):
        sizes = [r["count"] for r in counts if r.y == y]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_sample_with_replacement(spark):
    df = spark.range(50).withColumnRenamed("id", "k")
    out = SM.sample_with_replacement(df, "k", 400, 1).collect()
    assert len(out) == 400 and len({r.draw for r in out}) == 400 and len({r.k for r in out}) > 40


# --- drift ---------------------------------------------------------------------------------------
def brute_ks_p(d, n, m):
    """Share of all orderings of n + m values whose distance is at least d."""
    far = total = 0
    for first in itertools.combinations(range(n + m), n):
        mine, i, j, worst = set(first), 0, 0, 0.0
        for k in range(n + m):
            i, j = (i + 1, j) if k in mine else (i, j + 1)
            worst = max(worst, abs(i / n - j / m))
        total += 1
        far += worst >= d - 1e-12
    return far / total


@pytest.mark.parametrize("n, m", [(4, 4), (5, 3), (6, 4), (2, 7)])
def test_exact_ks_p(n, m):
    step = n * m // math.gcd(n, m)
    for h in range(0, step + 1):
        assert D.exact_ks_p(h / step, n, m) == pytest.approx(brute_ks_p(h / step, n, m), abs=1e-9)


@pytest.mark.parametrize("n, h", [(300, 20), (300, 290), (20000, 150), (20000, 2145), (20000, 3700)])
def test_small_exact_ks_p_keeps_its_digits(n, h):
    """Equal samples have a closed form, by reflection of paths."""
    def part(k):
        return math.exp(2 * math.lgamma(n + 1) - math.lgamma(n - k * h + 1) - math.lgamma(n + k * h + 1))
    closed = 2 * sum((-1) ** (k + 1) * part(k) for k in range(1, n // h + 1))
    assert D.exact_ks_p(h / n, n, n) == pytest.approx(closed, rel=1e-8)


def test_exact_ks_p_of_unequal_samples_and_far_apart():
    assert D.exact_ks_p(0.5, 40_000_000, 50_000_000) == 0.0  # no walk
    for n, m in ((37, 60), (60, 37), (1, 9), (9, 1)):
        step = n * m // math.gcd(n, m)
        values = [D.exact_ks_p(h / step, n, m) for h in range(0, step + 1, max(1, step // 40))]
        assert values[0] == 1.0 and values == sorted(values, reverse=True)
        assert values == pytest.approx([D.exact_ks_p(h / step, m, n) for h in range(0, step + 1, max(1, step // 40))])
        # all of one sample before all of the other
        assert D.exact_ks_p(1.0, n, m) == pytest.approx(2 / math.comb(n + m, n))


def test_exact_ks_p_large_agrees_with_limit(spark):
    n, m, d = 3000, 2500, 0.04
    limit = spark.range(1).select(D.ks_p_asymptotic(F.lit(d), F.lit(n), F.lit(m)).alias("p")).first().p
    assert D.exact_ks_p(d, n, m) == pytest.approx(limit, abs=0.01)


def test_ks_test(spark):
    rng = random.Random(5)
    ref = [(rng.random(), 1.0, None) for _ in range(300)]
    cur = [(rng.random() ** 2, 1.0, None) for _ in range(200)]
    schema = "a double, b double, c double"
    got = {r.feature: r for r in D.ks_test(spark.createDataFrame(ref, schema), spark.createDataFrame(cur, schema),
                                           ["a", "b", "c"]).collect()}
    assert set(got) == {"a", "b"}
    xs, ys = sorted(r[0] for r in ref), sorted(r[0] for r in cur)
    d = max(abs(sum(x <= t for x in xs) / 300 - sum(y <= t for y in ys) / 200) for t in xs + ys)
    assert got["a"].statistic == pytest.approx(d) and got["a"].detected
    assert got["b"].statistic == 0 and got["b"].score == 1 and not got["b"].detected


def test_report_round_trip(spark):
    rows = [("a", "K-S p_value", 0.5, 0.01, 0.05, True), ("b", "K-S p_value", 0.1, 0.4, 0.05, False)]
    results = spark.createDataFrame(
        rows, "feature string, method string, statistic double, score double, threshold double, detected boolean")
    doc = D.report_document(results)
    assert {(r.feature, r.detected) for r in D.parse_report(doc).collect()} == {("a", True), ("b", False)}
    assert tuple(D.parse_summary(doc).first()) == (1, 0.5, 0.5)


def test_report_defaults(spark):
    text = ('{"metrics": [{"metric_name": "m", "config": {"column": "a", "type": "x:ValueDrift"}, "value": "n/a"},'
            '{"metric_name": "m", "config": {"type": "x:Other"}, "value": 1},'
            '{"metric_name": "m", "config": {"column": "b", "type": "x:ValueDrift", "method": "chi"}, "value": 0.01}]}')
    got = {r.feature: r for r in D.parse_report(spark.createDataFrame([(text,)], "report string")).collect()}
    assert got["a"].detected is None and got["a"].threshold == 0.05 and got["a"].stattest == "—"
    assert got["b"].detected and got["b"].stattest == "chi"


def test_verdicts(spark):
    top = spark.createDataFrame([("a", 3.0, 1), ("b", 1.0, 2), ("c", 1.0, 3)], "feature string, importance double, rank int")
    results = spark.createDataFrame([("a", "m", 0.01, True), ("b", "m", 0.5, False)],
                                    "feature string, method string, score double, detected boolean")
    assert [r.status for r in D.critical_features(top, results).orderBy("rank").collect()] == \
        ["detected", "stable", "unknown"]
    w = D.weighted_drift(top, results).first()
    assert (w.weighted_ratio, w.covered, w.features, w.verdict) == (0.6, 2, 3, "alert")


def test_histogram(spark):
    df = spark.createDataFrame([(0.0,), (0.024,), (0.025,), (1.0,), (0.99,), (1.5,), (None,)], "p double")
    got = {r.bin: r["count"] for r in H.histogram(df, F.col("p")).collect()}
    assert len(got) == 40 and got[1] == 2 and got[2] == 1 and got[40] == 2 and sum(got.values()) == 5


# --- evaluation ------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(9)
    rows = [(int(rng.random() < 0.3), round(rng.random(), 1 + i % 3)) for i in range(800)]
    return rows, spark.createDataFrame(rows, "y int, p double")


def test_auc_and_average_precision(scored):
    rows, df = scored
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert EV.roc_auc(df, "y", "p").first().roc_auc == pytest.approx(auc)
    ap, last = 0.0, 0
    for t in sorted({p for _, p in rows}, reverse=True):
        tp, fp = sum(p >= t for p in pos), sum(p >= t for p in neg)
        ap += (tp - last) / len(pos) * tp / (tp + fp)
        last = tp
    assert EV.average_precision(df, "y", "p").first().pr_auc == pytest.approx(ap)


def test_cost_curve_hits_thresholds_exactly(spark):
    grid = EV.thresholds(100)
    rows = [(i % 2, t) for i, t in enumerate(grid)] + [(1, 0.0), (0, 1.0), (1, 0.005), (0, math.nextafter(grid[50], 0))]
    got = EV.cost_curve(spark.createDataFrame(rows, "y int, p double"), "y", "p", 100).orderBy("threshold").collect()
    assert [r.threshold for r in got] == grid
    for r in got:
        assert r.fp == sum(1 for y, p in rows if not y and p >= r.threshold)
        assert r.fn == sum(1 for y, p in rows if y and p < r.threshold)
        assert r.cost == 10 * r.fn + r.fp


def test_best_threshold_takes_the_lowest(spark):
    df = spark.createDataFrame([(0, 0.0), (1, 1.0)], "y int, p double")
    best = EV.best_threshold(df, "y", "p").first()
    assert (best.threshold, best.cost) == (0.01, 0)


def test_rates_without_positives(spark):
    df = spark.createDataFrame([(0, 0.1)], "y int, p double")
    row = EV.with_rates(EV.confusion(df, "y", F.col("p") >= 0.5)).first()
    assert (row.tn, row.precision, row.recall, row.f1, row.fbeta) == (1, 0, 0, 0, 0)


def test_weights(spark):
    df = spark.createDataFrame([(1,), (0,), (0,), (0,)], "y int")
    assert sorted(r.weight for r in EV.with_class_weights(df, "y").collect()) == pytest.approx([2 / 3] * 3 + [2])


# --- scenarios --------------------------------------------------------------------------------------
def test_bounds():
    """One column of each group of request rules, with the bounds written out."""
    expected = {
        "SK_ID_CURR": (100000, 999999999), "CNT_CHILDREN": (0, 20), "EXT_SOURCE_2": (0, 1), "APARTMENTS_AVG": (0, 1),
        "TOTALAREA_MODE": (0, 1), "REGION_POPULATION_RELATIVE": (0, 1), "DAYS_BIRTH": (-25550, -6570),
        "DAYS_EMPLOYED": (-25000, 365243), "DAYS_REGISTRATION": (-25000, 0), "DAYS_ID_PUBLISH": (-10000, 0),
        "OWN_CAR_AGE": (0, 100), "CNT_FAM_MEMBERS": (1, 20), "REGION_RATING_CLIENT": (1, 3), "HOUR_APPR_PROCESS_START": (0, 23),
        "OBS_30_CNT_SOCIAL_CIRCLE": (0, 500), "AMT_REQ_CREDIT_BUREAU_YEAR": (0, 500), "DAYS_LAST_PHONE_CHANGE": (-15000, 0),
        "AMT_CREDIT": (1, None), "AMT_INCOME_TOTAL": (1, None), "FLAG_MOBIL": (None, None), "FLAG_DOCUMENT_3": (None, None),
        "NO_REQUEST_COLUMN": (None, None)}
    assert {name: scenario.bounds(name) for name in expected} == expected
