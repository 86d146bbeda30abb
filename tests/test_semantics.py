"""Missing values, infinities, rounding, names."""

import math

import pytest
from pyspark.sql import functions as F

from creditmill.functions import missing as M
from creditmill.functions.hashing import uniform
from creditmill.functions.names import safe_names
from creditmill.operators.rollup import Rollup

INF, NAN = float("inf"), float("nan")


def one(spark, column, **values):
    schema = ", ".join(f"{k} double" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize("a, b, expected", [
    (200000.0, 400000.0, 0.5), (1.0, 0.0, None), (0.0, 0.0, None), (None, 1.0, None), (1.0, None, None)])
def test_ratio(spark, a, b, expected):
    assert one(spark, M.ratio(F.col("a"), F.col("b")), a=a, b=b) == expected


@pytest.mark.parametrize("a, b, expected", [
    (1.0, 0.0, INF), (-1.0, 0.0, -INF), (0.0, 0.0, None), (1.0, 2.0, 0.5), (None, 0.0, None)])
def test_ratio_keep_inf(spark, a, b, expected):
    assert one(spark, M.ratio_keep_inf(F.col("a"), F.col("b")), a=a, b=b) == expected


@pytest.mark.parametrize("x, expected", [(INF, None), (-INF, None), (NAN, None), (None, None), (1.5, 1.5)])
def test_finite_or_null(spark, x, expected):
    assert one(spark, M.finite_or_null(F.col("x")), x=x) == expected
    assert one(spark, F.expr(M.finite_sql("x")), x=x) == expected


@pytest.mark.parametrize("x, expected", [(-3.0, 0.0), (3.0, 3.0), (None, None)])
def test_not_below_keeps_missing(spark, x, expected):
    assert one(spark, M.not_below(F.col("x")), x=x) == expected


@pytest.mark.parametrize("x, expected", [(0.5, 0), (1.5, 2), (2.5, 2), (None, None)])
def test_half_even(spark, x, expected):
    assert one(spark, M.round_half_even(F.col("x")), x=x) == expected


def test_sentinel(spark):
    assert one(spark, M.sentinel_to_null(F.col("x")), x=365243.0) is None
    assert one(spark, M.sentinel_to_null(F.col("x")), x=-5.0) == -5.0


def test_safe_names():
    assert safe_names(["a b", "c (d)/e"]) == ["a_b", "c_d_e"]
    with pytest.raises(ValueError):
        safe_names(["a b", "a/b"])


def test_uniform_is_seeded(spark):
    df = spark.range(1000)
    first = df.select(uniform(1, F.col("id")).alias("u")).collect()
    again = df.repartition(7).sort("id").select(uniform(1, F.col("id")).alias("u")).collect()
    assert first == again
    assert 0 <= min(r.u for r in first) and max(r.u for r in first) < 1
    assert abs(sum(r.u for r in first) / 1000 - 0.5) < 0.05


SPEC = Rollup("P", {"x": ("min", "max", "mean", "sum", "var", "size", "nunique")}, {"c": ["a", "b"]},
              subsets={"A": ("c", "a")}, count="P_COUNT")


def rollup(spark, rows):
    df = spark.createDataFrame(rows, "k long, x double, c string")
    return {r.k: r.asDict() for r in SPEC.apply(df, "k").collect()}


def test_rollup_missing_rules(spark):
    out = rollup(spark, [(1, None, "a"), (1, None, None), (2, 3.0, "b"), (3, INF, "a"), (3, 1.0, "a"),
                         (None, 9.0, "a")])
    assert set(out) == {1, 2, 3}  # the missing key is dropped
    assert out[1]["P_x_SUM"] == 0 and out[1]["P_x_MEAN"] is None and out[1]["P_x_SIZE"] == 2
    assert out[1]["P_x_NUNIQUE"] == 0 and out[1]["P_COUNT"] == 2
    assert out[1]["P_c_a_MEAN"] == 0.5 and out[1]["P_c_b_MEAN"] == 0 and out[1]["P_c_nan_MEAN"] == 0.5
    # rows in the subset but no value: 0; no row in the subset: missing
    assert out[1]["A_x_SUM"] == 0 and out[1]["A_x_SIZE"] == 1 and out[1]["A_x_NUNIQUE"] == 0
    assert out[2]["A_x_SUM"] is None and out[2]["A_x_SIZE"] is None and out[2]["A_x_NUNIQUE"] is None
    assert out[2]["P_x_VAR"] is None  # one row has no variance
    assert out[3]["P_x_MAX"] == INF and out[3]["P_x_MEAN"] == INF and out[3]["P_x_SUM"] == INF
    assert out[3]["P_x_VAR"] is None


def test_rollup_matches_pandas(spark):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": rng.integers(0, 20, 500), "x": np.where(rng.random(500) < 0.2, np.nan, rng.normal(size=500)),
                        "c": rng.choice(["a", "b", None], 500)})
    out = rollup(spark, [(int(k), None if math.isnan(x) else float(x), c) for k, x, c in pdf.itertuples(index=False)])
    for k, group in pdf.groupby("k"):
        for stat in ("min", "max", "mean", "sum", "var"):
            want, got = getattr(group["x"], stat)(), out[k][f"P_x_{stat.upper()}"]
            assert got == pytest.approx(want) or (got is None and math.isnan(want))
        part = group[group["c"] == "a"]["x"]
        assert out[k]["A_x_SUM"] == (pytest.approx(part.sum()) if len(part) else None)
        shares = [out[k][f"P_c_{v}_MEAN"] for v in ("a", "b", "nan")]
        assert sum(shares) == pytest.approx(1)


def test_rollup_hot_key_and_partitioning(spark):
    """A third of all rows on one key gives the same result however the rows lie."""
    df = spark.range(30000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id % 1000 END AS k",
                                       "CAST(id % 97 AS DOUBLE) AS x", "if(id % 2 = 0, 'a', 'b') AS c")
    a = sorted(SPEC.apply(df, "k").collect(), key=lambda r: r.k)
    b = sorted(SPEC.apply(df.repartition(13, "x"), "k").collect(), key=lambda r: r.k)
    assert len(a) == len(b) == 1000
    for left, right in zip(a, b):
        assert list(left) == pytest.approx(list(right))


def test_distinct_codes_need_no_shuffle_of_their_own(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 40).alias("k"),  # a third of all rows on one key
        F.when(F.col("id") % 5 != 0, (F.col("id") % 11).cast("double")).alias("v"))
    odd = spark.createDataFrame([(50, 0.0), (50, -0.0), (51, None), (None, 1.0)], "k long, v double")
    rows = rows.union(odd).repartition(6)
    spec = {"v": ("nunique", "max")}
    plain = Rollup("T", spec, gather=False).apply(rows, "k")
    expected = sorted(map(str, plain.collect()))
    for gather, shuffles in ((False, 1), (True, 2)):
        coded = Rollup("T", spec, codes=("v",), gather=gather).apply(rows, "k")
        plan = coded._jdf.queryExecution().executedPlan().toString()
        # one for the repartition above; a gathering one moves rows, the last a row per key
        assert plan.count("Exchange") == shuffles + 1
        assert sorted(map(str, coded.collect())) == expected
    got = {r.k: r.T_v_NUNIQUE for r in coded.collect()}
    assert (got[7], got[50], got[51]) == (11, 1, 0)


def test_json_requests_with_foreign_names(spark):
    from creditmill.contract import schema as S
    from creditmill.operators import validate as V

    whole = "{" + ", ".join(f'"{c}": null' for c in S.REQUEST_COLUMNS) + "}"
    data = [("a", whole), ("b", '{"zeta": 1, "AMT_CREDIT": 2, "alpha": {"AMT_X": 1}}'), ("c", "{}"), ("d", "not json"),
            ("e", None), ("f", whole[:-1] + ', "TARGET": 1}')]
    payload = F.col("payload")
    got = {r.k: r for r in spark.createDataFrame(data, "k string, payload string").select(
        "k", V.unknown_fields(payload).alias("u"), V.unknown_fields(payload, "TARGET").alias("t"),
        F.size(V.absent_fields(payload)).alias("n"), V.absent_fields(payload).isNull().alias("bad")).collect()}
    assert got["a"].u == [] and got["a"].n == 0 and got["b"].u == ["alpha", "zeta"]
    assert got["b"].n == len(S.REQUIRED) - 1 and got["c"].n == len(S.REQUIRED) and got["c"].u == []
    assert got["d"].u is None and got["d"].bad and got["e"].u is None
    assert got["f"].u == ["TARGET"] and got["f"].t == []
    # a known name and two foreign ones, written out
    assert "AMT_CREDIT" in S.REQUEST_COLUMNS and "CODE_GENDER" in S.REQUIRED
