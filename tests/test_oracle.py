"""Every registered query against its SQL on the smallest data."""

import __spark_entry__ as entry
import oracle
import pytest

from creditmill.checks import catalog

SF = "0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()
# fitted models: no SQL states their result
ITERATIVE = {"train_logistic", "train_boosting", "train_forest", "train_perceptron", "oof_scores", "param_search", "threshold_selection",
             "gain_importance", "ks_features_exact"}


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF)


def test_only_iterative_queries_lack_sql():
    assert set(QUERIES) - set(SQL) == ITERATIVE
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(SQL)))
def test_matches_sql(spark, duck, name):
    assert oracle.compare(QUERIES[name](spark, f"{oracle.TESTDATA}/sf{SF}"), duck, SQL[name]) is None


@pytest.mark.parametrize("name", ["train_logistic", "oof_scores", "ks_features_exact"])
def test_iterative_queries_run(spark, name):
    assert QUERIES[name](spark, f"{oracle.TESTDATA}/sf{SF}").count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
