"""Evaluation, thresholds, folds and training."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from creditmill.checks.registry import query
from creditmill.checks.roles import child_tables, role, with_roles
from creditmill.contract import schema as S
from creditmill.contract.features import feature_names
from creditmill.operators import evaluate as EV
from creditmill.operators import sampling as SM
from creditmill.plans import scoring as SC
from creditmill.plans import training as TR
from creditmill.plans.feature_store import training_matrix
from creditmill.session import cut_lineage, new_table_path

K, Y = S.KEY, S.LABEL
T = 0.33
_P = ("greatest(0, least(1, 1 - CAST(CAST(coalesce(AMT_INCOME_TOTAL, 0) AS FLOAT) AS DOUBLE) / "
      "greatest(CAST(CAST(coalesce(AMT_CREDIT, 1) AS FLOAT) AS DOUBLE), 1)))")
SCORED = f"SELECT {K}, TARGET, {_P} AS p FROM application"


def labelled(spark, sf):
    return role(spark, sf, "application").select(K, Y, SC.income_credit_score().alias("p"))


def grid(steps: int) -> str:
    rows = ", ".join(f"(CAST('{t!r}' AS DOUBLE))" for t in EV.thresholds(steps))
    return f"(VALUES {rows}) g(t)"


def sql(body: str, **ctes: str) -> str:
    return with_roles(body, "application", scored=SCORED, **ctes)


_COUNTS = """count(*) FILTER (WHERE TARGET = 0 AND p < {t}) AS tn, count(*) FILTER (WHERE TARGET = 0 AND p >= {t}) AS fp,
    count(*) FILTER (WHERE TARGET = 1 AND p < {t}) AS fn, count(*) FILTER (WHERE TARGET = 1 AND p >= {t}) AS tp"""
_RATES = """CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision,
    CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall,
    CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1,
    CASE WHEN 3.25 * tp + 2.25 * fn + fp = 0 THEN 0 ELSE 3.25 * tp / (3.25 * tp + 2.25 * fn + fp) END AS fbeta"""
_COST = "10 * fn + fp AS cost"


@query("confusion_cost", sql(f"SELECT *, {_COST} FROM (SELECT {_COUNTS.format(t=T)} FROM scored)"))
def confusion_cost(spark, sf):
    return EV.confusion(labelled(spark, sf), Y, F.col("p") >= T)


@query("classification_metrics", sql(f"SELECT *, {_COST}, {_RATES} FROM (SELECT {_COUNTS.format(t=T)} FROM scored)"),
       ["precision", "recall", "f1", "fbeta"])
def classification_metrics(spark, sf):
    return EV.with_rates(EV.confusion(labelled(spark, sf), Y, F.col("p") >= T))


def curve_sql(steps: int, by: str = "") -> str:
    """Cost at every threshold; ``by`` is a column list ending in a comma."""
    return f"""SELECT {by} t AS threshold, count(*) FILTER (WHERE TARGET = 0 AND p >= t) AS fp,
      count(*) FILTER (WHERE TARGET = 1 AND p < t) AS fn,
      10 * count(*) FILTER (WHERE TARGET = 1 AND p < t) + count(*) FILTER (WHERE TARGET = 0 AND p >= t) AS cost
      FROM scored CROSS JOIN {grid(steps)} GROUP BY ALL"""


@query("cost_curve", sql(curve_sql(200)))
def cost_curve(spark, sf):
    return EV.cost_curve(labelled(spark, sf), Y, "p")


@query("best_threshold", sql(f"SELECT threshold, cost FROM ({curve_sql(100)}) ORDER BY cost, threshold LIMIT 1"))
def best_threshold(spark, sf):
    return EV.best_threshold(labelled(spark, sf), Y, "p")


def auc_sql(source: str, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    lead = f"{by}," if by else ""
    return f"""SELECT {lead} (sum(CASE WHEN TARGET = 1 THEN r END) - sum(TARGET) * (sum(TARGET) + 1) / 2)
      / (sum(TARGET) * CAST(sum(1 - TARGET) AS DOUBLE)) AS roc_auc
      FROM (SELECT {lead} TARGET, rank() OVER ({part} ORDER BY p)
        + (count(*) OVER (PARTITION BY {lead} p) - 1) / 2 AS r FROM {source}) GROUP BY ALL"""


def precision_sql(source: str, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    lead = f"{by}," if by else ""
    return f"""SELECT {lead} sum(pos / total * hits / alarms) AS pr_auc FROM (
      SELECT {lead} pos, sum(pos) OVER ({part}) AS total, sum(pos) OVER ({part} ORDER BY p DESC) AS hits,
        sum(n) OVER ({part} ORDER BY p DESC) AS alarms
      FROM (SELECT {lead} p, CAST(sum(TARGET) AS DOUBLE) AS pos, count(*) AS n FROM {source} GROUP BY ALL)) GROUP BY ALL"""


@query("roc_auc", sql(auc_sql("scored")), ["roc_auc"])
def roc_auc(spark, sf):
    return EV.roc_auc(labelled(spark, sf), Y, "p")


@query("average_precision", sql(precision_sql("scored")), ["pr_auc"])
def average_precision(spark, sf):
    return EV.average_precision(labelled(spark, sf), Y, "p")


_FOLDED = f"""SELECT *, CAST((row_number() OVER (PARTITION BY TARGET
    ORDER BY md5(concat('42|', CAST({K} AS STRING))), {K}) - 1) % 5 AS INT) AS fold FROM scored"""


@query("stratified_folds", sql(f"SELECT {K}, TARGET, fold FROM ({_FOLDED})"))
def stratified_folds(spark, sf):
    return SM.stratified_folds(labelled(spark, sf).select(K, Y), K, Y)


@query("holdout_split", sql(f"""SELECT {K},
    CAST(('0x' || substr(md5(concat('78|', CAST({K} AS STRING))), 1, 8)) AS BIGINT) / 4294967296 < 0.2 AS is_test
    FROM scored"""))
def holdout_split(spark, sf):
    return SM.holdout_split(labelled(spark, sf).select(K), K)


_METRICS = ["roc_auc", "pr_auc", "recall", "precision", "f1", "fbeta", "cost", "best_threshold"]
_BEST = """SELECT fold, threshold AS best_threshold FROM (SELECT *, row_number() OVER (PARTITION BY fold
    ORDER BY cost, threshold) AS rn FROM (""" + curve_sql(100, "fold,").replace("FROM scored", "FROM folded") + \
    ")) WHERE rn = 1"
_PER_FOLD = f"""SELECT *, {_COST}, {_RATES} FROM (SELECT fold, best_threshold, {_COUNTS.format(t='best_threshold')}
    FROM folded JOIN best USING (fold) GROUP BY ALL) JOIN ({auc_sql('folded', 'fold')}) USING (fold)
    JOIN ({precision_sql('folded', 'fold')}) USING (fold)"""
# two decimals of a mean that may lie on a rounding edge are compared before rounding
_SUMMARY = " UNION ALL ".join(
    f"SELECT '{m}' AS metric, round_even(avg({m}), 2) AS mean, round_even(stddev_pop({m}), 2) AS std FROM per_fold"
    for m in _METRICS)


@query("fold_metrics", sql("SELECT * FROM per_fold", folded=_FOLDED, best=_BEST, per_fold=_PER_FOLD),
       ["roc_auc", "pr_auc", "recall", "precision", "f1", "fbeta"])
def fold_metrics(spark, sf):
    folds = SM.stratified_folds(labelled(spark, sf), K, Y)
    return EV.fold_metrics(folds, Y, "p", "fold")


@query("fold_summary", sql(_SUMMARY, folded=_FOLDED, best=_BEST, per_fold=_PER_FOLD), ["mean", "std"])
def fold_summary(spark, sf):
    return EV.fold_summary(fold_metrics(spark, sf), _METRICS)


@query("fold_cost", sql("SELECT fold, CAST(min(cost) AS DOUBLE) AS cost FROM ("
                        + curve_sql(100, "fold,").replace("FROM scored", "FROM folded") + ") GROUP BY fold", folded=_FOLDED))
def fold_cost(spark, sf):
    """The evaluator of the parameter search, fold by fold."""
    folds = SM.stratified_folds(labelled(spark, sf), K, Y)
    scored = folds.select("fold", Y, array_to_vector(F.array(1 - F.col("p"), "p")).alias("probability"))
    rows = cut_lineage(scored, "scored")
    cost = TR.CostEvaluator(labelCol=Y)
    return spark.createDataFrame([(i, cost.evaluate(rows.where(F.col("fold") == i))) for i in range(TR.FOLDS)],
                                 "fold int, cost double")


@query("model_threshold", sql(f"""SELECT 'scorecard' AS model_name, CAST(1 AS INT) AS number,
      (SELECT mean FROM ({_SUMMARY}) WHERE metric = 'best_threshold') AS threshold, '1' AS version
    UNION ALL SELECT 'scorecard', CAST(2 AS INT), CAST(0.33 AS DOUBLE), '2'""",
    folded=_FOLDED, best=_BEST, per_fold=_PER_FOLD), ["threshold"])
def model_threshold(spark, sf):
    # both registry rows read one evaluation
    summary = cut_lineage(fold_summary(spark, sf), "summary")
    # the second version was registered without a threshold of its own
    registry = TR.registry_rows("scorecard", 1, summary).unionByName(
        TR.registry_rows("scorecard", 2, summary.where(F.col("metric") != "best_threshold")))
    return TR.resolve_model(registry)


@query("balanced_weights", sql(f"""SELECT {K}, TARGET,
    (SELECT count(*) FROM scored) / (2 * count(*) OVER (PARTITION BY TARGET)) AS weight FROM scored"""), ["weight"])
def balanced_weights(spark, sf):
    return EV.with_class_weights(labelled(spark, sf).select(K, Y), Y)


@query("score_extremes", sql(f"""SELECT * FROM (SELECT 'high' AS which, {K}, p, TARGET FROM scored ORDER BY p DESC, {K} LIMIT 1)
    UNION ALL SELECT * FROM (SELECT 'low' AS which, {K}, p, TARGET FROM scored ORDER BY p, {K} LIMIT 1)"""))
def score_extremes(spark, sf):
    return EV.score_extremes(labelled(spark, sf), K, "p", Y)


_TEST = f"""SELECT * FROM scored WHERE
    CAST(('0x' || substr(md5(concat('78|', CAST({K} AS STRING))), 1, 8)) AS BIGINT) / 4294967296 < 0.2"""


@query("holdout_report", sql(" UNION ALL ".join(
    f"SELECT CAST({i} AS INT) AS position, '{m}' AS metric, round_even(CAST({m} AS DOUBLE), 2) AS value FROM report"
    for i, m in enumerate(EV.HOLDOUT_ORDER, 1)), test=_TEST,
    report=f"""SELECT *, {_COST}, {_RATES}, (SELECT roc_auc FROM ({auc_sql('test')})) AS roc_auc,
      (SELECT pr_auc FROM ({precision_sql('test')})) AS pr_auc
      FROM (SELECT {_COUNTS.format(t=T)} FROM test)"""), ["value"])
def holdout_report(spark, sf):
    test = SM.holdout_split(labelled(spark, sf), K).where("is_test")
    return EV.holdout_report(EV.metrics(test, Y, "p", F.lit(T)))


_COMPARED = "SELECT p AS a, floor(p * 256) / 256 AS b FROM scored"


@query("scorer_compare", sql("""SELECT count(*) AS n, max(d) AS max_delta, avg(d) AS mean_delta,
      quantile_cont(d, 0.95) AS p95_delta, quantile_cont(d, 0.99) AS p99_delta,
      count(*) FILTER (WHERE d > 1e-5) AS above_1e5, count(*) FILTER (WHERE d > 1e-3) AS above_1e3,
      count(*) FILTER (WHERE ra <> rb) AS flips, count(*) FILTER (WHERE ra AND NOT rb) AS refused_to_granted,
      count(*) FILTER (WHERE rb AND NOT ra) AS granted_to_refused,
      count(*) FILTER (WHERE near) AS in_band, count(*) FILTER (WHERE near AND ra <> rb) AS flips_in_band,
      count(*) FILTER (WHERE (a > 0.5) <> (b > 0.5)) AS flips_at_half
    FROM (SELECT *, abs(a - b) AS d, a >= 0.33 AS ra, b >= 0.33 AS rb,
      a > CAST(0.33 AS DOUBLE) - CAST(0.005 AS DOUBLE) AND a < CAST(0.33 AS DOUBLE) + CAST(0.005 AS DOUBLE) AS near
      FROM pairs)""", pairs=_COMPARED), ["max_delta", "mean_delta", "p95_delta", "p99_delta"])
def scorer_compare(spark, sf):
    first = labelled(spark, sf)
    second = first.select(K, (F.floor(F.col("p") * 256) / 256).alias("q"))
    return EV.compare_scorers(first.join(second, K), "p", "q", T)


# --- training: iterative, so rows only; every model sees the whole contract ------------------------------
FEATURES = feature_names()


def training_rows(spark, sf):
    children = child_tables(spark, sf)
    rows = training_matrix(role(spark, sf, "application"), children.tables, children.family_buckets)
    return TR.matrix(SM.holdout_split(rows, K), FEATURES, [K, Y, "is_test"])


def _train(name: str, kind: str):
    @query(name)
    def run(spark, sf):
        rows = training_rows(spark, sf)
        fitted = TR.fit(rows.where("NOT is_test"), FEATURES, Y, kind, weighted=kind != "perceptron")
        return fitted.scored(rows.where("is_test")).select(K, Y, TR.SCORE)


_train("train_logistic", "logistic")
_train("train_boosting", "boosting")
_train("train_forest", "forest")
_train("train_perceptron", "perceptron")


@query("oof_scores")
def oof_scores(spark, sf):
    return TR.out_of_fold(training_rows(spark, sf), K, Y, FEATURES).select(K, Y, "fold", TR.SCORE)


@query("threshold_selection")
def threshold_selection(spark, sf):
    rows = training_rows(spark, sf)
    made = TR.select_threshold(rows.where("NOT is_test"), rows.where("is_test"), K, Y, FEATURES, "logistic", 1,
                               new_table_path(spark, "selection"))
    registered = TR.resolve_model(made.registry)
    curve = made.curve.select(F.lit("curve").alias("part"), F.col("threshold").cast("string").alias("name"),
                              F.col("cost").cast("double").alias("value"))
    holdout = made.holdout.select(F.lit("holdout"), "metric", "value")
    chosen = registered.select(F.lit("registry"), "model_name", "threshold")
    return curve.union(holdout).union(chosen)


@query("param_search")
def param_search(spark, sf):
    return TR.search(training_rows(spark, sf), K, Y, FEATURES)


@query("gain_importance")
def gain_importance(spark, sf):
    from creditmill.operators.drift import top_importance

    fitted = TR.fit(training_rows(spark, sf), FEATURES, Y, "boosting")
    return top_importance(TR.importances(fitted, spark), 10)
