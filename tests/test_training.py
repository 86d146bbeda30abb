"""Training over the contract: preparation, out-of-fold scores, threshold choice, search."""

import json
import shutil

import duckdb
import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from creditmill.checks import models as M
from creditmill.checks.roles import role
from creditmill.operators import evaluate as EV
from creditmill.operators import logistic
from creditmill.operators import sampling as SM
from creditmill.plans import training as TR

K, Y = M.K, M.Y
FEW = ["AMT_CREDIT", "AMT_ANNUITY", "AMT_INCOME_TOTAL", "EXT_SOURCE_1", "EXT_SOURCE_2", "DAYS_EMPLOYED"]


@pytest.fixture(scope="module")
def rows(spark):
    app = SM.holdout_split(role(spark, f"{oracle.TESTDATA}/sf0.01", "application"), K)
    return TR.matrix(app, FEW, [K, Y, "is_test"])


def scores_of(df):
    return {r[K]: r[TR.SCORE] for r in df.collect()}


def scores_of_k(df):
    return {r.k: r[TR.SCORE] for r in df.collect()}


def test_medians_are_exact(spark):
    data = [(1, 1.0, None, None, -0.5), (2, 4.0, 3.0, None, -0.5), (3, 2.0, 9.0, None, 8.0), (4, 2.0, None, None, 1.0),
            (5, 2.0, None, None, 1.0)]
    df = TR.matrix(spark.createDataFrame(data, "k int, a double, b double, c double, `d e` double"), ["a", "b", "c", "d e"],
                   ["k"])
    got = TR.learn_preparation(df, ["a", "b", "c", "d e"])
    assert got.medians == [2.0, 6.0, 0.0, 1.0]  # a column without values has median 0
    assert got.flagged == [1, 2] and got.inputs == ["a", "b", "c", "d e", "b_missing", "c_missing"]
    vector = df.where("k = 4").select(got.vector().alias("v")).first().v
    assert vector.toArray().tolist() == [2.0, 6.0, 0.0, 1.0, 1.0, 1.0]
    none = TR.learn_preparation(df.where("k > 9"), ["a", "b", "c", "d e"])
    assert none.medians == [0.0] * 4 and none.flagged == [0, 1, 2, 3]
    assert TR.learn_preparation(df.where("k = 3"), ["a"]).flagged == []


def test_medians_match_brute_force(rows):
    table = np.array([r.values for r in rows.select(F.col(TR.VALUES).alias("values")).toPandas().itertuples()], dtype=float)
    assert TR.learn_preparation(rows, FEW).medians == np.nanmedian(table, axis=0).tolist()


def test_medians_count_only_values_near_the_middle(spark, monkeypatch):
    draw = np.random.default_rng(5)
    wide = np.column_stack([draw.normal(size=2000), np.exp(draw.normal(0, 40, 2000)), -np.exp(draw.normal(0, 3, 2000)),
                            draw.integers(0, 2, 2000), draw.choice([-5e-324, 0.0, 5e-324], 2000),
                            draw.choice([np.inf, -np.inf, 1.0], 2000), 1e6 + draw.random(2000)])
    names = [f"f{i}" for i in range(wide.shape[1])]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(wide)], ["k", *names])
    counted, running = [], TR.running_sums
    monkeypatch.setattr(TR, "running_sums", lambda df, *given: counted.append(
        {r.pos: r["count"] for r in df.groupBy("pos").count().collect()}) or running(df, *given))
    table = TR.matrix(df, names, ["k"])
    found = TR.learn_preparations(table, names, [F.lit(True), F.col("k") < 777])
    assert [p.medians for p in found] == [np.median(wide[:n], axis=0).tolist() for n in (2000, 777)]
    # of 2000 different values each; the last feature lies in a single cell
    assert max(counted[0][i] for i in range(6)) < 200 and counted[0][6] == 2000


def test_all_folds_are_prepared_in_one_pass(rows, monkeypatch):
    placed = TR.in_folds(rows, K, Y, 3)
    parts = [F.col("fold") != i for i in range(3)] + [F.col(K) < 0]
    assert TR.learn_preparations(placed, FEW, parts) == [TR.learn_preparation(placed.where(p), FEW) for p in parts]
    passes, count = [], TR.learn_preparations
    monkeypatch.setattr(TR, "learn_preparations", lambda *given: passes.append(1) or count(*given))
    assert TR.out_of_fold(rows, K, Y, FEW, folds=3).count() == rows.count() and len(passes) == 1


def test_a_task_of_a_fit_reads_a_bounded_part(spark, rows, monkeypatch):
    monkeypatch.setattr(TR, "FILE_ROWS", 50)
    again = TR.matrix(rows.coalesce(1).select(K, *[F.get(TR.VALUES, i).alias(f) for i, f in enumerate(FEW)]), FEW, [K])
    files = again.inputFiles()
    assert len(files) == -(-rows.count() // 50)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    monkeypatch.setattr(TR, "READ_BYTES", 1 << 20)
    seen = []

    class Watched(TR.Pipeline):
        def _fit(self, df):
            seen.append(df.rdd.getNumPartitions())
            return super()._fit(df)

    monkeypatch.setattr(TR, "Pipeline", Watched)
    placed = TR.cut_lineage(rows, "small", 50)
    TR.fit(placed, FEW, Y, "logistic", settings={"maxIter": 1})
    assert seen[0] >= len(placed.inputFiles()) >= len(files)
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before


def test_saved_model_scores_alike(spark, rows, tmp_path):
    fitted = TR.fit(rows.where("NOT is_test"), FEW, Y, "forest", settings={"numTrees": 5, "maxDepth": 3})
    fitted.save(spark, f"{tmp_path}/m")
    again = TR.Fitted.load(spark, f"{tmp_path}/m")
    test = rows.where("is_test")
    assert again.preparation == fitted.preparation
    assert scores_of(again.scored(test)) == scores_of(fitted.scored(test))
    listed = {r.feature: r.importance for r in TR.importances(fitted, spark).collect()}
    assert list(listed) == fitted.preparation.inputs and sum(listed.values()) == pytest.approx(1)


def test_each_family_beats_chance(rows):
    small = {"boosting": {"maxIter": 5}, "forest": {"numTrees": 10, "maxDepth": 5}, "perceptron": {"maxIter": 30}}
    for kind in TR.SETTINGS:
        fitted = TR.fit(rows.where("NOT is_test"), FEW, Y, kind, kind != "perceptron", small.get(kind))
        auc = EV.roc_auc(fitted.scored(rows.where("is_test")), Y, TR.SCORE).first()["roc_auc"]
        assert auc > 0.65, kind


def test_unknown_family_is_refused():
    with pytest.raises(ValueError):
        TR.classifier("rules", 3, Y)


def test_whole_contract_reaches_auc(spark):
    """All 768 features; the test labels follow from columns among them."""
    rows = M.training_rows(spark, f"{oracle.TESTDATA}/sf0.01")
    assert len(M.FEATURES) == 768 and rows.select(F.size(TR.VALUES)).distinct().collect() == [(768,)]
    fitted = TR.fit(rows.where("NOT is_test"), M.FEATURES, Y, "logistic")
    assert EV.roc_auc(fitted.scored(rows.where("is_test")), Y, TR.SCORE).first()["roc_auc"] > 0.95


def test_threshold_comes_from_unseen_scores(spark, rows, tmp_path):
    train, test = rows.where("NOT is_test"), rows.where("is_test")
    path = f"{tmp_path}/chain"
    made = TR.select_threshold(train, test, K, Y, FEW, "logistic", 3, path)
    written = duckdb.connect()
    written.sql(f"CREATE VIEW scored AS SELECT TARGET, score AS p, fold, {K} FROM '{path}/scores/*/*.parquet'")
    # the curve is that of the written scores
    expected = written.sql(M.curve_sql(200)).fetchall()
    got = [(r.threshold, r.fp, r.fn, r.cost) for r in made.curve.collect()]
    assert sorted(got) == sorted(expected)
    assert made.threshold == min((cost, t) for t, _, _, cost in expected)[1]
    # every training row is scored once, by the model that was fitted without its fold
    assert written.sql(f"SELECT count(*), count(DISTINCT {K}) FROM scored").fetchall() == [(train.count(),) * 2]
    fold = made.scores.where("fold = 2")
    kept = TR.Fitted.load(spark, f"{path}/fold-2").scored(train.join(fold.select(K), K))
    assert scores_of(kept) == scores_of(fold)
    assert TR.Fitted.load(spark, f"{path}/fold-2").preparation == TR.learn_preparation(
        train.join(fold.select(K), K, "left_anti"), FEW)
    # the holdout is judged at that threshold
    tested = made.holdout_scores.toPandas()
    refused = tested.score >= made.threshold
    cost = 10 * ((tested.TARGET == 1) & ~refused).sum() + ((tested.TARGET == 0) & refused).sum()
    report = {r.metric: r.value for r in made.holdout.collect()}
    assert report["cost"] == cost and list(report) == EV.HOLDOUT_ORDER
    # the registry row holds the mean of the folds' own thresholds
    best = [EV.best_threshold(made.scores.where(F.col("fold") == i), Y, TR.SCORE).first()["threshold"] for i in range(5)]
    row = TR.resolve_model(made.registry).first()
    assert row["number"] == 3 and row["threshold"] == pytest.approx(np.mean(best), abs=0.006)


def test_folds_go_on_where_they_stopped(rows, tmp_path):
    train, path = rows.where("NOT is_test"), f"{tmp_path}/folds"
    first = scores_of(TR.out_of_fold(train, K, Y, FEW, folds=3, path=path))
    shutil.rmtree(f"{path}/scores/fold=1")
    models = {i: (tmp_path / f"folds/fold-{i}/model/metadata/_SUCCESS").stat().st_mtime_ns for i in range(3)}
    assert scores_of(TR.out_of_fold(train, K, Y, FEW, folds=3, path=path)) == first
    again = {i: (tmp_path / f"folds/fold-{i}/model/metadata/_SUCCESS").stat().st_mtime_ns for i in range(3)}
    assert [i for i in range(3) if models[i] != again[i]] == [1]


def test_logistic_models_of_folds_match_those_of_mllib(spark, rows, monkeypatch):
    placed = TR.in_folds(rows, K, Y, 3)
    parts = [F.col("fold") != 0, F.col("fold") != 1, F.lit(True)]
    prepared = TR.learn_preparations(placed, FEW, parts)
    monkeypatch.setattr(logistic, "BLOCK_ROWS", 37)
    known = {r[K]: r[Y] for r in placed.collect()}

    def loss(scores, inside):
        y, p = (np.array([d[k] for k in inside]) for d in (known, scores))
        weights = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
        return np.mean(weights * -np.log(np.where(y == 1, p, 1 - p)))

    for part, ours in zip(parts, TR.fit_logistic(placed, Y, prepared, parts, prepared[2].medians)):
        theirs = TR.fit(placed.where(part), FEW, Y, "logistic")
        assert ours.preparation == theirs.preparation and len(ours.preparation.flagged) > 0
        a, b = scores_of(ours.scored(rows)), scores_of(theirs.scored(rows))
        inside = [r[K] for r in placed.where(part).select(K).collect()]
        assert loss(a, inside) == pytest.approx(loss(b, inside), rel=1e-4) and len(a) == rows.count()
        # labels that a flag decides push its coefficient on for ever: both stop somewhere on a flat way
        assert np.mean([abs(a[k] - b[k]) for k in b]) < 2e-3


def test_logistic_fit_is_the_least_loss(spark):
    """Against Newton's method on the prepared numbers: missing cells, an input that never varies, one missing in one part."""
    draw = np.random.default_rng(3)
    x = draw.normal(size=(900, 4)) * [1, 50, 0, 1e-3] + [0, 7, 3, 1e6]
    y = (draw.random(900) < 1 / (1 + np.exp(-x[:, 0] - x[:, 1] / 50))).astype(int)
    cells = [[None if j in (0, 1) and (i + j) % 7 == 0 or j == 3 and i % 90 == 0 else float(v) for j, v in enumerate(r)]
             for i, r in enumerate(x)]
    names = ["a", "b", "c", "d"]
    df = TR.matrix(spark.createDataFrame([(i, int(t), *r) for i, (t, r) in enumerate(zip(y, cells))],
                                         "k int, y int, a double, b double, c double, d double").repartition(5), names, ["k", "y"])
    parts = [F.col("k") % 90 > 0, F.col("k") < 700]
    prepared = TR.learn_preparations(df, names, parts)
    assert [p.flagged for p in prepared] == [[0, 1], [0, 1, 3]]
    found = TR.fit_logistic(df, "y", prepared, parts, prepared[0].medians)
    alone = TR.fit_logistic(df, "y", prepared[1:], parts[1:], prepared[0].medians)[0].model.stages[-1]
    assert alone.coefficients == found[1].model.stages[-1].coefficients  # whatever is fitted beside it
    for keep, p, fitted in zip([np.arange(900) % 90 > 0, np.arange(900) < 700], prepared, found):
        table = np.array([[m if v is None else v for v, m in zip(r, p.medians)] + [float(r[j] is None) for j in p.flagged]
                          for r in cells])[keep]
        t, weights = y[keep], np.where(y[keep] == 1, 0.5 / y[keep].mean(), 0.5 / (1 - y[keep].mean()))
        table = np.column_stack([(table - table.mean(axis=0)), np.ones(len(t))])
        scale = np.maximum(table.std(axis=0), 1e-9)
        scale[-1] = 1
        scaled, w = table / scale, np.zeros(table.shape[1])
        for _ in range(30):
            chance = 1 / (1 + np.exp(-scaled @ w))
            curve = (scaled * (weights * chance * (1 - chance))[:, None]).T @ scaled + 1e-12 * np.eye(len(w))
            w -= np.linalg.solve(curve, scaled.T @ (weights * (chance - t)))
        least = np.mean(weights * np.logaddexp(0, np.where(t == 1, -1, 1) * (scaled @ w)))
        scores = scores_of_k(fitted.scored(df))
        ours = np.array([scores[i] for i in np.flatnonzero(keep)])
        assert np.mean(weights * -np.log(np.where(t == 1, ours, 1 - ours))) == pytest.approx(least, rel=2e-5)
        assert fitted.model.stages[-1].coefficients[2] == 0.0


def test_logistic_scores_are_those_of_mllib(rows):
    fitted = TR.fit(rows.where("NOT is_test"), FEW, Y, "logistic")
    ready = fitted.model.transform(rows.select(K, fitted.preparation.vector().alias("_raw")))
    expected = {r[K]: r.p for r in ready.select(K, TR.vector_to_array("probability")[1].alias("p")).collect()}
    got = fitted.scored(rows)
    assert got.columns == [K, Y, "is_test", TR.SCORE] and got.where("is_test").count() == rows.where("is_test").count()
    assert scores_of(got) == pytest.approx(expected, rel=1e-12) and scores_of(got.where("is_test")).items() <= scores_of(got).items()


def test_threshold_of_logistic_models_needs_no_fit_by_itself(rows, monkeypatch, tmp_path):
    monkeypatch.setattr(TR, "fit", lambda *given: pytest.fail("a logistic model was fitted by itself"))
    made = TR.select_threshold(rows.where("NOT is_test"), rows.where("is_test"), K, Y, FEW, "logistic", 1, f"{tmp_path}/chain")
    assert 0 < made.threshold < 1 and made.holdout_scores.count() == rows.where("is_test").count()


def test_labels_of_one_class_or_none_are_refused(spark, rows):
    prepared = [TR.learn_preparation(rows, FEW)]
    for bad in (rows.where(f"{Y} = 1"), rows.withColumn(Y, F.when(F.col(K) % 2 == 0, F.col(Y)))):
        with pytest.raises(ValueError):
            TR.fit_logistic(bad, Y, prepared, [F.lit(True)], prepared[0].medians)


def test_folds_share_the_passes_over_the_rows(rows, monkeypatch):
    """Once packed into blocks, rows are not prepared again for each fold."""
    asked, fitted = [], TR.fit_together
    monkeypatch.setattr(TR, "fit_together", lambda *given: asked.append(len(given[3])) or fitted(*given))
    monkeypatch.setattr(TR, "fit", lambda *given: pytest.fail("a fold was fitted by itself"))
    assert TR.out_of_fold(rows, K, Y, FEW, folds=3).count() == rows.count() and asked == [3]


def test_search_halves_and_goes_on(rows, tmp_path):
    train, path = rows.where("NOT is_test"), f"{tmp_path}/trials"
    rungs = (TR.Rung(5, 0.002, 1), TR.Rung(2, 0.004, 2))
    found = TR.search(train, K, Y, FEW, rungs, path=path).collect()
    assert [(r.rung, r.folds) for r in found] == [(1, 2)] * 2 + [(0, 1)] * 5
    low = sorted((r.cost, r.trial) for r in found if r.rung == 0)
    assert {r.trial for r in found if r.rung == 1} == {t for _, t in low[:2]}
    assert found[0].cost <= found[1].cost
    drawn = TR.draw_settings(5)
    assert all(json.loads(r.params) == drawn[r.trial] for r in found)
    assert all(r.iterations == max(1, round(drawn[r.trial]["maxIter"] * rungs[r.rung].share)) for r in found)
    assert TR.search(train, K, Y, FEW, rungs, path=path).collect() == found  # nothing is tried twice


def test_the_query_trains_every_trial_in_full(spark, rows, monkeypatch):
    monkeypatch.setattr(TR, "draw_settings", lambda trials: [
        {"maxDepth": 2, "maxIter": 2 + i, "stepSize": 0.3} for i in range(min(trials, 3))])
    asked, draw = [], TR.draw_settings
    monkeypatch.setattr(TR, "draw_settings", lambda trials: asked.append(trials) or draw(trials))
    monkeypatch.setattr(M, "training_rows", lambda spark, sf: rows)
    monkeypatch.setattr(M, "FEATURES", FEW)
    found = M.param_search(spark, "").collect()
    assert asked == [100]
    assert sorted((r.rung, r.trial, r.iterations, r.folds) for r in found) == [(0, i, 2 + i, TR.FOLDS) for i in range(3)]


def test_drawn_settings_stay_in_their_ranges():
    drawn = TR.draw_settings(100)
    assert len(drawn) == 100 and drawn[:3] == TR.draw_settings(3)
    assert all(len(d) == 8 and 4 <= d["maxDepth"] <= 8 and 0.01 <= d["stepSize"] <= 0.3 and 100 <= d["maxIter"] <= 1000
               and 5 <= d["minInstancesPerNode"] <= 100 and 0.5 <= d["subsamplingRate"] <= 1 for d in drawn)
