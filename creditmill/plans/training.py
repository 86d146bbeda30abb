"""Model training, out-of-fold scores, threshold choice, parameter search and the model registry, with MLlib.

Models see every feature of the contract. A row is kept as one array column, so plans stay narrow however many
features there are; what a fit learns about the features (medians, which of them can be missing) comes from counted
values, exactly and the same at every run.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target, keyword_only
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LogisticRegression, LogisticRegressionModel,
                                       MultilayerPerceptronClassifier, RandomForestClassifier)
from pyspark.ml.common import _py2java
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param.shared import HasLabelCol
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from creditmill.contract.schema import Model
from creditmill.functions.names import col, quoted
from creditmill.operators.evaluate import (CURVE_STEPS, SEARCH_STEPS, best_threshold, cost_curve, fold_metrics,
                                           fold_summary, holdout_report, metrics, with_class_weights)
from creditmill.operators.logistic import Part, chances, fit_together
from creditmill.operators.ordered import running_sums
from creditmill.operators.sampling import BROADCAST_KEYS, stratified_folds
from creditmill.session import cut_lineage, new_table_path, passing_tables, path_exists, small_reads
from creditmill.sources.tables import read_artefact, write_artefact

# --- fixed values ---------------------------------------------------------------------------
SEED = 42
FOLDS = 5
FOLD_METRICS = ["roc_auc", "pr_auc", "recall", "precision", "f1", "fbeta", "cost", "best_threshold"]
#: Of each model family as it is first trained. Tree depths stand for 31 leaves and for trees without a limit.
SETTINGS = {
    "boosting": {"maxIter": 100, "maxDepth": 5, "stepSize": 0.1},
    "forest": {"numTrees": 100, "maxDepth": 12},
    "logistic": {"maxIter": 1000},
    "perceptron": {"maxIter": 300},
}
HIDDEN_LAYERS = [100, 50]
# ---------------------------------------------------------------------------------------------
WEIGHT = "weight"
SCORE = "score"
VALUES = "values"  # the array of feature values, missing ones NULL
#: Cells in which values are counted before the medians; those of 1 and of -1 lie this far from the cell of 0.
CELLS_PER_OCTAVE = 32
CELL_OF_ONE = 40_000
_VECTOR = "probability"  # the column MLlib classifiers write
#: A row of the contract takes 2 KB in a file and up to 16 KB in MLlib's memory, which holds a whole partition at a time.
FILE_ROWS = 10_000
READ_BYTES = 64 << 20


# --- rows and what is learnt about them before a fit ---------------------------------------------
def matrix(df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """``keep`` and all features in one array column, written once: every fit reads this table, not the plan of ``df``."""
    values = ", ".join(f"CAST({quoted(f)} AS DOUBLE)" for f in features)
    return cut_lineage(df.select(*[col(c) for c in keep], F.expr(f"array({values})").alias(VALUES)), "matrix", FILE_ROWS)


@dataclass(frozen=True)
class Preparation:
    """Median of every feature, and the positions of those that were missing somewhere.

    MLlib trees cannot route missing values, so they are imputed and each such feature gets a 0/1 flag. A feature without
    any value has median 0.
    """

    features: list[str]
    medians: list[float]
    flagged: list[int]

    @property
    def inputs(self) -> list[str]:
        return self.features + [f"{self.features[i]}_missing" for i in self.flagged]

    def vector(self) -> Column:
        medians = F.lit(self.medians)
        filled = F.transform(VALUES, lambda v, i: F.coalesce(v, F.get(medians, i)))
        if not self.flagged:
            return array_to_vector(filled)
        flags = F.transform(F.lit(self.flagged), lambda i: F.get(F.col(VALUES), i).isNull().cast("double"))
        return array_to_vector(F.concat(filled, flags))


def _cell(value: Column) -> Column:
    """A whole number that never falls as ``value`` grows: sign and a 32nd of an octave."""
    size = F.floor(F.least(F.log2(F.abs(value)), F.lit(1025.0)) * CELLS_PER_OCTAVE) + CELL_OF_ONE
    return (F.when(F.isnan(value), 2 * CELL_OF_ONE).when(value == 0, 0).when(value < 0, -size).otherwise(size)
            .cast("int"))


def learn_preparations(rows: DataFrame, features: Sequence[str], parts: Sequence[Column]) -> list[Preparation]:
    """Exact medians of all features over the rows of each part. Parts may overlap.

    One pass counts the values of each cell for all parts and finds the cells that hold a middle rank; a second counts
    the different values of these cells only. What is shuffled is cells and the values of a few of them, not all
    different values. At most two rows per feature and part reach the driver.
    """
    names = [f"n{p}" for p in range(len(parts))]
    marked = rows.select(VALUES, *[part.alias(n) for n, part in zip(names, parts)])
    cells = (marked.select(*names, F.posexplode(VALUES)).where("col IS NOT NULL")
             .withColumn("cell", _cell(F.col("col"))))
    counts = [F.count_if(n).alias(n) for n in names]

    def holds(n: str, rank: Column, before: Column) -> Column:
        return (before <= rank) & (rank < before + F.col(n))

    low = {n: F.floor((F.col(f"{n}_total") - 1) / 2) for n in names}
    high = {n: F.floor(F.col(f"{n}_total") / 2) for n in names}
    whole = Window.partitionBy("pos")
    earlier = whole.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    placed = cells.groupBy("pos", "cell").agg(*counts).select(
        "*", *[F.sum(n).over(whole).alias(f"{n}_total") for n in names],
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"{n}_start") for n in names])
    middle = [holds(n, rank[n], F.col(f"{n}_start")) for n in names for rank in (low, high)]
    kept = placed.where(reduce(lambda a, b: a | b, middle)).drop(*names)
    wanted = F.broadcast(rows.sparkSession.createDataFrame(kept.collect(), kept.schema))

    picked = []
    for n in names:
        before = F.col(f"{n}_start") + F.col(f"{n}_before")
        picked += [F.max(f"{n}_total").alias(n),
                   *[F.max(F.when(holds(n, rank[n], before), F.col("col"))).alias(f"{n}_{label}")
                     for label, rank in (("low", low), ("high", high))]]
    inside = cells.join(wanted.select("pos", "cell"), ["pos", "cell"]).groupBy("pos", "cell", "col").agg(*counts)
    with passing_tables(rows.sparkSession):
        ranked = running_sums(inside, ["pos", "cell"], "col", names).drop(*[f"{n}_total" for n in names])
        found = {r.pos: r for r in ranked.join(wanted, ["pos", "cell"]).groupBy("pos").agg(*picked).collect()}
    sizes = marked.agg(*counts).first()
    out = []
    for n in names:
        have = {i: r for i, r in found.items() if r[n] > 0}
        medians = [(have[i][f"{n}_low"] + have[i][f"{n}_high"]) / 2 if i in have else 0.0 for i in range(len(features))]
        flagged = [i for i in range(len(features)) if i not in have or have[i][n] < sizes[n]]
        out.append(Preparation(list(features), medians, flagged))
    return out


def learn_preparation(rows: DataFrame, features: Sequence[str]) -> Preparation:
    return learn_preparations(rows, features, [F.lit(True)])[0]


def in_folds(rows: DataFrame, key: str, label: str, folds: int) -> DataFrame:
    """``rows`` with their ``fold``, written. Keys and folds go to the wide rows where there are few enough to broadcast."""
    split = stratified_folds(rows.select(key, label), key, label, folds, SEED).select(key, "fold")
    few = rows.count() <= BROADCAST_KEYS
    return cut_lineage(rows.join(F.broadcast(split) if few else split, key), "folded", FILE_ROWS)


# --- models --------------------------------------------------------------------------------------
def classifier(kind: str, n_inputs: int, label: str, weighted: bool = True,
               settings: Mapping[str, object] | None = None) -> list[Estimator]:
    """The stages of one of the four model families.

    Only the perceptron needs scaled inputs: trees do not care, and the logistic model scales by itself. The perceptron
    takes no row weights.
    """
    common = {"labelCol": label, "featuresCol": "features", **SETTINGS.get(kind, {}), **(settings or {})}
    weights = {"weightCol": WEIGHT} if weighted else {}
    if kind == "boosting":
        return [GBTClassifier(seed=SEED, **common, **weights)]
    if kind == "forest":
        return [RandomForestClassifier(seed=SEED, **common, **weights)]
    if kind == "logistic":
        return [LogisticRegression(**common, **weights)]
    if kind == "perceptron":
        scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
        layers = [n_inputs, *HIDDEN_LAYERS, 2]
        return [scaler, MultilayerPerceptronClassifier(seed=SEED, layers=layers, **common | {"featuresCol": "scaled"})]
    raise ValueError(f"unknown model {kind!r}")


@dataclass(frozen=True)
class Fitted:
    """A model with the preparation it was fitted behind; both are saved and loaded together."""

    preparation: Preparation
    model: PipelineModel

    def scored(self, rows: DataFrame) -> DataFrame:
        """``rows`` without the features, with the probability of class 1."""
        last = self.model.stages[-1]
        if isinstance(last, LogisticRegressionModel):  # without a vector of every row
            part = Part(self.preparation.medians, self.preparation.flagged)
            return chances(rows, VALUES, part, last.coefficients.toArray(), last.intercept, SCORE)
        kept = [col(c) for c in rows.columns if c != VALUES]
        ready = rows.select(*kept, self.preparation.vector().alias("_raw"))
        return self.model.transform(ready).select(*kept, vector_to_array(_VECTOR)[1].alias(SCORE))

    def save(self, spark: SparkSession, path: str) -> None:
        write_artefact(spark, vars(self.preparation), f"{path}/preparation")
        self.model.write().overwrite().save(f"{path}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Fitted:
        return cls(Preparation(**read_artefact(spark, f"{path}/preparation")), PipelineModel.load(f"{path}/model"))


def fit(rows: DataFrame, features: Sequence[str], label: str, kind: str = "logistic", weighted: bool = True,
        settings: Mapping[str, object] | None = None, preparation: Preparation | None = None) -> Fitted:
    """Fit on the rows of a ``matrix``. The assembler keeps mostly-zero rows (one-hot columns, flags) sparse.

    ``preparation`` is what ``learn_preparation`` finds in ``rows``, if it is known already.
    """
    preparation = preparation or learn_preparation(rows, features)
    ready = with_class_weights(rows, label, WEIGHT) if weighted else rows
    ready = ready.select(*[col(c) for c in ready.columns if c != VALUES], preparation.vector().alias("_raw"))
    assembler = VectorAssembler(inputCols=["_raw"], outputCol="features")
    stages = classifier(kind, len(preparation.inputs), label, weighted, settings)
    with small_reads(rows.sparkSession, READ_BYTES):
        return Fitted(preparation, Pipeline(stages=[assembler, *stages]).fit(ready))


def fit_logistic(rows: DataFrame, label: str, preparations: Sequence[Preparation], parts: Sequence[Column],
                 centre: Sequence[float], settings: Mapping[str, object] | None = None) -> list[Fitted]:
    """``fit`` of a logistic model with class weights on each part of the rows; all parts share every pass over the rows.

    ``centre`` is about the middle of each feature, as the median of all rows; numbers are kept as distances from it.
    """
    spark = rows.sparkSession
    most = {**SETTINGS["logistic"], **(settings or {})}["maxIter"]
    with small_reads(spark, READ_BYTES):
        found = fit_together(rows, label, VALUES, parts, [Part(p.medians, p.flagged) for p in preparations], centre, most)
    assembler = VectorAssembler(inputCols=["_raw"], outputCol="features")
    return [Fitted(p, PipelineModel([assembler, _logistic_model(spark, label, *model)]))
            for p, model in zip(preparations, found)]


def _logistic_model(spark: SparkSession, label: str, coefficients: Sequence[float], intercept: float) -> LogisticRegressionModel:
    """MLlib's model with known coefficients; only its JVM class can be made of them."""
    settings = LogisticRegression(labelCol=label, featuresCol="features", weightCol=WEIGHT)
    vector = _py2java(spark.sparkContext, Vectors.dense(coefficients))
    made = spark._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(settings.uid, vector, float(intercept))
    return settings._copyValues(LogisticRegressionModel(made))


def importances(fitted: Fitted, spark: SparkSession) -> DataFrame:
    """(feature, importance): split gain of a tree model, coefficient size of a linear one."""
    last = fitted.model.stages[-1]
    values = last.featureImportances if hasattr(last, "featureImportances") else last.coefficients
    rows = [(n, abs(float(v))) for n, v in zip(fitted.preparation.inputs, values.toArray())]
    return spark.createDataFrame(rows, "feature string, importance double")


# --- from out-of-fold scores to a threshold ---------------------------------------------------------
def out_of_fold(rows: DataFrame, key: str, label: str, features: Sequence[str], kind: str = "logistic",
                folds: int = FOLDS, settings: Mapping[str, object] | None = None, path: str | None = None) -> DataFrame:
    """Every row of a ``matrix`` scored by a model that has not seen it; adds ``fold`` and ``score``.

    Logistic models of all folds are fitted side by side, others one after the other. The model of a fold is kept at ``path``/fold-<i> and its scores at ``path``/scores/fold=<i>. Run again with the same
    rows and path, the folds whose scores are complete are not fitted again.
    """
    spark = rows.sparkSession
    path = new_table_path(spark, "folds") if path is None else path
    place = f"{path}/scores/fold="
    left = [fold for fold in range(folds) if not path_exists(spark, f"{place}{fold}/_SUCCESS")]
    with passing_tables(spark):
        if left:
            placed = in_folds(rows, key, label, folds)
            parts = [F.col("fold") != fold for fold in left]
            *prepared, whole = learn_preparations(placed, features, [*parts, F.lit(True)])
            together = (fit_logistic(placed, label, prepared, parts, whole.medians, settings) if kind == "logistic"
                        else [None] * len(left))
        for fold, preparation, fitted in zip(left, prepared, together) if left else []:
            fitted = fitted or fit(placed.where(F.col("fold") != fold), features, label, kind, kind != "perceptron", settings,
                                   preparation)
            fitted.save(spark, f"{path}/fold-{fold}")
            (fitted.scored(placed.where(F.col("fold") == fold)).drop("fold")
             .write.mode("overwrite").parquet(f"{place}{fold}"))
    return spark.read.option("basePath", f"{path}/scores").parquet(
        *[f"{path}/scores/fold={fold}" for fold in range(folds)])


@dataclass(frozen=True)
class Selection:
    """What one choice of a threshold leaves behind; all of it derives from ``scores``, which is a written table."""

    scores: DataFrame
    curve: DataFrame
    threshold: float
    holdout_scores: DataFrame
    holdout: DataFrame
    registry: DataFrame


def select_threshold(train: DataFrame, test: DataFrame, key: str, label: str, features: Sequence[str], name: str,
                     version: int, path: str, kind: str = "logistic",
                     settings: Mapping[str, object] | None = None) -> Selection:
    """Out-of-fold scores, their cost curve, its cheapest threshold, and at that threshold the holdout rows.

    The model for the holdout is fitted on all of ``train`` and kept at ``path``/final. The registry row has the mean and
    spread of the folds, each of which is evaluated once.
    """
    spark = train.sparkSession
    scores = out_of_fold(train, key, label, features, kind, settings=settings, path=path)
    curve = cut_lineage(cost_curve(scores, label, SCORE, CURVE_STEPS), "curve")
    threshold = curve.orderBy("cost", "threshold").first()["threshold"]
    if path_exists(spark, f"{path}/final/model/metadata/_SUCCESS"):
        final = Fitted.load(spark, f"{path}/final")
    else:
        if kind == "logistic":
            prepared = learn_preparation(train, features)
            final = fit_logistic(train, label, [prepared], [F.lit(True)], prepared.medians, settings)[0]
        else:
            final = fit(train, features, label, kind, kind != "perceptron", settings)
        final.save(spark, f"{path}/final")
    tested = cut_lineage(final.scored(test), "holdout")
    report = holdout_report(metrics(tested, label, SCORE, F.lit(threshold)))
    per_fold = cut_lineage(fold_metrics(scores, label, SCORE, "fold"), "per-fold")
    registry = registry_rows(name, version, fold_summary(per_fold, FOLD_METRICS))
    return Selection(scores, curve, threshold, tested, report, registry)


class CostEvaluator(Evaluator, HasLabelCol):
    """Least business cost of scored rows over the threshold grid; smaller is better."""

    @keyword_only
    def __init__(self, labelCol: str = "label"):
        super().__init__()
        self._set(labelCol=labelCol)

    def _evaluate(self, dataset: DataFrame) -> float:
        scored = dataset.select(col(self.getLabelCol()), vector_to_array(_VECTOR)[1].alias(SCORE))
        return float(best_threshold(scored, self.getLabelCol(), SCORE, SEARCH_STEPS).first()["cost"])

    def isLargerBetter(self) -> bool:
        return False


# --- parameter search -----------------------------------------------------------------------------
@dataclass(frozen=True)
class Rung:
    """``trials`` settings meet here, each with this share of its iterations, over so many of the folds."""

    trials: int
    share: float
    folds: int


#: 100 settings, each trained with all its iterations over all folds.
RUNGS = (Rung(100, 1.0, FOLDS),)


def draw_settings(trials: int, seed: int = SEED) -> list[dict[str, object]]:
    """Seeded settings of a boosted model over eight ranges.

    Leaves become a depth, the smallest leaf a row count, the shares of rows and of columns themselves; MLlib has no
    penalty on leaf weights, so the two penalties become the least gain and the least weight of a node.
    """
    draw = random.Random(seed)
    out = []
    for _ in range(trials):
        out.append({
            "maxDepth": int(math.log2(draw.randint(20, 300))),
            "stepSize": math.exp(draw.uniform(math.log(0.01), math.log(0.3))),
            "maxIter": draw.randint(100, 1000),
            "minInstancesPerNode": draw.randint(5, 100),
            "subsamplingRate": draw.uniform(0.5, 1.0),
            "featureSubsetStrategy": str(draw.uniform(0.5, 0.999)),
            "minInfoGain": math.exp(draw.uniform(math.log(1e-8), math.log(1e-2))),
            "minWeightFractionPerNode": math.exp(draw.uniform(math.log(1e-8), math.log(1e-2))),
        })
    return out


def search(rows: DataFrame, key: str, label: str, features: Sequence[str], rungs: Sequence[Rung] = RUNGS,
           parallelism: int = 4, path: str | None = None) -> DataFrame:
    """Mean business cost of drawn settings: (rung, trial, iterations, folds, cost, params), the last rung's best first.

    By default every trial is trained in full. A caller may ask for successive halving instead: the cheapest trials of a
    rung enter the next. Folds are prepared and written once for all trials. Finished trials are written below ``path``; a
    search started again there goes on after them.
    """
    spark = rows.sparkSession
    path = new_table_path(spark, "trials") if path is None else path
    settings = draw_settings(rungs[0].trials)
    most = max(r.folds for r in rungs)
    schema = "rung int, trial int, iterations int, folds int, cost double, params string"

    def prepared(placed: DataFrame, fold: int, preparation: Preparation) -> DataFrame:
        inside = F.col("fold") != fold
        weighted = with_class_weights(placed.withColumn("_y", F.when(inside, col(label))), "_y", WEIGHT)
        ready = weighted.select(col(label), WEIGHT, inside.alias("train"), preparation.vector().alias("_raw"))
        return cut_lineage(VectorAssembler(inputCols=["_raw"], outputCol="features").transform(ready).drop("_raw"), "fold",
                           FILE_ROWS)

    with passing_tables(spark), small_reads(spark, READ_BYTES):
        placed = in_folds(rows, key, label, FOLDS)
        found = learn_preparations(placed, features, [F.col("fold") != fold for fold in range(most)])
        tables = [prepared(placed, fold, found[fold]) for fold in range(most)]

        def run(job: tuple[int, int]) -> None:
            rung, trial = job
            params = settings[trial] | {"maxIter": max(1, round(settings[trial]["maxIter"] * rungs[rung].share))}
            costs = []
            for table in tables[:rungs[rung].folds]:
                model = classifier("boosting", 0, label, True, params)[0].fit(table.where("train"))
                costs.append(CostEvaluator(labelCol=label).evaluate(model.transform(table.where("NOT train"))))
            row = (rung, trial, params["maxIter"], len(costs), sum(costs) / len(costs), json.dumps(settings[trial]))
            # a folder each: trials that end together must not share one that is being committed
            spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/{rung}-{trial}")

        entering = list(range(len(settings)))
        with ThreadPool(parallelism) as pool:
            for number, rung in enumerate(rungs):
                entering = entering[:rung.trials]
                done = {(r.rung, r.trial) for r in _trials(spark, path, schema)}
                pool.map(inheritable_thread_target(spark)(run),
                         [(number, t) for t in entering if (number, t) not in done], chunksize=1)
                done = {(r.rung, r.trial): r.cost for r in _trials(spark, path, schema)}
                entering.sort(key=lambda t: (done[number, t], t))
    return spark.read.schema(schema).parquet(f"{path}/*").orderBy(F.desc("rung"), "cost", "trial")


def _trials(spark: SparkSession, path: str, schema: str):
    """The finished trials, a row each: as many as the search has rungs and trials."""
    return spark.read.schema(schema).parquet(f"{path}/*").collect() if path_exists(spark, path) else []


# --- registry -----------------------------------------------------------------------------------
def registry_rows(name: str, version: int, summary: DataFrame) -> DataFrame:
    """One registry row (name, version, document) from a metric table (metric, mean, std)."""
    entries = F.flatten(F.collect_list(F.array(*[
        F.struct(F.concat("metric", F.lit(f"_{k}")).alias("k"), F.col(k).alias("v")) for k in ("mean", "std")])))
    doc = F.to_json(F.struct(F.lit(name).alias("model_name"), F.lit(str(version)).alias("version"),
                             F.map_from_entries(F.col("e")).alias("metrics")))
    return summary.agg(entries.alias("e")).select(F.lit(name).alias("model_name"), F.lit(version).alias("number"),
                                                  doc.alias("document"))


def resolve_model(registry: DataFrame, default: Model = Model()) -> DataFrame:
    """Threshold and version per registry row, with defaults for what a document leaves out."""
    threshold = F.get_json_object("document", "$.metrics.best_threshold_mean").cast("double")
    version = F.get_json_object("document", "$.version")
    return registry.select("model_name", "number",
                           F.coalesce(threshold, F.lit(default.threshold)).alias("threshold"),
                           F.coalesce(version, F.lit(default.version)).alias("version"))


def write_registry(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)

