"""Classification metrics and threshold selection over tables of (label, score)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditmill.functions.missing import share_of
from creditmill.functions.names import col
from creditmill.operators.lookup import join_groups
from creditmill.operators.ordered import running_sums

# --- fixed values ---------------------------------------------------------------------------
COST_OF_MISSED_DEFAULT = 10
COST_OF_FALSE_ALARM = 1
BETA = 1.5
FIRST_THRESHOLD, LAST_THRESHOLD = 0.01, 0.99
SEARCH_STEPS, CURVE_STEPS = 100, 200
HOLDOUT_ORDER = ["roc_auc", "pr_auc", "recall", "precision", "cost", "f1", "fbeta"]


def cost(false_negatives: Column, false_positives: Column) -> Column:
    return COST_OF_MISSED_DEFAULT * false_negatives + COST_OF_FALSE_ALARM * false_positives


def confusion(df: DataFrame, label: str, predicted: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by..., tn, fp, fn, tp, cost)."""
    y, p = F.col(label) == 1, predicted
    counts = df.groupBy(*by).agg(F.count_if(~y & ~p).alias("tn"), F.count_if(~y & p).alias("fp"),
                                 F.count_if(y & ~p).alias("fn"), F.count_if(y & p).alias("tp"))
    return counts.withColumn("cost", cost(F.col("fn"), F.col("fp")))


def with_rates(counts: DataFrame, beta: float = BETA) -> DataFrame:
    """Add precision, recall, f1 and fbeta to confusion counts; an empty denominator gives 0."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    b2 = beta * beta
    return counts.withColumns({
        "precision": share_of(tp, tp + fp),
        "recall": share_of(tp, tp + fn),
        "f1": share_of(2 * tp, 2 * tp + fp + fn),
        "fbeta": share_of((1 + b2) * tp, (1 + b2) * tp + b2 * fn + fp),
    })


def thresholds(steps: int) -> list[float]:
    """Evenly spaced from the first to the last threshold, both included."""
    gap = (LAST_THRESHOLD - FIRST_THRESHOLD) / (steps - 1)
    return [FIRST_THRESHOLD + i * gap for i in range(steps - 1)] + [LAST_THRESHOLD]


def cost_curve(df: DataFrame, label: str, score: str, steps: int = CURVE_STEPS,
               by: Sequence[str] = ()) -> DataFrame:
    """(by..., threshold, fp, fn, cost) with ``score >= threshold`` predicting 1.

    Each score is first reduced to the number of thresholds it reaches, so one aggregate with at most
    steps + 1 rows per group answers all thresholds.
    """
    by = list(by)
    grid = thresholds(steps)
    cuts = F.array(*[F.lit(t) for t in grid])
    gap = (LAST_THRESHOLD - FIRST_THRESHOLD) / (steps - 1)
    # arithmetic gives the position up to rounding; the neighbours are then compared exactly
    guess = F.greatest(F.lit(0), F.least(F.lit(steps), F.floor((col(score) - FIRST_THRESHOLD) / gap).cast("int")))
    reached = (F.filter(F.sequence(F.greatest(F.lit(0), guess - 1), F.least(F.lit(steps - 1), guess + 1)),
                        lambda i: F.get(cuts, i) <= col(score)))
    count = F.when(F.size(reached) > 0, F.array_max(reached) + 1).otherwise(F.greatest(F.lit(0), guess - 1))
    counted = (df.where(col(score).isNotNull() & col(label).isNotNull())
               .select(*by, count.cast("int").alias("reached"), (col(label) == 1).cast("int").alias("y"))
               .groupBy(*by, "reached").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")))
    rows = counted.groupBy(*by).agg(F.collect_list(F.struct("reached", "pos", "neg")).alias("_r"))

    def total(field: str, keep) -> Column:
        return F.aggregate(F.filter("_r", keep), F.lit(0).cast("bigint"), lambda acc, r: acc + r[field])

    # threshold number i (0-based) is reached by scores with reached > i
    points = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.struct(
        F.get(cuts, i).alias("threshold"),
        total("neg", lambda r: r["reached"] > i).alias("fp"),
        total("pos", lambda r: r["reached"] <= i).alias("fn")))
    return (rows.select(*by, F.inline(points))
            .withColumn("cost", cost(F.col("fn"), F.col("fp"))))


def best_threshold(df: DataFrame, label: str, score: str, steps: int = SEARCH_STEPS,
                   by: Sequence[str] = ()) -> DataFrame:
    """The threshold of least cost, the lowest one on a tie: (by..., threshold, cost)."""
    curve = cost_curve(df, label, score, steps, by)
    least = F.min(F.struct("cost", "threshold")).alias("m")
    return curve.groupBy(*by).agg(least).select(*by, "m.threshold", "m.cost")


def _by_score(df: DataFrame, label: str, score: str, by: Sequence[str]) -> DataFrame:
    """Per distinct score the number of ones (pos) and zeros (neg), with running sums from the low end."""
    by = list(by)
    counted = (df.where(col(score).isNotNull() & col(label).isNotNull())
               .select(*by, col(score).cast("double").alias("_s"), (col(label) == 1).cast("int").alias("_y"))
               .groupBy(*by, "_s").agg(F.sum("_y").cast("bigint").alias("pos"),
                                       F.sum(1 - F.col("_y")).cast("bigint").alias("neg")))
    return running_sums(counted, by, "_s", ["pos", "neg"])


def ranking_metrics(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., roc_auc, pr_auc) from one ranking.

    roc_auc is the chance that a one scores above a zero, ties counting half. pr_auc sums, over the
    distinct scores from the top, the recall gained times the precision reached.
    """
    ranked = _by_score(df, label, score, by)
    wins = F.sum(F.col("pos") * (F.col("neg_before") + 0.5 * F.col("neg")))
    pairs = F.max("pos_total") * F.max("neg_total").cast("double")
    hits = (F.col("pos_total") - F.col("pos_before")).cast("double")
    alarms = hits + F.col("neg_total") - F.col("neg_before")
    gained = F.col("pos") / F.nullif(F.col("pos_total"), F.lit(0))
    return ranked.groupBy(*by).agg((wins / F.nullif(pairs, F.lit(0.0))).alias("roc_auc"),
                                   F.sum(gained * hits / alarms).alias("pr_auc"))


def roc_auc(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    return ranking_metrics(df, label, score, by).drop("pr_auc")


def average_precision(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    return ranking_metrics(df, label, score, by).drop("roc_auc")


def metrics(df: DataFrame, label: str, score: str, threshold: Column, by: Sequence[str] = ()) -> DataFrame:
    """All eight metrics in one row (per group); ``threshold`` may be a column of ``df``."""
    by = list(by)
    rows = df.withColumn("_all", F.lit(1))
    keys = ["_all", *by]
    point = with_rates(confusion(rows, label, col(score) >= threshold, keys))
    return join_groups(point, ranking_metrics(rows, label, score, keys), keys).drop("_all")


def fold_metrics(df: DataFrame, label: str, score: str, fold: str, steps: int = SEARCH_STEPS) -> DataFrame:
    """Metrics of every fold at the fold's own best threshold."""
    best = best_threshold(df, label, score, steps, [fold]).select(fold, F.col("threshold").alias("best_threshold"))
    # one threshold per fold: a handful of rows
    with_best = df.join(F.broadcast(best), fold)
    return (metrics(with_best, label, score, F.col("best_threshold"), [fold])
            .join(best, fold))


def fold_summary(per_fold: DataFrame, names: Sequence[str]) -> DataFrame:
    """Mean and population standard deviation over folds, to two decimals: (metric, mean, std)."""
    stats = per_fold.agg(*[f(n).alias(f"{n}_{k}") for n in names
                           for k, f in (("mean", F.avg), ("std", F.stddev_pop))])
    rows = [F.struct(F.lit(n).alias("metric"), F.bround(f"{n}_mean", 2).alias("mean"),
                     F.bround(f"{n}_std", 2).alias("std")) for n in names]
    return stats.select(F.inline(F.array(*rows)))


def holdout_report(metric_row: DataFrame) -> DataFrame:
    """The holdout table in its fixed order: (position, metric, value)."""
    rows = [F.struct(F.lit(i).alias("position"), F.lit(n).alias("metric"),
                     F.bround(col(n).cast("double"), 2).alias("value")) for i, n in enumerate(HOLDOUT_ORDER, 1)]
    return metric_row.select(F.inline(F.array(*rows)))


def with_class_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Add the balanced weight of a 0/1 label: all rows / (2 * rows of the class).

    The two counts come from a one-row subquery. A join on the label would send half of the rows to one
    task.
    """
    ones = F.count_if(col(label) == 1)
    counts = df.agg(F.struct(F.count(col(label)).alias("n"), ones.alias("ones"))).scalar()
    of_class = F.when(col(label) == 1, F.col("_c.ones")).otherwise(F.col("_c.n") - F.col("_c.ones"))
    return (df.withColumn("_c", counts)
            .withColumn(name, F.when(col(label).isNotNull(), F.col("_c.n") / (2 * of_class))).drop("_c"))


def score_extremes(df: DataFrame, key: str, score: str, label: str) -> DataFrame:
    """The highest- and lowest-scored row, the lower key on a tie: (which, key, score, label)."""
    row = F.struct(col(key), col(score), col(label))
    scored = df.where(col(score).isNotNull())
    both = scored.agg(F.max_by(row, F.struct(col(score), -col(key))).alias("high"),
                      F.min_by(row, F.struct(col(score), col(key))).alias("low"))
    pair = F.array(*[F.struct(F.lit(w).alias("which"), F.col(f"{w}.{key}").alias(key),
                              F.col(f"{w}.{score}").alias(score), F.col(f"{w}.{label}").alias(label))
                     for w in ("high", "low")])
    return both.select(F.inline(pair))


def compare_scorers(pairs: DataFrame, a: str, b: str, threshold: float, band: float = 0.005) -> DataFrame:
    """How far two scorers of the same rows disagree, and which decisions that flips.

    One row; p95 and p99 are exact.
    """
    from creditmill.operators.ordered import quantiles

    rows = pairs.select(F.lit(1).alias("_all"), col(a).alias("_a"), col(b).alias("_b"),
                        F.abs(col(a) - col(b)).alias("_d"))
    refuse_a, refuse_b = F.col("_a") >= threshold, F.col("_b") >= threshold
    flip = refuse_a != refuse_b
    near = (F.col("_a") > threshold - band) & (F.col("_a") < threshold + band)
    stats = rows.groupBy("_all").agg(
        F.count(F.lit(1)).alias("n"), F.max("_d").alias("max_delta"), F.avg("_d").alias("mean_delta"),
        F.count_if(F.col("_d") > 1e-5).alias("above_1e5"), F.count_if(F.col("_d") > 1e-3).alias("above_1e3"),
        F.count_if(flip).alias("flips"),
        F.count_if(refuse_a & ~refuse_b).alias("refused_to_granted"),
        F.count_if(~refuse_a & refuse_b).alias("granted_to_refused"),
        F.count_if(near).alias("in_band"), F.count_if(near & flip).alias("flips_in_band"),
        F.count_if((F.col("_a") > 0.5) != (F.col("_b") > 0.5)).alias("flips_at_half"))
    spread = (quantiles(rows, ["_all"], {"d": F.col("_d")}, {"p95": 0.95, "p99": 0.99})
              .withColumnsRenamed({"d_p95": "p95_delta", "d_p99": "p99_delta"}))
    return stats.join(spread, "_all").drop("_all")
