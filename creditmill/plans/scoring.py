"""Assemble, score, decide."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditmill.contract.features import feature_names, no_history_template
from creditmill.contract.schema import KEY, Model
from creditmill.functions.missing import finite_sql
from creditmill.functions.names import col, quoted
from creditmill.operators.encode import application_columns
from creditmill.operators.lookup import lookup_join

KNOWN = "client_known"


def assemble(requests: DataFrame, store: DataFrame, contract: Sequence[str] | None = None,
             template: Mapping[str, float | None] | None = None, request_id: str = KEY,
             keep: Sequence[str] = ()) -> DataFrame:
    """Request rows in contract shape, with ``client_known``.

    A known client takes the store row as it is, missing values included; an unknown one takes the
    template. A column that the request and the store both have is taken from the request.
    """
    contract = feature_names() if contract is None else list(contract)
    store_columns = [c for c in store.columns if c != KEY]
    template = no_history_template(store_columns) if template is None else template
    encoded = requests.select(col(KEY), *[col(c) for c in dict.fromkeys([request_id, *keep]) if c != KEY],
                              *application_columns([c for c in requests.columns if c not in keep]))
    wanted = [c for c in store_columns if c in set(contract) and c not in set(encoded.columns)]
    history = store.select(KEY, *[col(c) for c in wanted], F.lit(True).alias(KNOWN))
    joined = lookup_join(encoded, history, KEY)
    known = f"coalesce({KNOWN}, false)"
    from_store, have = set(wanted), set(encoded.columns)

    def feature(name: str) -> str:
        fallback = template.get(name)
        if name in from_store:
            value = finite_sql(quoted(name))
            if fallback is not None:
                value = f"CASE WHEN {known} THEN {value} ELSE {float(fallback)}D END"
        elif name in have:
            value = finite_sql(quoted(name))
        elif fallback is not None:
            value = f"CASE WHEN NOT {known} THEN {float(fallback)}D END"
        else:
            value = "CAST(NULL AS DOUBLE)"
        return f"{value} AS {quoted(name)}"

    carried = [quoted(c) for c in dict.fromkeys([KEY, request_id, *keep])]
    return joined.selectExpr(*carried, f"{known} AS {KNOWN}", *[feature(name) for name in contract])


def income_credit_score() -> Column:
    """The deterministic scorer used in tests: 1 - income / credit, clamped to [0, 1].

    Inputs are read at single precision, as a model would get them.
    """
    income = F.coalesce(F.col("AMT_INCOME_TOTAL").cast("float").cast("double"), F.lit(0.0))
    credit = F.coalesce(F.col("AMT_CREDIT").cast("float").cast("double"), F.lit(1.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - income / F.greatest(credit, F.lit(1.0))))


def decide(probability: Column, threshold: float) -> Column:
    """The threshold itself refuses."""
    return F.when(probability >= threshold, "REFUSED").when(probability.isNotNull(), "GRANTED")


def respond(scored: DataFrame, probability: Column, model: Model, keep: Sequence[str] = ()) -> DataFrame:
    return scored.select(
        col(KEY).alias("sk_id_curr"), *[col(c) for c in keep],
        probability.alias("probability_default"),
        decide(probability, model.threshold).alias("decision"),
        F.lit(model.threshold).alias("threshold"),
        F.lit(model.version).alias("model_version"),
        F.col(KNOWN))


def score_with(df: DataFrame, features: Sequence[str], load_scorer: Callable[[], Callable],
               keep: Sequence[str]) -> DataFrame:
    """Score with any function from an (n, features) float32 array to (n, 2) class probabilities.

    ``load_scorer`` runs once per task, so the model is loaded where it is used and never shipped.
    """
    features, keep = list(features), list(keep)
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("probability_default", T.DoubleType())])

    def run(batches: Iterator) -> Iterator:
        scorer = load_scorer()
        for batch in batches:
            out = batch[keep].copy()
            out["probability_default"] = scorer(batch[features].to_numpy(dtype="float32"))[:, 1].astype("float64")
            yield out

    return df.select(*[col(c) for c in dict.fromkeys([*keep, *features])]).mapInPandas(run, schema)
