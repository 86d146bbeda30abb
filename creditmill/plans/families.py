"""The five client-level feature families over the child tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditmill.contract import schema, vocabulary
from creditmill.contract.schema import KEY
from creditmill.functions.missing import not_below, ratio_keep_inf, sentinel_to_null
from creditmill.operators.rollup import Rollup

_RANGE = ("min", "max", "mean")

BALANCE = Rollup("", numeric={"MONTHS_BALANCE": ("min", "max", "size")}, shares=vocabulary.BUREAU_BALANCE,
                 gather=False)

BUREAU = Rollup(
    "BURO",
    numeric={
        "DAYS_CREDIT": (*_RANGE, "var"),
        "DAYS_CREDIT_ENDDATE": _RANGE,
        "DAYS_CREDIT_UPDATE": ("mean",),
        "CREDIT_DAY_OVERDUE": ("max", "mean"),
        "AMT_CREDIT_MAX_OVERDUE": ("mean",),
        "AMT_CREDIT_SUM": ("max", "mean", "sum"),
        "AMT_CREDIT_SUM_DEBT": ("max", "mean", "sum"),
        "AMT_CREDIT_SUM_OVERDUE": ("mean",),
        "AMT_CREDIT_SUM_LIMIT": ("mean", "sum"),
        "AMT_ANNUITY": ("max", "mean"),
        "CNT_CREDIT_PROLONG": ("sum",),
        "MONTHS_BALANCE_MIN": ("min",),
        "MONTHS_BALANCE_MAX": ("max",),
        "MONTHS_BALANCE_SIZE": ("mean", "sum"),
    },
    shares=vocabulary.BUREAU,
    carried={name: ("mean",) for name in BALANCE.output_columns() if name.startswith("STATUS_")},
    subsets={"ACTIVE": ("CREDIT_ACTIVE", "Active"), "CLOSED": ("CREDIT_ACTIVE", "Closed")},
)

PREVIOUS = Rollup(
    "PREV",
    numeric={
        "AMT_ANNUITY": _RANGE,
        "AMT_APPLICATION": _RANGE,
        "AMT_CREDIT": _RANGE,
        "APP_CREDIT_PERC": (*_RANGE, "var"),
        "AMT_DOWN_PAYMENT": _RANGE,
        "AMT_GOODS_PRICE": _RANGE,
        "HOUR_APPR_PROCESS_START": _RANGE,
        "RATE_DOWN_PAYMENT": _RANGE,
        "DAYS_DECISION": _RANGE,
        "CNT_PAYMENT": ("mean", "sum"),
    },
    shares=vocabulary.PREVIOUS,
    subsets={"APPROVED": ("NAME_CONTRACT_STATUS", "Approved"), "REFUSED": ("NAME_CONTRACT_STATUS", "Refused")},
)

POS_CASH = Rollup(
    "POS",
    numeric={"MONTHS_BALANCE": ("max", "mean", "size"), "SK_DPD": ("max", "mean"), "SK_DPD_DEF": ("max", "mean")},
    shares=vocabulary.POS_CASH,
    count="POS_COUNT",
    gather=False,
)

INSTALLMENTS = Rollup(
    "INSTAL",
    numeric={
        "NUM_INSTALMENT_VERSION": ("nunique",),
        "DPD": ("max", "mean", "sum"),
        "DBD": ("max", "mean", "sum"),
        "PAYMENT_PERC": ("max", "mean", "sum", "var"),
        "PAYMENT_DIFF": ("max", "mean", "sum", "var"),
        "AMT_INSTALMENT": ("max", "mean", "sum"),
        "AMT_PAYMENT": ("min", "max", "mean", "sum"),
        "DAYS_ENTRY_PAYMENT": ("max", "mean", "sum"),
    },
    count="INSTAL_COUNT",
    codes=("NUM_INSTALMENT_VERSION",),
)

CREDIT_CARD = Rollup(
    "CC",
    # the client id is aggregated like any number: an oddity the trained model expects
    numeric={name: ("min", "max", "mean", "sum", "var") for name in [KEY, *schema.CREDIT_CARD_NUMBERS]},
    shares=vocabulary.CREDIT_CARD,
    count="CC_COUNT",
)

#: Name of a further child table: the balances of credits, each with the client of its credit.
CLIENT_BALANCE = "bureau_balance_by_client"

FAMILIES = [BUREAU, PREVIOUS, POS_CASH, INSTALLMENTS, CREDIT_CARD]

# fixed values: previous-application dates that may hold the "no date" sentinel
PREVIOUS_DATES = ["DAYS_FIRST_DRAWING", "DAYS_FIRST_DUE", "DAYS_LAST_DUE_1ST_VERSION", "DAYS_LAST_DUE",
                  "DAYS_TERMINATION"]


def attach_balance(bureau: DataFrame, balance: DataFrame) -> DataFrame:
    """Left join of the balance roll-up onto its bureau credit.

    Credits without an id cannot match; the spread column keeps them from piling up in one task. On the
    other side it is always 0, written so that the optimizer keeps it as a join key, and grouped with the credit, so
    that the roll-up is not shuffled again for the join.

    Balances that carry the client of their credit are grouped and joined by client and credit: where both tables lie in
    equal buckets by client, nothing moves.
    """
    if KEY in balance.columns:
        return bureau.join(BALANCE.apply(balance, "SK_ID_BUREAU", along=[KEY]), ["SK_ID_BUREAU", KEY], "left")
    credit = F.col("SK_ID_BUREAU")
    per_credit = BALANCE.apply(balance.withColumn("_spread", F.pmod(credit, F.lit(1)).cast("long")), "SK_ID_BUREAU",
                               along=["_spread"])
    spread = F.when(credit.isNull(), F.xxhash64(*bureau.columns))
    return (bureau.withColumn("_spread", F.coalesce(spread, F.lit(0).cast("long")))
            .join(per_credit, ["SK_ID_BUREAU", "_spread"], "left").drop("_spread"))


def bureau_family(bureau: DataFrame, balance: DataFrame, buckets: int | None = None) -> DataFrame:
    return BUREAU.apply(attach_balance(bureau, balance), KEY, buckets)


def clean_previous(previous: DataFrame) -> DataFrame:
    dates = [c for c in PREVIOUS_DATES if c in previous.columns]
    return previous.withColumns({
        **{c: sentinel_to_null(F.col(c)) for c in dates},
        "APP_CREDIT_PERC": ratio_keep_inf(F.col("AMT_APPLICATION"), F.col("AMT_CREDIT")),
    })


def previous_family(previous: DataFrame, buckets: int | None = None) -> DataFrame:
    return PREVIOUS.apply(clean_previous(previous), KEY, buckets)


def pos_family(pos: DataFrame, buckets: int | None = None) -> DataFrame:
    return POS_CASH.apply(pos, KEY, buckets)


def payment_measures(installments: DataFrame, missing_as_zero: bool = False) -> DataFrame:
    """Paid share, shortfall, days past due and days before due.

    ``missing_as_zero`` counts an unknown payment date as neither late nor early.
    """
    late = F.col("DAYS_ENTRY_PAYMENT") - F.col("DAYS_INSTALMENT")
    early = F.col("DAYS_INSTALMENT") - F.col("DAYS_ENTRY_PAYMENT")
    past_due, before_due = not_below(late), not_below(early)
    if missing_as_zero:
        past_due, before_due = F.coalesce(past_due, F.lit(0)), F.coalesce(before_due, F.lit(0))
    return installments.withColumns({
        "PAYMENT_PERC": ratio_keep_inf(F.col("AMT_PAYMENT"), F.col("AMT_INSTALMENT")),
        "PAYMENT_DIFF": F.col("AMT_INSTALMENT") - F.col("AMT_PAYMENT"),
        "DPD": past_due,
        "DBD": before_due,
    })


def installments_family(installments: DataFrame, missing_as_zero: bool = False, buckets: int | None = None) -> DataFrame:
    return INSTALLMENTS.apply(payment_measures(installments, missing_as_zero), KEY, buckets)


def credit_card_family(cards: DataFrame, buckets: int | None = None) -> DataFrame:
    return CREDIT_CARD.apply(cards, KEY, buckets)


def all_families(tables: dict[str, DataFrame], buckets: int | None = None) -> list[DataFrame]:
    """The five families from the child tables, keyed by their file names; ``buckets`` as in ``Rollup.apply``.

    ``CLIENT_BALANCE``, if given, takes the place of the balances.
    """
    return [
        bureau_family(tables["bureau"], tables.get(CLIENT_BALANCE, tables["bureau_balance"]), buckets),
        previous_family(tables["previous_application"], buckets),
        pos_family(tables["POS_CASH_balance"], buckets),
        installments_family(tables["installments_payments"], buckets=buckets),
        credit_card_family(tables["credit_card_balance"], buckets),
    ]
