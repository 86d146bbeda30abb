"""SQL for the families, written the long way: dummies, filtered subsets and left joins."""

from __future__ import annotations

from creditmill.checks.roles import role_sql
from creditmill.contract.schema import KEY

_MISSING = "__missing__"


def _q(name: str) -> str:
    return '"' + name + '"'


def number_sql(stat: str, column: str) -> str:
    c = _q(column)
    d = f"CAST({c} AS DOUBLE)"
    # the checking engine refuses the variance of infinite values
    infinite = f"count(*) FILTER (WHERE isinf({d}))"
    finite = f"CASE WHEN isinf({d}) THEN NULL ELSE {d} END"
    return {
        "min": f"CAST(min({c}) AS DOUBLE)",
        "max": f"CAST(max({c}) AS DOUBLE)",
        "mean": f"avg({d})",
        "sum": f"coalesce(sum({d}), 0)",
        "var": f"CASE WHEN {infinite} > 0 THEN NULL ELSE var_samp({finite}) END",
        "size": "CAST(count(*) AS DOUBLE)",
        "nunique": f"CAST(count(DISTINCT {c}) AS DOUBLE)",
    }[stat]


def share_sql(column: str, value: str | None) -> str:
    test = f"{_q(column)} IS NULL" if value is None else f"{_q(column)} IS NOT DISTINCT FROM '{value}'"
    return f"avg(CASE WHEN {test} THEN 1.0 ELSE 0.0 END)"


def family_sql(family, source: str, key: str = KEY) -> str:
    """Roll-up of the subquery ``source`` per ``key``, subsets joined back from filtered selects."""
    def numbers(spec, prefix):
        return [f'{number_sql(s, c)} AS {_q(f"{prefix}_{c}_{s.upper()}" if prefix else f"{c}_{s.upper()}")}'
                for c, stats in spec.items() for s in stats]

    head = f"{family.prefix}_" if family.prefix else ""
    main = numbers(family.numeric, family.prefix)
    for column, values in family.shares.items():
        main += [f'{share_sql(column, v)} AS {_q(f"{head}{column}_{v}_MEAN")}' for v in values]
        main.append(f'{share_sql(column, None)} AS {_q(f"{head}{column}_nan_MEAN")}')
    main += numbers(family.carried, family.prefix)
    if family.count:
        main.append(f"CAST(count(*) AS DOUBLE) AS {_q(family.count)}")
    selects = [f"SELECT {key}, {', '.join(main)} FROM src WHERE {key} IS NOT NULL GROUP BY {key}"]
    for prefix, (column, value) in family.subsets.items():
        selects.append(f"SELECT {key}, {', '.join(numbers(family.numeric, prefix))} FROM src "
                       f"WHERE {key} IS NOT NULL AND {_q(column)} = '{value}' GROUP BY {key}")
    joined = "(" + selects[0] + ") f0"
    for i, sub in enumerate(selects[1:], 1):
        joined += f" LEFT JOIN ({sub}) f{i} USING ({key})"
    return f"SELECT * FROM (WITH src AS MATERIALIZED ({source}) SELECT * FROM {joined})"


def bureau_sql() -> str:
    from creditmill.plans.families import BALANCE, BUREAU

    balance = family_sql(BALANCE, role_sql("bureau_balance"), "SK_ID_BUREAU")
    return family_sql(BUREAU, f"SELECT * FROM ({role_sql('bureau')}) LEFT JOIN ({balance}) USING (SK_ID_BUREAU)")


def previous_sql() -> str:
    from creditmill.plans.families import PREVIOUS, PREVIOUS_DATES

    dates = ", ".join(f"nullif({c}, 365243) AS {c}" for c in PREVIOUS_DATES)
    perc = ("CASE WHEN AMT_CREDIT = 0 AND AMT_APPLICATION > 0 THEN CAST('inf' AS DOUBLE) "
            "WHEN AMT_CREDIT = 0 THEN NULL ELSE AMT_APPLICATION / AMT_CREDIT END")
    return family_sql(PREVIOUS, f"SELECT * REPLACE ({dates}), {perc} AS APP_CREDIT_PERC "
                                f"FROM ({role_sql('previous_application')})")


def pos_sql() -> str:
    from creditmill.plans.families import POS_CASH

    return family_sql(POS_CASH, role_sql("POS_CASH_balance"))


def payment_sql() -> str:
    return ("SELECT *, CASE WHEN AMT_INSTALMENT = 0 AND AMT_PAYMENT > 0 THEN CAST('inf' AS DOUBLE) "
            "WHEN AMT_INSTALMENT = 0 THEN NULL ELSE AMT_PAYMENT / AMT_INSTALMENT END AS PAYMENT_PERC, "
            "AMT_INSTALMENT - AMT_PAYMENT AS PAYMENT_DIFF, "
            "CASE WHEN DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT < 0 THEN 0 "
            "ELSE DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT END AS DPD, "
            "CASE WHEN DAYS_INSTALMENT - DAYS_ENTRY_PAYMENT < 0 THEN 0 "
            "ELSE DAYS_INSTALMENT - DAYS_ENTRY_PAYMENT END AS DBD "
            f"FROM ({role_sql('installments_payments')})")


def installments_sql() -> str:
    from creditmill.plans.families import INSTALLMENTS

    return family_sql(INSTALLMENTS, payment_sql())


def card_sql() -> str:
    from creditmill.plans.families import CREDIT_CARD

    return family_sql(CREDIT_CARD, role_sql("credit_card_balance"))


def store_sql() -> str:
    """Full outer chain of the five families."""
    parts = [bureau_sql(), previous_sql(), pos_sql(), installments_sql(), card_sql()]
    joined = f"({parts[0]}) s0"
    for i, part in enumerate(parts[1:], 1):
        joined += f" FULL JOIN ({part}) s{i} USING ({KEY})"
    return f"SELECT * FROM {joined}"
