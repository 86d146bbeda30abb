"""The ordered feature contract, derived from the schema, the vocabularies and the roll-up specs."""

from __future__ import annotations

import re

from creditmill.contract import schema, vocabulary

# --- fixed values ---------------------------------------------------------------------------
RATIOS: dict[str, tuple[str, str]] = {
    "DAYS_EMPLOYED_PERC": ("DAYS_EMPLOYED", "DAYS_BIRTH"),
    "INCOME_CREDIT_PERC": ("AMT_INCOME_TOTAL", "AMT_CREDIT"),
    "INCOME_PER_PERSON": ("AMT_INCOME_TOTAL", "CNT_FAM_MEMBERS"),
    "ANNUITY_INCOME_PERC": ("AMT_ANNUITY", "AMT_INCOME_TOTAL"),
    "PAYMENT_RATE": ("AMT_ANNUITY", "AMT_CREDIT"),
}
COUNT_NAME = r"_COUNT$|_COUNT_|COUNT_$|^COUNT_"


def application_features() -> list[str]:
    """Plain columns in schema order, then the dummies; the key and the label are not features."""
    plain = [f.name for f in schema.APPLICATION.fields
             if f.name not in (schema.KEY, schema.LABEL) and f.name not in vocabulary.APPLICATION]
    dummies = [f"{column}_{value}" for column, values in vocabulary.APPLICATION.items() for value in values]
    return plain + dummies


def store_features() -> list[str]:
    from creditmill.plans.families import FAMILIES

    return [name for family in FAMILIES for name in family.output_columns()]


def feature_names() -> list[str]:
    return application_features() + list(RATIOS) + store_features()


def no_history_template(store_columns: list[str] | None = None) -> dict[str, float | None]:
    """Values for a client without history: 0 for counts, missing for everything else."""
    columns = store_features() if store_columns is None else store_columns
    return {name: 0.0 if re.search(COUNT_NAME, name) else None for name in columns}


def outside_contract(columns: list[str], contract: list[str] | None = None) -> list[str]:
    """Store columns the contract does not know."""
    known = set(feature_names() if contract is None else contract)
    return [name for name in columns if name not in known]
