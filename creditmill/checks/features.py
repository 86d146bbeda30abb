"""Roll-ups and families."""

from __future__ import annotations

from creditmill.checks import family_sql as FS
from creditmill.checks.registry import query
from creditmill.checks.roles import role
from creditmill.plans import families as P


@query("family_bureau", FS.bureau_sql(), P.BUREAU.output_columns())
def family_bureau(spark, sf):
    return P.bureau_family(role(spark, sf, "bureau"), role(spark, sf, "bureau_balance"))


@query("family_previous", FS.previous_sql(), P.PREVIOUS.output_columns())
def family_previous(spark, sf):
    return P.previous_family(role(spark, sf, "previous_application"))


@query("family_pos", FS.pos_sql(), P.POS_CASH.output_columns())
def family_pos(spark, sf):
    return P.pos_family(role(spark, sf, "POS_CASH_balance"))


@query("family_installments", FS.installments_sql(), P.INSTALLMENTS.output_columns())
def family_installments(spark, sf):
    return P.installments_family(role(spark, sf, "installments_payments"))


@query("family_credit_card", FS.card_sql(), P.CREDIT_CARD.output_columns())
def family_credit_card(spark, sf):
    return P.credit_card_family(role(spark, sf, "credit_card_balance"))
