"""Registered budget queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tallybook.functions.money import from_cents
from tallybook.operators import budget as op
from tallybook.sources import derived

C = F.col
AS_OF = date(2001, 8, 1)
FIRST, LAST = date(2000, 11, 1), date(2001, 7, 1)


def _averages(s, d):
    return op.trailing_averages(derived.ledger(s, d), derived.categories(s, d),
                                derived.budget_rules(s, d), AS_OF)


def _items(s, d):
    return op.budget_vs_actual(derived.ledger(s, d), derived.categories(s, d),
                               derived.budget_rules(s, d), FIRST, LAST)


def _totals(s, d):
    return op.monthly_totals(derived.ledger(s, d), derived.budget_rules(s, d),
                             derived.users(s, d), FIRST, LAST)


def _spending(s, d):
    return derived.ledger(s, d).select(
        "id", op.budget_key(C("category_id")).alias("category_key")).withColumn(
        "category_id", op.category_of_key(C("category_key")))


def _proposed(s, d):
    """Every user doubles the limit of what they spent most on since 1999; half drop the total."""
    spent = (derived.ledger(s, d)
             .filter((C("transaction_type") == "expense")
                     & (C("transaction_date") >= F.lit(date(1999, 1, 1)))
                     & C("category_id").isNotNull())
             .groupBy("user_id", "category_id").agg(F.sum("amount_cents").alias("limit_cents")))
    parts = spent.select(C("category_id").alias("id"), "user_id", "category_id",
                         "limit_cents", F.lit(False).alias("is_total"))
    totals = (parts.groupBy("user_id")
              .agg(F.sum("limit_cents").alias("cents"), F.min("id").alias("low"))
              .select((-C("low")).alias("id"), "user_id",
                      F.lit(None).cast("long").alias("category_id"),
                      (C("cents") - F.when(C("low") % 20 > 10, 1).otherwise(0))
                      .alias("limit_cents"),
                      F.lit(True).alias("is_total")))
    return parts.unionByName(totals)


def _replaced(s, d, part):
    out = op.replace_rules(derived.budget_rules(s, d), derived.hidden_keys(s, d),
                           _proposed(s, d), derived.hidden_keys(s, d))
    return out[part]


QUERIES = {
    "b1_budget_key": _spending,
    "b2_read_rules": lambda s, d: op.read_rules(
        derived.budget_rules(s, d), derived.hidden_keys(s, d)),
    "b3_replaced_rules": lambda s, d: _replaced(s, d, 0),
    "b3_replaced_hidden": lambda s, d: _replaced(s, d, 1),
    "b3_violations": lambda s, d: _replaced(s, d, 2),
    "b4_trailing_averages": _averages,
    "b5_month_spine": lambda s, d: _month_spine_of_ledger(s, d),
    "b6_budget_vs_actual": _items,
    "b7_monthly_totals": _totals,
    "b8_visible_rows": lambda s, d: op.visible_rows(_averages(s, d), derived.hidden_keys(s, d)),
    "b9_unallocated": lambda s, d: op.unallocated(derived.budget_rules(s, d)),
    "b10_progress": lambda s, d: op.progress(_items(s, d)),
    "b11_over_budget_months": lambda s, d: op.over_months(_totals(s, d)).select(
        "user_id", "ym", "over_budget"),
    "b12_addable_categories": lambda s, d: op.addable_categories(
        _averages(s, d), derived.categories(s, d), derived.hidden_keys(s, d)),
}


def _month_spine_of_ledger(s, d):
    """Spend of every month of the spine, over all users."""
    spine = op.month_spine(s, FIRST, LAST)
    spend = (derived.ledger(s, d).filter(C("transaction_type") == "expense")
             .groupBy(F.date_format("transaction_date", "yyyy-MM").alias("ym"))
             .agg(F.sum("amount_cents").alias("cents")))
    return spine.join(spend, "ym", "left").select(
        "ym", "label", from_cents(F.coalesce("cents", F.lit(0))).alias("spent"))
