"""Registered dashboard and category statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallybook.functions.money import from_cents
from tallybook.operators import dashboard as op
from tallybook.operators import duplicates as dup
from tallybook.sources import derived

C = F.col
MONTHS = "1999-03,1998-12,bad,1998-11"


def _pie(s, d, kind="expense", months=None):
    return op.category_pie(derived.ledger(s, d), derived.categories(s, d), kind, months)


def _priced(slices):
    return slices.withColumn("amount", from_cents(C("amount_cents"))).drop("amount_cents")


def _ranked(s, d):
    return op.with_palette(_pie(s, d))


def _with_linked(s, d):
    return derived.ledger(s, d).unionByName(derived.linked_rows(s, d))


QUERIES = {
    "a1_category_pie": lambda s, d: _priced(op.with_palette(_pie(s, d))),
    "a1_income_pie_of_months": lambda s, d: _priced(_pie(s, d, "income", MONTHS)),
    "a2_palette_fallback": lambda s, d: _ranked(s, d).select(
        "user_id", "category", "color", "rank"),
    "a3_totals_and_net": lambda s, d: op.pie_totals(_pie(s, d), _pie(s, d, "income")),
    "a4_monthly_bars": lambda s, d: op.monthly_bars(
        derived.ledger(s, d), derived.users(s, d)).drop("position"),
    "a4_bars_of_months": lambda s, d: op.monthly_bars(
        derived.ledger(s, d), derived.users(s, d), "2001-08,1994-12,1999-01"),
    "a5_small_slices": lambda s, d: _priced(op.bucket_small(_ranked(s, d), 0.16)),
    "a6_slice_percentage": lambda s, d: op.with_share(_ranked(s, d)).select(
        "user_id", "category", "pct"),
    "a7_category_stats": lambda s, d: op.category_stats(
        derived.categories(s, d), derived.ledger(s, d)),
    "a8_rule_transaction_count": lambda s, d: op.rule_counts(
        derived.recurring_rules(s, d), _with_linked(s, d)),
    "d17_duplicate_groups": lambda s, d: dup.duplicate_groups(derived.dirty_ledger(s, d)),
    "d17_duplicate_group_ids": lambda s, d: dup.duplicate_groups(
        derived.dirty_ledger(s, d), with_ids=True),
    "d18_duplicate_report": lambda s, d: dup.duplicate_report(derived.dirty_ledger(s, d)),
    "d19_prune_duplicates": lambda s, d: dup.prune_duplicates(
        derived.dirty_ledger(s, d)).drop("created_at"),
    "d20_exact_duplicate_flag": lambda s, d: dup.flag_duplicates(
        derived.dirty_ledger(s, d)).select("id", "user_id", "exact_duplicate"),
}
