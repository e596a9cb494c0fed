"""Registered recurring-rule queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tallybook.operators import recurring as op
from tallybook.sources import derived

C = F.col
AS_OF = date(2001, 8, 1)
ROW = ("user_id", "transaction_date", "merchant_name", "amount", "transaction_type",
       "category_id", "account_id", "notes", "recurring_rule_id")


def _rules(s, d):
    return derived.recurring_rules(s, d)


def _ledger(s, d):
    return derived.ledger(s, d).unionByName(derived.linked_rows(s, d))


def _applied(s, d):
    return op.apply_update(_rules(s, d), derived.rule_changes(s, d), _ledger(s, d), AS_OF)


def _preview(s, d):
    return op.preview_update(_rules(s, d), derived.rule_changes(s, d), _ledger(s, d), AS_OF)


def _cuts(s, d):
    return _rules(s, d).filter(C("id") % 4 == 0).select(
        "id", "user_id", F.date_add("start_date", (C("id") % 120 - 20).cast("int"))
        .alias("from_date"))


def _gone(s, d):
    return _rules(s, d).filter(C("id") % 7 == 3).select("id", "user_id")


QUERIES = {
    "r1_schedule_dates": lambda s, d: op.expand_schedule(_rules(s, d), AS_OF).select(
        "id", "user_id", "step", "due_date"),
    "r2_horizon": lambda s, d: op.horizon(_rules(s, d), AS_OF),
    "r3_due_dates": lambda s, d: op.due_dates(_rules(s, d), AS_OF).select(
        "id", "user_id", "due_date"),
    "r4_new_rows": lambda s, d: op.process_due(_rules(s, d), _ledger(s, d), AS_OF)[0].select(*ROW),
    "r4_moved_rules": lambda s, d: op.process_due(
        _rules(s, d), _ledger(s, d), AS_OF)[1].select("id", "user_id", "last_created_date"),
    "r4_counts": lambda s, d: op.process_due(_rules(s, d), _ledger(s, d), AS_OF)[2],
    "r5_preview_update": _preview,
    "r5_preview_rows": lambda s, d: op.preview_rows(
        _rules(s, d), derived.rule_changes(s, d), _ledger(s, d), AS_OF),
    "r6_updated_ledger": lambda s, d: _applied(s, d)[0].select(*ROW),
    "r6_updated_rules": lambda s, d: _applied(s, d)[1],
    "r7_cut_ledger": lambda s, d: op.cut_rules(
        _ledger(s, d), _rules(s, d), _cuts(s, d))[0].select("id", *ROW),
    "r7_cut_rules": lambda s, d: op.cut_rules(_ledger(s, d), _rules(s, d), _cuts(s, d))[1],
    "r8_dropped_ledger": lambda s, d: op.drop_rules(
        _ledger(s, d), _rules(s, d), _gone(s, d))[0].select("id", *ROW),
    "r8_dropped_rules": lambda s, d: op.drop_rules(
        _ledger(s, d), _rules(s, d), _gone(s, d))[1],
    "r9_needs_confirmation": lambda s, d: op.needs_confirmation(
        _preview(s, d), derived.rule_changes(s, d)),
    "r10_invalid_windows": lambda s, d: op.invalid_windows(_rules(s, d).withColumn(
        "end_date", F.date_sub("end_date", (C("id") % 450).cast("int")))),
}
