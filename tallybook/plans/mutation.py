"""Registered batch-change queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallybook.operators import mutation as op
from tallybook.sources import derived

C, L = F.col, F.lit
ROW = ("id", "user_id", "transaction_date", "merchant_name", "amount", "amount_cents", "currency",
       "transaction_type", "category_id", "account_id", "notes")


def _ids(s, d):
    """Every ninth transaction; every 45th is listed under the wrong user."""
    return derived.ledger(s, d).filter(C("id") % 9 == 0).select(
        "id", F.when(C("id") % 45 == 0, L("NATION_2")).otherwise(C("user_id")).alias("user_id"))


def _patches(s, d):
    k = C("id")
    return derived.ledger(s, d).filter(k % 7 == 0).select(
        "id", "user_id", (C("category_id") + F.when(k % 5 == 0, 10).otherwise(0))
        .alias("category_id"), (k % 2 == 0).alias("set_category_id"),
        C("account_id"), L(False).alias("set_account_id"),
        L(None).cast("string").alias("notes"), (k % 3 == 0).alias("set_notes"),
        (C("amount_cents") + 100).alias("amount_cents"), (k % 4 == 1).alias("set_amount_cents"))


def _accepted(s, d, part):
    return op.accept_patches(_patches(s, d), derived.categories(s, d),
                             derived.accounts(s, d))[part]


def _settings(s, d):
    return derived.users(s, d).select("user_id", L("CAD").alias("default_currency"))


def _currency_changes(s, d):
    number = F.length("user_id")
    return derived.users(s, d).select("user_id", F.when(C("user_id").isNull(), " eur ")
                                      .when(number == 8, "usd").when(C("user_id") == "NATION_11",
                                                                    "12A").otherwise("cad")
                                      .alias("currency"))


def _gone(s, d):
    return derived.categories(s, d).filter(C("id") % 10 == 1).select("user_id", "id")


def _removed(s, d, part):
    return op.remove_categories(derived.ledger(s, d), derived.budget_rules(s, d),
                                derived.hidden_keys(s, d), _gone(s, d))[part]


def _category_changes(s, d):
    """A new category per account name, and an edit of every category."""
    creates = derived.accounts(s, d).select(
        C("id").alias("change_id"), "user_id", L(None).cast("long").alias("id"),
        F.when(C("id") % 50 == 0, L(" Large ")).otherwise(F.concat(L("Shop "), "institution",
                                                                   (C("id") % 400).cast("string")))
        .alias("name"), L("#000000").alias("color"),
        F.when(C("id") % 20 == 1, L("Gear, odd")).otherwise(
            F.concat(L("k"), C("id").cast("string"))).alias("keywords"))
    edits = derived.categories(s, d).select(
        (-C("id")).alias("change_id"), "user_id", "id",
        F.when(C("id") % 4 == 0, F.concat("name", L(" 2"))).alias("name"),
        L(None).cast("string").alias("color"),
        F.when(C("id") % 3 == 0, F.concat_ws(",", "keywords", L("red"), L("fresh")))
        .alias("keywords"))
    return creates.unionByName(edits)


def _upserted(s, d, part):
    return op.upsert_categories(derived.categories(s, d), _category_changes(s, d))[part]


def _foreign(s, d, key, owners):
    return op.ownership_violations(derived.ledger(s, d), owners(s, d), key).select(
        "id", "user_id", key)


QUERIES = {
    "m1_bulk_delete": lambda s, d: op.bulk_delete(
        derived.ledger(s, d), _ids(s, d)).select(*ROW),
    "m1_deleted_count": lambda s, d: op.owned_ids(derived.ledger(s, d), _ids(s, d)),
    "m2_bulk_update": lambda s, d: op.bulk_update(
        derived.ledger(s, d), _ids(s, d).withColumns({
            "category_id": F.when(C("id") % 2 == 0, C("id") * 0 + 1),
            "transaction_type": F.when(C("id") % 5 != 0, L("transfer"))})).select(*ROW),
    "m3_patched_ledger": lambda s, d: op.apply_patches(
        derived.ledger(s, d), _accepted(s, d, 0)).select(*ROW),
    "m3_rejected_patches": lambda s, d: _accepted(s, d, 1),
    "m4_rewritten_ledger": lambda s, d: op.rewrite_currency(
        derived.ledger(s, d), _settings(s, d), _currency_changes(s, d)).select(
        "id", "user_id", "currency"),
    "m4_rewritten_rules": lambda s, d: op.rewrite_currency(
        derived.recurring_rules(s, d), _settings(s, d), _currency_changes(s, d)).select(
        "id", "user_id", "currency"),
    "m5_uncategorised_ledger": lambda s, d: _removed(s, d, 0).select(*ROW),
    "m5_left_budget_rules": lambda s, d: _removed(s, d, 1),
    "m5_left_hidden_keys": lambda s, d: _removed(s, d, 2),
    "m6_clear_users": lambda s, d: op.clear_users(
        derived.ledger(s, d), derived.users(s, d).filter(
            C("user_id").isNull() | C("user_id").endswith("3"))).select(*ROW),
    "m7_upserted_categories": lambda s, d: _upserted(s, d, 0),
    "m7_category_conflicts": lambda s, d: _upserted(s, d, 1),
    "v1_foreign_categories": lambda s, d: _foreign(s, d, "category_id", derived.categories),
    "v1_foreign_accounts": lambda s, d: _foreign(s, d, "account_id", derived.accounts),
}
