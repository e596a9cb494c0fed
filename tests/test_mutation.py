from __future__ import annotations

from tallybook.operators import listing, mutation, recurring
from tests.helpers import accounts, categories, day, ledger, rules


def test_repeated_changes_keep_the_ledger_rows(spark):
    books = ledger(spark, {}, {})
    changes = spark.createDataFrame(
        [(None, 1, 5, None), (None, 1, 7, "refund"), (None, 1, 5, None)],
        "user_id string, id long, category_id long, transaction_type string")
    got = mutation.bulk_update(books, changes).orderBy("id").collect()
    assert [(r["id"], r["category_id"]) for r in got] == [(1, 7), (2, None)]
    settings = spark.createDataFrame([(None, "CAD")], "user_id string, default_currency string")
    codes = spark.createDataFrame([(None, "eur"), (None, "usd")], "user_id string, currency string")
    out = mutation.rewrite_currency(books, settings, codes).collect()
    assert [r["currency"] for r in out] == ["USD", "USD"]


def test_second_edit_of_a_category_is_a_conflict(spark):
    held = categories(spark, dict(id=3, name="food"))
    changes = spark.createDataFrame(
        [(0, None, 3, "meals", None, None), (1, None, 3, "snacks", None, None)],
        "change_id long, user_id string, id long, name string, color string, keywords string")
    rows, conflicts = mutation.upsert_categories(held, changes)
    assert [(r["id"], r["name"]) for r in rows.collect()] == [(3, "meals")]
    assert [tuple(r) for r in conflicts.collect()] == [(1, "id", "3")]


def test_rule_edit_clears_a_field_and_counts_once(spark):
    rule = rules(spark, dict(start_date=day("2020-01-01"), notes="old", category_id=4))
    rows = ledger(spark, dict(transaction_date=day("2020-01-01"), recurring_rule_id=1,
                              notes="old", category_id=4))
    one = (1, None, day("2020-01-01"), "monthly", day("2020-01-20"), None, True, None, False,
           False, False)
    changes = spark.createDataFrame(
        [one, one], "id long, user_id string, start_date date, frequency string, end_date date, "
        "notes string, set_notes boolean, category_id long, set_category_id boolean, "
        "remove_overlap boolean, backfill_missing boolean")
    books, kept = recurring.apply_update(rule, changes, rows, day("2020-03-01"))
    assert [(r["notes"], r["category_id"]) for r in books.collect()] == [(None, 4)]
    assert [(r["notes"], r["category_id"]) for r in kept.collect()] == [(None, 4)]


def test_pages_and_wildcards(spark):
    books = ledger(spark, *[dict(merchant_name=f"Shop {i}") for i in range(30)])
    page = listing.list_transactions(books, categories(spark), accounts(spark), user=None,
                                     page_size=20_000)
    assert page.count() == 30
    assert listing.filter_ledger(books, search="shop%7", wildcards=True).count() == 3
    assert listing.filter_ledger(books, search="shop%7").count() == 0


def test_a_backslash_is_searched_as_itself(spark):
    books = ledger(spark, dict(merchant_name=r"Co\op 100%"), dict(merchant_name="Coop 1000"))
    for search in (r"o\o", r"co\op _00", "\\"):
        found = listing.filter_ledger(books, search=search, wildcards=True).collect()
        assert [r["id"] for r in found] == [1], search
