"""Registered ledger queries: predicates, listing, summary, large expenses."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tallybook.operators import listing as op
from tallybook.sources import derived

AS_OF = date(2001, 8, 1)
_SHOWN = ("id", "user_id", "transaction_date", "merchant_name", "amount", "transaction_type",
          "category_id", "account_id", "notes")
_LISTED = (*_SHOWN, "category_name", "account_name", "exact_duplicate")


def _filtered(**filters):
    return lambda s, d: op.filter_ledger(derived.ledger(s, d), **filters).select(*_SHOWN)


def _page(**arguments):
    def run(s, d):
        return op.list_transactions(
            derived.dirty_ledger(s, d), derived.categories(s, d), derived.accounts(s, d),
            **arguments).select(*_LISTED)
    return run


def _next_page(**arguments):
    """The second page, found from the last row of the first one."""
    def run(s, d):
        books = (derived.dirty_ledger(s, d), derived.categories(s, d), derived.accounts(s, d))
        order = {k: arguments[k] for k in ("sort_by", "sort_dir") if k in arguments}
        last = op.last_of_page(op.list_transactions(*books, **arguments), **order)
        if last is None:
            return op.list_transactions(*books, page=2, **arguments).select(*_LISTED)
        return op.list_transactions(*books, after=last, **arguments).select(*_LISTED)
    return run


def _next_large(s, d):
    books, names = derived.ledger(s, d), derived.categories(s, d)
    first = op.large_expenses(books, names, min_pct=5.0, page=1, page_size=30)
    last = first.orderBy("transaction_date", F.desc("id")).first()
    after = (last["transaction_date"], last["id"]) if last else None
    return op.large_expenses(books, names, min_pct=5.0, after=after, page=1, page_size=30)


QUERIES = {
    "l1_user_scope": _filtered(user="NATION_7", include_excluded=True),
    "l1_local_scope": _filtered(user=None, include_excluded=True),
    "l2_months_filter": _filtered(months="1998-02,1998-03, bad,2000-12"),
    "l2_year_month_filter": _filtered(year=1999, month=2),
    "l2_no_months": _filtered(months="__none__"),
    "l3_date_range": _filtered(date_from="1998-11", date_to="1999-02", months="2000-01"),
    "l4_amount_range": _filtered(min_amount=100000.0, max_amount=150000.5),
    "l5_search_text": _filtered(search=" GEAR brand#1 "),
    "l5_search_number": _filtered(search="$1,23"),
    "l6_equality_filters": _filtered(transaction_type="expense", category_id=73),
    "l7_list_by_date": _page(user="NATION_3", page=2, page_size=40),
    "l7_list_by_amount": _page(user="NATION_3", sort_by="amount", sort_dir="desc",
                               page_size=60, year=1999),
    "l7_list_by_category": _page(user="NATION_9", sort_by="category", page=1, page_size=80),
    "l7_list_by_date_added": _page(user=None, sort_by="date_added", sort_dir="desc", page=3,
                                   page_size=25, search="ring"),
    "l7_seek_by_date": _next_page(user="NATION_3", page_size=40),
    "l7_seek_by_amount": _next_page(user="NATION_3", sort_by="amount", sort_dir="desc",
                                    page_size=60, year=1999),
    "l7_seek_by_category": _next_page(user="NATION_9", sort_by="category", page_size=80),
    "l7_seek_by_date_added": _next_page(user=None, sort_by="date_added", sort_dir="desc",
                                        page_size=25, search="ring"),
    "l7_list_total": lambda s, d: op.count_transactions(
        derived.dirty_ledger(s, d), user="NATION_3", year=1999, min_amount=1000.0),
    "d20_duplicate_only": _page(user="NATION_4", duplicate_only=True, date_from="1999-01",
                                sort_by="merchant", page_size=500),
    "l8_enrich": lambda s, d: op.enrich(
        derived.ledger(s, d), derived.categories(s, d), derived.accounts(s, d)).select(
        "id", "user_id", "category_name", "account_name"),
    "l9_latest_month": lambda s, d: op.latest_month(
        derived.ledger(s, d), derived.users(s, d), AS_OF),
    "l10_summary": lambda s, d: op.summary(op.filter_ledger(derived.ledger(s, d))),
    "l10_summary_filtered": lambda s, d: op.summary(op.filter_ledger(
        derived.ledger(s, d), date_from="1997-01", date_to="1998-06", search="hot")),
    "l11_available_months": lambda s, d: op.available_months(derived.ledger(s, d)),
    "l12_large_expenses": lambda s, d: op.large_expenses(
        derived.ledger(s, d), derived.categories(s, d), date_from="1996-01", date_to="2000-12",
        min_amount=450000.0, min_pct=25.0),
    "l12_large_expense_page": lambda s, d: op.large_expenses(
        derived.ledger(s, d), derived.categories(s, d), user="NATION_6", min_pct=10.0, page=2,
        page_size=10),
    "l12_seek_page": _next_large,
    "l13_categories_by_name": lambda s, d: op.ordered_by_name(derived.categories(s, d)),
    "l13_accounts_by_name": lambda s, d: op.ordered_by_name(
        derived.accounts(s, d).select("id", "user_id", "name", F.col("institution"))),
}
