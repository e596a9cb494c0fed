"""Filtering, paging and summarising the ledger."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions.dates import (
    month_floor, month_ranges, month_text, parse_month, parse_months, shift_month,
)
from tallybook.functions.joins import null_safe_join, scoped
from tallybook.functions.money import any_of, cents_text, from_cents, tenths_of_percent
from tallybook.operators.duplicates import DUPLICATE_KEY, with_duplicate_key

C, L = F.col, F.lit

ALL_USERS = object()  # keep every tenant; user_id stays a grouping key
NO_MONTHS = "__none__"


def in_months(months: str | None = None, year: int | None = None,
              month: int | None = None) -> Column | None:
    """Month predicate as merged date ranges; None when nothing restricts the date."""
    day = C("transaction_date")
    if months:
        if months == NO_MONTHS:
            return L(False)
        wanted = parse_months(months)
        if not wanted:
            return None
        return any_of([(day >= L(a)) & (day < L(b)) for a, b in month_ranges(wanted)])
    conditions = []
    if year:
        conditions.append((day >= L(date(year, 1, 1))) & (day < L(date(year + 1, 1, 1))))
    if month:
        conditions.append(F.month(day) == month)
    return conditions[0] & conditions[-1] if conditions else None


def in_date_range(date_from: str | None, date_to: str | None) -> Column | None:
    """Inclusive YYYY-MM bounds; an unreadable bound is ignored."""
    first, last = parse_month(date_from), parse_month(date_to)
    day = C("transaction_date")
    bounds = []
    if first:
        bounds.append(day >= L(first))
    if last:
        bounds.append(day < L(shift_month(last, 1)))
    return bounds[0] & bounds[-1] if bounds else None


def matches_search(search: str | None, wildcards: bool = False) -> Column | None:
    """Text or amount search; `wildcards` keeps % and _ of the text live, a backslash is itself."""
    text = (search or "").strip()
    if not text:
        return None
    amount_text = cents_text(C("amount_cents"))

    def has(column: Column, needle: str) -> Column:
        pattern = needle.replace("\\", "\\\\")
        found = (column.ilike(f"%{pattern}%") if wildcards
                 else F.contains(F.lower(column), L(needle.lower())))
        return F.coalesce(found, L(False))

    clauses = [has(C(c), text) for c in ("merchant_name", "notes", "merchant_city")]
    clauses.append(has(amount_text, text))
    number = re.sub(r"[^0-9.\-]", "", text.replace(",", ""))
    try:
        value = float(number)
    except ValueError:
        return any_of(clauses)
    clauses.append(C("amount") == L(value))
    if number != text:
        clauses.append(has(amount_text, number))
    return any_of(clauses)


def filter_ledger(ledger: DataFrame, *, user: object = ALL_USERS, months: str | None = None,
                  year: int | None = None, month: int | None = None,
                  date_from: str | None = None, date_to: str | None = None,
                  transaction_type: str | None = None, category_id: int | None = None,
                  account_id: int | None = None, search: str | None = None,
                  min_amount: float | None = None, max_amount: float | None = None,
                  include_excluded: bool = False, ignore_dates: bool = False,
                  wildcards: bool = False) -> DataFrame:
    """Rows that pass every filter given; a date range wins over months.

    With `wildcards` % and _ of the search text stand for any text and any character.
    """
    conditions: list[Column | None] = []
    if not include_excluded:
        conditions.append(~C("is_excluded"))
    if not ignore_dates:
        conditions.append(in_date_range(date_from, date_to) if date_from or date_to
                          else in_months(months, year, month))
    if transaction_type:
        conditions.append(C("transaction_type") == transaction_type)
    if category_id:
        conditions.append(C("category_id") == category_id)
    if account_id:
        conditions.append(C("account_id") == account_id)
    if min_amount is not None:
        conditions.append(C("amount") >= min_amount)
    if max_amount is not None:
        conditions.append(C("amount") <= max_amount)
    conditions.append(matches_search(search, wildcards))
    rows = ledger if user is ALL_USERS else scoped(ledger, user)
    for condition in conditions:
        if condition is not None:
            rows = rows.filter(condition)
    return rows


def enrich(rows: DataFrame, categories: DataFrame, accounts: DataFrame) -> DataFrame:
    """Add category_name and account_name of records the same user owns."""
    named = categories.select("user_id", C("id").alias("category_id"),
                              C("name").alias("category_name"))
    held = accounts.select("user_id", C("id").alias("account_id"),
                           C("name").alias("account_name"))
    with_category = null_safe_left(rows, named, "category_id")
    return null_safe_left(with_category, held, "account_id")


def null_safe_left(rows: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """Left join on (user, key): user null-safe, a null key never matches."""
    renamed = lookup.select(*[
        C(c).alias(f"_right_{c}") if c in ("user_id", key) else C(c) for c in lookup.columns])
    condition = (C("user_id").eqNullSafe(C("_right_user_id")) & (C(key) == C(f"_right_{key}")))
    return rows.join(renamed, condition, "left").drop("_right_user_id", f"_right_{key}")


_SORT_COLUMNS = {
    "date": "transaction_date", "date_added": "created_at", "merchant": "merchant_name",
    "amount": "amount", "type": "transaction_type", "category": "category_name",
}


def _sort_keys(sort_by: str, sort_dir: str) -> list[tuple[str, bool]]:
    """(column, ascending) of a listing's order; ties end in the id."""
    column = _SORT_COLUMNS.get(sort_by, "transaction_date")
    dates = [] if column == "transaction_date" else [("transaction_date", True)]
    return [(column, sort_dir == "asc"), *dates, ("id", True)]


def _ordered(keys: list[tuple[str, bool]]) -> list[Column]:
    """Nulls first ascending, last descending."""
    return [C(c).asc_nulls_first() if up else C(c).desc_nulls_last() for c, up in keys]


def after_row(keys: list[tuple[str, bool]], values: tuple) -> Column:
    """True for the rows that follow the row with these key values in the order of the keys.

    The first key alone also bounds the rows, as a plain comparison that a scan can use.
    """
    if len(keys) != len(values):
        raise ValueError(f"{len(keys)} values expected, one for each sort key")

    def beyond(column: str, up: bool, value: object) -> Column:
        if value is None:
            return C(column).isNotNull() if up else L(False)
        return C(column) > L(value) if up else C(column).isNull() | (C(column) < L(value))

    (column, up), value = keys[0], values[0]
    if value is None:
        bound = L(True) if up else C(column).isNull()
    else:
        bound = C(column) >= L(value) if up else C(column).isNull() | (C(column) <= L(value))
    follows, equal = [], L(True)
    for (name, rising), held in zip(keys, values):
        follows.append(equal & beyond(name, rising, held))
        equal = equal & C(name).eqNullSafe(L(held))
    return bound & F.coalesce(any_of(follows), L(False))


def last_of_page(page: DataFrame, sort_by: str = "date", sort_dir: str = "asc") -> tuple | None:
    """The sort values of a page's last row, where the next page starts; None for no rows."""
    keys = _sort_keys(sort_by, sort_dir)
    last = page.orderBy(*_ordered([(c, not up) for c, up in keys])).select(
        *[c for c, _ in keys]).first()
    return tuple(last) if last else None


def list_transactions(ledger: DataFrame, categories: DataFrame, accounts: DataFrame, *,
                      user: str | None, sort_by: str = "date", sort_dir: str = "asc",
                      page: int = 1, page_size: int = 50, duplicate_only: bool = False,
                      after: tuple | None = None, **filters) -> DataFrame:
    """One page of a tenant's ledger with names and the exact-duplicate flag.

    `after` (from `last_of_page`) gives the page behind a known row instead of a page number: the
    rows before it are filtered out, so a page far into the listing costs what the first one does.

    Sorting and limiting run first (a top-k over narrow rows); names and the flag are looked up
    for the page alone, of any size: how the page's keys meet the ledger is left to their measured
    size.
    """
    if page_size < 1 or page < 1:
        raise ValueError("page and page_size must be positive")
    if after is not None and page != 1:
        raise ValueError("a page is given by its number or by the row before it")
    own = scoped(ledger, user)
    rows = filter_ledger(own, ignore_dates=duplicate_only, **filters)
    if duplicate_only:
        rows = duplicates_within(rows, own)
    column = _SORT_COLUMNS.get(sort_by, "transaction_date")
    if column == "category_name":
        names = categories.select("user_id", C("id").alias("category_id"),
                                  C("name").alias("category_name"))
        rows = null_safe_left(rows, names, "category_id")
    keys = _sort_keys(sort_by, sort_dir)
    if after is not None:
        rows = rows.filter(after_row(keys, after))
    listed = rows.orderBy(*_ordered(keys)).offset((page - 1) * page_size).limit(page_size)
    return enrich(flag_page(listed.drop("category_name"), own), categories, accounts)


def duplicates_within(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rows whose duplicate key occurs more than once in the ledger."""
    repeated = (with_duplicate_key(ledger).groupBy("user_id", DUPLICATE_KEY)
                .agg(F.count(L(1)).alias("n")).filter(C("n") > 1))
    return null_safe_join(with_duplicate_key(rows), repeated.drop("n"),
                          ["user_id", DUPLICATE_KEY], "left_semi").drop(DUPLICATE_KEY)


def flag_page(listed: DataFrame, ledger: DataFrame) -> DataFrame:
    """exact_duplicate of the listed rows: only their keys are counted in the ledger."""
    keyed = with_duplicate_key(listed)
    keys = keyed.select("user_id", DUPLICATE_KEY).distinct()
    counts = (null_safe_join(
        with_duplicate_key(ledger).select("user_id", DUPLICATE_KEY), keys,
        ["user_id", DUPLICATE_KEY], "left_semi")
        .groupBy("user_id", DUPLICATE_KEY).agg(F.count(L(1)).alias("n")))
    return (null_safe_join(keyed, counts, ["user_id", DUPLICATE_KEY])
            .withColumn("exact_duplicate", F.coalesce(C("n") > 1, L(False)))
            .drop("n", DUPLICATE_KEY))


def count_transactions(ledger: DataFrame, *, user: str | None, duplicate_only: bool = False,
                       **filters) -> DataFrame:
    """Total of the listing, whatever the page."""
    own = scoped(ledger, user)
    rows = filter_ledger(own, ignore_dates=duplicate_only, **filters)
    if duplicate_only:
        rows = duplicates_within(rows, own)
    return rows.agg(F.count(L(1)).alias("total"))


def latest_month(ledger: DataFrame, users: DataFrame, as_of: date) -> DataFrame:
    """Year and month of each user's newest counted transaction, else of `as_of`."""
    newest = (ledger.filter(~C("is_excluded")).groupBy("user_id")
              .agg(F.max("transaction_date").alias("newest")))
    day = F.coalesce(C("newest"), L(as_of))
    return null_safe_join(users.select("user_id"), newest, ["user_id"]).select(
        "user_id", F.year(day).alias("year"), F.month(day).alias("month"))


def available_months(ledger: DataFrame) -> DataFrame:
    """Months with counted transactions, newest first."""
    day = month_floor(C("transaction_date"))
    return (ledger.filter(~C("is_excluded")).groupBy("user_id", day.alias("first_day"))
            .agg(F.count(L(1)).alias("count"))
            .select("user_id", month_text(C("first_day")).alias("ym"),
                    F.year("first_day").alias("year"), F.month("first_day").alias("month"),
                    "count")
            .orderBy(C("user_id").asc_nulls_first(), C("ym").desc()))


def summary(rows: DataFrame) -> DataFrame:
    """Totals and counts of the four types per user; net is income - expense + refund."""
    kinds = ("expense", "income", "refund", "transfer")
    sums = [F.coalesce(F.sum(F.when(C("transaction_type") == k, C("amount_cents"))), L(0))
            .alias(f"{k}_cents") for k in kinds]
    counts = [F.count_if(C("transaction_type") == k).alias(f"{k}_count") for k in kinds]
    net = C("income_cents") - C("expense_cents") + C("refund_cents")
    return rows.groupBy("user_id").agg(*sums, *counts).select(
        "user_id", *[from_cents(C(f"{k}_cents")).alias(k) for k in kinds],
        from_cents(net).alias("net"), *[f"{k}_count" for k in kinds])


def large_expenses(ledger: DataFrame, categories: DataFrame, *, user: object = ALL_USERS,
                   date_from: str | None = None, date_to: str | None = None,
                   min_amount: float | None = None, min_pct: float | None = None,
                   page: int | None = None, page_size: int = 10,
                   after: tuple | None = None) -> DataFrame:
    """Expenses above an amount, or above a share of their own month; newest first.

    Month totals are aggregated map-side and joined back, so a user with a third of all rows
    costs no single-task window. page=None returns every match; `after` (date, id) gives the page
    behind that row.
    """
    if after is not None and page not in (None, 1):
        raise ValueError("a page is given by its number or by the row before it")
    keys = [("transaction_date", False), ("id", True)]
    rows = filter_ledger(ledger, user=user, date_from=date_from, date_to=date_to,
                         transaction_type="expense")
    rows = rows.withColumn("first_day", month_floor(C("transaction_date")))
    totals = rows.groupBy("user_id", "first_day").agg(
        F.sum("amount_cents").alias("month_cents"))
    rows = null_safe_join(rows, totals, ["user_id", "first_day"])
    pct = F.coalesce(C("amount_cents") / F.nullif(C("month_cents"), L(0)) * L(100.0), L(0.0))
    passes = [L(False)]
    if min_amount is not None:
        passes.append(C("amount") >= min_amount)
    if min_pct is not None:
        passes.append(pct >= min_pct)
    matched = rows.filter(any_of(passes)).select(
        "id", "user_id", "transaction_date", "merchant_name", "amount_cents", "month_cents",
        "currency", "category_id")
    if after is not None:
        matched = matched.filter(after_row(keys, after))
        page = 1
    if page is not None:
        matched = matched.orderBy(*_ordered(keys)).offset((page - 1) * page_size).limit(page_size)
    names = categories.select("user_id", C("id").alias("category_id"),
                              C("name").alias("category"))
    return null_safe_left(matched, names, "category_id").select(
        "id", "user_id", "transaction_date", "merchant_name", "category",
        from_cents(C("amount_cents")).alias("amount"),
        tenths_of_percent(C("amount_cents"), C("month_cents")).alias("pct_of_month"), "currency")


def ordered_by_name(owned: DataFrame) -> DataFrame:
    """Categories or accounts in name order per user."""
    return owned.orderBy(C("user_id").asc_nulls_first(), "name", "id")
