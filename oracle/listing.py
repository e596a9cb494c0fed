from oracle.tables import over

SHOWN = ("id, user_id, transaction_date, merchant_name, amount, transaction_type, category_id, "
         "account_id, notes")
led = over("ledger")


def _where(condition: str) -> str:
    return led(f"SELECT {SHOWN} FROM ledger WHERE {condition}")


_DUP = """
    count(*) OVER (PARTITION BY user_id, transaction_date, posted_date,
        coalesce(reference_number, ''), merchant_name, coalesce(merchant_city, ''),
        coalesce(merchant_state, ''), coalesce(merchant_country, ''),
        coalesce(mcc_description, ''), round(amount, 4), currency, transaction_type,
        coalesce(account_id, -999999999), coalesce(category_id, -999999999),
        coalesce(notes, ''), is_excluded) > 1"""


def _page(user: str, condition: str, order: str, limit: int, offset: int) -> str:
    return over("dirty", "categories", "accounts")(f"""
        SELECT t.id, t.user_id, t.transaction_date, t.merchant_name, t.amount,
               t.transaction_type, t.category_id, t.account_id, t.notes,
               c.name AS category_name, a.name AS account_name, exact_duplicate
        FROM (SELECT *, {_DUP} AS exact_duplicate FROM dirty) t
        LEFT JOIN categories c
          ON c.id = t.category_id AND c.user_id IS NOT DISTINCT FROM t.user_id
        LEFT JOIN accounts a
          ON a.id = t.account_id AND a.user_id IS NOT DISTINCT FROM t.user_id
        WHERE t.user_id {user} AND NOT is_excluded AND {condition}
        ORDER BY {order} LIMIT {limit} OFFSET {offset}""")


_SUMMARY = """
    SELECT user_id, e / 100.0 AS expense, i / 100.0 AS income, r / 100.0 AS refund,
           t / 100.0 AS transfer, (i - e + r) / 100.0 AS net,
           expense_count, income_count, refund_count, transfer_count
    FROM (SELECT user_id,
            coalesce(sum(CASE WHEN transaction_type = 'expense' THEN amount_cents END), 0) e,
            coalesce(sum(CASE WHEN transaction_type = 'income' THEN amount_cents END), 0) i,
            coalesce(sum(CASE WHEN transaction_type = 'refund' THEN amount_cents END), 0) r,
            coalesce(sum(CASE WHEN transaction_type = 'transfer' THEN amount_cents END), 0) t,
            count(*) FILTER (transaction_type = 'expense') AS expense_count,
            count(*) FILTER (transaction_type = 'income') AS income_count,
            count(*) FILTER (transaction_type = 'refund') AS refund_count,
            count(*) FILTER (transaction_type = 'transfer') AS transfer_count
          FROM ledger WHERE NOT is_excluded AND {condition} GROUP BY user_id)"""

_LARGE = """
    SELECT x.id, x.user_id, transaction_date, merchant_name, c.name AS category,
           amount_cents / 100.0 AS amount,
           ((2000 * amount_cents + month_cents) // (2 * month_cents)) / 10.0 AS pct_of_month,
           currency
    FROM (SELECT *, CAST(sum(amount_cents) OVER (
                 PARTITION BY user_id, date_trunc('month', transaction_date)) AS BIGINT)
                 AS month_cents
          FROM ledger WHERE transaction_type = 'expense' AND NOT is_excluded AND {scope}) x
    LEFT JOIN categories c
      ON c.id = x.category_id AND c.user_id IS NOT DISTINCT FROM x.user_id
    WHERE {passes} {tail}"""

SQL = {
    "l1_user_scope": _where("user_id = 'NATION_7'"),
    "l1_local_scope": _where("user_id IS NULL"),
    "l2_months_filter": _where("NOT is_excluded AND strftime(transaction_date, '%Y-%m') "
                               "IN ('1998-02', '1998-03', '2000-12')"),
    "l2_year_month_filter": _where("NOT is_excluded AND year(transaction_date) = 1999 "
                                   "AND month(transaction_date) = 2"),
    "l2_no_months": _where("FALSE"),
    "l3_date_range": _where("NOT is_excluded AND transaction_date "
                            "BETWEEN DATE '1998-11-01' AND DATE '1999-02-28'"),
    "l4_amount_range": _where("NOT is_excluded AND amount BETWEEN 100000 AND 150000.5"),
    "l5_search_text": _where(
        "NOT is_excluded AND (contains(lower(merchant_name), 'gear brand#1') "
        "OR contains(lower(notes), 'gear brand#1') "
        "OR contains(lower(merchant_city), 'gear brand#1') OR amount = 1 "
        "OR contains(format('{:.2f}', amount), '1'))"),
    "l5_search_number": _where(
        "NOT is_excluded AND (contains(lower(merchant_name), '$1,23') "
        "OR contains(lower(notes), '$1,23') OR contains(lower(merchant_city), '$1,23') "
        "OR contains(format('{:.2f}', amount), '$1,23') OR amount = 123 "
        "OR contains(format('{:.2f}', amount), '123'))"),
    "l6_equality_filters": _where("NOT is_excluded AND transaction_type = 'expense' "
                                  "AND category_id = 73"),
    "l7_list_by_date": _page("= 'NATION_3'", "TRUE", "t.transaction_date, t.id", 40, 40),
    "l7_list_by_amount": _page("= 'NATION_3'", "year(t.transaction_date) = 1999",
                               "t.amount DESC, t.transaction_date, t.id", 60, 0),
    "l7_list_by_category": _page("= 'NATION_9'", "TRUE",
                                 "c.name ASC NULLS FIRST, t.transaction_date, t.id", 80, 0),
    "l7_list_by_date_added": _page(
        "IS NULL", "(contains(lower(t.merchant_name), 'ring') OR contains(lower(t.notes), "
        "'ring') OR contains(lower(t.merchant_city), 'ring'))",
        "t.created_at DESC NULLS LAST, t.transaction_date, t.id", 25, 50),
    "l7_seek_by_date": _page("= 'NATION_3'", "TRUE", "t.transaction_date, t.id", 40, 40),
    "l7_seek_by_amount": _page("= 'NATION_3'", "year(t.transaction_date) = 1999",
                               "t.amount DESC, t.transaction_date, t.id", 60, 60),
    "l7_seek_by_category": _page("= 'NATION_9'", "TRUE",
                                 "c.name ASC NULLS FIRST, t.transaction_date, t.id", 80, 80),
    "l7_seek_by_date_added": _page(
        "IS NULL", "(contains(lower(t.merchant_name), 'ring') OR contains(lower(t.notes), "
        "'ring') OR contains(lower(t.merchant_city), 'ring'))",
        "t.created_at DESC NULLS LAST, t.transaction_date, t.id", 25, 25),
    "l7_list_total": over("dirty")(
        "SELECT count(*) AS total FROM dirty WHERE user_id = 'NATION_3' AND NOT is_excluded "
        "AND year(transaction_date) = 1999 AND amount >= 1000"),
    "d20_duplicate_only": _page("= 'NATION_4'", "exact_duplicate",
                                "t.merchant_name, t.transaction_date, t.id", 500, 0),
    "l8_enrich": over("ledger", "categories", "accounts")("""
        SELECT t.id, t.user_id, c.name AS category_name, a.name AS account_name FROM ledger t
        LEFT JOIN categories c
          ON c.id = t.category_id AND c.user_id IS NOT DISTINCT FROM t.user_id
        LEFT JOIN accounts a
          ON a.id = t.account_id AND a.user_id IS NOT DISTINCT FROM t.user_id"""),
    "l9_latest_month": over("ledger", "users")("""
        SELECT u.user_id, CAST(year(d) AS INTEGER) AS year, CAST(month(d) AS INTEGER) AS month
        FROM (SELECT u.user_id, coalesce(max(transaction_date), DATE '2001-08-01') AS d
              FROM users u LEFT JOIN ledger l
                ON u.user_id IS NOT DISTINCT FROM l.user_id AND NOT l.is_excluded
              GROUP BY u.user_id) u"""),
    "l10_summary": led(_SUMMARY.format(condition="TRUE")),
    "l10_summary_filtered": led(_SUMMARY.format(
        condition="transaction_date BETWEEN DATE '1997-01-01' AND DATE '1998-06-30' AND "
        "(contains(lower(merchant_name), 'hot') OR contains(lower(notes), 'hot') "
        "OR contains(lower(merchant_city), 'hot'))")),
    "l11_available_months": led("""
        SELECT user_id, strftime(transaction_date, '%Y-%m') AS ym,
               CAST(year(transaction_date) AS INTEGER) AS year,
               CAST(month(transaction_date) AS INTEGER) AS month, count(*) AS count
        FROM ledger WHERE NOT is_excluded GROUP BY ALL"""),
    "l12_large_expenses": over("ledger", "categories")(_LARGE.format(
        scope="transaction_date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'",
        passes="amount >= 450000 OR amount_cents / month_cents * 100.0 >= 25", tail="")),
    "l12_seek_page": over("ledger", "categories")(_LARGE.format(
        scope="TRUE", passes="amount_cents / month_cents * 100.0 >= 5",
        tail="ORDER BY transaction_date DESC, x.id LIMIT 30 OFFSET 30")),
    "l12_large_expense_page": over("ledger", "categories")(_LARGE.format(
        scope="user_id = 'NATION_6'", passes="amount_cents / month_cents * 100.0 >= 10",
        tail="ORDER BY transaction_date DESC, x.id LIMIT 10 OFFSET 10")),
    "l13_categories_by_name": over("categories")("SELECT * FROM categories"),
    "l13_accounts_by_name": over("accounts")(
        "SELECT id, user_id, name, institution FROM accounts"),
}
