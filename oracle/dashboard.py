from oracle.tables import define, over

define("slices", """
    SELECT t.user_id, coalesce(c.name, 'Uncategorized') AS category, c.color, transaction_type,
           CAST(sum(amount_cents) AS BIGINT) AS cents
    FROM ledger t LEFT JOIN categories c
      ON c.id = t.category_id AND c.user_id IS NOT DISTINCT FROM t.user_id
    WHERE NOT is_excluded GROUP BY ALL""", "ledger", "categories")
define("ranked", """
    SELECT user_id, category, cents, rank,
           coalesce(color, ['#6366f1', '#f59e0b', '#10b981', '#ef4444', '#3b82f6', '#8b5cf6',
               '#ec4899', '#14b8a6', '#f97316', '#84cc16', '#06b6d4', '#a855f7', '#e11d48',
               '#0ea5e9', '#22c55e'][(rank - 1) % 15 + 1]) AS color
    FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY cents DESC, category)
                 AS INTEGER) AS rank
          FROM slices WHERE transaction_type = 'expense')""", "slices")
ranked = over("ranked")
dirty = over("dirty")
_KEY = """user_id, transaction_date, posted_date, coalesce(reference_number, ''), merchant_name,
    coalesce(merchant_city, ''), coalesce(merchant_state, ''), coalesce(merchant_country, ''),
    coalesce(mcc_description, ''), round(amount, 4), currency, transaction_type,
    coalesce(account_id, -999999999), coalesce(category_id, -999999999), coalesce(notes, ''),
    is_excluded"""
_COUNTED = f"""(SELECT *, count(*) OVER w AS n, min(id) OVER w AS keep_id FROM dirty
    WINDOW w AS (PARTITION BY {_KEY}))"""

SQL = {
    "a1_category_pie": ranked(
        "SELECT user_id, category, color, rank, cents / 100.0 AS amount FROM ranked"),
    "a1_income_pie_of_months": over("ledger", "categories")("""
        SELECT t.user_id, coalesce(c.name, 'Uncategorized') AS category, c.color,
               sum(amount_cents) / 100.0 AS amount
        FROM ledger t LEFT JOIN categories c
          ON c.id = t.category_id AND c.user_id IS NOT DISTINCT FROM t.user_id
        WHERE NOT is_excluded AND transaction_type = 'income'
          AND strftime(transaction_date, '%Y-%m') IN ('1999-03', '1998-12', '1998-11')
        GROUP BY t.user_id, c.name, c.color"""),
    "a2_palette_fallback": ranked("SELECT user_id, category, color, rank FROM ranked"),
    "a3_totals_and_net": over("slices")("""
        SELECT user_id, e / 100.0 AS total_expenses, i / 100.0 AS total_income,
               (i - e) / 100.0 AS net
        FROM (SELECT user_id, coalesce(sum(cents) FILTER (transaction_type = 'expense'), 0) AS e,
                     coalesce(sum(cents) FILTER (transaction_type = 'income'), 0) AS i
              FROM slices WHERE transaction_type IN ('expense', 'income') GROUP BY user_id)"""),
    "a4_monthly_bars": over("ledger")("""
        SELECT user_id, CAST(year(m) AS INTEGER) AS year, CAST(month(m) AS INTEGER) AS month,
               strftime(m, '%b %Y') AS label, e / 100.0 AS expenses, i / 100.0 AS income
        FROM (SELECT user_id, date_trunc('month', transaction_date) AS m,
                coalesce(sum(amount_cents) FILTER (transaction_type = 'expense'), 0) AS e,
                coalesce(sum(amount_cents) FILTER (transaction_type = 'income'), 0) AS i
              FROM ledger WHERE NOT is_excluded GROUP BY ALL)"""),
    "a4_bars_of_months": over("ledger", "users")("""
        SELECT u.user_id, w.position, CAST(year(w.m) AS INTEGER) AS year,
               CAST(month(w.m) AS INTEGER) AS month, strftime(w.m, '%b %Y') AS label,
               coalesce(sum(amount_cents) FILTER (transaction_type = 'expense'), 0) / 100.0
                 AS expenses,
               coalesce(sum(amount_cents) FILTER (transaction_type = 'income'), 0) / 100.0
                 AS income
        FROM users u CROSS JOIN (VALUES (0, DATE '2001-08-01'), (1, DATE '1994-12-01'),
                                        (2, DATE '1999-01-01')) AS w(position, m)
        LEFT JOIN ledger l ON l.user_id IS NOT DISTINCT FROM u.user_id AND NOT l.is_excluded
          AND date_trunc('month', l.transaction_date) = w.m
        GROUP BY ALL"""),
    "a5_small_slices": ranked("""
        SELECT user_id, category, color, cents / 100.0 AS amount
        FROM (SELECT *, sum(cents) OVER (PARTITION BY user_id) AS total FROM ranked)
        WHERE cents / total >= 0.16
        UNION ALL
        SELECT user_id, 'other (' || string_agg(category, ', ' ORDER BY rank) || ')', '#64748b',
               sum(cents) / 100.0
        FROM (SELECT *, sum(cents) OVER (PARTITION BY user_id) AS total FROM ranked)
        WHERE cents / total < 0.16 GROUP BY user_id"""),
    "a6_slice_percentage": ranked("""
        SELECT user_id, category, ((2000 * cents + total) // (2 * total)) / 10.0 AS pct
        FROM (SELECT *, CAST(sum(cents) OVER (PARTITION BY user_id) AS BIGINT) AS total
              FROM ranked)"""),
    "a7_category_stats": over("ledger", "categories")("""
        SELECT c.id, c.user_id, c.name, c.color, coalesce(c.keywords, '') AS keywords,
               count(l.id) AS tx_count, coalesce(sum(l.amount_cents), 0) / 100.0 AS total
        FROM categories c LEFT JOIN ledger l
          ON l.category_id = c.id AND l.user_id IS NOT DISTINCT FROM c.user_id
        GROUP BY ALL"""),
    "a8_rule_transaction_count": over("rules", "linked")("""
        SELECT r.id, r.user_id, count(l.id) AS transaction_count
        FROM rules r LEFT JOIN linked l
          ON l.recurring_rule_id = r.id AND l.user_id IS NOT DISTINCT FROM r.user_id
        GROUP BY ALL"""),
    "d17_duplicate_groups": dirty(f"""
        SELECT * EXCLUDE (id, n, created_at), n AS row_count FROM {_COUNTED}
        WHERE n > 1 AND id = keep_id"""),
    "d17_duplicate_group_ids": dirty(f"""
        SELECT user_id, keep_id, n AS row_count, id AS transaction_id FROM {_COUNTED}
        WHERE n > 1"""),
    "d18_duplicate_report": dirty(f"""
        SELECT user_id, count(DISTINCT keep_id) AS total_groups,
               count(*) - count(DISTINCT keep_id) AS total_extra_rows
        FROM {_COUNTED} WHERE n > 1 GROUP BY user_id"""),
    "d19_prune_duplicates": dirty(f"""
        SELECT * EXCLUDE (n, keep_id, created_at) FROM {_COUNTED} WHERE id = keep_id"""),
    "d20_exact_duplicate_flag": dirty(f"""
        SELECT id, user_id, n > 1 AS exact_duplicate FROM {_COUNTED}"""),
}
