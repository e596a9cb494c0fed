from oracle.tables import define, over

define("limits", "SELECT user_id, category_id, limit_cents FROM budget_rules WHERE NOT is_total",
       "budget_rules")
define("averages", """
    SELECT x.user_id, x.category_id, coalesce('cat:' || x.category_id, 'uncategorized')
             AS category_key,
           coalesce(c.name, CASE WHEN spent THEN 'Uncategorized' ELSE 'Unknown' END)
             AS category_name,
           c.color AS category_color,
           CAST(floor((2 * t6 + 6) / 12) AS BIGINT) / 100.0 AS avg_6m,
           CAST(floor((2 * t3 + 3) / 6) AS BIGINT) / 100.0 AS avg_3m, t1 / 100.0 AS avg_1m,
           limit_cents / 100.0 AS limit_amount
    FROM (SELECT user_id, category_id, max(spent) AS spent, sum(t6) AS t6, sum(t3) AS t3,
                 sum(t1) AS t1, max(limit_cents) AS limit_cents
          FROM (SELECT user_id, category_id, TRUE AS spent, amount_cents AS t6,
                       CASE WHEN transaction_date >= DATE '2001-05-01' THEN amount_cents ELSE 0
                       END AS t3,
                       CASE WHEN transaction_date >= DATE '2001-07-01' THEN amount_cents ELSE 0
                       END AS t1, CAST(NULL AS BIGINT) AS limit_cents
                FROM ledger WHERE transaction_type = 'expense'
                  AND transaction_date >= DATE '2001-02-01'
                UNION ALL
                SELECT user_id, category_id, FALSE, 0, 0, 0, limit_cents FROM limits)
          GROUP BY user_id, category_id) x
    LEFT JOIN categories c
      ON c.id = x.category_id AND c.user_id IS NOT DISTINCT FROM x.user_id""", "ledger", "categories", "limits")
define("months9", """
    SELECT CAST(DATE '2000-11-01' + i * INTERVAL 1 MONTH AS DATE) AS m FROM range(0, 9) AS r(i)
""")
define("spend", """
    SELECT user_id, CAST(date_trunc('month', transaction_date) AS DATE) AS m, category_id,
           CAST(sum(amount_cents) AS BIGINT) AS cents
    FROM ledger WHERE transaction_type = 'expense' GROUP BY ALL""", "ledger")
define("items", """
    SELECT l.user_id, strftime(months9.m, '%Y-%m') AS ym, l.category_id,
           coalesce(c.name, 'Unknown') AS category_name, c.color AS category_color,
           limit_cents / 100.0 AS budget, coalesce(cents, 0) / 100.0 AS spent,
           coalesce(cents, 0) > limit_cents AS over
    FROM limits l CROSS JOIN months9
    LEFT JOIN spend s ON s.user_id IS NOT DISTINCT FROM l.user_id AND s.m = months9.m
      AND s.category_id IS NOT DISTINCT FROM l.category_id
    LEFT JOIN categories c ON c.id = l.category_id
      AND c.user_id IS NOT DISTINCT FROM l.user_id""",
       "limits", "months9", "spend", "categories")
define("month_totals", """
    SELECT u.user_id, strftime(months9.m, '%Y-%m') AS ym, strftime(months9.m, '%b %Y') AS label,
           max(t.limit_cents) / 100.0 AS total_budget,
           coalesce(sum(cents), 0) / 100.0 AS total_spent,
           coalesce(sum(CASE WHEN l.limit_cents IS NULL THEN cents END), 0) / 100.0
             AS others_spent
    FROM users u CROSS JOIN months9
    LEFT JOIN spend s ON s.user_id IS NOT DISTINCT FROM u.user_id AND s.m = months9.m
    LEFT JOIN limits l ON l.user_id IS NOT DISTINCT FROM s.user_id
      AND l.category_id = s.category_id
    LEFT JOIN budget_rules t ON t.is_total AND t.user_id IS NOT DISTINCT FROM u.user_id
    GROUP BY u.user_id, months9.m""", "users", "months9", "spend", "limits", "budget_rules")
define("parts", """
    SELECT category_id AS id, user_id, category_id, CAST(sum(amount_cents) AS BIGINT)
             AS limit_cents, FALSE AS is_total
    FROM ledger WHERE transaction_type = 'expense' AND transaction_date >= DATE '1999-01-01'
      AND category_id IS NOT NULL GROUP BY user_id, category_id""", "ledger")
define("proposed", """
    SELECT * FROM parts UNION ALL
    SELECT -min(id), user_id, NULL,
           CAST(sum(limit_cents) - CASE WHEN min(id) % 20 > 10 THEN 1 ELSE 0 END AS BIGINT), TRUE
    FROM parts GROUP BY user_id""", "parts")
define("violations", """
    SELECT user_id, CAST(max(CASE WHEN is_total THEN limit_cents END) AS BIGINT) AS total_cents,
           CAST(sum(CASE WHEN is_total THEN 0 ELSE limit_cents END) AS BIGINT) AS sum_cents
    FROM proposed GROUP BY user_id
    HAVING max(CASE WHEN is_total THEN limit_cents END)
           < sum(CASE WHEN is_total THEN 0 ELSE limit_cents END)""", "proposed")
define("accepted", """
    SELECT * FROM proposed p WHERE NOT EXISTS (
        SELECT 1 FROM violations v WHERE v.user_id IS NOT DISTINCT FROM p.user_id)""",
       "proposed", "violations")

SQL = {
    "b1_budget_key": over("ledger")("""
        SELECT id, coalesce('cat:' || category_id, 'uncategorized') AS category_key, category_id
        FROM ledger"""),
    "b2_read_rules": over("budget_rules", "hidden")("""
        SELECT r.user_id, max(CASE WHEN is_total THEN limit_cents END) AS total_cents,
               count(*) FILTER (NOT is_total) AS rule_count,
               CAST(sum(CASE WHEN is_total THEN 0 ELSE limit_cents END) AS BIGINT) AS rule_cents,
               (SELECT string_agg(category_key, ',' ORDER BY category_key) FROM hidden h
                WHERE h.user_id IS NOT DISTINCT FROM r.user_id) AS hidden_keys
        FROM budget_rules r GROUP BY r.user_id"""),
    "b3_replaced_rules": over("budget_rules", "accepted")("""
        SELECT * FROM accepted UNION ALL
        SELECT * FROM budget_rules b WHERE NOT EXISTS (
            SELECT 1 FROM accepted a WHERE a.user_id IS NOT DISTINCT FROM b.user_id)"""),
    "b3_replaced_hidden": over("hidden", "accepted")("""
        SELECT user_id, category_key,
               TRY_CAST(regexp_extract(category_key, '^cat:(.*)$', 1) AS BIGINT) AS category_id
        FROM hidden h WHERE NOT EXISTS (
            SELECT 1 FROM accepted a WHERE a.user_id IS NOT DISTINCT FROM h.user_id
              AND 'cat:' || a.category_id = h.category_key)"""),
    "b3_violations": over("violations")("SELECT * FROM violations"),
    "b4_trailing_averages": over("averages")("SELECT * FROM averages"),
    "b5_month_spine": over("months9", "ledger")("""
        SELECT strftime(m, '%Y-%m') AS ym, strftime(m, '%b %Y') AS label,
               coalesce(sum(amount_cents), 0) / 100.0 AS spent
        FROM months9 LEFT JOIN ledger ON date_trunc('month', transaction_date) = m
          AND transaction_type = 'expense' GROUP BY m"""),
    "b6_budget_vs_actual": over("items")("SELECT * FROM items"),
    "b7_monthly_totals": over("month_totals")("SELECT * FROM month_totals"),
    "b8_visible_rows": over("averages", "hidden")("""
        SELECT * FROM averages a WHERE (avg_6m > 0 OR limit_amount IS NOT NULL)
          AND NOT EXISTS (SELECT 1 FROM hidden h WHERE h.category_key = a.category_key
                          AND h.user_id IS NOT DISTINCT FROM a.user_id)"""),
    "b9_unallocated": over("budget_rules")("""
        SELECT user_id, left_over / 100.0 AS unallocated, left_over >= 0 AS is_valid
        FROM (SELECT user_id, sum(CASE WHEN is_total THEN limit_cents ELSE -limit_cents END)
                     AS left_over FROM budget_rules GROUP BY user_id)"""),
    "b10_progress": over("items")("""
        SELECT user_id, ym, category_id, category_name, budget, spent,
               CASE WHEN budget > 0 THEN least(spent / budget * 100.0, 100.0) ELSE 0.0 END AS pct,
               budget > 0 AND spent > budget AS over
        FROM items"""),
    "b11_over_budget_months": over("month_totals")(
        "SELECT user_id, ym, total_spent > total_budget AS over_budget FROM month_totals"),
    "b12_addable_categories": over("averages", "categories", "hidden")("""
        SELECT user_id, category_key, name, color, avg_6m FROM (
            SELECT c.user_id, 'cat:' || c.id AS category_key, c.name, c.color,
                   coalesce(a.avg_6m, 0) AS avg_6m, a.limit_amount
            FROM categories c LEFT JOIN averages a ON a.category_key = 'cat:' || c.id
              AND a.user_id IS NOT DISTINCT FROM c.user_id
            UNION ALL
            SELECT user_id, category_key, category_name, coalesce(category_color, ''), avg_6m,
                   limit_amount
            FROM averages WHERE category_id IS NULL) x
        WHERE NOT ((avg_6m > 0 OR limit_amount IS NOT NULL) AND NOT EXISTS (
            SELECT 1 FROM hidden h WHERE h.category_key = x.category_key
              AND h.user_id IS NOT DISTINCT FROM x.user_id))"""),
}
