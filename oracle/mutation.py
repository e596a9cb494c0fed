import oracle.ingest  # noqa: F401  (defines kw)
from oracle.tables import define, over

ROW = ("id, user_id, transaction_date, merchant_name, amount, amount_cents, currency, "
       "transaction_type, category_id, account_id, notes")
led = over("ledger")
define("ids", """
    SELECT id, CASE WHEN id % 45 = 0 THEN 'NATION_2' ELSE user_id END AS user_id
    FROM ledger WHERE id % 9 = 0""", "ledger")
_IN_IDS = "EXISTS (SELECT 1 FROM ids i WHERE i.id = l.id AND i.user_id IS NOT DISTINCT FROM l.user_id)"
define("patches", """
    SELECT id, user_id, category_id + CASE WHEN id % 5 = 0 THEN 10 ELSE 0 END AS category_id,
           account_id, amount_cents + 100 AS amount_cents
    FROM ledger WHERE id % 7 = 0""", "ledger")
define("rejected", """
    SELECT user_id, id, 'category_id' AS field FROM patches p
    WHERE category_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM categories c
        WHERE c.id = p.category_id AND c.user_id IS NOT DISTINCT FROM p.user_id)
    UNION ALL
    SELECT user_id, id, 'account_id' FROM patches p
    WHERE account_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM accounts a
        WHERE a.id = p.account_id AND a.user_id IS NOT DISTINCT FROM p.user_id)""",
       "patches", "categories", "accounts")
_CURRENCY = """CASE WHEN user_id IS NULL THEN 'EUR' WHEN length(user_id) = 8 THEN 'USD'
    ELSE currency END"""
define("category_changes", """
    SELECT id AS change_id, user_id, CAST(NULL AS BIGINT) AS id,
           CASE WHEN id % 50 = 0 THEN 'large' ELSE lower('Shop ' || institution || (id % 400)) END
             AS name,
           '#000000' AS color,
           CASE WHEN id % 20 = 1 THEN 'gear, odd' ELSE 'k' || id END AS keywords
    FROM accounts
    UNION ALL
    SELECT -id, user_id, id, CASE WHEN id % 4 = 0 THEN name || ' 2' END, NULL,
           CASE WHEN id % 3 = 0 THEN CASE name WHEN 'economy' THEN 'red, widget, fresh'
                  WHEN 'large' THEN 'hot, gear, red, fresh'
                  WHEN 'medium' THEN 'gear, cold bolt, red, fresh'
                  WHEN 'promo' THEN 'blue bolt, ring, red, fresh'
                  WHEN 'small' THEN 'old rod, new, hot, red, fresh'
                  ELSE 'e transfer, red, fresh' END END
    FROM categories""", "accounts", "categories")
define("category_conflicts", """
    SELECT DISTINCT x.change_id, 'name' AS kind, x.name AS detail
    FROM category_changes x JOIN categories c ON c.name = x.name
      AND c.user_id IS NOT DISTINCT FROM x.user_id AND (x.id IS NULL OR x.id <> c.id)
    UNION
    SELECT change_id, 'name', name FROM (
        SELECT *, min(change_id) OVER (PARTITION BY user_id, name) AS first
        FROM category_changes WHERE name IS NOT NULL) WHERE change_id <> first
    UNION
    SELECT x.change_id, 'keyword', w.word
    FROM (SELECT *, unnest(string_split(keywords, ', ')) AS word FROM category_changes) w
    JOIN category_changes x ON x.change_id = w.change_id
    JOIN kw ON kw.keyword = w.word AND kw.user_id IS NOT DISTINCT FROM x.user_id
      AND (x.id IS NULL OR x.id <> kw.category_id)
    WHERE NOT EXISTS (SELECT 1 FROM kw own WHERE own.category_id = x.id AND own.keyword = w.word)
""", "category_changes", "categories", "kw")

SQL = {
    "m1_bulk_delete": over("ids")(f"SELECT {ROW} FROM ledger l WHERE NOT {_IN_IDS}"),
    "m1_deleted_count": over("ids")(
        f"SELECT user_id, count(*) AS affected FROM ledger l WHERE {_IN_IDS} GROUP BY user_id"),
    "m2_bulk_update": over("ids")(f"""
        SELECT {ROW} FROM (SELECT l.* REPLACE (
            CASE WHEN {_IN_IDS} AND id % 2 = 0 THEN 1 ELSE category_id END AS category_id,
            CASE WHEN {_IN_IDS} AND id % 5 <> 0 THEN 'transfer' ELSE transaction_type END
              AS transaction_type) FROM ledger l)"""),
    "m3_patched_ledger": over("ledger", "patches", "rejected")(f"""
        SELECT {ROW} FROM (SELECT l.* REPLACE (
            CASE WHEN p.id IS NOT NULL AND l.id % 2 = 0 THEN p.category_id ELSE l.category_id END
              AS category_id,
            CASE WHEN p.id IS NOT NULL AND l.id % 3 = 0 THEN NULL ELSE notes END AS notes,
            CASE WHEN p.id IS NOT NULL AND l.id % 4 = 1 THEN p.amount_cents
                 ELSE l.amount_cents END AS amount_cents,
            CASE WHEN p.id IS NOT NULL AND l.id % 4 = 1 THEN p.amount_cents / 100.0
                 ELSE l.amount END AS amount)
          FROM ledger l LEFT JOIN (SELECT * FROM patches
                                   WHERE id NOT IN (SELECT id FROM rejected)) p
            ON p.id = l.id)"""),
    "m3_rejected_patches": over("rejected")("SELECT * FROM rejected"),
    "m4_rewritten_ledger": led(f"SELECT id, user_id, {_CURRENCY} AS currency FROM ledger"),
    "m4_rewritten_rules": over("rules")(
        f"SELECT id, user_id, {_CURRENCY} AS currency FROM rules"),
    "m5_uncategorised_ledger": over("ledger", "categories")(f"""
        SELECT {ROW} FROM (SELECT l.* REPLACE (CASE WHEN NOT EXISTS (
            SELECT 1 FROM categories c WHERE c.id % 10 = 1 AND c.id = l.category_id
              AND c.user_id IS NOT DISTINCT FROM l.user_id) THEN category_id END AS category_id)
          FROM ledger l)"""),
    "m5_left_budget_rules": over("budget_rules", "categories")("""
        SELECT * FROM budget_rules b WHERE NOT EXISTS (SELECT 1 FROM categories c
            WHERE c.id % 10 = 1 AND c.id = b.category_id
              AND c.user_id IS NOT DISTINCT FROM b.user_id)"""),
    "m5_left_hidden_keys": over("hidden", "categories")("""
        SELECT * FROM hidden h WHERE NOT EXISTS (SELECT 1 FROM categories c
            WHERE c.id % 10 = 1 AND 'cat:' || c.id = h.category_key
              AND c.user_id IS NOT DISTINCT FROM h.user_id)"""),
    "m6_clear_users": led(f"SELECT {ROW} FROM ledger WHERE user_id NOT LIKE '%3'"),
    "m7_upserted_categories": over("categories", "category_changes", "category_conflicts")("""
        SELECT c.id, c.user_id, coalesce(x.name, c.name) AS name, c.color,
               coalesce(x.keywords, c.keywords) AS keywords
        FROM categories c LEFT JOIN (SELECT * FROM category_changes WHERE change_id NOT IN
            (SELECT change_id FROM category_conflicts)) x ON x.id = c.id
        UNION ALL
        SELECT (SELECT max(id) + 1 FROM categories) + change_id, user_id, name, color, keywords
        FROM category_changes WHERE id IS NULL AND change_id NOT IN
            (SELECT change_id FROM category_conflicts)"""),
    "m7_category_conflicts": over("category_conflicts")("SELECT * FROM category_conflicts"),
    "v1_foreign_categories": over("ledger", "categories")("""
        SELECT id, user_id, category_id FROM ledger l WHERE category_id IS NOT NULL
          AND NOT EXISTS (SELECT 1 FROM categories c WHERE c.id = l.category_id
                          AND c.user_id IS NOT DISTINCT FROM l.user_id)"""),
    "v1_foreign_accounts": over("ledger", "accounts")("""
        SELECT id, user_id, account_id FROM ledger l WHERE account_id IS NOT NULL
          AND NOT EXISTS (SELECT 1 FROM accounts a WHERE a.id = l.account_id
                          AND a.user_id IS NOT DISTINCT FROM l.user_id)"""),
}
