from oracle.tables import define, over

# a schedule as text: anchored steps from the start, never step by step
_SCHEDULE = """
    SELECT r.*, step, due_date FROM (
        SELECT r.*, CAST(t.step AS INTEGER) AS step,
               CAST(CASE frequency
                 WHEN 'monthly' THEN start_date + t.step * INTERVAL 1 MONTH
                 WHEN 'yearly' THEN start_date + t.step * INTERVAL 12 MONTH
                 WHEN 'weekly' THEN start_date + t.step * INTERVAL 7 DAY
                 ELSE start_date + t.step * INTERVAL 14 DAY END AS DATE) AS due_date
        FROM {source} r, range(0, 200) AS t(step)) r
    WHERE due_date <= least(DATE '2001-08-01', coalesce(end_date, DATE '2001-08-01'))"""

define("schedule", _SCHEDULE.format(source="rules"), "rules")
define("due", """SELECT * FROM schedule
    WHERE last_created_date IS NULL OR due_date > last_created_date""", "schedule")
define("book", "SELECT * FROM ledger UNION ALL BY NAME SELECT * FROM linked", "ledger", "linked")
define("edited", """
    SELECT r.* REPLACE (c.start_date AS start_date, c.frequency AS frequency,
                        c.end_date AS end_date,
                        coalesce(c.amount_cents, r.amount_cents) AS amount_cents,
                        coalesce(c.amount_cents, r.amount_cents) / 100.0 AS amount,
                        coalesce(c.merchant_name, r.merchant_name) AS merchant_name),
           c.start_date <> r.start_date OR c.frequency <> r.frequency
             OR c.end_date IS DISTINCT FROM r.end_date AS schedule_changed,
           keep_overlap, remove_overlap, backfill_missing, skip_backfill
    FROM rules r JOIN changes c ON c.id = r.id""", "rules", "changes")
define("expected", _SCHEDULE.format(source="edited"), "edited")
define("overlap", """
    SELECT l.*, e.remove_overlap FROM linked l JOIN edited e ON e.id = l.recurring_rule_id
    WHERE NOT EXISTS (SELECT 1 FROM expected x WHERE x.id = l.recurring_rule_id
                      AND x.due_date = l.transaction_date)""", "linked", "edited", "expected")
define("missing", """
    SELECT * FROM expected x WHERE NOT EXISTS (
        SELECT 1 FROM linked l WHERE l.recurring_rule_id = x.id
          AND l.transaction_date = x.due_date)""", "expected", "linked")
define("preview", """
    SELECT e.id, e.user_id, schedule_changed,
           (SELECT max(due_date) FROM expected x WHERE x.id = e.id) AS horizon,
           (SELECT count(*) FROM overlap o WHERE o.recurring_rule_id = e.id) AS overlap_count,
           (SELECT count(*) FROM missing m WHERE m.id = e.id) AS missing_count,
           (SELECT min(due_date) FROM missing m WHERE m.id = e.id) AS first_missing
    FROM edited e""", "edited", "expected", "overlap", "missing")
define("cuts", """SELECT id, user_id, start_date + CAST(id % 120 - 20 AS INTEGER) AS from_date
    FROM rules WHERE id % 4 = 0""", "rules")

ROW = ("user_id, transaction_date, merchant_name, amount, transaction_type, category_id, "
       "account_id, notes, recurring_rule_id")
_COPY = ("user_id, due_date AS transaction_date, merchant_name, amount, transaction_type, "
         "category_id, account_id, notes, id AS recurring_rule_id")

SQL = {
    "r1_schedule_dates": over("schedule")("SELECT id, user_id, step, due_date FROM schedule"),
    "r2_horizon": over("rules", "schedule")("""
        SELECT r.id, r.user_id, max(due_date) AS horizon
        FROM rules r LEFT JOIN schedule s ON s.id = r.id GROUP BY r.id, r.user_id"""),
    "r3_due_dates": over("due")("SELECT id, user_id, due_date FROM due"),
    "r4_new_rows": over("due")(f"SELECT {_COPY} FROM due"),
    "r4_moved_rules": over("rules", "due")("""
        SELECT r.id, r.user_id, coalesce(max(due_date), r.last_created_date)
          AS last_created_date
        FROM rules r LEFT JOIN due d ON d.id = r.id
        GROUP BY r.id, r.user_id, r.last_created_date"""),
    "r4_counts": over("due")("""
        SELECT user_id, count(*) AS created, count(DISTINCT id) AS rules_triggered
        FROM due GROUP BY user_id"""),
    "r5_preview_update": over("preview")("SELECT * FROM preview"),
    "r5_preview_rows": over("overlap", "missing")("""
        SELECT user_id, recurring_rule_id AS rule_id, 'overlap' AS kind, id AS transaction_id,
               transaction_date AS day FROM overlap
        UNION ALL SELECT user_id, id, 'missing', NULL, due_date FROM missing"""),
    "r6_updated_ledger": over("book", "changes", "overlap", "missing")(f"""
        SELECT b.user_id, transaction_date, coalesce(c.merchant_name, b.merchant_name)
                 AS merchant_name,
               CASE WHEN c.amount_cents IS NOT NULL THEN c.amount_cents / 100.0
                    ELSE b.amount END AS amount,
               transaction_type, category_id, account_id, notes, recurring_rule_id
        FROM book b LEFT JOIN changes c ON c.id = b.recurring_rule_id
        WHERE NOT EXISTS (SELECT 1 FROM overlap o WHERE o.id = b.id AND o.remove_overlap)
        UNION ALL SELECT {_COPY} FROM missing WHERE backfill_missing"""),
    "r6_updated_rules": over("rules", "edited", "preview")("""
        SELECT * FROM rules WHERE id NOT IN (SELECT id FROM edited)
        UNION ALL
        SELECT e.* EXCLUDE (schedule_changed, keep_overlap, remove_overlap, backfill_missing,
                            skip_backfill)
               REPLACE (CASE WHEN e.schedule_changed THEN p.horizon
                             ELSE e.last_created_date END AS last_created_date)
        FROM edited e JOIN preview p ON p.id = e.id"""),
    "r7_cut_ledger": over("book", "cuts")(f"""
        SELECT b.id, {ROW.replace('user_id', 'b.user_id', 1)}
        FROM book b LEFT JOIN cuts c ON c.id = b.recurring_rule_id
        WHERE from_date IS NULL OR transaction_date < from_date"""),
    "r7_cut_rules": over("rules", "cuts", "linked")("""
        SELECT r.* REPLACE (
            CASE WHEN from_date IS NULL THEN r.end_date ELSE from_date - 1 END AS end_date,
            CASE WHEN from_date <= last_created_date THEN
                (SELECT max(transaction_date) FROM linked l
                 WHERE l.recurring_rule_id = r.id AND transaction_date < from_date)
              ELSE last_created_date END AS last_created_date)
        FROM rules r LEFT JOIN cuts c ON c.id = r.id
        WHERE from_date IS NULL OR r.start_date <= from_date - 1"""),
    "r8_dropped_ledger": over("book", "rules")(f"""
        SELECT id, {ROW} FROM book
        WHERE recurring_rule_id IS NULL OR recurring_rule_id % 7 <> 3"""),
    "r8_dropped_rules": over("rules")("SELECT * FROM rules WHERE id % 7 <> 3"),
    "r9_needs_confirmation": over("preview", "edited")("""
        SELECT p.id, p.user_id, overlap_count, missing_count
        FROM preview p JOIN edited e ON e.id = p.id
        WHERE p.schedule_changed
          AND ((overlap_count > 0 AND NOT (keep_overlap OR remove_overlap))
               OR (missing_count > 0 AND NOT (backfill_missing OR skip_backfill)))"""),
    "r10_invalid_windows": over("rules")("""
        SELECT * FROM (SELECT * REPLACE (end_date - CAST(id % 450 AS INTEGER) AS end_date)
                       FROM rules) WHERE end_date < start_date"""),
}
