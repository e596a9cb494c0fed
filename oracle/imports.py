from oracle.tables import over

SQL = {
    "c2_scan_csv": over("raw")("""
        SELECT user_id, CASE WHEN source_file LIKE '%\\_1.csv' ESCAPE '\\' THEN ''
                             ELSE trim(amount_raw) END AS amount_raw,
               CASE WHEN source_file LIKE '%\\_1.csv' ESCAPE '\\' THEN amount_raw ELSE '' END
                 AS debit_raw, date_raw,
               CASE WHEN source_file LIKE '%\\_1.csv' ESCAPE '\\' THEN '' ELSE posted_raw END
                 AS posted_raw, merchant_raw, trim(mcc_raw) AS mcc_raw, card_raw, holder_raw,
               ref_raw, city_raw FROM raw"""),
    "w1_ledger_store": over("ledger")("""
        SELECT id, user_id, transaction_date, amount, strftime(transaction_date, '%Y-%m') AS ym
        FROM ledger WHERE NOT is_excluded"""),
    "w1_change_months": over("ledger")("""
        SELECT id, user_id, day AS transaction_date, amount, strftime(day, '%Y-%m') AS ym
        FROM (SELECT *, CASE WHEN year(transaction_date) = 1995 AND id % 7 = 1
                             THEN CAST(transaction_date + INTERVAL 1 MONTH AS DATE)
                             ELSE transaction_date END AS day FROM ledger)
        WHERE NOT (year(transaction_date) = 1995 AND id % 7 = 1 AND id % 3 = 0)"""),
    "c10_stored_rejects": over("parsed")("""
        SELECT user_id, error AS message FROM parsed WHERE error IS NOT NULL"""),
}
