from oracle.tables import define, over

_AMOUNT = r"""CASE WHEN trim(amount_raw) = '' THEN 0.0 ELSE TRY_CAST(regexp_replace(
    CASE WHEN trim(amount_raw) LIKE '(%)'
         THEN '-' || substr(trim(amount_raw), 2, length(trim(amount_raw)) - 2)
         ELSE trim(amount_raw) END, '[,$\s]', '', 'g') AS DOUBLE) END"""
_DATE = """CAST(coalesce({}) AS DATE)""".format(", ".join(
    f"try_strptime(trim({{c}}), '{f}')" for f in (
        "%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y", "%Y/%m/%d", "%m-%d-%Y", "%d-%m-%Y", "%b %d, %Y",
        "%B %d, %Y", "%d %b %Y", "%d %B %Y", "%Y%m%d")))
_PAYMENT = ("payment thank you|payment - thank you|remboursement|e-transfer|e transfer|etransfer|"
            "interac transfer|wire transfer|wire xfer|internal transfer|account transfer|"
            "ach transfer|eft transfer|internet transfer|online transfer|hh005tfr|tfr-to|tfr-from")
_MCC = """CASE lower(trim({c}))
    WHEN 'grocery stores and supermarkets' THEN 'groceries'
    WHEN 'computer software stores' THEN 'software'
    WHEN '' THEN {empty} ELSE {other} END"""

define("parsed", f"""
    SELECT *, CASE
             WHEN signed IS NULL THEN 'Cannot parse amount: ' || trim(amount_raw)
             WHEN transaction_date IS NULL AND trim(date_raw) <> ''
               THEN 'Cannot parse date: ' || trim(date_raw)
             WHEN posted_date IS NULL AND trim(posted_raw) <> ''
               THEN 'Cannot parse date: ' || trim(posted_raw) END AS error,
           CASE WHEN regexp_matches(lower(merchant_name || ' ' || mcc_description), '{_PAYMENT}')
                  THEN 'transfer'
                WHEN regexp_matches(lower(merchant_name || ' ' || mcc_description),
                                    'cash back|rebate') THEN 'refund'
                WHEN signed < 0 THEN 'refund' ELSE 'expense' END AS transaction_type
    FROM (SELECT row_idx, user_id, source_file, amount_raw, date_raw, posted_raw,
                 {_AMOUNT} AS signed, {_DATE.format(c='date_raw')} AS transaction_date,
                 {_DATE.format(c='posted_raw')} AS posted_date, trim(ref_raw) AS reference_number,
                 trim(merchant_raw) AS merchant_name, trim(city_raw) AS merchant_city,
                 trim(state_raw) AS merchant_state, trim(country_raw) AS merchant_country,
                 trim(mcc_raw) AS mcc_description, trim(card_raw) AS card_number_masked,
                 trim(holder_raw) AS cardholder
          FROM raw)""", "raw")
define("good", """
    SELECT row_idx, user_id, source_file, transaction_date, posted_date, reference_number,
           merchant_name, merchant_city, merchant_state, merchant_country, mcc_description,
           abs(signed) AS amount, CAST(round(abs(signed) * 100) AS BIGINT) AS amount_cents,
           'CAD' AS currency, transaction_type, card_number_masked, cardholder,
           transaction_type = 'transfer' AS is_payment, transaction_type = 'refund' AS is_refund
    FROM parsed WHERE error IS NULL""", "parsed")
define("kw", r"""
    SELECT DISTINCT user_id, category_id, category_name, keyword,
           CAST(length(keyword) AS INTEGER) AS length
    FROM (SELECT user_id, id AS category_id, lower(trim(name)) AS category_name,
                 trim(regexp_replace(lower(unnest(string_split(keywords, ','))),
                                     '[^\p{L}\p{N}]+', ' ', 'g')) AS keyword FROM categories)
    WHERE keyword <> ''""", "categories")
define("suggested", f"""
    SELECT g.*, coalesce(by_mcc, m.suggestion, 'uncategorized') AS suggested_category,
           CASE WHEN by_mcc IS NOT NULL THEN 'mcc' WHEN m.suggestion IS NOT NULL THEN 'keyword'
                ELSE 'none' END AS suggestion_source,
           by_mcc IS NULL AND coalesce(m.competing, FALSE) AS resolution_needed,
           CASE WHEN by_mcc IS NULL THEN coalesce(m.matches, '') END AS matches
    FROM (SELECT *, {_MCC.format(c='mcc_description', empty='NULL', other='NULL')} AS by_mcc
          FROM good) g
    LEFT JOIN (
        SELECT u.user_id, u.merchant_name,
               arg_min(category_name, lpad(CAST(1000 - length AS VARCHAR), 4, '0')
                       || category_name) AS suggestion,
               count(DISTINCT category_name) > 1 AS competing,
               string_agg(category_id || '|' || category_name || '|' || keyword || '|' || length,
                          ';' ORDER BY length DESC, category_name, keyword) AS matches
        FROM (SELECT DISTINCT user_id, merchant_name,
                     trim(regexp_replace(lower(merchant_name), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))
                       AS words FROM good) u
        JOIN kw ON kw.user_id IS NOT DISTINCT FROM u.user_id AND contains(words, keyword)
        GROUP BY u.user_id, u.merchant_name) m
      ON m.user_id IS NOT DISTINCT FROM g.user_id AND m.merchant_name = g.merchant_name""",
       "good", "kw")

raw = over("raw")
_SPLIT = _AMOUNT

SQL = {
    "c1_header_projection": """
        SELECT strftime(o_orderdate, '%Y-%m-%d') AS date_raw,
               strftime(o_orderdate, '%m/%d/%Y') AS posted_raw, '' AS amount_raw,
               CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_totalprice AS VARCHAR) ELSE '' END
                 AS debit_raw,
               CASE WHEN o_orderkey % 2 = 1 THEN CAST(o_totalprice AS VARCHAR) ELSE '' END
                 AS credit_raw,
               o_orderpriority AS merchant_raw, o_orderstatus AS mcc_raw,
               CAST(o_custkey AS VARCHAR) AS card_raw, '' AS holder_raw,
               CAST(o_orderkey AS VARCHAR) AS ref_raw, '' AS city_raw, '' AS state_raw,
               '' AS country_raw
        FROM orders""",
    "c3_parse_amount": raw(f"SELECT row_idx, {_AMOUNT} AS amount FROM raw"),
    "c4_split_amount": raw(f"""
        SELECT row_idx, CASE WHEN a = 0 THEN -0.0 WHEN row_idx % 8 < 4 THEN a ELSE -a END
                 AS amount
        FROM (SELECT row_idx, {_AMOUNT} AS a FROM raw)"""),
    "c5_parse_date": raw(f"SELECT row_idx, {_DATE.format(c='date_raw')} AS day FROM raw"),
    "c6_classify": over("parsed")("""
        SELECT row_idx, transaction_type, abs(signed) AS amount FROM parsed
        WHERE signed IS NOT NULL"""),
    "c7_mcc_category": raw(f"""
        SELECT row_idx, {_MCC.format(c='mcc_raw', empty="'uncategorized'",
                                     other='lower(trim(mcc_raw))')} AS category FROM raw"""),
    "c8_suggest_category": over("suggested")("""
        SELECT row_idx, suggested_category, suggestion_source, resolution_needed, matches
        FROM suggested"""),
    "c9_detect_period": over("good")("""
        SELECT f.user_id, f.source_file, coalesce(b.month, 1) AS month,
               coalesce(b.year, 2000) AS year
        FROM (SELECT DISTINCT user_id, source_file FROM good) f
        LEFT JOIN (SELECT user_id, source_file, CAST(month AS INTEGER) AS month,
                          CAST(year AS INTEGER) AS year,
                          row_number() OVER (PARTITION BY user_id, source_file
                                             ORDER BY n DESC, first_row) AS place
                   FROM (SELECT user_id, source_file, month(transaction_date) AS month,
                                year(transaction_date) AS year, count(*) AS n,
                                min(row_idx) AS first_row
                         FROM good WHERE transaction_date IS NOT NULL GROUP BY ALL)) b
          ON b.user_id IS NOT DISTINCT FROM f.user_id AND b.source_file = f.source_file
            AND place = 1"""),
    "c10_parse_errors": over("parsed")("""
        SELECT user_id, source_file, row_idx, 'Row ' || row_idx || ': ' || error AS message
        FROM parsed WHERE error IS NOT NULL"""),
    "c11_header_report": """
        SELECT source_file, field, title,
               CASE WHEN source_file = 'orders' THEN (SELECT count(*) FROM orders) END AS rows
        FROM (VALUES ('orders', 'date', ' trans. date '), ('orders', 'posted_date',
            'Posting Date'), ('orders', 'merchant_name', 'Memo'), ('orders', 'mcc_description',
            'TYPE'), ('orders', 'card_number', 'Card No.'), ('orders', 'reference_number',
            'Transaction ID'), ('orders', 'amount', 'Withdrawal / Deposits'),
            ('conversations', 'date', 'Date'), ('conversations', 'amount', 'Amount'))
          AS t(source_file, field, title)""",
    "c12_normalised_rows": over("suggested")("SELECT * EXCLUDE (by_mcc, matches) FROM suggested"),
    "p13_unknown_categories": over("suggested", "categories")("""
        SELECT user_id, suggested_category AS category, min(row_idx) AS first_row
        FROM suggested s WHERE suggested_category <> 'uncategorized' AND NOT EXISTS (
            SELECT 1 FROM categories c WHERE lower(c.name) = lower(s.suggested_category)
              AND c.user_id IS NOT DISTINCT FROM s.user_id)
        GROUP BY user_id, suggested_category"""),
}
