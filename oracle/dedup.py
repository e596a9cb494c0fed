import oracle.ingest  # noqa: F401  (defines good, suggested and kw)
from oracle.tables import define, over


def _low(column: str) -> str:
    return rf"trim(regexp_replace(lower(coalesce({column}, '')), '\s+', ' ', 'g'))"


_PLACE = " || '|' || ".join([_low("merchant_city"), _low("merchant_state"),
                             _low("merchant_country"), _low("mcc_description")])
_INTEREST = "cash interest|interest payment|interest earned|interest charge|interest paid"


def _keys(source: str) -> str:
    return f"""
    SELECT *, regexp_matches(m, '{_INTEREST}') AS interest FROM (
        SELECT *, nullif(trim(reference_number), '') AS ref,
               coalesce(trim(card_number_masked), '') AS own_card,
               coalesce(transaction_date, posted_date) AS sd, {_low('merchant_name')} AS m,
               {_PLACE} AS place, CAST(round(amount * 10000) AS BIGINT) AS e4
        FROM {source})"""


def _cards(source: str) -> str:
    return f"""
    SELECT user_id, own_card AS default_card
    FROM (SELECT user_id, own_card, row_number() OVER (PARTITION BY user_id
                 ORDER BY count(*) DESC, min(row_idx)) AS place
          FROM {source} WHERE own_card <> '' GROUP BY user_id, own_card)
    WHERE place = 1"""


_FOUR = r"CASE WHEN length(regexp_replace({0}, '\D', '', 'g')) >= 4 " \
        r"THEN right(regexp_replace({0}, '\D', '', 'g'), 4) END"


def _account(accounts: str, row: str) -> str:
    return f"""coalesce(
        (SELECT min(a.id) FROM {accounts} a WHERE a.user_id IS NOT DISTINCT FROM {row}.user_id
            AND a.card_number_masked = {row}.card),
        (SELECT min(a.id) FROM {accounts} a WHERE a.user_id IS NOT DISTINCT FROM {row}.user_id
            AND {_FOUR.format('a.card_number_masked')} = {_FOUR.format(row + '.card')}))"""


def _stored(rows: str, account: str) -> str:
    """Rows of `rows` found in the ledger, each branch written as its own search."""
    branch_a = f"(r.ref IS NOT NULL AND {account} IS NOT NULL)"
    branch_b = f"(NOT {branch_a} AND r.interest AND {account} IS NOT NULL)"
    same_user = "l.user_id IS NOT DISTINCT FROM r.user_id"
    return f"""
    SELECT DISTINCT row_idx FROM (
        SELECT r.row_idx FROM {rows} r JOIN stored l ON l.account_id = {account}
          AND l.reference_number = r.ref AND {same_user}
          AND (l.transaction_date = r.sd OR l.posted_date = r.sd)
        WHERE {branch_a}
        UNION ALL
        SELECT r.row_idx FROM {rows} r JOIN stored l ON l.account_id = {account}
          AND l.e4 = r.e4 AND {same_user} AND l.interest
          AND (l.transaction_date = r.sd OR l.posted_date = r.sd)
        WHERE r.interest AND ({branch_a} OR {branch_b})
        UNION ALL
        SELECT r.row_idx FROM {rows} r JOIN stored l ON l.transaction_date = r.sd
          AND l.e4 = r.e4 AND {same_user} AND l.m = r.m AND l.place = r.place
          AND l.currency = upper(r.currency) AND l.transaction_type = lower(r.transaction_type)
          AND ({account} IS NULL OR l.account_id = {account})
        WHERE NOT {branch_a} AND NOT {branch_b})"""


def _repeats(rows: str, token: str) -> str:
    return f"""
    SELECT row_idx FROM (
        SELECT row_idx, row_number() OVER (PARTITION BY user_id, CASE
              WHEN ref IS NOT NULL THEN 'r|' || ref || '|' || {token} || '|'
                || coalesce(CAST(sd AS VARCHAR), '')
              WHEN interest THEN 'i|' || {token} || '|' || sd || '|'
                || CAST(round(amount * 100) AS BIGINT) || '|' || m
              ELSE 'x|' || lower({token}) || '|' || sd || '|' || m || '|' || place || '|' || e4
                || '|' || currency || '|' || transaction_type END
            ORDER BY row_idx) AS place_no
        FROM {rows} WHERE ref IS NOT NULL OR sd IS NOT NULL)
    WHERE place_no > 1"""


define("keyed", _keys("good"), "good")
define("stored", _keys("(SELECT *, NULL AS card_number_masked, 0 AS row_idx FROM ledger)"),
       "ledger")
define("default_cards", _cards("keyed"), "keyed")
define("carded", """
    SELECT k.*, coalesce(nullif(own_card, ''), default_card, '') AS card
    FROM keyed k LEFT JOIN default_cards c ON c.user_id IS NOT DISTINCT FROM k.user_id""",
       "keyed", "default_cards")
define("card_list", f"""
    SELECT c.user_id, c.card, {_account('accounts', 'c')} AS account_id
    FROM (SELECT DISTINCT user_id, card FROM carded) c""", "carded", "accounts")
define("probed", """
    SELECT k.*, account_id FROM carded k JOIN card_list c
      ON c.user_id IS NOT DISTINCT FROM k.user_id AND c.card = k.card""", "carded", "card_list")
define("repeats", _repeats("probed", "card"), "probed")
define("in_ledger", _stored("probed", "r.account_id"), "probed", "stored")
define("checked", """
    SELECT p.row_idx, p.ref AS reference_number,
           CASE WHEN own_card = '' AND card <> '' THEN card ELSE card_number_masked END
             AS card_number_masked,
           p.row_idx % 30 = 0 AS exclude,
           r.row_idx IS NOT NULL OR l.row_idx IS NOT NULL AS duplicate,
           r.row_idx IS NOT NULL AS duplicate_in_import,
           r.row_idx IS NULL AND l.row_idx IS NOT NULL AS duplicate_in_database
    FROM probed p LEFT JOIN repeats r ON r.row_idx = p.row_idx
    LEFT JOIN in_ledger l ON l.row_idx = p.row_idx""", "probed", "repeats", "in_ledger")
define("detected", """
    SELECT f.user_id, f.source_file, coalesce(b.month, 1) AS month,
           coalesce(b.year, 2000) AS year
    FROM (SELECT DISTINCT user_id, source_file FROM good) f
    LEFT JOIN (SELECT user_id, source_file, month, year,
                      row_number() OVER (PARTITION BY user_id, source_file
                                         ORDER BY n DESC, first_row) AS place
               FROM (SELECT user_id, source_file,
                            CAST(month(transaction_date) AS INTEGER) AS month,
                            CAST(year(transaction_date) AS INTEGER) AS year, count(*) AS n,
                            min(row_idx) AS first_row
                     FROM good WHERE transaction_date IS NOT NULL GROUP BY ALL)) b
      ON b.user_id IS NOT DISTINCT FROM f.user_id AND b.source_file = f.source_file
        AND place = 1""", "good")
define("periods", """
    SELECT user_id, source_file,
           CASE WHEN month % 2 = 0 AND month + 2 <= 12 AND year BETWEEN 2000 AND 2100
                THEN month + 2 ELSE month END AS month, year
    FROM detected""", "detected")
define("upload", """
    SELECT s.* EXCLUDE (matches, by_mcc), row_idx % 30 = 0 AS exclude,
           CASE WHEN row_idx % 11 = 0 THEN ' Transfer '
                WHEN row_idx % 13 = 0 THEN 'Trip ' || year(transaction_date) END AS category_name,
           p.month AS import_month, p.year AS import_year
    FROM suggested s JOIN periods p ON p.source_file = s.source_file
      AND p.user_id IS NOT DISTINCT FROM s.user_id""", "suggested", "periods")
define("known", "SELECT * FROM accounts WHERE id % 2 = 0", "accounts")
define("u_keyed", _keys("upload"), "upload")
define("u_default", _cards("u_keyed"), "u_keyed")
define("u_live", """
    SELECT k.*, coalesce(nullif(own_card, ''), default_card, '') AS card
    FROM u_keyed k LEFT JOIN u_default c ON c.user_id IS NOT DISTINCT FROM k.user_id
    WHERE NOT exclude AND transaction_date IS NOT NULL AND trim(merchant_name) <> ''""",
       "u_keyed", "u_default")
define("u_cards", f"""
    SELECT c.*, {_account('known', 'c')} AS found_id, coalesce({_FOUR.format('c.card')}, c.card)
             AS card_group
    FROM (SELECT user_id, card, min(row_idx) AS first_row FROM u_live GROUP BY user_id, card) c
""", "u_live", "known")
define("u_new", """
    SELECT user_id, card_group, min(first_row) AS first_row, arg_min(card, first_row) AS card,
           (SELECT max(id) + 1 FROM known) + min(first_row) AS id
    FROM u_cards WHERE found_id IS NULL GROUP BY user_id, card_group""", "u_cards", "known")
define("u_probed", """
    SELECT l.*, coalesce(found_id, n.id) AS account_id,
           CASE WHEN l.card <> '' THEN coalesce(found_id, n.id) END AS probe_id
    FROM u_live l JOIN u_cards c
      ON c.user_id IS NOT DISTINCT FROM l.user_id AND c.card = l.card
    LEFT JOIN u_new n ON n.user_id IS NOT DISTINCT FROM l.user_id
      AND n.card_group = c.card_group""", "u_live", "u_cards", "u_new")
define("u_in_ledger", _stored("u_probed", "r.probe_id"), "u_probed", "stored")
define("u_fresh", "SELECT * FROM u_probed WHERE row_idx NOT IN (SELECT row_idx FROM u_in_ledger)",
       "u_probed", "u_in_ledger")
define("u_repeats", _repeats("u_fresh", "CAST(account_id AS VARCHAR)"), "u_fresh")
define("u_named", """
    SELECT f.*, lower(trim(CASE
               WHEN coalesce(nullif(category_name, ''), suggested_category) = 'uncategorized'
               THEN 'uncategorized' ELSE coalesce(nullif(category_name, ''), suggested_category)
               END)) AS category
    FROM u_fresh f WHERE row_idx NOT IN (SELECT row_idx FROM u_repeats)""",
       "u_fresh", "u_repeats")
define("u_keyword", """
    SELECT u.user_id, u.merchant_name,
           arg_min(category_name, lpad(CAST(1000 - length AS VARCHAR), 4, '0') || category_name)
             AS suggestion
    FROM (SELECT DISTINCT user_id, merchant_name,
                 trim(regexp_replace(lower(merchant_name), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS words
          FROM u_named) u
    JOIN kw ON kw.user_id IS NOT DISTINCT FROM u.user_id AND contains(words, keyword)
    GROUP BY u.user_id, u.merchant_name""", "u_named", "kw")
define("u_final", """
    SELECT n.* REPLACE (CASE WHEN category = 'uncategorized'
                             THEN coalesce(k.suggestion, category) ELSE category END AS category)
    FROM u_named n LEFT JOIN u_keyword k ON k.user_id IS NOT DISTINCT FROM n.user_id
      AND k.merchant_name = n.merchant_name""", "u_named", "u_keyword")
define("u_categories", """
    SELECT f.user_id, f.category AS name,
           (SELECT max(id) + 1 FROM categories) + min(row_idx) AS id
    FROM u_final f WHERE NOT EXISTS (SELECT 1 FROM categories c WHERE c.name = f.category
      AND c.user_id IS NOT DISTINCT FROM f.user_id)
    GROUP BY f.user_id, f.category""", "u_final", "categories")
define("u_batches", """
    SELECT u.user_id, trim(u.source_file) AS filename, u.import_month AS month,
           u.import_year AS year, count(*) AS total_rows, count(f.row_idx) AS imported_rows,
           count(*) - count(f.row_idx) AS skipped_rows
    FROM upload u LEFT JOIN u_final f ON f.row_idx = u.row_idx
    GROUP BY u.user_id, u.source_file, u.import_month, u.import_year""", "upload", "u_final")

SQL = {
    "d1_row_normalisers": over("raw")(f"""
        SELECT row_idx, nullif(trim(ref_raw), '') AS ref, trim(card_raw) AS card,
               {_low('merchant_raw')} AS merchant_key,
               {_FOUR.format('card_raw')} AS last_four,
               {_low('city_raw')} || '|' || {_low('state_raw')} || '|' || {_low('country_raw')}
                 || '|' || {_low('mcc_raw')} AS place_key
        FROM raw"""),
    "d2_default_card": over("default_cards")("SELECT * FROM default_cards"),
    "d3_statement_date": over("keyed")("SELECT row_idx, sd AS statement_date FROM keyed"),
    "d4_interest_like": over("keyed")("SELECT row_idx, interest AS interest_like FROM keyed"),
    "d5_exact_fingerprint": over("keyed")("""
        SELECT row_idx, sd || '|' || m || '|' || place || '|' || e4 || '|' || lower(currency)
               || '|' || transaction_type AS fingerprint FROM keyed"""),
    "d6_account_of_card": over("card_list")("SELECT * FROM card_list"),
    "d7_batch_duplicates": over("repeats")("SELECT * FROM repeats"),
    "d8_ledger_duplicates": over("in_ledger")("SELECT * FROM in_ledger"),
    "d9_interest_duplicates": over("in_ledger", "probed")(
        "SELECT row_idx FROM in_ledger WHERE row_idx IN (SELECT row_idx FROM probed "
        "WHERE interest)"),
    "d10_check_duplicates": over("checked")("SELECT * FROM checked"),
    "d11_default_exclude": over("checked")("""
        SELECT row_idx, duplicate, CASE WHEN NOT duplicate THEN exclude
               WHEN row_idx % 3 = 0 THEN row_idx % 2 = 0 ELSE TRUE END AS exclude
        FROM checked"""),
    "d12_assign_period": over("good", "periods")("""
        SELECT row_idx, month AS import_month, year AS import_year
        FROM good g JOIN periods p ON p.source_file = g.source_file
          AND p.user_id IS NOT DISTINCT FROM g.user_id"""),
    "d13_missing_required": over("good")("""
        SELECT row_idx, concat_ws(',', CASE WHEN transaction_date IS NULL THEN 'date' END,
               CASE WHEN trim(merchant_name) = '' THEN 'merchant' END) AS missing
        FROM good WHERE transaction_date IS NULL OR trim(merchant_name) = ''"""),
    "d14_commit_import": over("u_final", "u_categories", "categories", "ledger")("""
        SELECT (SELECT max(id) + 1 FROM ledger) + row_idx AS id, f.user_id, transaction_date,
               posted_date, ref AS reference_number, merchant_name,
               nullif(merchant_city, '') AS merchant_city,
               nullif(merchant_state, '') AS merchant_state,
               nullif(merchant_country, '') AS merchant_country,
               nullif(mcc_description, '') AS mcc_description, amount, amount_cents, currency,
               CASE WHEN category = 'transfer' THEN 'transfer' ELSE transaction_type END
                 AS transaction_type,
               account_id, coalesce(c.id, n.id) AS category_id, CAST(NULL AS VARCHAR) AS notes,
               FALSE AS is_excluded, CAST(NULL AS BIGINT) AS recurring_rule_id
        FROM u_final f
        LEFT JOIN categories c ON c.name = f.category AND c.user_id IS NOT DISTINCT FROM f.user_id
        LEFT JOIN u_categories n ON n.name = f.category
          AND n.user_id IS NOT DISTINCT FROM f.user_id"""),
    "d14_new_categories": over("u_categories")("""
        SELECT id, user_id, name, CAST(NULL AS VARCHAR) AS color,
               CAST(NULL AS VARCHAR) AS keywords FROM u_categories"""),
    "d15_batch_summary": over("u_batches")("SELECT * FROM u_batches"),
    "d15_grand_totals": over("u_batches")("""
        SELECT user_id, count(*) AS batches, CAST(sum(imported_rows) AS BIGINT) AS imported,
               CAST(sum(skipped_rows) AS BIGINT) AS skipped FROM u_batches GROUP BY user_id"""),
    "d16_new_accounts": over("u_new", "upload")("""
        SELECT n.id, n.user_id, u.cardholder || ' (' || n.card || ')' AS name,
               n.card AS card_number_masked, CAST(NULL AS VARCHAR) AS institution
        FROM u_new n JOIN upload u ON u.row_idx = n.first_row"""),
}
