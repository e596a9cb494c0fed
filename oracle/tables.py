"""The derived bank tables as DuckDB text, and a helper that puts the needed ones in front."""

from __future__ import annotations

CUST = """
    SELECT c.*, n.n_name, CASE WHEN c.c_nationkey <> 0 THEN n.n_name END AS user_id,
           CASE WHEN c.c_custkey % 10 = 0 THEN right(c.c_name, 4)
                ELSE '************' || right(c.c_name, 4) END AS card
    FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey"""

ACCOUNTS = """
    SELECT c_custkey + 1 AS id, user_id, c_name AS name, card AS card_number_masked,
           c_mktsegment AS institution FROM cust"""

CATEGORIES = """
    SELECT CAST(n_nationkey * 10 + e.code AS BIGINT) AS id,
           CASE WHEN n_nationkey <> 0 THEN n_name END AS user_id, e.name, e.color, e.keywords
    FROM nation, (VALUES (1, 'economy', '#112233', 'red, widget'),
                         (2, 'large', NULL, 'hot, gear'),
                         (3, 'medium', '#445566', 'Gear,cold bolt'),
                         (4, 'promo', NULL, 'blue bolt, ring, ring'),
                         (5, 'small', '#778899', 'old rod, new, hot'),
                         (6, 'transfer', NULL, 'e-transfer')) AS e(code, name, color, keywords)
    WHERE n_nationkey <> 10"""

USERS = "SELECT CASE WHEN n_nationkey <> 0 THEN n_name END AS user_id FROM nation"

LEDGER = """
    SELECT k * 4 + 1 AS id, user_id, d AS transaction_date,
           CASE WHEN k % 3 <> 0 THEN d + CAST(k % 4 AS INTEGER) END AS posted_date,
           CASE WHEN k % 7 <> 0 THEN 'R' || k END AS reference_number,
           CASE WHEN k % 41 = 0 THEN 'Interest Charge ' || p_brand
                ELSE p_name || ' ' || p_brand END AS merchant_name,
           CASE WHEN k % 5 <> 0 THEN 'City ' || (o_custkey % 10) END AS merchant_city,
           CASE WHEN k % 2 = 0 THEN 'ON' END AS merchant_state,
           'CA' AS merchant_country, p_type AS mcc_description,
           o_totalprice AS amount, CAST(round(o_totalprice * 100) AS BIGINT) AS amount_cents,
           CASE WHEN k % 50 = 7 THEN 'USD' ELSE 'CAD' END AS currency,
           CASE o_orderstatus WHEN 'F' THEN 'expense' WHEN 'O' THEN 'income'
                ELSE CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'refund'
                          ELSE 'transfer' END END AS transaction_type,
           CASE WHEN k % 17 <> 0 THEN o_custkey + 1 END AS account_id,
           CAST(CASE WHEN k % 200 = 9 THEN (c_nationkey + 1) % 25 * 10 + 1
                ELSE c_nationkey * 10 + CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'LARGE' THEN 2
                     WHEN 'MEDIUM' THEN 3 WHEN 'PROMO' THEN 4 WHEN 'SMALL' THEN 5 END
                END AS BIGINT) AS category_id,
           CASE WHEN k % 11 = 0 THEN 'note ' || o_orderpriority END AS notes,
           'b' || year(d) AS import_batch_id, k % 10 = 3 AS is_excluded,
           CAST(NULL AS BIGINT) AS recurring_rule_id,
           CAST(d + CAST(k % 28 AS INTEGER) AS TIMESTAMP) AS created_at
    FROM (SELECT *, o_orderkey AS k, CAST(o_orderdate AS DATE) AS d FROM orders) o
    JOIN part p ON p.p_partkey = k % (SELECT count(*) FROM part)
    JOIN cust c ON o.o_custkey = c.c_custkey"""

DIRTY = """
    SELECT l.* REPLACE (l.id + c.i AS id, l.import_batch_id || '/' || c.i AS import_batch_id)
    FROM ledger l JOIN (VALUES (0), (1), (2)) AS c(i)
      ON c.i <= CASE WHEN ((l.id - 1) // 4) % 100 = 0 THEN 2
                     WHEN ((l.id - 1) // 4) % 20 = 0 THEN 1 ELSE 0 END"""

BUDGET_RULES = """
    SELECT CAST(n_nationkey * 10 + e.code AS BIGINT) AS id,
           CASE WHEN n_nationkey <> 0 THEN n_name END AS user_id,
           CASE WHEN e.code <> 0 THEN CAST(n_nationkey * 10 + e.code AS BIGINT) END AS category_id,
           CASE e.code WHEN 0 THEN CAST(60000000 + n_nationkey * 1000000 AS BIGINT)
                WHEN 1 THEN 30000000 WHEN 3 THEN 15000050 ELSE 100000 END AS limit_cents,
           e.code = 0 AS is_total
    FROM nation, (VALUES (0), (1), (3), (9)) AS e(code)"""

HIDDEN = """
    SELECT CASE WHEN n_nationkey <> 0 THEN n_name END AS user_id, key AS category_key
    FROM (SELECT *, 'cat:' || (n_nationkey * 10 + 5) AS key FROM nation
          UNION ALL SELECT *, 'cat:' || (n_nationkey * 10 + 1) FROM nation
          UNION ALL SELECT *, 'uncategorized' FROM nation WHERE n_nationkey % 2 = 1)"""

RULES = """
    SELECT k + 1 AS id, user_id, 'Rent ' || c_name AS merchant_name, abs(c_acctbal) AS amount,
           abs(CAST(round(c_acctbal * 100) AS BIGINT)) AS amount_cents,
           CASE WHEN k % 5 = 0 THEN 'income' ELSE 'expense' END AS transaction_type,
           'CAD' AS currency, CAST(c_nationkey * 10 + k % 5 + 1 AS BIGINT) AS category_id,
           k + 1 AS account_id, CASE WHEN k % 6 = 0 THEN 'lease' END AS notes,
           CASE k % 4 WHEN 0 THEN 'monthly' WHEN 1 THEN 'weekly' WHEN 2 THEN 'biweekly'
                ELSE 'yearly' END AS frequency,
           s AS start_date,
           CASE WHEN k % 3 <> 0 THEN s + CAST(200 + k % 500 AS INTEGER) END AS end_date,
           CASE WHEN k % 2 = 1 THEN s + 90 END AS last_created_date
    FROM (SELECT *, c_custkey AS k, DATE '1999-01-29' + CAST(c_custkey % 400 AS INTEGER) AS s
          FROM cust)"""

LINKED = """
    SELECT CAST((id * 1000 + step) * 4 + 3 AS BIGINT) AS id, user_id,
           start_date + CAST(step * 7 AS INTEGER)
             + CASE WHEN step % 7 = 5 THEN 1 ELSE 0 END AS transaction_date,
           CAST(NULL AS DATE) AS posted_date, CAST(NULL AS VARCHAR) AS reference_number,
           merchant_name, CAST(NULL AS VARCHAR) AS merchant_city,
           CAST(NULL AS VARCHAR) AS merchant_state, CAST(NULL AS VARCHAR) AS merchant_country,
           CAST(NULL AS VARCHAR) AS mcc_description, amount, amount_cents, currency,
           transaction_type, account_id, category_id, notes,
           CAST(NULL AS VARCHAR) AS import_batch_id, FALSE AS is_excluded,
           id AS recurring_rule_id, CAST(start_date AS TIMESTAMP) AS created_at
    FROM rules, range(0, 31) AS t(step) WHERE step % 5 <> 3"""

CHANGES = """
    SELECT id, user_id,
           CASE WHEN k % 3 = 0 THEN start_date + 28 ELSE start_date END AS start_date,
           CASE WHEN k % 4 = 1 THEN 'biweekly' ELSE frequency END AS frequency,
           CASE WHEN k % 6 = 1 THEN start_date + 120 ELSE end_date END AS end_date,
           CASE WHEN k % 2 = 0 THEN amount_cents + 500 END AS amount_cents,
           CASE WHEN k % 9 = 0 THEN 'Rent (new)' END AS merchant_name,
           k % 4 = 0 AS keep_overlap, k % 4 = 1 AS remove_overlap,
           k % 6 = 0 AS backfill_missing, k % 6 = 1 AS skip_backfill
    FROM (SELECT *, id - 1 AS k FROM rules) WHERE k % 3 <> 2"""

LINES = """
    SELECT l.*, c.*, p.p_name, p.p_brand, p.p_type, o.o_custkey, l.l_orderkey * 1000 + l.rn AS seq,
           CAST(l.l_shipdate AS DATE) AS ship_day
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey,
                 l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag,
                 l_linestatus, l_shipdate) AS rn FROM lineitem) l
    JOIN orders o ON l.l_orderkey = o.o_orderkey
    JOIN cust c ON o.o_custkey = c.c_custkey
    JOIN part p ON l.l_partkey = p.p_partkey"""

RAW = """
    SELECT seq * 4 + r.i AS row_idx, user_id,
           'upload_' || lower(coalesce(user_id, 'local')) || '_' || (l_suppkey % 3) || '.csv'
             AS source_file,
           CASE WHEN l_partkey % 97 = 5 THEN 'not a date' WHEN l_partkey % 101 = 7 THEN ''
                WHEN l_partkey % 4 = 0 THEN strftime(ship_day, '%Y-%m-%d')
                WHEN l_partkey % 4 = 1 THEN strftime(ship_day, '%-m/%-d/%Y')
                WHEN l_partkey % 4 = 2 THEN strftime(ship_day, '%b %-d, %Y')
                ELSE strftime(ship_day, '%Y%m%d') END AS date_raw,
           CASE WHEN l_linenumber % 2 = 0 THEN strftime(ship_day + 1, '%Y-%m-%d') ELSE '' END
             AS posted_raw,
           CASE WHEN l_partkey % 89 = 3 THEN 'N/A'
                WHEN l_suppkey % 4 = 0 THEN '(' || format('{:,.2f}', l_extendedprice) || ')'
                WHEN l_suppkey % 4 = 1 THEN '$' || format('{:,.2f}', l_extendedprice)
                WHEN l_suppkey % 4 = 2 THEN '-' || format('{:.2f}', l_extendedprice)
                ELSE ' ' || format('{:.2f}', l_extendedprice) END AS amount_raw,
           CASE WHEN l_partkey % 37 = 0 THEN 'Interest Charge ' || p_brand
                WHEN l_partkey % 37 = 1 THEN 'INTERAC E-TRANSFER ' || p_brand
                WHEN l_partkey % 37 = 2 THEN 'Cash Back Reward'
                WHEN l_partkey % 37 = 3 THEN ''
                ELSE p_name || '  ' || p_brand END AS merchant_raw,
           CASE WHEN l_partkey % 13 = 0 THEN ' Grocery Stores and Supermarkets '
                WHEN l_partkey % 13 = 1 THEN 'Computer Software Stores'
                WHEN l_partkey % 13 = 2 THEN '' ELSE p_type END AS mcc_raw,
           CASE WHEN l_partkey % 3 = 0 THEN '' ELSE l_orderkey || '-' || l_linenumber END
             AS ref_raw,
           'City ' || (o_custkey % 10) AS city_raw, 'ON' AS state_raw, 'CA' AS country_raw,
           CASE WHEN l_suppkey % 6 = 0 THEN '' WHEN l_suppkey % 6 = 1 THEN right(c_name, 4)
                ELSE card END AS card_raw, c_name AS holder_raw
    FROM lines JOIN (VALUES (0), (1)) AS r(i) ON r.i = 0 OR seq % 15 = 0
    UNION ALL
    SELECT k * 4000 + 2, l.user_id,
           'upload_' || lower(coalesce(l.user_id, 'local')) || '_r.csv',
           strftime(l.transaction_date, '%Y-%m-%d'), '', format('{:.2f}', l.amount),
           replace(l.merchant_name, ' ', '  '), l.mcc_description,
           coalesce(l.reference_number, ''), coalesce(l.merchant_city, ''),
           coalesce(l.merchant_state, ''), l.merchant_country, c.card, c.c_name
    FROM (SELECT *, (id - 1) // 4 AS k FROM ledger) l
    JOIN orders o ON o.o_orderkey = l.k JOIN cust c ON c.c_custkey = o.o_custkey
    WHERE l.k % 5 = 0"""

OFX = r"""
    SELECT 'order' || l_orderkey || '.ofx' AS file,
           'OFXHEADER:100' || chr(10) || '<OFX><STMTRS>'
           || CASE WHEN l_orderkey % 2 = 0 THEN '<CURDEF>USD' || chr(10) ELSE '' END
           || string_agg('<STMTTRN><TRNTYPE>'
                || ['DEBIT', 'PAYMENT', 'CREDIT', 'DEP', 'POS', 'ODD'][l_suppkey % 6 + 1]
                || chr(10) || '<DTPOSTED>' || strftime(ship_day, '%Y%m%d') || '120000' || chr(10)
                || CASE WHEN l_linenumber % 2 = 0
                        THEN '<DTAVAIL>' || strftime(ship_day + 2, '%Y%m%d') || chr(10) ELSE '' END
                || '<TRNAMT>' || CASE WHEN l_partkey % 89 = 3 THEN 'oops'
                     WHEN l_suppkey % 6 IN (2, 3) THEN format('{:.2f}', l_extendedprice)
                     ELSE '-' || format('{:.2f}', l_extendedprice) END
                || chr(10) || '<FITID>' || seq || chr(10) || '<NAME>' || p_name
                || CASE WHEN l_partkey % 3 = 0 THEN chr(10) || '<MEMO>' || p_brand
                        WHEN l_partkey % 3 = 1 THEN chr(10) || '<MEMO>' || upper(p_name)
                        ELSE '' END
                || chr(10) || '</STMTTRN>', chr(10) ORDER BY rn)
           || chr(10) || '</STMTRS></OFX>' AS content
    FROM lines GROUP BY l_orderkey"""

# name -> (text, tables it reads)
TABLES: dict[str, tuple[str, tuple[str, ...]]] = {
    "cust": (CUST, ()),
    "accounts": (ACCOUNTS, ("cust",)),
    "categories": (CATEGORIES, ()),
    "users": (USERS, ()),
    "ledger": (LEDGER, ("cust",)),
    "dirty": (DIRTY, ("ledger",)),
    "budget_rules": (BUDGET_RULES, ()),
    "hidden": (HIDDEN, ()),
    "rules": (RULES, ("cust",)),
    "linked": (LINKED, ("rules",)),
    "changes": (CHANGES, ("rules",)),
    "lines": (LINES, ("cust",)),
    "raw": (RAW, ("lines", "ledger")),
    "ofx_files": (OFX, ("lines",)),
}


def define(name: str, text: str, *reads: str) -> None:
    """Add a shared intermediate table of an operator family."""
    TABLES[name] = (text, reads)


def over(*names: str):
    """Prefix a query body with the tables it reads, in dependency order."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in TABLES[name][1]:
            visit(dep)
        order.append(name)

    for name in names:
        visit(name)
    head = ",\n".join(f"{n} AS ({TABLES[n][0]})" for n in order)

    def build(body: str) -> str:
        body = body.strip()
        if body[:5].upper() == "WITH ":
            return f"WITH {head},\n{body[5:]}"
        return f"WITH {head}\n{body}"

    return build
