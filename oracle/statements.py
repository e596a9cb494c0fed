import oracle.ingest  # noqa: F401
from oracle.ingest import _PAYMENT
from oracle.tables import define, over
from tallybook.schemas import LAYOUT_FIELDS, LAYOUTS

NL = "chr(10)"
define("stmt_lines", f"""
    SELECT 'order' || l_orderkey || '.pdf' AS file, CAST(rn * 2 + 2 AS INTEGER) AS line_no,
           CASE WHEN l_partkey % 50 = 7
                  THEN strftime(ship_day, '%b %d') || ' TOTAL ' || format('{{:,.2f}}', l_extendedprice)
                WHEN l_partkey % 50 = 9 THEN 'Foo 99 ' || p_name || ' 5.00'
                WHEN l_partkey % 6 = 0 THEN strftime(ship_day, '%b %d ') || p_name || ' '
                  || p_brand || '  $' || format('{{:,.2f}}', l_extendedprice)
                WHEN l_partkey % 6 = 1 THEN strftime(ship_day, '%m/%d %m/%d ') || p_name || ' '
                  || format('{{:.2f}}', l_extendedprice) || ' 9,999.99'
                WHEN l_partkey % 6 = 2 THEN strftime(ship_day, '%d %b ') || p_name || ' '
                  || format('{{:.2f}}', l_extendedprice) || ' CR'
                WHEN l_partkey % 6 = 3 THEN strftime(ship_day, '%m/%d/%Y') || ' REFUND ' || p_name
                  || ' ' || format('{{:,.2f}}', l_extendedprice)
                ELSE upper(strftime(ship_day, '%b%d')) || ' ' || p_name END AS text
    FROM lines
    UNION ALL
    SELECT 'order' || l_orderkey || '.pdf', CAST(rn * 2 + 3 AS INTEGER),
           CASE WHEN l_partkey % 6 = 4 THEN '   ' || format('{{:,.2f}}', l_extendedprice) ELSE '' END
    FROM lines
    UNION ALL
    SELECT 'order' || l_orderkey || '.pdf', n, CASE n WHEN 1 THEN
             CASE WHEN l_orderkey % 3 = 0 THEN 'no year here'
                  ELSE 'Statement for ' || year(ship_day) || ' to 2030' END
             WHEN 2 THEN 'Jan 01 Opening Balance 100.00' ELSE '' END
    FROM lines, (VALUES (1), (2), (3)) AS t(n) WHERE rn = 1""", "lines")
define("stmt_cells", f"""
    SELECT 'order' || l_orderkey || '.pdf' AS file, 1 AS page, 0 AS table_no,
           CAST(rn AS INTEGER) AS row_no,
           CASE WHEN l_partkey % 41 = 8 THEN [day, name]
                WHEN l_orderkey % 5 < 2 THEN [day, name,
                  CASE WHEN l_suppkey % 3 = 0 THEN pretty ELSE '' END,
                  CASE WHEN l_suppkey % 3 = 1 THEN pretty ELSE '' END]
                ELSE [' x ', day, CASE WHEN l_partkey % 37 = 6 THEN '??' ELSE pretty END, name]
           END AS cells
    FROM (SELECT *, format('{{:,.2f}}', l_extendedprice) AS pretty,
                 CASE WHEN l_partkey % 31 = 4 THEN 'n/a'
                      WHEN l_orderkey % 3 = 1 THEN strftime(ship_day, '%b %d') || {NL} || 'posted'
                      ELSE strftime(ship_day, '%b %-d, %Y') || {NL} || 'posted' END AS day,
                 CASE WHEN l_partkey % 29 = 5 THEN 'Closing balance'
                      ELSE p_name || {NL} || p_brand END AS name
          FROM lines)
    UNION ALL
    SELECT 'order' || l_orderkey || '.pdf', 1, 0, 0,
           CASE WHEN l_orderkey % 5 < 2 THEN [' Date', 'Details', 'Withdrawals', 'Deposit']
                WHEN l_orderkey % 5 < 4 THEN ['No', 'Value Date', 'AMOUNT ', 'Description']
                ELSE ['No', 'When', 'Amount', 'Description'] END
    FROM lines WHERE rn = 1""", "lines")
define("stmt_words", """
    SELECT 'order' || l_orderkey || '.pdf' AS file,
           CASE WHEN part > 4 THEN 1 ELSE CAST((rn - 1) // 4 + 1 AS INTEGER) END AS page,
           CASE part WHEN 0 THEN strftime(ship_day, '%b') WHEN 1 THEN strftime(ship_day, '%d')
                WHEN 2 THEN split_part(p_name, ' ', 1) WHEN 3 THEN split_part(p_name, ' ', 2)
                WHEN 4 THEN format('{:.2f}', l_extendedprice)
                WHEN 5 THEN ['ACME', 'RBC', 'TD', 'Scotiabank', 'EQ'][l_orderkey % 5 + 1]
                WHEN 6 THEN ['Savings', 'Chequing', 'Visa', 'Passport', 'Bank'][l_orderkey % 5 + 1]
                WHEN 7 THEN CAST(year(ship_day) AS VARCHAR) WHEN 8 THEN 'Date'
                WHEN 9 THEN 'Description' WHEN 10 THEN 'Withdrawals($)' WHEN 11 THEN 'Deposits'
                ELSE 'Amount' END AS text,
           CAST(CASE WHEN l_orderkey % 3 = 2 THEN 40 ELSE 0 END + CASE part
                WHEN 0 THEN CASE WHEN visa THEN 35 ELSE 36 END
                WHEN 1 THEN CASE WHEN visa THEN 55 ELSE 56 END
                WHEN 2 THEN CASE WHEN visa THEN 140 ELSE 110 END
                WHEN 3 THEN CASE WHEN visa THEN 180 ELSE 150 END
                WHEN 4 THEN CASE WHEN visa THEN 320 WHEN l_suppkey % 3 = 0 THEN 450 ELSE 380 END
                WHEN 5 THEN 30 WHEN 6 THEN 90 WHEN 7 THEN 200 WHEN 8 THEN 36 WHEN 9 THEN 110
                WHEN 10 THEN 375 WHEN 11 THEN 445 ELSE 316 END AS DOUBLE) AS x0,
           CAST(CASE WHEN part IN (5, 6, 7) THEN 8 WHEN part > 7 THEN 40
                     ELSE (rn - 1) % 4 * 12 + 60 + l_partkey % 2 END AS DOUBLE) AS top
    FROM (SELECT *, l_orderkey % 5 = 2 AS visa FROM lines), range(0, 13) AS t(part)
    WHERE (part <= 4 OR rn = 1) AND (NOT visa OR part NOT IN (10, 11)) AND (visa OR part <> 12)
""", "lines")

_FORMATS = ("%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y", "%Y/%m/%d", "%m-%d-%Y", "%d-%m-%Y", "%b %d %Y",
            "%b %d, %Y", "%B %d %Y", "%B %d, %Y", "%d %b %Y", "%d %B %Y")
_YEARLESS = ("%b %d", "%m/%d", "%d %b", "%d-%b", "%b%d")


def _day(text: str, year: str) -> str:
    tries = [f"try_strptime({text}, '{f}')" for f in _FORMATS]
    tries += [f"try_strptime({text} || ' ' || {year}, '{f} %Y')" for f in _YEARLESS]
    tries.append(f"try_strptime({text}, '%b%d%Y')")
    return f"CAST(coalesce({', '.join(tries)}) AS DATE)"


def _value(text: str) -> str:
    clean = rf"regexp_replace(trim({text}), '[,$ ]', '', 'g')"
    return (f"TRY_CAST(CASE WHEN {clean} LIKE '(%)' THEN '-' || {clean}[2:-2] ELSE {clean} END "
            "AS DOUBLE)")


def _kind(merchant: str, signed: str) -> str:
    return f"""CASE WHEN regexp_matches(lower({merchant}), '{_PAYMENT}') THEN 'transfer'
        WHEN regexp_matches(lower({merchant}), 'cash back|rebate') THEN 'refund'
        WHEN {signed} < 0 THEN 'refund' ELSE 'expense' END"""


_DATE = (r"(?:\d{1,2}[/\-]\d{1,2}(?:[/\-]\d{2,4})?|[A-Za-z]{3,}\s*\d{1,2}(?:[,\s]+\d{4})?"
         r"|\d{1,2}[-\s][A-Za-z]{3}(?:\s+\d{4})?)")
_LINE = rf"^({_DATE})(?:\s+{_DATE})?\s+(.+)"
_END = r"[\-\+]?\$?\s*([\d,]+\.\d{2})\s*(?:CR|DB|DR)?\s*$"
_SKIP = (r"(?i)^\s*(opening|closing|balance\s*forward|previous\s*balance|new\s*balance"
         r"|starting\s*balance|total|subtotal|minimum\s*payment|credit\s*limit"
         r"|available\s*credit|statement\s*date|payment\s*due|brought\s*forward)\b")

define("stmt_years", rf"""
    SELECT file, coalesce(CAST(nullif(regexp_extract(string_agg(text, {NL}
             ORDER BY line_no), '\b(20\d{{2}})\b', 1), '') AS INTEGER), 2001) AS year
    FROM stmt_lines GROUP BY file""", "stmt_lines")
define("dated_lines", rf"""
    SELECT * FROM (
        SELECT file, line_no, line, trim(regexp_extract(line, '{_LINE}', 1)) AS date_text,
               trim(regexp_extract(line, '{_LINE}', 2)) AS rest, nxt
        FROM (SELECT *, trim(text) AS line,
                     lead(trim(text)) OVER (PARTITION BY file ORDER BY line_no) AS nxt
              FROM stmt_lines)
        WHERE regexp_matches(line, '{_LINE}'))
    WHERE NOT regexp_matches(rest, '{_SKIP}')""", "stmt_lines")


def _line_rows(two_amounts: bool, words: str | None) -> str:
    inner = f"regexp_matches(pre, '{_END}')" if two_amounts else "FALSE"
    credit = r"regexp_matches(line, '(?i)\bCR\b')" + (
        rf" OR regexp_matches(merchant, '(?i)\b({words})\b')" if words else "")
    return rf"""
    SELECT file, line_no, transaction_date, merchant AS merchant_name, signed,
           abs(signed) AS amount, {_kind('merchant', 'signed')} AS transaction_type,
           CASE WHEN amount_text IS NULL THEN 'no amount found' WHEN merchant = '' THEN 'no merchant'
                WHEN transaction_date IS NULL THEN 'bad date ' || date_text
                WHEN value IS NULL THEN 'bad amount' END AS error
    FROM (SELECT *, CASE WHEN {credit} THEN -abs(value) ELSE value END AS signed
          FROM (SELECT *, {_day('date_text', 'year')} AS transaction_date,
                       {_value('amount_text')} AS value
                FROM (SELECT l.*, y.year,
                         CASE WHEN has AND {inner} THEN regexp_extract(pre, '{_END}', 1)
                              WHEN has THEN regexp_extract(rest, '{_END}', 1)
                              ELSE nullif(regexp_extract(nxt, '{_END}', 1), '') END AS amount_text,
                         trim(CASE WHEN has AND {inner}
                                     THEN regexp_extract(pre, '^(.*?){_END}', 1)
                                   WHEN has THEN pre ELSE rest END) AS merchant
                      FROM (SELECT *, regexp_matches(rest, '{_END}') AS has,
                                   rtrim(regexp_extract(rest, '^(.*?){_END}', 1)) AS pre
                            FROM dated_lines) l JOIN stmt_years y ON y.file = l.file)))"""


_FULL = (r"credit\s*memo|direct\s*deposit|e[\-\s]?deposit|payroll\s*deposit|refund|reversal"
         r"|interest\s*paid|dividend\s*paid")
define("line_rows", _line_rows(True, _FULL), "dated_lines", "stmt_years")
define("scan_rows", _line_rows(True, r"credit\s*memo|direct\s*deposit|refund|reversal"),
       "dated_lines", "stmt_years")
define("plain_rows", _line_rows(False, None), "dated_lines", "stmt_years")

# Column titles of tables inside statements.
_ALIASES = {
    "date": ["date", "transaction date", "trans. date", "trans date", "activity date",
             "value date", "post date", "posted date"],
    "merchant": ["description", "merchant", "merchant name", "payee", "details", "memo",
                 "narrative", "particulars", "transaction description"],
    "amount": ["amount", "transaction amount", "cad amount", "net amount"],
    "debit": ["debit", "withdrawals", "withdrawal", "debit amount"],
    "credit": ["credit", "deposits", "deposit", "credit amount"],
}


def _at(field: str) -> str:
    return "coalesce(" + ", ".join(
        f"nullif(list_position(h, '{a}'), 0)" for a in _ALIASES[field]) + ")"


def _cell_rows(skip_zero: bool, short_rows: bool, one_line: bool = True) -> str:
    cell = "coalesce(c[m_at], '')"
    merchant = f"replace({cell}, {NL}, ' ')" if one_line else cell
    return rf"""
    SELECT file, page, table_no, row_no, transaction_date, merchant AS merchant_name,
           value AS signed, abs(value) AS amount, {_kind('merchant', 'value')}
             AS transaction_type,
           CASE WHEN NOT usable THEN 'table not recognised' WHEN short THEN 'row too short'
                WHEN transaction_date IS NULL AND date_text <> '' THEN 'bad date'
                WHEN value IS NULL THEN 'bad amount'
                WHEN {skip_zero} AND split AND value = 0 THEN 'zero amount' END AS error
    FROM (SELECT *, {_day('date_text', 'year')} AS transaction_date,
                 CASE WHEN split THEN CASE WHEN debit <> 0 THEN debit ELSE -credit END
                      ELSE {_value('single')} END AS value
          FROM (SELECT *, trim(split_part(coalesce(c[d_at], ''), {NL}, 1)) AS date_text,
                       trim({merchant}) AS merchant,
                       coalesce({_value("coalesce(c[w_at], '')")}, 0) AS debit,
                       coalesce({_value("coalesce(c[p_at], '')")}, 0) AS credit,
                       coalesce(c[a_at], '') AS single,
                       w_at IS NOT NULL OR p_at IS NOT NULL AS split,
                       d_at IS NOT NULL AND m_at IS NOT NULL
                         AND (a_at IS NOT NULL OR w_at IS NOT NULL OR p_at IS NOT NULL) AS usable,
                       {not short_rows} AND len(c) < greatest(coalesce(d_at, 1), coalesce(m_at, 1),
                         coalesce(a_at, 1), coalesce(w_at, 1), coalesce(p_at, 1)) AS short
                FROM (SELECT s.*, list_transform(s.cells, lambda x: trim(x)) AS c, t.*
                        EXCLUDE (file), y.year
                      FROM stmt_cells s JOIN stmt_years y ON y.file = s.file JOIN (
                        SELECT file, {_at('date')} AS d_at, {_at('merchant')} AS m_at,
                               {_at('amount')} AS a_at, {_at('debit')} AS w_at,
                               {_at('credit')} AS p_at
                        FROM (SELECT file, list_transform(cells, lambda x: lower(trim(x))) AS h
                              FROM stmt_cells WHERE row_no = 0)) t ON t.file = s.file
                      WHERE row_no > 0)))
    WHERE NOT (usable AND NOT short AND ((date_text = '' AND merchant = '')
               OR regexp_matches(merchant, '{_SKIP}')))"""


define("cell_rows", _cell_rows(False, False), "stmt_cells", "stmt_years")
define("stream_rows", _cell_rows(True, True, False), "stmt_cells", "stmt_years")
define("page_lines", """
    SELECT file, page, CAST(round_even(top / 4, 0) * 4 AS INTEGER) AS y,
           string_agg(text, ' ' ORDER BY x0, text) AS text
    FROM stmt_words GROUP BY ALL""", "stmt_words")
_PHRASES = ", ".join(f"({i}, '{name}', '{phrase.upper()}')"
                     for i, (name, phrases, _) in enumerate(LAYOUTS) for phrase in phrases)
define("profiles", rf"""
    SELECT f.file, CAST(coalesce(n, 0) AS INTEGER) AS number,
           coalesce(name, 'TD Visa') AS profile, n IS NOT NULL AS recognised,
           coalesce(year, 2001) AS year
    FROM (SELECT DISTINCT file FROM stmt_words) f
    LEFT JOIN (SELECT file, arg_min(n, page * 100 + n) AS n, arg_min(name, page * 100 + n) AS name
               FROM page_lines JOIN (VALUES {_PHRASES}) AS p(n, name, phrase)
                 ON contains(upper(text), phrase) GROUP BY file) h ON h.file = f.file
    LEFT JOIN (SELECT file, arg_min(CAST(regexp_extract(text, '\b(20\d{{2}})\b', 1) AS INTEGER),
                                    page * 1000000 + y) AS year
               FROM page_lines WHERE regexp_matches(text, '\b20\d{{2}}\b') GROUP BY file) y
      ON y.file = f.file""", "stmt_words", "page_lines")
_RANGES = ", ".join(
    f"({i}, " + ", ".join(
        f"{x[f][0]}, {x[f][1]}" if f in x else "NULL, NULL" for f in LAYOUT_FIELDS) + ")"
    for i, (_, _, x) in enumerate(LAYOUTS))
_BOUNDS = ", ".join(f"{f}_lo, {f}_hi" for f in LAYOUT_FIELDS)
define("word_lines", f"""
    SELECT w.file, w.page, CAST(round_even(top / 4, 0) * 4 AS INTEGER) AS y, p.year,
           {', '.join(f"coalesce(string_agg(text, ' ' ORDER BY x0, text) FILTER "
                      f"(x0 BETWEEN {f}_lo AND {f}_hi), '') AS {f}_text" for f in LAYOUT_FIELDS)},
           max(amount_lo) IS NOT NULL AS has_amount
    FROM stmt_words w JOIN profiles p ON p.file = w.file
    JOIN (VALUES {_RANGES}) AS r(n, {_BOUNDS}) ON r.n = p.number
    GROUP BY ALL""", "stmt_words", "profiles")
define("ofx_rows", rf"""
    SELECT *, {_kind('merchant_name', '-trnamt')} AS by_phrase FROM (
        SELECT *, CASE WHEN memo <> '' AND lower(memo) <> lower(name)
                       THEN trim(name || ' ' || memo) ELSE name END AS merchant_name
        FROM (SELECT file, position, currency, TRY_CAST(regexp_extract(b, '<TRNAMT>([^<\n]*)', 1)
                       AS DOUBLE) AS trnamt,
                     trim(regexp_extract(b, '<NAME>([^<\n]*)', 1)) AS name,
                     trim(regexp_extract(b, '<MEMO>([^<\n]*)', 1)) AS memo,
                     regexp_extract(b, '<TRNTYPE>([^<\n]*)', 1) AS kind,
                     regexp_extract(b, '<FITID>([^<\n]*)', 1) AS fitid,
                     CAST(try_strptime(substr(regexp_extract(b, '<DTPOSTED>([^<\n]*)', 1), 1, 8),
                          '%Y%m%d') AS DATE) AS transaction_date,
                     CAST(try_strptime(substr(regexp_extract(b, '<DTAVAIL>([^<\n]*)', 1), 1, 8),
                          '%Y%m%d') AS DATE) AS posted_date
              FROM (SELECT file, CASE WHEN contains(content, '<CURDEF>USD') THEN 'USD'
                                      ELSE 'CAD' END AS currency,
                           unnest(blocks) AS b,
                           CAST(unnest(range(0, len(blocks))) AS INTEGER) AS position
                    FROM (SELECT *, regexp_extract_all(content, '(?s)<STMTTRN>(.*?)</STMTTRN>', 1)
                                      AS blocks FROM ofx_files))))""", "ofx_files")
_OFX_TYPE = """CASE WHEN kind IN ('CREDIT', 'DEP') AND -trnamt <= 0 THEN 'income'
    WHEN kind = 'PAYMENT' THEN 'transfer' ELSE by_phrase END"""
_SHORT = "file, transaction_date, merchant_name, amount, transaction_type, error"
define("read_rows", f"""
    SELECT 'pdfplumber_table' AS parser_id, {_SHORT} FROM cell_rows
    UNION ALL SELECT 'camelot_stream', {_SHORT} FROM stream_rows
    UNION ALL SELECT 'pdfplumber_text', {_SHORT} FROM line_rows
    UNION ALL SELECT 'tesseract', {_SHORT} FROM plain_rows
    UNION ALL SELECT 'ofx_parser', file, transaction_date, merchant_name, abs(trnamt),
           {_OFX_TYPE}, CASE WHEN trnamt IS NULL THEN 'bad amount' END FROM ofx_rows""",
       "cell_rows", "stream_rows", "line_rows", "plain_rows", "ofx_rows")
define("quality", """
    SELECT file, parser_id, rows, valid_rows, skipped_rows,
           CASE WHEN parser_id = 'ofx_parser' AND valid_rows > 0 AND skipped_rows = 0 THEN 0.95
                ELSE least(coalesce(CAST(floor((2000 * valid_rows + total) / (2 * nullif(total, 0)))
                    AS BIGINT) / 1000, 0.0), CASE parser_id WHEN 'pdfplumber_text' THEN 0.75
                    WHEN 'camelot_stream' THEN 0.82 WHEN 'tesseract' THEN 0.65 ELSE 1.0 END)
           END::DOUBLE AS confidence
    FROM (SELECT *, valid_rows + skipped_rows AS total FROM (
        SELECT file, parser_id, count(*) FILTER (error IS NULL) AS rows,
               count(*) FILTER (error IS NULL AND transaction_date IS NOT NULL
                 AND merchant_name <> '' AND amount <> 0) AS valid_rows,
               count(*) FILTER (error IS NOT NULL) AS skipped_rows
        FROM read_rows GROUP BY file, parser_id))""", "read_rows")

SQL = {
    "x1_scan_ofx": over("ofx_rows")("""
        SELECT file, 0 AS statement_no, position, transaction_date, posted_date,
               nullif(fitid, '') AS reference_number, merchant_name, abs(trnamt) AS amount,
               currency, CASE WHEN trnamt IS NULL THEN 'bad amount' END AS error
        FROM ofx_rows"""),
    "x1_scan_ofx_files": over("ofx_rows")(f"""
        SELECT transaction_date, posted_date, nullif(fitid, '') AS reference_number,
               merchant_name, abs(trnamt) AS amount, currency, {_OFX_TYPE} AS transaction_type,
               CASE WHEN trnamt IS NULL THEN 'bad amount' END AS error
        FROM ofx_rows"""),
    "x2_ofx_type": over("ofx_rows")(
        f"SELECT file, position, {_OFX_TYPE} AS transaction_type FROM ofx_rows"),
    "p1_statement_lines": over("line_rows")("SELECT * FROM line_rows"),
    "p1_scanned_lines": over("scan_rows")("SELECT * FROM scan_rows"),
    "p2_infer_year": over("stmt_years")("SELECT * FROM stmt_years"),
    "p3_statement_date": over("stmt_cells", "stmt_years")(f"""
        SELECT file, row_no, place, {_day('t', 'year')} AS day
        FROM (SELECT file, year, row_no, CAST(generate_subscripts(cells, 1) - 1 AS INTEGER) AS place,
                     trim(split_part(trim(unnest(cells)), {NL}, 1)) AS t
              FROM stmt_cells JOIN stmt_years USING (file))"""),
    "p4_statement_amount": over("stmt_cells")(f"""
        SELECT file, row_no, place, {_value('t')} AS amount
        FROM (SELECT file, row_no, CAST(generate_subscripts(cells, 1) - 1 AS INTEGER) AS place,
                     unnest(cells) AS t FROM stmt_cells)"""),
    "p5_skip_row": over("stmt_lines")(
        f"SELECT file, line_no, regexp_matches(coalesce(nullif(regexp_extract(text, '{_LINE}', 2), "
        f"''), text), '{_SKIP}') AS skipped FROM stmt_lines"),
    "p6_table_cells": over("cell_rows")("SELECT * FROM cell_rows"),
    "p7_word_boxes": over("word_lines")(rf"""
        SELECT file, page, y, transaction_date, desc_text AS merchant_name, value AS signed,
               abs(value) AS amount, {_kind('desc_text', 'value')} AS transaction_type,
               CASE WHEN has_amount THEN CASE WHEN value IS NULL THEN 'bad amount' END
                    WHEN debit = 0 AND credit = 0 THEN 'zero amount' END AS error
        FROM (SELECT *, CASE WHEN has_amount THEN {_value('amount_text')}
                             WHEN debit <> 0 THEN debit ELSE -credit END AS value
              FROM (SELECT *, {_day('date_text', 'year')} AS transaction_date,
                           coalesce({_value('debit_text')}, 0) AS debit,
                           coalesce({_value('credit_text')}, 0) AS credit
                    FROM word_lines))
        WHERE date_text <> '' AND desc_text <> '' AND transaction_date IS NOT NULL
          AND NOT regexp_matches(desc_text, '{_SKIP}')"""),
    "p8_detect_profile": over("profiles")("SELECT * FROM profiles"),
    "p11_parse_quality": over("quality")("SELECT * FROM quality"),
    "p12_recommend_parser": over("quality")("""
        SELECT file, arg_max(parser_id, rows * 1000000 - skipped_rows * 1000
                 - list_position(['pdfplumber_table', 'camelot_stream', 'pdfplumber_text',
                                  'tesseract', 'ofx_parser'], parser_id)) AS recommended,
               max(rows) AS max_rows
        FROM quality GROUP BY file"""),
}
