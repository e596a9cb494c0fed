"""Both sides of the derived tables; checked by the tests, not registered as queries."""

from __future__ import annotations

from oracle.tables import over
from tallybook.sources import derived

QUERIES = {
    "table_ledger": lambda s, d: derived.ledger(s, d).drop("created_at"),
    "table_dirty_ledger": lambda s, d: derived.dirty_ledger(s, d).drop("created_at"),
    "table_accounts": derived.accounts,
    "table_categories": derived.categories,
    "table_budget_rules": derived.budget_rules,
    "table_hidden_keys": derived.hidden_keys,
    "table_recurring_rules": derived.recurring_rules,
    "table_linked_rows": lambda s, d: derived.linked_rows(s, d).drop("created_at"),
    "table_rule_changes": derived.rule_changes,
    "table_raw_uploads": derived.raw_uploads,
    "table_ofx_files": derived.ofx_files,
}

SQL = {
    "table_ledger": over("ledger")("SELECT * EXCLUDE (created_at) FROM ledger"),
    "table_dirty_ledger": over("dirty")("SELECT * EXCLUDE (created_at) FROM dirty"),
    "table_accounts": over("accounts")("SELECT * FROM accounts"),
    "table_categories": over("categories")("SELECT * FROM categories"),
    "table_budget_rules": over("budget_rules")("SELECT * FROM budget_rules"),
    "table_hidden_keys": over("hidden")("SELECT * FROM hidden"),
    "table_recurring_rules": over("rules")("SELECT * FROM rules"),
    "table_linked_rows": over("linked")("SELECT * EXCLUDE (created_at) FROM linked"),
    "table_rule_changes": over("changes")("SELECT * FROM changes"),
    "table_raw_uploads": over("raw")("SELECT * FROM raw"),
    "table_ofx_files": over("ofx_files")("SELECT * FROM ofx_files"),
}
