"""Plans and stored files that must not grow with the largest group."""

from __future__ import annotations

import os

from tallybook import schemas
from tallybook.operators import commit, dedup
from tallybook.session import cut_lineage, scratch, shared_folder
from tallybook.sources.ledger_store import TableStore
from tallybook.sources.statements import statement_lines
from tests import helpers as make


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _cuts(spark):
    return {f for f in os.listdir(shared_folder(spark).removeprefix("file:")) if f.startswith("cut-")}


def test_rows_of_a_batch_are_not_gathered_in_one_task(spark, tmp_path):
    store = TableStore(spark, f"{tmp_path}/ledger", schemas.LEDGER, "transaction_date")
    store.append(make.ledger(spark, dict(user_id="a"), dict(user_id=None)))
    assert "hashpartitioning(batch" not in _plan(store.read())
    assert store.read().count() == 2


def test_rows_are_not_dealt_by_user_for_the_default_card(spark):
    rows = make.upload(spark, dict(user_id="a", card_number_masked="1"), dict(user_id="a"),
                       dict(user_id=None))
    out = dedup.with_card(dedup.with_dedup_keys(rows))
    assert "SortMergeJoin" not in _plan(out)
    assert sorted((r["row_idx"], r["card"]) for r in out.collect()) == [
        (0, "1"), (1, "1"), (2, "")]


def test_a_commit_leaves_only_what_its_result_reads(spark):
    rows = make.upload(spark, dict(card_number_masked="1", row_idx=1))
    before = _cuts(spark)
    result = commit.commit_import(
        rows, make.ledger(spark), make.accounts(spark), make.categories(spark), token="t")
    assert result.new_rows.count() == 1 and result.new_accounts.count() == 1
    # accepted rows, new accounts and rows with their category
    assert len(_cuts(spark) - before) == 3


def test_a_table_kept_from_a_scratch_block_stays(spark):
    with scratch(spark) as lasting:
        first = cut_lineage(spark.range(3))
        kept = lasting(first)
        assert first.count() == 3
        inside = _cuts(spark)
    assert kept.count() == 3 and len(inside - _cuts(spark)) == 1


def test_statement_lines_order_their_lines_once(spark, sf_dir):
    """The heads of a file come from the pass that makes its rows."""
    lines = statement_lines.__wrapped__(spark, sf_dir)
    text = _plan(lines)
    assert text.count("row_number(") <= 2 and "Union" not in text
    first = lines.filter("line_no = 1")
    assert first.count() == lines.select("file").distinct().count()
