"""Properties of physical plans that matter at scale."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry


def _plan(df) -> str:
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", 10000)
    return df._jdf.queryExecution().executedPlan().toString()


LEDGER_QUERIES = [n for n in entry.queries() if n[0] in "abklmrv" and n[1].isdigit()]


@pytest.mark.parametrize("name", LEDGER_QUERIES)
def test_no_pairwise_join(spark, sf_dir, name):
    plan = _plan(entry.queries()[name](spark, sf_dir))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_month_filter_reaches_the_scan(spark, sf_dir):
    plan = _plan(entry.queries()["l2_months_filter"](spark, sf_dir))
    assert "GreaterThanOrEqual(transaction_date" in plan


def test_summary_reads_only_its_columns(spark, sf_dir):
    plan = _plan(entry.queries()["l10_summary"](spark, sf_dir))
    schema = plan.split("ReadSchema: struct<")[1].split(">")[0]
    assert {c.split(":")[0] for c in schema.split(",")} == {
        "user_id", "amount_cents", "transaction_type", "is_excluded"}


def test_large_expenses_have_no_window(spark, sf_dir):
    assert "Window" not in _plan(entry.queries()["l12_large_expenses"](spark, sf_dir))
