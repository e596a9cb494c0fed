from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tallybook.operators import recurring as op
from tests.helpers import day, ledger, rules


def _dates(df, column="due_date"):
    return [r[0].isoformat() for r in df.orderBy(column).select(column).collect()]


def test_short_month_anchor(spark):
    rule = rules(spark, dict(start_date=day("2025-08-31")))
    assert _dates(op.expand_schedule(rule, day("2026-03-31"))) == [
        "2025-08-31", "2025-09-30", "2025-10-31", "2025-11-30", "2025-12-31", "2026-01-31",
        "2026-02-28", "2026-03-31"]


def test_back_to_day_29(spark):
    rule = rules(spark, dict(start_date=day("2025-01-29")))
    assert _dates(op.expand_schedule(rule, day("2025-04-30"))) == [
        "2025-01-29", "2025-02-28", "2025-03-29", "2025-04-29"]


def test_horizon_equals_last_date(spark):
    made = [dict(start_date=date(2020, 1, 1 + i), frequency=f, end_date=e)
            for i in range(0, 31, 3) for f in ("monthly", "weekly", "biweekly", "yearly")
            for e in (None, day("2020-02-29"), day("2019-01-01"))]
    frame = rules(spark, *made)
    as_of = day("2024-02-28")
    last = {r["id"]: r["m"] for r in op.expand_schedule(frame, as_of).groupBy("id").agg(
        F.max("due_date").alias("m")).collect()}
    assert {r["id"]: r["horizon"] for r in op.horizon(frame, as_of).collect()} == {
        i: last.get(i) for i in range(1, len(made) + 1)}


def _linked(spark, *days, rule=1):
    return ledger(spark, *[dict(transaction_date=day(d), recurring_rule_id=rule,
                                merchant_name="Rent", amount=10.0) for d in days])


def _change(spark, start, end, **options):
    base = dict(remove_overlap=False, backfill_missing=False, keep_overlap=False,
                skip_backfill=False)
    base.update(options)
    return spark.createDataFrame(
        [(1, None, day(start), "monthly", day(end), *base.values())],
        "id long, user_id string, start_date date, frequency string, end_date date, "
        + ", ".join(f"{k} boolean" for k in base))


def test_preview_overlap_and_missing(spark):
    rule = rules(spark, dict(start_date=day("2020-01-01")))
    rows = _linked(spark, "2020-01-01", "2020-02-01", "2020-03-01", "2020-04-01")
    got = op.preview_update(rule, _change(spark, "2020-02-01", "2020-05-01"), rows,
                            day("2020-05-20")).first()
    assert (got["overlap_count"], got["missing_count"]) == (1, 1)
    assert (got["first_missing"], got["horizon"]) == (day("2020-05-01"), day("2020-05-01"))


def test_backfill(spark):
    rule = rules(spark, dict(start_date=day("2020-01-01"), end_date=day("2020-04-01")))
    rows = _linked(spark, "2020-01-01", "2020-03-01", "2020-04-01")
    out, new_rules = op.apply_update(
        rule, _change(spark, "2019-12-01", "2020-04-01", backfill_missing=True), rows,
        day("2020-05-20"))
    assert _dates(out, "transaction_date") == [
        "2019-12-01", "2020-01-01", "2020-02-01", "2020-03-01", "2020-04-01"]
    assert new_rules.first()["last_created_date"] == day("2020-04-01")
    assert out.select("id").distinct().count() == 5


def test_shrink_removes_overlap(spark):
    rule = rules(spark, dict(start_date=day("2020-01-01"), end_date=day("2020-05-01")))
    rows = _linked(spark, "2020-01-01", "2020-02-01", "2020-03-01", "2020-04-01", "2020-05-01")
    out, _ = op.apply_update(
        rule, _change(spark, "2020-03-01", "2020-04-01", remove_overlap=True), rows,
        day("2020-05-20"))
    assert _dates(out, "transaction_date") == ["2020-03-01", "2020-04-01"]


def test_processing_twice_adds_nothing(spark):
    frame = rules(spark, dict(start_date=day("2024-01-31")),
                  dict(start_date=day("2024-05-01"), frequency="weekly"))
    empty = ledger(spark).limit(0)
    rows, moved, counts = op.process_due(frame, empty, day("2024-04-30"))
    assert rows.count() == 4 and rows.select("id").distinct().count() == 4
    assert counts.first()["rules_triggered"] == 1
    again, _, _ = op.process_due(moved, rows, day("2024-04-30"))
    assert again.count() == 0


def test_cut_drops_rule_that_would_end_before_it_starts(spark):
    frame = rules(spark, dict(start_date=day("2024-01-01"), last_created_date=day("2024-03-01")),
                  dict(start_date=day("2024-01-01")))
    rows = _linked(spark, "2024-01-01", "2024-02-01", "2024-03-01")
    cuts = spark.createDataFrame([(1, None, day("2024-02-15")), (2, None, day("2024-01-01"))],
                                 "id long, user_id string, from_date date")
    left, kept = op.cut_rules(rows, frame, cuts)
    assert _dates(left, "transaction_date") == ["2024-01-01", "2024-02-01"]
    only = kept.collect()
    assert [(r["id"], r["end_date"], r["last_created_date"]) for r in only] == [
        (1, day("2024-02-14"), day("2024-02-01"))]
