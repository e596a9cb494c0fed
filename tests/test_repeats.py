"""Repeated keys never multiply rows; folded keywords can be removed."""

from __future__ import annotations

import datetime

from tallybook import schemas
from tallybook.operators import dedup, keywords, recurring
from tallybook.sources import derived


def test_repeated_states_of_a_row_keep_one(spark):
    checked = spark.createDataFrame([(1, True, False), (2, True, True)],
                                    "row_idx long, duplicate boolean, exclude boolean")
    before = spark.createDataFrame([(1, True, False), (1, True, True), (1, True, True)],
                                   "row_idx long, duplicate boolean, exclude boolean")
    out = dedup.default_exclude(checked, before).collect()
    assert sorted((r["row_idx"], r["exclude"]) for r in out) == [(1, True), (2, True)]


def test_repeated_periods_of_a_file_keep_its_rows(spark):
    kind = "user_id string, source_file string, month int, year int"
    rows = spark.createDataFrame([(1, None, "a")], "row_idx long, user_id string, "
                                                   "source_file string")
    found = spark.createDataFrame([(None, "a", 1, 2020)] * 2, kind)
    chosen = spark.createDataFrame([(None, "a", 3, 2021), (None, "a", 2, 2022)], kind)
    out = dedup.assign_period(rows, found, chosen).collect()
    assert [(r["import_month"], r["import_year"]) for r in out] == [(2, 2022)]


def test_repeated_cuts_of_a_rule_keep_its_rows(spark, sf_dir):
    ledger, rules = derived.linked_rows(spark, sf_dir), derived.recurring_rules(spark, sf_dir)
    rule = rules.filter("end_date is null or end_date > start_date").first()
    late, early = (rule["start_date"] + datetime.timedelta(days=n) for n in (60, 30))
    kind = "id long, user_id string, from_date date"

    def after(*days):
        cuts = spark.createDataFrame([(rule["id"], rule["user_id"], d) for d in days], kind)
        return [sorted(map(str, t.collect()))
                for t in recurring.cut_rules(ledger, rules, cuts)]

    assert after(late, early, early, None) == after(early)


def test_folded_keywords_are_removed(spark):
    rows = [(1, "u", "a", "#000000", "Straße, ﬁx, plain")]
    names = [f.name for f in schemas.CATEGORIES.fields]
    given = dict(zip(("id", "user_id", "name", "color", "keywords"), rows[0]))
    categories = spark.createDataFrame([tuple(given.get(n) for n in names)], schemas.CATEGORIES)
    gone = spark.createDataFrame([("u", 1, "STRASSE"), ("u", 1, "fix")],
                                 "user_id string, category_id long, keyword string")
    assert [r["keywords"] for r in keywords.remove_keywords(categories, gone).collect()] == [
        "plain"]
