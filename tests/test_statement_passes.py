"""Statement readers: input is gathered, split and parsed once, in generated code."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallybook import schemas
from tallybook.functions.dates import first_line, read_statement_date
from tallybook.functions.text import WHITE_SPACE, stripped, trimmed
from tallybook.operators import statements as op
from tallybook.sources import derived
from tests.helpers import day
from tests.test_plans import _plan

AS_OF = date(2026, 8, 1)


def test_stripped_is_trimmed(spark):
    texts = [None, "", "a", "~", "!", "é", *[f"{w}a b{w}" for w in WHITE_SPACE],
             *[f"a{w}" for w in WHITE_SPACE], *[f"{w}é" for w in WHITE_SPACE]]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert frame.filter(~stripped("t").eqNullSafe(trimmed(F.col("t")))).count() == 0


def test_dates_by_first_and_last_character(spark):
    cases = {"2023-06-05": "2023-06-05", "6/5/2023": "2023-06-05", "13/5/2023": "2023-05-13",
             "June 5, 2023": "2023-06-05", "jun 5 2023": "2023-06-05", "5 Jun 2023": "2023-06-05",
             "06/05": "2001-06-05", "Jun5": "2001-06-05", "5-Jun": "2001-06-05",
             "JUN052023": "2023-06-05", "June 5": None, "5.06": None, "Jun 5.": None, "5 June": None,
             "٥ Jun": None, "Jun ٥": None, "": None, "x": None, "Feb 30 2023": None}
    frame = spark.createDataFrame([(t,) for t in cases], "t string")
    got = {r["t"]: r["d"] for r in frame.select(
        "t", read_statement_date(F.col("t"), F.lit(2001)).alias("d")).collect()}
    assert got == {t: day(d) for t, d in cases.items()}
    lines = spark.createDataFrame([("Jun 5 \nposted",), ("Jun 5",)], "t string")
    assert [r[0] for r in lines.select(first_line(F.col("t"))).collect()] == ["Jun 5", "Jun 5"]


def test_dates_of_cells_stay_in_generated_code(spark, sf_dir):
    assert "lambda" not in _plan(entry.queries()["p3_statement_date"](spark, sf_dir))


def test_line_items_are_numbered_once(spark, sf_dir):
    derived.upload_lines(spark, sf_dir)
    assert "Window" not in _plan(derived.upload_lines(spark, sf_dir))


def test_several_readers_share_one_pass(spark):
    lines = spark.createDataFrame(
        [("a.pdf", i, t) for i, t in enumerate((
            "since 2017", "Jun 5 REFUND SHOP 4.00 9.00", "Jun\n5 CAFE 1.00", "Jun 6 GAS",
            "  7.00 ", "Jun 7 none", None, "Jun 8 X.Y CR 3.00"), 1)], schemas.STATEMENT_LINES)
    readers = {"one": {}, "two": {"two_amounts": False, "credit_words": None}}
    both = op.read_lines(lines, AS_OF, readers)
    for name, options in readers.items():
        alone = op.extract_lines(lines, AS_OF, **options)
        mine = both.filter(F.col("parser_id") == name).select(alone.columns)
        assert sorted(map(str, mine.collect())) == sorted(map(str, alone.collect()))
    got = {(r["line_no"], r["parser_id"]): (r["merchant_name"], r["signed"], r["error"])
           for r in both.collect()}
    assert got[2, "one"] == ("REFUND SHOP", -4.0, None)
    assert got[2, "two"] == ("REFUND SHOP 4.00", 9.0, None)
    assert got[3, "one"] == ("CAFE", 1.0, "bad date Jun\n5")
    assert got[4, "one"] == got[4, "two"] == ("GAS", 7.0, None)
    assert got[6, "one"] == ("none", None, "no amount found")
    assert got[8, "two"] == ("X.Y CR", -3.0, None)


def test_words_are_gathered_once(spark):
    words = spark.createDataFrame(
        [("a.pdf", 1, t, x, y) for y, row in ((8.0, [("ACME", 30.0), ("2019", 90.0)]), (40.0, [
            ("D-ate", 36.0), ("Description", 110.0), ("Amount", 316.0)]), (60.0, [
                ("Jun", 36.0), ("05", 56.0), ("SHOP", 140.0), ("1.00", 320.0)])) for t, x in row],
        schemas.STATEMENT_WORDS)
    lines = op.word_lines(words)
    assert op.word_lines(lines) is lines
    stored = lines.localCheckpoint()
    profiles = op.detect_profile(stored, AS_OF)
    inferred = op.infer_layout(stored, profiles)
    both = op.both_layouts(stored, profiles, inferred)
    assert "collect_list" not in _plan(both)
    assert [r["from_page"] for r in inferred.collect()] == [1]
    got = op.read_statements(words, AS_OF).collect()
    assert [(r["merchant_name"], r["signed"], r["transaction_date"]) for r in got] == [
        ("SHOP", 1.0, day("2019-06-05"))]
