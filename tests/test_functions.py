from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tallybook.functions import dates, money, text
from tallybook.operators.ingest import resolve_header
from tallybook.operators.statements import skip_row
from tests.helpers import day


def _column(spark, values, use):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v string")
    return [r[0] for r in df.select("i", use(F.col("v")).alias("o")).orderBy("i")
            .select("o").collect()]


def test_statement_dates(spark):
    cases = {"2018-10-09": "2018-10-09", "10/29/2018": "2018-10-29", "10/29": "2023-10-29",
             "Oct 9 2018": "2018-10-09", "Oct 9": "2023-10-09", "28 Apr": "2023-04-28",
             "3-Dec": "2023-12-03", "AUG08": "2023-08-08", "AUG082017": "2017-08-08",
             "November 21, 2016": "2016-11-21", "Oct 9\nposted": "2023-10-09", "": None,
             "soon": None, "04/31": None, "April 28": None, "25/11/2019": "2019-11-25",
             "Oct\u00a09": "2023-10-09", "28\u00a0Apr\u00a02018": "2018-04-28"}
    got = _column(spark, cases, lambda c: dates.parse_statement_date(c, F.lit(2023)))
    assert got == [day(v) for v in cases.values()]


def test_csv_dates_prefer_month_first(spark):
    cases = {"01/02/2023": "2023-01-02", "13/2/2023": "2023-02-13", "2023/1/2": "2023-01-02",
             "1-2-2023": "2023-01-02", "Jan 2, 2023": "2023-01-02", "2 January 2023": "2023-01-02",
             "20230102": "2023-01-02", "Jan 2 2023": None, "2023-13-01": None, " 2023-01-02 ":
             "2023-01-02", "01/02/23": None}
    assert _column(spark, cases, dates.parse_date) == [day(v) for v in cases.values()]


def test_amounts(spark):
    cases = {"": 0.0, "5d": None, "-8.15": -8.15, "$(5)": None, "(3.75)": -3.75, "N/A": None,
             "62,017.40": 62017.4, "  0.07": 0.07, "$18.20": 18.2}
    assert _column(spark, cases, money.parse_amount) == list(cases.values())
    cases = {"": None, "N/A": None, "$(5)": -5.0, "(1,0.5)": -10.5, "7": 7.0}
    assert _column(spark, cases, money.parse_statement_amount) == list(cases.values())


def test_split_amount_takes_debit_else_minus_credit(spark):
    df = spark.createDataFrame([("5", "", 5.0), ("", "7", -7.0), ("0", "2", -2.0),
                                ("x", "2", None)], "d string, c string, e double")
    got = df.select(money.split_amount(F.col("d"), F.col("c")), "e").collect()
    assert all(a == b for a, b in got)


def test_match_text_folds_unicode(spark):
    values = ["A&W  Café #12_x", "Straße ﬁ", None, "７-Eleven"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = {r["v"]: r["o"] for r in text.with_match_text(df, "v", "o").collect()}
    assert got == {"A&W  Café #12_x": "a w café 12 x", "Straße ﬁ": "strasse fi", None: "",
                   "７-Eleven": "7 eleven"}


@pytest.mark.parametrize("phrase", [
    "Opening Balance", "Closing Balance", "Balance Forward", "Previous Balance", "New Balance",
    "Starting Balance", "Total", "Subtotal", "Minimum Payment", "Credit Limit",
    "Available Credit", "Statement Date", "Payment Due", "Brought Forward", "NEWBALANCE",
    "credit limit"])
def test_skipped_rows(spark, phrase):
    assert _column(spark, [phrase], skip_row) == [True]


def test_kept_rows(spark):
    kept = ["Harbour Bakery", "Totally Fresh", "Closings Ltd", "My statement date"]
    assert _column(spark, kept, skip_row) == [False] * 4


def test_integer_rounding(spark):
    df = spark.createDataFrame([(1, 3), (1, 6), (2, 3), (0, 0)], "a long, b long")
    got = [r[0] for r in df.select(money.tenths_of_percent(F.col("a"), F.col("b"))).collect()]
    assert got == [33.3, 16.7, 66.7, 0.0]
    assert math.isclose(df.select(money.average_cents(F.lit(100).cast("long"), 6)).first()[0], 17)


def test_header_resolution():
    header = resolve_header(["Posting Date", " trans. date ", "Memo", "Withdrawal", "Deposits"])
    assert header.fields["date"] == " trans. date " and header.fields["debit"] == "Withdrawal"
    assert header.display()["amount"] == "Withdrawal / Deposits"
    assert resolve_header(["Date", "Memo"]) is None
    assert resolve_header(["date", "DATE", "Amount"]).fields["date"] == "DATE"


def test_month_filters():
    assert dates.parse_months("2026-01, bad,2025-12,2026-13") == [
        day("2026-01-01"), day("2025-12-01")]
    assert dates.month_ranges(dates.parse_months("2026-01,2025-12,2026-03")) == [
        (day("2025-12-01"), day("2026-02-01")), (day("2026-03-01"), day("2026-04-01"))]
    assert dates.parse_month("2026") is None
