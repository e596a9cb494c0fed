from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tallybook import schemas
from tallybook.operators import statements as op
from tests.helpers import day

AS_OF = date(2026, 8, 1)


def _words(spark, *lines, file="a.pdf"):
    """lines: (page, top, [(x0, text), ...])"""
    rows = [(file, page, text, float(x), float(top)) for page, top, ws in lines for x, text in ws]
    return spark.createDataFrame(rows, schemas.STATEMENT_WORDS)


def _profile(spark, *texts):
    lines = [(1, 12 * i, [(10 * j, w) for j, w in enumerate(t.split())])
             for i, t in enumerate(texts)]
    return op.detect_profile(_words(spark, *lines), AS_OF).first()


def test_chequing_header_wins_over_later_phrases(spark):
    rank = {name: i for i, (name, _, _) in enumerate(schemas.LAYOUTS)}
    phrase = {name: phrases[0] for name, phrases, _ in schemas.LAYOUTS}
    early, late = sorted(("RBC Chequing", "Scotiabank"), key=rank.get)[:2]
    got = _profile(spark, f"Page of {phrase[late]}", f"Issued 2011 by {phrase[early]}")
    assert got["profile"] == early and got["year"] == 2011


def test_card_header_wins_over_bank_footer(spark):
    name, phrases, _ = schemas.LAYOUTS[0]
    got = _profile(spark, f"Your {phrases[0]} account", f"footer {schemas.LAYOUTS[1][1][0]}")
    assert got["profile"] == name and got["recognised"]


def test_unknown_header_takes_first_layout(spark):
    got = _profile(spark, "Some credit union")
    assert got["profile"] == "TD Visa" and not got["recognised"] and got["year"] == 2026


def test_layout_and_year_are_sought_on_every_page(spark):
    name, phrases, _ = schemas.LAYOUTS[2]
    far = [(1, 12, [(30, "cover")]), (3, 12, [(10 * i, w) for i, w in enumerate(
        f"{phrases[0]} 2015".split())]), *[(3, 24 + 8 * i, [(30, "x" * 90)]) for i in range(30)]]
    late = _words(spark, (3, 12, [(30, "word")]), file="b.pdf")
    got = {r["file"]: r for r in op.detect_profile(
        _words(spark, *far).unionByName(late), AS_OF).collect()}
    assert (got["a.pdf"]["profile"], got["a.pdf"]["year"]) == (name, 2015)
    assert not got["b.pdf"]["recognised"] and got["b.pdf"]["year"] == 2026


def test_statement_that_starts_on_page_three(spark):
    words = _words(spark, *[(3, 60 + 12 * i, [(36, "Jun"), (52, f"{5 + i:02d}"), (140, "SHOP"),
                                              (320, amount)])
                            for i, amount in enumerate(("1.00", "4.00"))])
    got = op.read_statements(words, AS_OF).orderBy("y").collect()
    assert [r["signed"] for r in got] == [1.0, 4.0]


def test_year_and_lines_without_limits(spark):
    lines = _lines(spark, "x" * 1500, *["filler"] * 1200, "since 2017",
                   "Jun\u00a05\u00a0HARBOUR\u00a0BAKERY 4.00")
    assert op.infer_year(lines, AS_OF).first()["year"] == 2017
    got = op.extract_lines(lines, AS_OF).filter("error is null").collect()
    assert [(r["signed"], r["transaction_date"]) for r in got] == [(4.0, day("2017-06-05"))]


def _lines(spark, *texts):
    return spark.createDataFrame([("a.pdf", i, t) for i, t in enumerate(texts, 1)],
                                 schemas.STATEMENT_LINES)


def test_statement_lines(spark):
    lines = _lines(spark, "Statement 2023", "Jun 5 TIM HORTONS 45.67", "06/06 06/07 NETFLIX 9.99 "
                   "1,000.00", "Jun 7 OPENING BALANCE 3.00", "7 Jun REFUND SHOP 5.00",
                   "Jun 8 GAS STATION", "  20.00", "Jun 9 no amount here", "text", "Jun 10 X 1.00 CR")
    got = [(r["merchant_name"], r["signed"], r["error"]) for r in op.extract_lines(
        lines, AS_OF).orderBy("line_no").collect()]
    assert got == [("TIM HORTONS", 45.67, None), ("NETFLIX", 9.99, None),
                   ("REFUND SHOP", -5.0, None), ("GAS STATION", 20.0, None),
                   ("no amount here", None, "no amount found"), ("X", -1.0, None)]


def _page(page, offset, rows):
    return [(page, 60 + 12 * i, [(36 + offset, "Jun"), (52 + offset, f"{5 + i:02d}"),
                                 (110 + offset, "SHOP"), (x + offset, amount)])
            for i, (x, amount) in enumerate(rows)]


def test_inferred_layout_is_carried_while_it_wins(spark):
    """Shifted pages are read with the header's columns; a page they do not fit falls back."""
    header = (1, 40, [(136, "Date"), (210, "Description"), (475, "Withdrawals"),
                      (545, "Deposits")])
    shifted = [(380, "1.00"), (450, "2.00")]
    words = _words(spark, (1, 8, [(30, "Scotiabank"), (90, "2023")]), header,
                   *_page(1, 100, shifted), *_page(2, 100, shifted),
                   *_page(3, 0, [(380, "1.00"), (460, "2.00")]),
                   *_page(4, 100, shifted))
    profiles = op.detect_profile(words, AS_OF)
    inferred = op.infer_layout(words, profiles)
    assert [r["from_page"] for r in inferred.orderBy("page").collect()] == [1, 1, 1, 1]
    both = op.both_layouts(words, profiles, inferred)
    kinds = [r["kind"] for r in op.best_layout(both, inferred).orderBy("page").collect()]
    assert kinds == ["inferred", "inferred", "fixed", "fixed"]
    got = op.read_statements(words, AS_OF).orderBy("page", "y").collect()
    assert [(r["page"], r["signed"]) for r in got] == [
        (1, 1.0), (1, -2.0), (2, 1.0), (2, -2.0), (3, 1.0), (3, -2.0)]


def test_table_cells(spark):
    rows = [["Date", "Payee", "Debit", "Credit"], ["Jun 5 2023\nx", "TIM\nHORTONS", "4.50", ""],
            ["2023-06-06", "PAY", "", "$9.00"], ["", "", "", ""], ["2023-06-07", "Total", "1", ""],
            ["bad", "Z", "1", ""], ["2023-06-08", "short"]]
    cells = spark.createDataFrame([("a.pdf", 1, 0, i, c) for i, c in enumerate(rows)],
                                  schemas.STATEMENT_CELLS)
    years = spark.createDataFrame([("a.pdf", 2023)], "file string, year int")
    got = [(r["merchant_name"], r["signed"], r["error"]) for r in op.extract_cells(
        cells, years).orderBy("row_no").collect()]
    assert got[:2] == [("TIM HORTONS", 4.5, None), ("PAY", -9.0, None)]
    assert [g[2] for g in got[2:]] == ["bad date", "row too short"]
    kept = op.extract_cells(cells, years, one_line=False).orderBy("row_no").first()
    assert kept["merchant_name"] == "TIM\nHORTONS"
    bare = op.extract_cells(cells.filter("row_no > 0"), years.limit(0))
    assert {r["error"] for r in bare.collect()} == {"table not recognised"}


def test_cell_dates_take_the_year_of_their_file(spark):
    lines = spark.createDataFrame(
        [("a.pdf", 1, "no year"), ("a.pdf", 2, "Period to 2031"), ("b.pdf", 1, "nothing")],
        "file string, line_no int, text string")
    head = ["Posted Date", "Transaction Description", "Amount"]
    cells = spark.createDataFrame(
        [(f, 1, 0, i, c) for f in ("a.pdf", "b.pdf", "c.pdf") for i, c in enumerate(
            [head, ["Mar 09", "Lamp", "7.25"], ["Mar 9, 2019", "Desk", "81.00"]])],
        schemas.STATEMENT_CELLS)
    got = op.extract_cells(cells, op.infer_year(lines, day("2024-05-06"))).orderBy(
        "file", "row_no").collect()
    assert [(r["file"], r["transaction_date"], r["error"]) for r in got] == [
        ("a.pdf", day("2031-03-09"), None), ("a.pdf", day("2019-03-09"), None),
        ("b.pdf", day("2024-03-09"), None), ("b.pdf", day("2019-03-09"), None),
        ("c.pdf", None, "bad date"), ("c.pdf", day("2019-03-09"), None)]


def test_ofx(spark):
    text = ("<OFX><STMTRS><CURDEF>CAD<STMTTRN><TRNTYPE>DEBIT<DTPOSTED>20230605120000"
            "<TRNAMT>-45.67<FITID>1<NAME>Tim Hortons</STMTTRN><STMTTRN><TRNTYPE>DIRECTDEP"
            "<DTPOSTED>20230606<TRNAMT>2000.00<FITID>2<NAME>ACME<MEMO>PAYROLL</STMTTRN>"
            "<STMTTRN><TRNTYPE>PAYMENT<DTPOSTED>20230607<TRNAMT>-10<FITID>3<NAME>CARD &amp; CO"
            "</STMTTRN></STMTRS></OFX>")
    files = spark.createDataFrame([("a.ofx", text)], schemas.OFX_FILES)
    got = [(r["merchant_name"], r["amount"], r["transaction_type"], r["transaction_date"])
           for r in op.scan_ofx(files, "USD").orderBy("position").collect()]
    assert got == [("Tim Hortons", 45.67, "expense", day("2023-06-05")),
                   ("ACME PAYROLL", 2000.0, "income", day("2023-06-06")),
                   ("CARD & CO", 10.0, "transfer", day("2023-06-07"))]
    parsed = op.run_parsers({"ofx_parser": op.scan_ofx(files)})
    assert op.parse_quality(parsed).first()["confidence"] == 0.95


def test_recommendation_prefers_rows_then_fewer_skipped_then_order(spark):
    quality = spark.createDataFrame(
        [("a", "ocr", 5, 1, False), ("a", "tabula", 5, 0, False), ("a", "tesseract", 5, 0, False),
         ("a", "camelot_lattice", 9, 0, True), ("b", "ocr", 0, 0, True)],
        "file string, parser_id string, rows long, skipped_rows long, missing_dependency boolean")
    got = {r["file"]: (r["recommended"], r["max_rows"])
           for r in op.recommend_parser(quality).collect()}
    assert got == {"a": ("tabula", 9), "b": ("ocr", 0)}
