"""OFX files read in splits against the same texts read whole."""

from __future__ import annotations

import pytest

from tallybook import schemas
from tallybook.operators import statements as op
from tallybook.sources.csv_files import literal_path
from tallybook.sources.ofx_files import _records, scan_ofx_files
from tallybook.streaming.imports import Books, import_files, stream_import

SMALL = {"spark.sql.files.maxPartitionBytes": "600", "spark.sql.files.openCostInBytes": "0"}


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in SMALL}
    for key, value in SMALL.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def _transaction(n):
    memo = f"<MEMO>memo {n}\n" if n % 3 else ""
    return (f"<STMTTRN><TRNTYPE>{'CREDIT' if n % 4 else 'DEBIT'}\n<DTPOSTED>202401{1 + n % 28:02d}\n"
            f"<TRNAMT>{'odd' if n % 13 == 5 else n - 20}.5\n<FITID>{n}\n<NAME>Café &amp; {n}\n{memo}"
            "</STMTTRN>\n")


def _texts():
    """Files with many statements, with one long one, with none, and with odd edges."""
    many, n = "OFXHEADER:100\n<OFX>", 0
    for k in range(9):
        kind = "CC" if k % 2 else ""
        many += f"<{kind}STMTRS>" + ("", "<CURDEF>USD\n", "<CURDEF>EUR\n")[k % 3] + "<BANKTRANLIST>"
        for _ in range((0, 1, 7)[k % 3]):
            many += _transaction(n)
            n += 1
        many += f"</BANKTRANLIST></{kind}STMTRS>\n" + "filler " * (60 if k == 4 else 0)
    long = "<OFX><STMTRS><CURDEF>GBP\n" + "".join(map(_transaction, range(40))) + "</STMTRS></OFX>"
    outside = ("<OFX>" + _transaction(1) + "<STMTRS>" + _transaction(2) + "</STMTRS>"
               + _transaction(3) + "</OFX>")
    return {"many [1].ofx": many + "</OFX>", "long+a.ofx": long, "outside.ofx": outside,
            "none.ofx": "<OFX></OFX>", "empty.ofx": ""}


def _rows(df):
    names = sorted(c for c in df.columns if c != "path")
    return sorted((tuple(map(str, r)) for r in df.select(*names).collect()))


def test_split_files_read_like_whole_texts(spark, small_splits, tmp_path):
    texts = _texts()
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    paths = [literal_path(str(tmp_path / name)) for name in texts]
    whole = op.scan_ofx(spark.createDataFrame(list(texts.items()), schemas.OFX_FILES), "CHF")
    splits = _records(spark, paths).groupBy("file").agg({"split": "max"}).collect()
    assert max(r[1] for r in splits) > 2000  # the long files are cut several times
    found = scan_ofx_files(spark, paths, "CHF")
    assert _rows(found) == _rows(whole) and len(_rows(found)) == 24 + 40 + 1
    assert {r["currency"] for r in found.collect()} == {"USD", "EUR", "GBP", "CHF"}


def test_transactions_without_end_are_left_out_and_open_statements_count(spark, tmp_path):
    text = "<STMTRS><CURDEF>USD\n<STMTTRN><NAME>lost\n" + _transaction(1) + _transaction(2)
    (tmp_path / "a.ofx").write_text(text)
    found = scan_ofx_files(spark, [str(tmp_path / "a.ofx")]).orderBy("position").collect()
    assert [(r["reference_number"], r["position"], r["currency"]) for r in found] == [
        ("1", 0, "USD"), ("2", 1, "USD")]


def test_csv_and_ofx_in_one_import(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.csv").write_text("Date,Description,Amount\n2024-03-01,Bakery,3.50\n")
    texts = _texts()
    (inbox / "b [1].OFX").write_bytes(texts["many [1].ofx"].encode())
    paths = [literal_path(str(p)) for p in sorted(inbox.iterdir())]
    books = Books.at(spark, str(tmp_path / "books"))
    for _ in range(2):  # the second call repeats a published token
        import_files(spark, paths, books, "t", default_currency="CHF")
    rows = books.ledger.read().collect()
    odd = [n for n in range(24) if n % 13 == 5]
    assert len(rows) == 1 + 24 - len(odd) and len({r["id"] for r in rows}) == len(rows)
    assert {r["currency"] for r in rows} == {"CHF", "USD", "EUR"}
    errors = books.rejects.read().collect()
    assert {r["source_file"] for r in errors} == {"b [1].OFX"} and len(errors) == len(odd)
    assert all("bad amount in statement" in r["message"] for r in errors)
    # the same file under another name adds nothing, a new one its rows; both found by the stream
    (inbox / "c.ofx").write_bytes(texts["many [1].ofx"].encode())
    (inbox / "d.qfx").write_bytes(texts["outside.ofx"].replace("<FITID>2", "<FITID>902").encode())
    stream_import(spark, str(inbox), books, str(tmp_path / "progress"),
                  default_currency="CHF").awaitTermination()
    assert books.ledger.read().count() == len(rows) + 1
