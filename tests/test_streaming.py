from __future__ import annotations

import shutil

import pytest
from pyspark.sql import functions as F

from tallybook import schemas
from tallybook.operators import dedup
from tallybook.plans.uploads import good_rows
from tallybook.session import cut_lineage
from tallybook.sources import derived
from tallybook.sources.csv_files import scan_csv
from tallybook.sources.ledger_store import TableStore, publish
from tallybook.streaming import imports
from tallybook.streaming.imports import Books, import_files, stream_import

ONE = ("﻿Date,Description,Amount,Card No.\n2022-03-14,Corner Bakery,31.40,1234\n"
       '06/06/2023,"Shop, ""A""\nsecond line","1,000.50",1234\n\n'
       "bad date,X,1.00,1234\n06/08/2023,PAYMENT THANK YOU,-20.00,1234\n")
TWO = "Posting Date,Details,Withdrawal,Deposit\n2023-06-09,Cafe,3.50,\n2023-06-09,Pay,,7.00\n"
NONE = "col1,col2\n1,2\n"


def _write(folder, **files):
    folder.mkdir(parents=True, exist_ok=True)
    for name, text in files.items():
        (folder / f"{name}.csv").write_text(text, encoding="utf-8")


def test_scan_csv(spark, tmp_path):
    _write(tmp_path, one=ONE, two=TWO, none=NONE)
    scan = scan_csv(spark, [str(tmp_path)])
    rows = {(r["source_file"], r["row_no"]): r for r in scan.rows.collect()}
    assert sorted(rows) == [("one.csv", n) for n in (2, 3, 4, 5)] + [
        ("two.csv", n) for n in (2, 3)]
    assert rows[("one.csv", 3)]["merchant_raw"] == 'Shop, "A"\nsecond line'
    assert [r["source_file"] for r in scan.rejected.collect()] == ["none.csv"]
    assert scan.headers["two.csv"].display()["amount"] == "Withdrawal / Deposit"


def _books(spark, folder):
    return Books.at(spark, str(folder))


def test_stream_import_and_replay(spark, tmp_path):
    inbox, books = tmp_path / "inbox", _books(spark, tmp_path / "books")
    _write(inbox, one=ONE)

    def drain():
        stream_import(spark, str(inbox), books, str(tmp_path / "progress"),
                      files_per_batch=1).awaitTermination()

    drain()
    first = {(r["merchant_name"], r["amount"], r["transaction_type"])
             for r in books.ledger.read().collect()}
    assert first == {("Corner Bakery", 31.4, "expense"),
                     ('Shop, "A"\nsecond line', 1000.5, "expense"),
                     ("PAYMENT THANK YOU", 20.0, "transfer")}
    # a new file, and the first one sent again under another name
    _write(inbox, two=TWO)
    shutil.copy(inbox / "one.csv", inbox / "again.csv")
    drain()
    rows = books.ledger.read()
    assert rows.count() == 5 and rows.select("id").distinct().count() == 5
    batches = {r["filename"]: (r["imported_rows"], r["skipped_rows"])
               for r in books.batches.read().collect()}
    assert batches == {"one.csv": (3, 0), "two.csv": (2, 0), "again.csv": (0, 3)}
    drain()
    assert books.ledger.read().count() == 5


def test_repeated_batch_adds_nothing(spark, tmp_path):
    _write(tmp_path / "in", two=TWO)
    books = _books(spark, tmp_path / "books")
    for _ in range(2):
        import_files(spark, [str(tmp_path / "in")], books, "batch-0")
    assert books.ledger.read().count() == 2
    assert [(r["imported_rows"], r["skipped_rows"]) for r in books.batches.read().collect()] == [
        (2, 0)]


def test_file_names_with_special_characters(spark, tmp_path):
    names = ["stmt [1]", "50% off", "a+b{c}"]
    _write(tmp_path, **{n: TWO for n in names})
    scan = scan_csv(spark, [str(tmp_path)])
    assert {r["source_file"] for r in scan.rows.collect()} == {f"{n}.csv" for n in names}
    assert set(scan.headers) == {f"{n}.csv" for n in names}


TABLES = ("ledger", "accounts", "categories", "batches", "keys", "rejects")
BROKEN = "Date,Description,Amount,Card No.\nno day,Kiosk,4.10,77\n2022-02-03,Baker,5.20,77\n"


def _contents(books):
    return {name: sorted(map(str, (r.drop("created_at") if "created_at" in r.columns else r)
                             .collect()))
            for name in TABLES for r in [getattr(books, name).read()]}


def test_an_import_that_breaks_off_anywhere_is_completed_by_a_replay(
        spark, tmp_path, monkeypatch):
    """One import loses its driver before each of its writes in turn, then runs through."""
    _write(tmp_path / "in", two=TWO, broken=BROKEN, none=NONE)

    def run(books):
        import_files(spark, [str(tmp_path / "in")], books, "batch-1")

    whole, books = _books(spark, tmp_path / "whole"), _books(spark, tmp_path / "books")
    run(whole)
    made = {}
    commit = imports.commit_import

    def once(*args, **kwargs):  # the books do not change between the attempts, nor does this
        if not made:
            made["result"] = commit(*args, **kwargs)
        return made["result"]

    def crash(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(imports, "commit_import", once)
    for broken in (*TABLES, "publish"):
        with monkeypatch.context() as patch:
            if broken == "publish":
                patch.setattr(imports, "publish", crash)
            else:
                store = getattr(books, broken)
                real = store.stage

                def half(rows, batch, real=real):  # some rows are written, then the driver is lost
                    real(rows.limit(1), batch)
                    crash()

                patch.setattr(store, "stage", half)
            with pytest.raises(RuntimeError):
                run(books)
        assert books.ledger.published().isEmpty() and books.ledger.read().isEmpty()
    assert not any(_contents(books).values())
    run(books)
    assert _contents(books) == _contents(whole)
    run(books)
    assert _contents(books) == _contents(whole)


def test_rejected_files_and_rows_are_stored_once(spark, tmp_path):
    _write(tmp_path / "in", broken=BROKEN, none=NONE)
    books = _books(spark, tmp_path / "books")
    for _ in range(2):
        import_files(spark, [str(tmp_path / "in")], books, "t")
    found = {(r["source_file"], r["message"].split(":")[0]) for r in books.rejects.read().collect()}
    assert found == {("broken.csv", "Row 2"),
                     ("none.csv", "Unrecognized CSV format")}
    assert books.rejects.read().count() == 2 and books.ledger.read().count() == 1
    _write(tmp_path / "none", none=NONE)
    import_files(spark, [str(tmp_path / "none")], books, "u")
    assert books.rejects.read().count() == 3


def _files(folder):
    return {str(p) for p in folder.rglob("*.parquet")}


def test_a_change_rewrites_its_months_only(spark, sf_dir, tmp_path):
    books = _books(spark, tmp_path)
    books.open_with(derived.ledger(spark, sf_dir), derived.accounts(spark, sf_dir),
                    derived.categories(spark, sf_dir))
    before, rows = _files(tmp_path / "ledger"), books.ledger.read().count()
    one = books.ledger.read().orderBy("id").first()
    ids = spark.createDataFrame([(one["id"],)] * 2, "id long")  # repeated ids count once
    books.change(ids, lambda r: r.withColumn("notes", F.lit("seen")))
    after = _files(tmp_path / "ledger")
    assert {p.split("ym=")[1][:7] for p in before ^ after} == {one["ym"]}
    assert books.ledger.read().count() == rows
    assert books.ledger.read().filter("notes = 'seen'").count() == 1
    # deleting a whole month empties it, for readers and for the duplicate check
    month = books.ledger.read().filter(F.col("ym") == one["ym"])
    gone, held = month.count(), cut_lineage(month.select("id"))
    books.change(held, lambda r: r.limit(0))
    assert books.ledger.read().count() == rows - gone
    assert books.keys.read().join(held, "id").isEmpty()
    assert books.ledger.read().filter(F.col("ym") == one["ym"]).isEmpty()


def test_stored_keys_equal_the_ledger_and_prune(spark, sf_dir):
    keyed = cut_lineage(dedup.keyed_upload(good_rows(spark, sf_dir),
                                           derived.accounts(spark, sf_dir)).filter(
        "statement_date < '1995-03-01'"))
    ledger, keys = derived.ledger(spark, sf_dir), derived.ledger_keys(spark, sf_dir)
    found = dedup.ledger_duplicates(keyed, ledger, keys)
    assert sorted(found.collect()) == sorted(dedup.ledger_duplicates(keyed, ledger).collect())
    assert not found.isEmpty()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert any("ym#" in part.split("]")[0] for part in plan.split("PartitionFilters: [")[1:])
    assert "merchant_name" not in plan


def test_replace_keeps_published_batches_out(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "t"), schemas.ACCOUNTS)
    rows = spark.createDataFrame([(i, None, "a", None, None) for i in range(4)], schemas.ACCOUNTS)
    store.append(rows.filter("id < 2"))
    store.stage(rows.filter("id = 2"), "x")
    assert store.read().count() == 2
    publish("token", "x", [store])
    assert store.read().count() == 3
    store.replace(rows.filter("id = 3"))
    assert [r["id"] for r in store.read().collect()] == [3]
