from __future__ import annotations

import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from tallybook.operators import commit, dedup
from tallybook.operators.duplicates import prune_duplicates, flag_duplicates
from tests.helpers import accounts, categories, day, ledger, upload


def _flags(df):
    return [(r["duplicate"], r["duplicate_in_import"], r["duplicate_in_database"])
            for r in df.orderBy("row_idx").collect()]


def test_refless_repeat_within_upload(spark):
    out = dedup.check_duplicates(upload(spark, {}, {}), ledger(spark).limit(0),
                                 accounts(spark))
    assert _flags(out) == [(False, False, False), (True, True, False)]


def test_refless_row_in_ledger_despite_spaces(spark):
    books = ledger(spark, dict(merchant_name="Amazon   Marketplace", account_id=1))
    held = accounts(spark, dict(id=1, name="Imported PDF", card_number_masked=""))
    out = dedup.check_duplicates(upload(spark, {}), books, held)
    assert _flags(out) == [(True, False, True)]


def _commit(spark, rows, books, held=None, names=None):
    return commit.commit_import(
        rows, books, held if held is not None else accounts(spark),
        names if names is not None else categories(spark), token="t")


def test_commit_imports_first_of_a_repeat(spark):
    result = _commit(spark, upload(spark, {}, {}), ledger(spark).limit(0))
    batch = result.batches.first()
    assert (batch["total_rows"], batch["imported_rows"], batch["skipped_rows"]) == (2, 1, 1)
    assert result.new_rows.count() == 1
    assert result.new_accounts.count() == 1 and result.new_categories.count() == 1


def test_import_twice_equals_import_once(spark):
    rows = upload(spark, {}, dict(amount=3.5, reference_number="R1"),
                  dict(card_number_masked="************1234", reference_number="R2"),
                  dict(card_number_masked="1234", reference_number="R2"),
                  dict(merchant_name="Interest Charge", card_number_masked="1234"))
    first = _commit(spark, rows, ledger(spark).limit(0))
    assert first.new_rows.count() == 4  # the two cards are one account
    again = _commit(spark, rows, first.new_rows, first.new_accounts, first.new_categories)
    assert again.new_rows.count() == 0
    assert again.new_accounts.count() == 0 and again.new_categories.count() == 0


def test_texts_that_differ_late_are_no_duplicates(spark):
    long = "shop " * 80
    rows = upload(spark, dict(merchant_name=long + "a"), dict(merchant_name=long + "b"),
                  dict(merchant_name=long + "a"))
    first = _commit(spark, rows, ledger(spark).limit(0))
    assert sorted(r["merchant_name"][-1] for r in first.new_rows.collect()) == ["a", "b"]
    books = ledger(spark, dict(merchant_name=long + "a"))
    out = dedup.check_duplicates(rows, books, accounts(spark))
    assert _flags(out) == [(True, False, True), (False, False, False), (True, True, False)]


def test_files_with_long_names_are_batches_of_their_own(spark):
    name = "s" * 300
    rows = upload(spark, dict(source_file=name + "1"), dict(source_file=name + "2", amount=1.0))
    names = {r["filename"] for r in _commit(spark, rows, ledger(spark).limit(0)).batches.collect()}
    assert names == {name + "1", name + "2"}


def test_excluded_row_claims_nothing_in_a_commit_but_does_in_a_check(spark):
    rows = upload(spark, dict(exclude=True), {})
    assert _commit(spark, rows, ledger(spark).limit(0)).new_rows.count() == 1
    out = dedup.check_duplicates(rows, ledger(spark).limit(0), accounts(spark))
    assert _flags(out)[1] == (True, True, False)


def test_stored_row_does_not_claim_its_key_in_a_commit(spark):
    held = accounts(spark, dict(id=7, name="a", card_number_masked="9999"))
    books = ledger(spark, dict(account_id=None, amount=1.0))
    # no card at all: rows are looked up by fingerprint and share the empty account
    rows = upload(spark, dict(amount=1.0, reference_number="R"),
                  dict(amount=2.0, reference_number="R"))
    result = _commit(spark, rows, books, held)
    assert [r["amount"] for r in result.new_rows.collect()] == [2.0]


def test_transfer_category_sets_the_type(spark):
    result = _commit(spark, upload(spark, dict(category_name=" Transfer ")),
                     ledger(spark).limit(0))
    assert result.new_rows.first()["transaction_type"] == "transfer"


def test_missing_fields(spark):
    rows = upload(spark, dict(transaction_date=None, merchant_name=" "),
                  dict(transaction_type="gift"), {})
    got = {r["row_idx"]: r["missing"] for r in dedup.missing_required(rows).collect()}
    assert got == {0: ["date", "merchant"], 1: ["type"]}


def test_default_exclude_keeps_earlier_choices(spark):
    checked = spark.createDataFrame([(0, True, False), (1, True, False), (2, False, True)],
                                    "row_idx long, duplicate boolean, exclude boolean")
    before = spark.createDataFrame([(0, True, False), (1, False, False)],
                                   "row_idx long, duplicate boolean, exclude boolean")
    got = [r["exclude"] for r in dedup.default_exclude(checked, before).orderBy("row_idx")
           .collect()]
    assert got == [False, True, True]


def _brute_force_check(rows, books, held):
    """The duplicate rules row by row, over plain dicts."""
    def low(t):
        return " ".join((t or "").lower().split())

    def four(card):
        digits = "".join(c for c in card or "" if c.isdigit())
        return digits[-4:] if len(digits) >= 4 else None

    def interest(t):
        return any(p in low(t) for p in ("interest charge", "interest paid"))

    def find(card):
        exact = [a["id"] for a in held if a["card_number_masked"] == card]
        tail = [a["id"] for a in held if four(card) and four(a["card_number_masked"]) == four(card)]
        return min(exact) if exact else (min(tail) if tail else None)

    counts: dict = {}
    for r in rows:
        if r["card_number_masked"]:
            counts[r["card_number_masked"]] = counts.get(r["card_number_masked"], 0) + 1
    default = max(counts, key=counts.get) if counts else ""
    seen, out = set(), []
    for r in rows:
        card = r["card_number_masked"] or default
        account = find(card) if card else None
        when = r["transaction_date"]
        finger = (when, low(r["merchant_name"]), r["amount"], r["transaction_type"])
        if r["reference_number"]:
            key = ("r", r["reference_number"], card, when)
        elif interest(r["merchant_name"]):
            key = ("i", card, when, r["amount"], low(r["merchant_name"]))
        else:
            key = ("x", card, finger)
        if key in seen:
            out.append("import")
            continue
        seen.add(key)
        known = account is not None
        hit = False
        for b in books:
            same_day = when in (b["transaction_date"], b["posted_date"])
            by_interest = (b["account_id"] == account and same_day and b["amount"] == r["amount"]
                           and interest(b["merchant_name"]) and interest(r["merchant_name"]))
            if r["reference_number"] and known:
                hit |= (b["account_id"] == account and same_day
                        and b["reference_number"] == r["reference_number"]) or by_interest
            elif interest(r["merchant_name"]) and known:
                hit |= by_interest
            else:
                hit |= finger == (b["transaction_date"], low(b["merchant_name"]), b["amount"],
                                  b["transaction_type"]) and (
                    not known or b["account_id"] == account)
        out.append("database" if hit else None)
    return out


def test_check_against_brute_force(spark):
    rng = random.Random(7)
    merchants = ["Shop A", "shop  a", "Interest Charge", "INTEREST CHARGE x", "Other"]
    cards = ["", "************1234", "1234", "55"]

    def row():
        return dict(transaction_date=date(2024, 1, 1) + timedelta(days=rng.randrange(3)),
                    merchant_name=rng.choice(merchants), amount=float(rng.randrange(1, 4)),
                    transaction_type=rng.choice(["expense", "refund"]),
                    reference_number=rng.choice([None, None, "R1", "R2"]))

    rows = [{**row(), "card_number_masked": rng.choice(cards)} for _ in range(160)]
    books = [{**row(), "posted_date": rng.choice([None, date(2024, 1, 2)]),
              "account_id": rng.choice([None, 1, 2])} for _ in range(25)]
    held = [dict(id=1, name="a", card_number_masked="************1234"),
            dict(id=2, name="b", card_number_masked="55")]
    expected = _brute_force_check(rows, books, held)
    out = dedup.check_duplicates(upload(spark, *rows).repartition(7), ledger(spark, *books),
                                 accounts(spark, *held))
    got = ["import" if a else "database" if b else None for _, a, b in _flags(out)]
    assert got == expected
    assert {"import", "database", None} <= set(expected)


def test_prune_is_idempotent_and_keeps_lowest_id(spark):
    books = ledger(spark, {}, dict(notes=""), dict(notes="x"), dict(import_batch_id="b"))
    pruned = prune_duplicates(books)
    assert sorted(r["id"] for r in pruned.collect()) == [1, 3]
    assert prune_duplicates(pruned).count() == 2
    flags = {r["id"]: r["exact_duplicate"] for r in flag_duplicates(books).collect()}
    assert flags == {1: True, 2: True, 3: False, 4: True}


def test_hot_key_of_a_third_of_all_rows(spark):
    """Copies of one row are found without gathering them: every first is a grouped minimum."""
    rows = spark.range(30000).select(
        F.col("id").alias("row_idx"), F.lit(None).cast("string").alias("user_id"),
        F.lit(day("2024-01-01")).alias("transaction_date"),
        F.lit(None).cast("date").alias("posted_date"),
        F.lit(None).cast("string").alias("reference_number"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string"))
        .alias("merchant_name"),
        *[F.lit(None).cast("string").alias(c) for c in (
            "merchant_city", "merchant_state", "merchant_country", "mcc_description",
            "card_number_masked")],
        F.lit(1.0).alias("amount"), F.lit("CAD").alias("currency"),
        F.lit("expense").alias("transaction_type"), F.lit(False).alias("exclude"))
    out = dedup.check_duplicates(rows, ledger(spark).limit(0), accounts(spark))
    assert out.filter("duplicate").count() == 9999
