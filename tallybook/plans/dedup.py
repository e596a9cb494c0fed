"""Registered duplicate-check and commit queries over the derived uploads."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallybook.operators import commit as commit_op
from tallybook.operators import dedup as op
from tallybook.operators import ingest
from tallybook.plans.uploads import good_rows, suggested_rows
from tallybook.session import cut_lineage
from tallybook.sources import derived

C, L = F.col, F.lit
TOKEN = "registered"


def _checked(s, d):
    rows = good_rows(s, d).withColumn("exclude", C("row_idx") % 30 == 0)
    return op.check_duplicates(rows, derived.ledger(s, d), derived.accounts(s, d),
                               derived.ledger_keys(s, d))


def _keyed(s, d):
    return op.keyed_upload(good_rows(s, d), derived.accounts(s, d))


def _periods(rows):
    detected = cut_lineage(ingest.detect_period(rows))
    chosen = detected.filter(C("month") % 2 == 0).select(
        "user_id", "source_file", (C("month") + 2).alias("month"), "year")
    return detected, chosen


def _upload(s, d):
    """Suggested rows with some exclusions, chosen names and a period per file."""
    rows = cut_lineage(suggested_rows(s, d).drop("keyword_matches")).withColumns({
        "exclude": C("row_idx") % 30 == 0,
        "category_name": F.when(C("row_idx") % 11 == 0, L(" Transfer "))
        .when(C("row_idx") % 13 == 0, F.concat(L("Trip "), F.year("transaction_date"))),
        "notes": L(""),
    })
    return op.assign_period(rows, *_periods(rows))


def _commit(s, d):
    # the ledger a commit meets lacks half of the accounts
    known = derived.accounts(s, d).filter(C("id") % 2 == 0)
    return commit_op.commit_import(
        _upload(s, d), derived.ledger(s, d), known, derived.categories(s, d), token=TOKEN,
        keys=derived.ledger_keys(s, d))


def _imported(s, d):
    return _commit(s, d).new_rows.drop("created_at", "import_batch_id")


def _batches(s, d):
    return _commit(s, d).batches.drop("id")


def _previous(s, d):
    return good_rows(s, d).select(
        "row_idx", (C("row_idx") % 3 == 0).alias("duplicate"),
        (C("row_idx") % 2 == 0).alias("exclude"))


QUERIES = {
    "d1_row_normalisers": lambda s, d: op.with_dedup_keys(derived.raw_uploads(s, d).select(
        "row_idx", "user_id", C("ref_raw").alias("reference_number"),
        C("card_raw").alias("card_number_masked"), L(None).cast("date").alias("transaction_date"),
        L(None).cast("date").alias("posted_date"), C("merchant_raw").alias("merchant_name"),
        C("city_raw").alias("merchant_city"), C("state_raw").alias("merchant_state"),
        C("country_raw").alias("merchant_country"), C("mcc_raw").alias("mcc_description"),
        L(1.0).alias("amount"), L(None).cast("string").alias("currency"),
        L(None).cast("string").alias("transaction_type"))).select(
        "row_idx", "ref", C("own_card").alias("card"), "merchant_key",
        op.last_four(C("own_card")).alias("last_four"),
        F.replace("place_key", L("\x01"), L("|")).alias("place_key")),
    "d2_default_card": lambda s, d: op.default_cards(op.with_dedup_keys(good_rows(s, d))),
    "d3_statement_date": lambda s, d: op.with_dedup_keys(good_rows(s, d)).select(
        "row_idx", "statement_date"),
    "d4_interest_like": lambda s, d: op.with_dedup_keys(good_rows(s, d)).select(
        "row_idx", "interest_like"),
    "d5_exact_fingerprint": lambda s, d: op.with_dedup_keys(good_rows(s, d)).select(
        "row_idx", F.when(C("statement_date").isNotNull(), F.replace(F.concat_ws(
            "|", F.date_format("statement_date", "yyyy-MM-dd"), "merchant_key", "place_key",
            C("amount_e4").cast("string"), "kind_key"), L("\x01"), L("|"))).alias("fingerprint")),
    "d6_account_of_card": lambda s, d: op.card_accounts(
        op.with_card(op.with_dedup_keys(good_rows(s, d))), derived.accounts(s, d)).select(
        "user_id", "card", "account_id"),
    "d7_batch_duplicates": lambda s, d: op.batch_duplicates(_keyed(s, d), C("card")),
    "d8_ledger_duplicates": lambda s, d: op.ledger_duplicates(
        _keyed(s, d), derived.ledger(s, d), derived.ledger_keys(s, d)),
    "d9_interest_duplicates": lambda s, d: op.ledger_duplicates(
        _keyed(s, d).filter("interest_like"), derived.ledger(s, d), derived.ledger_keys(s, d)),
    "d10_check_duplicates": lambda s, d: _checked(s, d).select(
        "row_idx", "reference_number", "card_number_masked", "exclude", "duplicate",
        "duplicate_in_import", "duplicate_in_database"),
    "d11_default_exclude": lambda s, d: op.default_exclude(
        _checked(s, d), _previous(s, d)).select("row_idx", "duplicate", "exclude"),
    "d12_assign_period": lambda s, d: op.assign_period(
        good_rows(s, d), *_periods(good_rows(s, d))).select(
        "row_idx", "import_month", "import_year"),
    "d13_missing_required": lambda s, d: op.missing_required(good_rows(s, d)).select(
        "row_idx", F.array_join("missing", ",").alias("missing")),
    "d14_commit_import": _imported,
    "d14_new_categories": lambda s, d: _commit(s, d).new_categories,
    "d15_batch_summary": _batches,
    "d15_grand_totals": lambda s, d: commit_op.grand_totals(_commit(s, d).batches),
    "d16_new_accounts": lambda s, d: _commit(s, d).new_accounts,
}
