"""Registered ingestion queries over raw upload cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallybook.functions.dates import parse_date
from tallybook.functions.money import parse_amount, split_amount
from tallybook.operators import ingest as op
from tallybook.plans.uploads import good_rows, matches_text, suggested_rows
from tallybook.sources import derived

C, L = F.col, F.lit


def _bank_export(s, d):
    """Orders under the titles of a bank export, two of them alike."""
    return derived.table(s, d, "orders").select(
        C("o_orderkey").alias("Transaction ID"), C("o_custkey").alias("Card No."),
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("Posting Date"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias(" trans. date "),
        C("o_orderpriority").alias("Memo"), C("o_orderstatus").alias("TYPE"),
        F.when(C("o_orderkey") % 2 == 0, C("o_totalprice")).alias("Withdrawal"),
        F.when(C("o_orderkey") % 2 == 1, C("o_totalprice")).alias("Deposits"))


def _header_projection(s, d):
    export = _bank_export(s, d)
    header = op.resolve_header(export.columns)
    return export.select(*header.cells())


def _header_report(s, d):
    files = {name: op.resolve_header(titles) for name, titles in {
        "orders": _bank_export(s, d).columns,
        "events": derived.table(s, d, "events").columns,
        "conversations": ["Date", "Amount", *derived.table(s, d, "conversations").columns],
    }.items()}
    rows = derived.table(s, d, "orders").agg(F.count(L(1)).alias("rows"))
    return op.header_report(s, files).withColumn(
        "rows", F.when(C("source_file") == "orders", rows.scalar()))


def _split_export(s, d):
    half = C("row_idx") % 8 < 4
    return derived.raw_uploads(s, d).select(
        "row_idx", split_amount(F.when(half, C("amount_raw")), F.when(~half, C("amount_raw")))
        .alias("amount"))


def _classified(s, d):
    verdict = op.classify(parse_amount(C("amount_raw")), C("merchant_raw"), C("mcc_raw"))
    return (derived.raw_uploads(s, d).filter(parse_amount(C("amount_raw")).isNotNull())
            .select("row_idx", verdict.alias("v"))
            .select("row_idx", C("v.type").alias("transaction_type"), "v.amount"))


QUERIES = {
    "c1_header_projection": _header_projection,
    "c3_parse_amount": lambda s, d: derived.raw_uploads(s, d).select(
        "row_idx", parse_amount(C("amount_raw")).alias("amount")),
    "c4_split_amount": _split_export,
    "c5_parse_date": lambda s, d: derived.raw_uploads(s, d).select(
        "row_idx", parse_date(C("date_raw")).alias("day")),
    "c6_classify": _classified,
    "c7_mcc_category": lambda s, d: derived.raw_uploads(s, d).select(
        "row_idx", op.mcc_category(C("mcc_raw")).alias("category")),
    "c8_suggest_category": lambda s, d: suggested_rows(s, d).select(
        "row_idx", "suggested_category", "suggestion_source", "resolution_needed",
        matches_text().alias("matches")),
    "c9_detect_period": lambda s, d: op.detect_period(good_rows(s, d)),
    "c10_parse_errors": lambda s, d: op.split_errors(
        op.parse_cells(derived.raw_uploads(s, d)))[1],
    "c11_header_report": _header_report,
    "c12_normalised_rows": lambda s, d: suggested_rows(s, d).drop("keyword_matches"),
    "p13_unknown_categories": lambda s, d: op.unknown_categories(
        suggested_rows(s, d), derived.categories(s, d)),
}
