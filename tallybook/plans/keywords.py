"""Registered keyword queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallybook.functions.text import keywords_csv, normalize_match_text
from tallybook.operators import keywords as op
from tallybook.plans.uploads import matches_text, rules, suggested_rows
from tallybook.sources import derived

C, L = F.col, F.lit


def _candidates(s, d):
    """Candidate keywords taken from the ledger: the merchant's words and its two-word name."""
    words = F.split("merchant_name", " ")
    return derived.ledger(s, d).select(
        "user_id", C("category_id").alias("exclude_category_id"),
        F.explode(F.array(words[0], words[1], F.concat_ws(" ", words[0], words[1])))
        .alias("keyword")).distinct()


def _conflicts(s, d):
    return op.keyword_conflicts(rules(s, d), _candidates(s, d))


def _removed(s, d):
    taken = _conflicts(s, d).filter(
        (C("kind") == "exact") & (C("category_id") > C("exclude_category_id")))
    return op.remove_keywords(derived.categories(s, d), taken)


def _resuggested(s, d):
    rows = suggested_rows(s, d).withColumn(
        "category_name", F.when(C("row_idx") % 3 == 0, "chosen"))
    renamed = op.keyword_rules(derived.categories(s, d).withColumn(
        "keywords", F.replace("keywords", L("red"), L("blue"))))
    return op.resuggest(rows, renamed).select(
        "row_idx", "suggested_category", "suggestion_source", "resolution_needed")


def _resolved(s, d, part):
    rows = suggested_rows(s, d).select(
        "row_idx", "user_id", F.concat(L(" "), F.upper("suggested_category")).alias("category"))
    return op.resolve_categories(rows, derived.categories(s, d))[part]


QUERIES = {
    "k1_normalize_match_text": lambda s, d: derived.table(s, d, "documents").select(
        "doc_id", normalize_match_text(C("text")).alias("words")),
    "k2_keyword_rules": lambda s, d: rules(s, d),
    "k3_keyword_matches": lambda s, d: op.match_keywords(derived.ledger(s, d), rules(s, d)),
    "k4_analyze_merchants": lambda s, d: op.analyze_merchants(
        derived.ledger(s, d), rules(s, d)).select(
        "user_id", "merchant_name", "normalized_merchant", "suggested_category",
        "resolution_needed", matches_text().alias("matches")),
    "k5_exact_conflicts": lambda s, d: _conflicts(s, d).filter(C("kind") == "exact"),
    "k6_overlap_conflicts": lambda s, d: _conflicts(s, d).filter(C("kind") == "overlap"),
    "k7_keywords_csv": lambda s, d: derived.ledger(s, d).select("id", keywords_csv(F.concat_ws(
        ",", "merchant_name", "notes", F.upper("merchant_name"), L(" "), "mcc_description",
        "merchant_city")).alias("keywords")),
    "k8_remove_keywords": _removed,
    "k9_resuggest": _resuggested,
    "k10_seed_categories": lambda s, d: op.seed_categories(
        derived.accounts(s, d), derived.categories(s, d)),
    "k11_resolved_rows": lambda s, d: _resolved(s, d, 0).select(
        "row_idx", "user_id", "category_id"),
    "k11_new_categories": lambda s, d: _resolved(s, d, 1),
}
