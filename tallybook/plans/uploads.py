"""Shared inputs of the import queries: parsed uploads with suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.operators import ingest
from tallybook.operators.keywords import keyword_rules
from tallybook.sources import derived

C = F.col


def rules(s, d) -> DataFrame:
    return keyword_rules(derived.categories(s, d))


def good_rows(s, d) -> DataFrame:
    """Upload rows that parsed, without category suggestions."""
    return ingest.split_errors(ingest.parse_cells(derived.raw_uploads(s, d)))[0]


def suggested_rows(s, d) -> DataFrame:
    return ingest.normalise_rows(derived.raw_uploads(s, d), rules(s, d))


def matches_text(column: str = "keyword_matches"):
    """Match list as text: category|keyword|length, in rank order."""
    return F.array_join(F.transform(
        C(column), lambda m: F.concat_ws("|", m["category_id"].cast("string"),
                                         m["category_name"], m["keyword"],
                                         m["length"].cast("string"))), ";")
