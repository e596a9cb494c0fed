"""Statement rows from raw text cells: amounts, dates, type, category, period."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.functions.dates import read_date
from tallybook.functions.joins import null_safe_join
from tallybook.functions.money import clean_amount, read_clean_amount, to_cents
from tallybook.functions.text import computed_once, contains_any, stripped, trimmed
from tallybook.operators.keywords import analyze_merchants
from tallybook.schemas import (
    CASHBACK_PHRASES, CREDIT_TITLES, CSV_TITLES, DEBIT_TITLES, MCC_CATEGORY, PAYMENT_PHRASES,
)
from tallybook.session import cut_lineage

C, L = F.col, F.lit

UNCATEGORIZED = "uncategorized"
DEFAULT_PERIOD = (1, 2000)

# logical field of a header map -> raw cell column
_CELLS = {
    "date": "date_raw", "posted_date": "posted_raw", "amount": "amount_raw",
    "debit": "debit_raw", "credit": "credit_raw", "merchant_name": "merchant_raw",
    "mcc_description": "mcc_raw", "card_number": "card_raw", "cardholder": "holder_raw",
    "reference_number": "ref_raw", "merchant_city": "city_raw", "merchant_state": "state_raw",
    "merchant_country": "country_raw",
}


@dataclass(frozen=True)
class HeaderMap:
    """Which column of a file holds each logical field."""

    fields: dict[str, str]

    @property
    def has_split_amount(self) -> bool:
        return "amount" not in self.fields

    def display(self) -> dict[str, str]:
        """Logical field -> title, the debit/credit pair shown as one amount field."""
        shown = {k: v for k, v in self.fields.items() if k not in ("debit", "credit")}
        if self.has_split_amount:
            shown["amount"] = " / ".join(
                self.fields[k] for k in ("debit", "credit") if k in self.fields)
        return shown

    def cells(self, column_of: dict[str, str] | None = None) -> list[Column]:
        """Projection onto the raw cell columns; absent fields are ''.

        column_of names the DataFrame column of each title where they differ.
        """
        def cell(title: str) -> Column:
            name = column_of[title] if column_of else title
            return F.coalesce(F.col(f"`{name}`").cast("string"), L(""))

        return [(cell(self.fields[k]) if k in self.fields else L("")).alias(raw)
                for k, raw in _CELLS.items()]


def resolve_header(columns: list[str]) -> HeaderMap | None:
    """Field map of a header, or None when no date or no amount column is recognised."""
    def key(title: str) -> str:
        return title.strip().lower()

    by_title = {key(c): c for c in columns}  # the last of equal titles wins

    def first_of(titles: list[str]) -> str | None:
        return next((by_title[key(t)] for t in titles if key(t) in by_title), None)

    found = {field: first_of(titles) for field, titles in CSV_TITLES.items()}
    if found["amount"] is None:
        found["debit"], found["credit"] = first_of(DEBIT_TITLES), first_of(CREDIT_TITLES)
    fields = {field: title for field, title in found.items() if title is not None}
    if "date" not in fields or not fields.keys() & {"amount", "debit", "credit"}:
        return None
    return HeaderMap(fields)


def header_report(spark: SparkSession, headers: dict[str, HeaderMap | None]) -> DataFrame:
    """One row per file and recognised field: the column title used."""
    rows = [(file, field, title) for file, header in headers.items() if header
            for field, title in header.display().items()]
    return spark.createDataFrame(rows, "source_file string, field string, title string")


def classify(amount: Column, merchant: Column, mcc: Column) -> Column:
    """struct(type, amount): transfers and refunds by phrase, else by sign; never income."""
    return classify_text(phrase_text(merchant, mcc), amount)


def phrase_text(merchant: Column, mcc: Column) -> Column:
    """The text in which `classify` looks for phrases."""
    return F.lower(F.concat(F.coalesce(merchant, L("")), L(" "), F.coalesce(mcc, L(""))))


def classify_text(text: Column, amount: Column) -> Column:
    """classify for a computed `phrase_text`, which is searched some twenty times."""
    kind = (F.when(contains_any(text, PAYMENT_PHRASES), "transfer")
            .when(contains_any(text, CASHBACK_PHRASES), "refund")
            .when(amount < 0, "refund").otherwise("expense"))
    return F.struct(kind.alias("type"), F.abs(amount).alias("amount"))


def mcc_category(mcc: Column) -> Column:
    """Category of a merchant-category text: itself when unknown, uncategorized when empty."""
    return _category_of(mcc, F.lower(trimmed(mcc)))


def _category_of(mcc: Column, key: Column) -> Column:
    """mcc_category for its computed key."""
    table = F.create_map(*[L(x) for pair in MCC_CATEGORY.items() for x in pair])
    return F.when(F.coalesce(mcc, L("")) == "", L(UNCATEGORIZED)).otherwise(
        F.coalesce(F.try_element_at(table, key), key))


def suggest_category(rows: DataFrame, rules: DataFrame | None) -> DataFrame:
    """Add suggested_category, suggestion_source, resolution_needed and keyword_matches.

    A known merchant-category text wins; else the keyword analysis of the merchant, computed
    once per distinct merchant of the rows that need it.
    """
    keyed = computed_once(computed_once(
        rows, F.coalesce("mcc_description", L("")).alias("_mcc")),
        F.lower(stripped("_mcc")).alias("_key"))
    named = computed_once(keyed, _category_of(C("_mcc"), C("_key")).alias("_category"))
    category = C("_category")
    from_mcc = (category != "") & (category != UNCATEGORIZED) & (category != C("_key"))
    if rules is None:
        return named.select(
            *rows.columns, F.when(from_mcc, category).otherwise(UNCATEGORIZED).alias("suggested_category"),
            F.when(from_mcc, "mcc").otherwise("none").alias("suggestion_source"),
            L(False).alias("resolution_needed"))
    marked = named.withColumn("mcc_category", F.when(from_mcc, category)).drop(
        "_mcc", "_key", "_category")
    # stored, so that its size is known when the rows meet it
    found = cut_lineage(analyze_merchants(marked.filter(C("mcc_category").isNull()), rules).select(
        "user_id", "merchant_name", C("suggested_category").alias("by_keyword"),
        C("resolution_needed").alias("competing"), C("keyword_matches").alias("found")))
    by_mcc = C("mcc_category").isNotNull()
    return (null_safe_join(marked, found, ["user_id", "merchant_name"])
            .withColumn("suggested_category",
                        F.coalesce("mcc_category", "by_keyword", L(UNCATEGORIZED)))
            .withColumn("suggestion_source",
                        F.when(by_mcc, "mcc").when(C("by_keyword").isNotNull(), "keyword")
                        .otherwise("none"))
            .withColumn("resolution_needed", ~by_mcc & F.coalesce("competing", L(False)))
            .withColumn("keyword_matches", F.when(~by_mcc, C("found")))
            .drop("mcc_category", "by_keyword", "competing", "found"))


def parse_cells(raw: DataFrame, default_currency: str = "CAD") -> DataFrame:
    """Typed rows from raw cells, with `error` set where a cell cannot be read.

    Empty dates are null without error. A row keeps its first error: amount, date, posted date.
    """
    cells = [c for c in _CELLS.values() if c in raw.columns]
    keys = [c for c in ("row_idx", "row_no", "user_id", "source_file", "is_split")
            if c in raw.columns]
    whole = raw.select(*keys, *[F.coalesce(C(c), L("")).alias(c) for c in cells])
    text = whole.select(*keys, *[stripped(c).alias(c) for c in cells])
    # step by step and without lambdas, so that all of it is generated code
    amounts = [c for c in ("amount_raw", "debit_raw", "credit_raw") if c in cells]
    clean = computed_once(text, *[clean_amount(C(c)).alias(f"clean_{c}") for c in amounts])
    values = computed_once(clean, *[
        read_clean_amount(C(c), C(f"clean_{c}")).alias(f"value_{c}") for c in amounts])
    signed, shown = C("value_amount_raw"), C("amount_raw")
    if "debit_raw" in cells:
        debit, credit = C("value_debit_raw"), C("value_credit_raw")
        # both cells must be readable, as a bad cell rejects the row
        split = F.when(debit.isNotNull() & credit.isNotNull(),
                       F.when(debit != 0, debit).otherwise(-credit))
        is_split = C("is_split") if "is_split" in keys else L(True)
        signed = F.when(is_split, split).otherwise(signed)
        shown = F.when(is_split, F.concat_ws(" / ", "debit_raw", "credit_raw")).otherwise(shown)
    dated = computed_once(values, signed.alias("signed"),
                          read_date(C("date_raw")).alias("transaction_date"))
    typed = computed_once(dated, read_date(C("posted_raw")).alias("posted_date"))
    error = (F.when(C("signed").isNull(), F.concat(L("Cannot parse amount: "), shown))
             .when(C("transaction_date").isNull() & (C("date_raw") != ""),
                   F.concat(L("Cannot parse date: "), C("date_raw")))
             .when(C("posted_date").isNull() & (C("posted_raw") != ""),
                   F.concat(L("Cannot parse date: "), C("posted_raw"))))
    searched = computed_once(typed, error.alias("error"), phrase_text(
        C("merchant_raw"), C("mcc_raw")).alias("phrases"))
    verdict = classify_text(C("phrases"), C("signed"))
    return (computed_once(searched, verdict.alias("verdict"))
            .select("row_idx", *[c for c in keys if c == "row_no"], "user_id", "source_file",
                    "transaction_date", "posted_date", C("ref_raw").alias("reference_number"),
                    C("merchant_raw").alias("merchant_name"),
                    C("city_raw").alias("merchant_city"), C("state_raw").alias("merchant_state"),
                    C("country_raw").alias("merchant_country"),
                    C("mcc_raw").alias("mcc_description"),
                    C("verdict.amount").alias("amount"),
                    to_cents(C("verdict.amount")).alias("amount_cents"),
                    L(default_currency).alias("currency"),
                    C("verdict.type").alias("transaction_type"),
                    C("card_raw").alias("card_number_masked"),
                    C("holder_raw").alias("cardholder"),
                    (C("verdict.type") == "transfer").alias("is_payment"),
                    (C("verdict.type") == "refund").alias("is_refund"), "error"))


def split_errors(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, error messages 'Row i: ...'); one bad row never costs the others."""
    number = C("row_no") if "row_no" in parsed.columns else C("row_idx")
    good = parsed.filter(C("error").isNull()).drop("error", "row_no")
    bad = parsed.filter(C("error").isNotNull()).select(
        "user_id", "source_file", "row_idx",
        F.concat(L("Row "), number.cast("string"), L(": "), C("error")).alias("message"))
    return good, bad


def normalise_rows(raw: DataFrame, rules: DataFrame | None,
                   default_currency: str = "CAD") -> DataFrame:
    """Good rows with type, category suggestion and flags."""
    good, _ = split_errors(parse_cells(raw, default_currency))
    return suggest_category(good, rules)


def detect_period(rows: DataFrame, by: tuple[str, ...] = ("user_id", "source_file")) -> DataFrame:
    """Most frequent (month, year) per file, ties to the first seen; (1, 2000) without dates."""
    day = C("transaction_date")
    counted = rows.groupBy(*by, F.year(day).alias("year"), F.month(day).alias("month")).agg(
        F.count(day).alias("n"), F.min("row_idx").alias("first_row"))
    best = F.max_by(F.struct("month", "year"),
                    F.when(C("n") > 0, F.struct("n", -C("first_row"))))
    return counted.groupBy(*by).agg(best.alias("period")).select(
        *by, F.coalesce("period.month", L(DEFAULT_PERIOD[0])).alias("month"),
        F.coalesce("period.year", L(DEFAULT_PERIOD[1])).alias("year"))


def unknown_categories(rows: DataFrame, categories: DataFrame) -> DataFrame:
    """Suggested names the user has no category for (any case), in first-seen order."""
    name = F.trim(F.coalesce("suggested_category", L("")))
    seen = (rows.withColumn("category", name)
            .filter((C("category") != "") & (F.lower("category") != UNCATEGORIZED))
            .groupBy("user_id", "category").agg(F.min("row_idx").alias("first_row"))
            .withColumn("known_as", F.lower("category")))
    known = categories.select("user_id", F.lower("name").alias("known_as"))
    return null_safe_join(seen, known, ["user_id", "known_as"], "left_anti").select(
        "user_id", "category", "first_row")
