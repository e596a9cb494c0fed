"""Duplicates of uploaded rows, within the upload and against the stored ledger.

Every step works on a narrow table of keys. First rows are found by a grouped min(row_idx), which
combines map-side, and flags travel back on the unique row_idx, so a key shared by a third of all
rows never meets in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions.joins import null_safe_join, one_per_key
from tallybook.functions.money import to_cents, to_ten_thousandths
from tallybook.functions.text import (
    collapsed, collapsed_lower, computed_once, contains_any, digits_only, lowered, stripped, trimmed,
)
from tallybook.schemas import INTEREST_PHRASES, TRANSACTION_TYPES
from tallybook.session import cut_lineage, scratch

C, L = F.col, F.lit

_SEPARATOR = "\x01"
DEFAULT_CURRENCY = "CAD"
DEFAULT_TYPE = "expense"


def is_interest(merchant_key: Column) -> Column:
    return contains_any(merchant_key, INTEREST_PHRASES)


_PLACE = ("merchant_city", "merchant_state", "merchant_country", "mcc_description")


def _with_lowered(rows: DataFrame, *more: Column) -> DataFrame:
    """Add what merchant and place keys are made of, in lower case, and `more`."""
    return computed_once(rows, *[
        lowered(c).alias(f"_{c}") for c in ("merchant_name", *_PLACE)], *more)


def _place_key() -> Column:
    """City, state, country and category text in normal form, as one text."""
    return F.concat_ws(_SEPARATOR, *[collapsed(f"_{c}") for c in _PLACE])


def last_four(card: Column) -> Column:
    """Last four digits of a card text with at least four, else null."""
    digits = digits_only(card)
    return F.when(F.length(digits) >= 4, F.right(digits, L(4)))


def with_dedup_keys(rows: DataFrame, *carried: Column) -> DataFrame:
    """Narrow key table of upload rows: everything duplicates are judged by."""
    currency = F.coalesce("currency", L(DEFAULT_CURRENCY))
    kind = F.coalesce("transaction_type", L(DEFAULT_TYPE))
    # step by step, as each step refers to the one before several times
    texts = _with_lowered(
        rows, F.lower(currency).alias("_currency"), F.lower(kind).alias("_kind"),
        stripped("reference_number").alias("_ref"),
        F.coalesce(stripped("card_number_masked"), L("")).alias("own_card"),
        F.concat_ws(_SEPARATOR, F.upper(currency), F.lower(kind)).alias("stored_kind"))
    narrow = computed_once(computed_once(
        texts, F.nullif("_ref", L("")).alias("ref"),
        collapsed("_merchant_name").alias("merchant_key"),
        F.concat_ws(_SEPARATOR, collapsed("_currency"), collapsed("_kind")).alias("kind_key")),
        _place_key().alias("place_key"))
    amount = F.coalesce("amount", L(0.0))
    return narrow.select(
        "row_idx", "user_id", "ref", "own_card",
        F.coalesce("transaction_date", "posted_date").alias("statement_date"), "merchant_key",
        "place_key", "kind_key", "stored_kind", to_ten_thousandths(amount).alias("amount_e4"),
        to_cents(amount).alias("cents"), is_interest(C("merchant_key")).alias("interest_like"),
        *carried)


def default_cards(keyed: DataFrame) -> DataFrame:
    """Most frequent card of each user's upload, ties to the first seen."""
    counts = (keyed.filter(C("own_card") != "").groupBy("user_id", "own_card")
              .agg(F.count(L(1)).alias("n"), F.min("row_idx").alias("first_row")))
    return counts.groupBy("user_id").agg(
        F.max_by("own_card", F.struct("n", -C("first_row"))).alias("default_card"))


def with_card(keyed: DataFrame) -> DataFrame:
    """Add card: the row's own, else the upload's default, else ''."""
    # stored, so that its size is known: joined by shuffle, a user's rows would meet in one task
    joined = null_safe_join(keyed, cut_lineage(default_cards(keyed)), ["user_id"])
    return joined.withColumn("card", F.coalesce(
        F.nullif("own_card", L("")), "default_card", L(""))).drop("default_card")


def card_accounts(cards: DataFrame, accounts: DataFrame) -> DataFrame:
    """(user_id, card, account_id): exact card mask first, else equal last four digits; the
    lowest id among several. Works on distinct cards."""
    distinct = cards.select("user_id", "card").distinct().withColumn(
        "last4", last_four(C("card")))
    by_mask = accounts.filter(C("card_number_masked").isNotNull()).groupBy(
        "user_id", C("card_number_masked").alias("card")).agg(F.min("id").alias("mask_id"))
    by_four = (accounts.withColumn("last4", last_four(C("card_number_masked")))
               .filter(C("last4").isNotNull())
               .groupBy("user_id", "last4").agg(F.min("id").alias("four_id")))
    return null_safe_join(null_safe_join(distinct, by_mask, ["user_id", "card"]), by_four,
                          ["user_id", "last4"]).select(
        "user_id", "card", "last4", F.coalesce("mask_id", "four_id").alias("account_id"))


def resolve_accounts(keyed: DataFrame, accounts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(keyed rows with account_id, accounts to create); keyed carries cardholder.

    Unknown cards with equal last four digits share the account of the first of them. A new
    account gets max(id) + 1 + the first row_idx that needs it.
    """
    # stored, as is all that is made of it: rows are read once, and sizes are known
    firsts = cut_lineage(keyed.groupBy("user_id", "card").agg(
        F.min("row_idx").alias("first_row"),
        F.min_by("cardholder", "row_idx").alias("cardholder")))
    group = F.coalesce("last4", "card")
    found = cut_lineage(card_accounts(firsts, accounts))
    unknown = null_safe_join(found.filter(C("account_id").isNull()), firsts,
                             ["user_id", "card"]).withColumn("card_group", group)
    next_id = accounts.agg(F.coalesce(F.max("id"), L(0)) + 1).scalar()
    grouped = cut_lineage(unknown.groupBy("user_id", "card_group").agg(
        F.min_by("card", "first_row").alias("card"),
        F.min_by("cardholder", "first_row").alias("cardholder"),
        F.min("first_row").alias("first_row")))
    new_ids = grouped.select("user_id", "card_group", (next_id + C("first_row")).alias("new_id"))
    mapping = cut_lineage(null_safe_join(found.withColumn("card_group", group), new_ids,
                                         ["user_id", "card_group"]).select(
        "user_id", "card", F.coalesce("account_id", "new_id").alias("account_id")))
    holder = F.nullif(F.coalesce("cardholder", L("")), L(""))
    new = grouped.select(
        (next_id + C("first_row")).alias("id"), "user_id",
        F.coalesce(F.concat(holder, L(" ("), C("card"), L(")")), C("card")).alias("name"),
        C("card").alias("card_number_masked"), L(None).cast("string").alias("institution"))
    return null_safe_join(keyed, mapping, ["user_id", "card"]), new


_BATCH_KEY = ("branch", "token", "statement_date", "key_text", "key_amount")


def with_batch_key(keyed: DataFrame, token: Column) -> DataFrame:
    """Add the key a row claims within its upload; `branch` is null when it claims none.

    Rows with a reference claim (reference, token, date); interest rows (token, date, cents,
    merchant); other dated rows the nine-field fingerprint. Blank-date rows without reference
    are never duplicates.
    """
    dated = C("statement_date").isNotNull()
    branch = (F.when(C("ref").isNotNull(), "reference")
              .when(C("interest_like") & dated, "interest").when(dated, "exact"))
    exact = C("branch") == "exact"
    return keyed.withColumn("branch", branch).withColumns({
        "token": F.when(exact, collapsed_lower(token)).otherwise(token),
        "key_text": F.when(C("branch") == "reference", C("ref"))
        .when(C("branch") == "interest", C("merchant_key"))
        .otherwise(F.concat_ws(_SEPARATOR, "merchant_key", "place_key", "kind_key")),
        "key_amount": F.when(exact, C("amount_e4")).when(C("branch") == "interest", C("cents"))
        .otherwise(L(0)),
    })


def batch_duplicates(keyed: DataFrame, token: Column) -> DataFrame:
    """row_idx of rows whose key an earlier row of the user's upload already claimed."""
    claims = with_batch_key(keyed, token).filter(C("branch").isNotNull())
    firsts = claims.groupBy("user_id", *_BATCH_KEY).agg(F.min("row_idx").alias("row_idx"))
    return claims.select("row_idx").join(firsts.select("row_idx"), "row_idx", "left_anti")


_PROBE = ("user_id", "kind", "account", "day", "text", "amount_key")


def _probe(kind: str, account: Column, day: Column, text: Column, amount: Column) -> Column:
    return F.struct(L(kind).alias("kind"), account.cast("long").alias("account"),
                    day.alias("day"), text.alias("text"),
                    amount.cast("long").alias("amount_key"))


def _row_probes(keyed: DataFrame) -> DataFrame:
    """What each upload row looks for in the ledger; account_id is null when unknown."""
    day, account, no_amount, no_text = C("statement_date"), C("account_id"), L(0), L("")
    dated, known = day.isNotNull(), account.isNotNull()
    by_reference = C("ref").isNotNull() & known
    by_interest = ~by_reference & C("interest_like") & known & dated
    exact_text = F.concat_ws(_SEPARATOR, "merchant_key", "place_key", "stored_kind")
    probes = F.array(
        F.when(by_reference & dated, _probe("reference", account, day, C("ref"), no_amount)),
        # a stored interest row with its own reference also matches through this key, which
        # covers the reference-free variant with equal merchant
        F.when((by_interest | (by_reference & C("interest_like"))) & dated,
               _probe("interest", account, day, no_text, C("amount_e4"))),
        F.when(~by_reference & ~by_interest & dated,
               _probe("exact", account, day, exact_text, C("amount_e4"))))
    return _inlined(keyed, probes, "row_idx")


def _inlined(rows: DataFrame, probes: Column, row_id: str) -> DataFrame:
    """A row for each probe that is there. Rows of absent ones are filtered behind, as the lambda of
    array_compact would keep all of this out of generated code."""
    return rows.select(row_id, "user_id", F.inline(probes)).filter(C("kind").isNotNull())


def ledger_keys(ledger: DataFrame) -> DataFrame:
    """Every key under which a stored row can be found, with the row's id.

    Kept beside the ledger as a table by month of `day` (LEDGER_KEYS), an upload meets it without
    reading or normalising a ledger row.
    """
    kind = F.concat_ws(_SEPARATOR, "currency", "transaction_type")
    texts = _with_lowered(
        ledger.select("id", "user_id", "account_id", "transaction_date", "posted_date",
                      "reference_number", "merchant_name", *_PLACE, "amount", "currency",
                      "transaction_type"))
    narrow = computed_once(
        texts, collapsed("_merchant_name").alias("merchant_key"),
        _place_key().alias("place_key"), kind.alias("kind_key"))
    first, second = C("transaction_date"), C("posted_date")
    known = C("account_id").isNotNull()
    amount = to_ten_thousandths(F.coalesce("amount", L(0.0)))
    has_ref = known & C("reference_number").isNotNull()
    interest = known & is_interest(C("merchant_key"))
    other_day = second.isNotNull() & ~second.eqNullSafe(first)
    day = F.coalesce(first, second)
    exact_text = F.concat_ws(_SEPARATOR, "merchant_key", "place_key", "kind_key")
    account, no_amount, no_text = C("account_id"), L(0), L("")
    probes = F.array(
        F.when(has_ref & first.isNotNull(),
               _probe("reference", account, first, C("reference_number"), no_amount)),
        F.when(has_ref & other_day,
               _probe("reference", account, second, C("reference_number"), no_amount)),
        F.when(interest & first.isNotNull(),
               _probe("interest", account, first, no_text, amount)),
        F.when(interest & other_day, _probe("interest", account, second, no_text, amount)),
        F.when(known & day.isNotNull(), _probe("exact", account, day, exact_text, amount)),
        # for rows whose account is not known: any account will do
        F.when(day.isNotNull(), _probe("exact", L(None), day, exact_text, amount)))
    return _inlined(narrow, probes, "id")


def ledger_duplicates(keyed: DataFrame, ledger: DataFrame,
                      keys: DataFrame | None = None) -> DataFrame:
    """row_idx of rows the ledger already holds.

    Both sides are turned into equality keys (the either-date rule becomes one key per date).
    `keys` is the stored form of ledger_keys(ledger) with its month `ym`: only the months of the
    upload's days are read (a short text per month goes through the driver). Without it the ledger
    is read once. Either way it is reduced to keys the upload asks for: map-side when the upload
    is small enough to broadcast, else by a shuffle on the key.
    """
    probes = _row_probes(keyed)
    asked = _plain(probes).distinct()
    if keys is None:
        keys = ledger_keys(ledger)
    else:
        months = asked.select(F.date_format("day", "yyyy-MM").alias("ym")).distinct().collect()
        keys = keys.filter(C("ym").isin([r["ym"] for r in months]))
    # what is held is stored, so that its size is known before the upload's rows meet it
    held = cut_lineage(_plain(keys).join(asked, asked.columns, "left_semi").distinct())
    return _plain(probes, "row_idx").join(held, held.columns, "left_semi").select(
        "row_idx").distinct()


def _plain(probes: DataFrame, *kept: str) -> DataFrame:
    """Probes in columns that are never null: distinct probes stay where they are for a join on
    these, which a null-safe one would deal anew."""
    return probes.select(
        *kept, F.coalesce("user_id", L("")).alias("user"), C("user_id").isNull().alias("local"),
        "kind", F.coalesce("account", L(0)).alias("account"),
        C("account").isNull().alias("any_account"), *_PROBE[3:])


def keyed_upload(rows: DataFrame, accounts: DataFrame) -> DataFrame:
    """Key table with the effective card and, where it is known, its account."""
    keyed = with_card(cut_lineage(with_dedup_keys(rows)))
    known = cut_lineage(card_accounts(keyed.filter(C("card") != ""), accounts).select(
        "user_id", "card", "account_id"))
    return null_safe_join(keyed, known, ["user_id", "card"])


def check_duplicates(rows: DataFrame, ledger: DataFrame, accounts: DataFrame,
                     keys: DataFrame | None = None) -> DataFrame:
    """Upload rows with duplicate, duplicate_in_import, duplicate_in_database, card filled in.

    All rows take part, excluded ones too; a repeat within the upload is not looked up again.
    `keys`: the ledger's stored keys, see ledger_duplicates.
    """
    with scratch(rows.sparkSession) as lasting:
        keyed = lasting(keyed_upload(rows, accounts))
    with scratch(rows.sparkSession) as lasting:
        repeats = lasting(batch_duplicates(keyed, C("card")))
        firsts = keyed.join(repeats, "row_idx", "left_anti")
        stored = lasting(ledger_duplicates(firsts, ledger, keys))
    flags = (repeats.select("row_idx", L(True).alias("in_import"))
             .unionByName(stored.select("row_idx", L(False).alias("in_import"))))
    cards = keyed.select("row_idx", "ref", "card")
    joined = rows.join(cards, "row_idx", "left").join(flags, "row_idx", "left")
    in_import = F.coalesce("in_import", L(False))
    own_card = trimmed(F.coalesce("card_number_masked", L("")))
    return joined.withColumns({
        "reference_number": C("ref"),
        "card_number_masked": F.when((own_card == "") & (C("card") != ""), C("card"))
        .otherwise(C("card_number_masked")),
        "exclude": F.coalesce("exclude", L(False)),
        "duplicate": C("in_import").isNotNull(),
        "duplicate_in_import": in_import,
        "duplicate_in_database": C("in_import").isNotNull() & ~in_import,
    }).drop("ref", "card", "in_import")


def default_exclude(checked: DataFrame, previous: DataFrame) -> DataFrame:
    """Exclusion after a re-check: new duplicates are excluded, known ones keep their choice.

    previous(row_idx, duplicate, exclude) is the state before; of several states of one row the
    greatest counts.
    """
    before = one_per_key(previous.select(
        "row_idx", C("duplicate").alias("was_duplicate"), C("exclude").alias("was_excluded")),
        ["row_idx"])
    kept = F.when(F.coalesce("was_duplicate", L(False)),
                  F.coalesce("was_excluded", L(False))).otherwise(True)
    return checked.join(before, "row_idx", "left").withColumn(
        "exclude", F.when(C("duplicate"), kept).otherwise(C("exclude"))
    ).drop("was_duplicate", "was_excluded")


def assign_period(rows: DataFrame, detected: DataFrame, chosen: DataFrame) -> DataFrame:
    """import_month and import_year per file: a valid chosen period, else the detected one.

    detected and chosen: (user_id, source_file, month, year); of several of one file the latest
    counts.
    """
    key = ["user_id", "source_file"]
    valid = one_per_key(chosen.filter(
        C("month").between(1, 12) & C("year").between(2000, 2100)).select(
        *key, C("year").alias("chosen_year"), C("month").alias("chosen_month")), key)
    found = one_per_key(detected.select(*key, "year", "month"), key)
    # stored, so that its size is known: joined by shuffle, a file's rows would meet in one task
    periods = cut_lineage(null_safe_join(found, valid, key).select(
        "user_id", "source_file", F.coalesce("chosen_month", "month").alias("import_month"),
        F.coalesce("chosen_year", "year").alias("import_year")))
    base = rows.drop("import_month", "import_year")
    return null_safe_join(base, periods, ["user_id", "source_file"])


def _lacks() -> dict[str, Column]:
    """The required fields in order, and whether a row lacks each."""
    return {
        "date": C("transaction_date").isNull(),
        "merchant": F.coalesce(stripped("merchant_name"), L("")) == "",
        "amount": C("amount").isNull() | F.isnan("amount"),
        "type": ~F.coalesce("transaction_type", L("")).isin(*TRANSACTION_TYPES)}


def missing_fields() -> Column:
    """Names of the required fields a row lacks, in order."""
    return F.array_compact(F.array(*[F.when(lacks, name) for name, lacks in _lacks().items()]))


def is_complete() -> Column:
    """Whether a row lacks no required field; without the list, in generated code."""
    return ~reduce(lambda a, b: a | b, _lacks().values())


def missing_required(rows: DataFrame) -> DataFrame:
    """Rows that lack a required field, with the list."""
    return rows.withColumn("missing", missing_fields()).filter(F.size("missing") > 0)
