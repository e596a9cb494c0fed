"""Exact duplicates inside the stored ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.functions.joins import null_safe_join
from tallybook.functions.money import to_ten_thousandths

C, L = F.col, F.lit

DUPLICATE_KEY = "duplicate_key"
_KEPT_AS_TEXT = ("reference_number", "merchant_city", "merchant_state", "merchant_country",
                 "mcc_description", "notes")


def with_duplicate_key(ledger: DataFrame) -> DataFrame:
    """Add the fifteen-field key; a missing text equals '', the import batch takes no part."""
    texts = [F.coalesce(C(c), L("")).alias(c) for c in _KEPT_AS_TEXT]
    return ledger.withColumn(DUPLICATE_KEY, F.struct(
        "transaction_date", "posted_date", "merchant_name", *texts,
        to_ten_thousandths(F.coalesce(C("amount"), L(0.0))).alias("amount_e4"),
        "currency", "transaction_type", "account_id", "category_id", "is_excluded"))


def duplicate_groups(ledger: DataFrame, with_ids: bool = False) -> DataFrame:
    """Groups of equal rows: the id to keep, the size and the kept row's fields.

    The default carries no id list, so a group of any size is a partial aggregate; with_ids adds
    the other ids as rows of their own (one per copy) in place of one unbounded array.
    """
    groups = (with_duplicate_key(ledger).groupBy("user_id", DUPLICATE_KEY)
              .agg(F.min("id").alias("keep_id"), F.count(L(1)).alias("row_count"))
              .filter(C("row_count") > 1))
    if with_ids:
        keys = groups.select("user_id", DUPLICATE_KEY, "keep_id", "row_count")
        return null_safe_join(with_duplicate_key(ledger), keys,
                              ["user_id", DUPLICATE_KEY], "inner").select(
            "user_id", "keep_id", "row_count", C("id").alias("transaction_id"))
    summary = ledger.drop("user_id", "created_at").withColumnRenamed("id", "keep_id")
    return groups.select("user_id", "keep_id", "row_count").join(summary, "keep_id")


def duplicate_report(ledger: DataFrame) -> DataFrame:
    """Number of groups and of rows beyond the first, per user."""
    groups = (with_duplicate_key(ledger).groupBy("user_id", DUPLICATE_KEY)
              .agg(F.count(L(1)).alias("n")).filter(C("n") > 1))
    return groups.groupBy("user_id").agg(
        F.count(L(1)).alias("total_groups"), F.sum(C("n") - 1).alias("total_extra_rows"))


def _repeated(ledger: DataFrame) -> DataFrame:
    return (with_duplicate_key(ledger).groupBy("user_id", DUPLICATE_KEY)
            .agg(F.min("id").alias("keep_id"), F.count(L(1)).alias("n")).filter(C("n") > 1))


def prune_duplicates(ledger: DataFrame) -> DataFrame:
    """The ledger with only the lowest id of every group.

    Only keys that repeat are joined back, one row per key, so AQE broadcasts them when they are
    few and splits the hot key's partition when they are not.
    """
    keep = _repeated(ledger).select("user_id", DUPLICATE_KEY, "keep_id")
    joined = null_safe_join(with_duplicate_key(ledger), keep, ["user_id", DUPLICATE_KEY])
    return (joined.filter(C("keep_id").isNull() | (C("keep_id") == C("id")))
            .drop("keep_id", DUPLICATE_KEY))


def flag_duplicates(ledger: DataFrame) -> DataFrame:
    """Every row with exact_duplicate."""
    keys = _repeated(ledger).select("user_id", DUPLICATE_KEY, "n")
    return (null_safe_join(with_duplicate_key(ledger), keys, ["user_id", DUPLICATE_KEY])
            .withColumn("exact_duplicate", C("n").isNotNull()).drop("n", DUPLICATE_KEY))
