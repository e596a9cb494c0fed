"""Null-safe joins: the local tenant has a null user_id, so every key compares with <=>."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left",
                   extra: Column | None = None) -> DataFrame:
    """Join on keys of the same name with null = null; the left side's keys are kept."""
    renamed = right.select(*[
        F.col(c).alias(f"_right_{c}") if c in keys else F.col(c) for c in right.columns])
    condition = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    if extra is not None:
        condition = condition & extra
    return left.join(renamed, condition, how).drop(*[f"_right_{k}" for k in keys])


def without(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `left` with no partner in `right`."""
    return null_safe_join(left, right.select(*keys), keys, "left_anti")


def within(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `left` with a partner in `right`."""
    return null_safe_join(left, right.select(*keys), keys, "left_semi")


def one_per_key(changes: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: of several, the greatest, compared column by column (null is least)."""
    rest = [c for c in changes.columns if c not in keys]
    if not rest:
        return changes.distinct()
    return changes.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_row")).select(
        *keys, "_row.*")


def scoped(df: DataFrame, user: str | None) -> DataFrame:
    """Rows of one tenant; None is the local tenant."""
    return df.filter(F.col("user_id").eqNullSafe(F.lit(user).cast("string")))
