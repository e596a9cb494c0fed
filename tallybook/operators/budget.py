"""Budgets: limits, trailing averages, budget against actual."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.functions.dates import month_floor, month_label, month_text, shift_month
from tallybook.functions.joins import null_safe_join, without
from tallybook.functions.money import average_cents, from_cents
from tallybook.operators.listing import null_safe_left

C, L = F.col, F.lit

UNCATEGORIZED_KEY = "uncategorized"


def budget_key(category_id: Column) -> Column:
    return F.coalesce(F.concat(L("cat:"), category_id.cast("string")), L(UNCATEGORIZED_KEY))


def category_of_key(key: Column) -> Column:
    """Category id of a budget key; null for 'uncategorized' and unreadable keys."""
    return F.when(key.startswith("cat:"),
                  F.substring(key, L(5), F.length(key)).try_cast("long"))


def read_rules(rules: DataFrame, hidden: DataFrame) -> DataFrame:
    """Per user: total limit (lowest rule id when several), number and sum of category limits,
    and the hidden keys in order."""
    limits = rules.groupBy("user_id").agg(
        F.min_by("limit_cents", F.when(C("is_total"), C("id"))).alias("total_cents"),
        F.count_if(~C("is_total")).alias("rule_count"),
        F.coalesce(F.sum(F.when(~C("is_total"), C("limit_cents"))), L(0)).alias("rule_cents"))
    keys = hidden.groupBy("user_id").agg(
        F.array_join(F.sort_array(F.collect_set("category_key")), ",").alias("hidden_keys"))
    return null_safe_join(limits, keys, ["user_id"])


def category_limits(rules: DataFrame) -> DataFrame:
    """One limit per (user, category); the highest rule id wins when several exist."""
    return (rules.filter(~C("is_total")).groupBy("user_id", "category_id")
            .agg(F.max_by("limit_cents", "id").alias("limit_cents")))


def total_limits(rules: DataFrame) -> DataFrame:
    return (rules.filter("is_total").groupBy("user_id")
            .agg(F.min_by("limit_cents", "id").alias("total_cents")))


def replace_rules(current: DataFrame, current_hidden: DataFrame, proposed: DataFrame,
                  proposed_hidden: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rules, hidden keys, violations) after users replace their whole budget.

    A user whose total is below the sum of the category limits keeps the old budget and appears
    in the violations. Keys of budgeted categories are never hidden.
    """
    sums = proposed.groupBy("user_id").agg(
        F.min_by("limit_cents", F.when(C("is_total"), C("id"))).alias("total_cents"),
        F.coalesce(F.sum(F.when(~C("is_total"), C("limit_cents"))), L(0)).alias("sum_cents"))
    violations = sums.filter(C("total_cents") < C("sum_cents"))
    accepted = without(proposed, violations, ["user_id"])
    savers = accepted.select("user_id").distinct()
    rules = without(current, savers, ["user_id"]).unionByName(accepted)
    visible = accepted.filter(~C("is_total")).select(
        "user_id", budget_key(C("category_id")).alias("category_key")).distinct()
    new_hidden = without(
        null_safe_join(proposed_hidden.filter(C("category_key") != ""), savers, ["user_id"],
                       "left_semi").distinct(),
        visible, ["user_id", "category_key"])
    hidden = without(current_hidden, savers, ["user_id"]).unionByName(new_hidden)
    return rules, hidden.withColumn("category_id", category_of_key(C("category_key"))), violations


def _expenses(ledger: DataFrame) -> DataFrame:
    # budgets count excluded transactions too
    return ledger.filter(C("transaction_type") == "expense")


def trailing_averages(ledger: DataFrame, categories: DataFrame, rules: DataFrame,
                      as_of: date) -> DataFrame:
    """Average monthly spend per category over 6, 3 and 1 months back, with its limit.

    Each window also holds the running month, and nothing bounds it above. One pass over the
    ledger feeds the three sums; the full join adds budgeted categories without any spend.
    """
    starts = {n: shift_month(as_of, -n) for n in (6, 3, 1)}
    spent = (_expenses(ledger).filter(C("transaction_date") >= L(starts[6]))
             .groupBy("user_id", "category_id")
             .agg(*[F.coalesce(F.sum(F.when(C("transaction_date") >= L(start),
                                            C("amount_cents"))), L(0)).alias(f"t{n}")
                    for n, start in starts.items()])
             .withColumn("has_spend", L(True)))
    limits = category_limits(rules).select(
        C("user_id").alias("limit_user"), C("category_id").alias("limit_category"),
        "limit_cents", L(True).alias("has_limit"))
    both = spent.join(limits, C("user_id").eqNullSafe(C("limit_user"))
                      & C("category_id").eqNullSafe(C("limit_category")), "full").select(
        F.when(C("has_spend"), C("user_id")).otherwise(C("limit_user")).alias("user_id"),
        F.when(C("has_spend"), C("category_id")).otherwise(C("limit_category"))
        .alias("category_id"),
        *[F.coalesce(f"t{n}", L(0)).alias(f"t{n}") for n in starts], "limit_cents", "has_spend")
    names = categories.select("user_id", C("id").alias("category_id"), "name", "color")
    named = null_safe_left(both, names, "category_id")
    missing = F.when(C("has_spend"), L("Uncategorized")).otherwise(L("Unknown"))
    return (named.select(
        "user_id", "category_id", budget_key(C("category_id")).alias("category_key"),
        F.coalesce("name", missing).alias("category_name"), C("color").alias("category_color"),
        *[from_cents(average_cents(C(f"t{n}"), n)).alias(f"avg_{n}m") for n in starts],
        from_cents(C("limit_cents")).alias("limit_amount"))
        .orderBy(C("user_id").asc_nulls_first(), C("avg_6m").desc(), "category_key"))


def month_spine(spark: SparkSession, first: date, last: date) -> DataFrame:
    """Months between two dates, inclusive; empty when first is after last."""
    months = F.sequence(F.trunc(L(first), "MM"), F.trunc(L(last), "MM"),
                        F.expr("interval 1 month"))
    return (spark.range(1).filter(L(first.replace(day=1) <= last))
            .select(F.explode(months).alias("first_day"))
            .select("first_day", month_text(C("first_day")).alias("ym"),
                    month_label(C("first_day")).alias("label")))


def _each_month(df: DataFrame, first: date, last: date) -> DataFrame:
    """Every row repeated once per month, generated in place (no join)."""
    if first.replace(day=1) > last:
        return df.withColumn("first_day", L(None).cast("date")).limit(0)
    return df.withColumn("first_day", F.explode(F.sequence(
        F.trunc(L(first), "MM"), F.trunc(L(last), "MM"), F.expr("interval 1 month"))))


def _monthly_spend(ledger: DataFrame, first: date, last: date) -> DataFrame:
    day = C("transaction_date")
    return (_expenses(ledger)
            .filter((day >= L(first.replace(day=1))) & (day < L(shift_month(last, 1))))
            .groupBy("user_id", month_floor(day).alias("first_day"), "category_id")
            .agg(F.sum("amount_cents").alias("spent_cents")))


def budget_vs_actual(ledger: DataFrame, categories: DataFrame, rules: DataFrame, first: date,
                     last: date) -> DataFrame:
    """For every month and budgeted category: budget, spent and whether spent exceeds it."""
    plan = _each_month(category_limits(rules), first, last)
    spend = _monthly_spend(ledger, first, last)
    keys = ["user_id", "first_day", "category_id"]
    names = categories.select("user_id", C("id").alias("category_id"), "name", "color")
    spent = F.coalesce("spent_cents", L(0))
    return (null_safe_left(null_safe_join(plan, spend, keys), names, "category_id")
            .select("user_id", month_text(C("first_day")).alias("ym"), "category_id",
                    F.coalesce("name", L("Unknown")).alias("category_name"),
                    C("color").alias("category_color"),
                    from_cents(C("limit_cents")).alias("budget"),
                    from_cents(spent).alias("spent"),
                    (spent > C("limit_cents")).alias("over")))


def monthly_totals(ledger: DataFrame, rules: DataFrame, users: DataFrame, first: date,
                   last: date) -> DataFrame:
    """Per month: total budget, total spend and the spend outside budgeted categories."""
    budgeted = category_limits(rules).select("user_id", "category_id",
                                             L(True).alias("is_budgeted"))
    spend = null_safe_join(_monthly_spend(ledger, first, last), budgeted,
                           ["user_id", "category_id"])
    sums = spend.groupBy("user_id", "first_day").agg(
        F.sum("spent_cents").alias("total_cents_spent"),
        F.coalesce(F.sum(F.when(C("is_budgeted").isNull(), C("spent_cents"))), L(0))
        .alias("others_cents"))
    spine = _each_month(users.select("user_id"), first, last)
    joined = null_safe_join(null_safe_join(spine, sums, ["user_id", "first_day"]),
                            total_limits(rules), ["user_id"])
    return joined.select(
        "user_id", month_text(C("first_day")).alias("ym"),
        month_label(C("first_day")).alias("label"),
        from_cents(C("total_cents")).alias("total_budget"),
        from_cents(F.coalesce("total_cents_spent", L(0))).alias("total_spent"),
        from_cents(F.coalesce("others_cents", L(0))).alias("others_spent"))


def visible_rows(averages: DataFrame, hidden: DataFrame, sort_by: str = "avg_6m",
                 ascending: bool = False) -> DataFrame:
    """Budget table rows: not hidden, and spent on or limited; missing limits sort as -1."""
    shown = without(averages, hidden, ["user_id", "category_key"]).filter(
        (C("avg_6m") > 0) | C("limit_amount").isNotNull())
    keys = {"name": F.lower("category_name"),
            "limit": F.coalesce("limit_amount", L(-1.0))}
    key = keys.get(sort_by, C(sort_by) if sort_by in averages.columns else C("avg_6m"))
    return shown.orderBy(C("user_id").asc_nulls_first(),
                         key.asc() if ascending else key.desc(), "category_key")


def unallocated(rules: DataFrame) -> DataFrame:
    """Total budget minus the category limits; negative means the budget is invalid."""
    sums = rules.groupBy("user_id").agg(
        F.min_by("limit_cents", F.when(C("is_total"), C("id"))).alias("total"),
        F.coalesce(F.sum(F.when(~C("is_total"), C("limit_cents"))), L(0)).alias("parts"))
    left = C("total") - C("parts")
    return sums.filter(C("total").isNotNull()).select(
        "user_id", from_cents(left).alias("unallocated"), (left >= 0).alias("is_valid"))


def progress(items: DataFrame) -> DataFrame:
    """Progress of budget_vs_actual items: percent used (at most 100), over flag."""
    has_limit = C("budget") > 0
    used = F.when(has_limit, F.least(C("spent") / C("budget") * L(100.0), L(100.0)))
    return items.select(
        "user_id", "ym", "category_id", "category_name", "budget", "spent",
        F.coalesce(used, L(0.0)).alias("pct"),
        (has_limit & (C("spent") > C("budget"))).alias("over"))


def over_months(totals: DataFrame) -> DataFrame:
    """monthly_totals with a flag for months above the total budget."""
    return totals.withColumn(
        "over_budget", F.coalesce(C("total_spent") > C("total_budget"), L(False)))


def addable_categories(averages: DataFrame, categories: DataFrame,
                       hidden: DataFrame) -> DataFrame:
    """Categories not yet in the visible budget table, plus 'uncategorized' when hidden or
    unseen; most spent first."""
    visible = visible_rows(averages, hidden).select("user_id", "category_key")
    spend = averages.select("user_id", "category_key", "avg_6m")
    own = categories.select("user_id", budget_key(C("id")).alias("category_key"), "name",
                            "color")
    candidates = null_safe_join(own, spend, ["user_id", "category_key"])
    loose = averages.filter(C("category_id").isNull()).select(
        "user_id", "category_key", C("category_name").alias("name"),
        F.coalesce("category_color", L("")).alias("color"), "avg_6m")
    return (without(candidates.unionByName(loose), visible, ["user_id", "category_key"])
            .withColumn("avg_6m", F.coalesce("avg_6m", L(0.0)))
            .orderBy(C("user_id").asc_nulls_first(), C("avg_6m").desc(), "name"))
