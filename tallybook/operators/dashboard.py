"""Category shares, monthly bars and category statistics."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybook.functions.dates import month_floor, month_label, parse_months
from tallybook.functions.joins import null_safe_join
from tallybook.functions.money import from_cents, tenths_of_percent
from tallybook.operators.listing import filter_ledger, null_safe_left
from tallybook.schemas import OTHER_COLOR, SLICE_COLORS

C, L = F.col, F.lit


def category_pie(ledger: DataFrame, categories: DataFrame, transaction_type: str = "expense",
                 months: str | None = None) -> DataFrame:
    """Cents per (user, category name, colour); rows without an owned category: Uncategorized.

    Amounts are pre-aggregated per category id, so the join with the categories sees one row per
    (user, category) instead of every transaction.
    """
    rows = filter_ledger(ledger, months=months if parse_months(months) else None,
                         transaction_type=transaction_type)
    per_id = rows.groupBy("user_id", "category_id").agg(F.sum("amount_cents").alias("cents"))
    names = categories.select("user_id", C("id").alias("category_id"), "name", "color")
    return (null_safe_left(per_id, names, "category_id")
            .groupBy("user_id", "name", "color").agg(F.sum("cents").alias("amount_cents"))
            .select("user_id", F.coalesce("name", L("Uncategorized")).alias("category"),
                    "color", "amount_cents"))


def with_palette(pie: DataFrame) -> DataFrame:
    """Slices in rank order with a palette colour where the category has none.

    The window sees one row per category of a user, never transactions.
    """
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(
        C("amount_cents").desc(), "category"))
    palette = F.array(*[L(c) for c in SLICE_COLORS])
    return (pie.withColumn("rank", rank)
            .withColumn("color", F.coalesce(
                "color", F.element_at(palette, (C("rank") - 1) % len(SLICE_COLORS) + 1))))


def pie_totals(expense_pie: DataFrame, income_pie: DataFrame) -> DataFrame:
    """Total expenses, total income and net (income - expense) per user, from the slices."""
    sides = (expense_pie.select("user_id", C("amount_cents").alias("e"), L(0).alias("i"))
             .unionByName(income_pie.select("user_id", L(0).alias("e"),
                                            C("amount_cents").alias("i"))))
    return (sides.groupBy("user_id").agg(F.sum("e").alias("e"), F.sum("i").alias("i"))
            .select("user_id", from_cents(C("e")).alias("total_expenses"),
                    from_cents(C("i")).alias("total_income"),
                    from_cents(C("i") - C("e")).alias("net")))


def monthly_bars(ledger: DataFrame, users: DataFrame, months: str | None = None) -> DataFrame:
    """Expenses and income per user and month.

    Asked-for months come back in the order asked, zero-filled; without a list every month that
    has any counted transaction appears, also with zeros when it only holds other types.
    """
    wanted = parse_months(months)
    rows = filter_ledger(ledger, months=months if wanted else None)
    sums = rows.groupBy("user_id", month_floor(C("transaction_date")).alias("first_day")).agg(
        *[F.coalesce(F.sum(F.when(C("transaction_type") == kind, C("amount_cents"))), L(0))
          .alias(kind) for kind in ("expense", "income")])
    if wanted:
        spine = users.select("user_id", F.posexplode(
            F.array(*[L(m) for m in wanted])).alias("position", "first_day"))
        sums = null_safe_join(spine, sums, ["user_id", "first_day"])
    else:
        position = F.months_between("first_day", L(date(1900, 1, 1))).cast("int")
        sums = sums.withColumn("position", position)
    return sums.select(
        "user_id", "position", F.year("first_day").alias("year"),
        F.month("first_day").alias("month"), month_label(C("first_day")).alias("label"),
        from_cents(F.coalesce("expense", L(0))).alias("expenses"),
        from_cents(F.coalesce("income", L(0))).alias("income"))


def bucket_small(slices: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Slices below the threshold of their user's total merged into one 'other (a, b)' slice.

    Rank order of the members is kept in the label. Works on slices (one row per category).
    """
    totals = slices.groupBy("user_id").agg(F.sum("amount_cents").alias("total_cents"))
    joined = null_safe_join(slices, totals, ["user_id"])
    small = (C("total_cents") != 0) & (C("amount_cents") / C("total_cents") < L(threshold))
    marked = joined.withColumn("is_small", F.coalesce(small, L(False)))
    main = marked.filter(~C("is_small")).select("user_id", "category", "color", "amount_cents")
    members = F.sort_array(F.collect_list(F.struct("rank", "category")))
    merged = (marked.filter("is_small").groupBy("user_id")
              .agg(members.alias("members"), F.sum("amount_cents").alias("amount_cents"))
              .select("user_id",
                      F.concat(L("other ("), F.array_join("members.category", ", "), L(")"))
                      .alias("category"),
                      L(OTHER_COLOR).alias("color"), "amount_cents"))
    return main.unionByName(merged)


def with_share(slices: DataFrame) -> DataFrame:
    """Percent of the user's total, one decimal."""
    totals = slices.groupBy("user_id").agg(F.sum("amount_cents").alias("total_cents"))
    return null_safe_join(slices, totals, ["user_id"]).withColumn(
        "pct", tenths_of_percent(C("amount_cents"), C("total_cents"))).drop("total_cents")


def category_stats(categories: DataFrame, ledger: DataFrame) -> DataFrame:
    """Every category with its number of transactions and their sum (excluded ones count)."""
    per_id = (ledger.groupBy("user_id", "category_id")
              .agg(F.count(L(1)).alias("tx_count"), F.sum("amount_cents").alias("cents"))
              .withColumnRenamed("category_id", "id"))
    return (null_safe_left(categories, per_id, "id")
            .select("id", "user_id", "name", "color",
                    F.coalesce("keywords", L("")).alias("keywords"),
                    F.coalesce("tx_count", L(0)).alias("tx_count"),
                    from_cents(F.coalesce("cents", L(0))).alias("total"))
            .orderBy(C("user_id").asc_nulls_first(), "name"))


def rule_counts(rules: DataFrame, ledger: DataFrame) -> DataFrame:
    """Number of ledger rows linked to each recurring rule of the same user."""
    linked = (ledger.filter(C("recurring_rule_id").isNotNull())
              .groupBy("user_id", C("recurring_rule_id").alias("id"))
              .agg(F.count(L(1)).alias("n")))
    return null_safe_left(rules.select("id", "user_id"), linked, "id").select(
        "id", "user_id", F.coalesce("n", L(0)).alias("transaction_count"))
