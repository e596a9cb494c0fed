"""Recurring rules: schedules, due rows, and the effect of editing or cutting a rule."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions.joins import null_safe_join, one_per_key, within, without
from tallybook.functions.money import from_cents

C, L = F.col, F.lit

COPIED_FIELDS = ("merchant_name", "amount", "amount_cents", "transaction_type", "currency",
                 "category_id", "account_id", "notes")


def _ceiling(as_of: date) -> Column:
    return F.least(L(as_of), F.coalesce("end_date", L(as_of)))


def _last_step(as_of: date) -> Column:
    """Number of the last step that can lie at or before the ceiling (one too many at most)."""
    start, ceiling = C("start_date"), _ceiling(as_of)
    years = F.year(ceiling) - F.year(start)
    months = years * 12 + F.month(ceiling) - F.month(start)
    days = F.datediff(ceiling, start)
    return (F.when(C("frequency") == "monthly", months)
            .when(C("frequency") == "yearly", years)
            .when(C("frequency") == "weekly", F.floor(days / 7))
            .when(C("frequency") == "biweekly", F.floor(days / 14))).cast("int")


def _scheduled(step: Column) -> Column:
    """Date of a step, always counted from the start so short months do not drift."""
    start = C("start_date")
    return (F.when(C("frequency") == "monthly", F.add_months(start, step))
            .when(C("frequency") == "yearly", F.add_months(start, step * 12))
            .when(C("frequency") == "weekly", F.date_add(start, step * 7))
            .when(C("frequency") == "biweekly", F.date_add(start, step * 14)))


def expand_schedule(rules: DataFrame, as_of: date) -> DataFrame:
    """One row per rule and scheduled date up to the ceiling min(as_of, end_date)."""
    return (rules.filter(C("start_date") <= _ceiling(as_of))
            .withColumn("step", F.explode(F.sequence(L(0), _last_step(as_of))))
            .withColumn("due_date", _scheduled(C("step")))
            .filter(C("due_date") <= _ceiling(as_of)))


def horizon_of(as_of: date) -> Column:
    """Last scheduled date in closed form; null when nothing is scheduled yet."""
    last = _last_step(as_of)
    candidate = _scheduled(last)
    return F.when(C("start_date") <= _ceiling(as_of),
                  F.when(candidate <= _ceiling(as_of), candidate).otherwise(_scheduled(last - 1)))


def horizon(rules: DataFrame, as_of: date) -> DataFrame:
    return rules.select("id", "user_id", horizon_of(as_of).alias("horizon"))


def due_dates(rules: DataFrame, as_of: date) -> DataFrame:
    """Scheduled dates after the last one already created."""
    return expand_schedule(rules, as_of).filter(
        C("last_created_date").isNull() | (C("due_date") > C("last_created_date")))


def _ledger_rows(dated_rules: DataFrame, day: str) -> DataFrame:
    """Ledger rows copied from rules for a date column."""
    def missing(kind: str) -> Column:
        return L(None).cast(kind)

    return dated_rules.select(
        C("new_id").alias("id"), "user_id", C(day).alias("transaction_date"), missing("date").alias("posted_date"),
        missing("string").alias("reference_number"),
        *[missing("string").alias(c) for c in ("merchant_city", "merchant_state",
                                               "merchant_country", "mcc_description")],
        *COPIED_FIELDS, missing("string").alias("import_batch_id"),
        L(False).alias("is_excluded"), C("id").alias("recurring_rule_id"),
        C(day).cast("timestamp").alias("created_at"))


def _with_step_ids(dated_rules: DataFrame, rules: DataFrame, ledger: DataFrame) -> DataFrame:
    """Ledger rows of expanded rules, with ids beyond the ledger's.

    New ids are max(id) + 1 + step * (max rule id + 1) + rule id: unique and the same on every
    attempt, without numbering all rows in one task.
    """
    first = ledger.agg(F.coalesce(F.max("id"), L(0)) + 1).scalar()
    width = rules.agg(F.coalesce(F.max("id"), L(0)) + 1).scalar()
    new_id = (first + C("step") * width + C("id")).cast("long")
    return _ledger_rows(dated_rules.withColumn("new_id", new_id), "due_date")


def process_due(rules: DataFrame, ledger: DataFrame,
                as_of: date) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new ledger rows, rules with last_created_date moved on, counts per user)."""
    due = due_dates(rules, as_of)
    rows = _with_step_ids(due, rules, ledger)
    last = horizon_of(as_of)
    triggered = last.isNotNull() & (
        C("last_created_date").isNull() | (last > C("last_created_date")))
    moved = rules.withColumn(
        "last_created_date", F.when(triggered, last).otherwise(C("last_created_date")))
    counts = due.groupBy("user_id").agg(
        F.count(L(1)).alias("created"), F.count_distinct("id").alias("rules_triggered"))
    return rows, moved, counts


def _split(ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows linked to a rule, all others): the others never enter a join on the rule id, where
    their null key would gather in one partition."""
    is_linked = C("recurring_rule_id").isNotNull()
    return ledger.filter(is_linked), ledger.filter(~is_linked)


def _linked(ledger: DataFrame, rules: DataFrame) -> DataFrame:
    """Ledger rows of the given rules (same user), with rule_id."""
    linked = ledger.filter(C("recurring_rule_id").isNotNull()).withColumn(
        "rule_id", C("recurring_rule_id"))
    return within(linked, rules.select("user_id", C("id").alias("rule_id")),
                  ["user_id", "rule_id"])


def _edited(field: str, given: list[str], flag: str) -> Column:
    """new_<field> where it is not null or its flag is set, else the field as it is."""
    value = F.coalesce(f"new_{field}", field)
    if f"set_{field}" not in given:
        return value
    return F.when(C(flag + field), C(f"new_{field}")).otherwise(value)


def changed_rules(rules: DataFrame, changes: DataFrame) -> DataFrame:
    """Rules with their edits applied.

    `changes` holds the full new schedule (start_date, frequency, end_date) and, where not null,
    new values for copied fields; a true set_<field> also sets the field to null. Of several
    changes of one rule the greatest counts, as one_per_key compares them. Adds schedule_changed.
    """
    changes = one_per_key(changes, ["id", "user_id"])
    new = changes.select("id", "user_id", *[
        C(c).alias(f"new_{c}") for c in changes.columns if c not in ("id", "user_id")])
    joined = null_safe_join(rules, new, ["id", "user_id"], "inner")
    schedule = ("start_date", "frequency", "end_date")
    differs = [~C(c).eqNullSafe(C(f"new_{c}")) for c in schedule]
    out = joined.withColumn("schedule_changed", differs[0] | differs[1] | differs[2])
    for c in schedule:
        out = out.withColumn(c, C(f"new_{c}"))
    for c in COPIED_FIELDS:
        if f"new_{c}" in joined.columns:
            out = out.withColumn(c, _edited(c, changes.columns, "new_set_"))
    if "new_amount_cents" in joined.columns:
        out = out.withColumn("amount", from_cents(C("amount_cents")))
    return out.select(*rules.columns, "schedule_changed")


def _overlap(changed: DataFrame, ledger: DataFrame, as_of: date) -> DataFrame:
    """Linked rows whose date is not in the new schedule."""
    expected = expand_schedule(changed, as_of).select(
        "user_id", C("id").alias("rule_id"), C("due_date").alias("transaction_date"))
    return without(_linked(ledger, changed), expected,
                   ["user_id", "rule_id", "transaction_date"])


def _missing(changed: DataFrame, ledger: DataFrame, as_of: date) -> DataFrame:
    """Scheduled dates of the new schedule without a linked row."""
    held = _linked(ledger, changed).select(
        "user_id", C("rule_id").alias("id"), C("transaction_date").alias("due_date")).distinct()
    return without(expand_schedule(changed, as_of), held, ["user_id", "id", "due_date"])


def preview_update(rules: DataFrame, changes: DataFrame, ledger: DataFrame,
                   as_of: date) -> DataFrame:
    """Per edited rule: schedule_changed, rows outside and dates missing from the new schedule."""
    changed = changed_rules(rules, changes)
    outside = (_overlap(changed, ledger, as_of).groupBy("user_id", C("rule_id").alias("id"))
               .agg(F.count(L(1)).alias("overlap_count")))
    absent = (_missing(changed, ledger, as_of).groupBy("user_id", "id")
              .agg(F.count(L(1)).alias("missing_count"), F.min("due_date").alias("first_missing")))
    base = changed.select("id", "user_id", "schedule_changed", horizon_of(as_of).alias("horizon"))
    out = null_safe_join(null_safe_join(base, outside, ["user_id", "id"]), absent,
                         ["user_id", "id"])
    return out.withColumn("overlap_count", F.coalesce("overlap_count", L(0))).withColumn(
        "missing_count", F.coalesce("missing_count", L(0)))


def preview_rows(rules: DataFrame, changes: DataFrame, ledger: DataFrame,
                 as_of: date) -> DataFrame:
    """The rows behind the preview: kind overlap (existing rows) or missing (dates)."""
    changed = changed_rules(rules, changes)
    overlap = _overlap(changed, ledger, as_of).select(
        "user_id", "rule_id", L("overlap").alias("kind"), C("id").alias("transaction_id"),
        C("transaction_date").alias("day"))
    missing = _missing(changed, ledger, as_of).select(
        "user_id", C("id").alias("rule_id"), L("missing").alias("kind"),
        L(None).cast("long").alias("transaction_id"), C("due_date").alias("day"))
    return overlap.unionByName(missing)


def apply_update(rules: DataFrame, changes: DataFrame, ledger: DataFrame,
                 as_of: date) -> tuple[DataFrame, DataFrame]:
    """(ledger, rules) after the edits.

    Per change: remove_overlap drops linked rows off the new schedule, backfill_missing adds rows
    for dates without one, copied fields spread to every linked row, and a changed schedule moves
    last_created_date to the horizon.
    """
    changes = one_per_key(changes, ["id", "user_id"])
    changed = changed_rules(rules, changes)
    options = changes.select("id", "user_id", "remove_overlap", "backfill_missing")
    with_options = null_safe_join(changed, options, ["id", "user_id"])
    dropped = _overlap(with_options.filter("remove_overlap"), ledger, as_of).select("id")
    linked, others = _split(ledger)
    kept = linked.join(dropped, "id", "left_anti")
    edits = [c for c in COPIED_FIELDS if c in changes.columns]
    new = changes.select(C("id").alias("recurring_rule_id"), "user_id",
                         *[C(c).alias(f"new_{c}") for c in edits],
                         *[C(f"set_{c}") for c in edits if f"set_{c}" in changes.columns])
    condition =(C("user_id").eqNullSafe(C("_u")) & (C("recurring_rule_id") == C("_r")))
    kept = kept.join(new.withColumnsRenamed({"recurring_rule_id": "_r", "user_id": "_u"}),
                     condition, "left")
    for c in edits:
        kept = kept.withColumn(c, _edited(c, changes.columns, "set_"))
    if "amount_cents" in edits:
        kept = kept.withColumn("amount", F.when(
            C("new_amount_cents").isNotNull(), from_cents(C("amount_cents")))
            .otherwise(C("amount")))
    kept = kept.select(*ledger.columns)
    fill = _missing(with_options.filter("backfill_missing"), ledger, as_of)
    added = _with_step_ids(fill, rules, ledger)
    moved = changed.withColumn("last_created_date", F.when(
        C("schedule_changed"), horizon_of(as_of)).otherwise(C("last_created_date")))
    new_rules = without(rules, changes, ["id", "user_id"]).unionByName(
        moved.drop("schedule_changed"))
    return others.unionByName(kept).unionByName(added), new_rules


def needs_confirmation(preview: DataFrame, changes: DataFrame) -> DataFrame:
    """Edits that change the schedule and leave overlapping or missing rows undecided."""
    choices = one_per_key(changes, ["id", "user_id"]).select(
        "id", "user_id", "keep_overlap", "remove_overlap", "backfill_missing", "skip_backfill")
    joined = null_safe_join(preview, choices, ["id", "user_id"])
    overlap_open = (C("overlap_count") > 0) & ~(C("keep_overlap") | C("remove_overlap"))
    missing_open = (C("missing_count") > 0) & ~(C("backfill_missing") | C("skip_backfill"))
    return joined.filter(C("schedule_changed") & (overlap_open | missing_open)).select(
        "id", "user_id", "overlap_count", "missing_count")


def cut_rules(ledger: DataFrame, rules: DataFrame,
              cuts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ledger, rules) after ending rules at a date: cuts(id, user_id, from_date).

    Linked rows from that date on go; the rule ends the day before, or goes when it would end
    before it starts; last_created_date falls back to the newest remaining row. Of several cuts of
    one rule the earliest counts; a cut without a date changes nothing.
    """
    cuts = cuts.filter(C("from_date").isNotNull()).groupBy("id", "user_id").agg(
        F.min("from_date").alias("from_date"))
    marks = cuts.select(C("id").alias("_r"), C("user_id").alias("_u"), "from_date")
    condition = C("user_id").eqNullSafe(C("_u")) & (C("recurring_rule_id") == C("_r"))
    linked, others = _split(ledger)
    marked = linked.join(marks, condition, "left")
    is_cut = C("from_date").isNotNull() & (C("transaction_date") >= C("from_date"))
    left = others.unionByName(marked.filter(~is_cut).select(*ledger.columns))
    newest = (marked.filter(C("transaction_date") < C("from_date"))
              .groupBy("user_id", C("recurring_rule_id").alias("id"))
              .agg(F.max("transaction_date").alias("newest")))
    joined = null_safe_join(null_safe_join(rules, cuts.select("id", "user_id", "from_date"),
                                           ["id", "user_id"]), newest, ["id", "user_id"])
    new_end = F.date_sub("from_date", 1)
    touched = C("from_date").isNotNull()
    out = (joined.filter(~touched | (C("start_date") <= new_end))
           .withColumn("last_created_date", F.when(
               touched & (C("last_created_date") >= C("from_date")), C("newest"))
               .otherwise(C("last_created_date")))
           .withColumn("end_date", F.when(touched, new_end).otherwise(C("end_date"))))
    return left, out.select(*rules.columns)


def drop_rules(ledger: DataFrame, rules: DataFrame,
               gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ledger, rules) without the rules in gone(id, user_id) and their linked rows."""
    linked, others = _split(ledger)
    marks = gone.select(C("id").alias("_r"), C("user_id").alias("_u"))
    left = linked.join(marks, C("user_id").eqNullSafe(C("_u"))
                       & (C("recurring_rule_id") == C("_r")), "left_anti")
    return others.unionByName(left), without(rules, gone, ["id", "user_id"])


def invalid_windows(rules: DataFrame) -> DataFrame:
    """Rules that end before they start."""
    return rules.filter(C("end_date") < C("start_date"))
