"""Batch changes of the ledger and its dimensions, as new tables (copy on write)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions.joins import null_safe_join, one_per_key, within, without
from tallybook.functions.money import from_cents
from tallybook.functions.text import keyword_list, keywords_csv, trimmed
from tallybook.operators.budget import category_of_key
from tallybook.operators.keywords import keyword_conflicts, keyword_rules

C, L = F.col, F.lit


def bulk_delete(ledger: DataFrame, ids: DataFrame) -> DataFrame:
    """Ledger without ids(user_id, id); an id of another user stays."""
    return without(ledger, ids, ["user_id", "id"])


def owned_ids(ledger: DataFrame, ids: DataFrame) -> DataFrame:
    """Number of distinct listed rows each user really owns."""
    return within(ledger.select("user_id", "id"), ids, ["user_id", "id"]).groupBy(
        "user_id").agg(F.count(L(1)).alias("affected"))


def bulk_update(ledger: DataFrame, changes: DataFrame) -> DataFrame:
    """Ledger with changes(user_id, id, category_id, transaction_type); null leaves a field."""
    return apply_patches(ledger, changes, set_flags=False)


def apply_patches(ledger: DataFrame, patches: DataFrame, set_flags: bool = True) -> DataFrame:
    """Ledger with one patch per (user_id, id).

    With set_flags a field changes where its boolean set_<field> is true, also to null; else it
    changes where the patch value is not null. Of several patches of one row the greatest counts,
    as one_per_key compares them; the ledger keeps its rows.
    """
    fields = [c for c in patches.columns if c in ledger.columns and c not in ("user_id", "id")]
    new = one_per_key(patches.select(
        "user_id", "id", *[C(c).alias(f"_new_{c}") for c in fields],
        *[C(f"set_{c}") for c in fields if set_flags]), ["user_id", "id"])
    joined = null_safe_join(ledger, new, ["user_id", "id"])

    def value(c: str) -> Column:
        if c not in fields:
            if c == "amount" and "amount_cents" in fields:
                return F.when(changed("amount_cents"), from_cents(C("_new_amount_cents"))) \
                    .otherwise(C(c))
            return C(c)
        return F.when(changed(c), C(f"_new_{c}")).otherwise(C(c))

    def changed(c: str) -> Column:
        return (F.coalesce(C(f"set_{c}"), L(False)) if set_flags
                else C(f"_new_{c}").isNotNull())

    return joined.select(*[value(c).alias(c) for c in ledger.columns])


def ownership_violations(rows: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    """Rows whose `key` names a record that is not the same user's."""
    named = rows.filter(C(key).isNotNull())
    own = owners.select("user_id", C("id").alias(key))
    return without(named, own, ["user_id", key])


def accept_patches(patches: DataFrame, categories: DataFrame,
                   accounts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(patches whose category and account are the user's own, rejected ones with the field)."""
    rejected = None
    for key, owners in (("category_id", categories), ("account_id", accounts)):
        if key in patches.columns:
            bad = ownership_violations(patches, owners, key).select(
                "user_id", "id", L(key).alias("field"))
            rejected = bad if rejected is None else rejected.unionByName(bad)
    return without(patches, rejected, ["user_id", "id"]), rejected


def currency_code(code: Column) -> Column:
    """Upper-case three-letter code (blank means CAD); null when it is none."""
    text = F.upper(trimmed(F.coalesce(F.nullif(code, L("")), L("CAD"))))
    return F.when(text.rlike(r"^\p{L}{3}$"), text)


def rewrite_currency(rows: DataFrame, settings: DataFrame, changes: DataFrame) -> DataFrame:
    """Ledger or rules with every row of a user moved to a new currency; no conversion.

    changes(user_id, currency) of users whose default in settings(user_id, default_currency)
    already equals it, and unreadable codes, change nothing. Of several codes of a user the last
    in the alphabet counts.
    """
    wanted = one_per_key(changes.select(
        "user_id", currency_code(C("currency")).alias("_new")).filter(C("_new").isNotNull()),
        ["user_id"])
    current = settings.select("user_id", "default_currency")
    active = null_safe_join(wanted, current, ["user_id"]).filter(
        C("_new") != F.coalesce("default_currency", L("CAD"))).drop("default_currency")
    return null_safe_join(rows, active, ["user_id"]).withColumn(
        "currency", F.coalesce("_new", "currency")).drop("_new")


def remove_categories(ledger: DataFrame, budget_rules: DataFrame, hidden: DataFrame,
                      gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ledger, budget rules, hidden keys) after deleting categories gone(user_id, id).

    Transactions become uncategorised; the category's limits and hidden key go with it.
    """
    marks = gone.select("user_id", C("id").alias("category_id")).distinct()
    flagged = ledger.join(
        marks.select(C("user_id").alias("_u"), C("category_id").alias("_c"),
                     L(True).alias("_gone")),
        C("user_id").eqNullSafe(C("_u")) & (C("category_id") == C("_c")), "left")
    rows = flagged.withColumn("category_id", F.when(C("_gone").isNull(), C("category_id"))) \
        .select(*ledger.columns)
    limits = without(budget_rules, marks, ["user_id", "category_id"])
    keyed = hidden.withColumn("category_id", category_of_key(C("category_key")))
    keys = without(keyed, marks, ["user_id", "category_id"]).select(*hidden.columns)
    return rows, limits, keys


def clear_users(ledger: DataFrame, users: DataFrame) -> DataFrame:
    """Ledger without any row of the listed users."""
    return without(ledger, users, ["user_id"])


def upsert_categories(categories: DataFrame,
                      changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(categories, conflicts) after creating and editing categories.

    changes(change_id, user_id, id, name, color, keywords): id null creates, else null fields
    stay. A change is refused when its name is taken by another category of the user or by an
    earlier change of the batch, when an earlier change edits the same category, or when a keyword
    it adds is already on another category. New
    ids are max(id) + 1 + change_id.
    """
    clean = changes.withColumns({
        "name": F.lower(trimmed(C("name"))), "keywords": keywords_csv(C("keywords"))})
    current = categories.select(
        "user_id", "id", C("name").alias("old_name"), C("color").alias("old_color"),
        C("keywords").alias("old_keywords"))
    edits = null_safe_join(clean.filter(C("id").isNotNull()), current, ["user_id", "id"],
                           "inner")
    creates = clean.filter(C("id").isNull()).withColumns({
        c: L(None).cast("string") for c in ("old_name", "old_color", "old_keywords")})
    todo = edits.unionByName(creates)
    taken = categories.select("user_id", "name", C("id").alias("_other"))
    name_taken = null_safe_join(
        todo.filter(C("name").isNotNull()), taken, ["user_id", "name"], "inner",
        C("id").isNull() | (C("id") != C("_other"))).select(
        "change_id", L("name").alias("kind"), C("name").alias("detail"))
    named = todo.filter(C("name").isNotNull())
    firsts = named.groupBy("user_id", "name").agg(F.min("change_id").alias("change_id"))
    repeated = named.join(firsts.select("change_id"), "change_id", "left_anti").select(
        "change_id", L("name").alias("kind"), C("name").alias("detail"))
    added = F.array_except(keyword_list(C("keywords")), keyword_list(C("old_keywords")))
    words = todo.select("change_id", "user_id", C("id").alias("exclude_category_id"),
                        F.explode(added).alias("keyword"))
    exact = keyword_conflicts(keyword_rules(categories), words).filter(C("kind") == "exact")
    word_taken = null_safe_join(
        words.withColumn("candidate", C("keyword")).drop("keyword"),
        exact.select("user_id", "exclude_category_id", "candidate").distinct(),
        ["user_id", "exclude_category_id", "candidate"], "left_semi").select(
        "change_id", L("keyword").alias("kind"), C("candidate").alias("detail"))
    first_edits = edits.groupBy("user_id", "id").agg(F.min("change_id").alias("change_id"))
    edited_twice = edits.join(first_edits.select("change_id"), "change_id", "left_anti").select(
        "change_id", L("id").alias("kind"), C("id").cast("string").alias("detail"))
    conflicts = name_taken.unionByName(repeated).unionByName(word_taken).unionByName(
        edited_twice).distinct()
    accepted = todo.join(conflicts.select("change_id").distinct(), "change_id", "left_anti")
    first = categories.agg(F.coalesce(F.max("id"), L(0)) + 1).scalar()
    final = accepted.select(
        F.coalesce("id", first + C("change_id")).alias("id"), "user_id",
        F.coalesce("name", "old_name").alias("name"),
        F.coalesce("color", "old_color").alias("color"),
        F.coalesce("keywords", "old_keywords").alias("keywords"))
    untouched = without(categories, accepted.filter(C("id").isNotNull()), ["user_id", "id"])
    return untouched.unionByName(final), conflicts
