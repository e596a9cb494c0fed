"""Keyword rules of categories and the merchants they match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions.ids import with_dense_ids
from tallybook.functions.joins import null_safe_join, without
from tallybook.functions.text import (
    keyword_list, keywords_csv, with_match_text,
)
from tallybook.schemas import STARTER_CATEGORIES

C, L = F.col, F.lit

_GRAM = 3


def keyword_rules(categories: DataFrame) -> DataFrame:
    """One row per (category, keyword), normalised; categories without a name are left out."""
    parts = (categories
             .withColumn("category_name", F.lower(F.trim(F.coalesce("name", L("")))))
             .filter(C("category_name") != "")
             .select("user_id", C("id").alias("category_id"), "category_name",
                     F.explode(F.split(F.coalesce("keywords", L("")), ",")).alias("part")))
    return (with_match_text(parts, "part", "keyword").filter(C("keyword") != "")
            .select("user_id", "category_id", "category_name", "keyword",
                    F.length("keyword").alias("length")).distinct())


def _grams(text: Column) -> Column:
    """Distinct substrings of 1 to _GRAM characters; each keyword's head is one of them."""
    def of_size(n: int) -> Column:
        starts = F.sequence(L(1), F.length(text) - (n - 1))
        return F.when(F.length(text) >= n, F.transform(
            starts, lambda i: F.substring(text, i, L(n)))).otherwise(F.array().cast(
                "array<string>"))

    return F.array_distinct(F.concat(*[of_size(n) for n in range(1, _GRAM + 1)]))


def substring_pairs(texts: DataFrame, text: str, needles: DataFrame, needle: str,
                    keys: list[str], how: str = "inner") -> DataFrame:
    """Pairs where `needle` occurs in `text`, within equal keys.

    how='left' also keeps a row with null needle for every text gram that matches nothing.

    An equality join on the needle's first characters finds the candidates, so neither side is
    paired with everything; with few needles the join runs map-side on the exploded texts, with
    many it shuffles on (keys, head), which also spreads a hot user.
    """
    explode = F.explode if how == "inner" else F.explode_outer
    exploded = texts.withColumn("_head", explode(_grams(C(text))))
    headed = needles.withColumn("_head", F.substring(C(needle), 1, _GRAM))
    return null_safe_join(exploded, headed, [*keys, "_head"], how,
                          F.contains(C(text), C(needle))).drop("_head")


def distinct_merchants(rows: DataFrame) -> DataFrame:
    """(user_id, merchant_name, normalized_merchant), each merchant once."""
    return with_match_text(rows.select("user_id", "merchant_name").distinct(),
                           "merchant_name", "normalized_merchant")


def match_keywords(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Every rule whose keyword is a substring of the user's normalised merchant."""
    merchants = distinct_merchants(rows).select("user_id", "normalized_merchant").distinct()
    return substring_pairs(merchants, "normalized_merchant", rules, "keyword", ["user_id"])


def analyze_merchants(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Per distinct merchant: matches in rank order, suggestion, and whether categories compete.

    The longest keyword wins, ties go to the alphabetically first category.
    """
    match = F.struct((-C("length")).alias("rank"), "category_name", "keyword", "category_id")
    found = C("keyword").isNotNull()
    # one pass: partial aggregation folds a merchant's grams in the task that made them, and the
    # merchants stay partitioned as their distinct left them
    return (substring_pairs(distinct_merchants(rows), "normalized_merchant", rules, "keyword",
                            ["user_id"], "left")
            .groupBy("user_id", "merchant_name", "normalized_merchant").agg(
                F.min_by("category_name",
                         F.when(found, F.struct(-C("length"), C("category_name"))))
                .alias("suggested_category"),
                F.min("category_name").alias("first_name"),
                F.max("category_name").alias("last_name"),
                F.sort_array(F.collect_set(F.when(found, match))).alias("matches"))
            .withColumn("resolution_needed",
                        F.coalesce(C("first_name") != C("last_name"), L(False)))
            .withColumn("keyword_matches", F.transform(
                "matches", lambda m: F.struct(m["category_id"].alias("category_id"),
                                              m["category_name"].alias("category_name"),
                                              m["keyword"].alias("keyword"),
                                              (-m["rank"]).alias("length"))))
            .drop("first_name", "last_name", "matches"))


def keyword_conflicts(rules: DataFrame, candidates: DataFrame) -> DataFrame:
    """Conflicts of candidate keywords with the keywords of other categories.

    candidates(user_id, keyword, exclude_category_id): kind 'exact' for equal keywords, 'overlap'
    when one contains the other.
    """
    wanted = (with_match_text(candidates, "keyword", "candidate").filter(C("candidate") != "")
              .select("user_id", "candidate", "exclude_category_id").distinct())
    other = (C("exclude_category_id").isNull()
             | (C("exclude_category_id") != C("category_id")))
    columns = ("user_id", "exclude_category_id", "candidate", "category_id", "category_name",
               "keyword")
    exact = null_safe_join(
        wanted.withColumn("keyword", C("candidate")),
        rules.select("user_id", "keyword", "category_id", "category_name"),
        ["user_id", "keyword"], "inner", other).select(*columns, L("exact").alias("kind"))
    inside = substring_pairs(rules, "keyword", wanted, "candidate", ["user_id"])
    around = substring_pairs(wanted, "candidate", rules, "keyword", ["user_id"])
    overlap = (inside.select(*columns).unionByName(around.select(*columns))
               .filter((C("candidate") != C("keyword")) & other).distinct()
               .select(*columns, L("overlap").alias("kind")))
    return exact.unionByName(overlap)


def remove_keywords(categories: DataFrame, removals: DataFrame) -> DataFrame:
    """Categories without the keywords in removals(user_id, category_id, keyword).

    Only keywords a category really holds are gathered, so each list is no longer than the
    category's own.
    """
    # words are compared as the rules spell them, with letters folded, and removed as listed
    held = with_match_text(categories.select(
        "user_id", C("id").alias("category_id"),
        F.explode(keyword_list(C("keywords"))).alias("listed")), "listed", "word")
    wanted = with_match_text(removals.filter(C("category_id").isNotNull()).select(
        "user_id", "category_id", "keyword").distinct(), "keyword", "word").select(
        "user_id", "category_id", "word").distinct()
    named = wanted.filter(C("word") != "").select("user_id", "category_id").distinct()
    gone = (null_safe_join(held, wanted, ["user_id", "category_id", "word"], "left_semi")
            .groupBy("user_id", "category_id").agg(F.collect_set("listed").alias("gone")))
    marks = null_safe_join(named, gone, ["user_id", "category_id"]).select(
        "user_id", C("category_id").alias("id"), L(True).alias("touched"),
        F.coalesce("gone", F.array().cast("array<string>")).alias("gone"))
    left = F.array_join(F.array_except(keyword_list(C("keywords")), C("gone")), ", ")
    return null_safe_join(categories, marks, ["user_id", "id"]).withColumn(
        "keywords", F.when(C("touched"), F.nullif(left, L(""))).otherwise(C("keywords"))
    ).select(*categories.columns)


def resuggest(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Suggestions renewed after a keyword change.

    Only rows whose suggestion came from keywords (or had matches) change; a chosen
    category_name keeps its suggestion.
    """
    by_keyword = (C("suggestion_source") == "keyword") | (F.size("keyword_matches") > 0)
    fresh = analyze_merchants(rows.filter(by_keyword), rules).select(
        "user_id", "merchant_name", C("suggested_category").alias("new_suggestion"),
        C("resolution_needed").alias("new_resolution"), C("keyword_matches").alias("new_matches"))
    joined = null_safe_join(rows, fresh, ["user_id", "merchant_name"])
    chosen = F.coalesce("category_name", L("")) != ""
    return joined.select(*[
        {
            "suggested_category": F.when(by_keyword & ~chosen, F.coalesce(
                "new_suggestion", L(""))).otherwise(C("suggested_category")),
            "resolution_needed": F.when(by_keyword, C("new_resolution"))
            .otherwise(C("resolution_needed")),
            "keyword_matches": F.when(by_keyword, C("new_matches"))
            .otherwise(C("keyword_matches")),
            "suggestion_source": F.when(
                by_keyword, F.when(F.size("new_matches") > 0, "keyword").otherwise("none"))
            .otherwise(C("suggestion_source")),
        }.get(c, C(c)).alias(c) for c in rows.columns])


def seed_categories(users: DataFrame, categories: DataFrame) -> DataFrame:
    """Starter categories for users that have no category.

    Ids follow the highest in use without gaps, by user and place in the starter list, so they are
    equal on every evaluation.
    """
    entries = F.array(*[
        F.struct(L(name).alias("name"), L(color).alias("color"), L(words).alias("keywords"))
        for name, color, words in STARTER_CATEGORIES])
    first = categories.agg(F.coalesce(F.max("id"), L(0)) + 1).first()[0]
    seeded = (without(users.select("user_id").distinct(), categories, ["user_id"])
              .select("user_id", F.posexplode(entries).alias("place", "e"))
              .select("user_id", "place", "e.name", "e.color",
                      keywords_csv(C("e.keywords")).alias("keywords")))
    return with_dense_ids(seeded, "id", ["user_id", "place"], first).drop("place")


def resolve_categories(rows: DataFrame, categories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with category_id, categories to create) for rows(row_idx, user_id, category).

    Names compare trimmed and lower-case. A new category gets max(id) + 1 + the first row_idx
    that names it: unique, stable, and no row is numbered in a single task.
    """
    wanted = rows.withColumn("name", F.lower(F.trim("category")))
    known = categories.groupBy("user_id", "name").agg(F.min("id").alias("category_id"))
    named = wanted.groupBy("user_id", "name").agg(F.min("row_idx").alias("first_row"))
    first = categories.agg(F.coalesce(F.max("id"), L(0)) + 1).scalar()
    ids = null_safe_join(named, known, ["user_id", "name"]).withColumn(
        "is_new", C("category_id").isNull()).withColumn(
        "category_id", F.coalesce("category_id", first + C("first_row")))
    new = ids.filter("is_new").select(
        C("category_id").alias("id"), "user_id", "name", L(None).cast("string").alias("color"),
        L(None).cast("string").alias("keywords"))
    resolved = null_safe_join(wanted, ids.select("user_id", "name", "category_id"),
                              ["user_id", "name"]).drop("name")
    return resolved, new
