"""Pages behind a known row, and ids without gaps."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallybook.functions.ids import with_dense_ids
from tallybook.operators import keywords, listing
from tests.helpers import accounts, categories, day, ledger

SORTS = ("date", "date_added", "merchant", "amount", "type", "category")


def _books(spark):
    rows = []
    for i in range(14):
        rows.append(dict(
            transaction_date=day(None if i == 3 else f"2026-01-{1 + i % 4:02d}"),
            merchant_name=None if i % 5 == 0 else f"shop {i % 3}",
            amount=None if i in (2, 9) else float(i % 4), category_id=i % 3,
            transaction_type=None if i == 6 else ("income" if i % 2 else "expense")))
    return (ledger(spark, *rows).withColumn("created_at", F.when(
        F.col("id") % 4 != 0, F.timestamp_seconds(F.col("id") % 3))),
        categories(spark, dict(id=1, name="b"), dict(id=2, name="a")))


@pytest.mark.parametrize("direction", ["asc", "desc"])
def test_rows_after_a_row_are_those_listed_behind_it(spark, direction):
    books, names = _books(spark)
    named = listing.enrich(books, names, accounts(spark)).cache()
    for sort in SORTS:
        keys = listing._sort_keys(sort, direction)
        held = named.orderBy(*listing._ordered(keys)).select(*[c for c, _ in keys]).collect()
        behind = named.select(F.array(*[
            F.array_sort(F.collect_list(F.when(listing.after_row(keys, tuple(r)), F.col("id"))))
            for r in held])).first()[0]
        ids = [r["id"] for r in held]
        assert behind == [sorted(ids[k + 1:]) for k in range(len(ids))], sort


def test_seeking_walks_through_the_pages(spark):
    books, names = _books(spark)
    order = dict(sort_by="category", sort_dir="desc")
    first = listing.list_transactions(books, names, accounts(spark), user=None, page_size=6, **order)
    seen, last = [first.count()], listing.last_of_page(first, **order)
    second = listing.list_transactions(books, names, accounts(spark), user=None, page_size=6,
                                       after=last, **order)
    numbered = listing.list_transactions(books, names, accounts(spark), user=None, page_size=6,
                                         page=2, **order)
    assert seen == [6]
    assert {r["id"] for r in second.collect()} == {r["id"] for r in numbered.collect()}
    assert listing.last_of_page(first.limit(0), **order) is None
    for bad in (dict(page=2, after=last), dict(after=last[:1])):
        with pytest.raises(ValueError):
            listing.list_transactions(books, names, accounts(spark), user=None, **bad, **order)


def test_the_first_key_bounds_the_scan(spark, tmp_path):
    books, _ = _books(spark)
    books.write.partitionBy("transaction_date").parquet(str(tmp_path / "books"))
    rows = spark.read.parquet(str(tmp_path / "books")).filter(
        listing.after_row(listing._sort_keys("date", "asc"), (day("2026-01-03"), 5)))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "transaction_date" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]


def test_dense_ids_are_ranks_whatever_the_partitions(spark):
    rows = spark.range(1000).select(
        F.when(F.col("id") % 50 != 0, F.pmod(F.xxhash64("id"), F.lit(7))).alias("a"), "id")
    want = [(r["a"], r["id"]) for r in rows.orderBy(F.asc_nulls_first("a"), "id").collect()]
    for parts in (1, 13):
        out = with_dense_ids(rows.repartition(parts), "n", ["a", "id"], 5)
        assert [(r["n"], r["a"], r["id"]) for r in out.orderBy("n").collect()] == [
            (k, *v) for k, v in enumerate(want, 5)]
    assert with_dense_ids(rows.limit(0), "n", ["a", "id"]).count() == 0


def test_seeded_categories_follow_the_highest_id_without_gaps(spark):
    users = spark.createDataFrame([("z",), ("b",), (None,), ("b",), ("has",)], "user_id string")
    held = categories(spark, dict(id=40, user_id="has", name="x"))
    out = keywords.seed_categories(users, held).orderBy("id").collect()
    n = len(out) // 3
    assert [r["id"] for r in out] == list(range(41, 41 + 3 * n))
    assert [r["user_id"] for r in out] == [None] * n + ["b"] * n + ["z"] * n
    assert [r["name"] for r in out[:n]] == [r["name"] for r in out[n:2 * n]]
