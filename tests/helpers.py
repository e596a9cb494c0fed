"""Small tables for the tests."""

from __future__ import annotations

from datetime import date

from tallybook import schemas
from tallybook.functions.money import to_cents
from pyspark.sql import functions as F


def day(text: str | None) -> date | None:
    return date.fromisoformat(text) if text else None


def table(spark, schema, rows):
    names = [f.name for f in schema.fields]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def ledger(spark, *rows):
    base = dict(transaction_date=date(2026, 2, 3), merchant_name="Amazon Marketplace",
                amount=14.99, currency="CAD", transaction_type="expense", is_excluded=False)
    return table(spark, schemas.LEDGER, [{**base, "id": i, **r} for i, r in enumerate(rows, 1)]) \
        .withColumn("amount_cents", to_cents(F.col("amount")))


def upload(spark, *rows):
    base = dict(transaction_date=date(2026, 2, 3), merchant_name="Amazon Marketplace",
                amount=14.99, currency="CAD", transaction_type="expense",
                suggested_category="shopping", category_name="shopping",
                cardholder="Import User", exclude=False, source_file="statement.pdf",
                import_month=2, import_year=2026)
    return table(spark, schemas.UPLOAD_ROWS,
                 [{**base, "row_idx": i, **r} for i, r in enumerate(rows)])


def accounts(spark, *rows):
    return table(spark, schemas.ACCOUNTS, list(rows))


def categories(spark, *rows):
    return table(spark, schemas.CATEGORIES, list(rows))


def rules(spark, *rows):
    base = dict(user_id=None, merchant_name="Rent", amount=10.0, amount_cents=1000,
                transaction_type="expense", currency="CAD", frequency="monthly")
    return table(spark, schemas.RECURRING_RULES,
                 [{**base, "id": i, **r} for i, r in enumerate(rows, 1)])
