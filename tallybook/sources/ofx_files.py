"""OFX files read record by record, so that one file is the work of many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallybook.functions.ids import with_dense_ids
from tallybook.functions.money import to_cents
from tallybook.operators.statements import ofx_tag, ofx_transactions
from tallybook.session import cut_lineage
from tallybook.sources.csv_files import decoded_path

C, L = F.col, F.lit

_END = "</STMTTRN>"
_EDGE = r"(?s)^.*<(/?)(?:CC)?STMTRS>(.*)$"  # the last begin or end of a statement


def _records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Pieces between transaction tags, with what each says about the pieces behind it.

    A piece holds a transaction (`block`), and behind its end tag perhaps the end of a statement or
    the head of another: `edge` says whether a statement is open after the piece, and in which
    currency; it is null where nothing changes. `opens` counts heads.
    """
    rest = F.when(F.contains("value", L(_END)), F.regexp_replace(
        "value", rf"(?s)^.*?{_END}", "")).otherwise(C("value"))
    block = F.when(F.contains("value", L(_END)),
                   F.regexp_extract("value", rf"(?s)^(.*?){_END}", 1))
    pieces = (spark.read.option("lineSep", "<STMTTRN>").text(paths)
              .select(decoded_path(C("_metadata.file_path")).alias("path"),
                      decoded_path(C("_metadata.file_name")).alias("file"),
                      C("_metadata.file_block_start").alias("split"),
                      F.monotonically_increasing_id().alias("at"),
                      block.alias("block"), rest.alias("rest"))
              .withColumn("head", F.regexp_extract("rest", _EDGE, 2)))
    return pieces.select(
        "path", "file", "split", "at", "block",
        F.regexp_count("rest", L("<(CC)?STMTRS>")).alias("opens"),
        F.when(C("rest").rlike("</?(CC)?STMTRS>"), F.struct(
            (F.regexp_extract("rest", _EDGE, 1) == "").alias("open"),
            F.nullif(ofx_tag("head", "CURDEF"), L("")).alias("currency"))).alias("edge"))


def scan_ofx_files(spark: SparkSession, paths: list[str],
                   default_currency: str = "CAD") -> DataFrame:
    """Transactions of OFX files with `path`, the columns and the order numbers of `scan_ofx`.

    A large file is split; a transaction takes the currency of the last statement head before it,
    which may lie in an earlier split. Paths may be patterns, as for `scan_csv`. Within a split that is a running last value, whose groups no
    split can outgrow; between splits it is one over a single row per split. A transaction outside
    every statement or without an end tag is left out. A statement that is never closed counts.
    """
    found = cut_lineage(_records(spark, paths))
    held = F.when(C("block").isNotNull(), 1).otherwise(0)
    splits = found.groupBy("path", "split").agg(
        F.max_by("edge", F.when(C("edge").isNotNull(), C("at"))).alias("edge"),
        F.sum("opens").alias("opens"), F.sum(held).alias("held"))
    earlier = Window.partitionBy("path").orderBy("split").rowsBetween(
        Window.unboundedPreceding, -1)
    before = splits.select(
        "path", "split", F.last("edge", ignorenulls=True).over(earlier).alias("edge_before"),
        F.coalesce(F.sum("opens").over(earlier), L(0)).alias("opens_before"),
        F.coalesce(F.sum("held").over(earlier), L(0)).alias("held_before"))
    inside = Window.partitionBy("path", "split").orderBy("at").rowsBetween(
        Window.unboundedPreceding, -1)
    placed = (found.select(
        "path", "file", "split", "block",
        F.last("edge", ignorenulls=True).over(inside).alias("edge_here"),
        F.coalesce(F.sum("opens").over(inside), L(0)).alias("opens_here"),
        F.coalesce(F.sum(held).over(inside), L(0)).alias("held_here"))
        .join(before, ["path", "split"])
        .withColumn("edge", F.coalesce("edge_here", "edge_before"))
        .filter(C("block").isNotNull() & C("edge.open"))
        .select("path", "file", "block",
                (C("opens_here") + C("opens_before") - 1).cast("int").alias("statement_no"),
                (C("held_here") + C("held_before")).alias("number"),
                F.coalesce("edge.currency", L(default_currency)).alias("currency")))
    firsts = placed.groupBy("path", "statement_no").agg(F.min("number").alias("first"))
    blocks = placed.join(firsts, ["path", "statement_no"]).withColumn(
        "position", (C("number") - C("first")).cast("int"))
    return ofx_transactions(blocks, "path")


def ofx_upload(spark: SparkSession, paths: list[str], user: Column | None = None,
               default_currency: str = "CAD", first: int = 0) -> DataFrame:
    """Rows of OFX files in the form of `parse_cells`, with `error` where one cannot be read.

    row_idx counts from `first` without gaps in the order of the files; row_no is the place in the
    statement, from 1. `user` is an expression over `path`, as for `scan_csv`. Transactions say
    nothing of place, kind of merchant and card, so these are empty.
    """
    owner = user if user is not None else L(None).cast("string")
    rows = with_dense_ids(scan_ofx_files(spark, paths, default_currency), "row_idx",
                          ["path", "statement_no", "position"], first)
    unknown = [L("").alias(c) for c in ("merchant_city", "merchant_state", "merchant_country",
                                        "mcc_description", "card_number_masked", "cardholder")]
    return rows.select(
        "row_idx", (C("position") + 1).cast("long").alias("row_no"), owner.alias("user_id"),
        C("file").alias("source_file"), "transaction_date", "posted_date",
        F.coalesce("reference_number", L("")).alias("reference_number"), "merchant_name",
        "amount", to_cents(C("amount")).alias("amount_cents"), "currency", "transaction_type",
        *unknown, (C("transaction_type") == "transfer").alias("is_payment"),
        (C("transaction_type") == "refund").alias("is_refund"),
        F.when(C("error").isNotNull(), F.concat(
            C("error"), L(" in statement "), (C("statement_no") + 1).cast("string")))
        .alias("error"))
