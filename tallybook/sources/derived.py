"""Bank tables derived from the order/lineitem star schema.

The given tables hold no statements, so ledgers, uploads, rules and statement text are built from
orders, lineitem, part and customer by fixed rules; every table grows with its fact table.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallybook.functions.money import cents_text, to_cents
from tallybook.operators import dedup
from tallybook.schemas import LEDGER_KEYS
from tallybook.session import shared_folder, write_scratch
from tallybook.sources.ledger_store import TableStore

C, L = F.col, F.lit


_WRITTEN: dict[tuple[str, str, str], tuple] = {}
_OPENED: dict[tuple[str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its footer is read once per session."""
    path = f"{sf_dir}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _OPENED or _OPENED[key].sparkSession is not spark:
        _OPENED[key] = spark.read.parquet(path)
    return _OPENED[key]


def stored(build):
    """Keep a derived table as parquet in the shared folder, written once per session and input
    folder, so that queries read a stored table as they would in production."""
    @functools.wraps(build)
    def read(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir, build.__name__)
        if key not in _WRITTEN:
            path = f"{shared_folder(spark)}/derived-{uuid.uuid4().hex}/{build.__name__}"
            frame = build(spark, sf_dir)
            write_scratch(frame, path)
            _WRITTEN[key] = (path, frame.schema)
        path, schema = _WRITTEN[key]
        return spark.read.schema(schema).parquet(path)

    read.build = build  # for a table that only one other is made of, which need not be stored
    return read


def _user() -> Column:
    """Tenant of a customer row joined with its nation; nation 0 is the local tenant (null)."""
    return F.when(C("c_nationkey") != 0, C("n_name"))


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return customer.join(nation, C("c_nationkey") == C("n_nationkey")).withColumn(
        "user_id", _user()).withColumn(
        "card", F.when(C("c_custkey") % 10 == 0, F.right(C("c_name"), L(4)))
        .otherwise(F.concat(L("*" * 12), F.right(C("c_name"), L(4)))))


@stored
def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).select(
        (C("c_custkey") + 1).alias("id"), "user_id", C("c_name").alias("name"),
        C("card").alias("card_number_masked"), C("c_mktsegment").alias("institution"))


_CATEGORIES = (
    (1, "economy", "#112233", "red, widget"),
    (2, "large", None, "hot, gear"),
    (3, "medium", "#445566", "Gear,cold bolt"),
    (4, "promo", None, "blue bolt, ring, ring"),
    (5, "small", "#778899", "old rod, new, hot"),
    (6, "transfer", None, "e-transfer"),
)


@stored
def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six categories per tenant; tenant NATION_10 has none yet."""
    entries = F.array(*[
        F.struct(L(code).cast("long").alias("code"), L(name).alias("name"),
                 L(color).cast("string").alias("color"), L(words).alias("keywords"))
        for code, name, color, words in _CATEGORIES])
    nation = table(spark, sf_dir, "nation").filter(C("n_nationkey") != 10)
    return (nation
            .select("n_nationkey", "n_name", F.explode(entries).alias("e"))
            .select((C("n_nationkey") * 10 + C("e.code")).cast("long").alias("id"),
                    F.when(C("n_nationkey") != 0, C("n_name")).alias("user_id"),
                    "e.name", "e.color", "e.keywords"))


@stored
def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        F.when(C("n_nationkey") != 0, C("n_name")).alias("user_id"))


def _category_id(part_type: Column) -> Column:
    code = F.create_map(*[L(x) for c, n, _, _ in _CATEGORIES[:5] for x in (n.upper(), c)])
    return (C("c_nationkey") * 10 + F.try_element_at(code, part_type)).cast("long")


@stored
def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transaction per order."""
    orders = table(spark, sf_dir, "orders")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    n_part = table(spark, sf_dir, "part").select(F.count(L(1))).scalar()
    k = C("o_orderkey")
    day = C("o_orderdate").cast("date")
    kind = (F.when(C("o_orderstatus") == "F", "expense")
            .when(C("o_orderstatus") == "O", "income")
            .when(C("o_orderpriority").isin("1-URGENT", "2-HIGH"), "refund")
            .otherwise("transfer"))
    return (
        orders.withColumn("part_no", k % n_part)
        .join(part, C("part_no") == C("p_partkey"))
        .join(_customers(spark, sf_dir), C("o_custkey") == C("c_custkey"))
        .select(
            (k * 4 + 1).alias("id"), "user_id", day.alias("transaction_date"),
            F.when(k % 3 != 0, F.date_add(day, (k % 4).cast("int"))).alias("posted_date"),
            F.when(k % 7 != 0, F.concat(L("R"), k.cast("string"))).alias("reference_number"),
            F.when(k % 41 == 0, F.concat(L("Interest Charge "), C("p_brand")))
            .otherwise(F.concat_ws(" ", "p_name", "p_brand")).alias("merchant_name"),
            F.when(k % 5 != 0, F.concat(L("City "), (C("o_custkey") % 10).cast("string")))
            .alias("merchant_city"),
            F.when(k % 2 == 0, L("ON")).alias("merchant_state"),
            L("CA").alias("merchant_country"),
            C("p_type").alias("mcc_description"),
            C("o_totalprice").alias("amount"),
            to_cents(C("o_totalprice")).alias("amount_cents"),
            F.when(k % 50 == 7, L("USD")).otherwise(L("CAD")).alias("currency"),
            kind.alias("transaction_type"),
            F.when(k % 17 != 0, C("o_custkey") + 1).alias("account_id"),
            F.when(k % 200 == 9, (C("c_nationkey") + 1) % 25 * 10 + 1)
            .otherwise(_category_id(C("p_type"))).cast("long").alias("category_id"),
            F.when(k % 11 == 0, F.concat(L("note "), C("o_orderpriority"))).alias("notes"),
            F.concat(L("b"), F.year(day).cast("string")).alias("import_batch_id"),
            (k % 10 == 3).alias("is_excluded"),
            L(None).cast("long").alias("recurring_rule_id"),
            F.date_add(day, (k % 28).cast("int")).cast("timestamp").alias("created_at"),
        ))


@stored
def dirty_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger with exact copies: every 20th order twice, every 100th three times."""
    base = ledger(spark, sf_dir)
    k = (C("id") - 1) / 4
    copies = F.when(k % 100 == 0, 2).when(k % 20 == 0, 1).otherwise(0)
    return base.select(
        "*", F.explode(F.sequence(L(0), copies)).alias("copy_no"),
    ).withColumn("id", C("id") + C("copy_no")).withColumn(
        "import_batch_id", F.concat_ws("/", "import_batch_id", C("copy_no").cast("string"))
    ).drop("copy_no")


@stored
def budget_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A total and three category limits per tenant; one category does not exist."""
    nk = C("n_nationkey")
    entries = F.array(
        F.struct(L(0).alias("code"), (L(60000000) + nk * 1000000).cast("long").alias("cents")),
        F.struct(L(1).alias("code"), L(30000000).cast("long").alias("cents")),
        F.struct(L(3).alias("code"), L(15000050).cast("long").alias("cents")),
        F.struct(L(9).alias("code"), L(100000).cast("long").alias("cents")),
    )
    return (table(spark, sf_dir, "nation")
            .select(nk, "n_name", F.explode(entries).alias("e"))
            .select((nk * 10 + C("e.code")).cast("long").alias("id"),
                    F.when(nk != 0, C("n_name")).alias("user_id"),
                    F.when(C("e.code") != 0, (nk * 10 + C("e.code")).cast("long"))
                    .alias("category_id"),
                    C("e.cents").alias("limit_cents"), (C("e.code") == 0).alias("is_total")))


@stored
def hidden_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    nk = C("n_nationkey")
    keys = F.array(
        F.concat(L("cat:"), (nk * 10 + 5).cast("string")),
        F.concat(L("cat:"), (nk * 10 + 1).cast("string")),
        F.when(nk % 2 == 1, L("uncategorized")),
    )
    return (table(spark, sf_dir, "nation")
            .select(F.when(nk != 0, C("n_name")).alias("user_id"),
                    F.explode(F.array_compact(keys)).alias("category_key")))


@stored
def recurring_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rule per customer; a third never ends, half have been run before."""
    k = C("c_custkey")
    start = F.date_add(L("1999-01-29").cast("date"), (k % 400).cast("int"))
    frequency = F.element_at(
        F.array(L("monthly"), L("weekly"), L("biweekly"), L("yearly")), (k % 4 + 1).cast("int"))
    return _customers(spark, sf_dir).select(
        (k + 1).alias("id"), "user_id", F.concat(L("Rent "), C("c_name")).alias("merchant_name"),
        F.abs(C("c_acctbal")).alias("amount"),
        F.abs(to_cents(C("c_acctbal"))).alias("amount_cents"),
        F.when(k % 5 == 0, L("income")).otherwise(L("expense")).alias("transaction_type"),
        L("CAD").alias("currency"),
        (C("c_nationkey") * 10 + k % 5 + 1).cast("long").alias("category_id"),
        (k + 1).alias("account_id"),
        F.when(k % 6 == 0, L("lease")).alias("notes"),
        frequency.alias("frequency"), start.alias("start_date"),
        F.when(k % 3 != 0, F.date_add(start, (200 + k % 500).cast("int"))).alias("end_date"),
        F.when(k % 2 == 1, F.date_add(start, 90)).alias("last_created_date"))


@stored
def linked_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger rows earlier made from the rules: weekly steps of which some were edited."""
    step = C("step")
    day = F.date_add(C("start_date"), (step * 7).cast("int"))
    return (recurring_rules(spark, sf_dir)
            .withColumn("step", F.explode(F.sequence(L(0), L(30))))
            .filter(step % 5 != 3)
            .select(
                ((C("id") * 1000 + step) * 4 + 3).cast("long").alias("id"), "user_id",
                F.when(step % 7 == 5, F.date_add(day, 1)).otherwise(day)
                .alias("transaction_date"),
                L(None).cast("date").alias("posted_date"),
                L(None).cast("string").alias("reference_number"), "merchant_name",
                L(None).cast("string").alias("merchant_city"),
                L(None).cast("string").alias("merchant_state"),
                L(None).cast("string").alias("merchant_country"),
                L(None).cast("string").alias("mcc_description"),
                "amount", "amount_cents", "currency", "transaction_type", "account_id",
                "category_id", "notes", L(None).cast("string").alias("import_batch_id"),
                L(False).alias("is_excluded"), C("id").alias("recurring_rule_id"),
                C("start_date").cast("timestamp").alias("created_at")))


@stored
def rule_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A proposed edit for two of three rules: a later start, another frequency or a new price."""
    k = C("id") - 1
    rules = recurring_rules(spark, sf_dir).filter(k % 3 != 2)
    return rules.select(
        "id", "user_id",
        F.when(k % 3 == 0, F.date_add("start_date", 28)).otherwise(C("start_date"))
        .alias("start_date"),
        F.when(k % 4 == 1, L("biweekly")).otherwise(C("frequency")).alias("frequency"),
        F.when(k % 6 == 1, F.date_add("start_date", 120)).otherwise(C("end_date"))
        .alias("end_date"),
        F.when(k % 2 == 0, C("amount_cents") + 500).alias("amount_cents"),
        F.when(k % 9 == 0, L("Rent (new)")).alias("merchant_name"),
        (k % 4 == 0).alias("keep_overlap"), (k % 4 == 1).alias("remove_overlap"),
        (k % 6 == 0).alias("backfill_missing"), (k % 6 == 1).alias("skip_backfill"))


@stored
def upload_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with a stable row number inside their order, joined to customer and part; one
    table under the upload rows, statement lines, cells and words and OFX texts."""
    line_order = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    # orders meet their customers before the lines, which keep the order's partitions that way
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(
        _customers(spark, sf_dir), C("o_custkey") == C("c_custkey"))
    return (table(spark, sf_dir, "lineitem")
            .withColumn("rn", F.row_number().over(line_order))
            .join(orders, C("l_orderkey") == C("o_orderkey"))
            .join(part, C("l_partkey") == C("p_partkey"))
            .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "rn",
                    "o_custkey", "user_id", "c_name", "card", "p_name", "p_brand", "p_type",
                    (C("l_orderkey") * 1000 + C("rn")).alias("seq"),
                    C("l_shipdate").cast("date").alias("ship_day")))


@stored
def raw_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upload rows as raw text cells: line items, repeats of them, and restated ledger rows."""
    p, s, day = C("l_partkey"), C("l_suppkey"), C("ship_day")
    cents = to_cents(C("l_extendedprice"))
    pretty = F.format_number(C("l_extendedprice"), 2)
    lines = upload_lines.build(spark, sf_dir).select(
        (C("seq") * 4).alias("row_idx"), "user_id",
        F.concat(L("upload_"), F.lower(F.coalesce("user_id", L("local"))), L("_"),
                 (s % 3).cast("string"), L(".csv")).alias("source_file"),
        F.when(p % 97 == 5, "not a date").when(p % 101 == 7, "")
        .when(p % 4 == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(p % 4 == 1, F.date_format(day, "M/d/yyyy"))
        .when(p % 4 == 2, F.date_format(day, "MMM d, yyyy"))
        .otherwise(F.date_format(day, "yyyyMMdd")).alias("date_raw"),
        F.when(C("l_linenumber") % 2 == 0, F.date_format(F.date_add(day, 1), "yyyy-MM-dd"))
        .otherwise("").alias("posted_raw"),
        F.when(p % 89 == 3, "N/A")
        .when(s % 4 == 0, F.concat(L("("), pretty, L(")")))
        .when(s % 4 == 1, F.concat(L("$"), pretty))
        .when(s % 4 == 2, F.concat(L("-"), cents_text(cents)))
        .otherwise(F.concat(L(" "), cents_text(cents))).alias("amount_raw"),
        F.when(p % 37 == 0, F.concat(L("Interest Charge "), C("p_brand")))
        .when(p % 37 == 1, F.concat(L("INTERAC E-TRANSFER "), C("p_brand")))
        .when(p % 37 == 2, "Cash Back Reward")
        .when(p % 37 == 3, "")
        .otherwise(F.concat(C("p_name"), L("  "), C("p_brand"))).alias("merchant_raw"),
        F.when(p % 13 == 0, " Grocery Stores and Supermarkets ")
        .when(p % 13 == 1, "Computer Software Stores")
        .when(p % 13 == 2, "")
        .otherwise(C("p_type")).alias("mcc_raw"),
        F.when(p % 3 == 0, "").otherwise(
            F.concat_ws("-", C("l_orderkey").cast("string"), C("l_linenumber").cast("string")))
        .alias("ref_raw"),
        F.concat(L("City "), (C("o_custkey") % 10).cast("string")).alias("city_raw"),
        L("ON").alias("state_raw"), L("CA").alias("country_raw"),
        F.when(s % 6 == 0, "").when(s % 6 == 1, F.right(C("c_name"), L(4)))
        .otherwise(C("card")).alias("card_raw"),
        C("c_name").alias("holder_raw"),
        "seq",
    )
    copies = F.when(C("seq") % 15 == 0, 1).otherwise(0)
    repeated = lines.select("*", F.explode(F.sequence(L(0), copies)).alias("copy_no")).withColumn(
        "row_idx", C("row_idx") + C("copy_no")).drop("copy_no", "seq")
    owned = accounts(spark, sf_dir).select(
        C("id").alias("owner_no"), C("card_number_masked").alias("card_raw"),
        C("name").alias("holder_raw"))
    k = ((C("id") - 1) / 4).cast("long")
    books = (table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"))
    restated = (ledger(spark, sf_dir).filter(k % 5 == 0)
                .join(books, k == C("o_orderkey"))
                .join(owned, C("o_custkey") + 1 == C("owner_no"))
                .select(
                    (k * 4000 + 2).alias("row_idx"), "user_id",
                    F.concat(L("upload_"), F.lower(F.coalesce("user_id", L("local"))),
                             L("_r.csv")).alias("source_file"),
                    F.date_format("transaction_date", "yyyy-MM-dd").alias("date_raw"),
                    L("").alias("posted_raw"),
                    cents_text(C("amount_cents")).alias("amount_raw"),
                    F.replace("merchant_name", L(" "), L("  ")).alias("merchant_raw"),
                    C("mcc_description").alias("mcc_raw"),
                    F.coalesce("reference_number", L("")).alias("ref_raw"),
                    F.coalesce("merchant_city", L("")).alias("city_raw"),
                    F.coalesce("merchant_state", L("")).alias("state_raw"),
                    C("merchant_country").alias("country_raw"),
                    "card_raw", "holder_raw"))
    return repeated.unionByName(restated)


@stored
def ofx_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One OFX text per order, one STMTTRN block per line item."""
    p = C("l_partkey")
    kind = F.element_at(
        F.array(*[L(x) for x in ("DEBIT", "PAYMENT", "CREDIT", "DEP", "POS", "ODD")]),
        (C("l_suppkey") % 6 + 1).cast("int"))
    cents = to_cents(C("l_extendedprice"))
    signed = F.when(C("l_suppkey") % 6 == 3, cents_text(cents)).when(
        C("l_suppkey") % 6 == 2, cents_text(cents)).otherwise(
        F.concat(L("-"), cents_text(cents)))
    block = F.concat(
        L("<STMTTRN><TRNTYPE>"), kind, L("\n<DTPOSTED>"), F.date_format("ship_day", "yyyyMMdd"),
        L("120000\n"),
        F.when(C("l_linenumber") % 2 == 0, F.concat(
            L("<DTAVAIL>"), F.date_format(F.date_add("ship_day", 2), "yyyyMMdd"), L("\n")))
        .otherwise(""),
        L("<TRNAMT>"), F.when(p % 89 == 3, "oops").otherwise(signed),
        L("\n<FITID>"), C("seq").cast("string"), L("\n<NAME>"), C("p_name"),
        F.when(p % 3 == 0, F.concat(L("\n<MEMO>"), C("p_brand")))
        .when(p % 3 == 1, F.concat(L("\n<MEMO>"), F.upper("p_name"))).otherwise(""),
        L("\n</STMTTRN>"))
    return (upload_lines(spark, sf_dir)
            .select("l_orderkey", "rn", block.alias("block"))
            .groupBy("l_orderkey")
            .agg(F.sort_array(F.collect_list(F.struct("rn", "block"))).alias("blocks"))
            .select(
                F.concat(L("order"), C("l_orderkey").cast("string"), L(".ofx")).alias("file"),
                F.concat(
                    L("OFXHEADER:100\n<OFX><STMTRS>"),
                    F.when(C("l_orderkey") % 2 == 0, "<CURDEF>USD\n").otherwise(""),
                    F.array_join("blocks.block", "\n"), L("\n</STMTRS></OFX>"))
                .alias("content")))


def ledger_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger's duplicate keys, stored by month as an import keeps them."""
    key = (spark.sparkContext.applicationId, sf_dir, "ledger_keys")
    if key not in _WRITTEN:
        path = f"{shared_folder(spark)}/derived-{uuid.uuid4().hex}/ledger_keys"
        TableStore(spark, path, LEDGER_KEYS, "day").append(dedup.ledger_keys(
            ledger(spark, sf_dir)))
        _WRITTEN[key] = (path, LEDGER_KEYS)
    return TableStore(spark, _WRITTEN[key][0], LEDGER_KEYS, "day").read()
