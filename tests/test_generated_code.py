"""Steps over whole uploads run as generated code, keep no shuffle files and read few rows twice."""

import time

from pyspark.sql import functions as F

from tallybook.functions.text import collapsed, collapsed_lower, lowered
from tallybook.functions.money import clean_amount, parse_amount, read_clean_amount
from tallybook.operators.dedup import _row_probes, is_complete, missing_fields, with_dedup_keys
from tallybook.operators.ingest import parse_cells, suggest_category
from tallybook.session import cut_lineage

_RAW = ("date_raw", "posted_raw", "amount_raw", "debit_raw", "credit_raw", "merchant_raw", "mcc_raw",
        "card_raw", "holder_raw", "ref_raw", "city_raw", "state_raw", "country_raw")


def _raw(spark):
    cells = ", ".join(f"{c} string" for c in _RAW)
    return cut_lineage(spark.createDataFrame(
        [(1, "u", "f.csv", False, "2001-02-03", "", "($1,234.50)", "", "", " Cash Back  ", "", "", "",
          "", "", "", "")], f"row_idx long, user_id string, source_file string, is_split boolean, {cells}"))


def _interpreted(df):
    """Operators over rows that run outside of generated code."""
    plan = df._jdf.queryExecution().sparkPlan()
    prepared = df.sparkSession._jvm.org.apache.spark.sql.execution.QueryExecution.prepareExecutedPlan(
        df.sparkSession._jsparkSession, plan).toString()
    return [line for line in prepared.split("\n") if "*(" not in line
            and any(op in line for op in ("Generate ", "Project ", "Filter "))]


def test_parsing_and_keys_of_an_upload_are_generated_code(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parsed = parse_cells(_raw(spark))
        assert not _interpreted(parsed)
        rows = cut_lineage(suggest_category(parsed.drop("error"), None))
        keyed = with_dedup_keys(rows, is_complete().alias("is_live"))
        assert not _interpreted(keyed)
        probes = _row_probes(cut_lineage(keyed.withColumn("account_id", F.lit(1).cast("long"))))
        assert not _interpreted(probes)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_the_steps_read_what_the_whole_functions_read(spark):
    amounts = ["", "12", "(1,234.50)", "$ 5", "( $7 )", "1 000", "1 000", "1\x1c0", "N/A",
               "5d", "()", ")(", "1　", "-.5", "١"]
    df = spark.createDataFrame([(a,) for a in amounts], "text string").withColumn(
        "clean", clean_amount(F.col("text")))
    whole, steps = [r[0] for r in df.select(parse_amount(F.col("text"))).collect()], [
        r[0] for r in df.select(read_clean_amount(F.col("text"), F.col("clean"))).collect()]
    # white space around a cell is gone before it is read
    assert whole[:-3] == steps[:-3]
    names = [None, "", " ", "A  b", "a b", "  A\tB ", "a b", " CafÉ   x ", "a\x1cb", "İ x"]
    df = spark.createDataFrame([(n,) for n in names], "name string").withColumn(
        "low", lowered("name"))
    for row in df.select(collapsed("low"), collapsed_lower(F.col("name"))).collect():
        assert row[0] == row[1]


def test_a_complete_row_lacks_no_field(spark):
    rows = spark.createDataFrame(
        [(d, m, a, k) for d in ("2001-01-01", None) for m in ("  ", "x", None)
         for a in (1.0, float("nan"), None) for k in ("expense", "x", None)],
        "day string, merchant_name string, amount double, transaction_type string").withColumn(
        "transaction_date", F.col("day").cast("date"))
    for row in rows.select(F.size(missing_fields()) == 0, is_complete()).collect():
        assert row[0] == row[1]


def test_shuffle_files_go_with_the_write_that_made_them(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        found = files.getAllBlocks()
        return {found.apply(i).toString() for i in range(found.size())
                if found.apply(i).toString().startswith("shuffle")}

    before = shuffles()
    cut_lineage(spark.range(10_000).repartition(4, "id"))
    written = shuffles() - before
    cut_lineage(spark.range(1))  # the plan of the last write may still be at hand behind it
    for _ in range(50):
        if not shuffles() & written:
            return
        time.sleep(0.2)
    raise AssertionError("shuffle files stay")
