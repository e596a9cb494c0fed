"""Cleaning of a document corpus in stages, each written as Parquet and read back for the next.

toxicity -> near duplicates -> benchmark decontamination -> personal data -> token ids. A stage
takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the last return the
columns of documents. Rows without doc_id pass the stages that decide by id (near duplicates,
decontamination) unless their text is rejected by toxicity. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.llm import decontaminate, near_dedup, pii, toxicity, unigram
from tallybook.llm.common import stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below one half."""
    score = toxicity.scorer(toxicity.toxicity_model(docs, table(spark, sf_dir, "labels")))
    return docs.select(*COLUMNS).where(score(F.coalesce("text", F.lit(""))) < 0.5)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id."""
    dropped = near_dedup.near_duplicates(docs).where(~F.col("kept")).select("doc_id")
    return docs.select(*COLUMNS).join(dropped, "doc_id", "left_anti").select(*COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    held = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return docs.select(*COLUMNS).join(held.select("doc_id").distinct(), "doc_id", "left_anti") \
        .select(*COLUMNS)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data and terms that give it away generalised or removed."""
    return pii.sanitised(docs.select(*COLUMNS))


def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, n_bytes, exact: the texts as SentencePiece ids."""
    return unigram.encoded(docs.select("doc_id", "text")).drop("text")


STAGES = [
    ("toxicity", without_toxic),
    ("near_dedup", without_copies),
    ("decontamination", without_benchmark),
    ("pii", without_personal_data),
    ("sentencepiece", as_pieces),
]

ORACLE_SQL = None  # classifier, sketches and piece search have no SQL; run() has no brute force either


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
