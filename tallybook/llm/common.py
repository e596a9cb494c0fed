"""What the operators share: input columns, word codes, hashes and stored tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.session import cut_lineage

# Rows of one Arrow batch: a batch of the longest texts still fits beside the executor's heap.
ARROW_ROWS = 256
# Words whose codes a Python worker keeps; the store is emptied when it is full.
KEPT_WORDS = 200_000
MAP_BITS = 26
MIX = np.uint64(0x9E3779B97F4A7C15)


def prepared(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches of a session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone; a null text is an empty one."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"))


def stored(df: DataFrame) -> DataFrame:
    """The rows written once to the cluster's shared folder and read back."""
    return cut_lineage(df, packed=False)


def fold(bucket: Column, divisor: int) -> Column:
    """Remainder of the crc32 of an id as text: the held-out rule of the labelled tables."""
    return F.crc32(bucket.cast("string")) % F.lit(divisor)


class Codes(dict):
    """64-bit codes of byte strings, computed once while they are kept."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code


CODES = Codes()


def words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case (bytes.split and lower know only ASCII)."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_codes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(CODES.__getitem__, found), np.uint64, len(found))


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def bit_map(hashes: DataFrame, bits: int = MAP_BITS) -> np.ndarray:
    """2^bits bits, those at the low bits of the hashes set; made by tasks in pieces of 4 KB.

    Its size is fixed (8 MB), whatever the number of hashes.
    """
    slot = F.col("hash").bitwiseAND(F.lit((1 << bits) - 1)) + 1
    pieces = hashes.select(F.bitmap_bucket_number(slot).alias("piece"),
                           F.bitmap_bit_position(slot).alias("bit")) \
        .groupBy("piece").agg(F.bitmap_construct_agg("bit").alias("held")).collect()
    out = np.zeros(1 << (bits - 3), np.uint8)
    for p in pieces:
        own = np.frombuffer(p.held, np.uint8)
        out[(p.piece - 1) * 4096:(p.piece - 1) * 4096 + len(own)] = own
    return out
