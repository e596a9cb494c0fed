"""Benchmark decontamination by spaced-seed hashing.

Fixed masks choose 6 of up to 10 neighbouring words; a word under a 0 may differ. Hashes of all
masked windows of the benchmark are joined with those of the documents, each joint hash gives a
diagonal (document position minus item position), and on a diagonal the item is laid over the whole
document. A document holds an item when any stretch of a diagonal has at least `min_matches` equal
words (of shorter items: four fifths of the words) and `identity` of its words are equal. Reported is
the stretch with the best score (1 for an equal word, -2 for another) or, where that one falls short,
the stretch with the most equal words among all whose words are equal to the share of `identity`.

Scale: a bit map of fixed size (8 MB) of the benchmark's hashes goes to every task, and only
hashes that hit it are shuffled; the exact join removes what hit by chance. Texts are read again for
documents with a joint hash only.

Defined results: words are split at ASCII white space with A-Z in lower case. Null or empty texts and
items with fewer than six words match nothing. Repeated rows of a document or item give one row;
a document without doc_id is reported with a null id. Equal scores: the earliest stretch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import MAP_BITS, MIX, batch, bit_map, mixed, prepared, stored, texts, word_codes, words

MASKS = ("111111", "1110111", "1111011", "1101111", "11011011", "1010110101", "1111101")
SENT_KEYS = 1_000_000  # keys (8 MB) sent to every executor at most
MIN_MATCHES = 12
IDENTITY = 0.75
FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start_word", pa.int64()),
                   ("n_words", pa.int64()), ("n_equal", pa.int64())])


def masked_hashes(codes: np.ndarray, masks=MASKS) -> Iterator[np.ndarray]:
    """For each mask the hash at every position where it fits."""
    for number, mask in enumerate(masks, 1):
        n = len(codes) - len(mask) + 1
        out = np.full(max(n, 0), number, np.uint64)
        if n > 0:
            for k, bit in enumerate(mask):
                if bit == "1":
                    out = out * MIX + codes[k:k + n]
        yield mixed(out)


def best_stretch(doc: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int]:
    """(equal words, start in the document, words) of the best stretch of one diagonal."""
    low, high = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    if low >= high:
        return 0, 0, 0
    equal = doc[low + diagonal:high + diagonal] == item[low:high]
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, -2))])
    gain = total[1:] - np.minimum.accumulate(total[:-1])
    end = int(np.argmax(gain))
    start = int(np.argmin(total[:end + 1]))
    return int(equal[start:end + 1].sum()), low + diagonal + start, end + 1 - start


def longest_stretch(doc: np.ndarray, item: np.ndarray, diagonal: int,
                    identity: float) -> tuple[int, int, int]:
    """Like best_stretch, of the stretch with the most equal words among those of this identity.

    For every end, the earliest start with the identity has the most equal words.
    """
    low, high = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    if low >= high:
        return 0, 0, 0
    equal = doc[low + diagonal:high + diagonal] == item[low:high]
    n_equal = np.concatenate([[0], np.cumsum(equal)])
    over = np.round(n_equal - identity * np.arange(len(n_equal)), 6)
    first = np.searchsorted(-np.minimum.accumulate(over), -over)
    end = int(np.argmax(n_equal - n_equal[first]))
    inside = np.flatnonzero(equal[first[end]:end]) + first[end]
    if not len(inside):
        return 0, 0, 0
    start, last = int(inside[0]), int(inside[-1])
    return len(inside), low + diagonal + start, last + 1 - start


def judged(doc: np.ndarray, item: np.ndarray, diagonals, min_matches: int = MIN_MATCHES,
           identity: float = IDENTITY) -> tuple[int, int, int] | None:
    """The best of the stretches, of any diagonal, that make the item held by the document."""
    if len(item) < MASKS[0].count("1"):
        return None
    need = min(min_matches, -(-4 * len(item) // 5))

    def holds(stretch: tuple[int, int, int]) -> bool:
        return stretch[0] >= need and stretch[0] >= identity * stretch[2]

    found = [s for d in diagonals if holds(s := best_stretch(doc, item, d))
             or holds(s := longest_stretch(doc, item, d, identity))]
    return max(found, key=lambda x: (x[0], -x[1]), default=None)


def _key() -> Column:
    return F.xxhash64("doc_id", "text")


def seeds(benchmark: DataFrame) -> DataFrame:
    """hash, item_id, at: every masked window of the items."""
    schema = pa.schema([("hash", pa.int64()), ("item_id", pa.int64()), ("at", pa.int32())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist()):
                for h in masked_hashes(word_codes(words(text))):
                    yield batch({"hash": h.view(np.int64), "item_id": [item] * len(h),
                                 "at": range(len(h))}, schema)

    return benchmark.mapInArrow(rows, "hash long, item_id long, at int").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, min_matches: int = MIN_MATCHES,
                 identity: float = IDENTITY) -> DataFrame:
    """doc_id, item_id, start_word, n_words, n_equal: a row for each document and item it holds."""
    spark = prepared(docs.sparkSession)
    items = stored(benchmark.select(F.col("item_id").cast("long").alias("item_id"),
                                    F.coalesce(F.col("text"), F.lit("")).alias("text")).distinct())
    known = stored(seeds(items))
    sent = spark.sparkContext.broadcast(bit_map(known.select("hash").distinct()))
    schema = pa.schema([("key", pa.int64()), ("hash", pa.int64()), ("at", pa.int32())])

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, low = sent.value, np.uint64((1 << MAP_BITS) - 1)
        for b in batches:  # the words of a batch in one row; windows over two texts are dropped
            found = [words(t) for t in b.column("text").to_pylist()]
            ends = np.cumsum([len(w) for w in found])
            keys, codes = np.asarray(b.column("key")), word_codes([w for x in found for w in x])
            out = []
            for mask, h in zip(MASKS, masked_hashes(codes)):
                slot = h & low
                at = np.flatnonzero((bits[slot >> np.uint64(3)]
                                     >> (slot & np.uint64(7)).astype(np.uint8)) & 1)
                row = np.searchsorted(ends, at, "right")
                inside = at + len(mask) <= ends[row]
                at, row = at[inside], row[inside]
                out.append((keys[row], h[at].view(np.int64), at - (ends - list(map(len, found)))[row]))
            yield batch(dict(zip(schema.names, map(np.concatenate, zip(*out)))), schema)

    keyed = texts(docs).select(_key().alias("key"), "doc_id", "text")
    met = keyed.select("key", "text").mapInArrow(hits, "key long, hash long, at int")
    near = stored(met.join(known.withColumnRenamed("at", "item_at"), "hash")
                  .select("key", "item_id", (F.col("at") - F.col("item_at")).alias("diagonal"))
                  .groupBy("key", "item_id").agg(F.collect_set("diagonal").alias("diagonals")))
    keys = stored(near.select("key").distinct())
    few = keys.count() <= SENT_KEYS
    held = keyed.join(F.broadcast(keys) if few else keys, "key", "left_semi")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                best = judged(word_codes(words(r["text"])), word_codes(words(r["item"])),
                              r["diagonals"], min_matches, identity)
                if best:
                    out.append((r["doc_id"], r["item_id"], best[1], best[2], best[0]))
            yield batch(dict(zip(FOUND.names, zip(*out))) if out
                        else {n: [] for n in FOUND.names}, FOUND)

    pairs = held.join(near, "key").join(
        items.select("item_id", F.col("text").alias("item")), "item_id")
    found = pairs.select("doc_id", "text", "item_id", "item", "diagonals").mapInArrow(
        judge, "doc_id long, item_id long, start_word long, n_words long, n_equal long")
    best = F.max(F.struct("n_equal", (-F.col("start_word")).alias("back"), "n_words"))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select(
        "doc_id", "item_id", (-F.col("b.back")).alias("start_word"), "b.n_words", "b.n_equal")
