"""MinHash near-dedup: fast similarity sketches, banding, exact verification, components.

A document is the set of its distinct word 5-shingles (fewer words: the whole sequence as one;
no words or a null text: the empty set). Documents are linked when their sets' Jaccard similarity
reaches `similarity`; a component is a set of documents connected by links.

The sketch has T coordinates. In rounds 0..T-1 every shingle is hashed to a bin, in rounds T..2T-1
all shingles go to bin round-T, and a bin keeps its smallest (round, hash), so that every coordinate
is filled, also for a set of one. A set that is full after a round takes no part in later ones.

Scale: documents with equal sets are one class before any banding, so a group of copies costs one
row. Within a bucket classes are first compared with its smallest id only; components of what
was confirmed are found; classes of buckets that still hold different components then meet by an
exact prefix filter on their rarest shingles. So no link between different components is lost, and
no bucket of near copies or of texts that share a passage is expanded into all its pairs. Two sets at the least similarity share no band with
probability (1 - 0.75^4)^40 = 3e-7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybook.llm.common import MIX, batch, mixed, prepared, stored, texts, word_codes, words

SHINGLE = 5
BANDS = 40
BAND_ROWS = 4
SIMILARITY = 75  # per cent
SENT_IDS = 1_000_000  # ids (8 MB) sent to every executor at most
SIGNATURE = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()),
                       ("set_hi", pa.int64()), ("set_lo", pa.int64()),
                       ("bands", pa.list_(pa.int64()))])


def shingle_codes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit codes of the shingles of one text."""
    codes = word_codes(words(text))
    if not len(codes):
        return codes
    width = min(size, len(codes))
    out = np.full(len(codes) - width + 1, width, np.uint64)
    for k in range(width):
        out = out * MIX + codes[k:len(codes) - width + 1 + k]
    return np.unique(mixed(out))


def sketches(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """One row of coordinates per non-empty set."""
    n = len(sets)
    out = np.full(n * coordinates, np.iinfo(np.uint64).max, np.uint64)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    items = np.concatenate(sets) if n else np.empty(0, np.uint64)
    low = np.uint64((1 << 40) - 1)
    for turn in range(2 * coordinates):
        if not len(items):
            break
        seed = np.uint64((0xA0761D6478BD642F * (turn + 1)) % (1 << 64))
        x = mixed(items ^ seed)
        if turn < coordinates:
            at = (((x >> np.uint64(40)) * np.uint64(coordinates)) >> np.uint64(24)).astype(np.int64)
        else:
            at = np.full(len(items), turn - coordinates)
        np.minimum.at(out, owner * coordinates + at, (np.uint64(turn) << np.uint64(40)) | (x & low))
        open_rows = (out.reshape(n, coordinates) == np.iinfo(np.uint64).max).any(axis=1)
        left = open_rows[owner]
        if not left.all():
            owner, items = owner[left], items[left]
    return out.reshape(n, coordinates)


def band_codes(rows: np.ndarray, bands: int, band_rows: int) -> np.ndarray:
    grouped = rows.reshape(len(rows), bands, band_rows)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), grouped.shape[:2]).copy()
    for k in range(band_rows):
        out = mixed(out * MIX + grouped[:, :, k])
    return out.view(np.int64)


def signatures(docs: DataFrame, bands: int = BANDS, band_rows: int = BAND_ROWS,
               shingle: int = SHINGLE) -> DataFrame:
    """doc_id, set size, 128-bit code of the set and band codes, a row for each row of docs."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_codes(t, shingle) for t in b.column("text").to_pylist()]
            full = [i for i, s in enumerate(sets) if len(s)]
            codes = band_codes(sketches([sets[i] for i in full], bands * band_rows),
                               bands, band_rows)
            per_row: list = [[]] * len(sets)
            for i, row in zip(full, codes):
                per_row[i] = row
            digest = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            yield batch({
                "doc_id": b.column("doc_id"), "n_shingles": [len(s) for s in sets],
                "set_hi": [int.from_bytes(d[:8], "little", signed=True) for d in digest],
                "set_lo": [int.from_bytes(d[8:], "little", signed=True) for d in digest],
                "bands": per_row}, SIGNATURE)

    return texts(docs).mapInArrow(
        rows, "doc_id long, n_shingles long, set_hi long, set_lo long, bands array<long>")


def confirmed(pairs: DataFrame, held_texts: DataFrame, similarity: int = SIMILARITY,
              shingle: int = SHINGLE) -> DataFrame:
    """Those of the pairs (a, b) whose full shingle sets reach the similarity."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = (None, None)  # the hub's set; its rows follow each other
        for b in batches:
            keep = []
            for i, (a, ta, tb) in enumerate(zip(b.column("a").to_pylist(), b.column("text_a"),
                                                b.column("text_b"))):
                if held[0] != a:
                    held = (a, shingle_codes(ta.as_py(), shingle))
                other = shingle_codes(tb.as_py(), shingle)
                both = len(np.intersect1d(held[1], other, assume_unique=True))
                if both and 100 * both >= similarity * (len(held[1]) + len(other) - both):
                    keep.append(i)
            yield b.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    of_a = held_texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    of_b = held_texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(of_b, "b").join(of_a, "a").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(rows, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that the links (a, b) reach from each linked id.

    Alternates large and small stars until the edges no longer change; every step is a grouped
    minimum and a join, and only a count and a checksum come to the driver.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                 .where("u <> v").distinct())
    state = None
    while True:
        check = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if check[0] == 0 or tuple(check) == state:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
                now.select("v", "v").distinct())
        state = tuple(check)
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").where("v > u").select(
            F.col("v").alias("u"), F.least("u", "m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        now = stored(large.join(low, "u").select(
            F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")),
                              F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v").where("u <> v").distinct())


def _alike_sizes(pairs: DataFrame, similarity: int) -> DataFrame:
    """Drops pairs whose set sizes alone keep them below the similarity."""
    return pairs.where(100 * F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b"))


def rare_partners(rows: DataFrame, held: DataFrame, similarity: int = SIMILARITY,
                  shingle: int = SHINGLE) -> DataFrame:
    """Pairs (a, b) of rows(id, n, component) of different components that can be similar enough.

    An exact prefix filter: with all shingles in one order, the rarest first, two sets that reach
    the similarity share a shingle with so much left of both, from it to the end of the order, that
    the overlap they need can still be met. So a passage that many texts share makes no pairs
    unless it begins in the rarest quarter of the larger set and the rarest seventh of the other.
    """

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                found = shingle_codes(text.as_py(), shingle).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(found), doc_id, np.int64)), pa.array(found)],
                    names=["id", "code"])

    ids = rows.select(F.col("id").alias("doc_id"))
    listed = stored(held.join(ids, "doc_id", "left_semi").select("doc_id", "text")
                    .mapInArrow(codes, "id long, code long"))
    shared = listed.groupBy("code").agg(F.count("*").alias("df")).where("df > 1")
    first = F.row_number().over(Window.partitionBy("id").orderBy("df", "code"))
    kept = listed.join(shared, "code").withColumn("place", first) \
        .withColumn("n_shared", F.count("*").over(Window.partitionBy("id"))) \
        .join(rows, "id")
    # shingles of one set alone come first in its order and meet nothing
    at = F.col("place") + F.col("n") - F.col("n_shared")
    prefix = stored(kept.withColumn("left", F.col("n") - at + 1)
                    .where(100 * F.col("left") >= similarity * F.col("n"))
                    .select("id", "n", "component", "code", "left"))
    # of two sets at the similarity the smaller one holds more of the shared shingles
    short = (100 + similarity) * F.col("left") >= 2 * similarity * F.col("n")
    side = {x: rows.select("code", *[F.col(c).alias(f"{c}_{x}")
                                     for c in ("id", "n", "component", "left")])
            for x, rows in (("a", prefix.where(short)), ("b", prefix))}
    enough = ((100 + similarity) * F.least("left_a", "left_b")
              >= similarity * (F.col("n_a") + F.col("n_b")))
    across = side["a"].join(side["b"], "code").where(
        "(n_a < n_b or n_a = n_b and id_a < id_b) and component_a <> component_b").where(enough)
    return _alike_sizes(across, similarity).select(
        F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Texts of the given ids; few ids are sent to the documents, many are joined by a shuffle."""
    few = ids.count() <= SENT_IDS
    return texts(docs).join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def near_duplicates(docs: DataFrame, similarity: int = SIMILARITY, bands: int = BANDS,
                    band_rows: int = BAND_ROWS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each row of docs.

    Empty sets are linked with nothing (component_id is their own id). A row without doc_id is
    judged by its text like any other, but never gives a component its id; component_id is null
    when no row of the component has an id. Rows that repeat an id each get a row. Extra columns of
    docs are not read. An empty table gives an empty result.
    """
    prepared(docs.sparkSession)
    signed = stored(signatures(docs, bands, band_rows, shingle))
    classes = signed.where("n_shingles > 0").groupBy("set_hi", "set_lo").agg(
        F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"),
        F.first("bands").alias("bands"), F.count("*").alias("copies"))
    classes = stored(classes)
    banded = classes.where("id is not null").select("id", "n", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min(F.struct("id", "n")).alias("hub"),
                                         F.max("id").alias("last")).where("hub.id <> last")
    members = stored(banded.join(buckets.select("band", "hub"), "band"))
    ids = stored(members.select(F.col("id").alias("doc_id")).distinct())
    held = stored(_only(docs, ids))

    star = stored(_alike_sizes(members.where("id <> hub.id").select(
        F.col("hub.id").alias("a"), F.col("id").alias("b"),
        F.col("hub.n").alias("n_a"), F.col("n").alias("n_b")), similarity)
        .select("a", "b").distinct())
    first = stored(confirmed(star.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"),
                             held, similarity, shingle))
    label = components(first)
    second = stored(confirmed(_apart(star, label).select("a", "b"), held, similarity, shingle))
    label = components(label.select(F.col("component").alias("a"), F.col("id").alias("b"))
                       .union(second))

    named = members.select("band", "id", "n").join(label, "id", "left").select(
        "band", "id", "n", F.coalesce("component", "id").alias("component"))
    mixed_bands = named.groupBy("band").agg(
        F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    rest = stored(named.join(mixed_bands.select("band"), "band")
                  .select("id", "n", "component").distinct())
    across = rare_partners(rest, held, similarity, shingle)
    third = confirmed(across.join(star, ["a", "b"], "left_anti"), held, similarity, shingle)
    label = components(label.select(F.col("component").alias("a"), F.col("id").alias("b"))
                       .union(third))

    copied = classes.where("copies > 1").select("set_hi", "set_lo", F.col("id").alias("class_id"))
    return signed.select("doc_id", "n_shingles", "set_hi", "set_lo") \
        .join(copied, ["set_hi", "set_lo"], "left") \
        .withColumn("class_id", F.when(F.col("n_shingles") > 0, F.col("class_id"))) \
        .withColumn("id", F.coalesce("class_id", "doc_id")) \
        .join(label, "id", "left") \
        .select("doc_id", "n_shingles", F.coalesce("component", "id").alias("component_id")) \
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """The pairs whose ids are in different components so far."""
    side = {x: label.select(F.col("id").alias(x), F.col("component").alias(f"of_{x}"))
            for x in "ab"}
    return pairs.join(side["a"], "a", "left").join(side["b"], "b", "left").where(
        F.coalesce("of_a", "a") != F.coalesce("of_b", "b"))


SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN []
    WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3),
                        lambda i: array_to_string(list_slice(words, i, i + 4), ' ')) END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_both
  FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * n_both >= 75 * (na.n + nb.n - n_both)),
r AS (
  SELECT doc_id AS id, doc_id AS other FROM documents
  UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.other),
c AS (SELECT id, min(other) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id,
       d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON c.id = d.doc_id
"""
