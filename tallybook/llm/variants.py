"""Spelling variant grouping: frequent words one edit apart, found by a frontier walk of tries.

Words with their counts come from one pass over whole texts, counted in the task before the shuffle.
All words make two tries, one of words read forwards and one of words read backwards. A trie is an
edge table (side, node, first letter, label, child): a node is a prefix at which words end or go
apart, known by a 128-bit hash of the prefix, and an edge carries all letters up to the next node, so
the depth of a walk follows the branching, not the length of a word.

Two words one edit apart agree before or after the middle of the first. So every word starts at its
own nodes at or beyond its middle, in both tries, as states (word, position, node) without an edit; the
tries hold no prefixes shorter than that of words a letter longer. One join with the edge table makes
the edit: at a node a letter is left out before an edge or, for every edge but the word's own, its
letter is inserted or stands in place of the word's. Levels of joins then move the frontier of states
with one edit, which only follow the word's own letters. A state with one edit at the end of its word
at a node where a word ends is a pair of neighbours. A node has one edge a letter, so levels grow with
the words, not with their pairs, and nothing is capped.

Defined results: a null text has no words; a null doc_id counts as an empty id text; repeated rows
count repeatedly; very long runs are words like any other; ties of the form go to the smaller word
in code-point order; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybook.llm.common import batch, prepared, stored

LEAST_LENGTH, LEAST_COUNT = 5, 3
RATIO = 2        # a form is at least so many times as frequent
DIVISOR = 97     # of the hash that leaves a letter out of a run
KEPT = 300_000   # different words a task counts before it hands them on
SIDES = "<>"     # read forwards, read backwards
C, L = F.col, F.lit


def patterns(least: int) -> tuple[re.Pattern, re.Pattern]:
    """Maximal runs of at least so many letters, of ASCII bytes and of any text."""
    return re.compile(b"[a-z]{%d,}" % least), re.compile("[a-z\u00C0-\u00FF]{%d,}" % least)


def runs(doc_id: int | None, text: bytes, least: int = LEAST_LENGTH) -> Iterator[tuple[bytes, int]]:
    """(result in UTF-8, occurrences) of every different run of a text in UTF-8."""
    plain, any_letters = patterns(least)
    text = text.lower()  # of bytes: A-Z alone
    if text.isascii():
        found = Counter(plain.findall(text))
    else:
        found = {w.encode(): n for w, n in Counter(any_letters.findall(text.decode())).items()}
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in found.items():
        code = zlib.crc32(run, start)
        if code % DIVISOR == 0:
            letters = run.decode()
            at = code % len(letters)
            run = (letters[:at] + letters[at + 1:]).encode()
        yield run, n


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH,
                least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n of the words that are long and frequent enough."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(),
                                    b.column("text").cast(pa.binary()).to_pylist()):
                for word, n in runs(doc_id, text or b"", least_length):
                    held[word] += n
                if len(held) > KEPT:
                    yield batch({"word": [w.decode() for w in held], "n": list(held.values())},
                                schema)
                    held.clear()
        if held:
            yield batch({"word": [w.decode() for w in held], "n": list(held.values())}, schema)

    prepared(docs.sparkSession)
    rows = docs.select(C("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(counted, "word string, n long").groupBy("word").agg(
        F.sum("n").alias("n")).where(
        (C("n") >= least_count) & (F.char_length("word") >= least_length))


def prefixes(words: DataFrame) -> DataFrame:
    """side, s, m, pos, node, ch: the prefixes of every word read forwards and backwards that a word
    at most a letter shorter, longer or as long can meet at or beyond its own middle.

    s is the word as read, m its length, node the hash of its first pos letters, ch the code of the
    next letter (0 where the word ends). Sides have different nodes.
    """
    schema = pa.schema([("side", pa.int32()), ("s", pa.string()), ("m", pa.int32()),
                        ("pos", pa.int32()), ("node", pa.binary()), ("ch", pa.int32())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for word in b.column("word").to_pylist():
                m = len(word)
                for side, s in enumerate((word, word[::-1])):
                    start = m // 2 if side else (m - 1) // 2  # the middle of m - 1 letters
                    # the side is part of what is hashed: seeds would let short prefixes collide
                    state = xxhash.xxh3_128((SIDES[side] + s[:start]).encode())
                    for pos in range(start, m):
                        out.append((side, s, m, pos, state.digest(), ord(s[pos])))
                        state.update(s[pos].encode())
                        if len(out) >= 10_000:
                            yield batch(dict(zip(schema.names, zip(*out))), schema)
                            out = []
                    out.append((side, s, m, m, state.digest(), 0))
            if out:
                yield batch(dict(zip(schema.names, zip(*out))), schema)

    return words.select("word").mapInArrow(
        cut, "side int, s string, m int, pos int, node binary, ch int")


def tries(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, path): the edge tables of both tries, and every word's nodes."""
    rows = stored(prefixes(words))
    nodes = rows.groupBy("node").agg(F.min("ch").alias("least"), F.max("ch").alias("most")) \
        .where("least <> most or least = 0").select("node")
    path = stored(rows.join(nodes, "node").select("side", "s", "m", "pos", "node"))
    # the next node of a path; all words with this node and letter have the same one
    along = Window.partitionBy("side", "s").orderBy("pos")
    edges = path.select("node", "s", "pos", F.lead("pos").over(along).alias("to"),
                        F.lead("node").over(along).alias("child")).where(C("to").isNotNull()) \
        .select("node", F.substr("s", C("pos") + 1, C("to") - C("pos")).alias("label"), "child") \
        .distinct()
    return stored(edges.withColumn("way", F.substr("label", L(1), L(1)))
                  .withColumn("k", F.char_length("label"))), path


def neighbours(words: DataFrame) -> DataFrame:
    """word, near: all ordered pairs of words one inserted, deleted or replaced letter apart."""
    edges, path = tries(words)
    middle = F.when(C("side") == 0, F.floor(C("m") / 2)).otherwise(C("m") - F.floor(C("m") / 2))
    fresh = path.where(C("pos") >= middle)
    # the edge's letter is inserted (skip = 0), replaces the word's next one (1) or follows the one
    # left out (2); letters of the label after its first must be the word's next ones
    tail = F.substr("label", L(2), C("k"))
    level = stored(fresh.join(edges, "node").withColumn(
        "skip", F.explode(F.array(L(0), L(1), L(2)))).where(
        (C("pos") + C("skip") + C("k") - 1 <= C("m"))
        & F.when(C("skip") == 2, C("way") == F.substr("s", C("pos") + 2, L(1)))
        .otherwise(C("way") != F.substr("s", C("pos") + 1, L(1)))
        & (tail == F.substr("s", C("pos") + 1 + C("skip"), C("k") - 1))).select(
        "side", "s", "m", (C("pos") + C("skip") + C("k") - 1).cast("int").alias("pos"),
        C("child").alias("node")))
    # the last letter left out ends at the node itself
    ended = fresh.where(C("pos") == C("m") - 1).select("side", "s", "node")
    while True:
        ended = ended.unionByName(level.where("pos = m").select("side", "s", "node"))
        frontier = level.where("pos < m")
        if frontier.isEmpty():
            break
        level = stored(frontier.withColumn("way", F.substr("s", C("pos") + 1, L(1)))
                       .join(edges, ["node", "way"])
                       .where(C("label") == F.substr("s", C("pos") + 1, C("k")))
                       .select("side", "s", "m", (C("pos") + C("k")).alias("pos"),
                               C("child").alias("node")))
    ends = path.where("pos = m").select("node", C("s").alias("other"))
    back = [F.when(C("side") == 0, C(c)).otherwise(F.reverse(c)) for c in ("s", "other")]
    return ended.join(ends, "node").select(back[0].alias("word"), back[1].alias("near")).distinct()


def roots(links: DataFrame) -> DataFrame:
    """word, root of every word with a form: forms are followed to the last, in doubled steps.

    A form is at least twice as frequent, so chains are short and have no circle.
    """
    known = stored(links.select("word", C("form").alias("root")))
    while True:
        further = known.select(C("word").alias("root"), C("root").alias("next"))
        joined = stored(known.join(further, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), C("next").isNotNull().alias("moved")))
        known = joined.select("word", "root")
        if joined.where("moved").isEmpty():
            return known


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every frequent word."""
    words = stored(word_counts(docs))
    pairs = neighbours(words)
    sized = pairs.join(words.select(C("word").alias("near"), C("n").alias("near_n")), "near")
    best = sized.groupBy("word").agg(
        F.count(L(1)).alias("n_near"), F.min(F.struct((-C("near_n")).alias("less"), "near"))
        .alias("best"))
    is_form = -C("best.less") >= RATIO * C("n")
    formed = stored(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", L(0)).alias("n_near"),
        F.when(is_form, C("best.near")).alias("form"),
        F.when(is_form, -C("best.less")).alias("form_n")))
    ends = roots(formed.where(C("form").isNotNull()))
    return formed.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


SQL = f"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([i] || range(8), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)),
runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents)),
counted AS (
  SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= {LEAST_LENGTH}
  GROUP BY doc_id, run),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce([4294967295] || flatten(list_transform(
    string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda c:
      CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)]
           ELSE [195, CAST(unicode(c) - 64 AS BIGINT)] END)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
  FROM counted, crc),
words AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % {DIVISOR} = 0
           THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word,
           n FROM hashed)
  WHERE length(word) >= {LEAST_LENGTH}
  GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
cut AS MATERIALIZED (
  SELECT word, n, left(word, i - 1) AS a, substr(word, i + 1) AS b
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT x.word, y.word AS near, y.n FROM cut x JOIN cut y
    ON x.a || '*' || x.b = y.a || '*' || y.b AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM cut x JOIN words y ON x.a || x.b = y.word
  UNION SELECT y.word, x.word, x.n FROM cut x JOIN words y ON x.a || x.b = y.word),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY word ORDER BY n DESC, near) AS place,
         count(*) OVER (PARTITION BY word) AS n_near FROM near),
formed AS MATERIALIZED (
  SELECT w.word, w.n, CAST(coalesce(r.n_near, 0) AS BIGINT) AS n_near,
         CASE WHEN r.n >= {RATIO} * w.n THEN r.near END AS form,
         CASE WHEN r.n >= {RATIO} * w.n THEN r.n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.place = 1),
chain AS (
  SELECT word, word AS root FROM formed
  UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.root
  WHERE f.form IS NOT NULL),
last AS (
  SELECT c.word, c.root FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NULL)
SELECT f.word, f.form, l.root, f.n, f.n_near, f.form_n FROM formed f JOIN last l ON l.word = f.word
"""
