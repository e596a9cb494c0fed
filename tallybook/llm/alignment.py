"""Cross-tokenizer alignment: shared token ends found by a galloping intersection.

Every text is encoded by two vocabularies whose tokens spell the same bytes (a blank and the text).
The ends of both token lists ascend; the shorter list drives an exponential search, then a binary
one, into the longer (`galloping`, for all values of an array at once). Common ends cut both lists
into groups, and the ranks of two successive common ends give the tokens of a group on either side.
Tokens of one group are linked, each with each; a text's links are kept as different id pairs with
their number.

How many documents hold a pair is counted over all documents. Texts are dealt to blocks of bounded
size (`BLOCK` characters, or one text): a block stores its different pairs once and its documents as
numbers into that list, so what is shuffled to be counted, and comes back as counts, is the pairs of
blocks and not of documents. Counts meet the documents of their block again by a cogroup.

Defined results: texts that are null, empty, or that a vocabulary does not spell back byte by byte
have no tokens: zeros and an empty digest. Special tokens in a text are plain text. Repeated rows
and rows with equal or null doc_id are documents of their own. An empty table gives no rows; extra
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import batch, prepared, stored
from tallybook.llm.token_files import VISIBLE, Encoder

BLOCK = 8_000_000     # characters of the texts of one block
PART = 500_000        # characters of texts aligned at a time
ANCHOR = 64           # positions between two searches of the whole list
KEPT_CHARACTERS = 16_000_000
SPACE = "▁"
# which character of a byte-level vocabulary stands for which byte
BYTE_OF = {chr(b): b for b in VISIBLE} | {
    chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in VISIBLE)}

C, L = F.col, F.lit


class ByteLevel:
    """A byte-level vocabulary file: ids of a blank and a text."""

    def __init__(self, path: str):
        self.encoder = Encoder(path, specials=False)
        vocabulary = self.encoder.library.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = (bytes(BYTE_OF[c] for c in token)
                             if all(c in BYTE_OF for c in token) else token.encode())

    def encode(self, found: list[str]) -> list[np.ndarray]:
        return self.encoder.encode([" " + t for t in found])


class Pieces:
    """A SentencePiece vocabulary file, which adds the blank itself.

    Where no piece holds the blank mark after another character, the ids of a text are those of its
    chunks, cut before each run of blanks; different chunks are encoded once while they are kept.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        pieces = [self.library.id_to_piece(i) for i in range(n)]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.library.is_byte(i)
                      else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.by_chunk = (not any(SPACE in p.lstrip(SPACE) for p in pieces)
                         and self.library.encode(" a  b ") == self.library.encode(" a")
                         + self.library.encode(" b") + [self.library.piece_to_id(SPACE)])
        self.blank = np.array([self.library.piece_to_id(SPACE)], "<u4").tobytes()
        self.kept: dict[str, bytes] = {}
        self.characters = 0

    def _encode(self, found: list[str]) -> list[bytes]:
        return [np.array(ids, "<u4").tobytes()
                for ids in self.library.encode(found, num_threads=1)]

    def encode(self, found: list[str]) -> list[np.ndarray]:
        plain = [not self.by_chunk or t.startswith(" ") or t.endswith(" ") or "  " in t
                 or SPACE in t for t in found]
        whole = iter(self._encode([t for t, x in zip(found, plain) if x]))
        if self.characters > KEPT_CHARACTERS:
            self.kept.clear()
            self.characters = 0
        rows = [None if x else t.split(" ") for t, x in zip(found, plain)]
        new = list({w for row in rows if row for w in row if w not in self.kept})
        self.kept.update(zip(new, self._encode(new)))
        self.characters += sum(map(len, new))
        return [np.frombuffer(next(whole) if row is None
                              else b"".join(map(self.kept.__getitem__, row)), "<u4")
                for row in rows]


def galloping(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Rank in `long` (both ascend) of the first value no less than each value of `short`.

    Every ANCHOR-th value of `short` is found by a binary search; from there each value doubles its
    step until it has passed its target and then halves the span it jumped over.
    """
    n = len(long)
    anchors = np.searchsorted(long, short[::ANCHOR])
    low = np.repeat(anchors, ANCHOR)[:len(short)].astype(np.int64)
    high, step = low.copy(), 1
    open_ = np.flatnonzero((high < n) & (long[np.minimum(high, n - 1)] < short))
    while len(open_):
        low[open_] = high[open_] + 1
        high[open_] = np.minimum(low[open_] + step, n)
        step *= 2
        at = high[open_]
        open_ = open_[(at < n) & (long[np.minimum(at, n - 1)] < short[open_])]
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_]) // 2
        less = long[middle] < short[open_]
        low[open_[less]] = middle[less] + 1
        high[open_[~less]] = middle[~less]
        open_ = open_[low[open_] < high[open_]]
    return low


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ranks in a, ranks in b) of the ends that both lists have."""
    if len(a) > len(b):
        right, left = common_ends(b, a)
        return left, right
    if not len(b):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = galloping(a, b)
    same = np.flatnonzero((at < len(b)) & (b[np.minimum(at, len(b) - 1)] == a))
    return same, at[same]


class Aligner:
    """Both vocabularies, and the groups, digests and links of texts."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        self.size_a = np.array([len(x) for x in self.a.bytes], np.int64)
        self.size_b = np.array([len(x) for x in self.b.bytes], np.int64)
        # what stands behind an id in a digest: a comma, or the end of its side or group
        self.names = ([f"{i}{end}" for end in ",|" for i in range(len(self.a.bytes))]
                      + [f"{i}{end}" for end in ",;" for i in range(len(self.b.bytes))])

    def tokens(self, found: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both sides, empty where a text has no tokens."""
        none = np.empty(0, "<u4")
        with_text = [i for i, t in enumerate(found) if t and SPACE not in t]
        texts = [found[i] for i in with_text]
        a, b = [none] * len(found), [none] * len(found)
        for i, text, x, y in zip(with_text, texts, self.a.encode(texts), self.b.encode(texts)):
            plain = b" " + text.encode()
            if all(plain == b"".join(map(side.bytes.__getitem__, ids.tolist()))
                   for side, ids in ((self.a, x), (self.b, y))):
                a[i], b[i] = x, y
        return a, b

    def aligned(self, found: list[str | None]) -> dict[str, list]:
        """n_a, n_b, n_groups, n_links, groups_sha256 and (pairs, links) of every text."""
        a, b = self.tokens(found)
        n_a, n_b = (np.array([len(x) for x in side], np.int64) for side in (a, b))
        ids_a = np.concatenate([np.empty(0, "<u4"), *a]).astype(np.int64)
        ids_b = np.concatenate([np.empty(0, "<u4"), *b]).astype(np.int64)
        # texts one behind the other: the end of a text is a common end
        at_a, at_b = common_ends(np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b]))
        first_a, first_b = (np.concatenate([[0], at + 1])[:-1] for at in (at_a, at_b))
        in_a, in_b = at_a + 1 - first_a, at_b + 1 - first_b
        doc = np.searchsorted(np.cumsum(n_a), first_a, side="right")
        n = len(found)
        links = in_a * in_b
        n_links = np.bincount(doc, links, n).astype(np.int64)
        # digests: a's tokens of a group, then b's
        place = np.concatenate([
            np.arange(len(ids_a)) + np.repeat(first_b, in_a),
            np.arange(len(ids_b)) + np.repeat(first_a + in_a, in_b)])
        names_a, names_b = ids_a.copy(), ids_b + 2 * len(self.a.bytes)
        names_a[at_a] += len(self.a.bytes)
        names_b[at_b] += len(self.b.bytes)
        ordered = np.empty(len(place), np.int64)
        ordered[place] = np.concatenate([names_a, names_b])
        spelt = list(map(self.names.__getitem__, ordered.tolist()))
        ends = np.cumsum(n_a + n_b)
        digests = [hashlib.sha256("".join(spelt[e - k:e])[:-1].encode()).hexdigest() if k else ""
                   for e, k in zip(ends.tolist(), (n_a + n_b).tolist())]
        pairs = [self._pairs(ids_a, ids_b, first_a[lo:hi], first_b[lo:hi], in_a[lo:hi],
                             in_b[lo:hi])
                 for lo, hi in zip(np.searchsorted(doc, np.arange(n)),
                                   np.searchsorted(doc, np.arange(n), side="right"))]
        return {"n_a": n_a.tolist(), "n_b": n_b.tolist(),
                "n_groups": np.bincount(doc, minlength=n).tolist(), "n_links": n_links.tolist(),
                "groups_sha256": digests, "pairs": pairs}

    def _pairs(self, ids_a: np.ndarray, ids_b: np.ndarray, first_a: np.ndarray,
               first_b: np.ndarray, in_a: np.ndarray,
               in_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Different linked id pairs of a text (a * size of b's vocabulary + b) and their links."""
        width, most = len(self.b.bytes), 1_000_000
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        links = in_a * in_b
        ends = np.cumsum(links)
        low = 0
        while low < len(links):
            done = ends[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(ends, done + most, side="right")))
            if high == low + 1 and links[low] > most:  # one long group: its different ids only
                x, n_x = np.unique(ids_a[first_a[low]:first_a[low] + in_a[low]],
                                   return_counts=True)
                y, n_y = np.unique(ids_b[first_b[low]:first_b[low] + in_b[low]],
                                   return_counts=True)
                key = (x[:, None] * width + y).ravel()
                count = np.outer(n_x, n_y).ravel()
            else:
                part = links[low:high]
                at = np.arange(part.sum()) - np.repeat(np.cumsum(part) - part, part)
                per = np.repeat(in_b[low:high], part)
                key = (ids_a[np.repeat(first_a[low:high], part) + at // per] * width
                       + ids_b[np.repeat(first_b[low:high], part) + at % per])
                key, count = np.unique(key, return_counts=True)
            if low:
                keys, back = np.unique(np.concatenate([keys, key]), return_inverse=True)
                both = np.zeros(len(keys), np.int64)
                np.add.at(both, back, np.concatenate([counts, count]))
                counts = both
            else:
                keys, counts = key, count
            low = high
        return keys, counts


_ALIGNERS: dict = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path(
        "piece_bpe_32k.model")


SUMMARY = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
ALIGNED = pa.schema([
    ("block", pa.string()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
    ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()),
    ("at", pa.list_(pa.int32())), ("links", pa.list_(pa.int64())),
    ("pairs", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64()))])


def aligned(docs: DataFrame, path_a: str | None = None, path_b: str | None = None,
            block_size: int = BLOCK) -> DataFrame:
    """A row per document and, with null n_a, one per block that lists its pairs.

    Of a document: its summary, `at` (numbers of its pairs in the block's list) and `links` (how
    often each is linked). Of a block: `pairs` and `docs` (documents of the block that hold each).
    """
    if path_a is None or path_b is None:
        default = vocabularies()
        path_a, path_b = path_a or default[0], path_b or default[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task = aligner(path_a, path_b), TaskContext.get().partitionId()
        numbers: dict[int, int] = {}
        held = number = 0
        seen = np.zeros(0, np.int64)

        def closed() -> pa.RecordBatch:
            row = dict.fromkeys(ALIGNED.names, [None])
            return batch(row | {"block": [f"{task}-{number}"], "pairs": [list(numbers)],
                                "docs": [seen[:len(numbers)]]}, ALIGNED)

        for part in _parts(batches):
            ids, found = zip(*part)
            made = own.aligned(list(found))
            at = [np.array([numbers.setdefault(k, len(numbers)) for k in keys.tolist()], np.int32)
                  for keys, _ in made["pairs"]]
            if len(seen) < len(numbers):
                seen = np.concatenate([seen, np.zeros(2 * len(numbers) - len(seen), np.int64)])
            for one in at:
                seen[one] += 1
            yield batch({"block": [f"{task}-{number}"] * len(ids), "doc_id": ids, "at": at,
                         "links": [n for _, n in made["pairs"]], "pairs": [None] * len(ids),
                         "docs": [None] * len(ids)}
                        | {name: made[name] for name in SUMMARY}, ALIGNED)
            held += sum(len(t or "") for t in found)
            if held >= block_size:
                yield closed()
                numbers, seen, held, number = {}, np.zeros(0, np.int64), 0, number + 1
        if numbers:
            yield closed()

    prepared(docs.sparkSession)
    rows = docs.select(C("doc_id").cast("long").alias("doc_id"), "text")
    return stored(rows.mapInArrow(
        run, "block string, doc_id long, n_a long, n_b long, n_groups long, n_links long, "
             "groups_sha256 string, at array<int>, links array<long>, pairs array<long>, "
             "docs array<long>"))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows in parts of bounded length of text."""
    part: list[tuple] = []
    size = 0
    for b in batches:
        for row in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
            part.append(row)
            size += len(row[1] or "")
            if size >= PART or len(part) >= 4096:
                yield part
                part, size = [], 0
    if part:
        yield part


def alignment(docs: DataFrame, path_a: str | None = None, path_b: str | None = None,
              block_size: int = BLOCK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    path_a, path_b = path_a or vocabularies()[0], path_b or vocabularies()[1]
    rows = aligned(docs, path_a, path_b, block_size)
    width = _width(path_b)
    listed = rows.where(C("pairs").isNotNull()).select(
        "block", F.posexplode(F.arrays_zip("pairs", "docs")).alias("at", "x")).select(
        "block", "at", C("x.pairs").alias("pair"), C("x.docs").alias("docs"))
    counts = stored(listed.groupBy("pair").agg(F.sum("docs").alias("n")))
    side = F.expr(f"pair div {width}")
    best = counts.groupBy(side.alias("a")).agg(F.max("n").alias("most"))
    rated = counts.withColumn("a", side).join(best, "a").select(
        "pair", "n", (C("n") == C("most")).cast("long").alias("is_best"))
    known = listed.select("block", "at", "pair").join(rated, "pair").select(
        "block", "at", "n", "is_best")

    def summed(documents: pa.Table, of_block: pa.Table) -> pa.Table:
        n = np.zeros(of_block.num_rows, np.int64)
        most = np.zeros(of_block.num_rows, np.int64)  # the count where it is the highest, else 0
        at = of_block.column("at").to_numpy()
        n[at] = of_block.column("n").to_numpy()
        most[at] = of_block.column("is_best").to_numpy()
        per_row = list(zip(_arrays(documents, "at"), _arrays(documents, "links")))
        return documents.select(["doc_id", *SUMMARY]).append_column(
            "n_best", pa.array([int((links * most[x]).sum()) for x, links in per_row], pa.int64())
        ).append_column(
            "count_sum", pa.array([int((links * n[x]).sum()) for x, links in per_row], pa.int64()))

    documents = rows.where(C("n_a").isNotNull()).select(
        C("block").alias("own"), "doc_id", *SUMMARY, "at", "links")
    return documents.groupBy("own").cogroup(known.groupBy("block")).applyInArrow(
        summed, "doc_id long, n_a long, n_b long, n_groups long, n_links long, "
                "groups_sha256 string, n_best long, count_sum long")


def _arrays(rows: pa.Table, name: str) -> Iterator[np.ndarray]:
    """The lists of a column."""
    for chunk in rows.column(name).chunks:
        flat, ends = chunk.values.to_numpy(), chunk.offsets.to_numpy()
        yield from (flat[low:high] for low, high in zip(ends, ends[1:]))


def _width(path_b: str) -> int:
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path_b).get_piece_size()
