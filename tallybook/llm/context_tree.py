"""LM scoring by context-tree weighting over bytes, with a word-count base score beside it.

A text is its UTF-8 bytes and one end symbol (255, which UTF-8 never uses), with end symbols as the
context before the first byte. A byte is eight binary decisions; each decision has a tree
of contexts of 0 to `DEPTH` preceding bytes. A context node's Krichevsky-Trofimov estimate and the
product of its children's weighted probabilities are mixed half and half, bottom up; prediction
mixes the estimates along the path by the weights that the training texts leave at each node.

Documents are packed into chunks, bounded by bytes. A chunk's distinct (context, byte) windows and
words are sorted, difference-coded and sent as one row per bucket: a bucket holds all windows with the
same three nearest context bytes, so that its task has whole subtrees below depth 3. Depths 0 to 2
have at most 256 * 256 * 255 nodes together per decision tree, some hundred thousand in prose, and are
summed by Spark and sent to every task. A bucket answers every chunk with values in the order of the
chunk's own keys, without the keys; chunk and answers meet in a cogroup. Nothing is capped.

Defined results: a null or empty text is the end symbol (and the end token) alone; a null doc_id
is not held out; repeated rows count and are scored each; without training texts every decision is
even and N is 0; an empty table gives no rows. Texts are whole; extra columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.ipc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import batch, fold, prepared, stored, texts, word_codes

DEPTH = 5
END = 255
CHUNK_BYTES, CHUNK_DOCS = 1 << 24, 1 << 16  # of a chunk at most; a longer text is one of its own
BUCKETS = 256
SLICE = 1 << 17   # windows whose subtrees a task builds at a time, but for a larger subtree
STEP = 1 << 20    # sorted windows a chunk handles at a time
GRAM, WORD = 0, 1
END_WORD = 0  # the code of the end token
LEVELS = np.arange(8)


def _windows(raw: bytes) -> np.ndarray:
    n = len(raw) + 1
    x = b"\xff" * DEPTH + raw + b"\xff" * 3  # the end, and what the last eight bytes read
    eight = np.ndarray(n, "<u8", x, strides=(1,))
    return ((eight & np.uint64((1 << 40) - 1)) << np.uint64(8)) | ((eight >> np.uint64(40))
                                                                  & np.uint64(255))


def windows(text: str | None) -> np.ndarray:
    """A number per byte and for the end: the DEPTH bytes before it, nearest first, and itself."""
    return _windows((text or "").encode("utf-8", "surrogatepass")).astype(np.int64)


def tokens(raw: bytes) -> np.ndarray:
    """Codes of the words and of the end."""
    return np.append(word_codes(raw.lower().split()), np.uint64(END_WORD))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function of positive numbers, by shift and Stirling's series."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) \
        + 1 / (12 * y) - 1 / (360 * y ** 3) + 1 / (1260 * y ** 5) - shift


def log_kt(n: np.ndarray) -> np.ndarray:
    """Log of the estimate's probability of counts n[:, 0] and n[:, 1]."""
    return np.where(n.any(axis=1), log_gamma(n[:, 0] + 0.5) + log_gamma(n[:, 1] + 0.5)
                    - log_gamma(n.sum(axis=1) + 1.0) - np.log(np.pi), 0.0)


def decisions(grams: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Node numbers (context of `depth` bytes, place in the byte) and bits: 8 columns each."""
    symbol = (grams & 255)[:, None]
    place = (1 << LEVELS) | (symbol >> (8 - LEVELS))
    context = grams >> (8 * (DEPTH - depth) + 8)
    return (context[:, None] << 8) | place, (symbol >> (7 - LEVELS)) & 1


def parent(nodes: np.ndarray, depth: int) -> np.ndarray:
    """The nodes of the context one byte shorter (the furthest byte is the lowest)."""
    return (nodes >> 16 << 8) | (nodes & 255)


class Level:
    """Nodes of one depth with estimates, weighted probabilities, weights of stopping and, once
    known, the places of their parents in the level above."""

    def __init__(self, nodes: np.ndarray, counts: np.ndarray, below: np.ndarray | None):
        self.nodes, self.counts, self.up = nodes, counts, None
        self.one = (counts[:, 1] + 0.5) / (counts.sum(axis=1) + 1.0)
        stop = log_kt(counts)
        if below is None:
            self.weighted, self.stop = stop, np.ones(len(nodes))
        else:
            self.weighted = np.logaddexp(stop, below) - np.log(2.0)
            self.stop = np.exp(stop - np.logaddexp(stop, below))

    def mix(self, at: np.ndarray, deeper: np.ndarray) -> np.ndarray:
        """Probability of bit 1 at the nodes in these places, given what longer contexts say."""
        stop = self.stop[at]
        return stop * self.one[at] + (1 - stop) * deeper


def shorter(level: Level, depth: int) -> Level:
    """The level of the contexts one byte shorter."""
    kinds, level.up = np.unique(parent(level.nodes, depth), return_inverse=True)
    counts = np.stack([np.bincount(level.up, level.counts[:, i], len(kinds)) for i in (0, 1)], axis=1)
    return Level(kinds, counts, np.bincount(level.up, level.weighted, len(kinds)))


def levels(grams: np.ndarray, n: np.ndarray, top: int = 3) -> tuple[dict[int, Level], np.ndarray]:
    """Levels DEPTH to `top` of the subtrees these windows make up, and the nodes' places at DEPTH.

    Windows of held-out texts alone (n = 0) have nodes too: their estimates are even.
    """
    nodes, bits = decisions(grams, DEPTH)
    kinds, at = np.unique(nodes.ravel(), return_inverse=True)
    counts = np.bincount(2 * at + bits.ravel(), np.repeat(n, 8).astype(float),
                         2 * len(kinds)).reshape(-1, 2)
    out = {DEPTH: Level(kinds, counts, None)}
    for depth in range(DEPTH, top, -1):
        out[depth - 1] = shorter(out[depth], depth)
    return out, at.reshape(-1, 8)


def predicted(grams: np.ndarray, at: np.ndarray, known: dict[int, Level]) -> np.ndarray:
    """log10 of the probability of each window's last byte after the others."""
    p = np.full(at.shape, 0.5)
    for d in range(DEPTH, -1, -1):
        p = known[d].mix(at, p)
        at = known[d].up[at] if d else at
    return np.log10(np.where(decisions(grams, 0)[1] == 1, p, 1 - p)).sum(axis=1)


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplaned(raw: memoryview, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view("<u8").ravel()


def squeezed(*columns: np.ndarray) -> bytes:
    """Unsigned numbers by byte planes, compressed."""
    return pa.Codec("zstd", 1).compress(b"".join(map(_planes, columns)), asbytes=True)


def unsqueezed(data: bytes, n: int, columns: int) -> list[np.ndarray]:
    raw = memoryview(pa.Codec("zstd").decompress(data, decompressed_size=8 * n * columns))
    return [_unplaned(raw[8 * n * i:8 * n * (i + 1)], n) for i in range(columns)]


def by_bucket(kind: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order that brings sorted keys to their buckets, ends of the buckets in it)."""
    spread = keys if kind == WORD else \
        ((keys >> np.uint64(24)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)
    bucket = (spread & np.uint64(BUCKETS - 1)).astype(np.uint8)
    return np.argsort(bucket, kind="stable"), np.cumsum(np.bincount(bucket, minlength=BUCKETS))


class Chunk:
    """The texts of a chunk with their windows in order."""

    def __init__(self, raws: list[bytes]):
        self.size = len(raws)
        ends = np.cumsum([len(r) + 1 for r in raws])
        self.windows = np.empty(ends[-1], np.uint64)  # with the text's number in the low 16 bits
        for i, (raw, end) in enumerate(zip(raws, ends.tolist())):
            self.windows[end - len(raw) - 1:end] = (_windows(raw) << np.uint64(16)) | np.uint64(i)
        self.windows.sort()
        self.first = np.ones(len(self.windows), bool)
        for low in range(1, len(self.windows), STEP):
            high = min(low + STEP, len(self.windows))
            self.first[low:high] = (self.windows[low:high] ^ self.windows[low - 1:high - 1]) >> \
                np.uint64(16) != 0
        parts = [tokens(r) for r in raws]
        self.owner = np.repeat(np.arange(self.size), list(map(len, parts)))
        self.words, self.word_at = np.unique(np.concatenate(parts), return_inverse=True)

    def grams(self) -> np.ndarray:
        return self.windows[self.first] >> np.uint64(16)

    def pieces(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(text, place among the distinct windows) of all windows in order, STEP at a time."""
        at = -1
        for low in range(0, len(self.windows), STEP):
            place = at + np.cumsum(self.first[low:low + STEP])
            at = place[-1]
            yield (self.windows[low:low + STEP] & np.uint64(0xFFFF)).astype(np.int64), place

    def learnt(self, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of every distinct window and word in texts not held out."""
        weight = 1.0 - held
        grams = np.zeros(int(self.first.sum()))
        for text, place in self.pieces():
            n = np.bincount(place - place[0], weight[text])
            grams[place[0]:place[0] + len(n)] += n
        return grams, np.bincount(self.word_at, weight[self.owner], len(self.words))


DOCS = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("text", pa.binary())])
PACKED = "chunk long, kind int, bucket int, n int, data binary, docs binary"


def chunks(docs: DataFrame) -> DataFrame:
    """Per chunk a row with its documents (kind null), and a row per bucket of its distinct windows
    and words with their number in training texts: stored."""
    schema = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()),
                        ("n", pa.int32()), ("data", pa.binary()), ("docs", pa.binary())])

    def pack(members: list[tuple]) -> Iterator[pa.RecordBatch]:
        name = uuid.uuid4().int >> 65
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, DOCS, options=pa.ipc.IpcWriteOptions(
                compression=pa.Codec("zstd", 1))) as out:
            out.write_batch(batch(dict(zip(DOCS.names, zip(*members))), DOCS))
        yield batch({"chunk": [name], "kind": [None], "bucket": [None], "n": [len(members)],
                     "data": [None], "docs": [sink.getvalue().to_pybytes()]}, schema)
        chunk = Chunk([m[2] for m in members])
        grams, found = chunk.learnt(np.array([m[1] for m in members], float))
        for kind, keys, n in ((GRAM, chunk.grams(), grams), (WORD, chunk.words, found)):
            order, ends = by_bucket(kind, keys)
            rows: dict[str, list] = {c: [] for c in schema.names}
            for bucket, at in enumerate(np.split(order, ends[:-1])):
                if len(at):
                    own = keys[at]
                    own[1:] = np.diff(own)
                    for c, x in zip(schema.names, (name, kind, bucket, len(at),
                                                   squeezed(own, n[at]), None)):
                        rows[c].append(x)
            yield batch(rows, schema)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, size = [], 0
        for b in batches:
            for member in zip(b.column("doc_id").to_pylist(), b.column("held_out").to_pylist(),
                              b.column("text").cast(pa.binary()).to_pylist()):
                if members and (size + len(member[2]) >= CHUNK_BYTES
                                or len(members) == CHUNK_DOCS):
                    yield from pack(members)
                    members, size = [], 0
                members.append(member)
                size += len(member[2])
        if members:
            yield from pack(members)

    held = F.coalesce(fold(F.col("doc_id"), 7) == 2, F.lit(False))
    return stored(texts(docs).withColumn("held_out", held).select("doc_id", "held_out", "text")
                  .mapInArrow(collect, PACKED))


def merged(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(keys, their numbers in training texts, places of every row's keys) of a bucket."""
    if not len(rows):
        return np.empty(0, np.uint64), np.empty(0), []
    parts = [unsqueezed(d, n, 2) for d, n in zip(rows.column("data").to_pylist(),
                                                 rows.column("n").to_pylist())]
    own = np.concatenate([np.cumsum(k, dtype=np.uint64) for k, _ in parts])
    keys, at = np.unique(own, return_inverse=True)
    n = np.bincount(at, np.concatenate([n for _, n in parts]).astype(float), len(keys))
    return keys, n, np.split(at, np.cumsum([len(k) for k, _ in parts])[:-1])


def subtrees(keys: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place, windows, numbers) of whole subtrees below depth 3, some SLICE windows at a time."""
    grams = keys.astype(np.int64)
    starts = np.flatnonzero(np.diff(grams >> 24, prepend=-1))
    cuts = starts[np.flatnonzero(np.diff(starts // SLICE, prepend=-1))].tolist()
    for low, high in zip(cuts, [*cuts[1:], len(grams)]):
        yield low, grams[low:high], n[low:high]


def upper_levels(grams: DataFrame) -> dict[int, Level]:
    """Depths 0 to 2: summed by Spark to at most 256 * 256 * 255 rows."""
    schema = pa.schema([("node", pa.int64()), ("zero", pa.float64()), ("one", pa.float64()),
                        ("below", pa.float64())])

    def below(rows: pa.Table) -> pa.Table:
        keys, n, _ = merged(rows)
        out = []
        for _, part, counts in subtrees(keys, n):
            three = levels(part, counts)[0][3]
            kinds, at = np.unique(parent(three.nodes, 3), return_inverse=True)
            out.append(batch({"node": kinds, **{c: np.bincount(at, x) for c, x in zip(
                ("zero", "one", "below"),
                (three.counts[:, 0], three.counts[:, 1], three.weighted))}}, schema))
        return pa.Table.from_batches(out, schema)

    two = grams.groupBy("bucket").applyInArrow(
        below, "node long, zero double, one double, below double") \
        .groupBy("node").agg(F.sum("zero").alias("zero"), F.sum("one").alias("one"),
                             F.sum("below").alias("below")).orderBy("node").toPandas()
    out = {2: Level(two["node"].to_numpy(np.int64), two[["zero", "one"]].to_numpy(float),
                    two["below"].to_numpy(float))}
    out[1] = shorter(out[2], 2)
    out[0] = shorter(out[1], 1)
    return out


ANSWER = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()),
                    ("n", pa.int32()), ("data", pa.binary()), ("total", pa.int64()),
                    ("kinds", pa.int64())])


def answers(rows: DataFrame, kind: int, solve: Callable) -> DataFrame:
    """Per row the values of its keys; total and kinds of its training keys stand once a bucket."""
    def answer(members: pa.Table) -> pa.Table:
        keys, n, places = merged(members)
        values = solve(keys, n)
        first = np.zeros(len(places), np.int64)
        first[:1] = 1
        return pa.Table.from_batches([batch({
            **{c: members.column(c).to_pylist() for c in ("chunk", "bucket", "n")},
            "kind": [kind] * len(places), "data": [values(at) for at in places],
            "total": first * int(n.sum()), "kinds": first * int((n > 0).sum())}, ANSWER)], ANSWER)

    return rows.where(F.col("kind") == kind).select("chunk", "bucket", "n", "data") \
        .groupBy("bucket").applyInArrow(answer, "chunk long, kind int, bucket int, n int, "
                                                "data binary, total long, kinds long")


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    spark = prepared(docs.sparkSession)
    rows = chunks(docs)
    upper = spark.sparkContext.broadcast(upper_levels(
        rows.where(F.col("kind") == GRAM).select("bucket", "n", "data")))

    def predict(keys: np.ndarray, n: np.ndarray) -> Callable:
        found = np.empty(len(keys))
        for low, part, counts in subtrees(keys, n):
            known, at = levels(part, counts)
            known[3].up = np.searchsorted(upper.value[2].nodes, parent(known[3].nodes, 3))
            found[low:low + len(part)] = predicted(part, at, {**known, **upper.value})
        return lambda at: found[at].tobytes()

    told_words = stored(answers(rows, WORD, lambda keys, n: lambda at: squeezed(n[at])))
    seen = told_words.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n"),
                          F.coalesce(F.sum("kinds"), F.lit(0)).alias("v")).first()
    n_all, n_kinds = int(seen["n"]), int(seen["v"])
    told = answers(rows, GRAM, predict).unionByName(told_words) \
        .select("chunk", "kind", "bucket", "n", "data")
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()),
                        ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                        ("train_tokens", pa.int64()), ("base_score", pa.float64()),
                        ("score", pa.float64()), ("bits_per_byte", pa.float64())])

    def spread(found: pa.Table, kind: int, keys: np.ndarray) -> np.ndarray:
        """The values of a chunk's keys, from the rows of its buckets."""
        own = found.filter(pa.compute.equal(found.column("kind"), kind)).sort_by("bucket")
        values = [np.frombuffer(d) if kind == GRAM else unsqueezed(d, n, 1)[0].astype(float)
                  for d, n in zip(own.column("data").to_pylist(), own.column("n").to_pylist())]
        out = np.empty(len(keys))
        out[by_bucket(kind, keys)[0]] = np.concatenate(values)
        return out

    def score(packed: pa.Table, found: pa.Table) -> pa.Table:
        members = pa.ipc.open_stream(packed.column("docs")[0].as_py()).read_all()
        raws = members.column("text").to_pylist()
        chunk, size = Chunk(raws), len(raws)
        value, total = spread(found, GRAM, chunk.grams()), np.zeros(size)
        for text, place in chunk.pieces():
            total += np.bincount(text, value[place], size)
        c = spread(found, WORD, chunk.words)[chunk.word_at]
        n_tokens = np.bincount(chunk.owner, minlength=size)
        base = np.bincount(chunk.owner, np.log10((c + 1) / (n_all + n_kinds + 1)), size)
        return pa.Table.from_arrays([pa.array(x, f.type) for f, x in zip(schema, (
            members.column("doc_id").combine_chunks(), members.column("held_out").combine_chunks(),
            n_tokens, np.bincount(chunk.owner, c > 0, size).astype(np.int64),
            np.full(size, n_all), base, total,
            -total / np.log10(2) / np.array([len(r) + 1 for r in raws])))], schema=schema)

    return rows.where(F.col("kind").isNull()).select("chunk", "docs").groupBy("chunk") \
        .cogroup(told.groupBy("chunk")).applyInArrow(
            score, "doc_id long, held_out boolean, n_tokens long, n_known long, "
                   "train_tokens long, base_score double, score double, bits_per_byte double")
