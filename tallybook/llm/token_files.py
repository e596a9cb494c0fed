"""Token-id output: independent zstandard frames with a trailing seek table and frame checksums.

A file is a run of zstandard frames, each holding whole documents as little-endian unsigned 32-bit
ids; one more frame with the index of its documents; and a skippable frame with the seek table of
the public seekable format (sizes and a checksum per frame). A reader takes the table from the
file's end, the index, and then only the frames of the documents it wants.

Documents are range-partitioned by doc_id and sorted, so files and their rows ascend. Tasks write
files under names of their own attempt; the names that count are those in the manifest, which Spark
commits, so a repeated or lost task leaves at most a file nobody reads.

Defined results: null doc_id sorts first; equal doc_ids are ordered by a hash of the text; a null
or empty text is the end id alone; repeated rows are written repeatedly; an empty table gives an
empty manifest. One document is one frame at least, however long; extra columns are not read.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.llm.common import batch, prepared, stored, texts
from tallybook.session import shared_folder

# Fixed numbers of the public seekable format.
SKIPPABLE, SEEKABLE, CHECKED = 0x184D2A5E, 0x8F92EAB1, 0x80
FRAME_IDS = 1 << 16
END_ID = 0
INDEX = np.dtype([("doc_id", "<i8"), ("null", "<i4"), ("frame", "<i4"), ("first", "<i8"),
                  ("n", "<i8")])
MANIFEST = "file string, first_id long, first_hash long, n_docs long, n_tokens long"


def _file_system(path: str):
    return fs.FileSystem.from_uri(path if "://" in path else path.removeprefix("file:"))


class FrameWriter:
    """One file, written front to back."""

    def __init__(self, out, level: int = 3, frame_ids: int = FRAME_IDS):
        self.out, self.pack = out, zstandard.ZstdCompressor(level=level)
        self.frame_ids = frame_ids
        self.table, self.index, self.held, self.size = [], [], [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if self.held and self.size + len(ids) > self.frame_ids:
            self.flush()
        self.index.append((doc_id or 0, doc_id is None, len(self.table), self.size, len(ids)))
        self.held.append(ids.astype("<u4"))
        self.size += len(ids)

    def flush(self) -> None:
        if self.held:
            self._frame(np.concatenate(self.held).tobytes())
            self.held, self.size = [], 0

    def _frame(self, plain: bytes) -> None:
        packed = self.pack.compress(plain)
        self.out.write(packed)
        self.table.append((len(packed), len(plain),
                           xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))

    def close(self) -> None:
        self.flush()
        self._frame(np.array(self.index, INDEX).tobytes())
        body = b"".join(struct.pack("<III", *t) for t in self.table)
        body += struct.pack("<IBI", len(self.table), CHECKED, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)


class FrameReader:
    """Random access to the documents of one file."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE or not flags & CHECKED:
            raise ValueError("no seek table with checksums at the end of the file")
        source.seek(size - 9 - 12 * n)
        self.table = np.frombuffer(source.read(12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        self.unpack = zstandard.ZstdDecompressor()
        self.index = np.frombuffer(self.frame(n - 1), INDEX)
        self.at, self.ids = -1, np.empty(0, "<u4")

    def frame(self, i: int) -> bytes:
        packed, size, check = self.table[i].tolist()
        self.source.seek(int(self.starts[i]))
        plain = self.unpack.decompress(self.source.read(packed), max_output_size=max(1, size))
        if len(plain) != size or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {i} does not match its checksum")
        return plain

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document; its frame stays at hand for the next one."""
        row = self.index[i]
        if row["frame"] != self.at:
            self.at = int(row["frame"])
            self.ids = np.frombuffer(self.frame(self.at), "<u4")
        return self.ids[row["first"]:row["first"] + row["n"]]


_ENCODERS: dict = {}
KEPT_PIECES = 500_000
# The letters, numbers and white space below U+0250, and the pattern that splits a
# text before the merges, written with them.
LETTERS, NUMBERS, SPACES = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", r"\t-\r \xa0"
PIECES = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{LETTERS}]+| ?[{NUMBERS}]+"
                    rf"| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
# A character for every byte of a byte-level vocabulary: visible ones stand for themselves, the
# others for the next code points from 256.
VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LEVEL = {b: b for b in VISIBLE} | {
    b: 256 + i for i, b in enumerate(b for b in range(256) if b not in VISIBLE)}


class Encoder:
    """A vocabulary file whose words are encoded once while they are kept.

    Byte-level vocabularies never merge across the pieces their pattern splits a text into, so a
    text's ids are those of its pieces. Only texts below U+0250 without the control characters that
    regex libraries class differently, and without special tokens, are split here, and the library's
    model encodes each new piece; all other texts and all other kinds of vocabulary go to the
    library whole. `specials` false takes special tokens in a text as text.
    """

    def __init__(self, path: str, specials: bool = True):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = not specials
        self.model = self.library.model
        kind = json.loads(self.library.to_str())
        split = kind.get("pre_tokenizer") or {}
        self.byte_level = (kind.get("normalizer") is None and split.get("type") == "ByteLevel"
                           and not split.get("add_prefix_space") and split.get("use_regex", True))
        special = "|".join(re.escape(t["content"]) for t in kind.get("added_tokens", []))
        self.whole = re.compile("[\x1c-\x1f\x85\u0250-\U0010ffff]"
                                   + (f"|{special}" if special else ""))
        self.kept: dict[str, bytes] = {}

    def _encode(self, found: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes()
                for x in self.library.encode_batch_fast(found, add_special_tokens=False)]

    def _encode_piece(self, piece: str) -> bytes:
        plain = piece if piece.isascii() else piece.encode().decode("latin-1")
        return array("I", [t.id for t in self.model.tokenize(
            plain.translate(BYTE_LEVEL))]).tobytes()

    def encode(self, found: list[str]) -> list[np.ndarray]:
        """Ids of every text."""
        alone = [not self.byte_level or bool(self.whole.search(t)) for t in found]
        whole = iter(self._encode([t for t, x in zip(found, alone) if x]))
        split = [None if x else PIECES.findall(t) for t, x in zip(found, alone)]
        if len(self.kept) > KEPT_PIECES:
            self.kept.clear()
        new = list({w for row in split if row for w in row if w not in self.kept})
        self.kept.update(zip(new, map(self._encode_piece, new)))
        return [np.frombuffer(next(whole) if row is None
                              else b"".join(map(self.kept.__getitem__, row)), "<u4")
                for row in split]


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write_tokens(docs: DataFrame, folder: str, path: str, end_id: int = END_ID,
                 level: int = 3) -> DataFrame:
    """Writes files below `folder` (one every executor reaches); returns the stored manifest."""
    prepared(docs.sparkSession)
    schema = pa.schema([("file", pa.string()), ("first_id", pa.int64()),
                        ("first_hash", pa.int64()), ("n_docs", pa.int64()),
                        ("n_tokens", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, writer, name, first, total = encoder(path), None, "", None, 0
        for b in batches:
            ids_of = b.column("doc_id").to_pylist()
            if not ids_of:
                continue
            if writer is None:
                name = f"{folder}/{uuid.uuid4().hex}.ids.zst"
                system, place = _file_system(name)
                system.create_dir(place.rsplit("/", 1)[0], recursive=True)
                writer = FrameWriter(system.open_output_stream(place, compression=None), level)
                first = (ids_of[0], b.column("hash")[0].as_py())
            found = own.encode(b.column("text").to_pylist())
            for doc_id, one in zip(ids_of, found):
                ids = np.append(one, np.uint32(end_id))
                writer.add(doc_id, ids)
                total += len(ids)
        if writer is not None:
            writer.close()
            writer.out.close()
            yield batch({"file": [name], "first_id": [first[0]], "first_hash": [first[1]],
                         "n_docs": [len(writer.index)], "n_tokens": [total]}, schema)

    rows = texts(docs).withColumn("hash", F.xxhash64("text"))
    return stored(rows.repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash")
                  .mapInArrow(write, MANIFEST))


def read_tokens(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the files.

    The manifest has a row per file; the running sums over files are made on the driver.
    """
    files = sorted(manifest.collect(), key=lambda r: (
        r.first_id is not None, r.first_id or 0, r.first_hash))
    starts, total = [], 0
    for r in files:
        starts.append((r.file, total))
        total += r.n_tokens
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
                        ("ids_crc32", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, start in zip(b.column("file").to_pylist(), b.column("start").to_pylist()):
                system, place = _file_system(name)
                with system.open_input_file(place) as source:
                    reader = FrameReader(source)
                    index = reader.index
                    begins = start + np.concatenate([[0], np.cumsum(index["n"])[:-1]])
                    for low in range(0, len(index), 4096):
                        part = index[low:low + 4096]
                        yield batch({
                            "doc_id": pa.array(part["doc_id"], pa.int64(),
                                               mask=part["null"].astype(bool)),
                            "start": begins[low:low + 4096], "n_tokens": part["n"],
                            "ids_crc32": [zlib.crc32(reader.document(low + i).tobytes())
                                          for i in range(len(part))]}, schema)

    rows = spark.createDataFrame(starts, "file string, start long")
    return rows.repartition(max(1, len(starts)), "file").mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_output(docs: DataFrame, path: str | None = None, folder: str | None = None) -> DataFrame:
    """Writes docs as token files in a new folder and reads them back."""
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}"
    return read_tokens(spark, write_tokens(docs, folder, path or vocabulary()))
