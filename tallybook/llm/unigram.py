"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

A vocabulary file's pieces and scores are read once and laid out as a double array over UTF-8 bytes
(child of state s by byte b: base[s] + b, if check there is s), a few MB whatever the data. A text
starts with one space marker, spaces become markers, and the best sum of scores over its pieces
wins; equal sums go to the longest last piece. A character no piece covers costs ten less than the
worst piece and is written as its bytes. A marker character in the text itself is written as bytes
too, so that decoding gives back every text exactly.

No piece holds a marker behind another character, so a text falls into chunks (markers, then other
characters) whose best paths are independent. The distinct chunks of a batch run through the trie
together, position by position as arrays; chunks longer than `WIDE` bytes go one by one.

Defined results: a null or empty text has no ids and decodes to the empty text; rows without doc_id
and repeated rows are encoded like others; texts are encoded whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StructType

from tallybook.llm.common import KEPT_WORDS, prepared

MARKER = "▁"
MARK = MARKER.encode()
CHUNK = re.compile("▁*[^▁]*")
WIDE = 48
WORST_PENALTY = 10.0
NORMAL, CONTROL, UNKNOWN, USER, BYTE = 1, 3, 2, 4, 6  # kinds of pieces in the public file format


def read_pieces(path: str) -> list[tuple[bytes, float, int]]:
    """(piece, score, kind) of every id of a vocabulary file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i in range(model.get_piece_size()):
        kind = (UNKNOWN if model.is_unknown(i) else CONTROL if model.is_control(i)
                else BYTE if model.is_byte(i) else NORMAL)
        out.append((model.id_to_piece(i).encode(), model.get_score(i), kind))
    return out


class Trie:
    """A double array: state 1 is the root, value[s] the id of the piece that ends at s or -1."""

    def __init__(self, keys: list[tuple[bytes, int]]):
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for key, number in keys:
            node = 0
            for byte in key:
                if byte not in children[node]:
                    children[node][byte] = len(children)
                    children.append({})
                    ends.append(-1)
                node = children[node][byte]
            ends[node] = number
        size = 2 * len(children) + 1024
        base, check, value = (np.zeros(size, np.int64), np.full(size, -1, np.int64),
                              np.full(size, -1, np.int64))
        used = np.zeros(size, bool)
        used[:2] = True
        place, free, queue = {0: 1}, 2, [0]
        for node in queue:  # breadth first; grows while it is read
            state = place[node]
            value[state] = ends[node]
            own = np.array(sorted(children[node]), np.int64)
            if not len(own):
                continue
            while True:  # the first place whose slots for all children are free, by windows
                if free + 4096 + 600 >= len(used):
                    more = len(used)
                    base, value = np.append(base, np.zeros(more, np.int64)), np.append(
                        value, np.full(more, -1, np.int64))
                    check = np.append(check, np.full(more, -1, np.int64))
                    used = np.append(used, np.zeros(more, bool))
                low = max(free, 2 + int(own[0]))
                starts = low + np.flatnonzero(~used[low:low + 4096]) - int(own[0])
                fits = starts[~used[starts[:, None] + own].any(axis=1)]
                if len(fits):
                    at = int(fits[0])
                    break
                free += 4096
            base[state] = at
            used[at + own] = True
            check[at + own] = state
            for byte in own.tolist():
                child = children[node][byte]
                place[child] = at + byte
                queue.append(child)
        last = int(np.flatnonzero(used)[-1]) + 257
        self.base, self.check, self.value = (np.resize(x, last).astype(np.int32)
                                             if len(x) >= last else x.astype(np.int32)
                                             for x in (base, check, value))


class Unigram:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, pieces: list[tuple[bytes, float, int]]):
        usable = [(p, i) for i, (p, _, k) in enumerate(pieces) if k in (NORMAL, USER)]
        if any(MARK in p.lstrip(MARK) for p, _ in usable):
            raise ValueError("a piece holds a space marker behind another character")
        self.trie = Trie(usable)
        self.longest = max(len(p) for p, _ in usable)
        self.score = np.array([s for _, s, _ in pieces], np.float64)
        worst = min(self.score[i] for _, i in usable)
        self.unknown = float(worst - WORST_PENALTY)
        self.byte = np.full(256, -1, np.int32)
        for i, (p, _, k) in enumerate(pieces):
            if k == BYTE:
                self.byte[int(p[3:5], 16)] = i
        if (self.byte < 0).any():
            raise ValueError("byte fallback needs all 256 byte pieces")
        self.kept: dict[str, np.ndarray] = {}  # ids of chunks seen before
        # what an id decodes to: bytes for byte pieces, spaces for markers, nothing for controls
        self.plain = [bytes([int(p[3:5], 16)]) if k == BYTE
                      else p.replace(MARK, b" ") if k in (NORMAL, USER) else b""
                      for p, _, k in pieces]

    def encode_batch(self, chunks: list[bytes]) -> list[np.ndarray]:
        """Ids of every chunk."""
        out: list = [None] * len(chunks)
        short = [i for i, c in enumerate(chunks) if len(c) <= WIDE]
        for i, c in enumerate(chunks):
            if len(c) > WIDE:
                out[i] = self._one(c)
        short.sort(key=lambda i: len(chunks[i]))
        for part in (short[k:k + 8192] for k in range(0, len(short), 8192)):
            for i, ids in zip(part, self._many([chunks[i] for i in part])):
                out[i] = ids
        return out

    def _many(self, chunks: list[bytes]) -> list[np.ndarray]:
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        n, width = len(chunks), max(map(len, chunks))
        sizes = np.array([len(c) for c in chunks])
        text = np.frombuffer(b"".join(c.ljust(width, b"\0") for c in chunks), np.uint8) \
            .reshape(n, width).astype(np.int32)
        best = np.full((width + 1, n), -np.inf)
        best[0] = 0.0
        came = np.zeros((width + 1, n), np.int32)
        piece = np.full((width + 1, n), -1, np.int32)
        lead = (text & 0xC0) != 0x80
        for s in range(width):
            rows = np.flatnonzero((s < sizes) & lead[:, s] & (best[s] > -np.inf))
            if not len(rows):
                continue
            wide = np.where(text[rows, s] < 0x80, 1, np.where(
                text[rows, s] < 0xE0, 2, np.where(text[rows, s] < 0xF0, 3, 4)))
            single = np.zeros(n, bool)  # some piece is just this character
            width_of = np.zeros(n, np.int64)
            width_of[rows] = wide
            state, on = np.ones(len(rows), np.int32), rows
            for k in range(1, min(self.longest, width - s) + 1):
                step = base[state] + text[on, s + k - 1]
                fits = (check[step] == state) & (base[state] > 0) & (s + k <= sizes[on])
                state, on = step[fits], on[fits]
                if not len(on):
                    break
                ends = value[state] >= 0
                if ends.any():
                    who, what = on[ends], value[state][ends]
                    single[who[width_of[who] == k]] = True
                    total = best[s, who] + self.score[what]
                    better = total > best[s + k, who]
                    who, what = who[better], what[better]
                    best[s + k, who], came[s + k, who] = total[better], s
                    piece[s + k, who] = what
            for r, w in zip(rows[~single[rows]], wide[~single[rows]]):
                total = best[s, r] + self.unknown
                if total > best[s + w, r]:
                    best[s + w, r], came[s + w, r], piece[s + w, r] = total, s, -1
        return self._paths(chunks, came, piece, sizes)

    def _paths(self, chunks, came, piece, sizes) -> list[np.ndarray]:
        """Walks all best paths back together."""
        at, on = sizes.copy(), np.flatnonzero(sizes > 0)
        steps: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        while len(on):
            start = came[at[on], on]
            steps.append((on, piece[at[on], on], start, at[on].copy()))
            at[on] = start
            on = on[start > 0]
        if not steps:
            return [np.empty(0, np.int32) for _ in chunks]
        who = np.concatenate([s[0] for s in steps[::-1]])
        ids = np.concatenate([s[1] for s in steps[::-1]])
        order = np.argsort(who, kind="stable")
        out = np.split(ids[order], np.cumsum(np.bincount(who, minlength=len(chunks)))[:-1])
        if (ids < 0).any():
            starts = np.concatenate([s[2] for s in steps[::-1]])[order]
            ends = np.concatenate([s[3] for s in steps[::-1]])[order]
            spans = np.split(np.stack([starts, ends], 1),
                             np.cumsum(np.bincount(who, minlength=len(chunks)))[:-1])
            for i in np.unique(who[ids < 0]):
                out[i] = self._spelt(chunks[i], out[i], spans[i])
        return out

    def _spelt(self, chunk: bytes, ids, spans) -> np.ndarray:
        """Unknown characters (id -1) as byte pieces."""
        parts = [[i] if i >= 0 else self.byte[list(chunk[s:e])] for i, (s, e) in zip(ids, spans)]
        return np.concatenate(parts).astype(np.int32)

    def _one(self, chunk: bytes) -> np.ndarray:
        """One long chunk, position by position."""
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        n = len(chunk)
        best, came, piece = [-np.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for s in range(n):
            if best[s] == -np.inf or chunk[s] & 0xC0 == 0x80:
                continue
            w = 1 if chunk[s] < 0x80 else 2 if chunk[s] < 0xE0 else 3 if chunk[s] < 0xF0 else 4
            state, single = 1, False
            for k in range(1, min(self.longest, n - s) + 1):
                step = int(base[state]) + chunk[s + k - 1]
                if base[state] <= 0 or check[step] != state:
                    break
                state, what = step, int(value[step])
                if what >= 0:
                    single |= k == w
                    total = best[s] + float(self.score[what])
                    if total > best[s + k]:
                        best[s + k], came[s + k], piece[s + k] = total, s, what
            if not single and best[s] + self.unknown > best[s + w]:
                best[s + w], came[s + w], piece[s + w] = best[s] + self.unknown, s, -1
        spans, at = [], n
        while at:
            spans.append((came[at], at, piece[at]))
            at = came[at]
        spans.reverse()
        return self._spelt(chunk, [p for *_, p in spans], [(s, e) for s, e, _ in spans])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text."""
        known: dict[str, int] = {}
        rows = []
        for text in texts:
            rows.append([known.setdefault(c, len(known)) for c in chunks_of(text)])
        new = [c for c in known if c not in self.kept]
        made = dict(zip(new, self.encode_batch([c.encode("utf-8") for c in new])))
        if LITERAL in made:
            made[LITERAL] = self.byte[list(MARK)]
        ids = [made[c] if c in made else self.kept[c] for c in known]
        if len(self.kept) + len(made) > KEPT_WORDS:
            self.kept.clear()
        self.kept.update((c, x) for c, x in made.items() if len(c) <= WIDE)
        sizes = np.array([len(x) for x in ids], np.int64)
        flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else sizes
        out = []
        for row in rows:
            row = np.array(row, np.int64)
            n = sizes[row]
            ends = np.cumsum(n)
            take = np.repeat(first[row] - (ends - n), n) + np.arange(ends[-1] if len(n) else 0)
            out.append(flat[take])
        return out

    def decode(self, ids) -> str:
        """The text of ids: pieces joined, markers as spaces, without the first one."""
        raw = b"".join(map(self.plain.__getitem__, ids))
        return raw[1:].decode("utf-8", "replace") if raw[:1] == b" " else raw.decode(
            "utf-8", "replace")


LITERAL = "literal" + MARKER  # no chunk holds a marker behind another character


def chunks_of(text: str) -> list[str]:
    """Chunks of a text with its leading marker; LITERAL stands for a marker in the text."""
    if not text:
        return []
    if MARKER not in text:
        return CHUNK.findall((MARKER + text).replace(" ", MARKER))[:-1]
    out = []
    for k, part in enumerate(text.split(MARKER)):
        out += [LITERAL] * (k > 0)
        part = part.replace(" ", MARKER)
        out += [c for c in CHUNK.findall(MARKER + part if k == 0 else part) if c]
    return out


def vocabulary(path: str | None = None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return path


def encoded(docs: DataFrame, path: str | None = None, column: str = "text") -> DataFrame:
    """The rows of docs with `ids`, `n_tokens`, `n_bytes` (byte pieces) and `exact`.

    exact says that the ids decode to the text. Columns of docs with these names are replaced.
    """
    spark = prepared(docs.sparkSession)
    model = spark.sparkContext.broadcast(Unigram(read_pieces(vocabulary(path))))
    added = ["ids", "n_tokens", "n_bytes", "exact"]
    kept = docs.drop(*added)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unigram = model.value
        is_byte = np.zeros(len(unigram.score), bool)
        is_byte[unigram.byte] = True
        for b in batches:
            texts = [t or "" for t in b.column(column).to_pylist()]
            ids = unigram.encode(texts)
            sizes = np.array([len(x) for x in ids], np.int64)
            flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)),
                pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, lists, pa.array(sizes),
                 pa.array([int(is_byte[x].sum()) for x in ids], pa.int64()),
                 pa.array([unigram.decode(x.tolist()) == t for x, t in zip(ids, texts)])],
                names=[*b.schema.names, *added])

    schema = StructType(list(kept.schema.fields)).add("ids", ArrayType(IntegerType())).add("n_tokens", "long") \
        .add("n_bytes", "long").add("exact", "boolean")
    return kept.mapInArrow(rows, schema)
