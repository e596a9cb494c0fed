"""The Voronoi join, spelling variants and token alignment against brute force; awkward rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tallybook.llm import alignment, variants, voronoi

VECTORS = "vec_id long, embedding array<double>, score double, cell int"


def _clipped(x: int) -> int:
    return max(-2 ** 63, min(2 ** 63 - 1, x))


def _products(rows, k, every):
    """(query_id, rank, vec_id, score) by all pairs of rows of five components."""
    held: dict[int, set] = {}
    for i, v in rows:
        if i is not None and v and len(v) == 5 and all(
                x is not None and math.isfinite(x) for x in v):
            held.setdefault(i, set()).add(tuple(_clipped(math.floor(x * 1024)) for x in v))
    out = []
    for q, own in held.items():
        for v in own if q % every == 0 else ():
            best = sorted((-_clipped(max(sum(map(lambda a, b: a * b, v, x)) for x in xs)), i)
                          for i, xs in held.items() if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def _vectors():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(6, 5)) * 3
    rows = [(i, [float(x) for x in centres[i % 6] + rng.normal(size=5) * 0.1])
            for i in range(900)]
    rows += [(i, [1.0, 2.0, -1.0, 0.5, 0.25]) for i in range(1000, 1400)]  # one hot vector
    return rows + [
        (0, [0.0] * 5), (5, None), (10, []), (15, [math.nan] * 5), (20, [1.0] * 4),
        (None, [1.0] * 5), (25, [None, 1.0, 1.0, 1.0, 1.0]), (30, [math.inf] * 5),
        (1000, [1.0, 2.0, -1.0, 0.5, 0.25]), (1010, [5.0] * 5)]


def _check(spark, rows, **settings):
    df = spark.createDataFrame([(*r, 0.5, 1) for r in rows], VECTORS)
    found = voronoi.top_products(df, 10, 10, 8, **settings).collect()
    assert sorted(map(tuple, found)) == _products(rows, 10, 10)


def test_products_of_clusters_ties_repeats_and_unusable_rows(spark):
    _check(spark, _vectors(), least_block=64)


def test_products_with_many_groups_of_queries(spark):
    _check(spark, _vectors(), group=7)


def test_products_beyond_doubles_and_longs(spark):
    rows = [(i, [1e300 * (-1) ** i, 3e14, 1.0, 0.0, i / 7]) for i in range(40)]
    _check(spark, rows + _vectors()[:100])


def test_products_of_few_and_no_rows(spark):
    _check(spark, [(10, [1.0] * 5), (11, [2.0] * 5)])
    _check(spark, [(10, [1.0] * 5)])
    _check(spark, [])


def test_bounds_rule_rows_out():
    """Rows far from a query cell are not sent there, rows that can count are."""
    pivots = voronoi.Pivots(np.array([[1000, 0], [-1000, 0]]))
    x = np.array([[990, 5], [-990, 5]])
    cell, far = pivots.filed(x)
    most = pivots.most(x, cell, far, np.array([10.0, 10.0]))
    assert cell.tolist() == [0, 1]
    assert (most >= x @ pivots.points.T.astype(int)).all()
    assert most[1, 0] < 0 < most[0, 0]


DOCS = "doc_id long, text string, n long, word string, block string"


def _variants(rows):
    """All words against all words."""
    counts: Counter = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = "".join(c.lower() if c < "a" else c for c in run)
            code = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if code % 97 == 0:
                run = run[:code % len(run)] + run[code % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= 3 and len(w) >= 5}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    forms, sizes = {}, {}
    for w, n in words.items():
        others = sorted((-m, x) for x, m in words.items() if near(w, x))
        sizes[w] = len(others)
        if others and -others[0][0] >= 2 * n:
            forms[w] = others[0][1]

    def root(w):
        return root(forms[w]) if w in forms else w

    return sorted((w, forms.get(w) or "", root(w), n, sizes[w], words.get(forms.get(w)) or 0)
                  for w, n in words.items())


def _made_words():
    rng = random.Random(3)
    letters = "abcx\u00e9\u00d7"
    pool = ["".join(rng.choices(letters, k=rng.randint(4, 7))) for _ in range(150)]
    pool += ["a" * n for n in range(4, 8)] + ["stone", "stones", "Stone", "shone", "stne"]
    pool += ["river" * 4000, "river" * 4000 + "s", "x" + "river" * 4000]
    rows = []
    for i in range(300):
        size = rng.randint(0, 60)
        rows.append((i, " ".join(rng.choices(pool, [1 / (j + 1) for j in range(len(pool))],
                                             k=size))))
    rows += [(1000 + i, "stones " * 9 + "stoner " * 4 + "stoker " * 2) for i in range(3)]
    return rows + [(None, "stone stone stone"), (5, None), (6, ""), (7, "stone, shone!")] * 2


def test_spelling_variants_equal_all_pairs(spark):
    rows = _made_words()
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], DOCS)
    found = variants.spelling_variants(df).collect()
    assert sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0)
                  for r in found) == _variants(rows)
    assert any(r.form for r in found) and any(r.root not in (r.word, r.form) for r in found)


def test_tries_hold_only_prefixes_that_a_neighbour_can_meet(spark):
    """From the middle of a word a letter shorter, and short prefixes of both sides stay apart."""
    pool = ["streth", "theres", "sereht", "rerest", "nteres", "nierer", "streets", "cr\u00e9mes"]
    words = spark.createDataFrame([(w,) for w in pool], "word string")
    rows = variants.prefixes(words).collect()
    assert len(rows) == sum(2 * len(w) + 2 - (len(w) - 1) // 2 - len(w) // 2 for w in pool)
    meant = {}
    for r in rows:
        meant.setdefault(bytes(r.node), set()).add((r.side, r.s[:r.pos]))
    assert all(len(m) == 1 for m in meant.values())
    assert variants.neighbours(words).collect() == []
    assert dict(variants.runs(1, "Caf\u00c9s CAFES caf\u00c9s abcd caf\u00e9s".encode())) == {
        "caf\u00c9s".encode(): 2, b"cafes": 1, "caf\u00e9s".encode(): 1}


def test_spelling_variants_of_no_rows(spark):
    assert variants.spelling_variants(spark.createDataFrame([], DOCS)).collect() == []


ODD = ["a", "word", "  ", " ", "\n", "\t", "\x85", "\xa0", "'s", "1", "\u00e9", "\u65e5\u672c",
       "\U0001f600", "<|endoftext|>", ".", "\u200b", "\x00", "\u2581", "<s>", "<0x41>", "\ufb01",
       "a" * 24]


@pytest.fixture(scope="module")
def vocabulary_pair():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    path_a, path_b = alignment.vocabularies()
    a = Tokenizer.from_file(path_a)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=path_b)


def _alignments(rows, a, b):
    """Groups by the set of common ends, links one by one."""
    token_a = {i: bytes(alignment.BYTE_OF[c] for c in t) for t, i in a.get_vocab().items()
               if all(c in alignment.BYTE_OF for c in t)}

    def token_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace(
            "\u2581", " ").encode()

    split, counts = [], Counter()
    for doc_id, text in rows:
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        spelt = [[token_a[i] for i in x], [token_b(i) for i in y]]
        if any(b"".join(s) != b" " + (text or "").encode() for s in spelt):
            x, y, spelt = [], [], [[], []]
        ends = [np.cumsum([len(t) for t in s]).tolist() for s in spelt]
        groups = [([i for i, e in zip(x, ends[0]) if low < e <= high],
                   [i for i, e in zip(y, ends[1]) if low < e <= high])
                  for common in [sorted({0, *set(ends[0]) & set(ends[1])})]
                  for low, high in zip(common, common[1:])]
        links = [(i, j) for g in groups for i in g[0] for j in g[1]]
        counts.update(set(links))
        split.append((doc_id, x, y, groups, links))
    most: dict = {}
    for (i, _), n in counts.items():
        most[i] = max(n, most.get(i, 0))
    return Counter(
        (doc_id, len(x), len(y), len(groups), len(links),
         sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links),
         hashlib.sha256(";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}"
                                 for g, h in groups).encode()).hexdigest() if x else "")
        for doc_id, x, y, groups, links in split)


def _found(spark, rows, **settings):
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], DOCS)
    return Counter(tuple(r) for r in alignment.alignment(df, **settings).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
        "groups_sha256").collect())


def test_alignment_of_odd_texts_over_many_blocks(spark, vocabulary_pair):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choices(ODD, k=rng.randint(0, 30)))) for i in range(1500)]
    rows += [(None, None), (None, "x"), (1, ""), (1, "x y"), (1, "x y"),
             ((1 << 62) + 1, "river stone " * 3000)]
    assert _found(spark, rows, block_size=10_000) == _alignments(rows, *vocabulary_pair)


def test_alignment_of_the_table_and_of_no_rows(spark, vocabulary_pair):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
    assert _found(spark, rows) == _alignments(rows, *vocabulary_pair)
    assert not _found(spark, [])


def test_common_ends_equal_sets():
    rng = np.random.default_rng(5)
    for n, m in ((0, 5), (1, 1), (3, 500), (400, 7), (300, 300)):
        a, b = (np.cumsum(rng.integers(1, 9, k)) for k in (n, m))
        at_a, at_b = alignment.common_ends(a, b)
        assert a[at_a].tolist() == sorted(set(a.tolist()) & set(b.tolist())) == b[at_b].tolist()


def test_a_long_group_is_linked_by_its_different_ids():
    own = alignment.aligner(*alignment.vocabularies())
    ids = np.array([1, 2, 1] * 500)
    found = own._pairs(ids, ids, np.array([0]), np.array([0]), np.array([1500]), np.array([1500]))
    width = len(own.b.bytes)
    assert dict(zip(found[0].tolist(), found[1].tolist())) == {
        x * width + y: nx * ny for x, nx in ((1, 1000), (2, 500)) for y, ny in ((1, 1000), (2, 500))}
