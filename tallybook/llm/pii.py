"""PII: patterns, then information-theoretic sanitisation of terms that reveal what they found.

Protected entities are the values found by the four patterns (email, ip, card, phone). Most values
stand in one text only, so evidence is pooled: an entity is its value, its group (mail domain, first
three parts of an ip, first six digits of a card, phone without its last four digits), its kind, and
any entity at all. A term is a word of three or more characters of a text that holds an entity. From
the whole corpus come the numbers of documents that hold an entity of a pool, hold a term, and hold
both. The share of the pool's information that a term gives away is

    PMI(pool; term) / IC(pool) = log(p(pool | term) / p(pool)) / log(1 / p(pool)),
    p(pool) = n_pool / N,  p(pool | term) = (n_both + p(pool)) / (n_term + 1),

so a term counts as seen in one more document with the pool's own rate; for a value itself the plain
p(value | term) = n_both / n_term is taken. Terms with a share of
`disclosure` or more for a pool, seen with its entities in at least `support` different texts (copies
count once), are marked wherever they stand in a text that holds such an entity: as `term` spans, or
in `sanitised` by generalisation ([NAME], [NUMBER]) or removal.

Scale: one pass finds patterns and the distinct terms of texts with entities; only these few texts
are dealt out, and pools of fewer than `support` texts are left out before their terms are. Documents
per term are counted in a second pass by each task, for terms in a bit map of fixed size; places of
marked terms are sought in a third, in marked texts only.

Defined results: a null text is empty and has no spans; rows without doc_id are judged like others;
rows with equal id and text get equal rows; spans are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import (KEPT_WORDS, MAP_BITS, batch, bit_map, prepared, stored, texts,
                                  words)

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DIGIT = re.compile(r"[0-9]")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = bytes([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
SUPPORT, DISCLOSURE = 3, 0.8
SENT_ROWS = 200_000  # rows with marked terms (some 10 MB) sent to every executor at most


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`, in linear time.

    A run of local characters matches only if an @ ends it, so matches are sought from the @.
    """
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        else:
            last = at + 1
        at = text.find("@", last)
    return out


def luhn(digits: str) -> bool:
    doubled = (sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(doubled)) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The pattern matches of one text, by kind as listed, then start."""
    out = [("email", *s) for s in emails(text)]
    if not DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isascii() and c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


class Terms(dict):
    """Signed 64-bit codes of words without surrounding punctuation; 0 for what is no term."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        core = word.strip(EDGE)
        code = xxhash.xxh3_64_intdigest(core) if len(core) >= 3 else 0
        code = self[word] = code - ((code >> 63) << 64)
        return code


TERMS = Terms()


def pools(kind: str, value: str) -> list[int]:
    """Codes of the value (odd), its group, its kind and of any entity (even)."""
    value = value.lower()
    if kind == "ip":
        value = ".".join(p.lstrip("0") or "0" for p in value.split("."))
    elif kind != "email":
        value = "".join(c for c in value if c.isascii() and c.isdigit())
    group = {"email": value.partition("@")[2], "ip": value.rpartition(".")[0], "card": value[:6],
             "phone": value[:-4]}[kind]
    codes = (xxhash.xxh3_64_intdigest(x.encode()) & ~1 | own
             for x, own in ((f"{kind}:{value}", 1), (f"{kind}/{group}", 0), (kind, 0), ("", 0)))
    return [c - ((c >> 63) << 64) for c in codes]


def other_words(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[int, int, int]]:
    """(term, start, end) of the words that touch no span."""
    at = [m.span() for m in WORD.finditer(text)]
    starts = [s for s, _ in at]
    taken = {i for _, s, e in spans
             for i in range(max(0, int(np.searchsorted(starts, s, "right")) - 1),
                            int(np.searchsorted(starts, e, "left")))}
    found = ((TERMS[text[s:e].encode("utf-8", "surrogatepass").lower()], s, e)
             for i, (s, e) in enumerate(at) if i not in taken)
    return [x for x in found if x[0]]


def _key() -> Column:
    return F.xxhash64("doc_id", "text")


def scanned(docs: DataFrame) -> DataFrame:
    """Per row: its key, the code of its text, counts, base spans, pools and the terms beside them.

    `own` are pools of values and groups, `wide` those of kinds and of any entity.
    """
    lists = ("own", "wide", "terms")
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("copy", pa.int64()),
                        *((f"n_{k}", pa.int64()) for k in KINDS), ("base", pa.string()),
                        *((n, pa.list_(pa.int64())) for n in lists)])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(t, base_spans(t)) for t in b.column("text").to_pylist()]
            kinds = [Counter(k for k, *_ in s) for _, s in found]
            codes = [[pools(k, t[x:y]) for k, x, y in s] for t, s in found]
            yield batch({
                "doc_id": b.column("doc_id"), "key": b.column("key"), "copy": b.column("copy"),
                **{f"n_{k}": [c[k] for c in kinds] for k in KINDS},
                "base": [joined(s) for _, s in found],
                "own": [sorted({p for c in x for p in c[:2]}) for x in codes],
                "wide": [sorted({p for c in x for p in c[2:]}) for x in codes],
                "terms": [sorted({w for w, *_ in other_words(t, s)}) if s else []
                          for t, s in found]}, schema)

    return texts(docs).select("doc_id", _key().alias("key"), F.xxhash64("text").alias("copy"),
                              "text").mapInArrow(
        rows, "doc_id long, key long, copy long, n_email long, n_ip long, n_card long, "
              "n_phone long, base string, own array<long>, wide array<long>, terms array<long>")


def documents_with(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, n_term: rows of docs that hold each of the terms, and some other terms of the bit map."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(bit_map(terms.select(F.col("term").alias("hash"))))
    schema = pa.schema([("term", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, held, low = sent.value, Counter(), np.uint64((1 << MAP_BITS) - 1)
        wanted = bool(bits.any())
        for b in batches:
            for text in b.column("text").to_pylist() if wanted else ():
                kinds = set(words(text))
                codes = np.fromiter(map(TERMS.__getitem__, kinds), np.int64, len(kinds))
                slot = codes.view(np.uint64) & low
                on = (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1
                held.update(set(codes[on.astype(bool)].tolist()))
            if len(held) > 200_000:
                yield batch({"term": list(held), "n": list(held.values())}, schema)
                held.clear()
        yield batch({"term": list(held), "n": list(held.values())}, schema)

    return texts(docs).select("text").mapInArrow(count, "term long, n long") \
        .groupBy("term").agg(F.sum("n").alias("n_term"))


def revealed(docs: DataFrame, found: DataFrame, support: int = SUPPORT,
             disclosure: float = DISCLOSURE) -> DataFrame:
    """copy, marked: of each text the terms that give away the share `disclosure` of a pool of it."""
    held = stored(found.where(F.size("wide") > 0).groupBy("copy").agg(
        F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("own", "wide", "terms"))))
    own = held.select("copy", "n", F.explode("own").alias("pool"))
    wide = held.select("copy", "n", F.explode("wide").alias("pool"))
    sizes = stored(own.union(wide).groupBy("pool").agg(
        F.sum("n").alias("n_pool"), F.count("*").alias("n_texts")).where(F.col("n_texts") >= support))
    shared = stored(own.join(sizes.select("pool"), "pool", "left_semi").select("copy", "pool"))
    both = shared.join(held, "copy").select("copy", "n", "pool", F.explode("terms").alias("term")) \
        .union(held.select("copy", "n", F.explode("wide").alias("pool"), "terms")
               .select("copy", "n", "pool", F.explode("terms").alias("term")))
    pairs = stored(both.groupBy("pool", "term").agg(
        F.sum("n").alias("n_both"), F.count("*").alias("n_texts")).where(F.col("n_texts") >= support))
    terms = stored(pairs.select("term").distinct())
    rate = F.col("n_pool") / F.lit(float(max(1, found.count())))
    more = F.when(F.col("pool").bitwiseAND(1) == 0, 1).otherwise(0)
    given = (F.col("n_both") + more * rate) / (F.col("n_term") + more)
    telling = stored(pairs.join(documents_with(docs, terms), "term")
                     .join(sizes.select("pool", "n_pool"), "pool")
                     .where((rate < 1) & (F.log(given / rate) >= -disclosure * F.log(rate)))
                     .select("pool", "term"))
    few = telling.count() <= SENT_ROWS
    return both.join(F.broadcast(telling) if few else telling, ["pool", "term"]) \
        .groupBy("copy").agg(F.collect_set("term").alias("marked"))


def term_spans(docs: DataFrame, found: DataFrame, support: int = SUPPORT,
               disclosure: float = DISCLOSURE) -> DataFrame:
    """key, terms: the spans of all revealing terms of each row that has any."""
    marks = stored(revealed(docs, found, support, disclosure))
    few = marks.count() <= SENT_ROWS
    schema = pa.schema([("key", pa.int64()), ("terms", pa.list_(pa.struct(
        [("start", pa.int64()), ("end", pa.int64())])))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, marked in zip(b.column("text").to_pylist(), b.column("marked").to_pylist()):
                wanted = set(marked)
                out.append([{"start": s, "end": e} for w, s, e in other_words(text, base_spans(text))
                            if w in wanted])
            yield batch({"key": b.column("key"), "terms": out}, schema)

    held = texts(docs).select(_key().alias("key"), F.xxhash64("text").alias("copy"), "text") \
        .join(F.broadcast(marks) if few else marks, "copy")
    return held.select("key", "text", "marked").mapInArrow(
        rows, "key long, terms array<struct<start: long, end: long>>") \
        .groupBy("key").agg(F.first("terms").alias("terms"))


def private(docs: DataFrame, support: int = SUPPORT,
            disclosure: float = DISCLOSURE) -> DataFrame:
    """doc_id, n_<kind>, base_sha256, spans: a row for each row of docs; term spans come last."""
    prepared(docs.sparkSession)
    found = stored(scanned(docs))
    marked = F.transform("terms", lambda t: F.concat(
        F.lit("term:"), t["start"].cast("string"), F.lit(":"), t["end"].cast("string")))
    return found.drop("own", "wide", "terms", "copy").join(
        term_spans(docs, found, support, disclosure), "key", "left").select(
        "doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"),
        F.array_join(F.filter(F.concat(F.array("base"), F.coalesce(marked, F.array())),
                              lambda x: x != ""), ",").alias("spans"))


def replaced(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with its spans generalised or removed; overlapping spans become one."""
    out, last = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], x[2])):
        if s < last:
            last = max(last, e)
            continue
        word = text[s:e]
        label = LABELS.get(kind) or ("[NUMBER]" if DIGIT.search(word)
                                     else "[NAME]" if word[:1].isupper() else "")
        out += [text[last:s], label]
        last = e
    return "".join([*out, text[last:]])


def sanitised(docs: DataFrame, support: int = SUPPORT,
              disclosure: float = DISCLOSURE) -> DataFrame:
    """The rows of docs with spans replaced in `text` and n_chars, if any, renewed.

    A null text stays null. All other columns stay as they are.
    """
    prepared(docs.sparkSession)
    found = stored(scanned(docs))
    terms = stored(term_spans(docs, found, support, disclosure)
                   .withColumnRenamed("key", "_row").withColumnRenamed("terms", "_terms"))
    few = terms.count() <= SENT_ROWS

    @F.pandas_udf("string")
    def clean(text: pd.Series, terms: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else replaced(t, base_spans(t) + [
            ("term", x["start"], x["end"]) for x in (() if own is None else own)])
            for t, own in zip(text, terms)])

    key = F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")))
    out = docs.withColumn("_row", key).join(F.broadcast(terms) if few else terms, "_row", "left") \
        .withColumn("text", clean("text", "_terms"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(),
                                               F.length("text").cast("long")))
    return out.select(*docs.columns)
