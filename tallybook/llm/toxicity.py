"""Toxicity: a counterfactually regularised logistic classifier over word and word-stem marks.

Features of a text are its distinct words (letters, in lower case) and their first 4, 5 and 6
letters. Document counts of every feature are taken over all labelled training rows; features that
are in at least `min_docs` of them are ranked by the chi-square of label and presence, and the
`features` best are the model's. The weights minimise logistic loss, a ridge term and
`counterfactual` times the squared change of the logit under swaps of identity terms: for each
labelled sentence with identity terms, the terms are exchanged for those of other groups and the
change is penalised, so a neutral mention of a group cannot raise the score. A labelled text without
identity terms gives one pair too: one of its sentences gets a term and, for comparison, another
term of the same group; text and terms are matched by a hash, so all terms take part. The terms are
an argument, also as a table (group, term).

Defined results: a null or empty text has no features and is scored by the bias; ties in the feature
ranking go to the smaller feature; labels other than 0 and 1, and labelled ids without a document,
are not learned from; of conflicting labels of one id the greater counts; repeated rows of a labelled
id all count; with no training rows the score is 0.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import KEPT_WORDS, batch, fold, prepared, stored

WORD = re.compile(r"[^\W\d_]+")
STEMS = (4, 5, 6)
# Groups of identity terms that may stand for each other in a sentence.
IDENTITY = (
    ("women", "men", "girls", "boys", "woman", "man"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "refugees", "foreigners", "locals", "citizens"),
)
SAMPLE = 20_000  # labelled rows the weights are fitted on at most; counts are over all rows
FEATURES = 2_000
LABEL_BYTES = 64 << 20  # packed labels up to this size are sent to the tasks that read the texts


class Marks(dict):
    """The marks of one white-space token: its words and their stems, those in `only` if given."""

    def __init__(self, only: dict | None = None):
        super().__init__()
        self.only = only

    def __missing__(self, token: str) -> tuple:
        if len(self) >= KEPT_WORDS:
            self.clear()
        word = token.lower()
        found = [word] if word.isalpha() else WORD.findall(word)
        out = [*found, *(w[:n] + "*" for w in found for n in STEMS if len(w) >= n)]
        out = tuple(out if self.only is None else [f for f in out if f in self.only])
        self[token] = out
        return out

    def of(self, text: str | None) -> set[str]:
        """Distinct marks of one text."""
        return set().union(*map(self.__getitem__, set((text or "").split())))


def swapped(text: str, groups=IDENTITY) -> list[str]:
    """The text with its identity terms exchanged, once for each other place in their groups."""
    place = {t: (g, i) for g in groups for i, t in enumerate(g)}
    if place.keys().isdisjoint(WORD.findall(text.lower())):
        return []
    steps = range(1, max(map(len, groups)))

    def moved(step: int) -> str:
        def other(m: re.Match) -> str:
            at = place.get(m[0].lower())
            return at[0][(at[1] + step) % len(at[0])] if at else m[0]
        return WORD.sub(other, text)

    return sorted({moved(s) for s in steps} - {text})


def groups_from(terms: DataFrame, limit: int = 10_000) -> tuple[tuple[str, ...], ...]:
    """Groups of interchangeable terms from a table (group, term); single words, in lower case.

    A term of several groups belongs to the smallest; the table may hold `limit` terms at most.
    """
    found = terms.where(F.col("group").isNotNull() & F.col("term").isNotNull()) \
        .groupBy(F.lower(F.trim("term")).alias("term")).agg(F.min("group").alias("group")) \
        .limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"more than {limit} identity terms")
    held: dict = {}
    for r in sorted(found, key=lambda r: (r.group, r.term)):
        if WORD.fullmatch(r.term):
            held.setdefault(r.group, []).append(r.term)
    return tuple(tuple(g) for g in held.values() if len(g) > 1)


def placed(text: str, groups=IDENTITY) -> tuple[str, str, str] | None:
    """A sentence of the text and two terms of one group for the same place in it, or None."""
    sentences = [x for x in re.split(r"[.!?\n]+", text) if WORD.search(x)]
    if not sentences or not groups:
        return None
    at = zlib.crc32(text.encode("utf-8", "surrogatepass"))
    at, sentence = divmod(at, len(sentences))
    at, group = divmod(at, len(groups))
    terms = groups[group]
    at, first = divmod(at, len(terms))
    return sentences[sentence], terms[first], terms[(first + 1 + at % (len(terms) - 1)) % len(terms)]


def feature_counts(rows: DataFrame) -> DataFrame:
    """feature, n_pos, n_all over all rows (text, label), counted per task before the shuffle."""
    schema = pa.schema([("feature", pa.string()), ("n_pos", pa.int64()), ("n_all", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, held = Marks(), (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            names = list(held[0] | held[1])
            out = batch({"feature": names, "n_pos": [held[1][f] for f in names],
                         "n_all": [held[0][f] + held[1][f] for f in names]}, schema)
            held[0].clear()
            held[1].clear()
            return out

        for b in batches:
            for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist()):
                held[label].update(marks.of(text))
            if len(held[0]) + len(held[1]) > 200_000:
                yield flush()
        yield flush()

    return rows.select("text", "label").mapInArrow(
        count, "feature string, n_pos long, n_all long").groupBy("feature").agg(
        F.sum("n_pos").alias("n_pos"), F.sum("n_all").alias("n_all"))


def best_features(rows: DataFrame, features: int = FEATURES, min_docs: int = 3) -> list[str]:
    n, pos = rows.agg(F.count("*"), F.sum("label")).first()
    if not n or not pos or pos == n:
        return []
    expected = F.col("n_all") * F.lit(pos / n)
    chi = F.pow(F.col("n_pos") - expected, 2) / (expected * F.lit(1 - pos / n)) \
        * F.lit(float(n)) / (F.lit(float(n)) - F.col("n_all") + F.lit(1.0))
    ranked = feature_counts(rows).where(F.col("n_all") >= min_docs) \
        .orderBy(chi.desc(), "feature").limit(features)
    return sorted(r.feature for r in ranked.select("feature").collect())


def fitted(ones: tuple[np.ndarray, np.ndarray], labels: np.ndarray, n_features: int,
           pairs: tuple[np.ndarray, np.ndarray, np.ndarray, int], counterfactual: float,
           ridge: float = 1e-4, steps: int = 250, rate: float = 0.5) -> np.ndarray:
    """Weights with the bias last, by Adam over all rows.

    pairs: (pair, feature, sign) of the difference between a swapped and a plain sentence, and the
    number of pairs.
    """
    row, col = ones
    n = len(labels)
    w, m, v = np.zeros(n_features + 1), np.zeros(n_features + 1), np.zeros(n_features + 1)
    pair, at, sign, n_pairs = pairs
    for step in range(1, steps + 1):
        z = np.bincount(row, w[col], n) + w[-1]
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels
        grad = np.append(np.bincount(col, error[row], n_features), error.sum()) / n
        grad[:-1] += ridge * w[:-1]
        if n_pairs:
            change = np.bincount(pair, sign * w[at], n_pairs)
            grad[:-1] += 2 * counterfactual / n_pairs * np.bincount(
                at, sign * change[pair], n_features)
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        w -= rate * 0.995 ** step * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-9)
    return w


def train(rows: DataFrame, counterfactual: float = 5.0, features: int = FEATURES,
          sample: int = SAMPLE, groups=IDENTITY) -> dict[str, float]:
    """Weights by feature from rows (doc_id, text, label); the bias is at the empty string.

    The feature marks of at most `sample` rows, chosen by a hash of their ids (any rows where the
    hash chooses none), and the differences of their swapped sentences come to the driver; texts do
    not.
    """
    names = best_features(rows, features)
    identity = Marks().of(" ".join(t for g in groups for t in g))
    place = {f: i for i, f in enumerate([*names, *sorted(identity - set(names))])}
    schema = pa.schema([("label", pa.int32()), ("ones", pa.list_(pa.int32())),
                        ("plus", pa.list_(pa.list_(pa.int32()))),
                        ("minus", pa.list_(pa.list_(pa.int32())))])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Marks(place)

        def on(text: str | None) -> set[int]:
            return {place[f] for f in marks.of(text)}

        for b in batches:
            out: dict = {"label": b.column("label"), "ones": [], "plus": [], "minus": []}
            for text in b.column("text").to_pylist():
                sentences = [] if identity.isdisjoint(marks.of(text)) \
                    else re.split(r"[.!?\n]+", text)
                changes = [(on(s), on(x)) for x in sentences for s in swapped(x, groups)]
                if not changes and (slot := placed(text or "", groups)):
                    changes = [(on(f"{slot[1]} {slot[0]}"), on(f"{slot[2]} {slot[0]}"))]
                out["ones"].append(sorted(on(text)))
                out["plus"].append([sorted(a - b) for a, b in changes])
                out["minus"].append([sorted(b - a) for a, b in changes])
            yield batch(out, schema)

    n = rows.count()
    if not n:
        return {"": -30.0}
    share = min(1.0, 0.95 * sample / n) if n > sample else 1.0  # chosen by a hash of the id
    chosen = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(share * 1e6))
    if chosen.isEmpty():
        chosen = rows
    got = chosen.select("text", "label").mapInArrow(
        encoded, "label int, ones array<int>, plus array<array<int>>, minus array<array<int>>"
    ).limit(sample).toPandas()
    labels = got["label"].to_numpy(dtype=float)
    row = np.repeat(np.arange(len(got)), [len(x) for x in got["ones"]])
    col = np.concatenate([np.asarray(x, np.int64) for x in got["ones"]])
    swaps = [(p, m) for ps, ms in zip(got["plus"], got["minus"]) for p, m in zip(ps, ms)]
    pair = np.array([i for i, (p, m) in enumerate(swaps) for _ in [*p, *m]], dtype=np.int64)
    at = np.array([f for p, m in swaps for f in [*p, *m]], dtype=np.int64)
    sign = np.array([s for p, m in swaps for s in [1.0] * len(p) + [-1.0] * len(m)])
    w = fitted((row, col), labels, len(place), (pair, at, sign, len(swaps)), counterfactual)
    return {**{f: float(w[i]) for f, i in place.items()}, "": float(w[-1])}


def scorer(weights: dict[str, float]):
    """A Column function: the probability of label 1 of a text column."""
    held = {f: w for f, w in weights.items() if f}
    bias = weights[""]

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        marks = Marks(held)
        for text in batches:
            z = np.array([bias + sum(held[f] for f in sorted(marks.of(t))) for t in text])
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return score


def packed_labels(known: DataFrame) -> DataFrame:
    """block, marks: the labels of up to 512 ids as sorted codes 2 * (id in the block) + label."""
    code = (F.col("doc_id").bitwiseAND(F.lit(511)) * 2 + F.col("label")).cast("short")
    return known.groupBy(F.shiftright("doc_id", 9).alias("block")).agg(
        F.sort_array(F.collect_list(code)).alias("marks"))


def labelled(docs: DataFrame, labels: DataFrame, column: str,
             label_bytes: int = LABEL_BYTES) -> DataFrame:
    """Training rows (doc_id, text, label): crc32 of the id modulo 5 is not 0, label 0 or 1.

    Of conflicting labels of one id the greater counts. The texts stay where they are read while
    the packed labels, some two bytes each, are at most `label_bytes`; beyond that both are joined by
    id. The rows are the same.
    """
    known = stored(labels.select(F.col("doc_id").cast("long").alias("doc_id"),
                                 F.col(column).cast("int").alias("label"))
                   .where(F.col("label").isin(0, 1) & (fold(F.col("doc_id"), 5) != 0))
                   .groupBy("doc_id").agg(F.max("label").alias("label")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    packed = stored(packed_labels(known))
    size = packed.agg(F.sum(F.size("marks") * 2 + 64)).first()[0] or 0
    if size > label_bytes:
        return rows.join(known, "doc_id")
    code = (F.col("doc_id").bitwiseAND(F.lit(511)) * 2).cast("short")
    mark = F.when(F.array_contains("marks", (code + 1).cast("short")), 1) \
        .when(F.array_contains("marks", code), 0)
    return rows.withColumn("block", F.shiftright("doc_id", 9)) \
        .join(F.broadcast(packed), "block") \
        .select("doc_id", "text", mark.alias("label")).where(F.col("label").isNotNull())


def toxicity_model(docs: DataFrame, labels: DataFrame, groups=IDENTITY) -> dict[str, float]:
    """Weights from the labelled documents; `groups` also as a table (group, term)."""
    prepared(docs.sparkSession)
    if isinstance(groups, DataFrame):
        groups = groups_from(groups)
    return train(labelled(docs, labels, "toxic"), groups=groups)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5,
             groups=IDENTITY) -> DataFrame:
    """doc_id, held_out, score, predicted: a row for each row of docs.

    A row without doc_id is scored and not held out.
    """
    score = scorer(toxicity_model(docs, labels, groups))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), score(_text()).alias("score")) \
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))
