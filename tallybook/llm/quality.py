"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class gets the mean and covariance of the statistics of all its labelled training rows, summed
by Spark. A covariance is shrunk towards the pooled one by `shrink`, then towards its mean variance
by `ridge`. The score is the logistic of the difference of the two classes' Gaussian
log-densities (squared Mahalanobis distances by Cholesky factors that are computed once) and log
priors. Label, language, source and id are no inputs.

Defined results: a null or empty text has the statistics of an empty text and is scored like any
other; with fewer than two training rows in a class the score is that class balance's (0.5 without
rows at all). Texts are read whole; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import batch, fold, prepared, stored

CLASSES = {  # bytes counted together
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58),
    "space": (32, 9, 11, 12, 13), "line": (10,), "stop": b".!?", "comma": b",;:",
    "pipe": b"|", "wide": range(128, 256)}
STATISTICS = 17


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one text: sizes, shares of byte classes, repetition."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = max(1, len(raw))
    part = {k: float(counts[list(v)].sum()) for k, v in CLASSES.items()}
    other = len(raw) - sum(part.values())
    words = raw.split()
    n_words = max(1, len(words))
    kinds = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n_lines = max(1, len(lines))
    letters = max(1.0, part["upper"] + part["lower"] + part["wide"])

    def share(x: float, of: float) -> float:
        return float(np.log(x / of + 0.002))

    return [
        float(np.log1p(len(raw))), float(np.log1p(len(words))), float(np.log1p(len(lines))),
        float(np.log((n - part["space"]) / n_words + 1)),
        share(part["upper"], letters), share(part["digit"], n), share(other, n),
        share(part["stop"], n_words), share(part["comma"], n_words), share(part["pipe"], n_words),
        share(part["wide"], letters),
        share(len(kinds), n_words), share(max(kinds.values(), default=0), n_words),
        share(n_lines - len(set(lines)), n_lines),
        share(len(zlib.compress(raw, 1)), n),
        share(sum(1 for w in words if w[-1:] in b"!%$#&*"), n_words),
        share(sum(map(len, kinds)), n)]


def with_statistics(docs: DataFrame) -> DataFrame:
    @F.pandas_udf("array<double>")
    def of(text: pd.Series) -> pd.Series:
        return text.map(statistics)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       of(F.coalesce(F.col("text"), F.lit(""))).alias("x"))


def moments(rows: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Count, sum and sum of outer products of each label; a fixed number of rows to the driver."""
    schema = pa.schema([("label", pa.int32()), ("at", pa.int32()), ("part", pa.float64())])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            labels = np.asarray(b.column("label"))
            x = np.array(b.column("x").to_pylist()).reshape(len(labels), STATISTICS)
            x = np.hstack([np.ones((len(x), 1)), x])
            for k in np.unique(labels):
                own = x[labels == k]
                held[int(k)] = held.get(int(k), 0) + (own.T @ own).ravel()
        for k, v in held.items():
            yield batch({"label": [k] * len(v), "at": range(len(v)), "part": v}, schema)

    sums = rows.select("label", "x").mapInArrow(partial, "label int, at int, part double") \
        .groupBy("label", "at").agg(F.sum("part").alias("part")).collect()
    out = {}
    for k in {r.label for r in sums}:
        whole = np.zeros((STATISTICS + 1) ** 2)
        for r in sums:
            if r.label == k:
                whole[r["at"]] = r.part
        whole = whole.reshape(STATISTICS + 1, STATISTICS + 1)
        out[k] = (int(round(whole[0, 0])), whole[0, 1:], whole[1:, 1:])
    return out


class Discriminant:
    """Two Gaussian classes with the inverses of their Cholesky factors."""

    def __init__(self, sums: dict, shrink: float = 0.05, ridge: float = 0.01):
        counts = {k: sums[k][0] if k in sums else 0 for k in (0, 1)}
        self.prior = float(np.log((counts[1] + 0.5) / (counts[0] + 0.5)))
        self.classes = None
        if min(counts.values()) < 2:
            return
        mean = {k: sums[k][1] / counts[k] for k in (0, 1)}
        own = {k: sums[k][2] / counts[k] - np.outer(mean[k], mean[k]) for k in (0, 1)}
        pooled = sum(counts[k] * own[k] for k in (0, 1)) / sum(counts.values())
        self.classes = {}
        for k in (0, 1):
            cov = (1 - shrink) * own[k] + shrink * pooled
            cov = (1 - ridge) * cov + ridge * max(np.trace(cov) / len(cov), 1e-6) * np.eye(len(cov))
            factor = np.linalg.cholesky(cov)
            self.classes[k] = (mean[k], np.linalg.inv(factor), 2 * np.log(np.diag(factor)).sum())

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.prior)
        if self.classes:
            for k, sign in ((0, 0.5), (1, -0.5)):
                mean, inverse, log_det = self.classes[k]
                z += sign * ((((x - mean) @ inverse.T) ** 2).sum(axis=1) + log_det)
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted: a row for each row of docs (without id: not held out)."""
    prepared(docs.sparkSession)
    all_rows = stored(with_statistics(docs))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"),
                          F.col("quality").cast("int").alias("label")) \
        .where(F.col("label").isin(0, 1) & (fold(F.col("doc_id"), 5) != 0)) \
        .groupBy("doc_id").agg(F.max("label").alias("label"))
    model = Discriminant(moments(all_rows.join(known, "doc_id")))

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array(x.tolist()).reshape(len(x), STATISTICS)))

    return all_rows.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
                           .alias("held_out"),
                           score("x").alias("score")) \
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
