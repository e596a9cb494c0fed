"""Approximate nearest neighbours: a forest of random-projection trees and one shared queue.

Trees are grown on a bounded sample (`SAMPLE` distinct vectors): a node projects on the difference
of two of its vectors and splits at the median, down to `LEAF` sampled vectors. Every vector of
the table is then filed under one leaf of every tree. A query walks all trees through one priority
queue ordered by its distance to the planes it would have to cross, and takes the first `SHARE` of
the forest's leaves. Vectors and queries meet by leaf in blocks; exact inner products in double
precision rank what was found.

The blocks of a query's leaves are taken in the order of its queue, in rounds that grow by `GROWTH`.
The (k + 1)-th best score so far goes with the query into the next round, and a block returns only
what reaches it, so the rows found grow with the queries, and not with the leaves they visit.

Equal vectors are one class that carries its k + 1 smallest ids, which is all a result can need; a
leaf that holds many vectors is dealt to several blocks. A query meets only the leaves it asked for.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, rows
without vec_id, and vectors of another length than the most frequent one (the longer of two equally
frequent) take no part. Ties go to the smaller vec_id. Equal rows count once, rows that share
a query's vec_id are never its results, and an id with several vectors is a query with each of them.
An empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from tallybook.llm.common import prepared, stored

SAMPLE = 65_536  # distinct vectors the planes are fitted on
LEAF = 2_048     # sampled vectors of a leaf at most
TREES = 4
SHARE = 0.45     # of all leaves of the forest that one query visits
BLOCK = 8_192    # vectors of a leaf that meet the queries in one group
GROWTH = 8       # blocks met after a round, as a multiple of those met before it
SALTS = 16


class Tree:
    """Planes of one tree; a child below zero is leaf -child - 1."""

    def __init__(self, x: np.ndarray, leaf: int, seed: int):
        rng = np.random.default_rng(seed)
        normals, cuts, children, self.leaves = [], [], [], 0
        queue = [(np.arange(len(x)), None)]
        for rows, above in queue:  # grows while it is read
            split = None
            if len(rows) > leaf:
                a, b = x[rng.choice(rows, 2, replace=False)]
                normal = (a - b) / (np.linalg.norm(a - b) or 1.0)
                at = x[rows] @ normal
                cut = float(np.median(at))
                if (at < cut).any():
                    split = rows[at < cut], rows[at >= cut]
            if split is None:
                self.leaves += 1
                number = -self.leaves
            else:
                number = len(normals)
                normals.append(normal)
                cuts.append(cut)
                children.append([0, 0])
                queue += [(split[0], (number, 0)), (split[1], (number, 1))]
            if above:
                children[above[0]][above[1]] = number
        self.normals = np.array(normals).reshape(len(normals), x.shape[1])
        self.cuts, self.children = np.array(cuts), np.array(children).reshape(-1, 2)

    def margins(self, x: np.ndarray) -> np.ndarray:
        return x @ self.normals.T - self.cuts

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64) if len(self.cuts) else np.full(len(x), -1)
        while (node >= 0).any():
            on = np.flatnonzero(node >= 0)
            at = node[on]
            right = (x[on] * self.normals[at]).sum(axis=1) >= self.cuts[at]
            node[on] = self.children[at, right.astype(int)]
        return -node - 1


class Forest:
    def __init__(self, x: np.ndarray, trees: int = TREES, leaf: int = LEAF):
        self.trees = [Tree(x, leaf, seed) for seed in range(trees)]
        self.first = np.concatenate([[0], np.cumsum([t.leaves for t in self.trees])])
        self.leaves = int(self.first[-1])

    def cells(self, x: np.ndarray) -> np.ndarray:
        """Leaf of every vector in every tree, numbered through the forest."""
        return np.stack([t.leaf_of(x) + f for t, f in zip(self.trees, self.first)], axis=1)

    def probes(self, x: np.ndarray, share: float) -> list[list[int]]:
        """Leaves each query visits, in the order of the shared queue."""
        wanted = max(len(self.trees), math.ceil(share * self.leaves))
        margins = [t.margins(x) for t in self.trees]
        children = [t.children.tolist() for t in self.trees]
        out = []
        for i in range(len(x)):
            own = [m[i].tolist() for m in margins]
            queue = [(-np.inf, t, 0 if len(children[t]) else -1) for t in range(len(self.trees))]
            found: list[int] = []
            while queue and len(found) < wanted:
                far, t, node = heapq.heappop(queue)
                if node < 0:
                    found.append(int(self.first[t]) - node - 1)
                    continue
                left, right = children[t][node]
                heapq.heappush(queue, (max(far, own[t][node]), t, left))
                heapq.heappush(queue, (max(far, -own[t][node]), t, right))
            out.append(found)
        return out


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (doubles) of the rows that take part, each once."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")) \
        .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()) \
        .where(F.coalesce(finite, F.lit(False))
               & F.exists("v", lambda x: x != 0.0)).distinct()
    rows = stored(rows)
    size = rows.groupBy(F.size("v").alias("size")).count() \
        .agg(F.max(F.struct("count", "size"))["size"].alias("size")).first()["size"]
    return rows.where(F.size("v") == (size or 0))


@F.pandas_udf(BinaryType())
def packed(v: pd.Series) -> pd.Series:
    """The components' bytes, in single precision where that holds all of them exactly."""
    def one(x: np.ndarray) -> bytes:
        with np.errstate(over="ignore"):
            short = x.astype(np.float32)
        return (short if (short == x).all() else x).tobytes()

    return v.map(one)


def _unpacked(v: pd.Series, size: int) -> np.ndarray:
    return np.stack([np.frombuffer(x, np.float32 if len(x) == 4 * size else np.float64)
                     .astype(np.float64) for x in v])


def _best(index: pd.DataFrame, queries: pd.DataFrame, k: int, size: int) -> pd.DataFrame:
    """(q_id, q_hash, vec_id, score): the k best ids of every query among one block that reach the
    query's bound."""
    out: dict[str, list] = {"q_id": [], "q_hash": [], "vec_id": [], "score": []}
    x = _unpacked(index["p"], size) if len(index) else None
    ids = index["ids"].to_list()
    for low in range(0, len(queries) if len(index) else 0, 256):
        part = queries.iloc[low:low + 256]
        y = _unpacked(part["p"], size)
        products = y @ x.T
        edge = np.partition(products, max(0, len(x) - k), axis=1)[:, max(0, len(x) - k)]
        for i, (q_id, q_hash, least) in enumerate(zip(part["q_id"], part["q_hash"],
                                                      part["least"])):
            at_least = max(edge[i], least)
            near = np.flatnonzero(products[i] >= at_least - 1e-9 * max(1.0, abs(at_least)))
            scores = (x[near] * y[i]).sum(axis=1)
            found = [(-s, v) for s, j in zip(scores.tolist(), near) if s >= least
                     for v in ids[j].tolist()]
            for s, v in heapq.nsmallest(k, found):
                out["q_id"].append(q_id)
                out["q_hash"].append(q_hash)
                out["vec_id"].append(v)
                out["score"].append(-s)
    return pd.DataFrame(out)


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, trees: int = TREES,
            leaf: int = LEAF, share: float = SHARE, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose vec_id divides."""
    spark = prepared(vectors.sparkSession)
    rows = usable(vectors)
    classes = stored(rows.withColumn("n", F.row_number().over(
        Window.partitionBy("v").orderBy("vec_id"))).where(F.col("n") <= k + 1)
        .groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    shares = max(1, math.ceil(classes.count() / sample))
    fitted = classes.where(F.pmod(F.xxhash64("v"), F.lit(shares)) == 0).select("v") \
        .orderBy("v").toPandas()["v"].to_list()
    queries = stored(rows.where(F.pmod("vec_id", F.lit(every)) == 0))
    if not fitted:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sent = spark.sparkContext.broadcast(Forest(np.stack(fitted), trees, leaf))

    @F.pandas_udf("array<int>")
    def cells(v: pd.Series) -> pd.Series:
        return pd.Series(list(sent.value.cells(np.stack(v.to_list()))))

    @F.pandas_udf("array<int>")
    def probes(v: pd.Series) -> pd.Series:
        return pd.Series(sent.value.probes(np.stack(v.to_list()), share))

    size = len(fitted[0])
    filed = stored(classes.select(packed("v").alias("p"), "ids", cells("v").alias("cells"))) \
        .select("p", "ids", F.explode("cells").alias("cell"))
    sizes = {r.cell: r["count"] for r in filed.groupBy("cell").count().collect()}  # a row per leaf
    blocks = F.array(*(F.lit(max(1, math.ceil(sizes.get(c, 0) / BLOCK)))
                       for c in range(sent.value.leaves)))
    index = filed.withColumn("block", F.pmod(F.xxhash64("p"), blocks[F.col("cell")]).cast("int"))
    kinds = queries.groupBy("v").agg(F.min("vec_id").alias("q_id")) \
        .withColumn("q_hash", F.xxhash64("v"))
    # the blocks of a query's leaves, in the order of its queue
    visits = F.flatten(F.transform("cells", lambda c: F.transform(
        F.sequence(F.lit(0), blocks[c] - 1), lambda b: F.struct(c.alias("cell"), b.alias("block")))))
    kinds = stored(kinds.withColumn("cells", probes("v")).select(
        "q_id", "q_hash", "v", packed("v").alias("p"), visits.alias("visits")))
    longest = kinds.agg(F.max(F.size("visits")).alias("n")).first()["n"] or 0
    best = Window.partitionBy("q_id", "q_hash").orderBy(F.desc("score"), "vec_id")
    found, low, high = None, 0, trees
    while low < longest:
        asked = kinds.select("q_id", "q_hash", "p",
                             F.slice("visits", low + 1, high - low).alias("visits"))
        if found is None:
            asked = asked.withColumn("least", F.lit(float("-inf")))
        else:
            bound = found.groupBy("q_id", "q_hash").agg(
                F.min("score").alias("least"), F.count(F.lit(1)).alias("n")) \
                .where(F.col("n") > k).drop("n")
            asked = asked.join(bound, ["q_id", "q_hash"], "left") \
                .fillna(float("-inf"), ["least"])
        asked = asked.select("q_id", "q_hash", "p", "least", F.inline("visits"))
        more = index.groupBy("cell", "block").cogroup(asked.groupBy("cell", "block")) \
            .applyInPandas(lambda a, b: _best(a, b, k + 1, size),
                           "q_id long, q_hash long, vec_id long, score double")
        found = stored((more if found is None else found.unionByName(more))
                       .groupBy("q_id", "q_hash", "vec_id").agg(F.max("score").alias("score"))
                       .withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
                       .drop("n"))
        low, high = high, high * GROWTH
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    top = found.groupBy("q_id", "q_hash").agg(F.array_sort(F.collect_list(
        F.struct((-F.col("score")).alias("less"), "vec_id"))).alias("top"))
    lists = kinds.join(top, ["q_id", "q_hash"]).select(
        "v", "top", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    own = queries.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int"))
    others = F.slice(F.filter("top", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return own.withColumnRenamed("vec_id", "query_id").join(lists, ["v", "salt"]) \
        .select("query_id", F.posexplode(others).alias("at", "x")) \
        .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id",
                (-F.col("x.less")).alias("score"))
