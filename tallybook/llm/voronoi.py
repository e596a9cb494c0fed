"""Exact top-k search: a Voronoi join of queries and data on quantised vectors.

Every component becomes floor(1024 * x); nearness is the integer inner product. A bounded number of
pivots (`PIVOTS` rows chosen by a hash of their id) cuts all rows into cells, each row filed with its
distance to its pivot. Per cell a summary goes to the driver: row count, radius of its queries and
the smallest distances of its rows. By Cauchy and Schwarz <q, x> lies within |q| * |x - p| of <q, p>,
so the summaries bound from below what the k-th best product of any query of a cell can be. Then

1. queries are solved against the rows of their own cell, which raises that bound to a real k-th
   best product per query; the smallest of a cell's queries is the cell's bound;
2. of the rest, a row is sent only to groups of query cells where its product can reach the bound,
   and is solved there; a block returns only products that reach the query's own bound.

Cells and groups with many rows are dealt to blocks by a hash of vec_id, so a vector held by a third
of all rows meets no single task. Bounds carry margins for rounding and products are exact integers
(double precision below 2^53, Python integers beyond), so nothing is lost, only work is saved: for
directions without structure, as in the given tables, bounds rule out little and the join becomes
a product of blocks.

Defined results: rows whose vec_id or embedding is null, empty or holds null or non-finite
components, and vectors of another length than the most frequent one (the longer of two equally
frequent), take no part; zero vectors do. Components beyond the range of a long, and scores beyond
it, take its nearest end, where they tie. A vec_id with several rows is a query
with each different vector, is a result once with its best score, and never a result of itself.
Ties go to the smaller vec_id. An empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybook.llm.common import prepared, stored

SCALE = 1024
PIVOTS = 64
LEAST_BLOCK, MOST_BLOCK = 2_048, 32_768  # rows of a cell or group that meet in one task
BLOCKS = 64                              # blocks wanted, between those limits
GROUP = 16_384                           # queries of one group at most
SLICE = 128                              # queries multiplied at a time
MARGIN = 1e-9                            # of the sizes involved, far above double rounding
RESULT = "query_id long, rank int, vec_id long, score long"
LONG = (1 << 63) - 1

C, L = F.col, F.lit


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id, v (longs) of the rows that take part, repeated rows included."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
                      & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(C("vec_id").isNotNull() & (F.size("embedding") > 0)
                         & F.coalesce(finite, L(False))).select(
        C("vec_id").cast("long").alias("vec_id"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE)).alias("v"))
    size = rows.groupBy(F.size("v").alias("size")).count() \
        .agg(F.max(F.struct("count", "size"))["size"].alias("size")).first()["size"]
    return rows.where(F.size("v") == (size or 0))


def _matrix(v: pd.Series) -> np.ndarray:
    return np.stack(v.to_list()).astype(np.int64)


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)) * (1 + MARGIN)


def _products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products: doubles where they hold them, else Python integers within a long."""
    reach = float(np.abs(queries.astype(float)).max()) * float(np.abs(rows.astype(float)).max())
    if reach * rows.shape[1] < 2 ** 53:
        return queries.astype(np.float64) @ rows.astype(np.float64).T
    return np.clip(queries.astype(object) @ rows.astype(object).T, -LONG - 1, LONG)


class Pivots:
    """Cells, and bounds of products from distances."""

    def __init__(self, points: np.ndarray):
        self.points = points.astype(np.float64)
        self.norms = _norms(points)

    def filed(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nearest pivot, no less than the distance to it) of every row."""
        y = x.astype(np.float64)
        own = (y ** 2).sum(axis=1)
        squares = own[:, None] + (self.points ** 2).sum(axis=1) - 2 * y @ self.points.T
        cell = squares.argmin(axis=1)
        far = ((y - self.points[cell]) ** 2).sum(axis=1)
        return cell, np.sqrt(far) * (1 + MARGIN) + MARGIN

    def least(self, radius: np.ndarray, nearest: list[tuple[int, float]], need: int) -> np.ndarray:
        """Per query cell: no query of it has fewer than `need` rows with that product.

        `nearest` holds (cell, distance) of the rows closest to their pivots.
        """
        if len(nearest) < need:
            return np.full(len(self.points), -np.inf)
        cells = np.array([c for c, _ in nearest])
        far = np.array([d for _, d in nearest])
        size = self.norms + radius
        low = (self.points @ self.points[cells].T - np.outer(radius, self.norms[cells])
               - np.outer(size, far))
        low -= MARGIN * (np.outer(size, self.norms[cells] + far) + 1)
        least = -np.partition(-low, need - 1, axis=1)[:, need - 1]
        return np.minimum(least, LONG * (1 - MARGIN))

    def most(self, x: np.ndarray, cell: np.ndarray, far: np.ndarray,
             radius: np.ndarray) -> np.ndarray:
        """(rows, query cells): no query of the cell has a greater product with the row."""
        norms = _norms(x)
        size = self.norms + radius
        direct = x.astype(np.float64) @ self.points.T + np.outer(norms, radius)
        by_pivot = (self.points[cell] @ self.points.T + np.outer(self.norms[cell], radius)
                    + np.outer(far, size))
        return np.minimum(direct, by_pivot) + MARGIN * (np.outer(norms + far, size) + 1)


def _solved(rows: pd.DataFrame, queries: pd.DataFrame, k: int, copies: int,
            others: bool) -> pd.DataFrame:
    """(q_id, q_hash, vec_id, score) of the best k ids of every query that reach its bound.

    `others`: rows of the query's own cell are left out.
    """
    out: dict[str, list] = {"q_id": [], "q_hash": [], "vec_id": [], "score": []}
    if len(rows) and len(queries):
        x, ids = _matrix(rows["v"]), rows["vec_id"].to_numpy()
        cells = rows["cell"].to_numpy()
        # so many rows hold k ids besides the query's own
        edge_at = min(len(x), (k + 1) * copies) - 1
        for low in range(0, len(queries), SLICE):
            part = queries.iloc[low:low + SLICE]
            products = _products(_matrix(part["v"]), x)
            for one, (q_id, q_hash, cell, least) in zip(products, zip(
                    part["q_id"], part["q_hash"], part["cell"], part["least"])):
                near = np.flatnonzero((one >= least) & ((cells != cell) if others else True))
                if len(near) > edge_at + 1:
                    edge = -np.partition(-one[near], edge_at)[edge_at]
                    near = near[one[near] >= edge]
                seen = {q_id}
                for j in sorted(near, key=lambda j: (-one[j], ids[j])):
                    if ids[j] not in seen:
                        seen.add(ids[j])
                        out["q_id"].append(q_id)
                        out["q_hash"].append(q_hash)
                        out["vec_id"].append(ids[j])
                        out["score"].append(int(one[j]))
                        if len(seen) > k:
                            break
    return pd.DataFrame(out)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best ids of every query, ranked."""
    order = Window.partitionBy("q_id", "q_hash").orderBy(F.desc("score"), "vec_id")
    return found.groupBy("q_id", "q_hash", "vec_id").agg(F.max("score").alias("score")) \
        .withColumn("rank", F.row_number().over(order)).where(C("rank") <= k)


FOUND = "q_id long, q_hash long, vec_id long, score long"


def top_products(vectors: DataFrame, k: int = 10, every: int = 100, pivots: int = PIVOTS,
                 least_block: int = LEAST_BLOCK, group: int = GROUP) -> DataFrame:
    """query_id, rank, vec_id, score: the k greatest products of each row whose vec_id divides."""
    spark = prepared(vectors.sparkSession)
    rows = stored(quantised(vectors))
    chosen = rows.select("v").orderBy(F.xxhash64("vec_id", "v")).limit(4 * pivots).collect()
    points = np.array(sorted({tuple(r.v) for r in chosen})[:pivots], np.int64)
    if not len(points):
        return spark.createDataFrame([], RESULT)
    sent = spark.sparkContext.broadcast(Pivots(points))

    @F.pandas_udf("struct<cell: int, far: double>")
    def filed(v: pd.Series) -> pd.DataFrame:
        cell, far = sent.value.filed(_matrix(v))
        return pd.DataFrame({"cell": cell.astype(np.int32), "far": far})

    is_query = F.pmod("vec_id", L(every)) == 0
    data = stored(rows.withColumn("at", filed("v")).select("vec_id", "v", "at.*"))
    queries = stored(data.where(is_query).select(
        C("vec_id").alias("q_id"), F.xxhash64("v").alias("q_hash"), "v", "cell",
        "far").dropDuplicates(["q_id", "q_hash", "v"]))

    # a row per cell, k + 1 numbers of each cell, and one number come to the driver
    copies = data.groupBy("vec_id").count().agg(F.max("count").alias("n")).first()["n"]
    need = (k + 1) * copies
    sizes = {r.cell: r["count"] for r in data.groupBy("cell").count().collect()}
    asked = {r.cell: (r.far, r.n) for r in queries.groupBy("cell").agg(
        F.max("far").alias("far"), F.count(L(1)).alias("n")).collect()}
    closest = Window.partitionBy("cell").orderBy("far")
    nearest = [(r.cell, r.far) for r in data.select("cell", "far").withColumn(
        "n", F.row_number().over(closest)).where(C("n") <= k + 1).collect()]
    radius = np.array([asked.get(c, (0.0, 0))[0] for c in range(len(points))])
    least = sent.value.least(radius, nearest, need)
    total = sum(sizes.values())
    block = max(least_block, min(MOST_BLOCK, total // BLOCKS))
    leasts = F.array(*map(L, least.tolist()))

    # the rows of the queries' own cells
    counts = F.array(*(L(math.ceil(sizes.get(c, 0) / block)) for c in range(len(points))))
    number = F.pmod(F.xxhash64("vec_id"), counts[C("cell")]).cast("int")
    home = data.where(C("cell").isin(*asked)).select("vec_id", "v", "cell").withColumn(
        "block", number)
    own = queries.withColumn("least", leasts[C("cell")]).withColumn(
        "block", F.explode(F.sequence(L(0), counts[C("cell")] - 1)))
    first = stored(_best(home.groupBy("cell", "block").cogroup(own.groupBy("cell", "block"))
                         .applyInPandas(lambda a, b: _solved(a, b, k, copies, False), FOUND), k))

    # the k-th best of a query is its bound, the least of a cell's queries is that of the cell
    kth = first.where(C("rank") == k).select("q_id", "q_hash", C("score").alias("kth"))
    bound = F.greatest(leasts[C("cell")], C("kth").cast("double") * (
        1 - MARGIN * F.signum("kth")) - 1)
    bounded = stored(queries.join(kth, ["q_id", "q_hash"], "left").withColumn(
        "least", F.coalesce(bound, leasts[C("cell")])))
    least = np.full(len(points), np.inf)
    for r in bounded.groupBy("cell").agg(F.min("least").alias("least")).collect():
        least[r.cell] = r.least

    # groups of neighbouring query cells; a cell of many queries is several groups
    groups: list[list[int]] = []
    deals, held = {}, 0
    for c in sorted(asked):
        n = math.ceil(asked[c][1] / group)
        if n > 1 or held + asked[c][1] > group or not groups:
            groups += [[c] for _ in range(n)]
            held = asked[c][1] if n == 1 else group
        else:
            groups[-1].append(c)
            held += asked[c][1]
        deals[c] = (len(groups) - n, n)
    members = np.zeros((len(points), len(groups)), bool)
    for g, cells in enumerate(groups):
        members[cells, g] = True

    @F.pandas_udf("array<int>")
    def wanted(v: pd.Series, cell: pd.Series, far: pd.Series) -> pd.Series:
        own_cell = cell.to_numpy()
        meets = sent.value.most(_matrix(v), own_cell, far.to_numpy(), radius) >= least
        meets[np.arange(len(own_cell)), own_cell] = False
        return pd.Series([np.flatnonzero(row) for row in meets @ members])

    n_blocks = math.ceil(total / block)
    rest = data.select("vec_id", "v", "cell", F.explode(wanted("v", "cell", "far"))
                       .alias("group")).withColumn(
        "block", F.pmod(F.xxhash64("vec_id"), L(n_blocks)).cast("int"))
    first_group = F.create_map(*(L(x) for c, (at, _) in deals.items() for x in (c, at)))
    n_groups = F.create_map(*(L(x) for c, (_, n) in deals.items() for x in (c, n)))
    dealt = bounded.withColumn("group", (first_group[C("cell")] + F.pmod(
        F.xxhash64("q_id", "q_hash"), n_groups[C("cell")])).cast("int")).withColumn(
        "block", F.explode(F.sequence(L(0), L(n_blocks - 1))))
    second = rest.groupBy("group", "block").cogroup(dealt.groupBy("group", "block")) \
        .applyInPandas(lambda a, b: _solved(a, b, k, copies, True), FOUND)
    return _best(first.drop("rank").unionByName(second), k).select(
        C("q_id").alias("query_id"), "rank", "vec_id", "score")


SQL = f"""
WITH finite AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
width AS (
  SELECT len(v) AS n FROM finite GROUP BY len(v) ORDER BY count(*) DESC, len(v) DESC LIMIT 1),
usable AS (SELECT DISTINCT vec_id, v FROM finite WHERE len(v) = (SELECT n FROM width)),
scored AS (
  SELECT q.vec_id AS query_id, q.v, x.vec_id,
         max(CAST(list_inner_product(q.v, x.v) AS BIGINT)) AS score
  FROM usable q JOIN usable x ON q.vec_id % 100 = 0 AND x.vec_id <> q.vec_id
  GROUP BY q.vec_id, q.v, x.vec_id),
ranked AS (
  SELECT query_id, vec_id, score, CAST(row_number() OVER (
    PARTITION BY query_id, v ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
