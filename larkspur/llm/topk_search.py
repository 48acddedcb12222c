"""Exact top-k search by inner product: cover trees over queries and data, walked together."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import scratch

#: Vectors of the sample that names cells; vectors of a data block; of a query group; of a chunk of queries that meets a block
#: in one task; of a leaf; points that a child has on average at least; data points that are scored together; query groups whose
#: bounds a task takes together.
PIVOTS, BLOCK, GROUP, CHUNK, LEAF, CHILD, SCORED, GROUPS = 64, 2048, 256, 4096, 32, 4, 1024, 1024
RESULT = "query_id long, rank int, vec_id long, score long"


@dataclass
class CoverTree:
    """A cover tree in arrays. Node 0 is the root; a node's points are order[low:high], its center is the first of them.

    Every center is a data point. A node's ``radius`` covers all of its points. Its children's centers, of which its own center
    is the first, are apart by more than ``scale`` and cover its points within ``scale``, half its radius: so radii halve at least from level to level.
    Nodes of LEAF points or fewer, or of equal points, have no children, nor have those whose points are so far apart that children
    would have fewer than CHILD points on average, as in many dimensions: there bounds cannot leave out much.
    """

    order: np.ndarray
    low: np.ndarray
    high: np.ndarray
    radius: np.ndarray
    first: np.ndarray  # children are the nodes first[n] to last[n]
    last: np.ndarray

    @property
    def center(self) -> np.ndarray:
        return self.order[self.low]


def cover_tree(points: np.ndarray) -> CoverTree:
    """Level by level: centers are taken greedily, each the farthest from those before, until all points are covered."""
    norms = (points**2).sum(axis=1)

    def away(center: int, rows: np.ndarray) -> np.ndarray:
        d = norms[rows] + norms[center] - 2 * (points[rows] @ points[center])
        return np.sqrt(np.maximum(d, 0)) * (1 + 1e-9)

    middle = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
    order = np.concatenate([[middle], np.delete(np.arange(len(points)), middle)])
    nodes = [[0, len(points), float(away(middle, order).max()), 0, 0]]
    n = 0
    while n < len(nodes):
        low, high, radius, _, _ = nodes[n]
        rows = order[low:high]
        if len(rows) > LEAF and radius > 0:
            scale, pick = radius / 2, 0
            nearest, of, centers = np.full(len(rows), np.inf), np.zeros(len(rows), int), 0
            while nearest.max() > scale and centers * CHILD <= len(rows):
                d = away(rows[pick], rows)
                d[pick] = 0
                of[d < nearest] = centers
                nearest = np.minimum(nearest, d)
                centers += 1
                pick = int(nearest.argmax())
            if nearest.max() > scale:
                n += 1
                continue
            # Points by child, nearest first: a center is at no distance from itself.
            by = np.lexsort((nearest, of))
            order[low:high] = rows[by]
            size = np.bincount(of, minlength=centers)
            reach = np.maximum.reduceat(nearest[by], np.cumsum(size) - size)
            nodes[n][3:] = len(nodes), len(nodes) + centers
            at = low
            for k in range(centers):
                nodes.append([at, at + int(size[k]), float(reach[k]), 0, 0])
                at += int(size[k])
        n += 1
    low, high, radius, first, last = (np.array(x) for x in zip(*nodes, strict=True))
    return CoverTree(order, low, high, radius, first, last)


#: Stands for no score; below every other.
NONE = -(1 << 63)


class Best:
    """The k best of every query so far: score, then smaller id. Scores are 64-bit integers."""

    def __init__(self, ids: np.ndarray, k: int, floor: np.ndarray):
        self.ids, self.k = ids, k
        self.score = np.full((len(ids), k), NONE, np.int64)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.floor = np.asarray(floor, np.int64)

    def worst(self, rows: np.ndarray) -> np.ndarray:
        return np.maximum(self.score[rows, -1], self.floor[rows])

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        scores = np.where(self.ids[rows][:, None] == ids[None, :], NONE, scores)
        open_ = scores.max(axis=1) >= self.worst(rows)
        if not open_.any():
            return
        rows, scores = rows[open_], scores[open_]
        if scores.shape[1] > 4 * self.k:  # what is below the k-th of this leaf cannot stay
            bar = np.partition(scores, -self.k, axis=1)[:, -self.k]
            use = (scores >= bar[:, None]).any(axis=0)
            scores, ids = scores[:, use], ids[use]
        s = np.concatenate([self.score[rows], scores], axis=1)
        i = np.concatenate([self.found[rows], np.broadcast_to(ids, scores.shape)], axis=1)
        i = np.where(s == NONE, np.iinfo(np.int64).max, i)
        first = np.lexsort((i, ~s), axis=-1)[:, : self.k]
        self.score[rows], self.found[rows] = np.take_along_axis(s, first, 1), np.take_along_axis(i, first, 1)


def bounds(near: np.ndarray, nq, rq, nx, rx) -> np.ndarray:
    """No inner product of points of two balls is above this: near, of their centers, with norms n and radii r.

    Scores are integers, so half a unit and a share of what was added up are room enough for rounding.
    """
    more = nq * rx + nx * rq + rq * rx
    return near + more + 1e-9 * (np.abs(near) + nq * nx + more) + 0.5


def spread(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All numbers of the ranges first to last, one range after the other."""
    size = last - first
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


def products(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """Inner products of whole numbers as 64-bit integers, exact; ``most`` bounds the sum of the products' sizes.

    Doubles hold them below 2^53, 64-bit integers below 2^63. What may be larger is reckoned in integers of any size; a score that
    a 64-bit column cannot hold is an error, not another number.
    """
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    if most < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = np.array([[int(x) for x in row] for row in a], object) @ np.array([[int(x) for x in row] for row in b], object).T
    if max(abs(x) for x in whole.flat) >= 1 << 63:
        raise OverflowError("an inner product is beyond 64 bits")
    return whole.astype(np.int64)


def dual_tree(queries: np.ndarray, data: np.ndarray, ids: np.ndarray, best: Best) -> None:
    """Walk both trees together: each query node with the data nodes that may still hold one of the k best of its queries.

    Data nodes whose bound is below the worst k-th score of the query node go. Where data nodes are wider than the query node
    they give way to their children, else the query node does. A query leaf takes the data nodes in the order of their bounds,
    their points together, so that later ones meet better k-th scores.
    """
    if not len(queries) or not len(data):
        return
    most = max(np.abs(queries).max(), 1) * max(np.abs(data).max(), 1) * queries.shape[1]
    q, x = cover_tree(queries), cover_tree(data)
    norm_q, norm_x = np.sqrt((queries[q.center] ** 2).sum(axis=1)), np.sqrt((data[x.center] ** 2).sum(axis=1))
    leaf_x = x.last == 0
    stack = [(0, np.zeros(1, np.int64))]
    while stack:
        n, nodes = stack.pop()
        rows, center = q.order[q.low[n] : q.high[n]], queries[q.center[n]]

        def top(nodes: np.ndarray, n=n, center=center) -> np.ndarray:
            return bounds(data[x.center[nodes]] @ center, norm_q[n], q.radius[n], norm_x[nodes], x.radius[nodes])

        leaf = q.last[n] == 0
        while True:
            nodes = nodes[top(nodes) >= best.worst(rows).min()]
            wide = ~leaf_x[nodes] & (leaf | (x.radius[nodes] >= q.radius[n]))
            if not wide.any():
                break
            nodes = np.concatenate([nodes[~wide], spread(x.first[nodes[wide]], x.last[nodes[wide]])])
        if not len(nodes):
            continue
        if not leaf:
            stack += [(c, nodes) for c in range(q.first[n], q.last[n])]
            continue
        nodes = nodes[np.argsort(-top(nodes), kind="stable")]
        part = (np.cumsum(x.high[nodes] - x.low[nodes]) - 1) // SCORED
        for k in range(part.max() + 1):
            some = nodes[part == k]
            some = some[top(some) >= best.worst(rows).min()]
            if len(some):
                at = x.order[spread(x.low[some], x.high[some])]
                a, b = queries[rows], data[at]
                best.offer(rows, products(a, b, most), ids[at])


def matrix(column) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(lists), -1)


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v): floor(64 x) of every component; vectors that are or hold null, or hold non-finite numbers, are left out.

    Shorter vectors are filled up with zeros to the longest.
    """
    x = F.transform("embedding", lambda e: e.cast("double"))
    big = F.lit(float("inf"))
    good = F.coalesce(F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < big)), F.lit(False))
    v = embeddings.where(F.col("vec_id").isNotNull() & good).select(F.col("vec_id").cast("long"), F.transform(x, lambda e: F.floor(e * 64).cast("double")).alias("v"))
    dim = max(1, v.agg(F.max(F.size("v"))).first()[0] or 0)
    return v.select("vec_id", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(dim) - F.size("v"))).alias("v"))


def with_cells(vectors: DataFrame, pivots: int = PIVOTS) -> DataFrame:
    """Adds ``cell``: the nearest vector of a sample of ``pivots`` vectors, drawn by a digest of their ids."""
    sample = np.array([r.v for r in vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()])
    sent = vectors.sparkSession.sparkContext.broadcast(sample)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        for batch in batches:
            if len(batch):
                m = matrix(batch.column(1))
                cell = ((p**2).sum(axis=1)[None, :] - 2 * m @ p.T).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int64())], ["vec_id", "v", "cell"])

    return vectors.mapInArrow(nearest, "vec_id long, v array<double>, cell long")


def dealt(vectors: DataFrame, size: int, name: str) -> DataFrame:
    """Adds a block number: cells in parts of about ``size`` vectors, so a hot cell is many blocks. Cells are few."""
    parts = vectors.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / size).alias("parts"))
    return vectors.join(F.broadcast(parts), "cell").withColumn(name, F.col("cell") * F.lit(1 << 32) + F.pmod(F.xxhash64("vec_id", F.lit(7)), "parts")).drop("parts", "cell")


def balls(rows: DataFrame, key: str) -> DataFrame:
    """(key, center, radius) of every block: the vector nearest to the mean, and how far the others are from it."""

    def ball(part: pa.Table) -> pa.Table:
        m = matrix(part["v"])
        center = m[((m - m.mean(axis=0)) ** 2).sum(axis=1).argmin()]
        radius = float(np.sqrt(((m - center) ** 2).sum(axis=1)).max()) * (1 + 1e-9)
        return pa.table({key: part[key][:1], "center": pa.array([center], pa.list_(pa.float64())), "radius": [radius]})

    return rows.groupBy(key).applyInArrow(ball, f"{key} long, center array<double>, radius double")


def _together(groups: DataFrame, blocks: DataFrame, *more: str) -> DataFrame:
    """Every block with every chunk of about GROUPS query groups, one row for each chunk."""
    chunks = max(1, -(-groups.count() // GROUPS))
    g = groups.select(F.pmod(F.xxhash64("grp"), F.lit(chunks)).alias("part"), F.struct("grp", "center", "radius", *more).alias("g")).groupBy("part").agg(F.collect_list("g").alias("gs"))
    b = blocks.select("block", "center", "radius", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("part"))
    return b.join(g.hint("merge"), "part").select("part", "block", "center", "radius", "gs")


def nearest_blocks(groups: DataFrame, blocks: DataFrame) -> DataFrame:
    """(grp, block): the block whose center has the largest inner product with the group's; a task returns one row per group."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[float, int]] = {}
        for batch in batches:
            for block, center, gs in zip(*(batch.column(i).to_pylist() for i in (1, 2, 4)), strict=True):
                for r, p in zip(gs, (np.array([r["center"] for r in gs]) @ np.array(center)).tolist(), strict=True):
                    best[r["grp"]] = max(best.get(r["grp"], (p, block)), (p, block))
        columns = [pa.array(best, pa.int64()), pa.array([b for _, b in best.values()], pa.int64()), pa.array([p for p, _ in best.values()], pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, ["grp", "block", "near"])

    found = _together(groups, blocks).mapInArrow(near, "grp long, block long, near double")
    return found.groupBy("grp").agg(F.max_by("block", F.struct("near", "block")).alias("block"))


def meeting(groups: DataFrame, blocks: DataFrame) -> DataFrame:
    """(grp, block): data blocks that may hold one of the k best of a query group; groups: with worst, their least k-th score."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, block, center, radius, gs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, q = np.array(center), np.array([r["center"] for r in gs])
                top = bounds(q @ x, np.sqrt((q**2).sum(axis=1)), np.array([r["radius"] for r in gs]), np.sqrt(x @ x), radius)
                hit = np.flatnonzero(top >= np.array([r["worst"] for r in gs]))
                yield pa.RecordBatch.from_arrays([pa.array([gs[i]["grp"] for i in hit], pa.int64()), pa.array([block] * len(hit), pa.int64())], ["grp", "block"])

    return _together(groups, blocks, "worst").mapInArrow(keep, "grp long, block long")


def searched(queries: DataFrame, data: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): the best k of each query in each block that it meets; queries: (grp, vec_id, v, floor).

    A task takes one block and one chunk of the queries that meet it.
    """
    pairs = pairs.withColumn("chunk", F.pmod(F.xxhash64("grp", F.lit(3)), F.lit(max(1, -(-queries.count() // CHUNK)))))
    asked = queries.join(pairs.hint("merge"), "grp").select("block", "chunk", "vec_id", "v", "floor", F.lit(True).alias("asks"))
    given = data.join(pairs.select("block", "chunk").distinct().hint("merge"), "block").select("block", "chunk", "vec_id", "v", F.lit(0).cast("long").alias("floor"), F.lit(False).alias("asks"))

    def best(part: pa.Table) -> pa.Table:
        asks = np.array(part["asks"].to_pylist(), bool)
        v, ids, floor = matrix(part["v"]), part["vec_id"].to_numpy(), part["floor"].to_numpy()
        held = Best(ids[asks], k, floor[asks])
        dual_tree(v[asks], v[~asks], ids[~asks], held)
        ok = (held.score > NONE) & (held.score >= held.floor[:, None])
        q = np.broadcast_to(held.ids[:, None], ok.shape)[ok]
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(held.found[ok], pa.int64()), "score": pa.array(held.score[ok], pa.int64())})

    return asked.unionByName(given).groupBy("block", "chunk").applyInArrow(best, "query_id long, vec_id long, score long")


def top_k(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exact_top_k(embeddings: DataFrame, is_query, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: for every vector that ``is_query`` (a Column) selects, the k others of largest inner product.

    Data and queries are dealt into cells around a bounded sample of vectors, cells into blocks and groups of bounded size.
    Each query group first searches the block nearest to it, which gives every query a k-th score to beat; then it meets all
    blocks whose bound is not below the worst of these. In a task, a cover tree over the queries and one over the block are
    walked together. Bounds only ever leave out what cannot be among the k best, so results are exact.

    Ties go to the smaller vec_id. Rows with a null vec_id take no part. Rows that share a vec_id are one candidate each, and
    none for the query of that id; of queries that share an id, the smallest vector asks. Scores are exact up to 64 bits; one beyond
    raises. An empty table gives no rows.
    """
    vectors = scratch(integer_vectors(embeddings.select("vec_id", "embedding")))
    if vectors.isEmpty():
        return embeddings.sparkSession.createDataFrame([], RESULT)
    celled = scratch(with_cells(vectors))
    data = scratch(dealt(celled, BLOCK, "block"))
    asking = celled.where(is_query).groupBy("vec_id").agg(F.min(F.struct("v", "cell")).alias("q")).select("vec_id", "q.v", "q.cell")
    queries = scratch(dealt(scratch(asking), GROUP, "grp"))
    blocks = scratch(balls(data, "block"))
    groups = balls(queries, "grp")
    low = F.lit(NONE).cast("long")
    home = scratch(nearest_blocks(scratch(groups), blocks))
    first = scratch(searched(queries.withColumn("floor", low), data, home, k))
    kth = top_k(first, k).groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth"))
    asked = scratch(
        queries.join(kth.withColumnRenamed("query_id", "vec_id").hint("merge"), "vec_id", "left").select("grp", "vec_id", "v", F.coalesce("kth", low).alias("floor"))
    )
    worst = asked.groupBy("grp").agg(F.min("floor").alias("worst"))
    left = meeting(balls(asked, "grp").join(worst.hint("merge"), "grp"), blocks).join(home.hint("merge"), ["grp", "block"], "left_anti")
    rest = searched(asked, data, scratch(left.select("grp", "block")), k)
    return top_k(first.unionByName(rest), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, CAST([floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(q.v, x.v) AS BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""
