"""Exact top-k inner products by dual-tree search over cover trees."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioloom.llm import utf8
from folioloom.llm.cluster import cut, dealt, placed, stored, table
from folioloom.llm.hnsw import matrix, to_cells


#: Points of a leaf at most; candidates for centres that are looked at together; points scored at once.
LEAF, BATCH, CHUNK = 16, 64, 4_096


def cover(points: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """(centres, which): places of points chosen as centres, more than reach apart, so that every point lies within reach of one; and the
    nearest centre of each point. Centres come a batch at a time: points that none covers yet, thinned until they're apart."""
    size = (points**2).sum(axis=1)
    near, which = np.full(len(points), np.inf), np.zeros(len(points), np.int64)
    centres: list[int] = []
    limit = reach * reach
    left = np.arange(len(points))
    while len(left):
        batch = left[:: max(1, len(left) // BATCH)][:BATCH]
        own = points[batch]
        gap = ((own[:, None, :] - own[None, :, :]) ** 2).sum(axis=2)
        taken: list[int] = []
        for i in range(len(batch)):
            if all(gap[i, j] > limit for j in taken):
                taken.append(i)
        picked = batch[taken]
        d = np.maximum(0.0, size[:, None] + size[picked][None, :] - 2 * points @ points[picked].T)
        d[picked, np.arange(len(picked))] = 0.0
        best = d.argmin(axis=1)
        d = d[np.arange(len(points)), best]
        closer = d < near
        near[closer], which[closer] = d[closer], best[closer] + len(centres)
        centres += picked.tolist()
        left = np.flatnonzero(near > limit)
    return np.array(centres, np.int64), which


class CoverTree:
    """A cover tree in flat arrays. The points of a node are dealt to centres among them, its children, so that each lies within half
    the node's covering radius of its centre, and the centres are farther apart than that: there are as many children as it
    takes. Leaves hold at most leaf points, or points that are all alike. A node's radius is measured: its farthest point. The
    children of a node are numbered one after another."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.leaf = points, leaf
        n = len(points)
        self.order = np.arange(n)
        self.centres, self.radii = np.zeros((0, points.shape[1] if points.ndim == 2 else 0)), np.zeros(0)
        self.span, self.children = np.zeros((0, 2), np.int64), np.zeros((0, 2), np.int64)
        if n:
            self._build()

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, points=self.points, order=self.order, centres=self.centres, radii=self.radii, span=self.span, children=self.children)
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> CoverTree:
        z, made = np.load(io.BytesIO(raw)), cls(np.zeros((0, 0)))
        for name in z.files:
            setattr(made, name, z[name])
        return made

    def _build(self) -> None:
        root = self.points.mean(axis=0)
        centres, radii = [root[None, :]], [np.sqrt(((self.points - root) ** 2).sum(axis=1)).max()[None]]
        spans, children = [np.array([[0, len(self.points)]])], {}
        todo, made = [(0, 0, len(self.points), float(radii[0][0]))], 1
        while todo:
            k, a, b, radius = todo.pop()
            if b - a <= self.leaf or radius == 0:
                continue
            own = self.order[a:b].copy()
            picked, which = cover(self.points[own], radius / 2)
            by = np.argsort(which, kind="stable")
            self.order[a:b] = own[by]
            size = np.bincount(which, minlength=len(picked))
            first = np.cumsum(size) - size
            middle = self.points[own[picked]]
            far = np.sqrt(((self.points[self.order[a:b]] - middle[which[by]]) ** 2).sum(axis=1))
            wide = np.maximum.reduceat(far, first)  # each centre has at least itself
            centres.append(middle)
            radii.append(wide)
            spans.append(np.stack([a + first, a + first + size], axis=1))
            children[k] = (made, made + len(picked))
            todo += [(made + int(i), a + int(first[i]), a + int(first[i] + size[i]), float(wide[i])) for i in np.flatnonzero(size > self.leaf)]
            made += len(picked)
        self.centres, self.radii, self.span = np.concatenate(centres), np.concatenate(radii), np.concatenate(spans)
        self.children = np.zeros((made, 2), np.int64)
        for k, ends in children.items():
            self.children[k] = ends


def _integer_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows held as doubles: a matrix product of doubles where sums stay under 2^53,
    of 64-bit integers where they stay under 2^62, of Python integers, held to the range of a long, beyond."""
    most = (np.abs(a).max(initial=0)) * (np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    if most < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    exact = np.array([[int(v) for v in r] for r in a], object) @ np.array([[int(v) for v in r] for r in b], object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


class Best:
    """Each query's k best (score, id), ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), np.iinfo(np.int64).min)
        self.id = np.full((n, k), np.iinfo(np.int64).max)
        self.have = np.zeros(n, np.int64)

    def worst(self, rows: np.ndarray) -> np.ndarray:
        """The k-th score, minus infinity where fewer than k are known."""
        return np.where(self.have[rows] >= self.k, self.score[rows, -1].astype(np.float64), -np.inf)

    def offer(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray, ok: np.ndarray) -> None:
        """score of each of rows (down) with each of ids (across) where ok; only what reaches a row's k-th is sorted."""
        none_s, none_i = np.iinfo(np.int64).min, np.iinfo(np.int64).max
        self.have[rows] = np.minimum(self.k, self.have[rows] + ok.sum(axis=1))
        good = ok & (score >= self.score[rows, -1:])
        some = good.any(axis=1)
        cols = good[some].any(axis=0)
        if not cols.any():
            return
        rows, good = rows[some], good[np.ix_(some, cols)]
        s = np.concatenate([self.score[rows], np.where(good, score[np.ix_(some, cols)], none_s)], axis=1)
        i = np.concatenate([self.id[rows], np.where(good, ids[cols][None, :], none_i)], axis=1)
        order = np.lexsort((i, ~s), axis=1)[:, : self.k]  # ~s descends without overflow
        self.score[rows], self.id[rows] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


def search(queries: np.ndarray, query_ids: np.ndarray, dt: CoverTree, data_ids: np.ndarray, k: int, leaf: int = LEAF) -> tuple[Best, int]:
    """Best of all queries over all of dt's points other than the query's own id, and how many pairs were scored. The query tree is gone
    down with the data nodes that can still matter to each of its nodes: a node pair is dropped when its bound is under the
    group's worst k-th score. For centres c, d and covering radii r, s an inner product is at most c.d + r|d| + s|c| + rs. At a
    query leaf the data nodes are opened down to their leaves, which are scored, the highest bounds first, until these are too low."""
    best = Best(len(queries), k)
    qt, data = CoverTree(queries, leaf), dt.points
    if not len(queries) or not len(data):
        return best, 0
    norm_q, norm_d = np.sqrt((qt.centres**2).sum(axis=1)), np.sqrt((dt.centres**2).sum(axis=1))
    inner = dt.children[:, 1] > 0
    scored = 0

    def bounds(q: int, d: np.ndarray) -> np.ndarray:
        top = dt.centres[d] @ qt.centres[q] + qt.radii[q] * norm_d[d] + dt.radii[d] * norm_q[q] + qt.radii[q] * dt.radii[d]
        return top + 1e-9 * np.abs(top) + 1.0  # rounding of centres and radii

    def opened(d: np.ndarray, which: np.ndarray) -> np.ndarray:
        """d with the children of those of which in their place."""
        ends = dt.children[d[which]]
        return np.concatenate([d[~which], utf8.flat(ends[:, 0], ends[:, 1] - ends[:, 0])])

    stack = [(0, np.zeros(1, np.int64))]
    while stack:
        q, nodes = stack.pop()
        a, b = qt.span[q]
        rows = qt.order[a:b]
        if qt.children[q, 1]:
            live = nodes[bounds(q, nodes) >= best.worst(rows).min()]
            # data nodes as wide as the query node are opened together with it
            live = opened(live, inner[live] & (dt.radii[live] > qt.radii[q] / 2))
            stack += [(c, live) for c in range(*qt.children[q])]
            continue
        while True:
            top = bounds(q, nodes)
            keep = top >= best.worst(rows).min()
            nodes, top = nodes[keep], top[keep]
            if not inner[nodes].any():
                break
            nodes = opened(nodes, inner[nodes])
        most = 2 * k
        while len(nodes):  # those of the highest bounds first: then most others are under the k-th score
            first = np.argpartition(-top, most)[:most] if len(nodes) > most else np.arange(len(nodes))
            spans = dt.span[nodes[first]]
            cols = dt.order[utf8.flat(spans[:, 0], spans[:, 1] - spans[:, 0])]
            for at in range(0, len(cols), CHUNK):
                part = cols[at : at + CHUNK]
                score = _integer_scores(queries[rows], data[part])
                best.offer(rows, score, data_ids[part], query_ids[rows][:, None] != data_ids[part][None, :])
                scored += score.size
            keep = top >= best.worst(rows).min()
            keep[first] = False
            nodes, top, most = nodes[keep], top[keep], min(CHUNK, 2 * most)
    return best, scored


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(vec_id, v array<double>) with v = scale * x, rounded down by the reader; rows whose vector is null or holds a null or a non-finite
    component are left out."""
    v = F.col(vector_col)
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rounded = F.transform(v, lambda x: x.cast("double") * F.lit(scale))
    return vectors.where(fine).select(F.col(id_col).cast("long").alias("vec_id"), rounded.alias("v"))


def top_k(
    vectors: DataFrame,
    k: int = 5,
    every: int = 50,
    scale: float = 256.0,
    shard_bytes: int = 4 << 20,
    block_rows: int = 65536,
    leaf: int = LEAF,
    shard_rows: int | None = None,
) -> DataFrame:
    """query_id, rank, vec_id, score: for each query, a row whose vec_id is divisible by every, the k highest integer inner
    products of floor(scale * x) with every other row, ties to the smaller vec_id; all candidates, if fewer.

    Rows are dealt by a hash of vec_id into shards of at most about shard_bytes (or shard_rows rows), whose trees are built
    once and written to the shared folder; queries into blocks of about block_rows. A task holds one shard's tree and one
    block, builds the block's tree and returns k rows a query; the shards' rows are merged by rank. Exact at any value of
    these. Vectors that are null, or hold null or non-finite components take no part; nor do rows of null vec_id; an empty
    vector has inner product 0 and vectors of other length than the query's score over the common components. Of rows with
    one vec_id each is a candidate of its own, except for a query of that id. An empty table gives no rows. Scores beyond a
    long are held to its range.
    """
    spark = vectors.sparkSession
    rows = cut(quantised(vectors, scale=scale).where("vec_id is not null"))
    n, n_queries, width = rows.agg(F.count("*"), F.count(F.when(F.col("vec_id") % every == 0, 1)), F.max(F.size("v"))).first()
    shards = dealt(spark, n, shard_rows or max(1024, shard_bytes // (8 * max(1, width or 1))), 4096)
    blocks = max(1, -(-n_queries // block_rows))
    deal = lambda m, name: F.pmod(F.xxhash64("vec_id"), F.lit(m)).cast("int").alias(name)

    def plant(t: pa.Table) -> pa.Table:
        tree = CoverTree(np.floor(matrix(t, width)), leaf)
        return pa.table({"shard": t.column("shard").slice(0, 1), "ids": pa.array([t.column("vec_id").to_pylist()], pa.list_(pa.int64())), "tree": pa.array([tree.dump()], pa.binary())})

    data = rows.select(deal(shards, "shard"), "vec_id", "v")
    trees = stored(placed(data, "shard", shards).groupBy("shard").applyInArrow(plant, "shard int, ids array<long>, tree binary"), "cover-trees")
    asked = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"]).select(deal(blocks, "block"), "vec_id", "v")
    queries, held = to_cells(asked, trees, shards, blocks)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        cols = [np.zeros(0, np.int64)] * 3
        if left.num_rows and right.num_rows:
            ids = left.column("vec_id").to_numpy()
            data_ids = right.column("ids").combine_chunks().flatten().to_numpy()
            best, _ = search(np.floor(matrix(left, width)), ids, CoverTree.load(right.column("tree")[0].as_py()), data_ids, k, leaf)
            have = np.arange(k)[None, :] < best.have[:, None]
            cols = [np.repeat(ids, best.have), best.id[have], best.score[have]]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

    near = queries.cogroup(held).applyInArrow(run, "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8(spark, sf_dir: str) -> DataFrame:
    """The 5 highest integer inner products of each query of embeddings, exact."""
    return top_k(table(spark, sf_dir, "embeddings"))


OP8_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum([q.e[i] * d.e[i] FOR i IN range(1, len(q.e) + 1)]) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 50 = 0 AND d.vec_id <> q.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
