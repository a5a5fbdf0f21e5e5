"""Approximate nearest neighbours: one hierarchical navigable small-world graph a shard, in flat neighbour arrays."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioloom.llm.cluster import cut, dealt, placed, stored, table
from folioloom.llm.utf8 import flat, mix


def _distances(points: np.ndarray, norms: np.ndarray, q: np.ndarray, qn: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Squared distances of each query to its own row of ids; ids of -1 are infinitely far."""
    ok = ids >= 0
    if 3 * np.count_nonzero(ok) > 2 * ok.size:
        d = qn[:, None] + norms[ids] - 2 * np.einsum("qd,qmd->qm", q, points[ids], optimize=False)
        return np.where(ok, d, np.float32(np.inf))
    row, to = np.nonzero(ok)[0], ids[ok]  # most are empty or known
    out = np.full(ids.shape, np.inf, np.float32)
    out[ok] = qn[row] + norms[to] - 2 * np.einsum("pd,pd->p", q[row], points[to], optimize=False)
    return out


def _frame(points: np.ndarray) -> tuple[np.ndarray, float]:
    """Mean and size of the points: graphs hold points less the mean, over the size, as 32-bit floats."""
    if not len(points):
        return np.zeros((1, points.shape[1])), 1.0
    origin = (points / len(points)).sum(axis=0, keepdims=True)
    return origin, float(np.abs(points - origin).max()) or 1.0


class Graph:
    """Layers of neighbour arrays (n x most, -1 where empty) over distinct points; the top layer holds the entry point.

    Points are put in by batches no larger than what is already in: all of a batch search the graph side by side, are
    linked to neighbours chosen by the diversity rule, and the neighbours' own lists are chosen anew with the new links.
    """

    def __init__(self, points: np.ndarray, m: int = 16, ef: int = 80, seed: int = 7, batch: int = 512):
        self.origin, self.scale = _frame(points)
        self.points = np.ascontiguousarray((points - self.origin) / self.scale, np.float32)
        self.norms = np.einsum("nd,nd->n", self.points, self.points)
        n = len(points)
        u = (mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(2 * seed + 1)) >> np.uint64(11)).astype(np.float64) / (1 << 53)
        self.level = np.minimum((-np.log(np.maximum(u, 1e-300)) / np.log(m)).astype(np.int64), 12)
        self.m, self.ef = m, ef
        self.layers: list[np.ndarray] = []
        self.entry = -1
        if n:
            order = np.argsort(-self.level, kind="stable")  # the top layers first: the entry point never changes
            self.entry = int(order[0])
            self.layers = [np.full((n, 2 * m if k == 0 else m), -1, np.int32) for k in range(int(self.level.max()) + 1)]
            done = 1
            while done < n:
                size = min(batch, done, n - done)
                self._insert(order[done : done + size])
                done += size

    def _beam(self, q: np.ndarray, qn: np.ndarray, start: np.ndarray, layer: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances), nearest first, of the ef nearest found from start, for all queries side by side."""
        links, n, rows = self.layers[layer], len(self.points), len(q)
        seen = np.zeros((rows, n), bool)
        at = np.arange(rows)
        ids, dist = np.full((rows, ef), -1, np.int64), np.full((rows, ef), np.inf, np.float32)
        ids[:, : start.shape[1]] = start
        dist[:, : start.shape[1]] = _distances(self.points, self.norms, q, qn, start)
        order = np.argsort(dist, axis=1)
        ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
        seen[np.repeat(at, start.shape[1]), start.ravel()] = True
        opened = ids < 0
        live = at
        while len(live):
            todo = ~opened[live]
            has = todo.any(axis=1)
            live = live[has]
            if not len(live):
                break
            pick = todo[has].argmax(axis=1)  # rows are sorted: the nearest not opened
            opened[live, pick] = True
            near = links[ids[live, pick]].astype(np.int64)
            r = np.repeat(live[:, None], near.shape[1], axis=1)
            near[seen[r, near] & (near >= 0)] = -1
            ok = near >= 0
            seen[r[ok], near[ok]] = True
            d = _distances(self.points, self.norms, q[live], qn[live], near)
            d[d >= dist[live, -1:]] = np.inf
            gain = np.isfinite(d).any(axis=1)
            if gain.any():
                g = live[gain]
                all_d = np.concatenate([dist[g], d[gain]], axis=1)
                keep = np.argsort(all_d, axis=1)[:, :ef]
                ids[g] = np.take_along_axis(np.concatenate([ids[g], near[gain]], axis=1), keep, 1)
                dist[g] = np.take_along_axis(all_d, keep, 1)
                opened[g] = np.take_along_axis(np.concatenate([opened[g], ~ok[gain] | ~np.isfinite(d[gain])], axis=1), keep, 1) | ~np.isfinite(dist[g])
        return np.where(np.isfinite(dist), ids, -1), dist

    def _diverse(self, own: np.ndarray, ids: np.ndarray, dist: np.ndarray, most: int) -> np.ndarray:
        """For each row at most `most` of ids (nearest first): each nearer to the row's point than to any chosen before;
        room left is filled with the nearest of the others."""
        rows, width = ids.shape
        chosen = np.full((rows, most), -1, np.int64)
        count = np.zeros(rows, np.int64)
        taken = np.zeros((rows, width), bool)
        for c in range(width):
            cand = ids[:, c]
            live = np.flatnonzero((cand >= 0) & (count < most) & (cand != own))
            if not len(live):
                continue
            have = chosen[live]
            d = _distances(self.points, self.norms, self.points[cand[live]], self.norms[cand[live]], have)
            good = live[(d > dist[live, c][:, None]).all(axis=1)]
            chosen[good, count[good]] = ids[good, c]
            count[good] += 1
            taken[good, c] = True
        for c in range(width):
            live = np.flatnonzero((ids[:, c] >= 0) & (count < most) & ~taken[:, c] & (ids[:, c] != own))
            chosen[live, count[live]] = ids[live, c]
            count[live] += 1
        return chosen

    def _link(self, new: np.ndarray, near: np.ndarray, layer: int) -> None:
        links = self.layers[layer]
        most = links.shape[1]
        links[new, : near.shape[1]] = near
        a, b = np.repeat(new, near.shape[1]), near.ravel()
        a, b = a[b >= 0], b[b >= 0]
        order = np.argsort(b, kind="stable")
        a, b = a[order], b[order]
        heads = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, np.int64)
        to, size = b[heads], np.diff(np.r_[heads, len(b)])
        for i in range(0, len(to), 512):
            t, s, h = to[i : i + 512], size[i : i + 512], heads[i : i + 512]
            wide = np.full((len(t), most + int(s.max())), -1, np.int64)
            wide[:, :most] = links[t]
            row = np.repeat(np.arange(len(t)), s)
            wide[row, most + np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s)] = a[h[0] : h[0] + s.sum()]
            d = _distances(self.points, self.norms, self.points[t], self.norms[t], wide)
            order = np.argsort(d, axis=1, kind="stable")
            wide, d = np.take_along_axis(wide, order, 1), np.take_along_axis(d, order, 1)
            fits = (wide >= 0).sum(axis=1) <= most
            links[t[fits]] = wide[fits, :most]
            if (~fits).any():
                links[t[~fits]] = self._diverse(t[~fits], wide[~fits], d[~fits], most)

    def _insert(self, new: np.ndarray) -> None:
        q, qn = self.points[new], self.norms[new]
        at = np.full((len(new), 1), self.entry, np.int64)
        for layer in range(len(self.layers) - 1, -1, -1):
            here = self.level[new] >= layer
            ids, dist = self._beam(q, qn, at, layer, self.ef if here.any() else 1)
            if here.any():
                self._link(new[here], self._diverse(new[here], ids[here], dist[here], self.m), layer)
            at = ids[:, :1]

    def search(self, q: np.ndarray, ef: int) -> np.ndarray:
        """Ids of up to ef points for each query, nearest first, -1 where fewer were found."""
        if self.entry < 0:
            return np.full((len(q), 0), -1, np.int64)
        q = np.clip((q - self.origin) / self.scale, -1e15, 1e15).astype(np.float32)
        qn = np.einsum("nd,nd->n", q, q)
        at = np.full((len(q), 1), self.entry, np.int64)
        for layer in range(len(self.layers) - 1, 0, -1):
            at = self._beam(q, qn, at, layer, 1)[0]
        return self._beam(q, qn, at, 0, ef)[0]


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>): vectors null, zero, empty, or holding null or non-finite components are left out."""
    v = F.col("embedding")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return vectors.where(fine & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("v"))


def matrix(t: pa.Table, width: int | None = None) -> np.ndarray:
    """The vectors v of t as rows, shorter ones filled up with zeros to width, or to the longest."""
    col = t.column("v").combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks)
    flat_, size = col.flatten().to_numpy(zero_copy_only=False), np.diff(col.offsets.to_numpy())
    width = width or int(size.max(initial=0))
    out = np.zeros((len(col), width))
    out[np.repeat(np.arange(len(col)), size), flat(np.zeros(len(col), np.int64), size)] = flat_
    return out


def build(vectors: DataFrame, shards: int, width: int, m: int = 16, ef: int = 40, keep: int = 11) -> DataFrame:
    """The index: (shard, graph binary), one row a shard, written to the shared folder. A shard's graph is over its
    distinct vectors; of equal vectors the keep smallest vec_ids are held, which are all that k < keep neighbours can need."""

    def run(t: pa.Table) -> pa.Table:
        points, first, which = np.unique(matrix(t, width), axis=0, return_index=True, return_inverse=True)
        ids = t.column("vec_id").to_numpy()
        order = np.lexsort((ids, which.ravel()))
        which = which.ravel()[order]
        heads = np.flatnonzero(np.r_[True, which[1:] != which[:-1]])
        place = np.arange(len(which)) - np.repeat(heads, np.diff(np.r_[heads, len(which)]))
        use = place < keep
        g = Graph(points, m, ef)
        out = io.BytesIO()
        np.savez(out, points=points, entry=g.entry, ids=ids[order][use], node=which[use], layers=len(g.layers), **{f"layer{k}": x for k, x in enumerate(g.layers)})
        return pa.table({"shard": pa.array([t.column("shard")[0].as_py()], pa.int32()), "graph": pa.array([out.getvalue()], pa.binary())})

    own = vectors.select(F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int").alias("shard"), "vec_id", "v")
    return stored(placed(own, "shard", shards).groupBy("shard").applyInArrow(run, "shard int, graph binary"), "hnsw")


def _load(raw: bytes) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray]:
    z = np.load(io.BytesIO(raw))
    points = z["points"]
    g = Graph(np.zeros((0, points.shape[1])))
    g.origin, g.scale = _frame(points)
    g.points = np.ascontiguousarray((points - g.origin) / g.scale, np.float32)
    g.norms = np.einsum("nd,nd->n", g.points, g.points)
    g.entry = int(z["entry"])
    g.layers = [z[f"layer{k}"] for k in range(int(z["layers"]))]
    return g, points, z["ids"], z["node"]


def to_cells(queries: DataFrame, index: DataFrame, shards: int, blocks: int) -> tuple[GroupedData, GroupedData]:
    """queries (block, ...) and index (shard, ...), each block to every shard and each shard to every block, by cell: one
    block and one shard, a task's work."""
    every = lambda most: F.explode(F.sequence(F.lit(0), F.lit(most - 1)))
    cell = (F.col("shard") * F.lit(blocks) + F.col("block")).cast("int").alias("cell")
    asked = queries.select(every(shards).alias("shard"), "*").select(cell, "*").drop("shard", "block")
    held = index.select(every(blocks).alias("block"), "*").select(cell, "*").drop("shard", "block")
    return placed(asked, "cell", shards * blocks).groupBy("cell"), placed(held, "cell", shards * blocks).groupBy("cell")


def _hits(raw: bytes, q: np.ndarray, own: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, vec_ids, distances) of the k nearest found of each of q in one graph, scored anew on the vectors."""
    g, points, ids, node = _load(raw)
    first = np.searchsorted(node, np.arange(len(points)))
    held = np.diff(np.r_[first, len(node)])
    out = []
    for i in range(0, len(q), 512):
        near = g.search(q[i : i + 512], max(ef, k + 1))
        r, c = np.nonzero(near >= 0)
        at = near[r, c]
        exact = np.sqrt(((q[i + r] - points[at]) ** 2).sum(axis=1))
        size = held[at]
        cand = ids[flat(first[at], size)]
        row, d = np.repeat(i + r, size), np.repeat(exact, size)
        ok = cand != own[row]
        row, d, cand = row[ok], d[ok], cand[ok]
        order = np.lexsort((cand, d, row))
        row, d, cand = row[order], d[order], cand[order]
        heads = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
        top = np.arange(len(row)) - np.repeat(heads, np.diff(np.r_[heads, len(row)])) < k
        out.append((own[row[top]], cand[top], d[top]))
    join = lambda j, t: np.concatenate([x[j] for x in out]).astype(t) if out else np.zeros(0, t)
    return join(0, np.int64), join(1, np.int64), join(2, np.float64)


def nearest(
    vectors: DataFrame,
    k: int = 10,
    every: int = 100,
    shard_bytes: int = 8 << 20,
    block_rows: int = 65536,
    m: int = 16,
    ef_build: int = 40,
    ef: int = 96,
    shard_rows: int | None = None,
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by every, the k nearest found among all other
    rows, by Euclidean distance in double precision, ties to the smaller vec_id; all candidates, if fewer.

    Rows are dealt by hash into shards of at most about shard_bytes (or shard_rows rows), each with a graph of its own;
    queries into blocks of about block_rows. A task holds one shard's graph and one block; the shards' k nearest are merged.
    What the graphs return is scored anew on the original vectors. Left out: null vec_ids, and vectors that are null, zero,
    empty or hold null or non-finite components. Shorter vectors count as filled up with zeros. Rows that repeat both id and
    vector are one candidate; an id with several vectors has a candidate for each, and as a query a search for each, whose
    results share one list of k. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = cut(usable(vectors).dropDuplicates(["vec_id", "v"]))
    n, asked, width = rows.agg(F.count("*"), F.count(F.when(F.col("vec_id") % every == 0, 1)), F.max(F.size("v"))).first()
    shards = dealt(spark, n, shard_rows or max(1024, shard_bytes // (8 * max(1, width or 1))), 4096)
    blocks = max(1, -(-asked // block_rows))
    index = build(rows, shards, width, m, ef_build, k + 1)
    queries = rows.where(F.col("vec_id") % every == 0).select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), "vec_id", "v")
    queries, graphs = to_cells(queries, index, shards, blocks)

    def run(asked: pa.Table, graphs: pa.Table) -> pa.Table:
        cols = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if asked.num_rows and graphs.num_rows:
            cols = _hits(graphs.column("graph")[0].as_py(), matrix(asked, width), asked.column("vec_id").to_numpy(), k, ef)
        return pa.Table.from_arrays([pa.array(c) for c in cols], names=["query_id", "vec_id", "score"])

    found = queries.cogroup(graphs).applyInArrow(run, "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5(spark, sf_dir: str) -> DataFrame:
    """The 10 nearest found of each query of embeddings."""
    return nearest(table(spark, sf_dir, "embeddings"))
