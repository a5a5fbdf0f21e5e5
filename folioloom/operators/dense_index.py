"""An index for dense search: inverted lists under trained centroids, product-quantised residuals, exact rescoring.

Vectors are brought to unit length. Coarse centroids and, for what is left of a vector without its centroid, codebooks of its
parts are trained on a bounded sample; every vector then goes to the list of its nearest centroid as a code of one byte a part, and
with it the length of what the code misses. A search reads only the lists that its questions probe. There a code gives a
cosine and, by that length, bounds below and above it: a row whose upper bound is under the k-th lower bound can't be among the
k best. The rest, few, are scored with their own vectors; where bounds tell little, all of the probed lists is, without moving a row.
So what is found in the probed lists is exact, and with all lists probed the result is dense_top_k()'s.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as t

from folioloom.operators.retrieval import _cosines, _matrix, _ranked
from folioloom.sources import versions

#: Rows that centroids and codebooks are trained on at most, and rounds of training.
SAMPLE_ROWS, ROUNDS = 20_000, 12
#: Questions that a task holds at once; more are asked in blocks, one after another.
QUERY_BLOCK = 2_000
CODES = 256
#: Pairs of a question and a row that a block of questions may leave to be scored, for these rows to be looked up; where bounds leave more,
#: tasks score the probed lists where they lie.
DUE_ROWS = 100_000
#: The list of rows that have another width or no length: they are few, always probed, and scored as they are.
ODD = -1


def kmeans(rows: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """At most k centroids of rows, ties to the first; an empty one moves to the row that is worst off."""
    rng = np.random.default_rng(seed)
    if len(rows) <= k:
        return rows.copy()
    centres = rows[rng.choice(len(rows), k, replace=False)].copy()
    for _ in range(rounds):
        near, gap = nearest(rows, centres)
        size = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)
        empty = np.flatnonzero(size == 0)
        if len(empty):
            centres[empty] = rows[np.argsort(-gap, kind="stable")[: len(empty)]]
    return centres


def nearest(rows: np.ndarray, centres: np.ndarray, block: int = 4_096) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row and the squared distance to it."""
    near, gap = np.zeros(len(rows), np.int64), np.zeros(len(rows))
    own = (centres**2).sum(axis=1)
    for i in range(0, len(rows), block):
        part = rows[i : i + block]
        d = own[None, :] - 2 * part @ centres.T
        near[i : i + block] = d.argmin(axis=1)
        gap[i : i + block] = np.maximum(0.0, d.min(axis=1) + (part**2).sum(axis=1))
    return near, gap


@dataclass(frozen=True)
class Coder:
    """centroids: lists x width; books: parts x codes x width of a part."""

    centroids: np.ndarray
    books: list[np.ndarray]
    edges: list[int]

    @property
    def width(self) -> int:
        return self.centroids.shape[1]

    @classmethod
    def fit(cls, rows: np.ndarray, lists: int, parts: int) -> Coder:
        centroids = kmeans(rows, lists)
        rest = rows - centroids[nearest(rows, centroids)[0]]
        edges = [round(i * rows.shape[1] / parts) for i in range(parts + 1)]
        return cls(centroids, [kmeans(rest[:, a:b], CODES, seed=11 + i) for i, (a, b) in enumerate(zip(edges, edges[1:]))], edges)

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, codes, length of what the code misses) of each row of unit length."""
        near, _ = nearest(rows, self.centroids)
        rest = rows - self.centroids[near]
        codes = np.empty((len(rows), len(self.books)), np.uint8)
        missed = np.zeros(len(rows))
        for i, book in enumerate(self.books):
            code, gap = nearest(rest[:, self.edges[i] : self.edges[i + 1]], book)
            codes[:, i] = code
            missed += gap
        return near, codes, np.sqrt(missed)

    def cosines(self, q: np.ndarray, own: int, codes: np.ndarray) -> np.ndarray:
        """Of questions of unit length with the coded rows of one list: questions x rows."""
        out = np.repeat((q @ self.centroids[own])[:, None], len(codes), axis=1)
        for i, book in enumerate(self.books):
            out += (q[:, self.edges[i] : self.edges[i + 1]] @ book.T)[:, codes[:, i]]
        return out

    def probed(self, q: np.ndarray, probes: int) -> np.ndarray:
        """The lists of the highest cosines, questions x probes."""
        return np.argsort(-(q @ self.centroids.T), axis=1, kind="stable")[:, : min(probes, len(self.centroids))]

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, self.centroids, np.array(self.edges), *self.books)
        return out.getvalue()

    @classmethod
    def of(cls, raw: bytes) -> Coder:
        held = np.load(io.BytesIO(raw))
        centroids, edges, *books = [held[f"arr_{i}"] for i in range(len(held.files))]
        return cls(centroids, books, edges.tolist())


def _units(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norm = np.sqrt((rows**2).sum(axis=1))
    return rows / np.where(norm > 0, norm, 1.0)[:, None], norm


class Lists(versions.Table):
    """The index at a path: a version's buckets are its lists, so a list is a Parquet partition."""

    def __init__(self, spark: SparkSession, path: str, key: str = "document_id"):
        super().__init__(spark, path, key)

    def place(self, many: int):
        return F.col("list")

    def coder(self, v: versions.Version) -> Coder:
        return Coder.of(self._bytes(v.facts["coder"]))

    def encoded(self, rows: DataFrame, coder: Coder) -> DataFrame:
        """rows (chunk_id, ord, embedding, key) with list, code and missed; rows without an embedding are left out."""
        import pyarrow as pa

        own = rows.where("embedding is not null").select("chunk_id", F.col("ord").cast("long").alias("ord"), F.col("embedding").cast("array<double>").alias("embedding"), self.key)
        schema = t.StructType([*own.schema.fields, t.StructField("list", t.IntegerType()), t.StructField("code", t.BinaryType()), t.StructField("missed", t.DoubleType())])

        def run(batches: Iterator) -> Iterator:
            for b in batches:
                column = pa.chunked_array([b.column(2)])
                size = np.diff(b.column(2).offsets.to_numpy())
                m, _ = _matrix(column, max(coder.width, int(size.max(initial=0))))
                unit, norm = _units(m[:, : coder.width])
                near, codes, missed = coder.encode(unit)
                odd = (size != coder.width) | (norm == 0) | ~np.isfinite(norm)
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, pa.array(np.where(odd, ODD, near).astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(np.where(odd, 0.0, missed))], names=schema.names
                )

        return own.mapInArrow(run, schema)

    def build(self, rows: DataFrame, lists: int | None = None, parts: int = 8, sample_rows: int = SAMPLE_ROWS) -> versions.Version:
        """A new version of rows (chunk_id, ord, embedding, key) alone. lists: about the square root of their number if none is given;
        the sample is one by a hash of chunk_id, sample_rows at most, of the commonest width."""
        known = rows.where("size(embedding) > 0")
        n = known.count()
        share = min(1.0, 2 * sample_rows / max(n, 1))
        drawn = known.where(F.pmod(F.xxhash64("chunk_id", F.lit(3)), F.lit(1 << 20)) < int(share * (1 << 20))).select(F.col("embedding").cast("array<double>").alias("e")).limit(sample_rows)
        vectors = [r.e for r in drawn.collect()]  # sample_rows at most
        width = max(set(map(len, vectors)), key=[len(v) for v in vectors].count) if vectors else 1
        sample, norm = _units(np.nan_to_num(np.array([v for v in vectors if len(v) == width], float).reshape(-1, width)))
        sample = sample[norm > 0] if (norm > 0).any() else np.ones((1, width)) / np.sqrt(width)
        coder = Coder.fit(sample, lists or max(1, round(n**0.5)), min(parts, width))
        old, coded, name = self.version(), self.encoded(rows, coder), f"coder-{uuid.uuid4().hex}.npz"
        self._put(name, coder.to_bytes())
        _, lists_ = self._written(coded, F.col("list"))
        return self._commit(versions.Version((old.number if old else 0) + 1, len(coder.centroids), coded.schema.json(), lists_, {"coder": name}))

    def write(self, rows: DataFrame, facts: dict | None = None) -> versions.Version:
        return self.build(rows)

    def replace(self, rows: DataFrame, facts: dict | None = None) -> versions.Version:
        """A version in which the keys of rows have these rows; centroids and codebooks stay. Lists that have neither old nor new rows of
        these keys stay as they are: which have is found by their key column alone."""
        old = self.version()
        return self.build(rows) if old is None else self._changed(old, rows.select(self.key).distinct(), self.encoded(rows, self.coder(old)))

    def remove(self, keys: DataFrame) -> versions.Version | None:
        old = self.version()
        return None if old is None else self._changed(old, keys.select(self.key).distinct(), None)

    def _changed(self, old: versions.Version, keys: DataFrame, coded: DataFrame | None) -> versions.Version:
        held = self._rows(old).select("list", self.key).join(keys, self.key, "left_semi").select("list")
        touched = [r.list for r in (held if coded is None else held.unionByName(coded.select("list"))).distinct().collect()]  # lists at most
        kept = self._rows(old, touched).join(keys, self.key, "left_anti").select(t.StructType.fromJson(json.loads(old.schema)).names)
        _, new = self._written(kept if coded is None else kept.unionByName(coded), F.col("list"))
        return self._commit(versions.Version(old.number + 1, old.many, old.schema, {b: x for b, x in old.buckets.items() if b not in touched} | new, old.facts))

    def search(self, queries: DataFrame, k: int, probes: int | None = None, number: int | None = None) -> DataFrame:
        """query_id, rank, chunk_id, score: the k highest cosines of each query (query_id, q) with the rows of its probes nearest lists
        (of all, if None), ties in the order of ord; queries without a q are left out."""
        v = self.version(number)
        kind = queries.schema["query_id"].dataType.simpleString()
        if v is None:
            raise FileNotFoundError(self.path)
        name = t.StructType.fromJson(json.loads(v.schema))["chunk_id"].dataType.simpleString()
        asked = queries.where("q is not null").select("query_id", F.col("q").cast("array<double>").alias("q"))
        blocks = max(1, -(-asked.count() // QUERY_BLOCK))
        found = self.spark.createDataFrame([], f"query_id {kind}, chunk_id {name}, ord long, score double")
        for b in range(blocks):
            own = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
            rows = own.collect()  # QUERY_BLOCK, about
            if rows:
                found = found.unionByName(self._block(v, rows, k, probes, kind, name))
        return _ranked(found, F.desc("score"), F.col("ord")).where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score")

    def plan(self, queries: list[list[float]], probes: int, number: int | None = None) -> list[int]:
        """The lists that a search for these vectors reads."""
        v = self.version(number)
        coder = self.coder(v)
        wide = np.array([list(q)[: coder.width] + [0.0] * (coder.width - len(q)) for q in queries])
        return sorted(({int(x) for x in coder.probed(_units(wide)[0], probes).ravel()} | {ODD}) & set(v.buckets))

    def _block(self, v: versions.Version, rows: list, k: int, probes: int | None, kind: str, name: str) -> DataFrame:
        import pyarrow as pa

        coder = self.coder(v)
        width = max(coder.width, *(len(r.q) for r in rows))
        vectors, size = _matrix(pa.chunked_array([pa.array([r.q for r in rows], pa.list_(pa.float64()))]), width)
        unit, norm = _units(vectors[:, : coder.width])
        plain = (size == coder.width) & (norm > 0)  # others have every list's rows scored as they are
        probed = coder.probed(unit, probes or len(coder.centroids))
        of_list: dict[int, list[int]] = {ODD: list(range(len(rows)))}
        for i in range(len(rows)):
            for own in probed[i] if plain[i] else range(len(coder.centroids)):
                of_list.setdefault(int(own), []).append(i)
        lists = sorted(set(of_list) & set(v.buckets))
        shared = self.spark.sparkContext.broadcast((coder, vectors, size, unit, plain, of_list, [r.query_id for r in rows]))

        def bounded(batches: Iterator) -> Iterator:
            """(batch, list, places in it, questions, cosines by the codes, what these miss) of plain questions, 64 at a time; questions
            without bounds come with None."""
            coder, _, _, unit, plain, of_list, _ = shared.value
            for b in batches:
                own = b.column(0).to_numpy()
                codes = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(len(own), -1)
                missed = b.column(3).to_numpy()
                for one in np.unique(own):
                    at, asks = np.flatnonzero(own == one), np.array(of_list.get(int(one), []), np.int64)
                    sure = np.zeros(0, np.int64) if one == ODD else asks[plain[asks]]
                    for i in range(0, len(sure), 64):
                        yield b, one, at, sure[i : i + 64], coder.cosines(unit[sure[i : i + 64]], int(one), codes[at]), missed[at] + 1e-9
                    if len(rest := np.setdiff1d(asks, sure)):
                        yield b, one, at, rest, None, None

        def floors(batches: Iterator) -> Iterator:
            """The k highest lower bounds of each question in a task."""
            best = np.full((len(shared.value[3]), k), -np.inf)
            for _, _, _, part, c, gap in bounded(batches):
                if c is not None:
                    both = np.concatenate([best[part], c - gap], axis=1)
                    best[part] = np.partition(both, -k, axis=1)[:, -k:]
            i, j = np.nonzero(np.isfinite(best))
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(best[i, j])], names=["i", "low"])

        def due_pairs(batches: Iterator) -> Iterator:
            for b, one, at, part, c, gap in bounded(batches):
                r, col = np.nonzero(c + gap >= floor.value[part][:, None]) if c is not None else np.indices((len(part), len(at))).reshape(2, -1)
                yield b, one, part[r], at[col]

        def counted(batches: Iterator) -> Iterator:
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(q) for _, _, q, _ in due_pairs(batches))], pa.int64())], names=["n"])

        def candidates(batches: Iterator) -> Iterator:
            for b, one, q, at in due_pairs(batches):
                yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(np.full(len(q), one, np.int32)), b.column(1).take(pa.array(at))], names=["i", "list", "chunk_id"])

        def rescored(batches: Iterator) -> Iterator:
            _, vectors, size, _, _, _, ids = shared.value
            for b in batches:
                i = b.column(0).to_numpy()
                m, m_size = _matrix(pa.chunked_array([b.column(3)]), max(vectors.shape[1], int(np.diff(b.column(3).offsets.to_numpy()).max(initial=0))))
                out = np.zeros(len(i))
                for one in np.unique(i):
                    at = np.flatnonzero(i == one)
                    q = np.pad(vectors[one : one + 1], ((0, 0), (0, m.shape[1] - vectors.shape[1])))
                    out[at] = _cosines(q, size[one : one + 1], m[at], m_size[at])[0]
                yield pa.RecordBatch.from_arrays([pa.array([ids[x] for x in i], types["query_id"]), b.column(1), b.column(2), pa.array(out)], names=["query_id", "chunk_id", "ord", "score"])

        def scanned(batches: Iterator) -> Iterator:
            """The k best rows of each question in a task, by the vectors, of rows (list, chunk_id, ord, embedding)."""
            _, vectors, size, _, _, of_list, ids = shared.value
            low = np.where(np.isfinite(floor.value), floor.value - 1e-9, -np.inf)
            held = pa.table({"i": pa.array([], pa.int64()), "chunk_id": pa.array([], types["chunk_id"]), "ord": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

            def best(parts: list) -> pa.Table:
                both = pa.concat_tables(parts).combine_chunks()
                i, order, score = (both.column(c).to_numpy() for c in ("i", "ord", "score"))
                by = np.lexsort((order, -score, i))
                first = np.r_[True, i[by][1:] != i[by][:-1]] if len(by) else np.zeros(0, bool)
                place = np.arange(len(by)) - np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))
                return both.take(pa.array(by[place < k]))

            new, waiting = [], 0
            for b in batches:
                own = b.column(0).to_numpy()
                m, m_size = _matrix(pa.chunked_array([b.column(3)]), max(vectors.shape[1], int(np.diff(b.column(3).offsets.to_numpy()).max(initial=0))))
                wide = np.pad(vectors, ((0, 0), (0, m.shape[1] - vectors.shape[1])))
                for one in np.unique(own):
                    at, asks = np.flatnonzero(own == one), np.array(of_list.get(int(one), []), np.int64)
                    for j in range(0, len(asks), 256):
                        part = asks[j : j + 256]
                        c = _cosines(wide[part], size[part], m[at], m_size[at])
                        least = np.partition(c, -k, axis=1)[:, -k] if c.shape[1] > k else np.full(len(part), -np.inf)
                        r, col = np.nonzero(c >= np.maximum(least, low[part])[:, None])
                        rows_ = pa.array(at[col])
                        new.append(pa.table({"i": pa.array(part[r]), "chunk_id": b.column(1).take(rows_), "ord": b.column(2).take(rows_), "score": pa.array(c[r, col])}))
                        waiting += len(r)
                        if waiting > 4 * k * len(ids) + 100_000:
                            held, new, waiting = best([held, *new]), [], 0
            held = best([held, *new])
            i = held.column("i").to_numpy()
            yield from pa.table({"query_id": pa.array([ids[x] for x in i], types["query_id"]), **{c: held.column(c) for c in ("chunk_id", "ord", "score")}}).to_batches()

        from pyspark.sql.pandas.types import to_arrow_type

        types = {"query_id": to_arrow_type(t.StructType.fromDDL(f"query_id {kind}")["query_id"].dataType), "chunk_id": to_arrow_type(t.StructType.fromDDL(f"chunk_id {name}")["chunk_id"].dataType)}
        held, out = self._rows(v, lists), f"query_id {kind}, chunk_id {name}, ord long, score double"
        codes = held.select("list", "chunk_id", "code", "missed")
        lows = codes.mapInArrow(floors, "i int, low double").withColumn("n", F.row_number().over(W.partitionBy("i").orderBy(F.desc("low"))))
        found = np.full(len(rows), -np.inf)
        for r in lows.where(F.col("n") == k).select("i", "low").collect():  # a row a question
            found[r.i] = r.low
        floor = self.spark.sparkContext.broadcast(found)
        if (codes.mapInArrow(counted, "n long").agg(F.sum("n")).first()[0] or 0) > DUE_ROWS:
            return held.select("list", "chunk_id", "ord", "embedding").mapInArrow(scanned, out)
        due = codes.mapInArrow(candidates, f"i int, list int, chunk_id {name}").distinct()
        full = held.select("list", "chunk_id", "ord", "embedding").join(F.broadcast(due), ["list", "chunk_id"]).select("i", "chunk_id", "ord", "embedding")
        return full.mapInArrow(rescored, out)


def unclustered(v: versions.Version) -> int:
    """Rows that no list's code stands for."""
    return v.buckets.get(ODD, ("", 0))[1]
