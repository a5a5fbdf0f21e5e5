"""Ranked lexical search over a clustered index: documents in the order of a recursive graph bisection, visited by bounds.

A bisection of sampled documents deals all documents into clusters, clusters too large for a task into shards; in each shard the
bisection goes on over its own documents down to blocks of BLOCK. A question's score in a block, or a shard, is at most the sum of its
terms' weights times their largest impacts there. Shards are visited in waves, the highest bounds first, blocks within a shard one
after another; a shard or block whose bound is below the question's k-th score so far can't change the result, and is not visited.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioloom.llm import bisection, utf8
from folioloom.llm.cluster import placed, small_batches, stored, table

#: Documents that the clusters are fitted on at most.
SAMPLE_DOCS = 4_096
#: Sampled documents of a cluster, about; distinct terms of the documents of a shard, taken together, and documents of it, both about
#: and at most; documents of a cluster at least; documents of a block.
CLUSTER_SAMPLE, SHARD_TERMS, SHARD_DOCS, LEAST_DOCS, BLOCK = 64, 1_000_000, 32_768, 512, 16
#: Items and terms of items that a task holds at once: more are asked in blocks, one after another.
ITEMS, ITEM_TERMS = 1_024, 200_000
#: Shards that each item visits first, those of the highest bounds; of the others, all whose bounds reach the k-th score then.
FIRST = 4

_BETWEEN = np.ones(256, bool)
_BETWEEN[list(range(48, 58)) + list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = False


def _terms(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, hashes, counts, lengths): the distinct terms of each text, texts one after another, sorted within a text, and how many
    terms it has with repeats. A term is a run of ASCII letters and digits and of anything that isn't ASCII, A-Z lower-cased."""
    starts, ends, n = utf8.words(buf, offsets, _BETWEEN)
    found = utf8.hashes(utf8.LOWER[buf], starts, ends)
    text = np.repeat(np.arange(len(n)), n)
    by = np.lexsort((found, text))
    found, text = found[by], text[by]
    first = np.flatnonzero(np.r_[True, (found[1:] != found[:-1]) | (text[1:] != text[:-1])]) if len(found) else np.zeros(0, np.int64)
    counts = np.diff(np.r_[first, len(found)])
    return np.searchsorted(text[first], np.arange(len(n) + 1)), found[first], counts, n


def _each(batch: pa.RecordBatch, name: str) -> Iterator[tuple[int, int, tuple]]:
    buf, offsets = utf8.column(batch, name)
    for i, j in utf8.chunks(offsets):
        yield i, j, _terms(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def fit_clusters(docs: DataFrame, sample_docs: int, depth: int) -> tuple[bisection.Router, np.ndarray]:
    """The router of at most sample_docs documents (text), and how many terms and documents of them it sends to each cluster; one task
    bisects them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for b in batches:
            for _, _, (starts, found, _, _) in _each(b, "text"):
                size.append(np.diff(starts))
                hashes.append(found)
        sizes = np.concatenate(size)
        got = bisection.fit_router(np.concatenate([[0], np.cumsum(sizes)]), np.concatenate(hashes), depth)
        yield pa.record_batch([pa.array([pickle.dumps(got)], pa.large_binary())], names=["router"])

    (row,) = small_batches(docs).limit(sample_docs).repartition(1).mapInArrow(run, "router binary").collect()
    return pickle.loads(row.router)


@dataclass(frozen=True)
class Index:
    """shards: shard, ids, lengths (int64), vocabulary (sorted uint64), starts (int64), spots (uint16: where a document is in the order),
    counts (uint32) of a row a shard."""

    shards: DataFrame
    block: int


def build(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, shard_terms: int = SHARD_TERMS, shard_docs: int = SHARD_DOCS, least_docs: int = LEAST_DOCS, block: int = BLOCK) -> Index:
    """The index of all documents (id, text) that have a term. Repeated rows are as many documents; a null id is kept. Shards are dealt
    by the shares of clusters in the sample, so that a cluster of any size lies in as many as it needs."""
    spark = docs.sparkSession
    total, kind = docs.count(), docs.schema["id"].dataType.simpleString()
    row = f"shard int, ids array<{kind}>, lengths binary, vocabulary binary, starts binary, spots binary, counts binary"
    if not total:
        return Index(spark.createDataFrame([], row), block)
    depth = max(0, min(int(math.log2(max(1, min(sample_docs, total) // CLUSTER_SAMPLE))), int(math.log2(max(1, total // least_docs)))))
    share = min(1.0, 2.0 * sample_docs / max(1, total))
    chosen = docs.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30)) < int(share * (1 << 30))).select("text")
    router, sizes = fit_clusters(chosen, sample_docs, depth)
    scale = total / max(1.0, sizes[1].sum())
    many = np.maximum(1, np.ceil((sizes * scale / np.array([[shard_terms], [shard_docs]])).max(axis=0))).astype(np.int64)
    base = np.concatenate([[0], np.cumsum(many)])
    shared = spark.sparkContext.broadcast((router, many, base))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router, many, base = shared.value
        turn = 0
        for b in batches:
            for i, j, (starts, found, counts, n) in _each(b, "text"):
                cluster = router.clusters(starts, found)
                shard = base[cluster] + (np.arange(turn, turn + len(n)) % many[cluster])
                turn += len(n)
                cut = lambda values: pa.array([values[s:e].tobytes() for s, e in zip(starts[:-1], starts[1:], strict=True)], pa.binary())  # noqa: B023, E731
                out = pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), b.column(0).slice(i, j - i), pa.array(n), cut(found), cut(counts.astype(np.uint32))], names=["shard", "id", "n", "terms", "counts"])
                yield out.filter(pa.array(n > 0))

    def index(t: pa.Table) -> pa.Table:
        utf8.trim()
        joined = lambda name, d: np.frombuffer(b"".join(t.column(name).to_pylist()), d)
        hashes, counts = joined("terms", np.uint64), joined("counts", np.uint32)
        size = np.array([len(x) // 4 for x in t.column("counts").to_pylist()])
        vocabulary, number = np.unique(hashes, return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(size)])
        whole = bisection.Pairs(starts, number, len(vocabulary))
        at = bisection.order(whole.of(np.arange(len(size))), block)
        spot = np.empty(len(at), np.int64)
        spot[at] = np.arange(len(at))
        where = np.repeat(spot, size)
        by = np.lexsort((where, number))
        edges = np.searchsorted(number[by], np.arange(len(vocabulary) + 1))
        ids = t.column("id").take(pa.array(at)).combine_chunks()
        made = {
            "shard": pa.array([t.column("shard")[0].as_py()], pa.int32()),
            "ids": pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids),
            "lengths": [t.column("n").to_numpy()[at].astype(np.int64).tobytes()],
            "vocabulary": [vocabulary.tobytes()],
            "starts": [edges.astype(np.int64).tobytes()],
            "spots": [where[by].astype(np.uint16 if len(at) < 1 << 16 else np.uint32).tobytes()],
            "counts": [counts[by].tobytes()],
        }
        return pa.table(made)

    dealt = small_batches(docs).select("id", "text").mapInArrow(deal, f"shard int, id {kind}, n long, terms binary, counts binary")
    shards = placed(dealt, "shard", int(base[-1])).groupBy("shard").applyInArrow(index, row)
    return Index(stored(shards, "lexical-index"), block)


@dataclass(frozen=True)
class Asked:
    """terms: sorted hashes; weights of them; items: for each item the places of its terms; n, length: N and L of the corpus."""

    terms: np.ndarray
    weights: np.ndarray
    items: list[np.ndarray]
    n: int
    length: int
    k: int


class Shard:
    """A row of the index and what some items ask of it: the postings of the asked terms that it has, with their impacts, and each such
    term's blocks."""

    def __init__(self, row: dict, asked: Asked, block: int):
        self.asked, self.block = asked, block
        vocabulary, starts = np.frombuffer(row["vocabulary"], np.uint64), np.frombuffer(row["starts"], np.int64)
        at = np.minimum(np.searchsorted(vocabulary, asked.terms), max(0, len(vocabulary) - 1))
        self.has = vocabulary[at] == asked.terms if len(vocabulary) else np.zeros(len(asked.terms), bool)
        own = at[self.has]
        size = starts[own + 1] - starts[own]
        pick = utf8.flat(starts[own], size)
        lengths = np.frombuffer(row["lengths"], np.int64)
        spots = np.frombuffer(row["spots"], np.uint16 if len(lengths) < 1 << 16 else np.uint32)
        self.spots = spots[pick].astype(np.int64)
        tf = np.frombuffer(row["counts"], np.uint32)[pick].astype(np.int64)
        wide = 50 * int(lengths.max(initial=0)) * asked.n >= 1 << 63
        m = (50 + (50 * lengths.astype(object if wide else np.int64) * asked.n) // asked.length).astype(np.int64)
        self.impact = (1_000_000_000 * tf) // (1_000 * tf + 20 * m[self.spots])
        term = np.repeat(np.flatnonzero(self.has), size)
        where = self.spots // block
        self.first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (where[1:] != where[:-1])]) if len(term) else np.zeros(0, np.int64)
        self.size = np.diff(np.r_[self.first, len(term)])
        self.blocks = where[self.first]
        self.best = np.maximum.reduceat(self.impact, self.first) if len(self.first) else np.zeros(0, np.int64)
        self.edges = np.searchsorted(term[self.first], np.arange(len(asked.terms) + 1))
        self.n_blocks = -(-len(lengths) // block)

    def bound(self, item: int) -> int:
        """The most that any document of the shard can score."""
        own = self.asked.items[item]
        own = own[self.has[own]]
        return int(sum(int(self.asked.weights[t]) * int(self.best[self.edges[t] : self.edges[t + 1]].max()) for t in own))

    def search(self, item: int, least: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(spots, scores, blocks visited) of the documents that can be among the k best and score least or more."""
        own = self.asked.items[item]
        own = own[self.has[own]]
        entry = utf8.flat(self.edges[own], self.edges[own + 1] - self.edges[own])
        weight = np.repeat(self.asked.weights[own], self.edges[own + 1] - self.edges[own])
        bounds = np.bincount(self.blocks[entry], weights=weight * self.best[entry], minlength=self.n_blocks).astype(np.int64)  # whole numbers below 2^53
        by = np.argsort(-bounds, kind="stable")
        by = by[bounds[by] > 0]
        k, done, batch, floor = self.asked.k, 0, 4, max(1, least)
        spots, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while done < len(by) and bounds[by[done]] >= floor:
            chosen = np.zeros(self.n_blocks, bool)
            chosen[by[done : done + batch]] = True
            e = chosen[self.blocks[entry]]
            hit, w = entry[e], weight[e]
            p = utf8.flat(self.first[hit], self.size[hit])
            parts = self.impact[p] * np.repeat(w, self.size[hit])
            found, inverse = np.unique(self.spots[p], return_inverse=True)
            total = np.zeros(len(found), np.int64)
            np.add.at(total, inverse, parts)
            spots, scores = np.concatenate([spots, found]), np.concatenate([scores, total])
            done = min(len(by), done + batch)
            if len(scores) >= k:
                floor = max(floor, int(np.partition(scores, -k)[-k]))
                spots, scores = spots[scores >= floor], scores[scores >= floor]
            batch *= 2
        keep = scores >= floor
        return spots[keep], scores[keep], done


def _items(items: DataFrame) -> DataFrame:
    """(item_id, term): the distinct terms of each item (item_id, text); rows of one item are put together, without terms there's none."""
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, (starts, found, _, _) in _each(b, "text"):
                at = pa.array(np.repeat(np.arange(i, j), np.diff(starts)))
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array(found.view(np.int64))], names=["item_id", "term"])

    return small_batches(items).select("item_id", "text").mapInArrow(run, f"item_id {kind}, term long").distinct()


def _blocks(items: DataFrame) -> DataFrame:
    """(q, block, item_id, terms): numbered items, in blocks of at most ITEMS and about ITEM_TERMS."""
    rows = items.groupBy("item_id").agg(F.collect_set("term").alias("terms"))
    numbered = stored(rows.withColumn("q", F.monotonically_increasing_id()), "lexical-items")
    terms, n = numbered.agg(F.sum(F.size("terms")), F.count("*")).first()
    many = max(1, -(-int(n or 0) // ITEMS), -(-int(terms or 0) // ITEM_TERMS))
    return numbered.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(many)))


def _statistics(index: Index, terms: np.ndarray) -> tuple[int, int, np.ndarray]:
    """N, L and the document frequencies of terms; of the index only lengths, vocabulary and starts are read."""
    held = index.shards.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want = held.value
        df, n, length = np.zeros(len(want), np.int64), 0, 0
        for b in batches:
            for r in b.to_pylist():
                lengths, vocabulary, starts = np.frombuffer(r["lengths"], np.int64), np.frombuffer(r["vocabulary"], np.uint64), np.frombuffer(r["starts"], np.int64)
                at = np.minimum(np.searchsorted(vocabulary, want), len(vocabulary) - 1)
                df += np.where(vocabulary[at] == want, starts[at + 1] - starts[at], 0)
                n, length = n + len(lengths), length + int(lengths.sum())
        some = np.flatnonzero(df)
        yield pa.record_batch([pa.array(np.r_[-2, -1, some]), pa.array(np.r_[n, length, df[some]])], names=["t", "n"])

    got = index.shards.select("lengths", "vocabulary", "starts").mapInArrow(run, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).collect()  # a row a term at most
    known = {r.t: r.n for r in got}
    df = np.array([known.get(t, 0) for t in range(len(terms))], np.int64)
    return known.get(-2, 0), known.get(-1, 0), df


def _search(index: Index, rows: list, k: int) -> tuple[DataFrame, DataFrame] | None:
    """((q, id, score), (q, shard, visited, blocks)) for one block of items."""
    spark, block = index.shards.sparkSession, index.block
    kind = index.shards.schema["ids"].dataType.elementType.simpleString()
    terms = np.unique(np.concatenate([np.array(r.terms, np.int64).view(np.uint64) for r in rows]))
    n, length, df = _statistics(index, terms)
    if not n:
        return None
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    q = [r.q for r in rows]
    asked = spark.sparkContext.broadcast(Asked(terms, weights, [np.searchsorted(terms, np.array(r.terms, np.int64).view(np.uint64)) for r in rows], n, length, k))
    place = spark.sparkContext.broadcast({x: i for i, x in enumerate(q)})

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                shard = Shard(r, asked.value, block)
                found = np.array([shard.bound(i) for i in range(len(asked.value.items))], np.int64)
                some = np.flatnonzero(found)
                yield pa.record_batch([pa.array(np.array(q)[some]), pa.array(np.full(len(some), r["shard"], np.int32)), pa.array(found[some])], names=["q", "shard", "bound"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            listed = b.column(b.schema.get_field_index("ids"))
            for at, r in enumerate(b.drop_columns(["ids"]).to_pylist()):
                utf8.trim()
                shard, ids = Shard(r, asked.value, block), listed.slice(at, 1).flatten()
                for want in r["due"]:
                    spots, scores, seen = shard.search(place.value[want["q"]], want["least"])
                    t = pa.table({"id": ids.take(pa.array(spots)), "score": pa.array(scores)}).sort_by([("score", "descending"), ("id", "ascending")]).slice(0, k)
                    m = t.num_rows
                    # the hits, then a row that says how many blocks were visited
                    hits = [pa.array([want["q"]] * (m + 1)), pa.array([r["shard"]] * (m + 1), pa.int32())]
                    hits += [pa.concat_arrays([*t.column(c).chunks, pa.nulls(1, t.column(c).type)]) for c in ("id", "score")]
                    hits += [pa.array([None] * m + [x], pa.int32()) for x in (seen, shard.n_blocks)]
                    yield pa.RecordBatch.from_arrays(hits, names=["q", "shard", "id", "score", "visited", "blocks"])

    columns = ["shard", "lengths", "vocabulary", "starts", "spots", "counts"]
    most = stored(index.shards.select(columns).mapInArrow(bounds, "q long, shard int, bound long"), "lexical-bounds")
    turn = F.row_number().over(W.partitionBy("q").orderBy(F.desc("bound"), "shard"))
    by_score = W.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id"))

    def wave(due: DataFrame, name: str) -> DataFrame:
        """What the shards of due (q, shard, least) have for their items; a shard's list is no longer than the block of items."""
        lists = due.groupBy("shard").agg(F.collect_list(F.struct("q", "least")).alias("due"))
        return stored(index.shards.join(lists, "shard").mapInArrow(visit, f"q long, shard int, id {kind}, score long, visited int, blocks int"), name)

    def ranked(found: DataFrame) -> DataFrame:
        rows = found.where("score is not null").select("q", "id", "score")
        return rows.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)

    placed_ = stored(most.withColumn("turn", turn), "lexical-turns")
    first = wave(placed_.where(F.col("turn") <= FIRST).select("q", "shard", F.lit(1).cast("long").alias("least")), "lexical-first")
    reached = ranked(first).where(F.col("rank") == k).select("q", F.col("score").alias("least"))
    due = placed_.where(F.col("turn") > FIRST).join(reached, "q", "left").withColumn("least", F.coalesce("least", F.lit(1).cast("long")))
    rest = wave(due.where(F.col("bound") >= F.col("least")).select("q", "shard", "least"), "lexical-rest")
    both = first.unionByName(rest)
    return ranked(both), both.where("score is null").select("q", "shard", "visited", "blocks")


def search(index: Index, items: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """((item_id, rank, id, score), (item_id, shard, visited, blocks)): the k documents of highest score above 0 for each of the items
    (item_id, text), all if there are fewer, equal scores by id, null ids last; and how many blocks of each visited shard were
    visited. Rows of one item_id are one item; an item without a term, or without a hit, has no row."""
    spark = items.sparkSession
    numbered = _blocks(_items(items))
    kinds = items.schema["item_id"].dataType.simpleString(), index.shards.schema["ids"].dataType.elementType.simpleString()
    hits = spark.createDataFrame([], f"q long, id {kinds[1]}, score long, rank int")
    seen = spark.createDataFrame([], "q long, shard int, visited int, blocks int")
    for (b,) in sorted(numbered.select("block").distinct().collect()):
        found = _search(index, numbered.where(F.col("block") == b).select("q", "terms").collect(), k)  # ITEMS and ITEM_TERMS, about
        if found:
            hits, seen = hits.unionByName(found[0]), seen.unionByName(found[1])
    names = numbered.select("q", "item_id")
    return hits.join(names, "q").select("item_id", "rank", "id", "score"), seen.join(names, "q").select("item_id", "shard", "visited", "blocks")


def op11(spark, sf_dir: str) -> DataFrame:
    """item_id, rank, doc_id, score: the 50 best documents of the whole table for each benchmark item."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    hits, _ = search(build(docs), table(spark, sf_dir, "benchmark"), 50)
    return hits.select("item_id", "rank", F.col("id").alias("doc_id"), "score")


_TERMS = r"regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{{80}}-\x{{10FFFF}}]+')"
OP11_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS.format('"text"')} AS t FROM documents),
  s AS (SELECT count(*) AS n, sum(len(t))::BIGINT AS l FROM d WHERE len(t) > 0),
  p AS (SELECT r, doc_id, len(t) AS n, term, count(*) AS tf FROM (SELECT r, doc_id, t, unnest(t) AS term FROM d) GROUP BY ALL),
  i AS (SELECT DISTINCT item_id, unnest({_TERMS.format('"text"')}) AS term FROM benchmark),
  w AS (SELECT term, floor(1000 * ln((2 * s.n + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p CROSS JOIN s GROUP BY term, s.n),
  h AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * p.n * s.n) // s.l))))::BIGINT AS score
        FROM i JOIN p USING (term) JOIN w USING (term) CROSS JOIN s GROUP BY ALL)
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM h WHERE score > 0
  QUALIFY rank <= 50"""
