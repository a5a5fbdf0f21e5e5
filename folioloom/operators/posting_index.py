"""A posting index that is kept: blocks of postings with what bounds their scores, segments for what is added or replaced.

A segment holds chunks and, for each term and range of RANGE chunks, a block: the places in the range of those that have the term,
its counts there, the largest count and the shortest length among them. (A range that two tasks read has two.) What a chunk is
called and how long it is stands in the table of chunks, not in every entry. Texts are shuffled once, when chunks are put in order;
what else is shuffled are blocks. An update writes one more segment, with the chunks of earlier ones that it makes void and what that takes off the
document frequencies; no text of an earlier segment is read for it. Versions are pointers to lists of segments, as in
sources.versions. A search reads the blocks of the asked terms alone: first what bounds each range's score, then the entries of
the best ranges, then of those others whose bound reaches the k-th score.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as t

from folioloom.functions import text as T
from folioloom.operators.retrieval import QUERY_BLOCK, _ranked
from folioloom.sources import versions

#: Chunks of a range, which are neighbours in their document's order.
RANGE = 256
#: Ranges that a question scores first; segments from which compact() is due.
FIRST, SEGMENTS = 4, 8


class Postings:
    """The index at a path. Rows: (chunk_id, ord, document_id, text); a document's chunks are replaced together."""

    def __init__(self, spark: SparkSession, path: str, chunks_per_bucket: int = 50_000):
        self.spark, self.path, self.chunks_per_bucket = spark, path.rstrip("/"), chunks_per_bucket
        self.pointer = versions.Table(spark, path)

    # ---- writing

    def build(self, rows: DataFrame) -> dict:
        """A version of these rows alone."""
        many = 1 << max(3, min(12, (rows.count() // self.chunks_per_bucket).bit_length()))
        return self._commit([], rows, many, None)

    def replace(self, rows: DataFrame) -> dict:
        """A version in which the documents of rows have these chunks, and all others what they had."""
        facts = self.facts()
        return self.build(rows) if facts is None else self._commit(facts["segments"], rows, facts["many"], rows.select("document_id"))

    def remove(self, documents: DataFrame) -> dict | None:
        """A version without the documents of documents (document_id)."""
        facts = self.facts()
        return None if facts is None else self._commit(facts["segments"], None, facts["many"], documents.select("document_id"))

    def facts(self, number: int | None = None) -> dict | None:
        """segments, many (buckets of terms), n (chunks) and length (their tokens) of a version."""
        v = self.pointer.version(number)
        return None if v is None else v.facts

    def _place(self, column: str, many: int) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(many)).cast("int").alias("bucket")

    def _commit(self, segments: list[str], rows: DataFrame | None, many: int, documents: DataFrame | None) -> dict:
        name = f"seg-{uuid.uuid4().hex}"
        n, length = (0, 0) if not segments else (self.facts()["n"], self.facts()["length"])
        deltas = []
        if documents is not None:
            wanted = documents.distinct()
            places = [r.bucket for r in wanted.select(self._place("document_id", many)).distinct().collect()]  # many at most
            old = self._live(segments, places).join(wanted, "document_id", "left_semi")
            self._write(old.select("chunk_id", "dl", "terms", "range", "place"), f"{name}/gone")
            gone = self._read([name], "gone")
            count = gone.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length")).first()
            n, length = n - count.n, length - count.length
            deltas.append(gone.select(F.explode("terms").alias("term"), F.lit(-1).alias("df")))
        if rows is not None:
            self._write(self._chunks(rows, name, many), f"{name}/chunks", "bucket", dealt=True)
            made = self._read([name], "chunks")
            if made is not None:
                self._write(self._blocks(made, many), f"{name}/blocks", "bucket", sort="term")
                held = self._read([name], "blocks")
                if held is not None:
                    deltas.append(held.select("term", F.size("places").alias("df")))
                count = made.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length")).first()
                n, length = n + count.n, length + count.length
        if deltas:
            both = deltas[0] if len(deltas) == 1 else deltas[0].unionByName(deltas[1])
            self._write(both.groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0").withColumn("bucket", self._place("term", many)), f"{name}/terms", "bucket", sort="term")
        old_number = (self.pointer.version().number if self.pointer.version() else 0) + 1
        facts = {"segments": [*segments, name], "many": many, "n": n, "length": length}
        self.pointer._commit(versions.Version(old_number, many, t.StructType().json(), {}, facts))
        return facts

    def _chunks(self, rows: DataFrame, name: str, many: int) -> DataFrame:
        """chunk_id, ord, document_id, dl, terms (distinct), tfs, range, place, bucket: neighbours in the order of bucket, document
        and ord are of one range, and a bucket lies in few tasks."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            task, at = TaskContext.get().partitionId(), 0
            for b in batches:
                toks = b.column(3)
                dl = np.diff(toks.offsets.to_numpy()).astype(np.int32)
                coded = toks.flatten().dictionary_encode()
                words = max(1, len(coded.dictionary))
                pair, tf = np.unique(np.repeat(np.arange(len(dl)), dl) * words + coded.indices.to_numpy(), return_counts=True)
                ends = pa.array(np.searchsorted(pair, np.arange(len(dl) + 1) * words).astype(np.int32))
                k, place = np.divmod(at + np.arange(len(dl)), RANGE)
                own = {x: int.from_bytes(hashlib.blake2b(f"{name}:{task}:{x}".encode(), digest_size=8).digest(), "little", signed=True) for x in np.unique(k).tolist()}
                at += len(dl)
                made = [pa.array(dl), pa.ListArray.from_arrays(ends, coded.dictionary.take(pa.array(pair % words))), pa.ListArray.from_arrays(ends, pa.array(tf.astype(np.int32)))]
                made += [pa.array([own[x] for x in k.tolist()], pa.int64()), pa.array(place.astype(np.int32)), b.column(4)]
                yield pa.RecordBatch.from_arrays([*b.columns[:3], *made], names=["chunk_id", "ord", "document_id", "dl", "terms", "tfs", "range", "place", "bucket"])

        kind = lambda c: rows.schema[c].dataType.simpleString()
        parts = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        near = rows.select("chunk_id", F.col("ord").cast("long").alias("ord"), "document_id", "text", self._place("document_id", many))
        by = near.repartitionByRange(parts, "bucket", "document_id", "ord").sortWithinPartitions("bucket", "document_id", "ord")
        toks = by.select("chunk_id", "ord", "document_id", T.tokens(F.coalesce("text", F.lit(""))).alias("toks"), "bucket")
        return toks.mapInArrow(run, f"chunk_id {kind('chunk_id')}, ord long, document_id {kind('document_id')}, dl int, terms array<string>, tfs array<int>, range long, place int, bucket int")

    def _blocks(self, made: DataFrame, many: int) -> DataFrame:
        """term, range, places, tfs, max_tf, min_dl, bucket, of chunks as they lie."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                coded = b.column(3).flatten().dictionary_encode()
                if not len(coded):
                    continue
                row = np.repeat(np.arange(b.num_rows), np.diff(b.column(3).offsets.to_numpy()))
                term, tf = coded.indices.to_numpy(), b.column(4).flatten().to_numpy()
                span, place, dl = (b.column(i).to_numpy()[row] for i in range(3))
                order = np.lexsort((place, term, span))
                span, term, place, tf, dl = (x[order] for x in (span, term, place, tf, dl))
                heads = np.flatnonzero(np.r_[True, (span[1:] != span[:-1]) | (term[1:] != term[:-1])])
                ends = pa.array(np.r_[heads, len(span)].astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(t))) for x, t in ((place, np.int16), (tf, np.int32))]
                most = [pa.array(np.maximum.reduceat(tf, heads)), pa.array(np.minimum.reduceat(dl, heads))]
                yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(term[heads])), pa.array(span[heads]), *lists, *most], names=["term", "range", "places", "tfs", "max_tf", "min_dl"])

        own = made.select("range", "place", "dl", "terms", "tfs").mapInArrow(run, "term string, range long, places array<smallint>, tfs array<int>, max_tf int, min_dl int")
        return own.withColumn("bucket", self._place("term", many))

    def _write(self, rows: DataFrame, folder: str, by: str | None = None, sort: str | None = None, dealt: bool = False) -> None:
        """dealt: a bucket's rows lie in few tasks already."""
        if by:
            # the terms of a bucket lie together, so that a reader passes over row groups; a large bucket is split
            rows = rows if dealt else rows.hint("rebalance", by)
            rows = rows.sortWithinPartitions(by, sort) if sort else rows
        writer = (rows.write.partitionBy(by) if by else rows.write).option("compression", "zstd")
        writer.parquet(f"{self.path}/{folder}")

    def _read(self, segments: list[str], name: str, places: list[int] | None = None) -> DataFrame | None:
        """A table of some segments, of some buckets, with seg: the place of its segment in the list; None where there's none."""
        out = None
        for i, s in enumerate(segments):
            there = self.pointer._names(f"{s}/{name}")
            if not any(n.endswith(".parquet") or n.startswith("bucket=") for n in there):
                continue
            chosen = [f"{self.path}/{s}/{name}"] if places is None else [f"{self.path}/{s}/{name}/bucket={b}" for b in places if f"bucket={b}" in there]
            if chosen:
                one = self.spark.read.parquet(*chosen).withColumn("seg", F.lit(i))
                one = one.drop("bucket")
                out = one if out is None else out.unionByName(one)
        return out

    def _live(self, segments: list[str], places: list[int] | None = None) -> DataFrame:
        """The chunks that no later segment has made void."""
        rows = self._read(segments, "chunks", places)
        if rows is None:
            return self.spark.createDataFrame([], "chunk_id long, ord long, document_id string, dl int, terms array<string>, tfs array<int>, range long, place int, seg int")
        gone = self._read(segments, "gone")
        return rows if gone is None else rows.join(gone.select("range", "place"), ["range", "place"], "left_anti")

    def due(self) -> bool:
        """Whether there are so many segments that compact() pays."""
        facts = self.facts()
        return facts is not None and len(facts["segments"]) >= SEGMENTS

    def compact(self) -> dict:
        """A version with one segment of all that is live; texts aren't needed for it."""
        facts, name = self.facts(), f"seg-{uuid.uuid4().hex}"
        many = max(facts["many"], 1 << max(3, min(12, (facts["n"] // self.chunks_per_bucket).bit_length())))
        segments = facts["segments"]
        same = many == facts["many"]  # then what lies in a bucket stays there
        chunks = self._live(segments).drop("seg").withColumn("bucket", self._place("document_id", many))
        self._write(chunks, f"{name}/chunks", "bucket", sort="document_id", dealt=same)
        blocks, gone = (self._read(segments, x) for x in ("blocks", "gone"))
        if blocks is not None:
            if gone is not None:
                dead = gone.groupBy("range").agg(F.collect_set("place").alias("dead"))
                left = F.filter(F.arrays_zip("places", "tfs"), lambda e: ~F.array_contains("dead", e.places.cast("int")))
                blocks = blocks.join(dead, "range", "left").withColumn("left", F.when(F.col("dead").isNotNull(), left))
                # the shortest length stays: it bounds those that are left too
                blocks = blocks.where("left is null or size(left) > 0").withColumns({"places": F.coalesce("left.places", "places"), "tfs": F.coalesce("left.tfs", "tfs")}).withColumn("max_tf", F.array_max("tfs"))
            again = blocks.select("term", "range", "places", "tfs", "max_tf", "min_dl", self._place("term", many))
            self._write(again, f"{name}/blocks", "bucket", sort="term", dealt=same)
            terms = self._read(segments, "terms").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
            self._write(terms.withColumn("bucket", self._place("term", many)), f"{name}/terms", "bucket", sort="term")
        made = {"segments": [name], "many": many, "n": facts["n"], "length": facts["length"]}
        self.pointer._commit(versions.Version(self.pointer.version().number + 1, many, t.StructType().json(), {}, made))
        return made

    # ---- searching

    def search(self, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, number: int | None = None) -> DataFrame:
        """query_id, rank, chunk_id, score of queries (query_id, question): what retrieval.bm25() gives over the live chunks, from blocks
        alone. Questions go in blocks of about QUERY_BLOCK."""
        facts = self.facts(number)
        if facts is None:
            raise FileNotFoundError(self.path)
        terms = queries.select("query_id", F.explode(T.tokens(F.col("question"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
        parts = max(1, -(-queries.count() // QUERY_BLOCK))
        out = None
        for i in range(parts):
            own = terms if parts == 1 else terms.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i)
            found, _ = self._asked(facts, own, k, k1, b)
            out = found if out is None else out.unionByName(found)
        return out

    def visited(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, ranges, scored: in how many ranges of chunks a question's terms are, and of how many search() reads the entries."""
        terms = queries.select("query_id", F.explode(T.tokens(F.col("question"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
        _, turn = self._asked(self.facts(), terms, k, 1.5, 0.75)
        return turn.groupBy("query_id").agg(F.count("*").alias("ranges"), F.sum(F.col("due").cast("long")).alias("scored"))

    def _asked(self, facts: dict, terms: DataFrame, k: int, k1: float, b: float) -> tuple[DataFrame, DataFrame]:
        """(what search() gives, turn: query_id, range, bound and whether it's due)."""
        segments, n = facts["segments"], facts["n"]
        live = self._live(segments)
        known = [r.term for r in terms.select("term").distinct().collect()]  # of QUERY_BLOCK questions
        wanted = self.spark.createDataFrame([(x,) for x in known], "term string")
        places = sorted({r.bucket for r in wanted.select(self._place("term", facts["many"])).distinct().collect()})
        few = F.col("term").isin(known) if len(known) <= 500 else F.lit(True)  # is pushed down to row groups
        blocks, df = (self._read(segments, name, places) for name in ("blocks", "terms"))
        first = live.select("chunk_id", "ord").orderBy("ord").limit(2 * k)
        asks = terms.select("query_id").distinct()
        empty = asks.join(F.broadcast(first)).withColumn("score", F.lit(0.0))
        if blocks is None or df is None or not n:
            none = self.spark.createDataFrame([], "query_id long, range long, bound double, due boolean")
            return _ranked(empty, F.desc("score"), F.col("ord")).where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score"), none
        mean = facts["length"] / n
        counts = df.where(few).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        weighed = counts.join(F.broadcast(terms), "term").select("query_id", "term", (F.col("qtf") * F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)).alias("w"))
        part = lambda tf, dl: F.col("w") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / mean))
        own = blocks.where(few)
        bounds = own.select("term", "range", "max_tf", "min_dl").groupBy("term", "range").agg(F.max("max_tf").alias("max_tf"), F.min("min_dl").alias("min_dl"))
        bounds = bounds.join(F.broadcast(weighed), "term").groupBy("query_id", "range").agg(F.sum(part(F.col("max_tf"), F.col("min_dl"))).alias("bound"))
        turn = bounds.withColumn("turn", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("bound"), "range")))

        def scored(due: DataFrame) -> DataFrame:
            """query_id, chunk_id, ord, score of the live chunks of due (query_id, range)."""
            hits = own.join(F.broadcast(weighed), "term").join(due.select("query_id", "range"), ["query_id", "range"])
            each = hits.select("query_id", "w", "range", F.explode(F.arrays_zip("places", "tfs")).alias("e")).select("query_id", "w", "range", F.col("e.places").cast("int").alias("place"), F.col("e.tfs").alias("tf"))
            known = each.join(live.select("range", "place", "chunk_id", "ord", "dl"), ["range", "place"])
            return known.groupBy("query_id", "chunk_id", "ord").agg(F.round(F.sum(part(F.col("tf"), F.col("dl"))), 9).alias("score"))

        begun = _ranked(scored(turn.where(F.col("turn") <= FIRST)), F.desc("score"), F.col("ord")).where(F.col("rank") <= k)
        least = begun.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
        turn = turn.join(least, "query_id", "left").withColumn("due", (F.col("turn") <= FIRST) | (F.col("bound") >= F.coalesce("least", F.lit(0.0)) - 1e-6))
        hits = begun.drop("rank").unionByName(scored(turn.where((F.col("turn") > FIRST) & F.col("due"))))
        top = _ranked(hits, F.desc("score"), F.col("ord")).where(F.col("rank") <= k).drop("rank")
        # chunks that no term hits fill what is left, in the order of ord
        zero = empty.join(hits.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
        both = top.select("query_id", "chunk_id", "ord", "score").unionByName(zero.select("query_id", "chunk_id", "ord", "score"))
        return _ranked(both, F.desc("score"), F.col("ord")).where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score"), turn.select("query_id", "range", "bound", "due")
