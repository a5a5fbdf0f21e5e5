"""Near copies by shingle similarity: SimHash fingerprints and min-hash bands find candidates, exact Jaccard over whole shingle
sets decides.

Fingerprints within DISTANCE bits are linked as op1 links them: block tables, Hamming distances. That finds the nearest copies. A pair
at a Jaccard similarity of 0.8 differs in some 10 of 64 bits, and blocks that are equal then are too narrow to tell texts
apart; the bands find what lies between.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioloom.llm import utf8
from folioloom.llm.cluster import cut, partitions, texts
from folioloom.llm.components import components
from folioloom.llm.simhash import blocks_for, fingerprint_links, majority, shingles

WIDTH, SIMILARITY = 5, 0.8
#: Bits in which fingerprints of candidates differ at most.
DISTANCE = 4
#: BANDS keys of ROWS least hashes each. A pair at 0.8 shares none of the keys with a chance of (1 - 0.8^6)^40, 5 in a million;
#: a pair at 0.1, as by a common passage, shares one with a chance of 4 in 100,000.
BANDS, ROWS = 40, 6

_SEEDS = utf8.mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))
_XOR, _ODD = (_SEEDS >> np.uint64(32)).astype(np.uint32), (_SEEDS & np.uint64(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1)


def sets(buf: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct shingles of each text, sorted, one text after another; how many each has; a 64-bit hash of each set)."""
    h, made = shingles(buf, offsets, width)
    text = np.repeat(np.arange(len(made)), made)
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (text[1:] != text[:-1])] if len(h) else np.zeros(0, bool)
    h, text = h[new], text[new]
    n = np.bincount(text, minlength=len(made))
    node = np.zeros(len(made), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        heads = (np.cumsum(n) - n)[full]
        with np.errstate(over="ignore"):
            node[full] = utf8.pair(np.add.reduceat(utf8.mix(h), heads), n[full].astype(np.uint64))
    return h, n, node


def bands(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """BANDS keys of each text from its distinct shingles h, n a text; a text without any has zeros."""
    out = np.zeros((len(n), BANDS), np.uint64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    heads = (np.cumsum(n) - n)[full]
    short = (h ^ (h >> np.uint64(32))).astype(np.uint32)
    with np.errstate(over="ignore"):
        for b in range(BANDS):
            key = np.full(len(full), b + 1, np.uint64)
            for k in range(b * ROWS, (b + 1) * ROWS):
                x = (short ^ _XOR[k]) * _ODD[k]
                x ^= x >> np.uint32(15)
                key = utf8.pair(key, np.minimum.reduceat(x * np.uint32(0x2C1B3C6D), heads).astype(np.uint64))
            out[full, b] = key
    return out


def text_hash(column: str) -> Column:
    """What tells rows of one doc_id apart by their texts; a null text is an empty one."""
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")))


def _prints(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, text_hash, node, fp, keys) of every row, map side; node stands for a shingle set, texts of the same set share it.
    fp is the SimHash fingerprint of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, at = utf8.column(b, "text")
            node, fp, keys = np.zeros(len(at) - 1, np.uint64), np.zeros(len(at) - 1, np.uint64), np.zeros((len(at) - 1, BANDS), np.uint64)
            for i, j in utf8.chunks(at):
                h, n, node[i:j] = sets(buf[at[i] : at[j]], at[i : j + 1] - at[i], width)
                fp[i:j], keys[i:j] = majority(h, n), bands(h, n)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(node) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel().view(np.int64)))
            own = [b.column(0).cast(pa.int64()), b.column(2), pa.array(node.view(np.int64)), pa.array(fp.view(np.int64)), lists]
            yield pa.RecordBatch.from_arrays(own, names=["doc_id", "text_hash", "node", "fp", "keys"])

    return texts(docs).withColumn("text_hash", text_hash("text")).mapInArrow(run, "doc_id long, text_hash long, node long, fp long, keys array<long>")


def _fingerprint_links(nodes: DataFrame) -> DataFrame:
    """(a, b): links between nodes (node, fp) that keep together all whose fingerprints differ in at most DISTANCE bits."""
    least = cut(nodes.groupBy("fp").agg(F.min("node").alias("id")))
    far = fingerprint_links(least.withColumn("none", F.lit(False)), DISTANCE, blocks_for(least.count(), DISTANCE))
    same = nodes.join(least, "fp").where("node <> id").select(F.col("node").alias("a"), F.col("id").alias("b"))
    return far.select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).unionAll(same)


def _candidate_links(nodes: DataFrame) -> DataFrame:
    """(a, b): each node of nodes (node, keys) linked with the least one of each key's group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [b for b in batches if b.num_rows]
        if not own:
            return
        all_ = pa.Table.from_batches(own)
        node, key = (all_.column(c).to_numpy() for c in ("node", "key"))
        order = np.lexsort((node, key))
        node, key = node[order], key[order]
        heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        least = np.repeat(node[heads], np.diff(np.r_[heads, len(key)]))
        links = np.unique(np.stack([node, least], axis=1)[node != least], axis=0)
        for i in range(0, len(links), 100_000):
            part = links[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part[:, 0].copy()), pa.array(part[:, 1].copy())], names=["a", "b"])

    keyed = nodes.select("node", F.explode("keys").alias("key"))
    return keyed.repartition(partitions(nodes.sparkSession), "key").mapInArrow(run, "a long, b long")


def forest(node: np.ndarray, h: np.ndarray, n: np.ndarray, similarity: float) -> tuple[list[int], list[int]]:
    """Links that span what is within similarity of each other among node, whose distinct shingles are h, n each: every node is
    compared with those not yet reached, so that no component is split and what is made stays in proportion to the nodes."""
    names, ids = np.unique(h, return_inverse=True)
    heads = np.cumsum(n) - n
    mark = np.zeros(len(names), bool)
    rest, left, right = np.arange(len(node)), [], []
    while len(rest):
        wave, rest = [rest[0]], rest[1:]
        while wave and len(rest):
            x = wave.pop()
            # no set much smaller or larger reaches the similarity
            near = (n[rest] >= similarity * n[x] - 1e-9) & (n[x] >= similarity * n[rest] - 1e-9)
            some = rest[near]
            if not len(some):
                continue
            own = ids[heads[x] : heads[x] + n[x]]
            mark[own] = True
            both = np.add.reduceat(mark[ids[utf8.flat(heads[some], n[some])]], np.cumsum(n[some]) - n[some], dtype=np.int64)
            mark[own] = False
            hit = both >= similarity * (n[x] + n[some] - both) - 1e-9
            found = some[hit]
            left += [int(node[x])] * len(found)
            right += node[found].tolist()
            wave += found.tolist()
            rest = rest[~np.isin(rest, found)]
    return left, right


def _verified(docs: DataFrame, prints: DataFrame, groups: DataFrame, width: int, similarity: float) -> DataFrame:
    """(a, b): spanning links of similarity or more within each of groups (node, root), from whole shingle sets. Only texts of
    candidates move, one a node and those without an id."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, at = utf8.column(b, "text")
            for i, j in utf8.chunks(at):
                h, n, node = sets(buf[at[i] : at[j]], at[i : j + 1] - at[i], width)
                ends = np.r_[0, np.cumsum(n)]
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), lists], names=["node", "shingles"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [b for b in batches if b.num_rows]
        if not own:
            return
        all_ = pa.Table.from_batches(own)
        root, node = all_.column("root").to_numpy(), all_.column("node").to_numpy()
        _, pick = np.unique(np.stack([root, node], axis=1), axis=0, return_index=True)
        lists = all_.column("shingles").combine_chunks()
        root = root[pick]
        edge = np.flatnonzero(np.r_[True, root[1:] != root[:-1], True])
        left, right = [], []
        for i, j in zip(edge, edge[1:], strict=False):
            part = lists.take(pa.array(pick[i:j]))
            a, b = forest(node[pick[i:j]], part.flatten().to_numpy().view(np.uint64), np.diff(part.offsets.to_numpy()).astype(np.int64), similarity)
            left += a
            right += b
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    reps = prints.where("doc_id is not null").join(groups, "node").groupBy("node").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    own = docs.select("doc_id", "text")
    own = own.join(reps, "doc_id", "left_semi").unionByName(own.where("doc_id is null"))
    spelled = texts(own).drop("doc_id").mapInArrow(spell, "node long, shingles array<long>")
    return spelled.join(groups, "node").repartition(partitions(docs.sparkSession), "root").mapInArrow(link, "a long, b long")


def near_copies(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, text_hash, component_id): component_id is the smallest doc_id reachable over pairs of texts whose sets of width-word
    shingles have a Jaccard similarity of at least similarity, the row's own included.

    A text of fewer words is one shingle; null and blank texts are alike. Repeated rows are returned as often as they come. A
    null doc_id keeps its row and its group; component_id is null only where no row of the group has an id. The bands are made
    for similarities of 0.8 or more.
    """
    prints = cut(_prints(docs, width))
    nodes = cut(prints.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("fp").alias("fp"), F.first("keys").alias("keys")))
    full = nodes.where("node <> 0")
    groups = components(_candidate_links(full.select("node", "keys")).unionAll(_fingerprint_links(full.select("node", "fp"))))
    groups = cut(groups.unionAll(groups.select(F.col("root").alias("node"), "root")).distinct())  # a root is a member too
    # named by its smallest doc_id (without one by its hash, after all ids) a component's root is its component_id, and no join
    # on roots, of which one may have very many members, is needed
    names = nodes.select("node", F.struct(F.col("rep").isNull().alias("none"), F.coalesce("rep", "node").alias("id")).alias("name"))
    links = _verified(docs, prints.select("doc_id", "node"), groups, width, similarity)
    end = lambda c: names.select(F.col("node").alias(f"_{c}"), F.col("name").alias(c))
    named = links.select(F.col("a").alias("_a"), F.col("b").alias("_b")).join(end("a"), "_a").join(end("b"), "_b").select("a", "b")
    roots = components(named).withColumnRenamed("node", "name")
    root = F.coalesce("root", "name")
    known = names.join(roots, "name", "left").select("node", F.when(~root["none"], root["id"]).alias("component_id"))
    return prints.select("doc_id", "text_hash", "node").join(known, "node").select("doc_id", "text_hash", "component_id")
