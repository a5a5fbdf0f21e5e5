"""SimHash near-duplicate detection: pigeonhole blocks, Hamming verification, connected components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioloom.llm import utf8
from folioloom.llm.cluster import cut, partitions, texts
from folioloom.llm.components import components

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P2, 31) * _P1


def _xxh64_rows(rows: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of each row of a byte matrix."""
    n, size = rows.shape
    wide = np.zeros((n, -(-size // 8) * 8), np.uint8)
    wide[:, :size] = rows
    lanes, s = wide.view("<u8"), np.uint64(seed)
    at = 0
    if size >= 32:
        accs = [np.full(n, x, np.uint64) for x in (s + _P1 + _P2, s + _P2, s, s - _P1)]
        while at + 32 <= size:
            accs = [_round(a, lanes[:, at // 8 + k]) for k, a in enumerate(accs)]
            at += 32
        h = sum((_rotl(a, r) for a, r in zip(accs, (1, 7, 12, 18), strict=True)), np.zeros(n, np.uint64))
        for a in accs:
            h = (h ^ _round(np.zeros(n, np.uint64), a)) * _P1 + _P4
    else:
        h = np.full(n, s + _P5, np.uint64)
    h = h + np.uint64(size)
    while at + 8 <= size:
        h = _rotl(h ^ _round(np.zeros(n, np.uint64), lanes[:, at // 8]), 27) * _P1 + _P4
        at += 8
    if at + 4 <= size:
        h = _rotl(h ^ (np.ascontiguousarray(wide[:, at : at + 4]).view("<u4")[:, 0].astype(np.uint64) * _P1), 23) * _P2 + _P3
        at += 4
    for k in range(at, size):
        h = _rotl(h ^ (wide[:, k].astype(np.uint64) * _P5), 11) * _P1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def xxh64(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each slice of buf; slices of one length are hashed together."""
    out = np.zeros(len(starts), np.uint64)
    order = np.argsort(lengths, kind="stable")
    sizes, first = np.unique(lengths[order], return_index=True)
    with np.errstate(over="ignore"):
        for size, rows in zip(sizes.tolist(), np.split(order, first[1:]), strict=True):
            step = max(1, 8_000_000 // max(size, 1))
            for i in range(0, len(rows), step):
                part = rows[i : i + step]
                out[part] = _xxh64_rows(buf[starts[part][:, None] + np.arange(size)], seed)
    return out


def shingles(buf: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(XXH64 of the shingles of all texts, how many each text has): width words, lower-cased A-Z, space-joined; a text of
    fewer words is one shingle, one without words has none."""
    buf = utf8.LOWER[buf]
    starts, ends, count = utf8.words(buf, offsets)
    sizes = ends - starts
    # words side by side with one space after each
    place = np.cumsum(sizes + 1) - (sizes + 1)
    line = np.full(int((sizes + 1).sum()), 32, np.uint8)
    line[utf8.flat(place, sizes)] = buf[utf8.flat(starts, sizes)]
    made = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    first = np.cumsum(count) - count
    head = utf8.flat(first, made)
    tail = head + np.repeat(np.minimum(count, width), made) - 1
    return xxh64(line, place[head], place[tail] + sizes[tail] - place[head]), made


def fingerprints(buf: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit fingerprint of each text's shingles, repeats included, 0 for a text without words."""
    return majority(*shingles(buf, offsets, width))


def majority(h: np.ndarray, made: np.ndarray) -> np.ndarray:
    """The fingerprint of each run of made hashes in h: a bit is 1 where more than half of them have it; 0 without any."""
    out = np.zeros(len(made), np.uint64)
    full = np.flatnonzero(made)
    ones = np.zeros((len(full), 64), np.int64)
    step = 200_000  # shingles whose bits are unpacked at once
    text_of = np.repeat(np.arange(len(full)), made[full])
    for i in range(0, len(h), step):
        bits = np.unpackbits(h[i : i + step].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        own = text_of[i : i + step]
        heads = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        ones[own[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int64)
    packed = np.packbits(ones * 2 > made[full][:, None], axis=1)
    out[full] = packed.view(">u8")[:, 0].astype(np.uint64)
    return out


def with_fingerprint(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp long) of every row of docs (doc_id, text), from whole texts, map side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, at = utf8.column(b, "text")
            fp = np.zeros(len(at) - 1, np.uint64)
            for i, j in utf8.chunks(at):
                fp[i:j] = fingerprints(buf[at[i] : at[j]], at[i : j + 1] - at[i], width)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return texts(docs).mapInArrow(run, "doc_id long, fp long")


def block_tables(distance: int, blocks: int) -> list[int]:
    """Bit masks, one a table: two fingerprints that differ in at most distance bits agree under one of them, because at
    least blocks - distance of the blocks have no differing bit."""
    if not distance < blocks <= 64:
        raise ValueError("more blocks than differing bits are needed")
    cuts = [round(64 * k / blocks) for k in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(parts, blocks - distance)]


def _forest(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (places in fp) that span what is within distance of each other, one less than the members of each piece: each
    member is compared with those not yet reached only."""
    left, right = [], []
    at, rest = np.arange(len(fp)), fp
    while len(at):
        wave, at, rest = at[:1], at[1:], rest[1:]
        while len(wave) and len(at):
            ahead = []
            for x in wave:
                near = np.bitwise_count(rest ^ fp[x]) <= distance
                if near.any():
                    left.append(np.full(int(near.sum()), x))
                    right.append(at[near])
                    ahead.append(at[near])
                    at, rest = at[~near], rest[~near]
                    if not len(at):
                        break
            wave = np.concatenate(ahead) if ahead else at[:0]
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return join(left), join(right)


def _patterns(free: int, distance: int) -> list[int]:
    """The ways to differ in 1 to distance of the bits of free."""
    bits = [1 << k for k in range(64) if free >> k & 1]
    return [sum(c) for n in range(1, distance + 1) for c in combinations(bits, n)]


def _reached(fp: np.ndarray, patterns: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """As _forest, for groups larger than the ways to differ: each way is looked up for all members side by side, so that the
    work grows with the members and not with their square."""
    order = np.argsort(fp)
    v = fp[order]
    label, left, right = np.arange(len(v)), [], []
    for p in patterns:
        wanted = v ^ np.uint64(p)
        at = np.minimum(np.searchsorted(v, wanted), len(v) - 1)
        i = np.flatnonzero((v[at] == wanted) & (label[at] < label))
        if not len(i):
            continue
        pairs, first = np.unique(np.stack([label[at[i]], label[i]], axis=1), axis=0, return_index=True)
        parent: dict[int, int] = {}

        def root(x: int, parent: dict[int, int] = parent) -> int:
            while x in parent:
                x = parent[x]
            return x

        for (low, high), k in zip(pairs.tolist(), first.tolist(), strict=True):
            low, high = sorted((root(low), root(high)))
            if low != high:
                parent[high] = low
                left.append(i[k])
                right.append(at[i[k]])
        moved = np.arange(len(v))
        moved[list(parent)] = [root(x) for x in parent]
        label = moved[label]
    return order[np.array(left, np.int64)], order[np.array(right, np.int64)]


def linked(key: np.ndarray, fp: np.ndarray, distance: int, small: int = 48, free: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Verified links (places) among the fingerprints that share a key. Groups up to small members: every pair, side by side
    for all groups. Larger groups: spanning links only, so what is made stays in proportion to the members; free: the bits
    in which members of a group can differ, for groups so large that looking all differences up is cheaper than comparing."""
    order = np.lexsort((fp, key))
    key, fp = key[order], fp[order]
    heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[heads, len(key)])
    left, right = [], []
    patterns = _patterns(free, distance) if free is not None and int(sizes.max(initial=0)) > 4096 else []
    for i in np.flatnonzero(sizes > small):
        own = fp[heads[i] : heads[i] + sizes[i]]
        a, b = _reached(own, patterns) if patterns and sizes[i] > max(4096, 2 * len(patterns)) else _forest(own, distance)
        left.append(heads[i] + a)
        right.append(heads[i] + b)
    group = np.repeat(sizes, sizes)
    place = np.arange(len(key)) - np.repeat(heads, sizes)
    alive = np.flatnonzero(group <= small)
    for step in range(1, min(small, int(sizes.max(initial=0)))):
        alive = alive[place[alive] + step < group[alive]]
        near = alive[np.bitwise_count(fp[alive] ^ fp[alive + step]) <= distance]
        left.append(near)
        right.append(near + step)
    join = lambda x: order[np.concatenate(x)] if x else np.zeros(0, np.int64)
    return join(left), join(right)


def fingerprint_links(nodes: DataFrame, distance: int, blocks: int, rows: int = 500_000) -> DataFrame:
    """Links (a, b) between nodes (fp, none, id), as struct<none, id>, whose distinct fingerprints differ in at most distance
    bits, enough of them to keep every component whole. Each fingerprint goes once to each table of block_tables, dealt out by
    its bits under the mask; groups that share these are met in order, about rows of them at once."""
    masks = block_tables(distance, blocks)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(signed)])
    keyed = nodes.select("fp", "none", "id", F.explode(keys).alias("x")).select("fp", "none", "id", "x.t", "x.key")

    def made(t: pa.Table) -> Iterator[pa.RecordBatch]:
        fp, none, name, table, key = (t.column(c).to_numpy() for c in ("fp", "none", "id", "t", "key"))
        for k in np.unique(table):
            own = np.flatnonzero(table == k)
            a, b = linked(key[own], fp[own].view(np.uint64), distance, free=~masks[k] & ((1 << 64) - 1))
            a, b = own[a], own[b]
            for i in range(0, len(a), 100_000):
                x, y = a[i : i + 100_000], b[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (none[x], name[x], none[y], name[y])], names=["an", "a", "bn", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            n += b.num_rows
            if n >= rows:  # all groups but the last are whole
                t = pa.Table.from_batches(held)
                table, key = t.column("t").to_numpy(), t.column("key").to_numpy()
                last = int(np.flatnonzero((table != table[-1]) | (key != key[-1])).max(initial=-1)) + 1
                yield from made(t.slice(0, last))
                held = t.slice(last).to_batches()
                n = t.num_rows - last
        if held:
            yield from made(pa.Table.from_batches(held))

    n = partitions(nodes.sparkSession)
    found = keyed.repartition(n, "t", "key").sortWithinPartitions("t", "key").mapInArrow(run, "an boolean, a long, bn boolean, b long")
    return found.select(F.struct(F.col("an").alias("none"), F.col("a").alias("id")).alias("a"), F.struct(F.col("bn").alias("none"), F.col("b").alias("id")).alias("b"))


def blocks_for(distinct: int, distance: int) -> int:
    """Blocks so that a key of distance + 1 .. distance + 4 blocks stays selective: candidates of unrelated fingerprints
    per table are about distinct / 2^(64 (blocks - distance) / blocks). Exact at any value; only cost changes."""
    return distance + (2 if distinct < 1 << 24 else 3 if distinct < 1 << 29 else 4)


def near_duplicates(docs: DataFrame, width: int = 4, distance: int = 4, blocks: int | None = None) -> DataFrame:
    """(doc_id, fp long, component_id): component_id is the smallest doc_id reachable over fingerprints that differ in at
    most distance bits, the row's own included.

    Null or blank texts have fingerprint 0 and are linked like any other. Repeated rows are returned as often as they come.
    A null doc_id keeps its row and its group; component_id is null only where no row of the group has an id. An empty
    table gives no rows. Columns of docs other than doc_id and text are not read.
    """
    prints = cut(with_fingerprint(docs, width))
    # a node's name is its smallest doc_id (where none of its rows has one: its fingerprint, after all ids), so that the root
    # of a component is its component_id, and no join on roots, of which one may have very many members, is needed
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    nodes = cut(least.select("fp", F.col("rep").isNull().alias("none"), F.coalesce("rep", "fp").alias("id")))
    roots = components(fingerprint_links(nodes, distance, blocks or blocks_for(nodes.count(), distance)))
    own = nodes.select("fp", F.struct("none", "id").alias("node")).join(roots, "node", "left")
    root = F.coalesce("root", "node")
    known = own.select("fp", F.when(~root["none"], root["id"]).alias("component_id"))
    return prints.join(known, "fp").select("doc_id", "fp", "component_id")


def op1(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id over the whole documents table."""
    from folioloom.llm.cluster import table

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
