"""Katz backoff language model: Good-Turing discounted counts, exactly normalised backoff weights, sharded tables.

Words are 64-bit hashes throughout. Words are counted first. Counts, tables and lookups of bigrams are dealt into shards by
the upper bits of a hash: bigrams are first counted where their word lives (so that each learns its word's count), then
regrouped where their context lives, which is where the backoff weight of a context can be normalised exactly. What moves
between tasks are flat arrays, one a shard and batch of texts that has any bigram there, each distinct bigram of a batch once.

Words with a share of 1 / HOT or more of all tokens are hot; there are at most HOT of them, and all tasks know their counts.
So a hot word's bigrams needn't meet, and are counted where their context lives; a hot context's bigrams are dealt by both
words, and its normalisation is summed from all shards; bigrams as frequent as that are known to all tasks too, and scored
where they are read. No table, count or score of all the corpus comes to the driver or to one task; the driver sees counts of
counts and what is hot.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.llm import utf8
from folioloom.llm.cluster import partitions, remove, small_batches, stored, stored_at, table, texts

#: Hashes of what isn't a word: the end of a text and the context before its first token.
END, BEGIN = np.uint64(0x0E4D0E4D0E4D0E4D), np.uint64(0xB391B391B391B391)
#: Tokens of texts gathered before they are sent on.
BATCH_TOKENS = 1_500_000
#: Contexts are regrouped and documents scored in so many turns, each one's shuffle files gone before the next: what is on
#: disk at once is the tables and a turn's share.
TURNS = 3
#: Counts up to this are discounted.
KATZ_K = 5
#: A word or bigram with a share of 1 / HOT of all tokens is hot: at most HOT of each.
HOT = 65_536


def dump(*arrays: np.ndarray) -> bytes:
    """Arrays in one string: those of 8-byte integers as they are (hashes), others by byte planes, compressed."""
    codec = pa.Codec("zstd", compression_level=1)
    parts = []
    for a in arrays:
        raw = np.ascontiguousarray(a).view(np.uint8)
        if a.dtype == np.uint64:
            body = raw.tobytes()
        else:
            body = codec.compress(raw.reshape(len(a), a.dtype.itemsize).T.tobytes(), asbytes=True) if len(a) else b""
        parts.append(b"%s %d %d\n" % (a.dtype.str.encode(), len(a), len(body)) + body)
    return b"".join(parts)


def load(raw: bytes) -> list[np.ndarray]:
    codec, at, out = pa.Codec("zstd"), 0, []
    while at < len(raw):
        end = raw.index(b"\n", at)
        kind, n, size = raw[at:end].split(b" ")
        kind, n, size, at = np.dtype(kind.decode()), int(n), int(size), end + 1
        body = raw[at : at + size]
        at += size
        if kind == np.uint64 or not n:
            out.append(np.frombuffer(body, kind))
        else:
            planes = np.frombuffer(codec.decompress(body, n * kind.itemsize, asbytes=True), np.uint8).reshape(kind.itemsize, n)
            out.append(np.ascontiguousarray(planes.T).view(kind)[:, 0])
    return out


def tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, an END after each text; contexts; tokens of each text): lower-cased A-Z, split at white space."""
    buf = utf8.LOWER[buf]
    starts, ends, count = utf8.words(buf, offsets)
    n = count + 1
    first = np.cumsum(n) - n
    w = np.full(int(n.sum()), END, np.uint64)
    w[utf8.flat(first, count)] = utf8.hashes(buf, starts, ends)
    h = np.empty_like(w)
    h[1:] = w[:-1]
    h[first] = BEGIN
    return w, h, n


def heads(sorted_: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]) if len(sorted_) else np.zeros(0, np.int64)


def sizes(head: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.r_[head, n])


def by_shard(sorted_: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard begins and ends among sorted hashes; shards is a power of two."""
    if shards == 1:
        return np.array([0, len(sorted_)])
    at = np.searchsorted(sorted_ >> np.uint64(64 - shards.bit_length() + 1), np.arange(shards, dtype=np.uint64))
    return np.r_[at, len(sorted_)]


@dataclass(frozen=True)
class Stats:
    """What normalisation needs of the whole corpus: tokens, distinct tokens, counts of counts up to KATZ_K + 1."""

    n: int
    v: int
    words: tuple[int, ...]
    pairs: tuple[int, ...]

    def discounts(self, counts: tuple[int, ...]) -> np.ndarray:
        """d[r], r up to KATZ_K: Katz's, from Good-Turing counts; (r - 1/2) / r where those give none within (0, 1]."""
        d = np.ones(KATZ_K + 1)
        tail = (KATZ_K + 1) * counts[KATZ_K + 1] / counts[1] if counts[1] else 1.0
        for r in range(1, KATZ_K + 1):
            turing = (r + 1) * counts[r + 1] / (r * counts[r]) if counts[r] else math.nan
            got = (turing - tail) / (1 - tail) if tail != 1 else math.nan
            d[r] = got if 0 < got <= 1 else (r - 0.5) / r
        return d

    def discounted(self, c: np.ndarray, counts: tuple[int, ...]) -> np.ndarray:
        return c * self.discounts(counts)[np.where(c <= KATZ_K, c, 0)]

    def p_word(self, c: np.ndarray) -> np.ndarray:
        """Unigram probability by count; 0: of each unknown word. The mass that discounting frees goes to unseen words,
        as many as Chao's estimate N1^2 / (2 N2) has; where none is freed, one count in n + 1 does."""
        d = self.discounted(c, self.words)
        freed = self.freed()
        p = d / self.n if freed > 1e-12 else c / (self.n + 1)
        return np.where(c > 0, p, self.unknown())

    def freed(self) -> float:
        d = self.discounts(self.words)
        return sum(r * self.words[r] * (1 - d[r]) for r in range(1, KATZ_K + 1)) / self.n if self.n else 0.0

    def unknown(self) -> float:
        free = self.freed()
        unseen = max(1.0, self.words[1] ** 2 / (2 * self.words[2]) if self.words[2] else self.words[1] * (self.words[1] - 1) / 2)
        return (free if free > 1e-12 else 1 / (self.n + 1)) / unseen


def normalise(stats: Stats, c: np.ndarray, cw: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probability of each bigram, backoff weight of each context); entries of a context lie side by side from head on.
    A context whose counts free no mass gives one count in c(h) + 1 to what it hasn't seen."""
    if not len(c):
        return np.zeros(0), np.zeros(0)
    size = sizes(head, len(c))
    total = np.add.reduceat(c, head).astype(np.float64)
    d = stats.discounted(c, stats.pairs)
    left = 1 - np.add.reduceat(d, head) / total
    none = left <= 1e-12
    p = np.where(np.repeat(none, size), c / np.repeat(total + 1, size), d / np.repeat(total, size))
    left = np.where(none, 1 / (total + 1), left)
    return p, left / (1 - np.add.reduceat(stats.p_word(cw), head))


@contextmanager
def _released(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a finished job go at once, so that only one step's are on disk at a time; Arrow batches are small."""
    wanted = {
        "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
        "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
    }
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def shards_for(docs: DataFrame, megabytes: int = 8) -> int:
    """A power of two: a shard for so many MB of input, as Spark estimates it, at least 4."""
    estimate = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    wanted = estimate / (megabytes << 20) if estimate < 1 << 55 else 4 * partitions(docs.sparkSession)
    return max(4, 1 << max(0, math.ceil(math.log2(max(1, wanted)))))


def held_out(ids: list[int | None]) -> np.ndarray:
    """crc32 of the id as text, mod 7, is 2; a null id is learnt from."""
    return np.array([i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i in ids], bool)


def _batches(batches: Iterator[pa.RecordBatch], learn: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list]]:
    """(words, contexts, tokens of each text, ids) of whole texts, about BATCH_TOKENS and under 2^16 texts at once."""
    w, h, n, ids, held = [], [], [], [], 0
    for b in batches:
        buf, at = utf8.column(b, "text")
        own = b.column(0).to_pylist()
        for i, j in utf8.chunks(at):
            for k in range(i, j, 10_000):
                m = min(j, k + 10_000)
                name = own[k:m]
                ww, hh, nn = tokens(buf[at[k] : at[m]], at[k : m + 1] - at[k])
                if learn:
                    use = ~held_out(name)
                    every = np.repeat(use, nn)
                    ww, hh, nn, name = ww[every], hh[every], nn[use], [x for x, u in zip(name, use, strict=True) if u]
                w.append(ww)
                h.append(hh)
                n.append(nn)
                ids += name
                held += len(ww)
                if held >= BATCH_TOKENS or len(ids) > 50_000:
                    yield np.concatenate(w), np.concatenate(h), np.concatenate(n), ids
                    w, h, n, ids, held = [], [], [], [], 0
    if ids:
        yield np.concatenate(w), np.concatenate(h), np.concatenate(n), ids


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place among sorted keys, whether it's there) of each of wanted."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


@dataclass(frozen=True)
class Hot:
    """What all tasks know, each list sorted by its hash, none longer than HOT + 1: hot words and their counts, hot contexts
    with their totals and backoff weights, hot bigrams with their probabilities and their words' counts."""

    words: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    totals: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    none: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    bow: np.ndarray = field(default_factory=lambda: np.zeros(0))
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    pair_p: np.ndarray = field(default_factory=lambda: np.zeros(0))
    pair_words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def route(self, h: np.ndarray, w: np.ndarray, together: bool = False) -> np.ndarray:
        """The hash by which bigrams are dealt: their context's, where it's hot that of both words. together: bigrams of one
        context lie side by side, so each is looked up once."""
        hd = heads(h) if together else np.arange(len(h))
        hot = np.repeat(find(self.contexts, h[hd])[1], sizes(hd, len(h)))
        out = h.copy()
        out[hot] = utf8.pair(h[hot], w[hot])
        return out


class Model:
    """Tables of a fitted model: words (w, c) and pairs (shard, blob), the blobs of a shard's contexts, their sizes and backoff
    weights, words, counts, word counts, then the same of hot contexts' bigrams without weights; statistics of the whole
    and what is hot."""

    def __init__(self, words: DataFrame, pairs: DataFrame, stats: Stats, shards: int, hot: Hot):
        self.words, self.pairs, self.stats, self.shards, self.hot = words, pairs, stats, shards, hot


def _words(docs: DataFrame) -> DataFrame:
    """(w, c): how often each word is learnt, each batch's partial counts summed on both sides of the shuffle."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w, _, _, _ in _batches(batches, True):
            w, c = np.unique(w, return_counts=True)
            for i in range(0, len(w), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(w[i : i + 100_000].view(np.int64)), pa.array(c[i : i + 100_000])], names=["w", "c"])

    return texts(docs).mapInArrow(gather, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))


def _counts_of_counts(c: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(c, KATZ_K + 2), minlength=KATZ_K + 3).tolist()


def _by_word(w: np.ndarray, h: np.ndarray, c: np.ndarray, cw: np.ndarray | None = None) -> bytes:
    """Bigrams of a shard, in order of words: each word (and its count) once."""
    hd = heads(w)
    return dump(w[hd], *([] if cw is None else [cw[hd].astype(np.uint32)]), sizes(hd, len(w)).astype(np.uint32), h, c.astype(np.uint32))


def dealt_out(route: np.ndarray, shards: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """(order by shard, else as it is, [(shard, from, to)] of the shards that have any); shards is a power of two."""
    shard = route >> np.uint64(64 - shards.bit_length() + 1) if shards > 1 else np.zeros(len(route), np.uint64)
    shard = shard.astype(np.uint16 if shards <= 1 << 16 else np.uint32)
    order = np.argsort(shard, kind="stable")
    shard = shard[order]
    hd = heads(shard)
    return order, list(zip(shard[hd].tolist(), hd.tolist(), [*hd[1:].tolist(), len(shard)], strict=False))


def _count(docs: DataFrame, shards: int, hot: Hot) -> DataFrame:
    """(kind, turn, shard, blob, n): b: bigrams for a shard of contexts, with their words' counts; s: counts of counts n."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w, h, _, _ in _batches(batches, True):
            _, first, c = np.unique(utf8.pair(h, w), return_index=True, return_counts=True)
            w, h = w[first], h[first]
            order = np.argsort(w)
            w, h, c = w[order], h[order], c[order]
            hd = heads(w)
            known = np.repeat(find(hot.words, w[hd])[1], sizes(hd, len(w)))
            for kind, on in (("w", ~known), ("b", known)):
                ww, hh, cc = w[on], h[on], c[on]
                order, cuts = dealt_out(ww if kind == "w" else hot.route(hh, ww), shards)
                ww, hh, cc = ww[order], hh[order], cc[order]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([kind] * len(cuts), pa.string()),
                        pa.array([s for s, _, _ in cuts], pa.int32()),
                        pa.array([_by_word(ww[a:z], hh[a:z], cc[a:z]) for _, a, z in cuts], pa.binary()),
                    ],
                    names=["kind", "shard", "blob"],
                )

    def meet(t: pa.Table) -> pa.Table:
        utf8.trim()
        w, h, c = [], [], []
        for raw in t.column("blob").to_pylist():
            wu, size, hh, cc = load(raw)
            w.append(np.repeat(wu, size))
            h.append(hh)
            c.append(cc)
        w, h, c = np.concatenate(w), np.concatenate(h), np.concatenate(c).astype(np.int64)
        order = np.argsort(utf8.pair(h, w))
        w, h, c = w[order], h[order], c[order]
        hd = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]) | (h[1:] != h[:-1])])
        w, h, c = w[hd], h[hd], np.add.reduceat(c, hd)
        order = np.argsort(w)
        w, h, c = w[order], h[order], c[order]
        if t.column("kind")[0].as_py() == "w":
            hd = heads(w)
            cw = np.repeat(np.add.reduceat(c, hd), sizes(hd, len(w)))
            order, cuts = dealt_out(hot.route(h, w), shards)
            w, h, c, cw = w[order], h[order], c[order], cw[order]
        else:
            cw, cuts = hot.counts[find(hot.words, w)[0]], [(t.column("shard")[0].as_py(), 0, len(w))]
        made = [("b", s % TURNS, s, _by_word(w[a:z], h[a:z], c[a:z], cw[a:z]), None) for s, a, z in cuts] + [("s", 0, 0, None, _counts_of_counts(c))]
        types = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()))
        return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(zip(*made, strict=True), types, strict=True)], names=["kind", "turn", "shard", "blob", "n"])

    sent = texts(docs).mapInArrow(gather, "kind string, shard int, blob binary")
    return sent.groupBy("kind", "shard").applyInArrow(meet, "kind string, turn int, shard int, blob binary, n array<long>")


def _regroup(stats: Stats, hot: Hot, limit: int):
    """Bigrams of a shard of contexts to a table's blob (kind t), sums of hot contexts (c) and hot bigrams (p)."""

    def run(t: pa.Table) -> pa.Table:
        utf8.trim()
        h, w, c, cw = [], [], [], []
        for raw in t.column("blob").to_pylist():
            wu, cwu, size, hh, cc = load(raw)
            w.append(np.repeat(wu, size))
            cw.append(np.repeat(cwu, size))
            h.append(hh)
            c.append(cc)
        h, w, c, cw = (np.concatenate(x) for x in (h, w, c, cw))
        order = np.lexsort((w, h))
        h, w, c, cw = h[order], w[order], c[order], cw[order]
        shared = find(hot.contexts, h)[1]
        blobs = []
        for on in (~shared, shared):
            hd = heads(h[on])
            own = normalise(stats, c[on].astype(np.int64), cw[on].astype(np.int64), hd)[1] if on is not shared else np.zeros(0)
            blobs.append(dump(h[on][hd], sizes(hd, int(on.sum())).astype(np.uint32), own, w[on], c[on], cw[on]))
        hd = heads(h[shared])
        sums = [np.add.reduceat(x, hd) if len(hd) else np.zeros(0) for x in (
            c[shared].astype(np.int64),
            stats.discounted(c[shared].astype(np.int64), stats.pairs),
            stats.p_word(cw[shared].astype(np.int64)),
        )]
        often = shared & (c >= limit)
        n1, n2 = len(hd), int(often.sum())
        col = lambda first, a, b, kind: pa.array([first, *a.tolist(), *b.tolist()], kind)
        i64 = lambda x: x.view(np.int64)
        nothing = np.full(n2, None)
        return pa.Table.from_arrays(
            [
                pa.array(["t"] + ["c"] * n1 + ["p"] * n2),
                pa.array([t.column("shard")[0].as_py()] * (1 + n1 + n2), pa.int32()),
                pa.array([dump(*load(blobs[0]), *load(blobs[1]))] + [None] * (n1 + n2), pa.binary()),
                col(None, i64(h[shared][hd]), i64(h[often]), pa.int64()),
                col(None, np.full(n1, None), i64(w[often]), pa.int64()),
                col(None, sums[0].astype(np.int64), c[often].astype(np.int64), pa.int64()),
                col(None, np.full(n1, None), cw[often].astype(np.int64), pa.int64()),
                col(None, sums[1], nothing, pa.float64()),
                col(None, sums[2], nothing, pa.float64()),
            ],
            names=["kind", "shard", "blob", "h", "w", "c", "cw", "kept", "low"],
        )

    return run


def fit(docs: DataFrame, shards: int | None = None, hot: int = HOT) -> Model:
    """The bigram model of the texts of docs (doc_id, text) that aren't held out, in tables in the shared folder. hot: the
    bound on how many words, contexts and bigrams all tasks know."""
    spark = docs.sparkSession
    shards = shards or shards_for(docs)
    small_batches(docs)
    of_counts = lambda c: [F.count(F.when(F.least(c, F.lit(KATZ_K + 2)) == r, 1)) for r in range(KATZ_K + 3)]
    with _released(spark):
        words = stored(_words(docs), "katz-words")
        n, v, *own = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), *of_counts(F.col("c"))).first()
        limit = max(1, -(-n // hot))
        top = words.where(F.col("c") >= limit).toArrow()  # at most hot rows
        w, c = top.column("w").to_numpy().view(np.uint64), top.column("c").to_numpy()
        order = np.argsort(w)
        w, c = w[order], c[order]
        known = Hot(w, c, np.sort(np.where(w == END, BEGIN, w)))
        folder, counted = stored_at(_count(docs, shards, known), "katz-counts", "kind", "turn")
        pairs = counted.where("kind = 's'").agg(*[F.coalesce(F.sum(F.col("n")[r]), F.lit(0)) for r in range(KATZ_K + 3)]).first()
        stats = Stats(n, v, tuple(own), tuple(pairs))
        made = []
        for turn in range(TURNS):
            bigrams = counted.where(f"kind = 'b' and turn = {turn}").select("shard", "blob").groupBy("shard")
            schema = "kind string, shard int, blob binary, h long, w long, c long, cw long, kept double, low double"
            made.append(stored(bigrams.applyInArrow(_regroup(stats, known, limit), schema), "katz-pairs", "kind"))
            remove(spark, f"{folder}/kind=b/turn={turn}")
    remove(spark, folder)
    tables = reduce(DataFrame.unionByName, made)
    return Model(words, tables.where("kind = 't'").select("shard", "blob"), stats, shards, _heated(known, stats, tables))


def _heated(known: Hot, stats: Stats, tables: DataFrame) -> Hot:
    """known with hot contexts' totals and weights, summed over shards, and the hot bigrams, at most HOT of each."""
    by = tables.where("kind = 'c'").groupBy("h").agg(F.sum("c").alias("c"), F.sum("kept").alias("kept"), F.sum("low").alias("low")).toArrow()
    h, total, kept, low = (by.column(x).to_numpy() for x in ("h", "c", "kept", "low"))
    order = np.argsort(h.view(np.uint64))
    h, total, left, low = h.view(np.uint64)[order], total[order], (1 - kept / total)[order], low[order]
    none = left <= 1e-12
    bow = np.where(none, 1 / (total + 1), left) / (1 - low)
    often = tables.where("kind = 'p'").select("h", "w", "c", "cw").toArrow()
    a, w, c, cw = (often.column(x).to_numpy() for x in ("h", "w", "c", "cw"))
    at = find(h, a.view(np.uint64))[0]
    p = np.where(none[at], c / (total[at] + 1), stats.discounted(c, stats.pairs) / total[at]) if len(c) else np.zeros(0)
    key = utf8.pair(a.view(np.uint64), w.view(np.uint64))
    order = np.argsort(key)
    return Hot(known.words, known.counts, h, total, none, bow, key[order], p[order], cw[order])


def _table(stats: Stats, hot: Hot, raw: bytes | None) -> tuple[np.ndarray, ...]:
    """(bigram keys, log10 p, log10 (word count + 1); contexts, log10 backoff weights) of a shard, hot contexts' included."""
    key, p, c1, contexts, weights = [], [], [], [hot.contexts], [hot.bow]
    if raw is not None:
        parts = load(raw)
        for own, (h, size, bow, w, c, cw) in ((True, parts[:6]), (False, parts[6:])):
            c = c.astype(np.int64)
            each = np.repeat(h, size)
            if own:
                q, _ = normalise(stats, c, cw.astype(np.int64), np.cumsum(size, dtype=np.int64) - size)
                contexts.append(h)
                weights.append(bow)
            else:
                at = find(hot.contexts, each)[0]
                q = np.where(hot.none[at], c / (hot.totals[at] + 1), stats.discounted(c, stats.pairs) / hot.totals[at]) if len(c) else np.zeros(0)
            key.append(utf8.pair(each, w))
            p.append(q)
            c1.append(cw)
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    key, p, c1, contexts, weights = join(key, np.uint64), join(p, float), join(c1, np.uint32), join(contexts, np.uint64), join(weights, float)
    order, by = np.argsort(key), np.argsort(contexts)
    return key[order], np.log10(p[order]), np.log10(c1[order] + 1.0), contexts[by], np.log10(weights[by])


def _partial(doc: np.ndarray, occurs: np.ndarray, value: np.ndarray, base: np.ndarray, known: np.ndarray) -> bytes:
    """Sums a document of what each of its bigrams gives, occurs places of doc after one another each."""
    n = int(doc.max(initial=0)) + 1
    sums = [np.bincount(doc, weights=np.repeat(x, occurs), minlength=n) for x in (value, base, known)]
    on = np.unique(doc)
    return dump(on.astype(np.uint16), sums[0][on], sums[1][on], sums[2][on].astype(np.uint32))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every row of docs.

    score is the sum over tokens of log10 P(w|h): the bigram's discounted share where it was seen, else the context's
    backoff weight times the word's own probability, an unknown word's being an equal share of the mass of unseen words.
    base_score is that of the add-one unigram model. A null or empty text is its end alone. Rows of null or repeated
    doc_id are returned as they come; an empty table gives no rows; other columns are not read.
    """
    from pyspark import TaskContext

    shards, stats = model.shards, model.stats
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model.hot)  # at most HOT entries of each kind

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flush, hot = TaskContext.get().partitionId() << 24, shared.value
        log_p, log_c = np.log10(hot.pair_p), np.log10(hot.pair_words + 1.0)
        for w, h, n, ids in _batches(batches, False):
            doc = np.repeat(np.arange(len(n), dtype=np.uint16), n)
            at, often = find(hot.pairs, utf8.pair(h, w))
            sums = [np.bincount(doc[often], weights=x, minlength=len(n)) for x in (log_p[at[often]], log_c[at[often]], np.ones(int(often.sum())))] if len(hot.pairs) else [np.zeros(len(n))] * 3
            w, h, doc = w[~often], h[~often], doc[~often]
            order = np.lexsort((w, h))
            w, h, doc = w[order], h[order], doc[order]
            order, cuts = dealt_out(hot.route(h, w, True), shards)
            w, h, doc = w[order], h[order], doc[order]
            blobs, to = [], [s for s, _, _ in cuts]
            for _, a, z in cuts:
                hh, ww = h[a:z], w[a:z]
                pd = np.flatnonzero(np.r_[True, (hh[1:] != hh[:-1]) | (ww[1:] != ww[:-1])])
                hp = hh[pd]
                top = heads(hp)
                blobs.append(dump(hp[top], sizes(top, len(pd)).astype(np.uint32), ww[pd], sizes(pd, z - a).astype(np.uint32), doc[a:z]))
            blobs.append(dump(np.array([i or 0 for i in ids], np.int64), np.array([i is None for i in ids], np.uint8), n.astype(np.int64), *sums))
            own = len(to)
            yield pa.RecordBatch.from_arrays(
                [pa.array([*to, flush % shards], pa.int32()), pa.array([flush] * (own + 1), pa.int64()), pa.array([False] * own + [True]), pa.array(blobs, pa.binary())],
                names=["shard", "flush", "docs", "blob"],
            )
            flush += 1

    def look_up(sent: pa.Table, tables: pa.Table) -> pa.Table:
        utf8.trim()
        hot = shared.value
        kinds, keys, blobs = [], [], []
        key, log_p, log_c, contexts, log_bow = _table(stats, hot, tables.column("blob")[0].as_py() if tables.num_rows else None)
        missed: list[tuple] = []
        for flush, is_docs, raw in zip(sent.column("flush").to_pylist(), sent.column("docs").to_pylist(), sent.column("blob"), strict=True):
            raw = raw.as_py()
            if is_docs:
                kinds.append("d")
                keys.append(flush)
                blobs.append(raw)
                continue
            qh, qsize, qw, occurs, doc = load(raw)
            at, seen = find(key, utf8.pair(np.repeat(qh, qsize), qw))
            value, base, known = np.zeros(len(qw)), np.zeros(len(qw)), seen.astype(np.float64)
            value[seen], base[seen] = log_p[at[seen]], log_c[at[seen]]
            if not seen.all():
                hat, there = find(contexts, qh)
                back = np.zeros(len(qh))
                back[there] = log_bow[hat[there]]
                value[~seen] = np.repeat(back, qsize)[~seen]
                at, top = find(hot.words, qw)
                top &= ~seen  # words that all tasks know needn't go on
                c = hot.counts[at[top]].astype(np.int64)
                value[top] += np.log10(stats.p_word(c))
                base[top], known[top] = np.log10(c + 1.0), 1.0
                on = ~seen & ~top
                if on.any():
                    missed.append((qw[on], occurs[on], doc[np.repeat(on, occurs)], flush))
            kinds.append("p")
            keys.append(flush)
            blobs.append(_partial(doc, occurs, value, base, known))
        if missed:
            mw = np.concatenate([m[0] for m in missed])
            mo = np.concatenate([m[1] for m in missed])
            md = np.concatenate([m[2] for m in missed])
            mf = np.repeat(np.array([m[3] for m in missed], np.int64), [len(m[0]) for m in missed])
            order = np.argsort(mw, kind="stable")
            at = np.cumsum(mo, dtype=np.int64) - mo
            md = md[utf8.flat(at[order], mo[order].astype(np.int64))]
            mw, mo, mf = mw[order], mo[order], mf[order]
            ends, cut = np.r_[0, np.cumsum(mo, dtype=np.int64)], by_shard(mw, shards)
            for s in np.flatnonzero(np.diff(cut)).tolist():
                a, z = int(cut[s]), int(cut[s + 1])
                kinds.append("w")
                keys.append(s)
                blobs.append(dump(mw[a:z], mf[a:z], mo[a:z], md[ends[a] : ends[z]]))
        return pa.table({"kind": pa.array(kinds, pa.string()), "key": pa.array(keys, pa.int64()), "blob": pa.array(blobs, pa.binary())})

    def back_off(sent: pa.Table, tables: pa.Table) -> pa.Table:
        utf8.trim()
        w, cw = tables.column("w").to_numpy().view(np.uint64), tables.column("c").to_numpy()
        order = np.argsort(w)
        w, cw = w[order], cw[order]
        keys, blobs = [], []
        for raw in sent.column("blob").to_pylist():
            qw, flush, occurs, doc = load(raw)
            at, there = find(w, qw)
            c = np.zeros(len(qw), np.int64)
            c[there] = cw[at[there]]
            value, base, known = np.log10(stats.p_word(c)), np.log10(c + 1.0), (c > 0).astype(np.float64)
            order = np.argsort(flush, kind="stable")
            at = np.cumsum(occurs, dtype=np.int64) - occurs
            hd = heads(flush[order])
            for a, n in zip(hd.tolist(), sizes(hd, len(order)).tolist(), strict=True):
                own = order[a : a + n]
                keys.append(int(flush[own[0]]))
                blobs.append(_partial(doc[utf8.flat(at[own], occurs[own].astype(np.int64))], occurs[own], value[own], base[own], known[own]))
        return pa.table({"kind": pa.array(["p"] * len(keys), pa.string()), "key": pa.array(keys, pa.int64()), "blob": pa.array(blobs, pa.binary())})

    flat = math.log10(stats.n + stats.v + 1) if stats.n + stats.v else 0.0  # N + 1 * (V + 1) of the add-one model is N + V + 1

    def total(t: pa.Table) -> pa.Table:
        kinds, blobs = t.column("kind").to_pylist(), t.column("blob")
        ids, none, n, *sums = load(blobs[kinds.index("d")].as_py())
        sums = np.array(sums)
        for k, raw in zip(kinds, blobs, strict=True):
            if k == "p":
                doc, value, base, known = load(raw.as_py())
                for s, x in zip(sums, (value, base, known), strict=True):
                    s[doc] += x
        return pa.table({
            "doc_id": pa.array(ids, pa.int64(), mask=none.astype(bool)),
            "n_tokens": pa.array(n),
            "n_known": pa.array(sums[2].astype(np.int64)),
            "base_score": pa.array(sums[1] - n * flat),
            "score": pa.array(sums[0]),
        })

    kinds, out = "kind string, key long, blob binary", []
    words = model.words.select(F.shiftrightunsigned("w", 64 - shards.bit_length() + 1).cast("int").alias("shard"), "w", "c").groupBy("shard")
    for turn in range(TURNS):
        own = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(TURNS)) == turn)
        sent = texts(own).mapInArrow(gather, "shard int, flush long, docs boolean, blob binary")
        found = sent.groupBy("shard").cogroup(model.pairs.groupBy("shard")).applyInArrow(look_up, kinds)
        with _released(spark):
            folder, found = stored_at(found, "katz-found", "kind")
            unseen = found.where("kind = 'w'").select(F.col("key").cast("int").alias("shard"), "blob")
            second = unseen.groupBy("shard").cogroup(words).applyInArrow(back_off, kinds)
            first = found.where("kind in ('p', 'd')").select("kind", "key", "blob")
            scored = first.unionByName(second).groupBy("key").applyInArrow(total, "doc_id long, n_tokens long, n_known long, base_score double, score double")
            out.append(stored(scored, "katz-scores"))
            remove(spark, folder)
    return reduce(DataFrame.unionByName, out)


def op3(spark, sf_dir: str) -> DataFrame:
    """Katz and add-one scores of all documents, learnt from those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs)
    found = score(docs, model)
    held = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 7 == 2, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.stats.n).cast("long").alias("train_tokens"), "base_score", "score")
