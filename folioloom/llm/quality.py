"""Quality classifier: interpolated modified Kneser-Ney n-grams of trusted text, perplexity quantiles by language.

The n-grams are of characters and run over the spaces between words, so that word order and repetition count. A text is its
words (runs of what isn't white space) with one space between them, a BEGIN before and an END after, both predicted never
and once. Each distinct n-gram is evaluated once; tasks remember what they have seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from folioloom.llm import utf8
from folioloom.llm.cluster import cut, small_batches, table

#: A text's begin and end: white space, so in no word.
BEGIN, END = 9, 10
ORDER = 5
#: A model of up to this many entries (16 bytes each) is sent to every task; a larger one is joined shard by shard.
BROADCAST_ENTRIES = 4_000_000
#: Ids of labelled documents that are sent to every task at most.
SENT_IDS = 2_000_000
#: Slots of a task's memory of n-grams, a power of two; 16 bytes each.
SLOTS = 1 << 21
#: Bytes of text whose n-grams are made at once: some hundred bytes for each are held.
CHUNK = 600_000


def spelled(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(characters of all texts, one after another; text of each): BEGIN, words with one space between, END. A text without
    words has none."""
    starts, ends, count = utf8.words(buf, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = ends - starts + 1  # a word and what follows it
    first = np.zeros(len(starts), bool)
    full = np.flatnonzero(count)
    head = (np.cumsum(count) - count)[full]
    first[head] = True
    at = np.cumsum(size + first) - size
    line = np.full(int(at[-1] + size[-1]), 32, np.uint8)
    line[utf8.flat(at, size - 1)] = buf[utf8.flat(starts, size - 1)]
    line[at[head] - 1] = BEGIN
    last = np.r_[head[1:], len(starts)] - 1
    line[at[last] + size[last] - 1] = END
    codes = np.frombuffer(line.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.int64)
    return codes, full[np.cumsum(codes == BEGIN) - 1]


def grams(codes: np.ndarray, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(hashes of the 1..order-grams that end at each character, its place in its text); a k-gram exists from place k - 1 on."""
    unit = utf8.mix(codes.astype(np.uint64) + np.uint64(1))
    out = [unit]
    for _ in range(1, order):
        g = np.zeros_like(unit)
        g[1:] = utf8.pair(out[-1][:-1], unit[1:])
        out.append(g)
    head = np.flatnonzero(codes == BEGIN)
    return out, np.arange(len(codes)) - np.repeat(head, np.diff(np.r_[head, len(codes)]))


def longest(g: list[np.ndarray], place: np.ndarray) -> np.ndarray:
    """The hash of the longest n-gram that ends at each character: all that its probability depends on."""
    out = g[-1].copy()
    for k in range(len(g) - 1):
        near = np.flatnonzero(place == k)
        out[near] = g[k][near]
    return out


@dataclass(frozen=True)
class Model:
    """Sorted hashes of n-grams with their discounted shares, of contexts with their interpolation weights, by order."""

    order: int
    uniform: float
    grams: tuple[tuple[np.ndarray, np.ndarray], ...]
    contexts: tuple[tuple[np.ndarray, np.ndarray], ...]

    @staticmethod
    def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float) -> np.ndarray:
        if not len(keys):
            return np.full(len(wanted), default)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], default)

    def log_p(self, g: list[np.ndarray], place: np.ndarray, on: np.ndarray) -> np.ndarray:
        """Log probability of each of the characters at on, none of them a BEGIN."""
        p = np.full(len(on), self.uniform)
        for k in range(1, self.order + 1):
            own = np.flatnonzero(place[on] >= k - 1)
            at = on[own]
            context = np.zeros(len(at), np.uint64) if k == 1 else g[k - 2][at - 1]
            p[own] = self._find(*self.grams[k - 1], g[k - 1][at], 0.0) + self._find(*self.contexts[k - 1], context, 1.0) * p[own]
        return np.log(p)


class Memory:
    """Log probabilities of n-grams met before, each in the one slot that its hash names; a newer one takes an older's slot."""

    def __init__(self, model: Model, slots: int = SLOTS):
        self.model, self.mask = model, np.uint64(slots - 1)
        self.keys, self.values = np.zeros(slots, np.uint64), np.zeros(slots)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        """Log probability of each character, 0 of a BEGIN."""
        g, place = grams(codes, self.model.order)
        key = longest(g, place)
        slot = (key & self.mask).astype(np.int64)
        out = self.values[slot]
        new = np.flatnonzero((self.keys[slot] != key) & (place > 0))
        if len(new):
            _, first, which = np.unique(key[new], return_index=True, return_inverse=True)
            value = self.model.log_p(g, place, new[first])
            out[new] = value[which.ravel()]
            self.keys[slot[new[first]]], self.values[slot[new[first]]] = key[new[first]], value
        out[place == 0] = 0.0
        return out


def trusted_ids(labels: DataFrame, most: int | None = None) -> DataFrame:
    """(_id): that half, by a hash of doc_id, of the documents whose labels all say quality 1 and not toxic that the model may learn
    from, up to most of them if that is given; the other half gives the thresholds."""
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 and doc_id is not null")
    half = good.where((F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0) & (F.coalesce("t", F.lit(0)) == 0))
    return (half if most is None else half.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)).select(F.col("doc_id").alias("_id"))


def trusted(docs: DataFrame, labels: DataFrame, most: int | None = None) -> DataFrame:
    """(text) of trusted_ids(labels, most): what the classifier is fitted on. Up to SENT_IDS ids go to all tasks, more are joined."""
    chosen = trusted_ids(labels, most)
    if chosen.count() <= SENT_IDS:
        chosen = F.broadcast(chosen)
    return docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("_id"), "left_semi").select(F.coalesce("text", F.lit("")).alias("text"))


def count(sample: DataFrame, order: int) -> DataFrame:
    """(k, gram, context, suffix, opens, c): counts of the sample's k-grams; suffix: the gram without its first character,
    opens: it begins with BEGIN."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, at = utf8.column(b, "text")
            for i, j in utf8.chunks(at, CHUNK):
                codes, _ = spelled(buf[at[i] : at[j]], at[i : j + 1] - at[i])
                g, place = grams(codes, order)
                for k in range(1, order + 1):
                    on = np.flatnonzero(place >= max(1, k - 1))
                    if not len(on):
                        continue
                    keys, pick, c = np.unique(g[k - 1][on], return_index=True, return_counts=True)
                    pick = on[pick]
                    context = np.zeros(len(pick), np.uint64) if k == 1 else g[k - 2][pick - 1]
                    suffix = np.zeros(len(pick), np.uint64) if k == 1 else g[k - 2][pick]
                    i64 = lambda x: pa.array(x.view(np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(keys), k, np.int32)), i64(keys), i64(context), i64(suffix), pa.array(place[pick] == k - 1), pa.array(c)],
                        names=["k", "gram", "context", "suffix", "opens", "c"],
                    )

    kinds = "k int, gram long, context long, suffix long, opens boolean, c long"
    return small_batches(sample).mapInArrow(run, kinds).groupBy("k", "gram", "context", "suffix", "opens").agg(F.sum("c").alias("c"))


def fit_tables(sample: DataFrame, order: int = ORDER) -> tuple[DataFrame, DataFrame]:
    """(k, gram, share), (k, context, weight) of the interpolated modified Kneser-Ney model, by joins of count tables dealt
    out by their hashes. Below the top order a gram's count is the number of characters before it, unless it opens a text;
    discounts come from counts of counts of each order, and are (1/2, 1, 3/2) where those are too few."""
    raw = cut(count(sample, order))
    extended = raw.where("k > 1").groupBy((F.col("k") - 1).alias("k"), F.col("suffix").alias("gram")).agg(F.count("*").alias("left"))
    adjusted = raw.join(extended, ["k", "gram"], "left").withColumn(
        "a",
        F.when((F.col("k") == order) | F.col("opens"), F.col("c")).otherwise(F.coalesce("left", F.col("c"))),
    ).select("k", "gram", "context", "a")
    n = lambda r: F.count(F.when(F.col("a") == r, 1))
    counts = {r.k: r for r in adjusted.groupBy("k").agg(*[n(i).alias(f"n{i}") for i in (1, 2, 3, 4)]).collect()}  # a row an order

    def discount(k: int) -> tuple[float, float, float]:
        r = counts.get(k)
        if not r or not (r.n1 and r.n2 and r.n3 and r.n4):
            return 0.5, 1.0, 1.5
        y = r.n1 / (r.n1 + 2 * r.n2)
        d = (1 - 2 * y * r.n2 / r.n1, 2 - 3 * y * r.n3 / r.n2, 3 - 4 * y * r.n4 / r.n3)
        return d if all(0 < x < i for i, x in enumerate(d, 1)) else (0.5, 1.0, 1.5)

    d = F.lit(0.0)
    for k in range(1, order + 1):
        d1, d2, d3 = discount(k)
        d = F.when(F.col("k") == k, F.when(F.col("a") == 1, d1).when(F.col("a") == 2, d2).otherwise(d3)).otherwise(d)
    each = adjusted.withColumn("d", d)
    contexts = each.groupBy("k", "context").agg(F.sum("a").alias("total"), F.sum("d").alias("freed"))
    share = each.join(contexts, ["k", "context"]).select("k", "gram", ((F.col("a") - F.col("d")) / F.col("total")).alias("share"))
    return share, contexts.select("k", "context", (F.col("freed") / F.col("total")).alias("weight"))


def load(shares: DataFrame, weights: DataFrame, order: int) -> Model:
    """The tables of fit_tables() as sorted arrays; their size is for the caller to check."""

    def arrays(df: DataFrame, key: str, value: str) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
        t = df.select("k", key, value).toArrow()
        k, h, v = (t.column(c).to_numpy() for c in ("k", key, value))
        out = []
        for i in range(1, order + 1):
            u, x = h[k == i].view(np.uint64), v[k == i]
            o = np.argsort(u)
            out.append((u[o], x[o]))
        return tuple(out)

    g = arrays(shares, "gram", "share")
    return Model(order, 1.0 / (len(g[0][0]) + 1), g, arrays(weights, "context", "weight"))


def with_score(docs: DataFrame, model: Model, name: str = "log_perplexity") -> DataFrame:
    """docs, whole, and name, in the place of a column of that name: the mean negative log probability a character of each
    text; null where it has no words."""
    shared, docs = docs.sparkSession.sparkContext.broadcast(model), docs.drop(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory(shared.value)
        for b in batches:
            buf, at = utf8.column(b, "text")
            out = np.full(len(at) - 1, np.nan)
            for i, j in utf8.chunks(at, CHUNK):
                codes, text = spelled(buf[at[i] : at[j]], at[i : j + 1] - at[i])
                n = np.bincount(text, minlength=j - i)
                with np.errstate(invalid="ignore", divide="ignore"):
                    out[i:j] = -np.bincount(text, weights=memory(codes), minlength=j - i) / np.where(n > 0, n - 1, np.nan)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, mask=np.isnan(out))], names=[*b.schema.names, name])

    return small_batches(docs).mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def joined_score(docs: DataFrame, shares: DataFrame, weights: DataFrame, order: int = ORDER, name: str = "log_perplexity") -> DataFrame:
    """with_score() by joins alone, for a model of any size: each distinct n-gram of the documents is joined, shard by shard,
    with the tables of every order and evaluated once; the documents' n-gram counts are joined with that, summed a text, and
    joined with the documents by two hashes of the text. Spark splits the shards of texts that very many rows share."""
    docs = docs.drop(name)
    hashed = docs.withColumns({"_t1": F.xxhash64("text"), "_t2": F.xxhash64(F.lit(1), "text")})
    plain = hashed.select("_t1", "_t2", F.coalesce("text", F.lit("")).alias("text"))
    i64 = lambda x: pa.array(x.view(np.int64))

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            buf, at = utf8.column(b, "text")
            for i, j in utf8.chunks(at, CHUNK):
                codes, text = spelled(buf[at[i] : at[j]], at[i : j + 1] - at[i])
                g, place = grams(codes, order)
                yield b, i, text, g, place, longest(g, place)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, i, text, _, place, key in steps(batches):
            on = np.flatnonzero(place > 0)
            pick = on[np.lexsort((key[on], text[on]))]
            head = np.flatnonzero(np.r_[True, (key[pick][1:] != key[pick][:-1]) | (text[pick][1:] != text[pick][:-1])]) if len(pick) else np.zeros(0, np.int64)
            row = pa.array(i + text[pick[head]])
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(row), b.column(1).take(row), i64(key[pick[head]]), pa.array(np.diff(np.r_[head, len(pick)]))],
                names=["_t1", "_t2", "key", "n"],
            )

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, g, place, key in steps(batches):
            on = np.flatnonzero(place > 0)
            keys, first = np.unique(key[on], return_index=True)
            at = on[first]
            for k in range(1, order + 1):
                own = np.flatnonzero(place[at] >= k - 1)
                context = np.zeros(len(own), np.uint64) if k == 1 else g[k - 2][at[own] - 1]
                yield pa.RecordBatch.from_arrays([i64(keys[own]), pa.array(np.full(len(own), k, np.int32)), i64(g[k - 1][at[own]]), i64(context)], names=["key", "k", "gram", "context"])

    small_batches(docs)
    asked = plain.mapInArrow(distinct, "key long, k int, gram long, context long").distinct()
    known = asked.join(shares, ["k", "gram"], "left").join(weights, ["k", "context"], "left")
    step = F.struct("k", F.coalesce("share", F.lit(0.0)).alias("s"), F.coalesce("weight", F.lit(1.0)).alias("w"))
    uniform = shares.where("k = 1").agg((1.0 / (F.count("*") + 1)).alias("u"))
    each = known.groupBy("key").agg(F.sort_array(F.collect_list(step)).alias("steps")).join(F.broadcast(uniform))  # one row; order steps a key
    logs = each.select("key", F.log(F.aggregate("steps", F.col("u"), lambda p, x: x.s + x.w * p)).alias("l"))
    counts = plain.mapInArrow(counted, "_t1 long, _t2 long, key long, n long").groupBy("_t1", "_t2", "key").agg(F.max("n").alias("n"))  # a text's rows agree
    mean = (-F.sum(F.col("n") * F.col("l")) / F.sum("n")).alias(name)
    found = counts.join(logs, "key").groupBy("_t1", "_t2").agg(mean)
    return hashed.join(found, ["_t1", "_t2"], "left").select(*docs.columns, name)


STEP = 1e-3  # log perplexities are counted in steps of this for the quantiles


def thresholds(scores: DataFrame, labels: DataFrame, low: float, high: float) -> DataFrame:
    """(lang, least, most): quantiles low and high of log_perplexity over all documents labelled quality 1 of the half that no
    model learns from (a document learnt from looks more usual than it is), by language, from whole counts by steps of
    STEP; lang '*' has those of all languages together."""
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    good = good.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1)
    own = scores.where("log_perplexity is not null").join(good, "doc_id").select(F.coalesce("lang", F.lit("")).alias("lang"), F.floor(F.col("log_perplexity") / STEP).alias("step"))
    by = own.groupBy("lang", "step").agg(F.count("*").alias("n"))
    by = by.unionAll(by.groupBy(F.lit("*").alias("lang"), "step").agg(F.sum("n").alias("n")))
    # the steps of a language are few, whatever the number of documents: at most the spread of perplexities over STEP
    listed = by.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("step", "n"))).alias("s"), F.sum("n").alias("total"))
    passed = lambda q: F.aggregate(
        "s",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("at")),
        lambda a,
        x: F.struct((a.n + x.n).alias("n"), F.coalesce(a.at, F.when(a.n + x.n > q * F.col("total"), x.step)).alias("at")),
        lambda a: F.coalesce(a.at, F.element_at("s", -1).step),
    )
    return listed.select("lang", (passed(low) * STEP).alias("least"), ((passed(high) + 1) * STEP).alias("most"))


def judged(scored: DataFrame, bounds: DataFrame, score: str = "log_perplexity", keep: str = "keep") -> DataFrame:
    """scored with keep: score lies within the bounds of the row's language, or of all languages together where
    the language has none; false where it's null (no words). Without any bounds all rows with words are kept."""
    if bounds.count() <= 10_000:  # languages
        bounds = F.broadcast(bounds)
    every = bounds.where("lang = '*'").select(F.col("least").alias("_all_least"), F.col("most").alias("_all_most"), F.lit(1).alias("_one"))
    own = bounds.where("lang <> '*'").select(F.col("lang").alias("_lang"), F.col("least").alias("_least"), F.col("most").alias("_most"))
    both = scored.withColumn("_one", F.lit(1)).join(F.broadcast(every), "_one", "left").join(own, F.coalesce("lang", F.lit("")) == F.col("_lang"), "left")
    least, most = F.coalesce("_least", "_all_least", F.lit(float("-inf"))), F.coalesce("_most", "_all_most", F.lit(float("inf")))
    return both.withColumn(keep, F.coalesce(F.col(score).between(least, most), F.lit(False))).drop("_one", "_all_least", "_all_most", "_lang", "_least", "_most")


LOW, HIGH = 0.001, 0.985


def scorer(docs: DataFrame, labels: DataFrame, trusted_docs: int | None = None, order: int = ORDER, broadcast_entries: int = BROADCAST_ENTRIES):
    """A function (docs, name) -> docs with name, of the model of trusted(docs, labels, trusted_docs). The model's size is
    checked: up to broadcast_entries tasks hold it, a larger one is joined; results are the same."""
    shares, weights = (cut(t) for t in fit_tables(trusted(docs, labels, trusted_docs), order))
    if shares.count() + weights.count() <= broadcast_entries:
        model = load(shares, weights, order)
        return lambda df, name="log_perplexity": with_score(df, model, name)
    return lambda df, name="log_perplexity": joined_score(df, shares, weights, order, name)


def labelled(docs: DataFrame, labels: DataFrame, most: int = SENT_IDS) -> DataFrame:
    """doc_id, lang, text of docs that have a label; up to most ids go to all tasks, more are joined."""
    ids = labels.where("doc_id is not null and quality is not null").select("doc_id").distinct()
    if ids.count() <= most:
        ids = F.broadcast(ids)
    return docs.select("doc_id", "lang", "text").join(ids, "doc_id", "left_semi")


def classify(
    docs: DataFrame,
    labels: DataFrame,
    trusted_docs: int | None = None,
    low: float = LOW,
    high: float = HIGH,
    order: int = ORDER,
    broadcast_entries: int = BROADCAST_ENTRIES,
    score: str = "log_perplexity",
    keep: str = "keep",
) -> DataFrame:
    """docs with score and keep, in the place of columns of these names. Labelled documents are scored for the thresholds,
    which cover all of them, then each document as it passes; no text is moved between tasks but where the model is joined.

    Rows of null or repeated doc_id are judged like any other; a null or blank text has no perplexity and isn't kept; an
    empty table gives no rows. docs must have lang; other columns pass unchanged.
    """
    scored = scorer(docs, labels, trusted_docs, order, broadcast_entries)
    bounds = cut(thresholds(scored(labelled(docs, labels)).drop("text"), labels, low, high))
    return judged(scored(docs.drop(keep), score), bounds, score, keep)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, log_perplexity and keep of all documents: each is scored once, and the thresholds taken from that."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), table(spark, sf_dir, "labels")
    scores = cut(scorer(docs, labels)(docs).drop("text"))
    return judged(scores, cut(thresholds(scores, labels, LOW, HIGH))).select("doc_id", "lang", "log_perplexity", "keep")
