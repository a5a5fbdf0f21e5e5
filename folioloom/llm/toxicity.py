"""Toxicity: a classifier chain of linear models over words, each link fed the earlier links' out-of-fold probabilities.

Labels only say whether a document is toxic. The categories of the chain are kinds of toxic documents, found among the
labelled ones by what they share (kinds()), in whatever language; the last link is the label itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from folioloom.llm import utf8
from folioloom.llm.cluster import cut, small_batches, table

#: Kinds of toxic documents that the chain tells apart before it judges.
KINDS = 3

_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


#: Besides a word itself, its first so many bytes are features: stems that compounds share.
STEMS = (4, 5, 6, 7, 8)


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of text features, and how many each text has): of each run of letters and digits, lower-cased A-Z, whole and
    cut to each length of STEMS; bytes beyond ASCII count as letters."""
    plain = np.where(_IN_WORD[buf], utf8.LOWER[buf], np.uint8(32))
    s, e, n = utf8.words(plain, offsets)
    ends = np.minimum(e[:, None], s[:, None] + np.array([*STEMS, 1 << 40]))
    return utf8.hashes(plain, np.repeat(s, len(STEMS) + 1), ends.ravel()), n * (len(STEMS) + 1)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.03, rounds: int = 150) -> np.ndarray:
    """Weights of a logistic regression, the bias last and not shrunk: accelerated gradient steps."""
    n, d = x.shape
    xb = np.c_[x, np.ones(n)].astype(np.float32)
    w = v = np.zeros(d + 1, np.float32)
    y, shrink = y.astype(np.float32), np.r_[np.full(d, l2), 1e-6].astype(np.float32)
    step = 1 / (0.25 * np.linalg.norm(xb, "fro") ** 2 + l2)
    # the largest eigenvalue, by power iteration, gives longer steps than the whole norm
    u = np.full(d + 1, 1 / np.sqrt(d + 1), np.float32)
    for _ in range(30):
        u = xb.T @ (xb @ u)
        top = np.linalg.norm(u)
        if not top:
            break
        u /= top
    if top:
        step = 1 / (0.25 * top * 1.1 + l2)
    t = 1.0
    for _ in range(rounds):
        g = xb.T @ (sigmoid(xb @ v) - y) + shrink * v
        after = v - np.float32(step) * g
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = after + np.float32((t - 1) / t2) * (after - w)
        w, t = after, t2
    return w.astype(np.float64)


@dataclass(frozen=True)
class Chain:
    """Sorted word hashes, links (name, weights over words, earlier links' log odds and bias) and the last one's threshold."""

    words: np.ndarray
    links: tuple[tuple[str, np.ndarray], ...]
    threshold: float

    def probabilities(self, doc: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
        """Of n documents, from pairs (document, place among words) without repeats: a column a link."""
        out, odds = [], []
        for _, w in self.links:
            z = np.bincount(doc, weights=w[word], minlength=n) + w[-1]
            for k, o in enumerate(odds):
                z = z + w[len(self.words) + k] * o
            odds.append(np.clip(z, -6, 6))
            out.append(sigmoid(z))
        return np.array(out).T.reshape(n, len(self.links))


def _folds(text: np.ndarray, folds: int) -> np.ndarray:
    """By a hash of the whole text, so that copies share a fold."""
    return (utf8.mix(text) % np.uint64(folds)).astype(np.int64)


def kinds(x: np.ndarray, most: int, rounds: int = 20) -> np.ndarray:
    """The kind, 0 .. most - 1 by size, of each row of x, features present: spherical k-means over features weighted by how
    rare they are. Centres begin farthest from each other, so that the result is always the same."""
    if not len(x):
        return np.zeros(0, np.int64)
    v = x * np.log((1 + len(x)) / (1 + x.sum(axis=0)))
    size = np.sqrt((v**2).sum(axis=1, keepdims=True))
    v = v / np.where(size > 0, size, 1)
    picked = [int(v.sum(axis=1).argmax())]
    while len(picked) < most:
        near = (v @ v[picked].T).max(axis=1)
        picked.append(int(near.argmin()))
    centre, kind = v[picked], np.zeros(len(x), np.int64)
    for _ in range(rounds):
        after = (v @ centre.T).argmax(axis=1)
        if (after == kind).all() and _:
            break
        kind = after
        for k in range(most):
            mean = v[kind == k].sum(axis=0)
            norm = np.sqrt((mean**2).sum())
            if norm:
                centre[k] = mean / norm
    by = np.argsort(-np.bincount(kind, minlength=most), kind="stable")
    place = np.empty(most, np.int64)
    place[by] = np.arange(most)
    return place[kind]


def fit_chain(x: np.ndarray, ys: dict[str, np.ndarray], fold: np.ndarray, words: np.ndarray, precision: float, share: float | None = None) -> Chain:
    """Links in the order of ys. Each is trained on the words and the out-of-fold log odds of the links before; its own
    out-of-fold log odds come from models of the other folds. The threshold is the least at which the last link's
    out-of-fold predictions have the precision asked for, where a share of documents is toxic as given (as in y, if not)."""
    links, extra = [], np.zeros((len(x), 0))
    p = np.zeros(len(x))
    for name, y in ys.items():
        full = np.c_[x, extra]
        z = np.zeros(len(x))
        if 0 < y.sum() < len(y):
            for f in np.unique(fold):
                hold = fold == f
                rest = y[~hold]
                if 0 < rest.sum() < len(rest):
                    w = logistic(full[~hold], rest)
                    z[hold] = full[hold] @ w[:-1] + w[-1]
                else:
                    z[hold] = -6.0
            w = logistic(full, y)
        else:
            z[:] = 6.0 if len(y) and y.all() else -6.0
            w = np.r_[np.zeros(full.shape[1]), 6.0 if len(y) and y.all() else -6.0]
        links.append((name, w))
        z = np.clip(z, -6, 6)
        extra = np.c_[extra, z]
        p = sigmoid(z)
    y = list(ys.values())[-1]
    order = np.argsort(-p, kind="stable")
    toxic = y.sum() / max(1, len(y))
    share = toxic if share is None else share
    weight = np.where(y > 0, share / toxic if toxic else 0, (1 - share) / (1 - toxic) if toxic < 1 else 0)[order]
    with np.errstate(invalid="ignore", divide="ignore"):
        right = np.nan_to_num(np.cumsum(weight * y[order]) / np.cumsum(weight))
    last = np.r_[p[order][1:] != p[order][:-1], True] if len(y) else np.zeros(0, bool)
    good = np.flatnonzero(last & (right >= precision))
    if not len(good):
        return Chain(words, tuple(links), 0.5)
    # halfway, in log odds, to the next lower prediction, so that a document a little less telling is still caught
    at = good[-1]
    logit = lambda q: np.log(q / (1 - q))
    below = p[order][at + 1] if at + 1 < len(p) else p[order][at]
    return Chain(words, tuple(links), float(sigmoid((logit(p[order][at]) + logit(below)) / 2)))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 6000, features: int = 384, folds: int = 5, precision: float = 0.9) -> Chain:
    """The chain, from at most sample_rows labelled documents, half of them toxic where there are enough, chosen by a hash of
    doc_id, and the `features` words and stems whose presence tells most about the label by chi square. A document's label is toxic if
    any of its rows is. Its threshold holds at the share of toxic documents that all labels have. Of rows of one doc_id one
    teaches. Without documents of both labels nothing is found toxic."""
    one = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    half = sample_rows // 2
    chosen = one.where("toxic = 1").orderBy(*order).limit(half).unionAll(one.where("toxic <> 1").orderBy(*order).limit(sample_rows - half))
    chosen = chosen.select(F.col("doc_id").alias("_id"), "toxic")  # at most sample_rows ids
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select(
        "doc_id",
        F.coalesce("text", F.lit("")).alias("text"),
        F.col("toxic").cast("int").alias("toxic"),
    )
    share = one.agg(F.avg(F.when(F.col("toxic") == 1, 1.0).otherwise(0.0))).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, at = utf8.column(b, "text")
            h, n = word_hashes(buf, at)
            whole = utf8.hashes(buf, at[:-1], at[1:])
            ends = np.r_[0, np.cumsum(n)]
            own = [np.unique(h[a:z]) for a, z in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), pa.array(whole.view(np.int64)), b.column(2), pa.array([w.view(np.int64) for w in own], pa.list_(pa.int64()))],
                names=["doc_id", "whole", "toxic", "words"],
            )

    made = small_batches(sample).mapInArrow(run, "doc_id long, whole long, toxic int, words array<long>")
    first = made.groupBy("doc_id").agg(F.min_by(F.struct("whole", "toxic", "words"), "whole").alias("r")).select("doc_id", "r.*")
    spelled = cut(first.dropDuplicates(["whole", "toxic"]))  # copies teach once: at most sample_rows rows
    n1, n0 = spelled.agg(F.count(F.when(F.col("toxic") == 1, 1)), F.count(F.when(F.col("toxic") != 1, 1))).first()
    by = spelled.select("toxic", F.explode("words").alias("w")).groupBy("w").agg(
        F.count(F.when(F.col("toxic") == 1, 1)).alias("a"),
        F.count(F.when(F.col("toxic") != 1, 1)).alias("b"),
    ).where("a + b >= 6")
    n = n1 + n0
    chi = F.pow(F.col("a") * n0 - F.col("b") * n1, 2) / ((F.col("a") + F.col("b")) * (n - F.col("a") - F.col("b") + 1.0))
    # only what chance gives less often than once in a thousand: chi square over 10.83
    picked = by.select("w", chi.alias("chi")).where(F.col("chi") * n >= 10.83 * n1 * n0).orderBy(F.desc("chi"), "w").limit(features)
    words = np.array(sorted(np.array([r.w for r in picked.collect()], np.int64).view(np.uint64).tolist()), np.uint64)
    asked = F.array(*[F.lit(int(w)) for w in words.view(np.int64).tolist()]) if len(words) else F.array().cast("array<long>")
    got = sorted(
        spelled.select("doc_id", "whole", "toxic", F.array_intersect("words", asked).alias("words")).collect(),
        key=lambda r: (r.doc_id, r.whole),
    )  # at most sample_rows rows of at most `features`
    x = np.zeros((len(got), len(words)))
    for i, r in enumerate(got):
        if r.words:
            x[i, np.searchsorted(words, np.array(r.words, np.int64).view(np.uint64))] = 1
    toxic = np.array([r.toxic == 1 for r in got], float)
    kind = np.full(len(got), -1)
    kind[toxic > 0] = kinds(x[toxic > 0], KINDS)
    ys = {f"kind{k}": (kind == k).astype(float) for k in range(KINDS)} | {"toxic": toxic}
    return fit_chain(x, ys, _folds(np.array([r.whole for r in got], np.int64).view(np.uint64), folds), words, precision, share)


def classify(docs: DataFrame, chain: Chain, prefix: str = "p_", flag: str = "toxic") -> DataFrame:
    """docs, whole, with <prefix><category> of each link and flag: the last link's probability reaches the threshold.

    A null or empty text has the chances of a text without known words. Rows of null or repeated doc_id are judged like any
    other; an empty table gives no rows. Columns of docs of these names are replaced, all others pass unchanged.
    """
    names = [f"{prefix}{k}" for k, _ in chain.links]
    docs = docs.drop(*names, flag)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = np.zeros(1 << 16, bool)
        sieve[chain.words & np.uint64(0xFFFF)] = True
        for b in batches:
            buf, at = utf8.column(b, "text")
            p = np.zeros((len(at) - 1, len(names)))
            for i, j in utf8.chunks(at):
                h, n = word_hashes(buf[at[i] : at[j]], at[i : j + 1] - at[i])
                doc, word = np.zeros(0, np.int64), np.zeros(0, np.int64)
                if len(chain.words):
                    at_ = np.flatnonzero(sieve[h & np.uint64(0xFFFF)])  # most features are none of the model's
                    spot = np.minimum(np.searchsorted(chain.words, h[at_]), len(chain.words) - 1)
                    on = chain.words[spot] == h[at_]
                    key = np.unique(np.repeat(np.arange(j - i), n)[at_[on]] * len(chain.words) + spot[on])
                    doc, word = key // len(chain.words), key % len(chain.words)
                p[i:j] = chain.probabilities(doc, word, j - i)
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(np.ascontiguousarray(c)) for c in p.T], pa.array(p[:, -1] >= chain.threshold)], names=[*b.schema.names, *names, flag])

    return small_batches(docs).mapInArrow(run, StructType([*docs.schema.fields, *[StructField(k, DoubleType()) for k in names], StructField(flag, BooleanType())]))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, a probability a category, and toxic, of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, fit(docs, table(spark, sf_dir, "labels"))).drop("text")
