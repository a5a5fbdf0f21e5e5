"""Language identification: bit-sliced Bloom filters of character n-grams, one slice a language.

Texts become lower-case letters with single spaces between words; n-grams run over spaces. A language contains an n-gram if its
share of documents with it is no small part of any other language's. All languages' filters lie in one table of slots, each slot a
bit mask of languages: the masks of an n-gram's slots, and-ed, are the languages that contain it. A text's n-grams are counted per
language, what false positives add on average is taken off, and the highest count decides.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioloom.llm import utf8
from folioloom.llm.cluster import small_batches, stored, table

WIDTH = 4
HASHES = 4
#: Slots for each n-gram of all filters together.
SLOTS_PER_GRAM = 8
#: A language contains an n-gram if its share of documents with it is this part, or more, of the largest share of any language.
RATIO = 0.2
#: ... and is this or more: since documents hold finitely many n-grams each, this bounds how many n-grams a language can have, by
#: the mean number of distinct ones in a document over it, whatever the size of the corpus.
FLOOR = 1e-4
#: Bytes of the slots at most; where more would be needed the floor is doubled until they fit.
MOST_BYTES = 64 << 20
UNKNOWN = "und"

#: Entries that a counting task holds before it hands them on, and code points handled at once (a longer text alone, whole).
HELD = 1_500_000
CHUNK = 1_000_000

SLICE = 1 << 16


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(texts: list[str], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each n-gram, how many each text has); a text without a letter has none, one shorter than width has one."""
    lowered = [" " + t.lower() + " " for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    edges = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in lowered], out=edges[1:])
    letter = _letters()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[edges[:-1]] = True
    at = np.concatenate([[0], np.cumsum(keep)])[edges]
    codes = np.where(letter, codes, 32)[keep].astype(np.uint64)
    size = np.diff(at)
    n = np.where(size > 1, np.maximum(1, size - width + 1), 0)
    start = utf8.flat(at[:-1], n)
    last = np.repeat(at[1:] - 1, n)
    out = np.zeros(len(start), np.uint64)
    for k in range(width):
        c = codes[np.minimum(start + k, last)]
        out = utf8.mix(out ^ (c + np.uint64(1))) if k % 3 == 2 or k == width - 1 else (out ^ (c + np.uint64(1))) << np.uint64(21)
    return out, n


def _chunked(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) in chunks of about CHUNK code points, nulls as empty texts."""
    first, held, size = 0, [], 0
    for k, t in enumerate(column):
        t = t.as_py() or ""
        if held and size + len(t) > CHUNK:
            yield first, held
            first, held, size = k, [], 0
        held.append(t)
        size += len(t)
    if held:
        yield first, held


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _in_documents(found: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of some texts and how many of the texts have each."""
    order = np.argsort(found, kind="stable")
    key, doc = found[order], np.repeat(np.arange(len(n)), n)[order]
    new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
    pair = new | np.r_[True, doc[1:] != doc[:-1]] if len(key) else new
    first = np.flatnonzero(new)
    return key[first], np.add.reduceat(pair.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)


def counted(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(lang, gram, n): in how many documents (text, lang) of each language an n-gram is; gram null: how many the language has.
    Rows without a language or text don't count. Counts are summed in a task before any shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        seen: dict[str, int] = {}
        size = 0

        def given() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                key, n = _summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
                yield pa.record_batch([pa.array([lang] * len(key), pa.string()), pa.array(key.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])
            held.clear()
            utf8.trim()

        for b in batches:
            lang = b.column(1).to_pylist()
            for first, texts in _chunked(b.column(0)):
                by: dict[str, list[str]] = {}
                for k, t in enumerate(texts):
                    by.setdefault(lang[first + k], []).append(t)
                for name, own in by.items():
                    part = _in_documents(*grams(own, width))
                    seen[name] = seen.get(name, 0) + len(own)
                    held.setdefault(name, []).append(part)
                    size += len(part[0])
                if size > HELD:
                    for name, parts in held.items():
                        held[name] = [_summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))]
                    size = sum(len(p[0][0]) for p in held.values())
                    if size > HELD // 2:
                        yield from given()
                        size = 0
        yield from given()
        yield pa.record_batch([pa.array(list(seen), pa.string()), pa.nulls(len(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["lang", "gram", "n"])

    own = small_batches(docs).where("lang is not null and text is not null").select("text", F.col("lang").cast("string").alias("lang"))
    return own.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _slots(found: np.ndarray, k: int, mask: int) -> np.ndarray:
    """The k-th slot of each n-gram."""
    return (found + np.uint64(k) * (utf8.mix(found) | np.uint64(1)) & np.uint64(mask)).astype(np.int64)


@dataclass(frozen=True)
class Filters:
    """languages: the most frequent first; words: arrays of slots, each slot a mask of up to 64 languages; false_positive: the
    chance of each language's filter to hold an n-gram that the language doesn't contain."""

    languages: list[str]
    words: list[np.ndarray]
    false_positive: np.ndarray
    width: int
    hashes: int

    def popcounts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages: how many n-grams each language's filter holds, how many n-grams each text has)."""
        found, n = grams(texts, self.width)
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        some = np.flatnonzero(n)
        if len(some):
            ends = np.cumsum(n)[some]
            slots = [_slots(found, k, len(self.words[0]) - 1) for k in range(self.hashes)]
            for w, held in enumerate(self.words):
                mask = held[slots[0]]
                for s in slots[1:]:
                    mask &= held[s]
                for bit in range(min(64, len(self.languages) - 64 * w)):
                    total = np.cumsum((mask >> held.dtype.type(bit)) & held.dtype.type(1), dtype=np.int64)[ends - 1]
                    out[some, 64 * w + bit] = np.diff(total, prepend=0)
        return out, n

    def decide(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """(language, score) of each text; und and 0 where a text has no letter or nothing was learned. Ties go to the language
        with more documents, then by name; a text none of whose n-grams is known to the most frequent, with score 0."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        counts, n = self.popcounts(texts)
        f = self.false_positive
        real = np.maximum(0.0, (counts - n[:, None] * f) / (1 - f))
        best = real.argmax(axis=1)
        total = real.sum(axis=1)
        score = np.where(total > 0, real[np.arange(len(real)), best] / np.where(total > 0, total, 1.0), 0.0)
        return [self.languages[i] if m else UNKNOWN for i, m in zip(best, n, strict=True)], np.where(n > 0, score, 0.0)


def fit(docs: DataFrame, width: int = WIDTH, hashes: int = HASHES, ratio: float = RATIO, floor: float = FLOOR, slots_per_gram: int = SLOTS_PER_GRAM, most_bytes: int = MOST_BYTES) -> Filters:
    """The filters of all documents (text, lang) that have both. No such document: no languages."""
    counts = stored(counted(docs, width), "langid-counts")
    known = sorted(((r.n, r.lang) for r in counts.where("gram is null").collect()), key=lambda r: (-r[0], r[1]))
    if not known:
        return Filters([], [], np.zeros(0), width, hashes)
    spark = docs.sparkSession
    languages = spark.createDataFrame([(lang, i, n) for i, (n, lang) in enumerate(known)], "lang string, i int, docs long")
    rate = counts.where("gram is not null and n > 1").join(F.broadcast(languages), "lang").select("gram", "i", "n", (F.col("n") / F.col("docs")).alias("rate"))
    best = rate.groupBy("gram").agg(F.max("rate").alias("best"), F.collect_list(F.struct("i", "rate")).alias("l"))
    kept = stored(best.select("gram", F.filter("l", lambda x: (x["rate"] >= ratio * F.col("best")) & (x["rate"] >= floor)).alias("l")).where(F.size("l") > 0), "langid-grams")
    dtype = next(d for d, bits in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if len(known) <= bits or bits == 64)
    words = -(-len(known) // 64)
    while True:
        total = kept.where(F.exists("l", lambda x: x["rate"] >= floor)).count()
        size = max(SLICE, 1 << (max(1, total) * slots_per_gram - 1).bit_length())
        if size * words * np.dtype(dtype).itemsize <= max(most_bytes, SLICE * words * 8):
            break
        floor *= 2
    own = kept.select("gram", F.filter("l", lambda x: x["rate"] >= floor).alias("l")).where(F.size("l") > 0)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = b.column(0).to_numpy().view(np.uint64)
            at = [_slots(found, k, size - 1) for k in range(hashes)]
            for w, word in enumerate(b.columns[1:]):
                bits = np.tile(word.to_numpy(), hashes)
                slot = np.concatenate(at)
                some = bits != 0
                yield pa.record_batch([pa.array(slot[some]), pa.array(np.full(int(some.sum()), w, np.int32)), pa.array(bits[some])], names=["slot", "word", "bits"])

    def bits(w: int) -> Column:
        mine = F.filter("l", lambda x: (x["i"] >= 64 * w) & (x["i"] < 64 * (w + 1)))
        return F.aggregate(mine, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), x["i"] - 64 * w))).alias(f"w{w}")

    def packed(t: pa.Table) -> pa.Table:
        held = np.zeros(SLICE, np.uint64)
        np.bitwise_or.at(held, t.column("slot").to_numpy() % SLICE, t.column("bits").to_numpy().view(np.uint64))
        part, word = t.column("part")[0].as_py(), t.column("word")[0].as_py()
        return pa.table({"part": [part], "word": pa.array([word], pa.int32()), "data": [zlib.compress(held.astype(dtype).tobytes(), 1)]})

    marks = own.select("gram", *[bits(w) for w in range(words)]).mapInArrow(spread, "slot long, word int, bits long")
    slices = marks.withColumn("part", F.expr(f"slot div {SLICE}")).groupBy("part", "word").applyInArrow(packed, "part long, word int, data binary")
    arrays = [np.zeros(size, dtype) for _ in range(words)]
    for r in slices.collect():  # most_bytes at most
        arrays[r.word][r.part * SLICE : (r.part + 1) * SLICE] = np.frombuffer(zlib.decompress(r.data), dtype)
    fill = np.array([np.count_nonzero(arrays[i // 64] >> dtype(i % 64) & dtype(1)) / size for i in range(len(known))])
    return Filters([lang for _, lang in known], arrays, np.minimum(fill**hashes, 0.999), width, hashes)


def predict(docs: DataFrame, filters: Filters, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the language of each whole text and a score of 0 to 1, its share of what all languages count; text null: und, 0. No
    other column of docs is looked at; columns named pred or score are replaced."""
    spark = docs.sparkSession
    small_batches(docs)
    held = spark.sparkContext.broadcast(filters)
    rest = docs.select([c for c in docs.columns if c.lower() not in (pred.lower(), score.lower())])
    spot = rest.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for b in batches:
            langs, scores = [], []
            for _, texts in _chunked(b.column(spot)):
                lang, s = known.decide(texts)
                langs += lang
                scores.append(s)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(np.concatenate([np.zeros(0), *scores]))], names=[*b.schema.names, pred, score])

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    return rest.mapInArrow(run, StructType([*rest.schema.fields, StructField(pred, StringType()), StructField(score, DoubleType())]))


def op12(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score over the whole documents table; documents whose crc32(doc_id) leaves 2 when divided by 4
    teach nothing. A null doc_id isn't held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    filters = fit(docs.where(~held_out).select("text", "lang"))
    found = predict(docs.select("doc_id", held_out.alias("held_out"), "text"), filters)
    return found.select("doc_id", "held_out", "lang_pred", "score")
