"""Lexical search against a full scan, and the bisection against its cost."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioloom.llm import bisection, lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def brute(docs, items, k):
    """docs: (id, text), items: (item_id, text)."""
    bags = [(i, Counter(terms_of(t))) for i, t in docs]
    bags = [(i, c) for i, c in bags if c]
    n, length = len(bags), sum(sum(c.values()) for _, c in bags)
    df = Counter(t for _, c in bags for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms_of(text))
    out = []
    for item, terms in asked.items():
        hits = []
        for i, c in bags:
            m = 50 + (50 * sum(c.values()) * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if score > 0:
                hits.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(hits)[:k])]
    return sorted(out, key=str)


def topics(n, seed, longest=40):
    """Texts of five topics with few words in common."""
    rng = random.Random(seed)
    words = [[f"{'abcde'[t]}{i}é" for i in range(60)] for t in range(5)]
    return [(i, " ".join(rng.choice(words[rng.randrange(5) if rng.random() < 0.05 else i % 5])[: rng.choice([9, 9, 1])].title() for _ in range(rng.randint(1, longest)))) for i in range(n)]


ODD = [(None, "a1é a2é"), (None, "b3é"), (7000, None), (7001, ""), (7002, " -- !"), (7003, "a1é " * 70_000), (7004, "x\x00y_z-Q9")]


def test_terms_of_texts():
    texts = ["Ab-cd AB", "", "é_É 9", "a" * 1000, None]
    buf, offsets = lexical.utf8.column(pa.record_batch([pa.array(texts)], names=["t"]), "t")
    starts, found, counts, n = lexical._terms(buf, offsets)
    for k, t in enumerate(texts):
        want = Counter(terms_of(t))
        assert n[k] == sum(want.values())
        assert sorted(counts[starts[k] : starts[k + 1]]) == sorted(want.values())
    assert len(np.unique(found)) == len({t for x in texts for t in terms_of(x)})


@pytest.mark.parametrize("shard_docs", [40, 8_192])
def test_search_equals_scan(spark, shard_docs, monkeypatch):
    monkeypatch.setattr(lexical, "ITEMS", 5)  # items in several blocks
    docs = topics(500, 1) + ODD + topics(3, 1) * 4
    rng = random.Random(3)
    items = [(k, " ".join(rng.choice(docs[:500])[1].split()[0] for _ in range(rng.randint(1, 12)))) for k in range(12)]
    items += [(3, "A1é b2é"), (None, "c1é"), (50, None), (51, "?"), (52, "unseen"), (53, "Q9 x")]
    df = spark.createDataFrame(docs, "id long, text string").select("*", F.lit(0).alias("shard"), F.lit("t").alias("terms")).repartition(3)
    index = lexical.build(df, sample_docs=256, shard_docs=shard_docs, least_docs=50, block=8)
    hits, seen = lexical.search(index, spark.createDataFrame(items, "item_id long, text string"), 7)
    assert sorted(map(tuple, hits.collect()), key=str) == brute(docs, items, 7)
    assert index.shards.count() >= 4
    assert all(0 <= r.visited <= r.blocks for r in seen.collect())


def test_blocks_are_passed_over(spark):
    """Of clustered documents most blocks of the default size are never visited."""
    docs = topics(3000, 5, 30)
    items = [(k, docs[17 * k][1]) for k in range(20)]
    index = lexical.build(spark.createDataFrame(docs, "id long, text string"))
    hits, seen = lexical.search(index, spark.createDataFrame(items, "item_id long, text string"), 10)
    assert sorted(map(tuple, hits.collect()), key=str) == brute(docs, items, 10)
    visited = seen.agg(F.sum("visited")).first()[0]
    total = index.shards.select(F.sum(F.ceil(F.size("ids") / lexical.BLOCK))).first()[0] * len(items)
    assert visited < 0.6 * total


def test_bisection_brings_like_documents_together():
    docs = topics(640, 9)
    names = {t: i for i, t in enumerate(sorted({w for _, t in docs for w in terms_of(t)}))}
    bags = [np.unique([names[w] for w in terms_of(t)]) for _, t in docs]
    pairs = bisection.Pairs(np.concatenate([[0], np.cumsum([len(b) for b in bags])]), np.concatenate(bags), len(names))

    def bits(by):
        spots = {}
        for at, d in enumerate(by):
            for t in bags[d]:
                spots.setdefault(int(t), []).append(at)
        return sum(math.log2(b - a) for s in spots.values() for a, b in zip([-1, *s], s))

    by = bisection.order(pairs, 32)
    assert sorted(by.tolist()) == list(range(640))
    assert bits(by) < 0.85 * bits(range(640))
    whole = pairs.of(np.arange(640))
    assert bisection.split(whole, 384).sum() == 640 - 384
    router, (terms, sizes) = bisection.fit_router(pairs.starts, pairs.terms.astype(np.uint64), 3)
    assert sizes.sum() == 640 and len(sizes) == 8 and sizes.max() < 200 and terms.sum() == len(pairs.terms)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "a b")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = lexical.op11(spark, str(tmp_path))
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.count() == 0
    index = lexical.build(spark.createDataFrame([(1, "a b"), (2, " ")], "id long, text string"))
    assert lexical.search(index, spark.createDataFrame([], "item_id long, text string"), 3)[0].count() == 0
    assert lexical.build(spark.createDataFrame([(2, " ")], "id long, text string")).shards.count() == 0
