"""SimHash groups, components, toxicity, quality and the pipeline against brute force on small tables."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from folioloom.llm import components, simhash, toxicity


def brute_groups(fps, distance=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


@pytest.mark.parametrize("blocks", [5, 6, 7])
def test_links_keep_components(blocks):
    rng = random.Random(blocks)
    fps = [rng.getrandbits(64) for _ in range(40)]
    for f in fps[:12]:
        for _ in range(20):
            g = f
            for k in rng.sample(range(64), rng.randint(1, 5)):
                g ^= 1 << k
            fps.append(g)
    fps = sorted(set(fps))
    u = np.array(fps, np.uint64)
    a, b = [], []
    for m in simhash.block_tables(4, blocks):
        for small in (2, 48):
            x, y = (u[k] for k in simhash.linked(u & np.uint64(m), u, 4, small))
            assert all(bin(int(p) ^ int(q)).count("1") <= 4 for p, q in zip(x, y))
        a += x.tolist()
        b += y.tolist()
    at = {f: i for i, f in enumerate(fps)}
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for p, q in zip(a, b):
        i, j = find(at[p]), find(at[q])
        root[max(i, j)] = min(i, j)
    assert [find(i) for i in range(len(fps))] == brute_groups(fps)


def test_large_groups_by_differences():
    rng = np.random.default_rng(8)
    free = 0x3FFFFF
    fp = np.unique(np.r_[rng.integers(0, free, 5000, dtype=np.uint64), rng.integers(0, 1 << 12, 300, dtype=np.uint64)])
    mask = np.uint64(~free & ((1 << 64) - 1))

    def pieces(a, b):
        root = list(range(len(fp)))
        for i, j in zip(a.tolist(), b.tolist()):
            while root[i] != i:
                i = root[i]
            while root[j] != j:
                j = root[j]
            root[max(i, j)] = min(i, j)
        out = []
        for i in range(len(fp)):
            while root[i] != i:
                i = root[i]
            out.append(i)
        return out

    for distance in (1, 2):
        a, b = simhash._reached(fp, simhash._patterns(free, distance))
        x, y = simhash._forest(fp, distance)
        assert (np.bitwise_count(fp[a] ^ fp[b]) <= distance).all() and len(a) == len(x)
        assert pieces(a, b) == pieces(x, y)
    c, d = simhash.linked(fp & mask, fp, 2, free=free)
    assert pieces(c, d) == pieces(x, y)


def test_near_duplicates_table(spark):
    rng = random.Random(9)
    base = [" ".join(f"w{rng.randint(0, 500)}" for _ in range(300)) for _ in range(4)]
    texts = [None, "", "  ", "one", "ONE", *base, *base, base[0].replace("w1", "w2", 1), base[1] + " tail"]
    rows = [(i * 3, t, "x") for i, t in enumerate(texts)] + [(0, None, "x"), (None, base[2], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string").repartition(3)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    fps = [brute_print(t) for _, t, _ in rows]
    group = brute_groups(fps)
    least = {g: min(r[0] for r, h in zip(rows, group) if h == g and r[0] is not None) for g in set(group)}
    want = sorted((-1 if r[0] is None else r[0], f, least[g]) for r, f, g in zip(rows, fps, group))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.fp % 2**64, r.component_id) for r in got) == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(90)] + [(i, i + 1) for i in range(200, 240)] + [(300, k) for k in range(301, 340)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.root for r in components.components(df).collect()}
    near = {}
    for a, b in links:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for n in near:
        seen, todo = {n}, [n]
        while todo:
            for m in near[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        assert got.get(n, n) == min(seen)
    assert components.components(df.limit(0)).count() == 0


def corpus(spark, n=260):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re", "he"]) for _ in range(rng.randint(1, 3)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(30, 60))]
        bad, junk = i % 5 == 0, i % 9 == 1
        if bad:
            words.insert(3, rng.choice(["idiot", "scum", "moron"]))
        if junk:
            words = [w.upper() + "%%%$$" for w in words]
        rows.append((i, " ".join(words), "en" if i % 2 else "de", "keep me"))
        if i < n - 60:
            labels.append((i, 0 if junk else 1, int(bad)))
    rows += [(900, None, None, "x"), (901, "", "en", "x"), (901, "", "en", "x"), (None, "th er on", "fr", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, extra string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_held_out(spark):
    docs, labels = corpus(spark)
    got = toxicity.classify(docs, toxicity.fit(docs, labels)).collect()
    assert len(got) == docs.count() and got[0].extra == "keep me"
    held = [r for r in got if r.doc_id is not None and 200 <= r.doc_id < 260 and r.doc_id % 9 != 1]
    assert all(r.toxic == (r.doc_id % 5 == 0) for r in held)
    assert not any(r.toxic for r in got if r.doc_id in (900, 901, None))
    none = toxicity.fit(docs, labels.limit(0))
    assert not any(r.toxic for r in toxicity.classify(docs, none).collect())
    clash = toxicity.classify(docs.withColumn("toxic", F.lit("old")), none)
    assert dict(clash.dtypes)["toxic"] == "boolean" and clash.count() == docs.count()


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs, labels = corpus(spark)
    docs = docs.withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    more = docs.where("doc_id in (7, 8)").withColumn("doc_id", F.col("doc_id") + 5000).withColumn("text", F.concat("text", F.lit("")))
    docs = docs.unionByName(more)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_copies", "pii", "packing"]
    out = corpus_pipeline.run(spark, str(tmp_path))
    ids = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    assert not ids & {5, 10, 5007, 5008} and {7, 8} <= ids
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
