"""Near copies of the pipeline against brute-force Jaccard on planted edits."""

import random

import corpus_pipeline
import numpy as np
from folioloom.llm import nearcopies


def brute_sets(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_groups(texts, similarity=0.8):
    own, root = [brute_sets(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(own):
        for j, b in enumerate(own[:i]):
            if a == b or 5 * len(a & b) >= 5 * similarity * len(a | b) - 1e-9:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def planted(rng):
    """Texts, copies with words changed so that similarities lie on both sides of 0.8, and one passage that many share."""
    out = []
    for size in (12, 40, 90, 300, 700):
        for _ in range(6):
            base = [f"w{rng.randint(0, 3000)}" for _ in range(size)]
            out.append(" ".join(base))
            for share in (0.005, 0.015, 0.02, 0.025, 0.03, 0.05):
                words = list(base)
                for k in rng.sample(range(size), max(1, round(share * size))):
                    words[k] = f"x{rng.randint(0, 3000)}"
                out.append(" ".join(words))
    passage = " ".join(f"p{i}" for i in range(30))
    out += [passage + " " + " ".join(f"v{rng.randint(0, 9000)}" for _ in range(60)) for _ in range(20)]
    return out + ["", None, "  ", "one two", "ONE  two", "one three", out[0].upper()]


def test_near_copies_brute_force(spark):
    texts = planted(random.Random(5))
    rows = [(3 * i, t) for i, t in enumerate(texts)] + [(None, texts[7]), (3, texts[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    group = brute_groups([t for _, t in rows])
    least = {g: min(r[0] for r, h in zip(rows, group) if h == g and r[0] is not None) for g in set(group)}
    want = sorted((-1 if r[0] is None else r[0], least[g]) for r, g in zip(rows, group))
    got = nearcopies.near_copies(docs).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.component_id) for r in got) == want
    assert nearcopies.near_copies(docs.limit(0)).count() == 0
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs.where("doc_id is not null"), "").collect()}
    assert kept == set(least.values())


def test_forest_chains():
    sets = [np.arange(k, k + 100, dtype=np.uint64) for k in range(0, 60, 10)] + [np.arange(500, 600, dtype=np.uint64)]
    node = np.arange(7)
    left, right = nearcopies.forest(node, np.concatenate(sets), np.full(7, 100), 0.8)
    assert len(left) == 5 and set(left + right) == set(range(6))


def test_fingerprints_find_candidates(spark, monkeypatch):
    """Without the bands, SimHash alone groups the pairs of 0.8 or more within its distance, and its other links don't count."""
    rng = random.Random(9)
    texts = []
    for size in (400, 900):
        for _ in range(5):
            words = [f"w{rng.randint(0, 3000)}" for _ in range(size)]
            texts += [" ".join(words), " ".join([*words[:-1], "other"]), " ".join([*words[: size // 2], "more", *words[size // 2 :]])]
    seen = []
    monkeypatch.setattr(nearcopies, "_candidate_links", lambda nodes: nodes.sparkSession.createDataFrame([], "a long, b long"))
    monkeypatch.setattr(nearcopies, "_verified", lambda *a, real=nearcopies._verified: seen.append(a[2].count()) or real(*a))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    fps = {r.doc_id: r.fp & (1 << 64) - 1 for r in nearcopies._prints(docs, 5).collect()}
    own = [brute_sets(t) for t in texts]
    near = [(i, j) for j in fps for i in range(j) if (fps[i] ^ fps[j]).bit_count() <= nearcopies.DISTANCE and 5 * len(own[i] & own[j]) >= 4 * len(own[i] | own[j])]
    got = {r.doc_id: r.component_id for r in nearcopies.near_copies(docs).collect()}
    assert len(near) > 8 and seen[0] > 8 and all(got[i] == got[j] for i, j in near)
    whole = brute_groups(texts)
    assert all(whole[i] == whole[g] for i, g in got.items())
