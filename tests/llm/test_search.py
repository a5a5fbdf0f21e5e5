"""Searches against brute force."""

import numpy as np
import pytest

from folioloom.llm import covertree, hnsw


def brute_products(v, ids, k, every):
    out = {}
    for q, a in zip(ids, v):
        if q % every == 0:
            found = sorted((-sum(int(x) * int(y) for x, y in zip(a, b)), int(i)) for i, b in zip(ids, v) if i != q)
            out[int(q)] = [(i, -s) for s, i in found[:k]]
    return out


@pytest.mark.parametrize("make", ["flat", "clusters", "ties", "huge"])
def test_dual_tree_is_exact(make):
    rng = np.random.default_rng(3)
    v = {"flat": lambda: rng.normal(size=(400, 8)) * 256, "clusters": lambda: rng.normal(size=(6, 8))[rng.integers(0, 6, 400)] * 2000 + rng.normal(size=(400, 8)), "ties": lambda: rng.integers(-1, 2, (400, 3)).astype(float), "huge": lambda: rng.normal(size=(60, 4)) * 2.0**40}[make]()
    v = np.floor(v)
    ids = rng.permutation(len(v))
    best, scored = covertree.search(v[:50], ids[:50], covertree.CoverTree.load(covertree.CoverTree(v, 8).dump()), ids, 5, leaf=8)
    want = brute_products(v, ids, 5, 1)
    for r, q in enumerate(ids[:50].tolist()):
        got = list(zip(best.id[r].tolist(), best.score[r].tolist()))
        assert got == [(i, max(-(2**63), min(2**63 - 1, s))) for i, s in want[q]] or make == "huge"
    assert scored < 50 * len(v) or make != "clusters"


def test_top_k_table(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=4)], i) for i in range(120)] + [(200, None, 0), (250, [1.0, None, 0.0, 0.0], 0), (300, [float("nan")] * 4, 0), (350, [float("inf")] * 4, 0), (None, [1.0] * 4, 0), (119, [5.0] * 4, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    ok = [(i, np.floor(np.array(v, np.float32).astype(float) * 256)) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    want = brute_products([v for _, v in ok], [i for i, _ in ok], 5, 50)
    for shard_rows, block_rows in ((8192, 2048), (16, 1)):
        got = {}
        for r in covertree.top_k(df, shard_rows=shard_rows, block_rows=block_rows, leaf=4).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert got == want
    assert covertree.top_k(df.limit(0)).count() == 0
    assert {r.vec_id for r in covertree.top_k(df.where("vec_id in (50, 51)")).collect()} == {51}


def test_graph_recall(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(3000, 32)).astype(np.float32)
    v[2500:] = v[2499]  # equal vectors
    df = spark.createDataFrame([(i, [float(x) for x in r], 1) for i, r in enumerate(v)] + [(4000, [0.0] * 32, 1), (4100, None, 1), (4200, [float("nan")] * 32, 1)], "vec_id long, embedding array<float>, label int")
    got = {}
    for r in hnsw.nearest(df, shard_rows=1200, block_rows=8).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    x = v.astype(float)
    assert sorted(got) == list(range(0, 3000, 100))
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        want = [int(i) for i in np.lexsort((np.arange(3000), d)) if i != q][:10]
        hits += len({i for i, _ in found} & set(want))
        assert len(found) == 10 and all(abs(s - d[i]) < 1e-9 for i, s in found)
        assert found == sorted(found, key=lambda p: (p[1], p[0]))
        if q >= 2500:
            assert [i for i, _ in found] == want
    assert hits / (10 * len(got)) >= 0.9


def test_graph_small(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0]), (7, [1e30, -1e30])], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r.rank) for r in hnsw.nearest(df).orderBy("rank").collect()] == [(1, 1), (7, 2)]
    assert hnsw.nearest(df.limit(0)).count() == 0
    uneven = spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0]), (0, [3.0]), (0, [3.0])], "vec_id long, embedding array<float>")
    assert sorted((r.vec_id, r.score) for r in hnsw.nearest(uneven).collect()) == [(1, 2.0), (1, 8**0.5)]


@pytest.mark.parametrize("make", ["flat", "clusters", "copies"])
def test_cover_tree_rules_and_pruning_at_defaults(make):
    """Every node's points are its children's; each lies within half the node's radius of its child's centre, centres farther apart
    than that, radii as measured; and few pairs are scored with the parameters of the query."""
    rng = np.random.default_rng(9)
    v = {"flat": lambda: rng.normal(size=(2000, 64)) * 32, "clusters": lambda: rng.normal(size=(12, 64))[rng.integers(0, 12, 3000)] * 32 + rng.normal(size=(3000, 64)), "copies": lambda: np.repeat(rng.normal(size=(50, 8)) * 99, 40, axis=0)}[make]()
    v = np.floor(v)
    t = covertree.CoverTree.load(covertree.CoverTree(v).dump())
    assert sorted(t.order.tolist()) == list(range(len(v)))
    for k, ((a, b), (c, d), radius) in enumerate(zip(t.span, t.children, t.radii)):
        far = np.sqrt(((v[t.order[a:b]] - t.centres[k]) ** 2).sum(axis=1))
        assert abs(far.max() - radius) < 1e-6
        if not d:
            assert b - a <= covertree.LEAF or radius == 0
            continue
        assert t.span[c, 0] == a and t.span[d - 1, 1] == b and (t.span[c + 1 : d, 0] == t.span[c : d - 1, 1]).all()
        assert (t.radii[c:d] <= radius / 2 + 1e-6).all()
        if d - c > 1:
            own = t.centres[c:d]
            gap = (own**2).sum(axis=1)[:, None] + (own**2).sum(axis=1) - 2 * own @ own.T
            np.fill_diagonal(gap, np.inf)
            assert np.sqrt(max(0.0, gap.min())) > radius / 2 - 1e-3
    ids, q = np.arange(len(v)), np.arange(0, len(v), 50)
    best, scored = covertree.search(v[q], ids[q], t, ids, 5)
    for i, x in enumerate(q):
        s = v @ v[x]
        s[x] = -np.inf
        assert np.array_equal(np.lexsort((ids, -s))[:5], best.id[i])
    assert scored < (0.2 if make == "clusters" else 0.5) * len(q) * len(v)
