"""Inverted lists against a scan of all vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioloom.operators import dense_index, retrieval

SCHEMA = "chunk_id long, ord long, embedding array<float>, document_id string"


def clustered(spark, n=1500, width=24, groups=12, seed=1, odd=True):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, width))
    rows = [(i, n - i, (centres[i % groups] + 0.25 * rng.normal(size=width)).astype(float).tolist(), f"d{i % 30}") for i in range(n)]
    rows += [(n + i, -1 - i, rows[3][2], "copies") for i in range(40)]  # ties in the order of ord
    if odd:
        rows += [(9001, 10_001, [0.0] * width, "odd"), (9002, 10_002, [1.0, 2.0], "odd"), (9003, 10_003, None, "odd"), (9004, 10_004, [float("nan")] * width, "odd"), (9005, 10_005, [], "odd"), (9006, 10_006, rows[0][2] + [5.0], "odd")]
    return spark.createDataFrame(rows, SCHEMA), rows


def asked(spark, rows, every=25):
    return spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % every == 0 or r[0] in (9001, 9002, 9003, 9006)], "query_id long, q array<float>")


def found(df):
    return sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 9)) for r in df.collect())


def test_all_probes_equal_a_scan(spark, tmp_path, monkeypatch):
    df, rows = clustered(spark)
    held = dense_index.Lists(spark, f"{tmp_path}/i")
    v = held.build(df, lists=9)
    assert dense_index.unclustered(v) >= 4
    queries = asked(spark, rows)
    assert found(held.search(queries, 7)) == found(retrieval.dense_top_k(df, queries, 7))
    monkeypatch.setattr(dense_index, "QUERY_BLOCK", 20)  # several blocks
    assert found(held.search(queries, 3)) == found(retrieval.dense_top_k(df, queries, 3))


def test_probed_lists_alone_are_read_and_most_rows_never_scored(spark, tmp_path):
    df, rows = clustered(spark, odd=False)
    held = dense_index.Lists(spark, f"{tmp_path}/i")
    v = held.build(df, lists=24)
    one = [rows[5][2]]
    lists = held.plan(one, 2)
    assert 1 <= len(lists) <= 3 < len(v.buckets)
    got = held.search(spark.createDataFrame([(1, one[0])], "query_id long, q array<float>"), 5, probes=2)
    read = {f.split("/bucket=")[1].split("/")[0] for f in held._rows(v, lists).inputFiles()}
    assert read == set(map(str, lists))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<chunk_id:bigint,list:int,code:binary,missed:double>" in plan  # the first pass reads no vectors
    queries = asked(spark, rows)
    exact = {(q, c) for q, _, c, _ in found(retrieval.dense_top_k(df, queries, 5))}
    near = {(q, c) for q, _, c, _ in found(held.search(queries, 5, probes=3))}
    assert len(exact & near) >= 0.95 * len(exact)


def test_bounds_hold():
    rng = np.random.default_rng(3)
    rows, _ = dense_index._units(rng.normal(size=(600, 20)))
    coder = dense_index.Coder.fit(rows, 6, 5)
    near, codes, missed = coder.encode(rows)
    q, _ = dense_index._units(rng.normal(size=(8, 20)))
    for own in range(6):
        at = near == own
        c = coder.cosines(q, own, codes[at])
        assert (np.abs(c - q @ rows[at].T) <= missed[at] + 1e-9).all()
    again = dense_index.Coder.of(coder.to_bytes())
    assert np.array_equal(again.encode(rows)[1], codes)


def test_replace_and_remove(spark, tmp_path):
    df, rows = clustered(spark, n=400)
    held = dense_index.Lists(spark, f"{tmp_path}/i")
    first = held.build(df, lists=12)
    new = spark.createDataFrame([(3, 20_000, rows[3][2], "d3"), (777_000, 20_001, rows[5][2], "fresh")], SCHEMA)
    second = held.replace(new)
    third = held.remove(spark.createDataFrame([("d7",)], "document_id string"))
    now = df.where("document_id not in ('d3', 'd7')").unionByName(new)
    queries = asked(spark, rows, 40)
    assert found(held.search(queries, 5)) == found(retrieval.dense_top_k(now, queries, 5))
    assert found(held.search(queries, 5, number=1)) == found(retrieval.dense_top_k(df, queries, 5))
    assert (first.number, second.number, third.number) == (1, 2, 3)
    assert any(second.buckets.get(b) == x for b, x in first.buckets.items())  # lists without these documents stay


@pytest.mark.parametrize("rows", [[], [(1, 1, [0.0, 0.0], "a")], [(1, 1, [3.0, 4.0], "a")]])
def test_tiny_tables(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    held = dense_index.Lists(spark, f"{tmp_path}/i")
    held.build(df)
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id long, q array<float>")
    assert found(held.search(queries, 3)) == found(retrieval.dense_top_k(df, queries, 3))
    assert held.search(queries.where(F.lit(False)), 3).count() == 0


def test_pairs_that_bounds_do_not_settle_stay_where_they_lie(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dense_index, "DUE_ROWS", 1_000)
    rng = np.random.default_rng(5)
    rows = [(i, -i, rng.normal(size=64).tolist(), "d") for i in range(1200)] + [(5000, 1, [0.0] * 64, "odd"), (5001, 2, [1.0], "odd")]
    df = spark.createDataFrame(rows, SCHEMA)  # no clusters, so that codes rule out next to nothing
    held = dense_index.Lists(spark, f"{tmp_path}/i")
    v = held.build(df)
    queries = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 10 == 0 or r[0] > 4999], "query_id long, q array<float>")
    assert found(held.search(queries, 5)) == found(retrieval.dense_top_k(df, queries, 5))
    block = held._block(v, queries.collect(), 5, None, "bigint", "bigint")
    assert block.count() <= 5 * queries.count() * block.rdd.getNumPartitions()  # not all pairs of a question and a row
    assert "Exchange" not in block._jdf.queryExecution().executedPlan().toString()


def test_equal_scores_are_cut_by_ord_where_they_lie(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dense_index, "DUE_ROWS", 0)
    df, rows = clustered(spark)
    held = dense_index.Lists(spark, f"{tmp_path}/i")
    held.build(df, lists=9)
    queries = asked(spark, rows)
    assert found(held.search(queries, 7)) == found(retrieval.dense_top_k(df, queries, 7))
