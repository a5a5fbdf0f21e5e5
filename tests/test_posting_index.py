"""Posting blocks against BM25 over texts."""

import random

import pytest
from pyspark.sql import functions as F

from folioloom.operators import posting_index, retrieval

SCHEMA = "chunk_id long, ord long, document_id string, text string"
ASKED = [(1, "a1 a2 a1"), (2, "b3 common"), (3, "nothing here"), (4, "!!"), (5, "common"), (6, "c7 c7 d1 e9")]


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        topic = "abcde"[i * 5 // n]  # neighbours are of one topic
        rows.append((i, i, f"d{i // 10}", " ".join([f"{topic}{rng.randint(0, 30)}" for _ in range(rng.randint(1, 25))] + ["common"] * (rng.random() < 0.3))))
    return rows + [(9000, 9000, "odd", None), (9001, 9001, "odd", ""), (9002, 9002, "odd", "--"), (9003, 9003, None, "a1 " * 3000)]


def found(df):
    return sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 7)) for r in df.collect())


@pytest.fixture
def asked(spark):
    return spark.createDataFrame(ASKED, "query_id long, question string")


def test_search_equals_a_scan_and_passes_over_ranges(spark, tmp_path, asked, monkeypatch):
    monkeypatch.setattr(posting_index, "RANGE", 12)
    df = spark.createDataFrame(corpus(), SCHEMA)
    held = posting_index.Postings(spark, f"{tmp_path}/p")
    facts = held.build(df)
    assert facts["n"] == df.count()
    got = held.search(asked, 6)
    assert found(got) == found(retrieval.bm25(df, asked, 6))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "text#" not in plan
    seen = {r.query_id: (r.ranges, r.scored) for r in held.visited(asked, 6).collect()}
    assert seen[5][0] > 40 and sum(s for _, s in seen.values()) < 0.7 * sum(n for n, _ in seen.values())
    monkeypatch.setattr(posting_index, "QUERY_BLOCK", 2)  # several blocks of questions
    assert found(held.search(asked, 3)) == found(retrieval.bm25(df, asked, 3))


def test_updates_adjust_statistics(spark, tmp_path, asked):
    df = spark.createDataFrame(corpus(300, 3), SCHEMA)
    held = posting_index.Postings(spark, f"{tmp_path}/p")
    held.build(df)
    new = spark.createDataFrame([(5, 5, "d0", "a1 a1 b3"), (70_000, 70_000, "d3", "common c7"), (70_001, 70_001, "fresh", "d1 common")], SCHEMA)
    held.replace(new)
    held.remove(spark.createDataFrame([("d9",), ("none",)], "document_id string"))
    facts = held.replace(spark.createDataFrame([(70_001, 70_001, "fresh", "e9 e9 e9"), (9, 9, "d9", "common back again")], SCHEMA))
    now = df.where("document_id is null or document_id not in ('d0', 'd3', 'd9')").unionByName(spark.createDataFrame(
        [(5, 5, "d0", "a1 a1 b3"), (70_000, 70_000, "d3", "common c7"), (70_001, 70_001, "fresh", "e9 e9 e9"), (9, 9, "d9", "common back again")], SCHEMA
    ))
    want = found(retrieval.bm25(now, asked, 8))
    assert found(held.search(asked, 8)) == want
    assert (facts["n"], len(facts["segments"])) == (now.count(), 4)
    assert found(held.search(asked, 8, number=1)) == found(retrieval.bm25(df, asked, 8))
    df_now = {r.term: r.df for r in held._read(facts["segments"], "terms").groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0").collect()}
    assert df_now == {r.term: r.df for r in retrieval.token_index(now).where("term <> ''").groupBy("term").agg(F.count("*").alias("df")).collect()}
    compacted = held.compact()
    assert len(compacted["segments"]) == 1 and compacted["length"] == facts["length"]
    assert found(held.search(asked, 8)) == want


def test_empty_index(spark, tmp_path, asked):
    held = posting_index.Postings(spark, f"{tmp_path}/p")
    with pytest.raises(FileNotFoundError):
        held.search(asked, 3)
    none = spark.createDataFrame([], SCHEMA)
    held.build(none)
    assert held.search(asked, 3).count() == 0
    held.replace(spark.createDataFrame([(1, 1, "d", "a1")], SCHEMA))
    assert [(r.query_id, r.chunk_id, r.score > 0) for r in held.search(asked.where("query_id in (1, 3)"), 3).orderBy("query_id").collect()] == [(1, 1, True), (3, 1, False)]


def test_blocks_are_made_where_chunks_lie(spark, tmp_path, asked, monkeypatch):
    """Nothing is shuffled to make them; a range that lies in two batches has two blocks a term, and its bound is that of both."""
    monkeypatch.setattr(posting_index, "RANGE", 12)
    df = spark.createDataFrame(corpus(), SCHEMA)
    held = posting_index.Postings(spark, f"{tmp_path}/p")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        name = held.build(df)["segments"][0]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    blocks = held._read([name], "blocks")
    assert blocks.groupBy("term", "range").count().where("count > 1").count() > 0
    assert "Exchange" not in held._blocks(held._read([name], "chunks"), 8)._jdf.queryExecution().executedPlan().toString()
    assert found(held.search(asked, 6)) == found(retrieval.bm25(df, asked, 6))
    held.remove(spark.createDataFrame([("d3",), ("odd",)], "document_id string"))
    want = found(retrieval.bm25(df.where("document_id is null or document_id not in ('d3', 'odd')"), asked, 6))
    assert found(held.search(asked, 6)) == want
    held.compact()
    assert found(held.search(asked, 6)) == want
