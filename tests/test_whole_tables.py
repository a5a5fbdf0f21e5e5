"""Queries over every row of their tables, against plain Python."""

import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from folioloom.plans import queries as plans


def table(folder, name, **columns):
    pq.write_table(pa.table(columns), f"{folder}/{name}.parquet")


def brute_parts(role, text):
    lines = [re.sub(r"^[0-9]+[.)]\s*", "", x.strip()).strip() for x in re.split("\r\n|[\n-\r\x85\u2028\u2029]", f"1. {role or ''}\n\n2) {text or ''}")]
    return [x for x in lines if x] or [text or ""]


def duck_rows(folder, name, order):
    import duckdb

    c = duckdb.connect()
    for f in folder.glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return sorted(c.execute(f"SELECT {order} FROM ({plans.ORACLE[name]})").fetchall())


def test_decompose_parse(spark, tmp_path):
    texts = ["one", "two\nlines", "1. a\r\n2) b\n\n 3.  c ", None, "", "  ", "7) numbered", " outer ", "x\u2028y \x0bz", "3. 4) twice"]
    roles = ["user", "assistant", None, None, "", "u", "a", "b", "c", "d"]
    n = list(range(len(texts)))
    table(tmp_path, "conversations", conv_id=n, turn=[0] * len(n), role=roles, text=texts)
    got = sorted((r.conv_id, r.pos, r.part) for r in plans.decompose_parse(spark, str(tmp_path)).collect())
    want = sorted((i, k, p) for i in n for k, p in enumerate(brute_parts(roles[i], texts[i]), 1))
    assert got == want
    assert duck_rows(tmp_path, "decompose_parse", "conv_id, pos, part") == want


def test_faithfulness_parse(spark, tmp_path):
    values = [0.0, 0.0, 0.0, None, 250.0, None, 500.0]
    table(tmp_path, "events", event_id=list(range(7)), value=values)
    got = sorted((r.event_id, r.verdict, r.confidence, r.correct, r.n_claims) for r in plans.faithfulness_parse(spark, str(tmp_path)).collect())
    want = [(i, "FAITHFUL", 1.0, False, 0) if i % 3 else (i, "UNFAITHFUL", (v or 1000) / 1000, True, 2) for i, v in enumerate(values)]
    assert got == want
    assert duck_rows(tmp_path, "faithfulness_parse", "event_id, verdict, CAST(confidence AS DOUBLE), correct, n_claims") == want


def test_retrieval_metrics_whole_passages(spark, tmp_path):
    opening = "the same sixty characters open both of these passages, word by word, and then "
    passage = opening + "zebras graze"
    table(tmp_path, "benchmark", item_id=[1, 2], text=[passage, "nowhere at all"])
    docs = [opening + "lions sleep", "before " + passage + " after", opening + "zebras run", "zebras graze"]
    table(tmp_path, "documents", doc_id=list(range(4)), text=docs, source=["s"] * 4, lang=["en"] * 4)
    got = {r.query_id: r for r in plans.retrieval_metrics(spark, str(tmp_path)).collect()}
    assert (got[1].hit_rate, got[1].mrr, got[1].precision_at_k, got[1].recall_at_k) == (1.0, 1.0, 0.25, 1.0)
    assert got[2].hit_rate is None and got[2].recall_at_k is None
    assert {r.metric: r["mean"] for r in plans.evaluation_summary(spark, str(tmp_path)).collect()}["precision_at_k"] == 0.25


def test_hybrid_sees_documents_without_vectors(spark, tmp_path):
    texts = ["plain words", "other words", "idiot or moron: how many in the table", "more of it", "zzqqzz", "no vector here"]
    table(tmp_path, "documents", doc_id=list(range(6)), text=texts, source=["a", "b", "c", "d", "e", "e"], lang=["en"] * 6)
    table(tmp_path, "embeddings", vec_id=[0, 1], embedding=[[1.0, 0.0], [0.6, 0.8]], label=[0, 0])
    fused = {(r.query_id, r.chunk_id): r.score for r in plans.rrf_fusion(spark, str(tmp_path)).collect()}
    # question 5 has no vector: only BM25 ranks it, and document 4 has its word
    assert fused[5, 4] == pytest.approx(1 / 61, abs=1e-6)
    # question 1 has one; documents 0 and 1 alone have a dense rank
    assert fused[1, 1] > 1 / 61 and {c for q, c in fused if q == 1} == set(range(6))
    for name in ("rrf_fusion", "region_boost", "parent_expansion", "hybrid_topk", "lexical_rerank"):
        got = sorted((r.query_id, r.rank, r.chunk_id) for r in plans.QUERIES[name](spark, str(tmp_path)).collect())
        assert 4 in {c for _, _, c in got}, name
        assert got == duck_rows(tmp_path, name, "query_id, rank, chunk_id"), name
