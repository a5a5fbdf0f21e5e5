"""Model ports that fail, the order of a page, SKIP rules, and sinks read back."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioloom.operators import models, pages, ports
from folioloom.sources import files


def slow_permutation(scores):
    """All rows ask at once, again and again, until no place is asked for twice."""
    n = len(scores)
    wishes = [sorted(range(n), key=lambda j: (scores[i][j], j)) for i in range(n)]
    at = [w.pop() for w in wishes]
    while len(set(at)) < n:
        for place in set(at):
            rows = [i for i in range(n) if at[i] == place]
            best = max(rows, key=lambda i: (scores[i][place], -i))
            for i in rows:
                if i != best:
                    at[i] = wishes[i].pop()
    return at


@pytest.mark.parametrize("n", [0, 1, 2, 7, 25])
def test_permutation(n):
    rng = np.random.default_rng(n)
    for ties in (False, True):
        s = rng.integers(0, 4, (n, n)).astype(float) if ties else rng.normal(size=(n, n))
        got = pages.permutation(s).tolist()
        assert sorted(got) == list(range(n))
        if not ties:
            assert got == slow_permutation(s.tolist())


def test_failed_calls_are_null(spark):
    calls = []

    def service(prompt):
        calls.append(prompt)
        if "bad" in prompt:
            raise RuntimeError("no service")
        return prompt.upper()

    df = spark.createDataFrame([(1, "good"), (2, "bad"), (3, None)], "id int, p string")
    got = {r.id: r.a for r in ports.CalledModel(service).answer(df, "p", "a").collect()}
    assert got == {1: "GOOD", 2: None, 3: ""}
    questions = spark.createDataFrame([(1, "bad question"), (2, "fine")], "query_id int, question string")
    assert {r.query_id: r.search for r in models.hypothetical(ports.CalledModel(service), questions).collect()}[1] == "bad question"


def test_renderer_and_crops(spark):
    docs = spark.createDataFrame([("a", bytearray(b"12")), ("b", bytearray(b""))], "document_id string, content binary")
    made = pages.CalledRenderer(lambda content: [(10 + i, 20, bytes([c])) for i, c in enumerate(content)]).render(docs)
    assert [(r.page_number, r.image_width, bytes(r.image)) for r in made.orderBy("page_number").collect()] == [(1, 10, b"1"), (2, 11, b"2")]


def test_bucketed_tables(spark, tmp_path):
    path = f"{tmp_path}/t"
    files.replace(spark.range(1000).select(F.concat(F.lit("d"), (F.col("id") % 300).cast("string")).alias("document_id"), "id"), path)
    files.replace(spark.createDataFrame([("d7", -1), ("new", -2)], "document_id string, id long"), path)
    got = files.exported(spark, str(tmp_path), "t")
    assert got.where("document_id = 'd7'").count() == 1 and got.count() == 1000 - 4 + 2


def test_sources_refuse(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.documents(spark, str(tmp_path))
    with pytest.raises(ValueError):
        files.one_document(spark, f"{tmp_path}/a.exe")
    with pytest.raises(ValueError):
        files.processed_folder("/root", "..")
    assert files.processed_folder("/data", "abc") == "/data/abc" and files.Settings(user_id="u").folder("/data") == "/data/user_id=u"
    spark.conf.set("folioloom.top_k", "7")
    try:
        assert files.Settings.of(spark).top_k == 7 and files.Settings.of(spark).chunk_size == 1800
    finally:
        spark.conf.unset("folioloom.top_k")


def test_postings_give_the_same_ranking(spark, tmp_path):
    from folioloom.operators import retrieval

    rng = random.Random(3)
    docs = [(i, i, " ".join(rng.choice("ab cd ef gh ij kl mn".split()) for _ in range(rng.randint(0, 30)))) for i in range(80)]
    corpus = spark.createDataFrame(docs, "chunk_id long, ord long, text string")
    asked = spark.createDataFrame([(1, "ab ef zz"), (2, "nothing"), (3, "!")], "query_id int, question string")
    retrieval.write_postings(corpus, f"{tmp_path}/postings", 8)
    posted = retrieval.read_postings(spark, f"{tmp_path}/postings", ["ab", "ef", "zz", "nothing"], 8)
    key = lambda df: [(r.query_id, r["rank"], r.chunk_id, round(r.score, 6)) for r in df.orderBy("query_id", "rank").collect()]
    assert key(retrieval.bm25(corpus, asked, 9)) == key(retrieval.bm25(corpus, asked, 9, postings=posted))


def test_dense_blocks(spark, monkeypatch):
    from folioloom.operators import retrieval

    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    monkeypatch.setattr(retrieval, "SHARD_ROWS", 40)
    rng = np.random.default_rng(4)
    v = rng.normal(size=(150, 6))
    v[20:25] = v[19]
    v[3] = 0
    rows = [(i, i, [float(x) for x in r]) for i, r in enumerate(v)] + [(200, 200, []), (201, 201, [1.0, 2.0]), (202, 202, None)]
    corpus = spark.createDataFrame(rows, "chunk_id long, ord long, embedding array<double>")
    asked = corpus.where("chunk_id % 6 = 0 or chunk_id >= 200").selectExpr("chunk_id as query_id", "embedding as q")
    got = {}
    for r in retrieval.dense_top_k(corpus, asked, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, round(r.score, 9)))

    def cosine(a, b):
        n = min(len(a), len(b))
        a, b = np.array(a[:n]), np.array(b[:n])
        return float(a @ b / ((np.sqrt(a @ a) or 1) * (np.sqrt(b @ b) or 1))) if n else 0.0

    own = [r for r in rows if r[2] is not None]
    want = {}
    for i, _, q in own:
        if i % 6 == 0 or i >= 200:
            want[i] = sorted(((round(cosine(q, e), 12), j) for j, _, e in own), key=lambda x: (-x[0], x[1]))[:4]
    assert {k: [(j, round(s, 9)) for s, j in x] for k, x in want.items()} == got
