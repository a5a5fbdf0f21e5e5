"""Answers that are kept: how often models are called, and that all see one answer."""

import time
import uuid

import pytest
from pyspark.sql import functions as F

from folioloom.functions import text as T
from folioloom.operators import ledger, models, pages, ports


def counted(folder, answer):
    """A service that writes down each call, and never answers alike."""

    def call(prompt):
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(prompt)
        return answer(prompt)

    return call


@pytest.fixture
def calls(tmp_path):
    folder = tmp_path / "calls"
    folder.mkdir()
    return folder


def prompts(folder):
    return sorted(p.read_text() for p in folder.iterdir())


def test_each_prompt_once(spark, tmp_path, calls):
    model = ports.CalledModel(counted(calls, lambda p: uuid.uuid4().hex), tries=1)
    df = spark.createDataFrame([(i, f"p{i % 5}") for i in range(60)] + [(99, None), (98, "")], "id long, p string").repartition(4)
    book = ledger.Ledger(model, "m", f"{tmp_path}/book")
    one, two = (book.answer(df.withColumn("said", F.lit("old")), "p", "said") for _ in range(2))
    assert one.columns == ["id", "p", "said"] and one.count() == 62
    left, right = ({r.id: r.said for r in x.collect()} for x in (one, two))
    assert left == right and len({left[i] for i in range(60)}) == 5
    assert prompts(calls) == ["", "", *[f"p{i}" for i in range(5)]]
    again = ledger.Ledger(model, "m", f"{tmp_path}/book")
    assert {r.id: r.said for r in again.answer(df, "p", "said").collect()} == left
    assert len(prompts(calls)) == 7
    ledger.Ledger(model, "other", f"{tmp_path}/book").answer(df, "p", "said")
    assert len(prompts(calls)) == 14  # another model's answers are its own
    again.compact(spark)
    assert {r.id: r.said for r in again.answer(df, "p", "said").collect()} == left and len(prompts(calls)) == 14


def test_failures_are_kept_for_the_run(spark, tmp_path, calls):
    def fails(p):
        if "bad" in p:
            raise RuntimeError(p)
        return p.upper()

    df = spark.createDataFrame([(1, "bad"), (2, "good")], "id long, p string")
    book = ledger.Ledger(ports.CalledModel(counted(calls, fails), tries=2), "m", f"{tmp_path}/book")
    for _ in range(3):
        assert {r.id: r.said for r in book.answer(df, "p", "said").collect()} == {1: None, 2: "GOOD"}
    assert prompts(calls) == ["bad", "bad", "good"]
    well = ledger.Ledger(ports.CalledModel(counted(calls, str.upper)), "m", f"{tmp_path}/book")
    assert {r.id: r.said for r in well.answer(df, "p", "said").collect()} == {1: "BAD", 2: "GOOD"}
    assert prompts(calls) == ["bad", "bad", "bad", "good"]


def test_branches_see_one_answer(spark, tmp_path, calls):
    """A check that says something else each time: what is due and what stays add up, and nothing is asked twice."""
    turn = lambda p: "{\"claims\": [{\"claim_text\": \"c\", \"status\": \"" + ("UNSUPPORTED" if uuid.uuid4().int % 2 else "SUPPORTED") + "\"}], \"recommended_action\": \"flag\"}" if p.startswith(models.CHECK) else "mended"
    book = ledger.Ledger(ports.CalledModel(counted(calls, turn), tries=1), "m", f"{tmp_path}/book")
    questions = spark.createDataFrame([(i, f"q{i}") for i in range(24)], "query_id long, question string")
    answers = questions.select("query_id", F.concat(F.lit("a"), F.col("query_id").cast("string")).alias("answer"))
    found = questions.select("query_id", F.lit(1).alias("rank"), F.lit("c").alias("chunk_id"), F.lit(1.0).alias("score"), F.array(F.lit("table")).alias("region_types"), F.lit("t").alias("title"), F.lit("x").alias("text"))
    got = models.correct(book, models.check(book, questions, found, answers)).collect()
    assert sorted(r.query_id for r in got) == list(range(24))
    asked = prompts(calls)
    assert len(asked) == len(set(asked)) == 24 + sum(r.answer == "mended" for r in got)


def test_searches_ask_a_question_twice_at_most(spark, calls):
    said = lambda p: "complex" if p.startswith(models.CLASSIFY) and "and" in p.split("\n\n", 1)[1] else "1. one\n2. two" if p.startswith(models.DECOMPOSE) else "simple text"
    questions = spark.createDataFrame([(1, "a and b"), (2, "a"), (3, "c")], "query_id long, question string")
    got = sorted((r.query_id, r["sub"], r.search) for r in models.searches(ports.CalledModel(counted(calls, said), tries=1), questions).collect())
    assert got == [(1, 0, "one"), (1, 1, "two"), (2, 0, "simple text"), (3, 0, "simple text")]
    assert len(prompts(calls)) == 6


def test_cascade_goes_on_with_failures_alone(spark, tmp_path, calls):
    def first(p):
        if "x" in p:
            raise RuntimeError(p)
        return "one " + p

    def hangs(p):
        if "xx" in p:
            time.sleep(30)
        return "two " + p

    steps = [("a", ports.CalledModel(counted(calls, first), tries=1)), ("b", ports.CalledModel(hangs, tries=1, seconds=1.0)), ("c", ports.CalledModel(lambda p: 1 / 0 if "xxx" in p else "three " + p, tries=1))]
    df = spark.createDataFrame([(1, "p"), (2, "x"), (3, "xx"), (4, "xxx")], "id long, p string")
    model = ledger.Cascade(steps, f"{tmp_path}/cascade", "by")
    began = time.time()
    got = {r.id: (r.said, r.by) for r in model.answer(df, "p", "said").collect()}
    assert got == {1: ("one p", "a"), 2: ("two x", "b"), 3: ("three xx", "c"), 4: (None, None)}
    assert time.time() - began < 25 and len(prompts(calls)) == 4


def test_order_model_is_asked_once(spark, tmp_path, calls):
    class Order:
        def logits(self, pages_):
            note = counted(calls, lambda p: None)

            def run(batches):
                import pyarrow as pa

                for b in batches:
                    for k in range(b.num_rows):
                        note(str(k))
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.nulls(b.num_rows, pa.list_(pa.list_(pa.float64())))], names=[*b.schema.names, "scores"])

            from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

            return pages_.mapInArrow(run, StructType([*pages_.schema.fields, StructField("scores", ArrayType(ArrayType(DoubleType())))]))

    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    items = spark.createDataFrame([("d", 1, "i1", (0.0, 0.0, 5.0, 5.0), 1), ("d", 1, "i2", (0.0, 90.0, 5.0, 95.0), 2)], f"document_id string, page_number int, item_id string, bbox {box}, ord long")

    def keep(df):
        df.write.parquet(f"{tmp_path}/scores")
        return spark.read.parquet(f"{tmp_path}/scores")

    ordered, failed = pages.model_reading_order(items, Order(), keep=keep)
    assert failed.count() == 1 and [r.item_id for r in ordered.orderBy("reading_order").collect()] == ["i1", "i2"]
    assert len(prompts(calls)) == 1


def test_hashed_embedder_counts(spark):
    import numpy as np

    texts = ["a b a", "", None, "Word word other 1 2 3 " * 50]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    spots = {r.id: r.s for r in df.select("id", F.transform(T.tokens(F.coalesce("t", F.lit(""))), lambda t: F.pmod(F.xxhash64(t), F.lit(32))).alias("s")).collect()}
    for r in ports.HashedEmbedder(16).embed(df, "t", "e").collect():
        c = np.bincount(spots[r.id], minlength=32)
        want = (c[:16] - c[16:]).astype(float)
        assert np.allclose(r.e, want / (np.linalg.norm(want) or 1.0), atol=1e-6)


def test_answers_without_the_form_are_asked_again(spark, tmp_path, calls):
    def said(p):
        if "p1" in p:
            return 'Of course: {"a": 1, "b": "x"}'
        if "p2" in p:
            return '{"a": 1, "b": "again"}' if "didn't have the form" in p else '{"a": 1}'
        return "never"

    model = ledger.structured(ports.CalledModel(counted(calls, said), tries=1), "m", ("a", "b"), f"{tmp_path}/s")
    df = spark.createDataFrame([(1, "p1"), (2, "p2"), (3, "p3")], "id long, p string")
    got = {r.id: r.said for r in model.answer(df, "p", "said").collect()}
    assert "x" in got[1] and "again" in got[2] and got[3] is None
    assert len(prompts(calls)) == 5
