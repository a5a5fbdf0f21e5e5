"""Sources, sinks, streams and the composed plans."""

import os

from pyspark.sql import functions as F

from folioloom.operators import ports
from folioloom.plans import ask, ingest
from folioloom.sources import files
from folioloom.streaming import jobs


def page(n, texts, boxes):
    return ("d", n, texts, [0.9] * len(texts), boxes, [], 600, 800, "p.png")


def test_ingest_to_answer(spark, tmp_path):
    pages = spark.createDataFrame(
        [page(1, ["Revenue", "grew in total by 12 percent", "x 1", "y 2"], [[0.0, 0.0, 90.0, 15.0], [0.0, 40.0, 190.0, 55.0], [0.0, 100.0, 50.0, 115.0], [60.0, 100.0, 120.0, 115.0]]), page(2, ["Weather", "it rained all day"], [[0.0, 0.0, 90.0, 15.0], [0.0, 40.0, 190.0, 55.0]]), page(3, [], [])],
        "document_id string, page_number int, rec_texts array<string>, rec_scores array<double>, rec_boxes array<array<double>>, dt_polys array<array<array<double>>>, image_width int, image_height int, page_image_path string",
    )
    boxes = spark.createDataFrame(
        [("d", 1, 0, "title", 0.9, [0.0, 0.0, 100.0, 20.0]), ("d", 1, 1, "text", 0.9, [0.0, 30.0, 200.0, 60.0]), ("d", 1, 2, "table", 0.9, [0.0, 90.0, 200.0, 160.0]), ("d", 2, 0, "title", 0.9, [0.0, 0.0, 100.0, 20.0]), ("d", 2, 1, "text", 0.9, [0.0, 30.0, 200.0, 60.0])],
        "document_id string, page_number int, pos int, label string, score double, coordinate array<double>",
    )
    files.export(ingest.ingest(pages, boxes), f"{tmp_path}/run")  # each table is written once and read from there
    made = {name: files.exported(spark, f"{tmp_path}/run", name) for name in os.listdir(f"{tmp_path}/run")}
    assert [r.text for r in made["page_texts"].orderBy("page_number").collect()] == ["Revenue\ngrew in total by 12 percent\nx 1 y 2", "Weather\nit rained all day"]
    chunks = {r.page_number: r for r in made["chunks"].collect()}
    assert chunks[1].chunk_id == "d:chunk:1" and chunks[1].region_types == ["table", "text_block"] and chunks[1].parent_title == "Revenue" and chunks[2].parent_title == "Weather"
    assert {(r.title, r.tables) for r in made["sections"].collect()} == {("Revenue", 1), ("Weather", 0)}
    assert [(r.region_id, r.summary_text) for r in made["visual_summaries"].collect()] == [("region_3", "x 1 y 2")]
    assert [r.page_number for r in made["issues"].collect()] == [3]
    index = ingest.index_rows(made)
    assert {r.document_id for r in index.collect()} == {"d"}
    order = made["chunks"].select("chunk_id", F.col("chunk_no").cast("long").alias("ord"), "region_types", "parent_title", "parent_subtitle", "source_region_ids", "document_id")
    index.select("chunk_id", "text", "embedding").join(order, "chunk_id").write.parquet(f"{tmp_path}/corpus")
    corpus = spark.read.parquet(f"{tmp_path}/corpus")
    plan = ask.Ask(corpus)
    questions = spark.createDataFrame([(1, "how much did revenue grow in the table", ["d:chunk:1"]), (2, "when has it rained", ["d:chunk:2"])], "query_id int, question string, relevant array<string>")
    got = {r.query_id: r for r in plan.answer(questions).collect()}
    hits = plan.retrieve(questions)
    assert got[1].sources[0].chunk_id == "d:chunk:1" and got[1].answer.startswith("Revenue") and got[2].sources[0].chunk_id == "d:chunk:2"
    means = {r.metric: r["mean"] for r in plan.evaluate(questions).collect()}
    assert means["mrr"] == 1.0 and means["precision_at_k"] == 0.5
    routed = {r.query_id: r for r in plan.route(questions, hits, corpus, made["visual_summaries"]).collect()}
    assert routed[1].use_table_agent and routed[1].table_regions == ["region_3"] and not routed[2].use_table_agent


def test_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a.pdf", "b.PDF", "c.txt"):
        (tmp_path / "in" / name).write_bytes(name.encode())
    got = files.documents(spark, f"{tmp_path}/in", (".pdf",)).collect()
    assert sorted(r.source_filename for r in got) == ["a.pdf", "b.PDF"] and all(len(r.document_id) == 64 for r in got)
    assert files.artifact(spark, str(tmp_path), "chunks", files.CHUNK).count() == 0
    (tmp_path / "structured").mkdir()
    (tmp_path / "structured" / "chunks.json").write_text('[{"chunk_id": "s"}]')
    assert files.artifact(spark, str(tmp_path), "chunks", files.CHUNK).first().chunk_id == "s"
    (tmp_path / "chunks.json").write_text('[{"chunk_id": "direct"}]')
    assert files.artifact(spark, str(tmp_path), "chunks", files.CHUNK).first().chunk_id == "direct"
    (tmp_path / "q.jsonl").write_text('{"question": "a", "relevant_chunk_ids": ["x"]}\n\n{"question": "b"}\n')
    assert [r.question for r in files.questions(spark, f"{tmp_path}/q.jsonl").orderBy("question").collect()] == ["a", "b"]


def test_index_sink(spark, tmp_path):
    path = f"{tmp_path}/index"
    assert files.index(spark, path).count() == 0
    row = lambda c, d, t: (c, t, d, {}, [1.0])
    files.write_index(spark.createDataFrame([row("a1", "a", "x"), row("a2", "a", "x"), row("b1", "b", "x")], files.INDEX), path)
    files.write_index(spark.createDataFrame([row("a1", "a", "y")], files.INDEX), path)
    assert {(r.chunk_id, r.text) for r in files.index(spark, path).collect()} == {("a1", "y"), ("b1", "x")}


def test_progress_and_delivery_streams(spark, tmp_path):
    folder = f"{tmp_path}/pages"
    spark.createDataFrame([("d", 1, 4), ("d", 2, 4), ("d", 2, 4), ("e", 1, 1)], "document_id string, page_number int, total_pages int").write.parquet(folder)
    pages = spark.readStream.schema("document_id string, page_number int, total_pages int").parquet(folder)
    got = jobs.drain(jobs.progress(pages), "update", f"{tmp_path}/ck1", "document_id").collect()
    assert {r.document_id: (r.pages_done, r.total_pages) for r in got} == {"d": (2, 4), "e": (1, 1)}
    os.makedirs(f"{tmp_path}/up")
    for n, body in (("a.pdf", b"1"), ("copy.pdf", b"1"), ("b.pdf", b"2")):
        with open(f"{tmp_path}/up/{n}", "wb") as f:
            f.write(body)
    seen = []
    handler = jobs.ingest(lambda b: b.select("document_id"), lambda s: s.createDataFrame([(d,) for d in seen], "document_id string"), lambda out: seen.extend(r.document_id for r in out.collect()))
    for ck in ("ck2", "ck3"):  # the second delivery finds all done
        jobs.each_batch(jobs.uploads(spark, f"{tmp_path}/up"), handler, f"{tmp_path}/{ck}").awaitTermination()
    assert len(seen) == len(set(seen)) == 2


def test_embedder_port_in_plan(spark):
    assert isinstance(ports.HashedEmbedder().column(F.lit("x")), type(F.lit(1)))
