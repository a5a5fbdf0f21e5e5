"""Image headers, called readers and detectors, counts of an index, runs of an evaluation."""

import struct

import pytest
from pyspark.sql import functions as F

from folioloom.operators import pages, ports
from folioloom.plans import ask
from folioloom.sources import files

PNG = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 30, 40)
JPEG = b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"JFIF\0" + b"\0" * 9 + b"\xff\xff\xc2" + struct.pack(">HBHH", 11, 8, 50, 60) + b"\0" * 9
BMP = b"BM" + b"\0" * 16 + struct.pack("<ii", 70, -80)
WEBP = {
    "VP8X": b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (89).to_bytes(3, "little") + (99).to_bytes(3, "little"),
    "VP8L": b"RIFF\0\0\0\0WEBPVP8L\0\0\0\0\x2f" + (89 | 99 << 14).to_bytes(4, "little") + b"\0" * 9,
    "VP8 ": b"RIFF\0\0\0\0WEBPVP8 " + b"\0" * 10 + struct.pack("<HH", 90, 100),
}


def tiff(order):
    entry = lambda tag, kind, v: struct.pack(order + "HHI", tag, kind, 1) + (struct.pack(order + "HH", v, 0) if kind == 3 else struct.pack(order + "I", v))
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8) + struct.pack(order + "H", 3) + entry(254, 4, 0) + entry(256, 3, 110) + entry(257, 4, 120)


def test_image_sizes(spark):
    assert pages.image_size(PNG) == (30, 40) and pages.image_size(JPEG) == (60, 50) and pages.image_size(BMP) == (70, 80)
    assert {pages.image_size(w) for w in WEBP.values()} == {(90, 100)}
    assert pages.image_size(tiff("<")) == pages.image_size(tiff(">")) == (110, 120)
    for bad in (b"", b"%PDF-1.4", PNG[:20], JPEG[:10], b"II*\0", b"\xff\xd8" + b"\xff" * 40, b"RIFF\0\0\0\0WEBPxxxx" + b"\0" * 20):
        assert pages.image_size(bad) is None
    docs = spark.createDataFrame([("a", bytearray(JPEG)), ("b", bytearray(b"no image")), ("c", None)], "document_id string, content binary")
    assert [(r.document_id, r.page_number, r.image_width, r.image_height) for r in pages.ImagePages().render(docs).collect()] == [("a", 1, 60, 50)]


def test_called_reader_and_detector(spark):
    shown = spark.createDataFrame([("a", 1, bytearray(b"x")), ("a", 2, bytearray(b"bad")), ("b", 1, bytearray(b""))], "document_id string, page_number int, image binary")

    def read(image):
        if image == b"bad":
            raise ValueError("blurred")
        return {"rec_texts": [image.decode()] * len(image), "rec_scores": [0.5] * len(image), "rec_boxes": [[0.0, 0.0, 1.0, 1.0]] * len(image), "dt_polys": []}

    got = {(r.document_id, r.page_number): (r.rec_texts, r.error) for r in pages.CalledReader(read).read(shown).collect()}
    assert got == {("a", 1): (["x"], None), ("a", 2): (None, "ValueError: blurred"), ("b", 1): ([], None)}
    boxes = pages.CalledDetector(lambda image: [("table", 1, [0, 0, 5, len(image)])] * len(image)).detect(shown).where("label is not null")
    assert sorted((r.document_id, r.page_number, r.pos, r.coordinate[3]) for r in boxes.collect()) == [("a", 1, 0, 1.0)] + [("a", 2, i, 3.0) for i in range(3)]


def test_index_counts_and_required_chunks(spark, tmp_path):
    row = lambda c, d: (c, "t", d, {}, [1.0])
    path = f"{tmp_path}/index"
    rows = spark.createDataFrame([row("a1", "a"), row("a2", "a"), row("b1", "b")], files.INDEX)
    assert {r.document_id: r.n for r in files.index_documents(rows, path).collect()} == {"a": 2, "b": 1}
    assert {r.document_id: r.n for r in files.index_documents(rows.where("chunk_id = 'a1'"), path).collect()} == {"a": 1}
    assert files.index(spark, path).count() == 2
    with pytest.raises(FileNotFoundError):
        files.artifact(spark, str(tmp_path), "chunks", files.CHUNK, required=True)


def test_run_passes_over_failed_questions(spark, tmp_path):
    corpus = spark.createDataFrame(
        [(f"c{i}", i, t, "d", ["text_block"], "T", "") for i, t in enumerate(["revenue grew by twelve", "rain fell all day", "costs fell"])],
        "chunk_id string, ord long, text string, document_id string, region_types array<string>, parent_title string, parent_subtitle string",
    )
    corpus = ports.HashedEmbedder(16).embed(corpus, "text", "embedding")
    questions = spark.createDataFrame([(1, "how did revenue grow", "by twelve", ["c0"]), (2, "fail on rain", None, ["c1"]), (3, "what of costs", "", ["c2"])], "query_id int, question string, ground_truth string, relevant array<string>")
    model = ports.RuledModel(lambda p: F.when(~p.contains("fail on"), F.concat(F.lit("said "), F.length(p).cast("string"))))
    judge = ports.RuledModel(lambda p: F.lit('{"score": 0.5}'))
    means = {r.metric: r["mean"] for r in ask.Ask(corpus, ports.HashedEmbedder(16), model).evaluate_run(questions, f"{tmp_path}/run", judge).collect()}
    assert means["hit_rate"] == 1.0 and means["faithfulness"] == 0.5 and means["answer_correctness"] == 0.5
    results = spark.read.json(f"{tmp_path}/run/results")
    assert sorted(r.query_id for r in results.collect()) == [1, 3]
    assert {r.query_id: r.answer_correctness for r in results.collect()} == {1: 0.5, 3: None}  # no true answer, no score
    lines = [r.value for r in spark.read.text(f"{tmp_path}/run/report").collect()]
    assert any(x.startswith("Q01: how did revenue grow") for x in lines) and not any("fail on" in x for x in lines)
    assert any("redundant" in x and x.startswith("precision_at_k") for x in lines)


def test_sql_tables(spark):
    url = "jdbc:derby:memory:folioloom;create=true"
    rows = spark.createDataFrame([(i, f"c{i % 7}", "t" * (i % 5)) for i in range(100)], "id long, conversation_id string, text string")
    kinds = "conversation_id VARCHAR(64)"
    files.append_sql(rows.where("id < 60"), url, "messages", kinds)
    files.append_sql(rows.where("id >= 60"), url, "messages")
    got = files.sql_table(spark, url, "messages", "id", 3, 0, 100)
    assert got.rdd.getNumPartitions() == 3
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))
    doomed = spark.createDataFrame([("c1",), ("c3",), ("c3",), (None,), ("zz",)], "k string")
    assert files.delete_sql(doomed, url, "messages", "conversation_id", kinds) == sum(i % 7 in (1, 3) for i in range(100))
    assert {r.conversation_id for r in files.sql_table(spark, url, "messages").collect()} == {"c0", "c2", "c4", "c5", "c6"}
    assert files.delete_sql(doomed, url, "messages", "conversation_id", kinds) == 0
