"""Operators on small tables and against loops written from their semantics."""

import random

import pytest
from pyspark.sql import functions as F

from folioloom.functions import geometry as G
from folioloom.operators import chunking, evaluation, layout, retrieval, store

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def blocks_of(spark, texts, page=1):
    return spark.createDataFrame([("d", page, i, f"b{i}", t, [f"i{i}"], [f"r{i}"]) for i, t in enumerate(texts)], "document_id string, page_number int, reading_order int, block_id string, text string, item_ids array<string>, region_ids array<string>")


def pack(texts, target, overlap):
    out, cur = [], []
    for i, t in enumerate(texts):
        if cur and len("\n\n".join([texts[k] for k in cur] + [t])) > target:
            out.append(cur)
            tail, n = [], 0
            for k in reversed(cur):
                if overlap <= 0 or n >= overlap:
                    break
                tail.insert(0, k)
                n += len(texts[k])
            cur = tail
        cur = [*cur, i]
    return [*out, cur] if cur else out


@pytest.mark.parametrize("seed", range(6))
def test_packing(spark, seed):
    rng = random.Random(seed)
    texts = ["x" * rng.choice([0, 1, 5, 30, 120]) if seed else "A" * 600 for _ in range(25)]
    target, overlap = (1000, 0) if not seed else (rng.choice([60, 130, 300]), rng.choice([0, 1, 20, 100]))
    got = chunking.pack_blocks(blocks_of(spark, texts), target, overlap).orderBy("chunk_no").collect()
    want = pack(texts, target, overlap)
    assert [r.block_ids for r in got] == [[f"b{i}" for i in c] for c in want]
    assert [r.text for r in got] == ["\n\n".join(texts[i] for i in c if texts[i].strip()) for c in want]


def test_overlap_repeats_sentinel(spark):
    got = chunking.pack_blocks(blocks_of(spark, ["A" * 600, "sentinel", "B" * 600]), 700, 9).orderBy("chunk_no").collect()
    assert len(got) == 2 and "sentinel" in got[0].text and "sentinel" in got[1].text


def test_reading_order_and_blocks(spark):
    rng = random.Random(1)
    items = []
    for i in range(200):
        x, y = rng.randint(0, 300), rng.randint(0, 120)
        items.append(("d", f"i{i}", 1 + i % 3, rng.choice(["a", " b ", "", "c"]), (float(x), float(y), x + 10.0, y + 8.0), i, rng.choice([None, "r1", "r2"])))
    df = spark.createDataFrame(items, f"document_id string, item_id string, page_number int, text string, bbox {BOX}, ord long, region_id string")
    made = layout.blocks(layout.reading_order(df)).orderBy("reading_order").collect()
    want, n = [], 0
    for page in (1, 2, 3):
        own = sorted((i for i in items if i[2] == page), key=lambda i: (round(i[4][1] / 18), i[4][0], i[4][1], i[5]))
        last = object()
        for i in own:
            key = (i[6], i[4][1] // 20)
            if key != last:
                n += 1
                want.append((f"p{page}_block_{n}", []))
                last = key
            want[-1][1].append(i)
    assert [r.block_id for r in made] == [k for k, _ in want]
    for r, (_, own) in zip(made, want):
        assert r.item_ids == [i[1] for i in own] and r.text == " ".join(i[3].strip() for i in own if i[3].strip())
        assert tuple(r.bbox) == (min(i[4][0] for i in own), min(i[4][1] for i in own), max(i[4][2] for i in own), max(i[4][3] for i in own))


def test_same_bucket_goes_by_x(spark):
    df = spark.createDataFrame([("d", "right", 1, (400.0, 100.0, 500.0, 118.0), 0), ("d", "left", 1, (10.0, 105.0, 100.0, 123.0), 1)], f"document_id string, item_id string, page_number int, bbox {BOX}, ord long")
    assert [r.item_id for r in layout.reading_order(df).orderBy("reading_order").collect()] == ["left", "right"]


def test_best_region_first_of_equals(spark):
    items = spark.createDataFrame([("d", "i", 1, (0.0, 0.0, 10.0, 10.0)), ("d", "alone", 2, (0.0, 0.0, 1.0, 1.0))], f"document_id string, item_id string, page_number int, bbox {BOX}")
    regions = spark.createDataFrame([("d", "late", "table", 1, (0.0, 0.0, 10.0, 10.0), 2), ("d", "first", "figure", 1, (0.0, 0.0, 20.0, 20.0), 1), ("d", "part", "table", 1, (0.0, 0.0, 5.0, 10.0), 0)], f"document_id string, region_id string, region_type string, page_number int, bbox {BOX}, ord long")
    got = {r.item_id: (r.region_id, r.overlap_ratio) for r in layout.best_regions(items, regions).collect()}
    assert got == {"i": ("first", 1.0), "alone": (None, 0.0)}


def test_region_dedupe(spark):
    rows = [("a", "table", 1, 0.0), ("near", "table", 1, 0.04), ("type", "figure", 1, 0.0), ("page", "table", 2, 0.0), ("far", "table", 1, 0.2)]
    df = spark.createDataFrame([("d", i, k, p, (o, o, 100 + o, 100 + o), n) for n, (i, k, p, o) in enumerate(rows)], f"document_id string, region_id string, region_type string, page_number int, bbox {BOX}, ord long")
    assert {r.region_id for r in layout.dedupe_regions(df).collect()} == {"a", "type", "page", "far"}


def test_payloads(spark):
    pages = spark.createDataFrame([("d", 1, [" a ", "", "b", "c"], [0.9], [[0.0, 0.0, 5.0, 5.0], [0.0, 0.0, 1.0, 1.0]], [[[0.0, 0.0]], [[0.0, 0.0]], [[1.0, 2.0], [4.0, 6.0]], []]), ("d", 2, [], [], [], [])], "document_id string, page_number int, rec_texts array<string>, rec_scores array<double>, rec_boxes array<array<double>>, dt_polys array<array<array<double>>>")
    items = layout.ocr_items(pages)
    got = {r.item_id: (r.text, r.confidence, tuple(r.bbox)) for r in items.collect()}
    assert got == {"p1_ocr_0": ("a", 0.9, (0, 0, 5, 5)), "p1_ocr_2": ("b", None, (1, 2, 4, 6))}
    assert [(r.page_number, r.code) for r in layout.pages_without_text(pages, items).collect()] == [(2, "ocr_no_text")]
    boxes = spark.createDataFrame([("d", 1, 0, " Table", 0.5, [0.0, 0.0, 9.0, 9.0]), ("d", 1, 1, "logo", 0.5, [0.0, 0.0, 9.0, 9.0]), ("d", 1, 2, "text", 0.5, [0.0, 0.0, 0.0, 9.0]), ("d", 2, 0, "chart", 0.5, [0.0, 0.0, 9.0, 9.0])], "document_id string, page_number int, pos int, label string, score double, coordinate array<double>")
    assert [(r.region_id, r.region_type) for r in layout.detected_regions(boxes).orderBy("ord").collect()] == [("region_1", "table"), ("region_2", "figure")]


def test_titles_and_sections(spark):
    rng = random.Random(2)
    rows = [("d", f"r{i}", 1 + i // 40, float(i), i, rng.choice(["title", "doc_title", "subtitle", "text", "table", "chart", "image"]), rng.choice(["", "t%d" % i, "x" * 250])) for i in range(160)]
    df = spark.createDataFrame(rows, "document_id string, region_id string, page_number int, y0 double, ord long, label string, text string").withColumn("region_type", layout.region_type(F.col("label")))
    titled = layout.assign_titles(df)
    got = {r.ord: (r.parent_title, r.parent_subtitle) for r in titled.collect()}
    title, sub, want, secs = "untitled", None, {}, {}
    for _, region, page, y, o, label, text in rows:
        if label in ("title", "doc_title"):
            title, sub = text[:200] or f"section_{region}", None
            want[o] = (None, None)
        elif label == "subtitle":
            sub, want[o] = text[:200] or None, (None, None)
        else:
            want[o] = (title, sub)
            s = secs.setdefault(title, {"sub": sub, "text": 0, "table": 0, "chart": 0, "image": 0, "page": page, "t": [title]})
            s[label] += 1
            if label == "text" and text:
                s["t"].append(text)
    assert got == want
    for r in layout.sections(titled).collect():
        s = secs[r.title]
        assert (r.subtitle, r.text_blocks, r.tables, r.charts, r.figures, r.page_start, r.flat_text) == (s["sub"], s["text"], s["table"], s["chart"], s["image"], s["page"], "\n".join(s["t"])[:2000])


def test_strategy(spark):
    sections = spark.createDataFrame([("a", 3), ("b", 0), ("b", 0), ("c", 0)], "document_id string, tables int")
    loose = spark.createDataFrame([("b", False), ("c", True)], "document_id string, well_structured boolean")
    got = {r.document_id: (r.strategy, r.chunk_size) for r in layout.chunk_strategy(sections, loose).collect()}
    assert got == {"a": ("layout_aware", 1800), "b": ("recursive_large", 2000), "c": ("recursive", 1800)}


def test_visual_summaries(spark):
    regions = spark.createDataFrame([("d", "r", "figure", 5, (0.0, 100.0, 10.0, 110.0)), ("d", "lone", "table", 6, (0.0, 0.0, 9.0, 9.0)), ("d", "named", "table", 7, (0.0, 0.0, 9.0, 9.0))], f"document_id string, region_id string, region_type string, page_number int, bbox {BOX}")
    made = spark.createDataFrame([("d", 5, f"b{i}", i, t, (0.0, y, 9.0, y + 5)) for i, (t, y) in enumerate([("far", 0.0), ("above", 90.0), ("X" * 2000, 112.0), ("below", 130.0)])], f"document_id string, page_number int, block_id string, reading_order int, text string, bbox {BOX}")
    chunks = spark.createDataFrame([("d", "c1", 1, "chunk text", ["named"])], "document_id string, chunk_id string, ord int, text string, source_region_ids array<string>")
    got = {r.region_id: r for r in layout.visual_summaries(regions, made, chunks).collect()}
    assert got["r"].linked_block_ids == ["b2", "b1", "b3"] and len(got["r"].summary_text) == 1200
    assert got["lone"].summary_text == "Detected table region on page 6." and got["named"].summary_text == "chunk text" and got["named"].linked_chunk_ids == ["c1"]


def test_index_records(spark):
    df = spark.createDataFrame([("a", "t", "", "d", "f", 3, {"page_number": "9", "x": None}), ("b", "  ", None, "d", None, None, None), ("c", "t", "p", "d", None, None, None)], "chunk_id string, text string, page_content string, document_id string, source_filename string, page_number int, metadata map<string,string>")
    got = {r.chunk_id: (r.text, r.metadata) for r in chunking.index_records(df).collect()}
    assert got == {"a": ("t", {"page_number": "9", "document_id": "d", "source_filename": "f", "chunk_id": "a"}), "c": ("p", {"document_id": "d", "chunk_id": "c"})}


def test_fusion_by_hand(spark):
    d = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "query_id int, rank int, chunk_id string")
    s = spark.createDataFrame([(1, 1, "b"), (1, 2, "c")], "query_id int, rank int, chunk_id string")
    got = [(r.chunk_id, round(r.score, 9)) for r in retrieval.fuse(d, s).orderBy("rank").collect()]
    assert got == [("b", round(1 / 62 + 1 / 61, 9)), ("a", round(1 / 61, 9)), ("c", round(1 / 62, 9))]


@pytest.mark.parametrize("seed", range(4))
def test_parent_expansion(spark, seed):
    rng = random.Random(seed)
    corpus = [(f"c{i}", i, rng.choice(["d", "e"]), rng.choice([None, "T", "U"]), rng.choice([None, "s"])) for i in range(30)]
    top, want = [], {}
    for q in range(12):
        chosen = rng.sample(corpus, rng.randint(0, 6))
        top += [(q, k + 1, c[0], 1.0 / (k + 1)) for k, c in enumerate(chosen)]
        key = {c[0]: c[2:] for c in corpus}
        n = {}
        for c in chosen:
            if c[3] is not None:
                n[c[2:]] = n.get(c[2:], 0) + 1
        out, seen = [], set()
        for k, c in enumerate(chosen):
            group = [(x[0], 0.0) for x in corpus if x[2:] == c[2:]] if n.get(key[c[0]], 0) >= 2 else [(c[0], 1.0 / (k + 1))]
            for name, s in group:
                if name not in seen:
                    seen.add(name)
                    out.append((name, s))
        want[q] = out
    t = spark.createDataFrame(top, "query_id int, rank int, chunk_id string, score double")
    c = spark.createDataFrame(corpus, "chunk_id string, ord long, document_id string, parent_title string, parent_subtitle string")
    got = {}
    for r in retrieval.expand_parents(t, c).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, r.score))
    assert got == {q: v for q, v in want.items() if v}


def test_scopes(spark):
    df = spark.createDataFrame([("a1", "doc_a"), ("b1", "doc_b")], "chunk_id string, document_id string")
    assert [retrieval.scoped(df, x).count() for x in (None, [], ["doc_a"])] == [2, 0, 1]


def test_apply_ranking(spark):
    cand = spark.createDataFrame([(1, 1, "a", 0.9), (1, 2, "b", 0.02), (1, 3, "c", 0.5), (2, 1, "a", 0.1)], "query_id int, rank int, chunk_id string, score double")
    verdict = spark.createDataFrame([(1, ["c", "x", "b", "a"], {"c": 0.4}, ["a"]), (2, ["a"], {"a": 0.0}, [])], "query_id int, ranking array<string>, scores map<string,double>, dropped array<string>")
    got = [(r.query_id, r["rank"], r.chunk_id, r.score) for r in retrieval.apply_ranking(cand, verdict).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, "c", 0.4), (2, 1, "a", 0.1)]


def test_metrics(spark):
    res = spark.createDataFrame([(1, 1, "x"), (1, 2, "r"), (3, 1, "z")], "query_id int, rank int, chunk_id string")
    labels = spark.createDataFrame([(1, ["r"]), (2, ["r"]), (3, [])], "query_id int, relevant array<string>")
    got = {r.query_id: tuple(r)[1:] for r in evaluation.score(res, labels).collect()}
    assert got == {1: (1.0, 0.5, 0.5, 1.0), 2: (0.0, 0.0, 0.0, 0.0), 3: (None,) * 4}
    means = {r.metric: (r["mean"], r.passes) for r in evaluation.summary(evaluation.score(res, labels)).collect()}
    assert means["hit_rate"] == (0.5, True) and means["mrr"] == (0.25, False)
    text = evaluation.report("run", {"hit_rate": 0.5}, [{"question": "q" * 80, "scores": {"mrr": 0.5}, "answer": "a"}])
    assert "█" * 10 in text and "Q01: " + "q" * 60 in text


def test_rate_limit(spark):
    df = spark.createDataFrame([(i, "ip", s) for i, s in enumerate([0, 1, 1, 2, 61, 200])], "id int, ip string, s int").withColumn("ts", F.timestamp_seconds("s"))
    got = [(r.n, r.allowed) for r in store.rate_limit(df, "ip", "ts", "id", 3, 60).orderBy("id").collect()]
    assert got == [(1, True), (2, True), (3, True), (4, False), (2, True), (1, True)]


def test_store(spark):
    old = spark.createDataFrame([("a", "d1"), ("b", "d2")], "chunk_id string, document_id string")
    new = spark.createDataFrame([("c", "d1")], "chunk_id string, document_id string")
    assert sorted(r.chunk_id for r in store.replace_documents(old, new).collect()) == ["b", "c"]
    users = spark.createDataFrame([(1, "a@x")], "id int, email string")
    kept, refused = store.add_users(users, spark.createDataFrame([(2, " A@X "), (3, "b@x"), (4, "B@x")], "id int, email string"))
    assert sorted(r.id for r in kept.collect()) == [1, 3] and sorted(r.id for r in refused.collect()) == [2, 4]
    states = spark.createDataFrame([("a", "preprocessing", 40, 500), ("b", "ready", 40, 500)], "document_id string, status string, pages_done int, total_pages int")
    assert {r.document_id: (r.pages_done, r.total_pages) for r in store.job_status(states).collect()} == {"a": (40, 500), "b": (None, None)}


def test_bm25_reads_texts_once_and_sums_where_a_chunk_lies(spark):
    rng = random.Random(4)
    rows = [(i, i % 50, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 12)))) for i in range(200)] + [(900, 7, None)]
    df = spark.createDataFrame(rows, "chunk_id long, ord long, text string").repartition(3)
    asked = spark.createDataFrame([(1, "a b a"), (2, "h"), (3, "zz"), (4, "!")], "query_id long, question string")
    got = retrieval.bm25(df, asked, 300)
    assert "text#" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = retrieval.bm25(df, asked, 300, postings=retrieval.token_index(df))
    key = lambda r: (r.query_id, r.chunk_id, round(r.score, 8))
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    assert retrieval.Texts(df.limit(0)).search(asked, 3).count() == 0


def test_containing_meets_on_a_word(spark, monkeypatch):
    texts = ["xa b cy", "a b", "a  c d", "b longer c", None, "", "say a longer c", "one a b c two", "a\nb c d"]
    asked = ["a b c", "a  c", "a b", "", None, "a longer c", " b ", "b c d"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    q = spark.createDataFrame(list(enumerate(asked)), "query_id long, question string")
    want = sorted((i, j) for i, a in enumerate(asked) for j, t in enumerate(texts) if a is not None and t is not None and a in t)
    for most in (2000, 2):
        monkeypatch.setattr(evaluation, "QUERY_BLOCK", most)
        found = evaluation.containing(docs, q)
        assert sorted(map(tuple, found.collect())) == want
