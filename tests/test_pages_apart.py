"""A document's pages stay apart: numbers over a document and links of a page come without its rows meeting in one task."""

import contextlib
import random

import pytest
from folioloom.functions.geometry import BOX
from folioloom.operators import chunking, layout
from folioloom.plans import ingest
from pyspark.sql import functions as F

ITEM = f"document_id string, item_id string, page_number int, text string, bbox {BOX}, ord long"
REGION = f"document_id string, region_id string, region_type string, page_number int, bbox {BOX}, ord long"


@contextlib.contextmanager
def partitions_as_set(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        yield
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def parts(df, number="reading_order"):
    return df.select(number, F.spark_partition_id().alias("p")).where(f"{number} > 0").select("p").distinct().count()


def overlap(a, b):
    return max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))


@pytest.mark.parametrize("kept", (False, True))
def test_blocks_of_one_document_lie_by_page(spark, tmp_path, kept):
    rng = random.Random(5)
    items = [("d", f"i{i}", 1 + i % 40, "t", (float(rng.randint(0, 300)), y, 310.0, y + 8), i, rng.choice([None, "r"])) for i in range(800) for y in [float(rng.randint(0, 200))]]
    df = layout.reading_order(spark.createDataFrame(items, ITEM + ", region_id string"))
    with partitions_as_set(spark):
        made = layout.blocks(df, keep=ingest.kept_in(str(tmp_path / "kept"))) if kept else layout.blocks(df)
        assert kept or parts(made) > 1  # all were in one, as the numbers were a window over the document
        rows = sorted(made.collect(), key=lambda r: r.reading_order)
    assert [r.reading_order for r in rows] == list(range(1, len(rows) + 1))
    assert [r.page_number for r in rows] == sorted(r.page_number for r in rows)
    assert [r.block_id for r in rows] == [f"p{r.page_number}_block_{i}" for i, r in enumerate(rows, 1)]
    place = {r.item_id: r.reading_order for r in df.collect()}
    for a, b in zip(rows, rows[1:]):
        assert a.page_number < b.page_number or place[a.item_ids[-1]] < place[b.item_ids[0]]


def test_pages_without_a_number_come_first(spark):
    items = [("d", "a", 2, "x", (0.0, 0.0, 1.0, 1.0), 1, None), ("d", "b", None, "y", (0.0, 0.0, 1.0, 1.0), 2, None), ("d", "c", 1, "z", (0.0, 0.0, 1.0, 1.0), 3, None)]
    made = layout.blocks(layout.reading_order(spark.createDataFrame(items, ITEM + ", region_id string")))
    assert sorted((r.reading_order, r.text) for r in made.collect()) == [(1, "y"), (2, "z"), (3, "x")]


def test_links_neither_shuffle_nor_sort_pairs(spark):
    rng = random.Random(6)
    box = lambda w, h: (lambda x, y: (x, y, x + w, y + h))(float(rng.randint(0, 200)), float(rng.randint(0, 400)))
    regions = [("d", f"r{i}", rng.choice(["table", "figure", "text_block"]), i % 4, box(30, 30), i) for i in range(60)]
    blocks = [("d", 1 + i % 3, f"b{i}", i, f"t{i}", box(40, 10)) for i in range(60)]
    made = spark.createDataFrame(blocks, f"document_id string, page_number int, block_id string, reading_order int, text string, bbox {BOX}")
    links = layout.linked_blocks(spark.createDataFrame(regions, REGION), made)
    assert "Window" not in links._jdf.queryExecution().executedPlan().toString()  # three of them sorted all pairs of a page
    got = {}
    for r in links.collect():
        got.setdefault(r.region_id, []).append((r.pos, r.block_id))
    want = {}
    for _, region, kind, page, b, _ in regions:
        own = [x for x in blocks if x[1] == page and kind != "text_block"]
        on = [x for x in own if overlap(x[5], b) > 0]
        near = sorted(own, key=lambda x: (min(abs(x[5][1] - b[3]), abs(x[5][3] - b[1])), x[3]))[:3]
        if own:
            want[region] = [(i, x[2]) for i, x in enumerate(on or near, 1)]
    assert {k: sorted(v) for k, v in got.items()} == want


def test_rows_of_one_item_share_its_region(spark):
    items = [("d", "i", 1, "t", (0.0, 0.0, 10.0, 10.0), 1), ("d", "i", 1, "t", (0.0, 0.0, 10.0, 10.0), 1), ("d", "i", 1, "t", (90.0, 0.0, 100.0, 10.0), 1), ("d", "j", 1, "t", (90.0, 50.0, 100.0, 60.0), 1)]
    regions = [("d", "half", "table", 1, (0.0, 0.0, 5.0, 10.0), 1), ("d", "whole", "figure", 1, (0.0, 0.0, 20.0, 20.0), 2)]
    matched = layout.best_regions(spark.createDataFrame(items, ITEM), spark.createDataFrame(regions, REGION))
    assert sorted((r.item_id, r.region_id, r.overlap_ratio) for r in matched.collect()) == [("i", "whole", 1.0)] * 3 + [("j", None, 0.0)]
    ordered = layout.reading_order(matched)
    exchanges = ordered._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert exchanges == 2  # items once and regions; items went three times


def test_chunks_of_one_document_lie_by_page(spark):
    rows = [("d", 1 + i % 30, i, f"b{i}", "x" * (1 + i * 7 % 50)) for i in range(600)]
    made = spark.createDataFrame(rows, "document_id string, page_number int, reading_order int, block_id string, text string").withColumns({"item_ids": F.array("block_id"), "region_ids": F.array("block_id")})
    with partitions_as_set(spark):
        packed = chunking.pack_blocks(made, 120, 20)
        assert parts(packed, "chunk_no") > 1  # all were in one, as the numbers were a window over the document
        got = sorted(packed.collect(), key=lambda r: r.chunk_no)
    assert [r.chunk_no for r in got] == list(range(1, len(got) + 1))
    want = []
    for page in range(1, 31):
        cur = []
        for x in [r for r in rows if r[1] == page]:
            if cur and sum(len(y[4]) + 2 for y in cur) + len(x[4]) > 120:
                want.append((page, [y[3] for y in cur]))
                back, n = [], 0
                for y in reversed(cur):
                    if n >= 20:
                        break
                    back, n = [y, *back], n + len(y[4])
                cur = back
            cur = [*cur, x]
        want.append((page, [y[3] for y in cur]))
    assert [(r.page_number, r.block_ids) for r in got] == want


def test_summaries_neither_shuffle_nor_sort_pairs(spark):
    regions = spark.createDataFrame([("d", "r", "table", 1, (0.0, 0.0, 9.0, 9.0), 1), ("d", "s", "figure", 2, (0.0, 0.0, 9.0, 9.0), 2)], REGION)
    made = spark.createDataFrame([("d", 1, "b1", 1, None, (0.0, 0.0, 5.0, 5.0)), ("d", 1, "b2", 2, "two", (0.0, 6.0, 5.0, 8.0))], f"document_id string, page_number int, block_id string, reading_order int, text string, bbox {BOX}")
    chunks = spark.createDataFrame([("d", "c", 1, "chunk", ["s"])], "document_id string, chunk_id string, ord int, text string, source_region_ids array<string>")
    got = layout.visual_summaries(regions, made, chunks)
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.region_id, r.linked_block_ids, r.linked_chunk_ids, r.summary_text) for r in got.collect()) == [("r", ["b1", "b2"], [], "two"), ("s", [], ["c"], "chunk")]
