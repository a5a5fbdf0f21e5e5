"""Pages as images, reading order by a model, crops, and what a run sums up to."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioloom.operators import layout, ports
from folioloom.streaming import attempts

#: Items of a page that an order model is shown; the rest follow in geometric order.
MOST_ITEMS = 510


def image_size(content: bytes) -> tuple[int, int] | None:
    """(width, height) of a PNG, JPEG, BMP, WebP or TIFF image, by its headers; None of anything else."""
    u = int.from_bytes
    if content[:8] == b"\x89PNG\r\n\x1a\n" and len(content) >= 24:
        return u(content[16:20], "big"), u(content[20:24], "big")
    if content[:2] == b"BM" and len(content) >= 26:
        return u(content[18:22], "little", signed=True), abs(u(content[22:26], "little", signed=True))
    if content[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(content) and content[at] == 0xFF:
            kind, size = content[at + 1], u(content[at + 2 : at + 4], "big")
            if kind == 0xFF:  # filling
                at += 1
            elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):  # a frame's header
                return u(content[at + 7 : at + 9], "big"), u(content[at + 5 : at + 7], "big")
            else:
                at += 2 + (0 if kind == 0x01 or 0xD0 <= kind <= 0xD8 else size)
        return None
    if content[:4] == b"RIFF" and content[8:12] == b"WEBP" and len(content) >= 30:
        kind = content[12:16]
        if kind == b"VP8X":
            return 1 + u(content[24:27], "little"), 1 + u(content[27:30], "little")
        if kind == b"VP8L":
            bits = u(content[21:25], "little")
            return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
        if kind == b"VP8 ":
            return u(content[26:28], "little") & 0x3FFF, u(content[28:30], "little") & 0x3FFF
        return None
    if content[:4] in (b"II*\x00", b"MM\x00*") and len(content) >= 8:
        order = "little" if content[:2] == b"II" else "big"
        at, found = u(content[4:8], order), {}
        for k in range(u(content[at : at + 2], order)):
            e = content[at + 2 + 12 * k : at + 14 + 12 * k]
            if len(e) == 12 and u(e[:2], order) in (256, 257):
                found[u(e[:2], order)] = u(e[8:10] if u(e[2:4], order) == 3 else e[8:12], order)
        return (found[256], found[257]) if len(found) == 2 else None
    return None


class ImagePages:
    """Renders documents that are an image themselves: one page of the size in the file's header. Others have no pages."""

    def render(self, documents: DataFrame) -> DataFrame:
        def one(content: bytes) -> list[tuple[int, int, bytes]]:
            size = image_size(content or b"")
            return [(*size, content)] if size else []

        return CalledRenderer(one).render(documents)


PAGE_READ = "rec_texts array<string>, rec_scores array<double>, rec_boxes array<array<double>>, dt_polys array<array<array<double>>>"


class CalledReader:
    """Recognises text by any function of a page's image to a dict of rec_texts, rec_scores, rec_boxes, dt_polys, in the tasks that hold
    the pages. A page on which it raises has error, and no text; it fails no other."""

    def __init__(self, function: Callable[[bytes], dict]):
        self.function = function

    def read(self, pages: DataFrame) -> DataFrame:
        """document_id, page_number, error, and what ocr_items() takes."""
        function = self.function
        return attempts.caught(pages.select("document_id", "page_number", "image"), lambda r: [function(r["image"])], PAGE_READ, ("document_id", "page_number"))


class CalledDetector:
    """Detects regions by any function of a page's image to a list of (label, score, [x0, y0, x1, y1]), as CalledReader does texts."""

    def __init__(self, function: Callable[[bytes], list[tuple[str, float, list[float]]]]):
        self.function = function

    def detect(self, pages: DataFrame) -> DataFrame:
        """document_id, page_number, error, and what detected_regions() takes: pos, label, score, coordinate. A page without regions has
        a row without a label."""
        function = self.function

        def one(r: dict) -> list[dict]:
            return [{"pos": i, "label": label, "score": float(score), "coordinate": [float(x) for x in box]} for i, (label, score, box) in enumerate(function(r["image"]))]

        return attempts.caught(pages.select("document_id", "page_number", "image"), one, "pos int, label string, score double, coordinate array<double>", ("document_id", "page_number"))


class CalledRenderer:
    """Renders by any function of a file's bytes to a list of (width, height, image), called in the tasks that read the files."""

    def __init__(self, function):
        self.function = function

    def render(self, documents: DataFrame) -> DataFrame:
        import pyarrow as pa

        function = self.function
        names = ["document_id", "page_number", "image_width", "image_height", "image"]
        types = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary())

        def run(batches: Iterator) -> Iterator:
            for b in batches:
                for doc, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):  # a document at a time
                    made = [(doc, n, w, h, image) for n, (w, h, image) in enumerate(function(content), 1)]
                    if made:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)], names=names)

        return documents.select("document_id", "content").mapInArrow(run, "document_id string, page_number int, image_width int, image_height int, image binary")


def permutation(scores: np.ndarray) -> np.ndarray:
    """The place of each row of an n x n matrix of scores, each place taken once: rows ask for their best place, a place keeps
    the row that scores highest there, and who is turned away asks for its next best."""
    n = len(scores)
    wishes = np.argsort(scores, axis=1, kind="stable")[:, ::-1]
    asked, keeper = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    waiting = list(range(n - 1, -1, -1))
    while waiting:
        row = waiting.pop()
        place = wishes[row, asked[row]]
        asked[row] += 1
        other = keeper[place]
        if other < 0 or (scores[row, place], -row) > (scores[other, place], -other):
            keeper[place] = row
            row = other
        if row >= 0:
            waiting.append(row)
    out = np.empty(n, np.int64)
    out[keeper] = np.arange(n)
    return out


def model_input(items: DataFrame, most: int = MOST_ITEMS) -> DataFrame:
    """document_id, page_number, item_ids, boxes of the first `most` items (by ord) of each page: whole thousandths of the page,
    whose size is that of all items and a tenth more."""
    page = W.partitionBy("document_id", "page_number")
    wide, high = (F.coalesce(F.nullif(F.max(f"bbox.{c}").over(page) * 1.1, F.lit(0.0)), F.lit(1.0)) for c in ("x1", "y1"))
    part = lambda c, size: F.floor(F.col(f"bbox.{c}") / F.col(size) * 1000).cast("int")
    first = items.withColumn("_n", F.row_number().over(page.orderBy("ord"))).withColumns({"_w": wide, "_h": high}).where(F.col("_n") <= most)
    box = F.array(part("x0", "_w"), part("y0", "_h"), part("x1", "_w"), part("y1", "_h"))
    rows = first.groupBy("document_id", "page_number").agg(F.sort_array(F.collect_list(F.struct("_n", "item_id", box.alias("b")))).alias("r"))
    return rows.select("document_id", "page_number", F.transform("r", lambda x: x.item_id).alias("item_ids"), F.transform("r", lambda x: x.b).alias("boxes"))


def model_reading_order(
    items: DataFrame, model: ports.OrderModel, most: int = MOST_ITEMS, keep: Callable[[DataFrame], DataFrame] = lambda df: df
) -> tuple[DataFrame, DataFrame]:
    """(items with reading_order from 1 within the page, issues (document_id, page_number, code, level)).

    The model scores the places of a page's first items (model_input(), and scores array<array<double>>, null where it fails);
    permutation() gives each its own. Items beyond follow in geometric order, and so do all of a page that it fails on, which
    is an issue. A page's matrix is at most `most` square and handled by itself. Both tables come of what the model says: keep writes it
    down and reads it back, so that it's asked once, and both see one answer.
    """
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            for i in range(b.num_rows):  # a page's matrix at a time: as Python floats it's several times its size
                doc, page, ids, scores = (b.column(k)[i].as_py() for k in range(4))
                n = len(ids)
                fine = scores is not None and len(scores) >= n and all(r is not None and len(r) >= n for r in scores[:n])
                at = permutation(np.array([r[:n] for r in scores[:n]], float).reshape(n, n)).tolist() if fine else [None] * n
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc] * n, pa.string()), pa.array([page] * n, pa.int32()), pa.array(ids, pa.string()), pa.array(at, pa.int32())],
                    names=["document_id", "page_number", "item_id", "_place"],
                )

    scored = model.logits(model_input(items, most)).select("document_id", F.col("page_number").cast("int").alias("page_number"), "item_ids", "scores")
    scored = keep(scored)
    placed = scored.mapInArrow(run, "document_id string, page_number int, item_id string, _place int")
    geometric = layout.reading_order(items).withColumnRenamed("reading_order", "_geo")
    both = geometric.join(placed, ["document_id", "page_number", "item_id"], "left")
    page = W.partitionBy("document_id", "page_number")
    ordered = both.withColumn("reading_order", F.row_number().over(page.orderBy(F.asc_nulls_last("_place"), "_geo")))
    failed = scored.where("scores is null").select("document_id", "page_number", F.lit("layout_reader_fallback").alias("code"), F.lit("warning").alias("level"))
    return ordered.select(*items.columns, "reading_order"), failed


def crops(assets: DataFrame, pages: DataFrame, cut: Column) -> DataFrame:
    """document_id, region_id, crop_path, image, issue of crop_assets() rows: cut, a column over image and box, is null where
    the page's image can't be opened: crop_open_failed. pages: (document_id, page_number, image)."""
    own = assets.join(pages.select("document_id", "page_number", "image"), ["document_id", "page_number"], "left")
    made = own.withColumn("_cut", F.when(F.col("issue").isNull(), cut))
    issue = F.coalesce("issue", F.when(F.col("_cut").isNull(), "crop_open_failed"))
    return made.select("document_id", "region_id", F.when(F.col("_cut").isNotNull(), F.col("crop_path")).alias("crop_path"), F.col("_cut").alias("image"), issue.alias("issue"))


def processing_summary(documents: DataFrame, **tables: DataFrame) -> DataFrame:
    """documents (document_id) with n_<name>: how many rows each of the tables (document_id) has of it; of issues also
    n_warnings and n_errors, by level."""
    out = documents
    for name, df in tables.items():
        counts = [F.count("*").alias(f"n_{name}")]
        if name == "issues":
            counts += [F.count(F.when(F.col("level") == kind, 1)).alias(f"n_{kind}s") for kind in ("warning", "error")]
        by = df.groupBy("document_id").agg(*counts)
        out = out.join(by, "document_id", "left").fillna(0, [c for c in by.columns if c != "document_id"])
    return out


def index_summary(index: DataFrame) -> DataFrame:
    """document_id, n_chunks of each document with a record."""
    return index.groupBy("document_id").agg(F.count("*").alias("n_chunks"))


def throughput(runs: DataFrame) -> DataFrame:
    """documents, pages, chunks, seconds, seconds_per_page, chunks_per_page over runs (pages, chunks, seconds), one row."""
    total = runs.agg(F.count("*").alias("documents"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("pages", "chunks", "seconds")])
    pages = F.greatest(F.col("pages"), F.lit(1))
    return total.withColumns({"seconds_per_page": F.col("seconds") / pages, "chunks_per_page": F.col("chunks") / pages})


def performance_report(runs: DataFrame, queries: DataFrame, latency: DataFrame, total: DataFrame) -> DataFrame:
    """(n, line): a report in Markdown: a row a document of runs (source_filename, pages, chunks, seconds), a row a question of
    queries (question, milliseconds, top_score, answer), latency statistics and totals; ordered by n within a part."""
    cell = lambda c, most: F.regexp_replace(F.regexp_replace(F.substring(F.coalesce(F.col(c), F.lit("")), 1, most), r"\|", r"\\\\|"), "\n", " ")
    number = lambda c, digits: F.coalesce(F.format_string(f"%.{digits}f", F.col(c).cast("double")), F.lit("-"))
    row = lambda *cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    part = lambda df, k, key, line: df.select(F.concat(F.lit(f"{k}:"), key).alias("n"), line.alias("line"))
    per = F.when(F.col("pages") > 0, F.format_string("%.1f", F.col("chunks") / F.col("pages"))).otherwise("N/A")
    parts = [
        part(runs, 1, F.col("source_filename"), row(cell("source_filename", 200), F.col("pages").cast("string"), F.col("chunks").cast("string"), number("seconds", 1), per)),
        part(queries, 2, F.col("question"), row(cell("question", 60), number("milliseconds", 0), number("top_score", 3), cell("answer", 90))),
        part(latency, 3, F.lit(""), row(*[number(c, 0) for c in ("mean", "median", "p95", "p99", "min", "max", "stdev")])),
        part(total, 4, F.lit(""), row(F.col("pages").cast("string"), F.col("documents").cast("string"), number("seconds", 0), number("seconds_per_page", 1), number("chunks_per_page", 1))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
