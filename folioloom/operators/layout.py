"""Page layout: OCR and detector payloads, reading order, regions, blocks, titles and sections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioloom.functions import geometry as G
from folioloom.functions.text import strip

#: Detector labels of text regions and of figures (fixed values).
TEXT_LABELS = (
    "text", "title", "doc_title", "figure_title", "paragraph_title", "header", "footer", "reference", "caption", "list", "number", "formula_caption",
    "table_caption", "figure_caption", "aside_text",
)
FIGURE_LABELS = ("image", "figure", "chart", "graph")
TITLE_LABELS = ("title", "doc_title", "paragraph_title")


def region_type(label: Column) -> Column:
    """table wherever the label holds that word, else text_block, figure or null."""
    low = strip(F.lower(label))
    return F.when(low.contains("table"), "table").when(low.isin(*TEXT_LABELS) | low.endswith("_text"), "text_block").when(low.isin(*FIGURE_LABELS), "figure")


def ocr_items(pages: DataFrame) -> DataFrame:
    """document_id, item_id, page_number, text, bbox, confidence, ord of the recognised texts of pages (document_id, page_number,
    rec_texts, rec_scores, rec_boxes, dt_polys): stripped, without empty texts and missing or empty boxes. Names keep the place
    in the payload, so they have gaps."""
    at = lambda c: F.try_element_at(F.col(c), F.col("pos") + 1)
    flat = pages.select("document_id", "page_number", "rec_scores", "rec_boxes", "dt_polys", F.posexplode("rec_texts").alias("pos", "raw"))
    made = flat.select(
        "document_id",
        F.format_string("p%d_ocr_%d", F.col("page_number"), F.col("pos")).alias("item_id"),
        "page_number",
        strip(F.col("raw")).alias("text"),
        F.coalesce(G.from_array(at("rec_boxes")), G.from_polygon(at("dt_polys"))).alias("bbox"),
        at("rec_scores").alias("confidence"),
        F.col("pos").cast("bigint").alias("ord"),
    )
    return made.where((F.length("text") > 0) & G.valid(F.col("bbox")))


def pages_without_text(pages: DataFrame, items: DataFrame) -> DataFrame:
    """document_id, page_number, code, level: an issue for each page that no item came from."""
    return pages.select("document_id", "page_number").join(items, ["document_id", "page_number"], "left_anti").withColumns({"code": F.lit("ocr_no_text"), "level": F.lit("warning")})


def dedupe_regions(regions: DataFrame) -> DataFrame:
    """Of regions (document_id, page_number, region_type, bbox, ord) that agree to one decimal the first."""
    r = lambda c: F.bround(F.col(f"bbox.{c}"), 1)
    w = W.partitionBy("document_id", "page_number", "region_type", r("x0"), r("y0"), r("x1"), r("y1")).orderBy("ord")
    return regions.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def detected_regions(boxes: DataFrame) -> DataFrame:
    """document_id, region_id, region_type, page_number, bbox, label, confidence, ord of a detector's boxes (document_id,
    page_number, pos, label, score, coordinate): known labels, true boxes, near-equal ones once; numbered over the document."""
    typed = boxes.withColumn("region_type", region_type(F.col("label"))).withColumn("bbox", G.from_array(F.col("coordinate"))).where(F.col("region_type").isNotNull() & G.valid(F.col("bbox")))
    numbered = typed.withColumn("ord", F.row_number().over(W.partitionBy("document_id").orderBy("page_number", "pos")).cast("bigint"))
    named = numbered.select(
        "document_id",
        F.format_string("region_%d", F.col("ord")).alias("region_id"),
        "region_type",
        "page_number",
        "bbox",
        strip(F.lower("label")).alias("label"),
        F.col("score").alias("confidence"),
        "ord",
    )
    return dedupe_regions(named)


def label_counts(boxes: DataFrame) -> DataFrame:
    """document_id, page_number, region_type, label, n of a detector's boxes: how many of each type, null for labels that are
    passed over; a missing label is unknown."""
    label = F.coalesce(F.nullif(strip(F.lower("label")), F.lit("")), F.lit("unknown"))
    typed = boxes.select("document_id", "page_number", region_type(label).alias("region_type"), label.alias("label"))
    return typed.groupBy("document_id", "page_number", "region_type", "label").agg(F.count("*").alias("n"))


def reading_order(items: DataFrame) -> DataFrame:
    """items (document_id, page_number, bbox, ord) with reading_order from 1 within the page: lines of 18 (half to even), then
    left, top, ord; of items that share these, the narrower, the lower, then by text where there is one."""
    rest = [F.col("bbox.x1"), F.col("bbox.y1"), *(F.col(c) for c in ("text",) if c in items.columns)]
    w = W.partitionBy("document_id", "page_number").orderBy(F.bround(F.col("bbox.y0") / 18), F.col("bbox.x0"), F.col("bbox.y0"), F.col("ord"), *rest)
    return items.withColumn("reading_order", F.row_number().over(w))


def best_regions(items: DataFrame, regions: DataFrame) -> DataFrame:
    """items with region_id, region_type, overlap_ratio of the region of the same page that holds most of the item, the first
    (by ord) of equals; null, null and 0 where none holds any. items need item_id unique within the document; rows that share one
    share the region. Items are dealt out by page, once, and stay there."""
    i = items.withColumn("_row", F.monotonically_increasing_id()).alias("i")
    r = regions.select(F.col("document_id").alias("_document"), F.col("page_number").alias("_page"), *(F.col(c).alias(f"_{c}") for c in ("bbox", "ord", "region_id", "region_type")))
    held = (F.col("i.document_id") == F.col("_document")) & (F.col("i.page_number") == F.col("_page")) & (G.overlap(F.col("i.bbox"), F.col("_bbox")) > 0)
    m = F.struct(
        G.overlap_ratio(F.col("i.bbox"), F.col("_bbox")).alias("ratio"),
        (-F.col("_ord")).alias("neg"),
        F.col("_region_id").alias("region_id"),
        F.col("_region_type").alias("region_type"),
    )
    # a merge at any size: its rows lie by page, as the windows over a page need them
    pairs = i.join(r.hint("merge"), held, "left").select("i.*", F.when(F.col("_document").isNotNull() & F.col("i.item_id").isNotNull(), m).alias("_m"))
    w = W.partitionBy("document_id", "page_number", "item_id").orderBy("_row")
    best = pairs.select("*", F.max("_m").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("_best"), F.lag("_row").over(w).eqNullSafe(F.col("_row")).alias("_again"))
    return best.where(~F.col("_again")).select(
        *items.columns,
        F.col("_best.region_id").alias("region_id"),
        F.col("_best.region_type").alias("region_type"),
        F.coalesce("_best.ratio", F.lit(0.0)).alias("overlap_ratio"),
    )


def rows_before(counts: DataFrame) -> DataFrame:
    """document_id, page_number, _before: how many rows the document's earlier pages have, of counts (document_id, page_number, n),
    a row a page. Numbers over a document come of it without its rows meeting in one task."""
    earlier = W.partitionBy("document_id").orderBy("page_number").rowsBetween(W.unboundedPreceding, -1)
    return counts.select("document_id", "page_number", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))


def blocks(items: DataFrame, by_region: bool = True, keep: Callable[[str, DataFrame], DataFrame] = lambda name, df: df) -> DataFrame:
    """document_id, block_id, page_number, text, item_ids, region_ids, bbox, reading_order: runs of items (document_id, item_id,
    page_number, reading_order, text, bbox, region_id) in reading order of one region and one line of 20; numbered over the
    document. Without by_region lines alone make a block. keep: what is done with the runs, which are counted before they are
    numbered, such as plans.ingest.kept_in(); else they are made twice."""
    w = W.partitionBy("document_id", "page_number").orderBy("reading_order")
    line = F.floor(F.col("bbox.y0") / 20)
    new = F.lag(F.lit(1)).over(w).isNull() | (line != F.lag(line).over(w))
    if by_region:
        new = new | ~F.col("region_id").eqNullSafe(F.lag("region_id").over(w))
    run = items.withColumn("_run", F.sum(new.cast("int")).over(w))
    item = F.struct("reading_order", "item_id", F.coalesce(strip(F.col("text")), F.lit("")).alias("text"), "region_id")
    made = run.groupBy("document_id", "page_number", "_run").agg(F.sort_array(F.collect_list(item)).alias("i"), G.merged(F.col("bbox")).alias("bbox"))
    kept = keep(
        "runs",
        made.select(
            "document_id",
            "page_number",
            "_run",
            F.array_join(F.filter(F.col("i.text"), lambda t: t != ""), " ").alias("text"),
            F.col("i.item_id").alias("item_ids"),
            F.sort_array(F.array_distinct(F.filter(F.col("i.region_id"), lambda x: x.isNotNull()))).alias("region_ids"),
            "bbox",
        ),
    )
    before = rows_before(kept.groupBy("document_id", "page_number").agg(F.count("*").alias("n")))
    # a null page is the first of its document, with none before
    numbered = kept.join(before, ["document_id", "page_number"], "left").withColumn("reading_order", (F.coalesce("_before", F.lit(0)) + F.col("_run")).cast("int"))
    return numbered.select(
        "document_id",
        F.format_string("p%d_block_%d", F.col("page_number"), F.col("reading_order")).alias("block_id"),
        "page_number",
        "text",
        "item_ids",
        "region_ids",
        "bbox",
        "reading_order",
    )


def page_texts(made: DataFrame) -> DataFrame:
    """document_id, page_number, text: texts of blocks that aren't blank, a line each."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("reading_order", "text"))), lambda b: b.text), "\n")
    return made.where(F.length(strip(F.col("text"))) > 0).groupBy("document_id", "page_number").agg(text.alias("text"))


def document_texts(pages: DataFrame) -> DataFrame:
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_number", "text"))), lambda p: p.text), "\n\n")
    return pages.groupBy("document_id").agg(strip(text).alias("full_ordered_text"))


def with_links(regions: DataFrame, made: DataFrame, most: int = 3, also: tuple[str, ...] = ()) -> DataFrame:
    """The tables and figures among regions with links, an array of (block_id, also): the blocks of the page that overlap the
    region, in reading order; where none does the `most` nearest above or below; null where the page has no blocks.

    A page's blocks are met as one array, so that pairs of regions and blocks are neither shuffled nor sorted."""
    block = F.struct("reading_order", "block_id", "bbox", *also)
    b = made.where("bbox is not null").groupBy("document_id", "page_number").agg(F.sort_array(F.collect_list(block)).alias("_b"))
    r = regions.where(F.col("region_type").isin("table", "figure"))
    pairs = r.join(b, ["document_id", "page_number"], "left").select(*(r[c] for c in r.columns), "_b")
    box = F.col("bbox")
    gap = lambda x: F.least(F.abs(x.bbox.y0 - box.y1), F.abs(x.bbox.y1 - box.y0))
    link = lambda x: F.struct(x.block_id.alias("block_id"), *(x[c].alias(c) for c in also))
    nearest = F.slice(F.sort_array(F.transform("_b", lambda x: F.struct(gap(x).alias("gap"), x.reading_order.alias("at"), link(x).alias("link")))), 1, most)
    over = pairs.withColumn("_on", F.filter("_b", lambda x: G.overlap(x.bbox, box) > 0))
    return over.withColumn("links", F.when(F.size("_on") > 0, F.transform("_on", link)).otherwise(F.transform(nearest, lambda x: x.link))).drop("_b", "_on")


def linked_blocks(regions: DataFrame, made: DataFrame, most: int = 3) -> DataFrame:
    """document_id, region_id, block_id, pos: for each table or figure the blocks of its page that overlap it, in reading
    order; where none does the `most` nearest above or below."""
    flat = with_links(regions, made, most).select("document_id", "region_id", F.posexplode("links").alias("pos", "link"))
    return flat.select("document_id", "region_id", "link.block_id", (F.col("pos") + 1).alias("pos"))


def visual_summaries(regions: DataFrame, made: DataFrame, chunks: DataFrame, cap: int = 1200) -> DataFrame:
    """document_id, region_id, region_type, page_number, linked_block_ids, linked_chunk_ids, summary_text of tables and figures:
    the text of linked blocks, else of chunks (chunk_id, ord, text, source_region_ids) that name the region, else a sentence."""
    joined = lambda a: strip(F.array_join(F.filter(F.transform(a, lambda x: x.text), lambda t: F.length(strip(t)) > 0), " "))
    own = with_links(regions, made.withColumn("text", F.coalesce("text", F.lit(""))), also=("text",)).select("document_id", "region_id", "region_type", "page_number", F.col("links").alias("bl"))
    named = chunks.select("document_id", "chunk_id", "ord", "text", F.explode("source_region_ids").alias("region_id"))
    by_chunk = named.groupBy("document_id", "region_id").agg(F.sort_array(F.collect_list(F.struct("ord", "chunk_id", F.coalesce("text", F.lit("")).alias("text")))).alias("cl"))
    all_ = own.join(by_chunk, ["document_id", "region_id"], "left")
    text = F.coalesce(
        F.nullif(joined(F.col("bl")), F.lit("")),
        F.nullif(joined(F.col("cl")), F.lit("")),
        F.format_string("Detected %s region on page %d.", F.col("region_type"), F.col("page_number")),
    )
    none = F.array().cast("array<string>")
    return all_.select(
        "document_id",
        "region_id",
        "region_type",
        "page_number",
        F.coalesce(F.col("bl.block_id"), none).alias("linked_block_ids"),
        F.coalesce(F.col("cl.chunk_id"), none).alias("linked_chunk_ids"),
        F.substring(text, 1, cap).alias("summary_text"),
    )


def assign_titles(regions: DataFrame) -> DataFrame:
    """regions (document_id, region_id, page_number, y0, ord, label, text) with parent_title and parent_subtitle: those of the
    last title and, since then, subtitle above; "untitled" before the first. A title without text is section_ and its region_id;
    titles and subtitles of over 200 characters are cut. An empty subtitle clears the one before. Titles and subtitles
    themselves have no parents."""
    w = W.partitionBy("document_id").orderBy("page_number", "y0", "ord")
    title, sub = F.col("label").isin(*TITLE_LABELS), F.col("label") == "subtitle"
    run = regions.withColumn("_run", F.sum(F.when(title, 1).otherwise(0)).over(w))
    head = F.coalesce(F.nullif(F.substring(F.coalesce("text", F.lit("")), 1, 200), F.lit("")), F.concat(F.lit("section_"), "region_id"))
    within = W.partitionBy("document_id", "_run").orderBy("page_number", "y0", "ord")
    filled = run.withColumn("_title", F.first(F.when(title, head), ignorenulls=True).over(within)).withColumn(
        "_sub",
        F.last(F.when(sub, F.struct(F.nullif(F.substring(F.coalesce("text", F.lit("")), 1, 200), F.lit("")).alias("t"))), ignorenulls=True).over(within),
    )
    other = ~title & ~sub
    return filled.withColumn("parent_title", F.when(other, F.coalesce("_title", F.lit("untitled")))).withColumn("parent_subtitle", F.when(other, F.col("_sub.t"))).drop("_run", "_title", "_sub")


def sections(titled: DataFrame, cap: int = 2000) -> DataFrame:
    """document_id, title, subtitle, text_blocks, tables, charts, figures, page_start, flat_text of regions as assign_titles
    gives them, with region_type: one section a title, wherever its parts stand; the first subtitle. Figures labelled chart or
    graph are charts. flat_text: the title and its texts, a line each."""
    body = titled.where("parent_title is not null")
    place = F.struct("page_number", "y0", "ord")
    is_ = lambda c: F.count(F.when(c, 1))
    chart = F.col("label").isin("chart", "graph")
    texts = F.transform(
        F.sort_array(F.collect_list(F.when((F.col("region_type") == "text_block") & (F.coalesce("text", F.lit("")) != ""), F.struct(place.alias("p"), "text")))),
        lambda x: x.text,
    )
    made = body.groupBy("document_id", F.col("parent_title").alias("title")).agg(
        F.min_by(F.struct(F.col("parent_subtitle").alias("s")), place).alias("_s"), is_(F.col("region_type") == "text_block").alias("text_blocks"), is_(F.col("region_type") == "table").alias("tables"),
        is_((F.col("region_type") == "figure") & chart).alias("charts"), is_((F.col("region_type") == "figure") & ~chart).alias("figures"), F.min("page_number").alias("page_start"), texts.alias("_t"),
    )
    return made.select(
        "document_id",
        "title",
        F.col("_s.s").alias("subtitle"),
        "text_blocks",
        "tables",
        "charts",
        "figures",
        "page_start",
        F.substring(F.array_join(F.concat(F.array("title"), "_t"), "\n"), 1, cap).alias("flat_text"),
    )


def chunk_strategy(made: DataFrame, well_structured: DataFrame, chunk_size: int = 1800, overlap: int = 200) -> DataFrame:
    """document_id, strategy, chunk_size, overlap, keep_tables_intact from sections and (document_id, well_structured): tables
    in more than half of the sections: layout_aware; else a loose document of under three: recursive_large, 2000 at least."""
    total = made.groupBy("document_id").agg(F.count("*").alias("n"), F.sum("tables").alias("t"))
    both = total.join(well_structured, "document_id", "left")
    tabular = F.col("t") > F.col("n") / 2
    loose = ~F.coalesce("well_structured", F.lit(True)) & (F.col("n") < 3)
    return both.select(
        "document_id",
        F.when(tabular, "layout_aware").when(loose, "recursive_large").otherwise("recursive").alias("strategy"),
        F.when(~tabular & loose, F.greatest(F.lit(2000), F.lit(chunk_size))).otherwise(chunk_size).alias("chunk_size"),
        F.lit(overlap).alias("overlap"),
        tabular.alias("keep_tables_intact"),
    )


def crop_assets(regions: DataFrame, pages: DataFrame) -> DataFrame:
    """document_id, region_id, asset_id, page_number, region_type, crop_path, box, issue of tables and figures; pages:
    (document_id, page_number, image_width, image_height, page_image_path)."""
    own = regions.where(F.col("region_type").isin("table", "figure")).join(pages, ["document_id", "page_number"], "left")
    box = G.crop_box(F.col("bbox"), F.col("region_type"), F.col("image_width"), F.col("image_height"))
    issue = F.when(F.col("page_image_path").isNull(), "missing_page_image").when(F.col("box").isNull(), "invalid_crop_bounds")
    ok = F.col("issue").isNull()
    return own.withColumn("box", box).withColumn("issue", issue).select(
        "document_id",
        "region_id",
        F.when(ok, F.concat(F.lit("asset_"), "region_id")).alias("asset_id"),
        "page_number",
        "region_type",
        F.when(ok, F.concat(F.lit("crops/"), "region_type", F.lit("s/"), "region_id", F.lit(".png"))).alias("crop_path"),
        "box",
        "issue",
    )


def confidence_summary(items: DataFrame) -> DataFrame:
    """document_id, n, mean of confidences, four decimals."""
    return items.groupBy("document_id").agg(F.count("confidence").alias("n"), F.bround(F.avg("confidence"), 4).alias("mean"))
