"""Chunks: ordered blocks packed to a target length with overlap, index records, embedding texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioloom.functions.text import blank, strip
from folioloom.operators import layout


def _cuts(lens: Column, target: int, overlap: int) -> Column:
    """Chunks of a page's blocks of lens, array<int>, as array<struct<at, n>>: n blocks from the place at on, from 0. A fold, in the
    JVM."""
    cut = "array<struct<at:int,n:int>>"
    state = lambda done, at, n, length: F.struct(done.alias("done"), at.cast("int").alias("at"), n.cast("int").alias("n"), length.cast("int").alias("len"))
    open_ = lambda s: F.concat(s.done, F.array(F.struct(s.at.alias("at"), s.n.alias("n"))))
    back = lambda k, n, length: F.struct(k.cast("int").alias("k"), n.cast("int").alias("n"), length.cast("int").alias("len"))

    def flushed(s: Column, x: Column) -> Column:
        """The chunk is done; the next opens with its last blocks, up to overlap."""
        reopened = lambda a: state(open_(s), s.at + s.n - a.k, a.k + 1, a.len + x + 2)
        none = back(F.lit(0), F.lit(0), F.lit(0))
        if overlap <= 0:
            return state(open_(s), s.at + s.n, F.lit(1), x + 2)
        step = lambda a, y: F.when(a.n >= overlap, a).otherwise(back(a.k + 1, a.n + y, a.len + y + 2))
        return F.aggregate(F.reverse(F.slice(lens, s.at + 1, s.n)), none, step, reopened)

    def add(s: Column, x: Column) -> Column:
        return F.when((s.n > 0) & (s.len + x > target), flushed(s, x)).otherwise(state(s.done, s.at, s.n + 1, s.len + x + 2))

    return F.aggregate(lens, state(F.array().cast(cut), F.lit(0), F.lit(0), F.lit(0)), add, lambda s: F.when(s.n > 0, open_(s)).otherwise(s.done))


def pack_blocks(made: DataFrame, target: int, overlap: int) -> DataFrame:
    """document_id, chunk_no, page_number, block_ids, item_ids, source_region_ids, bbox_references, text: blocks (document_id,
    page_number, reading_order, block_id, text, item_ids, region_ids, and bbox where they have one) of a page packed in order
    until their texts joined by blank lines would pass target. Region ids are sorted; the text is stripped. No block is split; a chunk opens with the last blocks of the one before whose lengths reach overlap.

    A fold over a page's blocks, in the JVM; pages are the unit of work. Blank blocks count toward the length but not the text.
    Lengths alone say how many chunks a page has, so chunks are numbered over the document without being dealt out by it.
    """
    text = F.coalesce("text", F.lit(""))
    strings = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    box = F.when(F.col("bbox").isNotNull(), F.array("bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1")) if "bbox" in made.columns else F.lit(None).cast("array<double>")
    place = (F.col("reading_order").cast("int").alias("pos"), F.col("block_id").alias("id"), F.length(text).alias("len"))
    block = F.struct(*place, text.alias("text"), strings("item_ids").alias("items"), strings("region_ids").alias("regions"), box.alias("box"))

    def pages(of: Column) -> DataFrame:
        one = made.groupBy("document_id", "page_number").agg(F.sort_array(F.collect_list(of)).alias("b"))
        return one.withColumn("_lens", F.transform("b", lambda x: x.len)).withColumn("_cuts", _cuts(F.col("_lens"), target, overlap))

    before = layout.rows_before(pages(F.struct(*place)).select("document_id", "page_number", F.size("_cuts").alias("n")))
    # a null page is the first of its document, with none before
    whole = pages(block).join(before, ["document_id", "page_number"], "left")
    cut = whole.select("document_id", "page_number", "b", F.coalesce("_before", F.lit(0)).alias("_before"), F.posexplode("_cuts").alias("pos", "cut"))
    numbered = cut.select("document_id", "page_number", (F.col("_before") + F.col("pos") + 1).cast("int").alias("chunk_no"), F.slice("b", F.col("cut.at") + 1, F.col("cut.n")).alias("c"))
    joined = strip(F.array_join(F.filter(F.col("c.text"), lambda t: F.length(strip(t)) > 0), "\n\n"))
    regions = F.sort_array(F.array_distinct(F.flatten("c.regions")))
    return numbered.select(
        "document_id",
        "chunk_no",
        "page_number",
        F.col("c.id").alias("block_ids"),
        F.flatten("c.items").alias("item_ids"),
        regions.alias("source_region_ids"),
        F.filter("c.box", lambda b: b.isNotNull()).alias("bbox_references"),
        joined.alias("text"),
    )


def name_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("chunk_id", F.concat_ws(":chunk:", "document_id", F.col("chunk_no").cast("string")))


def with_region_attributes(chunks: DataFrame, regions: DataFrame) -> DataFrame:
    """chunks (document_id, chunk_id, source_region_ids) with region_types, distinct and sorted, crop_references, crop_asset_ids
    and the title and subtitle of the first region that has a parent; unknown regions are ignored. regions: (document_id,
    region_id, region_type, crop_path, parent_title, parent_subtitle)."""
    ids = chunks.select("document_id", "chunk_id", F.posexplode("source_region_ids").alias("pos", "region_id"))
    known = ids.join(regions.select("document_id", "region_id", "region_type", "crop_path", "parent_title", "parent_subtitle"), ["document_id", "region_id"])
    parent = F.when(F.col("parent_title").isNotNull(), F.struct("parent_title", "parent_subtitle"))
    row = F.struct("pos", "crop_path", F.when(F.col("crop_path").isNotNull(), F.concat(F.lit("asset_"), "region_id")).alias("asset"))
    by = known.groupBy("document_id", "chunk_id").agg(
        F.sort_array(F.collect_set("region_type")).alias("region_types"),
        F.sort_array(F.collect_list(row)).alias("r"),
        F.min_by(parent, F.when(parent.isNotNull(), F.col("pos"))).alias("p"),
    )
    fine = lambda c: F.filter(F.col(f"r.{c}"), lambda x: x.isNotNull())
    got = chunks.join(by, ["document_id", "chunk_id"], "left")
    none = F.array().cast("array<string>")
    return got.select(
        chunks["*"],
        F.coalesce("region_types", none).alias("region_types"),
        F.coalesce(fine("crop_path"), none).alias("crop_references"),
        F.coalesce(fine("asset"), none).alias("crop_asset_ids"),
        F.col("p.parent_title").alias("parent_title"),
        F.col("p.parent_subtitle").alias("parent_subtitle"),
    )


#: Metadata of a chunk that are lists, and the columns that have them.
LISTS = {"ordered_block_ids": "block_ids", "item_ids": "item_ids", "source_region_ids": "source_region_ids", "region_types": "region_types"}


def index_records(chunks: DataFrame) -> DataFrame:
    """chunk_id, text, metadata of chunks (chunk_id, text, page_content, document_id, source_filename, page_number,
    metadata map<string,string>) that aren't blank: page_content or else text; the metadata's own values before the columns';
    null values dropped. LISTS among the columns of chunks are metadata too, as JSON."""
    text = F.coalesce(F.nullif("page_content", F.lit("")), F.col("text"))
    own = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    columns = {n: F.col(n).cast("string") for n in ("document_id", "source_filename", "page_number", "chunk_id")}
    columns |= {n: F.to_json(c) for n, c in LISTS.items() if c in chunks.columns}
    added = F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*columns.values()))
    rest = F.map_filter(added, lambda k, v: ~F.map_contains_key(own, k))
    whole = F.map_filter(F.map_concat(own, rest), lambda k, v: v.isNotNull())
    return chunks.where(~blank(text)).select("chunk_id", text.alias("text"), whole.alias("metadata"))


def summaries_of(summaries: DataFrame, order: str, hits: DataFrame | None = None) -> DataFrame:
    """The last summary (document_id, region_id, ...) by order of each region: for an index all of them, for the documents of
    hits (document_id) those that are meaningful, as one without the flag is."""
    values = [c for c in summaries.columns if c not in ("document_id", "region_id")]
    last = summaries.groupBy("document_id", "region_id").agg(F.max_by(F.struct(*values), order).alias("_v")).select("document_id", "region_id", "_v.*")
    if hits is None:
        return last
    return last.where(F.coalesce("is_meaningful", F.lit(True))).join(hits.select("document_id").distinct(), "document_id", "left_semi")


def embedding_texts(chunks: DataFrame, summaries: DataFrame, meaningful_only: bool = False) -> DataFrame:
    """chunk_id, embed_text: the summary of the first of the chunk's regions that is a figure with one, else the chunk's text.
    chunks: (document_id, chunk_id, text, source_region_ids); summaries: (document_id, region_id, region_type, summary_text,
    is_meaningful)."""
    use = summaries.where((F.col("region_type") == "figure") & (F.coalesce("summary_text", F.lit("")) != ""))
    if meaningful_only:
        use = use.where(F.coalesce("is_meaningful", F.lit(True)))
    ids = chunks.select("document_id", "chunk_id", F.posexplode("source_region_ids").alias("pos", "region_id"))
    first = ids.join(use.select("document_id", "region_id", "summary_text"), ["document_id", "region_id"]).groupBy("document_id", "chunk_id").agg(F.min_by("summary_text", "pos").alias("s"))
    return chunks.join(first, ["document_id", "chunk_id"], "left").select("chunk_id", F.coalesce("s", "text").alias("embed_text"))
