"""From recognised pages and detected boxes to chunks and an index, keyed by document throughout."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioloom.operators import chunking, layout, ports
from folioloom.sources.files import Settings


def kept_in(folder: str) -> Callable[[str, DataFrame], DataFrame]:
    """Writes each table below folder and reads it from there, so that what follows doesn't make it again."""

    def keep(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")

    return keep


def ingest(pages: DataFrame, boxes: DataFrame, settings: Settings | None = None, keep: Callable[[str, DataFrame], DataFrame] = lambda name, df: df) -> dict[str, DataFrame]:
    """The tables of a preprocessing run. pages: (document_id, page_number, rec_texts, rec_scores, rec_boxes, dt_polys,
    image_width, image_height, page_image_path); boxes: (document_id, page_number, pos, label, score, coordinate). keep: what is done with tables that several others are made of, such as kept_in()."""
    settings = settings or Settings()
    items = keep("items", layout.ocr_items(pages))
    regions = keep("detected", layout.detected_regions(boxes))
    matched = layout.reading_order(layout.best_regions(items, regions))
    blocks = layout.blocks(matched, keep=keep)
    texts = blocks.select(
        "document_id",
        F.explode("region_ids").alias("region_id"),
        "reading_order",
        "text",
        "page_number",
    ).groupBy("document_id", "page_number", "region_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("reading_order", "text"))), lambda b: b.text), " ").alias("text")).drop("page_number")
    titled = keep("titled", layout.assign_titles(regions.join(texts, ["document_id", "region_id"], "left").withColumn("y0", F.col("bbox.y0"))))
    crops = layout.crop_assets(regions, pages.select("document_id", "page_number", "image_width", "image_height", "page_image_path"))
    chunks = keep("packed", chunking.name_chunks(chunking.pack_blocks(blocks, settings.chunk_size, settings.overlap)))
    known = titled.join(crops.select("document_id", "region_id", "crop_path"), ["document_id", "region_id"], "left")
    chunks = keep("chunks", chunking.with_region_attributes(chunks, known))
    summaries = layout.visual_summaries(regions, blocks, chunks.withColumn("ord", F.col("chunk_no")))
    return {
        "ocr_items": matched, "regions": titled, "blocks": blocks, "page_texts": layout.page_texts(blocks), "cropped_assets": crops, "chunks": chunks,
        "sections": layout.sections(titled), "visual_summaries": summaries.withColumn("is_meaningful", F.lit(True)), "issues": layout.pages_without_text(pages, items),
    }


def index_rows(tables: dict[str, DataFrame], embedder: ports.Embedder | None = None) -> DataFrame:
    """Rows for the vector index: each chunk with the embedding of its text, or of its figure's summary."""
    chunks = tables["chunks"]
    texts = chunking.embedding_texts(chunks, tables["visual_summaries"])
    made = (embedder or ports.HashedEmbedder()).embed(texts, "embed_text", "embedding")
    missing = {c: F.lit(None).cast(kind) for c, kind in (("page_content", "string"), ("source_filename", "string"), ("metadata", "map<string,string>")) if c not in chunks.columns}
    records = chunking.index_records(chunks.withColumns(missing))
    return records.join(made.select("chunk_id", "embedding"), "chunk_id").select("chunk_id", "text", F.col("metadata")["document_id"].alias("document_id"), "metadata", "embedding")
