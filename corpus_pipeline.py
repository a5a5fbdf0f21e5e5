"""Corpus pipeline: toxic and poor documents go, one of each group of near copies stays, personal data is redacted, and what is
left is packed into training sequences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.llm import nearcopies, packing, pii, quality, toxicity
from folioloom.llm.cluster import remove, stored_at, table, unused

#: SQL can't express trained classifiers, min-hash bands or tokenizers; tests hold the stages against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs that the classifier chain, fitted on their labels, doesn't find toxic."""
    chain = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    prefix, flag = (unused(docs.columns, name) for name in ("chain_", "toxic"))
    return toxicity.classify(docs, chain, prefix, flag).where(~F.col(flag)).select(docs.columns)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs whose perplexity lies within their language's bounds."""
    score, keep = (unused(docs.columns, name) for name in ("log_perplexity", "keep"))
    return quality.classify(docs, table(spark, sf_dir, "labels"), score=score, keep=keep).where(F.col(keep)).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group of near copies, texts whose sets of 5-word shingles have a Jaccard
    similarity of 0.8 or more: a component's own. SimHash fingerprints, and min-hash keys for what these don't reach, find the
    pairs; whole sets decide. Of rows that repeat a doc_id with the same text, and of rows without one, all
    stay that their group's smallest id, or none, has; a row goes for its own text only, not for another of its doc_id."""
    own = unused(docs.columns, "text_hash")
    gone = nearcopies.near_copies(docs).where("doc_id <> component_id").select("doc_id", F.col("text_hash").alias(own)).distinct()
    return docs.withColumn(own, nearcopies.text_hash("text")).join(gone, ["doc_id", own], "left_anti").select(docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with personal data replaced by its kind; n_chars, where docs has it, is the new length."""
    spans = pii.detect(docs, keep=True)
    text = F.when(F.col("text").isNull(), None).otherwise(pii.redacted(F.col("text"), F.col("_spans")))
    out = spans.withColumn("_redacted", text)
    cols = [F.col("_redacted").alias("text") if c == "text" else F.length("_redacted").cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return out.select(cols)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens, with their ids."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_copies", drop_near_copies),
    ("pii", redact),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is a Parquet table in the shared folder that the next one reads."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        folder, docs = stored_at(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            remove(spark, before)  # nothing reads it any more
        before = folder
    return docs
