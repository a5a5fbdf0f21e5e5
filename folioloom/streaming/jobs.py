"""Structured Streaming: ingestion states, progress, deliveries, windows over events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Events from Parquet files as they arrive; ts as a timestamp that can have a watermark."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def uploads(spark: SparkSession, folder: str, pattern: str = "*.{pdf,PDF}") -> DataFrame:
    """document_id (sha256 of the content), source_filename, path, content of files as they arrive."""
    known = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.schema(known).format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select(F.sha2("content", 256).alias("document_id"), F.element_at(F.split("path", "/"), -1).alias("source_filename"), "path", "content")


def tumbling(events: DataFrame, width: str, late: str, *keys: str) -> DataFrame:
    """Counts and sums of value by window and keys. In append mode a window's row comes once it can no longer change; in
    update mode whenever it does."""
    found = events.withWatermark("ts", late).groupBy(F.window("ts", width), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return found.select(F.col("window.start").alias("start"), *keys, "n", "total")


def sliding(events: DataFrame, width: str, step: str, late: str, *keys: str) -> DataFrame:
    found = events.withWatermark("ts", late).groupBy(F.window("ts", width, step), *keys).agg(F.count("*").alias("n"))
    return found.select(F.col("window.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, gap: str, late: str, *keys: str) -> DataFrame:
    found = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), *keys).agg(F.count("*").alias("n"))
    return found.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def once(deliveries: DataFrame, key: str, late: str) -> DataFrame:
    """The first delivery of each key within the watermark's delay."""
    return deliveries.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def latest(events: DataFrame, key: str, *columns: str) -> DataFrame:
    """The state of each key, by ts and event_id, in update or complete mode."""
    return events.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct("ts", "event_id")).alias("s")).select(key, "s.*")


def progress(pages: DataFrame, key: str = "document_id") -> DataFrame:
    """key, pages_done, total_pages of page events (key, page_number, total_pages): repeats of a page count once."""
    import pandas as pd

    def step(k, batches, state):
        done, total = (set(state.get[0]), state.get[1]) if state.exists else (set(), 0)
        for b in batches:
            done |= {int(p) for p in b["page_number"]}
            total = max([total, *map(int, b["total_pages"])])
        state.update((sorted(done), total))
        yield pd.DataFrame({key: [k[0]], "pages_done": [len(done)], "total_pages": [total]})

    return pages.groupBy(key).applyInPandasWithState(step, f"{key} string, pages_done long, total_pages long", "done array<long>, total long", "update", "NoTimeout")


def drain(df: DataFrame, mode: str, folder: str, *keys: str) -> DataFrame:
    """What a stream has to give now, written under folder with its checkpoint; nothing comes to the driver. Append mode: all
    rows; update mode: the last row of each of keys; complete mode: the last batch."""
    spark, out = df.sparkSession, f"{folder}/rows"

    def write(batch: DataFrame, n: int) -> None:
        batch.withColumn("_batch", F.lit(n)).write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/{n:09d}")

    stream = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint")
    stream.trigger(availableNow=True).start().awaitTermination()
    try:
        found = spark.read.schema(StructType([*df.schema.fields, StructField("_batch", IntegerType())])).option("recursiveFileLookup", "true").parquet(out)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], df.schema)
    if mode == "update":
        values = [c for c in df.columns if c not in keys]
        found = found.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("_v")).select(*keys, "_v.*")
    return found.select(df.columns)


def rate_limited(hits: DataFrame, key: str, limit: int, seconds: int) -> DataFrame:
    """hits (key, ts, hit_id), as they arrive, with allowed: among those of the key in the last `seconds` up to each, refused
    ones too, it's within limit. State: a key's times within the window, dropped as they pass out of it."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    span = seconds * 1_000_000

    def step(k, batches, state):
        kept = list(state.get[0]) if state.exists else []
        if state.hasTimedOut:  # none of its times is within the window any more
            state.remove()
            return
        new = pd.concat(list(batches))
        new["_us"] = new["ts"].astype("datetime64[us]").astype("int64")
        new = new.sort_values(["_us", "hit_id"])
        allowed = []
        for at in new["_us"].tolist():
            kept = [t for t in kept if t > at - span] + [at]
            allowed.append(len(kept) <= limit)
        state.update((kept,))
        state.setTimeoutTimestamp(max(kept[-1] // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]] * len(new), "hit_id": new["hit_id"].tolist(), "allowed": allowed})

    kind = hits.schema[key].dataType.simpleString()
    rows = hits.select(key, "ts", F.col("hit_id").cast("long").alias("hit_id")).withWatermark("ts", f"{seconds} seconds")
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, hit_id long, allowed boolean", "times array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def append_log(messages: DataFrame, folder: str, now: bool = True):
    """Messages, each once, at the end of a Parquet log; restarts go on where the checkpoint is."""
    writer = messages.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/log").option("checkpointLocation", f"{folder}/checkpoint")
    return (writer.trigger(availableNow=True) if now else writer.trigger(processingTime="3 seconds")).start()


def each_batch(df: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, now: bool = True):
    """One micro-batch at a time through handle; restarts go on where the checkpoint is."""
    writer = df.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if now else writer.trigger(processingTime="3 seconds")).start()


STATES = "document_id string, status string, error string"


def ingest(
    handle_document: Callable[[DataFrame], DataFrame],
    done: Callable[[SparkSession], DataFrame],
    sink: Callable[[DataFrame], None],
    states: Callable[[DataFrame], None] | None = None,
) -> Callable[[DataFrame, int], None]:
    """A batch handler for uploads(): documents already done are passed over, so a repeated delivery changes nothing. states
    gets STATES rows as a batch goes on: preprocessing, indexing, then ready, or error and why; a batch that fails doesn't
    end the stream where states are kept. Where the handler itself fails, the batch is halved by a hash of the ids and its halves
    handled by themselves, down to single documents: those that fail alone end in error, all others in ready. So a sink that fails
    may be given a document again. attempts.Ingestion catches errors a row instead, and tries again later."""

    def handle(batch: DataFrame, _: int) -> None:
        fresh = batch.dropDuplicates(["document_id"]).join(done(batch.sparkSession).select("document_id"), "document_id", "left_anti")
        if states is None:
            sink(handle_document(fresh))
            return
        ids = fresh.select("document_id").persist()

        def attempt(part: DataFrame, names: DataFrame, depth: int) -> None:
            told = lambda status, error=None: states(names.select("document_id", F.lit(status).alias("status"), F.lit(error).cast("string").alias("error")))
            try:
                if depth == 0:
                    told("preprocessing")
                made = handle_document(part)
                if depth == 0:
                    told("indexing")
                sink(made)
                told("ready")
            except Exception as e:  # noqa: BLE001 - any failure is some document's state
                n = names.count()
                if n <= 1 or depth >= 40:
                    told("error", str(e)[:500])
                    return
                side = F.shiftright(F.xxhash64("document_id"), depth).bitwiseAND(1) == 0
                for half in (side, ~side):
                    own = names.where(half)
                    if own.take(1):
                        attempt(part.where(half), own, depth + 1)

        try:
            attempt(fresh, ids, 0)
        finally:
            ids.unpersist()

    return handle
