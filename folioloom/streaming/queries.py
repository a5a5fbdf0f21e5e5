"""Streams over the events table, drained, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioloom.sources.shared import new_folder
from folioloom.streaming import jobs, timers

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def _events(spark, d: str) -> DataFrame:
    path = f"{d}/events.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    # a stream's source is a folder or a glob
    return reader.parquet(f"{d}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def _drained(df: DataFrame, mode: str, *keys: str) -> DataFrame:
    """In the shared folder that the cluster names: a stream's state is read by other executors after a loss."""
    return jobs.drain(df, mode, new_folder(df.sparkSession, "stream"), *keys)


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_daily_windows(spark, d):
    got = _drained(jobs.tumbling(_events(spark, d), "1 day", "1 day", "event_type"), "update", "start", "event_type")
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT s AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 1 DAY, ts), time_bucket(INTERVAL 1 DAY, ts) - INTERVAL 1 DAY]) AS s FROM events) GROUP BY s")
def stream_sliding_windows(spark, d):
    got = _drained(jobs.sliding(_events(spark, d), "2 days", "1 day", "1 day"), "update", "start")
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 1 DAY OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 1 DAY AS \"end\", count(*) AS n FROM s GROUP BY user_id, k")
def stream_sessions(spark, d):
    got = _drained(jobs.sessions(_events(spark, d), "1 day", "1 day", "user_id"), "complete")
    return got.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("SELECT user_id, s.e AS event_type, s.v AS value FROM (SELECT user_id, arg_max(struct_pack(e := event_type, v := value), struct_pack(t := ts, i := event_id)) AS s FROM events GROUP BY user_id)")
def stream_latest_state(spark, d):
    return _drained(jobs.latest(_events(spark, d), "user_id", "event_type", "value"), "update", "user_id")


@query("SELECT DISTINCT user_id FROM events")
def stream_once(spark, d):
    return _drained(jobs.once(_events(spark, d), "user_id", "400 days").select("user_id"), "append")


@query("""WITH e AS (SELECT *, epoch_us(ts) AS us FROM events), n AS (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 432000000000 - 1 PRECEDING AND CURRENT ROW) - (row_number() OVER (PARTITION BY user_id, us ORDER BY event_id DESC) - 1) AS n FROM e)
  SELECT event_id AS hit_id, user_id, n <= 3 AS allowed FROM n""")
def stream_rate_limit(spark, d):
    hits = _events(spark, d).select("user_id", "ts", F.col("event_id").alias("hit_id"))
    return _drained(jobs.rate_limited(hits, "user_id", 3, 5 * 86_400), "append")


def _arrivals(spark, d: str, parts: int = 4) -> str:
    """A folder of events in the order they arrive, some up to a fortnight after their time, in several files."""
    folder, rows = new_folder(spark, "arrivals"), spark.read.parquet(f"{d}/events.parquet")
    at = F.unix_seconds(F.col("ts").cast("timestamp")) + F.pmod(F.xxhash64("event_id"), F.lit(14)) * 86_400
    low, high = rows.agg(F.min(at), F.max(at)).first()
    part = F.floor((at - (low or 0)) * parts / ((high or 0) - (low or 0) + 1))
    for i in range(parts):  # a file a batch, the older first
        rows.where(part == i).coalesce(1).write.mode("append").parquet(folder)
    return folder


@query("""WITH e AS (SELECT *, epoch_us(ts) AS us FROM events), n AS (SELECT event_id, user_id, ts, count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 432000000000 - 1 PRECEDING AND CURRENT ROW) - (row_number() OVER (PARTITION BY user_id, us ORDER BY event_id DESC) - 1) AS n FROM e)
  SELECT event_id AS hit_id, user_id, n <= 3 AS allowed FROM n WHERE epoch_ms(ts) <= (SELECT max(epoch_ms(ts)) FROM events) - 15 * 86400000""")
def stream_rate_limit_late(spark, d):
    """Hits that come in several batches, up to a fortnight late: decided in order once the watermark has passed them."""
    folder = _arrivals(spark, d)
    schema = spark.read.parquet(folder).schema
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    hits = events.select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("hit_id"))
    return _drained(timers.rate_limited(hits, "user_id", 3, 5 * 86_400, "15 days"), "append")


@query("SELECT event_id, user_id, event_type FROM events")
def stream_append_log(spark, d):
    """Events appended to a log, in two runs of which the second finds only what came after the first."""
    folder = new_folder(spark, "log")
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "event_type")
    for n in (0, 1):
        rows.where(F.col("event_id") % 2 == n).write.mode("append").parquet(f"{folder}/in")
        jobs.append_log(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), folder).awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/log")


@query("SELECT 'd' || (page_id % 50) AS document_id, count(DISTINCT page_id) AS pages_done, CAST(max(page_id % 50 + 10) AS BIGINT) AS total_pages FROM pages GROUP BY page_id % 50")
def stream_progress_pages(spark, d):
    """A state entry a page; every page event comes twice."""
    schema = spark.read.parquet(f"{d}/pages.parquet").schema
    pages = spark.readStream.schema(schema).parquet(f"{d}/pages.parque[t]")
    i = F.col("page_id")
    rows = pages.select(F.concat(F.lit("d"), (i % 50).cast("string")).alias("document_id"), F.explode(F.array(i.cast("int"), i.cast("int"))).alias("page_number"), (i % 50 + 10).cast("int").alias("total_pages"))
    return _drained(timers.progress(rows), "update", "document_id")


@query("SELECT 'd' || (page_id % 50) AS document_id, count(DISTINCT page_id) AS pages_done, CAST(max(page_id % 50 + 10) AS BIGINT) AS total_pages FROM pages GROUP BY page_id % 50")
def stream_progress(spark, d):
    schema = spark.read.parquet(f"{d}/pages.parquet").schema
    pages = spark.readStream.schema(schema).parquet(f"{d}/pages.parque[t]")
    rows = pages.select(
        F.concat(F.lit("d"), (F.col("page_id") % 50).cast("string")).alias("document_id"),
        F.col("page_id").cast("int").alias("page_number"),
        (F.col("page_id") % 50 + 10).cast("int").alias("total_pages"),
    )
    return _drained(jobs.progress(rows), "update", "document_id")
