"""Sources and sinks over the tables of a folder: written to the shared folder, read back, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioloom.operators import chunking, evaluation, layout, pages, rollups, store
from folioloom.plans import ask, ingest
from folioloom.plans import model_queries as made
from folioloom.plans import queries as base
from folioloom.plans.queries import _t, query
from folioloom.sources import bundles, files, versions
from folioloom.sources.shared import new_folder
from folioloom.streaming import attempts, jobs


def _index_rows(docs, text):
    own = F.create_map(F.lit("lang"), F.col("lang"))
    name = F.concat(F.col("lang"), (F.col("doc_id") % 50).cast("string"))
    return docs.select(
        F.col("doc_id").cast("string").alias("chunk_id"),
        text.alias("text"),
        name.alias("document_id"),
        own.alias("metadata"),
        F.array(F.lit(1.0).cast("float")).alias("embedding"),
    )


@query("""WITH d AS (SELECT *, lang || (doc_id % 50) AS document_id FROM documents), again AS (SELECT DISTINCT document_id FROM d WHERE doc_id % 100 = 7)
  SELECT doc_id, document_id, "text", lang AS own FROM d WHERE document_id NOT IN (FROM again) UNION ALL SELECT doc_id, document_id, 'new', lang FROM d WHERE doc_id % 100 = 7""")
def index_sink(spark, d):
    """All documents indexed, then some again with fewer chunks: what was there of them goes, all else stays."""
    docs, path = _t(spark, d, "documents"), new_folder(spark, "index")
    files.write_index(_index_rows(docs, F.col("text")), path)
    files.write_index(_index_rows(docs.where("doc_id % 100 = 7"), F.lit("new")), path)
    return files.index(spark, path).select(F.col("chunk_id").cast("long").alias("doc_id"), "document_id", "text", F.col("metadata")["lang"].alias("own"))


@query("""WITH d AS (SELECT o_orderkey, o_custkey, o_totalprice, 'o' || (o_custkey % 97) AS document_id FROM orders),
  c AS (SELECT * FROM d WHERE document_id NOT IN ('o3', 'o5') UNION ALL SELECT -o_orderkey, o_custkey, 0.0, document_id FROM d WHERE document_id = 'o3' AND o_orderkey % 2 = 0)
  SELECT 'first' AS version, document_id, count(*) AS n, sum(o_orderkey)::BIGINT AS keys, round(sum(o_totalprice), 2) AS total FROM d GROUP BY ALL
  UNION ALL SELECT 'last', document_id, count(*), sum(o_orderkey)::BIGINT, round(sum(o_totalprice), 2) FROM c GROUP BY ALL""")
def table_versions(spark, d):
    """Orders as a table in versions: a document replaced, one removed; the first version reads as it was."""
    rows = _t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.concat(F.lit("o"), (F.col("o_custkey") % 97).cast("string")).alias("document_id"))
    held = versions.Table(spark, new_folder(spark, "versions"), bucket_rows=2_000)
    first = held.write(rows).number
    held.replace(rows.where("document_id = 'o3' and o_orderkey % 2 = 0").select((-F.col("o_orderkey")).alias("o_orderkey"), "o_custkey", F.lit(0.0).alias("o_totalprice"), "document_id"))
    held.remove(rows.where("document_id = 'o5'").select("document_id"))
    each = lambda df, name: df.groupBy(F.lit(name).alias("version"), "document_id").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return each(held.read(first), "first").unionByName(each(held.read(), "last"))


@query("""WITH d AS (SELECT doc_id, 'd' || (doc_id // 10) AS document_id, doc_id % 97 = 5 AS odd, source FROM documents)
  SELECT document_id, CASE WHEN NOT odd THEN doc_id END AS chunk_id, CASE WHEN NOT odd THEN source END AS title, CASE WHEN odd THEN '"five" is no bigint' END AS error FROM d""")
def bundle_scan(spark, d):
    """Documents written as artifact folders, some under structured/, and read from there; rows that don't fit say why."""
    root, i = new_folder(spark, "bundles"), F.col("doc_id")
    name = F.concat(F.lit("d"), F.expr("doc_id div 10").cast("string"))
    fits = F.to_json(F.struct(i.alias("chunk_id"), F.col("source").alias("title")))
    rows = _t(spark, d, "documents").select(name.alias("document_id"), F.when(i % 97 == 5, '{"chunk_id": "five"}').otherwise(fits).alias("json"), (F.expr("doc_id div 10") % 3 == 0).alias("deep"))
    for deep in (True, False):
        bundles.write(rows.where(rows.deep == deep), root, "chunks", deep)
    bundles.register(spark)
    read = spark.read.format("bundles").option("path", root).option("artifact", "chunks").schema("document_id string, chunk_id long, title string, error string").load()
    return read.withColumn("error", F.regexp_replace("error", "^[^:]*: ", ""))


@query("SELECT document_id, n_chunks FROM (SELECT lang || (doc_id % 50) AS document_id, count(*) AS n_chunks FROM documents WHERE doc_id % 3 = 0 GROUP BY ALL)")
def index_rebuild(spark, d):
    """The index of all documents, then of a third alone; its chunks a document."""
    docs, path = _t(spark, d, "documents"), new_folder(spark, "index")
    files.write_index(_index_rows(docs, F.col("text")), path)
    files.rebuild_index(_index_rows(docs.where("doc_id % 3 = 0"), F.col("text")), path)
    return pages.index_summary(files.index(spark, path))


@query(f"WITH {base._REGIONS} SELECT document_id, region_id, CASE WHEN document_id IN ('d1', 'd2') THEN 'again' ELSE region_type END AS region_type FROM regions")
def artifacts_sink(spark, d):
    """Regions exported by document, two documents once more."""
    regions, folder = base._regions(spark, d).select("document_id", "region_id", "region_type"), new_folder(spark, "artifacts")
    files.export({"layout": regions}, folder)
    files.export({"layout": regions.where("document_id in ('d1', 'd2')").withColumn("region_type", F.lit("again"))}, folder)
    return files.exported(spark, folder, "layout")


@query('SELECT "text" AS question, CASE WHEN item_id % 2 = 0 THEN \'t\' || item_id END AS ground_truth, CAST(item_id AS VARCHAR) AS chunk_id, CAST(item_id % 9 AS INTEGER) AS source_page FROM benchmark WHERE item_id % 5 <> 0')
def question_set(spark, d):
    """A labelled question a line, written and read; rows without a question are passed over."""
    i, path = F.col("item_id"), new_folder(spark, "questions")
    rows = _t(spark, d, "benchmark").select(
        F.when(i % 5 != 0, F.col("text")).alias("question"),
        F.when(i % 2 == 0, F.concat(F.lit("t"), i.cast("string"))).alias("ground_truth"),
        F.array(i.cast("string")).alias("relevant_chunk_ids"),
        (i % 9).cast("int").alias("source_page"),
    )
    files.write_questions(rows, path)
    return files.questions(spark, path).select("question", "ground_truth", F.element_at("relevant_chunk_ids", 1).alias("chunk_id"), "source_page")


@query("""SELECT CAST(sha256(n_name || chr(10)) AS VARCHAR) AS document_id FROM nation""")
def document_scan(spark, d):
    """Files of a folder by the hash of their content."""
    path = new_folder(spark, "scan")
    _t(spark, d, "nation").select("n_name").repartition(25).write.text(path)
    return files.documents(spark, path, (".TXT",)).select("document_id")


@query("""SELECT CAST(sha256(n_name || chr(10)) AS VARCHAR) AS document_id, 'ready' AS status, 3 AS n_states FROM nation""")
def upload_states(spark, d):
    """Uploads go through preprocessing and indexing to ready; delivered again they change nothing."""
    folder = new_folder(spark, "uploads")
    _t(spark, d, "nation").select("n_name").repartition(25).write.text(f"{folder}/in")
    done, told = f"{folder}/done", f"{folder}/states"
    read = lambda s: s.read.schema("document_id string").parquet(done) if _there(s, done) else s.createDataFrame([], "document_id string")
    states = lambda df: df.withColumn("at", F.current_timestamp()).write.mode("append").parquet(told)
    handler = jobs.ingest(lambda b: b.select("document_id"), read, lambda out: out.write.mode("append").parquet(done), states)
    for n in (1, 2):
        jobs.each_batch(jobs.uploads(spark, f"{folder}/in", "*.txt"), handler, f"{folder}/checkpoint{n}").awaitTermination()
    rows = spark.read.schema(f"{jobs.STATES}, at timestamp").parquet(told)
    last = store.latest_state(rows, "document_id", "at", "status", tie="status")
    return last.join(rows.groupBy("document_id").agg(F.count("*").cast("int").alias("n_states")), "document_id")


@query("""WITH f AS (SELECT n_name, CAST(sha256(n_name || chr(10)) AS VARCHAR) AS document_id FROM nation)
  SELECT run, document_id, CASE WHEN n_name NOT IN ('CANADA', 'PERU') OR (n_name = 'CANADA' AND run = 3) THEN 'ready' WHEN n_name = 'PERU' AND run = 3 THEN 'given_up' ELSE 'error' END AS status,
    CASE WHEN n_name IN ('CANADA', 'PERU') THEN run ELSE 1 END AS attempts, CASE WHEN n_name = 'PERU' OR (n_name = 'CANADA' AND run < 3) THEN 'ValueError: ' || n_name END AS error
  FROM f CROSS JOIN (SELECT unnest([1, 2, 3])::INTEGER AS run)""")
def upload_attempts(spark, d):
    """Of the files of all nations one is bad for ever and one in two runs of three: all others are ready at once; the first is given up,
    the second ready in the end."""
    from datetime import datetime, timedelta, timezone

    folder = new_folder(spark, "attempts")
    _t(spark, d, "nation").select("n_name").repartition(25).write.text(f"{folder}/in")
    out = None
    for run in (1, 2, 3):

        def each(r: dict, run: int = run) -> list[dict]:
            name = r["content"].decode().strip()
            if name == "PERU" or (name == "CANADA" and run < 3):
                raise ValueError(name)
            return [{"text": name, "n": len(name)}]

        clock = datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(days=run)  # noqa: UP017
        handler = attempts.Ingestion(spark, f"{folder}/states", each, "text string, n int", lambda df: versions.Table(spark, f"{folder}/texts").replace(df), f"{folder}/staging", now=lambda clock=clock: clock)
        jobs.each_batch(jobs.uploads(spark, f"{folder}/in", "*.txt"), handler, f"{folder}/checkpoint-{run}").awaitTermination()
        rows = handler.rows().select(F.lit(run).alias("run"), "document_id", "status", "attempts", "error")
        out = rows if out is None else out.unionByName(rows)
    return out


def _there(spark, path: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        spark.read.schema("document_id string").parquet(path)
    except AnalysisException:
        return False
    return True


@query("""WITH s AS (SELECT doc_id, lang AS document_id, 'r' || (doc_id % 40) AS region_id, CASE WHEN doc_id % 3 = 0 THEN 's' || doc_id END AS summary_text, CASE WHEN doc_id % 5 < 4 THEN doc_id % 5 > 0 END AS is_meaningful FROM documents)
  SELECT document_id, region_id, summary_text FROM (SELECT *, row_number() OVER (PARTITION BY document_id, region_id ORDER BY doc_id DESC) AS n FROM s) WHERE n = 1 AND coalesce(is_meaningful, true) AND document_id IN ('de', 'fr')""")
def summaries_for_hits(spark, d):
    """The last summary of each region, of the documents that were found, logos left out."""
    i = F.col("doc_id")
    rows = _t(spark, d, "documents").select(
        i,
        F.col("lang").alias("document_id"),
        F.concat(F.lit("r"), (i % 40).cast("string")).alias("region_id"),
        F.when(i % 3 == 0, F.concat(F.lit("s"), i.cast("string"))).alias("summary_text"),
        F.when(i % 5 < 4, i % 5 > 0).alias("is_meaningful"),
    )
    hits = spark.sql("SELECT explode(array('de', 'fr', 'de')) AS document_id")
    return chunking.summaries_of(rows, "doc_id", hits).select("document_id", "region_id", "summary_text")


@query(f"""WITH {made._FOUND} SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, 'd' AS document_id, CAST(doc_id % 9 AS INTEGER) AS page_number, title AS source_filename, chunk_id AS region_ids, CASE WHEN doc_id % 2 = 0 THEN 'asset_' || chunk_id ELSE '' END AS crop_asset_ids, round_even(s, 4) AS score, md5(body) AS context FROM ps""")
def source_payloads(spark, d):
    """What an answer cites, and the text that its judges are shown."""
    asked, found = made._found(spark, d)
    i = F.col("doc_id")
    own = _t(spark, d, "documents").select(
        i.cast("string").alias("chunk_id"),
        F.lit("d").alias("document_id"),
        "text",
        (i % 9).cast("int").alias("page_number"),
        F.col("source").alias("source_filename"),
        F.array(i.cast("string")).alias("source_region_ids"),
        F.when(i % 2 == 0, F.array(F.concat(F.lit("asset_"), i.cast("string")))).alias("crop_asset_ids"),
    )
    hits = found.select("query_id", "rank", "chunk_id", "document_id", "score")
    cited = ask.source_payload(hits, own)
    texts = ask.context_texts(hits, own)
    return cited.join(texts, ["query_id", "rank"]).select(
        "query_id",
        F.col("rank").cast("int").alias("rank"),
        "chunk_id",
        "document_id",
        "page_number",
        "source_filename",
        F.array_join("region_ids", ",").alias("region_ids"),
        F.array_join("crop_asset_ids", ",").alias("crop_asset_ids"),
        "score",
        F.md5("context").alias("context"),
    )


@query("""WITH m AS (SELECT lang AS metric, count(*) / 1000.0 AS v FROM documents GROUP BY lang) SELECT metric || ' ' || printf('%.3f', v) || ' ' || repeat('█', CAST(floor(v * 20) AS INTEGER)) || CASE WHEN metric IN ('de', 'fr') THEN ' (redundant: one label a question)' ELSE '' END AS line FROM m""")
def report_bars(spark, d):
    """A bar a metric, a block a twentieth; counts over 1000 have three decimals at most."""
    means = _t(spark, d, "documents").groupBy(F.col("lang").alias("metric")).agg((F.count("*") / 1000.0).alias("mean"))
    return evaluation.bars(means.withColumn("mean", F.round("mean", 3)), ("de", "fr")).select("line")


_CELL = "replace(replace(substr({}, 1, {}), '|', '\\|'), chr(10), ' ')"


@query(f"""WITH r AS (SELECT url, (page_id % 2 + 1) * 3 AS pages, length(html) // 100 AS chunks, (page_id % 7)::DOUBLE AS seconds FROM pages),
  s AS (SELECT event_type, list(value ORDER BY value) AS l, avg(value) AS mean, median(value) AS med, coalesce(stddev_samp(value), 0) AS sd FROM events WHERE value IS NOT NULL GROUP BY event_type)
  SELECT '| ' || {_CELL.format('url', 200)} || ' | ' || pages || ' | ' || chunks || ' | ' || printf('%.1f', seconds) || ' | ' || printf('%.1f', chunks / pages) || ' |' AS line FROM r
  UNION ALL SELECT '| ' || {_CELL.format('"text"', 60)} || ' | ' || length("text") || ' | ' || printf('%.3f', item_id % 10 / 10.0) || ' | ' || {_CELL.format('"text"', 90)} || ' |' FROM benchmark
  UNION ALL SELECT '| ' || array_to_string([printf('%.0f', x) FOR x IN [mean, med, l[greatest(1, CAST(floor(len(l) * 95 / 100) AS INTEGER))], l[greatest(1, CAST(floor(len(l) * 99 / 100) AS INTEGER))], l[1], l[-1], sd]], ' | ') || ' |' FROM s
  UNION ALL SELECT '| ' || sum(pages) || ' | ' || count(*) || ' | ' || printf('%.0f', sum(seconds)) || ' | ' || printf('%.1f', sum(seconds) / sum(pages)) || ' | ' || printf('%.1f', sum(chunks) / sum(pages)) || ' |' FROM r""")
def performance_report(spark, d):
    """A row a web page as a run, a row a question, latencies of events by type, and the totals."""
    runs = _t(spark, d, "pages").select(
        F.col("url").alias("source_filename"), ((F.col("page_id") % 2 + 1) * 3).alias("pages"), F.expr("length(html) div 100").alias("chunks"), (F.col("page_id") % 7).cast("double").alias("seconds")
    )
    asked = _t(spark, d, "benchmark").select(F.col("text").alias("question"), F.length("text").cast("double").alias("milliseconds"), (F.col("item_id") % 10 / 10.0).alias("top_score"), F.col("text").alias("answer"))
    latency = evaluation.latency(_t(spark, d, "events"), "event_type", "value")
    return pages.performance_report(runs, asked, latency, pages.throughput(runs)).select("line")


_LEVELS = "SELECT coalesce(lang, '-') AS document_id, CAST(doc_id % 7 AS INTEGER) AS page_number, CASE doc_id % 3 WHEN 0 THEN 'table' WHEN 1 THEN 'figure' END AS region_type, source AS label, n_chars FROM documents"


@query(f"""SELECT document_id, page_number, region_type, label, CAST(4 - bit_count(GROUPING(document_id, page_number, region_type, label)) AS INTEGER) AS level, count(*) AS n, sum(n_chars)::BIGINT AS chars
  FROM ({_LEVELS}) GROUP BY ROLLUP (document_id, page_number, region_type, label)""")
def totals_by_level(spark, d):
    """Regions and their characters over document, page, type and label, at every level in one pass; a null type is one."""
    i = F.col("doc_id")
    rows = _t(spark, d, "documents").select(
        F.coalesce("lang", F.lit("-")).alias("document_id"),
        (i % 7).cast("int").alias("page_number"),
        F.when(i % 3 == 0, "table").when(i % 3 == 1, "figure").alias("region_type"),
        F.col("source").alias("label"),
        "n_chars",
    )
    return rollups.totals(rows, ["document_id", "page_number", "region_type", "label"], n=F.count("*"), chars=F.sum("n_chars"))


@query("""SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max, true AS near, true AS distinct_near
  FROM events WHERE value IS NOT NULL AND CAST(ts AS DATE) >= (SELECT min(CAST(ts AS DATE)) + 2 FROM events) GROUP BY event_type""")
def latency_sketches(spark, d):
    """Sketches a day and type, written, and merged from the third day on: percentiles within the sketches' error in rank, and users
    within theirs in number."""
    events = _t(spark, d, "events").withColumn("day", F.to_date("ts"))
    path = new_folder(spark, "sketches")
    rollups.sketched(events, ["day", "event_type"], "value", "user_id").write.parquet(path)
    since = F.date_add(F.lit(events.agg(F.min("day")).first()[0]), 2)
    got = rollups.merged(spark.read.parquet(path).where(F.col("day") >= since), ["event_type"])
    own = events.where((F.col("day") >= since) & F.col("value").isNotNull()).join(got.select("event_type", "p50", "p95", "p99", "distinct"), "event_type")
    below = lambda p, f: F.avg(f(F.col("value"), F.col(p)).cast("double"))
    near = [(below(p, lambda v, x: v < x) <= q + rollups.QUANTILE_ERROR) & (below(p, lambda v, x: v <= x) >= q - rollups.QUANTILE_ERROR) for p, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))]
    users = F.count_distinct("user_id")
    checks = own.groupBy("event_type").agg((near[0] & near[1] & near[2]).alias("near"), (F.abs(F.max("distinct") - users) <= F.greatest(F.lit(1.0), users * 0.05)).alias("distinct_near"))
    return got.join(checks, "event_type").select("event_type", "n", F.round("mean", 6).alias("mean"), "min", "max", "near", "distinct_near")


@query()
def ingest_index(spark, d):
    """Recognised pages and detected boxes to index rows; tests hold its parts against SQL and loops."""
    shown = made._recognised(spark, d).withColumns({"image_width": F.lit(4800), "image_height": F.lit(6400), "page_image_path": F.lit("p.png")})
    run = ingest.ingest(shown, made._detected(spark, d), keep=ingest.kept_in(new_folder(spark, "ingest")))
    rows = ingest.index_rows(run)
    return rows.select("chunk_id", "document_id", F.md5("text").alias("text_md5"), F.size("embedding").alias("width"), F.col("metadata")["page_number"].alias("page_number"))


@query("SELECT event_id AS document_id, event_type AS status, CASE WHEN event_type = 'click' THEN user_id END AS pages_done, CASE WHEN event_type = 'click' THEN user_id + 5 END AS total_pages FROM events")
def job_progress(spark, d):
    """Pages are counted while a job is preprocessing, and not after."""
    rows = _t(spark, d, "events").select(
        F.col("event_id").alias("document_id"),
        F.when(F.col("event_type") == "click", "preprocessing").otherwise(F.col("event_type")).alias("status"),
        F.col("user_id").alias("pages_done"),
        (F.col("user_id") + 5).alias("total_pages"),
    )
    return store.job_status(rows).withColumn("status", F.when(F.col("status") == "preprocessing", "click").otherwise(F.col("status")))


@query("SELECT lang, max(CASE WHEN doc_id % 3 = 2 AND lang IN ('de', 'en') THEN 2 ELSE 1 END) <= 1 AS single FROM documents GROUP BY lang")
def single_label_flag(spark, d):
    """Whether any question of each language has more than one label."""
    two = (F.col("doc_id") % 3 == 2) & F.col("lang").isin("de", "en")
    relevant = F.when(F.col("doc_id") % 3 == 0, F.array().cast("array<string>")).when(two, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))
    docs = _t(spark, d, "documents").select("lang", relevant.alias("relevant"))
    out = None
    for (lang,) in sorted(docs.select("lang").distinct().collect(), key=str):  # a few
        one = evaluation.single_label(docs.where(F.col("lang").eqNullSafe(F.lit(lang)))).select(F.lit(lang).cast("string").alias("lang"), "single")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {base._BLOCKS}, bs AS (SELECT * FROM bn WHERE page_number % 3 <> 0), rs AS (SELECT * FROM regions WHERE region_type IN ('table', 'figure')),
  pr AS (SELECT r.document_id, r.region_id, i.page_number, i.o, i.body, ({base._OVERLAP}) > 0 AS hit, least(abs(i.y0 - r.y1), abs(i.y1 - r.y0)) AS gap FROM rs r JOIN bs i ON i.document_id = r.document_id AND i.page_number = r.page_number),
  pk AS (SELECT *, max(hit) OVER (PARTITION BY document_id, region_id) AS anyhit, row_number() OVER (PARTITION BY document_id, region_id ORDER BY gap, o) AS near FROM pr),
  tx AS (SELECT document_id, region_id, string_agg(body, ' ' ORDER BY CASE WHEN anyhit THEN o ELSE near END) AS t, count(*) AS n FROM pk WHERE CASE WHEN anyhit THEN hit ELSE near <= 3 END GROUP BY ALL)
  SELECT r.document_id, r.region_id, CAST(coalesce(n, 0) AS INTEGER) AS n_blocks, (coalesce(t, CASE WHEN ord % 2 = 0 THEN 'chunk of ' || r.region_id END, 'Detected ' || region_type || ' region on page ' || page_number || '.'))[1:1200] AS summary_text FROM rs r LEFT JOIN tx USING (document_id, region_id)""")
def visual_summary_texts(spark, d):
    """Text of linked blocks; on every third page there are none: then of a chunk that names the region, or a sentence."""
    regions = base._regions(spark, d)
    blocks = base._made_blocks(spark, d, regions).where("page_number % 3 <> 0")
    chunks = regions.where("ord % 2 = 0").select(
        "document_id",
        F.concat(F.lit("c"), "region_id").alias("chunk_id"),
        "ord",
        F.concat(F.lit("chunk of "), "region_id").alias("text"),
        F.array("region_id").alias("source_region_ids"),
    )
    got = layout.visual_summaries(regions, blocks, chunks)
    return got.select("document_id", "region_id", F.size("linked_block_ids").alias("n_blocks"), "summary_text")
