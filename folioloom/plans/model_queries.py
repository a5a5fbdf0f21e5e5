"""Operators around models and pages over the tables of a folder, and the same in DuckDB SQL. The models are rules over their
prompts, so that what they say, and where they fail, is known to both engines."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioloom.functions import lenient as L
from folioloom.functions import text as T
from folioloom.operators import chunking, layout, ledger, models, pages, ports, retrieval, store
from folioloom.plans import queries as base
from folioloom.plans.queries import _ITEMS, _REGIONS, _items, _regions, _t, query
from folioloom.sources.shared import new_folder

_rule = ports.RuledModel
_field = lambda p, head: F.regexp_extract(p, rf"(?s){head}(.*?)(?:\n|$)", 1)
_hash = lambda c: F.pmod(F.conv(F.substring(F.md5(c), 1, 4), 16, 10).cast("int"), F.lit(7))
_HASH = "(CAST('0x' || substr(md5({}), 1, 4) AS INTEGER) % 7)"

# ---- questions: those of users in conversations

_USER = "u AS (SELECT conv_id * 1000 + turn AS query_id, coalesce(\"text\", '') AS question FROM conversations WHERE role = 'user')"


def _asked(spark, d):
    return _t(spark, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.coalesce("text", F.lit("")).alias("question"))


_question = lambda p: F.regexp_extract(p, r"(?s)^[^\n]*\n\n(.*)$", 1)


@query(f"WITH {_USER} SELECT query_id, CASE WHEN {_HASH.format('question')} < 5 AND {_HASH.format('question')} % 2 = 0 THEN 'complex' ELSE 'simple' END AS kind FROM u")
def query_classify(spark, d):
    said = lambda p: F.when(_hash(_question(p)) < 5, F.when(_hash(_question(p)) % 2 == 0, " Complex.\n").otherwise("simple"))
    return models.classify(_rule(said), _asked(spark, d)).select("query_id", "kind")


@query(f"""WITH {_USER}, k AS (SELECT *, {_HASH.format('question')} AS h FROM u)
  SELECT query_id, 0 AS sub, CASE WHEN h = 1 THEN 'A passage of ' || length(question) ELSE question END AS search FROM k WHERE h % 2 = 1
  UNION ALL SELECT query_id, unnest([0, 1]) AS sub, unnest(['part a', 'part ' || length(question)]) AS search FROM k WHERE h % 2 = 0 AND h < 6
  UNION ALL SELECT query_id, 0, question FROM k WHERE h = 6""")
def query_searches(spark, d):
    """Simple questions search with a made-up passage, or with themselves where the model fails; complex ones with their parts."""
    q, h = _question, lambda p: _hash(_question(p))
    size = lambda p: F.length(q(p)).cast("string")
    kind = lambda p: F.when(h(p) % 2 == 0, "complex").otherwise("simple")
    made = lambda p: F.when(h(p) == 1, F.concat(F.lit(" A passage of "), size(p), F.lit("\n")))
    parts = lambda p: F.when(h(p) < 6, F.concat(F.lit("1. part a\n\n2) part "), size(p)))
    said = lambda p: F.when(p.startswith(models.CLASSIFY), kind(p)).when(p.startswith(models.HYPOTHETICAL), made(p)).otherwise(parts(p))
    return models.searches(_rule(said), _asked(spark, d)).select("query_id", "sub", "search")


@query(f"WITH {_USER} SELECT query_id, length(question) >= 1 AND query_id % 25 BETWEEN 1 AND 20 AS valid FROM u")
def request_checks(spark, d):
    return _asked(spark, d).select("query_id", store.valid_request(F.col("question"), F.col("query_id") % 25).alias("valid"))


# ---- passages of the fixed questions

_FOUND = f"""{base._Q_SQL}, {base._bm25_sql('true', 6)}, ps AS (SELECT r.query_id, r.rank, CAST(r.chunk_id AS VARCHAR) AS chunk_id, r.s, d."text" AS body, d.source AS title, d.lang AS sub, d.doc_id,
    CASE d.doc_id % 3 WHEN 0 THEN 'TABLE_DESC' WHEN 1 THEN 'FIGURE_DESC' ELSE CASE WHEN length({base._STRIP.format('d."text"')}) < 80 THEN 'SECTION_HEADER' ELSE 'PROSE' END END AS kind,
    CASE WHEN d.doc_id % 3 = 1 AND d.doc_id % 2 = 0 THEN 'picture ' || d.doc_id ELSE d."text" END AS content FROM r JOIN documents d ON d.doc_id = r.chunk_id)"""


def _summaries(spark, d):
    """A summary for every even document: of a figure where the document is one."""
    kind = F.when(F.col("doc_id") % 3 == 0, "table").when(F.col("doc_id") % 3 == 1, "figure").otherwise("text_block")
    docs = _t(spark, d, "documents").where("doc_id % 2 = 0")
    return docs.select(
        F.lit("d").alias("document_id"),
        F.col("doc_id").cast("string").alias("region_id"),
        kind.alias("region_type"),
        F.lit(1).alias("page_number"),
        F.concat(F.lit("picture "), F.col("doc_id").cast("string")).alias("summary_text"),
        F.lit(True).alias("is_meaningful"),
    )


def _found(spark, d):
    corpus = base._corpus(spark, d).withColumn("chunk_id", F.col("chunk_id").cast("string")).withColumn("source_region_ids", F.array("chunk_id"))
    hits = retrieval.bm25(base._corpus(spark, d), base._questions(spark), 6).withColumn("chunk_id", F.col("chunk_id").cast("string"))
    return base._questions(spark), models.passages(hits, corpus, _summaries(spark, d))


@query(f"""WITH {_FOUND} SELECT query_id, md5(string_agg('[ID: ' || chunk_id || ']' || chr(10) || 'Type: ' || kind || chr(10) || 'Section: ' || title || ' > ' || sub || chr(10) || 'Content: ' || content[1:600], chr(10) || chr(10) ORDER BY rank)) AS candidates,
  md5(string_agg('[CHUNK ' || chunk_id || ' | ' || CASE doc_id % 3 WHEN 0 THEN 'TABLE' WHEN 1 THEN 'FIGURE' ELSE 'PROSE' END || ' | ' || title || ']' || chr(10) || body, chr(10) || chr(10) ORDER BY rank)) AS sources FROM ps GROUP BY query_id""")
def prompt_blocks(spark, d):
    _, found = _found(spark, d)
    by = models.by_question(found, "chunk_id", "kind", "section", "content", "title", "text", "region_types")
    return by.select("query_id", F.md5(models.candidate_block(F.col("p"))).alias("candidates"), F.md5(models.source_block(F.col("p"))).alias("sources"))


@query(f"""WITH {_FOUND}, v AS (SELECT *, count(*) OVER (PARTITION BY query_id) + 1 - rank AS pos, rank / 10.0 AS s2 FROM ps WHERE query_id % 3 <> 0),
  k AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY pos) AS INTEGER) AS rank, chunk_id, round(s2, 6) AS score FROM v WHERE s2 >= 0.3 AND rank <> 5)
  SELECT * FROM k UNION ALL SELECT query_id, CAST(rank AS INTEGER), chunk_id, round(s, 6) FROM ps WHERE query_id NOT IN (SELECT query_id FROM k)""")
def model_rerank(spark, d):
    """The model turns the candidates round, scores them by place, drops the fifth, names one that isn't there, and fails on
    every third question."""
    asked, found = _found(spark, d)
    ids = lambda p: F.regexp_extract_all(p, F.lit(r"\[ID: ([^\]]*)\]"), F.lit(1))
    quoted = lambda a: F.array_join(F.transform(a, lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ", ")
    scores = lambda a: F.array_join(F.transform(a, lambda x, i: F.concat(F.lit('"'), x, F.lit('": '), ((i + 1) / 10.0).cast("string"))), ", ")
    body = lambda a: F.concat(
        F.lit('```json\n{"ranking": ['),
        quoted(F.reverse(a)),
        F.lit(', "none"], "scores": {'),
        scores(a),
        F.lit('}, "dropped": ['),
        quoted(F.slice(a, 5, 1)),
        F.lit("]}\n```"),
    )
    fails = F.lit(False)
    for i, q in base.QUESTIONS:
        if i % 3 == 0:
            fails = fails | (lambda p, q=q: p.contains(f"Query: {q}\n"))(F.col("_prompt"))
    got = models.rerank(_rule(lambda p: F.when(~fails, body(ids(p)))), asked, found)
    return got.select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


@query(f"""WITH {_FOUND} SELECT query_id, chunk_id, round(CASE WHEN doc_id % 5 = 0 THEN s ELSE least(1.0, length(CASE WHEN doc_id % 3 < 2 THEN body ELSE content END[1:800]) / 700.0) END, 6) AS score,
  CASE WHEN doc_id % 5 = 0 THEN 'model unavailable' ELSE 'type ' || kind END AS reason FROM ps""")
def passage_scores(spark, d):
    """Scores by the length of what the model is shown, over 1 for some; no answer for every fifth document's passage."""
    asked, found = _found(spark, d)
    shown = lambda p: F.regexp_extract(p, r"(?s)\nDocument: [^\n]*\n\n(.*?)(?:\n\nDescription:\n.*)?$", 1)
    kind = lambda p: _field(p, "\nType: ")
    body = lambda p: F.concat(F.lit("score: oops\n Score: "), (F.length(shown(p)) / 700.0).cast("string"), F.lit("\nreason: type "), kind(p))
    fails = F.col("chunk_id").cast("long") % 5 == 0
    got = models.score_passages(_rule(lambda p: F.when(~fails, body(p))), asked, found)
    return got.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "reason")


@query(f"""WITH {_FOUND}, b AS (SELECT query_id, string_agg('[CHUNK ' || chunk_id || ' | ' || kind || ' | ' || title || ' > ' || sub || ' | score: ' || regexp_replace(printf('%.4f', s), '(\\.[0-9]+?)0+$', '\\1') || ']' || chr(10) || content, chr(10) || chr(10) ORDER BY rank) AS t FROM ps GROUP BY query_id)
  SELECT q.query_id, CASE WHEN t IS NULL THEN '' WHEN q.query_id % 2 = 0 THEN md5(t) ELSE md5('short of ' || length(t)) END AS context FROM q LEFT JOIN b USING (query_id)""")
def context_compression(spark, d):
    """Shortened for every other question; whole where the model fails; empty without passages."""
    asked, found = _found(spark, d)
    block = lambda p: F.regexp_extract(p, r"(?s)\nDrop below: [^\n]*\n\n(.*)$", 1)
    fails = F.col("query_id") % 2 == 0
    got = models.compress(_rule(lambda p: F.when(~fails, F.concat(F.lit(" short of "), F.length(block(p)).cast("string"), F.lit("\n")))), asked, found)
    return got.select("query_id", F.when(F.col("context") == "", "").otherwise(F.md5("context")).alias("context"))


@query(f"""WITH {_FOUND}, fs AS (SELECT query_id, (SELECT arg_min(doc_id, rank) FROM ps WHERE ps.query_id = q.query_id) AS c FROM q)
  SELECT query_id, CASE WHEN query_id IN (1, 4) OR c IS NULL OR c % 3 = 2 THEN 'answer ' || query_id WHEN c % 3 = 0 THEN 'fixed INFERRED N/A' ELSE 'fixed UNSUPPORTED not in ' || c END AS answer,
    query_id <> 4 AND coalesce(c % 3 < 2, false) AS flawed FROM fs""")
def faithfulness_correction(spark, d):
    """Claims are supported, inferred or not, as the first source says; the check fails on question 4, the correction on question 1."""
    asked, found = _found(spark, d)
    answers = asked.select("query_id", F.concat(F.lit("answer "), F.col("query_id").cast("string")).alias("answer"))
    first = lambda p: F.regexp_extract(p, r"\[CHUNK (\d+) \|", 1)
    kind = lambda p: F.coalesce(first(p).try_cast("long") % 3, F.lit(2))
    status = lambda p: F.when(kind(p) == 0, "INFERRED").when(kind(p) == 1, "UNSUPPORTED").otherwise("SUPPORTED")
    note = lambda p: F.when(kind(p) == 1, F.concat(F.lit("not in "), first(p))).otherwise("")
    verdict = lambda p: F.concat(F.lit('```\n{"claims": [{"claim_text": "c", "status": "'), status(p), F.lit('", "note": "'), note(p), F.lit('"}, 7], "recommended_action": "flag_for_review"}\n```'))
    fixed = lambda p: F.concat(F.lit("fixed "), _field(p, "\nStatus: "), F.lit(" "), _field(p, "\nNote: "))
    said = lambda p: F.when(p.startswith(models.CHECK), F.when(F.col("query_id") != 4, verdict(p))).otherwise(F.when(F.col("query_id") != 1, fixed(p)))
    checked = models.check(_rule(said), asked, found, answers)
    flawed = checked.select("query_id", L.needs_correction(F.col("checked")).alias("flawed"))
    return models.correct(_rule(said), checked).join(flawed, "query_id")


@query("""WITH d AS (SELECT source || '-' || lang || '-' || (doc_id % 20) AS document_id, doc_id FROM documents),
  t AS (SELECT document_id, count(*) AS n, count(*) FILTER (doc_id % 5 = 0) AS t, max(doc_id % 2) = 0 AS well FROM d GROUP BY ALL),
  c AS (SELECT *, t > n / 2 AS tab, NOT t > n / 2 AND NOT well AND n < 3 AS loose, CASE n % 4 WHEN 1 THEN 1500 ELSE 1800 END AS size FROM t)
  SELECT document_id, CASE WHEN tab THEN 'layout_aware' WHEN loose THEN 'recursive_large' WHEN n % 4 = 1 THEN 'semantic_section' WHEN n % 4 = 2 THEN 'recursive_large' ELSE 'semantic_fixed' END AS strategy,
    CAST(CASE WHEN loose THEN greatest(size, 2000) ELSE size END AS INTEGER) AS chunk_size, CAST(CASE n % 4 WHEN 1 THEN 150 ELSE 200 END AS INTEGER) AS overlap, tab OR n % 4 = 1 AS keep_tables_intact,
    CASE n % 4 WHEN 0 THEN 'no answer' WHEN 1 THEN 'r' || n ELSE 'chosen by the model' END AS reason, CASE WHEN tab THEN 'table-dominant document' WHEN loose THEN 'unstructured document with few sections' END AS override FROM c""")
def chosen_strategies(spark, d):
    """By the number of sections the model fails, answers whole, in part and with a size that's no number, or without JSON."""
    i = F.col("doc_id")
    rows = _t(spark, d, "documents").where("source is not null and lang is not null").select(F.concat_ws("-", "source", "lang", (i % 20).cast("string")).alias("document_id"), i)
    sections = rows.select("document_id", (i % 5 == 0).cast("int").alias("tables"), F.lit(0).alias("charts"), F.lit(1).alias("figures"), F.lit(2).alias("text_blocks"))
    described = rows.groupBy("document_id").agg((F.max(i % 2) == 0).alias("well_structured")).select(
        "*", F.lit(3).alias("page_count"), F.lit("report").alias("doc_type"), F.lit("").alias("domain"), F.lit(False).alias("visual_heavy"), F.lit(None).cast("boolean").alias("data_heavy")
    )
    n = lambda p: F.regexp_extract(p, r"doc_type=report domain=unknown pages=3 sections=(\d+) ", 1).cast("int")
    whole = lambda p: F.concat(F.lit('```json\n{"strategy": "semantic_section", "chunk_size": 1500, "overlap": 150, "keep_tables_intact": true, "reason": "r'), n(p).cast("string"), F.lit('"}\n```'))
    said = lambda p: F.when(n(p) % 4 == 1, whole(p)).when(n(p) % 4 == 2, '{"strategy": "recursive_large", "chunk_size": "large"}').when(n(p) % 4 == 3, "none")
    return models.choose_strategy(_rule(said), sections, described)


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'chart' END AS type, CASE WHEN doc_id % 4 = 1 THEN coalesce(nullif(source, ''), 'untitled') || ': ' || least(300, length("text")) END AS key_finding, doc_id % 4 = 2 AS parse_error
  FROM documents WHERE doc_id % 4 IN (1, 2)""")
def visual_readings(spark, d):
    """Of every four crops one is read, one answered without JSON, one fails and one has no image."""
    i = F.col("doc_id")
    crops = _t(spark, d, "documents").select(
        i, F.lit("d").alias("document_id"), i.cast("string").alias("region_id"), F.lit("figure").alias("region_type"), (i % 4).cast("int").alias("page_number"), F.lit("c.png").alias("crop_path"),
        F.when(i % 4 != 3, F.encode(F.lit("png"), "UTF-8")).alias("image"), F.col("source").alias("parent_title"), F.lit(None).cast("string").alias("parent_subtitle"), F.col("text").alias("flat_text"),
    )
    page = lambda p: _field(p, "\nPage: ")
    size = lambda p: F.length(F.regexp_extract(p, r"(?s)\nText: (.*)\nAnswer in JSON", 1)).cast("string")
    read = lambda p: F.concat(F.lit('{"type": "chart", "key_finding": "'), _field(p, "Section: "), F.lit(": "), size(p), F.lit('"}'))
    got = models.read_visuals(_rule(lambda p: F.when(page(p) == "1", read(p)).when(page(p) == "2", "no reading")), crops)
    return got.select(F.col("region_id").cast("long").alias("doc_id"), "type", "key_finding", "parse_error")


@query("""WITH p AS (SELECT DISTINCT coalesce(source, '') || ' ' || coalesce(lang, '') AS t, lang FROM documents)
  SELECT 'one' AS run, count(*) AS calls, count(*) FILTER (lang = 'fr') AS failed FROM p UNION ALL SELECT 'two', count(*), count(*) FROM p WHERE lang = 'fr'""")
def answers_ledger(spark, d):
    """Two branches of one run, and a run after it, ask a prompt a document: each distinct one is called once, those that failed once more
    in the second run."""
    path, rows = new_folder(spark, "ledger"), _t(spark, d, "documents").select("doc_id", F.concat_ws(" ", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))).alias("p"))
    model = _rule(lambda p: F.when(~p.endswith(" fr"), F.concat(F.lit("on "), p)))
    for run in ("one", "two"):
        book = ledger.Ledger(model, "rule-1", path, run)
        for branch in (0, 1):
            book.answer(rows.where(F.col("doc_id") % 2 == branch), "p", "answer")
    return book.rows(spark).groupBy("run").agg(F.count("*").alias("calls"), F.count(F.when(F.col("answer").isNull(), 1)).alias("failed"))


@query("""SELECT doc_id, CASE WHEN lang = 'en' AND doc_id % 2 = 0 THEN 'first: even' WHEN lang IN ('en', 'de') THEN 'second: ' || lang WHEN lang = 'fr' THEN 'SKIP' END AS said,
  CASE WHEN lang = 'en' AND doc_id % 2 = 0 THEN 'first' WHEN lang IN ('en', 'de') THEN 'second' WHEN lang = 'fr' THEN 'third' END AS model FROM documents""")
def picture_cascade(spark, d):
    """Three picture models in order, each asked only of crops on which those before it failed."""
    rows = _t(spark, d, "documents").select(
        "doc_id", F.encode(F.lit("png"), "UTF-8").alias("image"), F.lit("figure").alias("kind"), F.concat(F.coalesce("lang", F.lit("")), (F.col("doc_id") % 2).cast("string")).alias("context")
    )
    context = lambda p: F.element_at(F.split(p, "\n"), 2)
    lang = lambda p: F.substring(context(p), 1, 2)
    steps = [
        ("first", _rule(lambda p: F.when(context(p) == "en0", "first: even"))),
        ("second", _rule(lambda p: F.when(lang(p).isin("en", "de"), F.concat(F.lit("second: "), lang(p))))),
        ("third", _rule(lambda p: F.when(lang(p) == "fr", "SKIP"))),
    ]
    return ledger.Cascade(steps, new_folder(spark, "cascade"), "model").describe(rows, "image", "kind", "context", "said").select("doc_id", "said", "model")


@query(f"""WITH {_FOUND}, rg AS (SELECT query_id, doc_id, CASE doc_id % 3 WHEN 0 THEN 'table' ELSE 'figure' END AS kind FROM ps WHERE doc_id % 2 = 0 AND doc_id % 3 < 2),
  ro AS (SELECT q.query_id, question, list_sort(coalesce(list(CAST(doc_id AS VARCHAR)) FILTER (kind = 'table'), [])) AS tr, list_sort(coalesce(list(CAST(doc_id AS VARCHAR)) FILTER (kind = 'figure'), [])) AS fr FROM q LEFT JOIN rg USING (query_id) GROUP BY ALL),
  us AS (SELECT *, len(tr) > 0 AND {base._ANY(T.CALL_TABLE_TERMS)} AS ta, len(fr) > 0 AND {base._ANY(T.CALL_FIGURE_TERMS)} AS fa FROM ro)
  SELECT query_id, array_to_string(tr, ',') AS table_regions, array_to_string(fr, ',') AS figure_regions, ta AS use_table_agent, fa AS use_figure_agent,
    CASE WHEN ta THEN 'saw ' || len(tr) END AS table_output, CASE WHEN fa THEN 'saw ' || len(fr) END AS figure_output,
    CASE WHEN query_id NOT IN (SELECT query_id FROM ps) THEN 'No relevant documents found in the corpus for this question.' ELSE 'from ' || (SELECT count(*) FROM ps WHERE ps.query_id = us.query_id) || ' and ' || (CAST(ta AS INTEGER) + CAST(fa AS INTEGER)) END AS answer FROM us""")
def route_and_answer(spark, d):
    """Routing, what the specialists say of the regions they are shown, and the answer from evidence and specialists."""
    from folioloom.plans.ask import Ask

    asked, found = _found(spark, d)
    corpus = base._corpus(spark, d).withColumn("chunk_id", F.col("chunk_id").cast("string")).withColumn("source_region_ids", F.array("chunk_id"))
    routed = Ask(corpus).route(asked, found.select("query_id", "chunk_id"), corpus, _summaries(spark, d))
    count = lambda p, what: F.size(F.regexp_extract_all(p, F.lit(what), F.lit(0))).cast("string")
    told = models.specialists(_rule(lambda p: F.concat(F.lit("saw "), count(p, r"\[region="))), asked, routed, _summaries(spark, d))
    evidence = models.compress(_rule(lambda p: F.lit(None).cast("string")), asked, found)
    answers = models.synthesise(_rule(lambda p: F.concat(F.lit("from "), count(p, r"\[CHUNK "), F.lit(" and "), count(p, r"agent regions="))), asked, evidence, told)
    by = told.groupBy("query_id").agg(*[F.max(F.when(F.col("agent") == k, F.col("output"))).alias(f"{k}_output") for k in ("table", "figure")])
    lists = [F.array_join(c, ",").alias(c) for c in ("table_regions", "figure_regions")]
    return routed.join(by, "query_id", "left").join(answers, "query_id").select("query_id", *lists, "use_table_agent", "use_figure_agent", "table_output", "figure_output", "answer")


@query(f"""WITH {_USER}, s AS (SELECT query_id, question, 'a' || query_id AS answer, CASE WHEN query_id % 3 <> 0 THEN 'truth ' || query_id END AS truth FROM u),
  n AS (SELECT *, 10 + 2 * length(question) AS ctx, 10 + 2 * least(400, length(question)) AS cut FROM s)
  SELECT query_id, round(CASE WHEN query_id % 7 = 0 THEN 0 ELSE least(length(answer) + ctx, 1000) / 1000.0 END, 6) AS faithfulness, round(CASE WHEN query_id % 7 = 0 THEN 0 ELSE least(length(question) + length(answer), 1000) / 1000.0 END, 6) AS answer_relevance,
    round(CASE WHEN query_id % 7 = 0 THEN 0 ELSE least(length(question) + cut, 1000) / 1000.0 END, 6) AS context_relevance, round(CASE WHEN truth IS NULL THEN NULL WHEN query_id % 7 = 0 THEN 0 ELSE least(length(truth) + cut, 1000) / 1000.0 END, 6) AS context_recall,
    round(CASE WHEN truth IS NULL THEN NULL WHEN query_id % 7 = 0 THEN 0 ELSE least(length(truth) + length(answer), 1000) / 1000.0 END, 6) AS answer_correctness FROM n""")
def judge_scores(spark, d):
    """Scores by the length of what each judge is shown; no JSON for every seventh question."""
    s = _asked(spark, d)
    name = F.col("query_id").cast("string")
    samples = s.select(
        "query_id",
        "question",
        F.concat(F.lit("a"), name).alias("answer"),
        F.array("question", "question").alias("contexts"),
        F.when(F.col("query_id") % 3 != 0, F.concat(F.lit("truth "), name)).alias("ground_truth"),
    )
    shown = lambda p: F.regexp_replace(p, r"(?s)^.*?\n\n\w+:\n", "")
    size = lambda p: F.length(F.regexp_replace(shown(p), r"\n\n(?:answer|passages|question|ground_truth):\n", ""))
    said = lambda p: F.when(
        F.col("query_id") % 7 != 0,
        F.concat(F.lit('{"score": '), (F.least(size(p), F.lit(1000)) / 1000.0).cast("string"), F.lit("}")),
    ).otherwise("not JSON")
    got = models.judge(_rule(said), samples)
    return got.select("query_id", *[F.round(k, 6).alias(k) for k in models.JUDGES])


@query(f"""WITH t AS (SELECT doc_id, {base._STRIP.format('"text"')} AS body FROM documents) SELECT 'q of ' || length(body[1:1200]) AS question, 't' || doc_id AS ground_truth, CAST(doc_id AS VARCHAR) AS chunk_id, CAST(doc_id % 9 AS INTEGER) AS source_page FROM t WHERE length(body) >= 100 AND doc_id % 4 < 2""")
def question_generation(spark, d):
    """Of four texts two get a question and an answer, one an empty answer, one no JSON."""
    chunks = _t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text", (F.col("doc_id") % 9).cast("int").alias("page_number"))
    size = lambda p: F.length(F.regexp_extract(p, r"(?s)^[^\n]*\n\nPassage:\n(.*)$", 1)).cast("string")
    made = lambda p: F.concat(
        F.lit('{"question": " q of '),
        size(p),
        F.lit('", "ground_truth": "'),
        F.when(F.col("chunk_id") % 4 < 2, F.concat(F.lit("t"), F.col("chunk_id").cast("string"))).otherwise(""),
        F.lit('"}'),
    )
    got = models.write_questions(_rule(lambda p: F.when(F.col("chunk_id") % 4 < 3, made(p))), chunks)
    return got.select("question", "ground_truth", F.element_at("relevant_chunk_ids", 1).alias("chunk_id"), "source_page")


@query("""WITH n AS (SELECT count(*) AS n FROM documents), p AS (SELECT doc_id FROM documents ORDER BY length("text") DESC, doc_id LIMIT (SELECT greatest(60, floor(n / 2) + 1) FROM n))
  SELECT doc_id FROM p ORDER BY md5('42:' || doc_id), doc_id LIMIT 20""")
def question_pool(spark, d):
    """The report is its limit: twenty chunks to write questions about, of the longer half."""
    return store.question_sample(_t(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", 20).select("doc_id")


# ---- sections, descriptors, pictures

_SECTIONS = f"""{base._TAGS}, sc AS (SELECT page_id, parent_title AS title, count(*) FILTER (label = 'table') AS tables, count(*) FILTER (label = 'chart') AS charts, count(*) FILTER (label = 'figure') AS figures,
  (concat_ws(chr(10), parent_title, string_agg(body, chr(10) ORDER BY ord) FILTER (label = 'text' AND body <> '')))[1:2000] AS flat FROM r3 WHERE parent_title IS NOT NULL GROUP BY page_id, parent_title)"""


def _sections(spark, d):
    return layout.sections(layout.assign_titles(base._tagged(spark, d)))


@query(f"""WITH {_SECTIONS} SELECT page_id, title, CASE WHEN page_id % 3 = 0 THEN '' ELSE 'S' || (tables + charts + figures) || ' of ' || length(flat[1:800]) END AS summary, CASE WHEN page_id % 3 = 0 THEN 0 ELSE 2 END AS n_topics, page_id % 3 = 1 AS has_data, CASE WHEN page_id % 3 = 0 THEN 'unknown' ELSE 'body' END AS section_type FROM sc""")
def section_summaries(spark, d):
    made = _sections(spark, d)
    size = lambda p: F.length(F.regexp_extract(p, r"(?s)\nText:\n(.*)\nPictures: none$", 1)).cast("string")
    seen = lambda p: (F.col("tables") + F.col("charts") + F.col("figures")).cast("string")
    said = lambda p: F.concat(
        F.lit('```json\n{"summary": "S'),
        seen(p),
        F.lit(" of "),
        size(p),
        F.lit('", "key_topics": ["a", "b"], "has_data": '),
        F.when(F.col("document_id") % 3 == 1, "true").otherwise("false"),
        F.lit(', "section_type": "body"}\n```'),
    )
    got = models.section_summaries(_rule(lambda p: F.when(F.col("document_id") % 3 != 0, said(p))), made)
    return got.select(F.col("document_id").alias("page_id"), "title", "summary", F.size("key_topics").alias("n_topics"), "has_data", "section_type")


@query(f"""WITH {_SECTIONS}, dc AS (SELECT p.page_id, count(sc.title) AS n, coalesce(sum(tables + charts + figures), 0) AS vis, coalesce(sum(tables), 0) AS tb FROM pages p LEFT JOIN sc USING (page_id) GROUP BY p.page_id)
  SELECT page_id, CASE WHEN page_id % 5 = 0 THEN '' ELSE 'about ' || vis || ' in ' || n END AS summary, page_id % 5 = 0 OR page_id % 2 = 0 AS well_structured, page_id % 5 <> 0 AS embedded,
    CASE WHEN n = 0 THEN NULL WHEN tb > n / 2.0 THEN 'layout_aware' WHEN page_id % 5 <> 0 AND page_id % 2 = 1 AND n < 3 THEN 'recursive_large' ELSE 'recursive' END AS strategy FROM dc""")
def document_descriptors(spark, d):
    made = _sections(spark, d)
    summed = models.section_summaries(_rule(lambda p: F.lit(None).cast("string")), made)
    docs = _t(spark, d, "pages").select(F.col("page_id").alias("document_id"), F.col("url").alias("source_filename"), F.lit(1).alias("page_count"))
    number = lambda p, head: F.regexp_extract(p, rf"\n{head}: (\d+)\n", 1)
    said = lambda p: F.concat(
        F.lit('{"summary": "about '),
        number(p, "Visuals"),
        F.lit(" in "),
        number(p, "Sections"),
        F.lit('", "well_structured": '),
        (F.col("document_id") % 2 == 0).cast("string"),
        F.lit("}"),
    )
    got = models.descriptors(_rule(lambda p: F.when(F.col("document_id") % 5 != 0, said(p))), summed, docs)
    plan = layout.chunk_strategy(made, got.select("document_id", "well_structured"))
    return got.join(plan, "document_id", "left").select(
        F.col("document_id").alias("page_id"),
        "summary",
        "well_structured",
        F.col("summary_embedding").isNotNull().alias("embedded"),
        "strategy",
    )


@query(f"""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN {base._STRIP.format("'figure;' || CASE WHEN doc_id % 8 = 0 THEN '' ELSE \"text\"[1:400] END")} ELSE CASE WHEN doc_id % 8 = 0 THEN 'Detected figure region on page 1.' ELSE "text" END END AS summary_text, doc_id % 4 <> 1 AS is_meaningful FROM documents""")
def picture_descriptions(spark, d):
    """Every fourth crop is described, the next is a logo, the next fails, the last has no image; a stock sentence isn't context."""
    text = F.when(F.col("doc_id") % 8 == 0, "Detected figure region on page 1.").otherwise(F.col("text"))
    rows = _t(spark, d, "documents").select(
        "doc_id",
        F.lit("figure").alias("region_type"),
        text.alias("summary_text"),
        F.lit(True).alias("is_meaningful"),
        F.when(F.col("doc_id") % 4 != 3, F.encode(F.lit("png"), "UTF-8")).alias("image"),
    )
    said = lambda p: F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit(" figure;"), F.col("_context"))).when(F.col("doc_id") % 4 == 1, "\tskip \n").when(F.col("doc_id") % 4 == 3, "of nothing")
    return models.describe_pictures(_rule(said), rows).select("doc_id", "summary_text", "is_meaningful")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'f' || (doc_id % 30) ELSE NULL END AS intelligence, CASE WHEN doc_id % 2 = 0 THEN 'v' END AS old FROM documents""")
def picture_intelligence(spark, d):
    docs = _t(spark, d, "documents")
    own = F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("k"), F.lit("v")))
    rows = docs.select("doc_id", F.concat(F.lit("c"), (F.col("doc_id") % 30).cast("string")).alias("crop_path"), own.alias("metadata"))
    read = spark.range(30).where("id % 3 = 0").select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("crop_path"), F.concat(F.lit("f"), F.col("id").cast("string")).alias("finding"))
    got = models.with_intelligence(rows, read)
    return got.select("doc_id", F.col("metadata")["intelligence"].alias("intelligence"), F.col("metadata")["k"].alias("old"))


# ---- pages

_PAYLOAD = f"""{_ITEMS}, pl AS (SELECT *, row_number() OVER (PARTITION BY document_id, page_number ORDER BY ord, body, x0, y0, x1, y1) - 1 AS pos FROM items),
  it AS (SELECT document_id, page_number, 'p' || page_number || '_ocr_' || pos AS item_id, body, CASE WHEN pos % 7 = 3 THEN x0 + 1 ELSE x0 END AS x0, y0, x1, y1, CASE WHEN pos % 5 < 4 THEN pos / 100.0 END AS confidence, pos FROM pl WHERE pos % 6 <> 2 AND pos % 11 <> 5)"""


def _recognised(spark, d):
    """Pages as a recogniser gives them: some texts blank, some boxes missing for which there's a polygon, some false."""
    one = F.struct("ord", "text", "bbox")
    rows = _items(spark, d).groupBy("document_id", "page_number").agg(F.sort_array(F.collect_list(one)).alias("r"))
    four = lambda b: F.array(b.x0, b.y0, b.x1, b.y1)
    box = lambda x, i: F.when(i % 7 == 3, F.lit(None).cast("array<double>")).when(i % 11 == 5, F.array(x.bbox.x1, x.bbox.y0, x.bbox.x0, x.bbox.y1)).otherwise(four(x.bbox))
    shape = lambda x, i: F.when(i % 11 == 5, F.array().cast("array<array<double>>")).otherwise(F.array(F.array(x.bbox.x0 + 1, x.bbox.y0), F.array(x.bbox.x1, x.bbox.y1)))
    return rows.select(
        "document_id", "page_number", F.transform("r", lambda x, i: F.when(i % 6 == 2, "  ").otherwise(F.concat(F.lit(" "), x.text))).alias("rec_texts"),
        F.transform("r", lambda x, i: F.when(i % 5 < 4, i / 100.0)).alias("rec_scores"), F.transform("r", box).alias("rec_boxes"), F.transform("r", shape).alias("dt_polys"),
    )


@query(f"WITH {_PAYLOAD} SELECT document_id, page_number, item_id, body, x0, y0, x1, y1, round(confidence, 6) AS confidence FROM it")
def ocr_items(spark, d):
    got = layout.ocr_items(_recognised(spark, d))
    return got.select("document_id", "page_number", "item_id", F.col("text").alias("body"), "bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1", F.round("confidence", 6).alias("confidence"))


@query(f"""WITH {_PAYLOAD}, o AS (SELECT *, row_number() OVER (PARTITION BY document_id, page_number ORDER BY pos) AS n FROM it),
  g AS (SELECT *, row_number() OVER (PARTITION BY document_id, page_number ORDER BY round_even(y0 / 18, 0), x0, y0, pos) AS geo FROM o)
  SELECT document_id, page_number, item_id, CAST(row_number() OVER (PARTITION BY document_id, page_number ORDER BY CASE WHEN page_number % 5 <> 0 AND n <= 40 THEN -n END NULLS LAST, geo) AS INTEGER) AS reading_order FROM g""")
def model_order(spark, d):
    """A model that reads backwards, is shown forty items at most and fails on every fifth page."""

    class Backwards:
        def logits(self, shown):
            n = F.size("item_ids")
            row = lambda x, i: F.transform("item_ids", lambda y, j: (-F.abs(i + j + 1 - n)).cast("double"))
            return shown.withColumn("scores", F.when(F.col("page_number") % 5 != 0, F.transform("item_ids", row)))

    got, _ = pages.model_reading_order(layout.ocr_items(_recognised(spark, d)), Backwards(), 40)
    return got.select("document_id", "page_number", "item_id", "reading_order")


@query(f"""WITH {_PAYLOAD}, o AS (SELECT *, row_number() OVER (PARTITION BY document_id, page_number ORDER BY pos) AS n, max(x1) OVER (PARTITION BY document_id, page_number) * 1.1 AS w, max(y1) OVER (PARTITION BY document_id, page_number) * 1.1 AS h FROM it)
  SELECT document_id, page_number, item_id, CAST(floor(x0 / w * 1000) AS INTEGER) AS x0, CAST(floor(y0 / h * 1000) AS INTEGER) AS y0, CAST(floor(x1 / w * 1000) AS INTEGER) AS x1, CAST(floor(y1 / h * 1000) AS INTEGER) AS y1 FROM o WHERE n <= 40""")
def model_boxes(spark, d):
    shown = pages.model_input(layout.ocr_items(_recognised(spark, d)), 40)
    one = shown.select("document_id", "page_number", F.explode(F.arrays_zip(F.col("item_ids").alias("i"), F.col("boxes").alias("b"))).alias("x"))
    return one.select("document_id", "page_number", F.col("x.i").alias("item_id"), *[F.col("x.b")[k].alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))])


_BOXES = f"""{_REGIONS}, bx AS (SELECT *, CASE ord % 4 WHEN 0 THEN ' Table ' WHEN 1 THEN 'CHART' WHEN 2 THEN 'logo' ELSE 'doc_title' END AS raw, row_number() OVER (PARTITION BY document_id, page_number ORDER BY ord) - 1 AS pos FROM regions),
  ty AS (SELECT *, lower(trim(raw)) AS label, CASE ord % 4 WHEN 0 THEN 'table' WHEN 1 THEN 'figure' ELSE 'text_block' END AS kind FROM bx WHERE ord % 4 <> 2 AND pos % 9 <> 7),
  nm AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page_number, pos) AS n FROM ty)"""


def _detected(spark, d):
    """A detector's boxes: a quarter of the labels unknown, some boxes of three numbers, some twice."""
    from pyspark.sql import Window as W

    label = F.when(F.col("ord") % 4 == 0, " Table ").when(F.col("ord") % 4 == 1, "CHART").when(F.col("ord") % 4 == 2, "logo").otherwise("doc_title")
    b = F.col("bbox")
    rows = _regions(spark, d).withColumn("pos", (F.row_number().over(W.partitionBy("document_id", "page_number").orderBy("ord")) - 1).cast("int"))
    four = F.when(F.col("pos") % 9 == 7, F.array(b.x0, b.y0, b.x1)).otherwise(F.array(b.x0, b.y0, b.x1, b.y1))
    return rows.select("document_id", "page_number", "pos", label.alias("label"), F.lit(0.5).alias("score"), four.alias("coordinate"))


@query(f"WITH {_BOXES} SELECT document_id, 'region_' || n AS region_id, kind AS region_type, page_number, label, x0, y0, x1, y1 FROM nm QUALIFY row_number() OVER (PARTITION BY document_id, page_number, kind, round_even(x0, 1), round_even(y0, 1), round_even(x1, 1), round_even(y1, 1) ORDER BY n) = 1")
def detected_regions(spark, d):
    got = layout.detected_regions(_detected(spark, d))
    return got.select("document_id", "region_id", "region_type", "page_number", "label", "bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1")


@query(f"WITH {_BOXES} SELECT document_id, page_number, CASE ord % 4 WHEN 0 THEN 'table' WHEN 1 THEN 'figure' WHEN 3 THEN 'text_block' END AS region_type, lower(trim(raw)) AS label, count(*) AS n FROM bx GROUP BY ALL")
def label_histogram(spark, d):
    return layout.label_counts(_detected(spark, d))


@query(f"""WITH {base._BLOCKS}, pg AS (SELECT document_id, page_number, string_agg(body, chr(10) ORDER BY o) AS t FROM bn GROUP BY ALL)
  SELECT document_id, md5(string_agg(t, chr(10) || chr(10) ORDER BY page_number)) AS text_md5, count(*) AS n_pages FROM pg GROUP BY document_id""")
def document_text(spark, d):
    made = base._made_blocks(spark, d, _regions(spark, d))
    own = layout.page_texts(made)
    whole = layout.document_texts(own)
    return whole.join(pages.index_summary(own), "document_id").select("document_id", F.md5("full_ordered_text").alias("text_md5"), F.col("n_chunks").alias("n_pages"))


@query("""SELECT o_orderkey AS doc_id, CAST(o_custkey % 2000 + 1 AS INTEGER) AS image_width, CAST(o_orderkey % 3000 + 70000 AS INTEGER) AS image_height FROM orders WHERE o_orderkey % 3 <> 0""")
def image_pages(spark, d):
    """Images as their own one page; every third file isn't one."""
    o = _t(spark, d, "orders")
    four = lambda c: F.lpad(F.hex(c.cast("int")), 8, "0")
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), four(F.col("o_custkey") % 2000 + 1), four(F.col("o_orderkey") % 3000 + 70000))
    files = o.select(
        F.col("o_orderkey").cast("string").alias("document_id"),
        F.when(F.col("o_orderkey") % 3 != 0, F.unhex(png)).otherwise(F.encode(F.lit("%PDF-1.7 and so on and on"), "UTF-8")).alias("content"),
    )
    return pages.ImagePages().render(files).select(F.col("document_id").cast("long").alias("doc_id"), "image_width", "image_height")


@query(f"""WITH {_REGIONS}, a AS (SELECT *, CASE WHEN page_number % 4 = 0 THEN 'missing_page_image' WHEN page_number % 4 = 1 THEN 'crop_open_failed' END AS issue FROM regions WHERE region_type IN ('table', 'figure'))
  SELECT document_id, region_id, CASE WHEN issue IS NULL THEN 'crops/' || region_type || 's/' || region_id || '.png' END AS crop_path, issue FROM a""")
def crop_images(spark, d):
    regions = _regions(spark, d)
    seen = regions.select("document_id", "page_number").distinct().withColumns({"image_width": F.lit(4800), "image_height": F.lit(6400), "page_image_path": F.when(F.col("page_number") % 4 != 0, "p.png"), "image": F.when(F.col("page_number") % 4 != 1, F.encode(F.lit("img"), "UTF-8"))})
    assets = layout.crop_assets(regions, seen.drop("image"))
    cut = F.concat(F.col("image"), F.encode(F.to_json("box"), "UTF-8"))
    return pages.crops(assets, seen, cut).select("document_id", "region_id", "crop_path", "issue")


@query(f"""WITH {base._BLOCKS}, iss AS (SELECT document_id, count(*) FILTER (o % 3 = 0) AS w, count(*) FILTER (o % 3 = 1) AS e, count(*) AS n FROM bn GROUP BY ALL)
  SELECT r.document_id, n_regions, coalesce(n_blocks, 0) AS n_blocks, coalesce(n, 0) AS n_issues, coalesce(w, 0) AS n_warnings, coalesce(e, 0) AS n_errors FROM (SELECT document_id, count(*) AS n_regions FROM regions GROUP BY ALL) r LEFT JOIN (SELECT document_id, count(*) AS n_blocks FROM bn GROUP BY ALL) b USING (document_id) LEFT JOIN iss USING (document_id)""")
def processing_summary(spark, d):
    regions = _regions(spark, d)
    made = base._made_blocks(spark, d, regions)
    level = F.when(F.col("reading_order") % 3 == 0, "warning").when(F.col("reading_order") % 3 == 1, "error").otherwise("info")
    return pages.processing_summary(regions.select("document_id").distinct(), regions=regions, blocks=made, issues=made.select("document_id", level.alias("level")))


@query("SELECT count(*) AS documents, CAST(sum(n_chars % 40) AS BIGINT) AS pages, CAST(sum(n_chars % 90) AS BIGINT) AS chunks, round(sum(n_chars % 7 * 0.5), 4) AS seconds, round(sum(n_chars % 7 * 0.5) / greatest(sum(n_chars % 40), 1), 6) AS seconds_per_page, round(sum(n_chars % 90) / greatest(sum(n_chars % 40), 1), 6) AS chunks_per_page FROM documents")
def throughput(spark, d):
    n = F.col("n_chars")
    runs = _t(spark, d, "documents").select((n % 40).cast("long").alias("pages"), (n % 90).cast("long").alias("chunks"), (n % 7 * F.lit(0.5)).cast("double").alias("seconds"))
    got = pages.throughput(runs)
    return got.select(
        "documents",
        "pages",
        "chunks",
        F.round("seconds", 4).alias("seconds"),
        F.round("seconds_per_page", 6).alias("seconds_per_page"),
        F.round("chunks_per_page", 6).alias("chunks_per_page"),
    )


# ---- chunks and their index

_CHUNKED = """ck AS (SELECT doc_id, [CAST(k AS VARCHAR) FOR k IN range(doc_id % 4, doc_id % 4 + 3)] AS ids FROM documents), rg AS (SELECT k, CAST(k AS VARCHAR) AS region_id, CASE k % 3 WHEN 0 THEN 'table' WHEN 1 THEN 'figure' ELSE 'text_block' END AS kind, CASE WHEN k % 3 < 2 THEN 'crops/' || k END AS crop, CASE WHEN k % 2 = 1 THEN 'title ' || k END AS ti, CASE WHEN k = 3 THEN 'sub' END AS su FROM range(5) t(k))"""


@query(f"""WITH {_CHUNKED}, j AS (SELECT doc_id, i.*, rg.* FROM (SELECT doc_id, unnest(ids) AS rid, generate_subscripts(ids, 1) AS pos FROM ck) i JOIN rg ON rg.region_id = i.rid)
  SELECT doc_id, array_to_string(list_sort(list_distinct(list(kind))), ',') AS region_types, coalesce(string_agg(crop, ',' ORDER BY pos), '') AS crop_references, coalesce(string_agg(CASE WHEN crop IS NOT NULL THEN 'asset_' || region_id END, ',' ORDER BY pos), '') AS crop_asset_ids,
    arg_min(ti, pos) FILTER (ti IS NOT NULL) AS parent_title, arg_min(struct_pack(s := su), pos) FILTER (ti IS NOT NULL).s AS parent_subtitle FROM j GROUP BY doc_id""")
def region_attributes(spark, d):
    """Three regions a chunk of which the last may be unknown."""
    k = F.col("doc_id") % 4
    chunks = _t(spark, d, "documents").select(
        F.lit("d").alias("document_id"),
        F.col("doc_id").alias("chunk_id"),
        F.transform(F.sequence(k, k + 2), lambda x: x.cast("string")).alias("source_region_ids"),
    )
    i = F.col("id")
    regions = spark.range(5).select(
        F.lit("d").alias("document_id"),
        i.cast("string").alias("region_id"),
        F.when(i % 3 == 0, "table").when(i % 3 == 1, "figure").otherwise("text_block").alias("region_type"),
        F.when(i % 3 < 2, F.concat(F.lit("crops/"), i.cast("string"))).alias("crop_path"),
        F.when(i % 2 == 1, F.concat(F.lit("title "), i.cast("string"))).alias("parent_title"),
        F.when(i == 3, "sub").alias("parent_subtitle"),
    )
    got = chunking.with_region_attributes(chunks, regions)
    lists = [F.array_join(c, ",").alias(c) for c in ("region_types", "crop_references", "crop_asset_ids")]
    return got.select(F.col("chunk_id").alias("doc_id"), *lists, "parent_title", "parent_subtitle")


@query(f"""WITH t AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 'page ' || "text" WHEN doc_id % 3 = 1 THEN '' END AS pc, CASE WHEN doc_id % 10 = 0 THEN '  ' ELSE "text" END AS body FROM documents), k AS (SELECT *, coalesce(nullif(pc, ''), body) AS tx FROM t)
  SELECT doc_id, md5(tx) AS text_md5, CASE WHEN doc_id % 4 = 0 THEN 'own' ELSE lang END AS document_id, CASE WHEN doc_id % 5 <> 0 THEN source END AS source_filename, CAST(doc_id % 9 AS VARCHAR) AS page_number, CASE WHEN doc_id % 4 = 0 THEN 'x' END AS extra, '["r' || doc_id || '"]' AS regions FROM k WHERE length({base._STRIP.format('tx')}) > 0""")
def chunk_records(spark, d):
    """page_content before text, the metadata's own values before the columns', nulls dropped, blank chunks passed over."""
    i = F.col("doc_id")
    chunks = _t(spark, d, "documents").select(
        i.alias("chunk_id"),
        F.when(i % 10 == 0, "  ").otherwise(F.col("text")).alias("text"),
        F.when(i % 3 == 0, F.concat(F.lit("page "), "text")).when(i % 3 == 1, "").alias("page_content"),
        F.col("lang").alias("document_id"),
        F.when(i % 5 != 0, F.col("source")).alias("source_filename"),
        (i % 9).alias("page_number"),
        F.when(i % 4 == 0, F.create_map(F.lit("document_id"), F.lit("own"), F.lit("extra"), F.lit("x"), F.lit("gone"), F.lit(None).cast("string"))).alias("metadata"),
        F.array(F.concat(F.lit("r"), i.cast("string"))).alias("source_region_ids"),
    )
    m = F.col("metadata")
    return chunking.index_records(chunks).select(
        F.col("chunk_id").alias("doc_id"),
        F.md5("text").alias("text_md5"),
        *[m[c].alias(c) for c in ("document_id", "source_filename", "page_number", "extra")],
        m["source_region_ids"].alias("regions"),
    )


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 1 WHEN doc_id % 4 = 2 THEN 2 ELSE 0 END AS n, CASE WHEN doc_id % 4 = 1 THEN 'r' || doc_id WHEN doc_id % 4 = 2 THEN 'a' END AS first FROM documents")
def json_lists(spark, d):
    """A lone string for a list, a list, null, and no object."""
    i = F.col("doc_id").cast("string")
    raw = F.when(F.col("doc_id") % 4 == 0, '{"ids": null}').when(F.col("doc_id") % 4 == 1, F.concat(F.lit('{"ids": "r'), i, F.lit('"}'))).when(F.col("doc_id") % 4 == 2, '{"ids": ["a", "b"]}').otherwise("none")
    got = _t(spark, d, "documents").select("doc_id", L.string_list(raw, "ids").alias("x"))
    return got.select("doc_id", F.size("x").alias("n"), F.try_element_at("x", F.lit(1)).alias("first"))


# ---- the store

@query("""WITH a AS (SELECT conv_id * 1000 + turn AS request_id, conv_id % 5 AS user_id, coalesce("text", '') AS question, CASE WHEN turn % 3 = 0 THEN NULL WHEN turn % 3 = 1 THEN conv_id ELSE conv_id + 1 END AS conversation_id FROM conversations WHERE role = 'user'),
  c AS (SELECT DISTINCT conv_id AS id, conv_id % 5 AS user_id FROM conversations), ok AS (SELECT a.*, c.user_id IS NOT DISTINCT FROM a.user_id OR a.conversation_id IS NULL AS fine FROM a LEFT JOIN c ON c.id = a.conversation_id)
  SELECT request_id, CASE WHEN NOT fine THEN 'refused' WHEN conversation_id IS NULL THEN 'opened' ELSE 'continued' END AS outcome, CASE WHEN fine AND conversation_id IS NULL THEN question[1:120] END AS title,
    CASE WHEN NOT fine THEN 0 WHEN request_id % 7 = 0 THEN 1 ELSE 2 END AS n_messages FROM ok""")
def ask_in_conversation(spark, d):
    """Requests that open a conversation, go on in their own, or name another user's; every seventh answer fails."""
    c = _t(spark, d, "conversations")
    known = c.select("conv_id").distinct().select(
        F.col("conv_id").cast("string").alias("id"),
        (F.col("conv_id") % 5).alias("user_id"),
        F.lit("t").alias("title"),
        F.lit(0).alias("created_at"),
    )
    old = spark.createDataFrame([], "id string, conversation_id string, role string, content string, created_at int")
    t = F.col("turn") % 3
    asked = c.where("role = 'user'").select(
        (F.col("conv_id") * 1000 + F.col("turn")).cast("string").alias("request_id"),
        (F.col("conv_id") % 5).alias("user_id"),
        F.coalesce("text", F.lit("")).alias("question"),
        F.when(t == 1, F.col("conv_id")).when(t == 2, F.col("conv_id") + 1).cast("string").alias("conversation_id"),
        F.lit(1).alias("created_at"),
    )
    answers = asked.where(F.col("request_id").cast("long") % 7 != 0).select("request_id", F.lit("a").alias("answer"), F.lit(2).alias("answered_at"))
    conversations, messages, refused = store.asked_in_conversations(known, old, asked, answers)
    opened = conversations.join(asked.select("request_id", store.object_uuid(F.col("request_id")).alias("id")), "id").select("request_id", "title", F.lit(True).alias("opened"))
    names = asked.select("request_id", F.explode(F.array(*[store.object_uuid(F.concat(F.lit(f"{r}:"), "request_id")) for r in ("user", "assistant")])).alias("id"))
    n = names.join(messages.select("id"), "id").groupBy("request_id").agg(F.count("*").cast("int").alias("n"))
    both = asked.select("request_id").join(opened, "request_id", "left").join(refused.select("request_id", F.lit(True).alias("no")), "request_id", "left").join(n, "request_id", "left")
    outcome = F.when(F.col("no"), "refused").when(F.col("opened"), "opened").otherwise("continued")
    return both.select(F.col("request_id").cast("long").alias("request_id"), outcome.alias("outcome"), "title", F.coalesce("n", F.lit(0)).alias("n_messages"))


@query("""SELECT c_custkey AS id, lower(c_name) AS email, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 4 = 0 THEN 'old' WHEN c_custkey % 3 = 0 THEN 'new' END AS oauth_provider FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey + 1000000, lower(c_name), 'new' FROM customer WHERE c_custkey % 2 = 1 AND c_custkey % 3 = 0""")
def outside_sign_in(spark, d):
    c, k = _t(spark, d, "customer"), F.col("c_custkey")
    users = c.where("c_custkey % 2 = 0").select(
        k.alias("id"),
        F.lower("c_name").alias("email"),
        F.when(k % 4 == 0, "old").alias("oauth_provider"),
        F.when(k % 4 == 0, "s").alias("oauth_sub"),
    )
    signed = c.where("c_custkey % 3 = 0").select(
        (k + 1_000_000).alias("id"),
        F.concat(F.lit(" "), "c_name").alias("email"),
        F.lit("new").alias("oauth_provider"),
        F.lit("t").alias("oauth_sub"),
    )
    return store.outside_sign_in(users, signed).select("id", "email", "oauth_provider")


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey % 4 < 2 AND c_custkey % 3 = 0")
def active_users(spark, d):
    k = F.col("c_custkey")
    users = _t(spark, d, "customer").select(k.alias("id"), F.when(k % 4 < 2, F.lit(True)).when(k % 4 == 2, F.lit(False)).alias("is_active"))
    return store.active_users(users, users.where("id % 3 = 0").select("id")).select("id")


@query("SELECT sha256('t' || c_custkey) AS token_hash, c_custkey AS user_id FROM customer WHERE c_custkey % 3 <> 0")
def log_out(spark, d):
    k = F.col("c_custkey")
    tokens = _t(spark, d, "customer").select(store.token_hash(F.concat(F.lit("t"), k.cast("string"))).alias("token_hash"), k.alias("user_id"))
    return store.log_out(tokens, _t(spark, d, "customer").where("c_custkey % 3 = 0").select(F.concat(F.lit("t"), k.cast("string")).alias("token")))


@query("SELECT doc_id, lang FROM documents WHERE lang = 'de'")
def user_scope(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", "lang", F.col("lang").alias("user_id"))
    return store.scoped_to_user(rows, "de").select("doc_id", "lang")


@query("SELECT DISTINCT label AS document_id FROM embeddings WHERE label % 2 = 0")
def described_documents(spark, d):
    index = _t(spark, d, "embeddings").select(F.col("label").alias("document_id"))
    wide = F.when(F.col("document_id") % 2 == 0, F.array(F.lit(1.0)))
    found = index.distinct().withColumn("summary_embedding", wide).unionByName(spark.range(5).select((F.col("id") + 100_000).alias("document_id"), F.array(F.lit(1.0)).alias("summary_embedding")))
    return retrieval.described(index, found).select("document_id")
