"""What language and picture models do around retrieval: prompts as columns, a port for the call, fallbacks for failures.

Every function takes the model as a port (ports.TextModel): a column of prompts to a column of answers, null where the call
failed. Where answers branch, as in correct(), or results are read more than once, give it a ledger.Ledger of the model: each prompt is
then called once and all see one answer. A question has at most some twenty passages, so what is gathered for one prompt is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioloom.functions import lenient as L
from folioloom.functions import text as T
from folioloom.operators import chunking, ports, retrieval

STRINGS = "array<string>"


def ask(model: ports.TextModel, df: DataFrame, instruction: str, body: Column, out: str = "raw") -> DataFrame:
    """df with out: the model's answer to instruction, a blank line and body; null where it failed."""
    prompted = df.withColumn("_prompt", F.concat(F.lit(instruction + "\n\n"), body))
    return model.answer(prompted, "_prompt", out).drop("_prompt")


def _lines(rows: Column, f) -> Column:
    return F.array_join(F.transform(rows, f), "\n\n")


def _none() -> Column:
    return F.array().cast(STRINGS)


# ---- questions

CLASSIFY = "Is this question simple or complex? Complex ones hold several questions or intents, or need several facts. Answer with that one word."
HYPOTHETICAL = "Write two to four sentences that a technical document might hold and that would answer this question."
DECOMPOSE = "Split this question into two to four that stand alone, one a line, numbered, and nothing else."


def classify(model: ports.TextModel, questions: DataFrame) -> DataFrame:
    """questions (query_id, question) with kind: complex where the answer holds that word, else simple."""
    raw = ask(model, questions, CLASSIFY, F.col("question"))
    return raw.withColumn("kind", F.when(F.lower("raw").contains("complex"), "complex").otherwise("simple")).drop("raw")


def hypothetical(model: ports.TextModel, questions: DataFrame) -> DataFrame:
    """questions with search: a made-up passage to search with, the question itself where the model fails."""
    raw = ask(model, questions, HYPOTHETICAL, F.col("question"))
    return raw.withColumn("search", F.coalesce(T.strip(F.col("raw")), F.col("question"))).drop("raw")


def decompose(model: ports.TextModel, questions: DataFrame) -> DataFrame:
    """questions with sub from 0 and search: each part, the question itself where there's none."""
    raw = ask(model, questions, DECOMPOSE, F.col("question"))
    parts = T.sub_queries(F.coalesce("raw", F.lit("")), F.col("question"))
    return raw.select(*questions.columns, F.posexplode(parts).alias("sub", "search"))


def searches(model: ports.TextModel, questions: DataFrame, first_only: bool = False) -> DataFrame:
    """questions with sub and search: the parts of complex ones (the first alone, where only one search can follow), a
    hypothetical passage for simple ones."""
    kinds, hard = classify(model, questions), F.col("kind") == "complex"
    # one prompt a question, by its kind: nothing branches off what the model said, so it says it once
    said = model.answer(kinds.withColumn("_prompt", F.concat(F.when(hard, DECOMPOSE).otherwise(HYPOTHETICAL), F.lit("\n\n"), F.col("question"))), "_prompt", "_raw")
    parts = T.sub_queries(F.coalesce("_raw", F.lit("")), F.col("question"))
    search = F.when(hard, parts).otherwise(F.array(F.coalesce(T.strip(F.col("_raw")), F.col("question"))))
    each = said.select(*questions.columns, F.posexplode(search).alias("sub", "search"))
    return each.where("sub = 0") if first_only else each


# ---- passages

def passages(hits: DataFrame, corpus: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """hits (query_id, rank, chunk_id, score) with the text, kind, section and content of corpus (document_id, chunk_id, text,
    region_types, parent_title, parent_subtitle, and source_region_ids where summaries are given): content is the summary of
    the chunk's first figure that has one, else its text."""
    own = corpus.join(hits.select("chunk_id").distinct(), "chunk_id", "left_semi")
    content = own.select("chunk_id", F.col("text").alias("content"))
    if summaries is not None:
        content = chunking.embedding_texts(own, summaries).withColumnRenamed("embed_text", "content")
    kind = T.passage_type(F.col("region_types"), F.col("text"))
    kind = F.when(kind.isin("TABLE", "FIGURE"), F.concat(kind, F.lit("_DESC"))).otherwise(kind)
    title, sub = (F.coalesce(c, F.lit("")) for c in ("parent_title", "parent_subtitle"))
    section = F.regexp_replace(F.concat(title, F.lit(" > "), sub), "^[ >]+|[ >]+$", "")
    known = own.select("chunk_id", "document_id", "text", "region_types", title.alias("title"), sub.alias("sub"), kind.alias("kind"), section.alias("section"))
    return hits.join(known, "chunk_id").join(content, "chunk_id")


def by_question(rows: DataFrame, *columns: str) -> DataFrame:
    """query_id and p: the question's passages in order of rank, as array<struct<rank, ...columns>>."""
    return rows.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", *columns))).alias("p"))


def candidate_block(p: Column, cap: int = 600) -> Column:
    """Candidates for a ranking, contents cut to cap characters."""
    return _lines(p, lambda x: F.concat(F.lit("[ID: "), x.chunk_id, F.lit("]\nType: "), x.kind, F.lit("\nSection: "), x.section, F.lit("\nContent: "), F.substring(x.content, 1, cap)))


def tagged_block(p: Column) -> Column:
    """Passages with tags that an answer can cite, and their scores to four decimals."""
    number = lambda v: F.regexp_replace(F.format_string("%.4f", v), r"(\.\d+?)0+$", "$1")
    return _lines(
        p,
        lambda x: F.concat(F.lit("[CHUNK "), x.chunk_id, F.lit(" | "), x.kind, F.lit(" | "), x.title, F.lit(" > "), x["sub"], F.lit(" | score: "), number(x.score), F.lit("]\n"), x.content),
    )


def source_block(p: Column) -> Column:
    """Passages as sources of a check: id, type and title, then the text."""
    kind = lambda x: F.when(F.array_contains(F.coalesce(x.region_types, _none()), "table"), "TABLE").when(F.array_contains(F.coalesce(x.region_types, _none()), "figure"), "FIGURE").otherwise("PROSE")
    return _lines(p, lambda x: F.concat(F.lit("[CHUNK "), x.chunk_id, F.lit(" | "), kind(x), F.lit(" | "), x.title, F.lit("]\n"), x.text))


RANK = 'Rank the candidates for the query, best first. Answer in JSON: {"ranking": [ids], "scores": {id: 0 to 1}, "dropped": [ids], "top_region_type": "prose|table|figure"}.'


def rerank(model: ports.TextModel, questions: DataFrame, found: DataFrame, drop_below: float = 0.3) -> DataFrame:
    """query_id, rank, chunk_id, score of passages() after the model's ranking; as they were where it fails, or drops all."""
    own = by_question(found, "chunk_id", "score", "kind", "section", "content").join(questions.select("query_id", "question"), "query_id")
    body = F.concat(
        F.lit("Query: "),
        "question",
        F.lit("\nIntent: "),
        T.query_type(F.col("question")),
        F.lit("\nCandidates: "),
        F.size("p").cast("string"),
        F.lit("\n\n"),
        candidate_block(F.col("p")),
    )
    verdict = L.ranking(F.coalesce("raw", F.lit("{}")), F.transform("p", lambda x: x.chunk_id)).alias("v")
    said = ask(model, own, RANK, body).select("query_id", "raw", "p", verdict).select("query_id", "raw", "v", F.explode("p").alias("c"))
    known = [F.when(F.col("raw").isNotNull(), F.col(f"v.{k}")).alias(k) for k in ("ranking", "scores", "dropped")]
    return retrieval.ranked_by(said.select("query_id", "c.rank", "c.chunk_id", "c.score", *known), drop_below)


SCORE = "How well does the passage answer the query? Answer in two lines, score: 0 to 1, and reason: one sentence."


def score_passages(model: ports.TextModel, questions: DataFrame, found: DataFrame) -> DataFrame:
    """query_id, chunk_id, score, reason of each passage by itself; its old score where the model fails."""
    own = found.withColumnRenamed("score", "old").join(questions.select("query_id", "question"), "query_id")
    known = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(other))
    visual = F.col("kind").isin("TABLE_DESC", "FIGURE_DESC")
    body = F.concat(
        F.lit("Query: "), "question", F.lit("\nType: "), "kind", F.lit("\nTitle: "), known("title", "N/A"), F.lit("\nSubtitle: "), known("sub", "N/A"), F.lit("\nDocument: "), F.coalesce("document_id", F.lit("unknown")),
        F.lit("\n\n"), F.substring(F.when(visual, F.col("text")).otherwise(F.col("content")), 1, 800), F.when(visual, F.concat(F.lit("\n\nDescription:\n"), "content")).otherwise(""),
    )
    said = ask(model, own, SCORE, body)
    score = F.when(F.col("raw").isNull(), F.col("old")).otherwise(L.single_score(F.col("raw")))
    reason = F.when(F.col("raw").isNull(), "model unavailable").otherwise(L.single_reason(F.col("raw")))
    return said.select("query_id", "chunk_id", score.alias("score"), reason.alias("reason"))


COMPRESS = "Keep of each passage only what helps to answer the query, word for word and under its tag; drop noise of recognition, headers and boilerplate. Tables and figures stay whole."


def compress(model: ports.TextModel, questions: DataFrame, found: DataFrame, threshold: float = 0.5) -> DataFrame:
    """query_id, context of each question: its passages shortened, as they are where the model fails, empty without any."""
    own = questions.select("query_id", "question").join(by_question(found, "chunk_id", "kind", "title", "sub", "score", "content"), "query_id", "left")
    block = tagged_block(F.col("p"))
    some = own.where("p is not null").withColumn("block", block)
    said = ask(model, some, COMPRESS, F.concat(F.lit("Query: "), "question", F.lit(f"\nDrop below: {threshold}\n\n"), "block"))
    none = own.where("p is null").select("query_id", F.lit("").alias("context"))
    return said.select("query_id", F.coalesce(T.strip(F.col("raw")), F.col("block")).alias("context")).unionByName(none)


# ---- answers

SPECIALIST = "You answer from descriptions of {}s alone. Say so if they don't suffice."
SYNTHESIS = "Answer from the evidence and what the specialists say alone, and cite chunk ids and pages."
NO_DOCUMENTS = "No relevant documents found in the corpus for this question."


def specialists(model: ports.TextModel, questions: DataFrame, routed: DataFrame, summaries: DataFrame) -> DataFrame:
    """query_id, agent, output, region_ids: what the table and the figure specialist say of the regions routed to them
    (query_id, table_regions, figure_regions, use_table_agent, use_figure_agent). summaries: (region_id, region_type,
    page_number, summary_text)."""
    found = None
    for kind in ("table", "figure"):
        called = routed.where(F.col(f"use_{kind}_agent")).select("query_id", F.explode(f"{kind}_regions").alias("region_id"))
        known = called.join(summaries.select("region_id", "region_type", "page_number", "summary_text"), "region_id")
        line = F.concat(F.lit("[region="), "region_id", F.lit(" page="), F.col("page_number").cast("string"), F.lit(" type="), "region_type", F.lit("]\n"), "summary_text")
        by = known.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("region_id", line.alias("line")))).alias("r")).join(questions.select("query_id", "question"), "query_id")
        said = ask(model, by, SPECIALIST.format(kind), F.concat(F.lit("Question: "), "question", F.lit("\n\nEvidence:\n"), _lines(F.col("r"), lambda x: x.line)))
        some = said.select("query_id", F.lit(kind).alias("agent"), T.strip(F.col("raw")).alias("output"), F.transform("r", lambda x: x.region_id).alias("region_ids"))
        found = some if found is None else found.unionByName(some)
    return found


def synthesise(model: ports.TextModel, questions: DataFrame, evidence: DataFrame, told: DataFrame) -> DataFrame:
    """query_id, answer from evidence (query_id, context) and what specialists told (query_id, agent, output, region_ids); a
    question without evidence has the answer that there's none."""
    line = F.concat(F.lit("["), "agent", F.lit(" agent regions="), F.array_join("region_ids", ", "), F.lit("]\n"), F.coalesce("output", F.lit("")))
    by = told.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("agent", line.alias("line")))).alias("s"))
    own = questions.select("query_id", "question").join(evidence, "query_id", "left").join(by, "query_id", "left")
    text = F.when(F.size("s") > 0, _lines(F.col("s"), lambda x: x.line)).otherwise("None")
    said = ask(model, own, SYNTHESIS, F.concat(F.lit("Question: "), "question", F.lit("\n\nEvidence:\n"), F.coalesce("context", F.lit("")), F.lit("\n\nSpecialists:\n"), text))
    return said.select("query_id", F.when(F.coalesce("context", F.lit("")) == "", NO_DOCUMENTS).otherwise(T.strip(F.col("raw"))).alias("answer"))


CHECK = 'Is each claim of the answer in the sources? Answer in JSON: {"claims": [{"claim_text", "status": "SUPPORTED|INFERRED|UNSUPPORTED", "source_chunk_ids", "note"}], "overall_verdict", "confidence_score", "recommended_action"}.'
CORRECT = "Rewrite the answer: drop or soften claims without support, hedge inferred ones, keep the rest word for word."


def check(model: ports.TextModel, questions: DataFrame, found: DataFrame, answers: DataFrame) -> DataFrame:
    """query_id, question, answer, sources, checked (lenient.FAITHFULNESS) of answers (query_id, answer); faithful where the
    model fails."""
    own = answers.join(questions.select("query_id", "question"), "query_id").join(by_question(found, "chunk_id", "region_types", "title", "text"), "query_id", "left")
    sourced = own.withColumn("sources", F.coalesce(source_block(F.col("p")), F.lit("")))
    said = ask(model, sourced, CHECK, F.concat(F.lit("Query: "), "question", F.lit("\n\nSources:\n"), "sources", F.lit("\n\nAnswer:\n"), "answer"))
    return said.select("query_id", "question", "answer", "sources", L.faithfulness(F.coalesce("raw", F.lit("{}"))).alias("checked"))


def problem_block(claims: Column) -> Column:
    bad = F.filter(claims, lambda c: c.status.isin("INFERRED", "UNSUPPORTED"))
    return _lines(bad, lambda c: F.concat(F.lit('Claim: "'), c.claim_text, F.lit('"\nStatus: '), c.status, F.lit("\nNote: "), F.coalesce(F.nullif(c.note, F.lit("")), F.lit("N/A"))))


def correct(model: ports.TextModel, checked: DataFrame) -> DataFrame:
    """query_id, answer of check() rows: rewritten where an action is recommended and a claim has a problem; as it was
    elsewhere, and where the model fails."""
    due = (F.col("checked.recommended_action") != "return_as_is") & L.needs_correction(F.col("checked"))
    body = F.concat(F.lit("Query: "), "question", F.lit("\n\nAnswer: "), "answer", F.lit("\n\nProblems:\n"), problem_block(F.col("checked.claims")), F.lit("\n\nSources:\n"), "sources")
    said = ask(model, checked.where(due), CORRECT, body).select("query_id", F.coalesce(T.strip(F.col("raw")), F.col("answer")).alias("answer"))
    return said.unionByName(checked.where(~due).select("query_id", "answer"))


# ---- evaluation

#: What each judge is shown and how much of a passage (none: all of it).
JUDGES = {
    "faithfulness": ("What share of the answer's claims do the passages support?", ("answer", "passages"), None),
    "answer_relevance": ("How well does the answer meet the question?", ("question", "answer"), None),
    "context_relevance": ("How relevant are the passages, taken together, to the question?", ("question", "passages"), 400),
    "context_recall": ("What share of the true answer's statements do the passages cover?", ("ground_truth", "passages"), 400),
    "answer_correctness": ("How far does the answer mean what the true answer means?", ("ground_truth", "answer"), None),
}


def judge(model: ports.TextModel, samples: DataFrame) -> DataFrame:
    """samples (question, answer, contexts, ground_truth) with a column a judge: the score of its JSON answer, 0 where it
    fails; null where it needs a true answer and there's none."""
    out = samples
    for name, (question, parts, cap) in JUDGES.items():
        shown = F.transform("contexts", lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.substring(c, 1, cap) if cap else c))  # noqa: B023
        text = {"passages": F.array_join(shown, "\n\n")}
        body = F.concat_ws("\n\n", *[F.concat(F.lit(p + ":\n"), text.get(p, F.coalesce(F.col(p) if p != "passages" else F.lit(""), F.lit("")))) for p in parts])
        said = ask(model, out, question + ' Answer in JSON: {"score": 0 to 1}.', body, "_raw")
        score = F.coalesce(F.get_json_object(F.coalesce(F.col("_raw"), F.lit("{}")), "$.score").try_cast("double"), F.lit(0.0))
        due = F.lit(True) if "ground_truth" not in parts else F.coalesce("ground_truth", F.lit("")) != ""
        out = said.withColumn(name, F.when(due, score)).drop("_raw")
    return out


WRITE_QUESTION = 'Write one specific question that only this passage answers, and its answer. Answer in JSON: {"question", "ground_truth"}.'


def write_questions(model: ports.TextModel, chunks: DataFrame, least: int = 100, cap: int = 1200) -> DataFrame:
    """question, ground_truth, relevant_chunk_ids, source_page of chunks (chunk_id, text, page_number) of `least` characters
    or more, cut to cap; those of which the model makes no question and answer have no row."""
    text = T.strip(F.coalesce("text", F.lit("")))
    long = chunks.select("chunk_id", "page_number", text.alias("text")).where(F.length("text") >= least)
    said = ask(model, long, WRITE_QUESTION, F.concat(F.lit("Passage:\n"), F.substring("text", 1, cap)))
    field = lambda k: T.strip(F.coalesce(F.get_json_object("raw", f"$.{k}"), F.lit("")))
    made = said.select(
        field("question").alias("question"),
        field("ground_truth").alias("ground_truth"),
        F.array(F.col("chunk_id").cast("string")).alias("relevant_chunk_ids"),
        F.col("page_number").alias("source_page"),
    )
    return made.where((F.col("question") != "") & (F.col("ground_truth") != ""))


# ---- documents

SECTION = 'Sum up this section. Answer in JSON: {"summary", "key_topics": [], "has_data": true or false, "section_type"}.'
DESCRIBE = 'Describe this document. Answer in JSON: {"summary", "topics": [], "doc_type", "domain", "well_structured", "visual_heavy", "data_heavy", "likely_questions": []}.'


def section_summaries(model: ports.TextModel, sections: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """sections (document_id, title, tables, charts, figures, page_start, flat_text) with summary, key_topics, has_data,
    section_type, and their defaults where the model gives none. findings: (document_id, title, finding) of pictures."""
    own = sections.withColumn("findings", F.lit(None).cast("string"))
    if findings is not None:
        by = findings.groupBy("document_id", "title").agg(F.array_join(F.sort_array(F.collect_list("finding")), " | ").alias("findings"))
        own = sections.join(by, ["document_id", "title"], "left")
    counts = F.format_string("Tables: %d, charts: %d, figures: %d", "tables", "charts", "figures")
    body = F.concat(F.lit("Title: "), "title", F.lit("\n"), counts, F.lit("\nText:\n"), F.substring("flat_text", 1, 800), F.lit("\nPictures: "), F.coalesce("findings", F.lit("none")))
    m = L.lenient_map(F.coalesce("raw", F.lit("{}")))
    said = ask(model, own, SECTION, body).withColumn("_m", m)
    return said.select(
        *sections.columns, F.coalesce(F.col("_m")["summary"], F.lit("")).alias("summary"), L.string_list(F.coalesce("raw", F.lit("{}")), "key_topics").alias("key_topics"),
        F.coalesce(F.col("_m")["has_data"] == "true", F.lit(False)).alias("has_data"), F.coalesce(F.col("_m")["section_type"], F.lit("unknown")).alias("section_type"),
    )


def descriptors(model: ports.TextModel, summed: DataFrame, documents: DataFrame, embedder: ports.Embedder | None = None) -> DataFrame:
    """document_id, summary, doc_type, domain, well_structured, visual_heavy, data_heavy, summary_embedding of documents
    (document_id, source_filename, page_count) from section_summaries(); the embedding is null where there's no summary."""
    line = F.concat(F.lit("["), "title", F.lit("] type="), "section_type", F.lit(" has_data="), F.col("has_data").cast("string"), F.lit(" | "), F.substring("summary", 1, 150))
    by = summed.groupBy("document_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_start", "title", line.alias("line")))), lambda x: x.line), "\n").alias("lines"),
        F.count("*").alias("n"),
        F.sum(F.col("tables") + F.col("charts") + F.col("figures")).alias("visuals"),
    )
    own = documents.join(by, "document_id", "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    body = F.concat(
        F.lit("File: "),
        F.coalesce("source_filename", F.lit("")),
        F.lit("\nPages: "),
        number("page_count"),
        F.lit("\nVisuals: "),
        number("visuals"),
        F.lit("\nSections: "),
        number("n"),
        F.lit("\n"),
        F.coalesce("lines", F.lit("")),
    )
    said = ask(model, own, DESCRIBE, body).withColumn("_m", L.lenient_map(F.coalesce("raw", F.lit("{}"))))
    flag = lambda k, other: F.coalesce(F.col("_m")[k] == "true", F.lit(other)).alias(k)
    word = lambda k, other: F.coalesce(F.col("_m")[k], F.lit(other)).alias(k)
    made = said.select(
        "document_id",
        word("summary", ""),
        word("doc_type", "unknown"),
        word("domain", "unknown"),
        flag("well_structured", True),
        flag("visual_heavy", False),
        flag("data_heavy", False),
    )
    embedded = (embedder or ports.HashedEmbedder()).embed(made, "summary", "summary_embedding")
    return embedded.withColumn("summary_embedding", F.when(F.col("summary") != "", F.col("summary_embedding")))


STRATEGY = (
    "Choose how to cut this document into chunks: semantic_section at its sections, where it's well structured; layout_aware so that tables and figures "
    "stay whole, where it's full of data; recursive_large with a wide overlap, where it's dense and loose; semantic_fixed otherwise. "
    'Answer in JSON: {"strategy", "chunk_size", "overlap", "keep_tables_intact", "reason"}.'
)


def choose_strategy(model: ports.TextModel | None, sections: DataFrame, described: DataFrame, chunk_size: int = 1800, overlap: int = 200) -> DataFrame:
    """document_id, strategy, chunk_size, overlap, keep_tables_intact, reason, override for each document of described (document_id,
    page_count, and what descriptors() gives), from its sections (document_id, tables, charts, figures, text_blocks): what the model
    says, and the defaults of semantic_fixed where it says nothing, fails or isn't there. Numbers that are none count as not said.
    Tables in more than half of the sections override it, and so does loose text in under three."""
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    total = sections.groupBy("document_id").agg(F.count("*").alias("n"), count("tables"), count("text_blocks"), F.coalesce(F.sum(F.col("figures") + F.col("charts")), F.lit(0)).alias("visuals"))
    own = described.join(total, "document_id", "left").fillna(0, ["n", "tables", "text_blocks", "visuals"])
    word = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(other))
    flag = lambda c, other: F.coalesce(F.col(c), F.lit(other)).cast("string")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    parts = (
        ("doc_type", word("doc_type", "unknown")), ("domain", word("domain", "unknown")), ("pages", number("page_count")), ("sections", number("n")), ("tables", number("tables")), ("figures", number("visuals")),
        ("text_blocks", number("text_blocks")), ("visual_heavy", flag("visual_heavy", False)), ("data_heavy", flag("data_heavy", False)), ("well_structured", flag("well_structured", True)),
    )
    profile = F.concat_ws(" ", *[F.concat(F.lit(f"{name}="), c) for name, c in parts])
    said = own.withColumn("raw", F.lit(None).cast("string")) if model is None else ask(model, own, STRATEGY, F.concat(F.lit("Profile:\n"), profile))
    m = said.withColumn("_m", L.lenient_map(F.coalesce("raw", F.lit("{}"))))
    told = lambda k: F.col("_m")[k]
    size, gap = F.coalesce(told("chunk_size").try_cast("int"), F.lit(chunk_size)), F.coalesce(told("overlap").try_cast("int"), F.lit(overlap))
    tabular = F.col("tables") > F.col("n") / 2
    loose = ~tabular & ~F.coalesce("well_structured", F.lit(True)) & (F.col("n") < 3)
    reason = F.when(F.col("raw").isNull(), "no answer").otherwise(F.coalesce(told("reason"), F.lit("chosen by the model")))
    return m.select(
        "document_id",
        F.when(tabular, "layout_aware").when(loose, "recursive_large").otherwise(F.coalesce(told("strategy"), F.lit("semantic_fixed"))).alias("strategy"),
        F.when(loose, F.greatest(size, F.lit(2000))).otherwise(size).alias("chunk_size"),
        gap.alias("overlap"),
        (tabular | F.coalesce(told("keep_tables_intact") == "true", F.lit(False))).alias("keep_tables_intact"),
        reason.alias("reason"),
        F.when(tabular, "table-dominant document").when(loose, "unstructured document with few sections").alias("override"),
    )


# ---- pictures

#: What a reading of a picture holds (fixed values).
READING = ("type", "summary", "key_finding", "data_extracted", "confidence", "retrieval_mode")


def read_visuals(model: ports.PictureModel, crops: DataFrame) -> DataFrame:
    """document_id, region_id, crop_path, page_number, parent_title, each of READING, null where the model leaves it out, and
    parse_error, of crops (document_id, region_id, region_type, page_number, crop_path, image, parent_title, parent_subtitle,
    flat_text): what a picture model reads in each, shown the section around it, its text up to 300 characters. A crop without an
    image, or on which the model fails, has no reading."""
    title, sub = F.coalesce(F.nullif("parent_title", F.lit("")), F.lit("untitled")), F.coalesce("parent_subtitle", F.lit(""))
    context = F.concat(
        F.lit("Section: "), title, F.lit("\nSubtitle: "), sub, F.lit("\nPage: "), F.coalesce(F.col("page_number").cast("string"), F.lit("")), F.lit("\nText: "), F.substring(F.coalesce("flat_text", F.lit("")), 1, 300),
        F.lit("\nAnswer in JSON: " + ", ".join(READING)),
    )
    said = model.describe(crops.where("image is not null").withColumn("_context", context), "image", "region_type", "_context", "_said").where("_said is not null")
    m = said.withColumn("_m", L.lenient_map(F.col("_said")))
    fields = [F.col("_m")[k].alias(k) for k in READING]
    return m.select("document_id", "region_id", "crop_path", "page_number", title.alias("parent_title"), *fields, (F.coalesce(F.col("_m")["parse_error"] == "true", F.lit(False))).alias("parse_error"))


def describe_pictures(model: ports.PictureModel, summaries: DataFrame) -> DataFrame:
    """summaries (region_id, region_type, summary_text, is_meaningful, crop_path, image) with what the picture model says of
    their crops: its text in the place of summary_text, or is_meaningful false where it says SKIP. Rows without an image, and
    those it fails on, stay as they are. The text so far is context, its first 400 characters, unless it's the stock sentence."""
    context = F.when(F.coalesce("summary_text", F.lit("")).startswith("Detected "), "").otherwise(F.substring(F.coalesce("summary_text", F.lit("")), 1, 400))
    said = model.describe(summaries.withColumn("_context", context), "image", "region_type", "_context", "_said")
    meaningful, text = ports.visual_answer(F.col("_said"))
    seen = F.col("image").isNotNull() & F.col("_said").isNotNull()
    made = said.withColumn("summary_text", F.when(seen & meaningful, text).otherwise(F.col("summary_text")))
    return made.withColumn("is_meaningful", F.when(seen & ~meaningful, F.lit(False)).otherwise(F.col("is_meaningful"))).select(summaries.columns)


def with_intelligence(summaries: DataFrame, read: DataFrame) -> DataFrame:
    """summaries with the picture model's findings (crop_path, finding) of the same crop in metadata as intelligence."""
    own = read.groupBy("crop_path").agg(F.max("finding").alias("_f"))
    added = F.map_from_arrays(F.array(F.lit("intelligence")), F.array("_f"))
    old = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    merged = F.when(F.col("_f").isNull(), F.col("metadata")).otherwise(F.map_concat(F.map_filter(old, lambda k, v: k != "intelligence"), added))
    return summaries.join(own, "crop_path", "left").withColumn("metadata", merged).select(summaries.columns)


# ---- asking

def answer_questions(model: ports.TextModel, questions: DataFrame, hits: DataFrame, corpus: DataFrame, summaries: DataFrame, routed: DataFrame) -> DataFrame:
    """query_id, answer of questions from hits: reranked, sent to specialists, compressed, answered, checked and corrected."""
    found = passages(hits, corpus, summaries)
    ranked = rerank(model, questions, found)
    kept = passages(ranked, corpus, summaries)
    told = specialists(model, questions, routed, summaries)
    answers = synthesise(model, questions, compress(model, questions, kept), told)
    return correct(model, check(model, questions, kept, answers))
