"""Answering a table of questions in one job: retrieve, rerank, route, answer; and its evaluation."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioloom.functions import text as T
from folioloom.operators import evaluation, models, ports, retrieval
from folioloom.sources import files
from folioloom.sources.files import Settings


def source_payload(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, rank, chunk_id, document_id, page_number, source_filename, region_ids, crop_asset_ids, score, to four
    decimals, of hits (query_id, rank, document_id, chunk_id, score), lists empty where chunks have none."""
    none = F.array().cast("array<string>")
    known = chunks.select(
        "document_id",
        "chunk_id",
        "page_number",
        "source_filename",
        F.coalesce("source_region_ids", none).alias("region_ids"),
        F.coalesce("crop_asset_ids", none).alias("crop_asset_ids"),
    )
    return hits.withColumn("score", F.bround("score", 4)).join(known, ["document_id", "chunk_id"])


def context_texts(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, rank, context: the text of each hit's chunk, by document and chunk; hits without one have no row."""
    return hits.join(chunks.select("document_id", "chunk_id", F.col("text").alias("context")), ["document_id", "chunk_id"]).select("query_id", "rank", "context")


@dataclass(frozen=True)
class Ask:
    """corpus: (chunk_id, ord, text, embedding, document_id, region_types, parent_title, parent_subtitle); sparse and dense: indexes of it,
    where they are kept."""

    corpus: DataFrame
    embedder: ports.Embedder = field(default_factory=ports.HashedEmbedder)
    model: ports.TextModel = field(default_factory=ports.ExtractiveModel)
    settings: Settings = field(default_factory=Settings)
    sparse: retrieval.Searcher | None = None
    dense: retrieval.Searcher | None = None

    def retrieve(self, questions: DataFrame) -> DataFrame:
        """query_id, rank, chunk_id, score of questions (query_id, question): three times top_k hits, hybrid, lexically
        reranked, the type asked for first, cut to top_k."""
        k = self.settings.top_k
        asked = self.embedder.embed(questions.select("query_id", "question"), "question", "q")
        found = retrieval.hybrid(self.corpus, asked, 3 * k, sparse=self.sparse, dense=self.dense)
        known = found.join(self.corpus.select("chunk_id", "text", "region_types"), "chunk_id").join(questions.select("query_id", "question"), "query_id")
        return retrieval.put_type_first(retrieval.rerank_lexically(known)).where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score")

    def route(self, questions: DataFrame, hits: DataFrame, chunks: DataFrame, summaries: DataFrame) -> DataFrame:
        """query_id, table_regions, figure_regions, use_table_agent, use_figure_agent: regions of the hits that have a summary
        (document_id, region_id, region_type), and whether the question calls for their specialist."""
        ids = hits.join(
            chunks.select("chunk_id", "document_id", F.explode("source_region_ids").alias("region_id")),
            "chunk_id",
        ).join(summaries.select("document_id", "region_id", "region_type"), ["document_id", "region_id"])
        of = lambda kind: F.sort_array(F.collect_set(F.when(F.col("region_type") == kind, F.col("region_id"))))
        by = ids.groupBy("query_id").agg(of("table").alias("table_regions"), of("figure").alias("figure_regions"))
        none = F.array().cast("array<string>")
        both = questions.join(by, "query_id", "left").withColumn("table_regions", F.coalesce("table_regions", none)).withColumn("figure_regions", F.coalesce("figure_regions", none))
        q = F.col("question")
        return both.select(
            "query_id",
            "table_regions",
            "figure_regions",
            ((F.size("table_regions") > 0) & T.has_any(q, T.CALL_TABLE_TERMS)).alias("use_table_agent"),
            ((F.size("figure_regions") > 0) & T.has_any(q, T.CALL_FIGURE_TERMS)).alias("use_figure_agent"),
        )

    def answer(self, questions: DataFrame) -> DataFrame:
        """query_id, question, answer, sources: array<struct<rank, chunk_id, score>>, scores to four decimals."""
        hits = self.retrieve(questions).join(self.corpus.select("chunk_id", "text"), "chunk_id")
        by = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_id", F.bround("score", 4).alias("score"), "text"))).alias("s"))
        both = questions.select("query_id", "question").join(by, "query_id", "left")
        prompted = both.withColumn("prompt", ports.context_prompt(F.col("question"), F.coalesce(F.col("s.text"), F.array().cast("array<string>"))))
        got = self.model.answer(prompted, "prompt", "answer")
        return got.select(
            "query_id",
            "question",
            "answer",
            F.transform(
                F.coalesce("s", F.expr("array()").cast(both.schema["s"].dataType)),
                lambda x: F.struct(x["rank"].alias("rank"), x.chunk_id.alias("chunk_id"), x.score.alias("score")),
            ).alias("sources"),
        )

    def evaluate_run(self, questions: DataFrame, folder: str, judge: ports.TextModel | None = None) -> DataFrame:
        """metric, mean, passes of a run over questions (query_id, question, ground_truth, relevant), whose results, a row a question that
        was answered, summary and report are written to folder. A question on which the model fails is passed over: it has no
        row and counts in no mean. judge: a model that scores answers too. Each question is answered once: what follows reads the
        answers that were written."""
        spark = questions.sparkSession
        self.answer(questions).where("answer is not null").write.mode("overwrite").parquet(f"{folder}/answers")
        answered = spark.read.parquet(f"{folder}/answers")
        asked = questions.join(answered.select("query_id"), "query_id", "left_semi")
        hits = answered.select("query_id", F.explode("sources").alias("s")).select("query_id", "s.rank", "s.chunk_id", "s.score")
        scored = answered.join(questions.select("query_id", "ground_truth"), "query_id").join(evaluation.score(hits, asked.select("query_id", "relevant")), "query_id", "left")
        metrics = ["hit_rate", "mrr", "precision_at_k", "recall_at_k"]
        if judge is not None:
            texts = hits.join(self.corpus.select("chunk_id", "text"), "chunk_id").groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda x: x.text).alias("contexts"))
            shown = scored.join(texts, "query_id", "left").withColumn("contexts", F.coalesce("contexts", F.array().cast("array<string>")))
            scored = models.judge(judge, shown).drop("contexts")
            metrics += list(models.JUDGES)
        scored.write.mode("overwrite").parquet(f"{folder}/scores")
        results = spark.read.parquet(f"{folder}/scores")
        means = evaluation.summary(results, tuple(metrics)).where("mean is not null")
        single = evaluation.single_label(questions.select("relevant")).first().single
        shown = results.select(F.col("query_id").alias("n"), "question", "answer", *metrics)
        files.write_results(results, means, folder, evaluation.report_lines(shown, means, ("precision_at_k", "recall_at_k") if single else ()))
        return means

    def evaluate(self, questions: DataFrame) -> DataFrame:
        """Mean metrics of questions (query_id, question, relevant)."""
        return evaluation.summary(evaluation.score(self.retrieve(questions), questions.select("query_id", "relevant")))
