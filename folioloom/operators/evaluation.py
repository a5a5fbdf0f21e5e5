"""Retrieval metrics and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioloom.operators.retrieval import QUERY_BLOCK


def containing(docs: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, doc_id) of each text of docs (doc_id, text) that contains a question of questions (query_id, question) as it stands.

    A text that does has all words of the question between its first and last space, so texts meet questions on the longest of
    these; only questions without one are looked for in every text.
    """
    inner = F.expr("filter(slice(split(question, ' '), 2, greatest(size(split(question, ' ')) - 2, 0)), w -> w <> '')")
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    asked = questions.where("question is not null").select("query_id", "question", longest.alias("word"))
    few = questions.count() <= QUERY_BLOCK
    small = F.broadcast if few else lambda df: df
    words = F.explode(F.array_distinct(F.split("text", " "))).alias("word")
    if few:  # the texts stay where they are
        near = docs.select("doc_id", "text", words).join(small(asked.where("word is not null")), "word")
    else:
        pairs = docs.select("doc_id", words).join(asked.select("query_id", "word"), "word").select("query_id", "doc_id").distinct()
        near = pairs.join(docs, "doc_id").join(asked, "query_id")
    rest = docs.join(small(asked.where("word is null")), F.col("text").contains(F.col("question")))
    return near.where(F.col("text").contains(F.col("question"))).select("query_id", "doc_id").unionByName(rest.select("query_id", "doc_id"))


def hits(retrieved: Column, relevant: Column) -> Column:
    return F.filter(retrieved, lambda x: F.array_contains(relevant, x))


def hit_rate(retrieved: Column, relevant: Column) -> Column:
    return F.when(F.size(hits(retrieved, relevant)) > 0, 1.0).otherwise(0.0)


def reciprocal_rank(retrieved: Column, relevant: Column) -> Column:
    flags = F.transform(retrieved, lambda x: F.array_contains(relevant, x))
    at = F.array_position(flags, F.lit(True))
    return F.when(at > 0, 1.0 / at).otherwise(0.0)


def precision(retrieved: Column, relevant: Column) -> Column:
    """Hits, repeats counted, among what was retrieved; 0 if nothing was."""
    return F.when(F.size(retrieved) > 0, F.size(hits(retrieved, relevant)) / F.size(retrieved)).otherwise(0.0)


def recall(retrieved: Column, relevant: Column) -> Column:
    """Hits, repeats counted, over the distinct relevant ones; 0 if none is relevant."""
    own = F.array_distinct(relevant)
    return F.when(F.size(own) > 0, F.size(hits(retrieved, relevant)) / F.size(own)).otherwise(0.0)


def score(results: DataFrame, labels: DataFrame) -> DataFrame:
    """query_id and four metrics of results (query_id, rank, chunk_id) for each question of labels (query_id, relevant); null
    where it has no labels."""
    got = results.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x.chunk_id).alias("got"))
    kind = results.schema["chunk_id"].dataType.simpleString()
    both = labels.join(got, "query_id", "left").withColumn("got", F.coalesce("got", F.array().cast(f"array<{kind}>")))
    known = F.size("relevant") > 0
    metric = lambda f: F.when(known, f(F.col("got"), F.col("relevant")))
    return both.select("query_id", metric(hit_rate).alias("hit_rate"), metric(reciprocal_rank).alias("mrr"), metric(precision).alias("precision_at_k"), metric(recall).alias("recall_at_k"))


def summary(scores: DataFrame, metrics: tuple[str, ...] = ("hit_rate", "mrr", "precision_at_k", "recall_at_k")) -> DataFrame:
    """metric, mean (four decimals) over the questions that have it, passes (half or more)."""
    long = scores.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics])).alias("x")).select("x.*")
    return long.groupBy("metric").agg(F.bround(F.avg("v"), 4).alias("mean")).withColumn("passes", F.coalesce(F.col("mean") >= 0.5, F.lit(False)))


def latency(values: DataFrame, key: str, value: str) -> DataFrame:
    """key, n, mean, median, p95, p99, min, max, stdev of values. Percentiles are the element int(n p / 100) of the sorted values,
    the first at least, exact at any size: found by rank, not by collecting a key's values."""
    from pyspark.sql import Window as W

    w = W.partitionBy(key)
    ranked = values.where(F.col(value).isNotNull()).select(key, F.col(value).cast("double").alias("v")).withColumn("n", F.count("*").over(w)).withColumn("r", F.row_number().over(w.orderBy("v")))
    at = lambda p: F.max(F.when(F.col("r") == F.greatest(F.lit(1), F.floor(F.col("n") * p / 100)), F.col("v")))
    mid = F.avg(F.when((F.col("r") == F.floor((F.col("n") + 1) / 2)) | (F.col("r") == F.floor((F.col("n") + 2) / 2)), F.col("v")))
    return ranked.groupBy(key).agg(
        F.count("*").alias("n"),
        F.avg("v").alias("mean"),
        mid.alias("median"),
        at(95).alias("p95"),
        at(99).alias("p99"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
        F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("stdev"),
    )


def bars(means: DataFrame, redundant: tuple[str, ...] = ()) -> DataFrame:
    """(metric, line) of means (metric, mean): a bar of twentieths, and a warning on metrics that say nothing new."""
    warning = F.when(F.col("metric").isin(*redundant), " (redundant: one label a question)").otherwise("") if redundant else F.lit("")
    bar = F.expr("repeat('█', cast(floor(mean * 20) as int))")
    return means.select("metric", F.concat("metric", F.lit(" "), F.format_string("%.3f", "mean"), F.lit(" "), bar, warning).alias("line"))


def report_lines(results: DataFrame, means: DataFrame, redundant: tuple[str, ...] = ()) -> DataFrame:
    """(n, line), to be sorted by n: bars() of means, then of each of results (n, question, answer, and a column a score) its question,
    scores and the opening of its answer."""
    scores = [c for c in results.columns if c not in ("n", "question", "answer")]
    shown = F.concat_ws("  ", *[F.when(F.col(c).isNotNull(), F.format_string(f"{c}=%.2f", F.col(c).cast("double"))) for c in scores])
    each = F.array(
        F.format_string("Q%02d: %s", F.col("n").cast("int"), F.substring("question", 1, 60)), F.concat(F.lit("  "), shown), F.concat(F.lit("  "), F.substring(F.coalesce("answer", F.lit("")), 1, 120))
    )
    lines = results.select(F.format_string("1:%012d", F.col("n").cast("long")).alias("a"), F.posexplode(each).alias("i", "line"))
    return bars(means, redundant).select(F.concat(F.lit("0:"), "metric").alias("n"), "line").unionByName(lines.select(F.concat("a", F.lit(":"), F.col("i").cast("string")).alias("n"), "line"))


def single_label(labels: DataFrame) -> DataFrame:
    """single, one row: no question of labels (relevant) has more than one."""
    return labels.agg(F.coalesce(F.max(F.size("relevant")) <= 1, F.lit(True)).alias("single"))


def report(run: str, means: dict[str, float], rows: list[dict], single_label: bool = False) -> str:
    """The evaluation as text: a bar of twentieths a metric, then each question's scores and the opening of its answer."""
    extra = {"precision_at_k", "recall_at_k"} if single_label else set()
    width = max(map(len, means), default=0)
    out = [f"Evaluation of {run}", ""]
    out += [f"{k:<{width}} {v:.3f} {'█' * int(v * 20)}" + " (redundant: one label a question)" * (k in extra) for k, v in means.items()]
    for i, r in enumerate(rows, 1):
        out += ["", f"Q{i:02d}: {r['question'][:60]}", "  " + "  ".join(f"{k}={v:.2f}" for k, v in r["scores"].items()), f"  {r['answer'][:120]}"]
    return "\n".join(out)
