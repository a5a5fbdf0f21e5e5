"""Retrieval and ranking, for a table of questions at once: queries (query_id, ...), corpus (chunk_id, ord, ...)."""

from __future__ import annotations

from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioloom.functions import text as T
from folioloom.functions.vectors import cosine
from folioloom.sources.shared import new_folder

#: Queries up to this many are sent to every task; more are dealt out in blocks of about this many.
QUERY_BLOCK = 2_000


def _ranked(df: DataFrame, *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order)))


def scoped(corpus: DataFrame, documents: list | None, column: str = "document_id") -> DataFrame:
    """The rows of the documents asked for; None means all, an empty list none."""
    return corpus if documents is None else corpus.where(F.col(column).isin(list(documents)) if documents else F.lit(False))


#: Terms of questions that are looked up in the array of a chunk's tokens; more are joined with them.
ASKED_TERMS = 20_000
#: Rows of the corpus that a task of a dense search holds at most.
SHARD_ROWS = 65_536


def _matrix(column, width: int):
    """(rows of vectors filled up with zeros, their lengths); a missing component is 0."""
    import numpy as np

    lists = column.combine_chunks()
    size = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width))
    flat = np.nan_to_num(lists.flatten().to_numpy(zero_copy_only=False).astype(float), nan=0.0)
    row = np.repeat(np.arange(len(lists)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out, size


def _cosines(q, q_size, v, v_size):
    """Cosines of all rows of q with all of v over their common lengths, 0 without any; a zero norm counts as 1."""
    import numpy as np

    dots = q @ v.T
    norm = lambda m, n: np.where((x := np.sqrt((m[:, :n] ** 2).sum(axis=1))) > 0, x, 1.0)
    for n in np.unique(q_size):
        for m in np.unique(v_size):
            at = np.ix_(q_size == n, v_size == m)
            both = min(n, m)
            dots[at] = dots[at] / (norm(q[q_size == n], both)[:, None] * norm(v[v_size == m], both)) if both else 0.0
    return np.round(dots, 12)  # sums in another order tie alike


def _best(left, right, k: int):
    """query_id, chunk_id, ord, score: the k best rows of right (chunk_id, ord, v) for each of left (query_id, v), as Arrow tables."""
    import numpy as np
    import pyarrow as pa

    if not left.num_rows or not right.num_rows:
        none = lambda t, c: t.column(c).slice(0, 0)
        return pa.table({"query_id": none(left, "query_id"), "chunk_id": none(right, "chunk_id"), "ord": none(right, "ord"), "score": pa.array([], pa.float64())})
    lists = [t.column("v").combine_chunks() for t in (left, right)]
    width = max(int(np.diff(x.offsets.to_numpy()).max()) for x in lists)
    (q, q_size), (v, v_size) = _matrix(left.column("v"), width), _matrix(right.column("v"), width)
    order = right.column("ord").to_numpy()
    row, col, score = [], [], []
    for i in range(0, len(q), 256):
        found = _cosines(q[i : i + 256], q_size[i : i + 256], v, v_size)
        floor = np.partition(found, -k, axis=1)[:, -k] if found.shape[1] > k else np.full(len(found), -np.inf)
        r, c = np.nonzero(found >= floor[:, None])
        by = np.lexsort((order[c], -found[r, c], r))
        r, c = r[by], c[by]
        first = np.r_[True, r[1:] != r[:-1]]
        place_ = np.arange(len(r)) - np.maximum.accumulate(np.where(first, np.arange(len(r)), 0))
        keep = place_ < k
        row.append(r[keep] + i)
        col.append(c[keep])
        score.append(found[r[keep], c[keep]])
    row, col = pa.array(np.concatenate(row)), pa.array(np.concatenate(col))
    return pa.table({
        "query_id": left.column("query_id").take(row),
        "chunk_id": right.column("chunk_id").take(col),
        "ord": right.column("ord").take(col),
        "score": pa.array(np.concatenate(score)),
    })


def _scanned(queries, batches, k: int):
    """_best() of queries and the rows of batches, SHARD_ROWS at a time."""
    import pyarrow as pa

    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= SHARD_ROWS:
            yield from _best(queries, pa.Table.from_batches(held), k).to_batches()
            held, n = [], 0
    if n:
        yield from _best(queries, pa.Table.from_batches(held), k).to_batches()


def dense_top_k(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, chunk_id, score: the k highest cosines of each query (query_id, q) with corpus (chunk_id, ord,
    embedding), ties in the order of ord; rows without a vector on either side are left out.

    Up to QUERY_BLOCK queries are sent to every task, and the corpus is scanned where it lies. For more, the corpus is dealt into
    shards, queries into blocks, and each shard meets each block in one task. Either way a task makes matrix products with
    SHARD_ROWS of the corpus at a time, of which k rows a query go on: its memory is bounded whatever the number of either.
    """
    spark, kind, name = corpus.sparkSession, queries.schema["query_id"].dataType.simpleString(), corpus.schema["chunk_id"].dataType.simpleString()
    queries = queries.where("q is not null").select("query_id", F.col("q").cast("array<double>").alias("v"))
    corpus = corpus.where("embedding is not null").select("chunk_id", F.col("ord").cast("long").alias("ord"), F.col("embedding").cast("array<double>").alias("v"))
    out, asked = f"query_id {kind}, chunk_id {name}, ord long, score double", queries.count()
    if asked <= QUERY_BLOCK:
        sent = spark.sparkContext.broadcast(queries.toArrow())
        found = corpus.mapInArrow(lambda batches: _scanned(sent.value, batches, k), out)
        return _ranked(found, F.desc("score"), F.col("ord")).where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score")
    n = corpus.count()
    shards = max(1, -(-n // SHARD_ROWS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 512))
    blocks = max(1, -(-asked // QUERY_BLOCK))
    deal = lambda key, m: F.pmod(F.xxhash64(key), F.lit(m))
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    cells = shards * blocks
    held = corpus.select(each(blocks).alias("b"), "*").select((deal("chunk_id", shards) * blocks + F.col("b")).cast("int").alias("cell"), "chunk_id", "ord", "v")
    sent = queries.select(each(shards).alias("s"), "*").select((F.col("s") * blocks + deal("query_id", blocks)).cast("int").alias("cell"), "query_id", "v")
    place = lambda df: (df.repartitionById(cells, F.col("cell")) if cells <= 20_000 else df.repartition(20_000, "cell")).groupBy("cell")

    found = place(sent).cogroup(place(held)).applyInArrow(lambda left, right: _best(left, right, k), out)
    return _ranked(found, F.desc("score"), F.col("ord")).where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score")


def _exploded(corpus: DataFrame) -> DataFrame:
    """(chunk_id, dl, term): a row a token of corpus (chunk_id, text), and one of term '' a chunk. The length is taken below the
    explosion, not for each of its rows."""
    toks = corpus.select("chunk_id", T.tokens(F.coalesce("text", F.lit(""))).alias("toks")).withColumn("dl", F.size("toks"))
    return toks.select("chunk_id", "dl", F.explode(F.concat(F.array(F.lit("")), "toks")).alias("term"))


def token_index(corpus: DataFrame) -> DataFrame:
    """Postings (chunk_id, term, dl, tf) of corpus (chunk_id, text), and for each chunk one of term '' and tf 0: the table to
    write once, by term, and query often."""
    return _counted(_exploded(corpus))


def _counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("chunk_id", "term", "dl").agg(F.sum(F.when(F.col("term") == "", 0).otherwise(1)).alias("tf"))


def write_postings(corpus: DataFrame, path: str, buckets: int = 256) -> None:
    """token_index() of corpus in folders by a hash of the term, so that a question reads those of its terms."""
    rows = token_index(corpus).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    # a term of every chunk lies in many files of its folder
    rows.repartition("bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(32))).write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_postings(spark: SparkSession, path: str, terms: list[str], buckets: int = 256) -> DataFrame:
    """The postings of terms, and the chunks' own rows, from the folders that hold them."""
    wanted = spark.createDataFrame([(t,) for t in {"", *terms}], "term string").select(F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("b"))
    found = spark.read.schema("chunk_id long, term string, dl int, tf long, bucket int").parquet(path)
    return found.where(F.col("bucket").isin([r.b for r in wanted.distinct().collect()])).where(F.col("term").isin(["", *terms])).drop("bucket")


def bm25(corpus: DataFrame, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, statistics: DataFrame | None = None, postings: DataFrame | None = None) -> DataFrame:
    """query_id, rank, chunk_id, score: Okapi BM25 of queries (query_id, question) over corpus (chunk_id, ord, text).

    idf = ln((n - df + 1/2) / (df + 1/2) + 1); a term counts as often as the question has it. Chunks without any term score 0
    and fill up to k in the order of ord; a question without tokens has no rows. Statistics are of the corpus itself, or of
    statistics (chunk_id, text) where the scope of a filter is narrower than that of the statistics. postings: those of the
    corpus as token_index() or read_postings() has them, so that no text is read.

    Up to QUERY_BLOCK queries: texts are read once; each chunk's length and the asked ones among its tokens are written to the
    shared folder. A chunk's scores are summed where it lies, and k rows a query leave a task. For more queries every token may
    be shuffled to meet them.
    """
    terms = queries.select("query_id", F.explode(T.tokens(F.col("question"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    wanted = terms.select("term").distinct()
    asked = None
    if queries.count() <= QUERY_BLOCK:
        asked = [r.term for r in wanted.limit(ASKED_TERMS + 1).collect()]
        asked = asked if len(asked) <= ASKED_TERMS else None
        wanted = F.broadcast(wanted)
    part = F.col("w") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    weight = F.col("qtf") * F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    if asked is not None and postings is None:
        held = _asked_tokens(corpus, asked)
        base = held if statistics is None else _asked_tokens(statistics.select("chunk_id", F.lit(0).alias("ord"), "text"), asked)
        total = base.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
        counts = base.select(F.explode(F.array_distinct("toks")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        weighed = F.broadcast(counts.join(F.broadcast(terms), "term").join(F.broadcast(total)).select("query_id", "term", weight.alias("w"), "avgdl"))
        tf = held.where(F.size("toks") > 0).repartition("chunk_id").select("chunk_id", "ord", "dl", F.explode("toks").alias("term")).groupBy("chunk_id", "ord", "dl", "term").agg(F.count("*").alias("tf"))
        scored = tf.join(weighed, "term").groupBy("chunk_id", "ord", "query_id").agg(F.round(F.sum(part), 9).alias("score")).select("query_id", "chunk_id", "score", "ord")  # sums in another order tie alike
        first = held.orderBy("ord").limit(2 * k)
        hits = first.select("chunk_id", F.explode(F.array_distinct("toks")).alias("term")).join(weighed, "term").select("query_id", "chunk_id")
        first = first.select("chunk_id", "ord")
    else:
        # what marks a chunk's own row is no condition on the term: it would be pushed below the shuffle, which then couldn't be shared
        posted = lambda df: _counted(_exploded(df).join(wanted.unionByName(df.sparkSession.range(1).select(F.lit("").alias("term"))), "term"))
        own = posted(corpus) if postings is None else postings.join(wanted.unionByName(corpus.sparkSession.range(1).select(F.lit("").alias("term"))), "term").select("chunk_id", "term", "dl", "tf")
        base = own if statistics is None else posted(statistics)  # where it's the same, its one shuffle serves all
        counts = base.groupBy("term").agg(F.count("*").alias("df"), F.sum("dl").alias("_dl"), F.sum("tf").alias("_tf"))
        total = counts.where("_tf = 0").select(F.col("df").alias("n"), (F.col("_dl") / F.col("df")).alias("avgdl"))
        weighed = counts.where("_tf > 0").drop("_dl", "_tf").join(terms, "term").join(F.broadcast(total)).select("query_id", "term", weight.alias("w"), "avgdl")
        hits = own.where("tf > 0").join(weighed, "term").groupBy("query_id", "chunk_id").agg(F.round(F.sum(part), 9).alias("score"))
        order = corpus.select("chunk_id", "ord")
        scored, first = hits.join(order, "chunk_id"), order.orderBy("ord").limit(2 * k)
    # zero scores can only fill what hits leave of the first k: candidates for that are the first k chunks of the corpus and, as
    # each query takes at most k of them besides its own hits, the first 2k
    zero = terms.select("query_id").distinct().join(F.broadcast(first)).join(hits.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    top = _ranked(scored, F.desc("score"), F.col("ord")).where(F.col("rank") <= k).drop("rank")
    both = top.unionByName(zero.withColumn("score", F.lit(0.0)))
    return _ranked(both, F.desc("score"), F.col("ord")).where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score")


def _asked_tokens(corpus: DataFrame, asked: list[str]) -> DataFrame:
    """chunk_id, ord, dl (the number of its tokens) and toks (those among asked, with repeats) of every chunk, kept in the shared folder."""
    toks = corpus.select("chunk_id", "ord", T.tokens(F.coalesce("text", F.lit(""))).alias("toks")).withColumn("dl", F.size("toks"))
    own = F.filter("toks", lambda x: x.isin(asked)) if asked else F.array().cast("array<string>")
    path = new_folder(corpus.sparkSession, "asked")
    toks.select("chunk_id", "ord", "dl", own.alias("toks")).write.parquet(path)
    return corpus.sparkSession.read.schema(f"chunk_id {corpus.schema['chunk_id'].dataType.simpleString()}, ord {corpus.select('ord').schema['ord'].dataType.simpleString()}, dl int, toks array<string>").parquet(path)


class Texts:
    """A corpus (chunk_id, ord, text) to ask as an index is: by bm25(), over its texts."""

    def __init__(self, corpus: DataFrame):
        self.corpus = corpus

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return bm25(self.corpus, queries, k)


def fuse(dense: DataFrame, sparse: DataFrame, rrf_k: int = 60, alpha: float | None = None) -> DataFrame:
    """query_id, rank, chunk_id, score: reciprocal rank fusion of two rankings (query_id, rank, chunk_id); ties in the order of
    the dense rank, then the sparse one. alpha: the dense ranking's share of the weight, the sparse one's is the rest; without it
    each counts once."""
    d = dense.select("query_id", "chunk_id", F.col("rank").alias("dense_rank"))
    s = sparse.select("query_id", "chunk_id", F.col("rank").alias("sparse_rank"))
    part = lambda c, share: F.coalesce((1.0 if alpha is None else share) / (rrf_k + F.col(c)), F.lit(0.0))
    both = d.join(s, ["query_id", "chunk_id"], "full_outer").withColumn("score", part("dense_rank", alpha) + part("sparse_rank", None if alpha is None else 1.0 - alpha))
    return _ranked(both, F.desc("score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank")).select("query_id", "rank", "chunk_id", "score")


def boost(ranked: DataFrame, factor: float = 1.3) -> DataFrame:
    """ranked (query_id, rank, question, region_types, score) with tables and figures scored up where the question asks for
    data, and ranked anew there."""
    typed = F.arrays_overlap(F.coalesce("region_types", F.array().cast("array<string>")), F.array(F.lit("table"), F.lit("figure")))
    data = T.asks_for_data(F.col("question"))
    score = F.when(data & F.coalesce(typed, F.lit(False)), F.col("score") * factor).otherwise(F.col("score"))
    changed = ranked.withColumn("_old", F.col("rank")).withColumn("score", score).withColumn("_data", data)
    return _ranked(changed.drop("rank"), F.when(F.col("_data"), -F.col("score")).otherwise(F.lit(0.0)), F.col("_old")).drop("_old", "_data")


def expand_parents(top: DataFrame, corpus: DataFrame, threshold: int = 2) -> DataFrame:
    """query_id, rank, chunk_id, score: where threshold or more of a query's chunks (query_id, rank, chunk_id, score) share
    document, title and subtitle, all chunks of that section take the place of the first of them, in the order of ord and with
    score 0; each chunk once. corpus: (chunk_id, ord, document_id, parent_title, parent_subtitle)."""
    key = ["document_id", "parent_title", "parent_subtitle"]
    same = lambda a, b: reduce(Column.__and__, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in key])
    placed = top.join(corpus.select("chunk_id", *key), "chunk_id", "left")
    hits = placed.where("parent_title is not null").groupBy("query_id", *key).agg(F.count("*").alias("n"), F.min("rank").alias("first")).where(F.col("n") >= threshold)
    hits = hits.select("query_id", *key, "first")
    c, h = corpus.alias("c"), hits.alias("h")
    siblings = c.join(h, same("c", "h")).select("h.query_id", F.col("c.chunk_id").alias("chunk_id"), F.col("h.first").alias("at"), F.col("c.ord").alias("sub"), F.lit(0.0).alias("score"))
    p = placed.alias("p")
    rest = p.join(hits.alias("g"), (F.col("p.query_id") == F.col("g.query_id")) & same("p", "g"), "left_anti").select(
        "query_id",
        "chunk_id",
        F.col("rank").alias("at"),
        F.lit(-1).cast("bigint").alias("sub"),
        "score",
    )
    both = siblings.select("query_id", "chunk_id", "at", F.col("sub").cast("bigint").alias("sub"), "score").unionByName(rest)
    once = both.withColumn("_n", F.row_number().over(W.partitionBy("query_id", "chunk_id").orderBy("at", "sub"))).where("_n = 1")
    return _ranked(once, F.col("at"), F.col("sub")).select("query_id", "rank", "chunk_id", "score")


def rerank_lexically(ranked: DataFrame, weight: float = 0.01) -> DataFrame:
    """ranked (query_id, rank, question, text, score) with weight added for each distinct token of three characters or more
    that question and text share, ranked anew, ties in the old order."""
    shared = F.size(F.array_intersect(T.long_tokens(F.col("question")), T.long_tokens(F.coalesce("text", F.lit("")))))
    return _ranked(ranked.withColumn("score", F.col("score") + weight * shared).withColumn("_old", F.col("rank")).drop("rank"), F.desc("score"), F.col("_old")).drop("_old")


def put_type_first(ranked: DataFrame) -> DataFrame:
    """ranked (query_id, rank, question, region_types) with chunks of the type that the question names first, figures before
    tables where it names both; the order within stays."""
    target = F.when(T.has_any(F.col("question"), T.FIRST_FIGURE_TERMS), "figure").when(T.has_any(F.col("question"), T.FIRST_TABLE_TERMS), "table")
    hit = F.coalesce(F.array_contains(F.coalesce("region_types", F.array().cast("array<string>")), target), F.lit(False))
    return _ranked(ranked.withColumn("_hit", hit).withColumn("_old", F.col("rank")).drop("rank"), F.desc("_hit"), F.col("_old")).drop("_hit", "_old")


def union_sub_queries(results: DataFrame) -> DataFrame:
    """query_id, rank, chunk_id, score of the results (query_id, sub, rank, chunk_id, score) of a question's sub-queries, each
    chunk where it comes first."""
    first = results.withColumn("_n", F.row_number().over(W.partitionBy("query_id", "chunk_id").orderBy("sub", "rank"))).where("_n = 1")
    return _ranked(first.withColumnRenamed("rank", "_rank"), F.col("sub"), F.col("_rank")).select("query_id", "rank", "chunk_id", "score")


class Searcher(Protocol):
    """An index that is kept: query_id, rank, chunk_id, score of queries, as bm25() or dense_top_k() give them."""

    def search(self, queries: DataFrame, k: int) -> DataFrame: ...


def hybrid(corpus: DataFrame, queries: DataFrame, k: int = 4, threshold: int = 2, sparse: Searcher | None = None, dense: Searcher | None = None) -> DataFrame:
    """query_id, rank, chunk_id, score of queries (query_id, question, q): 3k dense and 3k BM25 hits, fused, scored up by region,
    cut to k, sections expanded; chunks without an embedding, and questions without a q, take part in all but the dense half.
    corpus: (chunk_id, ord, text, embedding, document_id, region_types, parent_title, parent_subtitle). sparse, dense: indexes of
    the corpus (posting_index.Postings, dense_index.Lists) to ask instead of reading its texts or vectors."""
    fused = fuse(
        dense.search(queries.select("query_id", "q"), 3 * k) if dense else dense_top_k(corpus, queries, 3 * k),
        sparse.search(queries.select("query_id", "question"), 3 * k) if sparse else bm25(corpus, queries, 3 * k),
    )
    known = fused.join(corpus.select("chunk_id", "region_types"), "chunk_id").join(
        F.broadcast(queries.select("query_id", "question")) if queries.count() <= QUERY_BLOCK else queries.select("query_id", "question"),
        "query_id",
    )
    top = boost(known).where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score")
    return expand_parents(top, corpus, threshold)


def relevant_documents(documents: DataFrame, queries: DataFrame, threshold: float = 0.20) -> DataFrame:
    """query_id, document_id, score of the documents (document_id, summary_embedding) whose cosine with the query reaches the
    threshold; documents without an embedding are left out. Queries are a stated set; where they are more than QUERY_BLOCK
    Spark deals the pairs out instead of sending the queries to all tasks."""
    score = cosine(F.col("q"), F.col("summary_embedding"))
    asked = queries.select("query_id", "q")
    known = documents.where(F.size("summary_embedding") > 0)
    pairs = known.crossJoin(F.broadcast(asked) if asked.count() <= QUERY_BLOCK else asked)
    return pairs.select("query_id", "document_id", score.alias("score")).where(F.col("score") >= threshold)


def described(index: DataFrame, descriptors: DataFrame) -> DataFrame:
    """descriptors (document_id, summary_embedding, ...) of the documents that the index has chunks of, with an embedding."""
    return descriptors.where(F.size("summary_embedding") > 0).join(index.select("document_id").distinct(), "document_id", "left_semi")


def apply_ranking(candidates: DataFrame, verdicts: DataFrame, drop_below: float = 0.3) -> DataFrame:
    """query_id, rank, chunk_id, score after a model's ranking. candidates: (query_id, rank, chunk_id, score); verdicts:
    (query_id, ranking, scores, dropped). A chunk without a score keeps its own; those below drop_below or dropped go; unknown
    names are ignored; a query of which nothing is left keeps its candidates."""
    return ranked_by(candidates.select("query_id", "rank", "chunk_id", "score").join(verdicts.select("query_id", "ranking", "scores", "dropped"), "query_id", "left"), drop_below)


def ranked_by(rows: DataFrame, drop_below: float = 0.3) -> DataFrame:
    """query_id, rank, chunk_id, score of candidates (query_id, rank, chunk_id, score) that have their question's ranking,
    scores and dropped beside them, null where there's no verdict: apply_ranking() in one pass."""
    place = F.array_position(F.array_distinct("ranking"), F.col("chunk_id"))
    given = F.coalesce(F.try_element_at("scores", "chunk_id"), F.col("score"))
    kept = F.coalesce((place > 0) & (given >= drop_below) & ~F.array_contains("dropped", F.col("chunk_id")), F.lit(False))
    marked = rows.select("query_id", "chunk_id", "rank", "score", place.alias("_place"), given.alias("_given"), kept.alias("_kept"))
    some = F.max("_kept").over(W.partitionBy("query_id"))
    left = marked.withColumn("_some", some).where(F.col("_kept") | ~F.col("_some")).withColumn("_at", F.when(F.col("_some"), F.col("_place")).otherwise(F.col("rank")))
    scored = left.withColumn("score", F.when(F.col("_some"), F.col("_given")).otherwise(F.col("score"))).drop("rank")
    return _ranked(scored, F.col("_at")).select("query_id", "rank", "chunk_id", "score")
