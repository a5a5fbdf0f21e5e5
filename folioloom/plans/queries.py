"""Each operator over the tables of a folder, and the same in DuckDB SQL. Every query runs over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.functions import geometry as G
from folioloom.functions import lenient as L
from folioloom.functions import text as T
from folioloom.operators import chunking, dense_index, evaluation, layout, posting_index, retrieval, store
from folioloom.plans import ingest
from folioloom.sources.shared import new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _six(c):
    return F.round(c, 6)


#: White space off both ends of {}.
_STRIP = r"regexp_replace({}, '^[\t-\r\x{{85}}\pZ]+|[\t-\r\x{{85}}\pZ]+$', '', 'g')"

# ---- inputs made of the tables, alike in both engines

QUESTIONS = (
    (1, "the thing of that nation and the other"),
    (2, "der die keit und einer"),
    (3, "how many idiot or moron in the table"),
    (4, "que de la figure"),
    (5, "zzqqzz"),
    (6, "Licensed under the Apache License, Version 2.0."),
    (7, "!!"),
)
_Q_SQL = "q(query_id, question) AS (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in QUESTIONS) + ")"


def _questions(spark: SparkSession) -> DataFrame:
    values = ", ".join(f"({i}, '{q}')" for i, q in QUESTIONS)
    return spark.sql(f"SELECT * FROM VALUES {values} AS q(query_id, question)")


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    """Documents as chunks; source and lang are the section, and the type of region goes by the id."""
    kind = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("table"))).when(F.col("doc_id") % 3 == 1, F.array(F.lit("figure"))).otherwise(F.array(F.lit("text_block")))
    return _t(spark, d, "documents").select(
        F.col("doc_id").alias("chunk_id"),
        F.col("doc_id").alias("ord"),
        "text",
        F.lit("d").alias("document_id"),
        F.col("source").alias("parent_title"),
        F.col("lang").alias("parent_subtitle"),
        kind.alias("region_types"),
    )


_TYPES = "CASE doc_id % 3 WHEN 0 THEN ['table'] WHEN 1 THEN ['figure'] ELSE ['text_block'] END"


def _items(spark: SparkSession, d: str) -> DataFrame:
    """Lineitems as text items on pages of forty orders."""
    li = _t(spark, d, "lineitem")
    page = F.floor(F.col("l_orderkey") / 40).cast("int")
    x0, y0 = (F.col("l_partkey") % 500).cast("double"), ((F.col("l_suppkey") * 7 + F.col("l_linenumber") * 13 + F.col("l_orderkey")) % 800).cast("double")
    return li.select(
        F.concat(F.lit("d"), (page % 7).cast("string")).alias("document_id"),
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("item_id"),
        page.alias("page_number"),
        F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("text"),
        G.box(x0, y0, x0 + 20 + F.col("l_quantity"), y0 + 12).alias("bbox"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
    )


_ITEMS = """items AS (
  SELECT 'd' || (p % 7) AS document_id, l_orderkey || '-' || l_linenumber AS item_id, p AS page_number, l_returnflag || l_linenumber AS body,
    x0, y0, x0 + 20 + l_quantity AS x1, y0 + 12 AS y1, l_orderkey * 10 + l_linenumber AS ord
  FROM (SELECT *, CAST(floor(l_orderkey / 40.0) AS INTEGER) AS p, CAST(l_partkey % 500 AS DOUBLE) AS x0, CAST((l_suppkey * 7 + l_linenumber * 13 + l_orderkey) % 800 AS DOUBLE) AS y0 FROM lineitem))"""


def _regions(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders")
    page = F.floor(F.col("o_orderkey") / 40).cast("int")
    x0, y0 = (F.col("o_custkey") % 400).cast("double"), ((F.col("o_orderkey") * 3) % 700).cast("double")
    kind = F.when(F.col("o_orderstatus") == "F", "table").when(F.col("o_orderstatus") == "O", "figure").otherwise("text_block")
    return o.select(
        F.concat(F.lit("d"), (page % 7).cast("string")).alias("document_id"),
        F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("region_id"),
        kind.alias("region_type"),
        page.alias("page_number"),
        G.box(x0, y0, x0 + 100 + F.col("o_custkey") % 60, y0 + 40 + F.col("o_orderkey") % 50).alias("bbox"),
        F.col("o_orderkey").alias("ord"),
    )


_REGIONS = """regions AS (
  SELECT 'd' || (p % 7) AS document_id, 'r' || o_orderkey AS region_id, CASE o_orderstatus WHEN 'F' THEN 'table' WHEN 'O' THEN 'figure' ELSE 'text_block' END AS region_type,
    p AS page_number, x0, y0, x0 + 100 + o_custkey % 60 AS x1, y0 + 40 + o_orderkey % 50 AS y1, o_orderkey AS ord
  FROM (SELECT *, CAST(floor(o_orderkey / 40.0) AS INTEGER) AS p, CAST(o_custkey % 400 AS DOUBLE) AS x0, CAST((o_orderkey * 3) % 700 AS DOUBLE) AS y0 FROM orders))"""


def _made_blocks(spark: SparkSession, d: str, regions: DataFrame) -> DataFrame:
    """Blocks of the items and regions; their runs are written once and numbered from there."""
    ordered = layout.reading_order(layout.best_regions(_items(spark, d), regions))
    return layout.blocks(ordered, keep=ingest.kept_in(new_folder(spark, "blocks")))


_OVERLAP = "greatest(0, least(i.x1, r.x1) - greatest(i.x0, r.x0)) * greatest(0, least(i.y1, r.y1) - greatest(i.y0, r.y0))"

# ---- dense retrieval

_VEC = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("ord"), "embedding", F.col("label").alias("document_id"))


def _dense_sql(where: str, asked: str, k: int) -> str:
    return f"""WITH {_VEC}, s AS (SELECT q.vec_id AS query_id, d.vec_id AS chunk_id, list_cosine_similarity(q.e, d.e) AS s FROM v q JOIN v d ON {asked} AND {where}),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS rank FROM s)
      SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, round(s, 6) AS score FROM r WHERE rank <= {k}"""


def _dense(spark: SparkSession, d: str, asked, k: int, documents=None) -> DataFrame:
    v = _vectors(spark, d)
    q = v.where(asked).select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("q"))
    return retrieval.dense_top_k(retrieval.scoped(v, documents), q, k).withColumn("score", _six("score"))


@query(_dense_sql("true", "q.vec_id = 7", 4))
def dense_topk(spark, d):
    return _dense(spark, d, F.col("chunk_id") == 7, 4)


@query(_dense_sql("d.label IN (1, 2)", "q.vec_id = 7", 4))
def dense_topk_filtered(spark, d):
    return _dense(spark, d, F.col("chunk_id") == 7, 4, [1, 2])


@query(_dense_sql("true", "q.vec_id % 10 = 0", 5))
def dense_topk_batch(spark, d):
    return _dense(spark, d, F.col("chunk_id") % 10 == 0, 5)


def _dense_lists(spark: SparkSession, d: str, rows: DataFrame | None = None) -> dense_index.Lists:
    held = dense_index.Lists(spark, new_folder(spark, "lists"))
    held.build(_vectors(spark, d) if rows is None else rows)
    return held


def _asked_vectors(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).where("chunk_id % 10 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("q"))


@query(_dense_sql("true", "q.vec_id % 10 = 0", 5))
def dense_indexed(spark, d):
    """Of the index, all lists probed: what a scan of all vectors gives."""
    return _dense_lists(spark, d).search(_asked_vectors(spark, d), 5).withColumn("score", _six("score"))


@query(_dense_sql("d.label <> 3", "q.vec_id % 10 = 0", 5).replace("q.e, d.e)", "q.e, CASE d.label WHEN 2 THEN list_reverse(d.e) ELSE d.e END)"))
def dense_index_updated(spark, d):
    """The index after a document's vectors were replaced, all at once turned around, and another document removed."""
    v = _vectors(spark, d)
    held = _dense_lists(spark, d)
    held.replace(v.where("document_id = 2").withColumn("embedding", F.reverse("embedding")))
    held.remove(v.where("document_id = 3").select("document_id"))
    return held.search(_asked_vectors(spark, d), 5).withColumn("score", _six("score"))


@query(f"WITH {_VEC}, n AS (SELECT count(*) AS n FROM v) SELECT count(*) AS queries, 5 * count(*) AS pairs, true AS found FROM v WHERE vec_id % 10 = 0")
def dense_index_recall(spark, d):
    """Whether 95 in 100 of the five nearest are found where two thirds of the lists are probed: the test vectors don't cluster."""
    held, asked = _dense_lists(spark, d), _asked_vectors(spark, d)
    exact = retrieval.dense_top_k(_vectors(spark, d), asked, 5).select("query_id", "chunk_id")
    got = held.search(asked, 5, probes=-(-2 * held.version().many // 3)).select("query_id", "chunk_id", F.lit(1).alias("hit"))
    both = exact.join(got, ["query_id", "chunk_id"], "left")
    return both.agg(F.countDistinct("query_id").alias("queries"), F.count("*").alias("pairs"), (F.count("hit") / F.count("*") >= 0.95).alias("found"))


@query(f"WITH {_VEC} SELECT q.vec_id AS query_id, d.vec_id AS document_id, round(list_cosine_similarity(q.e, d.e), 6) AS score FROM v q JOIN v d ON q.vec_id = 7 AND list_cosine_similarity(q.e, d.e) >= 0.2")
def document_prefilter(spark, d):
    v = _vectors(spark, d)
    docs = v.select(F.col("chunk_id").alias("document_id"), F.col("embedding").alias("summary_embedding"))
    return retrieval.relevant_documents(docs, v.where("chunk_id = 7").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("q"))).withColumn("score", _six("score"))


# ---- tokens and BM25

_TOK = "regexp_extract_all(lower({}), '[a-z0-9]+')"


@query(f"SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, CAST(len(list_distinct(t)) AS INTEGER) AS n_distinct FROM (SELECT doc_id, {_TOK.format('\"text\"')} AS t FROM documents)")
def tokenize_stats(spark, d):
    t = T.tokens(F.coalesce("text", F.lit("")))
    return _t(spark, d, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_distinct"))


@query(f"WITH t AS (SELECT doc_id, unnest({_TOK.format('\"text\"')}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t GROUP BY term")
def document_frequency(spark, d):
    postings = retrieval.token_index(_corpus(spark, d))
    return postings.where("term <> ''").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def _bm25_sql(where: str, k: int, name: str = "r") -> str:
    return f"""c AS (SELECT doc_id, {_TOK.format('"text"')} AS toks FROM documents WHERE {where}),
      n AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM c),
      p AS (SELECT doc_id, term, len(toks) AS dl, count(*) AS tf FROM (SELECT doc_id, toks, unnest(toks) AS term FROM c) GROUP BY ALL),
      f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
      w AS (SELECT query_id, unnest({_TOK.format('question')}) AS term FROM q),
      s AS (SELECT query_id, doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS s FROM w JOIN p USING (term) JOIN f USING (term) CROSS JOIN n GROUP BY ALL),
      a AS (SELECT query_id, doc_id AS chunk_id, coalesce(s, 0) AS s FROM (SELECT DISTINCT query_id FROM w) CROSS JOIN c LEFT JOIN s USING (query_id, doc_id)),
      {name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS rank FROM a QUALIFY rank <= {k})"""


@query(f"WITH {_Q_SQL}, {_bm25_sql('true', 10)} SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, round(s, 6) AS score FROM r")
def bm25_topk(spark, d):
    return retrieval.bm25(_corpus(spark, d), _questions(spark), 10).withColumn("score", _six("score"))


@query(f"WITH {_Q_SQL}, {_bm25_sql("lang = 'de'", 5)} SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, round(s, 6) AS score FROM r")
def bm25_scoped(spark, d):
    return retrieval.bm25(retrieval.scoped(_corpus(spark, d), ["de"], "parent_subtitle"), _questions(spark), 5).withColumn("score", _six("score"))


def _postings(spark: SparkSession, d: str) -> posting_index.Postings:
    held = posting_index.Postings(spark, new_folder(spark, "postings"))
    held.build(_corpus(spark, d).withColumn("document_id", F.col("parent_title")))
    return held


@query(f"WITH {_Q_SQL}, {_bm25_sql('true', 10)} SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, round(s, 6) AS score FROM r")
def bm25_indexed(spark, d):
    """From blocks of postings alone: what a scan of all texts gives."""
    return _postings(spark, d).search(_questions(spark), 10).withColumn("score", _six("score"))


_UPDATED = """documents AS (SELECT * REPLACE (CASE WHEN source IN ('src1', 'src2') THEN "text" || ' zzqqzz der' ELSE "text" END AS "text") FROM main.documents WHERE source IS NULL OR source NOT IN ('src2', 'src4') OR (source = 'src2' AND doc_id % 2 = 0))"""


@query(f"WITH {_UPDATED}, {_Q_SQL}, {_bm25_sql('true', 10)} SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, round(s, 6) AS score FROM r")
def bm25_index_updated(spark, d):
    """After a document's chunks were replaced, another's by half as many, and a third removed; then compacted."""
    held, rows = _postings(spark, d), _corpus(spark, d).withColumn("document_id", F.col("parent_title"))
    again = rows.withColumn("text", F.concat("text", F.lit(" zzqqzz der")))
    held.replace(again.where("document_id = 'src1' or (document_id = 'src2' and chunk_id % 2 = 0)"))
    held.remove(rows.where("document_id = 'src4'").select("document_id"))
    before = held.search(_questions(spark), 10)
    held.compact()
    after = held.search(_questions(spark), 10)
    return before.unionByName(after).distinct().withColumn("score", _six("score"))  # both alike


# ---- fusion and what follows it; the query's vector is that of vec_id = query_id

_FUSED = f"""{_Q_SQL}, {_VEC}, {_bm25_sql('true', 12, 'sp')},
  dn AS (SELECT q.query_id, d.vec_id AS chunk_id, row_number() OVER (PARTITION BY q.query_id ORDER BY list_cosine_similarity(v.e, d.e) DESC, d.vec_id) AS rank
         FROM q JOIN v ON v.vec_id = q.query_id CROSS JOIN (SELECT * FROM v WHERE vec_id IN (SELECT doc_id FROM documents)) d QUALIFY rank <= 12),
  fu AS (SELECT coalesce(dn.query_id, sp.query_id) AS query_id, coalesce(dn.chunk_id, sp.chunk_id) AS chunk_id, dn.rank AS dr, sp.rank AS sr,
           coalesce(1.0 / (60 + dn.rank), 0) + coalesce(1.0 / (60 + sp.rank), 0) AS s FROM dn FULL JOIN sp ON dn.query_id = sp.query_id AND dn.chunk_id = sp.chunk_id),
  fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, dr NULLS LAST, sr NULLS LAST) AS rank FROM fu)"""
_DATA = "(regexp_matches(question, '[0-9]') OR " + " OR ".join(f"contains(lower(question), '{t}')" for t in T.DATA_TERMS) + ")"
_ANY = lambda terms: "(" + " OR ".join(f"contains(lower(question), '{t}')" for t in terms) + ")"


def _both(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All documents and questions, with their vectors where they have one."""
    v = _t(spark, d, "embeddings").select("vec_id", "embedding")
    corpus = _corpus(spark, d).join(v, F.col("chunk_id") == F.col("vec_id"), "left").drop("vec_id")
    asked = _questions(spark).join(v, F.col("query_id") == F.col("vec_id"), "left").select("query_id", "question", F.col("embedding").alias("q"))
    return corpus, asked


def _fused(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    corpus, asked = _both(spark, d)
    return retrieval.fuse(retrieval.dense_top_k(corpus, asked, 12), retrieval.bm25(_corpus(spark, d), asked, 12)), corpus, asked


@query(f"WITH {_FUSED} SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, round(s, 6) AS score FROM fr")
def rrf_fusion(spark, d):
    return _fused(spark, d)[0].withColumn("score", _six("score"))


@query(f"""WITH {_FUSED}, fw AS (SELECT *, coalesce(0.3 / (60 + dr), 0) + coalesce(0.7 / (60 + sr), 0) AS w FROM fu)
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY w DESC, dr NULLS LAST, sr NULLS LAST) AS INTEGER) AS rank, chunk_id, round(w, 6) AS score FROM fw""")
def weighted_fusion(spark, d):
    """Three tenths of the weight on vectors, the rest on terms."""
    corpus, asked = _both(spark, d)
    return retrieval.fuse(retrieval.dense_top_k(corpus, asked, 12), retrieval.bm25(_corpus(spark, d), asked, 12), alpha=0.3).withColumn("score", _six("score"))


_BOOSTED = f"""{_FUSED}, bo AS (SELECT fr.query_id, chunk_id, rank AS old, {_DATA} AS data, s * CASE WHEN {_DATA} AND chunk_id % 3 < 2 THEN 1.3 ELSE 1 END AS s FROM fr JOIN q USING (query_id)),
  br AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN data THEN -s ELSE 0 END, old) AS rank FROM bo)"""


@query(f"WITH {_BOOSTED} SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, round(s, 6) AS score FROM br")
def region_boost(spark, d):
    fused, corpus, asked = _fused(spark, d)
    known = fused.join(corpus.select("chunk_id", "region_types"), "chunk_id").join(asked.select("query_id", "question"), "query_id")
    return retrieval.boost(known).select("query_id", "rank", "chunk_id", _six("score").alias("score"))


def _expanded(source: str, k: int) -> str:
    return f"""tp AS (SELECT query_id, rank, chunk_id, s, source, lang FROM {source} JOIN documents ON doc_id = chunk_id WHERE rank <= {k}),
  hi AS (SELECT query_id, source, lang, min(rank) AS first FROM tp WHERE source IS NOT NULL GROUP BY ALL HAVING count(*) >= 2),
  un AS (SELECT query_id, doc_id AS chunk_id, first AS spot, doc_id AS sub, 0.0 AS s FROM hi JOIN documents c ON c.source = hi.source AND c.lang IS NOT DISTINCT FROM hi.lang
         UNION ALL SELECT query_id, chunk_id, rank, -1, s FROM tp WHERE NOT EXISTS (SELECT 1 FROM hi WHERE hi.query_id = tp.query_id AND hi.source = tp.source AND hi.lang IS NOT DISTINCT FROM tp.lang)),
  ex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY spot, sub) AS rank FROM un QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY spot, sub) = 1)"""


@query(f"WITH {_FUSED}, {_expanded('fr', 12)} SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, round(s, 6) AS score FROM ex")
def parent_expansion(spark, d):
    fused, corpus, _ = _fused(spark, d)
    return retrieval.expand_parents(fused.where("rank <= 12"), corpus).withColumn("score", _six("score"))


@query(f"WITH {_BOOSTED}, {_expanded('br', 4)} SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, round(s, 6) AS score FROM ex")
def hybrid_topk(spark, d):
    corpus, asked = _both(spark, d)
    # texts aren't joined with vectors: terms need none
    return retrieval.hybrid(corpus, asked, 4, sparse=retrieval.Texts(_corpus(spark, d))).withColumn("score", _six("score"))


@query(f"WITH {_BOOSTED}, {_expanded('br', 4)} SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, round(s, 6) AS score FROM ex")
def hybrid_indexed(spark, d):
    """hybrid_topk from indexes: postings and inverted lists."""
    corpus, asked = _both(spark, d)
    lists = _dense_lists(spark, d, corpus.where("embedding is not null").select("chunk_id", "ord", "embedding", "document_id"))
    return retrieval.hybrid(corpus, asked, 4, sparse=_postings(spark, d), dense=lists).withColumn("score", _six("score"))


@query(f"""WITH {_FUSED}, lx AS (SELECT fr.query_id, chunk_id, rank AS old, s + 0.01 * len(list_intersect(list_distinct(regexp_extract_all(lower(question), '[a-z0-9]{{3,}}')), list_distinct(regexp_extract_all(lower("text"), '[a-z0-9]{{3,}}')))) AS s
  FROM fr JOIN q USING (query_id) JOIN documents ON doc_id = chunk_id)
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, old) AS INTEGER) AS rank, chunk_id, round(s, 6) AS score FROM lx""")
def lexical_rerank(spark, d):
    fused, corpus, asked = _fused(spark, d)
    known = fused.join(corpus.select("chunk_id", "text"), "chunk_id").join(asked.select("query_id", "question"), "query_id")
    return retrieval.rerank_lexically(known).select("query_id", "rank", "chunk_id", _six("score").alias("score"))


@query(f"""WITH {_FUSED}, ty AS (SELECT fr.query_id, chunk_id, rank AS old, CASE WHEN {_ANY(T.FIRST_FIGURE_TERMS)} THEN 1 WHEN {_ANY(T.FIRST_TABLE_TERMS)} THEN 0 END AS want FROM fr JOIN q USING (query_id))
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY coalesce(chunk_id % 3 = want, false) DESC, old) AS INTEGER) AS rank, chunk_id FROM ty""")
def type_partition(spark, d):
    fused, corpus, asked = _fused(spark, d)
    known = fused.join(corpus.select("chunk_id", "region_types"), "chunk_id").join(asked.select("query_id", "question"), "query_id")
    return retrieval.put_type_first(known).select("query_id", "rank", "chunk_id")


@query(f"""WITH {_Q_SQL}, {_bm25_sql('true', 6)}, u AS (SELECT CAST(query_id % 2 AS INTEGER) AS query_id, query_id AS sub, rank AS rr, chunk_id, s FROM r),
  o AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY sub, rr) = 1)
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sub, rr) AS INTEGER) AS rank, chunk_id, round(s, 6) AS score FROM o""")
def subquery_union(spark, d):
    found = retrieval.bm25(_corpus(spark, d), _questions(spark), 6)
    return retrieval.union_sub_queries(found.withColumn("sub", F.col("query_id")).withColumn("query_id", (F.col("query_id") % 2).cast("int"))).withColumn("score", _six("score"))


_INTENT = f"""CASE WHEN regexp_matches(lower(question), '\\band\\b|\\balso\\b|\\bas well\\b') THEN 'multi_hop'
  WHEN {_ANY(T.QUERY_FIGURE_TERMS)} AND NOT ({_ANY(T.QUERY_TABLE_TERMS)} OR {_DATA}) THEN 'figure_lookup' WHEN {_ANY(T.QUERY_TABLE_TERMS)} OR {_DATA} THEN 'table_lookup' ELSE 'prose' END"""


@query(f"WITH u AS (SELECT conv_id, turn, \"text\" AS question FROM conversations WHERE role = 'user') SELECT conv_id, turn, {_DATA} AS data, {_INTENT} AS query_type FROM u")
def query_intent(spark, d):
    return _t(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", T.asks_for_data(F.col("text")).alias("data"), T.query_type(F.col("text")).alias("query_type"))


@query(f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'TABLE' WHEN doc_id % 3 = 1 THEN 'FIGURE' WHEN length(trim(\"text\", ' ' || chr(9) || chr(10) || chr(13))) < 80 THEN 'SECTION_HEADER' ELSE 'PROSE' END AS passage_type FROM documents")
def passage_type(spark, d):
    return _corpus(spark, d).select(F.col("chunk_id").alias("doc_id"), T.passage_type(F.col("region_types"), F.col("text")).alias("passage_type"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 1 AND doc_id % 2 = 1 THEN 'summary ' || doc_id WHEN doc_id % 5 = 0 AND (doc_id + 1) % 3 = 1 AND (doc_id + 1) % 2 = 1 THEN 'summary ' || (doc_id + 1) ELSE "text" END AS embed_text FROM documents""")
def embed_text_choice(spark, d):
    docs = _t(spark, d, "documents")
    ids = F.when(F.col("doc_id") % 5 == 0, F.array(F.col("doc_id").cast("string"), (F.col("doc_id") + 1).cast("string"))).otherwise(F.array(F.col("doc_id").cast("string")))
    chunks = docs.select(F.lit("d").alias("document_id"), F.col("doc_id").alias("chunk_id"), "text", ids.alias("source_region_ids"))
    n = docs.agg((F.max("doc_id") + 2).alias("n"))
    made = n.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))).alias("i")).where("i % 2 = 1")
    kind = F.when(F.col("i") % 3 == 0, "table").when(F.col("i") % 3 == 1, "figure").otherwise("text_block")
    summaries = made.select(
        F.lit("d").alias("document_id"),
        F.col("i").cast("string").alias("region_id"),
        kind.alias("region_type"),
        F.concat(F.lit("summary "), F.col("i").cast("string")).alias("summary_text"),
        F.lit(True).alias("is_meaningful"),
    )
    return chunking.embedding_texts(chunks, summaries).select(F.col("chunk_id").alias("doc_id"), "embed_text")


# ---- layout

_LINES = """ln AS (SELECT doc_id, p AS pos, s[p] AS body FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS p FROM (SELECT doc_id, string_split("text", chr(10)) AS s FROM documents)) WHERE length(s[p]) > 0),
  bl AS (SELECT doc_id, list(length(body) ORDER BY pos) AS l FROM ln GROUP BY doc_id)"""


@query(f"""WITH RECURSIVE {_LINES}, st AS (
    SELECT doc_id, l, 1 AS i, 1 AS s, 1 AS c FROM bl
    UNION ALL
    SELECT doc_id, l, i + 1, CASE WHEN full_ THEN CASE WHEN back IS NULL THEN s ELSE back END ELSE s END, CASE WHEN full_ THEN c + 1 ELSE c END FROM (
      SELECT *, list_sum(l[s:i]) + 2 * (i - s + 1) + l[i + 1] > 1200 AS full_, list_max([k FOR k IN range(s, i + 1) IF list_sum(l[k:i]) >= 150]) AS back FROM st WHERE i < len(l)))
  SELECT doc_id, chunk_no, n_blocks, md5({_STRIP.format(f"array_to_string([x FOR x IN t[a:b] IF length({_STRIP.format('x')}) > 0], chr(10) || chr(10))")}) AS text_md5,
    array_to_string(list_sort(list_distinct([CAST((k * 7) % 5 AS VARCHAR) FOR k IN p[a:b]])), ',') AS region_ids
  FROM (SELECT doc_id, CAST(c AS INTEGER) AS chunk_no, min(s) AS a, max(i) AS b, CAST(max(i) - min(s) + 1 AS INTEGER) AS n_blocks FROM st GROUP BY doc_id, c) JOIN (SELECT doc_id, list(body ORDER BY pos) AS t, list(pos - 1 ORDER BY pos) AS p FROM ln GROUP BY doc_id) USING (doc_id)""")
def chunk_packing(spark, d):
    lines = _t(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("pos", "text")).where(F.length("text") > 0)
    made = lines.select(
        "document_id",
        F.lit(1).alias("page_number"),
        F.col("pos").alias("reading_order"),
        F.col("pos").cast("string").alias("block_id"),
        "text",
        F.array().cast("array<string>").alias("item_ids"),
        F.array((F.col("pos") * 7 % 5).cast("string")).alias("region_ids"),
    )
    got = chunking.pack_blocks(made, 1200, 150)
    return got.select(
        F.col("document_id").alias("doc_id"),
        F.col("chunk_no").cast("int").alias("chunk_no"),
        F.size("block_ids").alias("n_blocks"),
        F.md5("text").alias("text_md5"),
        F.array_join("source_region_ids", ",").alias("region_ids"),
    )


@query(f"WITH {_ITEMS} SELECT document_id, page_number, item_id, CAST(row_number() OVER (PARTITION BY document_id, page_number ORDER BY round_even(y0 / 18, 0), x0, y0, ord, x1, y1, body NULLS FIRST) AS INTEGER) AS reading_order FROM items")
def reading_order(spark, d):
    return layout.reading_order(_items(spark, d)).select("document_id", "page_number", "item_id", "reading_order")


_MATCH = f"""{_ITEMS}, {_REGIONS}, mt AS (SELECT i.document_id, i.item_id, r.region_id, r.region_type, ({_OVERLAP}) / ((i.x1 - i.x0) * (i.y1 - i.y0)) AS ratio FROM items i JOIN regions r ON i.document_id = r.document_id AND i.page_number = r.page_number
    WHERE {_OVERLAP} > 0 QUALIFY row_number() OVER (PARTITION BY i.document_id, i.item_id ORDER BY ratio DESC, r.ord) = 1),
  im AS (SELECT i.*, region_id, region_type, coalesce(ratio, 0) AS ratio FROM items i LEFT JOIN mt USING (document_id, item_id))"""


@query(f"WITH {_MATCH} SELECT document_id, item_id, region_id, region_type, round(ratio, 6) AS overlap_ratio FROM im")
def spatial_best_match(spark, d):
    got = layout.best_regions(_items(spark, d), _regions(spark, d))
    return got.select("document_id", "item_id", "region_id", "region_type", _six("overlap_ratio").alias("overlap_ratio"))


_BLOCKS = f"""{_MATCH}, ro AS (SELECT *, row_number() OVER (PARTITION BY document_id, page_number ORDER BY round_even(y0 / 18, 0), x0, y0, ord, x1, y1, body NULLS FIRST) AS o FROM im),
  fl AS (SELECT *, CASE WHEN lag(1) OVER w IS NULL OR region_id IS DISTINCT FROM lag(region_id) OVER w OR floor(y0 / 20) <> lag(floor(y0 / 20)) OVER w THEN 1 ELSE 0 END AS new FROM ro WINDOW w AS (PARTITION BY document_id, page_number ORDER BY o)),
  rn AS (SELECT *, sum(new) OVER (PARTITION BY document_id, page_number ORDER BY o ROWS UNBOUNDED PRECEDING) AS run FROM fl),
  bk AS (SELECT document_id, page_number, run, string_agg(body, ' ' ORDER BY o) AS body, count(*) AS n, any_value(region_id) AS region_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM rn GROUP BY ALL),
  bn AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page_number, run) AS o FROM bk)"""


@query(f"WITH {_BLOCKS} SELECT document_id, 'p' || page_number || '_block_' || o AS block_id, body, CAST(n AS INTEGER) AS n_items, region_id, x0, y0, x1, y1 FROM bn")
def line_blocks(spark, d):
    made = _made_blocks(spark, d, _regions(spark, d))
    return made.select(
        "document_id",
        "block_id",
        F.col("text").alias("body"),
        F.size("item_ids").alias("n_items"),
        F.try_element_at("region_ids", F.lit(1)).alias("region_id"),
        "bbox.x0",
        "bbox.y0",
        "bbox.x1",
        "bbox.y1",
    )


@query(f"""WITH {_BLOCKS}, pr AS (SELECT r.document_id, r.region_id, i.page_number, i.o, ({_OVERLAP}) > 0 AS hit, least(abs(i.y0 - r.y1), abs(i.y1 - r.y0)) AS gap FROM regions r JOIN bn i ON i.document_id = r.document_id AND i.page_number = r.page_number WHERE r.region_type IN ('table', 'figure')),
  pk AS (SELECT *, max(hit) OVER (PARTITION BY document_id, region_id) AS anyhit, row_number() OVER (PARTITION BY document_id, region_id ORDER BY gap, o) AS near FROM pr)
  SELECT document_id, region_id, 'p' || page_number || '_block_' || o AS block_id, CAST(row_number() OVER (PARTITION BY document_id, region_id ORDER BY CASE WHEN anyhit THEN o ELSE near END) AS INTEGER) AS pos FROM pk WHERE CASE WHEN anyhit THEN hit ELSE near <= 3 END""")
def visual_links(spark, d):
    regions = _regions(spark, d)
    return layout.linked_blocks(regions, _made_blocks(spark, d, regions))


@query(f"""WITH {_REGIONS} SELECT document_id, region_id FROM (SELECT *, row_number() OVER (PARTITION BY document_id, page_number % 3, region_type, round_even(x0 / 16, 1), round_even(y0 / 16, 1), round_even((x1 - x0) / 512, 1), round_even((y1 - y0) / 512, 1) ORDER BY ord) AS n FROM regions) WHERE n = 1""")
def region_dedupe(spark, d):
    small = _regions(spark, d).withColumn("page_number", F.col("page_number") % 3).withColumn(
        "bbox",
        G.box(F.col("bbox.x0") / 16, F.col("bbox.y0") / 16, (F.col("bbox.x1") - F.col("bbox.x0")) / 512, (F.col("bbox.y1") - F.col("bbox.y0")) / 512),
    )
    return layout.dedupe_regions(small).select("document_id", "region_id")


@query(f"""WITH {_REGIONS}, pd AS (SELECT *, x1 - x0 AS w, y1 - y0 AS h, CASE region_type WHEN 'table' THEN greatest(28, trunc((x1 - x0) * 0.05)) ELSE greatest(36, trunc((x1 - x0) * 0.08)) END AS px, CASE region_type WHEN 'table' THEN greatest(28, trunc((y1 - y0) * 0.08)) ELSE greatest(36, trunc((y1 - y0) * 0.12)) END AS py FROM regions WHERE region_type IN ('table', 'figure')),
  bx AS (SELECT document_id, region_id, w, h, greatest(0, trunc(x0 - px)) AS l, greatest(0, trunc(y0 - py)) AS t, least(480, trunc(x1 + px)) AS r, least(640, trunc(y1 + py)) AS b FROM pd)
  SELECT document_id, region_id, CAST(CASE WHEN ok THEN l END AS INTEGER) AS "left", CAST(CASE WHEN ok THEN t END AS INTEGER) AS top, CAST(CASE WHEN ok THEN r END AS INTEGER) AS "right", CAST(CASE WHEN ok THEN b END AS INTEGER) AS bottom, CASE WHEN NOT ok THEN 'invalid_crop_bounds' END AS issue FROM (SELECT *, w > 1 AND h > 1 AND r - l >= 48 AND b - t >= 48 AS ok FROM bx)""")
def crop_boxes(spark, d):
    regions = _regions(spark, d)
    pages = regions.select("document_id", "page_number").distinct().withColumns({"image_width": F.lit(480), "image_height": F.lit(640), "page_image_path": F.lit("page.png")})
    return layout.crop_assets(regions, pages).select("document_id", "region_id", "box.left", "box.top", "box.right", "box.bottom", "issue")


_TAG = "<(title|h1|p|li|div|footer|article)[^>]*>([^<]*)"
_LABEL = {"title": "doc_title", "h1": "title", "footer": "subtitle", "li": "table", "div": "chart", "article": "figure", "p": "text"}
_TAGS = f"""tg AS (SELECT page_id, p AS ord, CASE t[p] {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in _LABEL.items())} END AS label, b[p] AS body
    FROM (SELECT *, unnest(range(1, len(t) + 1)) AS p FROM (SELECT page_id, regexp_extract_all(html, '{_TAG}', 1) AS t, regexp_extract_all(html, '{_TAG}', 2) AS b FROM pages))),
  r1 AS (SELECT *, sum(CASE WHEN label IN ('title', 'doc_title', 'paragraph_title') THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY ord) AS run FROM tg),
  r2 AS (SELECT *, max(CASE WHEN label IN ('title', 'doc_title', 'paragraph_title') THEN coalesce(nullif(body[1:200], ''), 'section_r' || ord) END) OVER (PARTITION BY page_id, run) AS ti,
    max(CASE WHEN label = 'subtitle' THEN ord END) OVER (PARTITION BY page_id, run ORDER BY ord) AS so FROM r1),
  r3 AS (SELECT a.*, CASE WHEN a.label NOT IN ('title', 'doc_title', 'paragraph_title', 'subtitle') THEN coalesce(a.ti, 'untitled') END AS parent_title, CASE WHEN a.label NOT IN ('title', 'doc_title', 'paragraph_title', 'subtitle') THEN nullif(s.body[1:200], '') END AS parent_subtitle
    FROM r2 a LEFT JOIN tg s ON s.page_id = a.page_id AND s.ord = a.so)"""


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    names, bodies = (F.regexp_extract_all("html", F.lit(_TAG), F.lit(i)) for i in (1, 2))
    rows = _t(spark, d, "pages").select(
        F.col("page_id").alias("document_id"),
        F.posexplode(F.arrays_zip(names.alias("n"), bodies.alias("b"))).alias("pos", "x"),
    ).withColumn("region_id", F.concat(F.lit("r"), (F.col("pos") + 1).cast("string")))
    label = F.lit(None).cast("string")
    for a, b in _LABEL.items():
        label = F.when(F.col("x.n") == a, b).otherwise(label)
    return rows.select(
        "document_id",
        "region_id",
        F.lit(1).alias("page_number"),
        (F.col("pos") + 1).cast("double").alias("y0"),
        (F.col("pos") + 1).cast("bigint").alias("ord"),
        label.alias("label"),
        F.col("x.b").alias("text"),
    ).withColumn("region_type", layout.region_type(F.col("label")))


@query(f"WITH {_TAGS} SELECT page_id, ord, label, parent_title, parent_subtitle FROM r3")
def title_fill(spark, d):
    return layout.assign_titles(_tagged(spark, d)).select(F.col("document_id").alias("page_id"), "ord", "label", "parent_title", "parent_subtitle")


@query(f"""WITH {_TAGS} SELECT page_id, parent_title AS title, arg_min(struct_pack(s := parent_subtitle), ord).s AS subtitle, count(*) FILTER (label = 'text') AS text_blocks, count(*) FILTER (label = 'table') AS tables, count(*) FILTER (label = 'chart') AS charts, count(*) FILTER (label = 'figure') AS figures,
  (concat_ws(chr(10), parent_title, string_agg(body, chr(10) ORDER BY ord) FILTER (label = 'text' AND body <> '')))[1:2000] AS flat_text FROM r3 WHERE parent_title IS NOT NULL GROUP BY page_id, parent_title""")
def section_counts(spark, d):
    return layout.sections(layout.assign_titles(_tagged(spark, d))).select(
        F.col("document_id").alias("page_id"),
        "title",
        "subtitle",
        "text_blocks",
        "tables",
        "charts",
        "figures",
        "flat_text",
    )


@query("""WITH t AS (SELECT DISTINCT t AS label FROM (SELECT unnest(regexp_extract_all(html, '<([a-z0-9]+)', 1)) AS t FROM pages) UNION SELECT unnest(['table_caption', ' Table ', 'CHART', 'side_text', 'logo', 'doc_title'])),
  l AS (SELECT label, trim(lower(label)) AS s FROM t)
  SELECT label, CASE WHEN contains(s, 'table') THEN 'table' WHEN s IN ('text', 'title', 'doc_title', 'figure_title', 'paragraph_title', 'header', 'footer', 'reference', 'caption', 'list', 'number', 'formula_caption', 'table_caption', 'figure_caption', 'aside_text') OR ends_with(s, '_text') THEN 'text_block' WHEN s IN ('image', 'figure', 'chart', 'graph') THEN 'figure' END AS region_type FROM l""")
def label_classify(spark, d):
    tags = _t(spark, d, "pages").select(F.explode(F.regexp_extract_all("html", F.lit("<([a-z0-9]+)"), F.lit(1))).alias("label"))
    more = spark.sql("SELECT explode(array('table_caption', ' Table ', 'CHART', 'side_text', 'logo', 'doc_title')) AS label")
    return tags.unionAll(more).distinct().withColumn("region_type", layout.region_type(F.col("label")))


@query("SELECT lang AS document_id, count(c) AS n, round_even(avg(c), 4) AS mean FROM (SELECT lang, CASE WHEN doc_id % 7 <> 0 THEN (doc_id % 100) / 100.0 END AS c FROM documents) GROUP BY lang")
def confidence_summary(spark, d):
    c = F.when(F.col("doc_id") % 7 != 0, (F.col("doc_id") % 100) / 100.0)
    return layout.confidence_summary(_t(spark, d, "documents").select(F.col("lang").alias("document_id"), c.alias("confidence")))


# ---- evaluation

_EVAL = f"""q AS (SELECT item_id AS query_id, "text" AS question FROM benchmark),
  {_bm25_sql('true', 8)}, rel AS (SELECT q.query_id, coalesce(list(d.doc_id) FILTER (d.doc_id IS NOT NULL), []) AS relevant FROM q LEFT JOIN documents d ON contains(d."text", q.question) GROUP BY q.query_id),
  got AS (SELECT query_id, list(chunk_id ORDER BY rank) AS g FROM r GROUP BY query_id),
  sc AS (SELECT query_id, len(relevant) > 0 AS known, coalesce(g, []) AS g, relevant, [x FOR x IN coalesce(g, []) IF list_contains(relevant, x)] AS h FROM rel LEFT JOIN got USING (query_id)),
  ev AS (SELECT query_id, CASE WHEN known THEN CASE WHEN len(h) > 0 THEN 1.0 ELSE 0.0 END END AS hit_rate, CASE WHEN known THEN CASE WHEN len(h) > 0 THEN 1.0 / list_position(g, h[1]) ELSE 0.0 END END AS mrr,
    CASE WHEN known THEN CASE WHEN len(g) > 0 THEN len(h) / len(g) ELSE 0.0 END END AS precision_at_k, CASE WHEN known THEN len(h) / len(list_distinct(relevant)) END AS recall_at_k FROM sc)"""


def _scores(spark: SparkSession, d: str) -> DataFrame:
    asked = _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    found = evaluation.containing(_t(spark, d, "documents").select("doc_id", "text"), asked).groupBy("query_id").agg(F.collect_list("doc_id").alias("relevant"))
    labels = asked.join(found, "query_id", "left").select("query_id", F.coalesce("relevant", F.array().cast("array<bigint>")).alias("relevant"))
    return evaluation.score(retrieval.bm25(_corpus(spark, d), asked, 8), labels)


@query(f"WITH {_EVAL} SELECT query_id, CAST(hit_rate AS DOUBLE) AS hit_rate, round(CAST(mrr AS DOUBLE), 6) AS mrr, round(CAST(precision_at_k AS DOUBLE), 6) AS precision_at_k, round(CAST(recall_at_k AS DOUBLE), 6) AS recall_at_k FROM ev")
def retrieval_metrics(spark, d):
    s = _scores(spark, d)
    return s.select("query_id", "hit_rate", *[_six(c).alias(c) for c in ("mrr", "precision_at_k", "recall_at_k")])


@query(f"WITH {_EVAL}, lo AS (UNPIVOT (SELECT CAST(hit_rate AS DOUBLE) AS hit_rate, CAST(mrr AS DOUBLE) AS mrr, CAST(precision_at_k AS DOUBLE) AS precision_at_k, CAST(recall_at_k AS DOUBLE) AS recall_at_k FROM ev) ON hit_rate, mrr, precision_at_k, recall_at_k INTO NAME metric VALUE v) SELECT metric, round_even(avg(v), 4) AS mean, coalesce(round(avg(v), 4) >= 0.5, false) AS passes FROM lo GROUP BY metric")
def evaluation_summary(spark, d):
    return evaluation.summary(_scores(spark, d))


@query("""WITH s AS (SELECT event_type, list(value ORDER BY value) AS l, avg(value) AS mean, median(value) AS med, stddev_samp(value) AS sd FROM events WHERE value IS NOT NULL GROUP BY event_type)
  SELECT event_type, CAST(len(l) AS BIGINT) AS n, round(mean, 6) AS mean, round(med, 6) AS median, round(l[greatest(1, CAST(floor(len(l) * 95 / 100) AS INTEGER))], 6) AS p95, round(l[greatest(1, CAST(floor(len(l) * 99 / 100) AS INTEGER))], 6) AS p99, round(l[1], 6) AS min, round(l[-1], 6) AS max, round(coalesce(sd, 0), 6) AS stdev FROM s""")
def latency_stats(spark, d):
    got = evaluation.latency(_t(spark, d, "events"), "event_type", "value")
    return got.select("event_type", "n", *[_six(c).alias(c) for c in ("mean", "median", "p95", "p99", "min", "max", "stdev")])


# ---- the relational store; a conversation's user is conv_id % 5, a turn is a message's time

_STORE = """cv AS (SELECT conv_id AS id, 'u' || (conv_id % 5) AS user_id, CASE WHEN conv_id % 4 <> 0 THEN 'c' || conv_id END AS title, conv_id AS created_at FROM (SELECT DISTINCT conv_id FROM conversations)),
  ms AS (SELECT conv_id * 1000 + turn AS id, conv_id AS conversation_id, role, "text" AS content, turn AS created_at FROM conversations)"""


def _store(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = _t(spark, d, "conversations")
    conversations = c.select("conv_id").distinct().select(
        F.col("conv_id").alias("id"),
        F.concat(F.lit("u"), (F.col("conv_id") % 5).cast("string")).alias("user_id"),
        F.when(F.col("conv_id") % 4 != 0, F.concat(F.lit("c"), F.col("conv_id").cast("string"))).alias("title"),
        F.col("conv_id").alias("created_at"),
    )
    return conversations, c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.col("conv_id").alias("conversation_id"),
        "role",
        F.col("text").alias("content"),
        F.col("turn").alias("created_at"),
    )


@query(f"WITH {_STORE} SELECT cv.id, coalesce(title, 'Untitled') AS title, (SELECT arg_max(content, created_at) FROM ms WHERE conversation_id = cv.id)[1:120] AS preview, created_at FROM cv WHERE user_id = 'u2'")
def conversation_list(spark, d):
    return store.conversation_list(*_store(spark, d), "u2")


@query(f"WITH {_STORE} SELECT ms.id, conversation_id, role, content, ms.created_at FROM ms JOIN cv ON cv.id = conversation_id WHERE user_id = 'u2' AND conversation_id = 7")
def message_history(spark, d):
    return store.message_history(*_store(spark, d), "u2", 7)


@query(f"WITH {_STORE}, gone AS (SELECT id FROM cv WHERE id % 3 = 0 AND user_id = 'u1') SELECT 'conversation' AS kind, id FROM cv WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'message', id FROM ms WHERE conversation_id NOT IN (SELECT id FROM gone)")
def cascade_delete(spark, d):
    conversations, messages = _store(spark, d)
    asked = conversations.where("id % 3 = 0").select("id", F.lit("u1").alias("user_id"))
    c, m = store.delete_conversations(conversations, messages, asked)
    return c.select(F.lit("conversation").alias("kind"), "id").unionAll(m.select(F.lit("message").alias("kind"), "id"))


@query("SELECT conv_id, turn, \"text\" AS question, CASE WHEN r = 'assistant' THEN t END AS answer FROM (SELECT *, lead(role) OVER w AS r, lead(\"text\") OVER w AS t FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user'")
def turn_pairs(spark, d):
    return store.turn_pairs(_t(spark, d, "conversations"), "conv_id", "turn", "role", "text")


_LATEST = "la AS (SELECT user_id, arg_max(struct_pack(e := event_type, v := value), struct_pack(t := ts, i := event_id)) AS s FROM events GROUP BY user_id)"


@query(f"WITH {_LATEST} SELECT user_id, s.e AS event_type, s.v AS value FROM la")
def latest_state(spark, d):
    return store.latest_state(_t(spark, d, "events"), "user_id", "ts", "event_type", "value", tie="event_id")


@query(f"WITH {_LATEST} SELECT user_id, s.e AS status FROM la WHERE user_id % 2 = 0 UNION ALL SELECT c_custkey, 'ready' FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM la WHERE user_id % 2 = 0)")
def status_precedence(spark, d):
    jobs = store.latest_state(_t(spark, d, "events"), "user_id", "ts", "event_type", tie="event_id").where("user_id % 2 = 0").withColumnRenamed("event_type", "status")
    return store.status_precedence(jobs, _t(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.lit("ready").alias("status")), "user_id")


@query("""WITH e AS (SELECT *, epoch_us(ts) AS us FROM events), n AS (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 432000000000 - 1 PRECEDING AND CURRENT ROW) - (row_number() OVER (PARTITION BY user_id, us ORDER BY event_id DESC) - 1) AS n FROM e)
  SELECT event_id, user_id, n, n <= 3 AS allowed FROM n""")
def rate_limit(spark, d):
    got = store.rate_limit(_t(spark, d, "events"), "user_id", "ts", "event_id", 3, 5 * 86_400)
    return got.select("event_id", "user_id", F.col("n").cast("bigint").alias("n"), "allowed")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new ' || (doc_id % 2) ELSE \"text\" END AS text FROM documents UNION ALL SELECT doc_id + 1000000000, 'new ' || (doc_id % 2) FROM documents WHERE doc_id % 11 = 0")
def upsert_latest(spark, d):
    old = _t(spark, d, "documents").select("doc_id", "text")
    at = F.explode(F.sequence(F.lit(0), F.lit(1))).alias("at")
    body = F.when(F.col("at") == 1, F.concat(F.lit("new "), (F.col("doc_id") % 2).cast("string"))).otherwise("old")
    first = old.where("doc_id % 3 = 0").select("doc_id", at).select("doc_id", body.alias("text"), "at")
    added = old.where("doc_id % 11 = 0").select("doc_id", at).select((F.col("doc_id") + 1_000_000_000).alias("doc_id"), body.alias("text"), "at")
    new = first.unionAll(added)
    return store.upsert(old, new, "doc_id", "at")


@query("SELECT doc_id, sha256(\"text\") AS content_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS uuid FROM (SELECT *, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents)")
def content_ids(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("content_id"), store.object_uuid(F.col("doc_id")).alias("uuid"))


@query("SELECT c_custkey AS id, lower(c_name) AS email FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey + 1000000000, lower(c_name) FROM customer WHERE c_custkey % 2 = 1")
def user_insert(spark, d):
    c = _t(spark, d, "customer")
    users = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.lower("c_name").alias("email"))
    new = c.select((F.col("c_custkey") + 1_000_000_000).alias("id"), F.concat(F.lit(" "), F.upper("c_name")).alias("email"))
    return store.add_users(users, new)[0]


@query("SELECT sha256(CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'new' ELSE 'old' END || c_custkey) AS token_hash, c_custkey AS user_id, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 90 ELSE c_custkey % 2 * -20 + 60 END AS expires_at FROM customer")
def token_rotation(spark, d):
    c = _t(spark, d, "customer")
    key = F.col("c_custkey").cast("string")
    tokens = c.select(store.token_hash(F.concat(F.lit("old"), key)).alias("token_hash"), F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 2 * -20 + 60).alias("expires_at"))
    asked = c.where("c_custkey % 3 = 0").select(F.concat(F.lit("old"), key).alias("token"), F.concat(F.lit("new"), key).alias("new_token"), F.lit(90).cast("bigint").alias("expires_at"))
    return store.rotate_tokens(tokens, asked, F.lit(50))


@query("WITH e AS (SELECT event_id, ts, floor((epoch_ms((SELECT max(ts) FROM events)) - epoch_ms(ts)) / 86400000) AS dd FROM events) SELECT event_id, CASE WHEN dd = 0 THEN 'Today' WHEN dd = 1 THEN 'Yesterday' WHEN dd < 7 THEN CAST(dd AS INTEGER) || ' days ago' ELSE strftime(ts, '%Y-%m-%d') END AS bucket FROM e")
def recency_bucket(spark, d):
    e = _t(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    now = e.agg(F.max("at").alias("now"))
    return e.join(F.broadcast(now)).select("event_id", store.recency(F.col("at"), F.col("now")).alias("bucket"))


@query("SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 50")
def deterministic_sample(spark, d):
    """The report is its limit: fifty documents."""
    return store.deterministic_sample(_t(spark, d, "documents"), "doc_id", 50).select("doc_id")


# ---- what models answer

_DAMAGE = (
    ("fence", lambda p: F.concat(F.lit("```json\n"), p, F.lit("\n```"))),
    ("prose", lambda p: F.concat(F.lit("Here it is: "), p, F.lit(" - done."))),
    ("broken", lambda p: F.concat(F.lit('{"summary": "s'), F.regexp_extract(p, "[0-9]+", 0), F.lit('", "k": 1,, '))),
    ("clean", lambda p: p),
    ("garbage", lambda p: F.lit("no object")),
)


@query("""SELECT event_id, CASE event_id % 5 WHEN 2 THEN NULL WHEN 4 THEN NULL ELSE json_extract_string(props, '$.k') END AS k, CASE WHEN event_id % 5 = 2 THEN 's' || regexp_extract(props, '[0-9]+') END AS summary, event_id % 5 IN (2, 4) AS parse_error FROM events""")
def lenient_json(spark, d):
    e = _t(spark, d, "events")
    raw = F.lit(None).cast("string")
    for i, (_, f) in enumerate(_DAMAGE):
        raw = F.when(F.col("event_id") % 5 == i, f(F.col("props"))).otherwise(raw)
    got = e.select("event_id", raw.alias("raw")).withColumn("m", L.lenient_map(F.col("raw")))
    return got.select("event_id", F.col("m")["k"].alias("k"), F.col("m")["summary"].alias("summary"), F.coalesce(F.col("m")["parse_error"] == "true", F.lit(False)).alias("parse_error"))


_LINE = _STRIP.format(f"regexp_replace({_STRIP.format('x')}, '^[0-9]+[.)]', '')")


@query(rf"""WITH c AS (SELECT conv_id, turn, coalesce("text", '') AS body, '1. ' || coalesce(role, '') || chr(10) || chr(10) || '2) ' || coalesce("text", '') AS raw FROM conversations),
  k AS (SELECT conv_id, turn, body, [y FOR y IN [{_LINE} FOR x IN string_split_regex(raw, '\r\n|[\n-\r\x{{85}}\x{{2028}}\x{{2029}}]')] IF length(y) > 0] AS p FROM c),
  w AS (SELECT conv_id, turn, CASE WHEN len(p) > 0 THEN p ELSE [body] END AS p FROM k)
  SELECT conv_id, turn, unnest(p) AS part, CAST(generate_subscripts(p, 1) AS INTEGER) AS pos FROM w""")
def decompose_parse(spark, d):
    """Every turn, its whole text; a null one is empty."""
    c = _t(spark, d, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    raw = F.concat(F.lit("1. "), F.coalesce("role", F.lit("")), F.lit("\n\n2) "), F.col("text"))
    return c.select("conv_id", "turn", F.posexplode(T.sub_queries(raw, F.col("text"))).alias("pos", "part")).select("conv_id", "turn", "part", (F.col("pos") + 1).alias("pos"))


_CAND = f"WITH {_Q_SQL}, {_bm25_sql('true', 4)}, cd AS (SELECT query_id, rank, CAST(chunk_id AS VARCHAR) AS chunk_id, s FROM r)"


@query(f"""{_CAND}, vd AS (SELECT *, count(*) OVER (PARTITION BY query_id) + 1 - rank AS pos, CASE WHEN query_id % 2 = 0 THEN s ELSE rank / 5.0 END AS s2 FROM cd),
  kp AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY pos) AS INTEGER) AS rank, chunk_id, round(s2, 6) AS score FROM vd WHERE s2 >= 0.3)
  SELECT * FROM kp UNION ALL SELECT query_id, CAST(rank AS INTEGER), chunk_id, round(s, 6) FROM cd WHERE query_id NOT IN (SELECT query_id FROM kp)""")
def rerank_parse(spark, d):
    found = retrieval.bm25(_corpus(spark, d), _questions(spark), 4).withColumn("chunk_id", F.col("chunk_id").cast("string"))
    own = F.sort_array(F.collect_list(F.struct("rank", "chunk_id")))
    ids = F.transform(F.col("c"), lambda x: x.chunk_id)
    quoted = F.array_join(F.transform(F.reverse(ids), lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ", ")
    pairs = F.array_join(F.transform(F.col("c"), lambda x: F.concat(F.lit('"'), x.chunk_id, F.lit('": '), (x["rank"] / 5.0).cast("string"))), ", ")
    scores = F.when(F.col("query_id") % 2 == 0, F.lit("")).otherwise(F.concat(F.lit(', "scores": {'), pairs, F.lit("}")))
    raw = F.concat(F.lit('```json\n{"ranking": ['), quoted, F.lit(', "unknown"]'), scores, F.lit("}\n```"))
    verdicts = found.groupBy("query_id").agg(own.alias("c")).select("query_id", L.ranking(raw, ids).alias("v")).select("query_id", "v.ranking", "v.scores", "v.dropped")
    return retrieval.apply_ranking(found, verdicts).withColumn("score", _six("score"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'UNFAITHFUL' ELSE 'FAITHFUL' END AS verdict, CASE event_id % 3 WHEN 0 THEN CASE WHEN coalesce(value, 0) = 0 THEN 1.0 ELSE round(value / 1000, 6) END ELSE 1.0 END AS confidence, event_id % 3 = 0 AS correct, CAST(CASE event_id % 3 WHEN 0 THEN 2 ELSE 0 END AS INTEGER) AS n_claims FROM events""")
def faithfulness_parse(spark, d):
    e = _t(spark, d, "events")
    full = F.concat(
        F.lit('Result: {"claims": [{"claim_text": "a", "status": "SUPPORTED"}, {"claim_text": "b"}], "overall_verdict": "UNFAITHFUL", "confidence_score": '),
        F.coalesce((F.col("value") / 1000).cast("string"), F.lit("null")),
        F.lit("} end"),
    )
    raw = F.when(F.col("event_id") % 3 == 0, full).when(F.col("event_id") % 3 == 1, '{"confidence_score": 0.0}').otherwise("garbage")
    got = e.select("event_id", L.faithfulness(raw).alias("f"))
    return got.select(
        "event_id",
        F.col("f.overall_verdict").alias("verdict"),
        _six("f.confidence_score").alias("confidence"),
        L.needs_correction(F.col("f")).alias("correct"),
        F.size("f.claims").alias("n_claims"),
    )
