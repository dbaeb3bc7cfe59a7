"""Search queries: terms, lexical and dense rankings, fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.text import terms
from leafmill.operators import retrieval
from leafmill.plans.base import Catalog
from leafmill.sources.shared import spread
from leafmill.sources.tables import load

CATALOG = Catalog()
TERM_SQL = r"list_transform(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9._\-+%/]*'), lambda t: lower(t))"


def chunks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select(F.lit(0).alias("index_id"), F.col("doc_id").alias("chunk_id"), "text")


def questions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.lit(0).alias("index_id"), "text")


def bm25_sql(chunks: str, queries: str, k: int, name: str = "lexical") -> str:
    """chunks: index_id, chunk_id, text; queries: query_id, index_id, text."""
    return f"""
    {name}_c AS ({chunks}), {name}_q AS ({queries}),
    {name}_p AS (SELECT index_id, chunk_id, term, count(*) AS tf FROM (SELECT index_id, chunk_id, unnest({TERM_SQL}) AS term FROM {name}_c) GROUP BY ALL),
    {name}_n AS (SELECT index_id, count(*) AS n FROM {name}_c GROUP BY ALL),
    {name}_raw AS (SELECT index_id, term, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM {name}_p JOIN {name}_n USING (index_id) GROUP BY index_id, term),
    {name}_idf AS (SELECT index_id, term, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER (PARTITION BY index_id) ELSE raw END AS idf FROM {name}_raw),
    {name}_l AS (SELECT index_id, chunk_id, sum(tf) AS dl FROM {name}_p GROUP BY ALL),
    {name}_a AS (SELECT index_id, sum(dl) / any_value(n) AS avgdl FROM {name}_l JOIN {name}_n USING (index_id) GROUP BY index_id),
    {name}_t AS (SELECT query_id, index_id, term, count(*) AS qf FROM (SELECT query_id, index_id, unnest({TERM_SQL}) AS term FROM {name}_q) GROUP BY ALL),
    {name}_s AS (SELECT query_id, index_id, chunk_id, round(sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
        FROM {name}_t JOIN {name}_p USING (index_id, term) JOIN {name}_idf USING (index_id, term) JOIN {name}_l USING (index_id, chunk_id) JOIN {name}_a USING (index_id) GROUP BY ALL),
    {name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM {name}_s WHERE score > 0 QUALIFY rank <= {k})"""


DOCS_SQL = "SELECT 0 AS index_id, doc_id AS chunk_id, text FROM documents"
ITEMS_SQL = "SELECT item_id AS query_id, 0 AS index_id, text FROM benchmark"


@CATALOG.add("F1, P8", f"SELECT term, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest({TERM_SQL}) AS term FROM documents) GROUP BY term")
def tokenize_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spread(load(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select("doc_id", F.explode(terms(F.col("text"))).alias("term"))
    each = found.groupBy("term", "doc_id").agg(F.count("*").alias("n"))
    return each.groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))


@CATALOG.add("A15", f"WITH {bm25_sql(DOCS_SQL, ITEMS_SQL, 8)} SELECT term, count(*) AS df, round(any_value(idf), 6) AS idf FROM lexical_p JOIN lexical_idf USING (index_id, term) GROUP BY term")
def bm25_corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunks_of(spark, sf_dir)
    return retrieval.term_stats(retrieval.postings(chunks)).select("term", "df", F.round("idf", 6).alias("idf"))


@CATALOG.add("F2, J18, T2, P11, W10, J5", f"WITH {bm25_sql(DOCS_SQL, ITEMS_SQL, 8)} SELECT query_id, chunk_id, score, rank::INTEGER AS rank FROM lexical")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.lexical_top(chunks_of(spark, sf_dir), questions_of(spark, sf_dir), 8).select("query_id", "chunk_id", "score", "rank")


LANGS = "CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 ELSE 3 END"


@CATALOG.add("P18, S24", f"""WITH {bm25_sql(f"SELECT {LANGS} AS index_id, doc_id AS chunk_id, text FROM documents", "SELECT item_id * 4 + i AS query_id, i AS index_id, text FROM benchmark, (SELECT unnest([0, 1, 2, 3]) AS i)", 8)}
    SELECT query_id, index_id, chunk_id, score, rank::INTEGER AS rank FROM lexical""")
def isolated_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question in each of four indexes; statistics and hits never cross them."""
    chunks = load(spark, sf_dir, "documents").select(F.expr(LANGS).alias("index_id"), F.col("doc_id").alias("chunk_id"), "text")
    questions = load(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array(*map(F.lit, range(4)))).alias("index_id"), "text")
    questions = questions.select((F.col("item_id") * 4 + F.col("index_id")).alias("query_id"), "index_id", "text")
    return retrieval.lexical_top(chunks, questions, 8).select("query_id", "index_id", "chunk_id", "score", "rank")


UNIT_SQL = "list_transform(embedding, lambda x: x::DOUBLE / greatest(sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))), 1e-12))"
DENSE_SQL = f"""vectors AS (SELECT vec_id, label, {UNIT_SQL} AS v FROM embeddings),
    pairs AS (SELECT q.vec_id AS query_id, q.label AS target, c.vec_id AS chunk_id, c.label, round(list_dot_product(q.v, c.v), 6) AS score FROM vectors q JOIN vectors c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
    dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM pairs QUALIFY rank <= 24)"""


def dense_hits(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """The k + 1 nearest include the query itself, which is left out."""
    vectors = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), retrieval.unit("embedding").alias("v"))
    queries = vectors.filter("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "v")
    hits = retrieval.dense_top(vectors, queries, k + 1).filter("chunk_id != query_id").drop("rank")
    return retrieval.ranked(hits, k)


@CATALOG.add("J17, T1, F3, S14", f"WITH {DENSE_SQL} SELECT query_id, chunk_id, score, rank::INTEGER AS rank FROM dense WHERE rank <= 8")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense_hits(spark, sf_dir, 8).select("query_id", "chunk_id", "score", "rank")


#: The lexical side of the hybrid: a vector's document is the one of the same id, and its text the question; documents without a vector have no dense rank.
HYBRID_ITEMS = "SELECT doc_id AS query_id, 0 AS index_id, text FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings WHERE vec_id % 20 = 0)"
FUSED_SQL = f"""{DENSE_SQL}, {bm25_sql(DOCS_SQL, HYBRID_ITEMS, 24)},
    both_r AS (SELECT query_id, chunk_id, rank AS d, NULL AS l FROM dense UNION ALL SELECT query_id, chunk_id, NULL, rank FROM lexical),
    one AS (SELECT query_id, chunk_id, min(d) AS dense_rank, min(l) AS lexical_rank FROM both_r GROUP BY ALL),
    scored AS (SELECT *, round(coalesce(1.0::DOUBLE / (60 + dense_rank), 0) + coalesce(1.0::DOUBLE / (60 + lexical_rank), 0), 9) AS score FROM one),
    fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dense_rank ASC NULLS LAST, lexical_rank) AS rank FROM scored)"""


def hybrid_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = load(spark, sf_dir, "embeddings").select("vec_id")
    docs = load(spark, sf_dir, "documents")
    asked = docs.join(ids.filter("vec_id % 20 = 0"), F.col("doc_id") == F.col("vec_id"), "left_semi").select(F.col("doc_id").alias("query_id"), F.lit(0).alias("index_id"), "text")
    lexical = retrieval.lexical_top(chunks_of(spark, sf_dir), asked, 24).select("query_id", "chunk_id", F.lit("lexical").alias("retriever"), "rank")
    dense = dense_hits(spark, sf_dir, 24).select("query_id", "chunk_id", F.lit("dense").alias("retriever"), "rank")
    return retrieval.fused(dense.unionByName(lexical))


@CATALOG.add("J8, T3, T4", f"WITH {FUSED_SQL} SELECT query_id, chunk_id, score, dense_rank::INTEGER AS dense_rank, lexical_rank::INTEGER AS lexical_rank, rank::INTEGER AS rank FROM fused WHERE rank <= 8")
def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid_hits(spark, sf_dir).filter("rank <= 8").select("query_id", "chunk_id", "score", "dense_rank", "lexical_rank", "rank")


@CATALOG.add("W9, T4", f"""WITH {FUSED_SQL}, grouped AS (SELECT query_id, chunk_id, score, rank, CASE WHEN chunk_id % 3 = 0 THEN chunk_id % 7 END AS grp FROM fused),
    kept AS (SELECT *, row_number() OVER (PARTITION BY query_id, grp ORDER BY rank) AS n FROM grouped QUALIFY grp IS NULL OR n <= 2)
    SELECT query_id, chunk_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY rank))::INTEGER AS rank FROM kept QUALIFY rank <= 8""".replace("QUALIFY rank <= 8", "QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY kept.rank) <= 8").replace("ORDER BY rank))::", "ORDER BY kept.rank))::"))
def hybrid_per_group_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most two hits of a table (here: of the chunks divisible by 3, by remainder of 7) before the cut to 8."""
    hits = hybrid_hits(spark, sf_dir).withColumn("grp", F.when(F.col("chunk_id") % 3 == 0, F.col("chunk_id") % 7))
    return retrieval.capped(hits, "grp", 2, 8).select("query_id", "chunk_id", "score", "rank")


@CATALOG.add("W11, U7", f"""WITH {DENSE_SQL}, asked AS (SELECT query_id // 60 AS question, (query_id // 20) % 3 AS sub, chunk_id, rank FROM dense WHERE rank <= 8),
    firsts AS (SELECT question, chunk_id, min(rank * 10 + sub) AS place FROM asked GROUP BY ALL),
    picks AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY place) AS pick FROM firsts QUALIFY pick <= 8),
    scores AS (SELECT question, chunk_id, round(sum(1.0::DOUBLE / (60 + rank) ORDER BY sub), 9) AS score FROM asked GROUP BY ALL)
    SELECT question AS query_id, chunk_id, score, (row_number() OVER (PARTITION BY question ORDER BY score DESC, pick))::INTEGER AS rank FROM picks JOIN scores USING (question, chunk_id)""")
def round_robin_multi_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three vectors stand for the sub-queries of one question."""
    hits = dense_hits(spark, sf_dir, 8).select(F.expr("query_id div 60").alias("query_id"), F.expr("(query_id div 20) % 3").alias("sub"), "chunk_id", "rank")
    return retrieval.round_robin(hits, 8).select("query_id", "chunk_id", "score", "rank")
