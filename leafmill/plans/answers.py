"""Questions answered by their route: what is searched, how rankings are put together, and which tables and rows are shown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import routing
from leafmill.operators import answering, packing, retrieval
from leafmill.plans import documents, questions, search
from leafmill.plans.base import Catalog
from leafmill.sources.shared import save_point

CATALOG = Catalog()
#: Hits of a question, and how many more a comparison gets.
HITS, MORE = 8, 6

# A question of no other route that names a table is looked up in it: here those of every third conversation.
ASK_SQL = rf"""{documents.QUESTION_SQL}, {documents.FORMS_SQL}, {questions.CHUNK_SQL}, tabs AS (SELECT table_id, min(chunk_id) AS chunk_id FROM chunks WHERE kind = 'table_full' AND table_id IS NOT NULL GROUP BY 1),
    asks AS (SELECT *, CASE WHEN base = 'qa' AND named IS NOT NULL THEN 'table_lookup' ELSE base END AS route FROM (SELECT conv_id * 1000 + turn AS query_id, question, p, {documents.ROUTE_SQL} AS base, CASE WHEN conv_id % 3 = 0 THEN 'T' || (conv_id % 20) END AS named FROM entities)),
    subs AS (SELECT query_id, i - 1 AS sub, q[i] AS text FROM (SELECT query_id, CASE WHEN route = 'comparison' AND p IS NOT NULL THEN {documents.ASPECT_SQL} ELSE [question] END AS q FROM asks WHERE route <> 'summary'), unnest(range(1, 6)) AS r(i) WHERE i <= len(q)),
    {search.bm25_sql(search.DOCS_SQL, "SELECT query_id * 10 + sub AS query_id, 0 AS index_id, text FROM subs", HITS + MORE)},
    found AS (SELECT a.query_id, l.query_id % 10 AS sub, chunk_id, rank, route, p FROM lexical l JOIN asks a ON a.query_id = l.query_id // 10 WHERE rank <= CASE route WHEN 'comparison' THEN {HITS + MORE} ELSE {HITS} END),
    firsts AS (SELECT query_id, chunk_id, min(rank * 10 + sub) AS place FROM found GROUP BY ALL), picks AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS pick FROM firsts QUALIFY pick <= {HITS + MORE}),
    sums AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank) ORDER BY sub), 9) AS score FROM found GROUP BY ALL), turns AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pick) AS rank FROM picks JOIN sums USING (query_id, chunk_id)),
    names AS (SELECT query_id, route, CASE WHEN route = 'comparison' AND p IS NOT NULL THEN list_filter([lower(p.a), lower(p.b)], lambda x: len(x) > 2) ELSE [] END AS names FROM asks),
    fit AS (SELECT t.* FROM turns t JOIN names USING (query_id) JOIN chunks c USING (chunk_id) WHERE len(names) < 2 OR kind <> 'table_row' OR (contains(lower(text), names[1]) AND contains(lower(text), names[2]))),
    led AS (SELECT query_id, chunk_id, 0 AS rank FROM asks JOIN tabs ON table_id = named WHERE route = 'table_lookup'),
    first_hits AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id) AS rank FROM (SELECT * FROM led UNION ALL SELECT * FROM fit f WHERE NOT EXISTS (SELECT 1 FROM led l WHERE l.query_id = f.query_id AND l.chunk_id = f.chunk_id))),
    {questions.SHOWN_SQL}"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, question, pair (of a comparison), named (a table, or null), route."""
    q, pair = F.col("question"), routing.compared(F.col("question"))
    # routing is much work for few bytes and is asked for by several steps: dealt out by question, and done once
    plain = documents.questions_of(spark, sf_dir)
    plain = plain.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "conv_id", "turn")
    out = plain.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "question", pair.alias("pair"), F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("T"), F.col("conv_id") % 20)).alias("named"))
    return save_point(out.withColumn("route", routing.route(q, F.col("named").isNotNull())).withColumn("pair", F.when(F.col("route") == "comparison", F.col("pair")).otherwise(F.array().cast("array<string>"))))


def routed_hits(asks: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, chunk_id, rank: the hits of each question that is searched. asks: query_id, question, pair, named, route; chunks: chunk_id, kind, table_id, text.

    A comparison is searched by its aspects too, for more hits, which are taken in turn; of its table rows only those that name both
    things stay. A table that a question names comes first.
    """
    subs = asks.filter("route != 'summary'").select("query_id", "route", F.posexplode(routing.subqueries(F.col("question"), F.col("pair"))).alias("sub", "text"))
    hits = retrieval.lexical_top(chunks.select(F.lit(0).alias("index_id"), "chunk_id", "text"), subs.select((F.col("query_id") * 10 + F.col("sub")).alias("query_id"), F.lit(0).alias("index_id"), "text"), HITS + MORE)
    hits = hits.select(F.floor(F.col("query_id") / 10).alias("query_id"), (F.col("query_id") % 10).cast("int").alias("sub"), "chunk_id", "rank").join(asks.select("query_id", "route"), "query_id")
    hits = hits.filter(F.col("rank") <= F.when(F.col("route") == "comparison", HITS + MORE).otherwise(HITS))
    turns = retrieval.round_robin(hits.select("query_id", "sub", "chunk_id", "rank"), HITS + MORE).select("query_id", "chunk_id", "rank")
    fit = packing.named_rows(turns.join(chunks, "chunk_id").join(asks.select("query_id", "pair"), "query_id"), "pair").select("query_id", "chunk_id", "rank")
    whole = chunks.filter("kind = 'table_full' and table_id is not null").groupBy("table_id").agg(F.min("chunk_id").alias("chunk_id"))
    led = asks.filter("route = 'table_lookup'").join(whole, F.col("named") == F.col("table_id")).select("query_id", "chunk_id")
    return packing.named_first(fit, led)


def evidence(asks: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, chunk_id, rank: the hits, of which rows give way to their whole tables."""
    return packing.with_whole_tables(routed_hits(asks, chunks), chunks)


@CATALOG.add("J19, P12, U7", f"WITH {ASK_SQL} SELECT query_id, route, chunk_id, rank::INTEGER AS rank FROM shown JOIN asks USING (query_id)")
def routed_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    asks = asked(spark, sf_dir)
    out = evidence(asks, questions.chunks_of(spark, sf_dir))
    return out.join(asks.select("query_id", "route"), "query_id").select("query_id", "route", "chunk_id", "rank")


@CATALOG.add("P13", f"""WITH {ASK_SQL}, rows_ AS (SELECT s.query_id, c.table_id, c.chunk_id, len(list_filter([lower(p.a), lower(p.b)], lambda x: contains(lower(c.text), x))) > 0 AS hit FROM shown s JOIN asks a USING (query_id) JOIN chunks f ON f.chunk_id = s.chunk_id AND f.kind = 'table_full' JOIN chunks c ON c.table_id = f.table_id AND c.kind = 'table_row' WHERE route = 'comparison' AND p IS NOT NULL)
    SELECT query_id, table_id, chunk_id FROM rows_ QUALIFY hit OR sum(hit::INTEGER) OVER (PARTITION BY query_id, table_id) = 0""")
def focused_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the whole tables shown for a comparison the rows that name one of both; all of a table's if none does."""
    asks, chunks = asked(spark, sf_dir), questions.chunks_of(spark, sf_dir)
    shown = evidence(asks, chunks).join(asks.filter("size(pair) = 2").select("query_id", "pair"), "query_id")
    tables = shown.join(chunks.filter("kind = 'table_full'").select("chunk_id", "table_id"), "chunk_id").select("query_id", "pair", "table_id")
    rows = tables.join(chunks.filter("kind = 'table_row'").select("table_id", "chunk_id", F.col("text").alias("row_label")), "table_id")
    return packing.focused_rows(rows, "pair").select("query_id", "table_id", "chunk_id")


PACKED_SQL = questions.PROMPT_SQL[: questions.PROMPT_SQL.index("prompts AS")].rstrip().rstrip(",")
ANSWERED_SQL = rf"""{questions.ADDED_SQL.replace("tabs", "shown_tabs")}, budgets AS (SELECT query_id, greatest(0, 6200 - greatest(len(regexp_extract_all(question, '\S+')) * 7, 200)) AS budget FROM asks), {questions.PACK_SQL}, {PACKED_SQL},
    pairs AS (SELECT query_id, 1 AS k, p.a AS name FROM asks WHERE route = 'comparison' AND p IS NOT NULL UNION ALL SELECT query_id, 2, p.b FROM asks WHERE route = 'comparison' AND p IS NOT NULL),
    told AS (SELECT query_id, k, name || ' is named in ' || coalesce('blocks ' || string_agg(n::VARCHAR, ', ' ORDER BY n) FILTER (contains(lower(shown), lower(name))), 'none') AS line FROM pairs JOIN shown_ USING (query_id) GROUP BY query_id, k, name), facts AS (SELECT query_id, string_agg(chr(10) || '- ' || line, '' ORDER BY k) AS more FROM told GROUP BY query_id),
    written AS (SELECT query_id, string_agg(array_to_string(list_filter(regexp_split_to_array(shown, '\s+'), lambda x: x <> '')[1:12], ' ') || ' [' || n || ']', ' ' ORDER BY n) AS answer FROM shown_ WHERE n <= 2 GROUP BY query_id), used AS (SELECT query_id, answer, list_transform(regexp_extract_all(answer, '\[(\d+)\]', 1), lambda x: x::BIGINT) AS ns FROM written),
    sourced AS (SELECT query_id, string_agg(chunk_id::VARCHAR, ',' ORDER BY n) AS sources FROM shown_ JOIN used USING (query_id) WHERE list_contains(ns, n) GROUP BY query_id)"""


@CATALOG.add("E1, P12, F18, X4", rf"""WITH RECURSIVE {ASK_SQL}, {ANSWERED_SQL}
    SELECT query_id, route, blocks AS n_blocks, md5(context || chr(10) || chr(10) || 'Question: ' || question || chr(10) || chr(10) || 'Computed from the tables, use as they are:' || chr(10) || '- ' || blocks || ' blocks are given' || coalesce(more, '')) AS prompt, answer, coalesce(sources, '') AS sources
    FROM contexts JOIN asks USING (query_id) JOIN written USING (query_id) LEFT JOIN facts USING (query_id) LEFT JOIN sourced USING (query_id)""")
def answered_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each question to its answer: route, search, whole tables and their discussion, budget, facts, prompt, and the sources that the answer cites."""
    asks, chunks = asked(spark, sf_dir), questions.chunks_of(spark, sf_dir)
    shown = save_point(answering.blocks(asks, save_point(routed_hits(asks, chunks)), chunks))
    out = answering.answered(asks, shown).join(asks.select("query_id", "route"), "query_id")
    return out.select("query_id", "route", "n_blocks", F.md5("prompt").alias("prompt"), "answer", F.array_join(F.col("sources").cast("array<string>"), ",").alias("sources"))
