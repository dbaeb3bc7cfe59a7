"""Queries that answer questions: evidence within a budget, summaries, evaluation."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.functions.text import evidence_budget, word_count
from leafmill.operators import evaluation, packing, summaries
from leafmill.plans.base import Catalog
from leafmill.plans.search import DENSE_SQL, dense_hits
from leafmill.sources import store
from leafmill.sources.shared import shared_folder
from leafmill.sources.tables import load

CATALOG = Catalog()

# Chunks are documents: of each ten one whole table and three rows of it; sections are hundreds.
CHUNK_SQL = """chunks AS (SELECT doc_id AS chunk_id, CASE WHEN doc_id % 10 = 0 THEN 'table_full' WHEN doc_id % 10 IN (1, 2, 3) THEN 'table_row' ELSE 'text' END AS kind, CASE WHEN doc_id % 10 < 4 AND doc_id % 70 < 60 THEN 'T' || (doc_id // 10) WHEN doc_id % 10 IN (1, 2, 3) THEN 'X' || doc_id END AS table_id, doc_id // 100 AS section_id, len(regexp_extract_all(text, '\\S+')) AS n_tokens, text FROM documents)"""
# Sixteen hits a question, spread over the corpus.
HIT_SQL = "size AS (SELECT count(*) AS n FROM documents), hits AS (SELECT DISTINCT item_id AS query_id, (item_id * 37 + i * i * 11) % n AS chunk_id, i FROM benchmark, size, unnest(range(1, 17)) AS u(i)), first_hits AS (SELECT query_id, chunk_id, min(i) AS rank FROM hits GROUP BY ALL)"
SHOWN_SQL = """known AS (SELECT query_id, h.chunk_id, rank, c.kind, c.table_id, f.chunk_id AS full_id FROM first_hits h JOIN chunks c USING (chunk_id) LEFT JOIN chunks f ON f.kind = 'table_full' AND f.table_id = c.table_id),
    shown AS (SELECT query_id, CASE WHEN kind IN ('table_row', 'table_full') THEN coalesce(full_id, chunk_id) ELSE chunk_id END AS chunk_id, min(rank) AS rank FROM known GROUP BY 1, 2)"""
ADDED_SQL = """tabs AS (SELECT query_id, rank, section_id FROM shown JOIN chunks USING (chunk_id) WHERE kind = 'table_full'), texts AS (SELECT t.query_id, t.rank, c.chunk_id, sum(c.n_tokens) OVER (PARTITION BY t.query_id, t.rank ORDER BY c.chunk_id) AS used FROM tabs t JOIN chunks c ON c.kind = 'text' AND c.section_id = t.section_id WHERE NOT EXISTS (SELECT 1 FROM first_hits h WHERE h.query_id = t.query_id AND h.chunk_id = c.chunk_id)),
    added AS (SELECT query_id, chunk_id, min(rank) AS rank FROM texts WHERE used <= 700 GROUP BY ALL), placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, k, chunk_id)::INTEGER AS place FROM (SELECT query_id, chunk_id, rank, 0 AS k FROM shown UNION ALL SELECT query_id, chunk_id, rank, 1 FROM added))"""


def chunks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    kind = F.when(d % 10 == 0, "table_full").when((d % 10).isin(1, 2, 3), "table_row").otherwise("text")
    table = F.when((d % 10 < 4) & (d % 70 < 60), F.concat(F.lit("T"), F.floor(d / 10))).when((d % 10).isin(1, 2, 3), F.concat(F.lit("X"), d))
    return load(spark, sf_dir, "documents").select(d.alias("chunk_id"), kind.alias("kind"), table.alias("table_id"), F.floor(d / 100).alias("section_id"), word_count(F.col("text")).alias("n_tokens"), "text")


def hits_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = load(spark, sf_dir, "documents").agg(F.count("*").alias("n"))
    asked = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.sequence(F.lit(1), F.lit(16))).alias("i"))
    at = (F.col("query_id") * 37 + F.col("i") * F.col("i") * 11) % F.col("n")
    return asked.crossJoin(F.broadcast(n)).groupBy("query_id", at.alias("chunk_id")).agg(F.min("i").alias("rank"))


@CATALOG.add("J6, U5", f"WITH {CHUNK_SQL}, {HIT_SQL}, {SHOWN_SQL} SELECT query_id, chunk_id, rank::INTEGER AS rank FROM shown")
def expand_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.with_whole_tables(hits_of(spark, sf_dir), chunks_of(spark, sf_dir))


@CATALOG.add("J7, W15", f"WITH {CHUNK_SQL}, {HIT_SQL}, {SHOWN_SQL}, {ADDED_SQL} SELECT query_id, chunk_id, rank::INTEGER AS rank, place FROM placed")
def discussion_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, chunks = hits_of(spark, sf_dir), chunks_of(spark, sf_dir)
    return packing.with_discussion(packing.with_whole_tables(hits, chunks), hits, chunks)


def packed_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, chunks = hits_of(spark, sf_dir), chunks_of(spark, sf_dir)
    placed = packing.with_discussion(packing.with_whole_tables(hits, chunks), hits, chunks)
    budget = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), evidence_budget(word_count(F.col("text")) * 7).alias("budget"))
    return packing.packed(placed.join(chunks, "chunk_id").join(budget, "query_id"))


BUDGET_SQL = r"budgets AS (SELECT item_id AS query_id, greatest(0, 6200 - greatest(len(regexp_extract_all(text, '\S+')) * 7, 200)) AS budget FROM benchmark)"
#: First fit with the next one tried after a drop, as a recursive walk; a text is cut at the last sentence that fits, or at the words.
PACK_SQL = rf"""cand AS (SELECT query_id, place, chunk_id, kind, n_tokens, text, budget FROM placed JOIN chunks USING (chunk_id) JOIN budgets USING (query_id)),
    sents AS (SELECT chunk_id, i, sum(len(regexp_extract_all(s[i], '\S+'))) OVER (PARTITION BY chunk_id ORDER BY i) AS used FROM (SELECT chunk_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT chunk_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM chunks WHERE kind = 'text' AND n_tokens > 80))),
    folds AS (SELECT chunk_id, list(used ORDER BY i) AS cum FROM sents GROUP BY 1),
    ready AS (SELECT c.*, coalesce(cum, []) AS cum FROM cand c LEFT JOIN folds USING (chunk_id)),
    walk AS (SELECT query_id, 0 AS place, NULL::BIGINT AS chunk_id, any_value(budget) AS room, 'start' AS outcome, 0 AS n, 0 AS tokens FROM cand GROUP BY query_id
    UNION ALL SELECT query_id, place, chunk_id, CASE WHEN outcome = 'dropped' THEN room ELSE room - size END, outcome, CASE WHEN outcome = 'dropped' THEN n ELSE n + 1 END, CASE WHEN outcome = 'dropped' THEN 0 ELSE size END FROM (
        SELECT *, CASE WHEN room <= 80 THEN 'dropped' WHEN n_tokens <= room THEN 'kept' WHEN kind <> 'text' THEN 'dropped' WHEN size < 80 THEN 'dropped' ELSE 'cut' END AS outcome FROM (
            SELECT w.query_id, r.place, r.chunk_id, w.room, w.n, r.n_tokens, r.kind, CASE WHEN r.n_tokens > w.room AND r.kind = 'text' AND w.room > 80 THEN CASE WHEN r.cum[1] <= w.room THEN list_max(list_filter(r.cum, lambda x: x <= w.room)) ELSE w.room END ELSE r.n_tokens END AS size
            FROM walk w JOIN ready r ON r.query_id = w.query_id AND r.place = w.place + 1)))"""


@CATALOG.add("W16, W12", f"WITH RECURSIVE {CHUNK_SQL}, {HIT_SQL}, {SHOWN_SQL}, {ADDED_SQL}, {BUDGET_SQL}, {PACK_SQL} SELECT query_id, place, chunk_id, outcome, CASE WHEN outcome <> 'dropped' THEN n::INTEGER END AS n, tokens::INTEGER AS tokens FROM walk WHERE place > 0")
def budget_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_of(spark, sf_dir).select("query_id", "place", "chunk_id", "outcome", "n", "tokens")


PROMPT_SQL = r"""taken AS (SELECT w.query_id, w.n, w.chunk_id, r.kind, r.text, r.cum, w.outcome, w.room + w.tokens AS room FROM walk w JOIN ready r ON r.query_id = w.query_id AND r.place = w.place WHERE w.place > 0 AND w.outcome <> 'dropped'),
    shown_ AS (SELECT *, CASE WHEN outcome = 'kept' THEN text WHEN cum[1] <= room THEN array_to_string(list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x, i: cum[i] <= room), ' ') ELSE array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')[1:room], ' ') END AS shown FROM taken),
    contexts AS (SELECT query_id, count(*) AS blocks, string_agg('[' || n || '] Source: document ' || chunk_id || chr(10) || '    Kind: ' || CASE kind WHEN 'text' THEN 'text' ELSE 'table' END || chr(10) || '    Content: ' || shown, chr(10) || chr(10) ORDER BY n) AS context FROM shown_ GROUP BY query_id),
    prompts AS (SELECT query_id, context || chr(10) || chr(10) || 'Question: ' || text || chr(10) || chr(10) || 'Computed from the tables, use as they are:' || chr(10) || '- ' || blocks || ' blocks are given' AS prompt FROM contexts JOIN benchmark ON item_id = query_id)"""


@CATALOG.add("F18, F25, E2", f"WITH RECURSIVE {CHUNK_SQL}, {HIT_SQL}, {SHOWN_SQL}, {ADDED_SQL}, {BUDGET_SQL}, {PACK_SQL}, {PROMPT_SQL} SELECT query_id, prompt FROM prompts")
def rendered_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompts of all questions: numbered evidence within the budget, the question, and facts after it."""
    blocks = packed_of(spark, sf_dir).filter("outcome != 'dropped'")
    kinds = chunks_of(spark, sf_dir).select("chunk_id", "kind")
    context = packing.rendered(blocks.join(kinds, "chunk_id").select("query_id", "n", F.concat(F.lit("document "), "chunk_id").alias("source"), "kind", "text"))
    facts = blocks.groupBy("query_id").agg(F.array(F.concat(F.count("*").cast("string"), F.lit(" blocks are given"))).alias("facts"))
    questions = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return packing.with_facts(context.join(facts, "query_id").join(questions, "query_id"))


@CATALOG.add("F23", f"WITH RECURSIVE {CHUNK_SQL}, {HIT_SQL}, {SHOWN_SQL}, {ADDED_SQL}, {BUDGET_SQL}, {PACK_SQL}, {PROMPT_SQL} SELECT query_id, len(regexp_extract_all(prompt, '\\S+'))::INTEGER AS prompt_tokens FROM prompts")
def prompt_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each prompt, as they are estimated where a stream of an answer reports none."""
    return rendered_prompts(spark, sf_dir).select("query_id", word_count(F.col("prompt")).alias("prompt_tokens"))


SEC_SQL = r"""secs AS (SELECT doc_id, (i - 1)::INTEGER AS seq, 'Part ' || i || ' ' || left(l[i], 12) AS title, CASE WHEN (i + doc_id) % 4 = 0 THEN 1 ELSE 2 END AS level, len(regexp_extract_all(l[i], '\S+')) AS n_tokens FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))),
    marked AS (SELECT *, (level <= 1 OR row_number() OVER w = 1)::INTEGER AS top FROM secs WINDOW w AS (PARTITION BY doc_id ORDER BY seq)), grouped AS (SELECT *, sum(top) OVER (PARTITION BY doc_id ORDER BY seq) AS grp FROM marked),
    sized AS (SELECT *, sum(n_tokens) OVER g AS size, count(*) OVER g AS items, first_value(title) OVER (PARTITION BY doc_id, grp ORDER BY seq) AS head FROM grouped WINDOW g AS (PARTITION BY doc_id, grp)),
    units AS (SELECT *, sum(CASE WHEN size > 350 AND items > 1 OR top = 1 AND (size >= 60 OR grp = 1) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS unit, CASE WHEN size > 350 AND items > 1 AND title <> head THEN head || ' · ' || title ELSE head END AS label FROM sized)"""


def sections_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "line"))
    i = F.col("seq") + 1
    return lines.select("doc_id", "seq", F.concat(F.lit("Part "), i, F.lit(" "), F.left("line", F.lit(12))).alias("title"), F.when((i + F.col("doc_id")) % 4 == 0, 1).otherwise(2).alias("level"), word_count(F.col("line")).alias("n_tokens"), F.col("line").alias("text"))


@CATALOG.add("A29", f"WITH {SEC_SQL} SELECT doc_id, unit::BIGINT AS unit, arg_min(label, seq) AS label, string_agg(seq::VARCHAR, ',' ORDER BY seq) AS members, sum(n_tokens)::BIGINT AS n_tokens FROM units GROUP BY doc_id, unit")
def summary_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = summaries.units(sections_of(spark, sf_dir), most=350)
    return out.select("doc_id", "unit", "label", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"), F.col("n_tokens").cast("long").alias("n_tokens"))


@CATALOG.add("J12", rf"""WITH {SEC_SQL}, u AS (SELECT doc_id, unit, arg_min(label, seq) AS label FROM units GROUP BY ALL), named AS (SELECT *, string_split(label, ' · ')[-1] AS title FROM u), bodies AS (SELECT s.doc_id, s.title, string_agg(l[s.seq + 1], chr(10) ORDER BY s.seq) AS text FROM secs s JOIN (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) USING (doc_id) GROUP BY ALL)
    SELECT n.doc_id, unit::BIGINT AS unit, label, left(trim(regexp_replace(text, '\s+', ' ', 'g')), 600) AS text FROM named n LEFT JOIN bodies b ON b.doc_id = n.doc_id AND b.title = n.title""")
def summary_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sections_of(spark, sf_dir)
    return summaries.with_source_text(summaries.units(s, most=350).select("doc_id", "unit", "label"), s).select("doc_id", "unit", "label", "text")


LEAD_SQL = r"array_to_string(string_split(regexp_replace(trim({t}), '([。！？.!?])\s+', '\1' || chr(1), 'g'), chr(1))[1:2], ' ')"
UNIT_TEXT_SQL = f"{SEC_SQL}, bodies AS (SELECT doc_id, unit, arg_min(label, seq) AS label, string_agg(l[seq + 1], chr(10) ORDER BY seq) AS text FROM units JOIN (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) USING (doc_id) GROUP BY doc_id, unit)"


def unit_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sections_of(spark, sf_dir)
    u = summaries.units(s, most=350).select("doc_id", "unit", "label", F.explode("members").alias("seq"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n")
    return u.join(s.select("doc_id", "seq", "text"), ["doc_id", "seq"]).groupBy("doc_id", "unit", "label").agg(text.alias("text"))


@CATALOG.add("A28, S26, X2", f"WITH {UNIT_TEXT_SQL}, parts AS (SELECT doc_id, string_agg('## ' || label || chr(10) || {LEAD_SQL.format(t='text')}, chr(10) || chr(10) ORDER BY unit) AS parts FROM bodies GROUP BY doc_id) SELECT doc_id, {LEAD_SQL.format(t='parts')} AS summary FROM parts")
def summarised_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extractive summaries of all documents; the generator is a parameter."""
    return summaries.summarised(unit_texts(spark, sf_dir))


@CATALOG.add("X5", f"WITH {UNIT_TEXT_SQL} SELECT count(*) AS units, sum(len(regexp_extract_all(text, '\\S+')))::BIGINT AS words FROM bodies")
def summary_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a listener hears of the summaries of all documents when they are done."""
    heard = Observation()
    summaries.summarised(unit_texts(spark, sf_dir), progress=heard).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(heard.get["units"], heard.get["words"])], "units long, words long")


@CATALOG.add("S20", "SELECT d.doc_id, l.lang FROM documents d, (SELECT unnest(['zh', 'en']) AS lang) l WHERE NOT EXISTS (SELECT 1 FROM labels c WHERE c.doc_id = d.doc_id AND CASE c.quality WHEN 1 THEN 'en' ELSE 'zh' END = l.lang)")
def missing_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = load(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "en").otherwise("zh").alias("lang"))
    return store.missing_summaries(load(spark, sf_dir, "documents"), cache, ("zh", "en"))


@CATALOG.add("S28", "SELECT doc_id, content_id FROM (SELECT doc_id, left(sha256(text), 16) AS content_id FROM documents) d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)")
def without_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains when the documents marked toxic are deleted."""
    docs = load(spark, sf_dir, "documents").select("doc_id", F.substring(F.sha2("text", 256), 1, 16).alias("content_id"))
    return docs.join(load(spark, sf_dir, "labels").filter("toxic = 1"), "doc_id", "left_anti")


# The label of a vector plays the section that a question expects; two ways of ranking and their union are the configurations.
EVAL_SQL = f"""{DENSE_SQL}, runs AS (SELECT 'dense' AS config, query_id, rank, 'Section ' || label AS title, target FROM dense WHERE rank <= 10 UNION ALL SELECT 'even', query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank), 'Section ' || label, target FROM dense WHERE chunk_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 10),
    words AS (SELECT vec_id AS query_id, 'section ' || label AS word FROM embeddings WHERE vec_id % 20 = 0 UNION SELECT vec_id, 'SECTION ' || (label + 1) % 10 FROM embeddings WHERE vec_id % 40 = 0), asked AS (SELECT config, query_id, count(DISTINCT word) AS expected FROM words, (SELECT DISTINCT config FROM runs) GROUP BY ALL),
    met AS (SELECT config, query_id, min(rank) AS rank, count(DISTINCT word) AS covered FROM runs JOIN words USING (query_id) WHERE contains(lower(title), lower(word)) GROUP BY ALL), ranks AS (SELECT config, query_id, rank, coalesce(covered, 0) AS covered, expected FROM asked LEFT JOIN met USING (config, query_id))"""


def ranks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings").select("vec_id", "label")
    hits = dense_hits(spark, sf_dir, 24).join(vectors.select(F.col("vec_id").alias("chunk_id"), F.concat(F.lit("Section "), "label").alias("title")), "chunk_id")
    even = hits.filter("chunk_id % 2 = 0").withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("rank")))
    runs = hits.withColumn("config", F.lit("dense")).unionByName(even.withColumn("config", F.lit("even"))).filter("rank <= 10")
    asked = vectors.filter("vec_id % 20 = 0")
    words = asked.select(F.col("vec_id").alias("query_id"), F.concat(F.lit("section "), "label").alias("word")).union(asked.filter("vec_id % 40 = 0").select("vec_id", F.concat(F.lit("SECTION "), (F.col("label") + 1) % 10)))
    return evaluation.first_ranks(runs.select("config", "query_id", "rank", "title"), words)


@CATALOG.add("A25, J14", f"WITH {EVAL_SQL} SELECT config, query_id, rank::INTEGER AS rank, covered, expected FROM ranks")
def eval_first_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks_of(spark, sf_dir)


@CATALOG.add("S18", f"WITH {EVAL_SQL} SELECT config, k::INTEGER AS k, count(*) FILTER (rank <= k) AS hits, round(count(*) FILTER (rank <= k) / count(*)::DOUBLE, 6) AS rate, round(avg(coalesce(rank, 11)), 6) AS mean_rank FROM ranks, unnest([10, 3]) AS u(k) GROUP BY ALL")
def published_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of an evaluation published twice, and read back."""
    folder, report = f"{shared_folder(spark)}/{uuid4().hex}", evaluation.hit_rates(ranks_of(spark, sf_dir), (10, 3))
    store.publish(report.limit(0), folder)
    return store.publish(report, folder)


@CATALOG.add("A24, A32, E3", f"WITH {EVAL_SQL} SELECT config, k::INTEGER AS k, count(*) FILTER (rank <= k) AS hits, round(count(*) FILTER (rank <= k) / count(*)::DOUBLE, 6) AS rate, round(avg(coalesce(rank, 11)), 6) AS mean_rank FROM ranks, unnest([10, 3]) AS u(k) GROUP BY ALL")
def eval_hit_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.hit_rates(ranks_of(spark, sf_dir), (10, 3))


@CATALOG.add("A26", "SELECT o_custkey AS doc_id, count(*) AS found, count(*) FILTER (o_orderstatus = 'F' AND o_orderkey % 3 > 0) AS data, count(*) FILTER (o_orderstatus <> 'F' AND o_orderkey % 3 > 0) AS prose, count(*) FILTER (o_orderkey % 3 = 0) AS failed FROM orders GROUP BY 1")
def table_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.fidelity(load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.when(F.col("o_orderstatus") == "F", "data").otherwise("prose").alias("kind"), (F.col("o_orderkey") % 3 > 0).alias("validated")))


@CATALOG.add("A27, P14", f"WITH {CHUNK_SQL} SELECT chunk_id // 10 AS doc_id, count(DISTINCT chunk_id % 3) AS sections, count(*) AS chunks, round(avg(n_tokens), 6) AS mean_tokens, max(n_tokens)::INTEGER AS most_tokens FROM chunks GROUP BY 1")
def corpus_generality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.generality(chunks_of(spark, sf_dir).select(F.floor(F.col("chunk_id") / 10).alias("doc_id"), (F.col("chunk_id") % 3).alias("section_id"), "n_tokens"))


