"""Queries over documents: text functions, routing, sections, chunks, lists of documents."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.functions import routing, text
from leafmill.operators import chunks, sections, segmentation
from leafmill.plans.base import Catalog
from leafmill.sources import urls
from leafmill.sources.shared import shared_folder
from leafmill.sources.tables import load

CATALOG = Catalog()

LINKS_SQL = """links AS (SELECT page_id, CASE page_id % 7 WHEN 0 THEN url WHEN 1 THEN ' ' || url || ' ' WHEN 2 THEN regexp_replace(url, '^https?://', '') WHEN 3 THEN lpad((page_id % 10000)::VARCHAR, 4, '0') || '.' || lpad((page_id % 100000)::VARCHAR, 5, '0') || CASE WHEN page_id % 2 = 0 THEN 'v2' ELSE '' END
    WHEN 4 THEN 'arxiv.org/abs/' || lpad((page_id % 10000)::VARCHAR, 4, '0') || '.' || lpad((page_id % 10000)::VARCHAR, 4, '0') WHEN 5 THEN replace(replace(url, 'https://', 'ftp://'), 'http://', 'ftp://') ELSE 'https://' || (page_id % 256) || '.' || (page_id * 7 % 256) || '.0.' || (page_id % 250) || '/a/b.PDF?x=1' END AS link FROM pages)"""
NORMAL_SQL = r"""CASE WHEN regexp_full_match(trim(link), '\d{4}\.\d{4,5}(v\d+)?') THEN 'https://arxiv.org/pdf/' || trim(link)
    WHEN contains(trim(link), 'arxiv.org') AND regexp_matches(link, '\d{4}\.\d{4,5}(v\d+)?') THEN 'https://arxiv.org/pdf/' || regexp_extract(link, '\d{4}\.\d{4,5}(v\d+)?')
    WHEN trim(link) LIKE 'https://%' THEN trim(link) WHEN trim(link) LIKE 'http://%' THEN 'https://' || substr(trim(link), 8)
    WHEN contains(trim(link), '://') THEN NULL ELSE 'https://' || trim(link) END"""


def links_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links in the forms that users give: as they are, without scheme, as arXiv ids, with other schemes, with addresses."""
    p, u = F.col("page_id"), F.col("url")
    four = lambda n, width: F.lpad((p % n).cast("string"), width, "0")
    link = (
        F.when(p % 7 == 0, u).when(p % 7 == 1, F.concat(F.lit(" "), u, F.lit(" "))).when(p % 7 == 2, F.regexp_replace(u, "^https?://", ""))
        .when(p % 7 == 3, F.concat(four(10000, 4), F.lit("."), four(100000, 5), F.when(p % 2 == 0, "v2").otherwise("")))
        .when(p % 7 == 4, F.concat(F.lit("arxiv.org/abs/"), four(10000, 4), F.lit("."), four(10000, 4)))
        .when(p % 7 == 5, F.replace(F.replace(u, F.lit("https://"), F.lit("ftp://")), F.lit("http://"), F.lit("ftp://")))
        .otherwise(F.concat(F.lit("https://"), p % 256, F.lit("."), p * 7 % 256, F.lit(".0."), p % 250, F.lit("/a/b.PDF?x=1")))
    )
    return load(spark, sf_dir, "pages").select("page_id", link.alias("link"))


@CATALOG.add("S3", f"WITH {LINKS_SQL} SELECT page_id, {NORMAL_SQL} AS url FROM links")
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links_of(spark, sf_dir).select("page_id", urls.normalized(F.col("link")).alias("url"))


@CATALOG.add("S4", rf"""WITH {LINKS_SQL}, named AS (SELECT page_id, trim(link) AS link, lower(regexp_extract(trim(link), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1)) AS host FROM links),
    parts AS (SELECT *, CASE WHEN regexp_full_match(host, '\d+\.\d+\.\d+\.\d+') THEN list_transform(string_split(host, '.'), lambda x: x::BIGINT) END AS b FROM named),
    numbers AS (SELECT *, b[1] * 16777216 + b[2] * 65536 + b[3] * 256 + b[4] AS ip FROM parts)
    SELECT page_id, CASE WHEN link NOT LIKE 'https://%' THEN 'scheme' WHEN host = '' THEN 'host' WHEN host = 'localhost' OR ip IS NOT NULL AND (b[1] IN (0, 10, 127) OR b[1] >= 224 OR b[1] = 100 AND b[2] BETWEEN 64 AND 127 OR b[1] = 169 AND b[2] = 254 OR b[1] = 172 AND b[2] BETWEEN 16 AND 31
        OR b[1] = 192 AND (b[2] = 168 OR b[2] = 0 AND b[3] IN (0, 2)) OR b[1] = 198 AND (b[2] IN (18, 19) OR b[2] = 51 AND b[3] = 100) OR b[1] = 203 AND b[2] = 0 AND b[3] = 113) THEN 'address' END AS refused FROM numbers""")
def url_syntactic_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links_of(spark, sf_dir).select("page_id", urls.refusal(F.trim("link")).alias("refused"))


@CATALOG.add("S5", rf"""WITH {LINKS_SQL}, paths AS (SELECT page_id, regexp_replace(regexp_replace(trim(link), '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', '') AS path FROM links),
    names AS (SELECT page_id, coalesce(nullif(string_split(path, '/')[-1], ''), 'document') AS name FROM paths)
    SELECT page_id, CASE WHEN lower(name) LIKE '%.pdf' THEN name ELSE name || '.pdf' END AS name FROM names""")
def url_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links_of(spark, sf_dir).select("page_id", urls.file_name(F.trim("link")).alias("name"))


@CATALOG.add("F21, U6", "SELECT left(sha256(text), 16) AS content_id, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").groupBy(text.content_id(F.col("text")).alias("content_id")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@CATALOG.add("F10, F26", r"""WITH t AS (SELECT conv_id, turn, regexp_replace(CASE WHEN turn % 5 = 1 THEN text || '這份文件的摘要是什麼這份文件的摘要是什麼這份文件的摘要是什麼這份文件的摘要是什麼' WHEN turn % 5 = 2 THEN '  ' ELSE text END, '\s', '', 'g') AS bare FROM conversations)
    SELECT conv_id, turn, CASE WHEN bare = '' OR len(regexp_replace(bare, '[^一-鿿぀-ヿ]', '', 'g')) / len(bare) > 0.1 THEN 'zh' ELSE 'en' END AS lang, CASE WHEN bare = '' OR len(regexp_replace(bare, '[^一-鿿぀-ヿ]', '', 'g')) / len(bare) > 0.1 THEN '摘要這份文件' ELSE 'Summarize this document' END AS quick FROM t""")
def language_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    asked = F.when(F.col("turn") % 5 == 1, F.concat(t, F.lit("這份文件的摘要是什麼" * 4))).when(F.col("turn") % 5 == 2, F.lit("  ")).otherwise(t)
    lang = text.language(asked)
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", lang.alias("lang"), F.when(lang == "en", "Summarize this document").otherwise("摘要這份文件").alias("quick"))


#: Questions of all routes from the conversations' words.
QUESTION_SQL = r"""questions AS (SELECT conv_id, turn, CASE (conv_id + turn) % 6 WHEN 0 THEN 'Compare ' || w[1] || ' with ' || w[2] || '?' WHEN 1 THEN w[1] || ' vs. ' || w[2] || ' ' || w[3] WHEN 2 THEN 'Please summarise ' || w[1] WHEN 3 THEN '比較 ' || w[1] || ' 和 ' || w[2] || '？' WHEN 4 THEN w[1] || ' 與 ' || w[2] || ' 有什麼差別' ELSE 'What about ' || w[1] || '?' END AS question
    FROM (SELECT conv_id, turn, regexp_extract_all(text, '[A-Za-z]+') AS w FROM conversations) WHERE len(w) >= 3)"""
ROUTE_SQL = f"CASE WHEN regexp_matches(question, '(?i){routing.SUMMARY}') THEN 'summary' WHEN regexp_matches(question, '(?i){routing.COMPARE}') THEN 'comparison' ELSE 'qa' END"
#: The question and, of a comparison of p, its aspects.
ASPECT_SQL = "[question, " + ", ".join("'" + t.replace("{a}", "' || p.a || '").replace("{b}", "' || p.b || '") + "'" for t in routing.ASPECTS) + "]"


def questions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.regexp_extract_all(F.col("text"), F.lit("([A-Za-z]+)"), F.lit(1))
    a, b, c, kind = F.col("w")[0], F.col("w")[1], F.col("w")[2], (F.col("conv_id") + F.col("turn")) % 6
    question = (
        F.when(kind == 0, F.concat(F.lit("Compare "), a, F.lit(" with "), b, F.lit("?"))).when(kind == 1, F.concat(a, F.lit(" vs. "), b, F.lit(" "), c))
        .when(kind == 2, F.concat(F.lit("Please summarise "), a)).when(kind == 3, F.concat(F.lit("比較 "), a, F.lit(" 和 "), b, F.lit("？")))
        .when(kind == 4, F.concat(a, F.lit(" 與 "), b, F.lit(" 有什麼差別"))).otherwise(F.concat(F.lit("What about "), a, F.lit("?")))
    )
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", w.alias("w")).filter(F.size("w") >= 3).select("conv_id", "turn", question.alias("question"))


@CATALOG.add("F11", f"WITH {QUESTION_SQL} SELECT conv_id, turn, question, {ROUTE_SQL} AS route FROM questions")
def route_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions_of(spark, sf_dir).select("conv_id", "turn", "question", routing.route(F.col("question")).alias("route"))


FORMS_SQL = "forms AS (SELECT *, " + ", ".join(f"regexp_extract(question, '(?i){form}', ['a', 'b']) AS f{k}" for k, form in enumerate(routing.PAIRS, 1)) + r""" FROM questions),
    entities AS (SELECT conv_id, turn, question, CASE WHEN len(f1.a) BETWEEN 2 AND 59 AND len(f1.b) BETWEEN 2 AND 59 THEN f1 WHEN len(f2.a) BETWEEN 2 AND 59 AND len(f2.b) BETWEEN 2 AND 59 THEN f2 WHEN len(f3.a) BETWEEN 2 AND 59 AND len(f3.b) BETWEEN 2 AND 59 THEN f3 WHEN len(f4.a) BETWEEN 2 AND 59 AND len(f4.b) BETWEEN 2 AND 59 THEN f4 END AS p FROM forms)"""


@CATALOG.add("F12", f"WITH {QUESTION_SQL}, {FORMS_SQL} SELECT conv_id, turn, p.a AS first, p.b AS second FROM entities")
def comparison_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = routing.compared(F.col("question"))
    return questions_of(spark, sf_dir).withColumn("p", pair).select("conv_id", "turn", F.try_element_at("p", F.lit(1)).alias("first"), F.try_element_at("p", F.lit(2)).alias("second"))


@CATALOG.add("U7", f"""WITH {QUESTION_SQL}, {FORMS_SQL}, asked AS (SELECT conv_id, turn, CASE WHEN p IS NULL THEN [question] ELSE {ASPECT_SQL} END AS q FROM entities)
    SELECT conv_id, turn, (i - 1)::INTEGER AS sub, q[i] AS question FROM asked, unnest(range(1, 6)) AS r(i) WHERE i <= len(q)""")
def comparison_subqueries(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("question")
    return questions_of(spark, sf_dir).select("conv_id", "turn", F.posexplode(routing.subqueries(q, routing.compared(q))).alias("sub", "question"))


DECLINE_SQL = f"(regexp_matches(answer, '(?i){text.DECLINING}') AND len(answer) < 400)"
ANSWER_SQL = "answers AS (SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN text || ' This Does Not Mention it.' WHEN 1 THEN '文件中沒有這項 ' || text WHEN 2 THEN text || ' [2] and [' || (turn + 3) || ']' ELSE text END AS answer FROM conversations)"


def answers_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, kind = F.col("text"), F.col("conv_id") % 4
    answer = F.when(kind == 0, F.concat(t, F.lit(" This Does Not Mention it."))).when(kind == 1, F.concat(F.lit("文件中沒有這項 "), t)).when(kind == 2, F.concat(t, F.lit(" [2] and ["), F.col("turn") + 3, F.lit("]"))).otherwise(t)
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", answer.alias("answer"))


@CATALOG.add("P17, F22, T7", rf"WITH {ANSWER_SQL} SELECT conv_id, turn, {DECLINE_SQL} AS declined, left(trim(regexp_replace(answer, '\s+', ' ', 'g')), 600) AS shown FROM answers")
def declined_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("answer")
    return answers_of(spark, sf_dir).select("conv_id", "turn", text.declined(a).alias("declined"), F.left(text.squeezed(a), F.lit(600)).alias("shown"))


@CATALOG.add("J13, W12, P10, P15, X4", rf"""WITH {ANSWER_SQL}, cites AS (SELECT conv_id, turn, list_transform(regexp_extract_all(answer, '\[(\d+)\]', 1), lambda x: x::BIGINT) AS used FROM answers)
    SELECT conv_id, turn, n, len(used) > 0 AS cited, 'p.' || (n * 2) || ' · section ' || n AS label FROM cites, unnest(range(1, 6)) AS b(n) WHERE len(used) = 0 OR list_contains(used, n)""")
def citation_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each answer has five numbered blocks; those it cites are its sources, or all of them, uncited, if it cites none."""
    from leafmill.operators.packing import cited_blocks

    blocks = answers_of(spark, sf_dir).withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(5).cast("long"))))
    cite = F.concat(F.lit("p."), F.col("n") * 2, F.lit(" · section "), F.col("n"))
    return cited_blocks(blocks, cite).select("conv_id", "turn", "n", "cited", "label")


# Lines of documents as blocks: every fourth line with a heading's words, some with a bare heading, a page each ten lines.
BARE_SQL = "[" + ", ".join(f"'{x}'" for x in sections.BARE) + "]"
BLOCK_SQL = rf"""lines AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, l FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
    blocks AS (SELECT doc_id, i - 1 AS ord, (i - 1) // 10 + 1 AS page, CASE WHEN i = 3 AND doc_id % 7 = 0 THEN upper({BARE_SQL}[doc_id % {len(sections.BARE)} + 1]) || ':' WHEN i % 4 = 2 AND doc_id % 3 <> 0 THEN ((i - 1) // 4 + 1) || '.' || CASE WHEN i % 8 = 2 THEN '' ELSE (i % 3 + 1) || '. ' END || left(l[i], 40) WHEN i % 10 = 1 AND doc_id % 2 = 0 THEN 'Page header ' || (doc_id % 5) WHEN i = 2 AND doc_id % 6 = 0 THEN 'Abstract of this' ELSE l[i] END AS text FROM lines WHERE trim(l[i]) <> '')"""
LEVEL_SQL = rf"""CASE WHEN len(trim(text)) > 90 OR trim(text) = '' THEN NULL WHEN list_contains({BARE_SQL}, regexp_replace(lower(trim(text)), '[ .:：]+$', '')) THEN 1
    WHEN regexp_matches(trim(text), '{sections.DOTTED}') THEN len(regexp_extract(trim(text), '{sections.DOTTED}', 1)) - len(replace(regexp_extract(trim(text), '{sections.DOTTED}', 1), '.', '')) + 1
    WHEN {" OR ".join(f"regexp_matches(trim(text), '{form}')" for form in sections.NUMBERED)} THEN 1 END"""
SECTION_SQL = rf"""{BLOCK_SQL}, headings AS (SELECT doc_id, ord, trim(regexp_replace(text, '\s+', ' ', 'g')) AS title, ({LEVEL_SQL})::INTEGER AS level FROM blocks WHERE {LEVEL_SQL} IS NOT NULL),
    sections AS (SELECT doc_id, 's' || lpad((row_number() OVER w - 1)::VARCHAR, 3, '0') AS section_id, title, level, ord::DOUBLE AS start_ord, coalesce(lead(ord) OVER w, 1e18)::DOUBLE AS end_ord FROM headings WINDOW w AS (PARTITION BY doc_id ORDER BY ord))"""


def blocks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "line")).filter(F.trim("line") != "")
    i, d = F.col("ord") + 1, F.col("doc_id")
    inner = F.when(i % 8 == 2, "").otherwise(F.concat(i % 3 + 1, F.lit(". ")))
    shown = (
        F.when((i == 3) & (d % 7 == 0), F.concat(F.upper(F.element_at(F.array(*map(F.lit, sections.BARE)), (d % len(sections.BARE) + 1).cast("int"))), F.lit(":")))
        .when((i % 4 == 2) & (d % 3 != 0), F.concat(F.floor((i - 1) / 4) + 1, F.lit("."), inner, F.left("line", F.lit(40)))).when((i % 10 == 1) & (d % 2 == 0), F.concat(F.lit("Page header "), d % 5))
        .when((i == 2) & (d % 6 == 0), "Abstract of this").otherwise(F.col("line"))
    )
    return lines.select("doc_id", F.col("ord").cast("long").alias("ord"), (F.floor((i - 1) / 10) + 1).alias("page"), shown.alias("text"))


def sections_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.sections_of(sections.text_headings(blocks_of(spark, sf_dir)).withColumn("seq", F.col("ord")))


@CATALOG.add("F7, F8, P1, S7", f"WITH {SECTION_SQL} SELECT * FROM headings")
def heading_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.text_headings(blocks_of(spark, sf_dir))


@CATALOG.add("W3, W2", f"""WITH {SECTION_SQL}, shuffled AS (SELECT *, (ord * 7 + doc_id) % 11 AS seq FROM headings), ordered AS (SELECT *, max(ord) OVER (PARTITION BY doc_id ORDER BY seq, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM shuffled),
    kept AS (SELECT * FROM ordered WHERE before IS NULL OR ord > before) SELECT doc_id, 's' || lpad((row_number() OVER w - 1)::VARCHAR, 3, '0') AS section_id, title, level, ord::DOUBLE AS start_ord, nullif(coalesce(lead(ord) OVER w, -5), -5)::DOUBLE AS end_ord FROM kept WINDOW w AS (PARTITION BY doc_id ORDER BY seq, ord)""")
def monotone_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings found out of order: those that do not come after all before them are left out."""
    found = sections.text_headings(blocks_of(spark, sf_dir)).withColumn("seq", F.struct(((F.col("ord") * 7 + F.col("doc_id")) % 11).alias("a"), "ord"))
    return sections.sections_of(found).withColumn("end_ord", F.when(F.col("end_ord") < float("inf"), F.col("end_ord")))


@CATALOG.add("J1", f"""WITH {SECTION_SQL}, fronts AS (SELECT b.doc_id, bool_or(regexp_matches(b.text, '(?i)^\\s*(abstract\\b|摘\\s*要)')) AS abstract FROM blocks b JOIN (SELECT doc_id, min(start_ord) AS first FROM sections GROUP BY 1) USING (doc_id) WHERE b.ord < first GROUP BY 1)
    SELECT b.doc_id, b.ord::DOUBLE AS ord, coalesce(s.section_id, 's000f') AS section_id, coalesce(s.title, CASE WHEN f.abstract THEN 'Abstract' ELSE 'Front matter' END) AS section_title, coalesce(s.level, 1)::INTEGER AS section_level FROM blocks b LEFT JOIN sections s ON s.doc_id = b.doc_id AND b.ord >= s.start_ord AND b.ord < s.end_ord LEFT JOIN fronts f ON f.doc_id = b.doc_id WHERE b.doc_id IN (SELECT doc_id FROM sections)""")
def assign_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.assigned(blocks_of(spark, sf_dir), sections_found(spark, sf_dir)).select("doc_id", "ord", "section_id", "section_title", "section_level")


@CATALOG.add("S11, T5", f"""WITH {BLOCK_SQL} SELECT doc_id, count(*) AS blocks, md5(string_agg(text, chr(10) ORDER BY ord)) AS digest FROM blocks WHERE page <= 3 GROUP BY doc_id""")
def page_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of the first three pages, blocks in order."""
    listed = F.array_sort(F.collect_list(F.struct("ord", "text")))
    return blocks_of(spark, sf_dir).filter("page <= 3").groupBy("doc_id").agg(F.count("*").alias("blocks"), F.md5(F.array_join(F.transform(listed, lambda b: b["text"]), "\n")).alias("digest"))


@CATALOG.add("P4", f"""WITH {BLOCK_SQL}, pages AS (SELECT doc_id, max(page) AS n_pages FROM blocks GROUP BY 1), counts AS (SELECT doc_id, text, count(*) AS n FROM blocks WHERE len(text) < 80 GROUP BY ALL)
    SELECT doc_id, text FROM counts JOIN pages USING (doc_id) WHERE n_pages >= 4 AND n >= greatest(2, floor(n_pages * 0.3))""")
def running_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = blocks_of(spark, sf_dir)
    return sections.running_text(blocks, blocks.groupBy("doc_id").agg(F.max("page").alias("n_pages")))


@CATALOG.add("W14, F5, R8", r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents), n AS (SELECT *, CASE WHEN len(w) > 450 THEN ceil((len(w) - 450) / 390.0)::INTEGER + 1 WHEN len(w) > 0 THEN 1 ELSE 0 END AS n FROM w)
    SELECT doc_id, i::INTEGER AS "window", md5(array_to_string(w[i * 390 + 1:i * 390 + 450], ' ')) AS digest, len(w[i * 390 + 1:i * 390 + 450])::INTEGER AS n_tokens FROM (SELECT *, unnest(range(n)) AS i FROM n)""")
def fixed_window_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.windows(load(spark, sf_dir, "documents")).select("doc_id", "window", F.md5("text").alias("digest"), "n_tokens")


@CATALOG.add("W17", r"""WITH s AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents), e AS (SELECT doc_id, unnest(range(1, len(s) + 1)) AS i, s FROM s),
    c AS (SELECT doc_id, i, s[i] AS sentence, sum(len(regexp_extract_all(s[i], '\S+'))) OVER (PARTITION BY doc_id ORDER BY i) AS used FROM e) SELECT doc_id, count(*) AS sentences, max(used)::BIGINT AS tokens, md5(string_agg(sentence, ' ' ORDER BY i)) AS digest FROM c WHERE used <= 100 GROUP BY doc_id""")
def sentence_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sentences that fit into 100 tokens; documents whose first does not fit are left out."""
    each = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("i", "sentence"))
    used = F.sum(text.word_count(F.col("sentence"))).over(W.partitionBy("doc_id").orderBy("i").rowsBetween(W.unboundedPreceding, 0))
    kept = each.withColumn("used", used).filter("used <= 100")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "sentence"))), lambda x: x["sentence"]), " ")
    return kept.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.max("used").cast("long").alias("tokens"), F.md5(joined).alias("digest"))


CHUNK_SQL = rf"""{BLOCK_SQL}, sized AS (SELECT doc_id, ord, page, text, len(regexp_extract_all(text, '\S+')) AS n_tokens, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS i FROM blocks),
    fold AS (SELECT doc_id, i, 0 AS n, n_tokens AS used FROM sized WHERE i = 1 UNION ALL SELECT s.doc_id, s.i, CASE WHEN f.used + s.n_tokens <= 450 THEN f.n ELSE f.n + 1 END, CASE WHEN f.used + s.n_tokens <= 450 THEN f.used + s.n_tokens ELSE s.n_tokens END FROM fold f JOIN sized s ON s.doc_id = f.doc_id AND s.i = f.i + 1)"""


@CATALOG.add("W13, W1, P20", f"""WITH RECURSIVE {CHUNK_SQL} SELECT doc_id, 's000-' || lpad(n::VARCHAR, 2, '0') AS chunk_id, first(page ORDER BY ord)::INTEGER AS page, count(*)::INTEGER AS blocks, sum(n_tokens)::INTEGER AS n_tokens, md5(string_agg(text, chr(10) ORDER BY ord)) AS digest FROM fold JOIN sized USING (doc_id, i) GROUP BY doc_id, n""")
def block_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = blocks_of(spark, sf_dir).select("doc_id", F.lit("s000").alias("section_id"), "ord", "page", "text", text.word_count(F.col("text")).alias("n_tokens"))
    out = chunks.packed_blocks(blocks)
    return out.select("doc_id", F.concat("section_id", F.lit("-"), F.lpad(F.col("n").cast("string"), 2, "0")).alias("chunk_id"), "page", F.size("ords").alias("blocks"), "n_tokens", F.md5("text").alias("digest"))


@CATALOG.add("F6, W1, E1")
def section_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section-aware chunks of all documents; recursive splitting has no SQL form and is tested on its own."""
    blocks = sections.assigned(blocks_of(spark, sf_dir), sections_found(spark, sf_dir))
    return chunks.section_chunks(blocks.select("doc_id", "section_id", "ord", "page", "text", text.word_count(F.col("text")).alias("n_tokens")))


@CATALOG.add("P9", "SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 THEN text ELSE 'Title ' || doc_id || chr(10) || text END) AS digest FROM documents")
def embedding_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("Title "), F.col("doc_id")))
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(text.titled(title, F.col("text"))).alias("digest"))


@CATALOG.add("F20, U1", r"""SELECT doc_id, 'doc-info' AS chunk_id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'Title: ' || source || chr(10) END || 'Beginning (authors, affiliations, abstract): ' || left(trim(regexp_replace(text, '\s+', ' ', 'g')), 600) || chr(10) || (n_chars // 3000 + 1) || ' pages, ' || (len(text) - len(replace(text, chr(10), '')) + 1) || ' sections.' AS text FROM documents""")
def document_info_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    profiles = load(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("source")).alias("title"), F.col("text").alias("front"), (F.floor(F.col("n_chars") / 3000) + 1).alias("n_pages"), lines.alias("n_sections"))
    return chunks.about_document(profiles)


@CATALOG.add("J15, T6, S27, S19", """WITH sources AS (SELECT doc_id, 'file' || doc_id || '.pdf' AS filename, CASE WHEN doc_id % 5 <> 0 THEN lpad((doc_id * 7919 % 100000)::VARCHAR, 5, '0') END AS uploaded FROM documents WHERE doc_id % 7 <> 0), summaries AS (SELECT doc_id FROM labels WHERE quality = 1)
    SELECT d.doc_id, coalesce(CASE WHEN d.doc_id % 3 = 0 THEN d.source END, s.filename, d.doc_id::VARCHAR) AS title, s.uploaded, EXISTS (SELECT 1 FROM summaries m WHERE m.doc_id = d.doc_id) AS has_summary, row_number() OVER (ORDER BY coalesce(s.uploaded, '') DESC, d.doc_id)::INTEGER AS place FROM documents d LEFT JOIN sources s USING (doc_id) QUALIFY place <= 500""")
def document_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list as a page shows it, from the sources that were written beside the documents: the 500 uploaded last."""
    from leafmill.sources.store import listing, publish

    docs = load(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("title"))
    d = F.col("doc_id")
    sources = docs.filter(d % 7 != 0).select("doc_id", F.concat(F.lit("file"), d, F.lit(".pdf")).alias("filename"), F.when(d % 5 != 0, F.lpad((d * 7919 % 100000).cast("string"), 5, "0")).alias("uploaded"))
    sources = publish(sources, f"{shared_folder(spark)}/{uuid4().hex}")
    return listing(docs, sources, load(spark, sf_dir, "labels").filter("quality = 1").select("doc_id"), 500)


@CATALOG.add("J20", """WITH kw AS (SELECT * FROM (VALUES (0, 'the'), (1, 'ein'), (2, 'que'), (3, 'les')) t(i, k)), hit AS (SELECT DISTINCT doc_id, i, k FROM documents JOIN kw ON contains(lower(string_split(text, chr(10))[1]), k))
    SELECT doc_id, k AS keyword, row_number() OVER (PARTITION BY doc_id ORDER BY i)::INTEGER AS place FROM hit QUALIFY place <= 2""")
def quick_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a fixed list of keywords the first two that a title (the first line) holds."""
    titles = load(spark, sf_dir, "documents").select("doc_id", F.lower(F.split_part("text", F.lit("\n"), F.lit(1))).alias("title"))
    words = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("keyword")) for i, k in enumerate(("the", "ein", "que", "les"))])
    hit = titles.select("doc_id", "title", F.inline(words)).filter(F.contains("title", F.col("keyword"))).select("doc_id", "i", "keyword").distinct()
    return hit.withColumn("place", F.row_number().over(W.partitionBy("doc_id").orderBy("i"))).filter("place <= 2").drop("i")


@CATALOG.add("J22", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'query: ' WHEN 1 THEN '为这个句子生成表示以用于检索相关文章：' ELSE '' END || title AS query, md5(CASE WHEN doc_id % 3 = 0 THEN 'passage: ' ELSE '' END || text) AS passage FROM (SELECT doc_id, text, 'Which source is ' || source || '?' AS title FROM documents)")
def model_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("doc_id") % 3
    model = F.when(kind == 0, "intfloat/multilingual-e5-small").when(kind == 1, "BAAI/bge-small-zh-v1.5").otherwise("all-MiniLM-L6-v2")
    question = F.concat(F.lit("Which source is "), "source", F.lit("?"))
    return load(spark, sf_dir, "documents").select("doc_id", text.prefixed(model, question, "query").alias("query"), F.md5(text.prefixed(model, F.col("text"), "passage")).alias("passage"))


@CATALOG.add("F19", "SELECT item_id, greatest(0, 10000 - 1800 - 1500 - 500 - greatest(len(regexp_extract_all(text, '\\S+')) * 7, 200))::INTEGER AS budget FROM benchmark")
def budget_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "benchmark").select("item_id", text.evidence_budget(text.word_count(F.col("text")) * 7).alias("budget"))


@CATALOG.add("R2", f"""WITH {SECTION_SQL}, ways AS (SELECT doc_id, 0 AS way, ord FROM headings WHERE ord % 4 = 0 UNION ALL SELECT doc_id, 1, ord FROM headings UNION ALL SELECT doc_id, 2, ord FROM blocks WHERE ord % 5 = 0), n AS (SELECT doc_id, way, count(*) AS sections FROM ways GROUP BY ALL HAVING count(*) >= 3)
    SELECT doc_id, way::INTEGER AS way, sections FROM n QUALIFY way = min(way) OVER (PARTITION BY doc_id)""")
def section_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of an outline, headings and even parts the first way that finds three sections or more in a document."""
    blocks = blocks_of(spark, sf_dir)
    heads = sections.text_headings(blocks)
    found = sections.cascade(heads.filter("ord % 4 = 0").select("doc_id", "ord"), heads.select("doc_id", "ord"), blocks.filter("ord % 5 = 0").select("doc_id", "ord"))
    return found.groupBy("doc_id", "way").agg(F.count("*").alias("sections"))


@CATALOG.add("J4", f"""WITH RECURSIVE {SECTION_SQL}, e AS (SELECT doc_id, title, level, ord, (ord // 10)::DOUBLE * 10000 AS top, CASE WHEN ord % 3 = 0 THEN []::DOUBLE[] ELSE [ord::DOUBLE, ord::DOUBLE + 5] END AS places, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS i FROM headings),
    walk AS (SELECT doc_id, i, ord AS seq, title, level, coalesce(list_filter(places, lambda x: x > -1)[1], greatest(0::DOUBLE, top)) AS place FROM e WHERE i = 1 UNION ALL SELECT e.doc_id, e.i, e.ord, e.title, e.level, coalesce(list_filter(e.places, lambda x: x > w.place)[1], greatest(w.place + 1, e.top)) FROM walk w JOIN e ON e.doc_id = w.doc_id AND e.i = w.i + 1)
    SELECT doc_id, seq::INTEGER AS seq, title, level, place AS ord FROM walk""")
def outline_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outline entries (headings of the blocks) located in their documents one after another."""
    heads = sections.text_headings(blocks_of(spark, sf_dir))
    d = heads.select("doc_id", F.col("ord").cast("int").alias("seq"), "title", "level", (F.floor(F.col("ord") / 10) + 1).cast("int").alias("page"), F.when(F.col("ord") % 3 == 0, F.array().cast("array<double>")).otherwise(F.array(F.col("ord").cast("double"), (F.col("ord") + 5).cast("double"))).alias("places"))
    return sections.located(d)


#: Letters as CJK characters, for text of both scripts: the first half of a turn has such characters in place of letters, without spaces between words.
LETTERS, CHARACTERS = "abcdefghijklmnopqrstuvwxyz", "".join(chr(0x4E01 + 7 * k) for k in range(26))


@CATALOG.add("F1, F2", rf"""WITH RECURSIVE mixed AS (SELECT conv_id, turn, translate(replace(lower(left(text, len(text) // 2)), ' ', ''), '{LETTERS}', '{CHARACTERS}') || ' ' || substr(text, len(text) // 2 + 1) AS text FROM conversations),
    runs AS (SELECT conv_id, turn, i, r[i] AS run FROM (SELECT conv_id, turn, r, unnest(range(1, len(r) + 1)) AS i FROM (SELECT conv_id, turn, regexp_extract_all(text, '[一-鿿぀-ヿ]+') AS r FROM mixed))),
    subs AS (SELECT run[p:p + n - 1] AS word FROM (SELECT run, unnest(range(1, len(run) + 1)) AS p FROM runs), (SELECT unnest([1, 2, 3, 4]) AS n) WHERE p + n - 1 <= len(run)), freq AS (SELECT word, count(*) AS n FROM subs GROUP BY word), whole AS (SELECT sum(n) AS chars FROM freq WHERE len(word) = 1),
    v AS (SELECT word, round(ln(chars / n::DOUBLE) * 1e6)::BIGINT AS cost FROM freq, whole WHERE len(word) = 1 OR n >= 2), once AS (SELECT DISTINCT run FROM runs),
    walk(run, i, costs, lens) AS (SELECT run, 0, [0::BIGINT], []::INTEGER[] FROM once UNION ALL SELECT run, i + 1, list_append(costs, best.c), list_append(lens, -best.l) FROM (SELECT w.run, w.i, w.costs, w.lens, list_min(list_filter([{{'c': w.costs[i + 1] + v1.cost, 'l': -1}}, {{'c': CASE WHEN i >= 1 THEN w.costs[i] + v2.cost END, 'l': -2}}, {{'c': CASE WHEN i >= 2 THEN w.costs[i - 1] + v3.cost END, 'l': -3}}, {{'c': CASE WHEN i >= 3 THEN w.costs[i - 2] + v4.cost END, 'l': -4}}], lambda x: x.c IS NOT NULL)) AS best
        FROM walk w LEFT JOIN v v1 ON v1.word = w.run[i + 1:i + 1] LEFT JOIN v v2 ON v2.word = w.run[i:i + 1] AND i >= 1 LEFT JOIN v v3 ON v3.word = w.run[i - 1:i + 1] AND i >= 2 LEFT JOIN v v4 ON v4.word = w.run[i - 2:i + 1] AND i >= 3 WHERE i < len(w.run))),
    done AS (SELECT run, lens FROM walk WHERE i = len(run)), back(run, lens, i, words) AS (SELECT run, lens, len(run), []::VARCHAR[] FROM done UNION ALL SELECT run, lens, i - lens[i], list_prepend(run[i - lens[i] + 1:i], words) FROM back WHERE i > 0),
    cut AS (SELECT run, words FROM back WHERE i = 0), cjk AS (SELECT conv_id, turn, string_agg(array_to_string(words, ' '), ' ' ORDER BY i) AS c FROM runs JOIN cut USING (run) GROUP BY ALL), latin AS (SELECT conv_id, turn, array_to_string(list_transform(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9._\-+%/]*'), lambda t: lower(t)), ' ') AS l FROM mixed)
    SELECT conv_id, turn, trim(l || ' ' || coalesce(c, '')) AS terms FROM latin LEFT JOIN cjk USING (conv_id, turn)""")
def segmented_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of text of both scripts, with words that the corpus itself teaches."""
    half = F.expr("cast(length(text) div 2 as int)")
    turned = F.translate(F.replace(F.lower(F.expr("left(text, cast(length(text) div 2 as int))")), F.lit(" "), F.lit("")), LETTERS, CHARACTERS)
    mixed = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(turned, F.lit(" "), F.substr("text", half + 1)).alias("text"))
    return segmentation.segmented(mixed, ["conv_id", "turn"]).select("conv_id", "turn", F.array_join("terms", " ").alias("terms"))
