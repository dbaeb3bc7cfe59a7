"""Queries over files of PDF: documents are written as files to the shared folder and read back."""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.functions import pdf
from leafmill.operators import pages
from leafmill.plans.base import Catalog
from leafmill.sources import pdf as source
from leafmill.sources import store, versions
from leafmill.sources.shared import save_point, shared_folder, spread
from leafmill.sources.tables import load

CATALOG = Catalog()
#: Lines of a page; the first of each page is larger, and an outline entry points to it, every third page one level down.
PER_PAGE = 40


def as_files(docs: DataFrame) -> DataFrame:
    """file, content of each document (doc_id, text): its lines on pages, the first of a page larger and in the outline; titled by every other document's id."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                lines = (text or "").split("\n")
                leaves = [lines[k : k + PER_PAGE] for k in range(0, len(lines), PER_PAGE)]
                outline = [(2 if k % 3 else 1, f"{k + 1} {leaf[0][:30]}", k + 1) for k, leaf in enumerate(leaves)]
                out.append(pdf.written([[(x, 10 if i else 14) for i, x in enumerate(leaf)] for leaf in leaves], outline, f"Document {doc_id}" if doc_id % 2 else "none"))
            yield pd.DataFrame({"file": "d" + frame["doc_id"].astype(str) + ".pdf", "content": out})

    return spread(docs.select("doc_id", "text"), "doc_id").mapInPandas(run, "file string, content binary")


def kept_files(spark: SparkSession, sf_dir: str) -> str:
    """All documents as files in a folder of the shared one."""
    folder = f"{shared_folder(spark)}/{uuid4().hex}"
    source.write_files(as_files(load(spark, sf_dir, "documents")), folder, folders=True)
    return folder


def doc_id() -> F.Column:
    return F.regexp_extract("file", r"d(\d+)\.pdf", 1).cast("long").alias("doc_id")


LINES_SQL = f"lines AS (SELECT doc_id, i - 1 AS n, string_split(text, chr(10))[i] AS line FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)), paged AS (SELECT *, n // {PER_PAGE} + 1 AS page FROM lines)"


@CATALOG.add("S7, R6", f"""WITH {LINES_SQL} SELECT doc_id, page::INTEGER AS page, count(*) AS n_lines, md5(string_agg(line, chr(10) ORDER BY n)) AS content, sum(len(line))::BIGINT AS n_chars, count(DISTINCT page) OVER (PARTITION BY doc_id) AS n_pages FROM paged GROUP BY doc_id, page""".replace("count(DISTINCT page) OVER (PARTITION BY doc_id)", "count(*) OVER (PARTITION BY doc_id)"))
def pdf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's lines as they were written, and the pages of each file."""
    objects = source.read_objects(spark, kept_files(spark, sf_dir))
    parts = save_point(pages.structure(objects))
    lines = pages.lines(pages.runs(objects, parts)).groupBy("file", "page").agg(
        F.count("*").alias("n_lines"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda s: s["text"]), "\n")).alias("content"), F.sum(F.char_length("text")).alias("n_chars"),
    )
    files = parts.filter("what = 'file'").select("file", F.col("n").cast("long").alias("n_pages"))
    return lines.join(files, "file").select(doc_id(), "page", "n_lines", "content", "n_chars", "n_pages")


@CATALOG.add("S7", f"""WITH {LINES_SQL}, placed AS (SELECT *, n % {PER_PAGE} AS row FROM paged WHERE doc_id % 10 = 3)
    SELECT doc_id, page::INTEGER AS page, row::INTEGER AS row, line AS text, CASE row WHEN 0 THEN 14.0::DOUBLE ELSE 10.0::DOUBLE END AS size, 50.0::DOUBLE AS x0, round(CASE row WHEN 0 THEN 18.0::DOUBLE ELSE 43.0 + 15 * (row - 1) END, 3) AS y0, round(50.0 + 0.5 * CASE row WHEN 0 THEN 14.0::DOUBLE ELSE 10.0::DOUBLE END * len(line), 3) AS x1 FROM placed""")
def pdf_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of the files whose names end in 3, with boxes and sizes; only these files are opened."""
    objects = source.read_objects(spark, kept_files(spark, sf_dir)).filter(F.col("file").endswith("3.pdf"))
    shown = pages.lines(pages.runs(objects, save_point(pages.structure(objects))))
    row = (F.row_number().over(W.partitionBy("file", "page").orderBy("seq")) - 1).alias("row")
    return shown.select(doc_id(), "page", row, "text", "size", "x0", F.round("y0", 3).alias("y0"), F.round("x1", 3).alias("x1"))


@CATALOG.add("S10", f"""WITH {LINES_SQL} SELECT doc_id, page::INTEGER AS n, CASE WHEN (page - 1) % 3 = 0 THEN 1 ELSE 2 END AS level, trim(regexp_replace(page || ' ' || left(line, 30), '\\s+', ' ', 'g')) AS title, page::INTEGER AS page FROM paged WHERE n % {PER_PAGE} = 0""")
def pdf_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outline of every file, in order, from its plain objects alone."""
    objects = source.read_objects(spark, kept_files(spark, sf_dir)).filter("kind in ('plain', 'trailer')")
    found = pages.structure(objects).filter("what = 'outline'")
    return found.select(doc_id(), "n", "level", "title", "page")


@CATALOG.add("R4, R6", f"""WITH {LINES_SQL}, first AS (SELECT doc_id, max(CASE WHEN n = 0 THEN trim(regexp_replace(line, '\\s+', ' ', 'g')) END) AS line, max(page) AS n_pages FROM paged GROUP BY doc_id)
    SELECT doc_id, n_pages::INTEGER AS n_pages, CASE WHEN doc_id % 2 = 1 AND len('Document ' || doc_id) >= 8 THEN 'Document ' || doc_id WHEN len(line) BETWEEN 8 AND 250 THEN line ELSE 'd' || doc_id || '.pdf' END AS title FROM first""")
def pdf_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and title of each file: its own, else the largest line of the first page, else its name."""
    objects = source.read_objects(spark, kept_files(spark, sf_dir))
    parts = save_point(pages.structure(objects))
    first = pages.lines(pages.runs(objects, parts.withColumn("what", F.when((F.col("what") != "page") | (F.col("page") == 1), F.col("what")))))
    clean = F.trim(F.regexp_replace("text", r"\s+", " "))
    largest = first.groupBy("file").agg(F.max_by(clean, F.struct("size", -F.col("seq"))).alias("line")).filter(F.length("line").between(8, 250))
    return pages.document_titles(parts, largest).select(doc_id(), "n_pages", "title")


@CATALOG.add("S1", """WITH named AS (SELECT doc_id, len(text) AS n FROM documents) SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'name' WHEN doc_id % 5 = 0 THEN 'content' END AS refused FROM named""")
def uploads_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every uploaded file with the reason why it is refused, if it is: every seventh has another ending, every fifth is no PDF."""
    folder = f"{shared_folder(spark)}/{uuid4().hex}"
    n = F.regexp_extract("file", r"d(\d+)", 1).cast("long")
    files = as_files(load(spark, sf_dir, "documents"))
    named = files.select(F.when(n % 7 == 0, F.replace("file", F.lit(".pdf"), F.lit(".txt"))).otherwise(F.col("file")).alias("file"), F.when(n % 5 == 0, F.encode(F.lit("plain"), "utf-8")).otherwise(F.col("content")).alias("content"))
    source.write_files(named, folder, folders=True)
    return store.checked_uploads(spark, folder, files=source.read_whole(spark, folder)).select(F.regexp_extract("path", r"d(\d+)\.\w+$", 1).cast("long").alias("doc_id"), "refused")


@CATALOG.add("S12, S13, S28", """WITH v AS (SELECT 1 AS version, doc_id, source, text FROM documents UNION ALL SELECT 3, doc_id, source, CASE WHEN doc_id % 10 = 1 THEN reverse(text) ELSE text END FROM documents WHERE doc_id % 25 <> 2),
    p AS (SELECT version, 'text' AS part, doc_id, md5(text) AS digest FROM v UNION ALL SELECT version, 'source', doc_id, source FROM v WHERE NOT (version = 3 AND doc_id % 10 = 1)) SELECT version, part, doc_id, digest FROM p""")
def index_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of all documents in two parts; a reader of the first version, which goes on reading it while every tenth document is replaced (and loses its source)
    and some are deleted; and what is there after that."""
    docs = load(spark, sf_dir, "documents")
    index = versions.Index(spark, f"{shared_folder(spark)}/{uuid4().hex}", 16)
    first = index.save({"text": docs.select("doc_id", "text"), "source": docs.select("doc_id", "source")})

    def shown(version: int) -> DataFrame:
        text = index.read("text", version=version).select("doc_id", F.md5("text").alias("digest"), F.lit("text").alias("part"))
        return text.unionByName(index.read("source", version=version).select("doc_id", F.col("source").alias("digest"), F.lit("source").alias("part"))).select(F.lit(version).alias("version"), "part", "doc_id", "digest")

    reader = shown(first)
    index.save({"text": docs.filter("doc_id % 10 = 1").select("doc_id", F.reverse("text").alias("text"))})
    last = index.delete(docs.filter("doc_id % 25 = 2"))
    return reader.unionByName(shown(last))
