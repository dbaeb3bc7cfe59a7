"""Headings, sections and what belongs to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.functions.text import squeezed

LONGEST, FEWEST = 90, 3
#: Fixed value: how an abstract begins.
ABSTRACT = r"(?iu)^\s*(abstract\b|摘\s*要)"
#: Headings without a number, as academic papers have them.
BARE = (
    "abstract", "introduction", "background", "related work", "method", "methods", "methodology", "approach", "experiments",
    "experimental setup", "evaluation", "results", "discussion", "ablation study", "ablation studies", "limitations",
    "conclusion", "conclusions", "references", "acknowledgments", "acknowledgements", "appendix",
)
#: Forms of a numbered heading.
DOTTED = r"(?s)^(\d+(?:\.\d+)*)\.?\s*\n?\s*(\S.{2,80})$"
NUMBERED = (r"(?s)^第\s*[一二三四五六七八九十百千\d]+\s*[章節篇]\s*(.{0,80})$", r"(?si)^(?:chapter|section|part)\s+(?:\d+|[IVXLC]+)\b(.{0,80})$", r"(?s)^([IVXLC]+)\.\s+(\S.{2,80})$")


def heading_level(text: Column) -> Column:
    """Level of a heading by its text, from 1 (one more for each dot of its number); null if it is none."""
    t = F.trim(text)
    bare = F.regexp_replace(F.lower(t), "[ .:：]+$", "").isin(*BARE)
    number = F.regexp_extract(t, DOTTED, 1)
    other = F.lit(False)
    for form in NUMBERED:
        other = other | t.rlike(form)
    level = F.when(bare, 1).when(number != "", F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1).when(other, 1)
    return F.when((F.length(t) <= LONGEST) & (t != ""), level)


def text_headings(blocks: DataFrame) -> DataFrame:
    """doc_id, ord, title, level of the blocks that are headings by their text. blocks: doc_id, ord, text."""
    return blocks.withColumn("level", heading_level(F.col("text"))).filter("level is not null").select("doc_id", "ord", squeezed(F.col("text")).alias("title"), "level")


def font_headings(blocks: DataFrame, sizes: DataFrame) -> DataFrame:
    """The same by font size: those of a document's heading sizes, a level each from the largest. sizes: doc_id, size."""
    levels = sizes.distinct().withColumn("level", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("size"))))
    return blocks.filter(F.length(F.trim("text")) <= LONGEST).join(levels, ["doc_id", "size"]).select("doc_id", "ord", squeezed(F.col("text")).alias("title"), "level")


def sections_of(headings: DataFrame) -> DataFrame:
    """doc_id, section_id, title, level, start_ord, end_ord (infinite for the last). headings: doc_id, ord, title, level, seq.

    seq is the order in which headings were found; one that does not come after all before it is left out.
    """
    before = F.max("ord").over(W.partitionBy("doc_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1))
    kept = headings.withColumn("before", F.coalesce(before, F.lit(-1.0))).filter("ord > before")
    order = W.partitionBy("doc_id").orderBy("seq")
    number = F.row_number().over(order) - 1
    return kept.select("doc_id", F.concat(F.lit("s"), F.lpad(number.cast("string"), 3, "0")).alias("section_id"), "title", "level", F.col("ord").cast("double").alias("start_ord"), F.coalesce(F.lead("ord").over(order).cast("double"), F.lit(float("inf"))).alias("end_ord"))


def cascade(*found: DataFrame) -> DataFrame:
    """Of several ways to find sections, for each document the first that gives three or more, with its place as `way`."""
    every = None
    for k, sections in enumerate(found):
        one = sections.withColumn("way", F.lit(k))
        every = one if every is None else every.unionByName(one)
    counted = every.withColumn("n", F.count("*").over(W.partitionBy("doc_id", "way"))).filter(F.col("n") >= FEWEST)
    return counted.withColumn("best", F.min("way").over(W.partitionBy("doc_id"))).filter("way = best").drop("n", "best")


def running_text(blocks: DataFrame, pages: DataFrame, share: float = 0.3) -> DataFrame:
    """doc_id, text of page headers and footers: short texts in a third of the pages of documents of four pages or more. pages: doc_id, n_pages."""
    counts = blocks.filter(F.length("text") < 80).groupBy("doc_id", "text").agg(F.count("*").alias("n"))
    limit = F.greatest(F.lit(2), F.floor(F.col("n_pages") * share))
    return counts.join(pages.filter("n_pages >= 4"), "doc_id").filter(F.col("n") >= limit).select("doc_id", "text")


def assigned(blocks: DataFrame, sections: DataFrame) -> DataFrame:
    """blocks with section_id, section_title, section_level: of the last section that starts at or before them.

    Blocks before the first section make up a front section: Abstract if one of them begins so, else Front matter. One sort of
    starts and blocks together, no join: each block takes the last start before it.
    """
    starts = sections.select("doc_id", F.col("start_ord").alias("ord"), F.struct("section_id", "title", "level").alias("starts"), F.lit(0).alias("kind"))
    rows = blocks.withColumn("ord", F.col("ord").cast("double")).withColumn("kind", F.lit(1))
    both = starts.unionByName(rows, allowMissingColumns=True)
    last = F.last("starts", ignorenulls=True).over(W.partitionBy("doc_id").orderBy("ord", "kind").rowsBetween(W.unboundedPreceding, 0))
    any_section = F.max(F.col("starts").isNotNull()).over(W.partitionBy("doc_id"))
    out = both.withColumn("s", last).withColumn("has", any_section).filter("kind = 1 and has")
    front = F.max(F.col("s").isNull() & F.col("text").rlike(ABSTRACT)).over(W.partitionBy("doc_id"))
    named = F.when(F.col("s").isNotNull(), F.col("s.title")).when(front, "Abstract").otherwise("Front matter")
    return out.withColumn("section_title", named).withColumn("section_id", F.coalesce("s.section_id", F.lit("s000f"))).withColumn("section_level", F.coalesce("s.level", F.lit(1))).drop("starts", "kind", "s", "has")


def owning_section(tables: DataFrame, sections: DataFrame) -> DataFrame:
    """tables with the section_id whose range holds their order, null if none."""
    s = sections.select(F.col("doc_id").alias("_doc"), "section_id", "start_ord", "end_ord")
    t = tables.join(s, (F.col("doc_id") == F.col("_doc")) & (F.col("ord") >= F.col("start_ord")) & (F.col("ord") < F.col("end_ord")), "left")
    return t.drop("_doc", "start_ord", "end_ord")


def without_tables(blocks: DataFrame, tables: DataFrame, above: float = 90, below: float = 20) -> DataFrame:
    """Blocks outside of all table regions (a margin above for the caption). tables: doc_id, page, y0, y1; blocks: doc_id, page, y0, y1."""
    t = tables.select(F.col("doc_id").alias("_doc"), F.col("page").alias("_page"), F.col("y0").alias("_top"), F.col("y1").alias("_bottom"))
    inside = (F.col("doc_id") == F.col("_doc")) & (F.col("page") == F.col("_page")) & (F.col("y0") >= F.col("_top") - above) & (F.col("y0") <= F.col("_bottom")) & (F.col("y1") <= F.col("_bottom") + below)
    return blocks.join(t, inside, "left_anti")


def located(entries: DataFrame) -> DataFrame:
    """doc_id, seq, title, level, ord of outline entries, each after the one before it. entries: doc_id, seq, title, level, page, places (where its title occurs).

    An entry takes its first place after the previous one's; without any, the top of its page or one after the previous.
    """
    listed = entries.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "title", "level", "page", F.array_sort("places").alias("places")))).alias("e"))
    kind = "array<struct<seq:int,title:string,level:int,ord:double>>"
    step = f"""aggregate(e, struct(cast(array() as {kind}) as out, cast(-1 as double) as prev), (a, x) -> named_struct(
        'out', concat(a.out, array(named_struct('seq', cast(x.seq as int), 'title', x.title, 'level', cast(x.level as int), 'ord', coalesce(get(filter(x.places, p -> p > a.prev), 0), greatest(a.prev + 1, cast((greatest(x.page, 1) - 1) * 10000 as double)))))),
        'prev', coalesce(get(filter(x.places, p -> p > a.prev), 0), greatest(a.prev + 1, cast((greatest(x.page, 1) - 1) * 10000 as double)))), a -> a.out)"""
    return listed.select("doc_id", F.inline(F.expr(step)))
