"""Units of a summary, and the summary by map and reduce."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.functions.text import word_count

#: Tokens beyond which a group is taken section by section, and below which a unit joins the one before it.
MOST, LEAST = 3500, 60


def units(sections: DataFrame, most: int = MOST, least: int = LEAST) -> DataFrame:
    """doc_id, unit (from 0), label, members (section numbers), n_tokens. sections: doc_id, seq, title, level, n_tokens.

    A section of level 1 begins a group, as does the first. A group that is too long gives a unit for each section, labelled with the group;
    a group that is short joins the unit before it.
    """
    order = W.partitionBy("doc_id").orderBy("seq")
    s = sections.withColumn("top", ((F.col("level") <= 1) | (F.row_number().over(order) == 1)).cast("int"))
    s = s.withColumn("grp", F.sum("top").over(order.rowsBetween(W.unboundedPreceding, 0)))
    own = W.partitionBy("doc_id", "grp")
    s = s.withColumn("size", F.sum("n_tokens").over(own)).withColumn("items", F.count("*").over(own)).withColumn("head", F.first("title").over(own.orderBy("seq")))
    split = (F.col("size") > most) & (F.col("items") > 1)
    s = s.withColumn("split", split)
    opens = F.col("split") | (F.col("top") == 1) & ((F.col("size") >= least) | (F.col("grp") == 1))
    s = s.withColumn("unit", F.sum(F.when(opens, 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, 0)) - 1)
    label = F.when(F.col("split") & (F.col("title") != F.col("head")), F.concat("head", F.lit(" · "), "title")).otherwise(F.col("head"))
    s = s.withColumn("label", label)
    return s.groupBy("doc_id", "unit").agg(F.min_by("label", "seq").alias("label"), F.array_sort(F.collect_list("seq")).alias("members"), F.sum("n_tokens").alias("n_tokens"))


def leading_sentences(text: Column, n: int = 2) -> Column:
    """A summary without a model: the first sentences."""
    return F.array_join(F.slice(F.split(F.trim(text), r"(?<=[。！？.!?])\s+"), 1, n), " ")


def summarised(units: DataFrame, generate=leading_sentences, progress: Observation | None = None) -> DataFrame:
    """doc_id, summary: each unit's text is summarised, and what they give, in order under their labels, once more. units: doc_id, unit, label, text.

    generate: from a text column to a text column; a model is put in as a pandas UDF. progress: gets units and words, the units that were
    summarised and the words that they had, when the result has been computed.
    """
    if progress is not None:
        units = units.observe(progress, F.count("*").alias("units"), F.sum(word_count(F.col("text"))).alias("words"))
    each = units.select("doc_id", "unit", F.concat(F.lit("## "), "label", F.lit("\n"), generate(F.col("text"))).alias("part"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("unit", "part"))), lambda x: x["part"]), "\n\n")
    return each.groupBy("doc_id").agg(joined.alias("parts")).select("doc_id", generate(F.col("parts")).alias("summary"))


def with_source_text(units: DataFrame, sections: DataFrame) -> DataFrame:
    """units with the start of the sections that they come from: the last part of a label with ' · ' names one. sections: doc_id, title, text."""
    named = units.withColumn("title", F.element_at(F.split("label", " · "), -1))
    text = sections.groupBy("doc_id", "title").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return named.join(text, ["doc_id", "title"], "left").withColumn("text", F.left(F.trim(F.regexp_replace("text", r"\s+", " ")), F.lit(600))).drop("title")
