"""From the hits of a question to its prompt, an answer, and the sources that it cites."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import evidence_budget, word_count
from leafmill.operators import packing

#: Tokens that a word of a question stands for in the estimate of what its prompt leaves to the evidence.
PER_WORD = 7


def blocks(asks: DataFrame, hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, n, chunk_id, kind, tokens, text: the evidence of each question within its budget, numbered. Rows give way to whole tables, which bring the text of their sections.

    asks: query_id, question; hits: query_id, chunk_id, rank; chunks: chunk_id, kind, table_id, section_id, n_tokens, text.
    """
    placed = packing.with_discussion(packing.with_whole_tables(hits, chunks), hits, chunks)
    budget = asks.select("query_id", evidence_budget(word_count(F.col("question")) * PER_WORD).alias("budget"))
    taken = packing.packed(placed.join(chunks, "chunk_id").join(budget, "query_id")).filter("outcome != 'dropped'")
    return taken.join(chunks.select("chunk_id", "kind"), "chunk_id").select("query_id", "n", "chunk_id", "kind", "tokens", "text")


def facts(asks: DataFrame, shown: DataFrame) -> DataFrame:
    """query_id, facts: how many blocks there are, and of each of the things that a comparison names in which of them it is named. asks: query_id, pair (array)."""
    counted = shown.groupBy("query_id").agg(F.count("*").alias("n_blocks"))
    names = asks.select("query_id", F.posexplode("pair").alias("k", "name"))
    found = names.join(shown.select("query_id", "n", "text"), "query_id").groupBy("query_id", "k", "name").agg(F.array_sort(F.collect_list(F.when(F.contains(F.lower("text"), F.lower("name")), F.col("n")))).alias("in"))
    line = F.concat("name", F.lit(" is named in "), F.when(F.size("in") > 0, F.concat(F.lit("blocks "), F.array_join(F.col("in").cast("array<string>"), ", "))).otherwise("none"))
    lines = found.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", line.alias("t")))), lambda x: x["t"]).alias("lines"))
    first = F.array(F.concat(F.col("n_blocks").cast("string"), F.lit(" blocks are given")))
    return counted.join(lines, "query_id", "left").select("query_id", F.concat(first, F.coalesce("lines", F.array().cast("array<string>"))).alias("facts"))


def leading(text: Column, n: Column) -> Column:
    """Stands for a model: the first words of a block, cited."""
    return F.concat(F.array_join(F.slice(F.filter(F.split(text, r"\s+"), lambda w: w != ""), 1, 12), " "), F.lit(" ["), n, F.lit("]"))


def answered(asks: DataFrame, shown: DataFrame, generate: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """query_id, n_blocks, prompt, answer, cited, sources (chunks that the answer cites, in order of their numbers; all of them if it cites none).

    asks: query_id, question, pair; shown: what blocks() gives; generate: (prompts, blocks) -> query_id, answer; the default puts the first words of the first two blocks together.
    Questions without evidence have no row.
    """
    context = packing.rendered(shown.select("query_id", "n", F.concat(F.lit("document "), "chunk_id").alias("source"), "kind", "text"))
    prompts = packing.with_facts(context.join(facts(asks, shown), "query_id").join(asks.select("query_id", "question"), "query_id"))
    if generate is None:
        parts = shown.filter("n <= 2").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("n", leading(F.col("text"), F.col("n")).alias("t")))).alias("p"))
        answers = parts.select("query_id", F.array_join(F.transform("p", lambda x: x["t"]), " ").alias("answer"))
    else:
        answers = generate(prompts, shown)
    used = packing.cited_blocks(shown.join(answers, "query_id"), F.lit(""))
    listed = used.groupBy("query_id").agg(F.max("cited").alias("cited"), F.transform(F.array_sort(F.collect_list(F.struct("n", "chunk_id"))), lambda x: x["chunk_id"]).alias("sources"))
    size = shown.groupBy("query_id").agg(F.count("*").alias("n_blocks"))
    return prompts.join(answers, "query_id").join(listed, "query_id", "left").join(size, "query_id").select("query_id", "n_blocks", "prompt", "answer", F.coalesce("cited", F.lit(True)).alias("cited"), F.coalesce("sources", F.array().cast("array<bigint>")).alias("sources"))
