"""How well rankings find the sections that are expected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_ranks(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """config, query_id, rank (of the first hit whose title holds an expected word, null if none), covered and expected words.

    hits: config, query_id, rank, title; expected: query_id, word.
    """
    asked = hits.select("config").distinct().crossJoin(expected.groupBy("query_id").agg(F.count_distinct("word").alias("expected")))
    met = hits.join(expected, "query_id").filter(F.contains(F.lower("title"), F.lower("word")))
    found = met.groupBy("config", "query_id").agg(F.min("rank").alias("rank"), F.count_distinct("word").alias("covered"))
    return asked.join(found, ["config", "query_id"], "left").select("config", "query_id", "rank", F.coalesce("covered", F.lit(0)).alias("covered"), "expected")


def hit_rates(ranks: DataFrame, depths: tuple[int, ...]) -> DataFrame:
    """config, k, hits, rate and mean rank (a miss counts as 11)."""
    rows = ranks.withColumn("k", F.explode(F.array(*map(F.lit, depths))))
    hit = F.coalesce(F.col("rank") <= F.col("k"), F.lit(False))
    return rows.groupBy("config", "k").agg(F.count_if(hit).alias("hits"), F.round(F.count_if(hit) / F.count("*"), 6).alias("rate"), F.round(F.avg(F.coalesce("rank", F.lit(11))), 6).alias("mean_rank"))


def fidelity(tables: DataFrame) -> DataFrame:
    """doc_id and how many of its tables are data, prose, validated or failed. tables: doc_id, kind, validated."""
    return tables.groupBy("doc_id").agg(F.count("*").alias("found"), F.count_if((F.col("kind") == "data") & F.col("validated")).alias("data"), F.count_if((F.col("kind") == "prose") & F.col("validated")).alias("prose"), F.count_if(~F.col("validated")).alias("failed"))


def generality(chunks: DataFrame) -> DataFrame:
    """doc_id, sections, chunks, mean and most tokens. chunks: doc_id, section_id, n_tokens."""
    return chunks.groupBy("doc_id").agg(F.count_distinct("section_id").alias("sections"), F.count("*").alias("chunks"), F.round(F.avg("n_tokens"), 6).alias("mean_tokens"), F.max("n_tokens").alias("most_tokens"))
