"""The corpus pipeline: from raw documents to mixed, encoded training text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import line_dedup, mixing, near_texts, pieces, quality
from leafmill.llm.common import save_point, table


def _good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labelled ones among docs, does not reject."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model).filter("quality_score >= 0.5").select(*docs.columns)


def _lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the first line of each group of near-duplicate lines; n_chars follows the text."""
    out = line_dedup.dedup_lines(docs)
    return with_sizes(out).select(*docs.columns)


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, at a similarity of 0.8 of their shingles of five words."""
    return near_texts.keep_first(docs)


def _mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's documents up to its target, once for each copy that the mix takes."""
    return mixing.apply_mix(docs)


def _encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids and the decoded text's hash of every row."""
    return pieces.op2_sentencepiece(spark, sf_dir, docs)


def with_sizes(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


STAGES = [("quality", _good), ("line_dedup", _lines), ("simhash_near_dedup", _near), ("mixing", _mixed), ("sentencepiece", _encoded)]
#: The classifier, the components and the samples are not SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are kept in the shared checkpoint folder for the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = save_point(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
