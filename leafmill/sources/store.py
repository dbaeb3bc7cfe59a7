"""Datasets of an index: writing, reading, listing, deleting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Datasets that an index consists of; sections came later, so older indexes may lack them.
PARTS = ("chunks", "tables", "cells", "sections", "vectors")


def save(frames: dict[str, DataFrame], folder: str) -> None:
    """Each part goes to its own dataset, a directory for each document; a document written again replaces what it had."""
    for name, df in frames.items():
        if name not in PARTS:
            raise ValueError(f"unknown part {name}")
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_id").parquet(f"{folder}/{name}")


def read(spark: SparkSession, folder: str, part: str, schema: T.StructType | str, doc_ids: list | None = None) -> DataFrame:
    """A part of the index, empty if it was never written; of some documents only their directories are read."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{part}")
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    df = spark.read.schema(schema).parquet(f"{folder}/{part}") if there else spark.createDataFrame([], schema)
    return df.filter(F.col("doc_id").isin(doc_ids)) if doc_ids is not None else df


def delete(spark: SparkSession, folder: str, doc_id: str) -> bool:
    """Removes a document from all parts; false if it was in none."""
    gone = False
    for part in PARTS:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{part}/doc_id={doc_id}")
        gone = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True) or gone
    spark.catalog.clearCache()
    return gone


def listing(docs: DataFrame, sources: DataFrame, summaries: DataFrame, show: int) -> DataFrame:
    """doc_id, title (else file name, else id), uploaded, has_summary, place: the latest uploads first, those without a time last; the first `show`."""
    rows = docs.join(sources, "doc_id", "left").join(summaries.select("doc_id").distinct().withColumn("has", F.lit(True)), "doc_id", "left")
    rows = rows.select("doc_id", F.coalesce("title", "filename", F.col("doc_id").cast("string")).alias("title"), "uploaded", F.coalesce("has", F.lit(False)).alias("has_summary"))
    top = rows.orderBy(F.desc(F.coalesce("uploaded", F.lit(""))), "doc_id").limit(show)
    return top.withColumn("place", F.row_number().over(W.orderBy(F.desc(F.coalesce("uploaded", F.lit(""))), "doc_id")))


def checked_uploads(spark: SparkSession, folder: str, most: int = 30 << 20, files: DataFrame | None = None) -> DataFrame:
    """doc_id by content, path, length, content of all files of a folder, and refused: name, size or content, or null where a file is taken. files: path,
    length and content where they are read already, as binaryFile lists all files of the folder in the driver."""
    files = spark.read.format("binaryFile").load(folder) if files is None else files
    why = F.when(~F.lower("path").endswith(".pdf"), "name").when(F.col("length") > most, "size").when(F.coalesce(F.substring("content", 1, 4), F.lit(b"")) != F.lit(b"%PDF"), "content")
    return files.select(F.substring(F.sha2("content", 256), 1, 16).alias("doc_id"), "path", "length", "content", why.alias("refused"))


def uploads(spark: SparkSession, folder: str, most: int = 30 << 20) -> DataFrame:
    """PDF files of a folder: doc_id by content, path, length, content; other names, larger files and other content are left out."""
    return checked_uploads(spark, folder, most).filter("refused is null").drop("refused")


def append(events: DataFrame, folder: str) -> None:
    """Adds events to a log of JSON lines."""
    events.write.mode("append").json(folder)


def appended(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """The events of a log; lines that are not JSON are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(folder)


def publish(report: DataFrame, folder: str) -> DataFrame:
    """Writes a report in place of the last one, and gives what is read back."""
    report.write.mode("overwrite").parquet(folder)
    return report.sparkSession.read.schema(report.schema).parquet(folder)


def missing_summaries(docs: DataFrame, cache: DataFrame, languages: tuple[str, ...]) -> DataFrame:
    """doc_id, lang of the summaries to be made: all languages but what the cache (doc_id, lang) has."""
    return docs.select("doc_id", F.explode(F.array(*map(F.lit, languages))).alias("lang")).join(cache, ["doc_id", "lang"], "left_anti")
