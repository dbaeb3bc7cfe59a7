"""Intermediate tables in the folder that driver and executors share, and tables that are small enough to be sent to all tasks."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one task gets of a table that is dealt out.
SHARE = 4 << 20
#: Bytes of a table that is sent to all tasks at most; what is larger is joined by a shuffle.
SENT = 32 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, made ready for checkpoint(). Where none is set, a private one, but in local mode alone."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*)?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp())
    return sc.getCheckpointDir()


def save_point(df: DataFrame) -> DataFrame:
    """Cuts the lineage through the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder in the shared one for tables that are needed only until what is made of them has been saved; it goes with all that is in it."""
    folder = f"{shared_folder(spark)}/{uuid4().hex}"
    try:
        yield folder
    finally:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, folder: str) -> DataFrame:
    """Cuts the lineage by a table in a folder, of which later steps read the columns that they need."""
    path = f"{folder}/{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sent(rows: DataFrame, size: int) -> DataFrame:
    """Marks a table for broadcast if its size in bytes is within SENT."""
    return F.broadcast(rows) if size <= SENT else rows


def spread(df: DataFrame, *by: str, text: str = "text", size: int = SHARE) -> DataFrame:
    """Rows dealt out by a key, in so many parts that each has about `size` bytes of text, however large the table is."""
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-total // size)), *by)
