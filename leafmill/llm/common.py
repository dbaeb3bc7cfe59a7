"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.sources.shared import save_point, scratch, sent, shared_folder, stored  # noqa: F401 (for the operators)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Tables:
    """Tables of one schema that follow each other in a folder, or else in the shared one; each overwrites the one before the last."""

    def __init__(self, spark: SparkSession, schema: str, folder: str | None = None) -> None:
        self.spark, self.schema, self.count = spark, schema, 0
        self.base = f"{folder or shared_folder(spark)}/{uuid4().hex}"

    def put(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.base}-{self.count % 2}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(self.schema).parquet(path)


def text_key(text: Column | str) -> list[Column]:
    """Two independent 64-bit hashes; null has its own key, apart from the empty text."""
    text = F.col(text) if isinstance(text, str) else text
    return [F.xxhash64(text, text.isNull()), F.xxhash64(F.lit("second"), text, text.isNull())]


def row_key(doc_id: Column | str = "doc_id", text: Column | str = "text") -> list[Column]:
    """Key of a document by content: rows with equal doc_id and equal text are one document that was read twice."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    a, b = text_key(text)
    return [F.xxhash64(doc_id, doc_id.isNull(), a), F.xxhash64(F.lit("second"), doc_id, doc_id.isNull(), b)]


def apart(df: DataFrame) -> str:
    """A beginning for names of columns that none of df's has."""
    return "_" * (1 + max((len(c) - len(c.lstrip("_")) for c in df.columns), default=0))


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, text: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in slices whose texts (column number `text`) have about `most` bytes, so that few are held as Python objects; a longer text has one of its own."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = np.flatnonzero(np.diff(sizes // most)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def whole_groups(batches: Iterable[pd.DataFrame], by: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """From batches sorted by `by`: frames in which every group is whole, with the offsets at which groups start and the end.

    A group that spans batches is carried on to the next frame.
    """
    carry: list[pd.DataFrame] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        edge = np.ones(len(batch), bool)
        edge[1:] = np.logical_or.reduce([batch[c].values[1:] != batch[c].values[:-1] for c in by])
        key = tuple(batch[c].iloc[0] for c in by)
        edge[0] = last is None or key != last
        last = tuple(batch[c].iloc[-1] for c in by)
        starts = np.flatnonzero(edge)
        if not len(starts):
            carry.append(batch)
            continue
        done = pd.concat([*carry, batch.iloc[: starts[-1]]], ignore_index=True)
        if len(done):
            first = sum(map(len, carry))
            inner = starts[:-1] + first
            yield done, np.unique(np.concatenate([[0], inner, [len(done)]]))
        carry = [batch.iloc[starts[-1] :]]
    if carry:
        done = pd.concat(carry, ignore_index=True)
        yield done, np.array([0, len(done)])


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow column's texts one after another, and where each begins, with the end; null as empty."""
    texts = pc.fill_null(column.cast(pa.large_binary()), b"")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    return data, at - at[0]
