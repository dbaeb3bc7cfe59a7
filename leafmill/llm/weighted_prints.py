"""Document fingerprints by consistent weighted sampling of word counts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import row_key, save_point, slices, table

SAMPLES = 128
#: Rows of each table of draws. A term takes its three rows by separate bits of its hash.
ROWS = 1 << 14
_MANY = 4096
#: Bytes of text in one part of the documents' order, about; more where there would be over PARTS parts, whose ranges the driver gets.
PART, PARTS = 8 << 20, 20_000


class Sampler:
    """Signatures whose share of equal samples estimates the generalised Jaccard similarity, sum of least over sum of most weights.

    For a term of weight S and each sample: r, c from Gamma(2, 1), beta uniform; t = floor(ln S / r + beta);
    ln a = ln c - r (t - beta + 1). The term of least a is drawn, as the pair (term, t).
    """

    def __init__(self, samples: int = SAMPLES, seed: int = 0) -> None:
        rng = np.random.Generator(np.random.PCG64(seed))
        self.samples = samples
        self.r = rng.gamma(2, size=(ROWS, samples)).astype(np.float32)
        self.ln_c = np.log(rng.gamma(2, size=(ROWS, samples))).astype(np.float32)
        self.beta = rng.random((ROWS, samples), np.float32)

    def __call__(self, text: str) -> np.ndarray:
        """Samples as 16-bit codes; all zero if the text has no words."""
        weights = Counter(text.lower().split())
        best = np.full(self.samples, np.inf, np.float32)
        codes = np.zeros(self.samples, np.uint16)
        if not weights:
            return codes
        h = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in weights], np.uint64)
        ln_s = np.log(np.fromiter(weights.values(), np.float32, len(weights)))
        for at in range(0, len(h), _MANY):
            x, s = h[at : at + _MANY], ln_s[at : at + _MANY, None]
            rows = [(x >> np.uint64(14 * i) & np.uint64(ROWS - 1)).astype(np.intp) for i in range(3)]
            r, beta = self.r[rows[0]], self.beta[rows[2]]
            t = np.floor(s / r + beta)
            a = self.ln_c[rows[1]] - r * (t - beta + 1)
            least = a.argmin(0)
            column = np.arange(self.samples)
            found = a[least, column]
            drawn = (x[least] + t[least, column].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
            better = found < best
            best[better] = found[better]
            codes[better] = (drawn >> np.uint64(48)).astype(np.uint16)[better]
        return codes


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The last half of the code points gives way to as many of the first ones of the following text, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame) -> DataFrame:
    """part, tail, doc_id, text: dealt by part and sorted in it by descending doc_id (null last), then by the row's key.

    A part is a range of this order of about PART bytes: of doc_ids, and of keys where one doc_id (or null) has more than a part.
    Each part ends with the first row of the following one (tail is true), so every row meets its next in its own task; the last
    part ends with the very first row. The driver gets the ranges and the first key of each part. Rows that are equal in doc_id
    and text are not told apart; they stay in one part.
    """
    spark = docs.sparkSession
    k1, k2 = row_key()
    keys = save_point(docs.select("doc_id", k1.alias("k1"), k2.alias("k2"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("bytes")))
    total = keys.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    size = max(PART, -(-total // PARTS))
    ranges = max(1, -(-total // size))
    found = keys.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)] or [0.5], 10 * ranges)).first()[0] or []
    ends = Counter(found)
    # a doc_id that several ranges end at has one of its own, as the one before it ends, too
    splits = sorted({*ends, *(max(x - 1, -(2**63)) for x, n in ends.items() if n > 1)})
    known_splits = f"cast(split('{','.join(map(str, splits))}', ',') as array<bigint>)" if splits else "cast(array() as array<bigint>)"
    # how many of the splits are below doc_id, by halving
    steps = max(1, len(splits)).bit_length()
    below = f"aggregate(sequence({steps}, 0, -1), 0, (p, i) -> if(get(splits, p + shiftleft(1, i) - 1) < doc_id, p + shiftleft(1, i), p))"

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.withColumn("splits", F.expr(known_splits)).withColumn("part", F.when(F.col("doc_id").isNull(), -1).otherwise(F.expr(below))).drop("splits")

    sizes = dealt(keys).groupBy("part").agg(F.sum("bytes").alias("bytes"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    cuts = {r.part: max(1, -(-r.bytes // size)) for r in sizes.collect() if r.low == r.high or r.low is None}
    known = spark.createDataFrame(list(cuts.items()) or [(-2, 1)], "part int, cuts int")

    def placed(rows: DataFrame) -> DataFrame:
        # keys are hashes, so equal ranges of them hold about as much each
        sub = F.floor((F.shiftright("k1", 32) + 2**31) * F.coalesce("cuts", F.lit(1)) / 2**32).cast("int")
        return dealt(rows).join(F.broadcast(known), "part", "left").withColumn("sub", sub).drop("cuts")

    least = F.min(F.struct(F.bitwise_not("doc_id").alias("d"), "k1", "k2"))
    firsts = placed(keys).groupBy("part", "sub").agg(least.alias("x")).orderBy(F.desc("part"), "sub").collect()
    rows = [(i, r.part, r["sub"], *r.x, (i - 1) % len(firsts)) for i, r in enumerate(firsts)]
    of = spark.createDataFrame(rows, "at int, part int, sub int, d long, f1 long, f2 long, before int")
    is_first = (F.col("k1") == F.col("f1")) & (F.col("k2") == F.col("f2")) & F.bitwise_not("doc_id").eqNullSafe(F.col("d"))
    own, also = F.struct(F.col("at").alias("part"), F.lit(False).alias("tail")), F.struct(F.col("before").alias("part"), F.lit(True).alias("tail"))
    goes = F.when(is_first, F.array(own, also)).otherwise(F.array(own))
    spread = placed(docs.select("doc_id", k1.alias("k1"), k2.alias("k2"), "text")).join(F.broadcast(of), ["part", "sub"]).select(F.inline(goes), "doc_id", "k1", "k2", "text")
    order = ["part", "tail", F.desc_nulls_last("doc_id"), "k1", "k2"]
    return spread.repartition(max(1, len(firsts)), "part").sortWithinPartitions(*order).select("part", "tail", "doc_id", "text")


def prints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    docs: doc_id, text; other columns are left aside. A null text counts as empty; a text without words has the
    fingerprint zero. Repeated rows and equal doc_ids follow each other in the order of their texts' hashes. A lone
    document is its own next. An empty table gives no rows.
    """
    kinds = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(samples)
        part, done, pending = None, False, None
        for batch in (part for whole in batches for part in slices(whole, 3)):
            out = []
            for p, tail, doc_id, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if p != part:
                    part, done, pending = p, False, None
                if done:
                    continue
                text = text or ""
                own = pending[2] if pending is not None and pending[1] == text else sampler(text)
                if pending is not None:
                    was_id, was, code = pending
                    new = edited(was, text)
                    new_code = code if new == was else sampler(new)
                    out.append((was_id, len(was), sha256(new.encode()).hexdigest(), code.tobytes().hex(), new_code.tobytes().hex(), likeness(code, new_code), likeness(code, own)))
                pending, done = (doc_id, text, own), tail
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)

    docs = docs.select(F.col("doc_id").cast("long"), "text")
    return with_next(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return prints(table(spark, sf_dir, "documents"))
