"""Removal of long repeated strings by suffix order and longest-previous-factor arrays, shard by shard.

A string of `length` bytes belongs to the shard of the least hash among its 32-byte grams, so equal strings meet in one
shard. Consecutive strings of one shard form a stretch; only stretches of shards with more than one go any further.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import row_key, save_point, slices, table, utf8, whole_groups

GRAM = 32
#: Strings in one stretch at most; longer ones are cut.
LONGEST = 2048
#: Bytes of a shard's different stretches up to which one task sorts its suffixes. In larger shards strings are counted by hash, shuffled by that hash.
HOT = 3 << 20
#: Bytes of smaller shards that are sorted together.
SORTED = 1 << 20
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _grams(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the 32 bytes from each position."""
    h = (data.astype(np.uint64) + np.uint64(1)) * _A
    k = 1
    while k < GRAM:
        h = (h[:-k] * _A + h[k:]) * _B
        h ^= h >> np.uint64(29)
        k *= 2
    return h


def _least(h: np.ndarray, w: int) -> np.ndarray:
    """Least of each w consecutive values."""
    n = len(h) - w + 1
    x = np.concatenate([h, np.full(-len(h) % w, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    before = np.minimum.accumulate(x, axis=1).reshape(-1)
    after = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(after[:n], before[w - 1 : w - 1 + n])


def stretches(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shard, first and last start (exclusive) of each maximal run of strings of one shard, and whether its gram occurs in it twice."""
    none = np.zeros(0, np.int64)
    if len(text) < length:
        return none, none, none, none
    w, grams = length - GRAM + 1, _grams(np.frombuffer(text, np.uint8))
    least = _least(grams, w)
    starts = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    ends = np.append(starts[1:], len(least))
    if (ends - starts).max() > LONGEST:
        cut = [np.arange(s, e, LONGEST) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
        starts = np.concatenate(cut)
        ends = np.append(starts[1:], len(least))
    shards = least[starts]
    twice = np.array([np.count_nonzero(grams[s : e + w - 1] == v) > 1 for s, e, v in zip(starts.tolist(), ends.tolist(), shards, strict=True)])
    return shards.view(np.int64), starts, ends, twice


def suffix_order(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes by their first `length` bytes, ties by position; and the rank by position, equal for equal first bytes. length: 8 at least."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key <<= np.uint64(8)
        key |= padded[i : i + n]
    known, step = 8, 8
    while True:
        order = np.argsort(key, kind="stable").astype(np.int32)
        differs = np.zeros(n, bool)
        key = key[order]
        differs[1:] = key[1:] != key[:-1]
        rank = np.empty(n, np.int32)
        rank[order] = np.cumsum(differs, dtype=np.int32)
        if known == length:
            return order, rank
        step = min(known, length - known)
        key = rank.astype(np.uint64) * np.uint64(n + 2)
        key[: n - step] += rank[step:].astype(np.uint64) + np.uint64(1)
        known += step


def previous_smaller(values: np.ndarray) -> np.ndarray:
    """Index of the nearest smaller value before each, or -1."""
    found = np.arange(-1, len(values) - 1, dtype=np.int32)
    todo = np.arange(len(values), dtype=np.int32)
    while len(todo := todo[(found[todo] >= 0) & (values[found[todo]] > values[todo])]):
        found[todo] = found[found[todo]]
    return found


def earlier_matches(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """For each of the starts (ascending positions with `length` bytes from them) an earlier start of the same string, as index into starts, or -1.

    The longest previous factor of a suffix is the longer of the common prefixes with its previous and its next smaller
    position in suffix order. It has `length` bytes or more if and only if one of both has the same rank.
    """
    order, rank = suffix_order(data, length)
    wanted = np.full(len(data), -1, np.int32)
    wanted[starts] = np.arange(len(starts), dtype=np.int32)
    at = wanted[order]
    del order, wanted
    at = at[at >= 0]
    ranks = rank[starts][at]
    before = previous_smaller(at)
    after = len(at) - 1 - previous_smaller(at[::-1])[::-1]
    found = np.full(len(starts), -1, np.int32)
    for near, there in ((after, after < len(at)), (before, before >= 0)):
        near = np.where(there, near, 0)
        same = there & (ranks[near] == ranks)
        found[at[same]] = at[near[same]]
    return found


def _runs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive values."""
    if not len(at):
        return at, at
    cut = np.flatnonzero(np.diff(at) != 1)
    return at[np.concatenate([[0], cut + 1])], at[np.append(cut, len(at) - 1)]


def _occurrences(texts: DataFrame, length: int) -> DataFrame:
    kinds = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("k1", "k2", "shard", "s1", "s2")), ("start", pa.int32()), ("n", pa.int32()), ("twice", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 3)):
            shards, starts, counts, hashes, rows, twices = [], [], [], [], [], []
            for i, text in enumerate(utf8(batch.column(3))):
                shard, start, end, twice = stretches(text, length)
                hashes += [xxhash.xxh3_128_digest(text[s : e + length - 1]) for s, e in zip(start.tolist(), end.tolist(), strict=True)]
                shards.append(shard)
                twices.append(twice.astype(bool))
                starts.append(start)
                counts.append(end - start)
                rows.append(np.full(len(shard), i))
            if hashes:
                s = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
                of = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(of) for k in range(3)), pa.array(np.concatenate(shards)), pa.array(s[:, 0].copy()), pa.array(s[:, 1].copy()), pa.array(np.concatenate(starts).astype(np.int32)), pa.array(np.concatenate(counts).astype(np.int32)), pa.array(np.concatenate(twices))], schema=kinds)

    return texts.mapInArrow(run, "doc_id long, k1 long, k2 long, shard long, s1 long, s2 long, start int, n int, twice boolean")


def _cut(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the wanted stretches."""
    kinds = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("k1", "k2", "shard", "copies")), ("start", pa.int32()), ("hot", pa.bool_()), ("bytes", pa.binary())])
    lists = wanted.groupBy("k1", "k2").agg(F.collect_set(F.struct("shard", "copies", "start", "n", "hot")).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 3)):
            out = []
            for doc_id, k1, k2, text, x in zip(*(batch.column(k).to_pylist() for k in range(3)), utf8(batch.column(3)), batch.column(4).to_pylist(), strict=True):
                out += [(doc_id, k1, k2, s["shard"], s["copies"], s["start"], s["hot"], text[s["start"] : s["start"] + s["n"] + length - 1]) for s in x]
                if len(out) > 4000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)

    # one of the rows that are there several times gives them all
    joined = texts.join(lists, ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select("doc_id", "k1", "k2", "text", "x")
    return joined.mapInArrow(run, "doc_id long, k1 long, k2 long, shard long, copies long, start int, hot boolean, bytes binary")


def _sorted_matches(cut: DataFrame, length: int, keep: str) -> DataFrame:
    """Repeated runs within the stretches, by suffix order: k1, k2, first and last byte (exclusive)."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "k1", "k2", "start"], na_position="last", kind="stable") if keep == "first" else frame
        sizes = frame["bytes"].str.len().values
        data = np.frombuffer(b"".join(frame["bytes"]), np.uint8)
        offset = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        counts = sizes - length + 1
        row = np.repeat(np.arange(len(frame), dtype=np.int32), counts)
        within = np.arange(len(row), dtype=np.int32) - np.repeat((np.cumsum(counts) - counts).astype(np.int32), counts)
        found = earlier_matches(data, offset.astype(np.int32)[row] + within, length)
        marked = found >= 0
        if keep == "none":
            marked[found[marked]] = True
        first, last = _runs(np.flatnonzero(marked))
        # a run of strings that goes on from one stretch to another of the buffer is cut at the stretch
        inside = np.flatnonzero(marked[1:] & marked[:-1] & (row[1:] != row[:-1])) if len(row) > 1 else np.zeros(0, int)
        first, last = np.sort(np.concatenate([first, inside + 1])), np.sort(np.concatenate([last, inside]))
        if keep == "none":
            of = frame["copies"].values[row[first]] == 1
            first, last = first[of], last[of]
        r = row[first]
        start = frame["start"].values[r]
        return pd.DataFrame({"k1": frame["k1"].values[r], "k2": frame["k2"].values[r], "a": start + within[first], "b": start + within[last] + length})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for frame, at in whole_groups(batches, ["shard"]):
            sizes = np.concatenate([[0], np.cumsum(frame["bytes"].str.len().values)])
            s = 0
            for e in at[1:].tolist():
                held_all = size + sizes[e] - sizes[s]
                if held_all > SORTED:
                    yield one(pd.concat([*held, frame.iloc[s:e]], ignore_index=True))
                    held, size, s = [], 0, e
            if s < len(frame):
                held.append(frame.iloc[s:])
                size += sizes[-1] - sizes[s]
        if held:
            yield one(pd.concat(held, ignore_index=True))

    return cut.filter("not hot").drop("hot").repartition("shard").sortWithinPartitions("shard").mapInPandas(run, "k1 long, k2 long, a int, b int")


def _counted_matches(cut: DataFrame, length: int, keep: str) -> DataFrame:
    """The same for shards of very many stretches: strings by their 128-bit hash."""
    kinds = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("k1", "k2", "copies", "w1", "w2")), ("a", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (start, data) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                n = len(data) - length + 1
                w = np.frombuffer(b"".join([xxhash.xxh3_128_digest(data[k : k + length]) for k in range(n)]), np.int64).reshape(-1, 2)
                of = pa.array(np.full(n, i))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(of) for k in range(4)), pa.array(w[:, 0].copy()), pa.array(w[:, 1].copy()), pa.array(np.arange(start, start + n, dtype=np.int32))], schema=kinds)

    strings = cut.filter("hot").select("doc_id", "k1", "k2", "copies", "start", "bytes").mapInArrow(run, "doc_id long, k1 long, k2 long, copies long, w1 long, w2 long, a int")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2", "a")
    known = strings.groupBy("w1", "w2").agg(F.count("*").alias("n"), F.min(order).alias("first")).filter("n > 1")
    marked = strings.join(known, ["w1", "w2"])
    marked = marked.filter(order != F.col("first")) if keep == "first" else marked.filter("copies = 1")
    return marked.select("k1", "k2", "a", (F.col("a") + length).alias("b"))


def repeated_spans(texts: DataFrame, length: int, keep: str) -> DataFrame:
    """k1, k2, a, b: byte ranges that repeated strings cover; they may overlap."""
    stretch = ["shard", "s1", "s2"]
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2", "start", "n")
    found = save_point(_occurrences(texts.select("doc_id", "k1", "k2", "text"), length))
    # the sides of the joins by shard are saved: a side that is summed in the join's own stage keeps Spark from splitting a shard of very many rows
    shards = save_point(found.groupBy("shard").agg(F.count("*").alias("m"), F.bool_or("twice").alias("t")).filter("m > 1 or t").select("shard"))
    found = save_point(found.join(shards, "shard"))
    each = save_point(found.groupBy(*stretch).agg(F.count("*").alias("copies"), F.min(order).alias("first"), F.bool_or("twice").alias("twice")))
    size = F.sum(F.col("first.n") + length - 1)
    many = save_point(each.groupBy("shard").agg(F.count("*").alias("m"), F.bool_or("twice").alias("t"), size.alias("size")).filter("m > 1 or t").select("shard", (F.col("size") > HOT).alias("hot")))
    wanted = each.join(many, "shard").select("shard", "copies", "hot", "first.k1", "first.k2", "first.start", "first.n")
    cut = _cut(texts, wanted, length)
    whole = found.join(each.filter("copies > 1").select(*stretch, "first"), stretch)
    if keep == "first":
        whole = whole.filter(order != F.col("first"))
    whole = whole.select("k1", "k2", F.col("start").alias("a"), (F.col("start") + F.col("n") + length - 1).alias("b"))
    return whole.unionByName(_sorted_matches(cut, length, keep)).unionByName(_counted_matches(cut, length, keep))


def remove_repeats(docs: DataFrame, length: int = 400, keep: str = "first") -> DataFrame:
    """doc_id, n_bytes, spans (array of removed [a, b), maximal and in order) and kept (the remaining bytes) of every document.

    keep "first": of strings of `length` bytes with several starts, all starts but the first (by doc_id, null last, then
    position) are removed, with all bytes they cover; keep "none": every start. Matches never cross documents;
    strings are judged on the input. docs: doc_id, text; other columns are left aside. A null text counts as
    empty. Equal rows are documents of their own for counting, and both get the spans of either. length: over 32.
    """
    if keep not in ("first", "none") or length <= GRAM:
        raise ValueError("keep is first or none, and length over 32")
    a, b = row_key("doc_id", "text")
    texts = docs.select(F.col("doc_id").cast("long"), "text").select("doc_id", a.alias("k1"), b.alias("k2"), "text")
    spans = repeated_spans(texts, length, keep).groupBy("k1", "k2").agg(F.collect_set(F.struct("a", "b")).alias("x"))
    kinds = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 3)):
            spans, kept, sizes = [], [], []
            for text, x in zip(utf8(batch.column(3)), batch.column(4).to_pylist(), strict=True):
                merged: list[list[int]] = []
                for s, e in sorted((v["a"], v["b"]) for v in x or ()):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([s, e])
                at, rest = 0, []
                for s, e in merged:
                    rest.append(text[at:s])
                    at = e
                spans.append([{"a": s, "b": e} for s, e in merged])
                kept.append(b"".join([*rest, text[at:]]) if merged else text)
                sizes.append(len(text))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, kinds.field(2).type), pa.array(kept, pa.binary())], schema=kinds)

    joined = texts.join(spans, ["k1", "k2"], "left").select("doc_id", "k1", "k2", "text", "x")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<a: int, b: int>>, kept binary")


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every start of a repeated string of 400 bytes goes: doc_id, n_bytes, n_removed, n_spans, kept_sha256; and what stays: n_kept (bytes), n_chars
    and text (the bytes that stay; a character that is cut is shown by its replacement mark)."""
    out = remove_repeats(table(spark, sf_dir, "documents"), 400, "none")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    text = F.make_valid_utf8(F.col("kept").cast("string"))
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), F.length("kept").cast("long").alias("n_kept"), F.char_length(text).cast("long").alias("n_chars"), text.alias("text"))
