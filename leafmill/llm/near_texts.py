"""Near-duplicate documents: texts whose SimHash fingerprints lie within a few bits meet in BK-trees, and an exact check of their sets of shingles follows;
texts that share a band of least hashes are held against each other too, as most pairs at the similarity asked for lie further apart in fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.llm.common import apart, row_key, save_point, slices, utf8, whole_groups
from leafmill.llm.components import components
from leafmill.llm.simhash_docs import majority, near_links, shingle_hashes

#: Similarity (Jaccard, of sets of shingles) from which texts are linked.
SIMILAR = 0.8
#: A text goes to one shard for each band of ROWS least hashes; texts of similarity s share none with probability (1 - s ** ROWS) ** BANDS, 0.00004 at 0.8.
BANDS, ROWS = 10, 2
#: Different texts of a band that are held together.
TREE = 256
_FACTORS = np.random.Generator(np.random.PCG64(7)).integers(0, 2**63, BANDS * ROWS).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Distinct shingles as sorted 32-bit hashes."""
    return np.unique((shingle_hashes(text, words) >> np.uint64(32)).astype(np.uint32))


def bands(h: np.ndarray) -> list[int]:
    """One 64-bit value a band, of the least hashes under ROWS mixings; none for no shingles."""
    if not len(h):
        return []
    least = np.array([(mixed := (h ^ h >> np.uint64(29)) * f)[np.argmin(mixed ^ mixed >> np.uint64(32))] for f in _FACTORS], np.uint64).reshape(BANDS, ROWS)
    return np.frombuffer(b"".join(xxhash.xxh64_digest(b"%d " % i + b.tobytes()) for i, b in enumerate(least)), np.int64).tolist()


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets, as sorted arrays, have a similarity of SIMILAR or more."""
    if min(len(a), len(b)) < SIMILAR * max(len(a), len(b)):
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared >= SIMILAR * (len(a) + len(b) - shared) - 1e-9


def forest(side: np.ndarray, root: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect all alike texts; a pair that is connected, by these or as its root says, is not compared again.

    side 0: held and querying; 1: held alone; 2: querying alone.
    """
    group, sizes = np.unique(root, return_inverse=True)[1], np.array([len(x) for x in sets])
    held, out = np.zeros(len(sets), bool), []
    for i in np.argsort(side == 2, kind="stable").tolist():
        if side[i] != 1:
            fits = np.minimum(sizes, sizes[i]) >= SIMILAR * np.maximum(sizes, sizes[i])
            for j in np.flatnonzero(held & fits & (group != group[i])).tolist():
                if group[i] != group[j] and alike(sets[i], sets[j]):
                    group[group == group[i]] = group[j]
                    out.append((i, j))
        held[i] = side[i] != 2
    return out


def _prints(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, k1, k2 (the row's key), u (hash of the set of shingles), fp (SimHash), bands."""
    k1, k2 = row_key()
    kinds = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("k1", "k2", "u", "fp")), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 3)):
            u, fp, keys = [], [], []
            for text in utf8(batch.column(3)):
                h = shingle_hashes(text, words)
                fp.append(majority(h))
                h = np.unique(h)
                u.append(xxhash.xxh64_intdigest(h.tobytes()))
                keys.append(bands(h))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (u, fp)), pa.array(keys, pa.list_(pa.int64()))], schema=kinds)

    plain = docs.select(F.col("doc_id").cast("long"), k1.alias("k1"), k2.alias("k2"), "text")
    return plain.mapInArrow(run, "doc_id long, k1 long, k2 long, u long, fp long, bands array<long>")


def _compared(rows: DataFrame) -> DataFrame:
    """(a, b): links between alike sets of shingles in each band, i and j. rows: band, i, j, side, u, root, s (the set's bytes)."""
    by = ["band", "i", "j"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, at in whole_groups(batches, by):
            u, side, root, out = frame["u"].values, frame["side"].values, frame["root"].values, []
            for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                own = [np.frombuffer(x, np.uint32) for x in frame["s"].iloc[s:e]]
                out += [(s + i, s + j) for i, j in forest(side[s:e], root[s:e], own)]
            ends = np.array(out, np.int64).reshape(-1, 2)
            yield pd.DataFrame({"a": u[ends[:, 0]], "b": u[ends[:, 1]]})

    return rows.select(*by, "side", "u", "root", "s").repartition(*by).sortWithinPartitions(*by).mapInPandas(run, "a long, b long").distinct()


def _sets(docs: DataFrame, of: DataFrame, words: int) -> DataFrame:
    """u, s: the sets of shingles, as bytes, of the texts in `of` (u and k, the key of one row that has it)."""
    k1, k2 = row_key()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t, words).tobytes() for t in utf8(batch.column(1))], pa.binary())], ["u", "s"])

    texts = docs.select(k1.alias("k1"), k2.alias("k2"), "text").join(of.select("u", "k.k1", "k.k2").distinct(), ["k1", "k2"]).select("u", "text")
    return texts.mapInArrow(read, "u long, s binary").dropDuplicates(["u"])


def simhash_links(each: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(a, b): links between sets of shingles that SimHash and BK-trees find within 3 bits and that are alike. each: u, fp, k (a row's key), a row each set."""
    first = each.groupBy("fp").agg(F.min("u").alias("least"))
    same = each.join(first, "fp").filter("u != least").select(F.col("least").alias("a"), F.col("u").alias("b"))
    near = near_links(first.select("fp")).join(first.toDF("a", "x"), "a").join(first.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    pairs = save_point(same.unionByName(near))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("u")).distinct()
    found = save_point(_sets(docs, each.join(ends, "u", "left_semi"), words))

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ok = [alike(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)) for x, y in zip(frame["s"], frame["t"], strict=True)]
            yield frame.loc[np.array(ok, bool), ["a", "b"]]

    return pairs.join(found.toDF("a", "s"), "a").join(found.toDF("b", "t"), "b").mapInPandas(check, "a long, b long")


def linked(prints: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(node, root) of the sets of shingles that links connect. Only texts near another by SimHash, or that share a band with one, are read again, one of each set.

    What SimHash links is not compared again in a band. Bands of over TREE sets are cut in parts, each compared within itself first. Only where the
    sets of a band then are in several groups does each part meet the others, and pairs of one group are not compared.
    """
    each = save_point(prints.groupBy("u").agg(F.first("bands").alias("bands"), F.min("fp").alias("fp"), F.min(F.struct("k1", "k2")).alias("k")))
    close = save_point(simhash_links(each.select("u", "fp", "k"), docs, words))
    joined = components(close).toDF("u", "root")
    keyed = save_point(each.select("u", "k", F.explode("bands").alias("band")))
    sizes = keyed.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    met = save_point(keyed.join(sizes, "band").withColumn("cuts", F.ceil(F.col("n") / TREE).cast("int")).withColumn("mine", F.pmod(F.xxhash64("u"), F.col("cuts")).cast("int")))
    own = met.select("band", F.col("mine").alias("i"), F.col("mine").alias("j"), F.lit(0).alias("side"), "u").join(joined, "u", "left").withColumn("root", F.coalesce("root", "u"))
    first = save_point(close.unionByName(_compared(own.join(_sets(docs, met, words), "u"))))
    groups = components(first)
    cut = met.filter("cuts > 1").join(groups.toDF("u", "root"), "u", "left").withColumn("root", F.coalesce("root", "u"))
    several = cut.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi").select("band")
    open_ = save_point(cut.join(several, "band", "left_semi"))
    if open_.isEmpty():
        return groups
    pairs = F.expr("filter(transform(sequence(0, cuts - 1), o -> struct(least(o, mine) as i, greatest(o, mine) as j, if(mine < o, 1, 2) as side)), x -> x.i != x.j)")
    more = _compared(open_.select("band", "u", "root", F.inline(pairs)).join(_sets(docs, open_, words), "u"))
    return components(first.unionByName(more))


def keep_first(docs: DataFrame, words: int = 5) -> DataFrame:
    """The rows of docs with one document of each group of near duplicates; all columns stay.

    Texts are linked if their sets of shingles have a similarity of SIMILAR or more; of each connected group the document of least
    doc_id (null last), then key, stays. A null text counts as empty; texts without words are one group, and texts of fewer
    words than a shingle are one shingle. Repeated rows are copies of each other. Empty in, empty out.
    """
    prints = save_point(_prints(docs, words))
    roots = linked(prints, docs, words).toDF("u", "linked")
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), "k1", "k2")
    # the least of each set first, so that a group of copies is not joined as rows
    least = prints.groupBy("u").agg(F.min(rank).alias("x")).join(roots, "u", "left")
    p = apart(docs)
    key = [f"{p}k1", f"{p}k2"]
    kept = least.groupBy(F.coalesce("linked", "u").alias("root")).agg(F.min("x").alias("x")).select(F.col("x.k1").alias(key[0]), F.col("x.k2").alias(key[1]))
    k1, k2 = row_key(F.col("doc_id").cast("long"))
    one = F.row_number().over(W.partitionBy(*key).orderBy(F.lit(0)))
    rows = docs.withColumn(key[0], k1).withColumn(key[1], k2).join(kept, key, "left_semi")
    return rows.withColumn(f"{p}n", one).filter(F.col(f"{p}n") == 1).select(*[docs[f"`{c}`"] for c in docs.columns])
