"""Near-duplicate documents by SimHash; fingerprints within a few bits are found in BK-trees."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.llm.common import apart, row_key, save_point, scratch, sent, slices, table, utf8, whole_groups
from leafmill.llm.components import components

#: 64 bits in five blocks. Up to 3 differing bits leave two blocks untouched, so each pair of blocks is a shard key.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Fingerprints in one tree; a larger shard is split into blocks, each of which queries the trees of all the others.
TREE = 2048
_LANES = np.uint64(0x0101010101010101)
_SHIFTS = np.arange(8, dtype=np.uint64)


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of each shingle of `words` words, repeats included; of all words if they are fewer; none if there is none."""
    parts = text.lower().split()  # for bytes: A-Z alone are lowered, and ASCII white space alone splits
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    if len(parts) <= words:
        spans = [(0, len(joined))]
    else:
        starts = np.concatenate([[0], ends[:-1] + 1])
        spans = zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
    return np.array([xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in spans], np.uint64)


def majority(h: np.ndarray) -> int:
    """The bits that more than half of the hashes have; zero for none."""
    n = len(h)
    if not n:
        return 0
    h = np.concatenate([h, np.zeros(-n % 255, np.uint64)]).reshape(-1, 255)
    # lane k of h >> s holds bit 8k + s; 255 rows at most are summed before a lane of 8 bits could overflow
    counts = np.stack([((h >> s) & _LANES).sum(1) for s in _SHIFTS]).view(np.uint8).reshape(8, -1, 8).sum(1, dtype=np.int64)
    bits = counts.T.reshape(-1) * 2 > n
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def simhash(text: bytes, words: int) -> int:
    """64-bit SimHash over the shingles of `words` words."""
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, the two columns of the row's key, and fp (the fingerprint's bits as a bigint)."""
    a, b = row_key()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in (part for whole in batches for part in slices(whole, 3)):
            fp = np.array([simhash(t, words) for t in utf8(x.column(3))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*x.columns[:3], pa.array(fp)], ["doc_id", "k1", "k2", "fp"])

    return docs.select(F.col("doc_id").cast("long"), a.alias("k1"), b.alias("k2"), F.col("text")).mapInArrow(run, "doc_id long, k1 long, k2 long, fp long")


def _block(i: int) -> Column:
    start, width = BLOCKS[i]
    return F.shiftrightunsigned("fp", start).bitwiseAND((1 << width) - 1)


class BKTree:
    """Children are keyed by their distance to the parent; a search follows the edges within the radius alone."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        at = 0
        self.values.append(value)
        self.children.append({})
        new = len(self.values) - 1
        while new:
            d = (self.values[at] ^ value).bit_count()
            following = self.children[at].get(d)
            if following is None:
                self.children[at][d] = new
                return
            at = following

    def within(self, value: int, radius: int) -> list[int]:
        """Positions of all values at most radius away."""
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            children = self.children[at]
            if children:
                todo += [children[e] for e in range(d - radius, d + radius + 1) if e in children]
        return found


def _links(fp: np.ndarray, side: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect what lies within the radius: a spanning forest, never all pairs.

    side 0: in the tree and querying; 1: in the tree alone; 2: querying alone.
    """
    values = fp.view(np.uint64).tolist()
    parent = list(range(len(values)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    tree, place, out = BKTree(), [], []
    for i in np.argsort(side == 2, kind="stable").tolist():
        if side[i] != 1:
            for at in tree.within(values[i], radius):
                a, b = find(i), find(place[at])
                if a != b:
                    parent[a] = b
                    out.append((i, place[at]))
        if side[i] != 2:
            tree.add(values[i])
            place.append(i)
    return out


def near_links(fps: DataFrame, radius: int = 3, tree: int = TREE) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints `fp` as closely as all pairs within the radius (3 at most) would.

    Each fingerprint goes to the shard of each pair of its blocks; shards of one fingerprint are dropped. A shard
    beyond `tree` fingerprints is cut into blocks by hash, and each pair of blocks is a tree with its queries.
    """
    if radius > 3:
        raise ValueError("five blocks in pairs find 3 differing bits at most")
    keys = F.array(*[F.struct(F.lit(i).alias("t"), _block(x).alias("x"), _block(y).alias("y")) for i, (x, y) in enumerate(combinations(range(5), 2))])
    keyed = fps.select("fp", F.inline(keys))
    sizes = keyed.groupBy("t", "x", "y").agg(F.count("*").alias("n")).filter("n > 1")
    cut = F.ceil(F.col("n") / tree).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int")
    pairs = F.expr("transform(sequence(0, cuts - 1), o -> struct(least(o, mine) as i, greatest(o, mine) as j, case when o = mine then 0 when mine < o then 1 else 2 end as side))")
    rows = keyed.join(sizes, ["t", "x", "y"]).withColumn("cuts", cut).withColumn("mine", mine).select("t", "x", "y", "fp", F.inline(pairs))
    by = ["t", "x", "y", "i", "j"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, at in whole_groups(batches, by):
            fp, side, out = frame["fp"].values, frame["side"].values, []
            for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if e - s == 2 and side[s] + side[s + 1] == 0:
                    if (int(fp[s]) ^ int(fp[s + 1])) & (2**64 - 1) and ((int(fp[s]) ^ int(fp[s + 1])) & (2**64 - 1)).bit_count() <= radius:
                        out.append((s, s + 1))
                else:
                    out += [(s + i, s + j) for i, j in _links(fp[s:e], side[s:e], radius)]
            ends = np.array(out, np.int64).reshape(-1, 2)
            yield pd.DataFrame({"a": fp[ends[:, 0]], "b": fp[ends[:, 1]]})

    return rows.repartition(*by).sortWithinPartitions(*by).mapInPandas(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = 5, radius: int = 3) -> DataFrame:
    """doc_id, k1, k2 (the row's key), fp and root (the same for all documents that links connect).

    docs: doc_id, text; other columns are left aside. A null text counts as empty, and all texts without words share
    the fingerprint zero. A null doc_id keeps its row. Repeated rows stay, each with its row. Empty in, empty out.
    """
    prints = save_point(fingerprints(docs, words))
    links = near_links(prints.select("fp").distinct(), radius)
    with scratch(docs.sparkSession) as folder:
        roots = save_point(components(links, folder).withColumnsRenamed({"node": "fp", "root": "linked"}))
    return prints.join(sent(roots, roots.count() * 32), "fp", "left").select("doc_id", "k1", "k2", "fp", F.coalesce("linked", "fp").alias("root"))


def with_component(found: DataFrame) -> DataFrame:
    """Adds component_id, the least doc_id of the component; null if all its doc_ids are."""
    # a document alone is its own component, so only the others' roots are joined
    least = save_point(found.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")).filter("n > 1").select("root", "component_id", F.lit(True).alias("shared")))
    out = found.join(sent(least, least.count() * 40), "root", "left")
    return out.withColumn("component_id", F.when(F.col("shared"), F.col("component_id")).otherwise(F.col("doc_id"))).drop("shared")


def keep_first(docs: DataFrame, words: int = 5, radius: int = 3) -> DataFrame:
    """The rows of docs with one document of each component: the one with the least doc_id (null last), then key; all columns stay."""
    found = near_duplicates(docs, words, radius)
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), "k1", "k2")
    p = apart(docs)
    key = [f"{p}k1", f"{p}k2"]
    kept = found.groupBy("root").agg(F.min(rank).alias("x")).select(F.col("x.k1").alias(key[0]), F.col("x.k2").alias(key[1]))
    a, b = row_key(F.col("doc_id").cast("long"))
    one = F.row_number().over(W.partitionBy(*key).orderBy(F.lit(0)))
    rows = docs.withColumn(key[0], a).withColumn(key[1], b).join(kept, key, "left_semi")
    return rows.withColumn(f"{p}n", one).filter(F.col(f"{p}n") == 1).select(*[docs[f"`{c}`"] for c in docs.columns])


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, 3 bits: doc_id, fingerprint (16 hex digits), component_id of every row of documents."""
    found = with_component(near_duplicates(table(spark, sf_dir, "documents"), 3, 3))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
