"""Longest-processing-time scheduling of groups on shards."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.llm.common import save_point, table, text_key

#: A group is large from this part of a shard's even share; there are SHARE x shards large groups at most.
SHARE = 1000
#: Groups that one heap places.
CELL = 50_000
#: Rows are counted in so many parts of each shard for their slots.
PARTS = 256


def longest_first(sizes: list[int], loads: list[float]) -> list[int]:
    """Shard of each size, given in descending order: the least loaded one so far, the lower number on ties."""
    heap = [(load, k) for k, load in enumerate(loads)]
    heapq.heapify(heap)
    out = []
    for size in sizes:
        load, k = heap[0]
        out.append(k)
        heapq.heapreplace(heap, (load + size, k))
    return out


def place_groups(groups: DataFrame, shards: int) -> tuple[DataFrame, DataFrame]:
    """g1, g2, shard of the large groups, and of all others. groups: g1, g2 (key), size (bigint over 0).

    The large groups, SHARE x shards at most whatever the data, are placed by one heap. All others are dealt by hash into
    cells of about CELL groups; in each a heap places them longest first, from the loads that the large groups
    left, in the cell's part. Totals, and the large groups' sizes, are all that the driver gets.
    """
    total, count = groups.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    limit = max(1, int(total) // (SHARE * shards))
    large = groups.filter(F.col("size") > limit).orderBy(F.desc("size"), "g1", "g2").select("size", "g1", "g2").toPandas()
    placed = longest_first(large["size"].tolist(), [0.0] * shards)
    loads = [0.0] * shards
    for size, k in zip(large["size"].tolist(), placed, strict=True):
        loads[k] += size
    cells = max(1, -(-(int(count) - len(large)) // CELL))
    start = [load / cells for load in loads]
    by = ["cell", "size", "g1", "g2"]
    small = groups.filter(F.col("size") <= limit).withColumn("cell", F.pmod(F.xxhash64("g2", "g1"), F.lit(cells)).cast("int"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(by, ascending=[True, False, True, True])
        # shards of equal load take turns, so that the rest of each cell does not go to the same ones
        turn = int(frame["cell"].iloc[0]) % shards
        ring = [(turn + i) % shards for i in range(shards)]
        frame["shard"] = [ring[k] for k in longest_first(frame["size"].tolist(), [start[k] for k in ring])]
        return frame[["g1", "g2", "shard"]]

    rest = small.groupBy("cell").applyInPandas(run, "g1 long, g2 long, shard int")
    known = groups.sparkSession.createDataFrame(large.assign(shard=placed)[["g1", "g2", "shard"]], "g1 long, g2 long, shard int")
    return known, rest


def shard_rows(docs: DataFrame, shards: int) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row; rows of equal text share a shard, and the shards' sizes are near equal.

    size: UTF-8 bytes of the text (null: none) plus 8, so empty and null texts weigh 8; they count as equal. Slots go
    from 0 without gaps in each shard, by a hash of the row, then doc_id. Null doc_ids and repeated rows keep
    rows of their own. docs: doc_id, text; other columns are left aside. Empty in, empty out.
    """
    text = F.coalesce("text", F.lit(""))

    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text")).select("doc_id", (F.octet_length("text") + 8).cast("long").alias("size"), F.crc32(F.encode("text", "utf-8")).alias("text_crc32"), text_key("text")[0].alias("g1"), text_key("text")[1].alias("g2"))
    rows = save_point(rows)
    groups = rows.groupBy("g1", "g2").agg(F.sum("size").alias("size"))
    part = F.pmod(F.xxhash64("doc_id", "g1"), F.lit(PARTS)).cast("int")
    # the large groups, of bounded number, go to their rows, so that a frequent text is nobody's task
    large, others = place_groups(groups, shards)
    key = ["g1", "g2"]
    placed = rows.join(F.broadcast(large), key).unionByName(rows.join(F.broadcast(large.select(*key)), key, "left_anti").join(others, key))
    dealt = save_point(placed.withColumn("part", part))
    before = dealt.groupBy("shard", "part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1))).select("shard", "part", F.coalesce("before", F.lit(0)).alias("before"))
    slot = F.row_number().over(W.partitionBy("shard", "part").orderBy("doc_id", "g1", "g2")) - 1
    # shards x PARTS rows
    return dealt.withColumn("n", slot).join(F.broadcast(before), ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("n")).alias("slot"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents on shards 0 to 23 by bytes."""
    out = shard_rows(table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
