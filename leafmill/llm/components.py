"""Connected components by alternating stars, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import Tables, sent

#: Edges that one task of a round holds, about.
EDGES = 1 << 20


def _star(edges: DataFrame, large: bool, count: int) -> DataFrame:
    """One step: every node links its larger (large) or smaller (small) neighbours to the least node it knows. count: of the edges, from which
    the number of tasks and the way of the join follow."""
    tasks = -(-count // EDGES) + 1
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(tasks)
    linked = both.join(sent(least, 32 * count), "u")
    if large:
        out = linked.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a > b").coalesce(tasks).distinct().coalesce(tasks)


def components(edges: DataFrame, folder: str | None = None) -> DataFrame:
    """(node, root) for each node of an edge; root is the least node of its component.

    edges: two bigint columns, in any direction; self loops and repeats are allowed, nulls are left out. The
    rounds are logarithmic in the longest path. Only a count and a checksum of the edges reach the driver; of the rounds' tables two are
    kept, in the folder (the result reads one) or else in the shared one.
    """
    rounds = Tables(edges.sparkSession, "a long, b long", folder)
    e = edges.toDF("x", "y").na.drop().select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).filter("a > b").distinct()
    e = rounds.put(e)
    seen = None
    while True:
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen or not now[0]:
            break
        seen = now
        e = rounds.put(_star(_star(e, True, 2 * now[0]), False, 2 * now[0]))
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
