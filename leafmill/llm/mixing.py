"""Mixing sources to target weights: whole documents whose exact lengths fit each source's budget."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.llm.common import apart, row_key, save_point, table

WORDS = r"[^\x20\x09-\x0D]+"
#: Words of the budget that dynamic programming fits; what is above is filled in proportion and then longest first.
FITTED = 1 << 16


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float) -> DataFrame:
    """sizes (none, source, source_size; none: true for the null source) with target.

    Sources by code point, null last, take the weights in turn and split `share` of all sizes; a target stops at twice its
    source's size and the excess goes to the others by weight, until none is above. That fixed point fills sources in
    order of their limit by weight: a source stops if the level, what is left over the weights left, is above it.
    Runs over one row a source.
    """
    last = F.struct("none", "source")
    turn = F.pmod(F.row_number().over(W.orderBy(last)) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int") + 1)
    x = sizes.withColumn("w", weight).withColumn("most", 2.0 * F.col("source_size"))
    order = W.orderBy(F.col("most") / F.col("w"), last)
    x = x.withColumn("filled", F.coalesce(F.sum("most").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    x = x.withColumn("w_left", F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing)))
    x = x.withColumn("all", F.sum("source_size").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) * share)
    x = x.withColumn("level", (F.col("all") - F.col("filled")) / F.col("w_left"))
    x = x.withColumn("stops", F.col("most") <= F.col("level") * F.col("w"))
    # after the first source that does not stop, the level only falls
    level = F.max(F.when(~F.col("stops"), F.col("level"))).over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return x.withColumn("open", level).select("none", "source", "source_size", F.when(F.col("stops"), F.col("most")).otherwise(F.col("open") * F.col("w")).alias("target"))


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take, so that their words come as near the budget as found without exceeding it.

    Each length gives its proportion, rounded down; then longest first while more than FITTED words remain; bounded-knapsack
    dynamic programming over the rest finds the greatest reachable sum.
    """
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    taken = (counts.astype(object) * budget // max(total, 1)).astype(np.int64)
    left = budget - int((taken * lengths).sum())
    order = np.argsort(-lengths, kind="stable")
    for k in order.tolist():
        if left <= FITTED:
            break
        n = min(int(counts[k] - taken[k]), (left - FITTED // 2) // int(lengths[k])) if lengths[k] else 0
        taken[k] += max(n, 0)
        left -= max(n, 0) * int(lengths[k])
    mask, reach = (1 << (left + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []  # sums reachable before it, length's place, how many at once
    for k in order[::-1].tolist():
        free, size, many = int(counts[k] - taken[k]), int(lengths[k]), 1
        if not 0 < size <= left:
            continue
        free = min(free, left // size)
        while free > 0 and not reach >> left & 1:
            many = min(many, free)
            steps.append((reach, k, many))
            reach |= reach << (size * many) & mask
            free -= many
            many *= 2
    at = reach.bit_length() - 1
    for before, k, many in reversed(steps):
        if not before >> at & 1:
            at -= int(lengths[k]) * many
            taken[k] += many
    return taken


def _plans(histogram: DataFrame) -> DataFrame:
    """none, source, size, whole (copies that all take), more (how many take another). histogram: none, source, size, n, source_size, target."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("size")
        total, target = int(frame["source_size"].iloc[0]), float(frame["target"].iloc[0])
        whole = min(int(target // total), 2) if total else 0
        more = fit(frame["size"].values, frame["n"].values, round(target) - whole * total) if whole < 2 else np.zeros(len(frame), np.int64)
        return frame[["none", "source", "size"]].assign(whole=whole, more=more)

    return histogram.groupBy("none", "source").applyInPandas(run, "none boolean, source string, size long, whole int, more long")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, seed: int = 0, size: Column | None = None) -> DataFrame:
    """k1, k2 (the row's key), doc_id, size, source_size, target, copies (0, 1 or 2) of every row.

    The copies' sizes of each source sum to its target as nearly as whole documents can. Among documents of one source and
    size, those of least seeded hash of the row are taken; ties of repeated rows are broken arbitrarily among equals.
    docs: doc_id, text, source; other columns are left aside. A null text has size 0, as has an empty
    one; null is a source of its own, last in order. Empty in, empty out.
    """
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORDS)).cast("long") if size is None else size
    k1, k2 = row_key()
    docs = docs.select(F.col("doc_id").cast("long"), F.col("source").isNull().alias("none"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), "text")
    # one hot source and size is counted in 256 parts of the draw; only the part in which the quota ends is put in order
    rows = docs.select("doc_id", "none", "source", size.alias("size"), k1.alias("k1"), k2.alias("k2")).withColumn("draw", F.xxhash64(F.lit(seed), "k1", "k2"))
    rows = save_point(rows.withColumn("part", F.shiftright("draw", 56).cast("int")))
    by = ["none", "source", "size"]
    cells = rows.groupBy(*by, "part").agg(F.count("*").alias("n"))
    by_size = cells.groupBy(*by).agg(F.sum("n").alias("n"))
    targets = save_point(source_targets(by_size.groupBy("none", "source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, share))
    plans = _plans(by_size.join(targets, ["none", "source"]))
    before = F.coalesce(F.sum("n").over(W.partitionBy(*by).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.col("more") - F.col("before")
    quota = cells.withColumn("before", before).join(plans, by)
    quota = quota.select(*by, "part", "whole", F.when(rest <= 0, F.lit(0)).when(rest >= F.col("n"), F.lit(-1)).otherwise(rest).alias("quota"))
    dealt = save_point(rows.join(quota, [*by, "part"]))
    ordered = dealt.filter("quota > 0").withColumn("n", F.row_number().over(W.partitionBy(*by, "part").orderBy("draw", "k1", "k2")))
    ordered = ordered.withColumn("copies", F.col("whole") + (F.col("n") <= F.col("quota")).cast("int")).drop("n")
    plain = dealt.filter("quota <= 0").withColumn("copies", F.col("whole") + F.when(F.col("quota") < 0, 1).otherwise(0))
    both = ordered.unionByName(plain).join(targets, ["none", "source"])
    return both.select("k1", "k2", "doc_id", F.when(~F.col("none"), F.col("source")).alias("source"), "size", "source_size", "target", "copies")


def apply_mix(docs: DataFrame, **how) -> DataFrame:
    """The rows that the mix takes, once for each copy; all columns stay."""
    p = apart(docs)
    key = [f"{p}k1", f"{p}k2"]
    mixed = mix(docs, **how).select(F.col("k1").alias(key[0]), F.col("k2").alias(key[1]), F.col("copies").alias(f"{p}copies"))
    # repeated rows share a key: their copies are dealt by rank
    rank = W.partitionBy(*key).orderBy(F.desc(f"{p}copies"))
    mixed = mixed.withColumn(f"{p}n", F.row_number().over(rank)).filter(F.col(f"{p}copies") > 0)
    k1, k2 = row_key(F.col("doc_id").cast("long"))
    keyed = docs.withColumn(key[0], k1).withColumn(key[1], k2).withColumn(f"{p}n", F.row_number().over(W.partitionBy(*key).orderBy(F.lit(0))))
    taken = keyed.join(mixed, [*key, f"{p}n"])
    return taken.withColumn(f"{p}copy", F.explode(F.sequence(F.lit(1), f"{p}copies"))).select(*[docs[f"`{c}`"] for c in docs.columns])


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, weights 5, 2, 1 and 150% of all words."""
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
