"""Counters as a scraper sees them, their increase and rate over a range, and quantiles of summed rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.operators.names import own_names


@own_names
def scraped(events: DataFrame, by: list[str], every: int, starts: DataFrame) -> DataFrame:
    """by, ts, v: each series' counter at each multiple of `every` seconds, from its process' start on. events: by, ts, n (what is added); starts: start, ending (timestamps) of the
    process' lives, a few rows, in which counters begin at nought.

    A series is there from the first scrape after its first event of a life to the last one of that life.
    """
    at = lambda ts: F.ceil(F.unix_micros(ts) / (every * 1_000_000)) * every
    lives = starts.select(F.unix_micros("start").alias("start"), F.unix_micros("ending").alias("ending"))
    placed = events.withColumn("u", F.unix_micros("ts")).join(F.broadcast(lives), (F.col("u") >= F.col("start")) & (F.col("u") < F.col("ending")))
    life = [*by, "start", "ending"]
    added = placed.groupBy(*life, at(F.col("ts")).alias("at")).agg(F.sum("n").alias("n")).filter(F.col("at") * 1_000_000 < F.col("ending"))
    ends = added.groupBy(*life).agg(F.min("at").alias("low"), (F.floor((F.col("ending") - 1) / (every * 1_000_000)) * every).alias("high"))
    slots = ends.select(*life, F.explode(F.sequence("low", "high", F.lit(every).cast("long"))).alias("at"))
    filled = slots.join(added, [*life, "at"], "left")
    v = F.sum(F.coalesce("n", F.lit(0))).over(W.partitionBy(*life).orderBy("at").rowsBetween(W.unboundedPreceding, 0))
    return filled.select(*by, F.timestamp_seconds("at").alias("ts"), v.cast("double").alias("v"))


@own_names
def increases(samples: DataFrame, by: list[str], size: int, step: int) -> DataFrame:
    """by, at, increase, rate at each multiple of `step` seconds over the `size` seconds before it (its own moment counting, the first not).

    A value below the one before it is a reset, after which the counter has grown by all it shows. What the samples show is carried on to the range's edges: to an
    edge nearer than 1.1 times the samples' mean distance wholly, else by half that distance, and to the left not beyond where the counter was nought. Ranges with fewer than two
    samples have no row. samples: by, ts, v.
    """
    order = W.partitionBy(*by).orderBy("ts")
    before = F.lag("v").over(order)
    grown = samples.withColumn("reset", F.when(F.col("v") < before, before).otherwise(0.0))
    grown = grown.withColumn("sum", F.col("v") + F.sum("reset").over(order.rowsBetween(W.unboundedPreceding, 0)))
    # windows are open on the right, so a moment earlier each sample belongs to those that end with it
    early = F.timestamp_micros(F.unix_micros("ts") - 1)
    sides = grown.withColumn("s", F.unix_micros("ts") / 1e6).groupBy(*by, F.window(early, f"{size} seconds", f"{step} seconds").alias("w")).agg(
        F.count("*").alias("n"), F.min("s").alias("first"), F.max("s").alias("last"), F.min_by("v", "s").alias("value"), (F.max_by("sum", "s") - F.min_by("sum", "s")).alias("grew"),
    )
    x = sides.filter("n > 1").withColumn("at", F.unix_micros("w.end") / 1e6).withColumn("span", F.col("last") - F.col("first")).withColumn("mean", F.try_divide(F.col("span"), F.col("n") - 1))
    near = lambda gap: F.when(gap >= F.col("mean") * 1.1, F.col("mean") / 2).otherwise(gap)
    left = near(F.col("first") - (F.col("at") - size))
    left = F.when(F.col("grew") > 0, F.least(left, F.try_divide(F.col("span") * F.col("value"), F.col("grew")))).otherwise(left)
    whole = F.try_divide(F.col("grew") * (F.col("span") + left + near(F.col("at") - F.col("last"))), F.col("span"))
    return x.select(*by, F.col("w.end").alias("at"), whole.alias("increase"), (whole / size).alias("rate"))


@own_names
def rate_quantiles(rates: DataFrame, by: list[str], shares: tuple[float, ...]) -> DataFrame:
    """by, share, value: quantiles by linear interpolation in a histogram of rates. rates: by, le (infinite for the last bucket), rate.

    A bucket below its forerunner counts as much as that one, as rates are estimates. Of the last bucket its lower bound; no row where nothing was counted.
    """
    order = W.partitionBy(*by).orderBy("le")
    h = rates.withColumn("n", F.max("rate").over(order.rowsBetween(W.unboundedPreceding, 0)))
    h = h.withColumn("low", F.coalesce(F.lag("le").over(order), F.lit(0.0))).withColumn("below", F.coalesce(F.lag("n").over(order), F.lit(0.0)))
    h = h.withColumn("total", F.max("n").over(W.partitionBy(*by))).filter("total > 0").withColumn("share", F.explode(F.array(*map(F.lit, shares))))
    hit = h.filter(F.col("n") >= F.col("total") * F.col("share")).groupBy(*by, "share").agg(F.min_by(F.struct("le", "low", "n", "below", "total"), "le").alias("b"))
    inside = F.col("b.low") + (F.col("b.le") - F.col("b.low")) * F.try_divide(F.col("b.total") * F.col("share") - F.col("b.below"), F.col("b.n") - F.col("b.below"))
    return hit.select(*by, "share", F.when(F.col("b.le") == float("inf"), F.col("b.low")).otherwise(F.coalesce(inside, "b.low")).alias("value"))


def latest(samples: DataFrame, by: list[str]) -> DataFrame:
    """by, value: each series' last sample."""
    return samples.groupBy(*by).agg(F.max_by("v", "ts").alias("value"))
