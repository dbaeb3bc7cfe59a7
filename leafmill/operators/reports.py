"""Counters, histograms, percentiles and rates of an event log.

events: event, ts and open fields; a query's are route, retrieval_ms, llm_ms, total_ms, prompt_tokens, completion_tokens, context_tokens,
context_budget, cost_usd, cited, declined, stream_error, dropped (count).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.operators.names import own_names
from leafmill.sources.shared import save_point

#: Bounds of the histograms' buckets, in seconds and tokens.
BUCKETS = {
    "retrieval_seconds": (0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5), "llm_seconds": (0.5, 1, 2, 3, 5, 8, 12, 20, 30),
    "request_seconds": (0.5, 1, 2, 3, 5, 8, 12, 20, 30), "context_tokens": (500, 1000, 1500, 2000, 3000, 4000, 5000, 6000, 6500, 7000),
    "prompt_tokens": (500, 1000, 2000, 3000, 4000, 5000, 6000, 7000, 8000, 10000),
    "index_seconds": (1, 2, 5, 10, 20, 40, 80, 160),
}


def outcome() -> Column:
    """declined, cited (also where nothing is said of it) or uncited."""
    return F.when(F.coalesce("declined", F.lit(False)), "declined").when(F.coalesce("cited", F.lit(True)), "cited").otherwise("uncited")


def counters(events: DataFrame) -> DataFrame:
    """metric, label, value of all counters; a batch over the whole log gives what a stream over it gave."""
    q = events.filter("event = 'query'")
    one = lambda df, name, label, value: df.groupBy(label.alias("label")).agg(value.alias("value")).select(F.lit(name).alias("metric"), "label", F.col("value").cast("double").alias("value"))
    total = F.count("*")
    out = one(q, "query_total", F.col("route"), total).unionByName(one(q, "answer_outcome_total", outcome(), total))
    out = out.unionByName(one(q, "cost_usd_total", F.lit(""), F.round(F.sum("cost_usd"), 6))).unionByName(one(q, "context_dropped_total", F.lit(""), F.sum("dropped")))
    return out.unionByName(one(events.filter("event = 'index'"), "index_total", F.lit(""), total))


def histogram(values: DataFrame, by: list[str], bounds: tuple[float, ...]) -> DataFrame:
    """by, le (infinite for the last), n: how many values are at most each bound. values: by, x; one pass and one row a group."""
    counts = [F.count_if(F.col("x") <= b).alias(f"_{i}") for i, b in enumerate(bounds)]
    wide = values.groupBy(*by).agg(*counts, F.count("x").alias("_all"))
    rows = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"_{i}").alias("n")) for i, b in enumerate(bounds)], F.struct(F.lit(float("inf")).alias("le"), F.col("_all").alias("n")))
    return wide.select(*by, F.inline(rows))


def histograms(events: DataFrame) -> DataFrame:
    """metric, le, n of all histograms of the log. Summaries neither search nor pack, so that only their whole time counts."""
    q = events.filter("event = 'query'")
    searched = q.filter("route != 'summary'")
    seconds = lambda c: F.col(c) / 1000
    values = {
        "retrieval_seconds": (searched, seconds("retrieval_ms")), "llm_seconds": (searched, seconds("llm_ms")), "request_seconds": (q, seconds("total_ms")),
        "context_tokens": (searched, F.col("context_tokens")), "prompt_tokens": (searched, F.col("prompt_tokens")), "index_seconds": (events.filter("event = 'index'"), seconds("total_ms")),
    }
    out = None
    for name, (rows, x) in values.items():
        one = histogram(rows.select(F.lit(name).alias("metric"), x.cast("double").alias("x")), ["metric"], BUCKETS[name])
        out = one if out is None else out.unionByName(one)
    return out


def quantiles(histogram: DataFrame, by: list[str], q: float) -> DataFrame:
    """by, value: the quantile by linear interpolation within its bucket; of the last bucket its lower bound, null without values."""
    order = W.partitionBy(*by).orderBy("le")
    h = histogram.withColumn("low", F.coalesce(F.lag("le").over(order), F.lit(0.0))).withColumn("below", F.coalesce(F.lag("n").over(order), F.lit(0)))
    h = h.withColumn("total", F.max("n").over(W.partitionBy(*by)))
    hit = h.filter(F.col("n") >= F.col("total") * q).withColumn("k", F.row_number().over(order)).filter("k = 1")
    inside = F.col("low") + (F.col("le") - F.col("low")) * F.try_divide(F.col("total") * q - F.col("below"), F.col("n") - F.col("below"))
    value = F.when(F.col("total") == 0, F.lit(None)).when(F.col("le") == float("inf"), F.col("low")).otherwise(inside)
    return hit.select(*by, F.round(value, 6).alias("value"))


@own_names
def percentiles(values: DataFrame, by: list[str], shares: tuple[float, ...], most: int = 10_000) -> DataFrame:
    """by and p50, p95, ..: the value at place min(floor(n * share), n - 1) in order, from 0. values: by, x; nulls are left out.

    Exact selection by narrowing ranges: each round estimates bounds of the wanted places among the values of their ranges, counts what lies below and between
    them, and goes on with the range that holds the place, until that has `most` values or only one. Only then are values put in order, at most `most` of a group and
    share. Nothing but counts, estimates and the last ranges moves, however many values a group has.
    """
    values = values.filter("x is not null").select(*by, F.col("x").cast("double").alias("x"))
    share = F.explode(F.array(*map(F.lit, shares))).alias("share")
    n, key = F.count("*"), [*by, "share"]
    place = F.least(F.floor(F.col("n") * F.col("share")), F.col("n") - 1)
    ranges = save_point(values.groupBy(*by).agg(n.alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).select(*by, "n", "low", "high", share).select(*key, place.alias("k"), "n", "low", "high"))
    while not (open_ := ranges.filter((F.col("n") > most) & (F.col("low") < F.col("high")))).isEmpty():
        held = values.join(open_, by) if by else values.crossJoin(F.broadcast(open_))
        held = held.filter("x between low and high")
        # estimates are within a thousandth of the range's values, so the place lies between those four thousandths around it
        around = [F.greatest(F.lit(0.0), F.col("k") / F.col("n") - 0.004), F.least(F.lit(1.0), (F.col("k") + 1) / F.col("n") + 0.004)]
        grid = F.percentile_approx("x", [i / 250 for i in range(251)], 1000)
        bounds = held.groupBy(*key).agg(grid.alias("g"), *[F.first(c).alias(c) for c in ("k", "n", "low", "high")])
        a, b = F.element_at("g", F.floor(around[0] * 250).cast("int") + 1), F.element_at("g", F.ceil(around[1] * 250).cast("int") + 1)
        bounds = save_point(bounds.select(*key, "k", "n", "low", "high", a.alias("a"), b.alias("b")))
        inner = values.join(bounds, by) if by else values.crossJoin(F.broadcast(bounds))
        counts = inner.filter("x between low and high").groupBy(*key).agg(F.count_if(F.col("x") < F.col("a")).alias("below"), F.count_if(F.expr("x between a and b")).alias("inside"), *[F.first(c).alias(c) for c in ("k", "n", "low", "high", "a", "b")])
        good = (F.col("below") <= F.col("k")) & (F.col("k") < F.col("below") + F.col("inside")) & (F.col("inside") < F.col("n"))
        # an estimate that did not hold, or did not narrow, halves the range instead
        middle = F.col("low") + (F.col("high") - F.col("low")) / 2
        half = inner.filter("x between low and high").groupBy(*key).agg(F.count_if(F.col("x") <= middle).alias("lower"), F.max(F.when(F.col("x") <= middle, F.col("x"))).alias("top"), F.min(F.when(F.col("x") > middle, F.col("x"))).alias("bottom"))
        both = counts.join(half, key)
        first = F.col("k") < F.col("lower")
        narrowed = both.select(
            *key, F.when(good, F.col("k") - F.col("below")).when(first, F.col("k")).otherwise(F.col("k") - F.col("lower")).alias("k"), F.when(good, F.col("inside")).when(first, F.col("lower")).otherwise(F.col("n") - F.col("lower")).alias("n"),
            F.when(good, F.col("a")).when(first, F.col("low")).otherwise(F.col("bottom")).alias("low"), F.when(good, F.col("b")).when(first, F.col("top")).otherwise(F.col("high")).alias("high"),
        )
        ranges = save_point(ranges.filter((F.col("n") <= most) | (F.col("low") == F.col("high"))).unionByName(narrowed))
    single = F.col("low") == F.col("high")
    few = ranges.filter(~single)
    held = values.join(few, by) if by else values.crossJoin(F.broadcast(few))
    chosen = held.filter("x between low and high").groupBy(*key).agg(F.array_sort(F.collect_list("x")).alias("all"), F.first("k").alias("k")).select(*key, F.get("all", F.col("k").cast("int")).alias("x"))
    found = chosen.unionByName(ranges.filter(single).select(*key, F.col("low").alias("x")))
    named = [F.max(F.when(F.col("share") == p, F.col("x"))).alias(f"p{round(p * 100)}") for p in shares]
    return found.groupBy(*by).agg(*named)


def report(events: DataFrame, ceiling: int) -> DataFrame:
    """One row: what the run-time report says. Queries packed under another budget (over the ceiling) are left out and counted as stale."""
    q = events.filter("event = 'query'").withColumn("stale", F.coalesce("context_budget", F.lit(0)) > ceiling)
    ok = ~F.col("stale")
    n = F.count_if(ok)
    answered = ok & F.col("cited").isNotNull() & F.col("stream_error").isNull()
    declined = answered & F.coalesce("declined", F.lit(False))
    cited = answered & F.col("cited") & ~F.coalesce("declined", F.lit(False))
    uncited = answered & ~F.col("cited") & ~F.coalesce("declined", F.lit(False))
    return q.agg(
        n.alias("queries"), F.count_if("stale").alias("stale"), F.count_if(cited).alias("cited"), F.count_if(uncited).alias("uncited"), F.count_if(declined).alias("declined"),
        F.count_if(ok & F.col("stream_error").isNotNull()).alias("broken"), F.round(F.try_divide(F.count_if(cited), F.count_if(cited) + F.count_if(uncited)), 6).alias("citation_rate"),
        F.round(F.avg(F.when(ok, F.col("prompt_tokens"))), 6).alias("tokens_in"), F.round(F.avg(F.when(ok, F.col("completion_tokens"))), 6).alias("tokens_out"),
        F.round(F.sum(F.when(ok, F.col("cost_usd"))), 6).alias("cost"), F.round(F.try_divide(F.sum(F.when(ok, F.col("cost_usd"))), n), 9).alias("cost_per_query"),
        F.min(F.when(ok, F.col("context_budget"))).alias("least_budget"), F.max(F.when(ok, F.col("context_budget"))).alias("most_budget"),
    )


def exposition(metrics: DataFrame) -> DataFrame:
    """line: metrics as text, one a line. metrics: metric, label, value."""
    label = F.when(F.col("label") == "", "").otherwise(F.concat(F.lit('{label="'), "label", F.lit('"}')))
    return metrics.select(F.concat("metric", label, F.lit(" "), F.col("value").cast("string")).alias("line"))


def verdicts(runs: DataFrame, base: str, most: float = 0.3) -> DataFrame:
    """run, p50, p95, ok, failed, change, worse: runs of a load test against one of them. runs: run, ms, failed."""
    p = percentiles(runs.filter("not failed").select("run", F.col("ms").alias("x")), ["run"], (0.5, 0.95))
    n = runs.groupBy("run").agg(F.count_if(~F.col("failed")).alias("ok"), F.count_if("failed").alias("failed"))
    first = F.max(F.when(F.col("run") == base, F.col("p50"))).over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    out = n.join(p, "run", "left").withColumn("change", F.round(F.try_divide(F.col("p50") - first, first), 6))
    return out.withColumn("worse", F.col("change") > most)


