"""Queries over the event log: counters, histograms, percentiles, reports."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.text import cost
from leafmill.operators import rates, reports
from leafmill.plans.base import Catalog
from leafmill.sources import store
from leafmill.sources.shared import shared_folder
from leafmill.sources.tables import load

CATALOG = Catalog()

# Events as a log of queries: the type is the route, purchases are index runs; value is the time in milliseconds, props the source of all else.
LOG_SQL = """k AS (SELECT event_id, ts, user_id, event_type, value, (props::JSON->>'k')::BIGINT AS k FROM events),
    log AS (SELECT event_id, ts, CASE event_type WHEN 'purchase' THEN 'index' ELSE 'query' END AS event, CASE event_type WHEN 'click' THEN 'qa' WHEN 'view' THEN 'comparison' WHEN 'signup' THEN 'summary' ELSE 'table_lookup' END AS route, value * 10 AS total_ms, value AS retrieval_ms, value * 8 AS llm_ms, k * 7 + 500 AS prompt_tokens, k % 50 + 20 AS completion_tokens, k * 3 AS context_tokens, CASE WHEN user_id % 9 > 0 THEN 6000 - user_id % 4 * 100 + CASE WHEN user_id % 17 = 0 THEN 1000 ELSE 0 END END AS context_budget,
        CASE WHEN user_id % 5 > 0 THEN k % 3 > 0 END AS cited, CASE WHEN user_id % 6 > 0 THEN k % 11 = 0 END AS declined, CASE WHEN event_id % 23 = 0 THEN 'APIConnectionError' END AS stream_error, k % 4 AS dropped FROM k),
    costed AS (SELECT *, (prompt_tokens * 0.15::DOUBLE + completion_tokens * 0.6::DOUBLE) / 1e6 AS cost_usd FROM log)"""


def log_from(events: DataFrame) -> DataFrame:
    """The same from a frame, batch or stream."""
    e = events.withColumn("k", F.from_json("props", "k bigint")["k"])
    u, k, kind = F.col("user_id"), F.col("k"), F.col("event_type")
    route = F.when(kind == "click", "qa").when(kind == "view", "comparison").when(kind == "signup", "summary").otherwise("table_lookup")
    budget = F.when(u % 9 > 0, 6000 - u % 4 * 100 + F.when(u % 17 == 0, 1000).otherwise(0))
    prompt, completion = k * 7 + 500, k % 50 + 20
    return e.select(
        "event_id", "ts", F.when(kind == "purchase", "index").otherwise("query").alias("event"), route.alias("route"), (F.col("value") * 10).alias("total_ms"), F.col("value").alias("retrieval_ms"), (F.col("value") * 8).alias("llm_ms"),
        prompt.alias("prompt_tokens"), completion.alias("completion_tokens"), (k * 3).alias("context_tokens"), budget.alias("context_budget"), F.when(u % 5 > 0, k % 3 > 0).alias("cited"), F.when(u % 6 > 0, k % 11 == 0).alias("declined"),
        F.when(F.col("event_id") % 23 == 0, "APIConnectionError").alias("stream_error"), (k % 4).alias("dropped"), cost(prompt, completion).alias("cost_usd"),
    )


def log_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_from(load(spark, sf_dir, "events"))


OUTCOME_SQL = "CASE WHEN declined THEN 'declined' WHEN coalesce(cited, true) THEN 'cited' ELSE 'uncited' END"
COUNTER_SQL = f"""WITH {LOG_SQL}, q AS (SELECT * FROM costed WHERE event = 'query') SELECT 'query_total' AS metric, route AS label, count(*)::DOUBLE AS value FROM q GROUP BY route UNION ALL SELECT 'answer_outcome_total', {OUTCOME_SQL}, count(*)::DOUBLE FROM q GROUP BY 2
    UNION ALL SELECT 'cost_usd_total', '', round(sum(cost_usd), 6) FROM q UNION ALL SELECT 'context_dropped_total', '', sum(dropped)::DOUBLE FROM q UNION ALL SELECT 'index_total', '', count(*)::DOUBLE FROM costed WHERE event = 'index'"""


@CATALOG.add("A17, P15", COUNTER_SQL)
def metrics_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.counters(log_of(spark, sf_dir))


@CATALOG.add("S21", f"SELECT metric || CASE WHEN label = '' THEN '' ELSE '{{label=\"' || label || '\"}}' END || ' ' || value::BIGINT AS line FROM ({COUNTER_SQL}) WHERE metric <> 'cost_usd_total'")
def metrics_exposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = reports.counters(log_of(spark, sf_dir)).filter("metric != 'cost_usd_total'")
    return reports.exposition(counted.withColumn("value", F.col("value").cast("long")))


@CATALOG.add("A18", f"""WITH {LOG_SQL}, b AS (SELECT unnest([0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 1e9]::DOUBLE[]) AS le) SELECT route, CASE le WHEN 1e9 THEN -1 ELSE le END AS le, count(*) FILTER (retrieval_ms / 1000 <= le) AS n FROM costed, b WHERE event = 'query' AND route <> 'summary' GROUP BY ALL""")
def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of the histogram; -1 stands for the last one, without bound."""
    q = log_of(spark, sf_dir).filter("event = 'query' and route != 'summary'").select("route", (F.col("retrieval_ms") / 1000).alias("x"))
    return reports.histogram(q, ["route"], reports.BUCKETS["retrieval_seconds"]).withColumn("le", F.when(F.col("le") == float("inf"), -1.0).otherwise(F.col("le")))


BOUNDS_SQL = " UNION ALL ".join(f"SELECT '{m}' AS metric, unnest([{', '.join(map(str, b))}, 1e18]::DOUBLE[]) AS le" for m, b in reports.BUCKETS.items())


@CATALOG.add("A18", f"""WITH {LOG_SQL}, v AS (SELECT 'retrieval_seconds' AS metric, retrieval_ms / 1000 AS x FROM costed WHERE event = 'query' AND route <> 'summary' UNION ALL SELECT 'llm_seconds', llm_ms / 1000 FROM costed WHERE event = 'query' AND route <> 'summary' UNION ALL SELECT 'request_seconds', total_ms / 1000 FROM costed WHERE event = 'query'
    UNION ALL SELECT 'context_tokens', context_tokens FROM costed WHERE event = 'query' AND route <> 'summary' UNION ALL SELECT 'prompt_tokens', prompt_tokens FROM costed WHERE event = 'query' AND route <> 'summary' UNION ALL SELECT 'index_seconds', total_ms / 1000 FROM costed WHERE event = 'index'), b AS ({BOUNDS_SQL})
    SELECT metric, CASE le WHEN 1e18 THEN -1 ELSE le END AS le, count(*) FILTER (x <= le) AS n FROM v JOIN b USING (metric) GROUP BY metric, le""")
def log_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six histograms; -1 stands for the bucket without bound."""
    return reports.histograms(log_of(spark, sf_dir)).withColumn("le", F.when(F.col("le") == float("inf"), -1.0).otherwise(F.col("le")))


@CATALOG.add("S15", COUNTER_SQL)
def appended_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log written in two appends as JSON lines and read back: its counters are those of the log."""
    folder, log = f"{shared_folder(spark)}/{uuid4().hex}", log_of(spark, sf_dir)
    for half in (0, 1):
        store.append(log.filter(F.col("event_id") % 2 == half), folder)
    return reports.counters(store.appended(spark, folder, log.schema))


@CATALOG.add("A19, A20", f"WITH {LOG_SQL}, v AS (SELECT route, list_sort(list(total_ms)) AS x FROM costed WHERE event = 'query' GROUP BY route) SELECT route, x[least(floor(len(x) * 0.5)::BIGINT, len(x) - 1) + 1] AS p50, x[least(floor(len(x) * 0.95)::BIGINT, len(x) - 1) + 1] AS p95 FROM v")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.percentiles(log_of(spark, sf_dir).filter("event = 'query'").select("route", F.col("total_ms").alias("x")), ["route"], (0.5, 0.95))


BUCKET_SQL = "b AS (SELECT unnest(list_append([0.5, 1, 2, 3, 5, 8, 12, 20, 30]::DOUBLE[], 'infinity'::DOUBLE)) AS le)"


@CATALOG.add("A30", f"""WITH {LOG_SQL}, {BUCKET_SQL}, h AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, le, count(*) FILTER (total_ms / 1000 <= le) AS n FROM costed, b WHERE event = 'query' GROUP BY ALL),
    r AS (SELECT *, coalesce(lag(le) OVER w, 0) AS low, coalesce(lag(n) OVER w, 0) AS below, max(n) OVER (PARTITION BY day) AS total FROM h WINDOW w AS (PARTITION BY day ORDER BY le)), f AS (SELECT * FROM r WHERE n >= total * 0.95 QUALIFY row_number() OVER (PARTITION BY day ORDER BY le) = 1)
    SELECT strftime(day, '%Y-%m-%d') AS day, round(CASE WHEN isinf(le) THEN low ELSE low + (le - low) * (total * 0.95::DOUBLE - below) / (n - below) END, 6) AS value FROM f""")
def histogram_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 95th percentile of each day, from the histogram alone."""
    q = log_of(spark, sf_dir).filter("event = 'query'").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), (F.col("total_ms") / 1000).alias("x"))
    return reports.quantiles(reports.histogram(q, ["day"], reports.BUCKETS["request_seconds"]), ["day"], 0.95)


@CATALOG.add("ST6, A30", f"""WITH {LOG_SQL}, w AS (SELECT route, to_timestamp(epoch(time_bucket(INTERVAL 1 HOUR, ts)) - h * 3600)::TIMESTAMP AS start FROM costed, unnest([0, 1, 2]) AS u(h) WHERE event = 'query') SELECT strftime(start, '%Y-%m-%d %H:%M') AS start, route, count(*) AS n FROM w GROUP BY ALL""")
def sliding_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries by route in windows of three hours that start each hour."""
    q = log_of(spark, sf_dir).filter("event = 'query'")
    return q.groupBy(F.window("ts", "3 hours", "1 hour").alias("w"), "route").agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "route", "n")


@CATALOG.add("A22", f"WITH {LOG_SQL} SELECT route, count(*) AS n, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS share FROM costed WHERE event = 'query' GROUP BY route")
def route_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = log_of(spark, sf_dir).filter("event = 'query'")
    return q.groupBy("route").agg(F.count("*").alias("n")).crossJoin(F.broadcast(q.agg(F.count("*").alias("all")))).select("route", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))


@CATALOG.add("A20, A21, A23, P14, P16, S29", f"""WITH {LOG_SQL}, q AS (SELECT *, coalesce(context_budget, 0) > 6000 AS stale, cited IS NOT NULL AND stream_error IS NULL AS answered, coalesce(declined, false) AS no FROM costed WHERE event = 'query')
    SELECT count(*) FILTER (NOT stale) AS queries, count(*) FILTER (stale) AS stale, count(*) FILTER (NOT stale AND answered AND cited AND NOT no) AS cited, count(*) FILTER (NOT stale AND answered AND NOT cited AND NOT no) AS uncited, count(*) FILTER (NOT stale AND answered AND no) AS declined, count(*) FILTER (NOT stale AND stream_error IS NOT NULL) AS broken,
        round(count(*) FILTER (NOT stale AND answered AND cited AND NOT no) / nullif(count(*) FILTER (NOT stale AND answered AND NOT no), 0)::DOUBLE, 6) AS citation_rate, round(avg(prompt_tokens) FILTER (NOT stale), 6) AS tokens_in, round(avg(completion_tokens) FILTER (NOT stale), 6) AS tokens_out, round(sum(cost_usd) FILTER (NOT stale), 6) AS cost, round(sum(cost_usd) FILTER (NOT stale) / count(*) FILTER (NOT stale), 9) AS cost_per_query,
        min(context_budget) FILTER (NOT stale) AS least_budget, max(context_budget) FILTER (NOT stale) AS most_budget FROM q""")
def runtime_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.report(log_of(spark, sf_dir), 6000)


@CATALOG.add("F24, S16", "SELECT user_id % 10 AS bucket, count(*) AS n, sum((props::JSON->>'k')::BIGINT)::BIGINT AS total FROM events WHERE json_valid(CASE event_id % 7 WHEN 0 THEN left(props, 4) ELSE props END) GROUP BY 1")
def tolerant_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a log of which every seventh is cut off; those that are not JSON are left out."""
    e = load(spark, sf_dir, "events").withColumn("line", F.when(F.col("event_id") % 7 == 0, F.left("props", F.lit(4))).otherwise(F.col("props")))
    sound = e.filter(F.try_parse_json("line").isNotNull())
    return sound.groupBy((F.col("user_id") % 10).alias("bucket")).agg(F.count("*").alias("n"), F.sum(F.from_json("line", "k bigint")["k"]).alias("total"))


@CATALOG.add("R10", f"""WITH {LOG_SQL}, runs AS (SELECT 'clients ' || (event_id % 4) AS run, total_ms * (1 + event_id % 4 * 0.2::DOUBLE) AS ms, stream_error IS NOT NULL AS failed FROM costed), n AS (SELECT run, count(*) FILTER (NOT failed) AS ok, count(*) FILTER (failed) AS failed FROM runs GROUP BY 1), p AS (SELECT run, list_sort(list(ms)) AS x FROM runs WHERE NOT failed GROUP BY 1),
    q AS (SELECT run, x[least(floor(len(x) * 0.5)::BIGINT, len(x) - 1) + 1] AS p50, x[least(floor(len(x) * 0.95)::BIGINT, len(x) - 1) + 1] AS p95 FROM p) SELECT run, ok, failed, p50, p95, round((p50 - b) / b, 6) AS change, round((p50 - b) / b, 6) > 0.3 AS worse FROM n JOIN q USING (run), (SELECT p50 AS b FROM q WHERE run = 'clients 0')""")
def load_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = log_of(spark, sf_dir).select(F.concat(F.lit("clients "), F.col("event_id") % 4).alias("run"), (F.col("total_ms") * (1 + F.col("event_id") % 4 * F.lit(0.2))).alias("ms"), F.col("stream_error").isNotNull().alias("failed"))
    return reports.verdicts(runs, "clients 0")


# A process that was started anew twice, and is looked at every ten minutes; ranges of three hours that end every hour.
SCRAPE, RANGE, STEP = 600, 10_800, 3600
LIVES = ("2024-01-01 00:00:00", "2024-01-11 05:07:30", "2024-01-21 17:41:10", "2024-01-31 00:00:00")
RESETS_SQL = f"lives(start, ending) AS (VALUES {', '.join(f"(TIMESTAMP '{a}', TIMESTAMP '{b}')" for a, b in zip(LIVES, LIVES[1:], strict=False))})"


def scraped_sql(series: str) -> str:
    """series: a query of ser (one column), ts, n. Gives s: ser, t (seconds), v."""
    return f"""{RESETS_SQL}, e AS ({series}), p AS (SELECT ser, epoch(start) AS start, epoch(ending) AS ending, ceil(epoch_us(ts) / {SCRAPE * 10**6}) * {SCRAPE} AS t, n FROM e JOIN lives ON ts >= start AND ts < ending),
    a AS (SELECT ser, start, ending, t, sum(n) AS n FROM p WHERE t < ending GROUP BY ALL), h AS (SELECT ser, start, ending, min(t)::BIGINT AS low, (floor((ending - 0.000001) / {SCRAPE}) * {SCRAPE})::BIGINT AS high FROM a GROUP BY ser, start, ending), slots AS (SELECT ser, start, ending, unnest(range(low, high + 1, {SCRAPE})) AS t FROM h),
    s AS (SELECT ser, t, sum(coalesce(n, 0)) OVER (PARTITION BY ser, start ORDER BY t ROWS UNBOUNDED PRECEDING)::DOUBLE AS v FROM slots LEFT JOIN a USING (ser, start, ending, t))"""


INCREASE_SQL = f"""l AS (SELECT *, lag(v) OVER (PARTITION BY ser ORDER BY t) AS b FROM s), g AS (SELECT ser, t, v, v + sum(CASE WHEN v < b THEN b ELSE 0 END) OVER (PARTITION BY ser ORDER BY t ROWS UNBOUNDED PRECEDING) AS c FROM l),
    w AS (SELECT ser, (ceil(t / {STEP}.0) + k) * {STEP} AS upto, t, v, c FROM g, (SELECT unnest(range({RANGE // STEP})) AS k)), q AS (SELECT ser, upto, count(*) AS n, min(t) AS first, max(t) AS last, arg_min(v, t) AS value, arg_max(c, t) - arg_min(c, t) AS grew FROM w GROUP BY ser, upto HAVING count(*) > 1),
    m AS (SELECT *, last - first AS span, (last - first) / (n - 1)::DOUBLE AS mean FROM q), d AS (SELECT *, CASE WHEN first - upto + {RANGE} >= mean * 1.1::DOUBLE THEN mean / 2 ELSE first - upto + {RANGE} END AS lft, CASE WHEN upto - last >= mean * 1.1::DOUBLE THEN mean / 2 ELSE upto - last END AS rgt FROM m),
    inc AS (SELECT ser, upto, grew * (span + CASE WHEN grew > 0 THEN least(lft, span * value / grew) ELSE lft END + rgt) / span AS increase FROM d)"""
ROUTES_SQL = "SELECT route AS ser, ts, 1 AS n FROM costed WHERE event = 'query'"
BUCKETS_SQL = "SELECT le AS ser, ts, (total_ms / 1000 <= le)::INTEGER AS n FROM costed, b WHERE event = 'query'"


def lives_of(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(zip(LIVES, LIVES[1:], strict=False)), "start string, ending string").select(F.to_timestamp("start").alias("start"), F.to_timestamp("ending").alias("ending"))


def queries_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_of(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")).filter("event = 'query'")


@CATALOG.add("A30, S30", f"""WITH {LOG_SQL}, {scraped_sql(ROUTES_SQL)}, {INCREASE_SQL} SELECT ser AS route, strftime(to_timestamp(upto)::TIMESTAMP, '%Y-%m-%d %H:%M') AS moment, round(increase, 6) AS increase FROM inc""")
def rate_increases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much each route's counter grew, across two starts of the process."""
    samples = rates.scraped(queries_of(spark, sf_dir).select("route", "ts", F.lit(1).alias("n")), ["route"], SCRAPE, lives_of(spark))
    return rates.increases(samples, ["route"], RANGE, STEP).select("route", F.date_format("at", "yyyy-MM-dd HH:mm").alias("moment"), F.round("increase", 6).alias("increase"))


@CATALOG.add("A30, S30", f"""WITH {LOG_SQL}, {BUCKET_SQL}, {scraped_sql(BUCKETS_SQL)}, {INCREASE_SQL}, r AS (SELECT upto, ser AS le, max(increase / {RANGE}) OVER (PARTITION BY upto ORDER BY ser ROWS UNBOUNDED PRECEDING) AS n FROM inc),
    o AS (SELECT *, coalesce(lag(le) OVER w, 0) AS low, coalesce(lag(n) OVER w, 0) AS below, max(n) OVER (PARTITION BY upto) AS total FROM r WINDOW w AS (PARTITION BY upto ORDER BY le)), f AS (SELECT * FROM o, (VALUES (0.5::DOUBLE), (0.95::DOUBLE)) AS p(share) WHERE total > 0 AND n >= total * share QUALIFY row_number() OVER (PARTITION BY upto, share ORDER BY le) = 1)
    SELECT strftime(to_timestamp(upto)::TIMESTAMP, '%Y-%m-%d %H:%M') AS moment, share, round(CASE WHEN isinf(le) THEN low ELSE coalesce(low + (le - low) * (total * share - below) / nullif(n - below, 0), low) END, 6) AS seconds FROM f""")
def rate_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and 95th percentile of the seconds of a request, from the rates of the buckets' counters alone."""
    bounds = F.explode(F.array(*[F.lit(float(b)) for b in (*reports.BUCKETS["request_seconds"], float("inf"))])).alias("le")
    counted = queries_of(spark, sf_dir).select("ts", (F.col("total_ms") / 1000).alias("x"), bounds).select("le", "ts", (F.col("x") <= F.col("le")).cast("int").alias("n"))
    samples = rates.scraped(counted, ["le"], SCRAPE, lives_of(spark))
    found = rates.rate_quantiles(rates.increases(samples, ["le"], RANGE, STEP), ["at"], (0.5, 0.95))
    return found.select(F.date_format("at", "yyyy-MM-dd HH:mm").alias("moment"), "share", F.round("value", 6).alias("seconds"))


OUTCOMES_SQL = f"SELECT {OUTCOME_SQL} AS ser, ts, 1 AS n FROM costed WHERE event = 'query'"


@CATALOG.add("S30", f"""WITH {LOG_SQL}, {scraped_sql(OUTCOMES_SQL)}, now AS (SELECT ser, arg_max(v, t) AS value FROM s GROUP BY ser) SELECT 'outcome' AS gauge, ser AS label, value FROM now UNION ALL SELECT 'queries', '', sum(value) FROM now
    UNION ALL SELECT 'cited share', '', round(sum(value) FILTER (ser = 'cited') / sum(value) FILTER (ser IN ('cited', 'uncited')), 6) FROM now""")
def dashboard_gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last scrape shows: the outcomes, their sum, and the share of cited answers among those that were given, a ratio of sums."""
    samples = rates.scraped(queries_of(spark, sf_dir).select(reports.outcome().alias("label"), "ts", F.lit(1).alias("n")), ["label"], SCRAPE, lives_of(spark))
    now = rates.latest(samples, ["label"])
    total, given = F.sum("value"), F.sum(F.when(F.col("label").isin("cited", "uncited"), F.col("value")))
    both = now.agg(total.alias("q"), F.round(F.try_divide(F.sum(F.when(F.col("label") == "cited", F.col("value"))), given), 6).alias("s"))
    sums = both.select(F.inline(F.array(F.struct(F.lit("queries").alias("gauge"), F.lit("").alias("label"), F.col("q").alias("value")), F.struct(F.lit("cited share").alias("gauge"), F.lit("").alias("label"), F.col("s").alias("value")))))
    return now.select(F.lit("outcome").alias("gauge"), "label", "value").unionByName(sums)
