"""Queries that run streams to their end, and what a batch gives for the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.plans.base import Catalog
from leafmill.plans.metrics import LOG_SQL, log_from
from leafmill.sources.shared import shared_folder
from leafmill.sources.tables import load
from leafmill.streaming import jobs, keyed

CATALOG = Catalog()


def streamed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its file, or of the files of its folder."""
    # a pattern, as a stream takes a single file by one alone
    return spark.readStream.schema(load(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def to_end(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over all that is there, and returns what it wrote to the shared folder: of a complete output the last state, else all rows."""
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    write = lambda df, _: df.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{folder}/out")
    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


@CATALOG.add("ST5", f"WITH {LOG_SQL} SELECT strftime(ts, '%Y-%m-%d') AS day, route, count(*) AS n, round(sum(cost_usd), 6) AS cost_usd FROM costed WHERE event = 'query' GROUP BY ALL")
def replay_equals_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a stream over the log; the SQL is the replay of the whole log."""
    out = to_end(jobs.counted(log_from(streamed(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))), "complete")
    return out.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "route", "n", F.round("cost_usd", 6).alias("cost_usd"))


@CATALOG.add("ST6", f"""WITH {LOG_SQL}, w AS (SELECT route, to_timestamp(epoch(time_bucket(INTERVAL 1 HOUR, ts)) - h * 3600)::TIMESTAMP AS start FROM costed, unnest([0, 1, 2]) AS u(h) WHERE event = 'query') SELECT strftime(start, '%Y-%m-%d %H:%M') AS start, route, count(*) AS n FROM w GROUP BY ALL""")
def stream_sliding_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = to_end(jobs.rates(log_from(streamed(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))), "3 hours", "1 hour"), "complete")
    return out.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "route", "n")


# Users stand for jobs; clicks parse, views index, signups are ready, purchases summarise, errors fail.
JOB_SQL = """ev AS (SELECT user_id AS job_id, event_id, ts, CASE event_type WHEN 'click' THEN 'parsing' WHEN 'view' THEN 'indexing' WHEN 'signup' THEN 'ready' WHEN 'purchase' THEN 'summarizing' ELSE CASE WHEN event_id % 5 = 0 THEN 'failed' ELSE 'ready' END END AS stage, CASE WHEN event_id % 13 = 0 THEN 'summary_ready' END AS detail FROM events),
    o AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS n FROM ev), f AS (SELECT job_id, min(n) FILTER (stage = 'failed') AS fail FROM o GROUP BY 1), live AS (SELECT o.*, fail FROM o JOIN f USING (job_id) WHERE fail IS NULL OR n <= fail)"""


@CATALOG.add("ST1, ST2", f"""WITH {JOB_SQL} SELECT job_id, arg_max(stage, n) AS stage, bool_or(stage IN ('ready', 'failed')) AS done, bool_or(detail = 'summary_ready' AND stage <> 'failed') IS TRUE OR any_value(fail) IS NOT NULL AS finished, max(CASE WHEN stage = 'failed' THEN coalesce(detail, 'failed') END) AS error, (SELECT count(*) FROM o WHERE o.job_id = live.job_id) AS updates FROM live GROUP BY job_id""")
def stream_job_fsm(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    stage = F.when(kind == "click", "parsing").when(kind == "view", "indexing").when(kind == "signup", "ready").when(kind == "purchase", "summarizing").when(F.col("event_id") % 5 == 0, "failed").otherwise("ready")
    events = streamed(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), "event_id", "ts", stage.alias("stage"), F.when(F.col("event_id") % 13 == 0, "summary_ready").alias("detail"))
    out = to_end(jobs.job_states(events), "update")
    return out.groupBy("job_id").agg(F.max_by(F.struct("stage", "done", "finished", "error"), "updates").alias("s"), F.max("updates").alias("updates")).select("job_id", "s.*", "updates")


@CATALOG.add("extension: event counts", r"""SELECT conv_id * 100 + turn AS query_id, count(*) AS n FROM conversations, unnest(range(len(regexp_extract_all(text, '\S+\s*')) + 5)) GROUP BY 1""")
def answer_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events a client is sent for each turn's text: a route, three stages, a word each, done."""
    answers = load(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), F.lit("qa").alias("route"), "text", F.lit(None).cast("string").alias("error"))
    return jobs.answer_events(answers).filter("not (kind = 'token' and value = '')").groupBy("query_id").agg(F.count("*").alias("n"))


@CATALOG.add("ST4", "SELECT conv_id AS query_id, count(*) AS done, max(turn) + 1 AS total FROM conversations GROUP BY 1")
def summary_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = streamed(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), (F.col("turn") + 1).alias("total"))
    return to_end(jobs.progress(events), "complete")


@CATALOG.add("extension: session windows", """WITH o AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOUR, true) AS opens FROM events), s AS (SELECT user_id, ts, sum(opens::INTEGER) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM o)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, s""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jobs.sessions(load(spark, sf_dir, "events"), "6 hours")
    return out.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@CATALOG.add("extension: rollup", "SELECT coalesce(event_type, 'all') AS event_type, coalesce(strftime(ts, '%Y-%m-%d'), 'all') AS day, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ROLLUP (event_type, strftime(ts, '%Y-%m-%d'))")
def daily_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").select("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"), "value")
    out = e.rollup("event_type", "day").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return out.select(F.coalesce("event_type", F.lit("all")).alias("event_type"), F.coalesce("day", F.lit("all")).alias("day"), "n", "value")


def in_parts(frame: DataFrame, parts: list[str]) -> Iterator[tuple[str, DataFrame]]:
    """A folder that gets one part of the frame after another, with the stream over it; between them the stream can be run and stopped."""
    spark = frame.sparkSession
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    for k, part in enumerate(parts):
        frame.filter(part).write.parquet(f"{folder}/{k}")
        yield folder, spark.readStream.schema(frame.schema).option("recursiveFileLookup", "true").parquet(folder)


def run_on(stream: DataFrame, sink: Callable[[DataFrame, int], None], mode: str, state: str) -> None:
    """Runs a stream over all that is there, from where it stopped."""
    stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


# As above, but events divisible by 11 are subscribers that come then, and jobs divisible by 4 were ready before.
FOLLOWED_SQL = f"""{JOB_SQL.replace("FROM events)", "FROM events WHERE event_id % 11 <> 0)")}, subs AS (SELECT user_id AS job_id, event_id AS subscriber, ts FROM events WHERE event_id % 11 = 0),
    timed AS (SELECT live.*, sum((stage = 'failed' OR detail IS NOT NULL)::INTEGER) OVER (PARTITION BY job_id ORDER BY n ROWS UNBOUNDED PRECEDING) > 0 AS finished FROM live)"""
PATIENCE = 6 * 3600


def followed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream over the first half of the time, stopped, and started again with the rest."""
    e, kind = load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), F.col("event_type")
    stage = F.when(kind == "click", "parsing").when(kind == "view", "indexing").when(kind == "signup", "ready").when(kind == "purchase", "summarizing").when(F.col("event_id") % 5 == 0, "failed").otherwise("ready")
    events = e.select(F.col("user_id").alias("job_id"), "event_id", "ts", F.when(F.col("event_id") % 11 == 0, "subscribe").otherwise("event").alias("kind"), stage.alias("stage"), F.when(F.col("event_id") % 13 == 0, "summary_ready").alias("detail"))
    known = events.select("job_id").distinct().filter("job_id % 4 = 0").select("job_id", F.lit("ready").alias("stage"), F.lit(True).alias("done"))
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    half = f"ts < timestamp '{low + (high - low) / 2}'"
    out, state = f"{shared_folder(spark)}/{uuid.uuid4().hex}", f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    sink = keyed.Once(out)
    for _, stream in in_parts(events, [half, f"not {half}"]):
        run_on(keyed.followed(stream, known, PATIENCE), sink, "update", state)
    return sink.read(spark, keyed.JOB_OUT)


@CATALOG.add("ST1, ST2", f"""WITH {FOLLOWED_SQL}, jobs AS (SELECT job_id, max(ts) AS last FROM (SELECT job_id, ts FROM ev UNION ALL SELECT job_id, ts FROM subs) GROUP BY 1),
    ended AS (SELECT job_id, arg_max(stage, n) AS stage, bool_or(stage IN ('ready', 'failed')) AS done, bool_or(finished) AS finished, max(CASE WHEN stage = 'failed' THEN coalesce(detail, 'failed') END) AS error FROM timed GROUP BY 1), counted AS (SELECT job_id, count(*) AS updates FROM ev GROUP BY 1)
    SELECT job_id, coalesce(stage, CASE job_id % 4 WHEN 0 THEN 'ready' ELSE 'queued' END) AS stage, coalesce(done, false) OR job_id % 4 = 0 AS done, coalesce(finished, false) AS finished, error, coalesce(updates, 0) AS updates,
        NOT coalesce(finished, false) AND last + INTERVAL {PATIENCE} SECOND <= (SELECT max(ts) FROM events) AS stalled FROM jobs LEFT JOIN ended USING (job_id) LEFT JOIN counted USING (job_id)""")
def stream_jobs_restarted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state of each job, of a stream that was stopped and started again, from jobs known before; stalled ones by timers."""
    return keyed.latest(followed_rows(spark, sf_dir))


@CATALOG.add("ST1, S22", f"""WITH {FOLLOWED_SQL}, seen AS (SELECT s.job_id, s.subscriber, max(t.n) AS upto, coalesce(bool_or(t.finished), false) AS over, arg_max(t.stage, t.n) AS stage, coalesce(bool_or(t.stage IN ('ready', 'failed')), false) OR s.job_id % 4 = 0 AS done FROM subs s LEFT JOIN timed t ON t.job_id = s.job_id AND (t.ts, t.event_id) < (s.ts, s.subscriber) GROUP BY 1, 2),
    firsts AS (SELECT job_id, subscriber, 0 AS seq, coalesce(stage, CASE job_id % 4 WHEN 0 THEN 'ready' ELSE 'queued' END) AS stage, done, over AS finished, coalesce(upto, 0) AS upto FROM seen),
    ends AS (SELECT job_id, min(n) FILTER (finished) AS ending FROM timed GROUP BY 1),
    rest AS (SELECT f.job_id, f.subscriber, row_number() OVER (PARTITION BY f.subscriber ORDER BY t.n)::INTEGER AS seq, t.stage, f.done OR bool_or(t.stage IN ('ready', 'failed')) OVER (PARTITION BY f.subscriber ORDER BY t.n ROWS UNBOUNDED PRECEDING) AS done, t.finished FROM firsts f JOIN timed t ON t.job_id = f.job_id AND t.n > f.upto JOIN ends e ON e.job_id = f.job_id WHERE NOT f.finished AND (ending IS NULL OR t.n <= ending))
    SELECT job_id, subscriber, seq, stage, done, finished FROM firsts UNION ALL SELECT * FROM rest""")
def stream_late_subscribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each subscriber gets: the state of its job when it came, then each change until the job is finished, across the stop."""
    return followed_rows(spark, sf_dir).filter("subscriber is not null").select("job_id", "subscriber", "seq", "stage", "done", "finished")


class Broken(RuntimeError):
    """Stands for a machine that is lost between the writing of a batch and its being known as written."""


@CATALOG.add("ST3, S22", """WITH t AS (SELECT conv_id, turn, text, max(turn) OVER (PARTITION BY conv_id) AS final, conv_id % 4 = 0 AS breaks FROM conversations),
    e AS (SELECT conv_id, 0 AS o, 0 AS turn, 'route' AS kind, CASE conv_id % 3 WHEN 0 THEN 'qa' WHEN 1 THEN 'comparison' ELSE 'table_lookup' END AS value FROM t WHERE turn = 0 UNION ALL SELECT conv_id, i, 0, 'stage', s FROM t, (VALUES (1, 'retrieving'), (2, 'packing'), (3, 'generating')) AS v(i, s) WHERE turn = 0
        UNION ALL SELECT conv_id, 4, turn, 'token', text FROM t WHERE text <> '' AND NOT (breaks AND turn >= 2) UNION ALL SELECT conv_id, 5, 2, 'break', 'RemoteProtocolError' FROM t WHERE breaks AND turn = 2 UNION ALL SELECT conv_id, 6, turn, 'done', CASE WHEN breaks AND final >= 2 THEN 'RemoteProtocolError' ELSE '' END FROM t WHERE turn = final)
    SELECT conv_id AS query_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, o) - 1)::INTEGER AS seq, kind, value FROM e""")
def stream_answer_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbered events of each conversation as an answer whose turns are its pieces; every fourth breaks off at its third. The second batch is lost after it was
    written, and comes again when the stream is started anew."""
    turns = load(spark, sf_dir, "conversations")
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("final"))
    route = F.when(F.col("conv_id") % 3 == 0, "qa").when(F.col("conv_id") % 3 == 1, "comparison").otherwise("table_lookup")
    breaks = (F.col("conv_id") % 4 == 0) & (F.col("turn") == 2)
    pieces = turns.join(last, "conv_id").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("at"), route.alias("route"), "text", F.when(breaks, "RemoteProtocolError").alias("error"), (F.col("turn") == F.col("final")).alias("last"))
    sink, state, lost = keyed.Once(f"{shared_folder(spark)}/{uuid.uuid4().hex}"), f"{shared_folder(spark)}/{uuid.uuid4().hex}", []

    def fragile(batch: DataFrame, number: int) -> None:
        sink(batch, number)
        if number and not lost:
            lost.append(number)
            raise Broken(number)

    for _, stream in in_parts(pieces, ["at < 2", "at >= 2"]):
        try:
            run_on(keyed.answer_stream(stream), fragile, "append", state)
        except StreamingQueryException:
            run_on(keyed.answer_stream(stream), fragile, "append", state)
    return sink.read(spark, keyed.ANSWER_OUT)
