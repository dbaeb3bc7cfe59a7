"""Streams: the stages of indexing jobs, counters, sliding rates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: The stages of a job; failed and ready with a summary are the ends.
STAGES = ("queued", "parsing", "indexing", "ready", "summarizing")
OUT = "job_id bigint, stage string, done boolean, finished boolean, error string, updates bigint"
STATE = "stage string, done boolean, summary boolean, error string, seen bigint"


def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A job's state after its new events: done once it was ready or failed, and ever after; finished when it failed, came from the cache, or has its summary."""
    stage, done, summary, error, seen = state.get if state.exists else ("queued", False, False, None, 0)
    events = pd.concat(list(frames)).sort_values(["ts", "event_id"])
    for e in events.itertuples():
        seen += 1
        if error is not None:
            continue
        if e.stage == "failed":
            error, stage = e.detail or "failed", "failed"
        else:
            stage = e.stage
            summary = summary or e.detail in ("summary_ready", "cached")
        done = done or stage == "ready" or error is not None
    state.update((stage, done, summary, error, seen))
    yield pd.DataFrame([(key[0], stage, done, summary or error is not None, error, seen)], columns=["job_id", "stage", "done", "finished", "error", "updates"])


def job_states(events: DataFrame) -> DataFrame:
    """The state of each job after each batch with events of it. events: job_id, event_id, ts, stage, detail; a batch or a stream."""
    rows = events.select("job_id", "event_id", "ts", "stage", "detail")
    return rows.groupBy("job_id").applyInPandasWithState(follow, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def counted(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Queries and their cost by route and day; a day is closed when the stream is `late` past it."""
    q = events.filter("event = 'query'").withWatermark("ts", late)
    return q.groupBy(F.window("ts", "1 day").alias("w"), "route").agg(F.count("*").alias("n"), F.sum("cost_usd").alias("cost_usd"))


def rates(events: DataFrame, size: str, slide: str, late: str = "1 hour") -> DataFrame:
    """Queries by route in sliding windows."""
    return events.filter("event = 'query'").withWatermark("ts", late).groupBy(F.window("ts", size, slide).alias("w"), "route").agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """Extension: queries of a user in sessions that end after a gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))


def progress(events: DataFrame) -> DataFrame:
    """query_id, step, total of each summary's parts as they come: how many are done so far. events: query_id, total; a stream."""
    return events.groupBy("query_id").agg(F.count("*").alias("done"), F.max("total").alias("total"))


def answer_events(answers: DataFrame) -> DataFrame:
    """query_id, seq, kind, value: what a client is sent of each answer: its route, the stages, the words, and done, with the error if it broke off.

    answers: query_id, route, text, error (null if whole).
    """
    words = F.transform(F.split("text", r"(?<=\s)"), lambda w: F.struct(F.lit("token").alias("kind"), w.alias("value")))
    fixed = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    head = F.array(fixed("route", F.col("route")), *[fixed("stage", F.lit(s)) for s in ("retrieving", "packing", "generating")])
    return answers.select("query_id", F.posexplode(F.concat(head, words, F.array(fixed("done", F.coalesce("error", F.lit("")))))).alias("seq", "e")).select("query_id", "seq", "e.kind", "e.value")
