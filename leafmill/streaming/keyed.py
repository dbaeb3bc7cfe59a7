"""Keyed state with transformWithState: jobs with their subscribers, and answers as numbered events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
JOB = "stage string, done boolean, summary boolean, error string, updates bigint, followers int, timer bigint"
JOB_OUT = "job_id bigint, subscriber bigint, seq int, stage string, done boolean, finished boolean, error string, updates bigint, stalled boolean"
JOB_ROW = Row(*(x.split()[0] for x in JOB_OUT.split(", ")))
ANSWER_OUT = "query_id bigint, seq int, kind string, value string"
STAGES = ("retrieving", "packing", "generating")


def with_state_store(spark: SparkSession) -> None:
    """The state store that transformWithState needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class Jobs(StatefulProcessor):
    """A job's stage, and who follows it.

    A job is done once it was ready or failed, and finished when it failed or has its summary; nothing changes a failed job. A subscriber first gets the state as it
    is, then each change until the job is finished. A job that is not finished and has had no event for `patience` seconds of event time is stalled until
    the next one.

    Each call of the state goes to the JVM and back, so a follower is kept once, with the updates that there were when it came (what it was sent since is the
    difference), and the job's row tells how many there are and when its timer ends.
    """

    def __init__(self, patience: int) -> None:
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", JOB)
        self.followers = handle.getListState("followers", "subscriber bigint, since bigint")

    @staticmethod
    def _row(key: tuple, state: tuple, subscriber: int | None = None, seq: int | None = None, stalled: bool = False) -> Row:
        stage, done, summary, error, updates = state
        return JOB_ROW(key[0], subscriber, seq, stage, done, summary or error is not None, error, updates, stalled)

    def handleInitialState(self, key: tuple, initialState: Row, timerValues: object) -> None:
        self.job.update((initialState.stage, initialState.done, False, None, 0, 0, None))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        events = sorted(rows, key=lambda e: (e.ts, e.event_id))
        stage, done, summary, error, updates, held, timer = self.job.get() or ("queued", False, False, None, 0, 0, None)
        followers = [(f[0], f[1]) for f in self.followers.get()] if held else []
        known = len(followers)
        for e in events:
            if e.kind == "subscribe":
                yield self._row(key, (stage, done, summary, error, updates), e.event_id, 0)
                if not (summary or error is not None):
                    followers.append((e.event_id, updates))
                continue
            updates += 1
            if error is not None:
                continue
            if e.stage == "failed":
                error, stage = e.detail or "failed", "failed"
            else:
                stage, summary = e.stage, summary or e.detail == "summary_ready"
            done = done or stage == "ready" or error is not None
            for f, since in followers:
                yield self._row(key, (stage, done, summary, error, updates), f, updates - since)
            if summary or error is not None:
                followers = []
        finished = summary or error is not None
        if finished and held:
            self.followers.clear()
        elif len(followers) > known:
            self.followers.appendList(followers[known:])
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = None if finished else int(events[-1].ts.timestamp() * 1000) + self.patience * 1000
        if timer is not None:
            self.handle.registerTimer(timer)
        self.job.update((stage, done, summary, error, updates, len(followers), timer))
        yield self._row(key, (stage, done, summary, error, updates))

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        *state, held, _ = self.job.get()
        self.job.update((*state, held, None))
        yield self._row(key, tuple(state), stalled=True)

    def close(self) -> None:
        pass


def followed(events: DataFrame, known: DataFrame, patience: int, late: str = "0 seconds") -> DataFrame:
    """What subscribers get (subscriber, seq from 0), and with a null subscriber the state of each job after each batch with events of it, and when it stalls.

    events: job_id, event_id, ts, kind (event or subscribe), stage, detail, a stream whose batches follow each other in time; known: job_id, stage, done of jobs that there were before.
    """
    with_state_store(events.sparkSession)
    first = known.select("job_id", "stage", "done").groupBy("job_id")
    rows = events.select("job_id", "event_id", "ts", "kind", "stage", "detail").withWatermark("ts", late)
    return rows.groupBy("job_id").transformWithState(Jobs(patience), JOB_OUT, "Update", "EventTime", first)


class Answers(StatefulProcessor):
    """The events of an answer, numbered without gaps however its pieces are spread over batches."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("answer", "seq int, error string, over boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        seq, error, over = tuple(self.state.get()) if self.state.exists() else (0, None, False)
        out: list[tuple] = []
        for e in pd.concat(list(rows)).sort_values("at").itertuples():
            if over:
                break
            if not seq:
                out += [("route", e.route), *(("stage", s) for s in STAGES)]
                seq = 4
            if e.error is not None and error is None:
                error = e.error
                out.append(("break", error))
                seq += 1
            elif error is None and e.text:
                out.append(("token", e.text))
                seq += 1
            if e.last:
                out.append(("done", error or ""))
                seq, over = seq + 1, True
        self.state.update((seq, error, over))
        first = seq - len(out)
        yield pd.DataFrame([(key[0], first + k, *x) for k, x in enumerate(out)], columns=["query_id", "seq", "kind", "value"])

    def close(self) -> None:
        pass


def answer_stream(pieces: DataFrame) -> DataFrame:
    """query_id, seq, kind, value: an answer's route and stages, its pieces, the break if it broke off (pieces after it are dropped), and done, with the error.

    pieces: query_id, at (order), route, text, error (not null where the answer breaks off), last; a stream.
    """
    with_state_store(pieces.sparkSession)
    return pieces.select("query_id", "at", "route", "text", "error", "last").groupBy("query_id").transformWithStateInPandas(Answers(), ANSWER_OUT, "Append", "None")


class Once:
    """A sink for foreachBatch that may get a batch again: each batch has a folder of its own, and one that is whole is not written twice, but read to its end, as the
    state of keys is kept only then."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        whole = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/batch={number}/_SUCCESS")
        if whole.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(whole):
            batch.write.format("noop").mode("overwrite").save()
        else:
            batch.write.mode("overwrite").parquet(f"{self.folder}/batch={number}")

    def read(self, spark: SparkSession, schema: str) -> DataFrame:
        return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(self.folder)


def latest(rows: DataFrame) -> DataFrame:
    """The last state of each job among those with a null subscriber."""
    last = F.max_by(F.struct("stage", "done", "finished", "error", "updates", "stalled"), F.struct("updates", "stalled"))
    return rows.filter("subscriber is null").groupBy("job_id").agg(last.alias("s")).select("job_id", "s.*")
