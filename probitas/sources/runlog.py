"""What runs did, beside their results: counts that Spark observes on the way, rates, remaining time, and sinks for them.

    log = RunLog(table_sink(spark, "/results/_runs"))
    log.run("graded", graded, lambda df: df.write.parquet(path), total=n, wrong=F.count_if(~F.col("correct")))
    with log.streams(spark):
        ingest.start(observed(stream, "answers"), ...).awaitTermination()

Counts are made by `DataFrame.observe` in the job that makes the result, so nothing is read twice. They are for people to
watch, not results: tasks that run again after an executor is lost may count again. Whatever fails in a sink or in counting
is kept in ``log.failures`` and changes nothing else.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import TypeVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

from .writers import append_json

Result = TypeVar("Result")
Sink = Callable[[dict], None]
_TEXT, _LONG, _DOUBLE = T.StringType(), T.LongType(), T.DoubleType()
_FIELDS = {"run": _TEXT, "name": _TEXT, "kind": _TEXT, "status": _TEXT, "batch": _LONG, "rows": _LONG, "seconds": _DOUBLE, "rate": _DOUBLE, "remaining_seconds": _DOUBLE, "metrics": _TEXT, "error": _TEXT}
RECORDS = T.StructType([T.StructField(k, t) for k, t in _FIELDS.items()])
#: So long a finished job is waited for to tell its counts.
PATIENCE = 30.0


def pace(done: int, total: int | None, seconds: float) -> dict:
    """Rows a second so far, and the seconds that the rest will take at that rate; null where they can not be told."""
    rate = done / seconds if seconds > 0 else None
    left = None if total is None else max(total - done, 0)
    return {"rate": rate, "remaining_seconds": 0.0 if left == 0 else left / rate if left and rate else None}


def observed(df: DataFrame, name: str | Observation, **metrics: Column) -> DataFrame:
    """``df``, counted while it is computed: ``rows`` and the aggregates given. Streams take a name, batches an Observation."""
    return df.observe(name, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in metrics.items()])


def table_sink(spark: SparkSession, path: str) -> Sink:
    """Appends records to a table of JSON lines of RECORDS: one small file for each, of a job, a batch or a stream's batch."""
    return lambda record: append_json(spark.createDataFrame([record], RECORDS), path)


class RunLog:
    """Keeps records in order and hands each to the sinks. Fields: see RECORDS; metrics is JSON of the further counts."""

    def __init__(self, *sinks: Sink) -> None:
        self.sinks, self.run_id, self.records, self.failures = sinks, uuid.uuid4().hex, [], []
        self._lock = threading.Lock()

    def add(self, name: str, kind: str, status: str = "ok", rows: int | None = None, total: int | None = None, seconds: float | None = None, batch: int | None = None, metrics: dict | None = None, error: str | None = None) -> dict:
        how = pace(rows, total, seconds) if rows is not None and seconds is not None else {"rate": None, "remaining_seconds": None}
        record = {"run": self.run_id, "name": name, "kind": kind, "status": status, "batch": batch, "rows": rows, "seconds": seconds, **how, "metrics": json.dumps(metrics or {}, default=str, sort_keys=True), "error": error}
        with self._lock:
            self.records.append(record)
        for sink in self.sinks:
            self._quietly(lambda: sink(dict(record)))  # noqa: B023
        return record

    def _quietly(self, do: Callable[[], Result]) -> Result | None:
        try:
            return do()
        except Exception as error:  # what watches a run must not end it
            with self._lock:
                self.failures.append(error)
            return None

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(r[f] for f in RECORDS.names) for r in self.records], RECORDS)

    def run(self, name: str, df: DataFrame, action: Callable[[DataFrame], Result], total: int | None = None, every: float | None = None, **metrics: Column) -> Result:
        """``action(df)``, with a record of its rows, time and ``metrics``; an action that fails leaves one too, then raises.

        The counts are those of the action's first job over ``df``; an action that computes only a part of it tells that
        part's. With ``every``, tasks done and remaining seconds are recorded after so many seconds, again and again.
        """
        observation = Observation(f"{name}-{uuid.uuid4().hex}")
        watched = self._quietly(lambda: observed(df, observation, **metrics))
        began = time.monotonic()
        try:
            with self._watched_tasks(df.sparkSession, name, every):
                result = action(df if watched is None else watched)
        except Exception as error:
            self.add(name, "batch", "failed", seconds=time.monotonic() - began, error=str(error))
            raise
        seconds, got = time.monotonic() - began, {}
        if watched is not None:
            asked = threading.Thread(target=lambda: self._quietly(lambda: got.update(observation.get)), daemon=True)
            asked.start()  # asking waits for a job, and the action may have started none
            asked.join(PATIENCE)
            if not got:
                self.failures.append(TimeoutError(f"{name}: no counts"))
        self.add(name, "batch", rows=got.pop("rows", None), total=total, seconds=seconds, metrics=got)
        return result

    @contextmanager
    def _watched_tasks(self, spark: SparkSession, name: str, every: float | None) -> Iterator[None]:
        if every is None:
            yield
            return
        context, group, ended = spark.sparkContext, f"runlog-{uuid.uuid4().hex}", threading.Event()
        before, began = context.getLocalProperty("spark.jobGroup.id"), time.monotonic()

        def look() -> None:
            tracker = context.statusTracker()
            stages = {s for j in tracker.getJobIdsForGroup(group) for s in (tracker.getJobInfo(j) or _NO_JOB).stageIds}
            infos = [i for i in map(tracker.getStageInfo, stages) if i is not None]
            done, known = sum(i.numCompletedTasks for i in infos), sum(i.numTasks for i in infos)
            self.add(name, "tasks", "running", rows=done, total=known, seconds=time.monotonic() - began, metrics={"tasks": known})

        def poll() -> None:
            while not ended.wait(every):
                self._quietly(look)

        context.setLocalProperty("spark.jobGroup.id", group)
        thread = threading.Thread(target=poll, daemon=True)
        thread.start()
        try:
            yield
        finally:
            ended.set()
            context.setLocalProperty("spark.jobGroup.id", before)
            thread.join(PATIENCE)

    @contextmanager
    def streams(self, spark: SparkSession) -> Iterator[None]:
        """Records a batch of each stream that runs meanwhile: its rows read, time, and the counts of its `observed` tables.
        At the end, streams that have stopped are waited for until they have told all."""
        listener = _Streams(self)
        spark.streams.addListener(listener)
        try:
            yield
        finally:
            active = {str(q.runId) for q in spark.streams.active}
            until = time.monotonic() + PATIENCE
            while listener.open - active and time.monotonic() < until:
                time.sleep(0.05)
            spark.streams.removeListener(listener)


class _NO_JOB:  # noqa: N801
    stageIds = ()  # noqa: N815


class _Streams(StreamingQueryListener):
    def __init__(self, log: RunLog) -> None:
        self.log, self.open = log, set()

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        self.open.add(str(event.runId))

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        p = event.progress
        counts = lambda: {k: row.asDict() for k, row in p.observedMetrics.items()}
        self.log._quietly(lambda: self.log.add(p.name or str(p.id), "stream", rows=p.numInputRows, seconds=p.batchDuration / 1000, batch=p.batchId, metrics=self.log._quietly(counts)))

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        if event.exception:
            self.log.add(str(event.id), "stream", "failed", error=event.exception)
        self.open.discard(str(event.runId))
