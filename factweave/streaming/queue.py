"""The job queue as keyed state with timers.

Events (job, id, ts, kind) of kinds ENQUEUE, CLAIM, BEAT, DONE, FAIL and TICK (time passes, nothing else) change one job's
state: status, attempts and last heartbeat. A running job sets a timer for the moment its lease runs out; when it fires without a
later heartbeat, the job is queued again, or fails after too many attempts, without any new event. An event that comes after that
moment but before the timer fired finds the lease run out too, so results don't depend on how events fall into micro-batches.
Ended jobs are forgotten ``KEEP`` after their last event. State is one small row for each job; a batch's rows of a job are folded in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.jobs import MAX_ATTEMPTS, STALE_MINUTES

LEASE_MS, KEEP_MS = STALE_MINUTES * 60_000, 24 * 3_600_000
STATE = "status string, attempts int, beat_us long"
OUT = "job string, at timestamp, status string, attempts int, reason string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

Job = tuple[str, int, int]


def expired(job: Job, now_us: int) -> bool:
    return job[0] == "RUNNING" and now_us - job[2] > LEASE_MS * 1000


def released(job: Job) -> tuple[Job, str]:
    """A job whose lease ran out, and why it changed."""
    if job[1] < MAX_ATTEMPTS:
        return ("QUEUED", job[1], job[2]), "RECOVERED"
    return ("FAILED", job[1], job[2]), "EXHAUSTED"


def applied(job: Job | None, kind: str, us: int) -> Job | None:
    """A job after an event; what is not allowed changes nothing."""
    status = job[0] if job else None
    if kind == "ENQUEUE" and status not in ("QUEUED", "RUNNING"):
        return ("QUEUED", 0, us)
    if kind == "CLAIM" and status == "QUEUED":
        return ("RUNNING", job[1] + 1, us)
    if kind == "BEAT" and status == "RUNNING":
        return ("RUNNING", job[1], max(us, job[2]))
    if kind in ("DONE", "FAIL") and status == "RUNNING":
        return ("DONE" if kind == "DONE" else "FAILED", job[1], us)
    return job


def _micros(ts: pd.Series) -> list[int]:
    return (ts.to_numpy().astype("datetime64[us]").astype("int64")).tolist()


class Queue(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._job = handle.getValueState("job", STATE)

    def _wait(self, job: Job | None, known: bool) -> None:
        """One timer: when the lease runs out, or when an ended job may be forgotten. A job that had no state has no timer either."""
        for t in list(self._handle.listTimers()) if known else ():
            self._handle.deleteTimer(t)
        if job and job[0] == "RUNNING":
            self._handle.registerTimer(job[2] // 1000 + LEASE_MS + 1)
        elif job and job[0] in ("DONE", "FAILED"):
            self._handle.registerTimer(job[2] // 1000 + KEEP_MS)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        had = self._job.get()
        job: Job | None = tuple(had) if had else None
        out = []
        # Most jobs have few rows, so they are plain values: frames would cost more than all else.
        every = sorted(row for part in rows for row in zip(_micros(part["ts"]), part["id"].tolist(), part["kind"].tolist(), strict=True))
        for us, _, kind in every:
            if job and expired(job, us):
                job, why = released(job)
                out.append((key[0], pd.Timestamp(job[2] + LEASE_MS * 1000 + 1000, unit="us"), job[0], job[1], why))
            after = applied(job, kind, us)
            if after is not job and (job is None or after[:2] != job[:2]):
                out.append((key[0], pd.Timestamp(us, unit="us"), after[0], after[1], kind))
            job = after
        if job:
            self._job.update(job)
        self._wait(job, had is not None)
        if out:
            yield pd.DataFrame(out, columns=["job", "at", "status", "attempts", "reason"]).astype({"at": "datetime64[us]"})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        job: Job | None = tuple(self._job.get()) if self._job.exists() else None
        out = []
        if job and job[0] == "RUNNING":
            if expired(job, expiredTimerInfo.getExpiryTimeInMs() * 1000):
                job, why = released(job)
                out.append((key[0], pd.Timestamp(job[2] + LEASE_MS * 1000 + 1000, unit="us"), job[0], job[1], why))
                self._job.update(job)
                if job[0] == "FAILED":
                    self._handle.registerTimer(job[2] // 1000 + KEEP_MS)
        elif job and job[0] in ("DONE", "FAILED"):
            self._job.clear()
        yield pd.DataFrame(out, columns=["job", "at", "status", "attempts", "reason"]).astype({"at": "datetime64[us]"})

    def close(self) -> None:
        pass


def transitions(events: DataFrame, delay: str = "1 minute") -> DataFrame:
    """(job, at, status, attempts, reason) of every change, for a stream of (job, id, ts, kind); for append mode.

    The session must keep state in RocksDB (``PROVIDER``). Events later than ``delay`` are dropped by the watermark.
    """
    rows = events.select(F.col("job").cast("string").alias("job"), F.col("id").cast("long").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "kind").withWatermark("ts", delay)
    return rows.groupBy("job").transformWithStateInPandas(Queue(), OUT, "Append", "EventTime")
