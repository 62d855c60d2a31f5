"""Structured Streaming forms of rate limit, duplicate suppression and fleet state.

They give what the batch forms of ``operators.jobs`` give for events that arrive in time order. State is a key's
last accepted times, no more, and goes once the key has been silent for the span.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.jobs import DUPLICATE_SECONDS, RATE_MAX, RATE_MINUTES

OUT = "key string, id long, ts timestamp, accepted boolean"


def _accept_latest(events: DataFrame, most: int, span: pd.Timedelta, delay: str) -> DataFrame:
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["ts", "id"])
        ok = []
        for ts in rows["ts"]:
            us = ts.value // 1000
            low = us - span.value // 1000
            near = sum(t > low for t in kept)
            ok.append(near < most)
            if ok[-1]:
                kept = [*kept, us][-most:]
        state.update((kept,))
        if kept:
            state.setTimeoutTimestamp(max(kept[-1] // 1000 + int(span.total_seconds() * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": key[0], "id": rows["id"].to_numpy(), "ts": rows["ts"].to_numpy(), "accepted": ok})

    marked = events.select(F.col("key").cast("string").alias("key"), F.col("id").cast("long").alias("id"), F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", delay)
    return marked.groupBy("key").applyInPandasWithState(run, OUT, "kept array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def rate_limit_stream(events: DataFrame, most: int = RATE_MAX, minutes: int = RATE_MINUTES, delay: str = "10 minutes") -> DataFrame:
    """(key, id, ts, accepted): fewer than ``most`` accepted events of the key in the minutes before."""
    return _accept_latest(events, most, pd.Timedelta(minutes=minutes), delay)


def suppress_duplicates_stream(events: DataFrame, seconds: int = DUPLICATE_SECONDS, delay: str = "10 minutes") -> DataFrame:
    """(key, id, ts, accepted): no accepted event of the key less than ``seconds`` before."""
    return _accept_latest(events, 1, pd.Timedelta(seconds=seconds), delay)


def last_seen_stream(heartbeats: DataFrame) -> DataFrame:
    """Latest heartbeat per worker, for update mode."""
    return heartbeats.groupBy("instance_id").agg(F.max("ts").alias("last_heartbeat_at"))
