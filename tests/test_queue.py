"""The queue's stream against a plain fold of the same log and against the batch form of recovery."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from factweave.operators import jobs
from factweave.streaming import queue

T0 = dt.datetime(2024, 5, 1, tzinfo=dt.timezone.utc)
LEASE = dt.timedelta(minutes=jobs.STALE_MINUTES)


def log(seed, n=160):
    r = random.Random(seed)
    at, out = T0, []
    for i in range(n):
        at += dt.timedelta(seconds=r.choice([1, 20, 90, 200]))
        out.append((f"j{r.randrange(7)}", i, at, r.choice(["ENQUEUE", "ENQUEUE", "CLAIM", "CLAIM", "CLAIM", "BEAT", "BEAT", "BEAT", "BEAT", "DONE", "FAIL"])))
    return out


def fold(rows):
    """Changes of each job in order, leases run out only when the next event shows it; and the jobs as they are left."""
    state, out = {}, []
    for job, _, at, kind in rows:
        s, a, b = state.get(job, (None, 0, None))
        if s == "RUNNING" and at - b > LEASE:
            s = "QUEUED" if a < jobs.MAX_ATTEMPTS else "FAILED"
            out.append((job, s, a, "RECOVERED" if s == "QUEUED" else "EXHAUSTED"))
        before = s
        if kind == "ENQUEUE" and s in (None, "DONE", "FAILED"):
            s, a = "QUEUED", 0
        elif kind == "CLAIM" and s == "QUEUED":
            s, a, b = "RUNNING", a + 1, at
        elif kind == "BEAT" and s == "RUNNING":
            b = at
        elif kind in ("DONE", "FAIL") and s == "RUNNING":
            s = "DONE" if kind == "DONE" else "FAILED"
        if s != before:
            out.append((job, s, a, kind))
        state[job] = (s, a, b)
    return out, {j: v for j, v in state.items() if v[0]}


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", queue.PROVIDER)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


@pytest.mark.parametrize("files", [1, 4])
def test_queue_against_a_fold_and_batch_recovery(spark, tmp_path, rocks, files):
    rows = log(files)
    now = rows[-1][2] + dt.timedelta(minutes=30)
    size = -(-len(rows) // files)
    parts = [rows[i : i + size] for i in range(0, len(rows), size)]
    parts[-1] = parts[-1] + [("clock", -1, now, "TICK")]
    schema = "job string, id bigint, ts timestamp, kind string"
    for i, part in enumerate(parts):
        where = f"{tmp_path}/log/{i}"
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(where)
        for name in os.listdir(where):
            os.utime(f"{where}/{name}", (1_700_000_000 + i * 100,) * 2)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/log")
    got = []
    q = queue.transitions(stream).writeStream.foreachBatch(lambda batch, _: got.extend(batch.collect())).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    changes, left = fold(rows)
    held = spark.createDataFrame([(j, s, a, b) for j, (s, a, b) in left.items()], "id string, status string, attempts int, heartbeat_at timestamp")
    want = {r.id: r.new_status for r in jobs.recovered(held, F.lit(now).cast("timestamp")).collect()}
    late = [(j, want[j], left[j][1], "RECOVERED" if want[j] == "QUEUED" else "EXHAUSTED") for j in want if left[j][0] == "RUNNING" and want[j] != "RUNNING"]
    assert late and sorted((r.job, r.status, r.attempts, r.reason) for r in got) == sorted(changes + late)
    by = {}
    for r in sorted(got, key=lambda r: (r.at, r.reason not in ("RECOVERED", "EXHAUSTED"))):
        by[r.job] = r.status
    assert by == want


def test_steps_of_one_job():
    us = 1_000_000
    job = queue.applied(None, "BEAT", 0)
    assert job is None and queue.applied(None, "CLAIM", 0) is None
    job = queue.applied(None, "ENQUEUE", us)
    for n in range(1, jobs.MAX_ATTEMPTS + 1):
        job = queue.applied(job, "CLAIM", n * us)
        assert job == ("RUNNING", n, n * us) and queue.applied(job, "ENQUEUE", 9) is job
        edge = n * us + queue.LEASE_MS * 1000
        assert not queue.expired(job, edge) and queue.expired(job, edge + 1)
        job, why = queue.released(job)
        assert why == ("RECOVERED" if n < jobs.MAX_ATTEMPTS else "EXHAUSTED")
    assert job[0] == "FAILED" and queue.applied(job, "CLAIM", 0) is job and queue.applied(job, "ENQUEUE", 5) == ("QUEUED", 0, 5)
