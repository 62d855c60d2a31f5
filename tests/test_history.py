"""Histories, up-times, cascades and upserts against plain loops."""

import datetime as dt
import os
import random

from pyspark.sql import functions as F

from factweave.operators import history, upserts
from factweave.sources.commits import Store

T0 = dt.datetime(2024, 5, 1)
AT = lambda s: T0 + dt.timedelta(seconds=s)


def test_state_at_any_time(spark):
    r = random.Random(5)
    log = [(d, i, AT(r.randrange(60)), r.choice(["DRAFT", "PROCESSING", "PUBLISHED", "ARCHIVED"])) for d in (1, 2) for i in range(25)]
    probes = [(d, i, AT(i - 3)) for d in (1, 2, 3) for i in range(70)]
    changes = spark.createDataFrame(log, "k int, id bigint, ts timestamp, state string")
    found = history.intervals(changes, "k")
    got = {(x.k, x.probe_id): x.state for x in history.as_of(found, spark.createDataFrame(probes, "k int, probe_id int, at timestamp"), "k").collect()}
    want = {}
    for d, i, at in probes:
        past = sorted((ts, n, s) for k, n, ts, s in log if k == d and ts <= at)
        want[d, i] = past[-1][2] if past else None
    assert got == want
    rows = found.orderBy("k", "valid_from", "id").collect()
    for a, b in zip(rows, rows[1:]):
        assert (a.valid_to == b.valid_from and b.before == a.state != b.state) if a.k == b.k else (a.valid_to is None and b.before is None)
    assert all(x.allowed == (x.state in history.ALLOWED[x.before]) for x in rows)
    illegal = [x for x in history.audit(found, "k").collect() if x.event == "ILLEGAL_CHANGE"]
    assert len(illegal) == sum(not x.allowed for x in rows) > 0


def test_uptimes_as_a_stream(spark, tmp_path):
    schema = "instance_id string, ts timestamp"
    parts = [[("a", AT(0)), ("a", AT(30)), ("b", AT(10)), ("a", AT(90))], [("a", AT(4000)), ("b", AT(69)), ("a", AT(4049))], [("c", AT(5000))], [("a", AT(5)), ("c", AT(5010))], [("z", AT(9000))]]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/{i}")
        for name in os.listdir(f"{tmp_path}/{i}"):
            os.utime(f"{tmp_path}/{i}/{name}", (1_700_000_000 + i * 100,) * 2)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path)).withWatermark("ts", "350 seconds")
    got = []
    history.uptimes(stream, 60).writeStream.foreachBatch(lambda b, _: got.extend(b.collect())).trigger(availableNow=True).start().awaitTermination()
    # The beat at 5 s comes long after the watermark has passed it and is dropped; the stretch at 9000 s is still open.
    kept = [x for p in parts for x in p if x != ("a", AT(5))]
    batch = history.uptimes(spark.createDataFrame(kept, schema), 60).where("instance_id != 'z'").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch))
    assert {(x.instance_id, x.up_from, x.last_beat, x.n_beats) for x in batch} == {("a", AT(0), AT(90), 3), ("a", AT(4000), AT(4049), 2), ("b", AT(10), AT(69), 2), ("c", AT(5000), AT(5010), 2)}


def test_cascade_round_cycles(spark):
    links = [("a", 1, "b", 1, "CASCADE"), ("b", 1, "c", 1, "CASCADE"), ("c", 1, "d", 1, "CASCADE"), ("d", 1, "e", 1, "CASCADE"), ("e", 1, "a", 1, "CASCADE"), ("a", 1, "d", 1, "CASCADE"), ("d", 1, "f", 1, "SET_NULL"), ("b", 1, "f", 2, "SET_NULL"), ("c", 1, "f", 2, "CASCADE"), ("x", 9, "y", 9, "CASCADE"), ("a", None, "g", 1, "CASCADE"), ("b", 1, "c", 1, "CASCADE")]
    rows = spark.createDataFrame(links, "parent string, parent_id bigint, child string, child_id bigint, rule string")
    gone = spark.createDataFrame([("a", 1), ("a", 1), ("h", 5)], "entity string, id bigint")
    got = {(r.entity, r.id): (r.effect, r.depth) for r in history.cascade(gone, rows).collect()}
    assert got == {("a", 1): ("DELETED", 0), ("h", 5): ("DELETED", 0), ("b", 1): ("DELETED", 1), ("d", 1): ("DELETED", 1), ("c", 1): ("DELETED", 2), ("e", 1): ("DELETED", 2), ("f", 2): ("DELETED", 3), ("f", 1): ("CLEARED", 2)}
    assert history.cascade(gone.limit(0), rows).count() == 0
    there = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", 1), ("e", 1)], "entity string, id bigint")
    assert [(r.parent, r.parent_id) for r in history.dangling(there, rows).collect()] == [("x", 9)]


def test_upserts_write_only_changed_buckets(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    schema = "k bigint, at int, v string"
    rows = lambda *r: spark.createDataFrame(r, schema)
    first = upserts.upsert(store, "one", "t", rows(*((k, 1, f"a{k}") for k in range(200))), ["k"], "at", 16)
    assert len(first) == 16
    second = upserts.upsert(store, "two", "t", rows((3, 2, "new"), (4, 0, "old"), (900, 5, "added")), ["k"], "at", 16)
    wanted = {r[0] for r in spark.createDataFrame([(3,), (4,), (900,)], "k bigint").select(F.pmod(F.xxhash64("k"), F.lit(16))).collect()}
    assert set(second) == wanted and len(second) < 4
    assert upserts.upsert(store, "two", "t", rows((3, 9, "again")), ["k"], "at", 16) == []
    got = {r.k: r.v for r in upserts.read(store, "t", schema, 16).collect()}
    assert got == {k: f"a{k}" for k in range(200)} | {3: "new", 900: "added"}
    assert upserts.read(store, "t", schema, 16).count() == 201 and upserts.read(store, "t", schema, 16, version=1).count() == 200
    assert store.vacuum() == 0 and upserts.read(store, "t", schema, 16).count() == 201
