"""Queues, heartbeats, rate limits and contact roll-ups, in batch. ``now`` is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Limits of the queue and of the contact form.
STALE_MINUTES, MAX_ATTEMPTS, FRESH_SECONDS = 5, 3, 60
RATE_MAX, RATE_MINUTES, DUPLICATE_SECONDS = 5, 10, 60


def recovered(jobs: DataFrame, now: Column, minutes: int = STALE_MINUTES, attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Running jobs without a recent heartbeat go back to the queue, or fail after too many attempts."""
    stale = (F.col("status") == "RUNNING") & (F.col("heartbeat_at") < now - F.make_dt_interval(mins=F.lit(minutes)))
    stale = F.coalesce(stale, F.lit(False))
    return jobs.withColumn("new_status", F.when(stale & (F.col("attempts") < attempts), "QUEUED").when(stale, "FAILED").otherwise(F.col("status")))


def failed(jobs: DataFrame, failures: DataFrame, now: Column) -> DataFrame:
    """``jobs`` with those in ``failures`` (id, error) failed at ``now``."""
    rows = jobs.join(failures.select("id", F.col("error").alias("_e"), F.lit(True).alias("_f")), "id", "left")
    kept = [c for c in jobs.columns if c not in ("status", "error", "finished_at")]
    old = lambda c, kind: F.col(c) if c in jobs.columns else F.lit(None).cast(kind)
    return rows.select(*kept, F.when(F.col("_f"), "FAILED").otherwise(F.col("status")).alias("status"), F.when(F.col("_f"), F.col("_e")).otherwise(old("error", "string")).alias("error"), F.when(F.col("_f"), now).otherwise(old("finished_at", "timestamp")).alias("finished_at"))


def released(documents: DataFrame, jobs: DataFrame, failures: DataFrame) -> DataFrame:
    """``documents`` (id, status) whose job failed go from PROCESSING to DRAFT; other states stay."""
    hit = jobs.join(failures, "id", "left_semi").select(F.col("document_id").alias("id"), F.lit(True).alias("_f")).distinct()
    back = F.col("_f") & (F.col("status") == "PROCESSING")
    return documents.join(hit, "id", "left").withColumn("status", F.when(back, "DRAFT").otherwise(F.col("status"))).drop("_f")


def claimed(jobs: DataFrame, workers: int) -> DataFrame:
    """The oldest queued jobs, one to a worker, as running with one attempt more."""
    return jobs.where("status = 'QUEUED'").orderBy("created_at", "id").limit(workers).withColumn("status", F.lit("RUNNING")).withColumn("attempts", F.col("attempts") + 1)


def queue_depth(jobs: DataFrame) -> DataFrame:
    return jobs.agg(*(F.count_if(F.col("status") == s).alias(s.lower()) for s in ("QUEUED", "RUNNING", "FAILED")))


def fleet(heartbeats: DataFrame, now: Column, seconds: int = FRESH_SECONDS) -> DataFrame:
    """Last heartbeat of each worker, and whether it is fresh."""
    last = heartbeats.groupBy("instance_id").agg(F.max("ts").alias("last_heartbeat_at"))
    return last.withColumn("fresh", F.col("last_heartbeat_at") > now - F.make_dt_interval(secs=F.lit(seconds)))


def requeue(jobs: DataFrame, key: str) -> DataFrame:
    """Per document: refused while its latest job waits or runs, else that job is to be reset."""
    last = jobs.groupBy(key).agg(F.max(F.struct("created_at", "id", "status")).alias("j"))
    busy = F.col("j.status").isin("QUEUED", "RUNNING")
    return last.select(key, F.col("j.id").alias("job_id"), F.when(busy, "REFUSED").otherwise("RESET").alias("decision"))


def rate_limited(messages: DataFrame, key: str, most: int = RATE_MAX, minutes: int = RATE_MINUTES) -> DataFrame:
    """Add ``accepted``: fewer than ``most`` accepted messages of the key lie in the minutes before.

    Rejected ones don't count, so the rule folds over the key's messages in order. The state is the last
    ``most`` accepted times alone. Messages are first cut where a key pauses for the whole span, for nothing
    before such a pause matters; a fold is one burst, not a key's whole history.
    """
    span = minutes * 60_000_000
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy(key).orderBy("us", "id")
    rows = messages.select(key, "id", us.alias("us")).withColumn("_new", F.coalesce(F.col("us") - F.lag("us").over(w) >= span, F.lit(True)).cast("int"))
    rows = rows.withColumn("burst", F.sum("_new").over(w))
    bursts = rows.groupBy(key, "burst").agg(F.array_sort(F.collect_list(F.struct("us", "id"))).alias("rows"))
    zero = F.struct(F.array().cast("array<bigint>").alias("kept"), F.array().cast("array<struct<id:bigint,accepted:boolean>>").alias("out"))

    def step(acc: Column, r: Column) -> Column:
        ok = F.size(F.filter(acc["kept"], lambda t: t > r["us"] - span)) < most
        kept = F.concat(acc["kept"], F.array(r["us"]))
        return F.struct(F.when(ok, F.slice(kept, -F.least(F.size(kept), F.lit(most)), F.lit(most))).otherwise(acc["kept"]).alias("kept"), F.concat(acc["out"], F.array(F.struct(r["id"].alias("id"), ok.alias("accepted")))).alias("out"))

    return bursts.select(key, F.explode(F.aggregate("rows", zero, step, lambda a: a["out"])).alias("r")).select(key, "r.id", "r.accepted")


def duplicates(messages: DataFrame, keys: list[str], seconds: int = DUPLICATE_SECONDS) -> DataFrame:
    """Add ``accepted``: no accepted message with the same keys lies less than ``seconds`` before.

    A suppressed message doesn't extend the span; the fold carries the last accepted time.
    """
    span = seconds * 1_000_000
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy(*keys).orderBy("us", "id")
    rows = messages.select(*keys, "id", us.alias("us")).withColumn("_new", F.coalesce(F.col("us") - F.lag("us").over(w) >= span, F.lit(True)).cast("int"))
    rows = rows.withColumn("burst", F.sum("_new").over(w))
    bursts = rows.groupBy(*keys, "burst").agg(F.array_sort(F.collect_list(F.struct("us", "id"))).alias("rows"))
    zero = F.struct(F.lit(None).cast("bigint").alias("last"), F.array().cast("array<struct<id:bigint,accepted:boolean>>").alias("out"))

    def step(acc: Column, r: Column) -> Column:
        ok = F.coalesce(r["us"] - acc["last"] >= span, F.lit(True))
        return F.struct(F.when(ok, r["us"]).otherwise(acc["last"]).alias("last"), F.concat(acc["out"], F.array(F.struct(r["id"].alias("id"), ok.alias("accepted")))).alias("out"))

    return bursts.select(*keys, F.explode(F.aggregate("rows", zero, step, lambda a: a["out"])).alias("r")).select(*keys, "r.id", "r.accepted")


def customers(messages: DataFrame, key: str) -> DataFrame:
    """Count, first and last message of each sender."""
    return messages.groupBy(key).agg(F.count("*").alias("n_messages"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.max(F.struct("ts", "id"))["id"].alias("last_id"))


def reference_chain(messages: DataFrame, key: str) -> DataFrame:
    """Ids of the messages before, in order, joined by spaces, as a thread's header has them."""
    w = Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return messages.withColumn("references", F.array_join(F.collect_list("id").over(w), " "))


def failing_fields(scores: DataFrame, key: str, fields: list[str], limit: int = 512) -> DataFrame:
    """A row per failing field of (key, <field>, <field>_check)."""
    rows = F.array(*(F.struct(F.lit(f).alias("field"), F.left(F.col(f), F.lit(limit)).alias("value"), F.col(f"{f}_check.score").alias("score"), F.col(f"{f}_check.reason").alias("reason")) for f in fields))
    return scores.select(key, F.explode(F.filter(rows, lambda r: r["score"] < 0.5)).alias("r")).select(key, "r.*")


def newest_heartbeats(heartbeats: DataFrame, most: int = 20) -> DataFrame:
    return heartbeats.orderBy(F.desc("last_heartbeat_at"), "instance_id").limit(most)


def fleet_status(workers: DataFrame) -> DataFrame:
    """One row: active if any worker is fresh."""
    return workers.agg(F.count("*").alias("n_workers"), F.count_if("fresh").alias("n_fresh"), F.when(F.bool_or("fresh"), "active").otherwise("inactive").alias("status"))


def without_instance(workers: DataFrame, gone: DataFrame) -> DataFrame:
    """Workers but those that have signed off."""
    return workers.join(gone.select("instance_id").distinct(), "instance_id", "left_anti")


def token_valid(expires: Column, now: Column) -> Column:
    """A reset token counts until it expires; a missing one doesn't."""
    return F.coalesce(expires > now, F.lit(False))
