"""Streams over the tables, played to their end; what they committed is read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.commits import Store
from ..sources.scratch import folder
from ..streaming import intake, queue
from .registry import query, table


def _as_stream(rows: DataFrame, name: str, files: int) -> DataFrame:
    """A table as a stream of micro-batches of one file each."""
    path = folder(rows.sparkSession, name)
    rows.repartition(files).write.parquet(path)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query(r"""WITH f AS (SELECT page_id, concat(CASE WHEN page_id % 7 = 0 THEN '%PNG' ELSE concat('%PDF-1.', page_id % 8, chr(10)) END, coalesce(html, ''), repeat('<< /Type /Page >> ', CAST(1 + page_id % 4 AS INTEGER)), CASE WHEN page_id % 9 = 0 THEN '/Encrypt 5 0 R' ELSE '' END, CASE WHEN page_id % 5 = 0 THEN '' ELSE '%%EOF' END) AS content FROM pages),
    v AS (SELECT *, CASE WHEN page_id % 11 = 0 THEN 'BAD_EXTENSION' WHEN page_id % 13 = 0 THEN 'BAD_MIME' WHEN page_id % 7 = 0 THEN 'BAD_MAGIC' WHEN page_id % 9 = 0 THEN 'ENCRYPTED' WHEN page_id % 5 = 0 THEN 'TRUNCATED' WHEN page_id % 4 = 3 THEN 'TOO_MANY_PAGES' ELSE 'ok' END AS verdict FROM f)
    SELECT concat('in/', page_id) AS path, verdict, CAST(octet_length(encode(content)) AS BIGINT) AS length, CASE WHEN verdict = 'ok' THEN sha256(content) END AS checksum, CASE WHEN verdict = 'ok' THEN CAST(1 + page_id % 4 AS INTEGER) END AS pages, CASE WHEN verdict = 'ok' THEN concat('1.', page_id % 8) END AS pdf_version,
    CASE WHEN verdict = 'ok' THEN 'audit,document,file,job,version' ELSE 'audit' END AS events FROM v""")
def admission_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as arriving files of at most three pages, judged in micro-batches; the stream is played twice and judges once."""
    k = F.col("page_id")
    head = F.when(k % 7 == 0, "%PNG").otherwise(F.concat(F.lit("%PDF-1."), (k % 8).cast("string"), F.lit("\n")))
    content = F.concat(head, F.coalesce("html", F.lit("")), F.repeat(F.lit("<< /Type /Page >> "), (1 + k % 4).cast("int")), F.when(k % 9 == 0, "/Encrypt 5 0 R").otherwise(""), F.when(k % 5 == 0, "").otherwise("%%EOF")).cast("binary")
    name = F.concat(k.cast("string"), F.when(k % 11 == 0, ".txt").otherwise(".PDF"))
    files = table(spark, sf_dir, "pages").select(F.concat(F.lit("in/"), k.cast("string")).alias("path"), name.alias("name"), F.when(k % 13 == 0, "text/plain").otherwise("Application/PDF; v=1").alias("declared_mime"), F.octet_length(content).cast("bigint").alias("length"), content.alias("content"))
    stream = _as_stream(files, "arrivals", 3)
    store = Store(spark, folder(spark, "intake-store"))
    sink = intake.Sink(store, lambda batch: intake.verdicts(batch, max_pages=3))
    for turn in range(2):
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", folder(spark, f"intake-{turn}")).trigger(availableNow=True).start().awaitTermination()
    said = store.read("events").groupBy(F.col("document_id").alias("path")).agg(F.array_join(F.array_sort(F.collect_list("entity")), ",").alias("events"))
    return store.read("verdicts").select("path", "verdict", "length", "checksum", "pages", "pdf_version").join(said, "path")


_KIND = "CASE (event_id * 7 + user_id) % 8 WHEN 0 THEN 'ENQUEUE' WHEN 1 THEN 'CLAIM' WHEN 2 THEN 'CLAIM' WHEN 3 THEN 'DONE' WHEN 4 THEN 'FAIL' ELSE 'BEAT' END"


@query(f"""WITH RECURSIVE e AS (SELECT user_id AS job, us, kind, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS n FROM (SELECT *, epoch_us(ts) // 200 AS us, {_KIND} AS kind FROM events)),
    f AS (SELECT DISTINCT job, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS s, 0 AS a, CAST(0 AS BIGINT) AS b, 0 AS recovered, 0 AS exhausted, 0 AS changes FROM e
        UNION ALL SELECT job, n, CASE WHEN kind = 'ENQUEUE' AND coalesce(s, '') NOT IN ('QUEUED', 'RUNNING') OR (kind = 'BEAT' AND s = 'QUEUED') THEN 'QUEUED' WHEN kind = 'CLAIM' AND s = 'QUEUED' THEN 'RUNNING' WHEN kind = 'DONE' AND s = 'RUNNING' THEN 'DONE' WHEN kind = 'FAIL' AND s = 'RUNNING' THEN 'FAILED' ELSE s END,
            CASE WHEN kind = 'ENQUEUE' AND coalesce(s, '') NOT IN ('QUEUED', 'RUNNING') THEN 0 WHEN kind = 'CLAIM' AND s = 'QUEUED' THEN a + 1 ELSE a END, CASE WHEN kind = 'CLAIM' AND s = 'QUEUED' OR kind = 'BEAT' AND s = 'RUNNING' THEN us ELSE b END, recovered, exhausted,
            changes + CASE WHEN kind = 'ENQUEUE' AND coalesce(s, '') NOT IN ('QUEUED', 'RUNNING') OR kind = 'CLAIM' AND s = 'QUEUED' OR kind IN ('DONE', 'FAIL') AND s = 'RUNNING' THEN 1 ELSE 0 END
        FROM (SELECT e.job, e.n, e.us, e.kind, b, a, CASE WHEN s = 'RUNNING' AND us - b > 300000000 THEN CASE WHEN a < 3 THEN 'QUEUED' ELSE 'FAILED' END ELSE s END AS s, recovered + CASE WHEN s = 'RUNNING' AND us - b > 300000000 AND a < 3 THEN 1 ELSE 0 END AS recovered,
            exhausted + CASE WHEN s = 'RUNNING' AND us - b > 300000000 AND a >= 3 THEN 1 ELSE 0 END AS exhausted, changes + CASE WHEN s = 'RUNNING' AND us - b > 300000000 THEN 1 ELSE 0 END AS changes FROM f JOIN e ON e.job = f.job AND e.n = f.n + 1)),
    l AS (SELECT DISTINCT ON (job) * FROM f ORDER BY job, n DESC)
    SELECT CAST(job AS VARCHAR) AS job, CASE WHEN s <> 'RUNNING' THEN s WHEN a < 3 THEN 'QUEUED' ELSE 'FAILED' END AS status, a AS attempts, CAST(changes + CASE WHEN s = 'RUNNING' THEN 1 ELSE 0 END AS BIGINT) AS n_changes,
        CAST(recovered + CASE WHEN s = 'RUNNING' AND a < 3 THEN 1 ELSE 0 END AS BIGINT) AS n_recovered, CAST(exhausted + CASE WHEN s = 'RUNNING' AND a >= 3 THEN 1 ELSE 0 END AS BIGINT) AS n_exhausted FROM l WHERE s IS NOT NULL""")
def job_queue_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a queue's log, two hundred times as fast; leases that run out without another event do so by their timers."""
    us = F.expr("unix_micros(CAST(ts AS TIMESTAMP)) div 200")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("job"), F.col("event_id").alias("id"), F.timestamp_micros(us).alias("ts"), F.expr(_KIND).alias("kind"))
    # The clock goes on for an hour after the last event.
    tick = rows.agg(F.lit("clock").alias("job"), F.lit(-1).cast("bigint").alias("id"), (F.max("ts") + F.expr("INTERVAL 1 HOUR")).alias("ts"), F.lit("TICK").alias("kind"))
    stream = _as_stream(rows.unionByName(tick), "queue-log", 1)
    store = Store(spark, folder(spark, "queue-store"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", queue.PROVIDER)
    try:
        write = lambda batch, number: store.commit(f"queue-{number}", {"changes": batch})
        queue.transitions(stream).writeStream.foreachBatch(write).option("checkpointLocation", folder(spark, "queue")).trigger(availableNow=True).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    last = F.max_by(F.struct("status", "attempts"), F.struct("at", F.col("reason").isin("RECOVERED", "EXHAUSTED").cast("int") * -1))
    found = store.read("changes").groupBy("job").agg(last.alias("l"), F.count("*").alias("n_changes"), F.count_if(F.col("reason") == "RECOVERED").alias("n_recovered"), F.count_if(F.col("reason") == "EXHAUSTED").alias("n_exhausted"))
    return found.select("job", "l.status", "l.attempts", "n_changes", "n_recovered", "n_exhausted")
