"""Queries on versions, reads, gates, queues and contacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import contact
from ..operators import checks, jobs, versions
from ..sources import extraction
from . import contact_sql
from .registry import query, table

NOW = "2024-01-15 12:00:00"


def _now() -> F.Column:
    return F.lit(NOW).cast("timestamp_ntz")


def _analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer are analyses of a document."""
    status = F.when(F.col("o_orderstatus") == "F", "APPROVED").when(F.col("o_orderstatus") == "P", "PARTIAL").otherwise("REVIEW_REQUIRED")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("document_id"), F.col("o_orderdate").alias("created_at"), status.alias("status"))


_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'APPROVED' WHEN 'P' THEN 'PARTIAL' ELSE 'REVIEW_REQUIRED' END"
_VERSIONS_SQL = f"""v AS (SELECT o_orderkey AS id, o_custkey AS document_id, CAST(row_number() OVER w AS INTEGER) AS version, lag(o_orderkey) OVER w AS supersedes, CASE WHEN lead(o_orderkey) OVER w IS NULL THEN {_STATUS} ELSE 'SUPERSEDED' END AS status
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"""


@query(f"WITH {_VERSIONS_SQL} SELECT * FROM v")
def version_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.numbered(_analyses(spark, sf_dir)).select("id", "document_id", "version", "supersedes", "status")


@query(f"WITH {_VERSIONS_SQL} SELECT document_id, CAST(max(version) + 1 AS INTEGER) AS next_version FROM v GROUP BY document_id")
def next_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.next_version(versions.numbered(_analyses(spark, sf_dir)))


@query(f"""SELECT c_custkey AS document_id, c_name AS title, l.id AS latest_id, l.status AS latest_status, f.id AS first_id FROM customer
    LEFT JOIN (SELECT o_custkey, o_orderkey AS id, {_STATUS} AS status FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) l ON l.o_custkey = c_custkey
    LEFT JOIN (SELECT o_custkey, o_orderkey AS id FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1) f ON f.o_custkey = c_custkey""")
def latest_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its latest and its first analysis."""
    a = _analyses(spark, sf_dir)
    last = versions.latest(a, "document_id", "created_at", "id").select("document_id", F.col("id").alias("latest_id"), F.col("status").alias("latest_status"))
    first = versions.earliest(a, "document_id", "created_at", "id").select("document_id", F.col("id").alias("first_id"))
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"), F.col("c_name").alias("title"))
    return docs.join(last, "document_id", "left").join(first, "document_id", "left")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    last = versions.latest(_analyses(spark, sf_dir), "document_id", "created_at", "id").select("document_id", F.col("id").alias("published_analysis_id"))
    key = F.col("c_custkey")
    docs = c.select(key.alias("document_id"), F.col("c_name").alias("title"), (key % 2 == 0).alias("published"), F.when(key % 4 == 2, "ARCHIVED").otherwise("PUBLISHED").alias("status"))
    return docs.join(last, "document_id", "left")


_DOCS_SQL = """d AS (SELECT c_custkey AS document_id, c_name AS title, c_custkey % 2 = 0 AS published, CASE WHEN c_custkey % 4 = 2 THEN 'ARCHIVED' ELSE 'PUBLISHED' END AS status,
    (SELECT arg_max(o_orderkey, (o_orderdate, o_orderkey)) FROM orders WHERE o_custkey = c_custkey) AS pid FROM customer)"""


@query(f"WITH {_VERSIONS_SQL}, {_DOCS_SQL} SELECT d.document_id, title, pid AS published_analysis_id, v.version AS published_version FROM d LEFT JOIN v ON v.id = pid WHERE published AND d.status = 'PUBLISHED'")
def published_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = versions.published_index(_documents(spark, sf_dir), versions.numbered(_analyses(spark, sf_dir)))
    return found.select("document_id", "title", "published_analysis_id", "published_version")


@query(f"""WITH {_VERSIONS_SQL}, {_DOCS_SQL}, m AS (SELECT l_orderkey, string_agg(concat(l_returnflag, CAST(l_linenumber AS VARCHAR)), ',' ORDER BY l_linenumber, l_returnflag) AS metrics FROM lineitem GROUP BY l_orderkey)
    SELECT d.document_id, pid AS published_analysis_id, v.version, metrics FROM d JOIN v ON v.id = pid LEFT JOIN m ON l_orderkey = pid WHERE published""")
def published_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published documents with their analysis and its metrics in order."""
    children = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("analysis_id"), F.col("l_linenumber").alias("ord"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("label"), F.col("l_quantity").alias("value"))
    found = versions.report(_documents(spark, sf_dir), versions.numbered(_analyses(spark, sf_dir)), children)
    return found.select("document_id", "published_analysis_id", "version", F.array_join(F.col("metrics.label"), ",").alias("metrics"))


@query("SELECT c_custkey AS document_id, c_name AS title FROM customer WHERE c_custkey % 2 = 0 AND c_mktsegment = 'BUILDING' ORDER BY c_custkey DESC LIMIT 1")
def file_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One published file by name."""
    rows = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0 and c_mktsegment = 'BUILDING'")
    return rows.orderBy(F.desc("c_custkey")).limit(1).select(F.col("c_custkey").alias("document_id"), F.col("c_name").alias("title"))


@query(f"""WITH a AS (SELECT o_orderkey AS id, o_orderkey % 10 AS k, {_STATUS} AS status, o_orderkey % 3 = 0 AS partial FROM orders),
    i AS (SELECT l_orderkey AS id, count(*) FILTER (l_linenumber = 7) AS b, count(*) FILTER (l_linenumber IN (2, 3) AND l_linenumber <> 1 + l_orderkey % 3) AS w FROM lineitem GROUP BY l_orderkey),
    r AS (SELECT a.id, concat_ws(',', CASE WHEN k = 1 THEN 'STALE_REVISION' END, CASE WHEN status <> 'APPROVED' THEN 'STATUS' END, CASE WHEN partial AND k <> 3 THEN 'PARTIAL_WITHOUT_OVERRIDE' END, CASE WHEN b > 0 THEN 'OPEN_BLOCKERS' END, CASE WHEN w > 0 THEN 'UNACKNOWLEDGED_WARNINGS' END) AS reasons FROM a LEFT JOIN i USING (id))
    SELECT id AS analysis_id, reasons, reasons = '' AS publishable FROM r""")
def publication_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as analyses, some lines as issues; one warning of each is acknowledged, another by an old fingerprint."""
    key = F.col("id")
    analyses = _analyses(spark, sf_dir).select(
        key.alias("analysis_id"), "status", F.lit(5).alias("current_revision"), F.when(key % 10 == 1, 4).otherwise(5).alias("requested_revision"), (key % 3 == 0).alias("is_partial"), (key % 10 == 3).alias("override_reviewed"), F.lit("seen").alias("override_justification"), F.lit("limited").alias("override_notice")
    )
    n = F.col("l_linenumber")
    lines = table(spark, sf_dir, "lineitem").where(n.isin(2, 3, 7)).select(F.col("l_orderkey").alias("analysis_id"), n.alias("n"), F.concat_ws(":", "l_orderkey", n).alias("issue_id"), F.when(n == 7, "BLOCKER").otherwise("WARNING").alias("severity"), F.concat(F.lit("f"), n.cast("string")).alias("fingerprint"))
    acked = lines.where((F.col("n") == 1 + F.col("analysis_id") % 3) | (F.col("n") == 7))
    acks = acked.select("issue_id", F.lit(1).alias("ord"), F.lit("old").alias("fingerprint")).unionByName(acked.select("issue_id", F.lit(2).alias("ord"), "fingerprint"))
    return checks.publication_gate(analyses, lines.drop("n"), acks)


@query("""WITH e AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
    m AS (SELECT CASE before WHEN 'view' THEN 'PROCESSING' WHEN 'click' THEN 'PARTIAL' WHEN 'signup' THEN 'REVIEW_REQUIRED' WHEN 'purchase' THEN 'APPROVED' ELSE 'FAILED' END AS a, CASE event_type WHEN 'view' THEN 'PROCESSING' WHEN 'click' THEN 'PARTIAL' WHEN 'signup' THEN 'REVIEW_REQUIRED' WHEN 'purchase' THEN 'APPROVED' ELSE 'FAILED' END AS b FROM e WHERE before IS NOT NULL)
    SELECT a AS from_status, b AS to_status, count(*) AS n FROM m WHERE concat(a, '>', b) NOT IN ('PROCESSING>REVIEW_REQUIRED', 'PROCESSING>PARTIAL', 'PROCESSING>FAILED', 'PARTIAL>REVIEW_REQUIRED', 'PARTIAL>FAILED', 'REVIEW_REQUIRED>APPROVED', 'REVIEW_REQUIRED>FAILED') GROUP BY a, b""")
def transition_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as status changes: those the edge table forbids, counted."""
    from pyspark.sql import Window

    name = lambda c: F.when(c == "view", "PROCESSING").when(c == "click", "PARTIAL").when(c == "signup", "REVIEW_REQUIRED").when(c == "purchase", "APPROVED").otherwise("FAILED")
    rows = table(spark, sf_dir, "events").withColumn("before", F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).where("before is not null")
    changes = rows.select(name(F.col("before")).alias("from_status"), name(F.col("event_type")).alias("to_status"))
    return checks.illegal_transitions(changes.groupBy("from_status", "to_status").agg(F.count("*").alias("n")))


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    status = F.when(k == 0, "QUEUED").when(k == 1, "DONE").when(k == 2, "RUNNING").otherwise("FAILED")
    beat = F.when(F.col("event_id") % 7 == 0, None).otherwise(F.col("ts"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("document_id"), status.alias("status"), (F.col("event_id") % 5).cast("int").alias("attempts"), beat.alias("heartbeat_at"), F.col("ts").alias("created_at"))


_JOBS_SQL = "j AS (SELECT event_id AS id, user_id AS document_id, CASE event_id % 4 WHEN 0 THEN 'QUEUED' WHEN 1 THEN 'DONE' WHEN 2 THEN 'RUNNING' ELSE 'FAILED' END AS status, CAST(event_id % 5 AS INTEGER) AS attempts, CASE WHEN event_id % 7 = 0 THEN NULL ELSE ts END AS heartbeat_at, ts AS created_at FROM events)"


@query(f"WITH {_JOBS_SQL} SELECT id, status, CASE WHEN status = 'RUNNING' AND heartbeat_at < TIMESTAMP '{NOW}' - INTERVAL 5 MINUTE THEN CASE WHEN attempts < 3 THEN 'QUEUED' ELSE 'FAILED' END ELSE status END AS new_status FROM j")
def job_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.recovered(_jobs(spark, sf_dir), _now()).select("id", "status", "new_status")


@query(f"WITH {_JOBS_SQL} SELECT id, 'RUNNING' AS status, attempts + 1 AS attempts FROM j WHERE status = 'QUEUED' ORDER BY created_at, id LIMIT 20")
def job_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.claimed(_jobs(spark, sf_dir), 20).select("id", "status", "attempts")


@query(f"WITH {_JOBS_SQL} SELECT count(*) FILTER (status = 'QUEUED') AS queued, count(*) FILTER (status = 'RUNNING') AS running, count(*) FILTER (status = 'FAILED') AS failed FROM j")
def queue_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.queue_depth(_jobs(spark, sf_dir))


@query(f"SELECT user_id AS instance_id, max(ts) AS last_heartbeat_at, max(ts) > TIMESTAMP '{NOW}' - INTERVAL 60 SECOND AS fresh FROM events WHERE ts <= TIMESTAMP '{NOW}' GROUP BY user_id")
def fleet_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    beats = table(spark, sf_dir, "events").where(F.col("ts") <= _now()).select(F.col("user_id").alias("instance_id"), "ts")
    return jobs.fleet(beats, _now())


@query(f"WITH {_JOBS_SQL} SELECT document_id, id AS job_id, CASE WHEN status IN ('QUEUED', 'RUNNING') THEN 'REFUSED' ELSE 'RESET' END AS decision FROM j QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, id DESC) = 1")
def requeue_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.requeue(_jobs(spark, sf_dir), "document_id")


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_type", F.col("event_id").alias("id"), "ts", "value", "props")


_ORDERED = "SELECT {keys}, event_id AS id, ts, row_number() OVER (PARTITION BY {keys} ORDER BY ts, event_id) AS n FROM events"
_RECENT = "len(list_filter(f.kept, lambda t: t > e.ts - INTERVAL 24 HOUR)) < 5"


@query(f"""WITH RECURSIVE e AS ({_ORDERED.format(keys='user_id')}),
    f AS (SELECT user_id, n, id, true AS accepted, [ts] AS kept FROM e WHERE n = 1
        UNION ALL SELECT e.user_id, e.n, e.id, {_RECENT}, CASE WHEN {_RECENT} THEN list_append(f.kept, e.ts) ELSE f.kept END FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
    SELECT user_id, id, accepted FROM f""")
def rate_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted and rejected messages per sender; tests hold the stream and a squeezed form against a plain loop."""
    return jobs.rate_limited(_messages(spark, sf_dir), "user_id", minutes=24 * 60)


@query(f"""WITH RECURSIVE e AS ({_ORDERED.format(keys='user_id, event_type')}),
    f AS (SELECT user_id, event_type, n, id, true AS accepted, ts AS last FROM e WHERE n = 1
        UNION ALL SELECT e.user_id, e.event_type, e.n, e.id, e.ts - f.last >= INTERVAL 24 HOUR, CASE WHEN e.ts - f.last >= INTERVAL 24 HOUR THEN e.ts ELSE f.last END FROM f JOIN e ON e.user_id = f.user_id AND e.event_type = f.event_type AND e.n = f.n + 1)
    SELECT user_id, event_type, id, accepted FROM f""")
def duplicates_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.duplicates(_messages(spark, sf_dir), ["user_id", "event_type"], 24 * 3600)


@query("SELECT user_id, count(*) AS n_messages, min(ts) AS first_at, max(ts) AS last_at, arg_max(event_id, (ts, event_id)) AS last_id FROM events GROUP BY user_id")
def customer_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.customers(_messages(spark, sf_dir), "user_id")


@query("""SELECT conv_id, turn AS ord, coalesce(string_agg(concat('<', conv_id, '.', turn, '>'), ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS references FROM conversations""".replace("AS references", 'AS "references"'))
def thread_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("ord"), F.concat(F.lit("<"), "conv_id", F.lit("."), "turn", F.lit(">")).alias("id"))
    return jobs.reference_chain(rows, "conv_id").select("conv_id", "ord", "references")


@query("""SELECT user_id, event_id AS id, CASE event_type WHEN 'view' THEN 'DRAFT' WHEN 'click' THEN 'PUBLISHED' WHEN 'purchase' THEN 'ARCHIVED' ELSE 'PROCESSING' END AS event FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 AND event_type <> 'error'""")
def document_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest state of each document of a log of transitions; deleted ones are gone."""
    kind = F.col("event_type")
    name = F.when(kind == "view", "DRAFT").when(kind == "click", "PUBLISHED").when(kind == "purchase", "ARCHIVED").when(kind == "error", "DELETED").otherwise("PROCESSING")
    return versions.current_state(_messages(spark, sf_dir).select("user_id", "id", name.alias("event")), "user_id", "id")


def _contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with names, addresses and numbers made from their keys, good and bad, and a conversation's first text."""
    key = F.col("c_custkey")
    pick = lambda *v: F.get(F.array(*map(F.lit, v)), (key % len(v)).cast("int"))
    said = table(spark, sf_dir, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.min(F.struct("turn", "text"))["text"].alias("said"))
    names = pick("Asha Rao", "aaaa", "abcdef", "qwerty", "José Núñez", "xkcd brtfgh", "Jo", "ababab", "Majd", "bcdfg")
    emails = F.concat(pick("jo", "test", "bcdfgh", "asd", "maria.lopez", "xyz1"), F.lit("@"), pick("firm.com", "mailinator.com", "qwe.com", "nodot", "uni.example.org"))
    phones = pick("9876501234", "1234567890", "+1111111111", "12345678", "+49 (30) 1234-5670", "919876501234", "12121212", "98765432109", "5")
    rows = table(spark, sf_dir, "customer").select(key.alias("id"), names.alias("name"), emails.alias("email"), phones.alias("phone"))
    message = F.when(F.col("id") % 3 == 0, "hello").when(F.col("id") % 3 == 1, "We would like to see the report about your company please").otherwise(F.coalesce("said", F.lit("")))
    return rows.join(said, F.col("id") == F.col("conv_id"), "left").withColumn("message", message).select("id", "name", "email", "phone", "message")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = {"name": contact.score_name, "email": contact.score_email, "phone": contact.score_phone, "message": contact.score_message}
    rows = _contacts(spark, sf_dir)
    rows = rows.withColumns({f"{k}_raw": f(F.col(k)) for k, f in raw.items()})
    final = contact.distrust({k: F.col(f"{k}_raw") for k in raw})
    return rows.withColumns({f"{k}_check": c for k, c in final.items()})


@query(contact_sql.SCORES)
def contact_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and reason of four fields."""
    fields = ("name", "email", "phone", "message")
    rows = _scored(spark, sf_dir)
    mean = sum((F.col(f"{k}_check.score") for k in fields), F.lit(0.0)) / 4
    return rows.select("id", *(F.col(f"{k}_check.{p}").alias(f"{k}_{p}") for k in fields for p in ("score", "reason")), F.round(mean, 4).alias("validation_score"))


@query(contact_sql.LOG)
def validation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.failing_fields(_scored(spark, sf_dir), "id", ["name", "email", "phone", "message"])


@query("""WITH l AS (SELECT l_orderkey AS id, count(*) FILTER (l_returnflag = 'R') AS s, count(*) FILTER (l_linestatus = 'O') AS m FROM lineitem GROUP BY l_orderkey)
    SELECT id, CAST(greatest(10, least(100, 100 - 10 * s - 5 * m)) AS DOUBLE) / 100 AS confidence FROM l""")
def legacy_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count_if(F.col("l_returnflag") == "R").alias("s"), F.count_if(F.col("l_linestatus") == "O").alias("m"))
    return rows.select("id", checks.legacy_confidence(F.col("s"), F.col("m")).alias("confidence"))


@query("""SELECT event_id, concat_ws(',', CAST(0 AS VARCHAR), CAST(event_id AS VARCHAR)) AS numbers, CAST(event_id % 2 = 0 AS BOOLEAN) AS flag FROM events""")
def legacy_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first contract's coercions: unreadable numbers are 0, flags are the text true."""
    key = F.col("event_id")
    numbers = extraction.legacy_numbers("array('n/a', CAST(event_id AS STRING))")
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.transform(numbers, lambda v: v.cast("bigint").cast("string")), ",").alias("numbers"), extraction.soft_bool(F.when(key % 2 == 0, "true").otherwise("True")).alias("flag"))
