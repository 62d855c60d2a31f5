"""Analyses of both contracts, committed table by table as one version, replayed and read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import persist, upserts
from ..sources.commits import Store
from ..sources.scratch import folder
from .registry import query, spread, table
from .reports import AS_OF_YEAR, LINES_SQL, report_inputs


def first_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, job_id and payload of each order: its lines are metrics and sections."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.concat(F.lit('{"name":"'), "l_returnflag", F.lit('","value":"Rs '), F.col("l_extendedprice").cast("string"), F.lit(' Cr","sourceExcerpt":"'), F.when(F.col("l_linestatus") == "O", "").otherwise("as printed"), F.lit('"}')).alias("m"), F.concat(F.lit('{"title":"'), "l_linestatus", F.lit('","summary":"s","evidence":'), F.when(F.col("l_returnflag") == "R", "null").otherwise('"e"'), F.lit("}")).alias("s"))
    lines = spread(table(spark, sf_dir, "lineitem"), "l_orderkey").select("l_orderkey", line.alias("line"))  # compiled here; inside the aggregate it would be interpreted
    rows = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("line")).alias("r"))
    joined = lambda f: F.coalesce(F.array_join(F.transform("r", lambda x: x[f]), ","), F.lit(""))
    said = F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit('"Co '), F.col("o_custkey").cast("string"), F.lit('"'))).otherwise("null")
    payload = F.concat(F.lit('{"title":"'), "o_orderpriority", F.lit('","company":'), said, F.lit(',"recommendation":"'), "o_orderstatus", F.lit('","metrics":['), joined("m"), F.lit('],"sections":['), joined("s"), F.lit('],"charts":[{"type":"line","title":"t","labels":["'), "o_orderstatus", F.lit('"],"series":[]},7]}'))
    k = F.col("o_orderkey")
    return spread(table(spark, sf_dir, "orders"), "o_orderkey").join(rows, k == F.col("l_orderkey"), "left").select(k.alias("doc_id"), k.alias("job_id"), F.when(k % 17 == 0, "sorry").otherwise(payload).alias("payload"))


@query("""WITH l AS (SELECT l_orderkey AS k, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(20, 2))) AS DOUBLE) AS total, count(*) FILTER (l_linestatus = 'O') AS m, count(*) FILTER (l_returnflag = 'R') AS s FROM lineitem GROUP BY l_orderkey)
    SELECT o_orderkey AS doc_id, o_orderkey % 17 <> 0 AS analysed, CASE WHEN o_orderkey % 17 <> 0 THEN CAST(CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS INTEGER) END AS version, CASE WHEN o_orderkey % 17 <> 0 AND o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS n_superseded,
    CASE WHEN o_orderkey % 17 <> 0 THEN 'REVIEW_REQUIRED' END AS status, CASE WHEN o_orderkey % 17 <> 0 THEN concat_ws(chr(10), concat('Title: ', o_orderpriority), CASE WHEN o_custkey % 2 = 0 THEN concat('Target: Co ', o_custkey) END, concat('Recommendation: ', o_orderstatus)) END AS summary,
    CASE WHEN o_orderkey % 17 <> 0 THEN CAST(greatest(10, 100 - 10 * coalesce(s, 0) - 5 * coalesce(m, 0)) AS DOUBLE) / 100 END AS confidence, CASE WHEN o_orderkey % 17 <> 0 THEN coalesce(n, 0) ELSE 0 END AS n_metrics, CASE WHEN o_orderkey % 17 <> 0 THEN coalesce(n, 0) ELSE 0 END AS n_sections,
    CASE WHEN o_orderkey % 17 <> 0 THEN total END AS total, CASE WHEN o_orderkey % 17 <> 0 THEN concat('{"labels":["', o_orderstatus, '"],"series":[]}') END AS chart, CASE WHEN o_orderkey % 17 <> 0 THEN 'DONE' ELSE 'FAILED' END AS job, 'RELEASED' AS document FROM orders LEFT JOIN l ON o_orderkey = k""")
def first_contract_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents analysed, a third of them again, and the first batch replayed without effect: what the tables then hold of each."""
    store = Store(spark, folder(spark, "first-contract-store"))
    rows = first_payloads(spark, sf_dir)
    persist.first_contract(store, "run-1", rows, "model")
    persist.first_contract(store, "run-2", rows.where("doc_id % 3 = 0"), "model")
    persist.first_contract(store, "run-1", rows, "model")
    found = persist.current(store).withColumn("n_superseded", F.count_if(F.col("status") == "SUPERSEDED").over(Window.partitionBy("doc_id")).cast("int"))
    now = found.where("status != 'SUPERSEDED'").select("analysis_id", "doc_id", "version", "n_superseded", "status", "summary", "confidence")
    sections = store.read("sections").groupBy("analysis_id").agg(F.count("*").alias("n_sections"))
    metrics = store.read("metrics").groupBy("analysis_id").agg(F.count("*").alias("n_metrics"), F.sum(F.col("numeric_value").cast("decimal(20,2)")).cast("double").alias("total"))
    charts = store.read("charts").select("analysis_id", F.col("config").alias("chart"))
    job, document = (persist.states(store, e).select(F.col("entity_id").cast("bigint").alias("doc_id"), F.col("event").alias(e)) for e in ("job", "document"))
    out = now.join(metrics, "analysis_id", "left").join(sections, "analysis_id", "left").join(charts, "analysis_id", "left").drop("analysis_id")
    out = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id")).join(out, "doc_id", "left").join(job, "doc_id", "left").join(document, "doc_id", "left")
    return out.fillna(0, ["n_metrics", "n_sections", "n_superseded"]).select("doc_id", F.col("version").isNotNull().alias("analysed"), "version", "n_superseded", "status", "summary", "confidence", "n_metrics", "n_sections", "total", "chart", "job", "document")


@query(f"""WITH {LINES_SQL} SELECT k AS doc_id, CAST(k % 10 + 1 AS INTEGER) AS version, CASE WHEN k % 9 = 0 THEN 'PARTIAL' ELSE 'REVIEW_REQUIRED' END AS status, CASE WHEN k % 10 > 0 THEN 1 ELSE 0 END AS n_superseded, metrics AS n_metrics, CAST(metrics + 1 + even AS BIGINT) AS n_evidence,
    chunks AS n_sections, CAST(1 AS BIGINT) AS n_risk_items, CAST(missing + target + others + units + late AS BIGINT) AS n_issues, CASE WHEN k % 9 = 0 THEN 'PARTIAL' ELSE 'COMPLETED' END AS run FROM y""")
def report_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole reports committed over earlier analyses and replayed; row counts of what was committed."""
    chunks, pages, documents, analyses = report_inputs(spark, sf_dir)
    store = Store(spark, folder(spark, "report-store"))
    none = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
    earlier = analyses.select(F.concat(F.lit("old-"), F.col("document_id").cast("string")).alias("analysis_id"), F.col("document_id").alias("doc_id"), "version", F.lit("REVIEW_REQUIRED").alias("status"), *none("summary", "recommendation", "valuation", "risks"), F.lit(None).cast("double").alias("confidence"), *none("model"))
    store.commit("earlier", {"analyses": earlier})
    for _ in range(2):
        persist.second_contract(store, "run", chunks, pages, documents, AS_OF_YEAR, "model")
    found = persist.current(store).withColumn("n_superseded", F.count_if(F.col("status") == "SUPERSEDED").over(Window.partitionBy("doc_id")).cast("int"))
    kept = ["doc_id", "version", "status", "n_superseded"]
    # What the tables hold of an analysis comes from one aggregate over the rows of all; nothing is joined or sent to all tasks.
    parts = [found.where("status != 'SUPERSEDED'").select("analysis_id", *kept), persist.states(store, "run").select(F.col("entity_id").alias("analysis_id"), F.col("event").alias("run"))]
    counts = [f"n_{name}" for name in ("metrics", "evidence", "sections", "risk_items", "issues")]
    parts += [store.read(c.removeprefix("n_")).select("analysis_id", F.lit(1).alias(c)) for c in counts]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    out = rows.groupBy("analysis_id").agg(*(F.max(c).alias(c) for c in [*kept, "run"]), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts)).where("doc_id is not null")
    return out.select(*kept, *counts, "run")


@query("""SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type""")
def upserted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user and type, merged batch by batch into buckets; every batch is played twice."""
    store = Store(spark, folder(spark, "upsert-store"))
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    for part in range(3):
        for _ in range(2):
            upserts.upsert(store, f"batch-{part}", "last_event", rows.where(F.col("event_id") % 3 == part), ["user_id", "event_type"], "event_id", 8)
    return upserts.read(store, "last_event", "user_id bigint, event_type string, event_id bigint, value double", 8)


@query("""SELECT user_id, count(*) AS n_messages, min(event_id) AS first_at, max(event_id) AS last_at FROM events GROUP BY user_id""")
def counted_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of each sender, raised batch by batch without reading history again."""
    store = Store(spark, folder(spark, "counter-store"))
    rows = table(spark, sf_dir, "events").select("user_id", F.lit(1).cast("bigint").alias("n_messages"), F.col("event_id").alias("first_at"), F.col("event_id").alias("last_at"))
    for part in range(3):
        for _ in range(2):
            upserts.count_up(store, f"batch-{part}", "customers", rows.where(F.col("first_at") % 3 == part), ["user_id"], 8)
    return upserts.read(store, "customers", "user_id bigint, n_messages bigint, first_at bigint, last_at bigint", 8)
