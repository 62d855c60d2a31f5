"""Queries on administration, admission, the first contract, slugs and small column functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calc, contact, text, values
from ..operators import checks, jobs, layout, versions
from ..sources import admission, extraction
from .registry import query, spread, table

NOW = "2024-01-15 12:00:00"


def _pick(key: F.Column, *choices: str | None) -> F.Column:
    return F.get(F.array(*map(F.lit, choices)), (key % len(choices)).cast("int"))


@query("""WITH t AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'brand' WHEN 1 THEN concat('brand-', p_partkey % 5 + 1) ELSE concat('item-', p_partkey % 50) END AS base FROM part),
    used AS (SELECT unnest(['brand-3', 'brand', 'item-7', 'item-8-2', 'brand-19']) AS s), bases AS (SELECT DISTINCT base AS s FROM t),
    n AS (SELECT base, count(*) AS m FROM t GROUP BY base),
    c AS (SELECT base, unnest(range(1, 2 * m + 20)) AS i FROM n), d AS (SELECT base, i, CASE WHEN i = 1 THEN base ELSE concat(base, '-', i) END AS s FROM c),
    f AS (SELECT base, s, row_number() OVER (PARTITION BY base ORDER BY i) AS r FROM d WHERE s NOT IN (SELECT s FROM used) AND (i = 1 OR s NOT IN (SELECT s FROM bases))),
    o AS (SELECT id, base, row_number() OVER (PARTITION BY base ORDER BY id) AS r FROM t)
    SELECT id, s AS slug FROM o JOIN f USING (base, r)""")
def slug_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs that repeat, that look like suffixed ones, and that are taken already."""
    k = F.col("p_partkey")
    base = F.when(k % 3 == 0, "brand").when(k % 3 == 1, F.concat(F.lit("brand-"), k % 5 + 1)).otherwise(F.concat(F.lit("item-"), k % 50))
    taken = spark.createDataFrame([(s,) for s in ("brand-3", "brand", "item-7", "item-8-2", "brand-19")], "slug string")
    return versions.unique_slugs(table(spark, sf_dir, "part").select(k.alias("id"), base.alias("slug")), taken)


@query("""WITH m AS (SELECT o_custkey AS k, count(*) AS n, count(*) FILTER (o_orderstatus <> 'O') AS ok FROM orders GROUP BY o_custkey),
    x AS (SELECT c_custkey AS k, coalesce(n, 0) AS n, coalesce(ok, 0) AS ok, c_custkey % 2 = 0 AS nar, c_acctbal < 0 AS warned, c_custkey % 10 = 3 AS lost FROM customer LEFT JOIN m ON m.k = c_custkey),
    y AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE (2000 * ok + n) // (2 * n) END AS num, CASE WHEN nar THEN 1000 ELSE 0 END AS t FROM x)
    SELECT k AS doc_id, CAST(num AS DOUBLE) / 1000 AS numeric_coverage, CAST(t AS DOUBLE) / 1000 AS narrative_coverage, CAST(lost AS BIGINT) AS n_conflicts, CAST(n - ok + CAST(warned AS BIGINT) AS BIGINT) AS n_review, CAST(lost AS BIGINT) AS n_missing,
        CASE WHEN NOT lost AND num >= 900 AND t >= 800 THEN 'EXCELLENT' WHEN NOT lost AND num >= 750 THEN 'GOOD' WHEN num >= 500 THEN 'FAIR' ELSE 'POOR' END AS tier FROM y""")
def coverage_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of customers as reports; a third of them have no order, and so no metric."""
    tier = lambda ok: F.when(ok, "NORMALIZED_MATCH").otherwise("UNVERIFIED").alias("evidence_verification")
    metrics = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), tier(F.col("o_orderstatus") != "O"))
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    sections = c.select(k.alias("doc_id"), tier(k % 2 == 0))
    issue = lambda rows, code, severity: rows.select(k.alias("doc_id"), F.lit(code).alias("code"), F.lit(severity).alias("severity"))
    issues = issue(c.where("c_acctbal < 0"), "ARITHMETIC_MARGIN_MISMATCH", "WARNING").unionByName(issue(c.where("c_custkey % 10 = 3"), "MISSING_CRITICAL_FIELD", "BLOCKER"))
    return checks.coverage(metrics, sections, issues, "doc_id")


_NAMES = ("a.pdf", "b.PDF ", "c.doc", "", None, " d.Pdf", "pdf")
_TYPES = ("application/pdf", "Application/PDF; charset=binary", "", None, "text/html", " application/octet-stream ", "application/x-pdf;q=1", "application/json")


@query("""SELECT event_id, CASE WHEN event_id % 7 IN (2, 3, 4, 6) THEN 'BAD_EXTENSION' WHEN event_id % 8 IN (4, 7) THEN 'BAD_MIME' ELSE 'ok' END AS verdict FROM events""")
def admission_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names padded, blank and missing, and types with parameters, in any case, blank and missing."""
    k = F.col("event_id")
    body = F.lit("%PDF-1.7\n<< /Type /Page >>\ntrailer << >>\n%%EOF").cast("binary")
    files = table(spark, sf_dir, "events").select("event_id", _pick(k, *_NAMES).alias("name"), _pick(k, *_TYPES).alias("declared_mime"), body.alias("content"))
    return admission.admit(files).select("event_id", "verdict")


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'TOO_LARGE' WHEN event_id % 5 = 0 THEN 'BAD_MIME' WHEN event_id % 7 = 0 THEN 'BAD_MAGIC' ELSE 'ok' END AS upload,
    concat('quarantine/', regexp_replace(regexp_replace(concat('/', CASE WHEN event_id % 2 = 0 THEN '../' ELSE '' END, event_type, '..../', event_id), '\\.\\.+', '', 'g'), '^/+', '')) AS quarantine,
    concat('1.', event_id % 8) AS version, CAST(1 + event_id % 4 AS INTEGER) AS pages FROM events""")
def storage_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upload limits, keys that can't climb, versions and page counts read from bytes."""
    k = F.col("event_id")
    head = F.concat(F.lit("%PDF-1."), (k % 8).cast("string"), F.lit("\n"))
    start = F.when(k % 7 == 0, F.lit("%PNG")).otherwise(head).cast("binary")
    verdict = admission.upload_allowed(F.when(k % 3 == 0, 30_000_000).otherwise(1000), F.when(k % 5 == 0, "text/plain").otherwise("application/pdf"), start)
    key = F.concat(F.lit("/"), F.when(k % 2 == 0, "../").otherwise(""), "event_type", F.lit("..../"), k.cast("string"))
    content = F.concat(head, F.repeat(F.lit("<< /Type /Page >> "), (1 + k % 4).cast("int"))).cast("binary")
    return table(spark, sf_dir, "events").select("event_id", verdict.alias("upload"), admission.quarantine_key(admission.safe_key(key)).alias("quarantine"), admission.pdf_version(content).alias("version"), admission.page_count(content).cast("int").alias("pages"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN concat('Co ', o_orderkey) END AS company, CAST(o_orderkey % 3 = 0 AS BOOLEAN) AS historical, CASE o_orderkey % 4 WHEN 0 THEN 12.5 WHEN 1 THEN 7.0 WHEN 2 THEN NULL ELSE -3.0 END::DOUBLE AS page,
    CASE o_orderkey % 4 WHEN 0 THEN '12.5,0,7' WHEN 1 THEN '' WHEN 2 THEN '1,2,0' ELSE '0,0,500' END AS numbers, CASE WHEN o_orderkey % 5 = 0 THEN 'line' ELSE 'bar' END AS chart, CASE WHEN o_orderkey % 5 = 0 THEN 'FY24,' ELSE '' END AS labels,
    concat('r', o_orderkey) AS risk, '' AS evidence FROM orders""")
def legacy_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first contract's JSON, fenced and in prose: texts, flags, leading numbers, charts and risks."""
    k = F.col("o_orderkey")
    page = _pick(k, '"12.5 cr"', '"7%"', '"n/a"', "-3")
    pages = _pick(k, '["12.5 cr", null, "7%"]', "null", '[1, 2, "x"]', '["NaN", "", "5e2"]')
    chart = F.when(k % 5 == 0, '{"type":"line","title":"t","labels":["FY24",null],"series":[{"name":"a","data":[1,"2x"]}]}').otherwise('{"type":"pie","title":null}')
    payload = F.concat(
        F.lit('Here it is: {"company":'), F.when(k % 2 == 0, F.concat(F.lit('"Co '), k, F.lit('"'))).otherwise("null"), F.lit(',"metrics":[{"name":"m","isHistorical":'), F.when(k % 3 == 0, "true").otherwise('"no"'), F.lit(',"page":'), page,
        F.lit('}],"sections":[{"title":"s","pageReferences":'), pages, F.lit('}],"risks":[{"risk":"r'), k, F.lit('"}],"charts":['), chart, F.lit("]} as you asked"),
    )
    rows = extraction.read_legacy(spread(table(spark, sf_dir, "orders"), "o_orderkey").select(k.alias("id"), payload.alias("payload")))
    metric, section, c, risk = (F.get(name, F.lit(0)) for name in ("metrics", "sections", "charts", "risks"))
    numbers = F.array_join(F.transform(section["pageReferences"], lambda v: F.regexp_replace(v.cast("string"), "\\.0$", "")), ",")
    return rows.select("id", "company", metric["isHistorical"].alias("historical"), metric["page"].alias("page"), numbers.alias("numbers"), c["type"].alias("chart"), F.array_join(c["labels"], ",").alias("labels"), risk["risk"].alias("risk"), risk["evidence"].alias("evidence"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), k.alias("document_id"), F.col("c_name").alias("title"), (k % 2 == 0).alias("published"), F.when(k % 4 == 2, "ARCHIVED").otherwise("PUBLISHED").alias("status"), (k % 100).alias("created_at"), (k % 7).alias("uploaded_by"))


@query("SELECT c_custkey AS id, c_name AS title, CASE WHEN c_custkey % 4 = 2 THEN 'ARCHIVED' ELSE 'PUBLISHED' END AS status, c_custkey % 100 AS created_at FROM customer")
def admin_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.admin_list(_documents(spark, sf_dir), ["id", "title", "status", "created_at"])


@query("SELECT c_custkey AS id, c_name AS title, c_custkey % 100 AS created_at FROM customer WHERE c_custkey % 4 = 0")
def published_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.published_list(_documents(spark, sf_dir), ["id", "title", "created_at"])


@query("""WITH a AS (SELECT o_orderkey AS id, o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS v FROM orders), l AS (SELECT k, arg_max(id, v) AS id, max(v) AS v FROM a GROUP BY k)
    SELECT l.k AS document_id, l.id AS analysis_id, CAST(l.v AS INTEGER) AS version, (SELECT string_agg(concat(l_returnflag, CAST(l_linenumber AS VARCHAR)), ',' ORDER BY l_linenumber, l_returnflag) FROM lineitem WHERE l_orderkey = l.id) AS children FROM l JOIN customer ON c_custkey = l.k""")
def draft_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their latest analysis and its children; those without an analysis have no draft."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("document_id"), F.col("o_orderdate").alias("created_at"), F.lit("APPROVED").alias("status"))
    children = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("analysis_id"), F.col("l_linenumber").alias("ord"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("label"))
    found = versions.draft_report(_documents(spark, sf_dir).select("document_id"), versions.numbered(orders), children)
    return found.select("document_id", "analysis_id", "version", F.array_join(F.col("children.label"), ",").alias("children"))


@query("""SELECT c_custkey AS document_id, CASE WHEN c_custkey % 7 < 5 THEN (SELECT s_name FROM supplier WHERE s_suppkey = c_custkey % 7 + 1) END AS uploader, coalesce((SELECT string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) FROM orders WHERE o_custkey = c_custkey), '') AS versions FROM customer""")
def admin_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with files, versions and uploader."""
    files = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), F.concat(F.col("o_orderkey").cast("string"), F.lit(".pdf")).alias("file_name"))
    numbers = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("version"))
    users = table(spark, sf_dir, "supplier").where("s_suppkey <= 5").select((F.col("s_suppkey") - 1).alias("user_id"), F.col("s_name").alias("name"))
    found = versions.admin_document(_documents(spark, sf_dir), files, numbers, users)
    return found.select("document_id", "uploader", F.array_join(F.transform("versions", lambda v: v.cast("string")), ",").alias("versions")).fillna("", ["versions"])


@query("""WITH a AS (SELECT o_orderkey AS pointer, o_custkey AS d, sha256(concat('approve:', o_custkey, ':', o_orderkey)) AS batch FROM orders WHERE o_orderstatus = 'F')
    SELECT batch, pointer, 'analysis' AS entity, pointer AS entity_id, 'APPROVED' AS event FROM a UNION ALL SELECT batch, pointer, 'document', d, 'PUBLISHED' FROM a UNION ALL SELECT batch, pointer, 'audit', d, 'APPROVE by desk' FROM a""")
def approval_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("document_id"), "o_orderstatus")
    return versions.approvals(orders.drop("o_orderstatus"), orders.where("o_orderstatus = 'F'").select("id", F.lit("desk").alias("user")))


@query("""SELECT c_custkey AS document_id, unnest(['document', 'file', 'job', 'version', 'audit']) AS entity, unnest(['PROCESSING', 'STORED', 'QUEUED', '1', 'UPLOAD']) AS event FROM customer WHERE c_custkey % 3 <> 0""")
def upload_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.uploads(_documents(spark, sf_dir).select("document_id", F.when(F.col("id") % 3 == 0, "EMPTY").otherwise("ok").alias("verdict")))


@query(f"""WITH w AS (SELECT user_id AS i, max(ts) AS t FROM events WHERE ts <= TIMESTAMP '{NOW}' GROUP BY user_id), x AS (SELECT i, t, t > TIMESTAMP '{NOW}' - INTERVAL 60 MINUTE AS fresh FROM w WHERE i % 10 <> 1)
    SELECT count(*) AS n_workers, count(*) FILTER (fresh) AS n_fresh, CASE WHEN bool_or(fresh) THEN 'active' ELSE 'inactive' END AS status FROM x""")
def fleet_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workers but those that signed off, and whether any is fresh."""
    now = F.lit(NOW).cast("timestamp_ntz")
    beats = table(spark, sf_dir, "events").where(F.col("ts") <= now).select(F.col("user_id").alias("instance_id"), "ts")
    workers = jobs.fleet(beats, now, 3600)
    return jobs.fleet_status(jobs.without_instance(workers, workers.where("instance_id % 10 = 1")))


@query("SELECT user_id AS instance_id, max(ts) AS last_heartbeat_at FROM events GROUP BY user_id ORDER BY 2 DESC, 1 LIMIT 20")
def newest_heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    beats = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("instance_id")).agg(F.max("ts").alias("last_heartbeat_at"))
    return jobs.newest_heartbeats(beats)


@query(f"SELECT event_id, CASE WHEN event_id % 4 = 0 THEN false ELSE ts > TIMESTAMP '{NOW}' END AS valid FROM events")
def token_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    expires = F.when(F.col("event_id") % 4 != 0, F.col("ts"))
    return table(spark, sf_dir, "events").select("event_id", jobs.token_valid(expires, F.lit(NOW).cast("timestamp_ntz")).alias("valid"))


@query(f"""SELECT event_id AS id, user_id % 50 AS document_id, CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'RUNNING' END AS status, CASE WHEN event_type = 'error' THEN 'no page' END AS error, CASE WHEN event_type = 'error' THEN TIMESTAMP '{NOW}' END AS finished_at,
    CASE WHEN user_id % 50 % 2 = 0 AND (user_id % 50) IN (SELECT user_id % 50 FROM events WHERE event_type = 'error') THEN 'DRAFT' WHEN user_id % 50 % 2 = 0 THEN 'PROCESSING' ELSE 'PUBLISHED' END AS document FROM events""")
def job_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed jobs, and their documents back from PROCESSING to DRAFT."""
    events = table(spark, sf_dir, "events")
    rows = events.select(F.col("event_id").alias("id"), (F.col("user_id") % 50).alias("document_id"), F.lit("RUNNING").alias("status"))
    failures = events.where("event_type = 'error'").select(F.col("event_id").alias("id"), F.lit("no page").alias("error"))
    documents = rows.select(F.col("document_id").alias("id")).distinct().withColumn("status", F.when(F.col("id") % 2 == 0, "PROCESSING").otherwise("PUBLISHED"))
    after = jobs.released(documents, rows, failures).select(F.col("id").alias("document_id"), F.col("status").alias("document"))
    return jobs.failed(rows, failures, F.lit(NOW).cast("timestamp_ntz")).join(after, "document_id").select("id", "document_id", "status", "error", "finished_at", "document")


@query("""WITH r AS (SELECT l_orderkey AS run, l_linenumber % 3 AS idx, l_partkey AS v, row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 3 ORDER BY l_linenumber DESC, l_partkey DESC) AS r, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey) AS f FROM lineitem WHERE l_orderkey % 4 <> 0)
    SELECT run, count(*) FILTER (r = 1) AS n_chunks, CAST(sum(v) FILTER (r = 1) AS BIGINT) AS payload, count(*) FILTER (f = 1) AS n_flags FROM r GROUP BY run""")
def last_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upserts by (run, index), first issue per fingerprint, and children of deleted documents gone."""
    li = spread(table(spark, sf_dir, "lineitem"), "l_orderkey").select(F.col("l_orderkey").alias("run"), (F.col("l_linenumber") % 3).alias("idx"), F.struct("l_linenumber", "l_partkey").alias("at"), F.col("l_partkey").alias("v"), F.col("l_returnflag").alias("fingerprint"))
    gone = table(spark, sf_dir, "orders").where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("run"))
    kept = versions.without_deleted(li, gone, "run")
    last = versions.last_write(kept, ["run", "idx"], "at").groupBy("run").agg(F.count("*").alias("n_chunks"), F.sum("v").alias("payload"))
    return last.join(checks.once(kept, ["run"], "at").groupBy("run").agg(F.count("*").alias("n_flags")), "run")


@query("""WITH p AS (SELECT p_partkey AS id, CAST(CAST(p_retailprice AS DECIMAL(12,2)) * 100 AS BIGINT) AS v2, p_size AS s FROM part)
    SELECT id, CASE WHEN v2 % 100 = 0 THEN CAST(v2 // 100 AS VARCHAR) WHEN v2 % 10 = 0 THEN concat(v2 // 100, '.', v2 % 100 // 10) ELSE concat(v2 // 100, '.', lpad(CAST(v2 % 100 AS VARCHAR), 2, '0')) END AS plain,
        -CAST(v2 AS DOUBLE) / 100 AS stripped, CAST(s AS INTEGER) AS whole, concat('FY', lpad(CAST(s AS VARCHAR), 2, '0'), CASE id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'E' ELSE '' END) AS period, CAST(CASE id % 3 WHEN 0 THEN 10000000 WHEN 1 THEN 1000 ELSE 1 END AS BIGINT) AS times,
        id % 4 = 1 AS forecast, CASE id % 4 WHEN 0 THEN true ELSE false END AS actual, CAST(10000 * CAST(s AS DOUBLE) / 10000 AS DOUBLE) AS delta, CASE WHEN s = 0 OR id % 2 = 0 THEN true ELSE false END AS same,
        concat('revenue:', CASE WHEN id % 5 = 0 THEN '?' ELSE 'FY24' END, ':A') AS metric, left(sha256(concat(id, ':', 'h', s)), 32) AS run FROM p""")
def value_utilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decimal strings, bare numbers, printed periods, scale factors, codes, deltas, ids."""
    k, price, size = F.col("p_partkey"), F.col("p_retailprice").cast("decimal(12,2)"), F.col("p_size")
    code = _pick(k, "A", "E", "AI", "U")
    printed = F.concat(F.lit("FY"), F.lpad(size.cast("string"), 2, "0"))
    scale = _pick(k, "crore", "thousand", "none")
    return table(spark, sf_dir, "part").select(
        k.alias("id"), calc.decimal_string(price).alias("plain"), values.strip_number(F.concat(F.lit("Rs -"), price.cast("string"), F.lit(" only"))).cast("double").alias("stripped"),
        values.whole_number(F.concat(F.lit("p. "), size.cast("string"))).alias("whole"), values.format_period(printed, code, 2026).alias("period"), values.multiplier_of(scale).alias("times"), values.is_forecast(values.clean_code(F.when(code == "AI", "U").otherwise(F.lower(code)))).alias("forecast"),
        values.is_actual(code).alias("actual"), calc.delta_pct(F.lit(100), 100 + size).cast("double").alias("delta"), calc.same_value(F.lit(1000), F.when(k % 2 == 0, 1004).otherwise(1000 + 10 * size)).alias("same"),
        text.metric_id(F.lit("revenue"), F.when(k % 5 != 0, "FY24"), F.lit("A")).alias("metric"), text.run_id(k, F.concat(F.lit("h"), size)).alias("run"),
    )


@query("""SELECT event_id, trim(concat('a<', event_type, '>&"', event_id, '''')) AS cleaned, concat('a&lt;', event_type, '&gt;&amp;&quot;', event_id, '&#39;') AS escaped, concat('line ', event_id, ' of ', event_type) AS error,
    event_id % 3 = 0 AS number, event_id % 2 = 0 AS image, CAST(event_id AS DOUBLE) + 0.13 AS x0, CAST(event_id AS DOUBLE) + 2.63 AS x1, CAST(2 * event_id AS DOUBLE) AS e, CAST(3 * event_id AS DOUBLE) AS f FROM events""")
def text_utilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Input cleaning, escaping, short errors, numbers in cells, pages without text, boxes and affine products."""
    k = F.col("event_id")
    raw = F.concat(F.lit("\t a<"), "event_type", F.lit('>&"'), k.cast("string"), F.lit("'\x07 "))
    cleaned = text.clean_input(raw, 100)
    cell = F.when(k % 3 == 0, F.concat(F.lit("(₹ "), k.cast("string"), F.lit(".5)"))).otherwise(F.concat(F.lit("n"), k.cast("string")))
    box = layout.bounding_box(F.lit(1), k + 0.1251, F.lit(0.0), F.lit(2.5), F.lit(1.0), F.lit(0))
    product = layout.affine([F.lit(2.0), F.lit(0.0), F.lit(0.0), F.lit(3.0), F.lit(0.0), F.lit(0.0)], [F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), k.cast("double"), k.cast("double")])
    return table(spark, sf_dir, "events").select(
        "event_id", cleaned.alias("cleaned"), text.escape_html(cleaned).alias("escaped"), text.short_error(F.concat(F.lit(" line  "), k.cast("string"), F.lit("\n of "), "event_type", F.lit(" "))).alias("error"), layout.numberish(cell).alias("number"),
        layout.image_only(F.when(k % 2 == 0, " few \n letters").otherwise("more than twenty five letters of text")).alias("image"), box["x0"].alias("x0"), box["x1"].alias("x1"), product[4].alias("e"), product[5].alias("f"),
    )


@query("""WITH c AS (SELECT c_custkey AS id, c_custkey % 4 AS k FROM customer) SELECT id, CASE k WHEN 0 THEN '' WHEN 1 THEN 'name' WHEN 2 THEN 'email,name' ELSE 'email,message,name,phone' END AS failing FROM c""")
def form_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of a contact form that get a message."""
    k = F.col("c_custkey") % 4
    fields = {"name": F.when(k == 0, "Asha Rao").otherwise("aaaa"), "email": F.when(k < 2, "asha@firm.com").otherwise("x"), "phone": F.when(k < 3, "9876501234").otherwise("1234567890"), "message": F.when(k < 3, "We would like to see the report about your company please").otherwise("hello")}
    scores = {"name": contact.score_name, "email": contact.score_email, "phone": contact.score_phone, "message": contact.score_message}
    # One failing field alone is not enough to distrust the others, so raw checks serve here.
    errors = contact.form_errors({f: scores[f](c) for f, c in fields.items()})
    return spread(table(spark, sf_dir, "customer"), "c_custkey").select(F.col("c_custkey").alias("id"), F.array_join(F.array_sort(F.map_keys(errors)), ",").alias("failing"))
