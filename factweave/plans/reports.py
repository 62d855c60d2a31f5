"""Whole reports from JSON: lines of an order are the metrics of a report, two to the chunk and page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import report
from .registry import query, spread, table

AS_OF_YEAR = 2026


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    rows = spread(table(spark, sf_dir, "lineitem"), "l_orderkey").select(F.col("l_orderkey").alias("k"), n.alias("n"), F.col("l_quantity").cast("int").cast("string").alias("q"), (F.col("l_returnflag") != "R").alias("told"), (F.col("l_linestatus") == "O").alias("loud"))
    return rows.withColumn("c", F.expr("(n - 1) div 2"))


def report_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Chunks, pages, documents and earlier analyses."""
    k, n, c = F.col("k"), F.col("n"), F.col("c")
    early = n <= 4
    written = lambda *parts: F.concat(*(F.coalesce(p.cast("string"), F.lit("null")) if isinstance(p, Column) else F.lit(p) for p in parts))
    said = written("line ", n, " sells ", F.col("q"), " pieces")
    quote = F.when(~F.col("told"), written("unheard ", n, " xxxx yyyy zzzz")).when(F.col("loud"), F.upper(said)).otherwise(said)
    metric = F.struct(
        F.when(n % 2 == 0, "Net revenue").otherwise("EBITDA").alias("label"),
        F.when(~early & (k % 4 == 0), F.concat(F.lit("US$ "), "q", F.lit(" mn"))).otherwise(F.concat(F.lit("Rs "), "q", F.lit(" Cr"))).alias("rawValue"),
        F.when(early, "FY24").otherwise("FY2025").alias("period"),
        F.when((k % 7 == 0) == early, "e").otherwise("A").alias("classificationCode"),
        quote.alias("sourceQuote"),
        (c + 1).alias("sourcePage"),
    )
    lines = _lines(spark, sf_dir)
    # Compiled before the aggregates; inside them it would be interpreted.
    together = lambda row: lines.select("k", "c", row.alias("r")).groupBy("k", "c").agg(F.array_sort(F.collect_list("r")).alias("rows"))
    company = F.when(c == 1, F.concat(F.lit("Late "), k)).when(k % 3 != 0, F.concat(F.lit("Company "), k)).otherwise("")
    identity = F.struct(company.alias("companyName"), F.when(c == 0, "A. Nalyst").alias("analystName"), F.when(c == 0, "2024-01-01").alias("publishedDate"), F.when(c == 1, "House").alias("researchHouse"), written("Company ", k, " reports").alias("identityQuote"), (c + 1).alias("identityPage"))
    valuation = F.struct(F.when(k % 2 == 0, "BUY").alias("rating"), F.lit(100).alias("cmp"), F.when(k % 5 == 0, "-5").otherwise("120").alias("baseTarget"), F.lit("12 months").alias("horizon"))
    risk = F.struct(F.lit("Risk").alias("name"), F.lit("Orders may fall").alias("explanation"), F.lit("a risk is named here").alias("sourceQuote"), (c + 1).alias("sourcePage"))
    section = F.struct(written("Section ", c).alias("heading"), written("Part ", c, " of order ", k).alias("summary"), F.when(c % 2 == 0, written("section ", c, " says so")).otherwise("").alias("sourceQuote"), (c + 1).alias("sourcePage"))
    payload = F.to_json(F.struct(F.when(c <= 1, identity).alias("identity"), F.when(c == 0, valuation).alias("valuation"), F.transform("rows", lambda r: r["m"]).alias("metrics"), F.array(risk).alias("risks"), F.array(section).alias("sections")))
    chunks = together(F.struct("n", metric.alias("m"))).select(k.alias("doc_id"), c.alias("chunk_idx"), F.concat(F.lit("```json\n"), payload, F.lit("\n```")).alias("payload"))
    body = F.concat_ws(". ", F.array_join(F.transform("rows", lambda r: r["s"]), ". "), F.when(c % 2 == 1, "a risk is named here").otherwise(written("section ", c, " says so")), F.when(c == 1, written("Company ", k, " reports")))
    pages = together(F.struct("n", said.alias("s"))).select(k.alias("doc_id"), (c + 1).cast("int").alias("page"), body.alias("text"))
    documents = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id")).distinct().withColumn("is_partial", F.col("doc_id") % 9 == 0)
    analyses = documents.where("doc_id % 10 > 0").select(F.col("doc_id").alias("document_id"), (F.col("doc_id") % 10).cast("int").alias("version"))
    return chunks, pages, documents, analyses


LINES_SQL = """
    l AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n, CAST(l_quantity AS INTEGER) AS q,
        CASE WHEN l_returnflag = 'R' THEN 1 WHEN l_linestatus = 'O' THEN 3 ELSE 4 END AS rank FROM lineitem),
    d AS (SELECT k, (max(n) + 1) // 2 AS chunks, ((max(n) + 1) // 2 + 1) // 2 AS even FROM l GROUP BY k),
    g AS (SELECT *, n % 2 AS tax, n <= 4 AS early, first_value(q) OVER (PARTITION BY k, n % 2, n <= 4 ORDER BY n) AS f FROM l),
    m AS (SELECT k, tax, early, count(*) FILTER (q <> f) AS conflicts, count(DISTINCT q) - 1 AS others, max(rank) FILTER (q = f) AS rank FROM g GROUP BY k, tax, early),
    t AS (SELECT k, tax, count(*) AS periods FROM m GROUP BY k, tax),
    s AS (SELECT k, CAST(count(*) AS BIGINT) AS metrics, count(*) FILTER (rank >= 3) AS ok, CAST(sum(conflicts) AS BIGINT) AS conflicts, CAST(sum(others) AS BIGINT) AS others FROM m GROUP BY k),
    u AS (SELECT k, count(*) AS charts, count(*) FILTER (periods = 2) AS both FROM t GROUP BY k),
    x AS (SELECT d.k, chunks, even, metrics, ok, conflicts, others, charts, CASE WHEN d.k % 4 = 0 THEN "both" ELSE 0 END AS units, CASE WHEN d.k % 7 = 0 THEN "both" ELSE 0 END AS late,
        CASE WHEN d.k % 5 = 0 THEN 1 ELSE 0 END AS target, CASE WHEN d.k % 3 = 0 AND chunks = 1 THEN 1 ELSE 0 END + CASE WHEN d.k % 2 = 1 THEN 1 ELSE 0 END + CASE WHEN chunks = 1 THEN 1 ELSE 0 END AS missing
        FROM d JOIN s USING (k) JOIN u USING (k)),
    y AS (SELECT *, (2000 * ok + metrics) // (2 * metrics) AS num, (2000 * even + chunks) // (2 * chunks) AS nar, missing + target + conflicts AS blockers FROM x)
"""


@query(f"""WITH {LINES_SQL} SELECT k AS doc_id, CAST(k % 10 + 1 AS INTEGER) AS version, CASE WHEN k % 9 = 0 THEN 'PARTIAL' ELSE 'REVIEW_REQUIRED' END AS status, metrics AS n_metrics, CAST(metrics + 1 + even AS BIGINT) AS n_evidence,
    charts AS n_charts, CAST(blockers + units + late AS BIGINT) AS n_issues, CAST(blockers AS BIGINT) AS n_blockers, CAST(missing + target + others + units + late AS BIGINT) AS n_stored, CAST(num AS DOUBLE) / 1000 AS numeric_coverage, CAST(nar AS DOUBLE) / 1000 AS narrative_coverage,
    CASE WHEN blockers = 0 AND num >= 900 AND nar >= 800 THEN 'EXCELLENT' WHEN blockers = 0 AND num >= 750 THEN 'GOOD' WHEN num >= 500 THEN 'FAIR' ELSE 'POOR' END AS tier FROM y""")
def assembled_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk JSON to checked, merged and versioned reports: a row per document with what its tables hold."""
    return report.assemble(*report_inputs(spark, sf_dir), AS_OF_YEAR).summary


@query(f"""WITH {LINES_SQL} SELECT k AS doc_id, CASE WHEN k % 3 <> 0 THEN concat('Company ', k) WHEN chunks > 1 THEN concat('Late ', k) END AS company, CASE WHEN chunks > 1 THEN 'House' END AS house,
    CASE WHEN chunks > 1 THEN 'EXACT_MATCH' ELSE 'UNVERIFIED' END AS status, CAST(CASE WHEN chunks > 1 THEN 2 ELSE 1 END AS INTEGER) AS page FROM d""")
def report_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity of each report and the evidence chosen for it."""
    chunks, pages, _, _ = report_inputs(spark, sf_dir)
    found = report.records(report.with_evidence(report.items(chunks, ("identity",)), pages), "identity")
    return found.select("doc_id", F.col("companyName").alias("company"), F.col("researchHouse").alias("house"), "status", "page")


@query(f"""WITH {LINES_SQL}, b AS (SELECT k, tax, early, f, arg_max(n, rank * 1000 - n) FILTER (q = f) AS n, max(rank) FILTER (q = f) AS rank, count(*) FILTER (q <> f) AS conflicts FROM g GROUP BY k, tax, early, f)
    SELECT k AS doc_id, CASE tax WHEN 0 THEN 'revenue' ELSE 'ebitda' END AS taxonomy_key, CASE WHEN early THEN 'FY24' ELSE 'FY25' END AS period, CASE WHEN (k % 7 = 0) = early THEN 'E' ELSE 'A' END AS classification_code, CAST(f AS DOUBLE) AS value,
        CASE WHEN NOT early AND k % 4 = 0 THEN 'USD' ELSE 'INR' END AS currency, CASE WHEN NOT early AND k % 4 = 0 THEN 'million' ELSE 'crore' END AS scale, CAST((n + 1) // 2 AS INTEGER) AS page, CAST(conflicts AS INTEGER) AS n_conflicts,
        row_number() OVER (PARTITION BY k ORDER BY tax DESC, early DESC) - 1 AS ord, CASE WHEN conflicts > 0 THEN 'CONFLICTING' WHEN rank = 4 THEN 'HIGH' WHEN rank = 3 THEN 'MEDIUM' ELSE 'UNVERIFIED' END AS confidence FROM b""")
def report_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised and folded metrics of each report in their order."""
    chunks, pages, _, _ = report_inputs(spark, sf_dir)
    found = report.merged_metrics(report.with_evidence(report.items(chunks, ("metric",)), pages), AS_OF_YEAR)
    return found.select("doc_id", "taxonomy_key", "period", "classification_code", F.col("value").cast("double").alias("value"), "currency", "scale", "page", "n_conflicts", "ord", "confidence")
