"""Queries on facts: growth, bridges, checks, coverage, series, claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calc
from ..operators import checks, claims, series
from .facts import YEARLY_SQL, half_up, order_lines, period, yearly
from .registry import query, table

AS_OF_YEAR = 2026


def _d(c: str) -> F.Column:
    return F.col(c).cast("double").alias(c)


@query(f"WITH {YEARLY_SQL} SELECT entity, period, CAST(fy AS INTEGER) AS fy, code, revenue4 / 10000.0 AS revenue, toi4 / 10000.0 AS total_operating_income, tax4 / 10000.0 AS tax FROM yearly".replace("10000.0", "CAST(10000 AS DOUBLE)"))
def metric_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue, operating income and tax per entity and fiscal year."""
    return yearly(spark, sf_dir).select("entity", "period", "fy", "code", _d("revenue"), F.col("toi").cast("double").alias("total_operating_income"), _d("tax"))


@query(f"""WITH {YEARLY_SQL}, p AS (SELECT *, lag(revenue4) OVER (PARTITION BY entity ORDER BY fy) AS prior4 FROM yearly)
    SELECT entity, period, CASE WHEN prior4 > 0 THEN CAST({half_up('(revenue4 - prior4) * 10000', 'prior4')} AS DOUBLE) / 100 END AS growth_pct,
        CASE WHEN prior4 IS NULL THEN 'input missing' END AS reason FROM p""")
def growth_yoy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series.growth_series(yearly(spark, sf_dir), ["entity"], "fy", "revenue", calc.growth(F.col("revenue"), F.col("prior")))
    return rows.select("entity", "period", F.col("growth.value").cast("double").alias("growth_pct"), F.col("growth.reason").alias("reason"))


@query(f"""WITH {YEARLY_SQL}, s AS (SELECT entity, arg_min(revenue4, fy) AS a, arg_max(revenue4, fy) AS b, max(fy) - min(fy) AS years FROM yearly GROUP BY entity)
    SELECT entity, CAST(years AS INTEGER) AS years, round(CAST((pow(CAST(b AS DOUBLE) / a, CAST(1 AS DOUBLE) / years) - 1) * 100 AS DECIMAL(20,4)), 2)::DOUBLE AS cagr_pct FROM s WHERE years > 0""")
def cagr_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = yearly(spark, sf_dir).groupBy("entity").agg(F.min_by("revenue", "fy").alias("a"), F.max_by("revenue", "fy").alias("b"), (F.max("fy") - F.min("fy")).alias("years"))
    return spans.where("years > 0").select("entity", "years", calc.cagr(F.col("a"), F.col("b"), F.col("years"))["value"].cast("double").alias("cagr_pct"))


@query(f"""WITH p AS (SELECT p_partkey, CAST(CAST(p_retailprice AS DECIMAL(12,2)) * 100 AS BIGINT) AS price2, CAST(p_size AS BIGINT) AS size, p_partkey % 7 AS k FROM part)
    SELECT p_partkey, CASE WHEN k > 0 THEN CAST({half_up('(price2 * (90 + size)) * 100 - 10000 * k * price2', 'k * price2')} AS DOUBLE) / 100 END AS upside_pct,
        CAST(price2 * size AS DOUBLE) / 100 AS ev, CAST(price2 * size - 100 * k + 500 AS DOUBLE) / 100 AS equity,
        CASE WHEN k > 0 THEN CAST({half_up('price2 * size - 100 * k + 500', 'k')} AS DOUBLE) / 100 END AS target, CAST(price2 * k AS DOUBLE) / 100 AS eps_target,
        CASE WHEN k = 0 THEN 'share count is zero' END AS reason FROM p""")
def valuation_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upside, enterprise value, equity value, target from equity and from earnings, per part."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").cast("decimal(12,2)").alias("price"), F.col("p_size").cast("decimal(20,4)").alias("size"), (F.col("p_partkey") % 7).cast("decimal(20,4)").alias("k"))
    ev = calc.ev_from_multiple(F.col("price"), F.col("size"))["value"]
    equity = calc.equity_from_ev(F.col("ev"), F.col("k"), investments=F.lit(7), minority=F.lit(2))["value"]
    rows = p.withColumn("ev", ev).withColumn("equity", equity).withColumn("t", calc.target_from_equity(F.col("equity"), F.col("k")))
    up = calc.upside(F.col("price") * (90 + F.col("size")) / 100, F.col("k") * F.col("price"))["value"]
    return rows.select("p_partkey", up.cast("double").alias("upside_pct"), _d("ev"), _d("equity"), F.col("t.value").cast("double").alias("target"), calc.target_from_eps(F.col("price"), F.col("k"))["value"].cast("double").alias("eps_target"), F.col("t.reason").alias("reason"))


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, ord, taxonomy_key, period, classification_code, value, currency, scale, evidence_verification): printed metrics, some of them off."""
    off = F.col("fy") % 3
    rows = yearly(spark, sf_dir)
    money = lambda c: F.round(c, 4).cast("decimal(20,4)")
    margin = F.round(F.col("revenue") / F.col("toi") * 100, 0) + F.when(off == 0, 5).otherwise(0)
    items = [
        (1, "revenue", money(F.col("toi"))),
        (2, "ebitda", money(F.col("revenue"))),
        (3, "ebitda_margin", money(margin)),
        (4, "ocf", money(F.col("revenue"))),
        (5, "capex", money(-F.col("tax"))),
        (6, "fcf", money(F.col("revenue") - F.col("tax") * F.when(off == 1, 3).otherwise(1))),
    ]
    each = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(k).alias("k"), v.alias("v")) for n, k, v in items))
    ord_ = (F.col("fy") * 10 + F.col("m.n")).cast("bigint")
    tier = F.when(ord_ % 5 < 3, "EXACT_MATCH").when(ord_ % 5 == 3, "NORMALIZED_MATCH").otherwise("UNVERIFIED")
    unit = F.when((F.col("m.n") == 1) & (off == 2), "USD").otherwise("INR")
    flat = rows.select("entity", "fy", "period", "code", F.explode(each).alias("m"))
    return flat.select("entity", ord_.alias("ord"), F.col("m.k").alias("taxonomy_key"), "period", F.col("code").alias("classification_code"), F.col("m.v").alias("value"), unit.alias("currency"), F.lit("crore").alias("scale"), tier.alias("evidence_verification"))


_ISSUES_SQL = f"""
    rounded AS (SELECT *, {half_up('revenue4 * 100', 'toi4')} + CASE WHEN fy % 3 = 0 THEN 5 ELSE 0 END AS margin0, {half_up('revenue4 * 10000', 'toi4')} AS margin2,
        revenue4 - tax4 * CASE WHEN fy % 3 = 1 THEN 3 ELSE 1 END AS fcf4, revenue4 - tax4 AS own4 FROM yearly),
    issues AS (
        SELECT entity, 'ARITHMETIC_MARGIN_MISMATCH' AS code, 'WARNING' AS severity, period, CAST(margin0 AS DOUBLE) AS reported, CAST(margin2 AS DOUBLE) / 100 AS computed
        FROM rounded WHERE abs(100 * margin0 - margin2) * 100 > abs(100 * CASE WHEN margin0 = 0 THEN margin2 ELSE margin0 END)
        UNION ALL SELECT entity, 'ARITHMETIC_FCF_MISMATCH', 'WARNING', period, CAST(fcf4 AS DOUBLE) / 10000, CAST(own4 AS DOUBLE) / 10000
        FROM rounded WHERE abs(fcf4 - own4) * 100 > abs(CASE WHEN fcf4 = 0 THEN own4 ELSE fcf4 END)
    )
"""


@query(f"WITH {YEARLY_SQL}, {_ISSUES_SQL} SELECT * FROM issues")
def arithmetic_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Margins and free cash flows that the facts' own figures contradict."""
    return checks.arithmetic_issues(_metrics(spark, sf_dir), ["entity"])


@query("""WITH v AS (SELECT p_partkey AS id, CAST(CAST(p_retailprice AS DECIMAL(12,2)) * 100 AS BIGINT) AS cmp2, p_partkey % 11 AS k FROM part),
    w AS (SELECT *, CASE WHEN k = 0 THEN -cmp2 WHEN k = 1 THEN cmp2 * 21 WHEN k = 2 THEN NULL ELSE cmp2 * 20 END AS t2, cmp2 * 20 AS own2 FROM v)
    SELECT id, 'ARITHMETIC_TARGET_MISMATCH' AS code, 'WARNING' AS severity, CAST(NULL AS VARCHAR) AS period, CAST(t2 AS DOUBLE) / 100 AS reported, CAST(own2 AS DOUBLE) / 100 AS computed FROM w WHERE abs(t2 - own2) * 100 > abs(t2)
    UNION ALL SELECT id, 'INVALID_TARGET_CMP_RELATIONSHIP', 'BLOCKER', NULL, CAST(t2 AS DOUBLE) / 100, CAST(cmp2 AS DOUBLE) / 100 FROM w WHERE cmp2 > 0 AND t2 <= 0""")
def target_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, k = F.col("p_retailprice").cast("decimal(12,2)"), F.col("p_partkey") % 11
    target = F.when(k == 0, -price).when(k == 1, price * 21).when(k == 2, None).otherwise(price * 20)
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), price.alias("cmp"), price.alias("eps"), F.lit(20).cast("decimal(20,4)").alias("pe"), target.cast("decimal(20,4)").alias("base_target"))
    return checks.target_issues(rows, ["id"])


def _halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two observations of revenue per entity, year and code: by the lines' status."""
    rows = order_lines(spark, sf_dir).groupBy("entity", "fy", "code", "l_linestatus").agg(F.sum("net").cast("decimal(20,4)").alias("value"))
    return rows.select("entity", period(F.col("fy")).alias("period"), F.col("code").alias("classification_code"), F.ascii("l_linestatus").cast("bigint").alias("ord"), F.lit("revenue").alias("taxonomy_key"), "value")


_HALVES_SQL = "halves AS (SELECT entity, concat('FY', lpad(CAST(fy % 100 AS VARCHAR), 2, '0')) AS period, code, CAST(ascii(l_linestatus) AS BIGINT) AS ord, CAST(sum(net4) AS BIGINT) AS v4 FROM lines GROUP BY entity, fy, code, l_linestatus)"


@query(f"""WITH {YEARLY_SQL}, {_HALVES_SQL}, f AS (SELECT *, first_value(v4) OVER (PARTITION BY entity, period, code ORDER BY ord) AS f4, min(ord) OVER (PARTITION BY entity, period, code) AS o FROM halves)
    SELECT entity, 'revenue' AS taxonomy_key, period, code AS classification_code, ord, CAST(f4 AS DOUBLE) / 10000 AS first_value, CAST(v4 AS DOUBLE) / 10000 AS other_value
    FROM f WHERE ord <> o AND abs(f4 - v4) * 100 > abs(CASE WHEN f4 = 0 THEN v4 ELSE f4 END)""")
def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.contradictions(_halves(spark, sf_dir), ["entity"])


@query(f"""WITH {YEARLY_SQL} SELECT entity, 'revenue' AS taxonomy_key, array_to_string(list_sort(list(DISTINCT CASE WHEN fy % 3 = 2 THEN 'USD/crore' ELSE 'INR/crore' END)), ',') AS units
    FROM yearly GROUP BY entity HAVING count(DISTINCT fy % 3 = 2) > 1""")
def mixed_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.mixed_units(_metrics(spark, sf_dir), ["entity"])


_RECORD_SQL = """record AS (SELECT n_name AS entity, CASE WHEN n_nationkey % 4 = 0 THEN '  ' ELSE 'buy' END AS recommendation, CASE WHEN n_nationkey % 6 = 1 THEN NULL ELSE 'desk' END AS analyst FROM nation),
    missing AS (SELECT entity, 'recommendation' AS field FROM record WHERE trim(recommendation) = '' UNION ALL SELECT entity, 'analyst' FROM record WHERE analyst IS NULL)"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("entity"), F.when(key % 4 == 0, "  ").otherwise("buy").alias("recommendation"), F.when(key % 6 == 1, None).otherwise("desk").alias("analyst"))


@query(f"""WITH {_RECORD_SQL} SELECT entity, 'MISSING_CRITICAL_FIELD' AS code, 'BLOCKER' AS severity, field,
    left(sha256(concat('{{"code":"MISSING_CRITICAL_FIELD","entityId":null,"entityType":"DocumentAnalysis","valueSnapshot":{{"field":"', field, '"}}}}')), 32) AS fingerprint FROM missing""")
def missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.missing_fields(_records(spark, sf_dir), ["entity"], ["recommendation", "analyst"])


@query(f"""WITH {YEARLY_SQL}, {_ISSUES_SQL}, {_RECORD_SQL},
    m AS (SELECT entity, (fy * 10 + n) % 5 AS t FROM yearly, range(1, 7) r(n)),
    a AS (SELECT entity, count(*) AS n, count(*) FILTER (t <= 3) AS ok FROM m GROUP BY entity),
    s AS (SELECT n_name AS entity, count(*) AS n, count(*) FILTER ((c_custkey % 10) < 8) AS ok FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name),
    w AS (SELECT entity, count(*) AS n FROM issues GROUP BY entity), b AS (SELECT entity, count(*) AS n FROM missing GROUP BY entity),
    j AS (SELECT a.entity, {half_up('a.ok * 1000', 'a.n')} AS num, CASE WHEN coalesce(s.n, 0) = 0 THEN 0 ELSE {half_up('coalesce(s.ok, 0) * 1000', 'greatest(coalesce(s.n, 0), 1)')} END AS nar, coalesce(b.n, 0) AS miss, a.n - a.ok + coalesce(w.n, 0) AS review
        FROM a LEFT JOIN s USING (entity) LEFT JOIN w USING (entity) LEFT JOIN b USING (entity))
    SELECT entity, CAST(num AS DOUBLE) / 1000 AS numeric_coverage, CAST(nar AS DOUBLE) / 1000 AS narrative_coverage, CAST(miss AS BIGINT) AS n_conflicts, CAST(review AS BIGINT) AS n_review, CAST(miss AS BIGINT) AS n_missing,
        CASE WHEN miss = 0 AND num >= 900 AND nar >= 800 THEN 'EXCELLENT' WHEN miss = 0 AND num >= 750 THEN 'GOOD' WHEN num >= 500 THEN 'FAIR' ELSE 'POOR' END AS tier FROM j""")
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage, conflicts and tier of every entity: the flagship."""
    metrics = _metrics(spark, sf_dir)
    nation = F.broadcast(table(spark, sf_dir, "nation"))
    tier = F.when(F.col("c_custkey") % 10 < 8, "EXACT_MATCH").otherwise("UNVERIFIED")
    sections = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("entity"), tier.alias("evidence_verification"))
    missing = checks.missing_fields(_records(spark, sf_dir), ["entity"], ["recommendation", "analyst"])
    issues = checks.arithmetic_issues(metrics, ["entity"]).select("entity", "code", "severity").unionByName(missing.select("entity", "code", "severity"))
    return checks.coverage(metrics, sections, issues, "entity")


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, ord, period, value, code) with every third year left out, and a few odd periods."""
    rows = yearly(spark, sf_dir).where("fy % 3 != 1")
    odd = F.when(F.col("fy") == 1995, "H1FY95").otherwise(F.concat(F.lit("FY"), F.col("fy").cast("string")))
    return rows.select(F.col("entity").alias("series"), F.col("fy").cast("bigint").alias("ord"), odd.alias("period"), F.col("revenue").cast("double").alias("value"), "code")


_DENSE_SQL = """
    pts AS (SELECT entity AS series, CAST(fy AS BIGINT) AS ord, fy, fy AS y, CAST(revenue4 AS DOUBLE) / 10000 AS value, code, fy = 1995 AS odd FROM yearly WHERE fy % 3 <> 1),
    own AS (SELECT * FROM pts WHERE NOT odd),
    nxt AS (SELECT *, lead(y) OVER (PARTITION BY series ORDER BY y, ord) AS ny FROM own),
    gaps AS (SELECT series, unnest(range(y + 1, ny)) AS y FROM nxt WHERE ny > y + 1),
    dense AS (SELECT series, ord, y, value, code FROM own UNION ALL SELECT series, NULL, y, NULL, 'U' FROM gaps)
"""


@query(f"""WITH {YEARLY_SQL}, {_DENSE_SQL} SELECT series, concat('FY', right(CAST(y AS VARCHAR), 2)) AS label, CAST(y * 10 AS INTEGER) AS sort_key, value, code,
    CASE WHEN ord IS NULL THEN 'SYSTEM_GENERATED_MISSING' ELSE 'REPORTED' END AS data_status FROM dense""")
def series_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense = series.densify(series.parsed_points(_points(spark, sf_dir), AS_OF_YEAR))
    return dense.select("series", "label", "sort_key", "value", "code", "data_status")


@query(f"""WITH {YEARLY_SQL}, {_DENSE_SQL}, b AS (SELECT *, max(code IN ('G', 'E', 'C', 'S', 'AI')) OVER (PARTITION BY series ORDER BY y, ord NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f FROM dense)
    SELECT series, 'CHART_UNPARSEABLE_PERIOD' AS issue, count(*) AS n FROM pts WHERE odd GROUP BY series
    UNION ALL SELECT series, 'CHART_FORECAST_BEFORE_ACTUAL', count(*) FROM b WHERE f AND code IN ('A', 'R', 'P') GROUP BY series""")
def series_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    return series.series_issues(points, series.densify(series.parsed_points(points, AS_OF_YEAR)), AS_OF_YEAR)


@query(f"""WITH {YEARLY_SQL}, {_DENSE_SQL} SELECT series, array_to_string(list(concat('FY', right(CAST(y AS VARCHAR), 2)) ORDER BY y), ',') AS labels, count(*) AS n_points, count(value) AS n_values FROM dense GROUP BY series""")
def series_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legacy arrays and back to points."""
    arrays = series.legacy_arrays(series.densify(series.parsed_points(_points(spark, sf_dir), AS_OF_YEAR)))
    back = series.from_legacy(arrays).groupBy("series").agg(F.count("*").alias("n_points"), F.count("value").alias("n_values"))
    return arrays.select("series", F.array_join("labels", ",").alias("labels")).join(back, "series")


@query(f"""WITH {YEARLY_SQL}, {_DENSE_SQL}, i AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY y, ord NULLS FIRST) - 1 AS i, code IN ('G', 'E', 'C', 'S', 'AI') AS f FROM dense),
    s AS (SELECT *, coalesce(min(i) FILTER (f) OVER (PARTITION BY series), -1) AS start FROM i)
    SELECT series, concat('FY', right(CAST(y AS VARCHAR), 2)) AS label, CAST(y * 10 AS INTEGER) AS sort_key, CASE WHEN NOT f THEN value END AS actual, CASE WHEN f OR i = start - 1 THEN value END AS forecast, CAST(start AS INTEGER) AS forecast_start FROM s""")
def forecast_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.forecast_boundary(series.densify(series.parsed_points(_points(spark, sf_dir), AS_OF_YEAR)))


@query(f"""WITH {YEARLY_SQL}, y AS (SELECT *, lag(revenue4) OVER (PARTITION BY entity ORDER BY fy) AS p4 FROM yearly),
    c AS (SELECT concat(entity, ':', period) AS claim_id, fy % 4 AS k, {half_up('revenue4', '10000')} AS whole, {half_up('(revenue4 - p4) * 10000', 'p4')} AS g2 FROM y WHERE p4 > 0)
    SELECT claim_id, CASE WHEN k = 3 THEN 'OUTLOOK' ELSE 'PERFORMANCE' END AS claim_type, CAST(CASE WHEN k = 3 THEN 1 ELSE 2 END AS BIGINT) AS n_numbers, CAST(CASE k WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS BIGINT) AS n_unsupported,
        k NOT IN (1, 2) AS accepted, CASE k WHEN 1 THEN 'not supported by citations' WHEN 2 THEN 'no valid citation' END AS reason FROM c""")
def claim_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences made of the facts: right, with a wrong figure, without valid citation, or with growth alone."""
    rows = series.growth_series(yearly(spark, sf_dir), ["entity"], "fy", "revenue", calc.growth(F.col("revenue"), F.col("prior"))["value"]).where("prior > 0")
    metrics = yearly(spark, sf_dir).select(F.concat_ws(":", F.lit("revenue"), "entity", "period").alias("metric_id"), F.lit("revenue").alias("taxonomy_key"), F.col("fy").alias("period_sort_key"), F.col("revenue").alias("value"))
    k = F.col("fy") % 4
    whole = F.round("revenue", 0).cast("decimal(20,0)").cast("string")
    wrong = F.round(F.col("revenue") * 9, 0).cast("decimal(20,0)").cast("string")
    grown = F.col("growth").cast("decimal(20,2)").cast("string")
    said = F.when(k == 3, F.concat(F.lit("Sales moved by "), grown, F.lit("% in "), "period", F.lit(" after 1999"))).otherwise(F.concat(F.lit("Revenue was "), F.when(k == 1, wrong).otherwise(whole), F.lit(" in "), "period", F.lit("A, a move of "), grown, F.lit("%")))
    mine = F.concat_ws(":", F.lit("revenue"), "entity", "period")
    before = F.concat_ws(":", F.lit("revenue"), "entity", period(F.col("fy") - 1))
    ids = F.when(k == 2, F.array(F.lit("none"))).otherwise(F.array(before, mine))
    made = rows.select(F.concat_ws(":", "entity", "period").alias("claim_id"), F.when(k == 3, "hope").otherwise("performance").alias("claim_type"), said.alias("text"), ids.alias("cited_metric_ids"))
    return claims.verify(made, metrics)


@query("""SELECT CAST(p_partkey AS VARCHAR) AS claim_id, 'VALUATION' AS claim_type, CAST(1 AS BIGINT) AS n_numbers, CAST(CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 1 END AS BIGINT) AS n_unsupported,
    p_partkey % 3 = 0 AS accepted, CASE WHEN p_partkey % 3 <> 0 THEN 'not supported by citations' END AS reason FROM part""")
def claim_upside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that state the upside of a report's price and target: right, wrong, or right without a target."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("claim_id"), (F.col("p_partkey") % 3).alias("k"), F.col("p_retailprice").cast("decimal(12,2)").alias("price"), "p_size")
    metrics = p.select(F.concat(F.lit("price:"), "claim_id").alias("metric_id"), F.lit("price").alias("taxonomy_key"), F.lit(0).alias("period_sort_key"), F.col("price").cast("decimal(20,4)").alias("value"))
    stated = (F.col("p_size") - 10 + F.when(F.col("k") == 1, 50).otherwise(0)).cast("string")
    made = p.select("claim_id", F.lit("valuation").alias("claim_type"), F.concat(F.lit("The target stands for a move of "), stated, F.lit("%")).alias("text"), F.array(F.concat(F.lit("price:"), "claim_id")).alias("cited_metric_ids"))
    target = F.when(F.col("k") != 2, F.col("price") * (90 + F.col("p_size")) / 100).cast("decimal(20,4)")
    return claims.verify(made, metrics, p.select("claim_id", target.alias("base_target"), F.col("price").cast("decimal(20,4)").alias("cmp")))
