"""Validation issues, coverage, confidence, publication gate and status transitions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calc, text

TOLERANCE = 0.01

# Fields a report can't be published without.
CRITICAL_FIELDS = ("company", "recommendation", "cmp", "baseTarget", "horizon", "researchHouse", "analyst", "publishedAt")

# Legal status changes.
TRANSITIONS = [
    ("PROCESSING", "REVIEW_REQUIRED"),
    ("PROCESSING", "PARTIAL"),
    ("PROCESSING", "FAILED"),
    ("PARTIAL", "REVIEW_REQUIRED"),
    ("PARTIAL", "FAILED"),
    ("PARTIAL", "SUPERSEDED"),
    ("REVIEW_REQUIRED", "APPROVED"),
    ("REVIEW_REQUIRED", "FAILED"),
    ("REVIEW_REQUIRED", "SUPERSEDED"),
    ("APPROVED", "SUPERSEDED"),
    ("FAILED", "SUPERSEDED"),
]


def by_period(metrics: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """A column per taxonomy key and period: the first metric in input order. One pass, no self-join."""
    first = lambda k: F.min(F.when(F.col("taxonomy_key") == k, F.struct("ord", F.col("value").alias("v"))))["v"].alias(k)
    return metrics.where("period is not null").groupBy(*keys, "period").agg(*(first(k) for k in names))


def _issues(rows: DataFrame, keys: list[str], *rules: tuple[str, str, Column, Column, Column]) -> DataFrame:
    """Issues by (code, severity, reported, computed, broken): each row is looked at once for all rules."""
    told = [F.when(broken, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), reported.cast("double").alias("reported"), computed.cast("double").alias("computed"))) for code, severity, reported, computed, broken in rules]
    any_broken = reduce(Column.__or__, (F.coalesce(broken, F.lit(False)) for *_, broken in rules))
    found = rows.where(any_broken).select(*keys, "period", F.explode(F.array_compact(F.array(*told))).alias("_i"))
    return found.select(*keys, "_i.code", "_i.severity", "period", "_i.reported", "_i.computed")


def arithmetic_issues(metrics: DataFrame, keys: list[str], tolerance: float = TOLERANCE) -> DataFrame:
    """Margins and free cash flow that the report's own figures contradict. Missing inputs are no failure."""
    wide = by_period(metrics, keys, ["revenue", "ebitda", "ebitda_margin", "ocf", "capex", "fcf"])
    # Where neither is told, nothing can be contradicted.
    wide = wide.where("ebitda_margin is not null or fcf is not null")
    wide = wide.withColumn("_m", calc.margin(F.col("ebitda"), F.col("revenue"))["value"]).withColumn("_f", calc.free_cash_flow(F.col("ocf"), F.col("capex"))["value"])
    differ = lambda r, c: F.col(r).isNotNull() & F.col(c).isNotNull() & ~calc.agrees(F.col(r), F.col(c), tolerance)
    return _issues(
        wide,
        keys,
        ("ARITHMETIC_MARGIN_MISMATCH", "WARNING", F.col("ebitda_margin"), F.col("_m"), differ("ebitda_margin", "_m")),
        ("ARITHMETIC_FCF_MISMATCH", "WARNING", F.col("fcf"), F.col("_f"), differ("fcf", "_f")),
    )


def target_issues(valuations: DataFrame, keys: list[str], tolerance: float = TOLERANCE) -> DataFrame:
    """Targets that eps times pe doesn't give, and targets that aren't positive beside a positive price."""
    rows = valuations.withColumn("_t", calc.target_from_eps(F.col("eps"), F.col("pe"))["value"]).withColumn("period", F.lit(None).cast("string"))
    off = F.col("base_target").isNotNull() & F.col("_t").isNotNull() & ~calc.agrees(F.col("base_target"), F.col("_t"), tolerance)
    wrong = (F.col("cmp") > 0) & (F.col("base_target") <= 0)
    return _issues(
        rows,
        keys,
        ("ARITHMETIC_TARGET_MISMATCH", "WARNING", F.col("base_target"), F.col("_t"), off),
        ("INVALID_TARGET_CMP_RELATIONSHIP", "BLOCKER", F.col("base_target"), F.col("cmp"), wrong),
    )


def contradictions(metrics: DataFrame, keys: list[str], tolerance: float = TOLERANCE) -> DataFrame:
    """Later values of one metric, period and code that disagree with the first."""
    rows = metrics.where("value is not null and period is not null and taxonomy_key != 'unmapped'").withColumn("code", F.coalesce("classification_code", F.lit("U")))
    # Rows move by ``keys`` alone and need no join with the first.
    same = Window.partitionBy(*keys, "taxonomy_key", "period", "code")
    joined = rows.select(*keys, "taxonomy_key", "period", "code", "ord", "value").repartition(*keys).withColumn("f", F.min(F.struct("ord", "value")).over(same)).where("ord != f.ord")
    return joined.where(~calc.agrees(F.col("f.value"), F.col("value"), tolerance)).select(*keys, "taxonomy_key", "period", F.col("code").alias("classification_code"), "ord", F.col("f.value").cast("double").alias("first_value"), F.col("value").cast("double").alias("other_value"))


def mixed_units(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Metrics that appear with more than one currency and scale."""
    unit = F.concat(F.coalesce("currency", F.lit("?")), F.lit("/"), F.coalesce("scale", F.lit("?")))
    rows = metrics.where("value is not null and taxonomy_key != 'unmapped'").groupBy(*keys, "taxonomy_key").agg(F.array_sort(F.collect_set(unit)).alias("u"))
    return rows.where(F.size("u") > 1).select(*keys, "taxonomy_key", F.array_join("u", ",").alias("units"))


def missing_fields(records: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """A BLOCKER for every critical field that is null or blank, with its fingerprint."""
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("v")) for f in fields))
    rows = records.select(*keys, F.explode(F.filter(pairs, lambda p: F.coalesce(F.trim(p["v"]), F.lit("")) == "")).alias("p"))
    mark = text.issue_fingerprint("MISSING_CRITICAL_FIELD", "DocumentAnalysis", F.lit(None).cast("string"), {"field": F.col("p.field")})
    return rows.select(*keys, F.lit("MISSING_CRITICAL_FIELD").alias("code"), F.lit("BLOCKER").alias("severity"), F.col("p.field").alias("field"), mark.alias("fingerprint"))


def once(issues: DataFrame, keys: list[str], order: str) -> DataFrame:
    """First issue per fingerprint."""
    return issues.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "fingerprint").orderBy(order))).where("_r = 1").drop("_r")


def confidence_level(status: Column, has_conflict: Column) -> Column:
    return (
        F.when(has_conflict | (status == "CONFLICTING"), "CONFLICTING")
        .when(status.isNull(), "MISSING")
        .when(status == "EXACT_MATCH", "HIGH")
        .when(status == "NORMALIZED_MATCH", "MEDIUM")
        .when(status == "APPROXIMATE_MATCH", "LOW")
        .otherwise("UNVERIFIED")
    )


def legacy_confidence(sections_without_evidence: Column, metrics_without_excerpt: Column) -> Column:
    return F.round(F.greatest(F.lit(0.1), F.least(F.lit(1.0), 1.0 - 0.1 * sections_without_evidence - 0.05 * metrics_without_excerpt)), 2)


#: What the coverage of an analysis is told from.
COUNTS = ["n_metrics", "n_metrics_ok", "n_sections", "n_sections_ok", "n_conflicts", "n_warnings", "n_missing"]


def coverage_counts(metrics: DataFrame, sections: DataFrame, issues: DataFrame, key: str) -> DataFrame:
    """``COUNTS`` that each metric, section and issue adds to those of its analysis."""
    ok = text.verbatim(F.col("evidence_verification"))
    conflict = (F.col("severity") == "BLOCKER") | (F.col("code") == "CONTRADICTORY_METRIC_VALUE")
    verified = lambda name: {name: F.lit(True), f"{name}_ok": ok}
    tables = [(metrics, verified("n_metrics")), (sections, verified("n_sections")), (issues, {"n_conflicts": conflict, "n_warnings": F.col("severity") == "WARNING", "n_missing": F.col("code") == "MISSING_CRITICAL_FIELD"})]
    add = lambda rows, told: rows.select(key, *(F.coalesce(told.get(c, F.lit(False)).cast("int"), F.lit(0)).alias(c) for c in COUNTS))
    return reduce(DataFrame.unionByName, [add(rows, told) for rows, told in tables])


def graded() -> dict[str, Column]:
    """Verified shares and the tier that ``COUNTS`` of an analysis give. Shares are whole thousandths, half up."""
    share = lambda ok, n: F.when(F.col(n) == 0, F.lit(0)).otherwise(F.expr(f"(2000 * {ok} + {n}) div (2 * {n})"))
    numeric, narrative = share("n_metrics_ok", "n_metrics"), share("n_sections_ok", "n_sections")
    tier = (
        F.when((F.col("n_missing") == 0) & (F.col("n_conflicts") == 0) & (numeric >= 900) & (narrative >= 800), "EXCELLENT")
        .when((F.col("n_conflicts") == 0) & (numeric >= 750) & (F.col("n_missing") <= 1), "GOOD")
        .when(numeric >= 500, "FAIR")
        .otherwise("POOR")
    )
    return {"numeric_coverage": numeric / 1000, "narrative_coverage": narrative / 1000, "tier": tier}


def coverage(metrics: DataFrame, sections: DataFrame, issues: DataFrame, key: str) -> DataFrame:
    """Verified shares, conflicts, reviews and the tier of each analysis that has a metric, section or issue, counted in one aggregate."""
    rows = coverage_counts(metrics, sections, issues, key).groupBy(key).agg(*(F.sum(c).alias(c) for c in COUNTS))
    review = F.col("n_metrics") - F.col("n_metrics_ok") + F.col("n_warnings")
    shares = graded()
    return rows.select(key, *(shares[c].alias(c) for c in ("numeric_coverage", "narrative_coverage")), "n_conflicts", review.alias("n_review"), "n_missing", shares["tier"].alias("tier"))


def publication_gate(analyses: DataFrame, issues: DataFrame, acks: DataFrame) -> DataFrame:
    """Reasons against publishing each analysis, in rule order; none means it may be published.

    Blockers can't be waived. The last acknowledgement of a warning counts, and only while its fingerprint is
    the warning's. A partial extraction needs a complete override.
    """
    last = acks.groupBy("issue_id").agg(F.max(F.struct("ord", "fingerprint"))["fingerprint"].alias("fingerprint"))
    waived = issues.where("severity = 'WARNING'").join(last, ["issue_id", "fingerprint"], "left_anti").groupBy("analysis_id").agg(F.count("*").alias("warnings"))
    stops = issues.where("severity = 'BLOCKER'").groupBy("analysis_id").agg(F.count("*").alias("blockers"))
    rows = analyses.join(stops, "analysis_id", "left").join(waived, "analysis_id", "left").fillna(0, ["blockers", "warnings"])
    complete = F.col("override_reviewed") & (F.trim("override_justification") != "") & (F.trim("override_notice") != "")
    incomplete = F.col("is_partial") & ~F.coalesce(complete, F.lit(False))
    rules = [
        (F.col("requested_revision") != F.col("current_revision"), "STALE_REVISION"),
        (F.col("status") != "APPROVED", "STATUS"),
        (incomplete, "PARTIAL_WITHOUT_OVERRIDE"),
        (F.col("blockers") > 0, "OPEN_BLOCKERS"),
        (F.col("warnings") > 0, "UNACKNOWLEDGED_WARNINGS"),
    ]
    reasons = F.array_compact(F.array(*(F.when(broken, name) for broken, name in rules)))
    return rows.select("analysis_id", F.array_join(reasons, ",").alias("reasons"), (F.size(reasons) == 0).alias("publishable"))


def illegal_transitions(changes: DataFrame) -> DataFrame:
    """Status changes that no edge of the table allows."""
    legal = changes.sparkSession.createDataFrame(TRANSITIONS, "from_status string, to_status string")
    return changes.join(F.broadcast(legal), ["from_status", "to_status"], "left_anti")


def legal_transitions(changes: DataFrame) -> DataFrame:
    """``changes`` as they are; the first illegal one ends the job when it is read."""
    legal = changes.sparkSession.createDataFrame(TRANSITIONS, "from_status string, to_status string").withColumn("_ok", F.lit(True))
    marked = changes.join(F.broadcast(legal), ["from_status", "to_status"], "left")
    broken = F.raise_error(F.concat(F.lit("illegal transition "), "from_status", F.lit(" to "), "to_status")).cast("boolean")
    return marked.where(F.when(F.col("_ok"), True).otherwise(broken)).drop("_ok")
