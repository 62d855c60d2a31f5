"""What a finished analysis writes, for both contracts: all its tables in one commit, under the document's next version.

Rows are only appended. An earlier analysis is superseded because a later version exists, and a document's or job's state is its last
event; nothing is updated in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as texts
from ..sources import extraction
from ..sources.commits import Store
from ..sources.scratch import stored
from . import checks, report, versions

ANALYSES = "analysis_id string, doc_id bigint, version int, status string, summary string, recommendation string, valuation string, risks string, confidence double, model string"
#: What the first contract writes of a document and its arrays.
WRITTEN = {"own": ("title", "company", "recommendation", "valuationMethodology"), "metrics": ("name", "value", "unit", "period", "category", "sourceExcerpt"), "sections": ("title", "summary", "evidence")}
EVENTS = "entity string, entity_id string, doc_id bigint, event string, version int"


def with_next_versions(store: Store, seen: int, rows: DataFrame) -> DataFrame:
    """``rows`` that name a document, with the version that comes next for it."""
    had = store.read("analyses", ANALYSES, seen).groupBy("doc_id").agg(F.max("version").alias("_last"))
    named = rows.where("doc_id is not null").join(had, "doc_id", "left")
    return named.withColumn("version", (F.coalesce("_last", F.lit(0)) + 1).cast("int")).drop("_last")


def _events(rows: DataFrame, entity: str, entity_id: Column, event: Column) -> DataFrame:
    return rows.select(F.lit(entity).alias("entity"), entity_id.cast("string").alias("entity_id"), "doc_id", event.alias("event"), "version")


def with_number(rows: DataFrame, value: str, to: str) -> DataFrame:
    """Add the number of a text once all but digits, points and dashes are gone; null if it begins with none or with one of no finite size.

    In steps, each of which uses the one before twice, so that none is computed twice.
    """
    digits = F.regexp_extract(F.regexp_replace(value, "[^0-9.-]+", ""), "^-?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)", 0)
    rows = rows.withColumn("_digits", digits).withColumn("_number", F.when(F.col("_digits") != "", F.col("_digits").try_cast("double")))
    return rows.withColumn(to, F.when(F.abs("_number") < float("inf"), F.col("_number"))).drop("_digits", "_number")


def first_contract(store: Store, batch: str, rows: DataFrame, model: str) -> int:
    """Commit (doc_id, job_id, payload) of the first contract; a payload that doesn't conform fails its job and leaves no analysis.

    A document has one row in a batch.
    """

    def make(seen: int) -> dict[str, DataFrame]:
        named = with_next_versions(store, seen, rows)
        read = stored(extraction.read_legacy(named.select("doc_id", "job_id", "version", "payload"), fields=WRITTEN).withColumnRenamed("conforms", "ok"), "first-contract")
        id_ = texts.run_id(F.col("doc_id"), F.concat_ws(":", F.lit(batch), "version"))
        good = read.where("ok").withColumn("analysis_id", id_)
        bare = lambda field: lambda x: F.trim(x[field]) == ""
        confidence = checks.legacy_confidence(F.size(F.filter("sections", bare("evidence"))), F.size(F.filter("metrics", bare("sourceExcerpt"))))
        said = lambda label, field: F.when(F.col(field) != "", F.concat(F.lit(f"{label}: "), F.col(field)))
        summary = F.concat_ws("\n", said("Title", "title"), said("Target", "company"), said("Recommendation", "recommendation"))
        analyses = good.select("analysis_id", "doc_id", "version", F.lit("REVIEW_REQUIRED").alias("status"), summary.alias("summary"), "recommendation", F.col("valuationMethodology").alias("valuation"), F.to_json("risks").alias("risks"), confidence.cast("double").alias("confidence"), F.lit(model).alias("model"))
        each = lambda name: good.select("analysis_id", "doc_id", F.posexplode(name).alias("ord", "x"))
        sections = each("sections").select("analysis_id", "doc_id", "ord", F.col("x.title").alias("heading"), F.col("x.summary").alias("content"), F.col("x.evidence").alias("source_excerpt"))
        metrics = with_number(each("metrics").select("analysis_id", "doc_id", "ord", F.col("x.name").alias("label"), "x.value", "x.unit", "x.period", "x.category"), "value", "numeric_value")
        charts = each("charts").select("analysis_id", "doc_id", "ord", "x.type", "x.title", F.to_json(F.struct("x.labels", "x.series")).alias("config"))
        jobs = _events(read, "job", F.col("job_id"), F.when(F.col("ok"), "DONE").otherwise("FAILED"))
        documents = _events(read, "document", F.col("doc_id"), F.lit("RELEASED"))
        return {"analyses": analyses, "sections": sections, "metrics": metrics, "charts": charts, "events": jobs.unionByName(documents)}

    return store.transact(batch, make)


def second_contract(store: Store, batch: str, chunks: DataFrame, pages: DataFrame, documents: DataFrame, as_of_year: int, model: str) -> int:
    """Commit whole reports assembled from the JSON of chunks."""

    def make(seen: int) -> dict[str, DataFrame]:
        had = store.read("analyses", ANALYSES, seen).select(F.col("doc_id").alias("document_id"), "version")
        made = report.assemble(chunks, pages, documents, had, as_of_year)
        id_ = texts.run_id(F.col("doc_id"), F.concat_ws(":", F.lit(batch), "version"))
        head = stored(made.summary.select("doc_id", F.col("version").cast("int").alias("version"), "status").withColumn("analysis_id", id_), "report-heads")
        # Tables small as files can be large in memory: sides are sorted and merged, none is sent whole through the driver.
        ids = head.select("doc_id", "analysis_id").hint("merge")
        rating = made.valuation.select("doc_id", "rating", "valuationBasis").hint("merge")
        target = made.identity.select("doc_id", "companyName").hint("merge")
        risks = made.narratives.where("kind = 'risk'").groupBy("doc_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("position", F.struct(F.col("title").alias("risk"), F.col("body").alias("explanation"), F.col("quote").alias("evidence")).alias("r")))), lambda x: x["r"])).alias("risks")).hint("merge")
        summary = F.concat_ws("\n", F.concat(F.lit("Target: "), "companyName"), F.concat(F.lit("Recommendation: "), "rating"))
        analyses = head.join(rating, "doc_id", "left").join(target, "doc_id", "left").join(risks, "doc_id", "left").select("analysis_id", "doc_id", "version", "status", summary.alias("summary"), F.col("rating").alias("recommendation"), F.col("valuationBasis").alias("valuation"), "risks", F.lit(None).cast("double").alias("confidence"), F.lit(model).alias("model"))
        own = lambda rows: rows.join(ids, "doc_id")
        kinds = {"section": "sections", "risk": "risk_items", "catalyst": "catalysts", "thesis": "drivers"}
        tables = {name: own(made.narratives.where(F.col("kind") == kind).drop("kind")) for kind, name in kinds.items()}
        status = F.when(F.size("conflicts") > 0, "CONFLICTING").otherwise("UNVERIFIED")
        events = _events(head, "document", F.col("doc_id"), F.lit("RELEASED")).unionByName(_events(head, "run", F.col("analysis_id"), F.when(F.col("status") == "PARTIAL", "PARTIAL").otherwise("COMPLETED")))
        w = Window.partitionBy("doc_id", "fingerprint").orderBy("code")
        issues = own(made.issues).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")  # as stored: one of a fingerprint
        points = own(made.chart_points.withColumn("doc_id", F.col("doc_id").cast("bigint")))
        return {"analyses": analyses, **tables, "metrics": own(made.metrics.withColumn("validation_status", status)), "evidence": own(made.evidence), "chart_points": points, "issues": issues, "events": events}

    return store.transact(batch, make)


def current(store: Store, version: int | None = None) -> DataFrame:
    """Analyses as they stand: all but a document's last version are superseded."""
    rows = store.read("analyses", ANALYSES, version)
    last = Window.partitionBy("doc_id")
    return rows.withColumn("status", F.when(F.col("version") < F.max("version").over(last), "SUPERSEDED").otherwise(F.col("status")))


def states(store: Store, entity: str) -> DataFrame:
    """entity_id and its last event."""
    rows = store.read("events", EVENTS).where(F.col("entity") == entity)
    return versions.latest(rows.select("entity_id", "version", "event"), "entity_id", "version").select("entity_id", "event")
