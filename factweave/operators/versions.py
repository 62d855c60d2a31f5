"""Versions, supersession, latest-per-key reads and state folds over append-only tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(analyses: DataFrame) -> DataFrame:
    """Add ``version`` per document by creation, ``supersedes`` and the status that follows from it."""
    w = Window.partitionBy("document_id").orderBy("created_at", "id")
    newest = F.lead("id").over(w).isNull()
    return analyses.withColumn("version", F.row_number().over(w)).withColumn("supersedes", F.lag("id").over(w)).withColumn("status", F.when(newest, F.col("status")).otherwise("SUPERSEDED"))


def next_version(analyses: DataFrame) -> DataFrame:
    return analyses.groupBy("document_id").agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("next_version"))


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row per key by ``order``: an aggregate of structs, so it combines before it shuffles."""
    rest = [c for c in rows.columns if c not in (key, *order)]
    return rows.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("_l")).select(key, "_l.*")


def earliest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in (key, *order)]
    return rows.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("_l")).select(key, "_l.*")


def published_index(documents: DataFrame, analyses: DataFrame) -> DataFrame:
    """Published documents with the analysis they point to, if there is one."""
    a = analyses.select(F.col("id").alias("published_analysis_id"), F.col("version").alias("published_version"))
    return documents.where("published and status = 'PUBLISHED'").join(a, "published_analysis_id", "left")


def report(documents: DataFrame, analyses: DataFrame, children: DataFrame) -> DataFrame:
    """Published documents with their analysis and its children in order, as arrays."""
    nested = children.groupBy("analysis_id").agg(F.array_sort(F.collect_list(F.struct("ord", "label", "value"))).alias("metrics"))
    a = analyses.select(F.col("id").alias("published_analysis_id"), "version")
    found = documents.where("published").join(a, "published_analysis_id")
    return found.join(nested, F.col("published_analysis_id") == F.col("analysis_id"), "left").drop("analysis_id")


def current_state(events: DataFrame, key: str, order: str) -> DataFrame:
    """Latest state per key of a log of transitions; keys whose last event is a deletion are gone."""
    return latest(events, key, order).where("event != 'DELETED'")


def last_write(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Upsert by natural key: the last row wins."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def without_deleted(children: DataFrame, tombstones: DataFrame, key: str) -> DataFrame:
    return children.join(tombstones.select(key).distinct(), key, "left_anti")


def unique_slugs(titles: DataFrame, taken: DataFrame) -> DataFrame:
    """(id, slug): free slugs for the base slugs of ``titles``, by id: the base itself, then -2, -3, ... as far as free.

    Neither slugs in ``taken`` nor the bases of other titles of the batch are given away as a suffixed slug, so
    all results differ. The i-th title of a base gets its i-th free number; there are as many candidates as titles and
    used slugs of the base.
    """
    base = F.regexp_replace("slug", "-[0-9]+$", "")
    used = taken.select("slug").distinct()
    blocked = used.union(titles.select("slug")).distinct()
    near = blocked.groupBy(base.alias("slug")).agg(F.count("*").alias("_near"))
    sizes = titles.groupBy("slug").agg(F.count("*").alias("_m")).join(near, "slug", "left").fillna(0, ["_near"])
    # The base itself may be in ``taken`` under another stem (a-2 is near a, not near itself), hence one more.
    every = sizes.select("slug", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_m") + F.col("_near") + 1)).alias("_n"))
    every = every.withColumn("_made", F.when(F.col("_n") == 1, F.col("slug")).otherwise(F.concat("slug", F.lit("-"), F.col("_n").cast("string"))))
    first = every.where("_n = 1").join(used.withColumnRenamed("slug", "_made"), "_made", "left_anti")
    later = every.where("_n > 1").join(blocked.withColumnRenamed("slug", "_made"), "_made", "left_anti")
    free = first.unionByName(later).withColumn("_i", F.row_number().over(Window.partitionBy("slug").orderBy("_n")))
    rows = titles.withColumn("_i", F.row_number().over(Window.partitionBy("slug").orderBy("id")))
    return rows.join(free, ["slug", "_i"]).select("id", F.col("_made").alias("slug"))


def admin_list(documents: DataFrame, fields: list[str]) -> DataFrame:
    """All documents, the newest first."""
    return documents.orderBy(F.desc("created_at"), F.desc("id")).select(*fields)


def published_list(documents: DataFrame, fields: list[str]) -> DataFrame:
    """Published documents, the newest first."""
    return documents.where("published and status = 'PUBLISHED'").orderBy(F.desc("created_at"), F.desc("id")).select(*fields)


def public_file(documents: DataFrame, slug: str) -> DataFrame:
    """The file of one published document."""
    return documents.where((F.col("slug") == slug) & F.col("published")).limit(1)


def draft_report(documents: DataFrame, analyses: DataFrame, children: DataFrame) -> DataFrame:
    """Every document that has an analysis, with its latest one and that one's children in order."""
    last = latest(analyses, "document_id", "version", "id").select("document_id", F.col("id").alias("analysis_id"), "version")
    nested = children.groupBy("analysis_id").agg(F.array_sort(F.collect_list(F.struct("ord", "label"))).alias("children"))
    return documents.join(last, "document_id").join(nested, "analysis_id", "left")


def admin_document(documents: DataFrame, files: DataFrame, numbers: DataFrame, users: DataFrame) -> DataFrame:
    """Documents with their files and versions in order and the one who uploaded them, if known."""
    f = files.groupBy("document_id").agg(F.array_sort(F.collect_list("file_name")).alias("files"))
    v = numbers.groupBy("document_id").agg(F.array_sort(F.collect_list("version")).alias("versions"))
    u = users.select(F.col("user_id").alias("uploaded_by"), F.col("name").alias("uploader"))
    return documents.join(f, "document_id", "left").join(v, "document_id", "left").join(u, "uploaded_by", "left")


def approvals(analyses: DataFrame, requests: DataFrame) -> DataFrame:
    """Events that approvals append: the analysis, the document with its pointer, and the audit row, under one batch id."""
    rows = analyses.join(requests, "id").withColumn("batch", F.sha2(F.concat_ws(":", F.lit("approve"), "document_id", "id"), 256))
    events = F.array(
        F.struct(F.lit("analysis").alias("entity"), F.col("id").alias("entity_id"), F.lit("APPROVED").alias("event")),
        F.struct(F.lit("document").alias("entity"), F.col("document_id").alias("entity_id"), F.lit("PUBLISHED").alias("event")),
        F.struct(F.lit("audit").alias("entity"), F.col("document_id").alias("entity_id"), F.concat(F.lit("APPROVE by "), "user").alias("event")),
    )
    return rows.select("batch", F.col("id").alias("pointer"), F.explode(events).alias("e")).select("batch", "pointer", "e.*")


def uploads(files: DataFrame) -> DataFrame:
    """Events that accepted uploads append: document, file, queued job, first version and audit row; files refused leave none."""
    kinds = ("document", "file", "job", "version", "audit")
    states = ("PROCESSING", "STORED", "QUEUED", "1", "UPLOAD")
    events = F.array(*(F.struct(F.lit(k).alias("entity"), F.lit(s).alias("event")) for k, s in zip(kinds, states, strict=True)))
    return files.where("verdict = 'ok'").select("document_id", F.explode(events).alias("e")).select("document_id", "e.*")
